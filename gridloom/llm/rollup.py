"""Token counts as delta-maintained rollups.

A batch of signed changes (inserts, deletes and revised counts) becomes one small table of additive deltas by source,
language and tokenizer version. A batch's folder is its commit: written under a name of its own, then renamed to
`batch=<id>`, so that a batch applied twice, or half applied by a run that died, counts once. compact() folds all deltas
into one folder `fold=<number>` that also says which folders it stands for: the one rename that makes the fold visible
takes those folders out of the totals. They are deleted by the compaction after it, so that readers can end.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"


class Rollup:
    """Totals under a path that driver and executors share, in a file system that renames folders in one step."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    def _state(self) -> tuple[list[str], set[str], set[str], int]:
        """Folders whose deltas count, folders that a fold stands for, ids of all batches ever committed, last fold."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.path)))
        folds = [x for x in names if x.startswith("fold=")]
        known, gone = {x[6:] for x in names if x.startswith("batch=")}, set()
        for x in folds:
            said = self._read(f"{self.path}/{x}/folded.json")
            known |= set(said["batches"])
            gone |= set(said["folders"])
        live = [x for x in names if x.startswith(("batch=", "fold=")) and x not in gone]
        return live, gone & set(names), known, max([int(x[5:]) for x in folds], default=0)

    def _read(self, path: str) -> dict:
        stream = self._fs.open(self._path(path))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, path: str, text: str) -> None:
        stream = self._fs.create(self._path(path))
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def committed(self) -> list[str]:
        """Ids of all batches ever committed, folded ones too."""
        return sorted(self._state()[2])

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit the changes once; False, and nothing is done, if the batch is committed already.

        changes: op ('insert', 'delete' or 'revise'), source, lang, tokenizer, old_tokens, new_tokens. An insert adds
        a document with new_tokens, a delete takes one with old_tokens away, a revision adds new_tokens - old_tokens.
        Null counts are 0; null keys are keys of their own; other ops, nulls too, change nothing; repeated rows are
        changes each. Other columns are left alone. Deltas are summed before they are shuffled, so that a source
        with a third of all changes costs no more than others.
        """
        if not batch or any(c in batch for c in "/=: "):
            raise ValueError(f"no name for a batch: {batch!r}")
        if batch in self._state()[2]:
            return False
        old, new = F.coalesce("old_tokens", F.lit(0)), F.coalesce("new_tokens", F.lit(0))
        op = F.col("op")
        documents = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0)
        tokens = F.when(op == "insert", new).when(op == "delete", -old).when(op == "revise", new - old).otherwise(0)
        delta = changes.groupBy(*KEYS).agg(F.sum(documents).cast("long").alias("documents"), F.sum(tokens).cast("long").alias("tokens"))
        own = self._prepare(delta)
        # a fold that was committed meanwhile may have taken the batch in and its folder may be gone
        if batch in self._state()[2]:
            self._fs.delete(self._path(own), True)
            return False
        return self._commit(own, f"batch={batch}")

    def _prepare(self, delta: DataFrame, folded: dict | None = None) -> str:
        """Write a folder under a name of its own."""
        own = f"{self.path}/_new-{uuid.uuid4().hex}"
        delta.write.option("compression", "zstd").parquet(own)
        if folded is not None:
            self._write(f"{own}/folded.json", json.dumps(folded))
        self._write(f"{own}/_owner-{own.rsplit('/', 1)[1]}", "")
        return own

    def _commit(self, own: str, name: str) -> bool:
        """Give a folder its name; False if another has it. The folder that has the name says whose it is, as a rename
        to an existing folder may put the later one inside it."""
        target, short = f"{self.path}/{name}", own.rsplit("/", 1)[1]
        path = self._path
        if not self._fs.exists(path(target)):
            self._fs.rename(path(own), path(target))
            if self._fs.exists(path(f"{target}/_owner-{short}")):
                return True
        self._fs.delete(path(f"{target}/{short}"), True)
        self._fs.delete(path(own), True)
        return False

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens), without groups of no documents and no tokens."""
        return self._sum(self._state()[0])

    def _sum(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/{x}/*.parquet" for x in folders))
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents != 0 or tokens != 0")

    def compact(self) -> bool:
        """Fold all deltas into one folder; batches stay known, so that none can be applied again. False if there is
        nothing to fold or another compaction was faster. A run that dies at any step changes no total."""
        live, gone, known, last = self._state()
        if len(live) < 2:
            return False
        own = self._prepare(self._sum(live), {"folders": sorted({*live, *gone}), "batches": sorted(known)})
        if not self._commit(own, f"fold={last + 1:012}"):
            return False
        for x in gone:
            self._fs.delete(self._path(f"{self.path}/{x}"), True)
        return True
