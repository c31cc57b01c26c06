"""Line dedup by content-defined chunks of lines.

A line's hash is the leading 60 bits of its MD5. A rolling hash runs over the last two line hashes, (31 * h1 + h2) mod M;
a chunk ends after a line where it has a local minimum, and after LONGEST lines at most. Minima never stand side by side,
so that chunks have two lines and more but for a text's last and the rest of a long one, and they depend on four lines
only, so that insertions shift no other boundary. Chunks of several lines that occur again are removed but for the first
occurrence (smallest id, then position). A match is carried on, line by line, into the chunks beside it, as long as
lines equal those beside the first occurrence. All that goes is compared by its bytes first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, drop_scratch, join_small, scratch, ship, text_column, trimmed

#: Lines of a chunk at most; the modulus of the rolling hash (fixed values, SQL uses them too).
LONGEST, MODULUS = 16, 1_000_003


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.md5(line.encode()).digest()[:8], "big") >> 4


def chunks(hashes: list[int]) -> list[tuple[int, int]]:
    """(first line, number of lines) of each chunk, from the hashes of a text's lines."""
    n = len(hashes)
    h = [x % MODULUS for x in hashes]
    r = [(31 * a + b) % MODULUS for a, b in zip([0, *h], h)]
    ends = [k + 1 for k in range(1, n - 1) if r[k - 1] > r[k] <= r[k + 1]]
    out = []
    for a, z in zip([0, *ends], [*ends, n]):
        out += [(k, min(LONGEST, z - k)) for k in range(a, z, LONGEST)]
    return out


def _split(text: str) -> tuple[list[str], list[int]]:
    lines = text.split("\n")
    return lines, list(map(line_hash, lines))


def _found(batches):
    """Chunks of several lines: (k1, k2, at, h1, h2), a 128-bit hash."""
    for b in batches:
        rows, at, ck = [], [], []
        for k, t in enumerate(text_column(b, "text").to_pylist()):
            if "\n" not in t:
                continue
            lines, hashes = _split(t)
            for i, n in chunks(hashes):
                if n > 1:
                    rows.append(k)
                    at.append(i)
                    ck.append(hashlib.blake2b("\n".join(lines[i : i + n]).encode(), digest_size=16).digest())
        take = pa.array(rows, pa.int64())
        h = np.frombuffer(b"".join(ck), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(at, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1])], ["k1", "k2", "at", "h1", "h2"])


def _sides(batches):
    """Marked chunks with the hashes of the lines beside them, nearest first: those of the next chunk that stays, or,
    beside a first occurrence, as many as a chunk may have."""
    for b in batches:
        out: list = [[] for _ in range(9)]
        for k1, k2, t, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_column(b, "text").to_pylist(), b.column(b.schema.get_field_index("marks")).to_pylist(), strict=True):
            own = {m["at"]: m for m in marks}
            hashes = list(map(line_hash, t.split("\n")))
            parts = chunks(hashes)
            for j, (i, n) in enumerate(parts):
                m = own.get(i)
                if m is None:
                    continue
                z = i + n
                if m["stays"]:
                    a, e = i - LONGEST, z + LONGEST
                else:
                    gone = [0 <= x < len(parts) and parts[x][0] in own and not own[parts[x][0]]["stays"] for x in (j - 1, j + 1)]
                    a = parts[j - 1][0] if j and not gone[0] else i
                    e = sum(parts[j + 1]) if j + 1 < len(parts) and not gone[1] else z
                for column, x in zip(out, (k1, k2, i, n, m["h1"], m["h2"], m["stays"], hashes[max(0, a) : i][::-1], hashes[z:e])):
                    column.append(x)
        kinds = [pa.int64()] * 6 + [pa.bool_()] + [pa.list_(pa.int64())] * 2
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["k1", "k2", "at", "n", "h1", "h2", "stays", "before", "after"])


def _bytes(batches):
    """Bytes of what is to go and of its first occurrence: (h1, h2, eb, ea, body)."""
    for b in batches:
        out: list = [[] for _ in range(5)]
        for t, marks in zip(text_column(b, "text").to_pylist(), b.column(b.schema.get_field_index("marks")).to_pylist(), strict=True):
            lines = t.split("\n")
            for m in marks:
                body = "\n".join(lines[m["at"] - m["eb"] : m["at"] + m["n"] + m["ea"]]).encode()
                for column, x in zip(out, (m["h1"], m["h2"], m["eb"], m["ea"], body)):
                    column.append(x)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["h1", "h2", "eb", "ea", "body"])


def _cut(batches):
    for b in batches:
        at = b.schema.get_field_index
        out, n, gone = [], [], []
        texts, marks = text_column(b, "text").to_pylist(), b.column(at("marks")).to_pylist()
        valid = b.column(at("text")).is_valid().to_pylist()
        for t, cuts, ok in zip(texts, marks, valid, strict=True):
            if not cuts:
                out.append(t if ok else None)
                n.append(0)
                gone.append(0)
                continue
            lines = t.split("\n")
            stays = bytearray(b"\1" * len(lines))
            for m in cuts:
                a, z = m["at"] - m["eb"], m["at"] + m["n"] + m["ea"]
                stays[a:z] = bytes(z - a)
            out.append("\n".join(x for x, s in zip(lines, stays) if s))
            n.append(len(cuts))
            gone.append(stays.count(0))
        keep = [k for k in range(b.num_columns) if b.schema.names[k] not in ("text", "marks")]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(out, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*(b.schema.names[k] for k in keep), "text", "chunks", "lines"])


def _alike(own: str, first: str) -> Column:
    """How many leading elements of two arrays are equal, all of `own` at most."""
    p = F.array_position(F.zip_with(own, first, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(p == 0, F.size(own)).otherwise(p - 1).cast("int")


def _by_text(marks: DataFrame, name: str, each: int) -> tuple[DataFrame, bool]:
    """Lists of marks by (k1, k2), written, and whether they are small enough to broadcast."""
    out = scratch(marks.groupBy("k1", "k2").agg(F.collect_set(F.struct(*(c for c in marks.columns if c not in ("k1", "k2")))).alias("marks")), name)
    return out, out.agg(F.count(F.lit(1)) * 48 + F.coalesce(F.sum(F.size("marks") * each), F.lit(0))).first()[0] <= BROADCAST_BYTES


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """docs with its columns, the text without repeated chunks of lines; report: also (_chunks, _lines), how many went.

    Lines end at "\\n". Every row stays, also one of whose text nothing is left. Null texts stay null and empty texts
    empty. Rows that repeat id and text are one document: they lose the same chunks, and the first keeps its own.
    Null ids come first among ids. No rows: no rows.

    Chunks meet by 128-bit hashes, lines beside them by 60 bits. Least and greatest bytes of all that one hash and its
    extension stand for are compared; where they differ nothing of it is removed. Only texts with marks are read again
    between the first pass and the last, and joined with their marks behind a size check.
    """
    spark = docs.sparkSession
    ship(spark)
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("k1"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("k2"), F.col(text_col).cast("string").alias("text"))
    slim = keyed.select("k1", "k2", "text")
    wide = lambda side: F.broadcast(side[0]) if side[1] else side[0]
    occ = scratch(slim.where("text is not null").mapInArrow(trimmed(_found), "k1 long, k2 long, at long, h1 long, h2 long").distinct(), "chunks")
    first = F.min(F.struct("k1", "k2", "at")).alias("first")
    again = scratch(occ.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1").select("h1", "h2", "first"), "again")
    marks = join_small(occ, again, ["h1", "h2"], "inner", 64).select("k1", "k2", "at", "h1", "h2", (F.struct("k1", "k2", "at") == F.col("first")).alias("stays"))
    marked = _by_text(marks, "marked", 48)
    sides = slim.join(wide(marked), ["k1", "k2"]).select("k1", "k2", "text", "marks").mapInArrow(trimmed(_sides), "k1 long, k2 long, at long, n long, h1 long, h2 long, stays boolean, before array<bigint>, after array<bigint>")
    sides = scratch(sides, "sides")
    drop_scratch(occ)
    kept = sides.where("stays").groupBy("h1", "h2").agg(F.min(F.struct("k1", "k2", "at", F.col("before").alias("b"), F.col("after").alias("a"))).alias("f"))
    gone = join_small(sides.where("not stays"), scratch(kept, "first"), ["h1", "h2"], "inner", 320)
    gone = gone.select("k1", "k2", "at", "n", "h1", "h2", _alike("before", "f.b").alias("eb"), _alike("after", "f.a").alias("ea"), F.col("f.k1").alias("f1"), F.col("f.k2").alias("f2"), F.col("f.at").alias("fat"))
    gone = scratch(gone.distinct(), "gone")
    ends = gone.select("k1", "k2", "at", "n", "h1", "h2", "eb", "ea").unionByName(gone.select(F.col("f1").alias("k1"), F.col("f2").alias("k2"), F.col("fat").alias("at"), "n", "h1", "h2", "eb", "ea").distinct())
    texts = slim.join(wide(_by_text(ends, "ends", 64)), ["k1", "k2"]).select("text", "marks").mapInArrow(trimmed(_bytes), "h1 long, h2 long, eb int, ea int, body binary")
    differ = scratch(texts.groupBy("h1", "h2", "eb", "ea").agg(F.min("body").alias("x"), F.max("body").alias("y")).where("x != y").select("h1", "h2", "eb", "ea"), "differ")
    cut = _by_text(join_small(gone, differ, ["h1", "h2", "eb", "ea"], "left_anti", 40).select("k1", "k2", "at", "n", "eb", "ea"), "cut", 40)
    for x in (marked[0], sides, gone):
        drop_scratch(x)
    done = keyed.join(wide(cut), ["k1", "k2"], "left").select("row", "text", "marks")
    schema = docs.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()
    out = done.mapInArrow(trimmed(_cut), f"row {schema}, text string, chunks long, lines long")
    return out.select(*(F.col("text").alias(text_col) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns), *((F.col("chunks").alias("_chunks"), F.col("lines").alias("_lines")) if report else ()))
