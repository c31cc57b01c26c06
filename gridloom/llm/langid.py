"""Language identification with word-first backoff.

A word that the training texts know scores by its smoothed log frequency in each language. An unseen word falls back
to its character n-grams, the longest length of which some gram is known: 5, then 4, 3, 2, 1. A text's score is the
sum over its words; the answer is the language with the highest mean.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, scratch, ship, text_column
from .quality import held_out

#: Training texts of a language, those with the smallest hashes; words and n-grams of each length that the model keeps
#: of a language, the most frequent; entries of the whole model, shared evenly by more languages; languages up to which
#: an entry has a number for each.
SAMPLE, WORDS, GRAMS, ENTRIES, DENSE = 1_500, 30_000, 20_000, 1_000_000, 32
#: Lengths of n-grams; what a word may differ from the mean over languages; words of a text that count as evidence.
LENGTHS, BOUND, EVIDENCE = (5, 4, 3, 2, 1), 6.0, 50
#: Runs of letters, and of numerals other than decimal digits, which are taken along for speed.
_WORDS = re.compile(r"[^\W\d_]+").findall
_MEMORY = 200_000


def _grams(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Model:
    """Log frequencies by language, centred on their mean over languages.

    An entry is a tuple of a number a language where languages are few, else (the languages that have the word, their
    numbers, the mean): all others have the language's number for what it has not, less the mean.
    """

    def __init__(self, langs: list[str], words: list[Counter], grams: list[list[Counter]]) -> None:
        self.langs = langs
        self.few = len(langs) <= DENSE
        self.words = self._table(words)
        self.grams = [self._table([g[k] for g in grams]) for k in range(len(LENGTHS))]
        self.memory: dict = {}

    def _table(self, counts: list[Counter]) -> tuple[np.ndarray, dict]:
        own: dict = {}
        for k, c in enumerate(counts):
            for key, n in c.items():
                own.setdefault(key, []).append((k, n))
        total = np.log(np.array([sum(c.values()) for c in counts], float) + 0.5 * len(own)) if own else np.zeros(len(counts))
        none = math.log(0.5) - total
        whole, out = float(none.sum()), {}
        for key, pairs in own.items():
            at = [k for k, _ in pairs]
            v = [math.log(n + 0.5) - total[k] for k, n in pairs]
            mean = (whole + sum(v) - sum(none[k] for k in at)) / len(counts)
            if self.few:
                row = none - mean
                row[at] = np.array(v) - mean
                out[key] = tuple(np.clip(row, -BOUND, BOUND).tolist())
            else:
                out[key] = (np.array(at, np.int32), np.clip(np.array(v) - mean, -BOUND, BOUND), mean)
        return none, out

    def __getstate__(self):
        return self.__dict__ | {"memory": {}}

    def _row(self, table: tuple[np.ndarray, dict], entry):
        if self.few:
            return entry
        row = np.clip(table[0] - entry[2], -BOUND, BOUND)
        row[entry[0]] = entry[1]
        return row

    def word(self, w: str):
        got = self.words[1].get(w)
        if got is not None:
            return self._row(self.words, got)
        got = self.memory.get(w)
        if got is None:
            got = self._backoff(w)
            if len(self.memory) * len(self.langs) < _MEMORY and len(w) <= 64:
                self.memory[w] = got
        return got

    def _backoff(self, w: str):
        for n, table in zip(LENGTHS, self.grams, strict=True):
            hit = [self._row(table, table[1][g]) for g in _grams(w, n) if g in table[1]]
            if hit:
                return tuple(sum(x) / len(hit) for x in zip(*hit, strict=True)) if self.few else sum(hit) / len(hit)
        return (0.0,) * len(self.langs) if self.few else np.zeros(len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and posterior. `und` and 0.0 without letters or without a trained language."""
        count = Counter(_WORDS((text or "").lower()))
        if not self.langs or not any(c.isalpha() for w in count for c in w):
            return "und", 0.0
        word = self.word
        if self.few:
            total = [0.0] * len(self.langs)
            for w, n in count.items():
                for k, v in enumerate(word(w)):
                    total[k] += n * v
        else:
            total = sum(n * word(w) for w, n in count.items()).tolist()
        size = sum(count.values())
        # words are far from independent: the evidence of a long text is that of at most so many words
        z = [v / size * min(size, EVIDENCE) for v in total]
        top = max(z)
        e = [math.exp(v - top) for v in z]
        best = max(range(len(z)), key=lambda k: (z[k], -k))
        return self.langs[best], e[best] / sum(e)


def drawn(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, text): of each language the `sample` texts with the smallest hashes of id and text, all if fewer.

    Learned from are rows with a language and a text whose crc32(id) mod 4 isn't 2. Rows that repeat id, text and
    language are one. The hash up to which a language's texts are drawn comes from counts by its leading bits, twice
    refined, so that no language's hashes meet in one task but about `sample`. Texts stay where they are.
    """
    ok = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 4, 2)).select("lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("h"))
    few = scratch(ok.select("lang", "h").distinct(), "hashes")
    limit = lambda rows: rows.withColumn("_l", F.encode("lang", "UTF-8"))
    for bits in (12, 24):
        place = F.shiftright("h", 63 - bits)
        hist = few.groupBy("lang", place.alias("b")).count()
        run = hist.withColumn("before", F.sum("count").over(Window.partitionBy("lang").orderBy("b")) - F.col("count"))
        last = scratch(run.where(F.col("before") < sample).groupBy("lang").agg(F.max("b").alias("_b")), "limits")
        few = scratch(join_small(few, limit(last), ["lang"], "inner", 48, "_l").where(place <= F.col("_b")).select("lang", "h"), "hashes")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    last = scratch(few.withColumn("r", rank).where(F.col("r") <= sample).groupBy("lang").agg(F.max("h").alias("_h")), "limits")
    return join_small(ok, limit(last), ["lang"], "inner", 48, "_l").where(F.col("h") <= F.col("_h")).dropDuplicates(["lang", "h"]).select("lang", "text")


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """From (doc_id, text, lang). A model holds every language that has a text to learn from; its entries, and so what
    the driver collects and the executors get, are at most ENTRIES or one of each kind a language."""
    chosen = scratch(drawn(docs, sample), "drawn")
    names = sorted(r.lang for r in chosen.select("lang").distinct().collect())
    share = max(1, ENTRIES // (max(1, len(names)) * (1 + len(LENGTHS))))
    total = chosen.mapInArrow(_count, "lang string, kind int, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "gram"))
    top = total.withColumn("r", rank).where(F.col("r") <= F.when(F.col("kind") == 0, min(WORDS, share)).otherwise(min(GRAMS, share))).select("lang", "kind", "gram", "n").toPandas()
    parts = {k: dict(zip(v.gram, v.n.astype(int), strict=True)) for k, v in top.groupby(["lang", "kind"])}
    get = lambda x, k: Counter(parts.get((x, k), {}))
    return Model(names, [get(x, 0) for x in names], [[get(x, n) for n in LENGTHS] for x in names])


def _count(batches):
    for b in batches:
        by: dict = {}
        for lang, t in zip(b.column(0).to_pylist(), text_column(b, "text").to_pylist(), strict=True):
            by.setdefault(lang, Counter()).update(_WORDS(t.lower()))
        lang, kind, gram, n = [], [], [], []
        for x, words in by.items():
            got = {0: words} | {k: Counter() for k in LENGTHS}
            for w, m in words.items():
                for k in LENGTHS:
                    for g in _grams(w, k):
                        got[k][g] += m
            for k, c in got.items():
                lang += [x] * len(c)
                kind += [k] * len(c)
                gram += c.keys()
                n += c.values()
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(kind, pa.int32()), pa.array(gram, pa.string()), pa.array(n, pa.int64())], ["lang", "kind", "gram", "n"])


def _predict(shared):
    def go(batches):
        model = shared.value
        for b in batches:
            got = [model.predict(t) for t in text_column(b, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return go


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row, learned from those with a language that aren't held out.

    score: the posterior of the prediction. `und` with score 0 for null texts, texts without a letter, or if nothing
    can be learned. Null ids and repeated rows are returned row by row (a null id is not held out). No rows: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = spark.sparkContext.broadcast(train(d))
    out = d.select("doc_id", "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
