"""Quality classifier: a sparse rule ensemble over text statistics.

Boosted shallow trees are grown on labelled rows; every path from a root to a node is a rule, a conjunction of
comparisons of statistics. A lasso logistic regression over all rules keeps few of them, and the model is compiled
into one Spark column expression. Statistics come from one pass over whole texts; no identifier, label, language or
source is among them.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, text_column, trimmed

STATS = [
    "log_chars", "log_words", "word_length", "word_length_sd", "distinct_words", "top_word", "top_three_words", "repeat_next",
    "letters", "upper", "digits", "blanks", "punctuation", "symbols", "bars", "bangs", "log_lines", "line_length", "distinct_lines",
    "short_lines", "ends_sentence", "upper_words", "symbol_words", "single_words", "words_per_stop", "alpha_words",
]
#: Labelled rows that a fit uses at most, those with the smallest hashes of their ids; trees, their depth and least
#: leaf; the step of boosting; penalty of the lasso (a share of the least that leaves no rule), and its steps.
SAMPLE, TREES, DEPTH, LEAF, RATE, PENALTY, STEPS = 20_000, 40, 3, 20, 0.3, 0.01, 400

_ASCII_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def statistics(text: str | None) -> list[float]:
    """The values of STATS for one whole text; null as empty. All are finite."""
    s = text or ""
    n = len(s)
    if not n:
        return [0.0] * len(STATS)
    words = s.split()
    m = len(words) or 1
    lengths = list(map(len, words))
    mean = sum(lengths) / m
    sd = math.sqrt(max(0.0, sum(x * x for x in lengths) / m - mean * mean))
    count = Counter(words)
    top = [v for _, v in count.most_common(3)]
    again = sum(map(str.__eq__, words, words[1:]))
    chars = Counter(s)
    upper = sum(v for c, v in chars.items() if c.isupper())
    letters = sum(v for c, v in chars.items() if c.isalpha())
    digits = sum(v for c, v in chars.items() if c.isdigit())
    blanks = sum(v for c, v in chars.items() if c.isspace())
    stops = sum(chars[c] for c in ".?;:,")
    lines = s.split("\n")
    k = len(lines)
    upper_words = sum(map(str.isupper, words))
    alpha = sum(v for w, v in count.items() if w.isalpha())
    odd = sum(v for w, v in count.items() if w[-1] in "%$&#*!|@^~<>=+_\\/")
    return [
        math.log1p(n), math.log1p(len(words)), mean, sd, len(count) / m, (top[0] if top else 0) / m, sum(top) / m, again / m,
        letters / n, upper / max(1, letters), digits / n, blanks / n, stops / n, (n - letters - digits - blanks - stops) / n, chars["|"] / n, chars["!"] / n,
        math.log1p(k), math.log1p(n / k), len(set(lines)) / k, sum(len(x) < 20 for x in lines) / k, sum(x.rstrip().endswith((".", "!", "?", '"')) for x in lines) / k,
        upper_words / m, odd / m, len([1 for v in count.values() if v == 1]) / m, min(1000.0, len(words) / max(1, chars["."])), alpha / m,
    ]


def _collect(batches):
    for b in batches:
        x = np.array([statistics(t) for t in text_column(b, b.schema.names[-1]).to_pylist()], float).reshape(-1, len(STATS))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(STATS), dtype=np.int32)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], flat], [*b.schema.names[:-1], "stats"])


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold): value > threshold, or not."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, t in self.parts:
            out &= (x[:, k] > t) == above
        return out

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for k, above, t in self.parts:
            v = F.element_at(stats, k + 1)
            out = out & (v > t if above else v <= t)
        return out


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]

    def score(self, stats: Column) -> Column:
        """Probability of label 1, as one expression over a stats column."""
        z = F.lit(self.intercept)
        for r, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(r.column(stats), F.lit(w)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-z))

    def score_numpy(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for r, w in zip(self.rules, self.weights, strict=True):
            z += np.where(r.holds(x), w, 0.0)
        return 1 / (1 + np.exp(-z))


def _grow(x: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, path: tuple, depth: int, found: list, out: np.ndarray) -> None:
    """A regression tree on gradients; `found` gets the path to each node, `out` the leaf values."""
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best, most = None, 1e-6
    if depth < DEPTH and len(rows) >= 2 * LEAF:
        for k in range(x.shape[1]):
            size = len(cuts[k]) + 1
            b = binned[rows, k]
            gs, hs, ns = np.cumsum(np.bincount(b, g[rows], size))[:-1], np.cumsum(np.bincount(b, h[rows], size))[:-1], np.cumsum(np.bincount(b, minlength=size))[:-1]
            gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
            gain[(ns < LEAF) | (len(rows) - ns < LEAF)] = -1
            if len(gain) and gain.max() > most:
                most, best = gain.max(), (k, int(gain.argmax()))
    if best is None:
        out[rows] = -total_g / (total_h + 1)
        return
    k, c = best
    right = binned[rows, k] > c
    for above in (False, True):
        step = (*path, (k, above, float(cuts[k][c])))
        found.append(step)
        _grow(x, cuts, binned, g, h, rows[right == above], step, depth + 1, found, out)


def _simple(path: tuple) -> Rule:
    """A path with the tightest bound of each statistic and side."""
    best: dict = {}
    for k, above, t in path:
        old = best.get((k, above))
        best[k, above] = t if old is None else (max(old, t) if above else min(old, t))
    return Rule(tuple(sorted((k, a, t) for (k, a), t in best.items())))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Rules and lasso weights from statistics (rows by STATS) and 0/1 labels."""
    n = len(y)
    if n == 0:
        return Model(0.0, (), ())
    rate = min(max(y.mean(), 0.5 / (n + 1)), 1 - 0.5 / (n + 1))
    base = math.log(rate / (1 - rate))
    if y.min() == y.max():
        return Model(base, (), ())
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 64), method="lower")) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)
    z, paths = np.full(n, base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        step = np.zeros(n)
        _grow(x, cuts, binned, p - y, p * (1 - p), np.arange(n), (), 0, paths, step)
        z += RATE * step
    rules = list(dict.fromkeys(_simple(p) for p in paths))
    if not rules:  # too few rows to split
        return Model(base, (), ())
    held = np.stack([r.holds(x) for r in rules], 1)
    share = held.mean(0)
    rules = [r for r, s in zip(rules, share, strict=True) if LEAF / n / 2 <= s <= 1 - LEAF / n / 2]
    if not rules:
        return Model(base, (), ())
    a = np.stack([r.holds(x) for r in rules], 1).astype(float)
    mean, sd = a.mean(0), a.std(0)
    a = (a - mean) / sd
    penalty = PENALTY * np.abs(a.T @ (y - rate)).max() / n
    # accelerated proximal gradient; the step is bounded by the largest eigenvalue
    v = np.ones(a.shape[1])
    for _ in range(30):
        v = a.T @ (a @ v)
        top = np.linalg.norm(v)
        v /= top
    step = 4 * n / (1.1 * top)
    w, b, u, c, t = np.zeros(a.shape[1]), base, np.zeros(a.shape[1]), base, 1.0
    for _ in range(STEPS):
        r = 1 / (1 + np.exp(-(a @ u + c))) - y
        nw = u - step * (a.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = c - 4 * r.mean() / 1.1
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        u, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    raw = w / sd
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return Model(float(b - (raw * mean).sum()), tuple(rules[k] for k in keep), tuple(float(raw[k]) for k in keep))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on texts of docs whose id isn't held out and has a label of 0 or 1.

    Of more than `sample` such ids those with the smallest hashes are used, and of rows that repeat them as many; only
    their texts get statistics. An id with several labels takes the smallest.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label_col).cast("double").alias("y"))
    known = known.where(~held_out(F.col("doc_id"), 5, 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # at most `sample` rows of 16 bytes are broadcast; texts become statistics where they are
    rows = rows.join(F.broadcast(known), "doc_id").select("doc_id", "y", F.xxhash64("text").alias("h"), "text").mapInArrow(_collect, "doc_id long, y double, h long, stats array<double>")
    got = sorted((r.doc_id, r.h, r.y, *r.stats) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(sample).collect())
    x = np.array([r[2:] for r in got], float).reshape(-1, 1 + len(STATS))
    return fit(x[:, 1:], x[:, 0])


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """crc32 of the decimal id, mod parts, is part; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_collect, "doc_id long, stats array<double>")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; the model is fitted on labels.

    Null and empty texts have statistics of 0 and a score. Repeated rows each get theirs; null ids are returned.
    Without usable labels every score is 0.5. Other columns are left alone. No rows: no rows. One pass over all texts,
    and one before it over those that the fit uses.
    """
    ship(docs.sparkSession)
    model = train(docs, labels, id_col, text_col)
    scored = with_statistics(docs, id_col, text_col).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), model.score(F.col("stats")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with their columns. Texts are not shuffled."""
    ship(docs.sparkSession)
    model = train(docs, labels, id_col, text_col)
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    scored = rows.mapInArrow(trimmed(_collect), f"row {kind}, stats array<double>")
    return scored.where(model.score(F.col("stats")) >= threshold).select("row.*")
