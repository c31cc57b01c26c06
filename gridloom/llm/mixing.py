"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

A document's place in its source is a 48-bit hash of its id. Sizes are summed by source and leading 12 bits of the
hash; the bucket in which the running sum passes the source's budget is refined by the next 12 bits, and the small
bucket then found by whole hashes. Documents are taken by comparison with the threshold found: nothing is sorted but
4096 sums a source, and only the boundary bucket is looked at twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WORD, scratch

#: Bits of the two histogram levels, and of the whole hash.
LEVEL, BITS = 12, 48
#: Bytes of sources up to which thresholds are broadcast; beyond it they are joined under salted keys.
BROADCAST, SALT = BROADCAST_BYTES, 32


def document_hash(doc_id: Column) -> Column:
    """The leading 48 bits of the MD5 of the decimal id; null as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): share of all sizes by weight, at most `most` times a
    source's size, the excess shared anew by weight.

    Raising a common level x fills min(most * size, weight * x). Sources fill up in the order of most * size / weight;
    the first that is still open when all before it are full has the level. Comparisons are free of divisions, so that
    ties don't hang on rounding. One row a source, so the windows hold as many rows as there are sources.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    w = w.withColumn("left", share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(after))
    # levels fall after the first open source, so it has the greatest of them
    w = w.withColumn("level", F.max(F.when(F.col("left") * F.col("weight") < F.col("cap") * F.col("open"), F.col("left") / F.col("open"))).over(whole))
    return w.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def _boundary(h: DataFrame, budgets: DataFrame, bucket: str) -> DataFrame:
    """(source, bucket, before): the bucket in which the running sum passes the budget, and the sum before it."""
    order = Window.partitionBy("source").orderBy(bucket)
    run = h.join(budgets, F.col("source").eqNullSafe(F.col("_s"))).withColumn("upto", F.sum("size").over(order) + F.col("done"))
    passed = run.where(F.col("upto") > F.col("budget")).groupBy("source").agg(F.min_by(F.struct(bucket, (F.col("upto") - F.col("size")).alias("done"), F.col("size").alias("here"), "budget"), bucket).alias("b"))
    return passed.select("source", f"b.{bucket}", "b.done", "b.here", "b.budget")


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, most: float) -> tuple[DataFrame, DataFrame, bool]:
    """Rows as (doc_id, source, size, h); by source (_s, source_size, target, copies, threshold); whether the latter is small."""
    slim = scratch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size")).withColumn("h", document_hash(F.col("doc_id"))), "sizes")
    b1, b2 = F.shiftright("h", BITS - LEVEL), F.shiftright("h", BITS - 2 * LEVEL)
    hist = scratch(slim.groupBy("source", b1.alias("b1")).agg(F.sum("size").alias("size")), "histogram")
    t = targets(hist.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    t = scratch(t.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size")), "targets")
    n, names = t.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    few = n * 80 + names <= BROADCAST
    hint = F.broadcast if few else (lambda x: x)

    first = scratch(_boundary(hist, hint(t.select(F.col("source").alias("_s"), "budget", F.lit(0).alias("done"))), "b1"), "level1")
    inside = slim.join(hint(first.select(F.col("source").alias("_s"), F.col("b1").alias("_b"))), F.col("source").eqNullSafe(F.col("_s")) & (b1 == F.col("_b")))
    hist2 = inside.groupBy("source", b2.alias("b2")).agg(F.sum("size").alias("size"))
    second = scratch(_boundary(hist2, hint(first.select(F.col("source").alias("_s"), "budget", "done")), "b2"), "level2")
    inside = slim.join(hint(second.select(F.col("source").alias("_s"), F.col("b2").alias("_b"))), F.col("source").eqNullSafe(F.col("_s")) & (b2 == F.col("_b")))
    last = _boundary(inside.groupBy("source", "h").agg(F.sum("size").alias("size")), hint(second.select(F.col("source").alias("_s"), "budget", "done")), "h")
    # below the threshold a document is taken; at it, where more than half of it fits
    cut = last.select(F.col("source").alias("_c"), (F.col("h") + F.when(2 * (F.col("budget") - F.col("done")) >= F.col("here"), 1).otherwise(0)).alias("threshold"))
    plan = t.join(cut, F.col("source").eqNullSafe(F.col("_c")), "left").select(F.col("source").alias("_s"), "source_size", "target", "copies", F.coalesce("threshold", F.when(F.col("budget") > 0, F.lit(1 << BITS)).otherwise(0)).alias("threshold"))
    return slim, scratch(plan, "plan"), few


def _with_plan(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """rows (with source and h) beside their source's plan; a source with many rows is spread by SALT."""
    if few:
        return rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_s")))
    salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.join(salted, F.col("source").eqNullSafe(F.col("_s")) & (F.pmod("h", F.lit(SALT)) == F.col("_salt")))


def _times() -> Column:
    return F.col("copies") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs.

    size: words of the text (null: 0). A source's documents are all taken floor(target / source_size) times, and once
    more in the order of their hashes while the source's target lasts; the document at the threshold is taken where
    that comes nearer to the target. No document is taken more than ceil(most) times. Reruns agree, as the hash is of
    the id alone; rows of a source that repeat an id go together. Null sources are one source, the last. A source
    without words, and an empty table, take nothing. Other columns are left alone.
    """
    slim, plan, few = _plan(docs, id_col, text_col, source_col, weights, share, most)
    done = _with_plan(slim, plan, few)
    return done.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * _times()).cast("long").alias("taken"), _times().cast("int").alias("times"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mixture itself: the columns of docs, each row as often as the mix takes it; rows without words stay once.

    Every row is placed by its own source and the hash of its id, so an id that stands in several sources is taken as
    each of them says. Texts are read where they are and not shuffled, unless the sources are too many to broadcast.
    """
    _, plan, few = _plan(docs, id_col, text_col, source_col, weights, share, most)
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).cast("string").alias("source"), document_hash(F.col(id_col).cast("long")).alias("h"), F.coalesce(F.col(text_col).cast("string").rlike(WORD), F.lit(False)).alias("words"))
    times = F.when(F.col("words"), _times()).otherwise(1).cast("int")
    return _with_plan(rows, plan, few).select("row", times.alias("times")).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
