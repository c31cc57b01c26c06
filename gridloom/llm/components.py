"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, scratch, ship

#: Edges of a task at most; few edges need few tasks and files a round. As many are joined by one task without rounds.
PART = 100_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that join what the edges join: every end but the least of its component, and the least."""
    up: dict = {}

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        r, s = root(x), root(y)
        if r != s:
            up[max(r, s)] = min(r, s)
    ends = list(up)
    return np.array(ends, np.int64), np.array([root(x) for x in ends], np.int64)


def _stars(batches):
    for b in batches:
        for k in range(0, b.num_rows, PART):
            x, y = forest(*(c.to_numpy() for c in b.slice(k, PART).columns))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["hi", "lo"])


def _whole(batches):
    """All edges at once; there are at most PART."""
    got = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    if got:
        x, y = forest(*(np.concatenate(c) for c in zip(*got, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["hi", "lo"])


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, component): every id with an edge, and the smallest id that it reaches.

    edges: two columns of longs, in either direction, repeats and loops allowed; nulls are left out.
    Edges become stars batch by batch where they are; few of them are then joined by one task. Else a round moves each
    edge to the smallest neighbour (of the larger end, then of the smaller), so that trees shrink to stars. A hub's
    edges meet in partial minima and in joins that adaptive execution splits. No rows reach the driver but a count and
    a checksum a round. An empty input gives an empty result.
    """
    ship(edges.sparkSession)
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    e = scratch(e.mapInArrow(_stars, "hi long, lo long"), "edges")
    before = _sum(e)
    if before[0] <= PART:
        e = e.coalesce(1).mapInArrow(_whole, "hi long, lo long")
        return _labels(scratch(e, "stars"))
    for _ in range(most_rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(low.select("hi", F.col("m").alias("lo")))
        new = scratch(small.distinct().coalesce(-(-before[0] // PART)), "edges")
        now = _sum(new)
        drop_scratch(e)
        e = new
        if now == before:
            return _labels(e)
        before = now
    raise RuntimeError("components did not settle")


def _labels(e: DataFrame) -> DataFrame:
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(e.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())


def _sum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
