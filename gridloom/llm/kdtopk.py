"""Exact top-k by inner product with KD-trees.

A bounded sample of all vectors gives the top of one KD-tree, median splits of the widest dimension, whose leaves deal
the rows into shards of bounded size that lie apart; a leaf with too many rows is several shards. Each shard becomes a
KD-tree of its own, with a tight bounding box at every node, and each leaf of the top has the tight box of its rows.
Queries are cut into blocks by the same top. First every block searches a shard of its own leaf; the kth best scores
found there bound the search of all others. A block then meets only shards of leaves whose box allows one of its
queries a score that reaches the query's bound. A search is best-first: nodes wait in a heap by the largest inner
product that their box allows, and the search ends when that falls below the query's kth best score, found or propagated.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, scratch, ship

#: Rows of a shard, of a leaf and of a block of queries; blocks that meet a shard in one task; sampled rows for the top
#: of the tree, and for each of its leaves.
SHARD, LEAF, BLOCK, TOGETHER, SAMPLE, EACH = 8192, 64, 256, 32, 65_536, 16
_KINDS = {2: np.int16, 4: np.int32, 8: np.int64}


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as they need."""
    most = int(np.abs(x).max()) if x.size else 0
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _exact(x: np.ndarray, q: np.ndarray) -> type:
    """A type in which sums of products of the two come out exact: double, 64-bit integers, or Python's own."""
    most = max(1, x.shape[1]) * max(int(np.abs(x).max()) if x.size else 0, 1) * max(int(np.abs(q).max()) if q.size else 0, 1)
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


def _reach(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product of each query with a point of each box."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


class Tree:
    """Rows ordered by leaf; nodes with first and last row, children and box. Child 0: a leaf."""

    def __init__(self, x: np.ndarray, ids: np.ndarray) -> None:
        order = np.arange(len(x))
        first, last, left, right = [0], [len(x)], [0], [0]
        todo = [0]
        while todo:
            k = todo.pop()
            a, z = first[k], last[k]
            if z - a <= LEAF:
                continue
            part = x[order[a:z]]
            d = int((part.max(0) - part.min(0)).argmax())
            mid = (z - a) // 2
            order[a:z] = order[a:z][np.argpartition(part[:, d], mid)]
            left[k], right[k] = len(first), len(first) + 1
            first += [a, a + mid]
            last += [a + mid, z]
            left += [0, 0]
            right += [0, 0]
            todo += [left[k], right[k]]
        self.x, self.ids, self.first, self.last, self.left, self.right = x[order], ids[order], first, last, left, right
        self.low = np.stack([self.x[a:z].min(0) for a, z in zip(first, last, strict=True)])
        self.high = np.stack([self.x[a:z].max(0) for a, z in zip(first, last, strict=True)])

    def search(self, q: np.ndarray, own: np.ndarray, k: int, bound: np.ndarray):
        """For each query: (ids, scores) of its k best rows but `own`, best first, none below its bound."""
        top = _reach(q, self.low, self.high).tolist()
        for i in range(len(q)):
            reach, ids, scores, kth = top[i], np.zeros(0, np.int64), np.zeros(0, q.dtype), int(bound[i])
            heap = [(-reach[0], 0)]
            while heap:
                t, n = heappop(heap)
                if -t < kth:
                    break
                if self.left[n]:
                    for c in (self.left[n], self.right[n]):
                        if reach[c] >= kth:
                            heappush(heap, (-reach[c], c))
                    continue
                a, z = self.first[n], self.last[n]
                s = self.x[a:z] @ q[i]
                keep = (s >= kth) & (self.ids[a:z] != own[i])
                if keep.any():
                    ids, scores = np.concatenate([ids, self.ids[a:z][keep]]), np.concatenate([scores, s[keep]])
                    if len(ids) > k:
                        best = np.lexsort((ids, -scores))[:k]
                        ids, scores = ids[best], scores[best]
                    if len(ids) >= k:
                        kth = max(kth, int(scores.min()))
            best = np.lexsort((ids, -scores))
            yield ids[best], scores[best]


class Top:
    """The top of a KD-tree over a sample: `levels` median splits, so 2 ** levels leaves."""

    def __init__(self, x: np.ndarray, levels: int) -> None:
        self.levels = levels
        self.dim, self.at = np.zeros(1 << levels, np.int64), np.zeros(1 << levels, np.int64)
        todo = [(1, np.arange(len(x)))]
        while todo:
            k, rows = todo.pop()
            if k >= 1 << levels:
                continue
            part = x[rows]
            d = int((part.max(0) - part.min(0)).argmax()) if len(part) else 0
            self.dim[k] = d
            self.at[k] = int(np.sort(part[:, d])[len(part) // 2]) if len(part) else 0
            right = part[:, d] >= self.at[k]
            todo += [(2 * k, rows[~right]), (2 * k + 1, rows[right])]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        k = np.ones(len(x), np.int64)
        for _ in range(self.levels):
            k = 2 * k + (x[np.arange(len(x)), self.dim[k]] >= self.at[k])
        return k - (1 << self.levels)


def _read(rows: bytes, width: int, dim: int) -> np.ndarray:
    return np.frombuffer(rows, _KINDS[width]).reshape(-1, dim)


def _deal(tops):
    """(vec_id, dim, leaf, width, v): vectors as narrow integers with the leaf of the top that they lie in."""

    def go(batches):
        for b in batches:
            lists, dims = b.column(1), b.column(2).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(at), dim)
                leaf = tops.value[int(dim)].leaf(x)
                x = _narrow(x)
                v = x.tobytes()
                size = x.itemsize * int(dim)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)), pa.array(leaf), pa.array(np.full(len(at), x.itemsize, np.int32)), pa.array([v[k : k + size] for k in range(0, len(v), size)], pa.binary())], ["vec_id", "dim", "leaf", "width", "v"])

    return go


_ROWS = "vec_id long, dim int, leaf long, width int, v binary"


def _together(table, dim: int) -> np.ndarray:
    """The vectors of a group of rows, in one width."""
    width = table.column("width").to_numpy()
    v = table.column("v").to_pylist()
    out = np.empty((len(v), dim), _KINDS[int(width.max())])
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        out[at] = _read(b"".join(v[k] for k in at.tolist()), int(w), dim)
    return out


def _shard(key, table):
    """One row for all rows of a shard, with their box."""
    dim, leaf, piece = (k.as_py() for k in key)
    x = _together(table, dim)
    box = lambda y: [y.astype(np.int64).tobytes()]
    return pa.table({"dim": pa.array([dim], pa.int32()), "leaf": [leaf], "piece": [piece], "width": pa.array([x.itemsize], pa.int32()), "ids": pa.array([table.column("vec_id").to_numpy().astype(np.int64).tobytes()], pa.binary()), "rows": pa.array([x.tobytes()], pa.binary()), "low": pa.array(box(x.min(0)), pa.binary()), "high": pa.array(box(x.max(0)), pa.binary())})


def _box(key, table):
    """The box of a leaf's shards."""
    side = lambda name, how: [how(np.frombuffer(b"".join(table.column(name).to_pylist()), np.int64).reshape(table.num_rows, -1)).tobytes()]
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "leaf": [key[1].as_py()], "pieces": pa.array([table.num_rows], pa.int64()), "low": pa.array(side("low", lambda x: x.min(0)), pa.binary()), "high": pa.array(side("high", lambda x: x.max(0)), pa.binary())})


def _block(key, table):
    """One row for all queries of a block."""
    dim, leaf, block = (k.as_py() for k in key)
    x = _together(table, dim)
    longs = lambda name: pa.array([table.column(name).to_numpy().astype(np.int64).tobytes()], pa.binary())
    return pa.table({"dim": pa.array([dim], pa.int32()), "leaf": [leaf], "block": [block], "width": pa.array([x.itemsize], pa.int32()), "ids": longs("vec_id"), "rows": pa.array([x.tobytes()], pa.binary()), "qkeys": longs("qkey"), "bounds": longs("bound")})


_SHARDS = "dim int, leaf long, piece long, width int, ids binary, rows binary, low binary, high binary"
_BLOCKS = "dim int, leaf long, block long, width int, ids binary, rows binary, qkeys binary, bounds binary"
_FOUND = "query_id long, qkey long, vec_id long, score long"
_PAIRS = "dim int, leaf long, block long, to long, piece long"


def _reached(boxes):
    """Shards in which a query of a block may score its bound or more, but the one that it has searched."""

    def go(batches):
        for b in batches:
            for r in b.to_pylist():
                leaves, pieces, low, high = boxes.value[r["dim"]]
                q = _read(r["rows"], r["width"], r["dim"])
                kind = _exact(np.concatenate([low, high]), q)
                bound = np.frombuffer(r["bounds"], np.int64)
                near = np.flatnonzero((_reach(q.astype(kind), low.astype(kind), high.astype(kind)) >= bound[:, None]).any(0))
                to = np.repeat(leaves[near], pieces[near])
                piece = np.concatenate([np.arange(p) for p in pieces[near]]) if len(near) else np.zeros(0, np.int64)
                own = pieces[np.flatnonzero(leaves == r["leaf"])[0]]
                keep = (to != r["leaf"]) | (piece != r["block"] % own)
                n = int(keep.sum())
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["dim"], np.int32)), pa.array(np.full(n, r["leaf"])), pa.array(np.full(n, r["block"])), pa.array(to[keep]), pa.array(piece[keep])], ["dim", "leaf", "block", "to", "piece"])

    return go


def _search(k: int):
    def go(key, shards, blocks):
        q, c, v, s = [], [], [], []
        dim = key[0].as_py()
        for r in shards.to_pylist():
            x, ids = _read(r["rows"], r["width"], dim), np.frombuffer(r["ids"], np.int64)
            parts = [(_read(b["rows"], b["width"], dim), *(np.frombuffer(b[n], np.int64) for n in ("ids", "qkeys", "bounds"))) for b in blocks.to_pylist()]
            if not parts:
                continue
            kind = _exact(x, np.concatenate([p[0] for p in parts]))
            tree = Tree(x.astype(kind), ids)
            for y, own, qkeys, bounds in parts:
                for i, (found, scores) in enumerate(tree.search(y.astype(kind), own, k, bounds)):
                    q += [own[i]] * len(found)
                    c += [qkeys[i]] * len(found)
                    v += found.tolist()
                    s += [int(t) for t in scores]
        return pa.table({"query_id": pa.array(q, pa.int64()), "qkey": pa.array(c, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.int64())})

    return go


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(256 * x) of every component, for vectors without null or non-finite components."""
    x = F.col(vector_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = lambda e: F.when(F.abs(e * 256.0) < 2.0**62, F.floor(e * 256.0)).otherwise(F.raise_error(F.lit("a component beyond 64-bit integers")).cast("long"))
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all other rows, ties to the smaller id.

    is_query: a condition on the column vec_id. Vectors with null id, null or non-finite components and empty ones
    take no part; vectors of different lengths are not compared. All rows but those of the query's own id are
    candidates, repeated ones each; a repeated query row is answered once. Fewer candidates: all of them. No queries
    or no rows: no rows. Components and scores that 64-bit integers don't hold raise an error, as no rank could be
    right. Other columns are left alone.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole = scratch(quantised(vectors, id_col, vector_col).withColumn("dim", F.size("v")), "vectors")
    tops = {}
    for r in whole.groupBy("dim").count().collect():
        # leaves of SHARD rows, as many as the sample can part and as have boxes that can be broadcast
        most = min(SAMPLE // EACH, max(1, BROADCAST_BYTES // (16 * r.dim)))
        levels = max(0, min((-(-r["count"] // SHARD) - 1).bit_length(), most.bit_length() - 1))
        sample = whole.where(F.col("dim") == r.dim).orderBy(F.xxhash64("vec_id", F.lit("top")), "vec_id").limit(EACH << levels).select("v").toPandas() if levels else None
        tops[r.dim] = Top(np.array(sample.v.tolist(), np.int64).reshape(-1, r.dim) if levels else np.zeros((0, r.dim), np.int64), levels)
    shared = spark.sparkContext.broadcast(tops)
    rows = scratch(whole.select("vec_id", "v", "dim").mapInArrow(_deal(shared), _ROWS), "dealt")
    # one row a leaf, and a leaf for SHARD rows at least
    pieces = F.broadcast(rows.groupBy("dim", "leaf").agg(F.ceil(F.count(F.lit(1)) / SHARD).alias("pieces")))
    shards = rows.join(pieces, ["dim", "leaf"]).withColumn("piece", F.pmod(F.xxhash64("vec_id", F.lit("shard")), F.col("pieces")))
    shards = scratch(shards.groupBy("dim", "leaf", "piece").applyInArrow(_shard, _SHARDS), "shards")
    leaves = shards.select("dim", "leaf", "low", "high").groupBy("dim", "leaf").applyInArrow(_box, "dim int, leaf long, pieces long, low binary, high binary").collect()
    made = {}
    for dim in tops:
        own = [r for r in leaves if r.dim == dim]
        made[dim] = (np.array([r.leaf for r in own], np.int64), np.array([r.pieces for r in own], np.int64), *(np.stack([np.frombuffer(r[c], np.int64) for r in own]) for c in ("low", "high")))
    boxes = spark.sparkContext.broadcast(made)

    queries = scratch(rows.where(is_query).withColumn("qkey", F.xxhash64("v")).dropDuplicates(["vec_id", "qkey"]), "queries")
    some = F.broadcast(queries.groupBy("dim", "leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")))
    queries = queries.join(some, ["dim", "leaf"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("blocks")))

    def blocks(q: DataFrame, name: str) -> DataFrame:
        return scratch(q.groupBy("dim", "leaf", "block").applyInArrow(_block, _BLOCKS), name)

    def searched(pairs: DataFrame, of: DataFrame) -> DataFrame:
        """pairs (dim, leaf, block, to, piece): of which blocks search which shards. Bytes are read for these alone."""
        turn = pairs.withColumn("turn", F.pmod(F.xxhash64("leaf", "block"), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("dim", "to", "piece")) / TOGETHER)))
        turn = scratch(turn, "pairs")
        asked = turn.join(of, ["dim", "leaf", "block"])
        wanted = turn.select(*(F.col(c).alias(a) for c, a in (("dim", "dim"), ("to", "leaf"), ("piece", "piece"), ("turn", "turn")))).distinct()
        asking = shards.select("dim", "leaf", "piece", "width", "ids", "rows").join(wanted, ["dim", "leaf", "piece"])
        got = asking.groupBy("dim", "leaf", "piece", "turn").cogroup(asked.groupBy("dim", "to", "piece", "turn")).applyInArrow(_search(k), _FOUND)
        return scratch(got, "found")

    lowest = -(2**62)
    first = blocks(queries.withColumn("bound", F.lit(lowest)), "blocks")
    count = F.broadcast(spark.createDataFrame([(r.dim, r.leaf, r.pieces) for r in leaves], "dim int, leaf long, pieces long"))
    home = searched(first.join(count, ["dim", "leaf"]).select("dim", "leaf", "block", F.col("leaf").alias("to"), F.pmod("block", "pieces").alias("piece")), first)
    bounds = home.groupBy("query_id", "qkey").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("m")).where(F.col("c") >= k).select(F.col("query_id").alias("vec_id"), "qkey", F.col("m").alias("bound"))
    bounded = blocks(queries.join(bounds, ["vec_id", "qkey"], "left").withColumn("bound", F.coalesce("bound", F.lit(lowest))), "bounded")
    others = searched(bounded.mapInArrow(_reached(boxes), _PAIRS), bounded)
    order = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    return home.unionByName(others).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
