"""Embedding near-duplicates by spherical-cap filters with structured random product codes.

A seeded rotation turns every unit vector; its coordinates are cut into blocks, and each block has a code of random
unit vectors. A filter direction is one codeword from each block; a vector takes the filters with the greatest inner
products with it, equally many for each vector, which list decoding finds block by block without walking through the
product. How many filters a vector takes is chosen by the share of random pairs at the least cosine that have a common
one, measured for the code at hand.

Vectors join on filters tile by tile: codewords of a block are put into cells of neighbours, a tile is a cell of each
block, and a vector goes once to each of the tiles that its filters lie in, not once to each filter. In a tile the
members of each filter are compared exactly, and a pair counts in its first common filter.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, binary_array, scratch, ship
from .components import components, forest

#: Filters of a vector, the first number that reaches RECALL (else the last); vectors of a filter on average that the
#: code's size aims at; vectors of a tile at most (larger ones are cut into pairs of pieces); rows compared at a time.
FILTERS, AIM, TILE, ROWS = (8, 12, 16, 24, 32, 48, 64), 1024, 50_000, 512
#: Share of pairs at the least cosine that must have a common filter, and the random pairs on which it is measured.
RECALL, PAIRS = 0.99, 2000


def pairs_at(dim: int, cosine: float, n: int = PAIRS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """n random pairs of unit vectors at a cosine."""
    rng = np.random.default_rng(seed)
    x, u = rng.standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    return x, cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * u


def _best(v: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the m greatest values of each row, and the values."""
    at = np.argpartition(-v, m - 1, axis=1)[:, :m] if m < v.shape[1] else np.broadcast_to(np.arange(v.shape[1]), v.shape)
    return at, np.take_along_axis(v, at, 1)


def cells(words: np.ndarray, levels: int) -> np.ndarray:
    """For each codeword one of 2 ** levels cells, of neighbours and equally large: halves along the widest direction."""
    out = np.zeros(len(words), np.int64)
    todo = [(np.arange(len(words)), levels)]
    while todo:
        at, level = todo.pop()
        if not level:
            continue
        part = words[at] - words[at].mean(0)
        axis = np.linalg.svd(part, full_matrices=False)[2][0] if len(at) > 1 else part[0]
        order = at[np.argsort(part @ axis, kind="stable")]
        low, high = order[: len(at) // 2], order[len(at) // 2 :]
        out[high] += 1 << (level - 1)
        todo += [(low, level - 1), (high, level - 1)] if len(low) else [(high, level - 1)]
    return out


class Code:
    """Product code for vectors of `dim` components, so fine that a filter gets about AIM of n vectors."""

    def __init__(self, dim: int, n: int, filters: int) -> None:
        rng = np.random.default_rng(20_240 + dim)
        self.filters, self.parts = filters, 1 if dim < 4 else 2
        self.size = math.ceil(max(filters, filters * n / AIM) ** (1 / self.parts))
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cut = [round(dim * k / self.parts) for k in range(self.parts + 1)]
        self.words = []
        for a, z in zip(self.cut, self.cut[1:]):
            w = rng.standard_normal((self.size, z - a))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True))
        # finer until a tile gets at most TILE of n vectors
        x, self.levels = pairs_at(dim, 1.0, 500, 2)[0], 0
        while True:
            self.cells = [cells(w, self.levels) for w in self.words]
            if 2**self.levels >= self.size or n * np.mean([len(np.unique(t)) for t in self.tiles(np.array(self.decode(x)))]) <= TILE << (self.levels * self.parts):
                break
            self.levels += 1

    def tiles(self, ids: np.ndarray) -> np.ndarray:
        """The tile of each filter."""
        out = np.zeros_like(ids)
        for k, cell in enumerate(self.cells):
            word = ids // self.size ** (self.parts - 1 - k) % self.size
            out = (out << self.levels) | cell[word]
        return out

    def _some(self, x: np.ndarray) -> np.ndarray:
        turned = x @ self.turn
        ids, sums = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for a, z, w in zip(self.cut, self.cut[1:], self.words):
            # the best sums are made of the best of each block
            word, v = _best(turned[:, a:z] @ w.T, self.filters)
            every = (ids[:, :, None] * self.size + word[:, None, :]).reshape(len(x), -1)
            at, sums = _best((sums[:, :, None] + v[:, None, :]).reshape(len(x), -1), self.filters)
            ids = np.take_along_axis(every, at, 1)
        return np.sort(ids, axis=1)

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """The best filters of each unit vector, ascending."""
        step = max(1, (1 << 21) // max(self.size, self.filters**2))
        return [row for k in range(0, len(x), step) for row in self._some(x[k : k + step])]

    def recall(self, cosine: float) -> float:
        """Share of random pairs at a cosine that have a common filter."""
        x, y = (np.array(self.decode(v)) for v in pairs_at(len(self.turn), cosine))
        return float(np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(x, y)]))


_codes: dict = {}


def _code(dim: int, n: int, least: float = 0.95) -> Code:
    """The code for n vectors, with the fewest filters that reach RECALL at cosine `least`."""
    n = 1 << max(8, n - 1).bit_length()
    key = (dim, n, least, AIM, TILE, FILTERS)
    if key not in _codes:
        for filters in FILTERS:
            _codes[key] = Code(dim, n, filters)
            if _codes[key].recall(least) >= RECALL:
                break
    return _codes[key]


def _unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _keys(kind: str):
    """(vec_id, dim, k1, k2, x): the digest of a vector's direction and its components as they are; null if it has none."""

    def go(batches):
        for b in batches:
            v = b.column(1)
            lists = v.to_pylist()
            good = [x is not None and len(x) > 0 and all(e is not None for e in x) for x in lists]
            dims, digest, out = [], [], []
            for x, ok in zip(lists, good, strict=True):
                y = np.array(x, kind) if ok else None
                if ok and np.isfinite(y).all() and y.any():
                    dims.append(len(y))
                    digest.append(_unit(y[None])[0])
                    out.append(y.tobytes())
                else:
                    dims.append(None)
                    out.append(None)
            h = iter([np.frombuffer(hashlib.md5(u.tobytes()).digest(), np.int64).tolist() for u in digest])
            ks = [next(h) if o is not None else (None, None) for o in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array([k[0] for k in ks], pa.int64()), pa.array([k[1] for k in ks], pa.int64()), pa.array(out, pa.binary())], ["vec_id", "dim", "k1", "k2", "x"])

    return go


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _decode(codes, kind: str):
    """The same rows with the filters of each vector, ascending."""

    def go(batches):
        for b in batches:
            dims = b.column(b.schema.get_field_index("dim")).to_numpy()
            x = b.column(b.schema.get_field_index("x"))
            own: list = [b""] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for k, ids in zip(at.tolist(), codes.value[int(dim)].decode(_unit(_matrix(x.take(pa.array(at)), int(dim), kind))), strict=True):
                    own[k] = ids.astype(np.int64).tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, binary_array(own)], [*b.schema.names, "own"])

    return go


def _of_tiles(b, codes):
    """(rows, tiles): each row once for every tile of its filters."""
    dims, own = b.column(b.schema.get_field_index("dim")).to_numpy(), b.column(b.schema.get_field_index("own")).to_pylist()
    for dim in np.unique(dims):
        at, code = np.flatnonzero(dims == dim), codes.value[int(dim)]
        t = np.sort(code.tiles(np.frombuffer(b"".join(own[k] for k in at.tolist()), np.int64).reshape(len(at), -1)), axis=1)
        new = np.concatenate([np.ones((len(t), 1), bool), t[:, 1:] != t[:, :-1]], 1)
        yield int(dim), at[np.nonzero(new)[0]], t[new]


def _tile_counts(codes):
    def go(batches):
        for b in batches:
            for dim, _, t in _of_tiles(b, codes):
                tile, n = np.unique(t, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tile), dim, np.int32)), pa.array(tile), pa.array(n.astype(np.int64))], ["dim", "tile", "n"])

    return go


def _to_tiles(codes, cut):
    """A row for each tile of a vector; in a tile of several pieces one for each pair of pieces that its own is in."""

    def go(batches):
        for b in batches:
            node = b.column(b.schema.get_field_index("node")).to_numpy()
            for dim, rows, tile in _of_tiles(b, codes):
                pieces = np.array([cut.value.get((dim, t), 1) for t in tile.tolist()], np.int64)
                own = (node[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % pieces
                each = np.repeat(np.arange(len(rows)), pieces)
                other = np.arange(len(each)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                for a in range(0, len(each), 20_000):
                    k, o = each[a : a + 20_000], other[a : a + 20_000]
                    take = pa.array(rows[k])
                    col = lambda name: b.column(b.schema.get_field_index(name)).take(take)
                    p, q = np.minimum(own[k], o), np.maximum(own[k], o)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), dim, np.int32)), pa.array(tile[k]), pa.array(p), pa.array(q), pa.array(own[k]), col("cid"), col("node"), col("mult"), col("x"), col("own")], ["dim", "tile", "p", "q", "piece", "cid", "node", "mult", "x", "own"])

    return go


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least filter that rows of two filter matrices share."""
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), 8192):
        x, y = a[i : i + 8192], b[i : i + 8192]
        hit = (x[:, :, None] == y[:, None, :]).any(2)
        out[i : i + 8192] = np.where(hit, x, np.iinfo(np.int64).max).min(1)
    return out


def _joined(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few edges that join what a matrix of links joins; where it is dense, by least labels of rows and columns."""
    i, j = np.nonzero(hit)
    if len(i) <= 4 * sum(hit.shape):
        return left[i], right[j]
    most = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    while True:
        a2 = np.minimum(a, np.where(hit, b, most).min(1))
        b2 = np.minimum(b, np.where(hit, a2[:, None], most).min(0))
        if (a2 == a).all() and (b2 == b).all():
            return np.concatenate([left, right]), np.concatenate([a, b])
        a, b = a2, b2


def _verify(least: float, codes, kind: str):
    """Of a tile, or of a pair of its pieces: links of each class (a, n), and edges that join what links join (a, b)."""

    def go(key, table):
        dim, tile, p, q = (k.as_py() for k in key)
        code = codes.value[dim]
        x = _unit(_matrix(table.column("x"), dim, kind))
        cid, node, mult, piece = (table.column(k).to_numpy() for k in ("cid", "node", "mult", "piece"))
        own = _matrix(table.column("own"), code.filters, "int64")
        links = np.zeros(len(node), np.int64)
        edges = [(node[:0], node[:0])]
        row, col = np.nonzero(code.tiles(own) == tile)
        f = own[row, col]
        order = np.argsort(f, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(f[order])) + 1):
            if len(part) < 2:
                continue
            this, at = f[part[0]], row[part]
            left, right = (at, at) if p == q else (at[piece[at] == p], at[piece[at] == q])
            y = x[right].T
            for a in range(0, len(left), ROWS):
                some = left[a : a + ROWS]
                # of each pair of rows of one piece the later one meets the earlier one
                hit = (x[some] @ y >= least) & ((right[None, :] < some[:, None]) if p == q else True)
                i, j = np.nonzero(hit)
                if not len(i):
                    continue
                edges.append(_joined(hit, node[some], node[right]))
                i, j = some[i], right[j]
                new = _first_common(own[i], own[j]) == this  # a pair counts in its first common filter
                i, j = i[new], j[new]
                links += np.bincount(i, mult[j], len(node)).astype(np.int64) + np.bincount(j, mult[i], len(node)).astype(np.int64)
        a, b = forest(*(np.concatenate(e) for e in zip(*edges, strict=True)))
        some = np.flatnonzero(links)
        n, m = len(some), len(a)
        return pa.table({"a": np.concatenate([cid[some], a]), "b": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(b)]), "n": pa.concat_arrays([pa.array(links[some]), pa.nulls(m, pa.int64())])})

    return go


def near_duplicates(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: links at cosine >= least, counted in double precision.

    Null, empty and zero vectors and those with null or non-finite components link with nothing, nor do vectors of
    different lengths or those with a null id (whose component is null). Equal directions are one class with a count.
    Rows that repeat an id with other vectors share its component; n_links is each row's own and counts rows. Every link found is verified; a link is missed where two vectors share no
    filter, at most about 1 - RECALL of random ones at cosine `least` and fewer above it. No rows: no rows. Other columns are left alone.
    """
    spark = vectors.sparkSession
    ship(spark)
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "float32" if single else "float64"
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    keyed = d.mapInArrow(_keys(kind), "vec_id long, dim int, k1 long, k2 long, x binary")
    rows = scratch(keyed.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("dim")).alias("dim"), "k1", "k2"), "directions")
    # chosen here, so that all executors take the same; the codes grow as the root of the rows
    made = {r.dim: _code(r.dim, r["count"], least) for r in rows.where("dim is not null").groupBy("dim").count().collect()}
    if sum(w.nbytes for c in made.values() for w in c.words) > BROADCAST_BYTES:
        raise ValueError("codes of more than 64 MB; set AIM higher")
    codes = spark.sparkContext.broadcast(made)
    classes = keyed.where("dim is not null and vec_id is not null").groupBy("dim", "k1", "k2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("mult"), F.first("x").alias("x"))
    kinds = "dim int, k1 long, k2 long, node long, mult long, x binary, own binary"
    # classes have numbers of their own, as an id may stand in several
    classes = scratch(classes.mapInArrow(_decode(codes, kind), kinds).withColumn("cid", F.monotonically_increasing_id()), "classes")
    # a row for each TILE vectors at most
    large = classes.select("dim", "own").mapInArrow(_tile_counts(codes), "dim int, tile long, n long").groupBy("dim", "tile").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * TILE)
    cut = spark.sparkContext.broadcast({(r.dim, r.tile): -(-r.n // TILE) for r in large.collect()})
    tiles = classes.select("dim", "cid", "node", "mult", "x", "own").mapInArrow(_to_tiles(codes, cut), "dim int, tile long, p long, q long, piece long, cid long, node long, mult long, x binary, own binary")
    done = scratch(tiles.groupBy("dim", "tile", "p", "q").applyInArrow(_verify(least, codes, kind), "a long, b long, n long"), "verified")
    links = done.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    key = ["dim", "k1", "k2"]
    named = scratch(classes.select(*key, "cid", "node", (F.col("mult") - 1).alias("same")).join(links, "cid", "left").select(*key, "node", (F.col("same") + F.coalesce("n", F.lit(0))).alias("n")), "links")
    copies = rows.where("dim is not null").join(named.select(*key, "node"), key).where("vec_id != node").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    reached = scratch(components(done.where("b is not null").select("a", "b").unionByName(copies)), "reached")
    out = rows.join(named.select(*key, "n"), key, "left").join(reached.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
