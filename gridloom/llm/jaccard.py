"""Exact n-gram Jaccard join on word shingles by set-relation skipping.

Plan, none of whose steps holds an unbounded group in one task:

1. One pass over all texts makes a set of hashed shingles of each, and writes its size, digest and a sketch (counts by
   slot, about a byte a shingle), and the counts of all shingles as sorted deltas of short hashes (about a byte each).
   Documents with equal sets are one node, the smallest id. Sets themselves, eight bytes a shingle, would take more room
   than the texts, so they are hashed again where they are needed, and never written but for pairs to be verified.
2. Counts name the frequent shingles. Rare shingles come first in the order of every set, so shared passages stay out
   of prefixes. A set puts the prefix that any partner must meet into index lists. A rare shingle's list is short by its
   count and is made in one task; a frequent shingle's entries stay rows, spread evenly.
3. Leaders: of some lists each set finds its most typical companion (a set with few shingles of its own), the one with
   which it shares most of them. The overlap with it is computed. Sets that it links join one component.
4. Only lists that still hold several components are joined. They are cut into blocks by size and position, with
   bounds. Bounds alone are joined, by shingle and band of sizes; the entries of pairs of blocks whose sizes or positions
   can't reach the threshold are never read.
5. Answers of a set follow from its leader's: for pairs of entries that are left, the overlap of their leaders is
   bounded by sketches, then computed once for all followers. With what a follower lacks and has besides its leader, it
   gives a least and a greatest overlap of the followers: most pairs are settled by these, only the rest are verified.

Links inside one component need no further proof, links across components are all settled: the components are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_array, collect_longs, drop_scratch, join_small, mix, partitions, scratch, ship, text_column, trimmed
from .components import components
from .shingles import sets_of

#: Documents with a shingle from which on it is frequent; most frequent shingles in the broadcast order, 12 bytes each
#: (any other has at most a 2,000,000th of all entries and goes into a list like a rare one); entries of a block; least
#: and most slots of a sketch, as powers of two; lists by which a set looks for its leader; shingles of a bucket.
FREQUENT, ORDERED, BLOCK, SKETCH, VOTES, BUCKET = 32, 2_000_000, 128, (6, 12), 8, 4_000_000
_FLUSH = 1_000_000


def _deltas(x: np.ndarray) -> bytes:
    """Sorted integers as gaps: a byte 255 adds 255 and goes on, a smaller byte adds itself and ends."""
    d = np.diff(x, prepend=x[:1] * 0).astype(np.int64)
    more = d // 255
    at = np.cumsum(more + 1) - 1
    out = np.full(int(at[-1]) + 1, 255, np.uint8)
    out[at] = d - more * 255
    return out.tobytes()


def _undelta(b: bytes) -> np.ndarray:
    x = np.frombuffer(b, np.uint8)
    return np.cumsum(x.astype(np.int64))[x != 255]


def sketch_of(x: np.ndarray) -> bytes:
    """Counts of shingles by slot, as many slots as a set has shingles or up to twice as many, at most 255 a slot."""
    slots = 1 << min(max((len(x) - 1).bit_length(), SKETCH[0]), SKETCH[1])
    return np.minimum(np.bincount((mix(x) & np.uint64(slots - 1)).astype(np.int64), minlength=slots), 255).astype(np.uint8).tobytes()


def _digest(x: np.ndarray) -> int:
    return int(mix(x).sum().astype(np.int64)) if len(x) else 0


_FIRST = "doc_id long, n long, s1 long, s2 long, sketch binary, bucket int, blob binary"


def _first(width: int, id_col: str, text_col: str, bits: int, top: int):
    """A row for each text, and short hashes of the shingles of a task's different sets by bucket of their leading bits."""

    def go(batches):
        held, size, seen = [], 0, set()

        def flush():
            x = np.sort(np.concatenate(held))
            cut = np.searchsorted(x, np.arange(1, (1 << top)) << (bits - top))
            parts = [(k, p) for k, p in enumerate(np.split(x, cut)) if len(p)]
            none = pa.nulls(len(parts), pa.int64())
            return pa.RecordBatch.from_arrays([none] * 4 + [pa.nulls(len(parts), pa.binary()), pa.array([k for k, _ in parts], pa.int32()), binary_array([_deltas(p - (k << (bits - top))) for k, p in parts])], names)

        names = ["doc_id", "n", "s1", "s2", "sketch", "bucket", "blob"]
        for b in batches:
            n, s1, s2, sketch = [], [], [], []
            for x in sets_of(text_column(b, text_col), width):
                n.append(len(x))
                s1.append(_digest(x))
                s2.append(_digest(x * np.uint64(0xD1342543DE82EF95)))
                sketch.append(sketch_of(x) if len(x) else None)
                if len(x) and (s1[-1], s2[-1]) not in seen:
                    seen.add((s1[-1], s2[-1]))
                    held.append((x >> np.uint64(64 - bits)).astype(np.int64))
                    size += len(x)
                if size > max(_FLUSH, 16 << top):
                    yield flush()
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(id_col)).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(sketch, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        if size:
            yield flush()

    return go


def _frequent(bits: int, top: int, least: int):
    def go(key, table):
        x = np.sort(np.concatenate([_undelta(b) for b in table.column("blob").to_pylist()]))
        at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        count = np.diff(np.append(at, len(x)))
        keep = count >= least
        return pa.table({"h": x[at][keep] + (int(key[0].as_py()) << (bits - top)), "count": count[keep]})

    return go


def _postings(width: int, id_col: str, text_col: str, num: int, den: int, bits: int, buckets: int, frequent):
    """Prefix entries of a task's different sets: rare ones packed by bucket of their hash; frequent ones packed too, but
    dealt out evenly. typical: the share of frequent shingles among a set's, of 255."""

    def go(batches):
        fh, fc = frequent.value
        held: list = []
        size, turn, seen = 0, 0, set()

        def flush():
            nonlocal turn
            tok, often = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            many = np.array([len(h[0]) for h in held])
            sid, n, typical = (np.repeat(np.array([h[k] for h in held], t), many) for k, t in ((2, np.int64), (3, np.int32), (4, np.uint8)))
            pos = np.concatenate([np.arange(m, dtype=np.int32) for m in many])
            out = []
            bucket = (mix(tok) % np.uint64(buckets)).astype(np.int64)
            turn += 1
            bucket[often > 0] = (np.arange(int((often > 0).sum())) // 4096 + turn * 7 + int(sid[0] % 1009)) % buckets
            order = np.lexsort((often > 0, bucket))
            cut = np.flatnonzero(np.diff(bucket[order] * 2 + (often[order] > 0))) + 1
            for part in np.split(order, cut):
                k = often[part[0]] > 0
                out.append((int(bucket[part[0]]), bool(k), tok[part].tobytes(), sid[part].tobytes(), n[part].tobytes(), pos[part].tobytes(), typical[part].tobytes(), often[part].tobytes() if k else b""))
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.bool_()), *(binary_array(list(c)) for c in cols[2:])], ["bucket", "often", "tok", "sid", "n", "pos", "typical", "counts"])

        for b in batches:
            ids = b.column(b.schema.get_field_index(id_col))
            for k, x in enumerate(sets_of(text_column(b, text_col), width)):
                if not len(x) or not ids[k].is_valid:
                    continue
                n = len(x)
                sid = _sid(x)
                if sid in seen:
                    continue
                seen.add(sid)
                short = (x >> np.uint64(64 - bits)).astype(np.int64)
                count = np.zeros(n, np.int32)
                if len(fh):
                    at = np.minimum(np.searchsorted(fh, short), len(fh) - 1)
                    hit = fh[at] == short
                    count[hit] = fc[at[hit]]
                order = np.lexsort((x, count))[: _prefix(n, num, den)]
                held.append((x[order], count[order], sid, n, int((count > 0).sum()) * 255 // n))
                size += len(order)
                if size > _FLUSH // 2:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return go


def _prefix(n, num: int, den: int):
    """Entries of a set of n shingles, one of which any partner has too."""
    return n - -(-num * n // den) + 1


def _sid(x: np.ndarray) -> int:
    return int(np.int64(_digest(x)) ^ np.int64(len(x)))


def _lists(num: int, den: int):
    """Rows of all lists that hold more than one set; a frequent shingle's rows pass as they are. vote: whether the list
    is one of the few by which the set looks for its leader; rank: typical sets first, else by hash."""

    def go(key, table):
        out = []
        rare = []
        kinds = {"tok": np.uint64, "sid": np.int64, "n": np.int32, "pos": np.int32, "typical": np.uint8}
        for r in table.to_pylist():
            got = [np.frombuffer(r[k], t) for k, t in kinds.items()]
            if r["often"]:
                out.append((*got, np.frombuffer(r["counts"], np.int32)))
            else:
                rare.append(got)
        if rare:
            cols = [np.concatenate([r[k] for r in rare]) for k in range(len(kinds))]
            order = np.lexsort((cols[1], cols[0]))
            cols = [c[order] for c in cols]
            tok, sid = cols[:2]
            new = np.concatenate([[True], (tok[1:] != tok[:-1]) | (sid[1:] != sid[:-1])])
            cols = [c[new] for c in cols]
            tok = cols[0]
            at = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
            many = np.diff(np.append(at, len(tok)))
            count = np.repeat(many, many)
            out.append((*(c[count > 1] for c in cols), count[count > 1].astype(np.int32)))
        tok, sid, n, pos, typical, entries = (np.concatenate([o[k] for o in out]) for k in range(6))
        vote = mix(tok * np.uint64(0x9E3779B97F4A7C15)) % (1 + _prefix(n.astype(np.int64), num, den) // VOTES).astype(np.uint64) == 0
        rank = (typical.astype(np.int64) << 54) | (mix(sid.view(np.uint64)) >> np.uint64(10)).astype(np.int64)
        return pa.table({"tok": tok.view(np.int64), "sid": sid, "n": n, "pos": pos, "entries": entries, "vote": vote, "rank": rank})

    return go


def _sets(width: int, text_col: str):
    def go(batches):
        for b in batches:
            whole = [x.tobytes() for x in sets_of(text_column(b, text_col), width)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("node")), binary_array(whole)], ["node", "whole"])

    return go


def least_difference(x: bytes, y: bytes) -> int:
    """Shingles in which two sets differ at least: the larger sketch folds to the slots of the smaller one."""
    u, v = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.abs(u.astype(np.int64) - np.minimum(v.reshape(-1, len(u)).sum(0, dtype=np.int64), 255)).sum())


def _bounded(batches):
    """Greatest overlap that sketches allow: (a, b, na, nb, o)."""
    for b in batches:
        na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
        differ = np.array([least_difference(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)], np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array((na + nb - differ) // 2, pa.int64())], ["a", "b", "na", "nb", "o"])


def _overlaps(batches):
    """Overlap of two whole sets: (a, b, na, nb, o)."""
    for b in batches:
        na, nb, o = [], [], []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            z = np.concatenate([x, y])
            z.sort(kind="stable")
            na.append(len(x))
            nb.append(len(y))
            o.append(int((z[1:] == z[:-1]).sum()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(na, pa.int64()), pa.array(nb, pa.int64()), pa.array(o, pa.int64())], ["a", "b", "na", "nb", "o"])


_PAIR = "a long, b long, na long, nb long, o long"


class _Sets:
    """Overlaps of pairs of nodes, from the sketches of the first pass or from whole sets."""

    def __init__(self, d: DataFrame, first: DataFrame, width: int, num: int, den: int) -> None:
        self.texts, self.width, self.num, self.den = d.withColumnRenamed("doc_id", "node"), width, num, den
        self.sketches = first.where("sketch is not null").select(F.col("doc_id").alias("node"), "n", "sketch")

    def _ends(self, pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()

    def linked(self, o: str = "o", na: str = "na", nb: str = "nb"):
        return F.expr(f"({self.num + self.den}) * ({o}) >= {self.num} * ({na} + {nb})")

    def bound(self, pairs: DataFrame, name: str) -> DataFrame:
        """(a, b, na, nb, o), written: o is the greatest overlap that sketches allow. pairs: cheap to read again."""
        own = scratch(join_small(self.sketches, self._ends(pairs), ["node"], "inner", 32).dropDuplicates(), f"{name}-sketches")
        side = lambda k: own.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
        out = scratch(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(trimmed(_bounded), _PAIR), f"{name}-bounds")
        drop_scratch(own)
        return out

    def overlap(self, pairs: DataFrame, name: str) -> DataFrame:
        """(a, b, na, nb, o), written: o is the overlap. pairs: cheap to read again; only the texts of their ends are hashed."""
        own = join_small(self.texts, self._ends(pairs), ["node"], "inner", 32).mapInArrow(trimmed(_sets(self.width, "text")), "node long, whole binary").dropDuplicates()
        own = scratch(own.where("length(whole) > 0"), f"{name}-sets")
        side = lambda k: own.select(F.col("node").alias(k), F.col("whole").alias(f"w{k}"))
        out = scratch(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "wa", "wb").mapInArrow(trimmed(_overlaps), _PAIR), f"{name}-overlaps")
        drop_scratch(own)
        return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked at Jaccard >= num / den, transitively.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a set holds the distinct `width`-word shingles, or the
    whole sequence if there are fewer words. Null and wordless texts: empty set, their own component. Rows that
    repeat an id are one document with all their links, and each row is returned. A null id: component null, no
    links, the row is returned. Other columns, whatever their names, are left alone. An empty table: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    # 1: short hashes with about half a shingle a slot; buckets of at most a few million shingles, a few for each task
    size = (d.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 5
    bits = max(20, size.bit_length() + 1)
    top = max(4, min(bits - 8, max((4 * partitions(spark) - 1).bit_length(), (size // BUCKET).bit_length()), 22))
    first = scratch(d.mapInArrow(trimmed(_first(width, "doc_id", "text", bits, top)), _FIRST), "first")
    summary = first.where("n is not null").select("doc_id", "n", "s1", "s2")
    known = summary.where("n > 0 and doc_id is not null")
    nodes = scratch(known.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node")).withColumn("sid", F.col("s1").bitwiseXOR(F.col("n"))), "nodes")
    copies = scratch(known.join(nodes, ["s1", "s2", "n"]).where("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")), "copies")

    # 2
    often = scratch(first.where("blob is not null").select("bucket", "blob").groupBy("bucket").applyInArrow(_frequent(bits, top, FREQUENT), "h long, count long"), "frequent")
    if often.count() > ORDERED:
        often = often.orderBy(F.desc("count"), "h").limit(ORDERED)
    h, many = collect_longs(often)
    order = np.argsort(h)
    frequent = spark.sparkContext.broadcast((h[order], np.minimum(many[order], 2**31 - 1).astype(np.int32)))
    packed = d.mapInArrow(trimmed(_postings(width, "doc_id", "text", num, den, bits, 1 << top, frequent)), "bucket int, often boolean, tok binary, sid binary, n binary, pos binary, typical binary, counts binary")
    index = scratch(packed.groupBy("bucket").applyInArrow(_lists(num, den), "tok long, sid long, n int, pos int, entries int, vote boolean, rank long"), "lists")

    # 3
    sets = _Sets(d, first, width, num, den)
    votes = index.where("vote").select("tok", "sid", F.col("n").cast("long").alias("n"), "rank")
    mid = scratch(votes.groupBy("tok").agg(F.max_by("sid", "rank").alias("partner"), F.max_by("n", "rank").alias("m"), F.min("rank").alias("r0"), F.max("rank").alias("r1")).where("r0 != r1").select("tok", "partner", "m"), "typical")
    tried = join_small(votes, mid, ["tok"], "inner", 40).where((F.col("sid") != F.col("partner")) & (F.least("n", "m") * den >= num * F.greatest("n", "m")))
    count = tried.groupBy("sid", "partner").agg(F.count(F.lit(1)).alias("c"))
    best = count.groupBy("sid").agg(F.max_by("partner", F.shiftleft("c", 48) + F.shiftrightunsigned(F.xxhash64("partner"), 17)).alias("partner"))
    name = lambda sid, node: nodes.select(F.col("sid").alias(sid), F.col("node").alias(node))
    pairs = scratch(best.join(name("sid", "a"), "sid").join(name("partner", "b"), "partner").where("a != b").select("a", "b").distinct(), "leaders")
    near = sets.bound(pairs, "leaders").where(sets.linked()).select("a", "b").distinct()
    answers = sets.overlap(near, "leaders").where(sets.linked())
    links = copies.unionByName(answers.select("a", "b"))
    reached = components(links)
    # a node that stands for several sets, as rows repeat its id, leads but is not led
    twice = nodes.groupBy("node").count().where("count > 1").select(F.col("node").alias("a"))
    leaders = answers.join(twice, "a", "left_anti")
    leaders = leaders.select(F.col("a").alias("node"), F.struct((F.col("na") - F.col("o")).alias("x"), (F.col("nb") - F.col("o")).alias("y"), F.col("b").alias("leader")).alias("l"))
    leaders = scratch(leaders.groupBy("node").agg(F.min("l").alias("l")).select("node", "l.leader", "l.x", "l.y"), "led")

    # 4
    label = nodes.join(reached.withColumnRenamed("id", "node"), "node", "left").select("sid", "node", F.coalesce("component", "node").alias("component"))
    here = scratch(index.select("tok", "sid", "n", "pos", "entries").join(label, "sid").drop("sid"), "labelled")
    drop_scratch(index)
    several = scratch(here.groupBy("tok").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("tok"), "several")
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num))).cast("int")
    zone = F.floor(F.log2(F.col("pos") + 1.0)).cast("int")
    salt = F.pmod(F.xxhash64("node", F.lit("block")), F.greatest(F.lit(1), F.ceil(F.col("entries") / BLOCK)))
    left = join_small(here, several, ["tok"], "inner", 48).select("tok", band.alias("band"), F.xxhash64("tok", band, zone, salt).alias("block"), "node", "component", F.col("n").cast("long").alias("n"), (F.col("n") - F.col("pos")).cast("long").alias("rest"))
    entries = scratch(left, "entries")
    drop_scratch(here)
    block = entries.groupBy("tok", "band", "block").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.max("rest").alias("t1"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    block = scratch(block, "blocks")
    side = lambda k: block.select("tok", *(F.col(c).alias(f"{c}_{k}") for c in ("band", "block", "n0", "n1", "t1", "c0", "c1")))
    x = side("x").withColumn("band", F.explode(F.array("band_x", F.col("band_x") + 1)))
    y = side("y").withColumn("band", F.col("band_y"))
    close = (
        ((F.col("band_x") != F.col("band_y")) | (F.col("block_x") <= F.col("block_y"))) & (F.col("n1_x") * den >= F.col("n0_y") * num) & (F.col("n1_y") * den >= F.col("n0_x") * num)
        & (F.least("t1_x", "t1_y") * (num + den) >= (F.col("n0_x") + F.col("n0_y")) * num)
        & ~((F.col("c0_x") == F.col("c1_x")) & (F.col("c0_y") == F.col("c1_y")) & (F.col("c0_x") == F.col("c0_y")))
    )
    met = x.join(y, ["tok", "band"]).where(close).select("tok", "block_x", "block_y")
    row = lambda k: entries.select("tok", F.col("block").alias(f"block_{k}"), F.struct("node", "component", "n", "rest").alias(k))
    met = met.join(row("x"), ["tok", "block_x"]).join(row("y"), ["tok", "block_y"])
    met = met.where("x.node != y.node and x.component != y.component").where((F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num) & (F.least("x.rest", "y.rest") * (num + den) >= F.expr("x.n + y.n") * num))
    lower = F.col("x.node") < F.col("y.node")
    met = met.select(*(F.when(lower, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")).alias(a) for c, a in (("node", "u"), ("n", "nu"))), *(F.when(lower, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")).alias(a) for c, a in (("node", "v"), ("n", "nv"))))

    # 5
    led = lambda k: leaders.select(F.col("node").alias(k), F.col("leader").alias(f"l{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    across = met.distinct().join(led("u"), "u", "left").join(led("v"), "v", "left")
    across = across.select("u", "v", "nu", "nv", F.coalesce("lu", "u").alias("lu"), F.coalesce("lv", "v").alias("lv"), (F.coalesce("xu", F.lit(0)) + F.coalesce("xv", F.lit(0))).alias("more"), (F.coalesce("yu", F.lit(0)) + F.coalesce("yv", F.lit(0))).alias("less"))
    across = scratch(across.withColumn("a", F.least("lu", "lv")).withColumn("b", F.greatest("lu", "lv")).drop("lu", "lv"), "across")
    if not across.isEmpty():
        bound = sets.bound(across.select("a", "b").distinct(), "led")
        most = bound.groupBy("a", "b").agg(F.max("o").alias("o"))
        left = scratch(join_small(across, most, ["a", "b"], "inner", 40).where(sets.linked("o + more", "nu", "nv")).drop("o"), "open")
        known = sets.overlap(left.select("a", "b").distinct(), "open").groupBy("a", "b").agg(F.max("o").alias("o"), F.min("o").alias("p"))
        done = scratch(join_small(left, known, ["a", "b"], "inner", 48).where(sets.linked("o + more", "nu", "nv")).withColumn("sure", sets.linked("p - less", "nu", "nv")), "derived")
        rest = done.where("not sure").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()
        links = links.unionByName(done.where("sure").select(F.col("u").alias("a"), F.col("v").alias("b")))
        if not rest.isEmpty():
            again = sets.bound(rest, "rest").where(sets.linked()).select("a", "b").distinct()
            links = links.unionByName(sets.overlap(again, "rest").where(sets.linked()).select("a", "b"))
        reached = components(links)
    named = summary.select("doc_id", "n").join(reached.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One document of each component, the one with the smallest id, with all columns of docs.

    Of rows that repeat an id the whole repetition stays or goes; rows with a null id stay.
    """
    found = jaccard_components(docs, **how)
    gone = scratch(found.where("doc_id is not null and component_id != doc_id").select("doc_id").distinct(), "gone")
    rows = docs.select(F.struct("*").alias("row"), F.col(how.get("id_col", "doc_id")).cast("long").alias("doc_id"))
    return join_small(rows, gone, ["doc_id"], "left_anti", 32).select("row.*")
