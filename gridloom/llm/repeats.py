"""Suffix-array removal of byte strings of 200 and more that occur twice, over whole corpora.

Only suffixes that can matter are sorted. Every 200-byte window names the leftmost of its 32-byte grams with the
smallest hash, its anchor; equal windows name equal anchors at equal offsets. An anchor's windows fall into two
classes: those with at most 84 bytes before the anchor hang on the suffix that starts at the anchor, the others on the
suffix that starts 84 bytes before it. Equal windows thus hang on suffixes that agree in 116 leading bytes, their lead.

1. Hashes of leads are counted over all documents; windows of a lead that occurs once can't repeat. No text moves.
2. Every other suffix becomes a context, the bytes from its first window's start to its last one's end, written once
   for a batch of texts in which it occurs; places are written without bytes. Contexts are grouped by their bytes; all
   windows of a context that occurs twice repeat.
3. Distinct contexts are range-partitioned by their suffixes' bytes, with sampled splitters. A bucket sorts suffixes,
   and the reversed bytes before them, by multikey quicksort and compares neighbours: windows at offset d are equal
   where suffixes agree in 200 - d bytes and the bytes before in d bytes.
4. Buckets are compared across their boundaries: a window whose part of the suffix is also a prefix of its bucket's
   first or last suffix may go on in another bucket. Such windows are told apart by hash, and those that two buckets
   have are grouped by their bytes. A lead with any number of contexts therefore spreads over as many buckets as it needs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, binary_array, blocks, collect_longs, drop_scratch, mix, partitions, raw, scratch, ship, text_column, trimmed

#: Distinct repeated leads up to which their hashes are broadcast (8 bytes each); beyond it they are joined.
BROADCAST_GRAMS = 6_000_000
#: Contexts of a bucket; rows that quicksort leaves to a sort of whole strings.
BUCKET, FEW = 40_000, 24

_GRAM = 32
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x2545F4914F6CDD1D)


def _grams(b: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each position on."""
    h, base, step = _TABLE[b], _BASE, 1
    with np.errstate(over="ignore"):
        while step < _GRAM:
            h = h[:-step] * base + h[step:]
            base, step = base * base, 2 * step
    return mix(h)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the `width` values from each position on."""
    m, have = x, 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(x) - width + 1], m[width - have :][: len(x) - width + 1])


def _half(length: int) -> int:
    """Most bytes that a window of the first class has before its anchor."""
    return (length - _GRAM) // 2


def _lead(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` bytes from given positions, from those of the grams that cover them."""
    out = h[at]
    for k in [*range(_GRAM, size - _GRAM, _GRAM), size - _GRAM]:
        out = mix(out * _BASE + h[at + k])
    return out.view(np.int64)


def _runs(data: np.ndarray, offsets: np.ndarray, length: int):
    """(row, suffix, first window, last window, lead) arrays for blocks of rows; positions count from the row."""
    half = _half(length)
    for i, j in blocks(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        for a in range(lo, max(lo + 1, hi - length + 1), 4 << 20):  # a very long row goes in pieces of starts
            b = data[a : min(hi, a + (4 << 20) + length - 1)]
            if len(b) < length:
                continue
            h = _grams(b)
            at = np.arange(len(h), dtype=np.uint64)
            anchor = (_least((h >> np.uint64(24) << np.uint64(24)) | at, length - _GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
            start = np.arange(len(anchor), dtype=np.int64)
            row = np.searchsorted(offsets, start + a, "right") - 1
            good = start + a + length <= offsets[row + 1]
            start, anchor, row = start[good], anchor[good], row[good]
            if not len(start):
                continue
            new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (row[1:] != row[:-1])]))
            p, s0, s1, r = anchor[new], start[new], start[np.append(new[1:], len(start)) - 1], row[new]
            near, far = np.flatnonzero(p - s1 <= half), np.flatnonzero(p - s0 > half)
            lead = np.concatenate([_lead(h, p[near], length - half), _lead(h, p[far] - half, _GRAM + half)])
            r, q = np.concatenate([r[near], r[far]]), np.concatenate([p[near], p[far] - half])
            first = np.concatenate([np.maximum(s0[near], p[near] - half), s0[far]])
            last = np.concatenate([s1[near], np.minimum(s1[far], p[far] - half - 1)])
            base = a - offsets[r]
            yield r, q + base, first + base, last + base, lead


def _lead_counts(length: int):
    def go(batches):
        for b in batches:
            data, offsets = raw(text_column(b, "text"))
            got = [x[4] for x in _runs(data, offsets, length)]
            if got:
                h, n = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    return go


def _leads_of_rows(length: int):
    def go(batches):
        for b in batches:
            data, offsets = raw(text_column(b, "text"))
            for r, _, _, _, h in _runs(data, offsets, length):
                x = np.unique(np.stack([r, h], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 1]), b.column(0).take(pa.array(x[:, 0])), b.column(1).take(pa.array(x[:, 0]))], ["h", "k1", "k2"])

    return go


_FOUND = "k1 long, k2 long, h1 long, h2 long, at binary, back int, ctx binary, n long"


def _contexts(length: int, known, salt: int):
    """Places of contexts (k1, k2, h1, h2, at), and once a batch their bytes (h1, h2, back, ctx, n)."""

    def go(batches):
        for b in batches:
            data, offsets = raw(text_column(b, "text"))
            own = None if known else b.column(3)
            for r, q, s0, s1, h in _runs(data, offsets, length):
                if known:
                    g = known.value
                    keep = g[np.minimum(np.searchsorted(g, h), len(g) - 1)] == h if len(g) else np.zeros(len(h), bool)
                else:
                    keep = np.zeros(len(h), bool)
                    for k in np.unique(r):
                        keep[r == k] = np.isin(h[r == k], np.asarray(own[int(k)].as_py() or [], np.int64))
                r, q, s0, s1 = r[keep], q[keep], s0[keep], s1[keep]
                if not len(r):
                    continue
                base = offsets[r]
                places: dict = {}
                count: dict = {}
                for row, at, back, x, y in zip(r.tolist(), q.tolist(), (q - s0).tolist(), (base + s0).tolist(), (base + s1 + length).tolist(), strict=True):
                    c = (back, data[x:y].tobytes())
                    places.setdefault((row, c), []).append(at)
                    count[c] = count.get(c, 0) + 1
                name = {c: hashlib.blake2b(c[1], digest_size=16, salt=c[0].to_bytes(4, "little") + salt.to_bytes(4, "little")).digest() for c in count}
                row = pa.array([k[0] for k in places], pa.int64())
                ck = np.frombuffer(b"".join(name[k[1]] for k in places), np.int64).reshape(-1, 2)
                none = lambda kind, n=len(places): pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(row), b.column(1).take(row), pa.array(ck[:, 0]), pa.array(ck[:, 1]), binary_array([np.asarray(v, np.int64).tobytes() for v in places.values()]), none(pa.int32()), none(pa.binary()), none(pa.int64())],
                    ["k1", "k2", "h1", "h2", "at", "back", "ctx", "n"],
                )
                ck = np.frombuffer(b"".join(name.values()), np.int64).reshape(-1, 2)
                none = lambda kind, n=len(count): pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays(
                    [none(pa.int64()), none(pa.int64()), pa.array(ck[:, 0]), pa.array(ck[:, 1]), none(pa.binary()), pa.array([c[0] for c in count], pa.int32()), binary_array([c[1] for c in count]), pa.array(list(count.values()), pa.int64())],
                    ["k1", "k2", "h1", "h2", "at", "back", "ctx", "n"],
                )

    return go


def multikey_quicksort(strings: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of bytes, whose width is a multiple of 8; a character is 8 bytes.

    A group of rows that agree so far is parted in three by its pivot's next character; the middle goes on to the
    character after it. Small groups are sorted as whole strings.
    """
    words = strings.view(">u8").astype(np.uint64)
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        a, z, w = todo.pop()
        if z - a < 2 or w == words.shape[1]:
            continue
        rows = order[a:z]
        if z - a <= FEW:
            order[a:z] = sorted(rows.tolist(), key=lambda k: strings[k].tobytes())
            continue
        x = words[rows, w]
        pivot = np.sort(x[[0, (z - a) // 2, -1]])[1]
        less, more = x < pivot, x > pivot
        low, high = rows[less], rows[more]
        order[a:z] = np.concatenate([low, rows[~(less | more)], high])
        todo += [(a, a + len(low), w), (a + len(low), z - len(high), w + 1), (z - len(high), z, w)]
    return order


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Leading bytes in which rows of x agree with rows of y, or with the one row y."""
    out = np.empty(len(x), np.int64)
    for a in range(0, len(x), 1 << 15):
        differ = x[a : a + (1 << 15)] != (y[a : a + (1 << 15)] if y.ndim == 2 else y)
        out[a : a + len(differ)] = np.where(differ.any(1), differ.argmax(1), x.shape[1])
    return out


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in parts), np.uint8).reshape(-1, width)


def _window_hashes(right: np.ndarray, before: np.ndarray, row: np.ndarray, d: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of windows: length - d bytes of a row's suffix and d bytes before it."""
    power = np.cumprod(np.full(length, _BASE, np.uint64))
    out = np.empty(len(row), np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(row), 1 << 14):
            rows, own = np.unique(row[a : a + (1 << 14)], return_inverse=True)
            k = d[a : a + (1 << 14)]
            x = np.cumsum(_TABLE[right[rows][:, :length]] * power, axis=1)
            y = np.cumsum(_TABLE[before[rows]] * power[: before.shape[1]], axis=1)
            out[a : a + (1 << 14)] = mix(x[own, length - k - 1]) * _BASE + mix(np.where(k > 0, y[own, np.maximum(k, 1) - 1], 0) + k.astype(np.uint64))
    return mix(out).view(np.int64)


def repeated_starts(contexts: list[bytes], back: np.ndarray, length: int, edges: bool = False):
    """For distinct contexts, each with its suffix `back` bytes in: (context, d) where the window that starts d bytes
    before the suffix equals a window of another context. With edges also (context, d, windows here, hash) of windows
    that may have equals in another bucket: each that has none here, and one of those that are equal here."""
    m, half = len(contexts), _half(length)
    wide_r, wide_l = -(-length // 8) * 8, -(-(length - _GRAM - half) // 8) * 8
    right = _matrix([c[k : k + length] for c, k in zip(contexts, back.tolist(), strict=True)], wide_r)
    order = multikey_quicksort(right)
    agree = np.append(0, _shared(right[order][1:], right[order][:-1]))
    reach = np.zeros(m, np.int64)
    if edges and m:
        reach[:] = np.maximum(_shared(right, right[order[0]]), _shared(right, right[order[-1]]))
    # rows that agree with no neighbour and no edge in a lead can't have equal windows
    live = (agree >= _GRAM + half) | np.append(agree[1:] >= _GRAM + half, False)
    live = order[live | (reach[order] >= _GRAM + half)]
    contexts, back, right, reach = [contexts[k] for k in live.tolist()], back[live], right[live], reach[live]
    n = len(live)
    agree_r = np.append(0, _shared(right[1:], right[:-1])) if n else np.zeros(0, np.int64)
    before = _matrix([c[:k][::-1] for c, k in zip(contexts, back.tolist(), strict=True)], wide_l)
    by_l = multikey_quicksort(before)
    agree_l = np.append(0, _shared(before[by_l][1:], before[by_l][:-1])) if n else np.zeros(0, np.int64)
    least = np.array([length - (len(c) - k) for c, k in zip(contexts, back.tolist(), strict=True)], np.int64)
    found, open_ = [np.zeros((0, 2), np.int64)], [np.zeros((0, 3), np.int64)]
    lc = np.empty(n, np.int64)
    for d in range(length - _GRAM - half + 1):
        sel = np.flatnonzero((least <= d) & (d <= back))
        if not len(sel):
            continue
        rc = np.cumsum(agree_r < length - d)
        lc[by_l] = np.cumsum(agree_l < d)
        key = rc[sel] * (n + 1) + lc[sel]
        k = np.argsort(key, kind="stable")
        same = key[k][1:] == key[k][:-1]
        hit, first = np.append(same, False) | np.append(False, same), np.append(True, ~same)
        found.append(np.stack([sel[k][hit], np.full(int(hit.sum()), d)], 1))
        if edges:
            go = first & (reach[sel[k]] >= length - d)
            open_.append(np.stack([sel[k][go], np.full(int(go.sum()), d), np.where(hit[go], 2, 1)], 1))
    found = np.concatenate(found)
    found[:, 0] = live[found[:, 0]]
    if not edges:
        return found
    open_ = np.concatenate(open_)
    open_ = open_[np.argsort(open_[:, 0], kind="stable")]
    return found, live[open_[:, 0]], open_[:, 1], open_[:, 2], _window_hashes(right, before, open_[:, 0], open_[:, 1], length)


def _packed(where: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Contexts, and for each its offsets d as pairs of first and last."""
    if not len(where):
        return np.zeros(0, np.int64), pa.array([], pa.list_(pa.int32()))
    order = np.lexsort((where[:, 1], where[:, 0]))
    c, d = where[order, 0], where[order, 1]
    a = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (d[1:] != d[:-1] + 1)]))
    z = np.append(a[1:], len(c)) - 1
    runs = np.stack([d[a], d[z]], 1).astype(np.int32).ravel()
    cut = np.flatnonzero(np.append(True, np.diff(c[a]) != 0))
    return c[a][cut], pa.ListArray.from_arrays(pa.array(np.append(2 * cut, len(runs)).astype(np.int32)), pa.array(runs))


_SORTED = "h1 long, h2 long, runs array<int>, w long, d int, n int"


def _bucket(length: int):
    """Runs of offsets of repeated windows (h1, h2, runs), and windows to compare with other buckets (h1, h2, w, d, n)."""

    def go(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        h1, h2 = t.column("h1").to_numpy(), t.column("h2").to_numpy()
        back, ctx, n = t.column("back").to_numpy(), t.column("ctx").to_pylist(), t.column("n").to_numpy()
        whole = np.flatnonzero(n > 1)
        size = np.array([len(x) for x in ctx])
        runs = np.stack([length - (size - back)[whole], back[whole]], 1).astype(np.int32).ravel()
        where, c, d, count, w = repeated_starts(ctx, back.astype(np.int64), length, True)
        some, lists = _packed(where)
        for at, found in ((whole, pa.ListArray.from_arrays(pa.array(np.arange(0, len(runs) + 1, 2, dtype=np.int32)), pa.array(runs))), (some, lists)):
            if len(at):
                none = [pa.nulls(len(at), x) for x in (pa.int64(), pa.int32(), pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(h1[at]), pa.array(h2[at]), found, *none], ["h1", "h2", "runs", "w", "d", "n"])
        for a in range(0, len(c), 100_000):
            x = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(h1[c[x]]), pa.array(h2[c[x]]), pa.nulls(len(c[x]), pa.list_(pa.int32())), pa.array(w[x]), pa.array(d[x].astype(np.int32)), pa.array(count[x].astype(np.int32))], ["h1", "h2", "runs", "w", "d", "n"])

    return go


def _spans_of(batches):
    """Covered bytes of an occurrence list: (k1, k2, spans) with first and last starts as pairs of int64."""
    for b in batches:
        out = []
        for at, runs in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            q, r = np.frombuffer(at, np.int64), np.asarray(runs, np.int64).reshape(-1, 2)
            out.append(np.stack([(q[:, None] - r[:, 1]).ravel(), (q[:, None] - r[:, 0]).ravel()], 1).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), binary_array(out)], ["k1", "k2", "spans"])


def _covered(length: int):
    """(k1, k2, cover): a text's maximal removed runs."""

    def go(batches):
        for b in batches:
            out = [_merge(np.concatenate([np.frombuffer(y, np.int64) for y in x]).reshape(-1, 2), length).tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), binary_array(out)], ["k1", "k2", "cover"])

    return go


def _merge(spans: np.ndarray, length: int) -> np.ndarray:
    """Maximal byte runs covered by windows that start in the given (first, last) ranges."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    s = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(s[:, 1] + length)
    new = np.concatenate([[True], s[1:, 0] > end[:-1]])
    a = np.flatnonzero(new)
    return np.stack([s[a, 0], end[np.append(a[1:], len(s)) - 1]], 1)


def _apply(batches):
    for b in batches:
        data, offsets = raw(text_column(b, "text"))
        n, gone, runs, digest, cover = [], [], [], [], []
        for k, x in enumerate(b.column(b.schema.get_field_index("cover")).to_pylist()):
            row = data[offsets[k] : offsets[k + 1]]
            m = np.frombuffer(x or b"", np.int64).reshape(-1, 2)
            h, at = hashlib.sha256(), 0
            for s, e in m.tolist():
                h.update(row[at:s].tobytes())
                at = e
            h.update(row[at:].tobytes())
            n.append(len(row))
            gone.append(int((m[:, 1] - m[:, 0]).sum()))
            runs.append(len(m))
            digest.append(h.hexdigest())
            cover.append(m.tolist())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(cover, pa.list_(pa.list_(pa.int64())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, broadcast_grams: int = BROADCAST_GRAMS, salt: int = 0) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): bytes covered by a `length`-byte string that starts twice.

    spans: the removed [first, end) byte ranges. Texts are UTF-8 bytes, null and empty ones have no bytes; matches
    never cross documents, overlapping ones in one document count. Rows that repeat id and text count as two
    occurrences and get equal results. Null ids are kept as null. Other columns are left alone. No rows: no rows.
    length: at least 64. salt: of the digests that stand for contexts; should two contexts ever have one digest, all
    is done again with the next salt.
    """
    if length < 2 * _GRAM:
        raise ValueError(f"length must be at least {2 * _GRAM}")
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = d.select(F.coalesce("doc_id", F.lit(0)).alias("k1"), F.xxhash64("doc_id", "text").alias("k2"), "text")

    # 1
    again = scratch(d.select("text").mapInArrow(trimmed(_lead_counts(length)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "leads")
    if again.count() <= broadcast_grams:
        known = spark.sparkContext.broadcast(np.sort(collect_longs(again)[0]))
        source = keyed
    else:
        known = None
        own = scratch(keyed.mapInArrow(_leads_of_rows(length), "h long, k1 long, k2 long").join(again, "h").groupBy("k1", "k2").agg(F.collect_set("h").alias("own")), "own-leads")
        source = keyed.join(own, ["k1", "k2"])

    # 2
    table = scratch(source.mapInArrow(trimmed(_contexts(length, known, salt)), _FOUND), "contexts")
    drop_scratch(again)
    distinct = scratch(table.where("ctx is not null").groupBy("back", "ctx").agg(F.sum("n").alias("n"), F.min("h1").alias("h1"), F.min("h2").alias("h2")), "distinct")
    m = distinct.count()
    if not distinct.groupBy("h1", "h2").count().where("count > 1").isEmpty():
        return repeated_spans(docs, id_col, text_col, length, broadcast_grams, salt + 1)

    # 3
    suffix, ahead = F.expr("substring(ctx, back + 1)"), F.expr("substring(ctx, 1, back)")
    buckets = distinct.select("h1", "h2", "back", "ctx", "n").repartitionByRange(max(1, partitions(spark), -(-m // BUCKET)), suffix, ahead)
    done = scratch(buckets.mapInArrow(trimmed(_bucket(length)), _SORTED), "sorted")

    # 4
    edges = done.where("w is not null")
    wanted = edges.groupBy("w").agg(F.count(F.lit(1)).alias("buckets")).where("buckets > 1").select("w")
    open_ = edges.join(wanted, "w").select("h1", "h2", "d").join(distinct.select("h1", "h2", "back", "ctx"), ["h1", "h2"])
    open_ = scratch(open_.select("h1", "h2", "d", F.substring("ctx", F.col("back") - F.col("d") + 1, F.lit(length)).alias("window")), "edges")
    equal = open_.groupBy("window").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("window")
    across = open_.join(equal, "window").groupBy("h1", "h2").agg(F.flatten(F.transform(F.collect_set("d"), lambda x: F.array(x, x))).alias("runs"))
    found = scratch(done.where("runs is not null").select("h1", "h2", "runs").unionByName(across), "found")
    drop_scratch(distinct)

    n, extra = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()
    hint = F.broadcast if n * 48 + 4 * extra <= BROADCAST_BYTES else (lambda x: x)
    spans = table.where("ctx is null").select("k1", "k2", "h1", "h2", "at").join(hint(found), ["h1", "h2"]).select("k1", "k2", "at", "runs").mapInArrow(_spans_of, "k1 long, k2 long, spans binary")
    # rows that repeat id and text have equal spans, so that a set of them stays as small as one row's
    cover = scratch(spans.groupBy("k1", "k2").agg(F.collect_set("spans").alias("spans")).mapInArrow(_covered(length), "k1 long, k2 long, cover binary"), "cover")
    for x in (table, done, open_, found):
        drop_scratch(x)
    n, extra = cover.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("cover")), F.lit(0))).first()
    hint = F.broadcast if n * 64 + extra <= BROADCAST_BYTES else (lambda x: x)
    marked = d.withColumn("k1", F.coalesce("doc_id", F.lit(0))).withColumn("k2", F.xxhash64("doc_id", "text"))
    marked = marked.join(hint(cover), ["k1", "k2"], "left").select("doc_id", "text", "cover")
    return marked.mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<bigint>>")
