"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token's bytes are a linked list. Each adjacent pair that is in the vocabulary waits in the bucket of its rank;
equal ranks merge from the left. Two levels of bitmaps mark the buckets in use: find-first-set on the upper, then on the
lower, gives the least rank without a search. Entries whose pair has changed since are skipped when they surface.
Pre-tokens don't touch each other, so many short ones share a queue, and numpy works off a large bucket, one merge a
pre-token at a time. A long one has its own, where a bucket is a heap of positions: n bytes take O(n log n), however many.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterable
from heapq import heappop, heappush
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, blocks, raw, ship, text_column, trimmed

#: Bytes of texts whose new pre-tokens are merged together, and ids gathered at once: what a worker needs beside its
#: vocabulary grows with them, and executors keep little for Python.
TEXTS, IDS = 4 << 20, 1 << 18


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file's content: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return read_ranks(f.read())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Merges:
    """The ranks of a vocabulary by pairs of ids: any two tokens that make a token together.

    The rank queue is written out where it is used, as calls would cost as much as its steps: buckets of positions by
    rank; `lower` has a bitmap of the buckets in use for every 256 ranks, `upper` one of the lower bitmaps in use.
    """

    #: Bytes of a pre-token that shares a queue with others, and of all that share one; entries of a bucket for numpy.
    SHORT, TOGETHER, MANY = 64, 1 << 18, 24

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        most = max(ranks.values(), default=0)
        none: dict[int, int] = {}
        self.pairs: list[dict[int, int]] = [none] * (most + 2)  # by the left id, then the right one; the last for -1
        for token, r in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    if self.pairs[a] is none:
                        self.pairs[a] = {}
                    self.pairs[a][b] = r
        self.byte = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.bytes = np.array(self.byte, np.int32)
        self.two = np.array([self.pairs[a].get(b, -1) for a in self.byte for b in self.byte], np.int32)  # by two bytes
        left, right, to = np.array([(a, b, r) for a, x in enumerate(self.pairs) for b, r in x.items()], np.int32).reshape(-1, 3).T.copy()
        order, ids = np.argsort(right, kind="stable"), np.arange(most + 2)
        # the ids right of an id and left of it, with the ranks; where each id's begin
        self.right, self.right_rank, self.right_at = right, to, np.searchsorted(left, ids)
        self.left, self.left_rank, self.left_at = left[order], to[order], np.searchsorted(right[order], ids)
        self.lower = [0] * ((most >> 8) + 1)  # all 0 between pre-tokens

    def ids(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        pairs, lower, byte = self.pairs, self.lower, self.byte
        n = len(piece)
        token = [byte[b] for b in piece]  # of the part that starts here; -1: merged away, and behind the end
        token.append(-1)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        upper, buckets = 0, {}
        a = token[0]
        for i in range(n - 1):
            b = token[i + 1]
            r = pairs[a].get(b)
            a = b
            if r is None:
                continue
            if r in buckets:
                buckets[r].append(i)  # in order, so it stays a heap
            else:
                buckets[r] = [i]
                lower[r >> 8] |= 1 << (r & 255)
                upper |= 1 << (r >> 8)
        while upper:
            # find-first-set on the upper bitmap, then on the lower one
            hi = (upper & -upper).bit_length() - 1
            low = lower[hi]
            r = hi << 8 | (low & -low).bit_length() - 1
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                del buckets[r]
                low &= low - 1
                lower[hi] = low
                if not low:
                    upper &= upper - 1
            mid = after[i]
            if pairs[token[i]].get(token[mid]) != r:
                continue  # stale
            token[i], token[mid] = r, -1
            last = after[i] = after[mid]
            before[last] = i
            s = pairs[r].get(token[last])
            if s is not None:
                if s in buckets:
                    heappush(buckets[s], i)
                else:
                    buckets[s] = [i]
                    lower[s >> 8] |= 1 << (s & 255)
                    upper |= 1 << (s >> 8)
            i = before[i]
            if i >= 0:
                s = pairs[token[i]].get(r)
                if s is not None:
                    if s in buckets:
                        heappush(buckets[s], i)
                    else:
                        buckets[s] = [i]
                        lower[s >> 8] |= 1 << (s & 255)
                        upper |= 1 << (s >> 8)
        return [x for x in token if x >= 0]

    def many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens one after the other, and how many each has."""
        out: list = [None] * len(pieces)
        short = []
        for k, p in enumerate(pieces):
            if len(p) > self.SHORT or p in self.ranks:
                out[k] = self.ids(p)
            else:
                short.append(k)
        n = np.zeros(len(pieces), np.int64)
        own = [k for k, x in enumerate(out) if x is not None]
        n[own] = [len(out[k]) for k in own]
        parts = [np.fromiter((x for k in own for x in out[k]), np.int32)]
        for i, j in blocks(np.cumsum([0, *(len(pieces[k]) for k in short)]), self.TOGETHER):
            ids, n[short[i:j]] = self._together([pieces[k] for k in short[i:j]])
            parts.append(ids)
        order = np.array([*own, *short], np.int64)  # of the parts
        starts = np.empty(len(pieces), np.int64)
        starts[order] = np.cumsum(n[order]) - n[order]
        return _runs(np.concatenate(parts), starts, n), n

    def _together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"\0".join([b"", *pieces, b""]), np.uint8)
        marks = np.cumsum([0, *(len(p) + 1 for p in pieces)])  # a mark before each, and one behind all
        token = self.bytes[data]  # of the part that starts here; -1: merged away, or a mark
        token[marks] = -1
        rank = np.append(self.two[data[:-1].astype(np.int64) << 8 | data[1:]], np.int32(-1))  # of the pair that starts here
        rank[marks] = -1
        rank[marks[1:] - 1] = -1
        piece = np.repeat(np.arange(len(marks), dtype=np.int32), np.diff(marks, append=len(data)))
        after, before = np.arange(1, len(data) + 1, dtype=np.int32), np.arange(-1, len(data) - 1, dtype=np.int32)
        follows, leads = np.full((2, len(self.pairs)), -1, np.int32)  # ranks by the other id of a pair, for one id at a time
        token_at, rank_at, after_at, before_at = map(memoryview, (token, rank, after, before))  # quicker one by one
        pairs, lower, upper, buckets = self.pairs, self.lower, 0, {}
        p = np.flatnonzero(rank >= 0)
        q = rank[p]
        while True:
            if len(q):
                order = np.argsort(q, kind="stable")
                p, q = p[order].tolist(), q[order]
                cuts = [0, *(np.flatnonzero(q[1:] != q[:-1]) + 1).tolist()]
                for s, i, j in zip(q[cuts].tolist(), cuts, [*cuts[1:], len(p)], strict=True):
                    if s in buckets:
                        buckets[s] += p[i:j]
                    else:
                        buckets[s] = p[i:j]
                        lower[s >> 8] |= 1 << (s & 255)
                        upper |= 1 << (s >> 8)
            p = q = ()
            if not upper:
                break
            # find-first-set on the upper bitmap, then on the lower one
            hi = (upper & -upper).bit_length() - 1
            low = lower[hi]
            r = hi << 8 | (low & -low).bit_length() - 1
            bucket = buckets[r]
            if len(bucket) < self.MANY:
                bucket.sort(reverse=True)
                while bucket:
                    i = bucket.pop()
                    if rank_at[i] != r:
                        continue  # stale
                    mid, j = after_at[i], before_at[i]
                    last = after_at[mid]
                    token_at[i], token_at[mid], rank_at[mid] = r, -1, -1
                    after_at[i], before_at[last] = last, i
                    s = rank_at[i] = pairs[r].get(token_at[last], -1)
                    t = rank_at[j] = pairs[token_at[j]].get(r, -1)
                    for k, x in ((s, i), (t, j)):
                        if k < 0:
                            continue
                        if k in buckets:
                            buckets[k].append(x)
                        else:
                            buckets[k] = [x]
                            lower[k >> 8] |= 1 << (k & 255)
                            upper |= 1 << (k >> 8)
                    if 0 <= s < r or 0 <= t < r:
                        break  # that one first
            else:
                i = np.array(bucket, np.int32)
                i = i[rank[i] == r]
                i.sort()
                # the leftmost of each pre-token; what it leads to may come before the next one
                own = piece[i]
                again = np.flatnonzero(own[1:] == own[:-1]) + 1
                buckets[r] = bucket = i[again].tolist()
                if len(again):
                    i = np.delete(i, again)
                mid, j = after[i], before[i]
                last = after[mid]
                token[i], token[mid], rank[mid] = r, -1, -1
                after[i], before[last] = last, i
                a, b = self.right_at[r], self.right_at[r + 1]
                follows[self.right[a:b]] = self.right_rank[a:b]
                rank[i] = s = follows[token[last]]
                follows[self.right[a:b]] = -1
                a, b = self.left_at[r], self.left_at[r + 1]
                leads[self.left[a:b]] = self.left_rank[a:b]
                rank[j] = t = leads[token[j]]
                leads[self.left[a:b]] = -1
                p, q = np.concatenate([i, j]), np.concatenate([s, t])
                kept = q >= 0
                p, q = p[kept], q[kept]
            if not bucket:
                del buckets[r]
                lower[hi] ^= 1 << (r & 255)
                if not lower[hi]:
                    upper ^= 1 << hi
        return token[token >= 0], np.diff(np.cumsum(token >= 0)[marks])


def _runs(flat: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[starts[k] : starts[k] + n[k]] for every k, one after the other."""
    ends = np.cumsum(n)
    at = np.repeat(starts - ends + n, n)
    at += np.arange(len(at))
    return flat[at]


class _Generation:
    """Pre-tokens numbered as they are met; by number, where their ids start and how many they are."""

    def __init__(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.ids, self.starts, self.n = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, n: np.ndarray) -> None:
        """The ids of the next numbers."""
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(n) - n])
        self.ids, self.n = np.concatenate([self.ids, ids]), np.concatenate([self.n, n])


class _Memory:
    """Ids by pre-token; a young and an old generation, so that it stays bounded and common pre-tokens stay in it."""

    MOST, LONGEST = 60_000, 64

    def __init__(self, merges: Merges) -> None:
        self.merges, self.young, self.old = merges, _Generation(), _Generation()

    def forget(self) -> None:
        """Between tasks: what has not been met lately."""
        self.old = _Generation()

    def encode(self, texts: Iterable[list[str]]) -> tuple[list[np.ndarray], np.ndarray]:
        """The numbers of texts' pre-tokens, good until the next call, and n + 1 offsets into the texts' ids."""
        if len(self.young.n) >= self.MOST or len(self.young.ids) >= 16 * self.MOST:
            self.young, self.old = _Generation(), self.young
        young, old = self.young, self.old
        had, number = len(young.number), young.number.__getitem__
        found = [np.fromiter(map(number, words), np.int32, len(words)) for words in texts]
        new = list(islice(young.number, had, None))
        known = np.array([old.number.get(w, -1) for w in new], np.int64)
        ids, n = self.merges.many([w.encode() for w, k in zip(new, known.tolist(), strict=True) if k < 0])
        starts, count = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        starts[known < 0], count[known < 0] = len(old.ids) + np.cumsum(n) - n, n
        starts[known >= 0], count[known >= 0] = old.starts[known[known >= 0]], old.n[known[known >= 0]]
        young.add(_runs(np.concatenate([old.ids, ids]), starts, count), count)
        for w in new:
            if len(w) > self.LONGEST:
                del young.number[w]
        return found, np.cumsum([0, *(int(young.n[x].sum()) for x in found)])

    def ids(self, found: list[np.ndarray]) -> np.ndarray:
        """The ids of texts one after the other."""
        words = np.concatenate([np.zeros(0, np.int32), *found])
        return _runs(self.young.ids, self.young.starts[words], self.young.n[words])


class Codec:
    """Encodes as a rank file and a pattern say, without special tokens; decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.find = regex.compile(pattern).findall
        token = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            token[v] = k
        self.token = pa.array(token, pa.large_binary())
        self.number = pa.array([b"%d," % k for k in range(len(token))], pa.large_binary())
        self.words = _Memory(Merges(ranks))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after the other, and n + 1 offsets into them."""
        words, ends = self.words_of(texts)
        return self.words.ids(words), ends

    def words_of(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """The numbers of each text's pre-tokens, for words.ids, and n + 1 offsets into the texts' ids."""
        return self.words.encode(map(self.find, texts))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[memoryview]:
        """The bytes of each text."""
        return _taken(self.token, ids, offsets)

    def listed(self, ids: np.ndarray, offsets: np.ndarray) -> list[memoryview]:
        """The decimal ids of each text, joined by commas."""
        return [x[:-1] for x in _taken(self.number, ids, offsets)]


def _taken(values: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> list[memoryview]:
    """The values of each text's ids, concatenated."""
    data, at = raw(values.take(pa.array(ids)))
    data, at = memoryview(data), at[offsets].tolist()
    return [data[i:j] for i, j in zip(at, at[1:])]


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(digest: str, shared, pattern: str) -> Codec:
    """One for each Python worker, rank file (by its content) and pattern."""
    key = (digest, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(shared.value), pattern)
    return _codecs[key]


def _encode(digest: str, shared, pattern: str, id_col: str, with_ids: bool):
    def go(batches):
        codec = _codec(digest, shared, pattern)
        for b in batches:
            texts = text_column(b, "text")
            for i, j in blocks(raw(texts)[1], TEXTS):
                words, ends = codec.words_of(texts.slice(i, j - i).to_pylist())
                for k, m in blocks(ends, IDS):
                    own, off = codec.words.ids(words[k:m]), ends[k : m + 1] - ends[k]
                    digests = [[hashlib.sha256(x).hexdigest() for x in f(own, off)] for f in (codec.listed, codec.decode)]
                    cols = [b.column(0).slice(i + k, m - k), pa.array(np.diff(off), pa.int64()), *(pa.array(x, pa.string()) for x in digests)]
                    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(own)))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names)
        codec.words.forget()

    return trimmed(go)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for every row of docs, in one pass without a shuffle.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the bytes that the ids decode to, both in
    lower-case hex. path: a rank file on the driver, which Spark sends to the executors (64 MB at most, else an
    error); its vocabulary is assumed to hold all 256 bytes. path and pattern default to those of the public
    tokenizer. Null and empty texts: no tokens, the digests of no bytes. Null and repeated ids and repeated rows are
    kept row by row; other columns are left alone. No rows: no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(path or default_path(), "rb") as f:
        data = f.read(BROADCAST_BYTES + 1)
    if len(data) > BROADCAST_BYTES:
        raise ValueError(f"a rank file of more than {BROADCAST_BYTES} bytes")
    go = _encode(hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data), pattern or default_pattern(), "doc_id", with_ids)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(go, schema)
