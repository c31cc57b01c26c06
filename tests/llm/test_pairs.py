"""Near-duplicate operators against brute force, on texts and vectors with all edge cases."""

import random
import re

import numpy as np
import pytest

from gridloom.llm import caps, jaccard
from gridloom.llm.components import components
from gridloom.llm.shingles import sets_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, node string, n int, component_id long, TOK string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expected(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), None if i is None else root(i)) for i, s in sets if i is not None)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    base = [[word() for _ in range(rng.randint(20, 300))] for _ in range(12)]
    passage = [word() for _ in range(60)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "One two"), (6, "é É"), (7, "a b c d e"), (8, "A b\x0bc d e"), (9, "z " * 5000), (10, "z " * 7)]
    for k in range(260):
        w = list(base[k % 12])
        for _ in range(rng.choice([0, 0, 1, 2, 5, 12])):
            w[rng.randrange(len(w))] = word()
        if k % 3 == 0:
            w += passage
        rows.append((100 + k, " ".join(w)))
    for k in range(60):
        rows.append((500 + k, " ".join([word() for _ in range(30)] + passage)))
    return rows + [(100, rows[11][1]), (101, "another text with an id that repeats"), (None, "a b c d e"), (None, None)]


def test_sets_match_python():
    import pyarrow as pa

    texts = [t or "" for _, t in corpus()]
    got = list(sets_of(pa.array(texts, pa.large_string())))
    assert [len(x) for x in got] == [len(shingles(t)) for t in texts]


@pytest.mark.parametrize("frequent,votes,block", [(32, 8, 128), (2, 8, 4), (32, 0.2, 128), (2, 0.01, 2)])
def test_jaccard_equals_brute_force(spark, monkeypatch, frequent, votes, block):
    for name, value in (("FREQUENT", frequent), ("VOTES", votes), ("BLOCK", block)):
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], SCHEMA)
    got = jaccard.jaccard_components(df).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == expected(rows)
    assert sorted(((r.n_shingles, r.component_id) for r in got if r.doc_id is None), key=str) == [(0, None), (1, None)]


def test_sketches_never_overstate_a_difference():
    import pyarrow as pa

    rng = random.Random(9)
    text = lambda n, vocabulary: " ".join(str(rng.randrange(vocabulary)) for _ in range(n))
    texts = ["", "a", "z " * 3000, *(text(n, v) for n in (5, 70, 300, 1500, 9000) for v in (3, 50, 10**6))]
    texts += [t + " " + text(20, 10**6) for t in texts]
    sketch, sets = [jaccard.sketch_of(x) for x in sets_of(pa.array(texts, pa.large_string()))], [shingles(t) for t in texts]
    for i in range(len(texts)):
        assert jaccard.least_difference(sketch[i], sketch[i]) == 0
        for j in range(i):
            assert jaccard.least_difference(sketch[i], sketch[j]) <= len(sets[i] ^ sets[j])


def test_keep_one_and_empty(spark):
    df = spark.createDataFrame([(2, "a b c d e f", "p"), (1, "a b c d e f", "q"), (3, None, "r"), (None, "a", "s")], "doc_id long, text string, component string")
    assert sorted(r.component for r in jaccard.keep_one(df).collect()) == ["q", "r", "s"]
    assert jaccard.jaccard_components(df.limit(0)).collect() == []


def test_components_of_chain_and_hub(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(300, 360)] + [(7, 7), (300, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 5 for k in [5, *range(300, 360)]}


def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for g in range(30):
        c = rng.standard_normal(16)
        c /= np.linalg.norm(c)
        for k in range(40 if g == 0 else 4):
            rows.append((len(rows), (c + rng.standard_normal(16) * 0.03).tolist()))
    rows += [(len(rows) + k, rng.standard_normal(16).tolist()) for k in range(300)]
    n = len(rows)
    same = rows[3][1]
    return rows + [(n, same), (n + 1, [2 * x for x in same]), (n + 2, None), (n + 3, [0.0] * 16), (n + 4, [float("nan")] * 16), (n + 5, [None] * 16), (n + 6, []), (n + 7, [1.0, 2.0]), (n + 8, [float("inf")] * 16), (n + 9, [1e300] * 16), (None, same)]


@pytest.mark.parametrize("tile,rows_at_once", [(50_000, 512), (60, 512), (20, 7)])
def test_caps_recall_and_precision(spark, monkeypatch, tile, rows_at_once):
    monkeypatch.setattr(caps, "TILE", tile)
    monkeypatch.setattr(caps, "ROWS", rows_at_once)
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, "a") for i, v in rows], "vec_id long, embedding array<double>, node int, filter string")
    got = {r.vec_id: r for r in caps.near_duplicates(df).collect() if r.vec_id is not None}
    ok = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.stack([v / np.abs(v).max() for _, v in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    want = dict(zip([i for i, _ in ok], (s >= 0.95).sum(1).tolist()))
    assert len(got) == len(rows) - 1
    assert all(got[i].n_links <= n for i, n in want.items())
    assert sum(got[i].n_links for i in want) >= 0.95 * sum(want.values())
    for i, r in got.items():
        assert r.kept == (r.component_id == i)
        if i not in want:
            assert (r.n_links, r.component_id) == (0, i)
    assert caps.near_duplicates(df.limit(0)).collect() == []


def test_caps_of_repeated_ids(spark):
    """An id with two vectors joins both their components; equal rows are links of one another."""
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.999, 0.01, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 0.999, 0.01]), (9, [1.0, 0.01, 0.0]), (9, [0.01, 1.0, 0.0]), (5, [0.0, 0.0, 1.0]), (5, [0.0, 0.0, 1.0]), (None, [1.0, 0.0, 0.0])]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 2, 1, False), (9, 2, 1, False), (9, 2, 1, False), (5, 1, 5, True), (5, 1, 5, True), (None, 0, None, False)], key=str)


@pytest.mark.parametrize("n", [3000, 40_000])
def test_caps_recall_of_links_at_the_threshold(spark, n):
    """Pairs just above the least cosine amid single precision vectors, at two sizes; a vector goes to few tiles."""
    x, y = caps.pairs_at(32, 0.953, n // 20, seed=5)
    rng = np.random.default_rng(6)
    z = rng.standard_normal((n - 2 * len(x), 32))
    v = np.concatenate([x, y, z / np.linalg.norm(z, axis=1, keepdims=True)]).astype(np.float32)
    df = spark.createDataFrame([(k, r) for k, r in enumerate(v.tolist())], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in caps.near_duplicates(df).collect()}
    assert len(got) == n and sum(got[k].n_links >= 1 for k in range(2 * len(x))) >= 0.97 * 2 * len(x)
    assert all(got[k].component_id <= k for k in got)
    code = caps._code(32, n)
    assert np.mean([len(np.unique(t)) for t in code.tiles(np.array(code.decode(z[:300] / np.linalg.norm(z[:300], axis=1, keepdims=True))))]) <= code.filters / 2


def test_dense_links_are_joined_as_all_pairs_would():
    rng = np.random.default_rng(2)
    for share in (0.0, 0.02, 0.5, 1.0):
        hit = rng.random((90, 120)) < share
        left, right = rng.permutation(1000)[:90].astype(np.int64), rng.permutation(1000)[:120].astype(np.int64) + 1000
        want, got = caps.forest(left[np.nonzero(hit)[0]], right[np.nonzero(hit)[1]]), caps.forest(*caps._joined(hit, left, right))
        assert dict(zip(*want)) == dict(zip(*got))


@pytest.mark.parametrize("dim,n", [(64, 1 << 10), (64, 1 << 16), (64, 1 << 17), (64, (1 << 17) + 1), (64, 1 << 20), (16, 1 << 20)])
def test_caps_borderline_pairs_share_filters_at_every_size(dim, n):
    rng = np.random.default_rng(8)
    x, u = rng.standard_normal((2, 600, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u -= (u * x).sum(1, keepdims=True) * x
    y = 0.951 * x + (1 - 0.951**2) ** 0.5 * u / np.linalg.norm(u, axis=1, keepdims=True)
    code = caps._code(dim, n)
    a, b = code.decode(x), code.decode(y)
    assert np.mean([len(np.intersect1d(i, j)) > 0 for i, j in zip(a, b)]) >= 0.98
    assert min(map(len, a)) >= 8
