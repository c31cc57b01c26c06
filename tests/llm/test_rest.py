"""Search, rollups and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import kdtopk, rollup
from gridloom.llm.common import scratch_path


@pytest.mark.parametrize("shard", [8192, 100])
def test_top_k_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(kdtopk, "SHARD", shard)
    rng = np.random.default_rng(1)
    v = rng.standard_normal((700, 8)) * 0.4
    v[100:200] = v[0]
    rows = [(k, x) for k, x in enumerate(v.tolist())] + [(700, None), (750, [float("nan")] * 8), (751, [None] * 8), (800, [1.0, 2.0]), (801, [3.0, 1.0]), (850, []), (900, [1e200] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + rows[50:51]], "vec_id long, embedding array<double>, rank int, part int")
    got = {}
    for r in kdtopk.top_k(df.where("vec_id is null or vec_id != 900"), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = np.floor(v * 256).astype(np.int64)
    s = q @ q.T
    for i in range(0, 700, 50):
        want = sorted((-int(s[i, j]), j) for j in range(700) if j != i)[:5]
        assert sorted(got[i]) == [(k + 1, j, -t) for k, (t, j) in enumerate(want)]
    assert sorted(got[800]) == [(1, 801, 256 * 256 * 5)] and set(got) == {*range(0, 700, 50), 800}
    assert kdtopk.top_k(df.limit(0), F.col("vec_id") == 0).collect() == []


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e5])
def test_top_k_of_clusters_visits_few_shards(spark, monkeypatch, scale):
    """Exact in every width of integers; blocks of queries meet only shards whose boxes can beat their bounds."""
    monkeypatch.setattr(kdtopk, "SHARD", 64)
    monkeypatch.setattr(kdtopk, "BLOCK", 16)
    seen = {}
    write = kdtopk.scratch

    def watched(df, name):
        out = write(df, name)
        seen.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(kdtopk, "scratch", watched)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((24, 6))
    centres *= 10 / np.linalg.norm(centres, axis=1, keepdims=True)
    v = np.concatenate([c + rng.standard_normal((100, 6)) * 0.05 for c in centres]) * scale
    df = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>")
    got = {}
    for r in kdtopk.top_k(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = [[int(x) for x in np.floor(r * 256)] for r in v]
    for i in range(0, len(v), 100):
        want = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in range(len(v)) if j != i)[:5]
        assert sorted(got[i]) == [(k + 1, j, -t) for k, (t, j) in enumerate(want)]
    blocks, shards = seen["bounded"][0].count(), seen["shards"][0].count()
    assert shards >= 24 and sum(x.count() for x in seen["pairs"]) < 0.4 * blocks * shards


def test_top_k_refuses_what_longs_dont_hold(spark):
    for v in ([1e200, 1.0], [1e12, 1.0]):
        df = spark.createDataFrame([(k, v) for k in range(3)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception):
            kdtopk.top_k(df, F.col("vec_id") == 0).collect()


def test_rollup_is_idempotent(spark):
    path = scratch_path(spark, "test-rollup")
    changes = lambda rows: spark.createDataFrame(rows, "op string, source string, lang string, tokenizer string, old_tokens long, new_tokens long, documents int")
    r = rollup.Rollup(spark, path)
    assert r.totals().collect() == []
    first = changes([("insert", "a", "en", "t", None, 5, 0), ("insert", "a", "en", "t", None, 7, 0), ("insert", None, None, "t", None, None, 0), (None, "a", "en", "t", 1, 1, 0)])
    assert r.apply("1", first) and not r.apply("1", first)
    assert r.apply("2", changes([("revise", "a", "en", "t", 7, 9, 0), ("delete", "a", "en", "t", 5, None, 0), ("insert", "b", "de", "t", None, 1, 0)]))
    want = [("None", 1, 0), ("a", 1, 9), ("b", 1, 1)]
    read = lambda: sorted((str(x.source), x.documents, x.tokens) for x in r.totals().collect())
    assert read() == want
    r.compact()
    assert read() == want and not r.apply("1", first) and rollup.Rollup(spark, path).committed() != []
    assert r.apply("3", changes([]).limit(0)) and read() == want
    with pytest.raises(ValueError):
        r.apply("a/b", first)


def test_rollup_counts_once_wherever_a_compaction_stops(spark, monkeypatch):
    """compact() is stopped before each of its steps in the file system, begun anew and run again."""
    row = lambda n: spark.createDataFrame([("insert", "a", "en", "t", None, n)], "op string, source string, lang string, tokenizer string, old_tokens long, new_tokens long")

    class Stop(Exception):
        pass

    for stop in range(1, 9):
        path = scratch_path(spark, f"test-rollup-{stop}")
        r = rollup.Rollup(spark, path)
        total = 0
        for k in range(2):
            for j in range(2):
                assert r.apply(f"{k}{j}", row(10 * k + j + 1))
                total += 10 * k + j + 1
            left = [stop]

            class Files:
                def __init__(self, fs):
                    self.fs = fs

                def __getattr__(self, name):
                    def call(*a):
                        if name in ("rename", "delete", "create"):
                            left[0] -= 1
                            if left[0] < 0:
                                raise Stop
                        return getattr(self.fs, name)(*a)

                    return call

            broken = rollup.Rollup(spark, path)
            broken._fs = Files(broken._fs)
            try:
                broken.compact()
            except Stop:
                pass
            again = rollup.Rollup(spark, path)
            assert [(x.documents, x.tokens) for x in again.totals().collect()] == [(2 * k + 2, total)]
            again.compact()
            assert [(x.documents, x.tokens) for x in again.totals().collect()] == [(2 * k + 2, total)]
            assert not again.apply(f"{k}0", row(5)) and not again.compact()


def test_rollup_says_who_committed(spark):
    """Of two writers of one batch, and of two compactions, one is told that it committed."""
    path = scratch_path(spark, "test-rollup-two")
    a, b = rollup.Rollup(spark, path), rollup.Rollup(spark, path)
    delta = spark.createDataFrame([("a", "en", "t", 1, 5)], rollup.SCHEMA)
    for name in ("batch=1", "batch=2", "fold=000000000001"):
        folded = {"folders": ["batch=1", "batch=2"], "batches": ["1", "2"]} if "fold" in name else None
        x, y = a._prepare(delta, folded), b._prepare(delta, folded)
        seen: list = []
        assert a._commit(x, name)

        class Late:
            """A file system whose first answer is from before the other's rename."""

            def __init__(self, fs):
                self.fs = fs

            def exists(self, at):
                seen.append(at)
                return False if len(seen) == 1 else self.fs.exists(at)

            def __getattr__(self, n):
                return getattr(self.fs, n)

        late = rollup.Rollup(spark, path)
        late._fs = Late(late._fs)
        assert not late._commit(y, name)
    assert [(r.documents, r.tokens) for r in a.totals().collect()] == [(1, 5)]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], sf)
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        seen.append(spark.read.parquet(f"{tmp_path}/{len(seen)}"))
    assert all(x.columns == docs.columns for x in seen[:-1])
    n = [x.count() for x in seen]
    assert n[1] < n[0] and n[2] == n[1] and n[3] <= n[2] and n[5] == n[4]
    # what a stage keeps is what its brute-force version keeps
    from gridloom.llm import quality

    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    hand = lambda t: 1 / (1 + np.exp(-(model.intercept + sum(w for r, w in zip(model.rules, model.weights) if all((t[k] > x) == above for k, above, x in r.parts)))))
    assert sorted(r.doc_id for r in seen[1].collect()) == sorted(r.doc_id for r in docs.collect() if hand(quality.statistics(r.text)) >= 0.3)
    from test_pairs import expected
    from test_texts import line_oracle

    before = [(r.doc_id, r.text) for r in seen[1].collect()]
    assert sorted((r.doc_id, r.text) for r in seen[2].collect()) == line_oracle(before)
    before = [(r.doc_id, r.text) for r in seen[2].collect()]
    assert sorted(r.doc_id for r in seen[3].collect()) == [i for i, _, c in expected(before) if i == c]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(r.doc_id for r in seen[5].collect())


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows and ids, columns that clash with the operators' own, and an empty table."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    good = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    rows = [(k, t, "en", f"s{k % 3}") for k, t in enumerate(good)] + [(None, good[0], None, None), (None, None, "en", "s1"), (5, good[5], "en", "s2"), (5, good[7], "en", "s2"), (900, "", "en", "s0"), (901, "w " * 40_000, "en", "s0")]
    names = ["row", "marks", "times", "stats", "node", "h", "_s", "size", "spans", "id"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in names)
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *range(len(names))) for r in rows], schema)
    for df in (docs, docs.limit(0)):
        at, last = df, None
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, sf)
            path = f"{tmp_path}/{k}-{df is docs}"
            out.write.parquet(path)
            last = spark.read.schema(out.schema).parquet(path)
            if k < 4:
                assert out.columns == docs.columns and all(r[c] == i for r in last.collect() for i, c in enumerate(names))
                at = last
        assert (last.count() == at.count()) and (last.count() > 40) == (df is docs)


def test_pipeline_mixes_and_encodes_as_brute_force(spark):
    import collections
    import hashlib
    import math

    import corpus_pipeline
    import public_tokenizers
    import tiktoken
    from test_texts import mix_oracle

    from gridloom.llm import bpe

    stages = dict(corpus_pipeline.STAGES)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    size, total, target = mix_oracle(rows)
    at = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16)
    want, upto = collections.Counter(), collections.Counter()
    for (i, _, s), n in sorted(zip(rows, size), key=lambda x: at(x[0][0])):
        copies = math.floor(target[s] / total[s]) if total[s] else 0
        left = target[s] - copies * total[s] - upto[s]
        want[i] = 1 if not n else copies + (left >= 0 and 2 * left >= n)
        upto[s] += n
    out = stages["mixing sources to target weights"](spark, docs, sf)
    got = out.select("doc_id", "text").collect()
    assert collections.Counter(r.doc_id for r in got) == +want
    words = dict(zip((i for i, _, _ in rows), size))
    assert sum(words[r.doc_id] for r in got) == pytest.approx(1.5 * sum(size), rel=0.02)

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_path()), special_tokens={})
    ids = {i: enc.encode_ordinary(t or "") for i, t, _ in rows}
    coded = stages["byte-level BPE encoding and decoding"](spark, out, sf).collect()
    assert sorted((r.doc_id, r.ids) for r in coded) == sorted((r.doc_id, ids[r.doc_id]) for r in got)
