"""Operators on texts against brute force."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from gridloom.llm import bpe, langid, lines, mixing, quality, repeats

EDGES = [None, "", " ", "\n", "a\nb", "x" * 199, "x" * 200, "ab" * 300, "a" * 3000, "é" * 500, "abc" * 400 + "q" + "abc" * 300, "Z" * 201, "tail \n\n  two  blanks ", "it's 12 don't　x\x0b"]


def spans(texts, size=200):
    seen = collections.Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                hit[i : i + size] = b"\1" * size
        kept = bytes(c for c, h in zip(t, hit) if not h)
        out.append((len(t), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest()))
    return out


def repeated(df, **how):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeated_spans(df, **how).collect()), key=str)


def expected_spans(rows):
    return sorted(((r[0], *w) for r, w in zip(rows, spans([(r[1] or "").encode() for r in rows]))), key=str)


@pytest.mark.parametrize("bucket", [40_000, 4])
@pytest.mark.parametrize("how", [{}, {"broadcast_grams": 0}])
def test_repeats_equal_brute_force(spark, monkeypatch, how, bucket):
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 7)))
    shared = [" ".join(word() for _ in range(60)) for _ in range(4)]
    texts = EDGES + [" ".join(word() for _ in range(80)) + shared[k % 4][k % 50 :] + " ".join(word() for _ in range(40)) for k in range(40)] + [shared[0], shared[0]]
    # a common line of 150 bytes amid different text, some of it alike on one side
    line = (" ".join(word() for _ in range(60)))[:150]
    texts += [(shared[k % 3][:40] if k % 2 else "") + word() + line + word() + (shared[k % 4][:60] if k % 5 else word()) for k in range(60)]
    rows = [(k, t, 1, 2) for k, t in enumerate(texts)] + [(3, texts[3], 1, 2), (None, texts[-1], 1, 2), (None, texts[-1], 1, 2), (None, None, 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int, k1 int")
    assert repeated(df, **how) == expected_spans(rows)
    assert repeats.repeated_spans(df.limit(0), **how).collect() == []


def test_repeats_in_rows_of_several_pieces(spark):
    """Rows over 4 MB are cut into pieces: passages across the cuts, twice in one row and in another row."""
    rng = random.Random(12)
    noise = lambda n: rng.randbytes(n // 2).hex()
    passage, own = noise(900), noise(400)
    cut = 4 << 20
    long = noise(cut - 500) + passage + noise(700_000) + own + noise(30_000) + own + noise(100)
    rows = [(1, long), (2, noise(300) + passage + noise(200)), (3, noise(250))]
    got = {r.doc_id: r for r in repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        want = []
        for x in (passage, own):
            at = t.find(x)
            while at >= 0:
                want.append([at, at + len(x)])
                at = t.find(x, at + 1)
        want.sort()
        # a byte beside a passage may happen to repeat too
        assert len(got[i].spans) == len(want) and all(abs(a - c) <= 8 and abs(b - e) <= 8 and a <= c and b >= e for (a, b), (c, e) in zip(got[i].spans, want))
        assert got[i].n_bytes == len(t) and got[i].n_removed == sum(b - a for a, b in got[i].spans)


def test_multikey_quicksort_sorts():
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (3000, 24)).astype(np.uint8)
    x[::3] = x[1]
    assert [r.tobytes() for r in x[repeats.multikey_quicksort(x)]] == sorted(r.tobytes() for r in x)
    assert len(repeats.multikey_quicksort(x[:0])) == 0


def test_bpe_equals_tiktoken(spark):
    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks(bpe.default_path())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert bpe.default_pattern() == public_tokenizers.PATTERN
    texts = [*EDGES, "<|endoftext|> x", "Ungkeit  und\t\tder. 'sie' 漢字 🙂🙂", "a" * 20000, "́" * 300, " lead", "trail ", "x\n y", "١٢٣ ²½"]
    df = spark.createDataFrame([(k, t, "a") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    for r in bpe.encode_documents(df).collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.encode_documents(df.limit(0)).collect() == []


def test_merges_of_long_pre_tokens_equal_tiktoken():
    """Pre-tokens of many thousand bytes, with a vocabulary of few letters, so that ranks tie and merges go stale."""
    import tiktoken

    rng = random.Random(6)
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < 700:
        a, b = rng.choice([t for t in ranks if t < b"e" and t >= b"a"]), rng.choice([t for t in ranks if t < b"e" and t >= b"a"])
        ranks.setdefault(a + b, len(ranks))
    enc = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    merges = bpe.Merges(ranks)
    for n in [*range(1, 40), 500, 20_000]:
        for letters in ("ab", "abcd", "a"):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert merges.ids(text.encode()) == enc.encode_ordinary(text)


def test_many_pre_tokens_in_one_queue_equal_tiktoken():
    """Few letters and ranks in any order, so that merges overlap, go stale and lead to lower ranks, in large and in small buckets."""
    import tiktoken

    rng = random.Random(7)
    for shuffled in (False, True):
        tokens = [bytes([b]) for b in range(256)]
        while len(tokens) < 600:
            token = rng.choice(tokens[97:101] + tokens[256:]) + rng.choice(tokens[97:101] + tokens[256:])
            if token not in tokens and len(token) < 10:
                tokens.append(token)
        if shuffled:
            rng.shuffle(tokens)
        ranks = {t: r for r, t in enumerate(tokens)}
        enc = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        merges = bpe.Merges(ranks)
        for n in (0, 1, 30, 3000):
            pieces = ["".join(rng.choice(rng.choice(["a", "ab", "abcde", "z"])) for _ in range(rng.randrange(1, 90))) for _ in range(n)]
            ids, counts = merges.many([p.encode() for p in pieces])
            want = [enc.encode_ordinary(p) for p in pieces]
            assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == [len(x) for x in want]


def test_many_pre_tokens_cost_less_together():
    """New pre-tokens are most of the operator's cost."""
    import time

    rng = random.Random(8)
    merges = bpe.Merges(bpe.load_ranks(bpe.default_path()))
    pieces = [("".join(rng.choice(["tion", "der", "sch", "la", "ous", "em", "re", "al"]) for _ in range(4)) + str(k)).encode() for k in range(20_000)]
    began = time.process_time()
    ids, _ = merges.many(pieces)
    together = time.process_time() - began
    assert ids.tolist() == [x for p in pieces for x in merges.ids(p)]
    assert together < 0.7 * (time.process_time() - began - together)


def test_bpe_memory_of_few_pre_tokens_equals_tiktoken(monkeypatch):
    """Generations turn again and again; pre-tokens come back from the old one, or are too long to stay."""
    import public_tokenizers
    import tiktoken

    monkeypatch.setattr(bpe._Memory, "MOST", 40)
    monkeypatch.setattr(bpe._Memory, "LONGEST", 8)
    rng = random.Random(9)
    ranks = bpe.load_ranks(bpe.default_path())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, bpe.default_pattern())
    words = ["".join(rng.choice("aeiouäß漢🙂") for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    for _ in range(60):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(6))]
        ids, ends = codec.encode(texts)
        want = [enc.encode_ordinary(t) for t in texts]
        assert [ids[i:j].tolist() for i, j in zip(ends, ends[1:])] == want
        assert [bytes(x).decode() for x in codec.decode(ids, ends)] == texts
        assert [bytes(x).decode() for x in codec.listed(ids, ends)] == [",".join(map(str, x)) for x in want]
        assert len(codec.words.young.number) < 150 and max(map(len, codec.words.young.number), default=0) <= 8
        rng.random() < 0.1 and codec.words.forget()


def test_bpe_worker_needs_little_memory_beside_its_vocabulary():
    """Large batches, many new pre-tokens: an executor's heap leaves little for its Python workers."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    with open(bpe.default_path(), "rb") as f:
        shared = SimpleNamespace(value=f.read())
    rng = random.Random(10)
    common = ["".join(rng.choice("aeioustrnl") for _ in range(6)) for _ in range(500)]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.85 else f"{rng.choice(common)}{rng.choice(common)}" for _ in range(1400)) for _ in range(400)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(400), pa.int64()), "text": texts})
    assert batch.nbytes > 4e6
    go = bpe._encode("memory", shared, bpe.default_pattern(), "doc_id", True)
    before = len(list(go([batch.slice(0, 0)])))  # makes the vocabulary
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in go([batch, batch]))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        bpe._codecs.pop(("memory", bpe.default_pattern()))
    assert (before, rows) == (0, 800)
    assert most < 56e6, most


def test_bpe_of_null_and_repeated_ids_and_two_files_of_one_name(spark, tmp_path):
    import base64

    import public_tokenizers
    import tiktoken

    df = spark.createDataFrame([(None, "aab aab"), (None, None), (5, "aab aab"), (5, "aab aab"), (5, "other")], "doc_id long, text string")
    for k, extra in enumerate([{}, {b"aa": 256, b"aab": 257}]):
        ranks = {bytes([b]): b for b in range(256)} | extra
        path = tmp_path / str(k) / "own.tiktoken"
        path.parent.mkdir()
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pattern in (None, r"\S+|\s+"):
            if pattern:
                enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            got = bpe.encode_documents(df, path=str(path), pattern=pattern).collect()
            want = [(r.doc_id, enc.encode_ordinary(r.text or "")) for r in df.collect()]
            assert sorted(((r.doc_id, r.ids) for r in got), key=str) == sorted(want, key=str)


def line_chunks(lines):
    """(first, number) of chunks, a line at a time."""
    h = [int(hashlib.md5(x.encode()).hexdigest()[:15], 16) % 1_000_003 for x in lines]
    r = [(31 * (h[k - 1] if k else 0) + h[k]) % 1_000_003 for k in range(len(h))]
    out, at = [], 0
    for k in range(len(lines)):
        low = 0 < k < len(lines) - 1 and r[k - 1] > r[k] and r[k + 1] >= r[k]
        if low or k == len(lines) - 1:
            while k + 1 - at > 16:
                out.append((at, 16))
                at += 16
            out.append((at, k + 1 - at))
            at = k + 1
    return out


def line_oracle(rows):
    """Whole texts in the order of ids; rows are taken as they come where ids are equal."""
    split = {i: t.split("\n") for i, t in rows if t is not None}
    first, gone = {}, collections.defaultdict(dict)
    for i in sorted(split):
        for a, n in line_chunks(split[i]):
            body = tuple(split[i][a : a + n])
            if n > 1 and first.setdefault(body, (i, a)) != (i, a):
                gone[i][a] = (n, *first[body])
    out = []
    for i, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out.append((i, None))
            continue
        x, drop, parts = split[i], set(), line_chunks(split[i])
        for j, (a, n) in enumerate(parts):
            if a not in gone[i]:
                continue
            drop.update(range(a, a + n))
            _, i0, a0 = gone[i][a]
            y = split[i0]
            if j and parts[j - 1][0] not in gone[i]:
                for k in range(1, parts[j - 1][1] + 1):
                    if a0 - k < 0 or y[a0 - k] != x[a - k]:
                        break
                    drop.add(a - k)
            if j + 1 < len(parts) and parts[j + 1][0] not in gone[i]:
                for k in range(parts[j + 1][1]):
                    if a0 + n + k >= len(y) or y[a0 + n + k] != x[a + n + k]:
                        break
                    drop.add(a + n + k)
        out.append((i, "\n".join(v for k, v in enumerate(x) if k not in drop)))
    return out


def test_line_dedup(spark):
    rng = random.Random(2)
    pool = [f"line {k} of some text" for k in range(30)]
    rows = list(enumerate([*EDGES, "same\n" * 1000, "\n".join(pool) + "\nsame" * 40, *("\n".join(pool[s : s + rng.randint(2, 25)]) for s in (rng.randrange(20) for _ in range(40)))]))
    df = spark.createDataFrame([(t, i, 1, "m") for i, t in rows], "text string, doc_id long, row int, marks string")
    got = lines.dedup_lines(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == line_oracle(rows)
    twice = lines.dedup_lines(df.union(df)).collect()
    assert sorted(((r.doc_id, r.text) for r in twice), key=str) == sorted([*line_oracle(rows)] * 2, key=str)
    assert lines.dedup_lines(df.limit(0)).collect() == []
    none = spark.createDataFrame([(None, t) for t in ["a\nb\nc\nd", "x\ny", None]] + [(1, "a\nb\nc\nd"), (2, "x\ny")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in lines.dedup_lines(none).collect()), key=str)
    assert [r for r in got if r[0] is None] == sorted([(None, "a\nb\nc\nd"), (None, "x\ny"), (None, None)], key=str) and (2, "") in got


@pytest.mark.parametrize("n,share", [(8, 0.5), (12, 0.8), (20, 0.95), (50, 0.99)])
def test_line_dedup_removes_planted_passages(spark, n, share):
    """Passages of n lines that two documents share amid lines of their own: the second loses most, and nothing else."""
    rng = random.Random(n)
    line = lambda: " ".join(str(rng.randrange(1000)) for _ in range(12))
    rows, own = [], {}
    for k in range(200):
        passage = [line() for _ in range(n)]
        for side in range(2):
            a, z = [line() for _ in range(rng.randint(1, 9))], [line() for _ in range(rng.randint(1, 9))]
            rows.append((2 * k + side, "\n".join(a + passage + z)))
            own[2 * k + side] = a + z
    got = {r.doc_id: (r.text or "").split("\n") for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = 0
    for i, t in rows:
        left = collections.Counter(got[i])
        assert not collections.Counter(own[i]) - left and (i % 2 or "\n".join(got[i]) == t)
        gone += len(t.split("\n")) - len(got[i])
    assert gone >= share * 200 * n


def mix_oracle(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = collections.Counter()
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    names = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, live, budget = {}, set(names), 1.5 * sum(size)
    while live:
        share = {s: budget * weight[s] / sum(weight[x] for x in live) for s in live}
        over = {s for s in live if share[s] > 2 * total[s]}
        if not over:
            return size, total, target | share
        for s in over:
            target[s] = 2.0 * total[s]
            budget -= target[s]
        live -= over
    return size, total, target


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_mixing(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "BROADCAST", few)
    rng = random.Random(4)
    rows = [(k, " ".join("w" for _ in range(rng.randint(0, 30))), rng.choice(["a", "a", "a", "B", "é", None, "z"])) for k in range(600)] + [(600, None, "a"), (601, "", "empty"), (602, "one", "one"), (None, "a b", "B")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, source string, size int, times string")
    size, total, target = mix_oracle(rows)
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    assert len(got) == len(rows)
    taken = collections.Counter()
    for (i, _, s), n in zip(rows, size):
        r = got[i]
        assert (r.size, r.source_size) == (n, total[s]) and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * n
        taken[s] += r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= 16
    assert sorted(mixing.mix(df).collect(), key=str) == sorted(got.values(), key=str)
    out = collections.Counter(r.doc_id for r in mixing.apply_mix(df).collect())
    assert all(out[i] == (1 if not n else got[i].taken // n) for (i, _, _), n in zip(rows, size))
    assert mixing.mix(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [3, 6, 20])
def test_mixing_many_sources_under_their_caps(spark, n):
    rows = [(k, "w " * 10, f"s{k % n:02}") for k in range(10 * n)]
    _, total, target = mix_oracle(rows)
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    have = {rows[r.doc_id][2]: r.target for r in got}
    assert have == pytest.approx(target) and sum(have.values()) == pytest.approx(1.5 * sum(total.values()))
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[rows[r.doc_id][2]] += r.taken
    assert all(abs(taken[s] - t) <= 5 for s, t in target.items())


def test_mixture_takes_an_id_by_its_source(spark):
    rows = [(k // 2, "w " * 10, "ab"[k % 2], 5) for k in range(200)] + [(7, "w " * 10, "a", 5), (900, "", "a", 5), (901, None, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, times int")
    planned = mixing.mix(df).collect()
    taken = collections.Counter((r.doc_id, r.target) for r in planned for _ in range(r.taken // 10 if r.size else 1))
    _, _, target = mix_oracle([(i, t, s) for i, t, s, _ in rows])
    assert target["a"] != target["b"] and {r.target for r in planned} == set(target.values())
    out = mixing.apply_mix(df)
    assert collections.Counter((r.doc_id, target[r.source]) for r in out.collect()) == taken
    assert out.columns == df.columns and mixing.apply_mix(df.limit(0)).collect() == []


def test_quality_learns_and_survives_edges(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    good = lambda: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(rng.randint(2, 9))) + "."
    bad = lambda: rng.choice([" ".join(word().upper() + "!!" for _ in range(40)), " ".join([word()] * 60), " | ".join(word() for _ in range(50))])
    truth = {k: int(rng.random() < 0.8) for k in range(900)}
    rows = [(k, good() if y else bad(), "x", 1) for k, y in truth.items()] + [(2000 + k, t, None, None) for k, t in enumerate(EDGES)] + [(None, "x", "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, stats string, score int")
    labels = spark.createDataFrame([(k, y) for k, y in truth.items()] + [(None, 1), (3, None), (2000, 7)], "doc_id long, quality int")
    got = quality.classify(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    import zlib

    assert {r.doc_id for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert quality.keep_good(df, labels).columns == df.columns
    assert quality.classify(df.limit(0), labels).collect() == []
    assert {r.score for r in quality.classify(df, labels.limit(0)).collect()} == {0.5}


def test_quality_scores_equal_rules_by_hand(spark):
    """Every score against statistics and rules evaluated a text at a time; the fit uses the labelled texts alone."""
    import math

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = [(k, " ".join(word().upper() if k % 3 else word() for _ in range(rng.randint(1, 60))) + "." * (k % 4)) for k in range(400)] + [(9, "a repeated id"), (None, "x")]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(0, 300)], "doc_id long, quality int")
    model = quality.train(df, labels)
    assert model.rules

    def score(text):
        x, z = quality.statistics(text), model.intercept
        for rule, w in zip(model.rules, model.weights):
            z += w * all((x[k] > t) if above else (x[k] <= t) for k, above, t in rule.parts)
        return 1 / (1 + math.exp(-z))

    want = sorted(((i, round(score(t), 9)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, round(r.score, 9)) for r in quality.classify(df, labels).collect()), key=str) == want
    held = {zlib.crc32(str(i).encode()) % 5 == 0: 1 for i, _ in rows if i is not None}
    x = [(i, t) for i, t in rows if i is not None and i < 300 and zlib.crc32(str(i).encode()) % 5]
    import numpy as np

    again = quality.fit(np.array([quality.statistics(t) for _, t in sorted(x)]), np.array([float(i % 3 > 0) for i, _ in sorted(x)]))
    assert len(held) == 2 and np.allclose(sorted(again.weights), sorted(model.weights), atol=1e-3)


def test_compiled_rules_equal_numpy(spark):
    import numpy as np

    x = np.array([quality.statistics(t) for t in EDGES] * 20)
    y = (x[:, 0] > 3).astype(float)
    model = quality.fit(x, y)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "k long, stats array<double>")
    got = [r.s for r in df.select("k", model.score(df.stats).alias("s")).orderBy("k").collect()]
    assert np.allclose(got, model.score_numpy(x))


def test_language_id(spark):
    rng = random.Random(6)
    parts = {"aa": ["ba", "lo", "ki"], "bb": ["sch", "ung", "ei"], "cc": ["tion", "eau", "qu"]}
    text = lambda x: " ".join("".join(rng.choice(parts[x]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(4, 40)))
    truth = {k: rng.choice(list(parts)) for k in range(600)}
    rows = [(k, text(x), x) for k, x in truth.items()] + [(1000, None, "aa"), (1001, "12 ²½ !", "aa"), (1002, "", None), (1003, "baloki", None), (None, "ungei", None)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, lang string, kind string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id in truth]
    assert len(got) == len(rows) and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "aa"
    assert langid.identify(df.limit(0)).collect() == []


def test_language_id_learns_more_than_a_thousand_languages(spark):
    word = lambda k: "".join("abcdefghijk"[k // 11**p % 11] for p in range(3))
    n = 1050
    rows = [(10 * k + i, word(k), f"l{k:04}") for k in range(n) for i in range(4)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    trained = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(trained) > 1000 and model.langs == sorted(trained)
    assert all(model.predict(word(int(x[1:])))[0] == x for x in (min(trained), max(trained)))


def test_language_id_equals_brute_force(spark, monkeypatch):
    """Every prediction and score against a plain model over all training texts; few and many languages alike."""
    import math

    rng = random.Random(16)
    parts = {"aa": ["ba", "lo", "ki"], "bb": ["sch", "ung", "ei"], "cc": ["ba", "eau", "ung"]}
    text = lambda x: " ".join("".join(rng.choice(parts[x]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(2, 9)))
    rows = [(k, text(x), x) for k in range(90) for x in [rng.choice(list(parts))]] + [(200, "balo Unseenword 5 ²", None), (201, None, "aa"), (202, "!", "bb"), (None, text("cc"), "cc")]
    rows += [rows[0], rows[0]]
    find = re.compile(r"[^\W\d_]+").findall
    trained = {r for r in rows if r[1] is not None and r[2] is not None and not (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2)}
    langs = sorted({r[2] for r in trained})
    words = {x: collections.Counter(w for _, t, y in trained if y == x for w in find(t.lower())) for x in langs}
    cut = lambda w, n: [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)]
    tables = [words] + [{x: collections.Counter(g for w, m in words[x].items() for g in cut(w, n) for _ in range(m)) for x in langs} for n in (5, 4, 3, 2, 1)]

    def number(table, key):
        keys = set().union(*table.values())
        if key not in keys:
            return None
        v = [math.log((table[x][key] + 0.5) / (sum(table[x].values()) + 0.5 * len(keys))) for x in langs]
        return [min(6, max(-6, a - sum(v) / len(v))) for a in v]

    def score(w):
        if got := number(tables[0], w):
            return got
        for n, table in zip((5, 4, 3, 2, 1), tables[1:]):
            hit = [x for x in (number(table, g) for g in cut(w, n)) if x]
            if hit:
                return [sum(x) / len(hit) for x in zip(*hit)]
        return [0.0] * len(langs)

    def predict(t):
        found = find((t or "").lower())
        if not any(c.isalpha() for w in found for c in w):
            return "und", 0.0
        z = [sum(x) / len(found) * min(len(found), 50) for x in zip(*map(score, found))]
        e = [math.exp(a - max(z)) for a in z]
        return langs[z.index(max(z))], round(max(e) / sum(e), 6)

    want = sorted(((i, *predict(t)) for i, t, _ in rows), key=str)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for dense in (32, 1):
        monkeypatch.setattr(langid, "DENSE", dense)
        assert sorted(((r.doc_id, r.lang_pred, round(r.score, 6)) for r in langid.identify(df).collect()), key=str) == want


def test_language_id_draws_as_many_texts_as_it_says(spark):
    rows = [(k, f"text {k}", "a" if k % 3 else "b") for k in range(3000)] + [(1, "text 1", "a")] * 1500 + [(k, "short", "c") for k in range(5)]
    got = collections.Counter(r.lang for r in langid.drawn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 100).collect())
    assert got == {"a": 100, "b": 100, "c": sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(5))}
