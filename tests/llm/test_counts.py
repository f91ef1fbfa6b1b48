"""Operators 1, 3, 6, 7 and 10 against brute force."""

from __future__ import annotations

import hashlib
import os
import resource
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm._shared import Scratch
from riskloom.llm import _arrays, _repeated, jaccard, mixing, ngrams, queries, secrets, suffixes
from tests.llm import brute


def key(r):
    return tuple((x is None, str(x)) for x in r)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney(corpus, rows, order):
    got = ngrams.train_and_score(corpus, order=order).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    want = brute.kneser_ney(rows, order)
    same([r[:5] for r in got], [r[:5] for r in want])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney_in_many_shards(corpus, order, monkeypatch):
    model = ngrams.train(corpus, order=order, shard_bytes=40_000)
    assert model.shards > 5
    got = {(r.doc_id, r.n_tokens): r.score for r in ngrams.score(corpus, model).collect()}
    one = ngrams.train(corpus, order=order)
    for r in ngrams.score(corpus, one).collect():
        assert got[r.doc_id, r.n_tokens] == pytest.approx(r.score, rel=1e-9)


def test_many_shards_with_few_files_open(corpus, monkeypatch):
    """Some 1,300 arrays of 110 shards under a limit of 100 more descriptors than there are now."""
    model = ngrams.train(corpus.limit(60), shard_bytes=1_000)
    assert model.shards > 100
    texts = [r.text or "" for r in corpus.limit(60).select("text").collect()]
    data, offsets = ngrams.texts_of(pa.array(texts))

    def scores():
        scorer = ngrams.Scorer(model)
        tokens = ngrams._tokens(scorer.vocabulary, data, offsets)
        return scorer.log10(tokens.context, tokens.word).sum(), len(scorer.files.open)

    want, mapped = scores()
    now, limits = len(os.listdir("/proc/self/fd")), resource.getrlimit(resource.RLIMIT_NOFILE)
    monkeypatch.setattr(ngrams, "OPEN_ARRAYS", 60)
    resource.setrlimit(resource.RLIMIT_NOFILE, (now + 100, limits[1]))
    try:
        got, few = scores()
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, limits)
    assert got == want and few == 60 < mapped <= 256


def test_probabilities_sum_to_one(spark, tmp_path):
    """Over the vocabulary, the end and one unknown word, after any context."""
    import numpy as np

    docs = spark.createDataFrame([(" ".join(w),) for w in ("a b a c a b", "b b c", "c a b a", "d a")], "text string")
    for order in (2, 3):
        scorer = ngrams.Scorer(ngrams.train(docs, order=order))
        m = scorer.model
        word = np.arange(m.size + 2, dtype=np.uint64)
        word = word[word != m.size]  # the begin mark is never predicted
        for u in range(m.size + 2):
            for v in range(m.size + 2):
                context = np.full(len(word), v if order == 2 else u << 32 | v, np.uint64)
                assert (10 ** scorer.log10(context, word)).sum() == pytest.approx(1)


def test_kneser_ney_beats_single_tokens_and_pairs(corpus):
    held = [[r for r in ngrams.train_and_score(corpus, order=k).collect() if r.held_out] for k in (2, 3)]
    two, three = (sum(r.score for r in x) for x in held)
    assert three > two > sum(r.base_score for r in held[0])


def test_mixture(corpus):
    got = mixing.taken_words(corpus, block_words=32, shard_blocks=64, bucket_blocks=100).collect()
    docs = corpus.select("doc_id", "text", "source").collect()
    sizes: dict = defaultdict(int)
    for r in docs:
        sizes[r.source] += len(brute.WORD.findall(r.text or ""))
    target = brute.mix_targets(sizes)
    same([(r.doc_id, r["size"]) for r in got], [(r.doc_id, len(brute.WORD.findall(r.text or ""))) for r in docs])
    source = {r.doc_id: r.source for r in docs}
    taken: dict = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(target[source[r.doc_id]], rel=1e-9)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
    for s, want in target.items():
        assert abs(taken[s] - want) <= 0.5 + 1e-6
    again = mixing.taken_words(corpus.repartition(3), block_words=32, shard_blocks=64, bucket_blocks=100).collect()
    same([(r.doc_id, r.taken) for r in again], [(r.doc_id, r.taken) for r in got])


def test_mixture_as_documents(corpus):
    options = {"block_words": 32, "shard_blocks": 64, "bucket_blocks": 100}
    want = Counter()
    for r in mixing.taken_words(corpus, **options).collect():
        want[r.doc_id] += r.taken
    got, bare = Counter(), Counter()
    texts = defaultdict(set)
    for r in corpus.select("doc_id", "text").collect():
        texts[r.doc_id] |= set((r.text or "").split())
    for r in mixing.materialise(corpus, **options).select("doc_id", "text", "source").collect():
        got[r.doc_id] += len(brute.WORD.findall(r.text or ""))
        bare[r.doc_id] += not brute.WORD.search(r.text or "")
        assert set((r.text or "").split()) <= texts[r.doc_id]
    assert +got == +want
    assert +bare == Counter(r.doc_id for r in corpus.select("doc_id", "text").collect() if not brute.WORD.search(r.text or ""))


def test_split_is_exact_and_even(spark):
    quotas = spark.sql("SELECT array(1000L, 10L, 0L, 499990L) AS quota")
    with Scratch(spark) as scratch:
        leaves = [r.taken for r in mixing.splitting_tree(quotas, 16, 3, scratch).collect()]
    assert len(leaves) == 16 and [sum(x) for x in zip(*leaves, strict=True)] == [1000, 10, 0, 499990]
    assert max(map(sum, leaves)) - min(map(sum, leaves)) <= 4
    assert max(x[0] for x in leaves) < 110


def test_hypergeometric_follows_its_law(spark):
    from math import comb

    from pyspark.sql import functions as F

    n = 20_000
    u = (F.col("id") + 0.5) / n
    seen = spark.range(n).select(mixing.hypergeometric(u, F.lit(7), F.lit(20), F.lit(9)).alias("k")).groupBy("k").count().collect()
    for r in seen:
        assert r["count"] / n == pytest.approx(comb(7, r.k) * comb(13, 9 - r.k) / comb(20, 9), abs=2e-4)


def links(docs, **options):
    return jaccard.link_components(docs, **options).select("doc_id", "n_shingles", "component_id").collect()


def test_links(corpus, rows):
    same(links(corpus), brute.link_components(rows))


def test_links_of_near_copies(spark):
    """Chains and groups of near copies of frequent words, some just at the threshold."""
    import random

    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"v{rng.randrange(30)}" for _ in range(rng.choice([6, 9, 20, 60, 200]))]
        for k in range(14):
            own = list(base)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(30)}"
            rows.append((g * 100 + k, " ".join(own[: len(own) - rng.randrange(0, 3)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(links(docs), brute.link_components(rows))
    for options in ({"pivots": 0}, {"pivots": 0, "frequent": 2}, {"frequent": 2, "shard_bytes": 3_000, "chunk_keys": 500}):
        same(links(docs, **options), brute.link_components(rows))


def test_links_with_frequent_shingles(spark):
    """Every shared shingle counts as frequent: only token combinations find the pairs."""
    import numpy as np

    rows = [(k, " ".join(f"u{(k // 4) * 1000 + j if j != k % 4 else 5000 + k}" for j in range(40))) for k in range(40)]
    sets = [next(iter(jaccard.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])))) for _, t in rows]
    often = Counter(x for s in sets for x in s.tolist())
    found = []
    for s in sets:
        s = sorted((x for x in s.tolist() if often[x] > 1), key=lambda x: (often[x], x))
        sig, high = jaccard.signatures(np.array(s, np.uint64), np.array([often[x] for x in s]), 36, 36 - len(s), frequent=1)
        assert (high <= 48).all()
        found.append(set(sig[high >= 36].tolist()))
    for a in range(40):
        for b in range(a):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                assert found[a] & found[b]


def test_keep_one(corpus, rows):
    kept = sorted((r.doc_id or -1) for r in jaccard.keep_one(corpus).select("doc_id").collect())
    linked = {(i, t, n) if n else (i, t, n, k) for k, ((i, t), (_, n, c)) in enumerate(zip(rows, brute.link_components(rows), strict=True)) if i == c or n == 0}
    want = sorted((x[0] or -1) for x in linked)
    assert kept == want


def test_secrets(corpus, rows):
    found = secrets.find_secrets(corpus.select("doc_id", "text"))
    got = []
    for r in found.collect():
        base = [(s.kind, s.start, s.end) for s in r.secrets if s.kind in ("assign", "access", "hex")]
        got.append((r.doc_id, r.text, base))
    same(got, [(i, t, brute.base_secrets(t)) for i, t in rows])


def test_secret_digests(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op7_secret_scan(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        base = brute.base_secrets(r.text)
        kinds = Counter(k for k, _, _ in base)
        own = got[r.doc_id]
        assert (own.n_assign, own.n_access, own.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert own.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()


def test_secret_texts_by_chance(spark):
    """Random texts over the rules' own letters: spans as the regular expressions give them."""
    import random

    rng = random.Random(11)
    parts = ["password", "Token", "API_key", "apikey", "SECRET", "AKIA", "AKI", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", '"', "'", " ", "  ", ":", "=", "é", "x", "\n", "abcdefgh", "-_.", "passwd"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for k in range(400)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.secrets if s.kind in ("assign", "access", "hex")] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i] == brute.base_secrets(t), t


def test_added_rules_and_redaction(spark):
    text = "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1B2" * 10 + " xoxb-12345678901-abc token=abcdefghij é end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = secrets.find_secrets(docs, redact=True).first()
    assert [s.kind for s in row.secrets] == ["private_key", "hosting", "chat", "assign"]
    assert row.text == "[private_key] [hosting] [chat] [assign] é end"


def test_repeats(corpus, rows):
    same(suffixes.remove_repeats(corpus).collect(), brute.remove_repeats(rows))


def test_repeats_by_both_ways(spark):
    """Shared passages, runs of one byte, periods and overlaps; groups settled by sorting and window by window."""
    import random

    rng = random.Random(3)
    shared = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (100, 101, 130, 400)]
    rows = []
    for k in range(60):
        parts = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(80))) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(shared))
        parts.insert(rng.randrange(5), rng.choice(["z" * rng.randrange(90, 300), "xyz" * rng.randrange(30, 90), ""]))
        rows.append((k, "".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute.remove_repeats(rows)
    same(suffixes.remove_repeats(docs).collect(), want)
    same(suffixes.remove_repeats(docs, hot=3).collect(), want)


def test_repeats_of_repeated_rows(spark):
    """Three equal rows under two ids: the first keeps everything, whatever number of them there is."""
    text = "".join(chr(97 + int(c, 16)) for c in hashlib.sha512(b"a").hexdigest() + hashlib.sha512(b"b").hexdigest())[:216]
    rows = [(10, text), (10, text), (11, text), (12, "x" + text[50:] + "y"), (12, "x" + text[50:] + "y")]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == sorted((i, n) for i, n in ((10, 0), (10, 0), (11, 216), (12, 166), (12, 166)))
    same(got, brute.remove_repeats(rows))


def test_repeats_move_no_texts(spark):
    """What is shuffled and spilled to disk is less than the texts: anchors and their contexts go over the network, texts don't."""
    import random

    rng = random.Random(5)
    shared = ["".join(chr(rng.randrange(33, 127)) for _ in range(150)) for _ in range(3)]
    rows = [(k, "".join(chr(rng.randrange(33, 127)) for _ in range(6000)) + shared[k % 3]) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    docs.count()

    def moved() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()

    before = moved()
    got = suffixes.remove_repeats(docs, hot=20).collect()
    assert sum(r.n_removed for r in got) >= 297 * 150
    assert moved() - before < sum(len(t) for _, t in rows)


def test_repeats_of_repeated_rows_in_large_groups(spark):
    """Rows that are equal in id and text count as one in groups that are split, too."""
    text = "".join(chr(97 + int(c, 16)) for c in hashlib.sha512(b"a").hexdigest() + hashlib.sha512(b"b").hexdigest())
    rows = [(k // 3, f"{k // 3:03d}" + text[: 120 + k // 3]) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for hot in (1, 4, 1000):
        same(suffixes.remove_repeats(docs, hot=hot).collect(), brute.remove_repeats(rows))


def test_anchors_fall_evenly_to_shards(monkeypatch):
    """An anchor has the smallest hash of its window; no shard gets much more than its share of them, though."""
    import random

    import numpy as np

    rng, taken = random.Random(9), []
    monkeypatch.setattr(suffixes, "with_repeats", lambda rows, extract, *rest, **sizes: taken.append(extract))
    suffixes._repeated_anchors(None, 100, 40)
    texts = ["".join(chr(rng.randrange(33, 127)) for _ in range(20_000)) for _ in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(range(20)), pa.array(texts)], names=["_id", "_hash", "text"])
    keys = np.sort(np.concatenate([x[0] for x in taken[0](batch)]))
    share = np.diff(_arrays.ranges(keys, 16)) / len(keys)
    assert len(keys) > 10_000 and 0.05 < share.min() and share.max() < 0.08


@pytest.mark.parametrize("shards", [1, 13, 52, 64])
def test_chunks_pass_by_all_shards(shards):
    """The rows of chunks, which go past the shards, are dealt evenly to them, also where their number is a power of two."""
    of = Counter(_repeated._way((partition << 32) + k, shards) for partition in range(shards * 4) for k in range(2))
    assert len(of) == shards and set(of.values()) == {8}


def test_lists_by_key(spark, tmp_path):
    """Lists come back by key in their order, with keys that share a hash, keys without a list, and shards without one."""
    import numpy as np
    import pyarrow as pa

    from riskloom.llm import _lists

    values = spark.range(2000).selectExpr("id % 300 as _id", "id % 7 as _hash", "id as v").groupBy("_id", "_hash").agg(F.sort_array(F.collect_list(F.struct("v"))).alias("l"))
    lists = _lists.write_lists(values, "l", 2000, f"file://{tmp_path}/lists", shard_values=9)
    want = {(r._id, r._hash): [x.v for x in r.l] for r in values.collect()}
    asked = spark.createDataFrame([*want, (5000, 1), (-1, -1)], "_id long, _hash long").select("*", _lists.place_of())
    batch = asked.toArrow().combine_chunks().to_batches()[0]
    row, (v,) = lists.of(batch)
    keys = list(zip(*(batch.column(c).to_pylist() for c in ("_id", "_hash")), strict=True))
    got = {k: v[row == i].tolist() for i, k in enumerate(keys)}
    assert got == want | {(5000, 1): [], (-1, -1): []}
    hashes = np.array([1, 4, 4, 4, 9])
    stored = [hashes, np.arange(5), np.arange(5)]
    assert _lists._find(stored, [np.array([4, 4, 9, 4, 10, 0]), np.array([3, 1, 4, 7, 4, 0]), np.array([3, 1, 4, 3, 4, 0])]).tolist() == [3, 1, 4, -1, -1, -1]
    assert lists.of(pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["_at", "_id", "_hash"]))[0].tolist() == []


def test_secret_matching_is_linear():
    """Runs that begin many matches and end none: a megabyte takes seconds, not hours."""
    import time

    scan = secrets.scanner()
    token = b"eyJabc.eyJabc." + b"s" * 30
    begun = time.time()
    found = secrets.spans_of(scan, b"eyJ" * 350_000 + b" " + token + b" " + b"AKIA" * 1000, 127)
    assert time.time() - begun < 20
    assert ("web_token", 1_050_001, 1_050_001 + len(token)) in found


def test_empty_tables(empty):
    for result in (ngrams.train_and_score(empty), mixing.taken_words(empty), mixing.materialise(empty), jaccard.link_components(empty), jaccard.keep_one(empty), secrets.find_secrets(empty), suffixes.remove_repeats(empty)):
        assert result.count() == 0
