"""Golden values of scalar features, name metrics, reviews and graph operators."""

from __future__ import annotations

import os
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.functions import cvss, reviews, scripts
from riskloom.operators import fuzzy, graph, updates


def values(spark, make, *inputs):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string")
    return [r[0] for r in rows.orderBy("k").select(make(F.col("x"))).collect()]


def test_script_features(spark):
    assert values(spark, scripts.calls_network, "use reqwest;", "std::net::TcpStream", "fn main() {}", None) == [True, True, False, False]
    assert values(spark, scripts.links_native, "#[link]", "cargo:rustc-link-lib=z", "fn main() {}") == [True, True, False]
    assert values(spark, scripts.spawns_process, 'Command::new("ls")', "cmd.spawn()", "fn spawn_task() {}") == [True, True, False]
    assert values(spark, scripts.has_raw_ip, "at 8.8.8.8", "127.0.0.1", "172.16.0.1", "172.32.0.1", "300.1.1.1", None) == [True, False, False, True, False, False]
    assert values(spark, scripts.has_free_tld, "malware.tk", "callback.ml/api", "example.com") == [True, True, False]


def test_entropy(spark):
    got = values(spark, scripts.byte_entropy, "", "aaaaaaa", "abababab", "aZ9!bY8@cX7#dW6$", None)
    assert got[:3] == [0.0, 0.0, 1.0] and got[3] == pytest.approx(4.0) and got[4] == 0.0


def test_cvss(spark):
    got = values(spark, cvss.base_score, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", None)
    assert got[0] in (98, 99) and got[1:] == [0, 0]


def test_name_metrics():
    assert fuzzy.osa_distance("ab", "ba") == 1 and fuzzy.osa_distance("abc", "acb") == 1 and fuzzy.osa_distance("ca", "abc") == 3
    assert fuzzy.jaro_winkler_similarity("serde", "serde") == 100 and fuzzy.jaro_winkler_similarity("serde", "serge") > 80
    assert fuzzy.keyboard_similarity("abc", "abc") == 100 and 0 <= fuzzy.keyboard_similarity("q", "0") <= 100


def test_metrics_over_arrays():
    """The array forms give what the plain ones give, on names by chance and odd ones."""
    rng = np.random.default_rng(4)
    letters = list("abcqwsz-_1éß😀")
    names = ["".join(rng.choice(letters, rng.integers(0, 12))) for _ in range(600)] + ["", "a", "ab", "ba", "abc", "acb"]
    a, b = pd.Series(names), pd.Series([names[k] for k in rng.permutation(len(names))])
    pair = (*fuzzy._codes(a), *fuzzy._codes(b))
    assert fuzzy.osa_distances(*pair).tolist() == [fuzzy.osa_distance(x, y) for x, y in zip(a, b, strict=True)]
    assert fuzzy.jaro_winkler_similarities(*pair).tolist() == [fuzzy.jaro_winkler_similarity(x, y) for x, y in zip(a, b, strict=True)]
    assert fuzzy.keyboard_similarities(*pair).tolist() == [fuzzy.keyboard_similarity(x, y) for x, y in zip(a, b, strict=True)]


def test_matcher_equals_all_pairs(spark):
    names = ["serde", "serge", "tokio", "tokoi", "tokio-rs", "rand", "random", "a", "ab", "hyper", "hyperr", "hypre"]
    packages = spark.createDataFrame([(k, n, 1000 - k) for k, n in enumerate(names)], "id long, name string, downloads long")
    got = {(r.package_id, r.similar_id): r.combined for r in fuzzy.lookalikes(packages, top=5, min_score=60).collect()}
    pairs = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(names) for j, b in enumerate(names[:5]) if i != j and not (i < 5 and i <= j) and abs(len(a) - len(b)) / max(len(a), len(b)) <= 0.3], "i long, j long, a string, b string")
    want = {(r.i, r.j): r.combined for r in fuzzy.all_scores(pairs, "a", "b").collect() if r.combined >= 60}
    assert got == want and want


def test_matcher_on_names_by_chance(spark):
    """Nothing that reaches the score is lost to the bounds: 900 names against 300, compared with all pairs."""
    rng = np.random.default_rng(9)
    stems = ["".join(rng.choice(list("abcdenorst"), rng.integers(3, 9))) for _ in range(60)]
    names = []
    for _ in range(900):
        x = list(str(rng.choice(stems)) + str(rng.choice(["", "-rs", "_core", "2", "é"])))
        for _ in range(rng.integers(0, 3)):
            k = int(rng.integers(len(x)))
            x[k : k + 1] = [[], [x[k], x[k]], list(rng.choice(list("abcxyz"), 1)), [x[min(k + 1, len(x) - 1)], x[k]]][rng.integers(4)]
        names.append("".join(map(str, x)))
    rows = [(k, n, 10_000 - k) for k, n in enumerate(names)]
    got = {(r.package_id, r.similar_id): (r.combined, r.levenshtein, r.osa, r.jaro_winkler, r.keyboard, r.prefix) for r in fuzzy.lookalikes(spark.createDataFrame(rows, "id long, name string, downloads long"), top=300, min_score=70).collect()}
    pairs = [
        (i, j, a, b) for i, a in enumerate(names) for j, b in enumerate(names[:300])
        if a != b and not (i < 300 and i <= j) and abs(len(a.encode()) - len(b.encode())) / max(len(a.encode()), len(b.encode()), 1) <= 0.3
    ]
    scored = fuzzy.all_scores(spark.createDataFrame(pairs, "i long, j long, a string, b string"), "a", "b")
    want = {(r.i, r.j): (r.combined, r.levenshtein, r.osa, r.jaro_winkler, r.keyboard, r.prefix) for r in scored.filter("combined >= 70").collect()}
    assert got == want and len(want) > 500


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 4)], "src long, dst long")
    roots = spark.createDataFrame([(1,)], "id long")
    assert {r.id for r in graph.closure(edges, roots).collect()} == {1, 2, 3, 4}
    kept = graph.break_cycles(edges)
    nodes = spark.createDataFrame([(k,) for k in range(1, 7)], "id long")
    assert {(r.src, r.dst) for r in graph.cycle_edges(edges).collect()} == {(1, 2), (2, 3)}
    wave = {r.id: r.wave for r in graph.waves(nodes, kept).collect()}
    assert len(wave) == 6 and all(wave[r.src] > wave[r.dst] for r in kept.collect())


def test_updates(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id long, name string, at long")
    new = spark.createDataFrame([(2, "B", 21), (3, "c", 30)], "id long, name string, at long")
    assert sorted(map(tuple, updates.upsert(old, new, ["id"], keep=["at"]).collect())) == [(1, "a", 10), (2, "B", 20), (3, "c", 30)]
    assert sorted(map(tuple, updates.insert_new(old, new, ["id"]).collect())) == [(1, "a", 10), (2, "b", 20), (3, "c", 30)]
    twice = spark.createDataFrame([(2, "B", 21), (2, "C", 23), (2, "D", 22), (3, "c", 30), (3, "d", 30)], "id long, name string, at long").repartition(3)
    assert sorted(map(tuple, updates.upsert(old, twice, ["id"], last="at").collect())) == [(1, "a", 10), (2, "C", 23), (3, "d", 30)]
    assert sorted(map(tuple, updates.insert_new(old, twice, ["id"], last="at").collect())) == [(1, "a", 10), (2, "b", 20), (3, "d", 30)]


def test_replies(spark):
    got = values(spark, reviews.reply_score, "x\nSCORE: 85\nSUMMARY:\nbad", "SCORE: 400", "none", "SCORE: x")
    assert got == [85, 100, 0, 0]
    assert values(spark, reviews.reply_notes, "SUMMARY:\n\n a\n b\t\n\n", "SUMMARY:\n\n") == ["a\n b", "SUMMARY:\n\n"]


def packed(context, files, limit):
    """Batches of one package's files in plain Python."""
    size = lambda s: len(s.encode())
    out, batch = [], ""
    for path, text in sorted(files, key=lambda f: (next((k for k, n in enumerate(reviews.FIRST_FILES) if f[0].endswith(n)), 9), f[0])):
        section = f"\n=== FILE: {path} ===\n{text}\n"
        wide = size(section) > limit - size(context)
        if batch and (wide or size(context + batch + section) > limit):
            out.append(context + batch)
            batch = ""
        if wide:
            step = limit - size(context) - reviews.HEADER_RESERVE
            parts = [text[k : k + step] for k in range(0, len(text), step)]
            out += [f"{context}\n=== FILE: {path} (Part {k}/{len(parts)}) ===\n{part}\n" for k, part in enumerate(parts, 1)]
        else:
            batch += section
    return out + [context + batch] if batch or not out else out


def test_review_batches(spark):
    draw = random.Random(2)
    files = [(p, f"{draw.choice(('src/', 'a/', ''))}{k}{draw.choice(('build.rs', 'lib.rs', '.py', 'mod.rs'))}", draw.choice("aé€😀") * draw.choice((0, 1, 40, 300, 900, 2500))) for p in range(6) for k in range(p * 9)]
    packages = [(p, f"n{p}", "", 10) for p in range(7)]
    rows = spark.createDataFrame(files, "package_id long, path string, content string"), spark.createDataFrame(packages, "id long, name string, repository string, downloads long")
    got = {(r.package_id, r.batch): (r.batches, r.content) for r in reviews.review_batches(*rows, 1_000).collect()}
    want = {}
    for p in range(7):
        context = f"=== PACKAGE ===\nName: n{p}\nRepository: \nDownloads: 10\n===============\n\n"
        batches = packed(context, [f[1:] for f in files if f[0] == p], 1_000)
        want |= {(p, k): (len(batches), b) for k, b in enumerate(batches, 1)}
    assert got == want


def test_bit_distances():
    """Against tables, with long names, few letters and many swaps."""
    draw = random.Random(6)
    first = ["".join(draw.choice("abc") for _ in range(draw.choice((1, 2, 5, 9, 63, 64)))) for _ in range(400)]
    second = [draw.choice((a[1:], a[::-1], a[1::-1] + a[2:], "".join(draw.choice("abcd") for _ in range(draw.randrange(70))))) for a in first]
    (a, la), (b, lb) = fuzzy._codes(pd.Series(first)), fuzzy._codes(pd.Series(second))
    alphabet = np.unique(b)
    batch = pa.RecordBatch.from_pydict({"name": first, "id": range(400), "downloads": range(400)})
    places = fuzzy.Names(batch, alphabet).places
    for swaps, table in ((False, fuzzy._distances), (True, fuzzy.osa_distances)):
        got = fuzzy.bit_distances(places, np.arange(400), la, np.searchsorted(alphabet, b), lb, swaps)
        assert (got == table(a, la, b, lb)).all()
    assert [fuzzy.osa_distance(x, y) for x, y in zip(first, second, strict=True)] == got.tolist()


def test_bounds_of_the_matcher():
    """No pair at the score is left out, for odd names too; what lengths need is worked out once for each."""
    draw = random.Random(3)
    base = ["".join(draw.choice("ab-é😀z") for _ in range(draw.choice((0, 1, 2, 3, 4, 9, 20, 70, 300)))) for _ in range(60)]
    names = base + [a[:k] + draw.choice("abq") + a[k + 1 :] for a in base for k in (0, 1, 2, 3, len(a) // 2)]
    table = pa.table({"name": names, "id": range(len(names)), "downloads": range(len(names))})
    targets, batch = fuzzy.Targets(table), fuzzy.Names(table.to_batches()[0], np.zeros(0, np.uint32))
    for i in range(0, len(names), 7):
        near, _, lead = targets.near(batch, i, 75)
        assert [os.path.commonprefix([names[i], targets.names[k]]) for k in near] == [names[i][:n] for n in lead]
        size = lambda x: len(x.encode())
        for k in set(range(len(names))) - set(near.tolist()):
            a, b = names[i], targets.names[k]
            if not a or not b or abs(size(a) - size(b)) / max(size(a), size(b)) > fuzzy.LENGTH_GAP or max(len(a), len(b)) > 64:
                continue
            begin = len(os.path.commonprefix([a, b])) / max(len(a), len(b))
            rest = 20 * fuzzy.osa_similarity(a, b) + 25 * fuzzy.osa_similarity(a, b) + 25 * fuzzy.jaro_winkler_similarity(a, b) + 15 * fuzzy.keyboard_similarity(a, b)
            assert rest + 15 * min(100, (begin + (0.1 if begin * max(len(a), len(b)) >= 2.5 else 0)) * 100 - 1) < 100 * 76
    lengths = {(len(names[i]), len(names[i].encode()), 75) for i in range(0, len(names), 7)}
    assert set(targets.rooms) == lengths
