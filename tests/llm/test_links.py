"""Operator 13 against brute force: fingerprints, groups, and components."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import simhash
from tests.llm.brute import words


def plain_fingerprint(text):
    w = words(text)
    shingles = [w[k : k + 3] for k in range(len(w) - 2)] or ([w] if w else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_roots(prints):
    """The smallest print reachable from each of distinct prints."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for k, p in enumerate(prints):
        for q in prints[:k]:
            if (p ^ q).bit_count() <= 3:
                a, b = sorted((find(p), find(q)))
                root[b] = a
    return {p: find(p) for p in prints}


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = plain_roots(sorted(set(prints)))
    least = {}
    for (doc_id, _), p in zip(rows, prints, strict=True):
        if doc_id is not None:
            least[root[p]] = min(doc_id, least.get(root[p], doc_id))
    return [(d, f"{p:016x}", least.get(root[p])) for (d, _), p in zip(rows, prints, strict=True)]


@pytest.mark.parametrize("refine", [simhash.REFINE, 8])
def test_components(corpus, rows, refine):
    """Also where groups of more than eight rows are split level by level."""
    got = Counter(map(tuple, simhash.near_duplicates(corpus, refine).select("doc_id", "fingerprint", "component_id").collect()))
    assert got == Counter(plain_components(rows))


def test_versions_of_one_text(spark):
    """Few words changed in a long text: fingerprints near each other, with chains between them."""
    text = [f"word{k * 7919 % 5003}" for k in range(600)]
    rows = [(k, " ".join(text[: 300 + k] + ["other"] * (k % 5) + text[300 + k :])) for k in range(120)]
    rows += [(1000 + k, " ".join(f"w{k}x{j}" for j in range(50))) for k in range(60)] + rows[:30]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 16).collect()
    assert Counter(map(tuple, got)) == Counter(plain_components(rows))
    assert len({r.component_id for r in got}) < 150


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 63), max_size=200), st.integers(0, 2**64 - 1), st.integers(1, 90))
def test_near_pairs(flips, start, group):
    """A walk of flipped bits: chains of neighbours, in one group or in several."""
    prints = [start]
    for b in flips:
        prints.append(prints[-1] ^ 1 << b ^ 1 << b * 7 % 64)
    prints = sorted(set(prints))
    keys = np.arange(len(prints)) // group
    a, b = simhash.linked_rows(keys, np.array(prints, np.uint64), 3)
    root = {p: p for p in prints}
    for x, y in sorted(zip(map(int, a), map(int, b), strict=True)):
        assert y < x
        root[x] = root[y]
    want, found = plain_roots(prints), {}
    for k in range(0, len(prints), group):
        part = plain_roots(prints[k : k + group])
        for p, r in part.items():
            assert root[p] == root[r]
    for p, r in root.items():
        found.setdefault(r, want[p])
        assert found[r] == want[p]


def test_bands_leave_16_bits():
    for path, mask in enumerate(simhash.band_masks()[-1]):
        assert 64 - mask.bit_count() <= 16, path


def test_every_near_pair_meets_in_a_last_group():
    rng = np.random.default_rng(5)
    masks = simhash.band_masks()[-1]
    for _ in range(50):
        flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not mask & flips for mask in masks)


def test_long_texts_in_stretches():
    text = " ".join(f"w{k % 977}" for k in range(20_000)).encode()
    assert simhash.fingerprint(text) == simhash.fingerprint(text, 100) == plain_fingerprint(text.decode())


def test_empty_table_and_wordless_texts(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    docs = spark.createDataFrame([(3, None), (2, ""), (None, " \n"), (7, "a b c d e")], "doc_id long, text string")
    got = {(r.doc_id, r.fingerprint == "0" * 16, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(3, True, 2), (2, True, 2), (None, True, 2), (7, False, 7)}
