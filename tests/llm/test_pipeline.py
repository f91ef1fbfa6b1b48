"""The corpus pipeline, stage by stage, on odd rows: each stage against brute force or what it must keep; nothing is left behind."""

from __future__ import annotations

from collections import Counter, defaultdict
from pathlib import Path

import pytest

import corpus_pipeline
from riskloom.llm._shared import shared_root
from tests.llm import brute
from tests.llm.conftest import EXTRA


def rows_of(df) -> list[tuple]:
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


def some(rows) -> Counter:
    return Counter(rows)


@pytest.fixture(scope="module")
def stages(spark, sf_dir, corpus, tmp_path_factory):
    """Each stage's result, written and read again, as the contract has it."""
    folder, out = tmp_path_factory.mktemp("stages"), {}
    docs = corpus
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out[name] = docs
    return out


def test_names_and_columns(stages):
    assert list(stages) == ["toxicity", "near_duplicates", "secrets", "mixture", "packing"]
    for name in list(stages)[:-1]:
        assert stages[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity(spark, sf_dir, corpus, stages):
    from riskloom.llm import queries, toxicity

    scored = toxicity.score(corpus.drop("score"), queries.toxicity_model(spark, corpus, sf_dir))
    want = Counter((r.doc_id, r.text, r.lang, r.source) for r in scored.collect() if r.score < 0.5)
    assert some(rows_of(stages["toxicity"])) == want and sum(want.values()) >= 0.9 * corpus.count()


def test_near_duplicates(stages):
    before = rows_of(stages["toxicity"])
    found = brute.link_components([(i, t) for i, t, _, _ in before])
    want = set()
    for k, ((i, t, _, _), (_, n, c)) in enumerate(zip(before, found, strict=True)):
        if not n or i == c:
            want.add((i, t, None if n else k))
    assert Counter((i, t) for i, t, _, _ in rows_of(stages["near_duplicates"])) == Counter((i, t) for i, t, _ in want)


def test_secrets(stages):
    after = defaultdict(list)
    for i, t, lang, source in rows_of(stages["secrets"]):
        after[i, lang, source].append(t)
    for i, t, lang, source in rows_of(stages["near_duplicates"]):
        assert after[i, lang, source]
        if not brute.base_secrets(t) and "eyJ" not in (t or "") and "BEGIN" not in (t or "") and "gh" not in (t or "") and "xox" not in (t or ""):
            assert t in after[i, lang, source]
    assert all(not brute.base_secrets(t) for ts in after.values() for t in ts)
    assert sum(map(len, after.values())) == stages["near_duplicates"].count()


def test_mixture(stages):
    before, after = rows_of(stages["secrets"]), rows_of(stages["mixture"])
    size = lambda t: len(brute.WORD.findall(t or ""))
    sizes, taken, held = defaultdict(int), defaultdict(int), Counter()
    for _, t, _, s in before:
        sizes[s] += size(t)
    for i, t, _, s in after:
        taken[s] += size(t)
        held[i] += size(t)
    for s, target in brute.mix_targets(sizes).items():
        assert abs(taken[s] - target) <= 0.5 + 1e-6
    for i, t, _, _ in before:
        assert held[i] <= 3 * size(t)
    bare = [(i, t) for i, t, _, _ in before if not size(t)]
    assert bare and Counter(bare) == Counter((i, t) for i, t, _, _ in after if not size(t))


def test_packing(stages):
    from tokenizers import Tokenizer

    from riskloom.llm.queries import tokenizer_path

    exact = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t, _, _ in rows_of(stages["mixture"]):
        want[i] += len(exact.encode(t or "", add_special_tokens=False).ids) + 1
    got, bins = Counter(), defaultdict(list)
    for r in stages["packing"].collect():
        got[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty_tables_and_clashes(spark, sf_dir, empty):
    docs = empty
    assert set(EXTRA) <= set(docs.columns)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_run_leaves_little(spark, sf_dir):
    root = Path(shared_root(spark).removeprefix("file://"))
    before = {p for p in root.iterdir()} if root.exists() else set()
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.count() > 0 and packed.select("doc_id").distinct().count() > 100
    left = {p for p in root.iterdir()} - before
    assert len(left) <= 3, left  # the pieces and their places, which the result reads


