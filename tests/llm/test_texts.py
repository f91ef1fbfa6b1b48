"""Operators 2, 4, 5, 8 and 9: round trips, brute force, held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm._shared import Scratch
from tests.llm import brute
from riskloom.llm import fingerprints, media, packing, queries, toxicity, warc


def test_warc_round_trip(spark):
    rows = [(5, "http://a", "same"), (3, "http://b\r\nx", "same"), (9, None, None), (4, "u", ""), (7, "v", "päivää 😀"), (8, "w", "WARC/1.1\r\n\r\n" * 9), (None, "n", "same")]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and all(r.kind == "record" for r in got.values())
    groups = defaultdict(list)
    for i, _, h in rows:
        if i is not None:
            groups[h or ""].append(i)
    for i, _, h in rows:
        data = (h or "").encode()
        first = min(groups[h or ""])
        want = ("response", None) if i == first else ("revisit", first)
        assert (got[i].record_type, got[i].refers_to) == want
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()


def _archive(packed: bool, n: int = 6) -> list[bytes]:
    parts = []
    for k in range(n):
        raw = warc.record(k, f"http://x/{k}", f"payload {k} ".encode() * 20, None)
        if packed:
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            raw = z.compress(raw) + z.flush()
        parts.append(raw)
    return parts


def _pages(found) -> list[str]:
    return [x[3][0]["x-page-id"] for x in found if x[0] == "record"]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    """A broken byte, a cut member and junk between records: every other record comes back, every byte is accounted for."""
    parts = _archive(packed)
    broken = bytearray(parts[2])
    broken[-30] ^= 0xFF  # in the block
    data = parts[0] + parts[1] + bytes(broken) + b"junk" + parts[3] + parts[4][:-9] + parts[5]
    found = list(warc.salvage(data))
    pages = _pages(found)
    assert [p for p in pages if p not in "24"] == ["0", "1", "3", "5"]
    assert sum(x[2] - x[1] for x in found) == len(data) and sum(x[0] == "gap" for x in found if x[4] is None) == 2


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("at", [0, 1, 2, 5])
def test_salvage_of_a_damaged_beginning(packed, at):
    parts = _archive(packed)
    data = bytearray(b"".join(parts))
    data[at] ^= 0x55
    found = list(warc.salvage(bytes(data)))
    assert set(_pages(found)) >= {"1", "2", "3", "4", "5"}
    assert sum(x[2] - x[1] for x in found) == len(data)


def test_salvage_inside_members():
    """Several records in one member: damage inside one record, a wrong checksum, and a member that is cut short."""
    raw = _archive(False)
    pack = lambda x: zlib.compressobj(0, zlib.DEFLATED, 31)

    def member(body: bytes) -> bytes:
        z = pack(body)
        return z.compress(body) + z.flush()

    broken = bytearray(raw[2])
    broken[-20] ^= 1
    whole = member(b"".join([raw[0], raw[1], bytes(broken), raw[3]]))
    found = list(warc.salvage(whole + member(raw[4])))
    assert _pages(found) == ["0", "1", "3", "4"]
    inner = [x for x in found if x[4] is not None and x[2] <= len(whole)]
    assert sum(x[5] - x[4] for x in inner) == sum(map(len, raw[:4])) and sum(x[2] - x[1] for x in found) == len(whole) + len(member(raw[4]))
    # A byte of the stored block flipped: the checksum fails, and only the record that holds it is lost.
    flipped = bytearray(member(b"".join(raw[:4])))
    flipped[len(flipped) // 2] ^= 1
    found = list(warc.salvage(bytes(flipped) + member(raw[4])))
    assert len(_pages(found)) == 4 and _pages(found)[-1] == "4"
    # Cut short after the second record.
    cut = member(b"".join(raw[:4]))[: len(raw[0]) + len(raw[1]) + 60]
    found = list(warc.salvage(cut + member(raw[4])))
    assert _pages(found) == ["0", "1", "4"] and sum(x[2] - x[1] for x in found) == len(cut) + len(member(raw[4]))


def test_salvage_of_damage_by_chance():
    """Whatever happens to an archive, reading it neither fails nor loses count of its bytes; far records come back."""
    rng = np.random.default_rng(8)
    for packed in (True, False):
        clean = b"".join(_archive(packed, 12))
        for _ in range(60):
            data = bytearray(clean)
            at = int(rng.integers(len(data)))
            data[at : at + int(rng.integers(1, 40))] = rng.bytes(int(rng.integers(0, 40)))
            found = list(warc.salvage(bytes(data)))
            assert sum(x[2] - x[1] for x in found) == len(data)
            assert len(set(_pages(found))) >= 9


def test_gaps_are_logged(spark, tmp_path):
    parts = _archive(True)
    folder = tmp_path / "warc"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(parts[0] + b"junk" + parts[1] + parts[2][:20])
    (folder / "b.warc.gz").write_bytes(parts[3])
    read = warc.read_warc(spark, str(folder), with_payload=True)
    gaps = warc.gap_log(read).collect()
    assert sorted((r.start, r.end) for r in gaps) == [(len(parts[0]), len(parts[0]) + 4), (len(parts[0] + parts[1]) + 4, len(parts[0] + parts[1]) + 24)]
    rows = {r.page_id: r for r in read.filter("kind = 'record'").collect()}
    assert set(rows) == {0, 1, 3} and rows[0].archive_gaps == 2 and rows[0].archive_gap_bytes == 24 and rows[3].archive_gaps == 0
    assert bytes(rows[3].payload) == b"payload 3 " * 20


def test_clashing_columns_of_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>", "x"), (2, "u", "<p>", "x")], "page_id long, url string, html string, x string")
    for name in ("_sha1", "refers_to", "_first", "_n", "kind", "path", "payload_digest", "record_type"):
        pages = pages.withColumn(name, F.lit("clash"))
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {1: ("response", None), 2: ("revisit", 1)}


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    unary, edges = rng.normal(size=5), rng.normal(size=(2, 2))
    weight = {y: np.exp(sum(u for u, t in zip(unary, y, strict=True) if t) + sum(edges[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=5)}
    whole = sum(weight.values())
    want = [sum(w for y, w in weight.items() if y[t]) / whole for t in range(5)]
    got = toxicity.marginals(np.concatenate([unary, unary[:1]]), np.array([0, 5]), edges)[0]
    assert got[:5] == pytest.approx(want)


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"  # 97 toxic rows are held out here, 6 at sf0.01
    got = queries.op4_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in got if r.held_out and r.toxic is not None]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.97
    assert sum(r.predicted for r in held if r.toxic) >= 0.85 * sum(r.toxic for r in held)


def test_toxic_offsets(spark):
    """Offsets point at the toxic words, in code points, whatever stands before them; clean texts have none."""
    words = ["bad", "vile"]
    chain = toxicity.fit(__import__("pyarrow").array([f"a nice {w} day here and there" for w in ("bad", "bad", "vile", "vile")] * 10 + ["a nice calm day here and there"] * 80), np.arange(120) < 40)
    texts = ["päivää 😀 bad day", "nice day", "a nice vile day here", None, "", "x " * 3000 + "bad"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(rows, chain).collect()}
    for k, t in enumerate(texts):
        found = [(t or "")[s.start : s.end] for s in got[k].toxic_spans]
        assert {x for x in found if x in words} == {x for x in (t or "").split() if x in words}, (t, found)


def test_training_is_bounded(spark):
    docs = spark.createDataFrame([(k, "word " * 100) for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(50)], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, labels, max_bytes=5_000) and toxicity.train(docs, labels, max_rows=3) and toxicity.train(docs, labels, max_bytes=1)


def test_more_empty_tables(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    chain = toxicity.fit(__import__("pyarrow").array(["bad", "good"]), np.array([True, False]))
    stored = media.write_media(empty)
    for result in (
        warc.round_trip(pages), toxicity.score(empty, chain), fingerprints.edited_fingerprints(empty),
        packing.pack_pieces(packing.cut_pieces(empty, queries.tokenizer_path())), media.read_payload(media.probe_media(stored, keep_media=True)),
    ):
        assert result.count() == 0


def test_toxicity_is_fitted_in_a_worker(spark, sf_dir, monkeypatch):
    """The driver gets weights, neither texts nor features."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = toxicity.fit  # workers import their own
    monkeypatch.setattr(toxicity, "fit", lambda *a: (_ for _ in ()).throw(AssertionError("fitted in the driver")))
    chain = queries.toxicity_model(spark, docs, sf_dir)
    monkeypatch.setattr(toxicity, "fit", want)
    assert chain.table.shape == (toxicity.BUCKETS,) and chain.table.any() and chain.edges.shape == (2, 2) and chain.curve.shape == (3,)


def test_toxicity_of_odd_rows(spark, corpus):
    chain = toxicity.fit(__import__("pyarrow").array(["bad vile word here"] * 20 + ["nice calm day"] * 40), np.arange(60) < 20)
    got = toxicity.score(corpus, chain).collect()
    assert len(got) == corpus.count() and all(0 <= r.score <= 1 for r in got)


def test_fingerprints(corpus, rows):
    got = fingerprints.edited_fingerprints(corpus).collect()
    assert len(got) == len(rows)
    assert fingerprints.edited_fingerprints(corpus.filter("doc_id = 900012")).first().near_next == 1  # its own neighbour
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    own = {(r.doc_id, r.n_chars): r for r in got}
    prints = defaultdict(set)
    for k, (i, t) in enumerate(order):
        _, after = order[(k + 1) % len(order)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = own[i, len(t)]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own_print, edited_print, next_print = (brute.order_minhash(x) for x in (t, edited, after))
        assert (r.fingerprint, r.edited_fingerprint) == tuple("".join(f"{e:08x}" for e in x) for x in (own_print, edited_print))
        assert r.near_edited == pytest.approx(brute.likeness(own_print, edited_print))
        assert r.near_next == pytest.approx(brute.likeness(own_print, next_print))
        prints[t].add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values())


def test_fingerprints_of_other_scripts_and_lines(spark):
    """Half of each text is changed: without spaces, a word a line, with tabs."""
    draw = random.Random(9)
    chinese = "".join(chr(draw.randrange(0x4E00, 0x5000)) for _ in range(400))
    lines, tabs = ("".join(f"{x}{draw.randrange(900)}" for x in sep * 200) for sep in ("\n", "\t"))
    texts = [chinese, lines, tabs, "😀" * 30]
    docs = spark.createDataFrame([(9 - k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    for k, t in enumerate(texts):
        r = got[9 - k]
        assert r.fingerprint == "".join(f"{e:08x}" for e in (x & 0xFFFFFFFF for x in brute.order_minhash(t)))
        assert k == 3 or 0.05 < r.near_edited < 0.7
    assert all(r.near_next < 0.1 for r in got.values())


def test_fingerprints_feel_order(spark):
    words = [f"w{k}" for k in range(400)]
    moved = words[200:] + words[:200]
    shuffled = [w for k in range(0, 400, 4) for w in reversed(words[k : k + 4])]
    near = [*words[:100], "x", *words[101:]]
    rows = spark.createDataFrame([(" ".join(words), " ".join(near), " ".join(moved), " ".join(shuffled))], "a string, b string, c string, d string")
    f = {c: fingerprints.fingerprint(F.col(c)) for c in "abcd"}
    r = rows.select(*[fingerprints.likeness(f["a"], f[c]).alias(c) for c in "abcd"]).first()
    assert r.a == 1 and r.b > 0.8 and r.b > r.c > r.d


def test_pieces_and_packing(spark, corpus, rows):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    exact = Tokenizer.from_file(path)
    packed = packing.pack_pieces(packing.cut_pieces(corpus, path)).collect()
    want = []
    for i, t in rows:
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(itertools.pairwise(edges))]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    lengths = np.array([r.length for r in packed])
    assert len(bins) <= packing.lower_bound(lengths, np.ones(len(lengths), int), 1024) * 1.01 + 1


def test_partitions_are_certified(spark):
    """Each partition's gap is its count above its own bound; the certificate holds for the whole; brute force can't beat the bound."""
    rng = np.random.default_rng(6)
    lengths = rng.integers(1, 90, 3000)
    items = spark.createDataFrame([(k, int(x)) for k, x in enumerate(lengths)], "row long, length long")
    with Scratch(spark) as scratch:
        first = packing._pack_round(items, 5, 0, 100).collect()
        parts = defaultdict(lambda: [set(), []])
        for r in first:
            parts[r.bin >> 32][0].add(r.bin)
            parts[r.bin >> 32][1].append(r.length)
        for r in first:
            bins, own = parts[r.bin >> 32]
            assert r.gap == len(bins) - packing.lower_bound(np.array(own), np.ones(len(own), int), 100) >= 0
        kept, certificate = packing.pack(items, scratch, 100, part_items=600)
        rows = kept.collect()
        assert sorted(r.row for r in rows) == list(range(3000)) and len({r.bin for r in rows}) == certificate.bins >= certificate.bound
        assert certificate.bins <= len({r.bin for r in first})
        fill = defaultdict(int)
        for r in sorted(rows, key=lambda r: (r.bin, r.offset)):
            assert fill[r.bin] == r.offset
            fill[r.bin] += r.length
        assert max(fill.values()) <= 100

    def best(x: list[int], bins: list[int]) -> int:
        """The fewest bins of 10, by trying everything."""
        if not x:
            return len(bins)
        tried = [best(x[1:], [*bins[:k], b + x[0], *bins[k + 1 :]]) for k, b in enumerate(bins) if b + x[0] <= 10]
        return min([*tried, best(x[1:], [*bins, x[0]])])

    for _ in range(25):
        x = rng.integers(1, 10, 7)
        least = best(x.tolist(), [])
        assert packing.lower_bound(x, np.ones(7, int), 10) <= least <= packing.best_fit_decreasing(x, 10)[2]


def test_other_tokenizer_files(tmp_path):
    """A file that the fast path does not fit goes to its own library."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    assert packing._encoders(path)[0] is not None
    file = json.loads(open(path, encoding="utf-8").read())
    file["normalizer"] = {"type": "Lowercase"}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(file), encoding="utf-8")
    assert packing._encoders(str(other))[0] is None
    assert packing.encode("Some TEXT", str(other)).tolist() == Tokenizer.from_file(str(other)).encode("Some TEXT", add_special_tokens=False).ids


def test_bounds_hold():
    rng = np.random.default_rng(4)
    for _ in range(30):
        x = rng.integers(1, 31, rng.integers(1, 60))
        assert packing.lower_bound(x, np.ones(len(x), int), 30) <= packing.best_fit_decreasing(x, 30)[2]
    assert packing.lower_bound(np.array([16] * 5), np.ones(5, int), 30) == 5


def test_media_round_trip(spark, corpus, rows):
    got = media.read_payload(media.probe_media(media.write_media(corpus), keep_media=True)).collect()
    by = {(r.doc_id, r.n_bytes): r for r in got}
    assert len(got) == len(rows)
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = by[i, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), None)
        assert r.samples == len(payload) // 576 and r.keyframes == len(r.keyframe_ranges) and r.codec.strip() == "raw" and r.tracks == 1
        frames = np.frombuffer(payload, np.uint8).reshape(-1, 576).astype(int)
        scenes = [k for k in range(len(frames)) if not k or np.abs(frames[k] - frames[k - 1]).mean() > 33]
        start = r.media_bytes - len(payload)
        assert [(x.offset, x.bytes) for x in r.keyframe_ranges] == [(start + 576 * k, 576) for k in scenes]


def test_broken_containers(spark):
    whole = media.container(b"\x07" * 1152)
    at = whole.index(b"mdhd") + 16
    timeless = whole[:at] + bytes(4) + whole[at + 4 :]
    deep = b"moov"
    for _ in range(3000):
        deep = (len(deep) + 4).to_bytes(4, "big") + deep + b""
        deep = b"moov" + deep
    deep = (len(deep) + 4).to_bytes(4, "big") + deep
    at = whole.index(b"stsz") + 12
    many = whole[:at] + b"\xff" * 4 + whole[at + 4 :]
    rows = [(1, whole), (2, whole[:300]), (3, b""), (4, None), (5, timeless), (6, deep), (7, many)]
    docs = spark.createDataFrame([(k, x and bytearray(x)) for k, x in rows], "k int, media binary")
    got = {r.k: r for r in media.read_payload(media.probe_media(docs, keep_media=True)).collect()}
    assert got[1].error is None and got[5].error is None and got[5].duration is None and got[5].payload_bytes == 1152
    assert all(got[k].error and got[k].codec is None and got[k].payload_bytes is None for k in (4, 6, 7, 2, 3))


def test_damaged_containers_by_chance():
    rng = np.random.default_rng(3)
    whole = media.container(rng.bytes(576 * 70))
    head = len(whole) - 576 * 70
    for _ in range(1000):
        data = bytearray(whole)
        for at in rng.integers(0, head, rng.integers(1, 6)):
            data[at] = int(rng.integers(256))
        data = bytes(data[: int(rng.integers(head, len(data)))] if rng.random() < 0.3 else data)
        try:
            for t in media.tracks(data):
                assert len(media.payload_of(data, t)) <= len(data)
        except (ValueError, KeyError, IndexError, OverflowError, __import__("struct").error):
            pass


def test_fragmented_media():
    """Samples that only track runs describe, with defaults of the movie and of the fragment."""
    import struct

    box, full = media._box, media._full
    whole = media.container(b"\x07" * 576)
    tables = {}
    for path, a, b in media.walk(memoryview(whole)):
        tables[path[-1]] = whole[a:b]
    empty = box(
        b"stbl", box(b"stsd", tables[b"stsd"]), full(b"stts", bytes(4)), full(b"stsc", bytes(4)), full(b"stsz", bytes(8)), full(b"stco", bytes(4)), full(b"stss", bytes(4))
    )
    track = box(b"trak", box(b"tkhd", tables[b"tkhd"]), box(b"mdia", box(b"mdhd", tables[b"mdhd"]), box(b"minf", empty)))
    movie = box(b"moov", track, box(b"mvex", full(b"trex", struct.pack(">5I", 1, 1, 1, 5, 0x10000))))

    def fragment(start: int) -> bytes:
        first = full(b"trun", struct.pack(">IiI", 3, start, 0), flags=0x1 | 0x4)
        second = full(b"trun", struct.pack(">I4I", 2, 7, 0, 8, 0x10000), flags=0x200 | 0x400)
        return box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 1), flags=0x20000), first, second))

    body = bytes(range(30))
    moof = fragment(len(fragment(0)) + 8)
    blob = movie + moof + box(b"mdat", body)
    (t,) = media.tracks(blob)
    assert t.size.tolist() == [5, 5, 5, 7, 8] and t.sync.tolist() == [0, 3] and t.ticks == 5 and media.payload_of(blob, t) == body


def test_registered_queries():
    import __spark_entry__ as entry

    assert {f"op{k}" for k in range(1, 11)} <= {n.split("_")[0] for n in entry.queries()} and "pipeline" in entry.queries()
    json.dumps(entry.oracle_sql())
