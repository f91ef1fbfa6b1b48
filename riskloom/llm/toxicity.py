"""Toxic spans by a linear-chain conditional random field (operator 4).

Labels are per document, so tokens are labelled first: in a bounded sample of labelled documents, a
token of a toxic document is marked toxic when its word, or a prefix of it, turns up in far more toxic
than clean documents. On one half of the sample a two-label chain (clean, toxic) over hashed word and
prefix features is fitted by gradient ascent on the conditional likelihood. On the other half, the
forward-backward marginals of whole documents are aggregated to (expected toxic tokens, largest
marginal) and a logistic curve turns them into a score from 0 to 1.

Tagging runs over every whole text: a sequence is a run of tokens up to a sentence end or line break,
and the recursions step through all the sequences of a slice at once. The model is a fixed-size
weight table (``BUCKETS`` floats), whatever the input's size.

Edge cases: a null or empty text has no tokens and gets the score of zero expected toxic tokens; a
sample without both labels gives score 0 for every row; repeated rows are scored alike, and nothing depends
on ties; a text of any length is scored whole, in a worker's memory; an empty table gives no rows; other
columns of the input are carried along untouched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm._shared import cut
from riskloom.llm._text import Words, code_points, mix64, slices, texts_of

BUCKETS = 1 << 19
PREFIXES = (3, 4, 5, 6, 7)
#: Bytes of tokens: ASCII letters and digits, and all bytes of longer code points.
_NOT_TOKEN = np.ones(256, bool)
_NOT_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STOPS = np.zeros(256, bool)
_STOPS[[10, 13, 33, 46, 63]] = True


@dataclass
class Tokens:
    """Tokens of a slice: feature buckets (n x features), sequence starts, and the text of each token."""

    features: np.ndarray
    sequence: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    words = Words(data, offsets, separators=_NOT_TOKEN)
    n = len(words.start)
    features = np.empty((n, 1 + len(PREFIXES)), np.int32)
    features[:, 0] = words.hash & np.uint64(BUCKETS - 1)
    for k, size in enumerate(PREFIXES, 1):
        long = words.end - words.start > size
        part = mix64(words.part(words.start, np.minimum(words.start + size, words.end)) + np.uint64(k))
        features[:, k] = np.where(long, part & np.uint64(BUCKETS - 1), features[:, 0])
    stops = np.cumsum(_STOPS[data]) if len(data) else np.zeros(0, np.int64)
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = stops[words.start[1:]] != stops[words.start[:-1]]
        new[words.first[:-1][words.first[:-1] < n]] = True
    return Tokens(features, np.flatnonzero(new), words.first, words.start, words.end)


@dataclass
class Chain:
    """Weights: ``table`` by feature bucket, ``bias``, ``edges`` (log potentials [from, to]); ``curve`` of the document score."""

    table: np.ndarray
    bias: float
    edges: np.ndarray
    curve: np.ndarray

    def unary(self, features: np.ndarray) -> np.ndarray:
        u = np.full(len(features), self.bias)
        for k in range(features.shape[1]):  # a prefix bucket equal to the word's own is a filler
            u += np.where((k > 0) & (features[:, k] == features[:, 0]), 0, self.table[features[:, k]]) if k else self.table[features[:, 0]]
        return np.clip(u, -30, 30)


def marginals(unary: np.ndarray, sequence: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all sequences at once: P(toxic) of each token, and the ratios forward and backward.

    ``forward[t]`` is alpha(toxic)/alpha(clean) with the token's own potential, ``backward[t]`` is
    beta(toxic)/beta(clean). One step serves the t-th token of every sequence.
    """
    n = len(unary)
    length = np.diff(np.append(sequence, n))
    order = np.argsort(-length, kind="stable")
    starts, length = sequence[order], length[order]
    potential = np.exp(unary)
    (oo, ot), (to, tt) = np.exp(edges)
    forward, backward = np.empty(n), np.ones(n)
    forward[starts] = potential[starts]
    active = np.searchsorted(-length, -np.arange(1, (length[0] if n else 0) + 1), "right")  # sequences longer than t
    for t in range(1, length[0] if n else 0):
        at = starts[: active[t]] + t
        a = forward[at - 1]
        forward[at] = potential[at] * (ot + a * tt) / (oo + a * to)
    for t in range((length[0] if n else 0) - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        b = potential[at + 1] * backward[at + 1]
        backward[at] = (to + b * tt) / (oo + b * ot)
    odds = forward * backward
    return odds / (1 + odds), forward, backward


def _parts(texts: pa.Array, label: np.ndarray) -> Iterator[tuple[Tokens, np.ndarray]]:
    """Tokens and labels of a sample, a slice of texts at a time: memory does not follow the sample."""
    data, offsets = texts_of(texts)
    for i, j in slices(offsets):
        yield tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), label[i:j]


def _evidence(texts: pa.Array, label: np.ndarray) -> np.ndarray:
    """For each feature bucket, log of its document rate among toxic over that among clean documents; 0 if under 2% of the toxic have it."""
    seen = np.zeros((2, BUCKETS), np.int32)
    for tok, own in _parts(texts, label):
        for i in range(len(own)):
            seen[int(own[i]), np.unique(tok.features[tok.first[i] : tok.first[i + 1]])] += 1
    rate = (seen + 0.5) / (np.array([[(~label).sum()], [label.sum()]]) + 1)
    return np.where(seen[1] >= max(4, 0.02 * label.sum()), np.log(rate[1] / rate[0]), 0)


def fit(texts: pa.Array, toxic: np.ndarray, min_log_ratio: float = 3.0, rounds: int = 30) -> Chain:
    """The chain and the score's curve from a bounded sample of labelled texts."""
    half = np.arange(len(toxic)) % 2 == 0
    if min(toxic.sum(), (~toxic).sum()) < 4:
        return Chain(np.zeros(BUCKETS), -10.0, np.zeros((2, 2)), np.array([-10.0, 0.0, 0.0]))
    sample = lambda rows: (texts.take(pa.array(np.flatnonzero(rows))), toxic[rows])
    strong = _evidence(*sample(half))
    chain = Chain(np.zeros(BUCKETS), -4.0, np.zeros((2, 2)), np.zeros(3))
    # The chain learns from all sequences with a marking feature, and every tenth of the others.
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for tok, label in _parts(*sample(half)):
        if not len(tok.start):
            continue
        marks = strong[tok.features].max(1) >= min_log_ratio
        size = np.diff(np.append(tok.sequence, len(marks)))
        keep = (np.add.reduceat(marks.astype(np.int64), tok.sequence) > 0) | (np.arange(len(size)) % 10 == 0)
        use = np.repeat(keep, size)
        in_toxic = np.repeat(label, np.diff(tok.first))
        kept.append((tok.features[use], (marks & in_toxic)[use].astype(float), size[keep]))
    features, target, size = (np.concatenate(x) for x in zip(*kept, strict=True))
    sequence = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)
    follows = np.ones(len(target), bool)
    follows[sequence] = False
    into, out_of = np.flatnonzero(follows), np.flatnonzero(follows) - 1
    pair = lambda p, q: np.array([[((1 - p) * (1 - q)).sum(), ((1 - p) * q).sum()], [(p * (1 - q)).sum(), (p * q).sum()]])
    observed = pair(target[out_of], target[into])
    own = np.ones(features.shape, bool)
    own[:, 1:] = features[:, 1:] != features[:, :1]
    flat = features[own]
    rows = np.repeat(np.arange(len(features)), own.sum(1))
    square, square_edges = np.full(BUCKETS, 1e-3), np.full((2, 2), 1.0)
    for _ in range(rounds):
        u = chain.unary(features)
        p, forward, backward = marginals(u, sequence, chain.edges)
        slope = np.bincount(flat, (target - p)[rows], BUCKETS) - 0.05 * chain.table
        square += slope**2
        chain.table += 0.7 * slope / np.sqrt(square)
        chain.bias += 0.2 * float(np.sign((target - p).sum())) * min(1.0, abs((target - p).sum()) / (1 + target.sum()))
        # Expected transitions: forward ratio, edge, own potential and backward ratio of the two tokens.
        a, b, edge = forward[out_of], np.exp(u[into]) * backward[into], np.exp(chain.edges)
        whole = edge[0, 0] + edge[0, 1] * b + a * edge[1, 0] + a * b * edge[1, 1]
        expected = edge * np.array([[(1 / whole).sum(), (b / whole).sum()], [(a / whole).sum(), (a * b / whole).sum()]])
        slope_edges = observed - expected - 0.05 * chain.edges
        square_edges += slope_edges**2
        chain.edges = chain.edges + 0.2 * slope_edges / np.sqrt(square_edges)
    texts_, label = sample(~half)
    x = [_aggregate(marginals(chain.unary(tok.features), tok.sequence, chain.edges)[0], tok.first) for tok, _ in _parts(texts_, label)]
    chain.curve = _curve(np.concatenate(x), label)
    return chain


def _aggregate(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document: 1, log(1 + expected toxic tokens), largest marginal."""
    total = np.zeros(len(p) + 1)
    np.cumsum(p, out=total[1:])
    out = np.zeros((len(first) - 1, 3))
    out[:, 0] = 1
    out[:, 1] = np.log1p(total[first[1:]] - total[first[:-1]])
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some, 2] = np.maximum.reduceat(p, first[some])
    return out


def _curve(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Logistic regression with a light ridge, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (label - p) - 0.1 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, max_chars: int = 100_000, max_bytes: int = 128 << 20) -> Chain:
    """Fits on at most ``max_rows`` labelled texts of at most ``max_chars``, and of at most ``max_bytes`` in all: those with the
    smallest hash of doc_id.

    The bounds are the classifier's only limits; scoring has none. One task fits the sample; no text comes to the driver. The chosen ids are at most ``max_rows``, so they can be
    broadcast (and summed up in one task), and only chosen texts are moved.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    chosen = cut(chosen)
    texts = docs.select("doc_id", "text").filter(F.length("text") <= max_chars)
    sizes = texts.select("doc_id", F.octet_length("text").cast("long").alias("size")).join(F.broadcast(chosen), "doc_id")
    sizes = sizes.groupBy("doc_id", "toxic").agg(F.max("size").alias("size"))
    so_far = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    taken = sizes.withColumn("_sum", so_far).filter(F.col("_sum") <= max_bytes).select("doc_id", "toxic")
    texts = texts.join(F.broadcast(taken), "doc_id")
    sample = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    found = sample.repartition(1).mapInArrow(_fit_sample, _CHAIN).collect()
    if not found:
        return fit(pa.array([], pa.string()), np.zeros(0, bool))
    numbers = {c: np.frombuffer(zlib.decompress(found[0][c])) for c in ("table", "edges", "curve")}
    return Chain(numbers["table"], found[0]["bias"], numbers["edges"].reshape(2, 2), numbers["curve"])


_CHAIN = "table binary, bias double, edges binary, curve binary"


def _fit_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chain of the sample, which is bounded, as one row: texts and features stay in a worker, and the driver gets weights only."""
    held = [b for b in batches if len(b)]
    if held:
        sample = pa.Table.from_batches(held).sort_by("doc_id")
        chain = fit(sample["text"].combine_chunks(), np.asarray(sample["toxic"].to_numpy()) > 0)
        packed = [pa.array([zlib.compress(np.asarray(x, float).tobytes(), 1)]) for x in (chain.table, chain.edges, chain.curve)]
        yield pa.RecordBatch.from_arrays([packed[0], pa.array([float(chain.bias)]), *packed[1:]], names=["table", "bias", "edges", "curve"])


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` and ``toxic_spans`` (start, end in code points, probability) of tokens at or above ``threshold``.

    Columns of the input with those two names give way to the new ones.
    """
    docs = docs.drop("score", "toxic_spans")
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("toxic_spans", spans)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            scores, found = np.empty(len(batch)), [[] for _ in range(len(batch))]
            for i, j in slices(offsets):
                own, base = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                tok = tokens(own, base)
                p, _, _ = marginals(chain.unary(tok.features), tok.sequence, chain.edges)
                scores[i:j] = 1 / (1 + np.exp(-np.clip(_aggregate(p, tok.first) @ chain.curve, -30, 30)))
                hits = np.flatnonzero(p >= threshold)
                for d in np.unique(np.searchsorted(tok.first, hits, "right") - 1):
                    here = hits[(hits >= tok.first[d]) & (hits < tok.first[d + 1])]
                    text = own[base[d] : base[d + 1]]
                    ends = code_points(text, np.stack([tok.start[here], tok.end[here]]) - base[d])
                    found[i + d] = [{"start": int(s), "end": int(e), "p": float(q)} for s, e, q in zip(*ends, p[here], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array(found, kind)], names=schema.names)

    return docs.mapInArrow(run, schema)
