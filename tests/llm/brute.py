"""Plain-Python versions of what the corpus operators compute, over rows held in memory."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(FOLD))


def held_out(doc_id, modulus: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


# --- operator 1 ----------------------------------------------------------------------------------


def kneser_ney(rows: list[tuple[int, str | None]], order: int = 3) -> list[tuple]:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) by dictionaries."""
    training = [words(t) + [None] for i, t in rows if held_out(i, 7) != 2]
    count = Counter(w for t in training for w in t)
    total, size = sum(count.values()), len(count)

    def grams(t):
        padded = ["<s>"] * (order - 1) + t
        return [tuple(padded[k : k + order]) for k in range(len(t))]

    # For each length, the counts: of the longest their own, of shorter ones the distinct words before them.
    counts = {order: Counter(g for t in training for g in grams(t))}
    for length in range(order - 1, 0, -1):
        counts[length] = Counter(g[1:] for g in counts[length + 1])
    follow = {length: defaultdict(list) for length in counts}
    for length, of in counts.items():
        for g, n in of.items():
            follow[length][g[:-1]].append(n)

    def discounts(values) -> tuple[float, float, float]:
        n = [sum(c == k for c in values) for k in (1, 2, 3, 4)]
        if min(n) <= 0:
            return 0.5, 1.0, 1.5
        y = n[0] / (n[0] + 2 * n[1])
        return tuple(min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.0), k + 1.0) for k in range(3))

    less = {length: (0.0, *discounts(list(of.values()))) for length, of in counts.items()}
    whole = {length: {c: sum(x) for c, x in of.items()} for length, of in follow.items()}
    left = {length: {c: sum(less[length][min(n, 3)] for n in x) for c, x in of.items()} for length, of in follow.items()}

    def p(g) -> float:
        if not g:
            return 1 / (size + 1)
        shorter, d, context = p(g[1:]), less[len(g)], g[:-1]
        if context not in whole[len(g)]:
            return shorter
        own = counts[len(g)][g]
        return (max(own - d[min(own, 3)], 0) + left[len(g)][context] * shorter) / whole[len(g)][context]

    out = []
    for i, t in rows:
        own = words(t) + [None]
        base = sum(math.log10((count[w] + 1) / (total + size + 1)) for w in own)
        score = sum(math.log10(p(g)) for g in grams(own))
        out.append((i, held_out(i, 7) == 2, len(own), sum(count[w] > 0 for w in own), total, base, score))
    return out


# --- operator 3 ----------------------------------------------------------------------------------


def mix_targets(sizes: dict) -> dict:
    """Water-filling: weights 1, 2, 3, repeating, in code-point order, null last; no target above 3 times its source."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > 3 * sizes[s]]
        if not over:
            return target | {s: share * weight[s] for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


# --- operator 5 ----------------------------------------------------------------------------------


def spark_hash(*values) -> int:
    """The engine's xxhash64 of values: bytes of 4 or 8 (integers) or of UTF-8, each seeded by the hash so far; None is passed over."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64(v if isinstance(v, bytes) else v.encode(), seed=seed).intdigest()
    return seed


def order_minhash(text: str | None, k: int = 3, bins: int = 64, width: int = 2, seed: int = 5) -> list[int]:
    """Entries by class: the ``width`` smallest occurrence-numbered k-word elements of the class, in text order, hashed as a tuple."""
    low, bits = (1 << 24) - 1, bins.bit_length() - 1
    signed = lambda x, n: x - (1 << n) if x >> (n - 1) else x
    own = re.split(r"[\x20\x09-\x0D]+", text or "")
    own = [x for w in own for x in (w if len(w) >= 24 else [w])]
    elements = [(spark_hash(seed.to_bytes(4, "little"), *own[i : i + k]) & ~low, i) for i in range(max(1, len(own) - k + 1))]
    seen, numbered = Counter(), []
    for e, i in elements:
        numbered.append((spark_hash(e.to_bytes(8, "little"), seen[e].to_bytes(4, "little")) & ~low, i))
        seen[e] += 1
    classes = defaultdict(list)
    for h, i in numbered:
        classes[signed(h, 64) >> (64 - bits)].append((h, i))
    out = []
    for kind in sorted(classes):
        least = sorted(classes[kind])[:width]
        mixed = spark_hash(*[(h >> 24).to_bytes(8, "little") for h, _ in sorted(least, key=lambda x: x[1])])
        entry = (least[0][0] >> (64 - bits) << (64 - bits)) | mixed >> bits
        out.append(entry >> 32)
    return out


def likeness(a: list[int], b: list[int], bins: int = 64) -> float:
    bits = bins.bit_length() - 1
    kinds = {e >> (32 - bits) for e in a} | {e >> (32 - bits) for e in b}
    return len(set(a) & set(b)) / max(1, len(kinds))


# --- operator 6 ----------------------------------------------------------------------------------


def shingles(text: str | None) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def link_components(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """(doc_id, n_shingles, component_id) by comparing all pairs of distinct sets."""
    sets = [shingles(t) for _, t in rows]
    distinct = list({s for s in sets if s})
    parent = {s: s for s in distinct}

    def root(s):
        while parent[s] is not s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    holders = defaultdict(list)
    for k, s in enumerate(distinct):
        shared = Counter(j for x in s for j in holders[x])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(distinct[j]) - n):
                parent[root(s)] = root(distinct[j])
        for x in s:
            holders[x].append(k)
    least: dict = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            least[root(s)] = min(least.get(root(s), i), i)
    return [(i, len(s), least.get(root(s), i) if s else i) for (i, _), s in zip(rows, sets, strict=True)]


# --- operator 7 ----------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
PLAIN = [("access", re.compile(r"AKIA[A-Z0-9]+"), 16), ("hex", re.compile(r"[0-9a-f]+"), 32)]


def base_secrets(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    for kind, pattern, least in PLAIN:
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end() - m.start() >= least]
    order = ["assign", "access", "hex"]
    return sorted(found, key=lambda x: (x[1], order.index(x[0])))


# --- operator 10 ---------------------------------------------------------------------------------


def remove_repeats(rows: list[tuple[int, str | None]], length: int = 100) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256); rows with equal doc_id and text are one document."""
    seen: set[bytes] = set()
    made: dict = {}
    for key in sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        data = key[1].encode()
        steps = [0] * (len(data) + 1)
        for a in range(len(data) - length + 1):
            window = data[a : a + length]
            if window in seen:
                steps[a] += 1
                steps[a + length] -= 1
            else:
                seen.add(window)
        gone, level = [], 0
        for x in steps[:-1]:
            level += x
            gone.append(level > 0)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        made[key] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return [(i, *made[i, t or ""]) for i, t in rows]
