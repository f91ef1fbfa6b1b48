"""Operator 11 against lists of turns, in DuckDB and in plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from riskloom.llm import queries, tries


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    sha = lambda node: hashlib.sha256(",".join(str(c) for c in members[node] if len(whole[c]) == len(node)).encode()).hexdigest()
    return sorted((members[n][0], len(n), members[n[:-1]][0] if n else -1, len(members[n]), len(children[n]), leaves[n], saved[n], sha(n)) for n in members)


def found(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in tries.prefix_trie(df).collect())


def test_real_conversations(spark, sf_dir):
    got = sorted(map(str, queries.op11_prefix_trie(spark, sf_dir).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = con.execute(queries.ORACLE_SQL["op11_prefix_trie"])
    names = [c[0] for c in want.description]
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *tries.SUMS, "ends_sha256"]
    want = sorted("Row(" + ", ".join(f"{c}={r[names.index(c)]!r}" for c in columns) + ")" for r in want.fetchall())
    assert got == want


@pytest.mark.parametrize("stretch", [tries.STRETCH, 3])
def test_shared_heads_nulls_and_ties(spark, stretch, monkeypatch):
    monkeypatch.setattr(tries, "STRETCH", stretch)
    draw = random.Random(4)
    rows = []
    for c in [*range(0, 260), *range(-40, 0, 3), 1000, 1100, 5001]:
        length = draw.choice((1, 2, 3, 4, 5, 8, 9, 16, 21))
        rows += [(c, None if draw.random() < 0.1 else t, draw.choice(("user", None, "")), draw.choice(("a", "b", None, "", "päivää 😀"))) for t in range(length)]
    rows += [(7000 + k, t, "user", "same") for k in range(60) for t in range(12)]  # copies
    rows += [(3, 0, "user", "a"), (3, 0, "user", "a"), (None, 0, "user", "lost"), (None, 1, None, None)]
    assert found(spark, rows) == plain(rows)


def test_each_conversation_goes_on_where_another_ends(spark):
    """Chains that hang on chains, and one conversation with half of all turns."""
    rows = [(c, t, "user", f"t{t}" if t < c - 90_000 else f"own {c} {t}") for c in range(90_001, 90_040) for t in range(c - 90_000 + 2)]
    rows += [(90_100, t, "user", f"long {t % 7}") for t in range(900)]
    assert found(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == []
