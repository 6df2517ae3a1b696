"""The prefix trie against a plain dictionary of prefixes, and against its SQL."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from wayfarer.llm import prefix_trie
from wayfarer.llm.queries import OP11_SQL, op11_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Node rows from (conv_id, turn, role, text), a node being a tuple of turns."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    for c in own:
        own[c].sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(*r[1:])))
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(r[1:] for r in own.get(c - c % 100, [])[:h] + own[c][h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {v: 0 for v in members}
    for v in members:
        if v:
            children[v[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for v, who in members.items():
        for d in range(len(v) + 1):
            leaves[v[:d]] += not children[v]
            saved[v[:d]] += (len(who) - 1) * len(v[-1][1]) if v else 0
    out = []
    for v, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if rebuilt[c] == v)
        out.append((min(who), len(v), min(members[v[:-1]]) if v else None, len(who), children[v], leaves[v], saved[v], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def talk(seed, n, most=9):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        c = c if r.random() < 0.8 else r.randrange(10**6)
        rows += [(c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(["a", "bb", "", None, "é"])) for t in range(r.randrange(1, most))]
    return rows


@pytest.mark.parametrize("block", [500_000, 7])
def test_random_conversations_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = talk(4, 230) + [(None, 1, "user", "lost"), (5, 3, "user", "again"), (5, 3, "user", "again")]
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_hot_conversation_hot_first_turn_and_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(100, t, "user", f"t{t}") for t in range(400)]
    rows += [(c, t, "user", x) for c in range(200, 300) for t, x in enumerate(["same", "same", f"own{c % 9}"])]
    rows += [(c, t, "user", "copy") for c in range(1000, 1100) for t in range(8)]
    rows += [(777, 0, "user", "short")]  # its base is absent: turnless if h > 0
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_sql_equals_brute_force_and_query(spark):
    con = duckdb.connect()
    con.execute("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    want = sorted((tuple(int(x) if isinstance(x, int) else x for x in r) for r in con.execute(OP11_SQL).fetchall()), key=str)
    df = op11_prefix_trie(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(df) == want == brute(rows)


def test_empty_table_clashing_columns_and_long_text(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(empty).collect() == []
    rows = [(1, 1, "user", "x" * 2_000_000), (2, None, None, None)]
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "2 AS name", "3 AS pid", "4 AS i", "5 AS size")
    assert got(prefix_trie.prefix_trie(clash)) == brute(rows)


def test_block_ranks_follow_the_tour():
    # a root with two children, the first of which has one: 0-(1,(2)),(3)
    block = {
        "conv_id": np.array([1, 1, 1, 5]),
        "depth": np.array([0, 1, 2, 1]),
        "parent_conv_id": np.array([prefix_trie.NONE, 1, 1, 1]),
        "child": np.array([1, 1, prefix_trie.NONE, prefix_trie.NONE]),
        "sibling": np.array([prefix_trie.NONE, 5, prefix_trie.NONE, prefix_trie.NONE]),
        "n_convs": np.array([3, 2, 1, 1]),
        "chars": np.array([0, 10, 4, 6]),
    }
    rows, links = prefix_trie.ranked_block(block)
    assert [int(x[0]) for x in links[:3]] == [1, 0, 0] and links[3].null_count == 1
    assert [int(x[0]) for x in links[6:]] == [8, 2, 10]
    leaves = rows[5] - rows[10]
    assert leaves.tolist() == [2, 1, 1, 1]
