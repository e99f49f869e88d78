"""Conversation tries against a plain one, node tables against dictionaries, the query against its SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from dirwise.llm import prefix_trie, queries


def plain_trie(table):
    """Nodes by conv_id, depth, parent, members, children, leaves, saved words and ends, in plain Python."""
    order = lambda x: (x[1] is not None, x[1] or 0, hashlib.md5(f"{len(x[2] or '')}:{x[2] or ''}{x[3] or ''}".encode()).digest())
    own = defaultdict(list)
    for row in sorted((r for r in table if r[0] is not None), key=order):
        own[row[0]].append((row[2] or "", row[3] or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, held in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(held) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
    ends = lambda node: ",".join(map(str, sorted(c for c in members[node] if len(built[c]) == len(node))))
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(ends(n).encode()).hexdigest()) for n, m in members.items()
    )


def own_trie(spark, table):
    docs = spark.createDataFrame([(*r, 1, "x") for r in table], "conv_id long, turn long, role string, text string, pos int, hi string")
    got = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(docs))).drop("node").collect()
    return sorted(tuple(-1 if x is None else x for x in r) for r in got)


def test_tries_match_a_plain_one(spark):
    rng = random.Random(1)
    roles = ["user", "assistant", None]
    table = []
    for c in range(300):
        table += [(c, t, rng.choice(roles), rng.choice(["a b", "c", "", None, "d\te  f"])) for t in range(rng.randint(1, 7))]
    table += [(1000 + c, t, "user", f"same turn {t}") for c in range(100) for t in range(4)]  # a third are copies
    table += [(2000, t, "user", "long") for t in range(600)] + [(2001, t, "user", "long") for t in range(560)]  # long, over several stretches
    table += [(None, 1, "user", "no id"), (7, None, "user", "null first"), (7, 0, "user", "a tie"), (7, 0, "user", "a tie"), (-5, 1, "user", "x")]
    table += [(3000 + c, 1, "user", "short of its head") for c in range(40) if c % 20]  # bases that are absent
    assert own_trie(spark, table) == plain_trie(table)


def test_small_shards_and_stretches_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 3)
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", 20)
    rng = random.Random(2)
    table = [(c, t, "user", rng.choice(["a b c", "d"])) for c in range(60) for t in range(rng.randint(1, 12))]
    table += [(c, t, "user", "d") for c in range(60, 90) for t in range(20)]
    assert own_trie(spark, table) == plain_trie(table)


def test_empty_and_odd_tables(spark):
    assert own_trie(spark, [(None, 1, "a", "b")]) == []
    assert own_trie(spark, [(5, None, None, None)]) == plain_trie([(5, None, None, None)])
    odd = [(5, 1, "user", "É Σ İ 日本 \x00 😀"), (6, 1, "user", "word " * 60_000), (25, 2, "user", "word " * 60_000)]
    assert own_trie(spark, odd) == plain_trie(odd)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 100_000])
def test_slots_are_minimal_and_verified(n):
    rng = np.random.default_rng(n)
    hi, lo = rng.integers(-(2**63), 2**63 - 1, (2, n)), None
    hi, lo = hi[0], hi[1]
    table = prefix_trie.NodeTable(hi, lo)
    assert sorted(table.find(hi, lo)) == list(range(n))
    assert (table.find(hi + 1, lo) == -1).all() and (table.find(hi, lo ^ 1) == -1).all()


def test_one_digest_for_two_prefixes_is_told(spark):
    rows = spark.createDataFrame([(1, 1, 5, 5, 1, 9, 9, 0, 0), (2, 1, 5, 6, 1, 9, 9, 0, 0)], "conv_id long, pos long, mark_hi long, mark_lo long, words long, hi long, lo long, up_hi long, up_lo long")
    with pytest.raises(Exception, match="one digest"):
        prefix_trie._nodes(rows).collect()


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    cur = con.execute(queries.ORACLES["op12_prefix_trie"])
    cols = [d[0] for d in cur.description]
    got = queries.QUERIES["op12_prefix_trie"](spark, sf)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r[c] for c in cols)) for r in got.collect())
