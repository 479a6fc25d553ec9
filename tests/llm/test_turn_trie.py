"""The prefix trie of conversations: SQL (test_llm), brute force, list ranking in many rounds, odd rows."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import common
from loomgraph.llm import turn_trie as T

TURNS = "conv_id long, turn long, role string, text string, c long, depth int, node long, range int, _tie int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], TURNS)


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h, b = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(b, [])[:h] + ts[h:])
    members = collections.defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    return sorted(((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(p)).encode()).hexdigest()) for p, cs in members.items()), key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("base", [10, 100_000])
def test_trie_against_brute_force(spark, base, monkeypatch):
    monkeypatch.setattr(T, "STRETCH", 16)
    monkeypatch.setattr(T, "IDS", 3)
    rnd = random.Random(3)
    rows = []
    for c in [*range(90, 230), 400, 401, 455, 777, -5, -100, -130]:  # conversation 700 is absent; 400 is short
        for t in range(rnd.randrange(1, 9) if c != 400 else 2):
            rows.append((c, t if rnd.random() < 0.95 else None, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bc", "déf", "", None])))
    rows += [(300 + c, t, "user", "hot") for c in range(40) for t in range(7)] + [(500, t, "u", "x" * (t % 3)) for t in range(400)]
    rows += [(None, 1, "user", "nobody"), (99, 3, "user", "tie"), (99, 3, "user", "tie"), (98, 0, "u", "y" * 200_000)]
    assert rows_of(T.trie(conversations(spark, rows), base)) == brute(rows)


def test_empty_and_turnless(spark):
    assert T.trie(conversations(spark, [(1, 1, "u", "x")]).limit(0)).collect() == []
    assert T.trie(conversations(spark, [(None, 1, "u", "x")])).collect() == []
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)  # its one turn is replaced by those of an absent conversation
    rows = [(alone, 1, "u", "x")]
    assert rows_of(T.trie(conversations(spark, rows))) == brute(rows) and len(brute(rows)) == 1


def test_list_ranking_needs_no_order_of_ids(spark):
    ids = random.Random(4).sample(range(10**12), 3000)
    links = spark.createDataFrame(list(zip(ids, [*ids[1:], None], strict=True)), "id long, next long")
    assert {r.id: r.pos for r in T.ranked(links, 20).collect()} == {x: i for i, x in enumerate(ids)}
    one = spark.createDataFrame([(7, None)], "id long, next long")
    assert [(r.id, r.pos) for r in T.ranked(one).collect()] == [(7, 0)]


def test_prefix_sums_of_a_key_over_many_ranges(spark):
    rows = [("hot", i % 500, i % 7) for i in range(3000)] + [(f"k{i}", i, 1) for i in range(50)] + [("a", 1, 2)]
    got = common.prefix_sums(spark.createDataFrame(rows, "k string, t int, v int"), "k", [F.col("t")], {"s": F.col("v"), "n": F.lit(1)}, ["t", "v"]).collect()
    hot = sorted((r.n, r.t, r.v, r.s) for r in got if r.k == "hot")
    assert [n for n, *_ in hot] == list(range(1, 3001)) and [t for _, t, *_ in hot] == sorted(t for k, t, _ in rows if k == "hot")
    total = 0
    for _, _, v, s in hot:
        total += v
        assert s == total
    assert sorted((r.k, r.n, r.s) for r in got if r.k != "hot") == sorted([("a", 1, 2), *[(f"k{i}", 1, 1) for i in range(50)]])
