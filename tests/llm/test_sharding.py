"""Sharding by the weighted hash tree: SQL, the law of growth, movement under changed weights, slots, odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import sharding as S

DOCS = "doc_id long, text string, shard string, h int, n int, slot int, bucket int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4) for i, t in rows], DOCS)


def walked(tree, key):
    """The shard of an id by plain descent."""
    own = list(tree)
    for depth in range(3):
        weights = collections.Counter()
        for s in own:
            weights[S.path_of(s)[depth]] += s.weight
        draw = lambda n: -math.log((int(hashlib.md5(f"{S.SEED}|{n}|{key}".encode()).hexdigest()[: S.DIGITS], 16) + 0.5) / 16.0**S.DIGITS) / weights[n]
        best = min((n for n in weights if weights[n] > 0), key=draw)
        own = [s for s in own if S.path_of(s)[depth] == best]
    return own[0].number


def shards_of(spark, tree, n=20_000):
    return {r.doc_id: r.shard for r in S.place(spark.range(n).withColumnRenamed("id", "doc_id"), tree).select("doc_id", "shard").collect()}


def test_descent_is_the_plain_one(spark):
    tree = (*S.grid(), S.Shard(16, "g1", "r0", 2.5, 1), S.Shard(17, "g9", "r0", 0.5, 2))
    assert shards_of(spark, tree, 400) == {i: walked(tree, i) for i in range(400)}


def test_shares_follow_weights(spark):
    tree = tuple(s._replace(weight=1.0 + s.number % 3) for s in S.grid())
    found, total = collections.Counter(shards_of(spark, tree).values()), sum(s.weight for s in tree)
    for s in tree:
        assert abs(found[s.number] / 20_000 - s.weight / total) < 0.01


@pytest.mark.parametrize(("region", "rack"), [("g0", "r0"), ("g1", "r1"), ("g7", "r0")])
def test_one_more_shard_takes_rows_only_into_itself(spark, region, rack):
    tree = S.grid()
    for _ in range(3):  # also beside shards that were added before
        more = S.grown(tree, region, rack)
        before, after = shards_of(spark, tree), shards_of(spark, more)
        moved = [i for i in before if before[i] != after[i]]
        assert {after[i] for i in moved} == {more[-1].number} and abs(len(moved) / 20_000 - 1 / len(more)) < 0.01
        tree = more


def test_changed_weights_move_rows_between_changed_subtrees_only(spark):
    tree = S.grid(3)
    changed = tuple(s._replace(weight=3.0) if s.number == 5 else s for s in tree)  # in g0/r1
    before, after = shards_of(spark, tree), shards_of(spark, changed)
    place = {s.number: (s.region, s.rack) for s in tree}
    moved = [i for i in before if before[i] != after[i]]
    assert moved
    for i in moved:
        old, new = place[before[i]], place[after[i]]
        assert new[0] == "g0" and (old[0] != "g0" or new[1] == "r1")  # into the heavier region; inside of it, into the heavier rack
        assert old != ("g0", "r1") or after[i] == 5
    gone = tuple(s._replace(weight=0.0) if s.number == 5 else s for s in tree)
    assert 5 not in shards_of(spark, gone, 2_000).values()


def test_odd_rows_and_slots(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 50)
    monkeypatch.setattr(S, "COPIES", 7)
    rows = [(i, f"text é {i}") for i in range(600)] + [(7, "hot")] * 500 + [(8, "a"), (8, "b"), (8, None), (None, "n"), (None, None), (9, ""), (-3, "x" * 300_000)]
    docs = documents(spark, rows)
    got = S.assigned(docs).collect()
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), walked(S.grid(), "null" if i is None else i)) for i, t in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard) for r in got) == want
    for shard in range(16):
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own)))
    assert all(r.law == "key" and r.grown_shard in (r.shard, 16) for r in got) and any(r.grown_shard == 16 for r in got)
    assert sorted(S.assigned(docs.repartition(7)).collect(), key=repr) == sorted(got, key=repr)  # the input's partitions decide nothing
    assert S.assigned(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        S.place(docs, ())


def test_written_shards_hold_the_rows(spark):
    docs = documents(spark, [(i, f"t{i}") for i in range(200)] + [(1, "again"), (None, None)]).drop("shard")
    back = spark.read.parquet(S.write(docs, files=3))
    assert sorted(back.select(*docs.columns).collect(), key=repr) == sorted(docs.collect(), key=repr)
    assert back.where(F.col("doc_id") == 1).select("shard").distinct().count() == 1
