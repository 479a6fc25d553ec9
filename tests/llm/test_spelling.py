"""Spelling variants: SQL (test_llm), brute force on words and on documents, blocks that are halved, odd rows."""

from __future__ import annotations

import collections
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import spelling as S

DOCS = "doc_id long, text string, word string, n int, size int, key int, a int, b int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5) for i, t in rows], DOCS)


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            n[low if h % 97 else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    root = {}
    for w in n:
        root[w] = w
        while form[root[w]]:
            root[w] = form[root[w]]
    return sorted(((w, form[w], root[w], n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abÿ", min_size=1, max_size=7), max_size=150, unique=True), st.integers(1, 7))
def test_bitsets_find_all_pairs(words, size):
    i, j = S.neighbours(words, size)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(
        (x, y) for x, a in enumerate(words) for y, b in enumerate(words) if len(a) == size and len(b) in (size, size + 1) and one_apart(a, b))


@pytest.mark.parametrize("block", [3, 2_048])
def test_variants_against_brute_force(spark, block):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcé") for _ in range(rnd.randrange(4, 9))) for _ in range(60)] + ["commonword", "z" * 3_000, "z" * 2_999 + "y", "q" * 40]
    words = [*base, *[w[:k] + w[k + 1 :] for w in base for k in (0, 2, len(w) - 1)], *[w[:k] + rnd.choice("abÿ") + w[k:] for w in base for k in (0, 3, len(w))]]
    rows = [(i, " ".join(rnd.choices(words, [1 + 7 * (i % 3) for i in range(len(words))], k=60)) + rnd.choice([".", " 7x ", "Ab×÷ÀÿĀcd"])) for i in range(120)]
    rows += [(i, "COMMONWORD,commonword " * 40) for i in range(30)] + [(3, "again again again"), (3, "again again again"), (None, "nobody nobody nobody"), (7, None), (8, ""), (9, "longtext " * 200_000)]
    got = S.variants(documents(spark, rows), block=block).collect()
    want = brute(rows)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert sum(r[1] is not None for r in want) > 40 and any(r[2] != r[1] and r[1] for r in want)


def test_parts_of_a_text_cut_no_run(monkeypatch):
    text = "alpha beta, gamma" * 50 + "x" * 100
    whole = S.runs(text)
    for part in (1, 7, 50):
        monkeypatch.setattr(S, "PART", part)
        assert S.runs(text) == whole


def test_empty_table(spark):
    assert S.variants(documents(spark, [(1, "x")]).limit(0)).collect() == [] and S.variants(documents(spark, [(1, "lonely words"), (2, None)])).collect() == []


def test_hot_keys_are_halved(spark):
    words = spark.createDataFrame([(f"prefix{a}{b}{c}suffix", 5) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"], "word string, n long")
    filed = S.filed(words, 20)
    assert filed.groupBy("key").count().agg({"count": "max"}).first()[0] <= 64  # two open letters of eight
    got = {(r.word, r.near) for r in S.pairs(words, 20).collect()}
    own = [r.word for r in words.collect()]
    assert got == {(a, b) for a in own for b in own if one_apart(a, b)}
