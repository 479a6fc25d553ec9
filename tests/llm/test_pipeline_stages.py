"""Every stage of the pipeline on clashing columns, odd rows and empty tables; the posteriors of the quality stage against plain SQL."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from loomgraph.llm import common, quality  # noqa: E402

SMALL = "/root/testdata/sf0.001"
NAMES = ["_row", "__row", "_mix_row", "_own", "_path", "_score", "_global", "_h", "_p", "_pass", "_parts", "_words", "_all", "_drawn", "node", "row", "component_id", "digest", "n", "h", "k", "i", "text_sha256"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 40)) for _ in range(30)]
    texts += [texts[0], None, "", " ", "word " * 60_000, texts[1] + " end", "one two three."]
    rows = [(i, t, "en", ["web", "book", None][i % 3], len(t or ""), *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(texts)]
    rows.append(rows[2])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_keeps_other_columns(spark, table, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    after = stage(spark, table, SMALL)
    if name == "tokens":
        assert {r.doc_id for r in after.collect()} == {r.doc_id for r in table.collect()}
    else:
        assert after.columns == table.columns
        got = after.collect()
        assert len(got) > 5
        for r in got:  # whatever stays has its own values
            assert [r[n] for n in NAMES] == [f"{n}{r.doc_id}" for n in NAMES]
    assert stage(spark, table.limit(0), SMALL).collect() == []


def test_whole_chain_of_odd_rows(spark, table):
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.frozen(stage(spark, docs, SMALL), name)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in docs.collect()} and last


def test_path_rates_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: r for r in quality.verdicts(docs, labels, "doc_id").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE own (doc_id BIGINT, own DOUBLE)")
    con.executemany("INSERT INTO own VALUES (?, ?)", [(i, r._own) for i, r in got.items()])
    want = con.execute(f"""
WITH e AS (
  SELECT doc_id, own, source AS h, lang AS p, coalesce(y::DOUBLE, 1 / (1 + exp(-own))) AS rate
  FROM '{folder}/documents.parquet' JOIN own USING (doc_id) LEFT JOIN (SELECT doc_id, min(quality) AS y FROM '{folder}/labels.parquet' WHERE quality IS NOT NULL GROUP BY 1) USING (doc_id)
), g AS (SELECT (sum(rate) + 0.5) / (count(*) + 1.0) AS base FROM e),
hosts AS (SELECT h, count(*)::DOUBLE AS n, sum(rate) AS good FROM e GROUP BY h),
ha AS (SELECT sum(n * (good / n - base) ** 2) AS wide, sum(base * (1 - base)) AS chance, sum(n) AS n, sum(n * base * (1 - base)) AS spread FROM hosts, g),
a AS (SELECT CASE WHEN (wide - chance) / n > 0 THEN least(1e6, greatest(1.0, spread / n / ((wide - chance) / n) - 1)) ELSE 1e6 END AS a FROM ha),
host AS (SELECT h, (a * base + good) / (a + n) AS host FROM hosts, g, a),
paths AS (SELECT e.h, p, count(*)::DOUBLE AS n, sum(rate) AS good, any_value(host) AS host FROM e JOIN host ON e.h IS NOT DISTINCT FROM host.h GROUP BY e.h, p),
pb AS (SELECT sum(n * (good / n - host) ** 2) AS wide, sum(host * (1 - host)) AS chance, sum(n) AS n, sum(n * host * (1 - host)) AS spread FROM paths),
b AS (SELECT CASE WHEN (wide - chance) / n > 0 THEN least(1e6, greatest(1.0, spread / n / ((wide - chance) / n) - 1)) ELSE 1e6 END AS b FROM pb),
r AS (SELECT doc_id, own, least(greatest((b * host + good - rate) / (b + n - 1), 1e-6), 1 - 1e-6) AS path, base FROM e JOIN paths ON e.h IS NOT DISTINCT FROM paths.h AND e.p IS NOT DISTINCT FROM paths.p, b, g)
SELECT doc_id, path, 1 / (1 + exp(-(own + ln(path / (1 - path)) - ln(base / (1 - base))))) FROM r""").fetchall()
    assert len(want) == len(got) > 900
    for i, path, score in want:
        assert got[i]._path == pytest.approx(path, abs=1e-9) and got[i]._score == pytest.approx(score, abs=1e-9)
