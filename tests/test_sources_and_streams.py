import random

from pyspark.sql import functions as F

from loomgraph.operators import lifecycle as L
from loomgraph.operators import tables as B
from loomgraph.sources import exports, markdown
from loomgraph.streaming import journal as J


def pack(paras, budget=400):
    out, cur, size = [], [], 0.0
    for p in paras:
        n = len(p) / 2.5
        if size + n > budget and cur:
            out.append("\n\n".join(cur))
            cur, size = [cur[-1]], len(cur[-1]) / 2.5
        cur.append(p)
        size += n
    return out + ["\n\n".join(cur)]


def test_chunker_sections_and_packing(spark):
    rnd = random.Random(3)
    paras = ["x" * rnd.randrange(50, 900) for _ in range(12)]
    text = "intro text that is long enough\n# One\nshort body but long enough\n## Two\n" + "\n\n".join(paras)
    rows = markdown.chunk(spark.createDataFrame([("f", text)], "doc string, text string")).orderBy("section", "part").collect()
    want = ["intro text that is long enough", "## One\nshort body but long enough"] + ["## Two\n" + c for c in pack(paras)]
    assert [r["content"] for r in rows] == want
    assert [r["heading"] for r in rows][:3] == ["", "One", "Two"]


def test_vault_scan_skips_known_and_excluded(spark, tmp_path):
    (tmp_path / "02_portfolio").mkdir()
    (tmp_path / ".obsidian").mkdir()
    (tmp_path / "02_portfolio" / "a.md").write_text("# A\nsome words that are long enough")
    (tmp_path / "b.md").write_text("plain words")
    (tmp_path / "c.txt").write_text("not markdown")
    (tmp_path / ".obsidian" / "d.md").write_text("hidden")
    rows = markdown.read_vault(spark, str(tmp_path)).withColumn("project", markdown.guess_project(F.col("path"))).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["project"]) for r in rows) == [("a.md", "portfolio"), ("b.md", "")]
    known = spark.createDataFrame([(next(r for r in rows if r["path"].endswith("b.md"))["file_hash"],)], "file_hash string")
    assert markdown.read_vault(spark, str(tmp_path), known).count() == 1


def test_event_stream_keeps_first_arrivals(spark, tmp_path):
    rows = [("e1", "s", 1), ("e2", "s", 2), ("e1", "s", 3)]
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    spark.createDataFrame(rows, "event_id string, session_id string, n int").write.parquet(src)
    J.write_journal(J.dedup_events(J.read_log(spark, src, "event_id string, session_id string, n int")), out, ck).awaitTermination()
    spark.createDataFrame([("e2", "s", 9), ("e3", "s", 9)], "event_id string, session_id string, n int").write.mode("append").parquet(src)
    J.write_journal(J.dedup_events(J.read_log(spark, src, "event_id string, session_id string, n int")), out, ck).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == ["e1", "e2", "e3"]


def test_node_intake_is_content_addressed(spark, tmp_path):
    schema = "id bigint, type string, layer int, node_role string, content_hash string"
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    spark.createDataFrame([(1, "Signal", None, "", "h1"), (2, "Signal", None, "", "h1")], schema).write.parquet(src)
    J.intake_nodes(J.read_log(spark, src, schema), out, ck).awaitTermination()
    spark.createDataFrame([(3, "Tool", None, "", "h1"), (4, "Tool", None, "", "h2")], schema).write.mode("append").parquet(src)
    J.intake_nodes(J.read_log(spark, src, schema), out, ck).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 4]


def test_running_sprt_equals_batch(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(rnd.randrange(3), i, float(rnd.random() < (0.75 if i % 2 else 0.4)), i) for i in range(300)]
    schema = "id bigint, ts int, score double, seq int"
    src = str(tmp_path / "in")
    for part in range(3):
        spark.createDataFrame(rows[part * 100:(part + 1) * 100], schema).coalesce(1).write.mode("append").parquet(src)
    files = sorted((tmp_path / "in").glob("part-*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    assert len(files) == 3
    stream = J.running_sprt(J.read_log(spark, src, schema, files_per_trigger=1))
    q = (stream.writeStream.format("memory").queryName("sprt_out").outputMode("update")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["id"]: (r["verdict"], r["n_obs"]) for r in spark.table("sprt_out").collect()}  # in order: the last batch counts
    log = spark.createDataFrame([(n, t, s, q_) for n, t, s, q_ in rows], "node_id bigint, ts int, score double, id int")
    want = {r["id"]: (r["v"], r["n"]) for r in L.score_history(log).select(
        "id", L.sprt_verdict(F.col("history")).alias("v"), F.size("history").alias("n")).collect()}
    assert got == want


def test_upsert_keeps_named_columns(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, project string, v string")
    new = spark.createDataFrame([(2, "zz", "n"), (3, "c", "m")], "k int, project string, v string")
    got = {r["k"]: (r["project"], r["v"]) for r in B.upsert(old, new, ["k"], keep=["project"]).collect()}
    assert got == {1: ("a", "x"), 2: ("b", "n"), 3: ("c", "m")}


def test_json_lines(spark):
    n = spark.createDataFrame([(7, "text", None, ["k1", "k2"], "active", 0.5)],
                              "id bigint, content string, summary string, key_concepts array<string>, status string, quality_score double")
    line = exports.json_lines(n).first()["value"]
    assert '"id":"node_7"' in line and "text | [concepts] k1, k2" in line


def test_review_tally(spark):
    df = spark.createDataFrame([("[A] fine\n[B] no\n  [A] again\nnot [A]",)], "sheet string")
    from loomgraph.operators.traits import tally
    assert df.select(tally(F.col("sheet"), "A")).first()[0] == 2


def test_judged_queries_and_catalog_files(spark, tmp_path):
    from loomgraph.sources import catalog
    (tmp_path / "g.yaml").write_text("queries:\n- {id: q1, query: one, relevant_ids: [1, 2], also_relevant: [3]}\n- {id: q2, query: two}\n")
    (tmp_path / "c.yaml").write_text("node_types:\n  Signal: {description: s}\nrelation_types:\n  led_to: {description: r}\n")
    got = {(r["qid"], r["node_id"], r["grade"]) for r in catalog.judged_queries(spark, str(tmp_path / "g.yaml")).collect()}
    assert got == {("q1", 1, 1.0), ("q1", 2, 1.0), ("q1", 3, 0.5)}
    types, rels = catalog.declared_catalog(spark, str(tmp_path / "c.yaml"))
    assert [tuple(r) for r in types.collect()] == [("Signal", "s")] and [tuple(r) for r in rels.collect()] == [("led_to", "r")]


def test_catalog_sync_actions(spark):
    d = spark.createDataFrame([("a", "new"), ("b", "x"), ("c", "x")], "name string, description string")
    st = spark.createDataFrame([("b", "old", "active"), ("c", "x", "deprecated"), ("d", "x", "active")], "name string, description string, status string")
    run = lambda again: {r["name"]: r["action"] for r in L.sync_catalog(d, st, again).collect()}
    assert run(True) == {"a": "insert", "b": "update", "c": "reactivate", "d": "deprecate"}
    assert run(False)["c"] == "none"
