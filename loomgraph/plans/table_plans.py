"""Scans, lookups, writes, text sources and windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph import ontology as O
from loomgraph.fixtures import AS_OF
from loomgraph.functions import text as X
from loomgraph.operators import graph as G
from loomgraph.operators import tables as B
from loomgraph.operators.curation import item_role, skip_item
from loomgraph.operators.lifecycle import sync_catalog
from loomgraph.operators.scale import carry_previous
from loomgraph.operators.snapshots import read_days, write_days
from loomgraph.operators.vector_store import VectorStore
from loomgraph.plans.registry import query
from loomgraph.plans.sqlparts import quoted
from loomgraph.session import shared_folder
from loomgraph.sources import catalog, exports, markdown


@query("src02_lookup", "SRC2 SRC3 FLT2", "nodes", """SELECT id, type, project FROM nodes WHERE status = 'active' AND content_hash IN (SELECT content_hash FROM nodes WHERE node_role = 'knowledge_core')""")
def src02(t):
    return B.by_hash(t.nodes, t.nodes.where("node_role = 'knowledge_core' AND content_hash IS NOT NULL")).select("id", "type", "project")


@query("src05_markdown_chunks", "SRC5", "", r"""WITH RECURSIVE d AS (SELECT doc_id AS doc, lang, regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '^\s+|\s+$', '', 'g') AS body FROM documents),
p AS (SELECT doc, lang, length(body) AS bl, list_transform(string_split_regex(body, '\n\n+'), lambda x: length(x)) AS ls FROM d WHERE body <> ''),
walk AS (SELECT doc, lang, ls, 1 AS i, 0 AS part, ls[1] / 2.5 AS sz, ls[1] AS chars FROM p WHERE bl / 2.5 > 400
 UNION ALL SELECT doc, lang, ls, i + 1, CASE WHEN sz + ls[i + 1] / 2.5 > 400 THEN part + 1 ELSE part END, CASE WHEN sz + ls[i + 1] / 2.5 > 400 THEN ls[i] / 2.5 + ls[i + 1] / 2.5 ELSE sz + ls[i + 1] / 2.5 END,
  CASE WHEN sz + ls[i + 1] / 2.5 > 400 THEN ls[i] + 2 + ls[i + 1] ELSE chars + 2 + ls[i + 1] END FROM walk WHERE i < len(ls)),
u AS (SELECT doc, lang, part, arg_max(chars, i) AS chars FROM walk GROUP BY 1, 2, 3 UNION ALL SELECT doc, lang, 0, bl FROM p WHERE bl / 2.5 <= 400)
SELECT doc, part, lang AS heading, chars + length(lang) + 4 AS chars FROM u WHERE chars + length(lang) + 4 >= 20""")
def src05(t):
    text = F.concat(F.lit("## "), F.col("lang"), F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")))
    docs = t.base("documents").select(F.col("doc_id").alias("doc"), text.alias("text"))
    return markdown.chunk(docs).select("doc", "part", "heading", F.length("content").cast("bigint").alias("chars"))


@query("src07_same_file_edges", "SRC7", "captures", """SELECT c.rn AS source_id, f.rn AS target_id, 'part_of' AS relation, CAST(0.7 AS DOUBLE) AS strength FROM (SELECT conv_id * 1000 + turn AS rn, conv_id FROM conversations) c
JOIN (SELECT conv_id, min(conv_id * 1000 + turn) AS rn FROM conversations GROUP BY conv_id) f ON f.conv_id = c.conv_id WHERE c.rn <> f.rn""")
def src07(t):
    return markdown.same_file_edges(t.base("conversations").selectExpr("conv_id AS doc", "conv_id * 1000 + turn AS id"))


@query("src08_catalog_sync", "LC24 SO4", "edges", f"""WITH d AS (SELECT DISTINCT unnest([{quoted(O.SCHEMA_RELATIONS)}]) AS name), s AS (SELECT relation AS name, CASE WHEN relation < 'd' THEN 'deprecated' ELSE 'active' END AS status FROM edges GROUP BY relation)
SELECT coalesce(d.name, s.name) AS name, CASE WHEN s.name IS NULL THEN 'insert' WHEN d.name IS NULL AND s.status = 'active' THEN 'deprecate' WHEN d.name IS NULL THEN 'none' WHEN s.status = 'deprecated' THEN 'reactivate' ELSE 'none' END AS action
FROM d FULL JOIN s ON s.name = d.name""")
def src08(t):
    declared = t.spark.createDataFrame([(r, "") for r in O.SCHEMA_RELATIONS], "name string, description string")
    stored = t.edges.select("relation").distinct().select(
        F.col("relation").alias("name"), F.lit("").alias("description"), F.when(F.col("relation") < "d", "deprecated").otherwise("active").alias("status"))
    return sync_catalog(declared, stored, reactivate=True)


@query("snk01_insert_nodes", "SNK1 MX4", "nodes", """WITH old AS (SELECT * FROM nodes WHERE node_role = 'knowledge_core'), inc AS (SELECT * FROM nodes WHERE node_role <> 'knowledge_core'),
o AS (SELECT i.*, coalesce((SELECT min(x.id) FROM old x WHERE x.content_hash = i.content_hash), (SELECT min(y.id) FROM inc y WHERE y.content_hash = i.content_hash AND y.id < i.id)) AS own FROM inc i)
SELECT id, CASE WHEN own IS NULL THEN 'inserted' ELSE 'duplicate' END AS outcome, own AS existing_id, layer, CASE WHEN node_role = '' THEN 'knowledge_candidate' ELSE node_role END AS node_role FROM o""")
def snk01(t):
    core = F.col("node_role") == "knowledge_core"
    return B.insert_nodes(t.nodes.where(core), t.nodes.where(~core))


@query("snk02_insert_edges", "SNK2", "edges", f"""SELECT id, relation AS asked, CASE relation WHEN 'realizes' THEN 'expressed_as' WHEN 'influences' THEN 'correlated_with' ELSE relation END AS stored, relation IN ('realizes', 'influences') AS corrected FROM edges""")
def snk02(t):
    return B.insert_edges(t.edges)


@query("mx02_correction_rows", "MX2", "edges", f"""SELECT CAST(0 AS BIGINT) AS node_id, id AS edge_id, 'relation' AS field, relation AS old_value, CASE relation WHEN 'realizes' THEN 'expressed_as' ELSE 'correlated_with' END AS new_value,
 'canonical relation' AS reason, 'system' AS corrected_by, TIMESTAMP '{AS_OF}' AS created_at FROM edges WHERE relation IN ('realizes', 'influences')""")
def mx02(t):
    return B.correction_rows(t.edges, AS_OF)


@query("snk05_count_up", "SNK5 2.10-Cast", "recall_log", r"""WITH old AS (SELECT query AS key, CASE query WHEN 'view' THEN 'n/a' WHEN 'click' THEN ' 12x' ELSE CAST(count(*) AS VARCHAR) END AS value FROM recall_log WHERE query <> 'error' GROUP BY query),
new AS (SELECT query AS key, count(*) AS n FROM recall_log WHERE query <> 'signup' GROUP BY query)
SELECT coalesce(o.key, n.key) AS key, CASE WHEN n.n IS NULL THEN o.value ELSE CAST(coalesce(TRY_CAST(regexp_extract(coalesce(o.value, ''), '^\s*([+-]?\d+)', 1) AS BIGINT), 0) + n.n AS VARCHAR) END AS value FROM old o FULL JOIN new n ON n.key = o.key""")
def snk05(t):
    log = t.recall_log.select(F.col("query").alias("key"))
    value = F.when(F.col("key") == "view", "n/a").when(F.col("key") == "click", " 12x").otherwise(F.col("n").cast("string"))
    old = log.where("key <> 'error'").groupBy("key").agg(F.count("*").alias("n")).select("key", value.alias("value"))
    return B.count_up(old, log.where("key <> 'signup'"))


@query("gr10_hub_snapshot", "GR10", "nodes edges", """WITH s AS (SELECT n.id AS node_id, count(e.id) AS ihs_score FROM nodes n LEFT JOIN edges e ON e.target_id = n.id WHERE n.status = 'active' GROUP BY n.id ORDER BY 2 DESC, 1 LIMIT 20)
SELECT node_id, ihs_score - 1 AS ihs_score, '2024-04-30' AS snapshot_date FROM s UNION ALL SELECT node_id, ihs_score, '2024-05-01' FROM s""")
def gr10(t):
    from loomgraph.operators.graph import in_degree
    top = in_degree(t.nodes, t.edges, 20).select(F.col("id").alias("node_id"), "ihs_score")
    day = lambda score, d: top.select("node_id", score.alias("ihs_score"), F.lit(d).alias("snapshot_date"))
    path, schema = f"{shared_folder(t.spark)}/hub-days-{uuid.uuid4().hex}", "node_id bigint, ihs_score bigint, snapshot_date string"
    write_days(day(F.col("ihs_score") - 1, "2024-04-30").unionAll(day(F.col("ihs_score") + 7, "2024-05-01")), path)
    for _ in range(2):  # the second day is written anew; once more changes nothing
        write_days(day(F.col("ihs_score"), "2024-05-01"), path)
    return read_days(t.spark, path, schema)


@query("snk03_upsert_counters", "SNK3 MX3", "recall_log", """WITH old AS (SELECT query AS key, count(*) AS value FROM recall_log WHERE ts < TIMESTAMP '2024-01-20' AND query <> 'error' GROUP BY 1), new AS (SELECT query AS key, count(*) AS value FROM recall_log WHERE ts >= TIMESTAMP '2024-01-20' AND query <> 'view' GROUP BY 1)
SELECT coalesce(n.key, o.key) AS key, coalesce(n.value, o.value) AS value FROM old o FULL JOIN new n ON n.key = o.key""")
def snk03(t):
    late = F.col("ts") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    old = t.recall_log.where(~late & (F.col("query") != "error")).groupBy(F.col("query").alias("key")).agg(F.count("*").alias("value"))
    new = t.recall_log.where(late & (F.col("query") != "view")).groupBy(F.col("query").alias("key")).agg(F.count("*").alias("value"))
    return B.upsert(old, new, ["key"])


@query("snk04_upsert_sessions", "SNK4", "sessions", """WITH new AS (SELECT session_id, 'later' AS project, upper(summary) AS summary, TIMESTAMP '2024-06-01' AS started_at FROM sessions WHERE active_pipeline <> '' UNION ALL SELECT 'x' || session_id, 'fresh', 'new', TIMESTAMP '2024-06-01' FROM sessions WHERE summary = '')
SELECT coalesce(n.session_id, o.session_id) AS session_id, coalesce(o.project, n.project) AS project, CASE WHEN n.session_id IS NOT NULL THEN n.summary ELSE o.summary END AS summary, coalesce(o.started_at, n.started_at) AS started_at FROM sessions o FULL JOIN new n ON n.session_id = o.session_id""")
def snk04(t):
    s = t.sessions.select("session_id", "project", "summary", "started_at", "active_pipeline")
    stamp = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz").alias("started_at")
    again = s.where("active_pipeline <> ''").select("session_id", F.lit("later").alias("project"), F.upper("summary").alias("summary"), stamp)
    fresh = s.where("summary = ''").select(F.concat(F.lit("x"), "session_id").alias("session_id"), F.lit("fresh").alias("project"), F.lit("new").alias("summary"), stamp)
    return B.upsert(s.drop("active_pipeline"), again.unionAll(fresh), ["session_id"], keep=["project", "started_at"])


@query("snk06_export_graph", "SNK6 FLT1 FLT2", "nodes edges", """WITH n AS (SELECT * FROM nodes WHERE status = 'active' AND type IN ('Decision', 'Pattern', 'Insight', 'Failure', 'Question'))
SELECT 'node' AS kind, id, CAST(NULL AS BIGINT) AS source_id, CAST(NULL AS BIGINT) AS target_id FROM n UNION ALL SELECT 'edge', id, source_id, target_id FROM edges WHERE status = 'active' AND source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)""")
def snk06(t):
    n, e = B.export_graph(t.nodes, t.edges, types=["Decision", "Pattern", "Insight", "Failure", "Question"])
    null = F.lit(None).cast("bigint")
    return n.select(F.lit("node").alias("kind"), "id", null.alias("source_id"), null.alias("target_id")).unionAll(
        e.select(F.lit("edge").alias("kind"), "id", "source_id", "target_id"))


@query("snk07_export_lines", "SNK7", "nodes", """SELECT 'node_' || id AS id, concat_ws(' | ', nullif(content, ''), '[summary] ' || nullif(summary, ''), '[concepts] ' || array_to_string(key_concepts, ', ')) AS search_text FROM nodes WHERE status <> 'deleted' AND quality_score >= 0.5""")
def snk07(t):
    rows = exports.export_rows(t.nodes, min_quality=0.5)
    return rows.select(F.concat(F.lit("node_"), F.col("id").cast("string")).alias("id"), "search_text")


@query("snk10_dirty_topics", "SNK10", "nodes", "SELECT DISTINCT lower(trim(project)) AS topic, id AS node_id FROM nodes WHERE status = 'active' AND lower(trim(project)) <> 'src3'")
def snk10(t):
    return B.clear_topics(B.dirty_topics(G.active(t.nodes)), ["src3"])


@query("flt03_text_filter", "FLT3 FLT5", "nodes", "SELECT id FROM nodes WHERE contains(lower(coalesce(content, '')), 'tion') OR contains(lower(coalesce(summary, '')), 'tion') OR contains(lower(tags), 'tion')")
def flt03(t):
    return B.text_filter(t.nodes, "tion", ["content", "summary", "tags"]).select("id")


@query("flt17_type_validation", "FLT17 FLT18", "nodes", f"""WITH v AS (SELECT id, CASE WHEN layer = 0 THEN lower(type) WHEN layer = 3 THEN 'Workflow' ELSE type END AS type FROM nodes), d AS (SELECT unnest([{quoted(O.ACTIVE_TYPES)}]) AS name)
SELECT v.id, v.type, v.type IN (SELECT name FROM d) AS valid, CASE WHEN v.type = 'Workflow' THEN 'Pattern' ELSE (SELECT name FROM d WHERE lower(name) = lower(v.type)) END AS corrected FROM v""")
def flt17(t):
    seen = F.when(F.col("layer") == 0, F.lower("type")).when(F.col("layer") == 3, "Workflow").otherwise(F.col("type"))
    return B.validate_types(t.nodes.select("id", seen.alias("type")), catalog.type_defs(t.spark, {"Workflow": "Pattern"}))


@query("jn20_project_isolated", "JN20 TK5", "nodes edges", """WITH a AS (SELECT * FROM edges WHERE status = 'active'), x AS (SELECT source_id AS i, target_id AS j FROM a UNION ALL SELECT target_id, source_id FROM a)
SELECT id, type, visit_count FROM nodes n WHERE status = 'active' AND type IN ('Principle', 'Pattern', 'Insight', 'Decision', 'Failure', 'Goal', 'Identity', 'Signal') AND project <> ''
 AND NOT EXISTS (SELECT 1 FROM x JOIN nodes m ON m.id = x.j WHERE x.i = n.id AND m.project <> '' AND m.project <> n.project)
ORDER BY type IN ('Principle', 'Pattern', 'Insight') DESC, visit_count DESC NULLS LAST, id LIMIT 200""")
def jn20(t):
    kinds = ["Principle", "Pattern", "Insight", "Decision", "Failure", "Goal", "Identity", "Signal"]
    return B.project_isolated(t.nodes, t.edges, kinds, kinds[:3]).select("id", "type", "visit_count")


@query("wn03_previous_session", "WN3 MX5", "sessions", "SELECT id, session_id, lag(id) OVER (PARTITION BY project ORDER BY started_at, id) AS previous_id FROM sessions")
def wn03(t):
    s = t.sessions.select("id", "session_id", "project", "started_at")
    out = carry_previous(s, "project", F.date_trunc("day", F.col("started_at").cast("timestamp")), ["started_at", "id"], "id", "previous_id")
    return out.select("id", "session_id", "previous_id")


@query("mx05_session_save", "MX5 FLT13 FLT14", "captures", """WITH c AS (SELECT id, session_id, trim(content) AS x FROM captures WHERE actor = 'owner' AND trim(content) <> '')
SELECT id, session_id, CASE WHEN contains(x, '?') THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS strength, CASE WHEN contains(x, '?') THEN 'Question' ELSE 'Decision' END AS type, length(x) < 40 AS short FROM c""")
def mx05(t):
    rows = t.captures.where((F.col("actor") == "owner") & ~skip_item(F.col("content")))
    kind = F.when(F.contains(F.trim("content"), F.lit("?")), "Question").otherwise("Decision")
    role = item_role(F.col("content"), kind)
    return rows.select("id", "session_id", F.when(kind == "Question", 0.8).otherwise(0.9).alias("strength"), kind.alias("type"),
                       ((F.length(F.trim("content")) < 40) & (role == "work_item")).alias("short"))


@query("fn01_text_functions", "RET2 RET20", "nodes", """SELECT id, substr(sha256(content), 1, 16) AS short_hash, sha1(trim(content)) AS signature, sha1(trim(regexp_replace(content, '\\s+', ' ', 'g'))) AS normal_hash,
 greatest(1, length(content) // 2) AS tokens, round(length(content) / 2.5, 6) AS rough_tokens, list_filter(list_transform(string_split(tags, ','), lambda x: lower(trim(x))), lambda x: x <> '') AS tag_list FROM nodes WHERE trim(content) <> ''""")
def fn01(t):
    c = F.col("content")
    return t.nodes.where(F.trim(c) != "").select(
        "id", F.substring(F.sha2(c, 256), 1, 16).alias("short_hash"), X.content_signature(c, F.col("id")).alias("signature"),
        F.sha1(X.squeeze(c)).alias("normal_hash"), X.tokens_estimate(c).alias("tokens"), F.round(F.length(c) / 2.5, 6).alias("rough_tokens"),
        X.csv_list(F.col("tags")).alias("tag_list"))


@query("fn02_embedding_texts", "2.10-embedding-text", "nodes", """SELECT id, concat_ws(chr(10), '[' || type || ' | ' || project || ']', CASE WHEN coalesce(trim(summary), '') <> '' THEN trim(summary) ELSE nullif(trim(content), '') END,
 CASE WHEN coalesce(trim(summary), '') <> '' AND length(trim(content)) > length(trim(summary)) * 2 THEN trim(substr(trim(content), 1, 200)) END,
 'Keywords: ' || nullif(array_to_string(list_filter(list_transform(key_concepts, lambda x: trim(x)), lambda x: x <> ''), ', '), '')) AS full_text,
 concat_ws(chr(10), '[' || type || ']', nullif(summary, ''), nullif(array_to_string(key_concepts, ', '), ''), nullif(substr(content, 1, 200), '')) AS compact_text FROM nodes""")
def fn02(t):
    cols = [F.col(c) for c in ("content", "summary", "key_concepts", "type", "project")]
    return t.nodes.select("id", X.embed_text(*cols).alias("full_text"), X.embed_text_compact(*cols[:4]).alias("compact_text"))


@query("mx01_vector_stats", "MX1", "", "SELECT count(*) AS vectors, min(len(embedding)) AS least_dim, max(len(embedding)) AS most_dim, CAST(sum(len(embedding)) * 4 AS BIGINT) AS bytes FROM embeddings")
def mx01(t):
    return t.embeddings.agg(F.count("*").alias("vectors"), F.min(F.size("embedding")).cast("bigint").alias("least_dim"),
                            F.max(F.size("embedding")).cast("bigint").alias("most_dim"), (F.sum(F.size("embedding")) * 4).alias("bytes"))


# vectors that point one way are replaced by their half, those that point another way are removed, and every first one comes again as a new id
CHANGED = """e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), top AS (SELECT max(id) + 1 AS m FROM e),
put AS (SELECT id, list_transform(v, lambda x: x / 2) AS v FROM e WHERE v[1] > 0.1 UNION ALL SELECT id + m, v FROM e, top WHERE v[2] > 0.1),
gone AS (SELECT id FROM e WHERE v[3] > 0.1),
now AS (SELECT * FROM put UNION ALL SELECT * FROM e WHERE id NOT IN (SELECT id FROM put)), left_ AS (SELECT * FROM now WHERE id NOT IN (SELECT id FROM gone))"""


def _changed_vectors(t):
    store = VectorStore.create(t.embeddings)
    v = lambda i: F.element_at("embedding", i)
    more = t.embeddings.agg((F.max("id") + 1).alias("m")).first()["m"] or 0
    halved = t.embeddings.where(v(1) > 0.1).select("id", F.transform("embedding", lambda x: x / 2).alias("embedding"))
    fresh = t.embeddings.where(v(2) > 0.1).select((F.col("id") + more).alias("id"), "embedding")
    return store.put(halved.unionByName(fresh)).remove(t.embeddings.where(v(3) > 0.1).select("id"))


@query("mx01_vector_changes", "MX1", "", f"WITH {CHANGED} SELECT id, len(v) AS dim, round(v[1], 5) AS first, round(list_sum(v), 4) AS total FROM left_")
def mx01_changes(t):
    rows = _changed_vectors(t).rows()  # the log is merged when it is read
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("id", F.size("embedding").cast("bigint").alias("dim"), F.round(F.element_at("embedding", 1).cast("double"), 5).alias("first"), F.round(total, 4).alias("total"))


@query("mx01_vector_reload", "MX1", "", f"WITH {CHANGED} SELECT count(*) AS vectors, min(len(v)) AS least_dim, max(len(v)) AS most_dim, CAST(sum(len(v)) * 4 AS BIGINT) AS bytes FROM left_")
def mx01_reload(t):
    store = _changed_vectors(t).compact()
    return VectorStore.open(t.spark, store.path).stats()
