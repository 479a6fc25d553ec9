"""Retrieval queries: three requests over the whole corpus, in one plan each."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph import ontology as O
from loomgraph.fixtures import AS_OF, Tables
from loomgraph.functions import text as T
from loomgraph.functions.vector import VectorQuery, neighbours, search
from loomgraph.operators import graph as G
from loomgraph.operators import retrieval as R
from loomgraph.operators.scale import held
from loomgraph.plans.registry import query
from loomgraph.plans.sqlparts import BACK, CANON, CLASSES, FAMILIES, LIVE, NOW, RULES, ends, infer, quoted, values

REQUESTS = {0: "the and tion heresh", 1: "queaux eau", 2: "der und sch ein de la"}
K = 5


def requests(t: Tables, **kw) -> list[R.Query]:
    picked = {r["id"]: list(r["embedding"]) for r in t.embeddings.where(F.col("id").isin(list(REQUESTS))).collect()}
    return [R.Query(i, text, picked[i], top_k=K, **kw) for i, text in REQUESTS.items()]


def corpus(t: Tables):
    return t.embeddings.join(G.active(t.nodes).select("id", "type", "project"), "id")


def vec_sql(name: str, k: int, where: str = "TRUE") -> str:
    return f"""{name} AS (SELECT qid, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM (
 SELECT q.vec_id AS qid, n.id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS distance
 FROM (SELECT * FROM embeddings WHERE vec_id IN ({", ".join(map(str, REQUESTS))})) q, embeddings e JOIN nodes n ON n.id = e.vec_id
 WHERE n.status = 'active' AND {where})) WHERE rank <= {k})"""


WORDS = values("words", "qid, word", [(i, w.lower()) for i, s in REQUESTS.items() for w in T.match_terms(s)[0]])
SHORT = values("shorts", "qid, word, need", [(i, w, max(2, len(T.match_terms(s)[1]) // 2))
                                            for i, s in REQUESTS.items() for w in T.match_terms(s)[1]])
_SEVEN = ["content", "tags", "project", "summary", "key_concepts", "domains", "facets"]


def low(f: str) -> str:
    lists = {"key_concepts", "domains", "facets"}
    return f"lower(coalesce({'array_to_string(' + f + ', chr(44) || chr(32))' if f in lists else f}, ''))"


def txt_sql(k: int) -> str:
    hay = ", ".join(f"{low(f)} AS {f}" for f in _SEVEN)
    dl = " + ".join(f"greatest(length({f}) - 2, 0)" for f in _SEVEN)
    tf = " + ".join(f"(length({f}) - length(replace({f}, w.word, ''))) // length(w.word)" for f in _SEVEN)
    return f"""{WORDS}, hay AS MATERIALIZED (SELECT id, status, {hay} FROM nodes),
dl AS (SELECT id, {dl} AS dl FROM hay), corp AS (SELECT count(*) AS n, avg(dl) AS av FROM dl),
tfs AS (SELECT h.id, h.status, w.word, {tf} AS tf FROM hay h, (SELECT DISTINCT word FROM words) w),
dfs AS (SELECT word, count(*) AS df FROM tfs WHERE tf > 0 GROUP BY word),
bm AS (SELECT w.qid, t.id, round(sum(greatest(ln((c.n - d.df + 0.5) / (d.df + 0.5)), 0.000001) * t.tf * 2.2 / (t.tf + 1.2 * (1 - 0.75 + 0.75 * dl.dl / c.av))), 9) AS score
 FROM tfs t JOIN words w ON w.word = t.word JOIN dfs d ON d.word = t.word JOIN dl ON dl.id = t.id, corp c
 WHERE t.tf > 0 AND t.status = 'active' GROUP BY w.qid, t.id),
txt0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= {k})"""


def assist_sql(k: int) -> str:
    five = " || chr(10) || ".join(low(f) for f in ["content", "summary", "key_concepts", "domains", "facets"])
    return f"""{SHORT}, each AS (SELECT * FROM (SELECT s.qid, s.word, s.need, n.id, row_number() OVER (PARTITION BY s.qid, s.word ORDER BY n.id) AS p
  FROM nodes n JOIN shorts s ON contains({five}, s.word) WHERE n.status = 'active') WHERE p <= {k}),
cnts AS (SELECT qid, need, id, count(*) AS cnt FROM each GROUP BY ALL),
fresh AS (SELECT c.*, row_number() OVER (PARTITION BY c.qid ORDER BY cnt DESC, c.id) AS pos FROM cnts c ANTI JOIN txt0 t ON t.qid = c.qid AND t.id = c.id),
tiers AS (SELECT qid, id, score, 1 AS tier, rank AS o FROM txt0 UNION ALL
 SELECT qid, id, CASE WHEN cnt >= need AND pos <= 2 THEN cnt * 10.0 ELSE cnt * 1.0 END, CASE WHEN cnt >= need AND pos <= 2 THEN 0 ELSE 2 END, pos FROM fresh),
txt AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY tier, o) AS rank FROM tiers)"""


@query("ret01_vector_search", "RET1 JN16 TK3 WN1", "nodes", f"WITH {vec_sql('v', 20)} SELECT * FROM v")
def ret01(t):
    asked = [VectorQuery(q.qid, q.vector) for q in requests(t)]
    return search(corpus(t), asked, K * 4)


@query("ret04_text_search_bm25", "RET2 RET3 RET4 JN12 RET17", "nodes", f"WITH {txt_sql(20)} SELECT qid, id, score, rank FROM txt0")
def ret04(t):
    return R.text_search(t.nodes, requests(t), K * 4, t.texts)


@query("ret05_two_letter_assist", "RET5 FLT3", "nodes", f"WITH {txt_sql(20)}, {assist_sql(20)} SELECT qid, id, CAST(score AS DOUBLE) AS score, rank FROM txt")
def ret05(t):
    qs = requests(t)
    return R.two_letter_assist(t.nodes, qs, R.text_search(t.nodes, qs, K * 4, t.texts), K * 4, t.texts)


HINTED = "결정 실패 도구"  # three types are named, two of them count
HINTS = T.type_hints(HINTED)


@query("ret06_typed_vector_channel", "RET6", "nodes", "WITH " + ", ".join(vec_sql(f"h{i}", 10, f"n.type = '{h}'") for i, h in enumerate(HINTS)) + " " + " UNION ALL ".join(
    f"SELECT qid, id, '{h}' AS hint, round(CAST({O.TYPE_CHANNEL_WEIGHTS[h]} AS DOUBLE) / (18 + rank), 9) AS part FROM h{i}" for i, h in enumerate(HINTS)))
def ret06(t):
    out = None
    for hint in T.type_hints(HINTED):
        hits = search(corpus(t), [VectorQuery(q.qid, q.vector, hint) for q in requests(t)], K * 2)
        part = R.contributions(hits, hint, O.TYPE_CHANNEL_WEIGHTS[hint]).select(
            "qid", "id", F.col("source").alias("hint"), F.round("part", 9).alias("part"))
        out = part if out is None else out.unionAll(part)
    return out


SEEDS = "seeds AS (SELECT qid, id FROM v WHERE rank <= 3 UNION SELECT qid, id FROM txt WHERE rank <= 3)"
REASON = f"reason AS (SELECT * FROM edges WHERE status = 'active' AND coalesce(generation_method, '') NOT IN ({quoted(O.GRAPH_EXCLUDED_METHODS)}))"


def reach_sql(qids: str) -> str:
    return f"""{REASON}, {ends('reason', 'rends')}, h1 AS (SELECT DISTINCT s.qid, e.nbr AS id FROM seeds s JOIN rends e ON e.nid = s.id WHERE s.qid IN ({qids})),
h2 AS (SELECT DISTINCT h.qid, e.nbr AS id FROM h1 h JOIN rends e ON e.nid = h.id),
reach AS (SELECT * FROM (SELECT * FROM h1 UNION SELECT * FROM h2) x ANTI JOIN seeds s ON s.qid = x.qid AND s.id = x.id),
act AS (SELECT * FROM edges WHERE status = 'active'), {ends('act', 'aends')}, {CLASSES},
direct AS (SELECT s.qid, e.nbr AS id, max(coalesce(c.rnk, 0)) AS r FROM seeds s JOIN aends e ON e.nid = s.id LEFT JOIN classes c ON c.rel = e.relation GROUP BY 1, 2),
reachc AS (SELECT r.qid, r.id, CASE d.r WHEN 4 THEN 'semantic' WHEN 3 THEN 'evidence' WHEN 2 THEN 'temporal' WHEN 1 THEN 'structural' WHEN 0 THEN 'operational' ELSE '' END AS edge_class
 FROM reach r LEFT JOIN direct d ON d.qid = r.qid AND d.id = r.id)"""


def ucb_sql(coeff: dict[int, float]) -> str:
    hops = []
    front, seen = "useeds", "SELECT qid, id FROM useeds"
    for h in (1, 2):
        hops.append(f"""c{h} AS (SELECT f.qid, f.c, f.id AS nid, coalesce(vi.visits, 1) AS n_i, e.nbr AS id, arg_max(e.relation, (e.outw, e.edge_id)) AS relation,
  arg_max(e.strength, (e.outw, e.edge_id)) AS strength FROM {front} f JOIN uends e ON e.nid = f.id LEFT JOIN visits vi ON vi.id = f.id
  ANTI JOIN ({seen}) s ON s.qid = f.qid AND s.id = e.nbr GROUP BY ALL),
s{h} AS (SELECT c.qid, c.c, c.id, round(greatest(c.strength * coalesce(fa.w, 0.3), 0) + c.c * sqrt(ln(c.n_i + 1.0) / (vj.visits + 1)), 9) AS score,
  coalesce(k.cls, 'operational') AS edge_class, coalesce(k.rnk, 0) AS rnk
  FROM c{h} c JOIN visits vj ON vj.id = c.id LEFT JOIN families fa ON fa.rel = c.relation LEFT JOIN classes k ON k.rel = c.relation),
b{h} AS (SELECT qid, c, id, max(score) AS score, arg_max(edge_class, (score, rnk)) AS edge_class FROM s{h} GROUP BY qid, c, id),
p{h} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id DESC, edge_class DESC) AS rn FROM b{h}) WHERE rn <= 20)""")
        front = f"p{h}"
        seen += f" UNION ALL SELECT qid, id FROM p{h}"
    case = " ".join(f"WHEN {q} THEN CAST({c} AS DOUBLE)" for q, c in coeff.items())
    return f"""{LIVE}, ulive AS (SELECT * FROM live WHERE coalesce(generation_method, '') NOT IN ({quoted(O.GRAPH_EXCLUDED_METHODS)})), {ends('ulive', 'uends')}, {FAMILIES},
visits AS (SELECT id, CASE WHEN coalesce(visit_count, 0) > 0 THEN visit_count ELSE 1 END AS visits FROM nodes),
useeds AS (SELECT qid, id, CASE qid {case} END AS c FROM seeds WHERE qid IN ({", ".join(map(str, coeff))})),
{", ".join(hops)}, ucb AS (SELECT qid, id, edge_class FROM p1 UNION ALL SELECT qid, id, edge_class FROM p2)"""


COEFF = {i: T.exploration(s) for i, s in REQUESTS.items()}
CHANNELS = (f"{vec_sql('v', K * 4)}, {txt_sql(K * 4)}, {assist_sql(K * 4)}, {SEEDS}, {reach_sql('2')}, "
            f"{ucb_sql({i: c for i, c in COEFF.items() if c > O.UCB_FOCUS})}")


def _seeds(t):
    qs = requests(t)
    vec = search(corpus(t), [VectorQuery(q.qid, q.vector) for q in qs], K * 4)
    txt = R.two_letter_assist(t.nodes, qs, held(R.text_search(t.nodes, qs, K * 4, t.texts), 60), K * 4, t.texts)
    return qs, R.seeds_of(held(vec, 60), held(txt, 400))


@query("gr01_reachable_two_hops", "GR1 GR2 RET7 RET10 SO1 SO2 SO3", "nodes edges",
       f"WITH {vec_sql('v', K * 4)}, {txt_sql(K * 4)}, {assist_sql(K * 4)}, {SEEDS}, {reach_sql('0, 1, 2')} SELECT * FROM reachc")
def gr01(t):
    _, seeds = _seeds(t)
    return G.best_edge_class(t.edges, seeds, G.reachable(t.edges, seeds)).select("qid", "id", "edge_class")


@query("gr03_ucb_traversal", "GR3 GR4 RET8 RET9 RET10", "nodes edges", f"WITH {CHANNELS} SELECT * FROM ucb")
def gr03(t):
    qs, seeds = _seeds(t)
    return R.graph_channel(t.nodes, t.edges, [q for q in qs if q.qid != 2], seeds)


GRAPH_PART = "CASE edge_class WHEN 'semantic' THEN 0.015 WHEN 'evidence' THEN 0.012 WHEN 'temporal' THEN 0.005 WHEN 'structural' THEN 0.002 WHEN 'operational' THEN 0 ELSE 0.005 END"
FUSED = f"""{CHANNELS}, parts AS (SELECT qid, id, CAST(1.0 AS DOUBLE) / (18 + rank) AS part, 'vector' AS source FROM v
 UNION ALL SELECT qid, id, CAST(1.0 AS DOUBLE) / (18 + rank), 'fts5' FROM txt
 UNION ALL SELECT qid, id, CAST({GRAPH_PART} AS DOUBLE), 'graph' FROM (SELECT * FROM ucb UNION ALL SELECT * FROM reachc) WHERE {GRAPH_PART} > 0),
fused AS (SELECT qid, id, round(sum(part), 9) AS fused, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM parts GROUP BY qid, id)"""


@query("ret11_rank_fusion", "RET11 WN1", "nodes edges", f"WITH {FUSED} SELECT qid, id, fused, sources FROM fused")
def ret11(t):
    out = R.channels(t.nodes, t.edges, t.embeddings, requests(t), t.texts)
    return out.withColumn("sources", F.array_join("sources", ","))


REQ = values("req", "qid, terms, phrase", [(i, "\x01", " ".join(T.query_terms(s))) for i, s in REQUESTS.items()])
for _i, _s in REQUESTS.items():
    REQ = REQ.replace("'\x01'", "[" + quoted(T.query_terms(_s)) + "]", 1)
SCORED = f"""{FUSED}, {REQ},
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, id) AS fr FROM fused) WHERE fr <= {K * 10}),
contra AS (SELECT source_id AS id FROM live WHERE relation = 'contradicts' UNION SELECT target_id FROM live WHERE relation = 'contradicts'),
cand AS (SELECT c.qid, c.id, c.fused, c.sources, n.*  EXCLUDE (id), r.terms, r.phrase, k.id IS NOT NULL AS flagged,
  trim(concat_ws(' ', nullif(lower(coalesce(content, '')), ''), nullif(lower(coalesce(summary, '')), ''),
   nullif(lower(array_to_string(key_concepts, ', ')), ''), nullif(lower(tags), ''))) AS hay,
  CASE n.layer WHEN 3 THEN 0.6 WHEN 2 THEN 0.4 WHEN 1 THEN 0.2 ELSE 0.1 END AS imp,
  greatest(coalesce(floor((epoch({NOW}) - epoch(coalesce(last_accessed_at, updated_at))) / 86400), 365), 0) AS days
  FROM cut c JOIN nodes n ON n.id = c.id AND n.status = 'active' JOIN req r ON r.qid = c.qid LEFT JOIN contra k ON k.id = c.id),
cand2 AS (SELECT *, CAST(len(list_filter(terms, lambda w: contains(hay, w))) AS DOUBLE) / len(terms) AS ratio FROM cand),
scored AS (SELECT *, round((fused + CASE tier WHEN 0 THEN 0.15 WHEN 1 THEN 0.05 ELSE 0 END + CASE WHEN flagged THEN -0.10 ELSE 0 END
  + 0.001 * imp * exp(-0.01 * days) + 0.001 * imp
  + CASE source WHEN 'user' THEN 0.12 WHEN 'claude' THEN 0.08 WHEN 'checkpoint' THEN 0.04 WHEN 'save_session' THEN -0.02 WHEN 'pdr' THEN -0.02
     WHEN 'obsidian' THEN -0.05 WHEN 'hook' THEN -0.04 ELSE -0.03 END
  + CASE WHEN lower(source) LIKE '%obsidian:agents.md%' OR contains(source, '.rulesync\\rules\\') THEN -0.08 ELSE 0 END
  + CASE WHEN contains(hay, phrase) THEN 0.12 ELSE 0 END + CASE WHEN len(terms) = 1 THEN CASE WHEN ratio = 1 THEN 0.05 ELSE 0 END ELSE 0.08 * ratio END
  + coalesce((quality_score - 0.5) * 0.2, 0) + coalesce((confidence - 0.5) * 0.05, 0))
  * CASE WHEN promotion_candidate <> 0 THEN 1.5 ELSE 1 END, 9) AS score FROM cand2),
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, CASE WHEN trim(coalesce(content, '')) = '' THEN 'id:' || id ELSE sha1(trim(content)) END
  ORDER BY score DESC, id) AS copy FROM scored) WHERE copy = 1),
final AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM uniq)"""


@query("ret15_hybrid_scoring", "RET11 RET12 RET13 RET14 RET15 RET16 RET18 RET19 RET20 WN6 JN12", "nodes edges",
       f"WITH {SCORED} SELECT qid, rank, id, type, project, sources, score FROM final")
def ret15(t):
    qs = requests(t)
    out = R.score_candidates(t.nodes, t.edges, R.channels(t.nodes, t.edges, t.embeddings, qs, t.texts), qs, AS_OF)
    return out.select("qid", "rank", "id", "type", "project", F.array_join("sources", ",").alias("sources"), "score")


def diverse_sql(k: int) -> str:
    most = max(1, int(k * 0.6))
    return f"""{SCORED}, marked AS (SELECT *, rank <= {k} AS top, count(*) OVER (PARTITION BY qid) > {k} AS more, count(*) FILTER (rank <= {k}) OVER (PARTITION BY qid, type) AS same FROM final),
crowd AS (SELECT DISTINCT qid, type AS crowded, same - {most} AS surplus FROM marked WHERE more AND same > {most}),
staged AS (SELECT m.*, c.crowded, c.surplus, row_number() OVER (PARTITION BY m.qid, m.top, m.type IS NOT DISTINCT FROM c.crowded ORDER BY CASE WHEN m.top THEN -m.rank ELSE m.rank END) AS nth
 FROM marked m LEFT JOIN crowd c ON c.qid = m.qid),
diverse AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY qid ORDER BY score DESC, top DESC, rank) AS rank FROM staged
 WHERE CASE WHEN top THEN crowded IS NULL OR type <> crowded OR nth > surplus ELSE crowded IS NOT NULL AND type <> crowded AND nth <= surplus END)"""


@query("ret22_diverse_results", "RET22 RET30", "nodes edges", f"""WITH {diverse_sql(K)}
SELECT qid, rank, id, type, substr(content, 1, 200) AS content, project, tags, round(score, 3) AS score, created_at, coalesce(layer, 1) AS layer,
 round(coalesce(nullif(confidence, 0), 0.5), 2) AS confidence, coalesce(source, '') AS source, round(coalesce(quality_score, 0), 2) AS quality,
 coalesce(node_role, '') AS node_role, coalesce(epistemic_status, 'provisional') AS epistemic_status FROM diverse WHERE rank <= {K}""")
def ret22(t):
    out = R.hybrid_search(t.nodes, t.edges, t.embeddings, requests(t), AS_OF, index=t.texts)
    return R.format_results(out)


@query("ret21_rerank", "RET21 WN7 WN10", "nodes edges", f"""WITH {SCORED},
pool AS (SELECT qid, id, score, rank, CAST(least(length(content), 300) AS DOUBLE) AS ce FROM final WHERE rank <= 15),
gaps AS (SELECT qid, max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END) AS gap, min(ce) AS lo, max(ce) AS hi FROM pool GROUP BY qid),
mixed AS (SELECT p.qid, p.id, CASE WHEN gap < 0.05 THEN round(score * (1 - 0.35) + (ce - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 0.35, 9) ELSE score END AS score
 FROM pool p JOIN gaps g ON g.qid = p.qid)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM mixed""")
def ret21(t):
    qs = requests(t)
    ranked = R.score_candidates(t.nodes, t.edges, R.channels(t.nodes, t.edges, t.embeddings, qs, t.texts), qs, AS_OF)
    scorer = F.least(F.length("content"), F.lit(300)).cast("double")  # stand-in for a cross-encoder
    return R.rerank(ranked, scorer).select("qid", "id", "score", "rank")


TOP = f"{SCORED}, res AS (SELECT qid, id, type, project, source, node_role, score, rank FROM final WHERE rank <= 15)"


def _ranked(t, k=15):
    qs = requests(t)
    out = R.score_candidates(t.nodes, t.edges, R.channels(t.nodes, t.edges, t.embeddings, qs, t.texts), qs, AS_OF)
    return held(out.where(F.col("rank") <= k), len(qs) * k)


@query("ret25_intent_filters", "RET23 RET25 FLT12", "nodes edges", f"""WITH {TOP}
SELECT 'generic' AS intent, qid, id FROM res WHERE node_role NOT IN ('session_anchor', 'work_item', 'external_noise', 'correction')
  AND NOT (source = 'pdr' AND type IN ('Narrative', 'Observation'))
UNION ALL SELECT 'recollection', qid, id FROM res WHERE node_role NOT IN ('work_item', 'external_noise')
UNION ALL SELECT 'troubleshooting', qid, id FROM res WHERE node_role <> 'external_noise' AND NOT (source = 'pdr' AND type = 'Narrative')""")
def ret25(t):
    ranked = _ranked(t)
    parts = [R.intent_filter(ranked, i).select(F.lit(i).alias("intent"), "qid", "id")
             for i in ("generic", "recollection", "troubleshooting")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("ret26_patch_saturation", "RET26 AG12 WN8", "nodes edges", f"""WITH {TOP}, cnt AS (SELECT qid, project, count(*) AS n FROM res GROUP BY ALL)
SELECT qid, CAST(sum(n) AS BIGINT) AS total, max(n) AS top_n, arg_max(project, (n, project)) AS dominant, sum(n) >= 3 AND max(n) / sum(n) >= 0.75 AS saturated FROM cnt GROUP BY qid""")
def ret26(t):
    return R.saturated(_ranked(t))


@query("ret28_context_package", "RET28 GR32", "nodes edges", f"""WITH {TOP}, {ends('live')},
pk AS (SELECT r.qid, e.nid, e.nbr, e.outw, e.relation, row_number() OVER (PARTITION BY r.qid, e.nid ORDER BY e.edge_id) AS pos
 FROM (SELECT DISTINCT qid, id FROM res) r JOIN ends e ON e.nid = r.id WHERE e.relation <> 'co_retrieved')
SELECT p.qid, p.nid AS id, p.pos, CASE WHEN outw THEN '→' ELSE '←' END || relation AS relation, p.nbr AS neighbour_id, n.type, substr(n.content, 1, 100) AS preview
FROM pk p JOIN nodes n ON n.id = p.nbr AND n.status = 'active' WHERE pos <= 5""")
def ret28(t):
    return R.context_package(t.nodes, t.edges, _ranked(t))


@query("ret29_causal_chains", "RET29", "nodes edges", f"""WITH {TOP}, {ends('live')},
hit AS (SELECT a.qid, e.nid, e.nbr, e.outw, e.relation, row_number() OVER (PARTITION BY a.qid, least(e.nid, e.nbr), greatest(e.nid, e.nbr) ORDER BY a.rank, e.edge_id) AS k
 FROM ends e JOIN res a ON a.id = e.nid JOIN res b ON b.id = e.nbr AND b.qid = a.qid WHERE e.nid <> e.nbr AND e.relation IN ({quoted(O.CAUSAL_RELATIONS)}))
SELECT qid, nid AS from_id, nbr AS to_id, CASE WHEN outw THEN '→' ELSE '←' END || relation AS relation FROM hit WHERE k = 1""")
def ret29(t):
    return R.causal_chains(t.nodes, t.edges, _ranked(t))


@query("ret31_recall_log_rows", "RET31", "nodes edges", f"""WITH {TOP}
SELECT 'batch' AS query, id AS node_id, rank, score, 'auto' AS mode, 'r1' AS recall_id, '[' || array_to_string(list_transform(string_split(f.sources, ','), lambda s: '"' || s || '"'), ',') || ']' AS sources
FROM res JOIN (SELECT qid, id, sources FROM fused) f USING (qid, id)""")
def ret31_log(t):
    return R.recall_log_rows(_ranked(t), "batch", "auto", "r1")


@query("ret32_retrieval_log_row", "RET32", "nodes edges", f"""WITH {TOP},
kinds AS (SELECT qid, '{{' || string_agg('"' || type || '":' || n, ',' ORDER BY type) || '}}' AS slot_distribution FROM (SELECT qid, type, count(*) AS n FROM res GROUP BY ALL) GROUP BY qid)
SELECT r.qid, '[' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) || ']' AS returned_ids, CAST(count(DISTINCT nullif(project, '')) > 1 AS INTEGER) AS cross_domain,
 any_value(k.slot_distribution) AS slot_distribution, 'batch' AS query, 0 AS feedback_linked FROM res r JOIN kinds k ON k.qid = r.qid GROUP BY r.qid""")
def ret32(t):
    return R.retrieval_log_row(_ranked(t), "batch")


@query("ret24_troubleshooting_recall", "RET24 RET25 RET26", "nodes edges")
def ret24(t):
    q = requests(t)[0]
    return R.recall(t.nodes, t.edges, t.embeddings, R.Query(0, q.text, q.vector, mode="troubleshooting", top_k=K), AS_OF, t.texts).select(
        "qid", "rank", "id", "type", "score")


@query("ret27_correction_recall", "RET27", "nodes edges")
def ret27(t):
    q = requests(t)[1]
    return R.recall(t.nodes, t.edges, t.embeddings, R.Query(1, q.text, q.vector, mode="correction", top_k=K), AS_OF, t.texts).select(
        "qid", "rank", "id", "type", "score")


@query("ret33_recent_nodes", "RET33 SRC1 TK1 FLT1", "nodes", """SELECT id, type, project, created_at FROM nodes
WHERE status = 'active' AND type = 'Decision' ORDER BY created_at DESC, id LIMIT 10""")
def ret33(t):
    from loomgraph.operators.tables import recent_nodes
    return recent_nodes(t.nodes, node_type="Decision").select("id", "type", "project", "created_at")


KNN = """near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM (
 SELECT a.vec_id AS qid, b.vec_id AS id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance
 FROM embeddings a, embeddings b JOIN nodes n ON n.id = b.vec_id WHERE n.status = 'active' AND a.vec_id <> b.vec_id)) WHERE rank <= 5)"""


def _near(t):
    mine = t.embeddings.join(G.active(t.nodes).select("id"), "id", "left_semi")
    return neighbours(mine, corpus(t), 5)


@query("ret34_auto_link", "RET34 GR28", "nodes", f"""WITH {KNN}, {RULES}, {BACK}, {CANON}
SELECT s.id AS source_id, t.id AS target_id, coalesce((SELECT stored FROM canon WHERE rel = {infer('s', 't')}), {infer('s', 't')}) AS relation,
 round(greatest(0, 1 - k.distance), 6) AS strength, 'semantic_auto' AS generation_method
FROM near k JOIN nodes s ON s.id = k.qid AND s.status = 'active' JOIN nodes t ON t.id = k.id WHERE k.distance <= 0.55""")
def ret34(t):
    return R.auto_link(G.active(t.nodes), t.nodes, _near(t))


@query("ret35_fallback_link", "RET35", "nodes", f"""WITH {RULES}, {BACK}, {CANON}, act AS (SELECT * FROM nodes WHERE status = 'active' AND project <> ''),
c AS (SELECT s.id AS sid, t.id AS tid, row_number() OVER (PARTITION BY s.id ORDER BY CASE WHEN t.type = s.type THEN 0 ELSE 1 END, t.created_at DESC, t.id) AS k
 FROM act s JOIN act t ON t.project = s.project AND t.id <> s.id)
SELECT s.id AS source_id, t.id AS target_id, coalesce((SELECT stored FROM canon WHERE rel = {infer('s', 't')}), {infer('s', 't')}) AS relation,
 CAST(0.6 AS DOUBLE) AS strength, 'fallback' AS generation_method FROM c JOIN nodes s ON s.id = c.sid JOIN nodes t ON t.id = c.tid WHERE c.k = 1""")
def ret35(t):
    return R.fallback_link(G.active(t.nodes), t.nodes)


@query("ret36_similar_failure_warning", "RET36", "nodes", """WITH near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM (
 SELECT a.vec_id AS qid, b.vec_id AS id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance
 FROM embeddings a, embeddings b JOIN nodes n ON n.id = b.vec_id WHERE n.status = 'active' AND n.type = 'Failure' AND a.vec_id <> b.vec_id)) WHERE rank <= 3)
SELECT qid AS id, k.id AS failure_id, round(1 - distance, 6) AS similarity FROM near k WHERE rank = 1 AND distance <= 0.4""")
def ret36(t):
    near = neighbours(t.embeddings, corpus(t), 3, ["Failure"])
    return near.where("rank = 1 AND distance <= 0.4").select(
        F.col("qid").alias("id"), F.col("id").alias("failure_id"), F.round(1 - F.col("distance"), 6).alias("similarity"))


@query("ret37_classify", "RET37", "nodes", """SELECT id, CASE WHEN type = 'Correction' THEN NULL WHEN type IN ('Observation', 'Narrative', 'Question') THEN 0
 WHEN type IN ('Pattern', 'Insight', 'Framework') THEN 2 WHEN type IN ('Principle', 'Identity') THEN 3 ELSE 1 END AS default_layer,
 CASE WHEN type IN ('Principle', 'Identity') THEN 0 ELSE 2 END AS start_tier FROM nodes""")
def ret37(t):
    layer, tier = R.classify(F.col("type"))
    return t.nodes.select("id", layer.alias("default_layer"), tier.alias("start_tier"))


@query("ret37_suggest_type", "FLT19 MX4", "nodes", "WITH x AS (SELECT id, lower(content || CASE id % 997 "
       + " ".join(f"WHEN {i} THEN ' {words[0]}'" for i, words in enumerate(O.SUGGEST_KEYWORDS.values())) + " ELSE '' END) AS c FROM nodes) SELECT id, CASE "
       + " ".join("WHEN " + " OR ".join(f"contains(c, '{w}')" for w in words) + f" THEN '{kind}'" for kind, words in O.SUGGEST_KEYWORDS.items())
       + " ELSE 'Unclassified' END AS suggested FROM x")
def ret37_suggest(t):
    # the invented prose holds few keywords, so a row of each kind gets the first one of its kind
    added = F.concat(*[F.when(F.col("id") % 997 == i, f" {words[0]}").otherwise("") for i, words in enumerate(O.SUGGEST_KEYWORDS.values())])
    return t.nodes.select("id", R.suggest_type(F.concat("content", added)).alias("suggested"))


SCENARIOS = {0: "english_query", 1: "two_word_query", 2: "mixed_length_query"}


@query("qc07_recall_scenarios", "QC7 RET9", "nodes edges", f"""WITH {SCORED}, c AS (SELECT qid, count(*) AS n FROM final WHERE rank <= 5 GROUP BY qid)
SELECT name, 'recall' AS category, CAST(coalesce(n, 0) AS DOUBLE) AS score, CAST(NULL AS DOUBLE) AS threshold, CASE WHEN coalesce(n, 0) >= 1 THEN 'PASS' ELSE 'FAIL' END AS status
FROM (VALUES (0, 'english_query'), (1, 'two_word_query'), (2, 'mixed_length_query')) v(qid, name) LEFT JOIN c ON c.qid = v.qid
UNION ALL SELECT 'mode_focus_coefficient', 'recall', CAST(0.3 AS DOUBLE), NULL, 'PASS' UNION ALL SELECT 'mode_dmn_coefficient', 'recall', CAST(2.5 AS DOUBLE), NULL, 'PASS'
UNION ALL SELECT 'duplicate_content_refused', 'recall', CAST(0 AS DOUBLE), NULL, 'PASS'""")
def qc07(t):
    from loomgraph.operators.quality import recall_scenarios
    from loomgraph.operators.tables import insert_nodes
    counts = _ranked(t, K).groupBy("qid").agg(F.count("*").alias("n"))
    coeff = {"mode_focus_coefficient": (O.UCB_FOCUS, T.exploration("a b c", "focus")), "mode_dmn_coefficient": (O.UCB_WIDE, T.exploration("a b c", "dmn"))}
    known = t.nodes.where("content_hash IS NOT NULL").select("id", "type", "layer", "node_role", "content_hash")
    return recall_scenarios(counts, SCENARIOS, coeff, insert_nodes(known, known))
