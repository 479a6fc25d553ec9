"""The claim and trait tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import ontology as O
from loomgraph.operators import graph as G
from loomgraph.operators.scale import top_per_group

# Claim type per dimension.
CLAIM_TYPE = {"preference": "preference", "emotion": "emotion", "decision_style": "decision", "thinking_style": "observation",
              "language": "observation", "rhythm": "observation", "metacognition": "observation", "connection": "observation"}
DIMENSIONS = list(CLAIM_TYPE)


def unprocessed(captures: DataFrame, claims: DataFrame) -> DataFrame:
    return captures.join(claims.select(F.col("capture_id").alias("id")), "id", "left_anti")


def missing_references(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """Rows whose reference names no parent row."""
    return rows.join(parents.select(F.col("id").alias(column)), column, "left_anti")


def claims_from_extraction(captures: DataFrame, extracted: DataFrame) -> DataFrame:
    """Claim rows of extracted items (capture_id, text, dimension, confidence); a capture without any gets a marker."""
    good = extracted.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    rows = good.select("capture_id", F.trim("text").alias("text"), O.lookup(CLAIM_TYPE, F.col("dimension"), "observation").alias("claim_type"),
                       F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.lit("provisional").alias("status"))
    none = captures.select(F.col("id").alias("capture_id")).join(extracted.select("capture_id"), "capture_id", "left_anti")
    return rows.unionAll(none.select("capture_id", F.lit("[no extractable claims]"), F.lit("skip"), F.lit(0.0), F.lit("skip")))


def trait_sources(nodes: DataFrame, types: list[str], words: list[str], shortest: int = 50, longest: int = 800,
                  limit: int | None = None) -> DataFrame:
    """Nodes that may speak of the owner: of given types, of middle length, with one of the words."""
    size = F.length("content").between(shortest, longest)
    rows = G.active(nodes).where(F.col("type").isin(types) & size & O.contains_any(F.lower("content"), [w.lower() for w in words]))
    rows = rows.select("id", "type", F.coalesce("quality_score", F.lit(0.0)).alias("quality"), F.coalesce("maturity", F.lit(0.0)).alias("maturity"))
    return rows.orderBy(F.desc("quality"), F.desc("maturity"), "id").limit(limit) if limit else rows


def keywords(content: Column) -> Column:
    return F.slice(F.filter(F.split(F.coalesce(content, F.lit("")), r"\s+"), lambda w: F.length(w) >= 3), 1, 3)


def grams(text: Column) -> Column:
    """Distinct three-letter pieces of a text of at least three letters."""
    pieces = F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, 3))
    return F.when(F.length(text) >= 3, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def containing(words: DataFrame, texts: DataFrame) -> DataFrame:
    """(word, claim_id) for every text that contains a word of three letters or more, anywhere.

    Each word is looked up by the rarest of its trigrams, an equi-join, and
    only those candidates are compared; a trigram no text has ends the word.
    """
    pieces = texts.select("claim_id", F.explode(grams(F.col("text"))).alias("g"))
    freq = pieces.groupBy("g").agg(F.count("*").alias("df"))
    rarest = (words.select("word", F.explode(grams(F.col("word"))).alias("g")).join(freq, "g", "left")
              .groupBy("word").agg(F.min_by("g", F.struct(F.coalesce("df", F.lit(0)), F.col("g"))).alias("g")))
    return (rarest.join(pieces, "g").join(texts, "claim_id").where(F.contains("text", F.col("word")))
            .select("word", "claim_id"))


def evidence_boost(traits: DataFrame, evidence: DataFrame, claims: DataFrame, captures: DataFrame, target: int = 3,
                   actor: str = "owner") -> DataFrame:
    """New evidence rows for traits short of ``target``: claims of the owner that contain a key word."""
    have = evidence.groupBy(F.col("trait_id").alias("id")).agg(F.count("*").alias("have"))
    short = (traits.where("status <> 'archived'").join(have, "id", "left")
             .withColumn("needed", F.lit(target) - F.coalesce("have", F.lit(0))).where("needed > 0"))
    asked = short.select(F.col("id").alias("trait_id"), "needed", F.posexplode(keywords(F.col("content"))).alias("ord", "word"))
    asked = asked.withColumn("word", F.lower("word"))
    own = captures.where(F.col("actor") == actor).select(F.col("id").alias("capture_id"))
    pool = (claims.where((F.col("status") != "rejected") & (F.length("text") >= 20)).join(own, "capture_id", "left_semi")
            .select(F.col("id").alias("claim_id"), F.lower("text").alias("text")))
    found = containing(asked.select("word").distinct(), pool)
    cand = asked.join(found, "word").join(evidence.select("trait_id", "claim_id"), ["trait_id", "claim_id"], "left_anti")
    first = top_per_group(cand, ["trait_id", "word"], [F.col("claim_id")], target, "k").drop("k")
    once = top_per_group(first, ["trait_id", "claim_id"], [F.col("ord")], 1, "k").drop("k")
    return top_per_group(once, ["trait_id"], [F.col("ord"), F.col("claim_id")], target, "pos").where(
        F.col("pos") <= F.col("needed")).select("trait_id", "claim_id", F.lit(0.3).alias("strength"))


def evidence_ratio(traits: DataFrame, evidence: DataFrame) -> DataFrame:
    live = traits.where("status <> 'archived'")
    n = evidence.join(live.select(F.col("id").alias("trait_id")), "trait_id", "left_semi").agg(F.count("*")).scalar()
    return live.agg(F.count("*").alias("traits"), F.round(F.lit(n) / F.count("*"), 6).alias("evidence_per_trait"))


def coverage(traits: DataFrame) -> DataFrame:
    """Traits per dimension with a mark: three and more are enough."""
    every = traits.sparkSession.createDataFrame([(d,) for d in [*DIMENSIONS, "unclassified"]], "dimension string")
    n = traits.where("status <> 'archived'").groupBy("dimension").agg(F.count("*").alias("n"))
    out = every.join(n, "dimension", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    usual = F.when(F.col("n") >= 3, "enough").when(F.col("n") > 0, "few").otherwise("none")
    open_ = F.when(F.col("n") > 0, "few").otherwise("enough")
    return out.withColumn("mark", F.when(F.col("dimension") == "unclassified", open_).otherwise(usual))


def apply_review(traits: DataFrame, decisions: DataFrame) -> DataFrame:
    """Traits changed by review marks (mark x or r, id prefix); archived traits stay as they are.

    A trait's own prefixes meet the marks by one equi-join, so marks of any length, or none at all, are one plan.
    """
    own = F.explode(F.transform(F.sequence(F.lit(0), F.length("id")), lambda n: F.substring("id", F.lit(1), n)))
    hits = traits.where("status <> 'archived'").select("id", own.alias("prefix")).join(decisions.select("prefix", "mark"), "prefix")
    last = hits.groupBy("id").agg(F.max("mark").alias("mark"))
    return last.select("id", F.when(F.col("mark") == "x", "verified").otherwise("archived").alias("status"),
                       F.when(F.col("mark") == "x", "approved").otherwise("rejected").alias("approval"))


def identity_traits(nodes: DataFrame) -> DataFrame:
    """Traits seeded from Identity nodes, their state from the epistemic status."""
    e = F.col("epistemic_status")
    status = F.when(e == "validated", "verified").when(e == "outdated", "dormant").otherwise("provisional")
    approval = (F.when(e == "validated", "approved").when(e == "outdated", "expired").when(e == "flagged", "rejected").otherwise("pending"))
    return G.active(nodes).where("type = 'Identity'").select(
        F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.lit("unclassified").alias("dimension"), "content",
        status.alias("status"), approval.alias("approval"),
        F.to_json(F.struct(F.col("id").alias("migrated_from_node_id"))).alias("metadata"))


def origin(traits: DataFrame) -> DataFrame:
    return traits.select(F.col("id").alias("trait_id"), F.get_json_object("metadata", "$.migrated_from_node_id").try_cast("bigint").alias("target_id"))


def evidence_from_edges(nodes: DataFrame, edges: DataFrame, traits: DataFrame) -> DataFrame:
    """Evidence bridged from edges into Identity nodes, with the text of the claim it stands on."""
    kinds = G.active(edges).where(F.col("relation").isin("generalizes_to", "expressed_as", "instantiated_as"))
    src = nodes.select(F.col("id").alias("source_id"), F.substring("content", 1, 500).alias("claim_text"))
    return kinds.join(origin(traits), "target_id").join(src, "source_id").select(
        F.col("id").alias("edge_id"), "trait_id", "source_id", F.coalesce(F.nullif("strength", F.lit(0.0)), F.lit(1.0)).alias("strength"), "claim_text")


def conflicts_from_corrections(nodes: DataFrame, edges: DataFrame, traits: DataFrame) -> DataFrame:
    fix = nodes.where("type = 'Correction'").select(F.col("id").alias("source_id"))
    return (G.active(edges).where("relation = 'contradicts'").join(fix, "source_id", "left_semi").join(origin(traits), "target_id")
            .select(F.col("id").alias("edge_id"), "trait_id", F.concat(F.lit("legacy:node:"), F.col("source_id").cast("string")).alias("source_ref"),
                    F.coalesce("description", F.lit("")).alias("description")))


def tally(text: Column, mark: str) -> Column:
    """Times a mark such as [A] stands at the start of a line in a review sheet."""
    return F.regexp_count(text, F.lit(rf"(?m)^\s*\[{mark}\]"))
