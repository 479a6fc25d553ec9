"""Text helpers: query-side functions run on the one query string, column forms on tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph import ontology as O

PUNCTUATION = "`'\"“”‘’.,:;!?()[]{}<>|-_/\\"


def strip_particle(term: str) -> str:
    """Drop the first listed ending that leaves at least two characters."""
    return next((term[: -len(s)] for s in O.PARTICLE_SUFFIXES
                 if len(term) > len(s) + 1 and term.endswith(s)), term)


def strip_particle_column(term: Column) -> Column:
    """Column form: the shortest stem wins, so two-character endings come first."""
    endings = "|".join(O.PARTICLE_SUFFIXES)
    return F.regexp_replace(term, f"^(.{{2,}}?)(?:{endings})$", "$1")


def query_terms(query: str) -> list[str]:
    words = (strip_particle(w.strip(PUNCTUATION)) for w in query.lower().split())
    return list(dict.fromkeys(w for w in words if len(w) >= 2))


def match_terms(query: str) -> tuple[list[str], list[str]]:
    """Query words for the indexed match (three characters up) and for the two-letter assist."""
    words = [strip_particle(w) for w in query.split()]
    return [w for w in words if len(w) >= 3], [w for w in words if len(w) == 2][:5]


def type_hints(query: str) -> list[str]:
    hit = [t for t, words in O.TYPE_KEYWORDS.items() if any(w in query for w in words)]
    return hit[: O.MAX_TYPE_HINTS]


def exploration(query: str, mode: str = "auto") -> float:
    if mode == "focus":
        return O.UCB_FOCUS
    if mode == "dmn":
        return O.UCB_WIDE
    n = len(query.split())
    return O.UCB_FOCUS if n >= 5 else O.UCB_WIDE if n <= 2 else O.UCB_AUTO


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a word in an already lower-cased text."""
    gone = F.length(F.replace(text, F.lit(word), F.lit("")))
    return ((F.length(text) - gone) / F.lit(len(word))).cast("int")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def json_list(text: Column) -> Column:
    """JSON array of strings; anything malformed reads as the empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def csv_list(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.lower(F.trim(t)))
    return F.filter(parts, lambda t: t != "")


def content_signature(content: Column, node_id: Column) -> Column:
    text = F.trim(F.coalesce(content, F.lit("")))
    return F.when(text == "", F.concat(F.lit("id:"), node_id.cast("string"))).otherwise(F.sha1(text))


def tokens_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 2)).cast("bigint")


def embed_text(content: Column, summary: Column, concepts: Column, node_type: Column, project: Column,
               queries: Column | None = None) -> Column:
    """Text handed to the embedder: header, summary, excerpt, keywords and related queries."""
    body, raw = F.trim(F.coalesce(summary, F.lit(""))), F.trim(F.coalesce(content, F.lit("")))
    excerpt = F.trim(F.substring(raw, 1, 200))
    head = F.concat_ws(" | ", F.nullif(F.trim(node_type), F.lit("")), F.nullif(F.trim(project), F.lit("")))
    words = F.array_join(F.filter(F.transform(concepts, lambda w: F.trim(w)), lambda c: c != ""), ", ")
    parts = [
        F.when(head != "", F.concat(F.lit("["), head, F.lit("]"))),
        F.when(body != "", body).otherwise(F.nullif(raw, F.lit(""))),
        F.when((body != "") & (F.length(raw) > F.length(body) * 2), excerpt),
        F.when(words != "", F.concat(F.lit("Keywords: "), words)),
    ]
    if queries is not None:
        asked = F.array_join(F.filter(F.transform(queries, lambda w: F.trim(w)), lambda c: c != ""), ", ")
        parts.append(F.when(asked != "", F.concat(F.lit("Queries: "), asked)))
    return F.concat_ws("\n", *parts)


def embed_text_compact(content: Column, summary: Column, concepts: Column, node_type: Column,
                       related: Column | None = None, context: Column | None = None) -> Column:
    """Second layout: type tag, summary, concepts, excerpt, then the first five hints of each kind."""
    def joined(words):
        return F.nullif(F.array_join(F.slice(words, 1, 5), ", "), F.lit(""))

    parts = [
        F.when(F.coalesce(node_type, F.lit("")) != "", F.concat(F.lit("["), node_type, F.lit("]"))),
        F.nullif(summary, F.lit("")),
        F.nullif(F.array_join(concepts, ", "), F.lit("")),
        F.nullif(F.substring(content, 1, 200), F.lit("")),
    ]
    parts += [joined(c) for c in (related, context) if c is not None]
    return F.concat_ws("\n", *parts)
