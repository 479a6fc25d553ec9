"""Chat formatting by relational means: collected turn structs, sorted, merged and concatenated with Spark expressions only.

Template (fixed values): a run of turns of one role is `<|role|>`, its texts with `<+>` between them, and `</s>`. In texts
and roles `&`, `<` and `[` become `&amp;`, `&lt;` and `&#91;` (in roles also `|`, as `&#124;`), so that no control string
(`</s>`, `[INST]`, `<|...|>`) can come from a text, and the original is read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]
ROLE_ESCAPES = [*ESCAPES, ("|", "&#124;")]
CONTINUED, CLOSED = "<+>", "</s>"


def _swap(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column) -> Column:
    return _swap(text, ESCAPES)


def unescape(text: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    return _swap(text, [(new, old) for old, new in reversed(pairs)])


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans array<struct<start, size>>): one row per conversation, spans in code points.

    Turns are ordered by number (nulls first), ties by role and text; repeated rows stay. A null text or role counts as
    empty; rows with a null conversation id form one conversation. The spans cover the escaped texts of `learn` turns, no
    marks. Other columns are not read. A conversation is one output row, so its turns meet in one task by definition.
    """
    own = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    rows = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # a run starts where the role differs from the one before
    starts = F.filter(F.sequence(F.lit(1), F.size("ts")), lambda i: (i == 1) | (F.element_at("ts", i)["role"] != F.element_at("ts", F.greatest(i - 1, F.lit(1)))["role"]))
    runs = F.transform("starts", lambda s, k: F.struct(
        F.element_at("ts", s)["role"].alias("role"),
        F.transform(F.slice("ts", s, F.coalesce(F.get("starts", k + 1), F.size("ts") + 1) - s), lambda t: escape(t["text"])).alias("texts"),
    ))
    rows = rows.withColumn("starts", starts).withColumn("runs", runs)
    head = lambda r: F.concat(F.lit("<|"), _swap(r["role"], ROLE_ESCAPES), F.lit("|>"))
    formatted = F.array_join(F.transform("runs", lambda r: F.concat(head(r), F.array_join(r["texts"], CONTINUED), F.lit(CLOSED))), "")
    # (what stands before the text, its length, what stands after it, whether it is learnt) for every turn, then running starts
    parts = F.flatten(F.transform("runs", lambda r: F.transform(r["texts"], lambda t, k: F.struct(
        F.when(k == 0, F.length(head(r))).otherwise(len(CONTINUED)).alias("before"), F.length(t).alias("size"),
        F.when(k == F.size(r["texts"]) - 1, len(CLOSED)).otherwise(0).alias("after"), (r["role"] == learn).alias("learnt"),
    ))))
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,size:int>>)").alias("spans"))
    walked = F.aggregate("parts", empty, lambda a, p: F.struct(
        (a["at"] + p["before"] + p["size"] + p["after"]).alias("at"),
        F.when(p["learnt"], F.concat(a["spans"], F.array(F.struct((a["at"] + p["before"]).alias("start"), p["size"].alias("size"))))).otherwise(a["spans"]).alias("spans"),
    ))
    return rows.withColumn("parts", parts).select("conv_id", formatted.alias("formatted"), walked["spans"].alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text, formatted_chars), from the formatted string and its spans alone."""
    runs = F.filter(F.split("formatted", CLOSED), lambda r: r != "")
    turns = F.flatten(F.transform(runs, lambda r: F.transform(
        F.split(F.regexp_replace(r, r"^<\|[^|]*\|>", ""), r"<\+>"),
        lambda t: F.struct(unescape(F.regexp_extract(r, r"^<\|([^|]*)\|>", 1), ROLE_ESCAPES).alias("role"), unescape(t).alias("text")),
    )))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["size"]))), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(read: DataFrame) -> DataFrame:
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), marked AS (
  SELECT *, role IS NOT DISTINCT FROM lag(role) OVER w AS goes_on,
    length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) AS body,
    length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '|', '&#124;')) AS head
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(body + CASE WHEN goes_on THEN 3 ELSE head + 8 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id"""
