"""Spelling variants by a bit-sliced position index.

Words that differ by one inserted, deleted or replaced letter are found with bitsets over a block of words: one for every (position,
letter) that occurs and one for every length. Walking through a word's letters, three sets are kept at once, each a row of 64-bit
lanes: words equal so far, words with one letter replaced (same position), and words with one letter more (position shifted by
one). Each letter costs a few AND and OR operations for 64 words at a time, and all words of a block walk in step. Pairs of unequal
length are found from the shorter word, so the set with one letter less needs no walk of its own.

Blocks: the letters left and right of an error agree. With s the length of the shorter word, two such words share their first or
their last s // 2 letters, so every word is filed under both, for s its own length and the one below. A key with too many words is
halved again: what lies between the agreed ends must agree in its first or last half. Halving ends when one letter is open (two of
a longer word), where only as many words as an alphabet has pairs of letters can share a key, so every block is bounded whatever the
words are. Small keys of one length share
a block.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import frozen

RUN = "A-Za-zÀ-ÿ"
#: A run is misspelt when MISS divides its checksum; words have at least LEAST letters and FEW occurrences; a form has RATIO times as many.
MISS, LEAST, FEW, RATIO = 97, 5, 3, 2
#: Words of a block, their letters, and letters of a text that are split at once.
BLOCK, LETTERS, PART = 2_048, 200_000, 1_000_000
#: Distinct words that a task gathers before it passes their counts on.
HELD = 100_000
_RUNS, _GAP = re.compile(f"[{RUN}]+"), re.compile(f"[^{RUN}]")


def runs(text: str) -> Counter:
    """Occurrences of every run of a text, a part at a time, cut between runs."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PART)
        end = gap.start() if gap else len(text)
        found.update(_RUNS.findall(text[at:end] if at or gap else text))
        at = end
    return found


def words_of(doc_id: int | None, text: str | None) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a document: runs in lower case (A-Z only), one letter deleted where the checksum says so."""
    if not text:
        return
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs(text).items():
        low = run.encode().lower()
        h = zlib.crc32(low, head)
        word = low.decode()
        if h % MISS == 0:
            word = word[: h % len(word)] + word[h % len(word) + 1 :]
        if len(word) >= LEAST:
            yield word, n


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): all words of at least LEAST letters with FEW occurrences. A null text has none; a null id counts as empty before the colon."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("i").to_pylist(), batch.column("t"), strict=True):
                for word, n in words_of(doc_id, text.as_py()):
                    total[word] += n
                if len(total) > HELD:
                    yield told(total)
                    total.clear()
        yield told(total)

    def told(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(count, "word string, n long")
    return frozen(rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= FEW), "words")


def index_of(words: list[str]) -> tuple[dict[tuple[int, str], int], np.ndarray, dict[int, np.ndarray]]:
    """(row of every (position, letter), their bitsets over the words, bitsets of the lengths)."""
    row: dict[tuple[int, str], int] = {}
    at = [[row.setdefault((i, c), len(row)) for i, c in enumerate(w)] for w in words]
    lanes = -(-len(words) // 64)
    bits = np.zeros((len(row) + 1, lanes), np.uint64)  # the last row: letters that do not occur
    lengths: dict[int, np.ndarray] = {}
    for k, own in enumerate(at):
        bits[own, k >> 6] |= np.uint64(1 << (k & 63))
        lengths.setdefault(len(own), np.zeros(lanes, np.uint64))[k >> 6] |= np.uint64(1 << (k & 63))
    return row, bits, lengths


def neighbours(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of distinct words, i of `size` letters and j of as many or one more, that differ by one letter."""
    row, bits, lengths = index_of(words)
    asked = np.array([k for k, w in enumerate(words) if len(w) == size], np.int64)
    none, lanes = len(row), bits.shape[1]
    if not len(asked):
        return asked, asked
    same = np.full((len(asked), lanes), ~np.uint64(0))
    replaced, longer = np.zeros_like(same), np.zeros_like(same)
    for i in range(size):
        here = bits[[row.get((i, words[k][i]), none) for k in asked]]
        shifted = bits[[row.get((i + 1, words[k][i]), none) for k in asked]]
        longer = (longer | same) & shifted  # the letter more stands before this one, or did earlier
        replaced = (replaced & here) | (same & ~here)
        same &= here
    longer |= same  # or it stands at the end
    blank = np.zeros(lanes, np.uint64)
    found = (replaced & lengths.get(size, blank)) | (longer & lengths.get(size + 1, blank))
    flat = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")
    i, j = np.nonzero(flat)
    return asked[i], j


def halves(size: Column, left: Column, right: Column) -> list[tuple[Column, Column]]:
    """The two pairs of agreed ends (letters on the left, letters on the right) that follow from one."""
    half = F.floor((size - left - right) / 2).cast("int")
    return [(left + half, right), (left, right + half)]


def filed(words: DataFrame, block: int) -> DataFrame:
    """(word, n, size, key): every word under each of its keys, no key with more than `block` words unless one letter is open.

    `size` is the length of the shorter word of a pair.
    """
    length = F.length("word")
    rows = words.withColumn("size", F.explode(F.array(length, length - 1))).withColumns({"a": F.lit(0), "b": F.lit(0)})
    key = F.xxhash64("size", "a", "b", F.substring("word", F.lit(1), F.col("a")), F.expr("right(word, b)"))
    rows = split(rows).withColumn("key", key)
    done: list[DataFrame] = []
    while True:
        rows = frozen(rows, "filed")
        large = rows.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > block).join(
            rows.where(F.col("size") - F.col("a") - F.col("b") > 1).select("key").distinct(), "key", "left_semi")
        large = frozen(large.select("key"), "large")
        if large.isEmpty():
            break
        done.append(rows.join(large, "key", "left_anti"))
        rows = split(rows.join(large, "key", "left_semi").drop("key")).withColumn("key", key)
    for more in done:
        rows = rows.unionByName(more)
    return rows.select("word", "n", "size", "key")


def split(rows: DataFrame) -> DataFrame:
    ends = F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in halves(F.col("size"), F.col("a"), F.col("b"))])
    return rows.withColumn("ends", F.explode(F.array_distinct(ends))).withColumns({"a": F.col("ends.a"), "b": F.col("ends.b")}).drop("ends")


def pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, near, near_n), both ways round, once each: all words that differ by one letter."""
    keys = filed(words, block)
    # keys of one length share blocks; long words in smaller ones, so that a block's letters are bounded too
    room = F.greatest(F.lit(64), F.least(F.lit(block), F.floor(F.lit(LETTERS) / F.col("size"))))
    many = keys.groupBy("size").agg(F.count("*").alias("rows")).select("size", F.ceil(F.col("rows") / room).alias("blocks"))
    dealt = keys.join(many, "size").select("size", F.pmod("key", "blocks").alias("block"), "word", "n")

    def search(key: tuple, table: pa.Table) -> pa.Table:
        known = dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True))  # a word may have several keys here
        words, n = list(known), np.array(list(known.values()), np.int64)
        i, j = neighbours(words, key[0].as_py())
        more = np.fromiter((len(words[x]) != len(words[y]) for x, y in zip(i, j, strict=True)), bool, len(i))  # replaced letters are found both ways
        i, j = np.concatenate([i, j[more]]), np.concatenate([j, i[more]])
        return pa.table({"word": pa.array([words[x] for x in i], pa.string()), "n": n[i], "near": pa.array([words[x] for x in j], pa.string()), "near_n": n[j]})

    return dealt.groupBy("size", "block").applyInArrow(search, "word string, n long, near string, near_n long").distinct()


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word.

    A word's form is its near word of most occurrences (ties: the first by code point), if that has RATIO times its own; its root is
    the end of the chain of forms. Occurrences at least double along it, so the jumps that find all roots are few. An empty table
    gives an empty result; other columns are not read; repeated rows count again.
    """
    words = vocabulary(docs, id_col, text_col)
    near = pairs(words, block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    own = words.join(near, "word", "left").withColumn("form_n", -F.col("best.minus"))
    formed = F.col("form_n") >= RATIO * F.col("n")
    own = frozen(own.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n")), "forms")
    links = frozen(own.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = frozen(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = after.select("word", "root")
        if after.where("moved").isEmpty():
            break
    return own.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_BYTES = "list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT)"
_CRC = "xor(4294967295, list_reduce(list_transform(range(8 * len(bytes)), lambda i: (bytes[i // 8 + 1] >> (i % 8)) & 1), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT))"
SQL = rf"""
WITH RECURSIVE raw AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY 1, 2
), hashed AS (
  SELECT run, n, {_CRC} AS h FROM (SELECT run, n, {_BYTES} AS bytes FROM raw)
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {MISS} = 0 THEN run[:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(n) >= {FEW}
), holes AS (
  SELECT DISTINCT word, n, i, word[:i] || word[i+2:] AS hole FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.i = b.i AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.hole
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.hole
), best AS (
  SELECT word, count(*) AS n_near, min(struct_pack(minus := -near_n, near := encode(near))) AS best FROM near GROUP BY word
), own AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.minus >= {RATIO} * n THEN decode(best.near) END AS form,
    CASE WHEN -best.minus >= {RATIO} * n THEN -best.minus END AS form_n FROM words LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root FROM own
  UNION ALL SELECT k.word, o.form FROM walk k JOIN own o ON o.word = k.root WHERE o.form IS NOT NULL
)
SELECT word, own.form, root, own.n, own.n_near, own.form_n
FROM own JOIN (SELECT k.word, arg_max(k.root, o.n) AS root FROM walk k JOIN own o ON o.word = k.root GROUP BY k.word) USING (word)"""
