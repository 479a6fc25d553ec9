"""Repeated passages by FM-indexes, one per shard, with backward search over wavelet matrices.

Content decides the shard. Of every window of 13 words the smallest of its 4-word grams (by hash) is the anchor; neighbouring
windows with the same anchor form one segment, and equal windows have equal anchors, so they meet in one shard. Steps:

0. Rows with the very text of a smaller document are set aside: all their windows repeat.
1. A window has nine words besides its anchor, so five of them stand on one side: the window repeats only if the anchor with the
   five words before it, or with the five after it, does. Blocks of documents send these 9-word keys, packed and dealt by hash,
   to buckets, which tell the keys of more than one document. A key goes once a block, not once a document, however
   frequent it is.
2. Documents meet their repeated keys and cut the segments around them; all other text can hold no repeated window.
3. Equal segments are one, with the smallest document id. A shard builds the index of its segments and streams them
   through it: the matching statistic of a window's last word, cut at 13, comes from backward search; where it reaches 13,
   the interval of the suffix array gives the smallest document that holds the window.
4. A document's windows that a smaller document holds as well are the reported intervals; their words go.

Windows are judged on the input. A document is told by its id: the same passage twice in one document, or in rows with the same
id, is no repetition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import frozen, gram_hashes, hashes, mixed, partitions, pieces, split_words

WINDOW, GRAM = 13, 4
#: Words on one side of an anchor that a window has at least.
SIDE = (WINDOW - GRAM + 1) // 2
#: Rows (80 bytes at most) up to which ids are sent to the texts; beyond, both are joined by id.
HELD = 500_000


def anchors(word_hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the smallest gram of every window of one text, the leftmost if equal."""
    grams, inside = gram_hashes(word_hashes, gram), window - gram + 1
    if len(grams) < inside:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, inside)
    at = views.argmin(axis=1) + np.arange(len(views))
    return grams[at], at


def keys_of(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every anchor the key with the words before it and the one with the words after it, 56 bits each; 0 where the text ends first."""
    grams = gram_hashes(h, GRAM + SIDE) >> np.uint64(8)
    before, after = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    fits = at >= SIDE
    before[fits] = grams[at[fits] - SIDE]
    fits = at < len(grams)
    after[fits] = grams[at[fits]]
    return before, after


def distinct_keys(h: np.ndarray) -> np.ndarray:
    at = np.unique(anchors(h)[1])
    found = np.unique(np.concatenate(keys_of(h, at)))
    return found[found > 0]


def _each(codes: np.ndarray, ends: np.ndarray, words: list[bytes]) -> Iterator[np.ndarray]:
    own = hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield own[a:b]


# ---- step 1: which keys occur in more than one document

PACKED = "target string, kind int, n int, pack binary"


def repeated_keys(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, found array<long>): the keys of a document that other documents have too, a row for each document that has any.

    What a bucket has told goes on packed by document hash, since a row for each document and bucket would grow faster than
    the documents do.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(ids):
                continue
            found = [distinct_keys(h) for part in pieces(batch.column("text")) for h in _each(*split_words(part))]
            who, what = np.repeat(ids, [len(f) for f in found]), np.concatenate(found)
            order = np.lexsort((who, what))
            who, what = who[order], what[order]
            first = np.ones(len(what), bool)
            first[1:] = what[1:] != what[:-1]
            group = np.cumsum(first) - 1
            starts = np.flatnonzero(first)
            many = np.zeros(0, bool)
            if len(starts):
                many = np.maximum.reduceat(who, starts) > np.minimum.reduceat(who, starts)
            known = many[group] if len(group) else np.zeros(0, bool)
            targets, kinds, sizes, packs = [], [], [], []
            if known.any():  # repeated within the block: known at once
                targets.append(f"d{part}-{number}")
                kinds.append(0)
                sizes.append(int(known.sum()))
                packs.append(zstandard.compress(who[known].tobytes() + what[known].tobytes(), 1))
            own, one, several = what[starts], who[starts], many.astype(np.uint8)
            bucket = (own >> np.uint64(20)) % np.uint64(buckets)
            for b in np.unique(bucket).tolist():
                here = bucket == b
                targets.append(f"b{b}")
                kinds.append(1)
                sizes.append(int(here.sum()))
                packs.append(zstandard.compress(own[here].view(np.uint8).reshape(-1, 8)[:, :7].T.tobytes() + one[here].view(np.uint8).reshape(-1, 8).T.tobytes() + several[here].tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(targets, pa.string()), pa.array(kinds, pa.int32()), pa.array(sizes, pa.int32()), pa.array(packs, pa.binary())], ["target", "kind", "n", "pack"])

    def told(table: pa.Table) -> pa.Table:
        who, what, several = [], [], []
        for kind, n, pack in zip(*(table.column(c).to_pylist() for c in ("kind", "n", "pack")), strict=True):
            raw = np.frombuffer(zstandard.decompress(pack), np.uint8)
            if kind == 0:
                pair = raw.view(np.int64)
                who, what = who + [pair[:n]], what + [pair[n:].view(np.uint64)]
            else:
                key = np.zeros((n, 8), np.uint8)
                key[:, :7] = raw[: 7 * n].reshape(7, n).T
                one = np.ascontiguousarray(raw[7 * n : 15 * n].reshape(8, n).T)
                what, who, several = what + [key.reshape(-1).view(np.uint64)], who + [one.reshape(-1).view(np.int64)], several + [raw[15 * n :].astype(bool)]
        who, what = np.concatenate(who), np.concatenate(what)
        if several:  # a bucket: anchors of several blocks with different documents, and those repeated within a block elsewhere
            marked = np.concatenate(several)
            order = np.argsort(what, kind="stable")
            who, what, marked = who[order], what[order], marked[order]
            first = np.ones(len(what), bool)
            first[1:] = what[1:] != what[:-1]
            starts, group = np.flatnonzero(first), np.cumsum(first) - 1
            many = (np.maximum.reduceat(who, starts) > np.minimum.reduceat(who, starts)) | np.logical_or.reduceat(marked, starts)
            # what is marked has been told within its block already
            keep = many[group] & ~marked
            who, what = who[keep], what[keep]
        to = mixed(who.view(np.uint64)) % np.uint64(buckets)
        order = np.lexsort((what, who, to))
        who, what, to = who[order], what[order], to[order]
        parts, starts = np.unique(to, return_index=True)
        ends = np.append(starts[1:], len(to))[: len(starts)]
        packs = [zstandard.compress(who[a:b].view(np.uint8).reshape(-1, 8).T.tobytes() + what[a:b].view(np.uint8).reshape(-1, 8).T.tobytes(), 1) for a, b in zip(starts, ends, strict=True)]
        return pa.table({"part": pa.array(parts.astype(np.int64), pa.int64()), "n": pa.array(ends - starts, pa.int32()), "pack": pa.array(packs, pa.binary())})

    def merged(table: pa.Table) -> pa.Table:
        who, what = [], []
        for n, pack in zip(table.column("n").to_pylist(), table.column("pack").to_pylist(), strict=True):
            whole = np.ascontiguousarray(np.frombuffer(zstandard.decompress(pack), np.uint8).reshape(2, 8, n).transpose(0, 2, 1))
            who.append(whole[0].reshape(-1).view(np.int64))
            what.append(whole[1].reshape(-1).view(np.uint64))
        who, what = np.concatenate(who), np.concatenate(what)
        order = np.lexsort((what, who))
        who, what = who[order], what[order]
        again = np.zeros(len(who), bool)
        again[1:] = (who[1:] == who[:-1]) & (what[1:] == what[:-1])
        who, what = who[~again], what[~again]
        starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        return pa.table({"doc_id": pa.array(who[starts], pa.int64()), "found": pa.ListArray.from_arrays(pa.array(np.append(starts, len(who)), pa.int32()), pa.array(what.view(np.int64)))})

    packed = docs.mapInArrow(blocks, PACKED).groupBy("target").applyInArrow(told, "part long, n int, pack binary")
    return packed.groupBy("part").applyInArrow(merged, "doc_id long, found array<long>")


# ---- step 2: segments

def segments(hits: DataFrame) -> DataFrame:
    """(doc_id, own, start, anchor, digest, words) of every run of windows around an anchor with a repeated key; hits: (doc_id, own, text, found)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, ends, words = split_words(batch.column("text"))
            found, ids, texts = batch.column("found"), batch.column("doc_id").to_pylist(), batch.column("own").to_pylist()
            rows: list[tuple] = []
            for i, h in enumerate(_each(codes, ends, words)):
                smallest, at = anchors(h)
                if not len(at):
                    continue
                first = np.ones(len(at), bool)
                first[1:] = at[1:] != at[:-1]
                starts = np.flatnonzero(first)
                stops = np.append(starts[1:], len(at))
                known = found[i].values.to_numpy().view(np.uint64)
                keep = np.logical_or(*(np.isin(k, known) for k in keys_of(h, at[starts])))
                own = codes[ends[i] : ends[i + 1]].tolist()
                for s, e, a in zip(starts[keep].tolist(), stops[keep].tolist(), smallest[starts][keep].view(np.int64).tolist(), strict=True):
                    text = b" ".join([words[c] for c in own[s : e + WINDOW - 1]])
                    rows.append((ids[i], texts[i], s, a, hashlib.blake2b(text, digest_size=16).digest(), text))
                if len(rows) > 50_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "own", "start", "anchor", "digest", "words"])

    return hits.select("doc_id", "own", "text", "found").mapInArrow(cut, "doc_id long, own binary, start int, anchor long, digest binary, words binary")


# ---- step 3: the index of a shard

class Bits:
    """A bit vector with rank: 64-bit words and the number of ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)
        self.zeros = int(len(bits) - ones.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FmIndex:
    """Suffix array intervals of patterns of up to `reach` symbols, by backward search over the text's BWT.

    Symbols are 1 and up, 0 separates texts. Suffixes are sorted by their first `reach` symbols or more, which is all that
    patterns of that length can tell apart. The BWT is kept as a wavelet matrix. Nothing is compressed: the suffix
    array is whole, the bit vectors are plain.
    """

    def __init__(self, text: np.ndarray, reach: int) -> None:
        self.n = len(text)
        rank = text.astype(np.int64)
        span = 1
        while span <= reach:
            later = np.zeros(self.n, np.int64)
            later[: self.n - span] = rank[span:] + 1
            key = rank * (self.n + int(text.max()) + 2) + later
            self.suffixes = np.argsort(key, kind="stable")
            ordered = key[self.suffixes]
            rank = np.empty(self.n, np.int64)
            rank[self.suffixes] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            span *= 2
        bwt = text[self.suffixes - 1].astype(np.int64)  # the text ends with a separator, which stands before its first symbol
        self.levels, depth = [], max(1, int(text.max()).bit_length())
        for bit in range(depth - 1, -1, -1):
            bits = (bwt >> bit) & 1
            self.levels.append((bit, Bits(bits.astype(np.uint8))))
            bwt = np.concatenate([bwt[bits == 0], bwt[bits == 1]])
        counts = np.bincount(text, minlength=int(text.max()) + 1)
        self.below = np.cumsum(counts) - counts
        self.origin = self._down(np.zeros(len(counts), np.int64), np.arange(len(counts)))

    def _down(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for bit, bits in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> bit) & 1, bits.zeros + ones, at - ones)
        return at

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from the intervals of the patterns."""
        base = self.below[symbol] - self.origin[symbol]
        return self._down(low, symbol) + base, self._down(high, symbol) + base


def smallest_holders(texts: list[bytes], holders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all windows of all texts, in order: the smallest holder of a text that has the window; and the windows of each text.

    A window is searched from its last word to its first. Where the interval has shrunk to one suffix, the window occurs
    nowhere else and the search ends early: its only holder is its own text's.
    """
    codes, ends, words = split_words(pa.array(texts, pa.binary()).cast(pa.string()))
    order = np.argsort(np.array(words, dtype=object))
    code_of = np.empty(len(words), np.int64)
    code_of[order] = np.arange(1, len(words) + 1)
    sizes = np.diff(ends)
    text = np.zeros(len(codes) + len(texts), np.int64)
    text[np.arange(len(codes)) + np.repeat(np.arange(len(texts)), sizes)] = code_of[codes]
    index = FmIndex(text, WINDOW)
    windows = np.maximum(sizes - WINDOW + 1, 0)
    starts = (ends[:-1] + np.arange(len(texts)))
    begin = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    out = np.repeat(holders, windows)
    holder_at = np.repeat(holders, sizes + 1)[index.suffixes]
    live = np.arange(len(begin))
    low, high = np.zeros(len(begin), np.int64), np.full(len(begin), index.n, np.int64)
    for back in range(WINDOW - 1, -1, -1):
        low, high = index.extend(low, high, text[begin[live] + back])
        several = high - low > 1
        live, low, high = live[several], low[several], high[several]
    if len(live):
        spans, inverse = np.unique(low * (index.n + 1) + high, return_inverse=True)
        a, b = spans // (index.n + 1), spans % (index.n + 1)
        at = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange((b - a).sum())
        out[live] = np.minimum.reduceat(holder_at[at], np.cumsum(b - a) - (b - a))[inverse]
    return out, windows


def searched(distinct: DataFrame) -> DataFrame:
    """(digest, holders array<long>): per window of a segment the smallest document that holds it; distinct: (digest, holder, words, shard)."""

    def shard(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        out, windows = smallest_holders(table.column("words").to_pylist(), table.column("holder").to_numpy())
        ends = np.concatenate([[0], np.cumsum(windows)])
        return pa.table({"digest": table.column("digest"), "holders": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int64()))})

    return distinct.groupBy("shard").applyInArrow(shard, "digest binary, holders array<long>")


# ---- step 4

def few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= HELD else ids


def met(rows: DataFrame, figures: DataFrame, by: list[str]) -> DataFrame:
    """Rows beside their figures. While the ids are few, they go to the texts first, so that other texts are not shuffled."""
    return rows.join(few(figures.select(by)), by, "left_semi").join(figures, by)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, spans array<array<int>>, kept_text), one row per row of `docs`.

    Spans are [first, end) runs of removed words. A null text has no words; a text of fewer than 13 words stays whole. A row
    without an id neither removes nor is removed from. Repeated rows stay and are judged alike; of an id with several texts each
    is judged on its own words. An empty table gives an
    empty result; other columns are not read.
    """
    spark = docs.sparkSession
    shards = shards or partitions(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("sha"))
    rows = rows.withColumn("own", F.unhex(F.substring("sha", 1, 32)))  # tells the texts of one id apart
    named = rows.where("doc_id is not null")
    first = named.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = frozen(named.select("doc_id", "sha").join(first, "sha").where("doc_id > first").select("doc_id", "sha").distinct(), "copies")
    held = F.broadcast(copies) if copies.count() <= HELD else copies
    single = named.join(held, ["doc_id", "sha"], "left_anti").select("doc_id", "own", "text")
    found = frozen(repeated_keys(single.select("doc_id", "text"), shards), "found")
    own = frozen(segments(met(single, found, ["doc_id"])), "segments")
    distinct = own.groupBy("digest").agg(F.min("doc_id").alias("holder"), F.min("anchor").alias("anchor"), F.first("words").alias("words"))
    answers = searched(distinct.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))))
    hits = own.select("doc_id", "own", "start", "digest").join(answers, "digest").where(F.exists("holders", lambda h: h < F.col("doc_id")))
    at = F.filter(F.transform("holders", lambda h, i: F.when(h < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull())
    gone = frozen(hits.groupBy("doc_id", "own").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(at)))).alias("gone")), "gone")
    marked = rows.join(held.withColumn("copy", F.lit(True)), ["doc_id", "sha"], "left").select("doc_id", "own", "text", F.coalesce("copy", F.lit(False)).alias("copy"))
    whole = marked.join(few(gone.select("doc_id", "own")), ["doc_id", "own"], "left_anti").withColumn("gone", F.lit(None).cast("array<int>"))
    joined = met(marked, gone, ["doc_id", "own"]).unionByName(whole)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, ends, words = split_words(batch.column("text"))
            n_words, n_removed, spans, texts = [], [], [], []
            for i, (gone, copy) in enumerate(zip(batch.column("gone"), batch.column("copy"), strict=True)):
                own = codes[ends[i] : ends[i + 1]]
                stay = np.ones(len(own), bool)
                runs: list[list[int]] = []
                if copy.as_py() and len(own) >= WINDOW:
                    stay[:], runs = False, [[0, len(own)]]
                elif gone.is_valid and not copy.as_py():
                    edge = np.zeros(len(own) + 1, np.int64)
                    first = gone.values.to_numpy()
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + WINDOW, -1)
                    stay = np.cumsum(edge)[:-1] == 0
                    turns = np.flatnonzero(np.diff(np.concatenate([[True], stay, [True]]).astype(np.int8)))
                    runs = turns.reshape(-1, 2).tolist()
                n_words.append(len(own))
                n_removed.append(int(len(own) - stay.sum()))
                spans.append(runs)
                texts.append(b" ".join([words[c] for c in own[stay].tolist()]))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(texts, pa.binary()).cast(pa.string()),
            ], ["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return joined.select("doc_id", "text", "gone", "copy").mapInArrow(kept, "doc_id long, n_words long, n_removed long, spans array<array<int>>, kept_text string")


SQL = r"""
WITH split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
  windows AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 11, 1))) AS i, ws FROM split),
  keyed AS (SELECT doc_id, i, hash(array_to_string(ws[i:i + 12], ' ')) AS k1, md5_number(array_to_string(ws[i:i + 12], ' ')) AS k2 FROM windows),
  judged AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k1, k2) AS holder FROM keyed),
  gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS g FROM judged WHERE holder < doc_id GROUP BY doc_id),
  kept AS (SELECT s.doc_id, len(ws) AS n_words, coalesce(len(g), 0) AS n_removed,
    CASE WHEN g IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(g, x[2])), lambda x: x[1]) END AS k
    FROM split s LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept"""
