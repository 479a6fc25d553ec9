"""Near-duplicates: MinHash bands propose, odd sketches sift, full shingle sets decide.

A document's set is its distinct 5-word shingles. Documents with equal sets are one class with one representative. 36 bands of 4
MinHash values put pairs of similarity 0.75 into a common bucket with a probability of 1 - 1e-6. All 144 values are also folded
into a parity bitmap of 512 bits (odd sketch): the population count of two bitmaps' XOR tells how many values differ, and
pairs that cannot reach the threshold (six standard deviations) go before any text is read. What is left is compared set by set.

No bucket emits its pairs. Each bucket proposes its members to its most central one, the member whose buckets are
fullest: of a group of near copies, that is the original. Once that has been decided, members outside of the bucket's largest
component meet the members of other components block by block, by bitmaps and then by full sets, and a block emits a forest of
links; so nothing is lost where the central member is not similar to all, and no pairs are written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import components, frozen, gram_hashes, hashes, mixed, partitions, pieces, split_words

SIZE, BANDS, ROWS, BITS = 5, 36, 4, 512
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Most differing bits of a pair that is compared in full: 144 samples at a similarity of 0.52 differ in about as many.
NEAR_BITS = 107
_RNG = np.random.default_rng(20240229)
#: Ids (8 bytes each) up to which they are sent to the texts.
HELD = 1_000_000
FACTORS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(texts: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; a text of fewer words is one shingle, an empty or null one has none."""
    codes, ends, words = split_words(texts, lower=True)
    word_hashes = hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    grams, out = gram_hashes(word_hashes, size), []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            out.append(gram_hashes(word_hashes[a:b], b - a) ^ np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


def minhashes(found: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of the permutations."""
    low = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        values = FACTORS[:, None] * found[None, at : at + 1024]
        values += SHIFTS[:, None]
        np.minimum(low, values.min(axis=1), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    out = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + low[r::ROWS])
    return out.view(np.int64)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Parity of the number of samples that fall on each bit."""
    spots = mixed(low + np.arange(len(low), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(BITS)
    return np.packbits((np.bincount(spots.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, keys, bits) for (doc_id, text) rows; the last three are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), hashlib.sha256(s.tobytes()).digest()[:16] if len(s) else None, minhashes(s) if len(s) else None) for part in pieces(batch.column("text")) for s in shingle_sets(part)]
            counts, own, lows = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(counts, pa.int64()),
                pa.array(own, pa.binary()),
                pa.array([None if x is None else bands(x) for x in lows], pa.list_(pa.int64())),
                pa.array([None if x is None else odd_sketch(x) for x in lows], pa.list_(pa.int64())),
            ], ["doc_id", "n_shingles", "digest", "keys", "bits"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>, bits array<long>")


def able(bits_a: Column, bits_b: Column, size_a: Column, size_b: Column) -> Column:
    """Whether sizes and bitmaps leave a chance of a link."""
    differ = sum((F.bit_count(F.get(bits_a, i).bitwiseXOR(F.get(bits_b, i))) for i in range(BITS // 64)), F.lit(0))
    return (100 * F.least(size_a, size_b) >= PERCENT * F.greatest(size_a, size_b)) & (differ <= NEAR_BITS)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The (doc_id, text) rows of `ids`, written once. While there are few ids (8 bytes each) they go to the texts, else both are joined by id."""
    ids = frozen(ids.distinct(), "ids")
    return frozen(docs.join(F.broadcast(ids) if ids.count() <= HELD else ids, "doc_id", "left_semi"), "texts")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those (a, b) whose full sets reach the threshold. Texts meet their pairs by two equi-joins, of which Spark splits hot keys."""
    needed = texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    full = pairs.join(needed.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(needed.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, at = [], 0
            for part in pieces(batch.column("tb")):
                left = batch.column("ta").slice(at, len(part)).dictionary_encode()  # a central document stands beside many others
                sets_a, sets_b = shingle_sets(left.dictionary), shingle_sets(part)
                for j, y in zip(left.indices.to_pylist(), sets_b, strict=True):
                    both = len(np.intersect1d(sets_a[j], y, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= PERCENT * (len(sets_a[j]) + len(y) - both))
                at += len(part)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return full.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


# ---- what the central members leave open

def blockwise(rows: DataFrame, decide, schema: str, most: int) -> DataFrame:
    """`decide(left, right)` for the outsiders beside all members of every group, block by block.

    rows: (group, doc_id, root, outside, ...). A group of more than `most` rows is dealt to blocks by hash, and every block of
    outsiders meets every block of members in a task of its own. `decide` takes and returns Arrow tables and emits no pairs but
    a forest, at most a row per row.
    """
    parts = 4 * partitions(rows.sparkSession)
    sizes = rows.groupBy("group").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "group").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = dealt.where("outside").withColumn("i", F.col("own")).withColumn("j", every)
    right = dealt.toDF(*dealt.columns).withColumn("j", F.col("own")).withColumn("i", every)
    part = F.pmod(F.xxhash64("group", "i", "j"), F.lit(parts))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if len(a) and len(b):
            names = ["group", "i", "j"]
            a, b = (t.sort_by([(n, "ascending") for n in names]).combine_chunks() for t in (a, b))
            keys_a, keys_b = (list(zip(*(t[n].to_pylist() for n in names), strict=True)) for t in (a, b))
            at, ends = 0, {}
            for n, key in enumerate(keys_b):
                ends.setdefault(key, [n, n])[1] = n + 1
            while at < len(keys_a):
                end = at
                while end < len(keys_a) and keys_a[end] == keys_a[at]:
                    end += 1
                if keys_a[at] in ends:
                    lo, hi = ends[keys_a[at]]
                    out.append(decide(a.slice(at, end - at), b.slice(lo, hi - lo)))
                at = end
        return pa.concat_tables(out) if out else decide(a.slice(0, 0), b.slice(0, 0))

    return left.withColumn("part", part).groupBy("part").cogroup(right.withColumn("part", part).groupBy("part")).applyInArrow(run, schema)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy(zero_copy_only=False)


def sifted_blocks(a: pa.Table, b: pa.Table) -> pa.Table:
    """Outsiders and members with a counterpart in another component that sizes and bitmaps allow."""
    hit_a, hit_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    if len(a) and len(b):
        x, y = (np.stack(t["bits"].to_pylist()).astype(np.int64).view(np.uint64) for t in (a, b))
        n_x, n_y, r_x, r_y = _numbers(a, "n_shingles"), _numbers(b, "n_shingles"), _numbers(a, "root"), _numbers(b, "root")
        for i in range(len(a)):
            able_ = (r_y != r_x[i]) & (100 * np.minimum(n_x[i], n_y) >= PERCENT * np.maximum(n_x[i], n_y))
            at = np.flatnonzero(able_)
            at = at[np.bitwise_count(x[i] ^ y[at]).sum(axis=1) <= NEAR_BITS]
            hit_a[i] |= len(at) > 0
            hit_b[at] = True
    names = ["group", "doc_id", "root", "outside"]
    return pa.concat_tables([a.select(names).filter(pa.array(hit_a)), b.select(names).filter(pa.array(hit_b))])


def linked_blocks(a: pa.Table, b: pa.Table) -> pa.Table:
    """A forest of the links between components, by full sets: an outsider's shingles count the members that hold them."""
    found: list[tuple[int, int]] = []
    if len(a) and len(b):
        sets_b = [np.frombuffer(s, np.uint64) for s in b["shingles"].to_pylist()]
        sizes = np.array(list(map(len, sets_b)))
        values, member = np.concatenate(sets_b), np.repeat(np.arange(len(b)), sizes)
        order = np.argsort(values, kind="stable")
        values, member = values[order], member[order]
        id_a, id_b, r_a, r_b = a["doc_id"].to_pylist(), b["doc_id"].to_pylist(), a["root"].to_pylist(), b["root"].to_pylist()
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, raw in enumerate(a["shingles"].to_pylist()):
            own = np.frombuffer(raw, np.uint64)
            lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            n = hi - lo
            spread = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(member[spread], minlength=len(b))
            for m in np.flatnonzero((both > 0) & (100 * both >= PERCENT * (len(own) + sizes - both))).tolist():
                p, q = root(r_a[i]), root(r_b[m])
                if p != q:
                    parent[p] = q
                    found.append((id_a[i], id_b[m]))
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def remaining_links(crowded: DataFrame, roots: DataFrame, marks: DataFrame, docs: DataFrame, most: int) -> DataFrame:
    """(a, b): links between members of one bucket that lie in different components.

    Buckets with the same largest component are one group: the members of that component, and the outsiders of all these buckets.
    """
    placed = crowded.where("c > 2").join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    placed = frozen(placed, "placed")
    sums = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = sums.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("top.root").alias("group"))
    rows = placed.join(main, "key").select("group", "doc_id", "root", (F.col("root") != F.col("group")).alias("outside")).distinct()
    near = blockwise(frozen(rows.join(marks, "doc_id"), "mixed"), sifted_blocks, "group long, doc_id long, root long, outside boolean", most)
    near = frozen(near.distinct(), "near")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for part in pieces(batch.column("text")) for s in shingle_sets(part)], pa.binary())], ["doc_id", "shingles"])

    full = texts_of(docs, near.select("doc_id")).mapInArrow(sets, "doc_id long, shingles binary")
    return blockwise(near.join(full, "doc_id"), linked_blocks, "a long, b long", most)


def shared_ids(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): for every id with several texts, links from the smallest to the others of the nodes that its texts stand for."""
    own = sketches.where("doc_id is not null").select("doc_id", "digest")
    empty = F.coalesce("digest", F.lit(b""))
    several = frozen(own.groupBy("doc_id").agg(F.min(empty).alias("low"), F.max(empty).alias("high")).where("low <> high").select("doc_id"), "several")
    nodes = own.join(F.broadcast(several) if several.count() <= HELD else several, "doc_id", "left_semi").distinct().join(classes, "digest", "left")
    nodes = frozen(nodes.select("doc_id", F.coalesce("rep", "doc_id").alias("b")), "nodes")
    least = nodes.groupBy("doc_id").agg(F.min("b").alias("a"))
    return nodes.join(least, "doc_id").where("a <> b").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 2_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of `docs`.

    Documents without words are linked with nothing. Rows that repeat an id are one node, linked by any of their texts; a row
    without an id is linked with nothing and kept (component null). An empty table gives an empty result; other columns are
    not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = frozen(sketched(rows), "sketches")
    classes = frozen(sketches.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    # one row of each class: its smallest id
    reps = sketches.where("digest is not null").join(classes, "digest").where("doc_id = rep").dropDuplicates(["digest"]).select("doc_id", "n_shingles", "keys", "bits")
    reps = frozen(reps, "reps")
    marks = reps.select("doc_id", "n_shingles", "bits")
    entries = reps.select("doc_id", F.explode("keys").alias("key"))
    full = entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    crowded = frozen(entries.join(full, "key"), "crowded")
    weight = crowded.groupBy("doc_id").agg(F.sum("c").alias("weight"))
    central = crowded.join(weight, "doc_id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("m"))).alias("top")).select("key", (-F.col("top.m")).alias("center"))
    star = frozen(crowded.join(central, "key").where("doc_id <> center").select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct(), "star")

    def sifted(pairs: DataFrame) -> DataFrame:
        side = lambda x: marks.select(F.col("doc_id").alias(x), F.col("n_shingles").alias("n_" + x), F.col("bits").alias("s_" + x))
        return pairs.join(side("b"), "b").join(side("a"), "a").where(able(F.col("s_a"), F.col("s_b"), F.col("n_a"), F.col("n_b"))).select("a", "b")

    links = frozen(confirmed(frozen(sifted(star), "sifted"), rows).union(shared_ids(sketches, classes)), "links")
    roots = components(links)

    more = frozen(remaining_links(crowded, roots, marks, rows, block), "links")
    if not more.isEmpty():
        roots = components(links.union(more))

    known = sketches.select("doc_id", "n_shingles", "digest").join(classes.where("n > 1").select("digest", "rep"), "digest", "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    joined = known.join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("root", "rep"))
    # shared_ids has linked the classes of an id that repeats with several texts
    return joined.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
