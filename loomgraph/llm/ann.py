"""Nearest neighbours by an inverted multi-index.

Unit vectors are cut into two halves, each quantised by its own codebook; a cell is a pair of centroids. A request walks cells in
the order of their summed distance, with a heap over both sorted centroid lists, until the cells it met hold enough
entries; those are reranked by cosine in double precision. How many are enough is measured: `PROBES` requests are answered
by a full scan, and so many entries are visited as `AIM` of their true neighbours would have taken. Clustered vectors need few;
vectors without structure need a large share of all, and then a search costs requests times rows, in blocks.

Equal vectors are one entry that carries its smallest ids, as many as an answer can name, so that copies neither crowd a cell
nor an answer; equal requests are walked once. Cells of very many entries are split into chunks that different tasks
rerank. Codebooks are fitted on a bounded sample of entries (`SAMPLE`); every entry is indexed.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import frozen, partitions

#: Most vectors that the codebooks are fitted on.
SAMPLE = 20_000
#: Most centroids of a half: cell counts, the only figures of the whole index that the driver sees, are at most its square.
MOST = 256
#: Entries that a request visits at least, and entries of a chunk.
VISIT, CHUNK = 1_000, 4_096
#: Factor of the cell in a chunk's key.
WIDE = 1 << 20
#: Requests that set the number of visits, and the share of true neighbours aimed at.
PROBES, AIM = 128, 0.97


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): finite, non-zero vectors of the most frequent length; of rows that repeat an id, the smallest vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where(
        "vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1)[None]


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means from k different points of the sample."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centroids = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = distances(x, centroids).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centroids))
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, visit: int) -> list[int]:
    """Cells (row * columns + column) by growing first[row] + second[column], until they hold `visit` entries or all were met."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    left, right, width = first[a].tolist(), second[b].tolist(), len(second)
    heap, got, cells = [(left[0] + right[0], 0, 0)], 0, []
    while heap and got < visit:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * width + int(b[j])
        if counts[cell]:
            cells.append(cell)
            got += int(counts[cell])
        if j + 1 < len(right):
            heapq.heappush(heap, (left[i] + right[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(left):
            heapq.heappush(heap, (left[i + 1] + right[0], i + 1, 0))
    return cells


def search(vectors: DataFrame, asked: str = "vec_id % 50 = 0", k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", visit: int = VISIT) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest found of every row for which `asked` holds, itself excluded.

    Null ids, null, empty or zero vectors and vectors with null or non-finite components take no part, nor do vectors of
    another length than the most frequent. Ties go to the smaller id. A request with fewer than `k` candidates gets all.
    An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    by_id = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= k + 1)
    entries = frozen(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("e", F.element_at("ids", 1)), "entries")
    requests = frozen(rows.where(asked).select(F.col("vec_id").alias("query_id"), "v").join(entries.select("v", "e"), "v"), "requests")
    n = entries.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = entries.select("v", F.xxhash64("e").alias("h")).orderBy("h").limit(SAMPLE).drop("h").toArrow().column("v").combine_chunks()
    fitted = unit(matrix(sample))
    half = (fitted.shape[1] + 1) // 2
    size = int(np.clip(round(math.sqrt(n / 16)), 2, MOST))
    books = [codebook(fitted[:, :half], size, 1), codebook(fitted[:, half:], size, 2)]
    width = len(books[1])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch.column("v")))
            cells = distances(x[:, :half], books[0]).argmin(1) * width + distances(x[:, half:], books[1]).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("e"), batch.column("v"), batch.column("ids"), pa.array(cells, pa.int64())], ["e", "v", "ids", "cell"])

    kind = dict(entries.dtypes)["v"]
    index = frozen(entries.select("e", "v", "ids").mapInArrow(placed, f"e long, v {kind}, ids array<long>, cell long"), "index")
    counts = np.zeros(len(books[0]) * width, np.int64)
    for r in index.groupBy("cell").count().collect():  # at most MOST * MOST rows
        counts[r["cell"]] = r["count"]
    parts = partitions(spark)
    visit = max(visit, enough(index, requests, books, counts, k))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch.column("v")))
            first, second = distances(x[:, :half], books[0]), distances(x[:, half:], books[1])
            for q in range(len(x)):  # a row for every part that holds one of its cells, not one for every cell
                cells = np.array(walk(first[q], second[q], counts, visit), np.int64)
                chunks = -(-counts[cells] // CHUNK)
                key = np.repeat(cells, chunks) * WIDE + np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
                part = (key // WIDE * 31 + key % WIDE) % parts
                order = np.argsort(part, kind="stable")
                own, starts = np.unique(part[order], return_index=True)
                taken = batch.take(pa.array(np.full(len(own), q)))
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)), pa.int32()), pa.array(key[order]))
                yield pa.RecordBatch.from_arrays([taken.column("e"), taken.column("v"), lists, pa.array(own, pa.int64())], ["q", "v", "keys", "part"])

    chunk_of = F.pmod(F.xxhash64("e"), F.element_at(F.lit((np.maximum(-(-counts // CHUNK), 1)).tolist()), F.col("cell").cast("int") + 1))
    own = index.withColumn("chunk", chunk_of).withColumn("part", (F.col("cell") * 31 + F.col("chunk")) % parts)
    asks = requests.select("e", "v").dropDuplicates(["e"]).mapInArrow(walked, f"q long, v {kind}, keys array<long>, part long")

    def reranked(asking: pa.Table, entry: pa.Table) -> pa.Table:
        """All chunks of a part: per request the best k + 1 entries of each chunk."""
        out_q, out_score, out_ids = [], [], []
        if len(asking) and len(entry):
            q = asking.combine_chunks()
            e = entry.take(pa.array(np.lexsort((entry["chunk"].to_numpy(), entry["cell"].to_numpy())))).combine_chunks()
            e_key = e["cell"].to_numpy() * WIDE + e["chunk"].to_numpy()
            lists = q["keys"].combine_chunks()
            q_key, q_row = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
            order = np.argsort(q_key, kind="stable")
            q_key, q_row = q_key[order], q_row[order]
            qx, ex = unit(matrix(q["v"].combine_chunks())), unit(matrix(e["v"].combine_chunks()))
            e_id = e["e"].to_numpy()
            for key in np.intersect1d(q_key, e_key):
                (a, b), (c, d) = (np.searchsorted(k_, [key, key + 1]) for k_ in (q_key, e_key))
                scores = qx[q_row[a:b]] @ ex[c:d].T
                if d - c > k + 1:  # what ties with the last place stays
                    border = np.partition(scores, d - c - k - 1, axis=1)[:, d - c - k - 1 : d - c - k]
                    at, col = np.nonzero(scores >= border - 1e-12)
                else:
                    at, col = np.nonzero(np.ones_like(scores, bool))
                out_q.append(q_row[a:b][at])
                out_ids.append(c + col)
                out_score.append(scores[at, col])
            rows, ids, near = (np.concatenate(x) if x else np.zeros(0, int) for x in (out_q, out_ids, out_score))
            # of all chunks of the part, the best of each request
            order = np.lexsort((e_id[ids], -near, rows))
            rows, ids, near = rows[order], ids[order], near[order]
            first = np.searchsorted(rows, np.arange(len(q)))
            place = np.arange(len(rows)) - first[rows]
            last = near[np.minimum(first + k, len(near) - 1)] if len(near) else near
            keep = (place <= k) | (near >= last[rows] - 1e-12) if len(rows) else np.zeros(0, bool)
            rows, ids = rows[keep], ids[keep]
            exact = _cosine(matrix(q["v"].combine_chunks())[rows], matrix(e["v"].combine_chunks())[ids])
            return pa.table({"q": q["q"].take(pa.array(rows)), "e": e["e"].take(pa.array(ids)), "ids": e["ids"].take(pa.array(ids)), "score": pa.array(exact)})
        return pa.table({"q": pa.array([], pa.int64()), "e": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})

    scored = asks.groupBy("part").cogroup(own.groupBy("part")).applyInArrow(reranked, "q long, e long, ids array<long>, score double")
    ahead = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = scored.select("q", "score", F.explode("ids").alias("vec_id")).withColumn("at", F.row_number().over(ahead)).where(F.col("at") <= k + 1)
    answers = requests.select("query_id", F.col("e").alias("q")).join(top, "q").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("at"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def enough(index: DataFrame, requests: DataFrame, books: list[np.ndarray], counts: np.ndarray, k: int) -> int:
    """Entries that `AIM` of the true neighbours of at most `PROBES` requests take, cells by growing summed distance."""
    probes = requests.select("e", "v").dropDuplicates(["e"]).orderBy(F.xxhash64("e")).limit(PROBES).toArrow()
    if not len(probes):
        return 0
    ids, x, half = probes["e"].to_numpy(), unit(matrix(probes["v"].combine_chunks())), books[0].shape[1]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = x @ unit(matrix(batch.column("v"))).T
            scores[ids[:, None] == batch.column("e").to_numpy()[None]] = -np.inf
            keep = min(k, scores.shape[1])
            best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
            at = np.repeat(np.arange(len(ids)), keep)
            found = batch.take(pa.array(best.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(at), found.column("e"), found.column("cell"), pa.array(scores[at, best.ravel()])], ["p", "e", "cell", "score"])

    near = index.mapInArrow(scanned, "p long, e long, cell long, score double").where("score >= -1")
    near = near.withColumn("at", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("score"), "e"))).where(F.col("at") <= k)
    first, second = distances(x[:, :half], books[0]), distances(x[:, half:], books[1])
    need = []
    for r in near.select("p", "cell").collect():  # at most PROBES * k rows
        sums = (first[r["p"]][:, None] + second[r["p"]][None]).ravel()
        need.append(int(counts[sums <= sums[r["cell"]]].sum()))
    return int(np.ceil(np.quantile(need, AIM))) if need else 0


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
