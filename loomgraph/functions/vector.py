"""Cosine search with numpy inside the tasks: Arrow in, per-task top-k out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.scale import top_per_group
from loomgraph.session import cut_lineage

HIT_SCHEMA = "qid bigint, id bigint, distance double"
#: Requests of one search of a batch from the driver; in `neighbours` cells, rows of a chunk of a tile and requests of a block (one group
#: holds both), requests whose distances are held at once.
SEARCH_ROWS, CELLS, BLOCK_ROWS, STRIPE = 4096, 64, 16384, 128


@dataclass
class VectorQuery:
    qid: int
    vector: list[float]
    type: str = ""
    project: str = ""
    exclude_id: int | None = None


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns in double; 0 where lengths differ or a norm is 0."""
    def dot(x, y):
        pairs = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) == F.size(b)) & (norms > 0)
    return F.when(usable, dot(a, b) / norms).otherwise(F.lit(0.0))


def _search_partitions(queries: list[VectorQuery], k: int):
    dim = len(queries[0].vector)
    q = np.asarray([v.vector for v in queries], dtype=np.float64)
    norm = np.linalg.norm(q, axis=1, keepdims=True)
    unit = np.divide(q, norm, out=np.zeros_like(q), where=norm > 0)
    silent = norm[:, 0] == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(queries)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column("id").to_numpy()
            types, projects = batch.column("type").to_pandas().values, batch.column("project").to_pandas().values
            m = batch.column("embedding").flatten().to_numpy().astype(np.float64).reshape(len(ids), dim)
            size = np.linalg.norm(m, axis=1, keepdims=True)
            m = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
            dist = np.round(1.0 - m @ unit.T, 9)
            for i, query in enumerate(queries):
                if silent[i]:
                    continue
                keep = np.ones(len(ids), bool)
                if query.type:
                    keep &= types == query.type
                if query.project:
                    keep &= projects == query.project
                if query.exclude_id is not None:
                    keep &= ids != query.exclude_id
                cid = np.concatenate([best[i][0], ids[keep]])
                cdist = np.concatenate([best[i][1], dist[keep, i]])
                order = np.lexsort((cid, cdist))[:k]
                best[i] = (cid[order], cdist[order])
        for query, (cid, cdist) in zip(queries, best):
            if len(cid):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cid), query.qid)), pa.array(cid), pa.array(cdist)],
                    names=["qid", "id", "distance"])

    return run


def search(corpus: DataFrame, queries: list[VectorQuery], k: int) -> DataFrame:
    """Exact top-k per query over (id, type, project, embedding).

    The corpus stays where it is: each task keeps its own k best and only
    those rows are shuffled. A zero query finds nothing; a zero row is at
    distance 1. Queries come as a driver list, in blocks of ``SEARCH_ROWS``.
    """
    if not queries:
        return corpus.sparkSession.createDataFrame([], HIT_SCHEMA + ", rank int")
    dim = len(queries[0].vector)
    rows = (corpus.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim))
            .select("id", F.coalesce("type", F.lit("")).alias("type"),
                    F.coalesce("project", F.lit("")).alias("project"), "embedding"))
    hits = None
    for start in range(0, len(queries), SEARCH_ROWS):
        part = rows.mapInArrow(_search_partitions(queries[start:start + SEARCH_ROWS], k), HIT_SCHEMA)
        hits = part if hits is None else hits.unionAll(part)
    return top_per_group(hits, ["qid"], [F.col("distance"), F.col("id")], k, "rank")


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows and which of them are zero."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0), norm[:, 0] == 0


def _away(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit rows to unit centers."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * x @ centers.T))


def _tiles(centers: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Tile of every cell (the last one is the zero rows'): cells near each other share one while they hold ``BLOCK_ROWS`` rows at most; -1: no rows."""
    tile, order, at = np.full(len(rows), -1), [], 0
    left = set(range(len(centers)))
    while left:
        order.append(at := max(left, key=lambda c: (centers[c] @ centers[at], -c)))
        left.remove(at)
    held, last = 0, -1
    for c in [*order, len(centers)]:
        if rows[c]:
            if last < 0 or held + rows[c] > BLOCK_ROWS:
                held, last = 0, last + 1
            tile[c], held = last, held + rows[c]
    return tile


def neighbours(batch: DataFrame, corpus: DataFrame, k: int, by_type: list[str] | None = None) -> DataFrame:
    """k nearest corpus rows of every row of a batch of new vectors, without the row itself; exact.

    Both sides stay in Spark. The corpus is dealt to the cells of ``CELLS`` sampled vectors; small cells share a tile, large
    ones are cut into chunks of ``BLOCK_ROWS``. A new vector first meets the tile of its own cell; its k-th distance there, by
    the triangle inequality, rules out every cell whose radius cannot reach it, and only tiles with others are visited. The
    requests of a tile are dealt to blocks of ``BLOCK_ROWS`` too, and a block meets a chunk in one group, so that a task's
    memory does not grow with either side. The driver sees a row per cell and tile. ``by_type`` searches each listed type apart and returns it in ``hint``; rows of other types
    are left aside. Rows of another length than the batch's take no part.
    """
    spark, hints = batch.sparkSession, by_type or [""]
    asked = batch.where("embedding is not null").select(F.col("id").alias("qid"), "embedding")
    first = asked.first()
    out = "qid bigint, id bigint, distance double, hint string"
    if first is None:
        return spark.createDataFrame([], out + ", rank int")
    dim = len(first["embedding"])
    asked = asked.where(F.size("embedding") == dim)
    rows = corpus.where("embedding is not null").where(F.size("embedding") == dim).select("id", F.coalesce("type", F.lit("")).alias("type"), "embedding")
    if by_type:
        rows = rows.where(F.col("type").isin(by_type))
    sample = rows.select("embedding").orderBy(F.xxhash64("id")).limit(CELLS).toArrow().column("embedding").combine_chunks()
    if not len(sample):
        return spark.createDataFrame([], out + ", rank int")
    centers, zero = _matrix(sample)
    centers = np.unique(centers[~zero], axis=0) if (~zero).any() else np.eye(1, dim)
    n = len(centers)  # cell n holds zero rows, which are at distance 1 from everything

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, none = _matrix(b.column("embedding"))
            away = _away(x, centers)
            cell = np.where(none, n, away.argmin(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(np.where(none, 0.0, away.min(1)))], [*b.schema.names, "cell", "away"])

    kind = dict(rows.dtypes)["embedding"]
    index = cut_lineage(rows.mapInArrow(dealt, f"id bigint, type string, embedding {kind}, cell int, away double"))
    radius, sizes = np.full(n + 1, -1.0), np.zeros(n + 1, np.int64)
    for r in index.groupBy("cell").agg(F.max("away").alias("far"), F.count("*").alias("rows")).collect():
        radius[r["cell"]], sizes[r["cell"]] = r["far"], r["rows"]
    tile = _tiles(centers, sizes)
    tiled = np.arange(tile.max() + 1)[:, None] == tile[None]  # (tile, cell)
    chunks = np.maximum(1, -(-(tiled @ sizes) // BLOCK_ROWS))
    index = index.select("id", "type", "embedding", F.element_at(F.lit(tile.tolist()), F.col("cell") + 1).alias("tile"))

    def met(tiles_of):
        """Every request with the tiles that `tiles_of(x, batch)` marks; a zero request has none."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, none = _matrix(b.column("embedding"))
                at, open_ = np.nonzero(tiles_of(x, b) & ~none[:, None])
                ends = np.searchsorted(at, np.arange(len(x) + 1))
                tiles = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(open_, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("embedding"), tiles], ["qid", "embedding", "tiles"])
        return run

    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        found: list[pa.Table] = []
        if len(q) and len(c):
            c = c.sort_by("id")  # of equally near rows the smaller ids are kept
            qx, cx = _matrix(q["embedding"].combine_chunks())[0], _matrix(c["embedding"].combine_chunks())[0]
            q_id, c_id, types = q["qid"].to_numpy(), c["id"].to_numpy(), np.array(c["type"].to_pylist(), dtype=object)
            for hint in hints:
                able = np.flatnonzero(types == hint) if hint else np.arange(len(c_id))
                keep, to, to_id = min(k, len(able)), cx[able].T, c_id[able]
                for a in range(0, len(q_id) if keep else 0, STRIPE):
                    distance = np.round(1.0 - qx[a : a + STRIPE] @ to, 9)
                    distance[q_id[a : a + STRIPE, None] == to_id[None]] = np.inf
                    border = np.partition(distance, keep - 1, axis=1)[:, keep - 1 : keep]
                    near = (distance <= border) & np.isfinite(distance)
                    for row in np.flatnonzero(near.sum(1) > keep):
                        near[row] = False
                        near[row, np.argsort(distance[row], kind="stable")[:keep]] = True
                    at, col = np.nonzero(near)
                    found.append(pa.table({"qid": q_id[a + at], "id": to_id[col], "distance": distance[at, col], "hint": pa.repeat(hint, len(at))}))
        none = pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64()), "hint": pa.array([], pa.string())})
        return pa.concat_tables([none, *found])

    def searched(requests: DataFrame) -> DataFrame:
        """Hits of (qid, embedding, tiles); the requests of each tile are counted, a row per tile, to deal them to blocks."""
        blocks = np.zeros(len(chunks), np.int64)
        for r in requests.select(F.explode("tiles").alias("tile")).groupBy("tile").count().collect():
            blocks[r["tile"]] = -(-r["count"] // BLOCK_ROWS)
        of = lambda counts: F.element_at(F.lit(counts.tolist()), F.col("tile") + 1)
        every = lambda counts: F.explode(F.when(of(counts) > 0, F.sequence(F.lit(0).cast("long"), of(counts) - 1)))
        own = lambda key, counts: F.pmod(F.xxhash64(key), F.greatest(of(counts), F.lit(1)))
        left = requests.select("qid", "embedding", F.explode("tiles").alias("tile")).withColumn("block", own("qid", blocks)).withColumn("chunk", every(chunks))
        right = index.withColumn("chunk", own("id", chunks)).withColumn("block", every(blocks))
        keys = ["tile", "chunk", "block"]
        hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, out)
        return top_per_group(hits, ["qid", "hint"], [F.col("distance"), F.col("id")], k, "rank")

    asking = f"qid bigint, embedding {dict(asked.dtypes)['embedding']}, tiles array<int>"

    def home(x: np.ndarray) -> np.ndarray:
        """The tile of the nearest cell that has rows, as (request, tile)."""
        away = np.where(tile[None, :n] >= 0, _away(x, centers), np.inf)
        return np.arange(len(chunks))[None] == tile[away.argmin(1)][:, None]

    near = cut_lineage(searched(asked.mapInArrow(met(lambda x, b: home(x)), asking)))
    full = near.groupBy("qid", "hint").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
    reach = full.groupBy("qid").agg(F.when((F.count("*") == len(hints)) & (F.min("n") == k), F.max("far")).alias("reach"))

    def others(x: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        far = np.nan_to_num(b.column("reach").to_numpy(zero_copy_only=False).astype(float), nan=4.0)
        open_ = _away(x, centers) - radius[None, :n] <= np.sqrt(2 * np.maximum(far, 0.0) + 2e-9)[:, None] + 1e-6
        return (np.concatenate([open_, np.ones((len(x), 1), bool)], axis=1) @ tiled.T) & ~home(x)

    rest = cut_lineage(asked.join(reach, "qid", "left").select("qid", "embedding", "reach").mapInArrow(met(others), asking))  # counted, then searched
    return top_per_group(near.drop("rank").unionByName(searched(rest).drop("rank")), ["qid", "hint"], [F.col("distance"), F.col("id")], k, "rank")
