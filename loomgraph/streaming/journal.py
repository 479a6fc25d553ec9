"""Structured Streaming intake: idempotent event journal, content-addressed node intake, running sequential test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgraph import ontology as O
from loomgraph.operators.lifecycle import SPRT_HIT, SPRT_LOWER, SPRT_MISS, SPRT_UPPER
from loomgraph.operators.tables import insert_nodes


def read_log(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def dedup_events(events: DataFrame, delay: str | None = None, stamp: str = "created_at") -> DataFrame:
    """First arrival of every event id.

    Without ``delay`` an id is remembered for ever, as in the table it replaces.
    With one, state is dropped once the watermark has passed: a bound for
    endless streams, at the price of re-admitting a later repetition.
    """
    if delay is None:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark(stamp, delay).dropDuplicatesWithinWatermark(["event_id"])


def write_journal(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append-only sink; the file sink's log makes a restarted batch harmless."""
    return (events.writeStream.format("parquet").outputMode("append").option("path", folder)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _written(spark: SparkSession, folder: str) -> bool:
    """Whether the folder holds a finished batch; errors of the file system are not taken for an empty folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(path) and any(s.isDirectory() and system.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
                                       for s in system.listStatus(path))


def intake_nodes(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append nodes whose content hash is new, batch by batch.

    Every batch goes to its own folder, which a repeated run overwrites, and is
    checked against the other folders only: a retry gives the same result.
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mine = f"{folder}/batch={batch_id}"
        if _written(spark, folder):
            known = spark.read.parquet(folder).where(F.col("batch") != batch_id)
        else:
            known = batch.limit(0).select("id", "content_hash")
        # only hashes that the batch brings are looked up
        known = known.select("id", "content_hash").join(batch.select("content_hash").distinct(), "content_hash", "left_semi")
        fresh = insert_nodes(known, batch).where("outcome = 'inserted'").select("id")
        batch.join(fresh, "id", "left_semi").write.mode("overwrite").parquet(mine)

    return (rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


SPRT_OUT = "id bigint, n_obs bigint, verdict string"
SPRT_STATE = "ts array<bigint>, seq array<bigint>, score array<double>"


def running_sprt(scores: DataFrame) -> DataFrame:
    """Verdict per node (id, score, ts, seq) after each batch, over its last ``SPRT_HISTORY`` scores, as in the batch form.

    State holds those scores and no more; they are folded anew, since the oldest drop out. ``ts`` is a number that grows with time.
    Verdicts before ``SPRT_MIN_OBS`` observations are held back.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(frames))[["ts", "seq", "score"]]
        if state.exists:
            new = pd.concat([pd.DataFrame(dict(zip(["ts", "seq", "score"], map(list, state.get)))), new])
        last = new.sort_values(["ts", "seq"]).tail(O.SPRT_HISTORY)
        state.update(tuple(last[c].tolist() for c in last.columns))
        total = np.cumsum(np.where(last["score"] > 0.5, SPRT_HIT, SPRT_MISS))
        crossed = np.flatnonzero((total >= SPRT_UPPER) | (total <= SPRT_LOWER))
        verdict = "open" if not len(crossed) else "promote" if total[crossed[0]] >= SPRT_UPPER else "reject"
        yield pd.DataFrame({"id": [key[0]], "n_obs": [len(last)], "verdict": [verdict if len(last) >= O.SPRT_MIN_OBS else "open"]})

    return scores.groupBy("id").applyInPandasWithState(step, SPRT_OUT, SPRT_STATE, "update", GroupStateTimeout.NoTimeout)
