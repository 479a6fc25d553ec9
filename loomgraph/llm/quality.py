"""Quality by hierarchical empirical Bayes: a document's own evidence, its host's and its path's.

Documents have no address here; `source` stands for the host and (source, lang) for the path below it. A logistic classifier
over plain text figures gives a document's own probability; it is fitted on at most `SAMPLE` labelled documents. Sites gather the
labels of their documents, or the classifier's probability where there is none, in one grouped aggregation; a document's own share
is taken out of its path again before the path speaks about it. A host's rate is
shrunk toward the global one, a path's toward its host's; the strength of the pull is estimated from how much the rates of
hosts (of paths about their hosts) differ beyond chance, so a sparse site keeps to its prior. The posterior log-odds are the
document's plus those of its path less those of the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomgraph.llm.common import free, frozen, numbered, pieces, split_words, without

#: Most labelled documents that the classifier is fitted on; most paths whose posteriors are sent to all tasks.
SAMPLE, HELD = 20_000, 100_000
FEATURES = 12
#: Log-odds beyond this are as sure as any.
SURE = 12.0


def figures(texts: pa.Array) -> np.ndarray:
    """FEATURES plain figures of every text; a null text counts as empty."""
    return np.concatenate([_figures(part) for part in pieces(texts)])


def _figures(texts: pa.Array) -> np.ndarray:
    codes, ends, words = split_words(texts)
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), FEATURES))
    # of distinct words: length, letters in capitals, letters at all, digits, plain punctuation, other signs, words of one sign
    own = np.zeros((len(words), 7))
    for i, w in enumerate(words):
        s = w.decode()
        letters = sum(map(str.isalpha, s))
        plain = sum(c in ".,;:!?'\"-" for c in s)
        digits = sum(map(str.isdigit, s))
        own[i] = len(s), sum(map(str.isupper, s)), letters, digits, plain, len(s) - letters - digits - plain, len(s) == 1 and not letters
    own = np.concatenate([own, [[w.endswith(b"!!"), 0] for w in words] if words else np.zeros((0, 2))], axis=1)
    text = np.repeat(np.arange(len(sizes)), sizes)
    sums = np.stack([np.bincount(text, weights=own[codes, c], minlength=len(sizes)) for c in range(8)], axis=1)
    pair = text[1:] == text[:-1]
    again = np.bincount(text[1:][pair], weights=(codes[1:] == codes[:-1])[pair], minlength=len(sizes))
    distinct = np.bincount(np.unique(text.astype(np.int64) * (len(words) + 1) + codes) // (len(words) + 1), minlength=len(sizes)) if len(codes) else np.zeros(len(sizes))
    n, chars = np.maximum(sizes, 1), np.maximum(sums[:, 0], 1)
    out[:, 0] = np.log1p(sizes)
    out[:, 1] = distinct / n ** 0.9
    out[:, 2] = again / n
    out[:, 3] = sums[:, 0] / n
    out[:, 4] = sums[:, 1] / np.maximum(sums[:, 2], 1)
    out[:, 5] = sums[:, 3] / chars
    out[:, 6] = sums[:, 4] / chars
    out[:, 7] = sums[:, 5] / chars
    out[:, 8] = sums[:, 6] / n
    out[:, 9] = sums[:, 7] / n
    out[:, 10] = np.sqrt(out[:, 7])
    out[:, 11] = np.sqrt(out[:, 2])
    return out


class Logistic:
    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 40) -> None:
        """Damped Newton steps over standardised figures; constant log-odds where a class is missing."""
        self.mean, self.scale = (x.mean(0), np.maximum(x.std(0), 1e-9)) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
        z = self.design(x)
        self.w = np.zeros(z.shape[1])
        rate = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.w[-1] = np.log(rate / (1 - rate))
        if len(y) and 0 < y.mean() < 1:
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
                pull = ridge * np.append(self.w[:-1], 0)
                h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(self.w)) + 1e-9 * np.eye(len(self.w))
                move = np.linalg.solve(h, z.T @ (p - y) / len(y) + pull)
                self.w -= move
                if np.abs(move).max() < 1e-6:
                    break

    def design(self, x: np.ndarray) -> np.ndarray:
        s = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([s, s * s, np.ones((len(x), 1))], axis=1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x) @ self.w, -SURE, SURE)


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> Logistic:
    known = labels.select(F.col("doc_id").cast("long").alias("i"), F.col("quality").alias("y")).where("i is not null and y is not null").groupBy("i").agg(F.min("y").alias("y"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("i"), "i").limit(SAMPLE))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text")).join(chosen, "i").select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = figures(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("y").cast(pa.float64())], ["x", "y"])

    got = rows.mapInArrow(run, "x array<double>, y double").orderBy("y", "x").limit(2 * SAMPLE).toArrow()
    return Logistic(np.array(got.column("x").to_pylist(), float).reshape(-1, FEATURES), got.column("y").to_numpy())


def verdicts(rows: DataFrame, labels: DataFrame, keep: str, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", part_col: str = "lang") -> DataFrame:
    """(`keep`, `_own`, `_path`, `_score`), one row per row: the document's log-odds, its path's posterior rate without the document's
    own share in it, and the posterior probability.

    Texts go to Python once and do not come back: the evidence is written as a slim table, which all that follows reads.
    """
    model = fitted(rows, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.log_odds(figures(batch.column("text"))))], [*batch.schema.names[:-1], "_own"])

    slim = rows.select(F.col(keep).alias("k"), F.col(id_col).cast("long").alias("i"), F.col(host_col).alias("h"), F.col(part_col).alias("p"), F.col(text_col).cast("string").alias("text"))
    evidence = slim.mapInArrow(run, StructType([*slim.schema.fields[:-1], StructField("_own", DoubleType())]))
    known = labels.select(F.col("doc_id").cast("long").alias("i"), F.col("quality").alias("y")).where("i is not null and y is not null").groupBy("i").agg(F.min("y").alias("y"))
    rate = F.coalesce(F.col("y").cast("double"), 1 / (1 + F.exp(-F.col("_own"))))
    evidence = frozen(evidence.join(known, "i", "left").select("k", "h", "p", "_own", rate.alias("rate")), "evidence")
    paths = frozen(evidence.groupBy("h", "p").agg(F.count("*").cast("double").alias("n"), F.sum("rate").alias("good")), "paths")
    sites = posteriors(paths).drop("_path").withColumnsRenamed({"h": "hh", "p": "pp"})
    held = F.broadcast(sites) if sites.count() <= HELD else sites
    joined = evidence.join(held, F.col("h").eqNullSafe(F.col("hh")) & F.col("p").eqNullSafe(F.col("pp")))
    path = kept_inside((F.col("_pull") * F.col("_host") + F.col("_good") - F.col("rate")) / (F.col("_pull") + F.col("_n") - 1))
    odds = lambda x: F.ln(x / (1 - x))
    joined = joined.withColumn("_path", path)
    return joined.select(F.col("k").alias(keep), "_own", "_path", (1 / (1 + F.exp(-(F.col("_own") + odds(F.col("_path")) - odds(F.col("_global")))))).alias("_score"))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", part_col: str = "lang") -> DataFrame:
    """`docs` with `_own`, `_path` and `_score` of `verdicts`, one row each; columns of these names are replaced, all others stay.

    Null hosts and parts are sites like any other; a null text counts as empty. Labels that repeat an id count once (the lower
    one); without labels, or with one class only, every document has the constant rate. Repeated rows stay.
    """
    row = free("_row", docs.columns)
    rows = numbered(docs, row, id_col)
    found = verdicts(rows, labels, row, id_col, text_col, host_col, part_col)
    return rows.drop("_own", "_path", "_score").join(found, row).drop(row)


def pull(rows: DataFrame, rate: str, prior: str) -> float:
    """Strength of the prior (as a number of documents) by moments: how much less the rates differ than chance alone would let them."""
    wide = rows.agg(F.sum(F.col("n") * (F.col(rate) - F.col(prior)) ** 2).alias("between"), F.sum(F.col(prior) * (1 - F.col(prior))).alias("chance"),
                    F.sum("n").alias("n"), F.sum(F.col("n") * F.col(prior) * (1 - F.col(prior))).alias("spread")).first()
    if not wide["n"] or not wide["spread"]:
        return 1.0
    variance = max(0.0, (wide["between"] - wide["chance"]) / wide["n"])
    typical = wide["spread"] / wide["n"]
    return min(1e6, max(1.0, typical / variance - 1)) if variance > 0 else 1e6


def posteriors(paths: DataFrame) -> DataFrame:
    """(h, p, _path, _global, _host, _pull, _n, _good) from (h, p, n, good): beta posteriors, global to host to path, and what the path's is made of."""
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    n, good = total["n"] or 0.0, total["good"] or 0.0
    base = (good + 0.5) / (n + 1.0)
    hosts = paths.groupBy("h").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("rate", F.col("good") / F.col("n")).withColumn("prior", F.lit(base))
    a = pull(hosts, "rate", "prior")
    hosts = hosts.select(F.col("h").alias("hh"), ((F.lit(a * base) + F.col("good")) / (F.lit(a) + F.col("n"))).alias("host"))
    rows = paths.join(hosts, F.col("h").eqNullSafe(F.col("hh"))).withColumn("rate", F.col("good") / F.col("n"))
    b = pull(rows, "rate", "host")
    path = (F.lit(b) * F.col("host") + F.col("good")) / (F.lit(b) + F.col("n"))
    parts = [F.col("host").alias("_host"), F.lit(b).alias("_pull"), F.col("n").alias("_n"), F.col("good").alias("_good")]
    return frozen(rows.select("h", "p", kept_inside(path).alias("_path"), F.lit(base).alias("_global"), *parts), "sites")


def kept_inside(rate: Column) -> Column:
    return F.least(F.greatest(rate, F.lit(1e-6)), F.lit(1 - 1e-6))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents whose posterior reaches `least`, with their own columns only, whatever these are called."""
    row = free("_row", docs.columns)
    rows = numbered(docs, row)
    return without(rows, verdicts(rows, labels, row).where(F.col("_score") < least).select(row), row).select(*docs.columns)
