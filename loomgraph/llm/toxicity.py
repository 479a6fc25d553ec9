"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as its own embedding (words of the training sample only) and as its characters: embeddings of its hashed byte
3- to 5-grams, pooled by attention. Two gated recurrent layers read a window in both directions, attention over its words
pools their states, and a logistic unit scores the window. A document's score is that of its worst window; windows of 32 words
start every 16 words, so that any two words up to 16 apart share one, and none is left out.

Training takes a bounded sample (`SAMPLE_TOXIC`, `SAMPLE_CLEAN` labelled documents that have a text; of a long one, `STRETCHES` stretches of
a window's length, spread over all of it), first with any window under its document's label (documents alike, so that short ones,
whose label is nearer, count more), then with the worst windows of toxic documents only. A word's own embedding is left out at random
(`DROP`), so that its characters must do as well, and the weights that are used are a running mean over the later steps (`MEAN`). The
border between the classes comes from an inner fold, scored before the network has seen it, where a toxic document weighs `MISS` times as
much as another; then the fold is learnt from as well. Only texts and labels are read: neither language,
source nor id enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import WORD, mixed, pieces, split_words

WINDOW, STRIDE = 32, 16
SAMPLE_TOXIC, SAMPLE_CLEAN, STRETCHES = 1_000, 2_000, 32
WORD_ROWS, GRAM_ROWS, SIZE, HIDDEN, PAY = 4_096, 16_384, 8, 8, 8
STEPS, BATCH = 80, 400
DROP, MEAN, MISS, FOLD = 0.25, 0.99, 4.0, 5
#: Learning rates of the rounds before and after the border is set.
RATES, LAST = (0.01, 0.01, 0.005), (0.01, 0.01, 0.005, 0.005)


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the gram table, first of each word): hashed byte 3- to 5-grams of `^word$`, word by word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    raw = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint64)
    word_of = np.repeat(np.arange(len(words)), sizes)
    keys, owners, h = [], [], raw.copy()
    for size in range(2, 6):
        h = h[:-1] * np.uint64(257) + raw[size - 1 :] if len(h) > 1 else h[:0]
        if size > 2:
            inside = word_of[: len(h)] == word_of[size - 1 :][: len(h)]
            keys.append((mixed(h[inside] + np.uint64(size)) % np.uint64(GRAM_ROWS)).astype(np.int64))
            owners.append(word_of[: len(h)][inside])
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return key[order], np.searchsorted(owner[order], np.arange(len(words)))


def windows_of(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, number of words) of all windows; a text without words has one empty window."""
    sizes = np.diff(ends)
    many = np.maximum(1, -(-np.maximum(sizes - WINDOW, 0) // STRIDE) + 1)
    text = np.repeat(np.arange(len(sizes)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    first = ends[:-1][text] + nth * STRIDE
    return text, first, np.minimum(WINDOW, ends[1:][text] - first)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, vocabulary: list[bytes], seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.vocabulary = {w: i + 1 for i, w in enumerate(vocabulary)}
        draw = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"word": draw(len(vocabulary) + 1, SIZE) * 3, "gram": draw(GRAM_ROWS, SIZE) * 30, "ask": draw(SIZE), "pay": draw(2 * HIDDEN, PAY), "pick": draw(PAY), "out": draw(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {"W" + d: draw(2 * SIZE, 3 * HIDDEN), "U" + d: draw(HIDDEN, 3 * HIDDEN), "c" + d: np.zeros(3 * HIDDEN, np.float32)}
        self.shift = 0.0

    # -- words

    def inputs(self, words: list[bytes], kept: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """Input vectors of distinct words; of those not `kept`, from their characters alone."""
        p, own = self.p, np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        own = own if kept is None else np.where(kept, own, 0)
        keys, starts = grams_of(words)
        e = p["gram"][keys]
        score = e @ p["ask"]
        owner = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(keys))))
        weight = np.exp(score - np.maximum.reduceat(score, starts)[owner])
        weight /= np.add.reduceat(weight, starts)[owner]
        pooled = np.add.reduceat(e * weight[:, None], starts, axis=0)
        return np.concatenate([p["word"][own], pooled], axis=1), (own, keys, starts, owner, e, weight, pooled)

    def inputs_back(self, g: np.ndarray, kept: tuple, grads: dict) -> None:
        own, keys, starts, owner, e, weight, pooled = kept
        np.add.at(grads["word"], own, g[:, :SIZE])
        gp = g[:, SIZE:][owner]
        gs = weight * ((gp * e).sum(1) - (gp * pooled[owner]).sum(1))
        np.add.at(grads["gram"], keys, gp * weight[:, None] + gs[:, None] * self.p["ask"])
        grads["ask"] += gs @ e

    # -- windows

    def layer(self, d: str, gates: np.ndarray, at: np.ndarray, real: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States (time, window, HIDDEN) of one direction; `gates` are the input parts per distinct word, `at` their rows (time, window)."""
        U, steps = self.p["U" + d], len(at)
        h, out, tape = np.zeros((at.shape[1], HIDDEN), np.float32), np.zeros((steps, at.shape[1], HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x, u = gates[at[t]], h @ U
            zr = sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            new = np.where(real[t][:, None], n + z * (h - n), h)
            if keep:
                tape.append((t, h, z, r, n, u[:, 2 * HIDDEN :]))
            out[t] = h = new
        return out, tape

    def forward(self, x: np.ndarray, codes: np.ndarray, real: np.ndarray, keep: bool = False, gates: dict | None = None):
        """Logits of windows; codes (time, window) point into the rows of x."""
        p = self.p
        gates = gates or {d: x @ p["W" + d] + p["c" + d] for d in "fb"}
        runs = {d: self.layer(d, gates[d], codes, real, keep) for d in "fb"}
        h = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        a = np.tanh(h @ p["pay"])
        score = np.where(real, a @ p["pick"], np.float32(-1e9))
        weight = np.exp(score - score.max(0)) * real
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = (h * weight[:, :, None]).sum(0)
        return pooled @ p["out"] + p["bias"][0], (runs, h, a, weight, pooled)

    def gradients(self, words: list[bytes], codes: np.ndarray, real: np.ndarray, label: np.ndarray, known: np.ndarray | None = None) -> dict:
        p, grads = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        x, kept = self.inputs(words, known)
        logit, (runs, h, a, weight, pooled) = self.forward(x, codes, real, keep=True)
        g = ((sigmoid(logit) - label) / len(label)).astype(np.float32)
        grads["bias"][0], grads["out"] = g.sum(), g @ pooled
        gp = g[:, None] * p["out"]
        gw = (h * gp).sum(2)
        gs = weight * (gw - (gw * weight).sum(0))
        grads["pick"] = np.einsum("tb,tbp->p", gs, a)
        ga = gs[:, :, None] * p["pick"] * (1 - a * a)
        grads["pay"] = np.einsum("tbh,tbp->hp", h, ga)
        gh = weight[:, :, None] * gp + ga @ p["pay"].T
        gx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            own, carry = gh[:, :, k * HIDDEN : (k + 1) * HIDDEN], np.zeros((codes.shape[1], HIDDEN), np.float32)
            gates = np.zeros((len(x), 3 * HIDDEN), np.float32)
            for t, before, z, r, n, u in reversed(runs[d][1]):
                got = (own[t] + carry)
                live = got * real[t][:, None]
                gn = live * (1 - z) * (1 - n * n)
                gz = live * (before - n) * z * (1 - z)
                gr = gn * u * r * (1 - r)
                gate, inner = np.concatenate([gz, gr, gn], 1), np.concatenate([gz, gr, gn * r], 1)
                grads["U" + d] += before.T @ inner
                np.add.at(gates, codes[t], gate)
                carry = (got - live) + live * z + inner @ p["U" + d].T
            grads["W" + d], grads["c" + d] = x.T @ gates, gates.sum(0)
            gx += gates @ p["W" + d].T
        self.inputs_back(gx, kept, grads)
        return grads

    # -- texts

    def texts(self, texts: pa.Array, chunk: int = 4_096) -> np.ndarray:
        """Logit of every text's worst window, a few megabytes of text at a time."""
        return np.concatenate([self._texts(part, chunk) for part in pieces(texts)])

    def _texts(self, texts: pa.Array, chunk: int) -> np.ndarray:
        codes, ends, words = split_words(texts, lower=True)
        text, first, size = windows_of(ends)
        words = words or [b""]
        gates = {d: [] for d in "fb"}
        for at in range(0, len(words), 20_000):
            x, _ = self.inputs(words[at : at + 20_000])
            for d in "fb":
                gates[d].append(x @ self.p["W" + d] + self.p["c" + d])
        gates = {d: np.concatenate(g) for d, g in gates.items()}
        codes = np.append(codes, np.zeros(WINDOW, codes.dtype)).astype(np.int64)
        logits = np.empty(len(text), np.float32)
        for at in range(0, len(text), chunk):
            span = np.arange(WINDOW)[:, None]
            real = span < size[None, at : at + chunk]
            rows = codes[np.minimum(first[None, at : at + chunk] + span, len(codes) - 1)]
            logits[at : at + chunk] = self.forward(None, rows, real, gates=gates)[0]
        worst = np.full(len(texts), -np.inf, np.float32)
        np.maximum.at(worst, text, logits)
        return worst


def border(top: np.ndarray, label: np.ndarray) -> float:
    """The score at which a logistic curve over scores and labels is even, where a toxic document weighs `MISS` times as much as another.

    A curve over all scores is steadier than the best cut between two of the few documents of a fold.
    """
    z, weight = np.clip(top, -8, 8).astype(np.float64), np.where(label > 0.5, MISS, 1.0)
    slope, base = 0.5, 0.0
    for _ in range(50):
        p = sigmoid(slope * z + base)
        r, off = weight * p * (1 - p), weight * (p - label)
        pull = np.array([[(r * z * z).sum() + 0.1, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-6]])
        move = np.linalg.solve(pull, np.array([(off * z).sum() + 0.1 * slope, off.sum()]))
        slope, base = slope - move[0], base - move[1]
    return float(-base / slope)


def worst_of(logits: np.ndarray, text: np.ndarray, many: int) -> np.ndarray:
    top = np.full(many, -np.inf, np.float32)
    np.maximum.at(top, text, logits)
    return top


def train(texts: list[str], label: np.ndarray, seed: int = 7) -> Network | None:
    """The network of a sample of texts, its border from an inner fold; none where the sample lacks a class."""
    if not len(label) or label.min() == label.max():
        return None
    rng = np.random.default_rng(seed)
    order, fold = rng.permutation(len(label)), np.zeros(len(label), bool)
    for y in (0.0, 1.0):  # every FOLD-th of either class, if that leaves some of both
        own = order[label[order] == y]
        fold[own[:: FOLD] if len(own) >= FOLD and min(label.sum(), (1 - label).sum()) >= FOLD else own[:0]] = True
    codes, ends, words = split_words(pa.array(texts, pa.string()), lower=True)
    often = np.bincount(codes, minlength=len(words))
    vocabulary = [words[i] for i in np.argsort(-often, kind="stable")[:WORD_ROWS] if often[i] >= 5]
    net = Network(vocabulary)
    text, first, size = windows_of(ends)
    padded = np.append(codes, np.zeros(WINDOW, codes.dtype)).astype(np.int64)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, mean = 0, None

    def learn(pools: tuple[np.ndarray, np.ndarray], steps: int, rate: float) -> None:
        nonlocal step
        for _ in range(steps):
            step += 1
            pick = np.concatenate([rng.choice(pool, BATCH // 2) for pool in pools])
            span = np.arange(WINDOW)[:, None]
            real = span < size[None, pick]
            used, inverse = np.unique(padded[first[None, pick] + span], return_inverse=True)
            grads = net.gradients([words[w] for w in used], inverse.reshape(real.shape), real, label[text[pick]], rng.random(len(used)) >= DROP)
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
                if mean is not None:
                    mean[k] += (1 - MEAN) * (net.p[k] - mean[k])

    def all_logits() -> np.ndarray:
        x, _ = net.inputs(words)
        gates = {d: x @ net.p["W" + d] + net.p["c" + d] for d in "fb"}
        out = []
        for at in range(0, len(text), 8_192):
            span = np.arange(WINDOW)[:, None]
            real = span < size[None, at : at + 8_192]
            out.append(net.forward(None, padded[first[None, at : at + 8_192] + span], real, gates=gates)[0])
        return np.concatenate(out)

    toxic = label[text] > 0.5

    def sharpen(used: np.ndarray, rates: tuple[float, ...]) -> None:
        """Rounds over the worst windows of toxic documents and the hard ones of the others."""
        for rate in rates:
            logits = all_logits()
            worst = np.flatnonzero(toxic & used[text] & (logits >= worst_of(logits, text, len(texts))[text]))
            clean = ~toxic & used[text]
            hard = np.flatnonzero(clean)
            hard = np.concatenate([hard, *[np.argsort(np.where(clean, logits, -np.inf))[-max(1, len(hard) // 20) :]] * 10])  # the worst clean windows count more
            learn((worst, hard), STEPS, rate)

    # a window for every document and round, so that a draw of windows is a draw of documents
    many = np.bincount(text)
    nth = np.floor(rng.random((16, len(many))) * many).astype(np.int64) + np.cumsum(many) - many
    learn((nth[:, (label > 0.5) & ~fold].ravel(), nth[:, (label <= 0.5) & ~fold].ravel()), 2 * STEPS, 0.02)
    mean = {k: v.copy() for k, v in net.p.items()}
    sharpen(~fold, RATES)
    last, net.p = net.p, {k: v.astype(np.float32) for k, v in mean.items()}
    judges = fold if fold.any() else np.ones(len(label), bool)
    net.shift = border(worst_of(all_logits(), text, len(texts))[judges], label[judges])
    if fold.any():  # the fold has told the border, and is learnt from as well
        net.p = last
        sharpen(np.ones(len(label), bool), LAST)
        net.p = {k: v.astype(np.float32) for k, v in mean.items()}
    return net


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[list[str], np.ndarray]:
    """The training texts: labelled rows outside of the held-out fifth, by the order of a hash, at most the documented numbers."""
    known = labels.select(F.col("doc_id").cast("long").alias("i"), F.col("toxic").alias("y")).where(F.col("y").isNotNull() & F.col("i").isNotNull() & ~held_out(F.col("i")))
    known = known.groupBy("i").agg(F.max("y").alias("y"))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    # of a long text, stretches from evenly spread places
    many, long = F.size("w"), WINDOW * STRETCHES
    starts = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda k: F.floor(k * (many - WINDOW) / (STRETCHES - 1)).cast("int") + 1)
    cut = F.when(many <= long, F.col("text")).otherwise(F.array_join(F.flatten(F.transform(starts, lambda a: F.slice("w", a, WINDOW))), " "))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    able = rows.where(F.col("text").rlike(WORD)).select("i", "t").join(known, "i").distinct()
    pick = lambda y, n: able.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i", "t").limit(n)
    chosen = pick(1, SAMPLE_TOXIC).unionAll(pick(0, SAMPLE_CLEAN))
    found = rows.join(F.broadcast(chosen), ["i", "t"]).withColumn("w", words).select("i", "t", "y", cut.alias("text")).dropDuplicates(["i", "t"])
    taken = found.orderBy(F.desc("y"), F.xxhash64("i"), "i", "t").select("text", "y").collect()  # at most the two numbers, each at most so many words
    return [r["text"] for r in taken], np.array([r["y"] for r in taken], np.float32)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of `docs`.

    A null text counts as empty; texts without words get the empty window's score. Without labels of both classes every score
    is 0. Rows with a null id are scored, not held out. Repeated rows stay; other columns are not read.
    """
    net = train(*sample(docs, labels, id_col, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            score = np.zeros(len(texts)) if net is None else sigmoid(net.texts(texts).astype(np.float64) - net.shift)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
