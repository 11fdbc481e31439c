"""Language identification by a bidirectional gated recurrent network over bytes.

The network is small and plain numpy.  A forward and a backward GRU read the
UTF-8 bytes; at every position the two states give the probabilities of the
languages, and a document's are their mean over all its bytes.  Texts are cut
into segments, which are read side by side, longest first, so that each step is
one matrix product over all segments still running.

Training is by backpropagation through time on the driver, on whole texts of a sample
that PER_LANGUAGE rows of each language and BYTES bytes bound, in the order of a hash
of the ids; a step takes a segment from anywhere in each of its texts, and labels
stand at every position.  The weights, a few kilobytes, go with the task.

Edge cases: a null text, or one without a letter (str.isalpha), is ``und`` with score
0; texts of any length are read whole; without any labelled row all are ``und``; an
empty table gives an empty result; rows that repeat an id are each predicted, and one
of them is learned from; only the id, the text and for training lang are read, so
other columns may clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinfold.functions.ship import ship
from twinfold.llm.kernels import chunks, utf8

#: States of each direction.
STATES = 8
#: Bytes of a segment when reading, and when training.
SEGMENT, TRAINED = 256, 64
#: Bounds of the training sample: rows of a language, and bytes of all their texts.
PER_LANGUAGE, BYTES = 150, 1 << 26
STEPS, BATCH, RATE, SEED = 160, 96, 0.02, 5
UNKNOWN = "und"
#: Mean probability below which no language is told in a pipeline.
LEAST = 0.3


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Gru:
    """One direction: x has the gates' inputs by byte, u the weights on the state (z, r, candidate)."""

    def __init__(self, rng: np.random.Generator):
        self.x = rng.normal(0, 0.3, (256, 3 * STATES)).astype(np.float32)
        self.u = rng.normal(0, 0.3, (STATES, 3 * STATES)).astype(np.float32)

    def step(self, codes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        a, b = self.x[codes], h @ self.u
        zr = sigmoid(a[:, : 2 * STATES] + b[:, : 2 * STATES])
        z, r = zr[:, :STATES], zr[:, STATES:]
        n = np.tanh(a[:, 2 * STATES :] + r * b[:, 2 * STATES :])
        return n + z * (h - n), (codes, h, z, r, n, b[:, 2 * STATES :])

    def back(self, dh: np.ndarray, kept: tuple, gx: np.ndarray, gu: np.ndarray) -> np.ndarray:
        """Adds to the gradients; returns that of the state before."""
        codes, h, z, r, n, b = kept
        da = np.empty((len(h), 3 * STATES), np.float32)
        dn = dh * (1 - z) * (1 - n * n)
        da[:, :STATES] = dh * (h - n) * z * (1 - z)
        da[:, STATES : 2 * STATES] = dn * b * r * (1 - r)
        da[:, 2 * STATES :] = dn
        np.add.at(gx, codes, da)
        db = da.copy()
        db[:, 2 * STATES :] *= r
        gu += h.T @ db
        return dh * z + db @ self.u.T


class Network:
    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.behind = Gru(rng), Gru(rng)
        self.v = rng.normal(0, 0.3, (2 * STATES, len(languages))).astype(np.float32)
        self.c = np.zeros(len(languages), np.float32)

    def train(self, texts: list[np.ndarray], labels: np.ndarray, seed: int = SEED) -> None:
        """texts: the bytes of each, TRAINED or more; the languages come equally often."""
        rng = np.random.default_rng(seed)
        params = [self.ahead.x, self.ahead.u, self.behind.x, self.behind.u, self.v, self.c]
        each = [np.flatnonzero(labels == i) for i in np.unique(labels)]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, STEPS + 1):
            pick = [own[rng.integers(0, len(own))] for own in each for _ in range(-(-BATCH // len(each)))]
            at = [rng.integers(0, len(texts[i]) - TRAINED + 1) for i in pick]
            grads = self.gradients(np.stack([texts[i][a : a + TRAINED] for i, a in zip(pick, at)]), labels[pick])
            for p, g, m, s in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy over all positions."""
        n, t = x.shape
        both = np.zeros((t, n, 2 * STATES), np.float32)
        kept: list[list[tuple]] = [[None] * t, [None] * t]  # type: ignore[list-item]
        for way, gru, order in ((0, self.ahead, range(t)), (1, self.behind, range(t - 1, -1, -1))):
            h = np.zeros((n, STATES), np.float32)
            for i in order:
                h, kept[way][i] = gru.step(x[:, i], h)
                both[i, :, way * STATES : (way + 1) * STATES] = h
        d = softmax(both @ self.v + self.c)
        d[:, np.arange(n), y] -= 1
        d /= n * t
        flat, dflat = both.reshape(-1, 2 * STATES), d.reshape(-1, len(self.c))
        dboth = d @ self.v.T
        grads = [np.zeros_like(p) for p in (self.ahead.x, self.ahead.u, self.behind.x, self.behind.u)]
        for way, gru, order in ((0, self.ahead, range(t - 1, -1, -1)), (1, self.behind, range(t))):
            dh = np.zeros((n, STATES), np.float32)
            for i in order:
                dh = gru.back(dh + dboth[i, :, way * STATES : (way + 1) * STATES], kept[way][i], grads[2 * way], grads[2 * way + 1])
        return [*grads, flat.T @ dflat, dflat.sum(0)]

    def read(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sums over the bytes of each text of the languages' probabilities."""
        size = np.diff(offsets)
        pieces = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(size)), pieces)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offsets[owner] + place * SEGMENT
        length = np.minimum(SEGMENT, offsets[owner + 1] - start)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        out = np.zeros((len(size), len(self.c)))
        for a in range(0, len(owner), 4096):
            np.add.at(out, owner[a : a + 4096], self._segments(buf, start[a : a + 4096], length[a : a + 4096]))
        return out

    def _segments(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        n, t = len(start), int(length[0])
        running = np.searchsorted(-length, -np.arange(t), "left")  # segments longer than i
        codes = buf[np.minimum(start[:, None] + np.arange(t), len(buf) - 1)].T.copy()
        scores = np.empty((t, n, len(self.c)), np.float32)
        h = np.zeros((n, STATES), np.float32)
        for i in range(t):
            k = running[i]
            h, _ = self.ahead.step(codes[i, :k], h[:k])
            scores[i, :k] = h @ self.v[:STATES]
        total = np.zeros((n, len(self.c)), np.float32)
        h = np.zeros((n, STATES), np.float32)
        for i in range(t - 1, -1, -1):
            k = running[i]
            h[:k], _ = self.behind.step(codes[i, :k], h[:k])
            total[:k] += softmax(scores[i, :k] + h[:k] @ self.v[STATES:] + self.c)
        return total


def fit(docs: DataFrame) -> Network | None:
    """Trained on rows whose crc32 of the id is not divisible by 5; None without any."""
    learned = docs.where("lang is not null and text is not null and length(text) > 0 and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = learned.select("lang", "doc_id").withColumn("_rank", F.row_number().over(order)).where(f"_rank <= {PER_LANGUAGE}").select("doc_id").distinct()
    rows = learned.join(F.broadcast(few), "doc_id", "left_semi").select("doc_id", "lang", "text")
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text", "lang"))).where("_rank = 1")
    # At most PER_LANGUAGE rows of each language from here on; the bytes are summed over their sizes only.
    sizes = rows.select("doc_id", F.octet_length("text").cast("long").alias("_size"))
    within = sizes.select("doc_id", F.sum("_size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")).alias("_sum")).where(F.col("_sum") <= BYTES).select("doc_id")
    sample = sorted(rows.join(F.broadcast(within), "doc_id").select("lang", "text").collect(), key=lambda r: (r.lang, r.text))
    if not sample:
        return None
    languages = sorted({r.lang for r in sample})
    texts = [np.frombuffer(r.text.encode(), np.uint8) for r in sample]
    net = Network(languages)
    net.train([np.tile(t, -(-TRAINED // len(t))) if len(t) < TRAINED else t for t in texts], np.array([languages.index(r.lang) for r in sample]))
    return net


def predicted(docs: DataFrame, net: Network | None) -> DataFrame:
    """All columns of docs with lang_pred and score."""
    ship(docs.sparkSession)
    names = docs.columns
    schema = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            texts = part.column("text")
            buf, offsets = utf8(texts)
            n = len(part)
            if net is None or not len(buf):
                best, score = [UNKNOWN] * n, np.zeros(n)
            else:
                p = net.read(buf, offsets)
                p /= np.maximum(p.sum(1, keepdims=True), 1e-9)
                at = p.argmax(1)
                letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
                best = [net.languages[i] if k else UNKNOWN for i, k in zip(at, letters)]
                score = np.where(letters, np.clip(p[np.arange(n), at], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language can be told: those with a letter, where one language has LEAST of the positions at least.

    A null lang becomes the prediction."""
    both = predicted(docs.withColumnsRenamed({c: f"_in_{i}" for i, c in enumerate(docs.columns) if c != "text"}), fit(docs))
    told = both.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST))
    own = {c: F.col("text" if c == "text" else f"_in_{i}") for i, c in enumerate(docs.columns)}
    return told.select(*[(F.coalesce(x, "lang_pred") if c == "lang" else x).alias(c) for c, x in own.items()])


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out")
    return predicted(docs.select("doc_id", held, "text"), fit(docs)).drop("text")
