"""Toxicity by a convolutional text classifier in numpy.

Words are runs of letters and digits, ASCII lower-cased.  A word's embedding is
the sum of rows of hashed tables: one for the word, one each for its first STEM_BYTES
bytes, so inflected forms and compounds share what is learned of their stems.  Filters
of one, two and three words slide over the text, and the maximum of each over the
text feeds a logistic unit.  Max pooling sends the gradient to one place per
filter, so training touches few rows.

Thresholds are calibrated by language: every labelled text that may be learned from
and wasn't trained on is scored, and histograms of the responses by label and by the
language that the words tell (a naive Bayes table learned from the sample) give each
group the cut with the least cost, where a miss costs MISS false alarms.  A group's
cut is shrunk towards that of all texts, which weighs like SHRINK labelled texts of
the group's rarer label.  Scores are shifted so that the cut is 0.3 for every group.
Languages, sources, ids and labels are not inputs of a score.

Training takes whole texts, a sample bounded by EACH rows of each label and BYTES
bytes in all, on the driver.

Edge cases: a null or empty text, also of an empty table, is scored as one without
words; texts of any length are scored whole; without any label every score is 0.15;
rows that repeat an id are each scored, and count once in the sample; ties of the
sample's order are broken by a hash of the text; only the id, the text and for
training lang are read, so other columns may clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinfold.functions.ship import ship
from twinfold.functions.storage import checkpoint
from twinfold.llm.kernels import LOWER, chunks, stream, utf8

#: Rows of the tables for words and for stems, and their columns.
BUCKETS, STEMS, DIM = 1 << 20, 1 << 18, 4
STEM_BYTES = (4, 5, 6, 7)
WIDTHS = (1, 2, 3)
FILTERS = 6
#: Bounds of the training sample: rows of each label, and bytes of their texts.
EACH, BYTES = 1500, 1 << 26
EPOCHS, RATE, SEED = 4, 0.1, 3
#: Slope of the pooled maxima below zero, without which filters whose maxima are all negative would never learn.
LEAK = 0.1
#: False alarms that a miss costs; labelled texts that the common cut weighs like; steps of the histograms a unit.
MISS, SHRINK, STEPS = 3.0, 10.0, 50
#: Texts of the sample that a word or stem must occur in to be learned; others stay at zero.
FAMILIAR = 3
CUT = 0.3

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, ptr): for each word its rows in the tables of words and of stems; text i has words ptr[i] to ptr[i + 1]."""
    raw, offsets = utf8(texts)
    buf = LOWER[raw]
    n = len(buf)
    on = _TOKEN[buf]
    before, after = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    before[1:], after[:n] = on, on
    before[offsets] = after[offsets] = False
    starts = np.flatnonzero(on & ~before[:n])
    ends = np.flatnonzero(on & ~after[1:]) + 1
    ptr = np.searchsorted(starts, offsets)
    s = stream(51)
    rows = np.empty((1 + len(STEM_BYTES), len(starts)), np.int32)
    values = s.byte[buf]
    for i, (cut, size) in enumerate([(None, BUCKETS), *((cut, STEMS) for cut in STEM_BYTES)]):
        to = ends if cut is None else np.minimum(ends, starts + cut)
        rows[i] = (s.spans(values, starts, to) >> np.uint64(40)).astype(np.int64) % size
    return rows, ptr


class Classifier:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.words = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        self.stems = rng.normal(0, 0.02, (len(STEM_BYTES), STEMS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.full(len(WIDTHS) * FILTERS, -0.1, np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.float32(-1)
        self.groups = np.zeros((BUCKETS >> 6, 1), np.float32)
        self.cuts = np.zeros(1)

    def embed(self, rows: np.ndarray) -> np.ndarray:
        return sum((table[r] for table, r in zip(self.stems, rows[1:])), self.words[rows[0]])

    def pooled(self, rows: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text and filter the maximum over the text (0 if it is too short), leaky, and the responses' table."""
        n = len(ptr) - 1
        e = self.embed(rows)
        last = np.repeat(ptr[1:], np.diff(ptr))
        out = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        full = np.flatnonzero(np.diff(ptr) > 0)
        every = []
        at = np.arange(len(e))
        for i, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            y = e @ f[0]
            for j in range(1, w):
                y[: len(e) - j] += (e[j:] @ f[j])[: max(0, len(e) - j)]
            y += self.bias[i * FILTERS : (i + 1) * FILTERS]
            if w > 1:
                y[at + w > last] = -1e9  # it would leave the text
            every.append(y)
            if len(full):
                m = np.maximum.reduceat(y, ptr[full], axis=0)
                out[full, i * FILTERS : (i + 1) * FILTERS] = np.where(m > 0, m, np.where(m > -1e8, LEAK * m, 0))
        return out, np.concatenate(every, 1) if every else np.zeros((0, 0))

    def raw(self, rows: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        return self.pooled(rows, ptr)[0] @ self.out + self.base

    def group(self, rows: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """The language group of each text by its words."""
        if self.groups.shape[1] == 1:
            return np.zeros(len(ptr) - 1, np.int64)
        p = self.groups[rows[0] & (len(self.groups) - 1)]
        total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, 0, dtype=np.float64)])
        return (total[ptr[1:]] - total[ptr[:-1]]).argmax(1)

    def train(self, docs: list[np.ndarray], y: np.ndarray, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        known = []
        once = {id(d): (d, int(label)) for d, label in zip(docs, y)}.values()  # a text that is repeated counts once
        texts = np.bincount([label for _, label in once], minlength=2)
        for i, table in enumerate((self.words, *self.stems)):
            df = np.zeros((2, len(table)), np.int32)
            for d, label in once:
                df[label, np.unique(d[i])] += 1
            known.append(df.sum(0) >= FAMILIAR)
            table[~known[-1]] = 0
            # The first column starts at how far the log odds of texts with the word stand out from chance.
            odds = np.log((df[1] + 0.5) / (texts[1] + 1)) - np.log((df[0] + 0.5) / (texts[0] + 1))
            stands_out = odds / np.sqrt(1 / (df[1] + 0.5) + 1 / (df[0] + 0.5))
            table[:, 0] = np.where(known[-1], 0.3 * np.clip(stands_out - 2, 0, 8), 0)
        # The first filters of one word start by reading it.
        self.filters[0][0, 0], self.out[:FILTERS], self.base = 1, 0.5, np.float32(-2)
        # Adagrad's sums of squares.
        sums = [np.full(len(table), 1e-3, np.float32) for table in (self.words, *self.stems)]
        dense = [*self.filters, self.bias, self.out]
        squares = [np.full(p.shape, 1e-3, np.float32) for p in dense]
        base_square = 1e-3
        for epoch in range(EPOCHS):
            order = rng.permutation(len(docs))
            for a in range(0, len(order), 64):
                pick = order[a : a + 64]
                rows = np.concatenate([docs[i] for i in pick], 1)
                ptr = np.concatenate([[0], np.cumsum([docs[i].shape[1] for i in pick])])
                if not rows.shape[1]:
                    continue
                pool, every = self.pooled(rows, ptr)
                error = 1 / (1 + np.exp(-(pool @ self.out + self.base))) - y[pick]
                gates = np.where(pool > 0, 1, LEAK * (pool < 0)).astype(np.float32) * error[:, None] * self.out
                grads = [np.zeros_like(p) for p in dense]
                grads[-1] += pool.T @ error
                grads[-2] += gates.sum(0)
                at, de = [], []
                e = self.embed(rows)
                for d in range(len(pick)):
                    z = slice(ptr[d], ptr[d + 1])
                    live = np.flatnonzero(gates[d])
                    if not len(live):
                        continue
                    best = every[z][:, live].argmax(0) + ptr[d]
                    for k, b in zip(live.tolist(), best.tolist()):
                        i, f = divmod(k, FILTERS)
                        for j in range(WIDTHS[i]):
                            grads[i][j, :, f] += gates[d, k] * e[b + j]
                            at.append(b + j)
                            de.append(gates[d, k] * self.filters[i][j, :, f])
                for p, g, s in zip(dense, grads, squares):
                    g /= len(pick)
                    s += g * g
                    p -= 0.3 * RATE * g / np.sqrt(s)
                g = float(error.mean())
                base_square += g * g
                self.base -= np.float32(0.3 * RATE * g / np.sqrt(base_square))
                if at:
                    de_ = np.array(de, np.float32)
                    for table, s, r, on in zip((self.words, *self.stems), sums, rows, known):
                        ids, back = np.unique(r[at], return_inverse=True)
                        total = np.zeros((len(ids), DIM), np.float32)
                        np.add.at(total, back, de_)
                        ids, total = ids[on[ids]], total[on[ids]]
                        s[ids] += (total * total).mean(1)
                        table[ids] -= RATE * total / np.sqrt(s[ids])[:, None]

    def learn_groups(self, docs: list[np.ndarray], langs: list[str]) -> None:
        names = sorted(set(langs))
        counts = np.full((BUCKETS >> 6, len(names)), 0.5)
        for d, lang in zip(docs, langs):
            np.add.at(counts[:, names.index(lang)], d[0] & (len(counts) - 1), 1)
        self.groups = np.log(counts / counts.sum(0)).astype(np.float32)
        self.cuts = np.zeros(len(names))

    def calibrate(self, hist: list[tuple[int, int, int, int]], weight: float) -> None:
        """hist: (group, step, label, count) of responses; weight: how many texts one without the label stands for, next to one with it."""
        rows = np.array(hist, np.int64).reshape(-1, 4)
        whole = _cut(rows, weight)
        if whole is None:
            return
        for g in range(len(self.cuts)):
            own = rows[rows[:, 0] == g]
            least = min(own[own[:, 2] == v, 3].sum() for v in (0, 1))
            cut = _cut(own, weight)
            self.cuts[g] = whole if cut is None else (least * cut + SHRINK * whole) / (least + SHRINK)


def _cut(rows: np.ndarray, weight: float) -> float | None:
    """The response with the least cost, in the middle of the widest gap among equals; None without both labels."""
    if len(np.unique(rows[:, 2])) < 2:
        return None
    steps = np.unique(rows[:, 1])
    at = np.searchsorted(steps, rows[:, 1])
    bad, good = (np.bincount(at, rows[:, 3] * (rows[:, 2] == v), len(steps)) for v in (1, 0))
    # Cut k lies below steps[k]: what is below it is called good.
    cost = MISS * np.concatenate([[0], np.cumsum(bad)]) + weight * np.append(np.cumsum(good[::-1])[::-1], 0)
    edges = np.concatenate([[steps[0] - STEPS], steps, [steps[-1] + STEPS]])
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    k = max(best.tolist(), key=lambda i: edges[i + 1] - edges[i])
    return float((edges[k] + edges[k + 1] + 1) / 2 / STEPS)


def _crc() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def _known(labels: DataFrame) -> DataFrame:
    """doc_id, toxic that may be learned from."""
    return labels.where("toxic is not null and doc_id is not null").where(_crc() % 4 != 2).select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])


def _trained(docs: DataFrame, known: DataFrame) -> tuple[Classifier, list]:
    """A classifier that isn't calibrated, and the ids that it was trained on."""
    # EACH ids of each label, a top-k each; of their rows one an id, and EACH of each label.
    few = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EACH) for v in (0, 1)]
    rows = docs.select("doc_id", "text", "lang").where("text is not null").join(F.broadcast(few[0].unionByName(few[1])), "doc_id")
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    rows = rows.withColumn("_n", one).where("_n = 1").drop("_n")
    # At most 2 EACH rows from here on; the bytes are summed over their sizes only.
    sizes = rows.select("doc_id", F.octet_length("text").cast("long").alias("_size"))
    within = sizes.select("doc_id", F.sum("_size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")).alias("_sum")).where(F.col("_sum") <= BYTES).select("doc_id")
    sample = sorted(rows.join(F.broadcast(within), "doc_id").collect(), key=lambda r: r.doc_id)
    net = Classifier()
    if not sample:
        net.base, net.out[:] = np.float32(-1), 0
        net.cuts[:] = -1 + np.log(0.85 / 0.15) - np.log(0.7 / 0.3)
        return net, []
    parts = [tokens(pa.array([r.text]))[0] for r in sample]  # one by one: the kernels' tables grow with what they get at once
    y = np.array([r.toxic for r in sample], np.float32)
    net.learn_groups(parts, [r.lang or "" for r in sample])
    # A fifth is left for the cuts.  As many of each label: the rarer repeated.
    train = np.flatnonzero(np.array([zlib.crc32(f"aside {r.doc_id}".encode()) % 5 for r in sample]) > 0)
    each = [train[y[train] == v] for v in (0, 1)]
    if min(map(len, each)):
        train = np.concatenate([np.resize(e, max(map(len, each))) for e in each])
    net.train([parts[i] for i in train], y[train])
    return net, [sample[i].doc_id for i in np.unique(train)]


def responses(docs: DataFrame, net: Classifier) -> DataFrame:
    """doc_id, response, group; checkpointed."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # tables of fixed size, 33 MB
    schema = docs.select("doc_id").schema.add("response", "double").add("group", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            rows, ptr = tokens(part.column("text"))
            net = shared.value
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(net.raw(rows, ptr).astype(np.float64)), pa.array(net.group(rows, ptr).astype(np.int32))], names=["doc_id", "response", "group"])

    return checkpoint(docs.select("doc_id", "text").mapInArrow(run, schema))


def _fitted(docs: DataFrame, labels: DataFrame) -> tuple[Classifier, DataFrame]:
    known = _known(labels)
    net, used = _trained(docs, known)
    found = responses(docs, net)
    if not used:
        return net, found
    seen = docs.sparkSession.createDataFrame([(i,) for i in used], docs.select("doc_id").schema)
    rest = found.join(known, "doc_id").join(F.broadcast(seen), "doc_id", "left_anti")
    # A row for each group, step and label; responses are bounded by the clip.
    step = F.floor(F.greatest(F.lit(-100.0), F.least(F.lit(100.0), "response")) * STEPS).alias("step")
    hist = [tuple(r) for r in rest.groupBy("group", step, "toxic").count().collect()]
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    shown = {v: max(1, sum(h[3] for h in hist if h[2] == v)) for v in (0, 1)}
    net.calibrate(hist, (totals.get(0, 1) / shown[0]) / (totals.get(1, 1) / shown[1]))
    return net, found


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Trained and calibrated on labelled rows whose crc32 of the id leaves another remainder than 2 by 4."""
    return _fitted(docs, labels)[0]


def _scores(found: DataFrame, net: Classifier) -> DataFrame:
    shift = F.element_at(F.array(*[F.lit(float(c)) for c in net.cuts]), F.col("group") + 1)
    x = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("response") - shift + F.lit(float(np.log(CUT / (1 - CUT))))))
    return found.select("doc_id", (1 / (1 + F.exp(-x))).alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def scored(docs: DataFrame, net: Classifier) -> DataFrame:
    """doc_id, score, predicted."""
    return _scores(responses(docs, net), net)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    net, found = _fitted(docs, labels)
    return _scores(found, net).select("doc_id", (_crc() % 4 == 2).alias("held_out"), "score", "predicted")
