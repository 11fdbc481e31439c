"""Substring deduplication: remove the words of windows that occur more than once.

A window is ``size`` consecutive words of one text.  Two equal windows share
their anchor: the k-word gram of least hash in the window, leftmost on ties.  It
stands at the same place in both, so two windows have two anchors, and an anchor
comes at least as often as any window around it.  Anchors are about a twelfth of
the words.

1. Count-min prefilter.  Each task sketches the anchors of its texts; the merged
   sketch, sized by the corpus up to a bound, overestimates how often an anchor, and
   so any window around it, occurs.
2. Exact pass.  Only windows whose anchor may occur twice are counted exactly,
   by a 96-bit hash of their words; none is lost, since the sketch never
   underestimates.  A task sends runs of neighbouring windows to the hash range of
   their anchor; what it holds twice is settled there, and one witness is sent.  A
   sketch that the corpus overfills lets more windows through: all of them are 2.4
   times the text, so the cost stays in proportion to the input.
3. The stretches of windows counted twice or more are brought back to their texts by
   text hash, and the words that they cover are removed.

Windows are judged on the input, not on what is left.

Edge cases: a null text has no words; texts shorter than a window keep all
their words; copies, also of one id, are occurrences of their windows; rows with
the same text get the same result; an empty table gives an empty result; only
the id and text columns are read, so others may clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import sketch
from twinfold.llm.kernels import Words, chunks, mix, stream

WINDOW = 35
GRAM = 8
PLACE_BITS = 30
#: Distinct texts that a task remembers before it starts afresh.
TEXTS = 500_000
#: Windows that a task gathers before it sends them, and windows of a hash range if all were sent.
GATHERED, RANGE = 700_000, 2_000_000
#: Bytes of text for each anchor, and for each word; they size tables only.
ANCHOR_BYTES, WORD_BYTES = 64, 6
#: Seeds of the word hashes, and of the hashes over words.
SEEDS = (11, 12)
OVER = (21, 22)
#: Text of a run that only bears witness.
WITNESS = (1 << 32) - 1


def anchors(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows; the gram hash and the place of each one's anchor."""
    gram = min(GRAM, size)
    at = words.windows(size)
    if not len(at):
        return at, np.zeros(0, np.uint64), at
    last = len(words) - gram
    starts = np.arange(last + 1)
    grams = stream(OVER[0] + 10).spans(hashes, starts, starts + gram)
    # The place in the low bits settles ties and comes out with the least hash; as many bits in every chunk, so that
    # equal windows choose alike.
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = (grams & ~mask) | starts.astype(np.uint64)
    span, have = size - gram + 1, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    place = (least[at] & mask).astype(np.int64)
    return at, grams[place], place


def _keys(size: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for part in chunks(batches):
            words = Words(part.column("text"))
            _, grams, place = anchors(words, words.hashes(SEEDS[0]), size)
            yield grams[np.unique(place, return_index=True)[1]]

    return keys


_PACKED = "p int, hashes binary, rests binary, runs binary, texts binary"


def _packed(rows: list[tuple[int, bytes, bytes, bytes, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(x, pa.binary()) for x in columns[1:]]], names=["p", "hashes", "rests", "runs", "texts"])


def _stretches(text: np.ndarray, at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of neighbouring windows of one text, alike in all of same, begin, and their lengths."""
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(text)))


class _Gathered:
    """Windows of a task that wait to be sent."""

    def __init__(self, ranges: int):
        self.ranges = ranges
        self.texts: list[tuple[int, int]] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, texts: list[tuple[int, int]], hashes: np.ndarray, rests: np.ndarray, grams: np.ndarray, owner: np.ndarray, at: np.ndarray) -> None:
        self.parts.append((hashes, rests, grams, owner + len(self.texts), at))
        self.texts += texts
        self.n += len(hashes)

    def sent(self) -> pa.RecordBatch:
        """Runs by range; what comes twice here is settled, its places go along under a negative range."""
        hashes, rests, grams, text, at = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((rests, hashes))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (rests[order[1:]] != rests[order[:-1]])
        first = np.flatnonzero(new)
        several = np.repeat(np.diff(np.append(first, len(order))) > 1, np.diff(np.append(first, len(order))))
        settled, leads = np.zeros(len(order), bool), np.zeros(len(order), bool)
        settled[order] = several
        leads[order] = new
        keys = np.array(self.texts, np.int64).reshape(-1, 2)
        rows = []
        own = np.flatnonzero(settled)
        if len(own):
            a, n = _stretches(text[own], at[own])
            used, local = np.unique(text[own[a]], return_inverse=True)
            runs = np.stack([local, at[own[a]], n]).astype("<u4")
            rows.append((-1 - int(hashes[0] % np.uint64(self.ranges)), b"", b"", runs.tobytes(), keys[used].astype("<i8").tobytes()))
        own = np.flatnonzero(leads)
        a, n = _stretches(text[own], at[own], grams[own], settled[own])
        # Anchors are least hashes, so they are hashed again to spread over the ranges.
        p = ((mix(grams[own[a]]) >> np.uint64(32)) * np.uint64(self.ranges) >> np.uint64(32)).astype(np.int64)
        by = np.argsort(p, kind="stable")
        for pick in np.split(by, np.flatnonzero(np.diff(p[by])) + 1):
            ends = np.cumsum(n[pick])
            windows = own[np.repeat(a[pick] - ends + n[pick], n[pick]) + np.arange(ends[-1])]
            lead = own[a[pick]]
            used, local = np.unique(text[lead[~settled[lead]]], return_inverse=True)
            name = np.full(len(pick), WITNESS, np.int64)
            name[~settled[lead]] = local
            runs = np.stack([name, at[lead], n[pick]]).astype("<u4")
            rows.append((int(p[pick[0]]), hashes[windows].astype("<u8").tobytes(), rests[windows].astype("<u4").tobytes(), runs.tobytes(), keys[used].astype("<i8").tobytes()))
        self.texts, self.parts, self.n = [], [], 0
        return _packed(rows)


def _met(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t1, t2, first, last): stretches of first words of the windows that come twice or more in a range."""
    hashes, rests, runs, texts, n_texts = [], [], [], [np.zeros((0, 2), np.int64)], 0
    for batch in batches:
        for h, r, u, t in zip(*(batch.column(c) for c in ("hashes", "rests", "runs", "texts"))):
            hashes.append(np.frombuffer(h.as_buffer(), "<u8"))
            rests.append(np.frombuffer(r.as_buffer(), "<u4"))
            run = np.frombuffer(u.as_buffer(), "<u4").astype(np.int64).reshape(3, -1)
            run[0] = np.where(run[0] == WITNESS, -1, run[0] + n_texts)
            runs.append(run)
            texts.append(np.frombuffer(t.as_buffer(), "<i8").reshape(-1, 2))
            n_texts += len(texts[-1])
    run, names = np.concatenate(runs, 1), np.concatenate(texts)
    if key[0].as_py() < 0:
        text, first, last = run[0], run[1], run[1] + run[2]
    else:
        h, r = np.concatenate(hashes), np.concatenate(rests)
        order = np.lexsort((r, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (r[order[1:]] != r[order[:-1]])
        group = np.cumsum(new) - 1
        owner = np.repeat(np.arange(run.shape[1]), run[2])
        text = run[0][owner]
        at = run[1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(run[2]) - run[2], run[2])
        votes = np.bincount(group, np.where(text[order] < 0, 2, 1)) > 1
        repeated = np.zeros(len(h), bool)
        repeated[order] = votes[group]
        own = np.flatnonzero(repeated & (text >= 0))
        a, n = _stretches(text[own], at[own])
        text, first = text[own[a]], at[own[a]]
        last = first + n
    yield pa.RecordBatch.from_arrays([pa.array(names[text, 0]), pa.array(names[text, 1]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["t1", "t2", "first", "last"])


def _text_keys() -> list:
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2")]


def repeated_windows(docs: DataFrame, size: int = WINDOW, most_bits: int = sketch.MOST_BITS, gathered: int = GATHERED) -> DataFrame:
    """(t1, t2, first, last): text hashes, and stretches of first words of the windows that occur twice or more in the texts.

    most_bits: bound of the sketch's width; gathered: windows that a task sends at once."""
    texts = docs.select(*_text_keys(), "text").where("text is not null")
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    seen = sketch.marked(texts.select("text"), _keys(size), sketch.width(total // ANCHOR_BYTES + 1, most_bits), 2)
    ranges = total // WORD_BYTES // RANGE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter[tuple[int, int]] = Counter()
        held = _Gathered(ranges)
        for part in chunks(batches):
            # Two copies of a text say of its windows all that more would.
            if len(met) > TEXTS:
                met.clear()
            fresh, names = [], []
            for key in zip(part.column("t1").to_pylist(), part.column("t2").to_pylist()):
                met[key] += 1
                fresh.append(met[key] <= 2)
                if fresh[-1]:
                    names.append(key)
            words = Words(part.column("text").filter(pa.array(fresh)))
            first = words.hashes(SEEDS[0])
            at, grams, place = anchors(words, first, size)
            if not len(at):
                continue
            _, ask, back = np.unique(place, return_index=True, return_inverse=True)
            keep = seen(grams[ask])[back]
            at, grams = at[keep], grams[keep]
            if len(at):
                owner = np.searchsorted(words.ptr, at, "right") - 1
                second = stream(OVER[1]).spans(words.hashes(SEEDS[1]), at, at + size)
                held.add(names, stream(OVER[0]).spans(first, at, at + size), (second >> np.uint64(32)).astype(np.uint32), grams, owner, at - words.ptr[owner])
            if held.n >= gathered:
                yield held.sent()
        if held.n:
            yield held.sent()

    return texts.mapInArrow(run, _PACKED).groupBy("p").applyInArrow(_met, "t1 long, t2 long, first int, last int")


def remove_repeats(docs: DataFrame, size: int = WINDOW, **options: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space); options as repeated_windows has them."""
    spans = repeated_windows(docs, size, **options).groupBy("t1", "t2").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    spans = spans.select("t1", "t2", F.col("spans.first").alias("first"), F.col("spans.last").alias("last"))
    joined = docs.select("doc_id", "text", *_text_keys()).join(spans, ["t1", "t2"], "left").select("doc_id", "text", "first", "last")
    schema = docs.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            words = Words(part.column("text"))
            first, last = part.column("first"), part.column("last")
            begin = np.repeat(words.ptr[:-1], np.asarray(first.value_lengths().fill_null(0)))
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, begin + first.flatten().to_numpy(), 1)
            np.add.at(edge, begin + last.flatten().to_numpy() + size - 1, -1)
            kept = np.cumsum(edge[:-1]) == 0
            removed = words.counts - np.diff(np.concatenate([[0], np.cumsum(kept)])[words.ptr])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), kept_texts(words, kept)],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return joined.mapInArrow(run, schema)


def kept_texts(words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    starts, ends = words.starts[kept], words.ends[kept]
    lens = ends - starts + 1  # and a space
    to = np.cumsum(lens)
    at = np.repeat(starts - to + lens, lens) + np.arange(to[-1] if len(to) else 0)
    raw = np.append(words.raw, np.uint8(32))[at]
    raw[to - 1] = 32
    owner = np.repeat(np.arange(len(words.counts)), words.counts)[kept]
    n = np.bincount(owner, minlength=len(words.counts))
    bytes_at = np.concatenate([[0], to])[np.concatenate([[0], np.cumsum(n)])]
    data = raw.tobytes()
    return pa.array([data[a : max(a, z - 1)] for a, z in zip(bytes_at, bytes_at[1:])], pa.binary())


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows are told apart by MD5 here.
SQL = r"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT rid, unnest(range(len(words) - 34)) AS pos, words FROM w WHERE len(words) >= 35),
rep AS (SELECT rid, pos FROM (SELECT rid, pos, md5(array_to_string(words[pos + 1 : pos + 35], ' ')) AS h FROM win) QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT rid, pos + j AS k FROM rep, range(35) r(j)),
word AS (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS k FROM w),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (rid, k) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (rid)"""
