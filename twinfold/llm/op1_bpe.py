"""Byte-level BPE encoding and decoding with a given rank file.

Texts are cut by the split pattern.  The distinct pieces of a chunk that the
worker hasn't met yet are put into padded matrices, one per length bucket.
Every round each row merges its leftmost pair of minimum rank: pairs are looked
up in an open-addressing hash table held in numpy arrays, the row is compacted,
and rows without a mergeable pair leave the matrix.  Pieces longer than
``LONG`` bytes go through a heap over a linked list instead, because a matrix
round touches the whole row and would be quadratic in the length.

Edge cases: a null or empty text has no tokens and the hash of no bytes; rows
are encoded one by one, so repeated rows and clashing column names don't matter
(only the id and text columns are read).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.functions.ship import ship
from twinfold.llm.kernels import chunks

NONE = np.int32(2**31 - 1)
#: Pieces of more bytes leave the matrices for the heap.
LONG = 128
#: Pieces a worker remembers before it starts afresh.
REMEMBERED = 600_000
#: Rows of a matrix, and the lengths of its buckets.
ROWS = 4096
WIDTHS = (6, 8, 10, 12, 16, 24, 32, 64, 128)
ONE = np.ones(1, np.int64)
#: A rank file above this size isn't broadcast.
MAX_RANK_FILE = 64 << 20


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class PairTable:
    """(left id, right id) -> merged id, by open addressing with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = self._key(np.array(left, np.int64), np.array(right, np.int64))
        self.mask = (1 << max(4, (4 * len(keys)).bit_length())) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.full(self.mask + 1, NONE, np.int32)
        values, slot, self.probes = np.array(merged, np.int32), self._slot(keys), 1
        while len(keys):
            free = self.keys[slot] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(np.where(free, slot, -1), return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            keys, values, slot = keys[~put], values[~put], (slot[~put] + 1) & self.mask
            self.probes += 1

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) << 32) | b.astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(32)) & np.uint64(self.mask)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged ids of pairs of ids of any shape; NONE where a pair doesn't merge or an id is negative."""
        keys = self._key(a, b).ravel()
        out = np.full(len(keys), NONE, np.int32)
        ask = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        slot = self._slot(keys[ask])
        while len(ask):
            there = self.keys[slot]
            hit = there == keys[ask]
            out[ask[hit]] = self.values[slot[hit]]
            on = ~hit & (there != -1)
            ask, slot = ask[on], (slot[on] + 1) & self.mask
        return out.reshape(a.shape)


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.cumsum(self.token_len) - self.token_len
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int64)

    def merge_matrix(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For pieces of at most width bytes: their numbers as they were finished, counts of ids, ids in a row."""
        n = len(pieces)
        lens = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < lens[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ended, counts, flat = [], [], []
        rows = np.arange(n)
        ranks = self.pairs(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            best = ranks[every, at]
            done = best == NONE
            if done.any():
                ended.append(rows[done])
                counts.append((ids[done] >= 0).sum(1))
                flat.append(ids[done][ids[done] >= 0])
                on = ~done
                rows, ids, ranks, at, best = rows[on], ids[on], ranks[on], at[on], best[on]
                every = np.arange(len(rows))
                if not len(rows):
                    break
            ids[every, at] = best
            cols = np.arange(ids.shape[1] - 1)
            ids = np.concatenate([np.take_along_axis(ids, cols + (cols > at[:, None]), 1), np.full((len(rows), 1), -1, np.int32)], 1)
            cols = np.arange(ranks.shape[1] - 1)
            ranks = np.concatenate([np.take_along_axis(ranks, cols + (cols >= at[:, None]), 1), np.full((len(rows), 1), NONE, np.int32)], 1)
            ranks[every, at] = self.pairs(ids[every, at], ids[every, np.minimum(at + 1, ids.shape[1] - 1)])
            has = at > 0
            ranks[every[has], at[has] - 1] = self.pairs(ids[every[has], at[has] - 1], ids[every[has], at[has]])
            widest = int((ids >= 0).sum(1).max())
            if 2 <= widest < ids.shape[1] // 2:
                ids, ranks = ids[:, : widest + 1], ranks[:, :widest]
        return np.concatenate(ended), np.concatenate(counts), np.concatenate(flat)

    def merge_heap(self, piece: bytes) -> np.ndarray:
        """The same for one long piece: a heap of (rank, position) over a linked list."""
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        ranks = self.ranks

        def push(i: int) -> None:
            if i >= 0 and after[i] < len(parts):
                r = ranks.get(parts[i] + parts[after[i]])
                if r is not None:
                    heapq.heappush(heap, (r, i, len(parts[i]), len(parts[after[i]])))

        heap: list[tuple[int, int, int, int]] = []
        for i in range(len(parts) - 1):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if parts[i] is None or len(parts[i]) != a or after[i] >= len(parts) or len(parts[after[i]]) != b:
                continue
            j = after[i]
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            push(before[i])
            push(i)
        return np.array([ranks[p] for p in parts if p is not None], np.int32)

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that aren't known yet."""
        names: list[str] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        buckets: dict[int, list[str]] = {}
        raws = {p: p.encode() for p in pieces}
        for p, raw in raws.items():
            whole = self.ranks.get(raw)
            if whole is not None:
                names.append(p)
                counts.append(ONE)
                ids.append(np.array([whole], np.int32))
            elif len(raw) > LONG:
                names.append(p)
                ids.append(self.merge_heap(raw))
                counts.append(np.array([len(ids[-1])]))
            else:
                buckets.setdefault(next(w for w in WIDTHS if len(raw) <= w), []).append(p)
        for width, own in buckets.items():
            for i in range(0, len(own), ROWS):
                some = own[i : i + ROWS]
                order, lens, flat = self.merge_matrix([raws[p] for p in some], width)
                names += map(some.__getitem__, order.tolist())
                counts.append(lens)
                ids.append(flat)
        lens = np.concatenate(counts)
        base = len(self.len)
        self.known.update(zip(names, range(base, base + len(names))))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(lens) - lens])
        self.len = np.concatenate([self.len, lens])
        self.ids = np.concatenate([self.ids, *ids])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids begin."""
        if len(self.known) > REMEMBERED:
            self.forget()
        pieces: list[str] = []
        cuts = [0]
        for t in texts:
            if t:
                pieces += self.split(t)
            cuts.append(len(pieces))
        if new := set(pieces) - self.known.keys():
            self.learn(new)
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        lens = self.len[at]
        ends = np.concatenate([[0], np.cumsum(lens)])
        return self.ids[gather(self.start[at], lens)], ends[cuts]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids in a row, and where those of each text begin."""
        lens = self.token_len[ids]
        ends = np.concatenate([[0], np.cumsum(lens)])
        return self.token_bytes[gather(self.token_start[ids], lens)], ends[bounds]


def gather(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of all spans in a row."""
    ends = np.cumsum(lens)
    return np.repeat(starts - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)


_loaded: dict[tuple[int, str], Bpe] = {}


def _bpe(blob, pattern: str) -> Bpe:
    key = (hash(blob.value), pattern)
    if key not in _loaded:
        _loaded[key] = Bpe(read_ranks(blob.value), pattern)
    return _loaded[key]


def load_ranks(spark: SparkSession, path: str):
    """The rank file as a broadcast variable; a vocabulary file is bounded, and its size is checked."""
    ship(spark)
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_FILE + 1)
    if len(data) > MAX_RANK_FILE:
        raise ValueError(f"{path} has more than {MAX_RANK_FILE} bytes")
    return spark.sparkContext.broadcast(data)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id column, ids (array of int), decoded (binary)."""
    spark = docs.sparkSession
    blob = load_ranks(spark, path)
    schema = docs.select(F.col(id_col).alias("doc_id")).schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(blob, pattern)
        for part in chunks(batches):
            ids, at = bpe.encode(part.column("text").to_pylist())
            raw, to = bpe.decode(ids, at)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            data = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, data], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; ids and bytes stay in the worker."""
    blob = load_ranks(docs.sparkSession, path)
    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(blob, pattern)
        for part in chunks(batches):
            ids, at = bpe.encode(part.column("text").to_pylist())
            raw, to = bpe.decode(ids, at)
            ids_at, raw_at = memoryview(ids.astype("<u4").view(np.uint8)), memoryview(np.ascontiguousarray(raw))
            sha = lambda b: hashlib.sha256(b).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([sha(ids_at[4 * a : 4 * b]) for a, b in zip(at, at[1:])], pa.string()),
                    pa.array([sha(raw_at[a:b]) for a, b in zip(to, to[1:])], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
