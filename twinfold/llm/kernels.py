"""Vectorised text kernels shared by the operators that run in Python workers.

Texts arrive as Arrow string arrays.  The kernels work on the UTF-8 buffer
itself: words are found by a byte table, and every word is hashed with a
polynomial over its bytes, taken from prefix sums modulo 2**64, so no Python
object is made for a word.  ``chunks`` bounds the working memory: a chunk holds
about a megabyte of text, and one text longer than that is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20

#: Byte separators of words: space and U+0009 to U+000D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII lower-casing of bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element-wise."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Stream:
    """One independent hash function: byte values, and powers of an odd base with their inverses."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.byte = rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
        self.base = int(rng.integers(2**40, 2**62)) * 2 + 1
        self.inverse = pow(self.base, -1, 2**64)
        self.salt = U64(int(rng.integers(1, 2**63)))
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                up, down = np.full(size, self.base, np.uint64), np.full(size, self.inverse, np.uint64)
                up[0] = down[0] = 1
                self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[start:end] for each pair, the same wherever the values stand."""
        up, down = self.powers(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * self.salt)


#: Hash functions by seed; a worker makes each once.
_streams: dict[int, Stream] = {}


def stream(seed: int) -> Stream:
    if seed not in _streams:
        _streams[seed] = Stream(seed)
    return _streams[seed]


class Words:
    """The words of a chunk of texts: byte spans, and for text i the words ptr[i] to ptr[i + 1]."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        buf, offsets = utf8(texts)
        self.raw = buf
        self.offsets = offsets
        self.buf = LOWER[buf] if lower else buf
        n = len(buf)
        sep = SEPARATOR[buf]
        before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
        before[1:] = sep if n else True
        before[offsets] = True
        after[:n] = sep
        after[offsets] = True
        word = ~sep
        self.starts = np.flatnonzero(word & before[:n])
        self.ends = np.flatnonzero(word & after[1:]) + 1
        self.ptr = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.ptr)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, seed: int) -> np.ndarray:
        s = stream(seed)
        return s.spans(s.byte[self.buf], self.starts, self.ends)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, size: int) -> np.ndarray:
        """First words of all windows of so many words that stay in one text."""
        last = np.repeat(self.ptr[1:] - size, self.counts)
        at = np.arange(len(self))
        return at[at <= last]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array (null: none) and its offsets into them."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    if data is None or not n:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have about so many bytes, and of so many rows at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            to = min(to, at + rows)
            yield batch.slice(at, to - at)
            at = to


def table(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(k).type) for k, c in columns.items()], schema=schema)
