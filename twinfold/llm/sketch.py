"""A mergeable count-min sketch with byte counters that stop at a cap, kept as bits once merged.

It tells which keys may have come ``least`` times, and never misses one that has.
Each of its rows has CELLS cells a key, so few other keys pass, up to 2 ** MOST_BITS
cells, that is 64 MB a row, so that what is broadcast stays bounded.  A table
that is fuller than that lets more keys pass: that costs the caller work, never a key.

Each task sends sparse blocks of (cell, count); they are merged per block in two
rounds, first among a share of the tasks and then all, so that no task holds
more than the counters of one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame

from twinfold.functions.ship import ship
from twinfold.llm.kernels import mix

DEPTH = 2
#: Cells for each key, and the most cells of a row as bits of their number.
CELLS, MOST_BITS = 8, 29
#: Cells of a block, as bits of their number.
BLOCK_BITS = 19
SALTS = 8
#: Keys a task gathers before it sends them.
GATHERED = 2_000_000

SCHEMA = pa.schema([("block", pa.int32()), ("salt", pa.int32()), ("cells", pa.binary())])

Keys = Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]


def width(keys: int, most: int = MOST_BITS) -> int:
    """Bits of the number of cells for so many keys."""
    return min(most, max(4, (CELLS * keys - 1).bit_length()))


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(keys + np.uint64(row * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(64 - bits)).astype(np.int64)


def _coded(cell: np.ndarray, count: np.ndarray) -> bytes:
    return (cell << 8 | np.minimum(count, 255)).astype("<u4").tobytes()


def blocks(keys: np.ndarray, bits: int, cap: int) -> pa.RecordBatch:
    """The sketch of the keys as rows of SCHEMA."""
    out: tuple[list[int], list[int], list[bytes]] = ([], [], [])
    small = min(bits, BLOCK_BITS)
    for row in range(DEPTH):
        cell, count = np.unique(cells(keys, row, bits), return_counts=True)
        block, local = cell >> small, cell & ((1 << small) - 1)
        ids, first = np.unique(block, return_index=True)
        for b, a, z in zip(ids.tolist(), first, [*first[1:], len(cell)]):
            out[0].append(row << (bits - small) | b)
            out[1].append(int(keys[0] % np.uint64(SALTS)))
            out[2].append(_coded(local[a:z], np.minimum(count[a:z], cap)))
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], schema=SCHEMA)


def _merging(cap: int, size: int, last: bool):
    """Merges the cells of a block; the last round tells which counts have reached the cap, as bits."""

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(size, np.int32)
        for batch in batches:
            for x in batch.column("cells"):
                coded = np.frombuffer(x.as_buffer(), "<u4").astype(np.int64)
                at = coded >> 8  # cells differ within a row
                count[at] = np.minimum(cap, count[at] + (coded & 255))
        cell = np.flatnonzero(count)
        out = np.packbits(count >= cap).tobytes() if last else _coded(cell, count[cell])
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([out], pa.binary())], schema=SCHEMA)

    return merge


class Marked:
    """Tells in a worker which keys may have come often enough."""

    def __init__(self, rows: Broadcast, bits: int):
        self.rows, self.bits = rows, bits

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for row, table in enumerate(self.rows.value):
            at = np.flatnonzero(out)
            cell = cells(keys[at], row, self.bits)
            out[at] = (table[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1
        return out


def marked(df: DataFrame, keys: Keys, bits: int, least: int) -> Marked:
    """Of the keys that keys() finds in the batches of df, those that come ``least`` times or more, and some others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for found in keys(batches):
            held.append(found)
            n += len(found)
            if n > GATHERED:
                yield blocks(np.concatenate(held), bits, least)
                held, n = [], 0
        if n:
            yield blocks(np.concatenate(held), bits, least)

    ship(df.sparkSession)
    schema = "block int, salt int, cells binary"
    small = min(bits, BLOCK_BITS)
    some = df.mapInArrow(run, schema).groupBy("block", "salt").applyInArrow(_merging(least, 1 << small, False), schema)
    rows = [np.zeros(max(1, 1 << (bits - 3)), np.uint8) for _ in range(DEPTH)]
    for x in some.groupBy("block").applyInArrow(_merging(least, 1 << small, True), schema).toLocalIterator():
        row, block = divmod(x.block, 1 << (bits - small))
        own = np.frombuffer(x.cells, np.uint8)
        rows[row][block << (small - 3) :][: len(own)] = own
    return Marked(df.sparkSession.sparkContext.broadcast(rows), bits)


def members(df: DataFrame, keys: Keys, n: int) -> Marked:
    """Tells which keys may be among the n that keys() finds."""
    return marked(df, keys, width(n), 1)
