"""Benchmark decontamination over templates.

A text becomes a template: numbers, names and units turn into typed slots, other
words are lower-cased.  A number is a word that begins with a digit; a unit is one of
UNITS right after a number; a name is a capitalised word.  Where a sentence begins a
capitalised word may be a name or not, so there are two templates, one that takes it
for a literal and one that takes it for a name.  Windows of ``size`` template words (a
shorter item: all of it) with at least LITERAL (an item: SHORT_LITERAL) words that
aren't slots are hashed, and windows of documents are joined by hash with windows of benchmark items.  A run of
joined windows (one document, item, template and offset between them) counts if its
slots are consistent: each value of the item stands for one value in the document
wherever it recurs.  So exact passages are found, and re-parameterised ones too.
Windows and items with fewer literals, such as bare sums, are joined by their exact words, case included.

Before the join, a table of fixed size over the benchmark's window hashes leaves
out nearly all windows of the documents.

Edge cases: null or empty texts and items match nothing; items of fewer than SHORTEST
words can't match, as any text may hold them by chance; copies and rows that repeat an id are each
reported; texts of any length are read whole; an empty benchmark matches nothing;
only id and text columns are read, so others may clash; an item that comes twice is
reported once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions.ship import ship
from twinfold.functions.storage import checkpoint
from twinfold.llm import sketch
from twinfold.llm.kernels import LOWER, chunks, stream, utf8

WINDOW = 12
#: Literals that a window needs, and that a shorter item needs.
LITERAL, SHORT_LITERAL = 6, 5
SHORTEST = 4
#: How a window is written: sentence beginnings as literals, as names, or all words as they are.
TEMPLATES = PLAIN, NAMED, EXACT = 0, 1, 2
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g gram grams kg lb lbs pound pounds oz ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh percent dollar dollars cent cents euro euros degree degrees celsius fahrenheit kelvin watt watts volt volts joule joules hz kb mb gb".split()
)

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n:\"|")] = True
_SLOT = np.array([0, 0x1111111111111111, 0x2222222222222222, 0x3333333333333333], np.uint64)


def _unit_hashes() -> np.ndarray:
    s = stream(61)
    raw = [np.frombuffer(u.encode(), np.uint8) for u in sorted(UNITS)]
    buf = np.concatenate(raw)
    ends = np.cumsum([len(r) for r in raw])
    return np.sort(s.spans(s.byte[buf], ends - [len(r) for r in raw], ends))


class Templates:
    """Template words of texts: value hash, kind (0 literal, 1 number, 2 name, 3 unit), and bounds ptr of each text."""

    def __init__(self, texts: pa.Array):
        raw, offsets = utf8(texts)
        low = LOWER[raw]
        n = len(raw)
        on = _TOKEN[raw]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], on])[:n] & ~edge[:n]
        after = np.append(on[1:], False)[:n] & ~edge[1:]
        starts = np.flatnonzero(on & ~before)
        ends = np.flatnonzero(on & ~after) + 1
        self.ptr = np.searchsorted(starts, offsets)
        s = stream(61)
        self.value = s.spans(s.byte[low], starts, ends)
        self.cased = s.spans(s.byte[raw], starts, ends)
        # A word begins a sentence if a stop stands between it and the word before, or none is before.
        stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
        begins = np.ones(len(starts), bool)
        begins[1:] = stops[starts[1:]] > stops[ends[:-1]]
        begins[self.ptr[:-1][self.ptr[:-1] < len(starts)]] = True
        first = raw[starts]
        self.kind = np.zeros(len(starts), np.int8)
        capital = (first >= 65) & (first <= 90)
        self.kind[capital & ~begins] = 2
        self.kind[(first >= 48) & (first <= 57)] = 1
        units = _unit_hashes()
        unit = np.zeros(len(starts), bool)
        unit[1:] = (self.kind[:-1] == 1) & (self.kind[1:] != 1)
        unit[self.ptr[:-1][self.ptr[:-1] < len(starts)]] = False
        place = np.minimum(np.searchsorted(units, self.value), len(units) - 1)
        self.kind[unit & (units[place] == self.value)] = 3
        self.kinds = [self.kind, np.where(capital & begins & (self.kind == 0), np.int8(2), self.kind), np.zeros_like(self.kind)]

    def windows(self, size: int, template: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words, text and hash of the windows that the template is for."""
        counts = np.diff(self.ptr)
        at = np.arange(len(self.value))
        owner = np.repeat(np.arange(len(counts)), counts)
        keep = at + size <= self.ptr[owner + 1]
        at, owner = at[keep], owner[keep]
        kind = self.kinds[template]
        count = lambda of: (total := np.concatenate([[0], np.cumsum(of)]))[at + size] - total[at]
        least = LITERAL if size == WINDOW else SHORT_LITERAL
        if template == EXACT:
            keep = count(self.kind == 0) < least
        else:
            keep = count(kind == 0) >= least
            if template == NAMED:  # else the plain one says the same
                keep &= count(kind != self.kind) > 0
        at, owner = at[keep], owner[keep]
        return at, owner, stream(62 + template).spans(self.cased if template == EXACT else np.where(kind == 0, self.value, _SLOT[kind]), at, at + size)

    def slots(self, at: np.ndarray, size: int, template: int) -> pa.Array:
        """The values of the slots of windows, in order."""
        slot = np.flatnonzero(self.kinds[template] > 0)
        a, z = np.searchsorted(slot, at), np.searchsorted(slot, at + size)
        ends = np.cumsum(z - a)
        flat = slot[np.repeat(a - ends + (z - a), z - a) + np.arange(ends[-1] if len(ends) else 0)]
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(self.value[flat].view(np.int64)))


def _windows(df: DataFrame, keys: list[str], sizes: list[int], among: sketch.Marked | None) -> DataFrame:
    """The keys with size, h, at, slots of windows (of all, where among is None)."""
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", size int, template int, h long, at int, slots array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            t = Templates(part.column("text"))
            for size, template in ((size, template) for size in sizes for template in TEMPLATES):
                at, owner, h = t.windows(size, template)
                if among is None and size != WINDOW:  # a short item is one window
                    short = np.diff(t.ptr)[owner] == size
                    at, owner, h = at[short], owner[short], h[short]
                if among is not None:
                    hit = among(h)
                    at, owner, h = at[hit], owner[hit], h[hit]
                if len(at):
                    own = pa.array(owner)
                    fixed = [pa.array(np.full(len(at), x, np.int32)) for x in (size, template)]
                    yield pa.RecordBatch.from_arrays(
                        [*[part.column(k).take(own) for k in keys], *fixed, pa.array(h.view(np.int64)), pa.array((at - t.ptr[owner]).astype(np.int32)), t.slots(at, size, template)],
                        names=[*keys, "size", "template", "h", "at", "slots"],
                    )

    return df.mapInArrow(run, schema)


def _text_keys() -> list:
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2")]


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(t1, t2, item_id, n_windows, n_slots): text hashes of documents and the items that they hold."""
    ship(docs.sparkSession)
    items = checkpoint(_windows(benchmark.select("item_id", "text").where("text is not null"), ["item_id"], list(range(SHORTEST, size + 1)), None))
    # At most as many sizes as a window has words.
    sizes = sorted(r.size for r in items.select("size").distinct().collect())

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield batch.column("h").to_numpy().view(np.uint64)

    among = sketch.members(items.select("h"), keys, items.count())
    found = _windows(docs.select(*_text_keys(), "text").where("text is not null"), ["t1", "t2"], sizes, among)
    mine = items.select("size", "template", "h", "item_id", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    both = found.join(mine, ["size", "template", "h"]).select("t1", "t2", "item_id", "template", "at", (F.col("at") - F.col("item_at")).alias("off"), F.arrays_zip("item_slots", "slots").alias("pairs"))
    # Copies add nothing new to the set of pairs, which the item's slots bound.
    runs = both.groupBy("t1", "t2", "item_id", "off", "template").agg(F.count_distinct("at").alias("n"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    consistent = F.size("pairs") == F.size(F.array_distinct(F.expr("transform(pairs, p -> p.item_slots)")))
    # The templates tell of the same windows, or of some each: the one with most counts.
    alike = runs.where(consistent).groupBy("t1", "t2", "item_id", "off").agg(F.max("n").alias("n"), F.max(F.size("pairs")).cast("long").alias("n_slots"))
    return alike.groupBy("t1", "t2", "item_id").agg(F.sum("n").alias("n_windows"), F.max("n_slots").alias("n_slots"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item."""
    hits = matches(docs, benchmark).select("t1", "t2").distinct()
    own = [f"_in_{i}" for i in range(len(docs.columns))]
    text = own[docs.columns.index("text")]
    rows = docs.toDF(*own)
    same = (F.xxhash64(text) == F.col("t1")) & (F.xxhash64(F.lit("second"), text) == F.col("t2"))
    return rows.join(hits, same, "left_anti").toDF(*docs.columns)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of every document that holds an item, with the windows and slots of the match."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return docs.where("text is not null").select("doc_id", *_text_keys()).join(matches(docs, benchmark), ["t1", "t2"]).select("doc_id", "item_id", "n_windows", "n_slots")
