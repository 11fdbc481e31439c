"""Quality rules whose limits come from the data, with DataFrame operations only.

Measures of each text are taken in its own row by array functions.  For every
language and source a mergeable KLL quantile sketch of each rate is built, of the
texts that pass the base rules; sketches of sources merge into one of the
language, and those into one of all.  Quantiles of a source are shrunk towards
those of its language, and these towards those of all: n texts weigh as
n / (n + PRIOR).  A text is rejected if it fails a base rule, or if a rate lies
beyond the outer tenth of its group by more than REACH times the distance from
there to the median.  No limit is fixed; a count may only exceed what its limit
allows by one event, since a text can't hold less than one (in a group in which
nine tenths have no repeated line, a single one rejects nothing, two do).  The
limits are joined to the measures by language and source.

Edge cases: a null text has no words and fails the base rule; null languages and
sources form groups of their own; repeated rows each count; words and lines of
any number are taken whole; only doc_id, text, lang and source are read, so other
columns may clash; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions.storage import checkpoint

SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Texts that the wider group's quantiles weigh.
PRIOR = 100
#: Times the distance from the median to the outer tenth that a rate may lie beyond the latter.
REACH = 3.0
#: Rates: count, what it is divided by, and the count of one event (two places of a window, with no word in common).
RATES = {"chars_a_word": ("word_chars", "n_words", 0), "symbols_a_word": ("n_symbols", "n_words", 1), "dup_lines_a_line": ("n_dup_lines", "n_lines", 1), "repeats_a_word": ("n_repeat_words", "n_words", 6)}
#: Rates of which too little also counts.
BOTH_WAYS = ("chars_a_word",)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text."""
    blank = lambda c: F.translate(c, SEPARATORS, "")
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: blank(x) != "")
    cut = docs.select(
        "doc_id", "lang", "source",
        words.alias("words"), lines.alias("lines"),
        F.length(blank(text)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    counted = cut.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        # Every 3-word window with its place, equal ones side by side.
        F.expr("""if(size(words) < 3, array(), sort_array(transform(sequence(0, size(words) - 3),
            i -> named_struct('h', xxhash64(words[i], words[i + 1], words[i + 2]), 'i', i))))""").alias("windows"),
    )
    repeats = F.expr("""sort_array(transform(filter(sequence(0, greatest(size(windows) - 1, 0)),
        j -> windows[j].h = get(windows, j - 1).h or windows[j].h = get(windows, j + 1).h), j -> windows[j].i))""")
    placed = counted.withColumn("at", F.when(F.size("windows") > 0, repeats).otherwise(F.array().cast("array<int>"))).drop("windows")
    covered = F.expr("aggregate(at, named_struct('n', 0L, 'last', -3), (a, x) -> named_struct('n', a.n + least(3, x - a.last), 'last', x), a -> a.n)")
    return placed.withColumn("n_repeat_words", covered).drop("at")


def _rates(m: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.withColumns({r: F.col(n) / F.greatest(of, F.lit(1)) for r, (n, of, _) in RATES.items()} | {"base_failed": failed})


def limits(rated: DataFrame) -> DataFrame:
    """One row for each language and source: n, and for each rate its low and high limit."""
    by_source = rated.where("not base_failed").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(r).alias(r) for r in RATES])
    by_source = checkpoint(by_source)  # as many rows as there are languages and sources, a few KB each
    wider = lambda df, keys, tag: df.groupBy(*keys).agg(F.sum("n").alias(f"n_{tag}"), *[F.kll_merge_agg_double(r).alias(f"{r}_{tag}") for r in RATES])
    lang = wider(by_source, ["lang"], "lang").withColumnRenamed("lang", "_lang")
    every = wider(by_source, [], "all")
    joined = by_source.join(lang, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang").join(F.broadcast(every))  # every: one row
    out = joined
    shrunk = lambda n, own, wide: (F.col(n) * own + PRIOR * wide) / (F.col(n) + PRIOR)
    for r in RATES:
        q = lambda x, r=r: shrunk("n", _quantile(r, x), shrunk("n_lang", _quantile(f"{r}_lang", x), _quantile(f"{r}_all", x)))
        out = out.withColumn(f"{r}_high", q(0.9) + (q(0.9) - q(0.5)) * REACH).withColumn(f"{r}_low", q(0.1) - (q(0.5) - q(0.1)) * REACH)
    return out.select("lang", "source", "n", *[f"{r}_{x}" for r in RATES for x in ("low", "high")])


def _quantile(sketch: str, x: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(x))


def judged(docs: DataFrame) -> DataFrame:
    """The measures and rates of each text with base_failed and kept."""
    rated = _rates(checkpoint(measures(docs)))
    bounds = limits(rated)
    bounds = bounds.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *bounds.columns[3:])
    both = rated.join(bounds, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    within: Column = F.lit(True)
    for r, (n, of, event) in RATES.items():
        within &= F.coalesce(F.col(n) <= F.col(f"{r}_high") * F.col(of) + event, F.lit(True))
        if r in BOTH_WAYS:
            within &= F.coalesce(F.col(r) >= F.col(f"{r}_low"), F.lit(True))
    return both.withColumn("kept", ~F.col("base_failed") & within)


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, each once for every time it occurs; doc_id must be unique."""
    return docs.join(judged(docs).where("kept").select("doc_id"), "doc_id", "left_semi").select(*[docs[c] for c in docs.columns])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
