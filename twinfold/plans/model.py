"""Schemas, rules that rows must keep, and file tables derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions import flags, paths

FILES = "path string, digest string, size bigint, mod_ns bigint, flag int"
COLUMNS = ["path", "digest", "size", "mod_ns", "flag"]
#: Names of files that don't matter (fixed values).
IGNORED_NAMES = ("thumbs.db", "desktop.ini")
SECOND = 1_000_000_000


def ignorable() -> Column:
    """Empty files and those whose name the desktop makes; names fold case as Unicode's simple folding does."""
    return (F.col("size") == 0) | F.lower(F.upper(paths.base("path"))).isin(*IGNORED_NAMES)


def live(files: DataFrame) -> DataFrame:
    return files.where(~flags.is_gone())


def violations(files: DataFrame) -> DataFrame:
    """(rule, what): rows, digests and paths that break a rule; empty for a sound table."""
    bad_path = files.where(~paths.valid_name("path") | F.col("path").isNull()).select(F.lit("path").alias("rule"), "path")
    bad_size = files.where("size < 0 or size is null").select(F.lit("size").alias("rule"), "path")
    bad_digest = files.where("digest is null or not digest rlike '^[0-9a-f]{64}$'").select(F.lit("digest").alias("rule"), "path")
    sizes = files.groupBy("digest").agg(F.min("size").alias("a"), F.max("size").alias("b")).where("a <> b").select(F.lit("one digest, several sizes").alias("rule"), F.col("digest").alias("path"))
    twice = live(files).groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("path exists twice").alias("rule"), "path")
    dirs = live(files).select(F.explode(paths.proper_ancestors("path")).alias("dir")).distinct().where("dir <> '.'")
    both = live(files).join(dirs, F.concat("path", F.lit("/")) == F.col("dir"), "left_semi").select(F.lit("file and directory").alias("rule"), "path")
    out = bad_path.unionByName(bad_size).unionByName(bad_digest).unionByName(sizes).unionByName(twice).unionByName(both)
    return out.withColumnRenamed("path", "what")


def mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees live/, backup/ and old/ over documents: copies, half the copies, and a quarter of them, some changed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    tail = F.concat("source", F.lit("/"), "lang", F.lit("/b"), (F.col("doc_id") % 8).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    changed = F.when(F.col("doc_id") % 40 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    # One pass over the texts: each row yields its copies.
    copy = lambda top, text, flag, keep: F.when(keep, F.struct(F.lit(top).alias("top"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("bigint").alias("size"), flag.cast("int").alias("flag")))
    own = F.col("text")
    copies = F.array(
        copy("live/", own, F.lit(0), F.lit(True)),
        copy("backup/", own, F.lit(0), F.col("doc_id") % 2 == 0),
        copy("old/", changed, F.when(F.col("doc_id") % 16 == 0, 1).otherwise(0), F.col("doc_id") % 4 == 0),
    )
    rows = docs.select("doc_id", "source", tail.alias("tail"), F.explode(F.array_compact(copies)).alias("c"))
    return rows.select(F.concat("c.top", "tail").alias("path"), "c.digest", "c.size", ((F.col("doc_id") + 1_700_000_000) * SECOND).alias("mod_ns"), "c.flag", "doc_id", "source", F.col("c.top").alias("top"))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mirrored trees with every kind of flag, ignorable files and atomic directories."""
    m = mirrored(spark, sf_dir)
    i = F.col("doc_id")
    flag = (
        F.when((F.col("top") == "live/") & (i % 97 == 0), 3)
        .when((F.col("top") == "backup/") & (i % 106 == 0), 7)
        .when((F.col("top") == "backup/") & (i % 53 == 0), 4)
        .otherwise(F.col("flag"))
    )
    rows = m.withColumn("flag", flag.cast("int"))
    sources = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct()
    thumbs = sources.select(F.concat(F.lit("live/"), "source", F.lit("/Thumbs.db")).alias("path"), F.sha2(F.lit("thumbs"), 256).alias("digest"), F.lit(6).cast("bigint").alias("size"))
    empty = sources.select(F.concat(F.lit("live/"), "source", F.lit("/empty")).alias("path")).select("path", F.sha2(F.col("path"), 256).alias("digest"), F.lit(0).cast("bigint").alias("size"))
    small = thumbs.unionByName(empty).withColumn("mod_ns", F.lit(1_700_000_000 * SECOND)).withColumn("flag", F.lit(0))
    git = m.where((F.col("top") == "live/") & (i % 10 == 0)).select(F.concat(F.lit("live/"), "source", F.lit("/.git/objects/"), i.cast("string")).alias("path"), "digest", "size", "mod_ns", F.lit(0).alias("flag"))
    return rows.select(*COLUMNS).unionByName(small.select(*COLUMNS)).unionByName(git.select(*COLUMNS))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later listing of the flagged tree: some files deleted, touched, changed, and some new; digest is what hashing would find."""
    old = live(flagged(spark, sf_dir)).select("path", "digest", "size", "mod_ns")
    i = F.coalesce(F.expr("try_cast(regexp_extract(path, '([0-9]+)(\\\\.txt)?$', 1) as bigint)"), F.lit(1))
    kept = old.withColumn("i", i).where("i % 11 <> 0")
    changed = kept.withColumn("digest", F.when(F.col("i") % 17 == 0, F.sha2(F.concat("digest", F.lit("+")), 256)).otherwise(F.col("digest")))
    changed = changed.withColumn("size", F.when(F.col("i") % 17 == 0, F.col("size") + 1).otherwise(F.col("size"))).withColumn("mod_ns", F.when(F.col("i") % 13 == 0, F.col("mod_ns") + SECOND).otherwise(F.col("mod_ns")))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 19 = 0")
    new = docs.select(F.concat(F.lit("new/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("bigint").alias("size"), F.lit(1_800_000_000 * SECOND).alias("mod_ns"))
    return changed.drop("i").unionByName(new)
