"""Named queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinfold.functions import flags, paths
from twinfold.functions.storage import checkpoint
from twinfold.operators import dups, hashing, mark, rescan, tree
from twinfold.plans.model import COLUMNS, flagged, ignorable, listing, mirrored
from twinfold.plans.oracle import ORACLE_SQL  # noqa: F401
from twinfold.sources import codec
from twinfold.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def judged(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and their maximal duplicates, written down, as queries read both several times."""
    files = checkpoint(files.select(*COLUMNS))
    return files, checkpoint(dups.maximal(files))


@query
def digest_groups(spark: SparkSession, d: str) -> DataFrame:
    return tree.group_by_digest(flagged(spark, d))


@query
def files_sorted(spark: SparkSession, d: str) -> DataFrame:
    """File order, as the place of each file in its directory."""
    f = flagged(spark, d)
    order = Window.partitionBy(paths.parent("path")).orderBy(paths.path_key("path"), F.col("flag").bitwiseAND(F.lit(4)), "mod_ns", flags.decision(), "size")
    return f.withColumn("n", F.row_number().over(order).cast("bigint"))


@query
def dir_stats(spark: SparkSession, d: str) -> DataFrame:
    return tree.dir_stats(flagged(spark, d))


@query
def atoms(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d).select("path", paths.atom("path").alias("atom"))


@query
def ancestors(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d).select("path", F.explode(paths.ancestors("path")).alias("dir"))


@query
def unique_dirs(spark: SparkSession, d: str) -> DataFrame:
    return tree.unique_dirs(flagged(spark, d))


@query
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d).select("path", paths.parent("path").alias("parent"), paths.base("path").alias("base"), paths.is_dir("path").alias("is_dir"))


@query
def path_dist(spark: SparkSession, d: str) -> DataFrame:
    """Common roots and distances of live files to their old copies, or to their directories."""
    live = mirrored(spark, d).where("top = 'live/'").withColumn("b", F.when(F.col("doc_id") % 2 == 0, F.replace("path", F.lit("live/"), F.lit("old/"))).otherwise(paths.parent("path")))
    return live.select(F.col("path").alias("a"), "b", paths.common_root("path", "b").alias("root"), paths.dist("path", "b").cast("bigint").alias("dist"))


@query
def path_rank(spark: SparkSession, d: str) -> DataFrame:
    """Path order among the entries of each directory."""
    f = flagged(spark, d)
    every = f.select("path").unionByName(f.select(paths.parent("path").alias("path"))).distinct().where("path <> '.'")
    return every.withColumn("n", F.row_number().over(Window.partitionBy(paths.parent("path")).orderBy(paths.path_key("path"))).cast("bigint"))


@query
def flag_predicates(spark: SparkSession, d: str) -> DataFrame:
    tests = {f.__name__: f() for f in (flags.is_dup, flags.is_junk, flags.is_keep, flags.is_gone, flags.may_remove, flags.is_safe, flags.is_stored)}
    return flagged(spark, d).select("path", "flag", *[c.alias(n) for n, c in tests.items()], flags.flag_text().alias("text"))


@query
def ignorable_files(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d).where(ignorable()).select("path", "size")


@query
def file_lookup(spark: SparkSession, d: str) -> DataFrame:
    return tree.find_file(flagged(spark, d), "live/src0/Thumbs.db")


@query
def mark_keep(spark: SparkSession, d: str) -> DataFrame:
    return mark.mark_keep(flagged(spark, d), ["live/src1/"], check=False).select("path", "flag")


@query
def mark_dup(spark: SparkSession, d: str) -> DataFrame:
    return mark.mark_dup(flagged(spark, d), ["backup"], check=False).select("path", "flag")


@query
def mark_junk(spark: SparkSession, d: str) -> DataFrame:
    return mark.mark_junk(flagged(spark, d), ["live/src0/Thumbs.db", "./old//src2"], check=False).select("path", "flag")


@query
def rescan_same(spark: SparkSession, d: str) -> DataFrame:
    return rescan.same(flagged(spark, d), listing(spark, d))


@query
def rescan_stale(spark: SparkSession, d: str) -> DataFrame:
    return rescan.stale(flagged(spark, d), listing(spark, d)).select("path", "size", "mod_ns")


@query
def rescan_gone(spark: SparkSession, d: str) -> DataFrame:
    return rescan.gone(flagged(spark, d), listing(spark, d))


@query
def rescan_merge(spark: SparkSession, d: str) -> DataFrame:
    return rescan.rescan(flagged(spark, d), listing(spark, d))


@query
def dup_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return dups.verdicts(flagged(spark, d))


@query
def dups_maximal(spark: SparkSession, d: str) -> DataFrame:
    return dups.maximal(mirrored(spark, d))


@query
def dups_flagged(spark: SparkSession, d: str) -> DataFrame:
    return dups.maximal(flagged(spark, d))


@query
def dups_limit(spark: SparkSession, d: str) -> DataFrame:
    return dups.maximal(mirrored(spark, d), max_dups=5)


@query
def dup_lost(spark: SparkSession, d: str) -> DataFrame:
    f, found = judged(flagged(spark, d))
    return dups.lost(f, found)


@query
def dup_ignored(spark: SparkSession, d: str) -> DataFrame:
    f, found = judged(flagged(spark, d))
    return dups.ignored(f, found)


@query
def alt_candidates(spark: SparkSession, d: str) -> DataFrame:
    f, found = judged(flagged(spark, d))
    return dups.candidates(f, found).groupBy("dir", "alt").agg(F.count(F.lit(1)).alias("n"))


@query
def alt_scores(spark: SparkSession, d: str) -> DataFrame:
    f, found = judged(flagged(spark, d))
    return dups.scores(dups.candidates(f, found), tree.dir_stats(f)).withColumn("score", F.round("score", 9))


@query
def alt_best(spark: SparkSession, d: str) -> DataFrame:
    f, found = judged(flagged(spark, d))
    return dups.best(dups.scores(dups.candidates(f, found), tree.dir_stats(f))).select("dir", "alt", F.round("score", 9).alias("score"))


@query
def dup_alts(spark: SparkSession, d: str) -> DataFrame:
    """Greedy cover of every maximal duplicate directory; iterative, so without SQL."""
    f, found = judged(mirrored(spark, d))
    return dups.alternates(f, found).groupBy("dir", "alt", "round").agg(F.count(F.lit(1)).alias("n"))


@query
def file_map(spark: SparkSession, d: str) -> DataFrame:
    """For every file of a maximal duplicate directory the copy that stays; iterative, so without SQL."""
    f, found = judged(mirrored(spark, d))
    return dups.file_map(f, found)


@query
def index_lines(spark: SparkSession, d: str) -> DataFrame:
    """The body of the text index of the flagged tree."""
    return codec.index_lines(flagged(spark, d)).select("n", "line")


@query
def index_parse(spark: SparkSession, d: str) -> DataFrame:
    """The flagged tree written as lines and parsed again."""
    lines = codec.index_lines(flagged(spark, d))
    # A group's rows keep their order within the one index that each first letter of a digest makes here.
    return codec.parse(codec.numbered(lines)).where("error is null").select("path", "digest", "size", "mod_ns", "flag")


@query
def hash_compare(spark: SparkSession, d: str) -> DataFrame:
    return hashing.compare(mirrored(spark, d).select(paths.parent("path").alias("dir"), "digest"), ["dir"])


@query
def progress_ewma(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    n = F.row_number().over(Window.partitionBy(F.col("user_id") % 50).orderBy("event_id"))
    samples = events.select((F.col("user_id") % 50).alias("scan"), (n * F.lit(0.75)).alias("t"), (F.col("event_id") % 7 + 1).alias("files"), (F.col("event_id") % 1000 * 97).alias("bytes"))
    return progress.ewma(samples, ["scan"]).select("scan", "files", "bytes", F.round("fps", 6).alias("fps"), F.round("bps", 4).alias("bps"))


@query
def wide_groups(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of directories two levels down a tree of events."""
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select(
        F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string"), F.lit("/"), "event_type", F.lit("/d"), F.dayofmonth("ts").cast("string"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"),
        F.sha2(F.concat_ws("|", "props", "event_type", (F.col("user_id") % 50).cast("string")), 256).alias("digest"),
        F.lit(1).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("mod_ns"), F.lit(0).alias("flag"),
    )
    return tree.dir_stats(rows).where(paths.depth("dir") == 2).select(F.rtrim("dir", F.lit("/")).alias("dir"), "total_files", "unique_files")


QUERIES["ignorable"] = QUERIES.pop("ignorable_files")
