"""Directories whose content exists elsewhere, what would be lost, and which directories keep it best.

Whether a safe copy lies outside a directory is a difference of two counts, the
copies anywhere and those inside, so no file is joined with its copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinfold.functions import flags, paths
from twinfold.functions.storage import checkpoint
from twinfold.operators.tree import dir_stats
from twinfold.plans.model import ignorable, live

MAX_LOST = 10


def dir_content(files: DataFrame) -> DataFrame:
    """(dir, digest, size) of subtrees: n_real, keep, n_outside (safe copies elsewhere)."""
    safe = F.sum(flags.is_safe().cast("bigint"))
    own = live(files).groupBy(paths.parent("path").alias("own"), "digest", "size").agg(safe.alias("n_safe"), F.sum((~ignorable()).cast("bigint")).alias("n_real"), F.max(flags.is_keep()).alias("keep"))
    inside = own.select(F.explode(paths.ancestors("own")).alias("dir"), "digest", "size", "n_safe", "n_real", "keep").groupBy("dir", "digest", "size").agg(F.sum("n_safe").alias("n_safe"), F.sum("n_real").alias("n_real"), F.max("keep").alias("keep"))
    total = files.groupBy("digest", "size").agg(safe.alias("n_total"))
    return inside.join(total, ["digest", "size"]).select("dir", "digest", "size", "n_real", "keep", (F.col("n_total") - F.col("n_safe")).alias("n_outside"))


def _verdicts(content: DataFrame, max_lost: int) -> DataFrame:
    real = F.col("n_real") > 0
    per_dir = content.groupBy("dir").agg(
        F.max("keep").alias("keep"),
        F.sum((real & (F.col("n_outside") > 0)).cast("bigint")).alias("n_safe"),
        F.sum((real & (F.col("n_outside") <= 0)).cast("bigint")).alias("n_lost"),
    )
    inside_atom = paths.atom("dir").isNotNull() & (paths.atom("dir") != F.col("dir"))
    is_dup = ~F.col("keep") & (F.col("n_lost") <= max_lost) & (F.col("n_safe") > F.col("n_lost") * F.col("n_lost")) & ~inside_atom & (F.col("dir") != paths.ROOT)
    return per_dir.select("dir", "keep", "n_safe", "n_lost", is_dup.alias("is_dup"))


def verdicts(files: DataFrame, max_lost: int = MAX_LOST) -> DataFrame:
    """dir, keep, n_safe, n_lost, is_dup of every directory."""
    return _verdicts(dir_content(files), max_lost)


def _maximal(judged: DataFrame, below: str) -> DataFrame:
    found = judged.where("is_dup").where(paths.contains(F.lit(below), "dir") & (F.col("dir") != below)).drop("is_dup", "keep")
    above = found.select(F.col("dir").alias("_dir"), F.explode(paths.proper_ancestors("dir")).alias("_up"))
    nested = above.join(found.select(F.col("dir").alias("_up")), "_up", "left_semi").select(F.col("_dir").alias("dir"))
    return found.join(nested, "dir", "left_anti")


def maximal(files: DataFrame, below: str = paths.ROOT, max_lost: int = MAX_LOST, max_dups: int = 0) -> DataFrame:
    """dir, n_safe, n_lost of duplicate directories that no other one holds; the first max_dups in path order if over 0."""
    out = _maximal(verdicts(files, max_lost), below)
    return out.orderBy(paths.path_key("dir")).limit(max_dups) if max_dups > 0 else out


def _files_under(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """Existing files with the directory of dirs (none of which holds another) that they lie under."""
    return live(files).withColumn("dir", F.explode(paths.ancestors(paths.parent("path")))).join(dirs.select("dir"), "dir", "left_semi")


def lost(files: DataFrame, dups: DataFrame) -> DataFrame:
    """(dir, file columns): every existing copy under a duplicate whose content isn't safe elsewhere."""
    gone = dir_content(files).join(dups.select("dir"), "dir", "left_semi").where("n_real > 0 and n_outside <= 0").select("dir", "digest", "size")
    return _files_under(dups, files).where(~ignorable()).join(gone, ["dir", "digest", "size"], "left_semi").select("dir", "path", "digest", "size", "mod_ns", "flag")


def ignored(files: DataFrame, dups: DataFrame) -> DataFrame:
    """(dir, file columns): files under a duplicate that don't matter."""
    return _files_under(dups, files).where(ignorable()).select("dir", "path", "digest", "size", "mod_ns", "flag")


def _places(files: DataFrame, dups: DataFrame, content: DataFrame) -> DataFrame:
    """Safe copies of the content: their path, own (the directory) and lies (the duplicate that they are under, or null)."""
    safe = files.where(flags.is_safe()).join(content.select("digest", "size").distinct(), ["digest", "size"], "left_semi")
    safe = safe.select("path", "digest", "size", paths.parent("path").alias("own"))
    under = safe.select("own").distinct().select("own", F.explode(paths.ancestors("own")).alias("lies"))
    # No duplicate holds another, so a directory lies under one at most.
    return safe.join(under.join(dups.select(F.col("dir").alias("lies")), "lies", "left_semi"), "own", "left")


def candidates(files: DataFrame, dups: DataFrame) -> DataFrame:
    """(dir, alt, digest, size): directories outside a duplicate that hold a safe copy of its content; atomic ones count whole.

    Copies are first lifted to (digest, alt) with the duplicates that they lie under, of which two tell enough: a copy is
    outside of dir unless all of alt's copies lie under dir.  So copies never meet each other, only the result's rows."""
    want = dir_content(files).join(dups.select("dir"), "dir", "left_semi").where("n_real > 0 and n_outside > 0").select("dir", "digest", "size")
    at = _places(files, dups, want).select("digest", "size", F.coalesce(paths.atom("own"), F.col("own")).alias("at"), "lies").distinct()
    lifted = at.select("digest", "size", F.explode(paths.ancestors("at")).alias("alt"), "lies")
    held = lifted.groupBy("digest", "size", "alt").agg(F.min("lies").alias("a"), F.max("lies").alias("z"), F.max(F.col("lies").isNull()).alias("free"))
    return want.join(held, ["digest", "size"]).where("free or a <> dir or z <> dir").select("dir", "alt", "digest", "size")


def score(safe: Column, rest: Column, unique: Column, n_files: Column, n_dirs: Column) -> Column:
    """How well alt keeps what rests of dir, in [0, 1]; sums in a fixed order, so ties are ties."""
    s = safe.cast("double")
    match = (s / rest) * (s / unique)
    away = 1 / paths.dist("dir", paths.common_root("dir", "alt")).cast("double")
    out = F.lit(5.0 / 8) * match + (s / n_files) / 8 + (1 / (1 + n_dirs.cast("double"))) / 8 + away / 8
    return F.when(paths.contains("alt", "dir"), out / 2).otherwise(out)


def scores(cand: DataFrame, stats: DataFrame) -> DataFrame:
    """dir, alt, n_safe, n_rest, score of every candidate for the content left."""
    n = cand.groupBy("dir", "alt").agg(F.count(F.lit(1)).alias("n_safe"))
    rest = cand.select("dir", "digest", "size").distinct().groupBy("dir").agg(F.count(F.lit(1)).alias("n_rest"))
    about = stats.select(F.col("dir").alias("alt"), "unique_files", "total_files", "total_dirs")
    out = n.join(rest, "dir").join(about, "alt")
    return out.select("dir", "alt", "n_safe", "n_rest", score(F.col("n_safe"), F.col("n_rest"), F.col("unique_files"), F.col("total_files"), F.col("total_dirs")).alias("score"))


def best(scored: DataFrame) -> DataFrame:
    """Of each directory's candidates the one of highest score, the least path on ties."""
    first = Window.partitionBy("dir").orderBy(F.col("score").desc(), paths.path_key("alt"))
    return scored.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def alternates(files: DataFrame, dups: DataFrame) -> DataFrame:
    """(dir, alt, round, digest, size): greedy cover of each duplicate's safe content.

    Every round picks one alternate for every directory at once and takes away what
    it covers; a round is a few aggregations, whatever the size of a directory."""
    cand = checkpoint(candidates(files, dups))
    stats = checkpoint(dir_stats(files))
    done, n = None, 0
    while not cand.isEmpty():
        n += 1
        covered = checkpoint(cand.join(best(scores(cand, stats)).select("dir", "alt"), ["dir", "alt"]).select("dir", "alt", F.lit(n).alias("round"), "digest", "size"))
        done = covered if done is None else done.unionByName(covered)
        cand = checkpoint(cand.join(covered, ["dir", "digest", "size"], "left_anti"))
    return done if done is not None else cand.select("dir", "alt", F.lit(0).alias("round"), "digest", "size")


def dups(files: DataFrame, below: str = paths.ROOT, max_dups: int = 0, max_lost: int = MAX_LOST) -> DataFrame:
    """dir, alts, lost, ignored, safe of the maximal duplicate directories, as nested columns."""
    found = checkpoint(maximal(files, below, max_lost, max_dups))
    file = F.struct("path", "digest", "size", "mod_ns", "flag")
    keyed = lambda df, name: df.groupBy("dir").agg(F.transform(F.sort_array(F.collect_list(F.struct(paths.path_key("path").alias("k"), file.alias("f")))), lambda x: x["f"]).alias(name))
    alts = alternates(files, found)
    names = alts.select("dir", "alt").distinct().groupBy("dir").agg(F.transform(F.sort_array(F.collect_list(F.struct(paths.path_key("alt").alias("k"), "alt"))), lambda x: x["alt"]).alias("alts"))
    safe = alts.groupBy("dir").agg(F.map_from_entries(F.collect_list(F.struct("digest", "alt"))).alias("safe"))
    return found.select("dir").join(names, "dir", "left").join(keyed(lost(files, found), "lost"), "dir", "left").join(keyed(ignored(files, found), "ignored"), "dir", "left").join(safe, "dir", "left")


def file_map(files: DataFrame, dups: DataFrame, alts: DataFrame | None = None, alt: str | None = None) -> DataFrame:
    """(dir, path, kept_path): for every existing copy under a duplicate, the first safe copy in its alternate, outside the duplicate.

    alt: only what this alternate keeps; one that no duplicate has gives nothing."""
    chosen = alternates(files, dups) if alts is None else alts
    if alt is not None:
        chosen = chosen.where(F.col("alt") == paths.dir_path(F.lit(alt)))
    # Of each alternate the first copy, and the first that doesn't lie under the same duplicate: one of them is outside of dir.
    place = _places(files, dups, chosen).select("digest", "size", "lies", F.struct(paths.path_key("path").alias("k"), F.col("path").alias("kept")).alias("copy"), F.explode(paths.ancestors("own")).alias("alt"))
    first = place.join(chosen.select("digest", "size", "alt").distinct(), ["digest", "size", "alt"], "left_semi").groupBy("digest", "size", "alt", "lies").agg(F.min("copy").alias("copy"))
    order = Window.partitionBy("digest", "size", "alt").orderBy("copy")
    two = first.withColumn("_n", F.row_number().over(order)).where("_n <= 2").drop("_n")
    outside = chosen.join(two, ["digest", "size", "alt"]).where("lies is null or lies <> dir")
    kept = outside.groupBy("dir", "digest", "size").agg(F.min("copy").getField("kept").alias("kept_path"))
    return _files_under(dups, files).join(kept, ["dir", "digest", "size"]).select("dir", "path", "kept_path")
