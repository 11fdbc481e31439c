"""Directory statistics and lookups over a table of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.functions import flags, paths
from twinfold.plans.model import COLUMNS, live


def group_by_digest(files: DataFrame) -> DataFrame:
    """(digest, size, n, first): groups of equal content with the first path in path order."""
    return files.groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(paths.path_key("path").alias("k"), F.col("path"))).getField("path").alias("first"))


def groups(files: DataFrame) -> DataFrame:
    """The same with the group's files as an array in file order."""
    key = F.struct(paths.path_key("path").alias("k"), flags.is_gone().alias("g"), F.col("mod_ns"), flags.decision().alias("d"), F.col("path"), F.col("flag"))
    grouped = files.groupBy("digest", "size").agg(F.sort_array(F.collect_list(key)).alias("files"))
    return grouped.select("digest", "size", F.expr("transform(files, f -> named_struct('path', f.path, 'mod_ns', f.mod_ns, 'flag', f.flag))").alias("files"), F.expr("files[0].k").alias("first_key"))


def files_sorted(files: DataFrame) -> DataFrame:
    """All files in path order; at one path existing before gone, then by time, decision and size."""
    return files.orderBy(paths.path_key("path"), flags.is_gone(), "mod_ns", flags.decision(), "size").select(*COLUMNS)


def dir_digests(files: DataFrame) -> DataFrame:
    """(dir, digest, size) with n_files: content of each subtree; files are summed in their own directory before they are exploded."""
    own = live(files).groupBy(paths.parent("path").alias("own"), "digest", "size").agg(F.count(F.lit(1)).alias("n"))
    return own.select(F.explode(paths.ancestors("own")).alias("dir"), "digest", "size", "n").groupBy("dir", "digest", "size").agg(F.sum("n").alias("n_files"))


def dir_stats(files: DataFrame) -> DataFrame:
    """dir, parent, base, atom, total_dirs, total_files, unique_files of every directory of existing files."""
    content = dir_digests(files).groupBy("dir").agg(F.sum("n_files").alias("total_files"), F.count(F.lit(1)).alias("unique_files"))
    below = content.select(F.explode(paths.proper_ancestors("dir")).alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("total_dirs"))
    out = content.join(below, "dir", "left")
    up = F.when(F.col("dir") != paths.ROOT, paths.parent("dir"))
    name = F.when(F.col("dir") != paths.ROOT, paths.base("dir"))
    return out.select("dir", up.alias("parent"), name.alias("base"), paths.atom("dir").alias("atom"), F.coalesce("total_dirs", F.lit(0)).cast("bigint").alias("total_dirs"), "total_files", "unique_files")


def unique_dirs(files: DataFrame) -> DataFrame:
    """Every directory that holds an existing file, once."""
    return live(files).select(paths.parent("path").alias("own")).distinct().select(F.explode(paths.ancestors("own")).alias("dir")).distinct()


def find_file(files: DataFrame, path: str) -> DataFrame:
    return live(files).where(F.col("path") == path)


def find_dir(files: DataFrame, path: str) -> DataFrame:
    return dir_stats(live(files).where(paths.contains(F.lit(path), "path"))).where(F.col("dir") == path)


def to_index(files: DataFrame) -> DataFrame:
    """Tree to index: run-time flags dropped, rows in file order."""
    return files_sorted(files.withColumn("flag", F.col("flag").bitwiseAND(F.lit(flags.STORED))))
