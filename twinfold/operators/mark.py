"""Recording decisions for files and subtrees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.functions import flags, paths


def targets(names: list[str]) -> Column:
    """Whether a row lies in one of the named directories or is one of the named files."""
    hit = [paths.contains(paths.dir_path(F.lit(n)), "path") | F.coalesce(F.col("path") == paths.file_path(F.lit(n)), F.lit(False)) for n in names]
    return reduce(Column.__or__, hit, F.lit(False))


def mark(files: DataFrame, names: list[str], decision: int, check: bool = True) -> DataFrame:
    """files with the decision on existing rows under names that have none yet; a name that matches nothing is an error."""
    if check:
        live = files.where(~flags.is_gone())
        found = live.agg(*[F.coalesce(F.max(targets([n])), F.lit(False)).alias(str(i)) for i, n in enumerate(names)]).first() if names else ()
        missing = [n for n, ok in zip(names, found) if not ok]
        if missing:
            raise FileNotFoundError(", ".join(missing))
    free = targets(names) & ~flags.is_gone() & (flags.decision() == flags.NONE)
    return files.withColumn("flag", F.when(free, F.col("flag").bitwiseOR(F.lit(decision))).otherwise(F.col("flag")))


def mark_dup(files: DataFrame, names: list[str], check: bool = True) -> DataFrame:
    return mark(files, names, flags.DUP, check)


def mark_junk(files: DataFrame, names: list[str], check: bool = True) -> DataFrame:
    return mark(files, names, flags.JUNK, check)


def mark_keep(files: DataFrame, names: list[str], check: bool = True) -> DataFrame:
    return mark(files, names, flags.KEEP, check)
