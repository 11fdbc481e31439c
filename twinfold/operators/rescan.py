"""Merging a new listing with decisions made on an earlier state.

An existing row whose path, size and modification time are listed again keeps its
digest and decision; other listed files are hashed; rows that vanished are kept
as gone if they carry a decision.  Hashing comes after the anti join, so only
stale files are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.functions import flags
from twinfold.functions.storage import checkpoint
from twinfold.plans.model import COLUMNS

KEYS = ["path", "size", "mod_ns"]


def _stored(old: DataFrame) -> DataFrame:
    return old.withColumn("flag", F.col("flag").bitwiseAND(F.lit(flags.STORED)))


def same(old: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows that are listed unchanged, flagged so."""
    known = _stored(old).where(~flags.is_gone()).join(listing.select(*KEYS).distinct(), KEYS, "left_semi")
    return known.select("path", "digest", "size", "mod_ns", F.col("flag").bitwiseOR(F.lit(flags.SAME)).alias("flag"))


def stale(old: DataFrame, listing: DataFrame) -> DataFrame:
    """Listed files that must be hashed."""
    return listing.join(_stored(old).where(~flags.is_gone()).select(*KEYS), KEYS, "left_anti")


def gone(old: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows no longer there that carry a decision; rows already gone are never matched, even if they equal a listed file."""
    before = _stored(old)
    vanished = before.where(~flags.is_gone()).join(listing.select(*KEYS), KEYS, "left_anti")
    rows = vanished.unionByName(before.where(flags.is_gone()))
    return rows.withColumn("flag", F.col("flag").bitwiseOR(F.lit(flags.GONE))).where(flags.decision() != flags.NONE).select(*COLUMNS)


def _merged(old: DataFrame, listing: DataFrame, fresh: DataFrame) -> DataFrame:
    new = fresh.select("path", "digest", "size", "mod_ns", F.lit(flags.NONE).alias("flag"))
    return same(old, listing).unionByName(new).unionByName(gone(old, listing))


def rescan(old: DataFrame, listing: DataFrame, digest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The merged state. digest adds a digest column to the files it gets; without one the listing has it.

    Files without a digest are left out; rescan_checked tells why."""
    return rescan_checked(old, listing, digest)[0]


def rescan_checked(old: DataFrame, listing: DataFrame, digest: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(merged state, errors): errors are (path, error) of files that could not be hashed, and of a listing's own errors.

    An old row of such a file is no longer there: with a decision it is kept as gone, and its file comes back undecided."""
    broken = listing.limit(0).select("path", F.lit("").alias("error"))
    if "error" in listing.columns:
        broken = listing.where("error is not null").select("path", "error")
        listing = listing.where("error is null")
    fresh = stale(old, listing)
    if digest is None:
        return _merged(old, listing, fresh), broken
    # Read once: both results come from it, and a file may change in between.
    fresh = checkpoint(digest(fresh.select(*KEYS)))
    if "error" in fresh.columns:
        broken = broken.unionByName(fresh.where("digest is null").select("path", "error"))
    return _merged(old, listing, fresh.where("digest is not null")), broken
