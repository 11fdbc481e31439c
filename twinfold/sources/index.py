"""Saved indexes: creating, updating and marking one.

Each call reads or scans, saves the whole index and returns the errors of single files
as (path, error); such files are left out of the index, or kept as they were decided.
An index that can't be read, or a root that isn't there, raises and nothing is saved.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from twinfold.functions.storage import checkpoint
from twinfold.operators import mark, rescan
from twinfold.plans.model import COLUMNS
from twinfold.sources import codec, walk


def _folder(root: str) -> str:
    root = os.path.normpath(root)
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    return root


def create(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Scan root into a new index; an old one becomes its backup."""
    root = _folder(root)
    # Both results of one scan, so a file that is left out has its error.
    found = checkpoint(walk.walk(spark, root, digest=True))
    files, errors = walk.split(found)
    codec.write_index(files, path, root)
    return errors


def update(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """Scan an index's root, or another that takes its place, again; decisions stay."""
    saved, old = codec.read_index(spark, path)
    root = _folder(root or saved)
    merged, errors = rescan.rescan_checked(checkpoint(old), checkpoint(walk.walk(spark, root)), walk.rehash(root))
    codec.write_index(merged, path, root)
    return errors


def _marked(spark: SparkSession, path: str, names: list[str], how) -> None:  # noqa: ANN001
    root, files = codec.read_index(spark, path)
    codec.write_index(how(checkpoint(files.select(*COLUMNS)), names), path, root)


def keep(spark: SparkSession, path: str, names: list[str]) -> None:
    """Protect the named files and directories of an index; a name that matches nothing raises."""
    _marked(spark, path, names, mark.mark_keep)


def dup(spark: SparkSession, path: str, names: list[str]) -> None:
    _marked(spark, path, names, mark.mark_dup)


def junk(spark: SparkSession, path: str, names: list[str]) -> None:
    _marked(spark, path, names, mark.mark_junk)
