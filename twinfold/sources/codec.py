"""The grouped text index: reading, writing and its files.

Two header lines, a signature and the root, then groups of files with equal
content.  A file's line is flag, TAB, path and, after a terminator, its time if it
differs from the file before; a line that begins with two TABs ends the group
with digest and size.
"""

from __future__ import annotations

import os
import stat
import tempfile
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinfold.functions import flags, paths
from twinfold.functions.ship import ship

# Fixed values of the format: second half of the signature, column of the times, width of a tab.
VERSION = "index v1"
SIGNATURE = rf"^[a-z]+ {VERSION}$"
COLUMN, TAB = 104, 8
LONGEST_LINE = 64 * 1024


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) of compressed index files; a file is decoded by one task, as its format demands."""
    ship(spark)
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for name, content in zip(batch.column("file"), batch.column("content")):
                with zstandard.ZstdDecompressor().stream_reader(content.as_py()) as f:
                    rest, pos = b"", 0
                    while block := f.read(1 << 20):
                        *whole, rest = (rest + block).split(b"\n")
                        yield _lines(name.as_py(), pos, whole)
                        pos += len(whole)
                    if rest:
                        yield _lines(name.as_py(), pos, [rest])

    return raw.mapInArrow(run, "file string, pos bigint, line string")


def _lines(name: str, pos: int, whole: list[bytes]) -> pa.RecordBatch:
    text = [x.removesuffix(b"\r").decode() for x in whole]
    return pa.RecordBatch.from_arrays([pa.array([name] * len(text), pa.string()), pa.array(range(pos, pos + len(text)), pa.int64()), pa.array(text, pa.string())], names=["file", "pos", "line"])


def parse(text: DataFrame) -> DataFrame:
    """(file, pos, path, digest, size, mod_ns, flag, error) of lines (file, pos, line); rows with an error have what could be read."""
    by = Window.partitionBy("file").orderBy("pos")
    body = text.where("pos >= 2").withColumn("ends", F.startswith("line", F.lit("\t\t")))
    body = body.withColumn("g", F.coalesce(F.sum(F.col("ends").cast("bigint")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    entry = F.regexp_extract("line", r"^[^\t]*\t(.*?)(?:\t//(.*))?$", 1)
    time = F.ltrim(F.regexp_extract("line", r"^[^\t]*\t(.*?)(?:\t//(.*))?$", 2), F.lit("\t"))
    group = Window.partitionBy("file", "g")
    within = group.orderBy("pos")
    tail = F.split(F.substring("line", 3, LONGEST_LINE), "\t")
    digest, size = F.when(F.col("ends"), tail[0]), F.when(F.col("ends"), F.get(tail, F.lit(1)))
    rows = body.select(
        "file", "pos", "ends", "g", "line",
        F.when(~F.col("ends"), entry).alias("path"),
        F.when(~F.col("ends"), flags.parse_flag(F.substring_index("line", "\t", 1))).alias("flag"),
        F.when(~F.col("ends") & (time != ""), time).alias("time"),
        F.when(digest.rlike("^[0-9a-fA-F]{64}$"), F.lower(digest)).alias("d"),
        F.expr("try_cast(" + "if(ends, get(split(substring(line, 3), '\t'), 1), null) as bigint)").alias("s"),
    )
    rows = rows.withColumn("own_ns", mod_ns("time"))
    filled = rows.select(
        "*",
        F.last("own_ns", True).over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("mod_ns"),
        F.max("d").over(group).alias("digest"),
        F.max("s").over(group).alias("size"),
        F.max("ends").over(group).alias("closed"),
        F.min(F.when(~F.col("ends"), F.col("pos"))).over(group).alias("first"),
    )
    error = (
        F.when(F.col("ends") & F.col("first").isNull(), "missing group")
        .when(F.col("ends") & F.col("d").isNull(), "invalid digest")
        .when(F.col("ends") & (F.col("s").isNull() | (F.col("s") < 0)), "invalid size")
        .when(F.col("ends"), None)
        .when(~F.col("line").contains("\t") | paths.strict_file_path("path").isNull(), "invalid entry")
        .when(F.col("flag").isNull(), "invalid flag")
        .when(F.col("time").isNotNull() & F.col("own_ns").isNull(), "invalid mtime")
        .when(F.col("mod_ns").isNull(), "missing mtime")
        .when(~F.col("closed"), "incomplete group")
    )
    out = filled.withColumn("error", error).where(~F.col("ends") | F.col("error").isNotNull())
    return out.select("file", "pos", "path", "digest", "size", "mod_ns", F.col("flag").cast("int").alias("flag"), F.when(F.col("error").isNotNull(), F.concat(F.lit("line "), (F.col("pos") + 1).cast("string"), F.lit(": "), "error")).alias("error"))


def headers(text: DataFrame) -> DataFrame:
    """(file, signature, root, error) of each file's first two lines."""
    head = text.where("pos < 2").groupBy("file").agg(F.max(F.when(F.col("pos") == 0, F.col("line"))).alias("signature"), F.max(F.when(F.col("pos") == 1, F.col("line"))).alias("root"))
    error = (
        F.when(F.col("signature").isNull(), "missing signature").when(~F.col("signature").rlike(SIGNATURE), "invalid signature")
        .when(F.col("root").isNull(), "missing root").when(F.col("root").contains("\t"), "invalid root")
    )
    return head.withColumn("error", error)


def read_index(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """Root and files of one index; raises ValueError at the first error."""
    text = lines(spark, path)
    head = headers(text).first()
    if head is None or head.error:
        raise ValueError(head.error if head else "missing signature")
    rows = parse(text)
    bad = rows.where("error is not null").orderBy("pos").first()
    if bad is not None:
        raise ValueError(bad.error)
    return head.root, rows.select("path", "digest", "size", "mod_ns", "flag")


def mod_ns(time: Column | str) -> Column:
    """Nanoseconds since 1970 of an RFC 3339 time, or null."""
    t = F.col(time) if isinstance(time, str) else time
    pattern = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?(Z|[+-]\d{2}:\d{2})$"
    whole = F.concat(F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 3))
    seconds = F.unix_seconds(F.try_to_timestamp(whole, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    part = F.rpad(F.coalesce(F.regexp_extract(t, pattern, 2), F.lit("")), 9, "0").cast("bigint")
    return F.when(t.rlike(pattern), seconds * 1_000_000_000 + part)


def rfc3339(ns: Column | str) -> Column:
    """The time in UTC, with as many decimals as it needs."""
    ns = F.col(ns) if isinstance(ns, str) else ns
    seconds = F.floor(ns / F.lit(1_000_000_000).cast("decimal(20,0)")).cast("bigint")
    part = F.rtrim(F.lpad((ns - seconds * 1_000_000_000).cast("string"), 9, "0"), F.lit("0"))
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.when(part != "", F.concat(F.lit("."), part)).otherwise(""), F.lit("Z"))


def width(text: str) -> int:
    """Columns that a monospace terminal takes, tabs to the next stop."""
    n = 0
    for c in text:
        if c == "\t":
            n = n // TAB * TAB + TAB
        elif unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Cf", "Cc"):
            continue
        else:
            n += 2 if unicodedata.east_asian_width(c) in "WF" else 1
    return n


def entries(files: DataFrame) -> DataFrame:
    """(gkey, digest, size, key, path, flag, mod_ns, shows_time) of the rows an index keeps, with whether a line needs its time."""
    kept = files.where(flags.is_stored()).withColumn("key", paths.path_key("path"))
    kept = kept.withColumn("gkey", F.min("key").over(Window.partitionBy("digest", "size")))
    order = Window.partitionBy("digest", "size").orderBy("key", flags.is_gone(), "mod_ns", flags.decision())
    before = F.lag("mod_ns").over(order)
    return kept.select("gkey", "digest", "size", "key", "path", "mod_ns", flags.flag_text().alias("flag"), F.row_number().over(order).alias("n"), (before.isNull() | (before != F.col("mod_ns"))).alias("shows_time"))


def index_lines(files: DataFrame) -> DataFrame:
    """(gkey, n, line): the body of an index; sort by gkey and n for its order."""
    ship(files.sparkSession)
    e = entries(files)
    time = rfc3339("mod_ns")
    blank_end = F.col("path").rlike(r"\s$")
    e = e.withColumn("used", TAB + F.floor(shown_width(F.col("path")) / TAB) * TAB + 2 * TAB)
    # Times of a group stand in one column, after its widest path.
    align = F.greatest(F.lit(COLUMN), F.max("used").over(Window.partitionBy("digest", "size")))
    e = e.withColumn("pad", ((align - F.col("used")) / TAB).cast("int") + 1)
    line = F.concat("flag", F.lit("\t"), "path", F.when(F.col("shows_time"), F.concat(F.lit("\t//"), F.repeat(F.lit("\t"), F.col("pad")), time)).when(blank_end, F.lit("\t//")).otherwise(""))
    ends = e.groupBy("gkey", "digest", "size").agg((F.max("n") + 1).alias("n")).select("gkey", "n", F.concat(F.lit("\t\t"), "digest", F.lit("\t"), F.col("size").cast("string")).alias("line"))
    return e.select("gkey", "n", line.alias("line")).unionByName(ends)


def numbered(body: DataFrame) -> DataFrame:
    """(file, pos, line) of an index body cut into as many files as digests have first letters, for readers side by side."""
    group = Window.partitionBy("gkey").orderBy("n")
    named = body.withColumn("file", F.last(F.substring(F.element_at(F.split("line", "\t"), -2), 1, 1)).over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return named.withColumn("pos", (F.row_number().over(Window.partitionBy("file").orderBy("gkey", "n")) + 1).cast("bigint")).select("file", "pos", "line")


def shown_width(path: Column) -> Column:
    """Display width: bytes for plain ASCII without tabs, else by a batched Python function."""

    @F.pandas_udf("int")
    def wide(s: pd.Series) -> pd.Series:
        return s.map(width)

    return F.when(path.rlike(r"^[\x20-\x7e]*$"), F.length(path)).otherwise(wide(path))


def write_index(files: DataFrame, path: str, root: str = "", signature: str = f"files {VERSION}", backup: bool = True) -> None:
    """Save an index file: written beside it under another name, then renamed; an old one becomes ``.bak``.

    The text of one index file is one stream, so it is written by the driver as rows arrive."""
    import zstandard

    if "\t" in root or "\n" in root:
        raise ValueError("invalid root")
    ship(files.sparkSession)
    ordered = index_lines(files).orderBy("gkey", "n").select("line")
    target = Path(path)
    if backup and target.exists() and not stat.S_ISREG(os.lstat(target).st_mode):
        raise ValueError(f"{path} is not a regular file")
    handle, name = tempfile.mkstemp(prefix=f".{target.name}.", dir=target.parent)
    try:
        with os.fdopen(handle, "wb") as raw, zstandard.ZstdCompressor().stream_writer(raw, closefd=False) as f:
            f.write(f"{signature}\n{root}\n".encode())
            for row in ordered.toLocalIterator():
                f.write(f"{row.line}\n".encode())
        if backup and target.exists():
            os.replace(target, f"{path}.bak")
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def overwrite_index(files: DataFrame, path: str, root: str = "", signature: str = f"files {VERSION}") -> None:
    write_index(files, path, root, signature, backup=False)


def cat(spark: SparkSession, path: str) -> DataFrame:
    """The lines of an index file in order."""
    return lines(spark, path).orderBy("pos").select("line")
