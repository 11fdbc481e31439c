"""Content digests of files, and comparing them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions import paths
from twinfold.functions.ship import ship


def sha256(content: Column | str, name: Column | str | None = None) -> Column:
    """Hex digest in the JVM; of the name, if given, where the content is empty."""
    content = F.col(content) if isinstance(content, str) else content
    if name is None:
        return F.sha2(content, 256)
    return F.sha2(F.when(F.octet_length(content) == 0, F.encode(name, "UTF-8")).otherwise(content), 256)


def with_blake3(df: DataFrame, content: str = "content", name: str | None = "path", out: str = "digest") -> DataFrame:
    """df with the BLAKE3-256 of content as lowercase hex; of the name, if given, where the content is empty."""
    ship(df.sparkSession)
    schema = df.schema.add(out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from twinfold.functions.blake3 import blake3_many

        for batch in batches:
            names = batch.column(name).to_pylist() if name else [None] * batch.num_rows
            contents = [c if c is None else c or (n or "").encode() for c, n in zip(batch.column(content).to_pylist(), names)]
            found = iter(blake3_many([c for c in contents if c is not None]))
            digests = [None if c is None else next(found).hex() for c in contents]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def hash_files(spark: SparkSession, names: list[str]) -> DataFrame:
    """(pos, path, digest, error, line) of the named files in the order given; digests print as uppercase hex, two spaces, name."""
    asked = spark.createDataFrame(list(enumerate(names)), "pos int, name string").withColumn("path", F.when(F.startswith("name", F.lit("/")), F.concat(F.lit("/"), paths.clean_path(F.ltrim("name", F.lit("/"))))).otherwise(paths.clean_path("name")))
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from twinfold.sources.walk import digests_of

        for batch in batches:
            found = list(digests_of((p, "", None, None) for p in batch.column("path").to_pylist()))
            digests, errors = [d for d, _ in found], [e for _, e in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, "digest", "error"])

    read = asked.mapInArrow(run, "pos int, name string, path string, digest string, error string")
    return read.withColumn("line", F.concat(F.upper("digest"), F.lit("  "), F.col("path"))).orderBy("pos")


def compare(digests: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, n_distinct, identical: whether two files or more all have one digest, overall or by group; a digest missing makes it null."""
    agg = digests.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("digest").alias("n_distinct"), F.count(F.when(F.col("digest").isNull(), 1)).alias("_bad"))
    return agg.withColumn("identical", F.when((F.col("_bad") == 0) & (F.col("n") >= 2), F.col("n_distinct") == 1)).drop("_bad")
