"""Proportional stratified interleaving into shards, with DataFrame operations only.

Rows are shuffled by a seeded hash and ranked within their stratum; sorted by
fractional rank (rank + 1/2) / stratum size, every stretch of the order holds the
strata in the mixture's proportions.  The order is cut into runs whose lengths
differ by one row at most (law ``rows``), so a stratum's share of any shard
differs from its share of the corpus by a few rows.

Ranks come from two range sorts.  A row's place is the number of rows in earlier
partitions plus its place in its own, so no stratum, however large, is gathered
in one task; what is summed over partitions has a row for each partition.

Edge cases: null strata form a stratum of their own; a null text has size 1 and
the checksum of no bytes; repeated rows each get a slot of their own; with fewer
rows than shards some shards are empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinfold.functions.storage import checkpoint

SHARDS = 16
SEED = 7


def placed(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """df with each row's place, from 0, in the order of the keys; checkpointed, so the order is settled."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = checkpoint(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    # One row for each partition.
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ordered.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def stratified(df: DataFrame, stratum: str = "source", key: str = "doc_id", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """df's key and stratum columns with rank, place, shard and slot."""
    rows = df.withColumn("_s", F.col(stratum).cast("string")).withColumn("_h", F.xxhash64(F.lit(seed), F.col(key).cast("string"), *[c for c in df.columns if c not in (key, stratum)]))
    by = placed(rows, [F.col("_s").asc_nulls_first(), F.col("_h"), F.col(key)], "_g")
    sizes = by.groupBy("_s").agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("_size"))
    ranked = by.join(sizes, by["_s"].eqNullSafe(sizes["_s"])).drop(sizes["_s"]).withColumn("rank", F.col("_g") - F.col("_first"))
    ranked = ranked.withColumn("_f", (F.col("rank") + F.lit(0.5)) / F.col("_size")).drop("_first", "_g")
    order = placed(ranked, [F.col("_f"), F.xxhash64("_s", F.lit(seed)), F.col("_s").asc_nulls_first(), F.col("_h"), F.col(key)], "place")
    # The number of rows is a single value.
    total = order.agg(F.count(F.lit(1)).alias("n")).first().n
    cut = order.withColumn("shard", F.expr(f"place * {shards} div {max(1, total)}").cast("int"))
    return cut.withColumn("slot", F.expr(f"place - (shard * bigint({total}) + {shards - 1}) div {shards}")).drop("_s", "_h", "_f", "_size")


def write_shards(df: DataFrame, path: str, **options) -> None:
    """All columns of df as Parquet, one folder a shard, rows in the order of their slots; ids must be unique."""
    key = options.get("key", "doc_id")
    where = stratified(df.select(key, options.get("stratum", "source")), **options).select(key, "shard", "slot")
    df.join(where, key).repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return stratified(sized).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
