"""Proportional stratified interleaving: shards that each match the mixture of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets that ranks are counted in: of a source's rows by their key, and of all rows by their fraction.
SOURCE_BUCKETS, BUCKETS = 1024, 8192


def _key(seed: int, *of: Column) -> Column:
    """A seeded 48-bit number from MD5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *of).cast("binary")), 1, 12), 16, 10).cast("long")


def _before(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """The running count before each bucket; at most as many rows in a window as there are buckets."""
    return counts.withColumn("before", F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))


def interleave(documents: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of documents, and its source.

    Law `rows`: shard sizes differ by one at most. Within a source, rows are shuffled by a seeded hash;
    the row of rank r of n gets the fraction (r + phase) / n with a phase of its source's own, all rows
    are sorted by it, and the order is cut into equal shards, so that any shard holds each source's
    share within one row or so.

    Ranks come from bucket counts and a row_number within (source, bucket): a source with a third of
    all rows is spread over SOURCE_BUCKETS windows, and the overall order over BUCKETS of them. A null
    text is empty, a null source is a source, ties (equal or null doc_ids) are ordered by doc_id,
    size and text_crc32. An empty table gives no rows.
    """
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("\x00")).alias("stratum"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("key", _key(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text_crc32").cast("string")))
    rows = rows.withColumn("part", F.floor(F.col("key") / F.lit(2**48 // SOURCE_BUCKETS)).cast("int"))
    counts = rows.groupBy("stratum", "part").agg(F.count("*").alias("n"))
    counts = _before(counts, ["stratum"], "part").withColumn("total", F.sum("n").over(Window.partitionBy("stratum")))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("stratum", "part").orderBy("key", "doc_id", "size", "text_crc32")) - 1)
    ranked = ranked.join(counts.select("stratum", "part", "before", "total"), ["stratum", "part"])
    phase = _key(seed + 1, F.col("stratum")) / F.lit(float(2**48))
    ranked = ranked.withColumn("fraction", (F.coalesce("before", F.lit(0)) + F.col("r") + phase) / F.col("total"))
    ranked = ranked.withColumn("bucket", F.least(F.floor(F.col("fraction") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    spread = _before(ranked.groupBy("bucket").agg(F.count("*").alias("n")), [], "bucket")
    spread = spread.withColumn("all_rows", F.sum("n").over(Window.partitionBy()))
    placed = ranked.withColumn("g", F.row_number().over(Window.partitionBy("bucket").orderBy("fraction", "stratum", "key", "doc_id", "size", "text_crc32")) - 1)
    placed = placed.join(spread.select("bucket", F.coalesce("before", F.lit(0)).alias("start"), "all_rows"), "bucket")
    placed = placed.withColumn("g", F.col("start") + F.col("g")).withColumn("shard", F.expr(f"cast(g * {shards} div all_rows as int)"))
    first = F.expr(f"(shard * all_rows + {shards - 1}) div {shards}")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("g") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.nullif(F.col("stratum"), F.lit("\x00")).alias("source"))
