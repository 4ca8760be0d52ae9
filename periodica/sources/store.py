"""Feature and parameter tables: appends by name, conditional updates, resumable dates."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def clean_name(text: str) -> str:
    """A name that is safe in a path."""
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", text).strip("_") or "_"


def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def upsert(history: DataFrame, new: DataFrame, update: str | None = None, value=None, where: str | None = None) -> DataFrame:
    """Rows of both by column name; then `update` becomes `value` where the condition holds."""
    rows = union_by_name(history, new)
    if update is None:
        return rows
    return rows.withColumn(update, F.when(F.expr(where) if where else F.lit(True), F.lit(value)).otherwise(F.col(update)))


def save(spark: SparkSession, rows: DataFrame, folder: str, name: str, version: str) -> str:
    """Write a version of a table; a path that is being read is never overwritten."""
    path = f"{folder.rstrip('/')}/{clean_name(name)}/{clean_name(version)}"
    rows.write.mode("errorifexists").parquet(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df computed once, without its lineage: a reliable checkpoint in the folder that spark.checkpoint.dir names, or that was set on the context.

    Only a local session gets a temporary folder where neither is set.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="periodica-checkpoint-"))
    return df.checkpoint()


def append_dates(rows: DataFrame, path: str) -> None:
    """Append features, partitioned by as_of."""
    rows.write.mode("append").partitionBy("as_of").parquet(path)


def to_do(dates: DataFrame, done: DataFrame) -> DataFrame:
    """Dates without features yet."""
    return dates.join(done.select("as_of").distinct(), "as_of", "left_anti")


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first by `order`, sorted by key."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("r = 1").drop("r").orderBy(key)


def digest(rows: DataFrame) -> DataFrame:
    """Number of rows and an order-free checksum of all columns."""
    return rows.select(F.xxhash64(*sorted(rows.columns)).cast("decimal(20,0)").alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("checksum"))
