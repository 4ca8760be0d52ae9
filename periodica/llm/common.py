"""What the operators of this package share: lineage cuts, row keys, Arrow batches, connected components."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java's and DuckDB's form of one word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A translation of bytes that lower-cases A-Z and nothing else.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Rows and bytes of one Arrow batch, so that a worker's memory does not follow the table.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small: texts may be long, and a batch is held whole by the JVM and by Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a checkpoint folder set on the context.

    Only a local session (one machine, as in tests) gets a temporary folder where neither is set.
    """
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="periodica-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/periodica-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it: a lineage cut that is compressed on disk."""
    return _written(df)[0]


class Scratch:
    """Tables that one operator writes on its way: deleted when it ends, but for what its result reads.

        with Scratch(spark) as s:
            a = s.table(...)
            return s.result(...)  # written before the others go
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for path in self.paths:
            at = hadoop(path)
            at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    def table(self, df: DataFrame) -> DataFrame:
        out, path = _written(df)
        self.paths.append(path)
        return out

    def result(self, df: DataFrame) -> DataFrame:
        return table(df)


def texts(documents: DataFrame, *columns: Column) -> DataFrame:
    """doc_id and text of a table, a null text as the empty one, without any further columns."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *columns)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and its n + 1 offsets, without a copy."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def trim() -> None:
    """Python workers are reused by later stages: give memory that an earlier one freed back to the machine."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def let_go() -> None:
    """Drop the token encoder, with its caches, that an earlier stage left in this worker."""
    coder = getattr(sys.modules.get("periodica.llm.byte_bpe"), "_coder", None)
    if coder is not None and coder.cache_info().currsize:
        coder.cache_clear()
        gc.collect()
        trim()


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about `limit` bytes of `column`, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = raw(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of each node in `links` (a, b).

    Alternating large-star and small-star rounds until nothing changes: every step is a group-by with a partial
    aggregate and a join, so that a hub's neighbours are never gathered in one row or task.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    state = None
    while True:
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = cut(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


#: Stands for a null doc_id where rows are ordered by it: smaller than any other.
NO_ID = -(2**63)


def keyed(documents: DataFrame) -> tuple[DataFrame, str]:
    """documents with one more column, a unique long key of each row, and that column's name.

    The key is the doc_id itself (NO_ID for a null) where that is unique; only ids are shuffled to see that. Else rows
    are numbered in the order of doc_id, null first, and rows of one id by their texts; the numbered table is written,
    so that a key never changes. A hot id is spread over tasks by its texts' hashes.
    """
    name = "row_key"
    while name in documents.columns:
        name += "_"
    ids = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"))
    if ids.groupBy("k").count().where("count > 1").isEmpty():
        return documents.withColumn(name, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))), name
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = [F.col("doc_id").cast("long").asc_nulls_first(), F.xxhash64(text), text]
    dealt = documents.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return table(dealt.withColumn(name, F.monotonically_increasing_id())), name


def one_row_each(documents: DataFrame) -> DataFrame:
    """doc_id (the unique key of `keyed`), own_id (the row's doc_id) and text, a null text as the empty one, of every row."""
    rows, key = keyed(documents)
    return rows.select(F.col(key).alias("doc_id"), F.col("doc_id").cast("long").alias("own_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def without_rows(documents: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of documents, columns as they are, but for those whose key is a doc_id of find(doc_id: key, own_id, text).

    Rows that a bitmap of the keys rules out stay where they are; only the others are shuffled with their texts.
    """
    rows, key = keyed(documents)
    gone = find(rows.select(F.col(key).alias("doc_id"), F.col("doc_id").cast("long").alias("own_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    gone = table(gone.select(F.col("doc_id").alias("key")).distinct())
    marked = maybe(rows.select(F.col(key).alias("key"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")), "key", gone)
    left = marked.where("NOT maybe").union(marked.where("maybe").join(gone, "key", "left_anti").select(*marked.columns))
    return left.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])


#: Bits of a sketch for each value in it, and the bounds of its size: the largest has 2**18 rows of 64 bits.
SKETCH_SHARE, SKETCH_LEAST, SKETCH_MOST = 8, 14, 24


def maybe(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """df with a boolean column `maybe`: false only for values of `column` that `values`, a written table, doesn't hold.

    A bitmap sized by the number of values is broadcast, so that rows which cannot match need not be shuffled. For
    more values than the largest bitmap can tell apart all rows are marked, and the caller's join shuffles them.
    """
    bits = max(SKETCH_LEAST, (SKETCH_SHARE * max(1, values.count()) - 1).bit_length())
    if bits > SKETCH_MOST:
        return df.withColumn("maybe", F.lit(True))
    word = F.shiftrightunsigned(F.xxhash64(F.col(column)), 64 - bits + 6)
    bit = F.expr(f"shiftleft(1L, cast(xxhash64({column}) & 63 as int))")
    bitmap = values.select(word.alias("sketch_word"), bit.alias("bit")).groupBy("sketch_word").agg(F.bit_or("bit").alias("sketch_bits"))
    found = df.withColumn("sketch_word", word).join(F.broadcast(bitmap), "sketch_word", "left")
    return found.withColumn("maybe", F.coalesce(F.col("sketch_bits").bitwiseAND(bit), F.lit(0)) != 0).drop("sketch_word", "sketch_bits")
