"""Exact dedup by composable polynomial fingerprints and a chunkwise comparison of what they match."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, maybe, raw, table, texts, without_rows

#: Two primes under 2**31: a chunk's sum of byte times power stays under 2**52, so float64 dot products are exact.
MODULI = (2147483647, 2147483629)
BASES = (1103515245, 1597334677)
CHUNK = 4096
#: Bytes compared at a time, and bytes of a chunk of a text that is longer.
COMPARED, HUGE = 1 << 16, 8 << 20
SCHEMA = "doc_id long, text_sha256 string, n_bytes long, h1 long, h2 long"


class Fingerprint:
    """Polynomial hashes of byte strings that compose: of(a + b) == join(of(a), of(b)).

    A fingerprint is (bytes, hash, hash); the hash of b0..bn-1 is the sum of (bi + 1) * base**(n-1-i).
    """

    def __init__(self, moduli: tuple[int, int] = MODULI):
        self.moduli = moduli
        powers = [[1] * CHUNK for _ in moduli]
        for row, p, base in zip(powers, moduli, BASES, strict=True):
            for i in range(CHUNK - 2, -1, -1):
                row[i] = row[i + 1] * base % p
        self.powers = np.array(powers, dtype=np.float64).T.copy()

    def join(self, a: tuple, b: tuple) -> tuple:
        """The fingerprint of two neighbouring parts: the left hash is shifted by the right part's length."""
        return (a[0] + b[0], *((x * pow(base, b[0], p) + y) % p for x, y, p, base in zip(a[1:], b[1:], self.moduli, BASES, strict=True)))

    def of(self, data: np.ndarray) -> tuple:
        """Full chunks are hashed side by side in one matrix product, then joined in order."""
        full = len(data) // CHUNK
        out = (0, 0, 0)
        if full:
            sums = (data[: full * CHUNK].reshape(full, CHUNK).astype(np.float64) + 1) @ self.powers
            for row in sums.astype(np.int64).tolist():
                out = self.join(out, (CHUNK, *(x % p for x, p in zip(row, self.moduli, strict=True))))
        if rest := len(data) - full * CHUNK:
            row = ((data[full * CHUNK :].astype(np.float64) + 1) @ self.powers[CHUNK - rest :]).astype(np.int64).tolist()
            out = self.join(out, (rest, *(x % p for x, p in zip(row, self.moduli, strict=True))))
        return out


def _small(documents: DataFrame, moduli: tuple[int, int]) -> DataFrame:
    """Fingerprints of texts of up to HUGE bytes: one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Fingerprint(moduli)
        for batch in batches:
            data, at = raw(batch.column("text"))
            found = [hashed.of(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            columns = [pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else ([], [], []))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_sha256"), *columns], ["doc_id", "text_sha256", "n_bytes", "h1", "h2"])

    return documents.where(F.octet_length("text") <= HUGE).mapInArrow(run, SCHEMA)


def _huge(documents: DataFrame, moduli: tuple[int, int]) -> DataFrame:
    """Fingerprints of longer texts: their chunks are hashed in parallel, and joined in order by length-shifted arithmetic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Fingerprint(moduli)
        for batch in batches:
            data, at = raw(batch.column("part"))
            found = [hashed.of(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            columns = [pa.array(x, pa.int64()) for x in (zip(*found, strict=True) if found else ([], [], []))]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in ("doc_id", "text_sha256", "row", "chunk")] + columns, ["doc_id", "text_sha256", "row", "chunk", "n", "h1", "h2"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Fingerprint(moduli)
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                whole = (0, 0, 0)
                for part in parts:
                    whole = hashed.join(whole, (part["n"], part["h1"], part["h2"]))
                out.append(whole)
            columns = [pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([], [], []))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_sha256"), *columns], ["doc_id", "text_sha256", "n_bytes", "h1", "h2"])

    rows = documents.where(F.octet_length("text") > HUGE).withColumn("row", F.monotonically_increasing_id())
    parts = rows.select("doc_id", "text_sha256", "row", F.explode(_parts(F.col("text").cast("binary"), HUGE)).alias("p")).select("doc_id", "text_sha256", "row", "p.chunk", "p.part")
    each = parts.repartition("row", "chunk").mapInArrow(run, "doc_id long, text_sha256 string, row long, chunk int, n long, h1 long, h2 long")
    together = each.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_sha256").alias("text_sha256"), F.array_sort(F.collect_list(F.struct("chunk", "n", "h1", "h2"))).alias("parts"))
    return together.select("doc_id", "text_sha256", "parts").mapInArrow(join, SCHEMA)


def _parts(data: Column, size: int) -> Column:
    """(chunk, part) of binary data, `size` bytes each, one at least; cut in one array, so that rows don't carry the whole."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length(data) - 1) / size).cast("int"))), lambda i: F.struct(i.alias("chunk"), F.substring(data, i * size + 1, F.lit(size)).alias("part")))


def fingerprints(documents: DataFrame, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """doc_id, text_sha256 and the fingerprint (n_bytes, h1, h2) of every whole text."""
    bounded(documents.sparkSession)
    rows = texts(documents, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_sha256"))
    return _small(rows, moduli).union(_huge(rows, moduli))


def exact_dedup(documents: DataFrame, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of documents.

    Texts are equal if their bytes are; null counts as the empty text, and empty texts are equal to
    each other. The largest doc_id of a group stays. Rows that repeat a doc_id with the same text are
    members of the group each and are kept together; a null doc_id is smaller than any other and its
    row is kept only if its whole group has none. Very long texts are hashed and compared in chunks, side by side. Only doc_id
    and text are read, so other columns may have any names. An empty table gives no rows.

    Groups with equal fingerprints are compared chunk by chunk: per group and chunk number the least
    and the greatest chunk must agree, an aggregate that shrinks a huge group on the map side. A group
    whose chunks differ (a collision) is split by its texts themselves. Groups are written before they are joined, so that
    a hot group's rows come in an exchange of their own, which adaptive execution can split.
    """
    key = ["n_bytes", "h1", "h2"]
    rows = table(fingerprints(documents, moduli))
    groups = table(rows.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    shared = table(rows.join(groups.where("group_size > 1").select(*key), key, "left_semi").select("doc_id", *key).distinct())
    some = maybe(texts(documents), "doc_id", shared).where("maybe").drop("maybe")  # texts of other groups don't move
    members = some.join(shared.withColumnRenamed("doc_id", "member"), F.col("doc_id").eqNullSafe(F.col("member")) & (F.octet_length("text") == F.col("n_bytes")))
    chunks = members.select(*key, F.explode(_parts(F.col("text").cast("binary"), COMPARED)).alias("p")).select(*key, "p.*")
    split = cut(chunks.groupBy(*key, "chunk").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select(*key).distinct())
    out = rows.join(groups, key)
    if not split.isEmpty():
        doubtful = rows.join(split, key, "left_semi").select(F.col("doc_id").alias("member"), "text_sha256", *key).distinct()
        again = texts(documents).join(doubtful, F.col("doc_id").eqNullSafe(F.col("member")) & (F.sha2("text", 256) == F.col("text_sha256")))
        apart = again.groupBy(*key, "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        redone = again.join(apart, [*key, "text"])
        names = ["doc_id", "keep_id", "group_size", "text_sha256"]
        out = out.join(split, key, "left_anti").select(*names).union(redone.select(*names))
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")


def keep_exact(documents: DataFrame) -> DataFrame:
    """The rows of documents, columns as they are, without all but one of each group of equal texts: its largest doc_id stays; of rows that share it, one."""
    return without_rows(documents, lambda rows: exact_dedup(rows).where(~F.col("kept")))
