"""Quality by nearest labelled neighbours in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, let_go, raw, texts

#: Hashed terms of a text (byte trigrams) and shares (`shares`), latent dimensions, labelled rows that
#: are sent to every worker, neighbours that vote.
TERMS, SHARES, LATENT, LABELLED, NEIGHBOURS = 2048, 4, 64, 3000, 25
#: A share of 1 weighs as much as so many times all trigrams together.
SHARE_WEIGHT = 2.0
#: Rows of one block of the cosine products.
BLOCK = 512


def shares(data: np.ndarray) -> list[float]:
    """Of all words: those that repeat the one before or the one before that. Of all lines: repeats. Of all bytes: capitals, and neither letters nor spaces."""
    words, lines = data.tobytes().split(), data.tobytes().split(b"\n")
    repeats = sum(a == b or a == c for a, b, c in zip(words[2:], words[1:], words, strict=False))
    capital = int(((data >= 65) & (data <= 90)).sum())
    other = int(((data > 32) & (data < 65)).sum()) + int(((data > 90) & (data < 97)).sum() + ((data > 122) & (data < 128)).sum())
    return [repeats / max(1, len(words)), 1 - len(set(lines)) / max(1, len(lines)), capital / len(data), other / len(data)]


def term_counts(data: np.ndarray) -> np.ndarray:
    """How often each hashed term comes in a whole text, and its shares."""
    out = np.zeros(TERMS + SHARES, np.float32)
    if not len(data):
        return out
    x = np.concatenate([[32], data, [32]]).astype(np.uint32)
    slot = ((x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA6B) ^ x[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)) >> np.uint32(21)
    out[:TERMS] = np.bincount(slot, minlength=TERMS)
    out[TERMS:] = shares(data)
    return out


def _counts(column: pa.Array) -> np.ndarray:
    data, at = raw(column)
    return np.stack([term_counts(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])


def _weighed(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    x = np.log1p(counts[:, :TERMS]) * rarity
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return np.concatenate([x, counts[:, TERMS:] * SHARE_WEIGHT], axis=1)


@dataclass
class Neighbours:
    """What a worker gets: about LABELLED * LATENT + TERMS * LATENT numbers, whatever the table's size."""

    rarity: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, seed: int = 11) -> Neighbours:
        """Truncated SVD of the weighed term matrix by subspace iteration."""
        n = len(labels)
        rarity = (np.log((1 + n) / (1 + (counts[:, :TERMS] > 0).sum(axis=0))) + 1).astype(np.float32)
        x = _weighed(counts, rarity)
        basis = np.random.default_rng(seed).standard_normal((counts.shape[1], LATENT + 16)).astype(np.float32)
        for _ in range(3 if n else 0):
            basis, _ = np.linalg.qr(x.T @ (x @ basis))
        _, _, turn = np.linalg.svd(x @ basis, full_matrices=False) if n else (0, 0, np.eye(LATENT + 16, dtype=np.float32))
        axes = (basis @ turn[:LATENT].T).astype(np.float32)
        return cls(rarity, axes, cls._unit(x @ axes), labels.astype(np.float32))

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The labels of the nearest vectors, weighted by a power of the cosine; the mean label for a text without terms."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        prior = float(self.labels.mean())
        near = self._unit(_weighed(counts, self.rarity) @ self.axes) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        who = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, who, axis=1), 0).astype(np.float64) ** 8
        votes = (weight * self.labels[who]).sum(axis=1) + 1e-6 * prior
        return np.clip(votes / (weight.sum(axis=1) + 1e-6), 0, 1)


def held_out(modulus: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0, F.lit(False))


def labelled(documents: DataFrame, labels: DataFrame, column: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Term counts and labels of at most `limit` labelled training rows, those whose hashed doc_id is least."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out(5)).groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw(batch.column("text"))
            found = [term_counts(data[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())], ["doc_id", "label", "counts"])

    rows = texts(documents).join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")
    rows = rows.mapInArrow(run, "doc_id long, label int, counts binary").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("counts").alias("counts")).orderBy("doc_id").toPandas()
    counts = np.frombuffer(b"".join(map(bytes, rows["counts"])), np.float32).reshape(-1, TERMS + SHARES)
    return counts, rows["label"].to_numpy(np.int64)


def quality_scores(documents: DataFrame, labels: DataFrame, column: str = "quality", limit: int = LABELLED, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents.

    Learnt from at most `limit` labelled rows whose crc32(doc_id) mod 5 is not 0; scored from the text
    alone, over the whole of it. A label of null counts as none, of repeated labels the least counts. An
    empty or null text gets the mean label, as does every text if there are no labels at all (0.5 then).
    Repeated rows and null doc_ids are scored like any other. An empty table gives no rows.
    """
    spark = bounded(documents.sparkSession)
    model = spark.sparkContext.broadcast(Neighbours.fit(*labelled(documents, labels, column, limit)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                score = model.value.score(_counts(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return texts(documents, held_out(5).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(documents: DataFrame, labels: DataFrame, column: str = "quality", limit: int = LABELLED, threshold: float = 0.3) -> DataFrame:
    """The rows of documents, columns as they are, whose text scores `threshold` or more; one pass, no shuffle of texts."""
    spark = bounded(documents.sparkSession)
    model = spark.sparkContext.broadcast(Neighbours.fit(*labelled(documents, labels, column, limit)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                yield part.filter(pa.array(model.value.score(_counts(part.column("text").fill_null(""))) >= threshold))

    return documents.mapInArrow(run, documents.schema)
