"""Runs of equally anchored windows: what long-repeat operators shuffle instead of single windows.

A window is `width` neighbouring units (bytes or words) of one text. Its anchor is the leftmost of its
`gram`-unit substrings with the least hash, so equal windows have equal anchors at equal offsets.
Neighbouring windows with one anchor form a run (a super-k-mer); runs are several times fewer than
windows, and two equal windows always lie in runs with the same key, the hash of the anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, maybe, pieces

_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64)
#: Windows handled at once; a longer text is cut into overlapping blocks of so many.
BLOCK = 1 << 22
_LOW = np.uint64(0xFFFFFF)
#: Bits of the filter of repeated keys for each such key, and the bounds of its size: 128 KB to 128 MB.
FILTER_SHARE, FILTER_LEAST, FILTER_MOST = 8, 20, 30


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Units:
    """The units of one text: data[start[i] : end[i]] is unit i."""

    def __init__(self, text: bytes, words: bool):
        if words:
            parts = text.split()
            self.data = b" ".join(parts)
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            self.end = np.cumsum(lengths + 1) - 1
            self.start = self.end - lengths
            self.n = len(parts)
        else:
            self.data, self.n = text, len(text)
            self.start = self.end = None

    def slice(self, first: int, count: int) -> bytes:
        """`count` units from the first on, as they stand."""
        if self.start is None:
            return self.data[first : first + count]
        return self.data[self.start[first] : self.end[first + count - 1]]


class Anchors:
    def __init__(self, width: int, gram: int, words: bool):
        self.width, self.gram, self.words = width, gram, words
        self._up, self._down = _powers(1 << 16, _BASE), _powers(1 << 16, _INVERSE)

    def _hashes(self, units: Units) -> np.ndarray:
        """A hash per gram, from prefix sums of powers; which anchor is chosen needs no more than that equal grams agree."""
        data = np.frombuffer(units.data, np.uint8)
        if len(data) >= len(self._up):
            size = 1 << int(len(data)).bit_length()
            self._up, self._down = _powers(size, _BASE), _powers(size, _INVERSE)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * self._up[: len(data)], out=sums[1:])
        if self.words:
            a, b = units.start[: units.n - self.gram + 1], units.end[self.gram - 1 :]
            h = (sums[b] - sums[a]) * self._down[a]
        else:
            h = (sums[self.gram :] - sums[: -self.gram]) * self._down[: len(data) - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        return h

    def runs(self, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """key, first window and number of windows of each run, in order."""
        none = np.zeros(0, np.int64)
        if units.n < self.width:
            return none, none, none
        hashes = self._hashes(units)
        span, windows, found = self.width - self.gram + 1, units.n - self.width + 1, []
        for at in range(0, windows, BLOCK):
            h = hashes[at : at + BLOCK + span - 1]
            least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
            step = 1
            while 2 * step <= span:
                least, step = np.minimum(least[:-step], least[step:]), 2 * step
            if span > step:
                least = np.minimum(least[: len(least) - (span - step)], least[span - step :])
            anchor = (least & _LOW).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            count = np.diff(np.append(first, len(anchor)))
            found.append((h[anchor[first]].view(np.int64), first + at, count))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if len(found) > 1 else found[0]


def _bits(keys: DataFrame) -> np.ndarray:
    """A bitmap over the low bits of `keys`.key, a written table: a power of two of bits, about FILTER_SHARE a key."""
    size = min(FILTER_MOST, max(FILTER_LEAST, (FILTER_SHARE * max(1, keys.count()) - 1).bit_length()))
    low = F.col("key").bitwiseAND(F.lit((1 << size) - 1))
    words = keys.select(F.shiftright(low, 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def _inside(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys.view(np.uint64) & np.uint64(64 * len(bits) - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1


def _keys(rows: DataFrame, anchors: Anchors) -> DataFrame:
    """key of every run of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [anchors.runs(Units(x.as_buffer().to_pybytes(), anchors.words))[0] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64())], ["key"])

    bounded(rows.sparkSession)
    return rows.select("text").mapInArrow(run, "key long")


def _scan(rows: DataFrame, anchors: Anchors, bits) -> DataFrame:
    """The runs whose key may be repeated, by the broadcast bitmap: key, label, doc_id, first, n, lead.

    label hashes the whole run; lead marks the first run of its key and label in its text.
    """
    schema = "key long, label long, doc_id long, first int, n int, lead boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                units = Units(text.as_buffer().to_pybytes(), anchors.words)
                key, first, n = anchors.runs(units)
                some = _inside(bits.value, key)
                key, first, n = key[some], first[some], n[some]
                if not len(key):
                    continue
                whole = (units.slice(a, b) for a, b in zip(first.tolist(), (n + anchors.width - 1).tolist(), strict=True))
                label = np.fromiter(map(xxhash.xxh3_64_intdigest, whole), np.uint64, len(key)).view(np.int64)
                lead = np.zeros(len(key), bool)
                lead[np.unique((key * np.int64(0x9E3779B1) ^ label) * np.int64(0x85EBCA6B) ^ n, return_index=True)[1]] = True
                out.append((key, label, np.full(len(key), doc), first, n, lead))
            if out:
                key, label, doc, first, n, lead = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(label), pa.array(doc, pa.int64()), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(lead)], [x.split()[0] for x in schema.split(", ")])

    bounded(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def _contexts(scratch: Scratch, rows: DataFrame, anchors: Anchors, runs: DataFrame) -> DataFrame:
    """runs (key, labels, doc_id, first, n) with their units as context; only texts that have some are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            out = []
            ends, fields = batch.column("asked").offsets.to_pylist(), [x.to_pylist() for x in batch.column("asked").values.flatten()]
            for doc, text, a, b in zip(batch.column("doc_id").to_pylist(), batch.column("text"), ends, ends[1:], strict=False):
                units = Units(text.as_buffer().to_pybytes(), anchors.words)
                out += [(key, labels, doc, first, n, units.slice(first, n + anchors.width - 1)) for key, labels, first, n in zip(*(x[a:b] for x in fields), strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "labels", "doc_id", "first", "n", "context"])

    asked = scratch.table(runs.groupBy("doc_id").agg(F.collect_list(F.struct("key", "labels", "first", "n")).alias("asked")))
    some = maybe(rows, "doc_id", asked).where("maybe").select("doc_id", "text")
    bounded(rows.sparkSession)
    return some.join(asked, "doc_id").mapInArrow(run, "key long, labels long, doc_id long, first int, n int, context binary")


def repeated_runs(scratch: Scratch, rows: DataFrame, anchors: Anchors) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For rows (doc_id, text), one per doc_id: whole runs with an earlier copy, the first copies of these, and the first copies that may hold repeated windows.

    First result: doc_id, first, n, source_doc, source_first. Every window of such a run also starts in its source.
    Second: the same columns, of the sources themselves.
    Third: key, labels (of the key), doc_id, first, n, context: the first copy of each run whose anchor has different runs too.
    A window whose first occurrence is not in the third result occurs in its own run's copies only.

    First pass: which keys come more than once. Second pass: only runs with such keys (and a few that
    the filter lets through) are shuffled. The units of runs are fetched last, for first copies alone.
    """
    spark = rows.sparkSession
    keys = scratch.table(_keys(rows, anchors).groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key"))
    found = scratch.table(_scan(rows, anchors, spark.sparkContext.broadcast(_bits(keys))))
    firsts = found.groupBy("key", "label", "n").agg(F.min("doc_id").alias("source_doc"), F.expr("min_by(first, doc_id) FILTER (WHERE lead)").alias("source_first"), F.count("*").alias("copies"))
    firsts = scratch.table(firsts)
    moved = found.join(firsts.where("copies > 1"), ["key", "label", "n"]).where("doc_id <> source_doc OR first <> source_first")
    several = firsts.groupBy("key").agg(F.count("*").alias("labels")).where("labels > 1")
    varied = firsts.join(several, "key").select("key", "labels", F.col("source_doc").alias("doc_id"), F.col("source_first").alias("first"), "n")
    sources = firsts.where("copies > 1").select(F.col("source_doc").alias("doc_id"), F.col("source_first").alias("first"), "n", "source_doc", "source_first")
    return moved.select("doc_id", "first", "n", "source_doc", "source_first"), sources, _contexts(scratch, rows, anchors, varied)


def opened(runs: DataFrame, anchors: Anchors) -> DataFrame:
    """The windows of runs (doc_id, first, n, context): doc_id, first and a 128-bit hash (h1, h2) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in pieces(batches, "context", 1 << 20):
            docs, starts, hashes = [], [], []
            for doc, first, n, context in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "first", "n", "context")), strict=True):
                units = Units(context, anchors.words)
                hashes += [digest(units.slice(i, anchors.width)) for i in range(n)]
                docs.append(np.full(n, doc))
                starts.append(np.arange(first, first + n))
            both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(np.concatenate(starts), pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["doc_id", "first", "h1", "h2"])

    bounded(runs.sparkSession)
    return runs.select("doc_id", "first", "n", "context").mapInArrow(run, "doc_id long, first int, h1 long, h2 long")


def later_windows(scratch: Scratch, windows: DataFrame) -> DataFrame:
    """doc_id, first, source_doc, source_first of the windows (h1, h2) that are not the first of their kind.

    The first ones are written before the join: both of its sides are then exchanged for it, and a hot window's rows can be split.
    """
    firsts = scratch.table(windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "first")).alias("source"), F.count("*").alias("copies")).where("copies > 1"))
    return windows.join(firsts, ["h1", "h2"]).select("doc_id", "first", F.col("source.doc_id").alias("source_doc"), F.col("source.first").alias("source_first")).where("doc_id <> source_doc OR first <> source_first")
