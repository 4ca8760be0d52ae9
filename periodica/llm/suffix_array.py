"""Byte-level dedup with bucket-pointer refinement.

Initial buckets are q-grams: by anchor across the cluster (windows.py), then within a block of
contexts all suffixes that share their first bytes. A bucket is refined by sorting its suffixes on the
bucket identifiers of later offsets; refined identifiers are what the next refinement reads, so the
depth doubles until it spans a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, one_row_each
from .substring_dedup import compact, verified, without
from .windows import Anchors, later_windows, opened, repeated_runs

#: An anchor bucket with more different contexts than this is not one task's: its windows are spread by their contents.
TASK_LABELS = 4096
#: Bytes of contexts that are refined together.
BLOCK_BYTES = 4 << 20


def refine(data: np.ndarray, depth: int) -> np.ndarray:
    """For each position with `depth` bytes from it on, a number that equal substrings of that length share.

    Buckets start as 8-grams. In each round a suffix of a shared bucket is sorted by its bucket pointer
    and the pointer of the suffix that starts where its known prefix ends. Suffixes alone in their
    bucket are final: they keep their pointer and leave the sort, but others go on reading it.
    """
    n = len(data)
    if n < depth:
        return np.zeros(0, np.int64)
    known = 8 if depth >= 8 else 1
    data = np.ascontiguousarray(data)
    head = np.ndarray((n - known + 1,), np.uint64, data, strides=(1,)).copy() if known == 8 else data.astype(np.int64)
    _, pointer = np.unique(head, return_inverse=True)
    pointer = pointer.astype(np.int64)
    while known < depth:
        step = min(known, depth - known)
        size = n - known - step + 1
        own, later = pointer[:size], pointer[step : step + size]
        members = np.bincount(own)
        shared = np.flatnonzero(members[own] > 1)
        order = shared[np.argsort(own[shared] * n + later[shared])]  # both are less than n
        # pointers stay ordered: bucket b's members get numbers from the start of b on
        starts = np.concatenate([[0], np.cumsum(members)])[:-1]
        refined = starts[own]
        if len(order):
            a, b = own[order], later[order]
            fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            head_of = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
            bucket_at = np.maximum.accumulate(np.where(np.concatenate([[True], a[1:] != a[:-1]]), np.arange(len(order)), 0))
            refined[order] = starts[a] + head_of - bucket_at
        pointer, known = refined, known + step
    return pointer


def _block(rows: list[tuple], width: int) -> pa.RecordBatch | None:
    """doc_id, first, n of the runs of windows that also start earlier in the block's contexts."""
    rows.sort(key=lambda x: (x[1], x[2]))
    data = np.frombuffer(b"".join(x[4] for x in rows), np.uint8)
    pointer = refine(data, width)
    at = np.concatenate([[0], np.cumsum([len(x[4]) for x in rows])])[:-1]
    n = np.array([x[3] for x in rows])
    where = np.repeat(at - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
    own, number = pointer[where], np.arange(len(where))
    seen = np.empty(len(pointer), np.int64)
    seen[own[::-1]] = number[::-1]  # the last one written is the earliest, as rows are in order
    found = np.flatnonzero(seen[own] != number)
    if not len(found):
        return None
    doc = np.repeat(np.array([x[1] for x in rows]), n)[found]
    first = (np.repeat(np.array([x[2] for x in rows]) - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum()))[found]
    fresh = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + 1)]))
    return pa.RecordBatch.from_arrays([pa.array(doc[fresh]), pa.array(first[fresh], pa.int32()), pa.array(np.diff(np.append(fresh, len(doc))), pa.int32())], ["doc_id", "first", "n"])


def repeated_in_buckets(varied: DataFrame, width: int) -> DataFrame:
    """doc_id, first, n: windows of `varied` that have an equal, earlier one, found bucket by bucket.

    Buckets (keys) are whole within a partition and sorted, so that a task holds one block of contexts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, key = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("key", "doc_id", "first", "n", "context")), strict=True):
                if size >= BLOCK_BYTES and row[0] != key:
                    if (out := _block(rows, width)) is not None:
                        yield out
                    rows, size = [], 0
                rows.append(row)
                size, key = size + len(row[4]), row[0]
        if rows and (out := _block(rows, width)) is not None:
            yield out

    bounded(varied.sparkSession)
    dealt = varied.select("key", "doc_id", "first", "n", "context").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "doc_id long, first int, n int")


def dedup_bytes(documents: DataFrame, width: int = 100, gram: int = 32, task_labels: int = TASK_LABELS, kept_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and, if asked, kept_text) of every document.

    A byte is removed if a string of `width` bytes that covers it also starts earlier: in a smaller
    doc_id, or earlier in the same document. Overlaps count, strings are judged on the input, and
    matches never cross documents. Null texts are empty, texts shorter than `width` lose nothing. Rows that share a doc_id are
    documents of their own, in the order of their texts' hashes; null doc_ids come before any other. Very long texts are read
    whole, in blocks of windows. Only doc_id and text are read, so other columns may have any names. An empty table gives no rows.

    Copies of a whole run of windows go to their first source, and their bytes are compared with those there. Different runs of
    one anchor bucket are refined together in one task; a bucket with more than task_labels different runs is too much for
    one, and is opened into windows that are dealt by content and compared with their sources as well: the same result, for any number.
    """
    rows = one_row_each(documents)
    anchors = Anchors(width, gram, False)
    with Scratch(documents.sparkSession) as scratch:
        moved, _, varied = repeated_runs(scratch, rows, anchors)
        varied = scratch.table(varied)
        refined = repeated_in_buckets(varied.where(F.col("labels") <= task_labels), width)
        spread = later_windows(scratch, scratch.table(opened(varied.where(F.col("labels") > task_labels), anchors)))
        hashed = moved.union(spread.select("doc_id", "first", F.lit(1).alias("n"), "source_doc", "source_first"))
        found = verified(scratch, compact(hashed), rows, width, False).union(refined)
        spans = scratch.result(found.groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("spans")))
    return without(rows, spans, width, False, kept_text)
