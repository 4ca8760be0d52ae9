"""Substring dedup on the de Bruijn graph of word windows.

Edges are k-mers of `width` words; an edge's ends, the nodes, are its first and last width - 1 words. Edges are
shuffled as super-k-mers (windows.py), stretches of neighbouring edges with one anchor. Repeated stretches are
joined to their first source; where one is always followed by the same next one, and that one always
preceded by it, the node between them does not branch, and joins compact both into one path. The words of
every occurrence of a path are compared with those at its source coordinates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, maybe, one_row_each, pieces
from .windows import Anchors, Units, later_windows, opened, repeated_runs


def compact(edges: DataFrame) -> DataFrame:
    """Join windows (doc_id, first, n, source_doc, source_first) that follow each other both in a document and in its source into one span. Windows are per document."""
    order = Window.partitionBy("doc_id").orderBy("first")
    same = (F.lag("source_doc").over(order) == F.col("source_doc")) & (F.lag(F.col("source_first") + F.col("n")).over(order) == F.col("source_first")) & (F.lag(F.col("first") + F.col("n")).over(order) == F.col("first"))
    parts = edges.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("path", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("doc_id", "path").agg(F.min("first").alias("first"), F.sum("n").cast("int").alias("n"), F.min("source_doc").alias("source_doc"), F.min("source_first").alias("source_first")).drop("path")


def unbranched(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """runs (doc_id, first, n, source_doc, source_first) compacted along paths without a branch; sources are the same of the runs that are their own source.

    A stretch of edges is named by its source. Its out-degree is the number of different stretches, or ends, that follow its
    occurrences, its in-degree that of those before them. A join links a stretch with out-degree one to the one behind, if
    that has in-degree one. Then every occurrence goes on, the first one too, so that a path's sources lie one behind the other: the
    unlinked stretches of a source document begin its paths. Occurrences of a path are whole, so that grouping by the place where it
    begins puts them together.
    """
    name = F.struct("source_doc", "source_first")
    order = Window.partitionBy("doc_id").orderBy("first", "n")
    after = F.when(F.lead("first").over(order) == F.col("first") + F.col("n"), F.lead(name).over(order))
    before = F.when(F.lag(F.col("first") + F.col("n")).over(order) == F.col("first"), F.lag(name).over(order))
    near = runs.union(sources).select("n", name.alias("path"), after.alias("after"), before.alias("before"))
    one = lambda c: (F.count(c) == F.count("*")) & (F.min(c) == F.max(c))
    nodes = near.groupBy("path", "n").agg(F.when(one("after"), F.min("after")).alias("after"), F.coalesce(one("before"), F.lit(False)).alias("single_in"))
    links = nodes.where("after IS NOT NULL").select(F.col("after").alias("path"), F.lit(True).alias("linked")).distinct()
    joined = nodes.join(links, "path", "left").select("path.source_doc", "path.source_first", (F.col("single_in") & F.coalesce("linked", F.lit(False))).alias("linked"))
    along = Window.partitionBy("source_doc").orderBy("source_first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = joined.select("source_doc", "source_first", F.max(F.when(~F.col("linked"), F.col("source_first"))).over(along).alias("head"))
    spans = runs.join(heads, ["source_doc", "source_first"]).withColumn("start", F.col("first") - F.col("source_first") + F.col("head"))
    spans = spans.groupBy("doc_id", "source_doc", "head", "start").agg(F.sum("n").cast("int").alias("n"))
    return spans.select("doc_id", F.col("start").alias("first"), "n", "source_doc", F.col("head").alias("source_first"))


def _listed(column: pa.ListArray) -> Iterator[zip]:
    """For each row of a list of structs, tuples of its fields."""
    ends, fields = column.offsets.to_pylist(), [x.to_pylist() for x in column.values.flatten()]
    null = column.is_null().to_pylist()
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        yield zip(*(x[a:b] for x in fields), strict=True) if not null[i] else ()


def digests(rows: DataFrame, asked: DataFrame, width: int, words: bool) -> DataFrame:
    """doc_id, first, n, source_doc, source_first, digest: SHA-256 of the units that the asked windows of each text cover.

    asked: doc_id, own (spans with their sources), places (spans that others have as a source; their source comes out null). One pass over the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            out, found = [], []
            for doc, text, own, places in zip(batch.column("doc_id").to_pylist(), batch.column("text"), _listed(batch.column("own")), _listed(batch.column("places")), strict=True):
                units = Units(text.as_buffer().to_pybytes(), words)
                for x in [*own, *((first, n, None, None) for first, n in places)]:
                    out.append((doc, *x))
                    found.append(hashlib.sha256(units.slice(x[0], x[1] + width - 1)).digest())
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], ["doc_id", "first", "n", "source_doc", "source_first", "digest"])

    bounded(rows.sparkSession)
    some = maybe(rows, "doc_id", asked).where("maybe").select("doc_id", "text")
    return some.join(asked, "doc_id").mapInArrow(run, "doc_id long, first int, n int, source_doc long, source_first int, digest binary")


def _asked(own: DataFrame) -> DataFrame:
    """doc_id, own, places from doc_id, own: the distinct sources of all spans, by their document, beside each document's own spans."""
    places = own.select(F.explode("own").alias("x")).select("x.source_doc", "x.source_first", "x.n").distinct()
    places = places.groupBy(F.col("source_doc").alias("doc_id")).agg(F.collect_list(F.struct(F.col("source_first").alias("first"), "n")).alias("places"))
    return own.join(places, "doc_id", "full")


def verified(scratch: Scratch, spans: DataFrame, rows: DataFrame, width: int, words: bool) -> DataFrame:
    """doc_id, first, n of the spans (doc_id, first, n, source_doc, source_first) whose units are those at their source, by SHA-256 of both.

    A span that differs, by a collision of hashes, is taken apart: its windows and their sources are compared by their own
    digests, and those with an equal, earlier one are kept. Equal windows always have equal hashes, so none is missed.
    """
    struct = F.struct("first", "n", F.col("source_doc").cast("long").alias("source_doc"), F.col("source_first").cast("int").alias("source_first"))
    own = scratch.table(spans.groupBy("doc_id").agg(F.collect_list(struct).alias("own")))
    found = scratch.table(digests(rows, scratch.table(_asked(own)), width, words))
    source = found.where("source_doc IS NULL").select(F.col("doc_id").alias("source_doc"), F.col("first").alias("source_first"), "n", F.col("digest").alias("source_digest"))
    checked = scratch.table(found.where("source_doc IS NOT NULL").join(source, ["source_doc", "source_first", "n"]).select("doc_id", "first", "n", "source_doc", "source_first", (F.col("digest") == F.col("source_digest")).alias("equal")))
    good, bad = checked.where("equal").select("doc_id", "first", "n"), checked.where("NOT equal")
    if bad.isEmpty():
        return good
    each = bad.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    places = each.select("doc_id", (F.col("first") + F.col("i")).alias("first")).union(each.select("source_doc", F.col("source_first") + F.col("i"))).distinct()
    places = places.groupBy("doc_id").agg(F.collect_list(F.struct("first", F.lit(1).alias("n"))).alias("places")).withColumn("own", F.lit(None).cast(own.schema["own"].dataType))
    single = scratch.table(digests(rows, scratch.table(places), width, words))
    firsts = single.groupBy("digest").agg(F.min(F.struct("doc_id", "first")).alias("least"))
    return good.union(single.join(firsts, "digest").where("struct(doc_id, first) <> least").select("doc_id", "first", "n"))


def dedup_words(documents: DataFrame, width: int = 20, gram: int = 8, kept_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and, if asked, kept_text) of every document.

    A word is removed if a window of `width` words that covers it also starts earlier: in a smaller
    doc_id, or earlier in the same document. Windows are judged on the input. Words are runs of anything
    but ASCII white space, unchanged. A null or empty text has none, and a text of fewer than `width`
    words loses none. Rows that share a doc_id are documents of their own, in the order of their texts' hashes, and of equal
    rows all but one lose their repeats; null doc_ids come before any other. Very long texts are read whole, in blocks of windows.
    Only doc_id and text are read, so other columns may have any names. An empty table gives no rows.
    """
    rows = one_row_each(documents)
    anchors = Anchors(width, gram, True)
    with Scratch(documents.sparkSession) as scratch:
        moved, sources, varied = repeated_runs(scratch, rows, anchors)
        single = later_windows(scratch, scratch.table(opened(varied, anchors))).select("doc_id", "first", F.lit(1).alias("n"), "source_doc", "source_first")
        found = unbranched(scratch.table(moved), sources).union(compact(single))
        spans = scratch.result(verified(scratch, found, rows, width, True).groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("spans")))
    return without(rows, spans, width, True, kept_text)


def without(rows: DataFrame, spans: DataFrame, width: int, words: bool, kept_text: bool) -> DataFrame:
    """Each text without the units covered by its spans (doc_id, spans: first window, number of windows)."""
    unit = "words" if words else "bytes"
    schema = f"doc_id long, n_{unit} long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * kept_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = []
            for doc, text, spans in zip(batch.column("own_id").to_pylist(), batch.column("text"), _listed(batch.column("spans")), strict=True):
                units, kept, at, removed, runs = Units(text.as_buffer().to_pybytes(), words), [], 0, 0, 0
                for first, n in sorted(spans):
                    if first > at or not runs:
                        runs += 1
                        if first > at:
                            kept.append(units.slice(at, first - at))
                    end = first + n + width - 1
                    removed += max(0, end - max(at, first))
                    at = max(at, end)
                if at < units.n:
                    kept.append(units.slice(at, units.n - at))
                kept = (b" " if words else b"").join(kept)
                out.append((doc, units.n, removed, runs, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "replace")] * kept_text)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=False)], [x.split()[0] for x in schema.split(", ")])

    marked = maybe(rows, "doc_id", spans).select("doc_id", "own_id", "text", "maybe")
    none = F.lit(None).cast("array<struct<first:int,n:int>>").alias("spans")
    touched = marked.where("maybe").join(spans, "doc_id", "left").select("own_id", "text", "spans")
    bounded(rows.sparkSession)
    return marked.where("NOT maybe").select("own_id", "text", none).union(touched).mapInArrow(run, schema)
