"""SimHash near-dedup by multi-index hashing with small Hamming balls per segment, and exact near-dedup by shingle prefixes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, bounded, components, cut, let_go, maybe, one_row_each, pieces, table, texts, without_rows

SEED = 42


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every run of `size` words, joined by spaces; of the whole sequence if there are fewer words."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, len(words) - size + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes, as a signed number."""
    if not len(hashes):
        return 0
    set_in = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        set_in += bits.sum(axis=0, dtype=np.int64) if len(bits) < 64 else _columns(bits)
    return int(np.packbits(2 * set_in > len(hashes)).view(">i8")[0])


def _columns(bits: np.ndarray) -> np.ndarray:
    """Sums of 0/1 columns, eight bytes at a time: at most 255 rows fit a byte."""
    rows = len(bits) // 255
    head = bits[: rows * 255].view(np.uint64).reshape(rows, 255, 8).sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(rows, 64)
    return head.sum(axis=0, dtype=np.int64) + bits[rows * 255 :].sum(axis=0, dtype=np.int64)


def fingerprints(documents: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and 64-bit fingerprint of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [majority(shingle_hashes(x.as_buffer().to_pybytes() if x.as_buffer() else b"", words)) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    bounded(documents.sparkSession)
    return texts(documents).mapInArrow(run, "doc_id long, fp long")


def segments(bits: int, count: int) -> list[tuple[int, int]]:
    """(shift, width) of `count` neighbouring segments that cover `bits`."""
    cuts = [i * bits // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def balls(distance: int, count: int) -> list[int]:
    """A radius per segment such that any two fingerprints within `distance` are within it in one segment at least.

    With distance = count * r + a, the first a + 1 segments get r and the others r - 1: were all
    exceeded, the distances would add up to (a + 1) * (r + 1) + (count - a - 1) * r = distance + 1.
    """
    r, a = divmod(distance, count)
    return [r if i <= a else r - 1 for i in range(count)]


def masks(width: int, radius: int) -> list[int]:
    """All changes of up to `radius` bits."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _segment(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else fp


def best_count(points: int, distance: int) -> int:
    """The number of segments with the fewest comparisons: a probe for every change within a ball, each with its share of the points."""

    def work(count: int) -> float:
        parts = zip(segments(64, count), balls(distance, count), strict=True)
        return sum(sum(math.comb(width, r) for r in range(radius + 1)) * (1 + points / 2.0**width) for (_, width), radius in parts if radius >= 0)

    return min(range(1, distance + 2), key=work)


def _entries(distance: int, count: int) -> tuple[list[Column], list[Column]]:
    """Structs (seg, value) under which a fingerprint is filed, and those that it probes: all small changes of its segments."""
    filed, probes = [], []
    for i, ((shift, width), radius) in enumerate(zip(segments(64, count), balls(distance, count), strict=True)):
        if radius < 0:
            continue
        own = _segment(F.col("fp"), shift, width)
        filed.append(F.struct(F.lit(i).alias("seg"), own.alias("value")))
        probes += [F.struct(F.lit(i).alias("seg"), own.bitwiseXOR(F.lit(m)).alias("value")) for m in masks(width, radius)]
    return filed, probes


def _keyed(df: DataFrame, entries: list[Column], name: str) -> DataFrame:
    """A row for each entry. Spark's estimate of their size leaves the number of entries out: joins of these rows need a hint, or the driver gathers them all."""
    named = [F.col(c).alias(f"{name}_{c}") for c in df.columns]
    return df.select(*named, F.explode(F.array(*entries)).alias("e")).select("e.seg", "e.value", *[f"{name}_{c}" for c in df.columns])


def star(points: DataFrame, distance: int, count: int) -> DataFrame:
    """Pairs (a, b) of ids of `points` (id, fp) within `distance`: every probe against its bucket's least member only, so one row a probe at most."""
    filed, probes = _entries(distance, count)
    pivots = _keyed(points, filed, "b").groupBy("seg", "value").agg(F.min("b_id").alias("b_id"), F.min_by("b_fp", "b_id").alias("b_fp"))
    near = F.bit_count(F.col("a_fp").bitwiseXOR(F.col("b_fp"))) <= distance
    found = _keyed(points, probes, "a").hint("merge").join(pivots, ["seg", "value"]).where((F.col("a_id") != F.col("b_id")) & near)
    return found.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def links(points: DataFrame, distance: int = 4, count: int | None = None) -> DataFrame:
    """Pairs (a, b) of ids of `points` (id, fp) that span the same components as all pairs within `distance`.

    Each segment of a fingerprint is a table key. A fingerprint probes the keys in a small Hamming ball
    around its own segment; a match's complete distance is verified. A dense bucket is first reduced to a
    star about its least member; after that only pairs from different components are left to be emitted,
    so that a group of near copies costs its size and not its square in rows. `count` segments, by
    default as many as keep the comparisons fewest for the number of points.
    """
    count = count or best_count(points.count(), distance)
    filed, probes = _entries(distance, count)
    first = cut(star(points, distance, count))
    label = components(first).withColumnRenamed("node", "id")
    marked = cut(points.join(label, "id", "left").select("id", "fp", F.coalesce("component", "id").alias("c")))
    near = F.bit_count(F.col("a_fp").bitwiseXOR(F.col("b_fp"))) <= distance
    left, right = _keyed(marked, probes, "a").hint("merge"), _keyed(marked, filed, "b")
    rest = left.join(right, (left["seg"] == right["seg"]) & (left["value"] == right["value"]) & (left["a_c"] != right["b_c"]) & near)
    return first.union(rest.select(F.greatest("a_id", "b_id").alias("a"), F.least("a_id", "b_id").alias("b")).distinct())


def simhash_components(documents: DataFrame, words: int = 4, distance: int = 4, segment_count: int | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of documents.

    A component's id is the least doc_id that links reach. Null and empty texts have the fingerprint
    zero and are linked like any other; equal fingerprints are equal nodes, so copies cost one row
    each. Repeated rows give a row each; a null doc_id is ignored in component_id unless its component
    has no other. An empty table gives no rows.
    """
    rows = cut(fingerprints(documents, words))
    points = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(links(points.select(F.col("fp").alias("id"), "fp"), distance, segment_count))
    named = points.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "component").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shingle_set(text: bytes, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


#: Every so many-th document is looked at for common shingles, which are those in so many of them; bits of their bitmap.
LOOK, COMMON, COMMON_BITS = 16, 3, 24
#: Fingerprints of near copies that the balls look for.
NEAR = 4


def _common(rows: DataFrame, words: int) -> np.ndarray:
    """A bitmap over the first bits of shingles that are common in a sample: it only says in which order shingles are read, and decides no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            found = [_shingle_set(x.as_buffer().to_pybytes(), words).view(np.int64) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["s"])

    bounded(rows.sparkSession)
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(LOOK)) == 0).select("text").mapInArrow(run, "s long")
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(s, {64 - COMMON_BITS}) & 63 as int))")
    word = F.shiftrightunsigned("s", 64 - COMMON_BITS + 6).cast("int")
    got = some.groupBy("s").count().where(f"count >= {COMMON}").select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (COMMON_BITS - 6), np.int64)
    bitmap[got["word"].to_numpy()] = got["bits"].to_numpy()
    return bitmap.view(np.uint64)


def prefix(shingles: np.ndarray, bitmap: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """The first of the shingles, ordered by (common, hash), and how many are not common: two sets of at least that Jaccard similarity share one of these.

    Both sets hold `similarity` of the larger one's shingles in common, so the first common one is not further back.
    """
    at = shingles >> np.uint64(64 - COMMON_BITS)
    common = (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
    n, own = len(shingles), shingles[~common]
    return np.concatenate([own, shingles[common]])[: n - math.ceil(similarity * n - 1e-6) + 1], len(own)


def odd_bits(shingles: np.ndarray) -> bytes:
    """Which of m slots an odd number of the shingles falls into; m is a power of two, twice the shingles at least.

    Of two sets' slots, folded to the same m, no more differ than shingles are in one set only.
    """
    m = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    return np.packbits((np.bincount((shingles & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """At least so many shingles are in one of two sets only, by their odd_bits."""
    a, b = (np.frombuffer(z, np.uint64) for z in ((x, y) if len(x) >= len(y) else (y, x)))
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _sets(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc_id, a hash of the set of `words`-word shingles, the set's size n, its number of shingles that are not common, SimHash, odd bits, and prefix."""
    sent = rows.sparkSession.sparkContext.broadcast(_common(rows, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        bitmap = sent.value
        for batch in pieces(batches, "text", 1 << 20):
            sets = [_shingle_set(x.as_buffer().to_pybytes(), words) for x in batch.column("text")]
            content = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            first, own = zip(*(prefix(x, bitmap, similarity) for x in sets), strict=True)
            ends = np.cumsum([0, *map(len, first)], dtype=np.int32)
            columns = [
                batch.column("doc_id"), batch.column("own_id"), pa.array(content, pa.binary()), pa.array(list(map(len, sets)), pa.int32()), pa.array(own, pa.int32()), pa.array(list(map(majority, sets)), pa.int64()), pa.array(list(map(odd_bits, sets)), pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first).view(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "own_id", "content", "n", "own", "fp", "odd", "prefix"])

    bounded(rows.sparkSession)
    return rows.select("doc_id", "own_id", "text").mapInArrow(run, "doc_id long, own_id long, content binary, n int, own int, fp long, odd binary, prefix array<long>")


def _similar(scratch: Scratch, pairs: DataFrame, each: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of doc_ids whose sets of shingles have at least that Jaccard similarity, counted exactly.

    Pairs whose odd bits show that too many shingles differ go first, so that whole sets move for few others than real links.
    """

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = (batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()) * ((1 - similarity) / (1 + similarity)) + 1e-6
            keep = [least_difference(x, y) <= most for x, y, most in zip(batch.column("oa").to_pylist(), batch.column("ob").to_pylist(), sizes.tolist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in pieces(batches, "text", 1 << 20):
            found = [_shingle_set(x.as_buffer().to_pybytes(), words).tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-6)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    bits = [each.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("odd").alias(f"o{x}")) for x in "ab"]
    bounded(rows.sparkSession)
    pairs = scratch.table(pairs.join(bits[0], "a").join(bits[1], "b").select("a", "b", "na", "nb", "oa", "ob").mapInArrow(possible, "a long, b long"))
    ids = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    some = maybe(rows, "doc_id", ids).where("maybe").select("doc_id", "text")
    found = scratch.table(some.join(ids, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, shingles binary"))
    both = pairs.join(found.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").join(found.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    return scratch.table(both.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long"))


def _room(similarity: float) -> Column:
    """Whether shingles from these places on can make up the overlap that two sets of sizes a_n and b_n need."""
    return F.expr(f"least(a_n - a_pos, b_n - b_pos) * {1 + similarity}D >= {similarity}D * (a_n + b_n) - 1e-6D")


def _named(df: DataFrame, name: str) -> DataFrame:
    return df.select("s", *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "s"])


def near_duplicates(documents: DataFrame, words: int = 5, similarity: float = 0.8, distance: int = NEAR) -> DataFrame:
    """doc_id, component_id (the least doc_id of its group) of every row of documents.

    Two rows are linked if their sets of `words`-word shingles have a Jaccard similarity of at least
    `similarity`, counted exactly. Candidates come from multi-index hashing of SimHash fingerprints within
    `distance` bits. A fingerprint of 64 bits cannot tell a similarity of 0.8 from one of 0.7, so what that
    ball leaves apart is found by an exact prefix filter: the first shared shingle, rare ones first, of a
    pair at the threshold lies in the first fifth of the larger set and in the first ninth of the smaller
    one, at places that leave room for the overlap. So no pair at the threshold is missed.

    Every entry is compared with one pivot of its shingle first, the set with the smallest share of
    shingles of its own; only pairs from different components are compared after that.

    Rows without words form one group. Repeated rows and rows that share a doc_id are rows like any other; a null doc_id
    comes out null, and component_id is null only for a group without any. Very long texts are read whole, in pieces
    of whole rows. Other columns are not read. An empty table gives no rows.
    """
    found = _near(one_row_each(documents), words, similarity, distance)
    least = table(found.groupBy("component").agg(F.min("own_id").alias("component_id")))
    return found.join(least, "component").select(F.col("own_id").alias("doc_id"), "component_id")


def _near(rows: DataFrame, words: int, similarity: float, distance: int) -> DataFrame:
    """doc_id (the key), own_id, component (its least key) of rows (doc_id, own_id, text)."""
    with Scratch(rows.sparkSession) as scratch:
        each = scratch.table(_sets(rows, words, similarity))
        nodes = scratch.table(each.groupBy("content").agg(F.min("doc_id").alias("id"), F.min_by("fp", "doc_id").alias("fp"), F.count("*").alias("rows")))
        same = each.select("doc_id", "content").join(nodes.where("rows > 1").select("content", "id"), "content").where("doc_id <> id").select("doc_id")
        alone = each.join(scratch.table(same), "doc_id", "left_anti")
        entries = alone.select(F.col("doc_id").alias("id"), "n", (F.col("own") / F.col("n")).alias("share"), F.posexplode("prefix").alias("pos", "s"))
        # as the smaller set of a pair, by (n, id), a set is found under fewer of its shingles
        entries = entries.withColumn("low", F.expr(f"pos < n - ceil({2 * similarity / (1 + similarity)}D * n - 1e-6D) + 1"))
        # most shingles are one set's alone: only their hashes move
        many = scratch.table(entries.groupBy("s").agg(F.count("*").alias("sets"), F.max("low").alias("low")).where("sets > 1 AND low").select("s"))
        some = scratch.table(maybe(entries, "s", many).where("maybe").drop("maybe").join(many.hint("merge"), "s", "left_semi"))
        pivots = scratch.table(some.groupBy("s").agg(F.min(F.when(F.col("low"), F.struct("share", "id", "n", "pos"))).alias("p")))
        shared = scratch.table(some.join(pivots, "s").select("s", "id", "n", "pos", "low", F.col("p.id").alias("b_id"), F.col("p.n").alias("b_n"), F.col("p.pos").alias("b_pos")))
        stars = shared.select(F.col("id").alias("a_id"), F.col("n").alias("a_n"), F.col("pos").alias("a_pos"), "b_id", "b_n", "b_pos").where((F.col("a_id") != F.col("b_id")) & _room(similarity))
        points = nodes.select("id", "fp")
        ball = star(points, distance, best_count(points.count(), distance))
        pairs = scratch.table(ball.union(stars.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        found = _similar(scratch, pairs, each, rows, words, similarity)
        label = scratch.table(components(found).withColumnRenamed("node", "id"))
        marked = scratch.table(shared.select("s", "id", "n", "pos", "low").join(label, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component"))
        smaller = F.expr("named_struct('n', a_n, 'id', a_id) < named_struct('n', b_n, 'id', b_id)")
        rest = _named(marked.where("low"), "a").join(_named(marked, "b"), "s").where(smaller & (F.col("a_c") != F.col("b_c")) & _room(similarity))
        rest = scratch.table(rest.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct())
        more = _similar(scratch, rest, each, rows, words, similarity)
        of = nodes.join(label, "id", "left").select("id", "content", F.coalesce("component", "id").alias("component"))
        if not more.isEmpty():  # links between components
            ends = [of.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}")) for x in "ab"]
            joined = more.join(ends[0], "a").join(ends[1], "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct()
            merged = components(joined).select(F.col("node").alias("component"), F.col("component").alias("merged"))
            of = of.join(merged, "component", "left").select("id", "content", F.coalesce("merged", "component").alias("component"))
        return scratch.result(each.select("doc_id", "own_id", "content").join(of.select("content", "component"), "content").select("doc_id", "own_id", "component"))


def keep_one_per_group(documents: DataFrame, words: int = 5, similarity: float = 0.8, distance: int = NEAR) -> DataFrame:
    """The rows of documents, columns as they are, without all but one of each group of near duplicates: its least doc_id stays, a null one before others.

    Of rows that share the least doc_id, or are equal, one stays.
    """
    return without_rows(documents, lambda rows: _near(rows, words, similarity, distance).where("doc_id <> component"))
