"""A gated recurrent language model in numpy that scores whole documents.

Tokens are words and one end per document. The output softmax is factored by class: a hidden state
predicts the class, then the word within it. Classes of frequent words have weights per word. All other
words fall into tail classes by their endings; the state predicts the tail class, within which a word has its
smoothed share of the class's training tokens. Training is truncated backpropagation through time over every
training document: documents are dealt into shards of a fixed number of tokens by their contents, each
shard trains from the common weights, and the shards' weights are averaged.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, bounded, pieces, texts

#: Frequent words with weights of their own, words of a class, tail classes, hidden units, and the steps of one window.
VOCABULARY, CLASS, TAIL, HIDDEN, STEPS = 1024, 32, 64, 16, 32
#: Most frequent words whose counts are sent to every worker; counts of others are joined.
LOCAL = 150_000
#: Documents side by side in one batch, and learning rate.
LANES, RATE, FIRST_SQUARE = 256, 0.1, 1e-7
#: Tokens that a shard trains on between two averages, and averages; tokens that are laid out in lanes at a time.
SHARD, ROUNDS, PIECE = 1 << 22, 2, 1 << 22
#: Vectors of weights that reach the driver at once.
SUMS = 16
END = b"\n"
SMOOTH = 0.1


def training(modulus: int = 10) -> Column:
    return ~held_out(modulus)


def held_out(modulus: int = 10) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0, F.lit(False))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split() + [END]


def tail_of(word: bytes, tail: int) -> int:
    """The tail class of a word: by its last two bytes, so that unseen words have one too."""
    return zlib.crc32(word[-2:]) % tail


def word_counts(rows: DataFrame) -> DataFrame:
    """word (binary), c: counts of all tokens of rows.text. Each task sums up batches first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
            counts.clear()
            return out

        for batch in pieces(batches, "text"):
            for text in batch.column("text"):
                counts.update(words_of(text.as_buffer().to_pybytes()))
            if len(counts) > 300_000:
                yield flush()
        if counts:
            yield flush()

    bounded(rows.sparkSession)
    return rows.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _exponents(x: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of the softmax at each row's chosen column, and the rows' totals; x becomes its exponents. Rows are shifted only where they would overflow or vanish."""
    rows = np.arange(len(x))
    if x.size and not -80 < x[rows, chosen].min() <= x.max() < 80:
        x -= x.max(axis=1, keepdims=True)
    out = x[rows, chosen]
    np.exp(x, out=x)
    total = x @ np.ones((x.shape[1], 1), x.dtype)
    return out - np.log(total[:, 0]), total


class Model:
    """Weights by name. Input embeddings are already multiplied into the gates: update and reset in e_zr, the candidate in e_n.

    Ids 0 to v - 1 are the frequent words, v to v + tail - 1 the tail classes, and v + tail is the start of a document.
    """

    def __init__(self, counts: np.ndarray, tail_mass: np.ndarray, seed: int = 3, hidden: int = HIDDEN):
        """counts: of the frequent words, most frequent first; tail_mass: smoothed counts of each tail class."""
        self.v, self.tail, self.h, self.k = len(counts), len(tail_mass), hidden, max(1, -(-len(counts) // CLASS))
        self.start = self.v + self.tail
        rng = np.random.default_rng(seed)
        # classes are slices of the words sorted by frequency, then the tail classes
        self.class_of = np.concatenate([np.arange(self.v) // CLASS, self.k + np.arange(self.tail)]).astype(np.int16)
        mass = np.concatenate([np.bincount(self.class_of[: self.v], weights=counts, minlength=self.k), tail_mass])
        size = self.k * CLASS
        bias = np.full(size, -30.0)
        bias[: self.v] = np.log((counts + 1.0) / (np.repeat(np.maximum.reduceat(counts, np.arange(0, self.v, CLASS)), CLASS)[: self.v] + 1.0)) if self.v else 0
        self.w = {
            "e_zr": rng.normal(0, 0.1, (self.start + 1, 2 * hidden)),
            "e_n": rng.normal(0, 0.1, (self.start + 1, hidden)),
            "u_zr": rng.normal(0, hidden**-0.5, (hidden, 2 * hidden)),
            "u_n": rng.normal(0, hidden**-0.5, (hidden, hidden)),
            "class_w": rng.normal(0, 0.05, (hidden, self.k + self.tail)),
            "class_b": np.log(np.maximum(mass / max(mass.sum(), 1e-9), 1e-9)),
            "word_w": rng.normal(0, 0.05, (size, hidden)),
            "word_b": bias,
        }
        self.w = {k: x.astype(np.float32) for k, x in self.w.items()}

    def copy(self) -> Model:
        own = Model.__new__(Model)
        own.__dict__ |= self.__dict__ | {"w": {k: x.copy() for k, x in self.w.items()}}
        return own

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.w.values()])

    def shaped(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, x in self.w.items():
            out[k], at = flat[at : at + x.size].reshape(x.shape).astype(np.float32), at + x.size
        return out

    def forward(self, inputs: np.ndarray, state: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, dict]:
        """States after each of the steps (T, B, h) of word ids (T, B), from `state` (B, h), or zero where a document begins."""
        steps, lanes = inputs.shape
        h, u_zr, u_n = self.h, self.w["u_zr"], self.w["u_n"]
        out, before, kept = (np.empty((steps, lanes, h), np.float32) for _ in range(3))
        begins = fresh.any(axis=1)
        gates, candidates = self.w["e_zr"][inputs], self.w["e_n"][inputs]
        for t in range(steps):
            now, zr, n = before[t], gates[t], candidates[t]
            now[...] = out[t - 1] if t else state
            if begins[t]:
                now[fresh[t]] = 0
            zr += now @ u_zr
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.matmul(now, u_n, out=kept[t])
            n += zr[:, h:] * kept[t]
            np.tanh(n, out=n)
            out[t] = n + zr[:, :h] * (now - n)
        return out, {"gates": gates, "candidates": candidates, "kept": kept, "before": before}

    def output(self, hidden: np.ndarray, target: np.ndarray, grad: bool = False):
        """log P of each target (n,) from hidden states (n, h), a tail word as its class; and gradients if asked."""
        n, klass = len(target), self.class_of[target]
        logits = hidden @ self.w["class_w"] + self.w["class_b"]
        rows = np.arange(n)
        score, total = _exponents(logits, klass)
        grads, back = {}, None
        if grad:
            logits /= total
            logits[rows, klass] -= 1
            grads = {"class_w": hidden.T @ logits, "class_b": logits.sum(axis=0), "word_w": np.zeros_like(self.w["word_w"]), "word_b": np.zeros_like(self.w["word_b"])}
            back = logits @ self.w["class_w"].T
        order = np.argsort(klass, kind="stable")
        cuts = np.searchsorted(klass[order], np.arange(self.k + 1))
        for c in range(self.k):
            some = order[cuts[c] : cuts[c + 1]]
            if not len(some):
                continue
            at = slice(c * CLASS, (c + 1) * CLASS)
            own_hidden = hidden[some]
            x = own_hidden @ self.w["word_w"][at].T + self.w["word_b"][at]
            inner, own = target[some] - c * CLASS, np.arange(len(some))
            chosen, total = _exponents(x, inner)
            score[some] += chosen
            if grad:
                x /= total
                x[own, inner] -= 1
                grads["word_w"][at] = x.T @ own_hidden
                grads["word_b"][at] = x.sum(axis=0)
                back[some] += x @ self.w["word_w"][at]
        return (score, grads, back) if grad else score

    def step(self, inputs: np.ndarray, targets: np.ndarray, valid: np.ndarray, fresh: np.ndarray, state: np.ndarray, moment: dict) -> np.ndarray:
        """One window of truncated backpropagation with Adagrad; returns the last state, through which no gradient goes on."""
        steps, lanes = inputs.shape
        h, u_zr_t, u_n_t = self.h, np.ascontiguousarray(self.w["u_zr"].T), np.ascontiguousarray(self.w["u_n"].T)
        out, seen = self.forward(inputs, state, fresh)
        flat = np.flatnonzero(valid.ravel())
        if not len(flat):
            return out[-1]
        _, grads, back = self.output(out.reshape(-1, h)[flat], targets.ravel()[flat], grad=True)
        d_out = np.zeros((steps * lanes, h), np.float32)
        d_out[flat] = back
        d_out = d_out.reshape(steps, lanes, h)
        d_zr, d_n, d_kept = np.empty((steps, lanes, 2 * h), np.float32), np.empty_like(d_out), np.empty_like(d_out)
        before, gates, n_all = seen["before"], seen["gates"], seen["candidates"]
        # what each step multiplies the coming gradient with, for all steps at once
        z, r = gates[:, :, :h], gates[:, :, h:]
        to_n = (1 - z) * (1 - n_all * n_all)
        to_z = (before - n_all) * z * (1 - z)
        to_r = seen["kept"] * r * (1 - r)
        begins, carry = fresh.any(axis=1), np.zeros((lanes, h), np.float32)
        for t in range(steps - 1, -1, -1):
            carry += d_out[t]
            np.multiply(carry, to_n[t], out=d_n[t])
            np.multiply(carry, to_z[t], out=d_zr[t, :, :h])
            np.multiply(d_n[t], to_r[t], out=d_zr[t, :, h:])
            np.multiply(d_n[t], r[t], out=d_kept[t])
            carry = carry * z[t] + d_zr[t] @ u_zr_t + d_kept[t] @ u_n_t
            if begins[t]:
                carry[fresh[t]] = 0
        past = before.reshape(-1, h).T
        grads["u_zr"], grads["u_n"] = past @ d_zr.reshape(-1, 2 * h), past @ d_kept.reshape(-1, h)
        scale = 1 / len(flat)
        for k, x in grads.items():
            x *= scale
            np.clip(x, -0.5, 0.5, out=x)
            moment[k] += x * x
            self.w[k] -= (RATE / 10 if k.endswith("_b") else RATE) * x / np.sqrt(moment[k])  # biases start at the counts' logarithms
        # embeddings: only the rows of this window's words
        where = inputs.ravel()
        order = np.argsort(where, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(where[order]) > 0]))
        words = where[order][first]
        for k, d in (("e_zr", d_zr.reshape(-1, 2 * h)), ("e_n", d_n.reshape(-1, h))):
            x = np.add.reduceat(d[order], first, axis=0) * scale
            moment[k][words] += x * x
            self.w[k][words] -= RATE * x / np.sqrt(moment[k][words])
        return out[-1]


def lanes_of(documents: list[np.ndarray], start: int, lanes: int = LANES, steps: int = STEPS) -> Iterator[tuple]:
    """Windows (inputs, targets, doc, fresh) over documents laid end to end in parallel lanes.

    `start` is the input before a document's first word. doc is each target's document, -1 past a lane's
    end; fresh marks the inputs that begin a document, before which the state is zero. Lanes are filled
    longest document first, so that they end at about the same step; windows get narrower as lanes end.
    """
    lanes = max(1, min(lanes, len(documents)))
    rows: list[list[int]] = [[] for _ in range(lanes)]
    loads = [(0, i) for i in range(lanes)]
    for i in sorted(range(len(documents)), key=lambda i: -len(documents[i])):
        load, lane = loads[0]
        rows[lane].append(i)
        heapq.heapreplace(loads, (load + len(documents[i]), lane))
    load = np.zeros(lanes, np.int64)
    for x, lane in loads:
        load[lane] = x
    order = np.argsort(-load, kind="stable")
    length = int(load.max(initial=0))
    targets, doc = np.zeros((length, lanes), np.int16), np.full((length, lanes), -1, np.int32)
    inputs, fresh = np.zeros((length, lanes), np.int16), np.zeros((length, lanes), bool)
    for column, lane in enumerate(order):
        at = 0
        for i in rows[lane]:
            x = documents[i]
            targets[at : at + len(x), column], doc[at : at + len(x), column] = x, i
            inputs[at, column], fresh[at, column] = start, True
            inputs[at + 1 : at + len(x), column] = x[:-1]
            at += len(x)
    active = (doc >= 0).sum(axis=1)
    for t in range(0, length, steps):
        width = int(active[t])
        yield inputs[t : t + steps, :width], targets[t : t + steps, :width], doc[t : t + steps, :width], fresh[t : t + steps, :width]


def _laid_out(batches: Iterator[pa.RecordBatch], by: str | None = None) -> Iterator[list[tuple]]:
    """Lists of rows (a dict a batch and an index) with about PIECE tokens of `ids`, one row at least; a list never spans two values of `by`."""
    held, size, key = [], 0, None
    for batch in batches:
        ids = batch.column("ids")
        lengths = np.diff(ids.offsets.to_numpy()) if len(ids) else []
        keys = batch.column(by).to_numpy() if by else np.zeros(batch.num_rows, np.int64)
        for i in range(batch.num_rows):
            if held and (size >= PIECE or keys[i] != key):
                yield held
                held, size = [], 0
            held.append((batch, i, ids[i].values.to_numpy()))
            size, key = size + int(lengths[i]), keys[i]
    if held:
        yield held


def train(scratch: Scratch, rows: DataFrame, model: Model, tokens: int, rounds: int = ROUNDS, shard: int = SHARD) -> Model:
    """The average of what shards of about `shard` tokens learn, `rounds` times; every document of rows (h, ids) is in one shard of one round.

    h, a hash of the document, says shard and round, so the result does not depend on partitions. The number of shards grows
    with the corpus, what one of them learns from does not. Weights leave a task as one binary vector a shard
    and are added up in SUMS tasks before the driver divides them.
    """
    spark = rows.sparkSession
    shards = max(1, -(-tokens // (rounds * shard)))
    moment = {k: np.full_like(x, FIRST_SQUARE) for k, x in model.w.items()}
    rows = rows.withColumn("shard", F.pmod("h", F.lit(shards))).withColumn("round", F.pmod(F.shiftright("h", 40), F.lit(rounds)))
    for part in range(rounds):
        sent = spark.sparkContext.broadcast((model, moment))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = moment = key = None

            def result():
                flat = np.concatenate([own.flat(), *(x.ravel() for x in moment.values())]).astype(np.float64) * seen
                return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([flat.tobytes()], pa.binary()), pa.array([seen], pa.int64())], ["shard", "x", "n"])

            for piece in _laid_out(batches, "shard"):
                now = piece[0][0].column("shard")[piece[0][1]].as_py()
                if now != key:
                    if own is not None:
                        yield result()
                    own, moment, key, seen = sent.value[0].copy(), {k: x.copy() for k, x in sent.value[1].items()}, now, 0
                state = None
                for inputs, targets, doc, fresh in lanes_of([x for _, _, x in piece], own.start):
                    width = inputs.shape[1]
                    state = np.zeros((width, own.h), np.float32) if state is None else state[:width]
                    state = own.step(inputs, targets, doc >= 0, fresh, state, moment)
                seen += sum(len(x) for _, _, x in piece)
            if own is not None:
                yield result()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n, some = 0.0, 0, False
            for batch in batches:
                for x, m in zip(batch.column("x"), batch.column("n").to_pylist(), strict=True):
                    total, n, some = total + np.frombuffer(x.as_buffer(), np.float64), n + m, True
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["x", "n"])

        learnt = rows.where(F.col("round") == part).select("shard", "h", "ids").repartition(shards, "shard").sortWithinPartitions("shard", "h", "ids")
        learnt = scratch.table(learnt.mapInArrow(run, "shard long, x binary, n long"))
        sums = learnt.withColumn("g", F.pmod("shard", F.lit(SUMS))).repartition(SUMS, "g").sortWithinPartitions("shard").select("x", "n").mapInArrow(add, "x binary, n long").collect()
        sent.unpersist()
        if sums:
            flat = sum(sorted((np.frombuffer(r["x"], np.float64) for r in sums), key=lambda x: x[0])) / sum(r["n"] for r in sums)
            model.w, moment = model.shaped(flat[: len(flat) // 2]), model.shaped(flat[len(flat) // 2 :])
    return model


def score_documents(documents: DataFrame, vocabulary: int = VOCABULARY, rounds: int = ROUNDS, tail: int = TAIL, shard: int = SHARD, hidden: int = HIDDEN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of documents.

    Learnt from the rows whose crc32(doc_id) mod 10 is not 0: counts of all their words, and weights from
    all their windows. score is log10 P of the whole text and its end; the state starts at zero with each
    document and is carried from window to window. The distribution is over the training words and an
    unknown word in each tail class; it sums to 1 after any words.

    A null or empty text is its end alone. Repeated rows and null doc_ids are scored like any other (a
    null id trains). Very long texts are read whole, their state carried through. Columns other than doc_id
    and text are not read. An empty table gives no rows; without training rows every word is unknown.
    """
    spark = bounded(documents.sparkSession)
    with Scratch(spark) as scratch:
        rows = texts(documents)
        counts = scratch.table(word_counts(rows.where(training())))
        groups = counts.groupBy(F.pmod(F.crc32(F.expr("substring(word, -2)")), F.lit(tail)).cast("int").alias("t")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
        total, distinct = sum(r["c"] for r in groups), sum(r["n"] for r in groups)
        top = counts.orderBy(F.desc("c"), "word").limit(max(LOCAL, vocabulary)).toArrow()
        top, local = top["word"].to_pylist(), top["c"].to_numpy().astype(np.float64)
        frequent = len(local[:vocabulary])
        in_tail, kinds = np.zeros(tail), np.zeros(tail)
        for r in groups:
            in_tail[r["t"]], kinds[r["t"]] = r["c"], r["n"]
        for word, c in zip(top[:frequent], local[:frequent], strict=True):
            t = tail_of(word, tail)
            in_tail[t], kinds[t] = in_tail[t] - c, kinds[t] - 1
        mass = in_tail + SMOOTH * (kinds + 1)
        known = {word: i for i, word in enumerate(top)}
        ids_of = np.array([i if i < frequent else frequent + tail_of(word, tail) for i, word in enumerate(top)], np.int16)
        model = Model(local[:vocabulary], mass, hidden=hidden)
        sent = spark.sparkContext.broadcast((known, ids_of, np.log10(local + SMOOTH), frequent))

        def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, ids_of, logs, frequent = sent.value
            many, crc32 = len(known), zlib.crc32
            for batch in pieces(batches, "text"):
                out = []
                for text in batch.column("text"):
                    words = words_of(text.as_buffer().to_pybytes())
                    rank = np.fromiter(map(known.get, words, repeat(many)), np.int32, len(words))
                    far = np.flatnonzero(rank == many)
                    near = rank[rank < many]
                    rare = [words[i] for i in far.tolist()]
                    ids = np.empty(len(words), np.int16)
                    ids[rank < many] = ids_of[near]
                    ids[far] = [frequent + crc32(w[-2:]) % tail for w in rare]
                    value = logs[near]
                    out.append((len(words), len(near), float(value.sum()), float(value[near >= frequent].sum()), rare, ids))
                n, some, base, inner, rare, ids = zip(*out, strict=True)
                ends, rare_ends = (np.cumsum([0, *map(len, x)], dtype=np.int32) for x in (ids, rare))
                columns = [batch.column(x) for x in ("row", "doc_id", "held_out", "h")] + [
                    pa.array(n, pa.int64()), pa.array(some, pa.int64()), pa.array(base, pa.float64()), pa.array(inner, pa.float64()),
                    pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), pa.array([w for x in rare for w in x], pa.binary())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "h", "n_tokens", "frequent", "base", "inner", "rare", "ids"])

        schema = "row long, doc_id long, held_out boolean, h long, n_tokens long, frequent long, base double, inner double, rare array<binary>, ids array<smallint>"
        h = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.coalesce(F.col("text").cast("string"), F.lit("")))
        read = scratch.table(texts(documents, held_out().alias("held_out"), h.alias("h"), F.monotonically_increasing_id().alias("row")).mapInArrow(identify, schema))
        model = train(scratch, read.where("NOT held_out").select("h", "ids"), model, total, rounds, shard)
        ready = spark.sparkContext.broadcast((model, np.log10(mass)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, norms = ready.value
            for piece in _laid_out(batches):
                found = [x for _, _, x in piece]
                score = np.zeros(len(found))
                state = None
                for inputs, targets, doc, fresh in lanes_of(found, model.start):
                    width = inputs.shape[1]
                    state = np.zeros((width, model.h), np.float32) if state is None else state[:width]
                    out, _ = model.forward(inputs, state, fresh)
                    state = out[-1]
                    flat = np.flatnonzero(doc.ravel() >= 0)
                    target = targets.ravel()[flat]
                    p = model.output(out.reshape(-1, model.h)[flat], target) / np.log(10)
                    far = target >= model.v
                    p[far] -= norms[target[far] - model.v]
                    score += np.bincount(doc.ravel()[flat], weights=p, minlength=len(found))
                yield pa.RecordBatch.from_arrays([pa.array([b.column("row")[i].as_py() for b, i, _ in piece], pa.int64()), pa.array(score)], ["row", "own"])

        own = read.select("row", "ids").mapInArrow(run, "row long, own double")
        rare = read.select("row", F.explode("rare").alias("word"))
        seen = rare.join(counts, "word", "left").groupBy("row").agg(
            F.count("c").alias("n"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))).alias("logs"),
        )
        whole = F.log10(F.lit(float(total + SMOOTH * (distinct + 1))))
        out = read.drop("rare", "ids", "h").join(own, "row").join(seen, "row", "left")
        logs = F.coalesce("logs", F.lit(0.0))
        return scratch.result(out.select(
            "doc_id", "held_out", "n_tokens", (F.col("frequent") + F.coalesce("n", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base") + logs - F.col("n_tokens") * whole).alias("base_score"), (F.col("own") + F.col("inner") + logs).alias("score"),
        ))
