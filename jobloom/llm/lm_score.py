"""Scoring of texts by a log-bilinear language model trained with noise-contrastive estimation.

Counts of all training tokens come from one Spark aggregation. The model has `slots` outputs: the end of a text, a word
never seen in training, the most frequent words one each, and a quarter of the slots for all other words, dealt by a hash of
their last ENDING bytes; so every word has a vector, as a target and as a context, and words that end alike share one. The softmax is split into classes of SPAN slots (about the root of their number), so that a
normalised probability takes two small batched matrix products instead of one over all slots. A word that shares its slot
gets the slot's probability times its smoothed share among the slot's words. The result is mixed with the smoothed
frequencies (MIX); it sums to one over the known tokens and one unknown.

Every task trains on all training texts of its input, from the same start; the noise is drawn once a batch and, for the
slots, once a class, so that it takes matrix products as well. The parameters are averaged, weighted by tokens.

For scoring, texts are dealt into buckets of about BUCKET_BYTES. The distinct rarer words of each bucket go as packed
messages to shards of the counts and come back with them, and each bucket is scored beside its own counts; counts of the
frequent words are sent with the model. Nothing that grows with the vocabulary is broadcast.

Words are told apart by 64-bit hashes, TAIL bits of which follow from the ending: among 10**9 different words about 0.03 pairs
are expected to meet if endings are many, among 10**10 about three, and their counts would then be added up.

Edge cases: null and empty texts are the end token alone; a null id counts as the id ""; repeated rows are scored each;
without training texts all counts are 0 (N = V = 0) and the score is the smoothed frequency of an unknown token;
very long texts are learned from and scored in a slice of their own, about 400 bytes a token; an empty table gives no rows.
Other columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .words import SPACED, Words, crc_mod, joined, mix, packed, raw_bytes, stored, text_slices

SLOTS, SPAN, DIM, PLACES = 4096, 64, 16, 3
END, UNKNOWN = 0, 1
MIX, CLASS_NOISE, SLOT_NOISE, BATCH, RATE, CALM = 0.1, 64, 16, 8192, 0.2, 0.05
BUCKET_BYTES, SHARD_WORDS = 8 << 20, 500_000
TAIL, ENDING = 12, 3  # low bits of a hash, bytes of a word
END_HASH = np.uint64(0)  # no word has it


def token_hashes(words: Words) -> np.ndarray:
    """A hash of each distinct word whose low TAIL bits follow from its ending alone, so that rarer words that end alike share
    a slot: that tells what kind of word, and of which language, it is."""
    data, off = raw_bytes(words.unique)
    data, tail = np.concatenate([np.zeros(ENDING, np.uint8), data]), np.zeros(len(off) - 1, np.uint64)
    for k in range(ENDING, 0, -1):
        at = off[1:] - k
        tail = (tail << np.uint64(8)) | np.where(at >= off[:-1], data[at + ENDING], 0).astype(np.uint64)
    low = np.uint64((1 << TAIL) - 1)
    return np.maximum((words.hashes_of_unique() & ~low) | (mix(tail) & low), np.uint64(1))


def hashed(slots: int) -> int:
    """How many of the slots are for words dealt by hash."""
    return slots // 4


@dataclass
class Model:
    """q: context vectors; c: a weight per context place and dimension; u, a: classes; v, b: slots."""

    q: np.ndarray
    c: np.ndarray
    u: np.ndarray
    a: np.ndarray
    v: np.ndarray
    b: np.ndarray

    NAMES = ("q", "c", "u", "a", "v", "b")

    @classmethod
    def start(cls, counts: np.ndarray) -> Model:
        """Small random vectors, and biases that alone give the frequencies; unused slots are shut."""
        rng, slots = np.random.default_rng(7), len(counts)
        share = counts / max(1, counts.sum())
        by_class = share.reshape(-1, SPAN).sum(axis=1)
        log = lambda x: np.where(x > 0, np.log(np.maximum(x, 1e-12)), -30)
        small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        v = small(slots, DIM)
        v[UNKNOWN] = 0  # training has none of it
        return cls(small(slots, DIM), np.ones((PLACES, DIM), np.float32), small(slots // SPAN, DIM), log(by_class).astype(np.float32), v, log(share / np.maximum(np.repeat(by_class, SPAN), 1e-12)).astype(np.float32))

    def pack(self) -> np.ndarray:
        """All parameters as rows of DIM numbers; the last row is filled up."""
        flat = np.concatenate([getattr(self, n).ravel() for n in self.NAMES])
        return np.append(flat, np.zeros(-len(flat) % DIM, np.float32)).reshape(-1, DIM)

    @classmethod
    def unpack(cls, flat: np.ndarray, like: Model) -> Model:
        parts, at = [], 0
        for n in cls.NAMES:
            x = getattr(like, n)
            parts.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return cls(*parts)

    def context(self, before: np.ndarray) -> np.ndarray:
        return sum(self.q.take(before[:, j], axis=0) * self.c[j] for j in range(PLACES))

    def log_probs(self, slot: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Natural log of the model's probability of each slot after the slots before it."""
        cls = (slot // SPAN).astype(np.uint16)
        order = np.argsort(cls, kind="stable")
        slot, bounds = slot.take(order), np.searchsorted(cls.take(order), np.arange(len(self.a) + 1))
        r = np.column_stack([self.context(before.take(order, axis=0)), np.ones(len(slot), np.float32)])
        u, v, found = np.column_stack([self.u, self.a]).T.copy(), np.column_stack([self.v, self.b]), np.zeros(len(slot), np.float32)
        for k in range(len(self.a)):
            w = v[k * SPAN : (k + 1) * SPAN].T.copy()
            for lo in range(bounds[k], bounds[k + 1], 1 << 13):
                hi = min(lo + (1 << 13), bounds[k + 1])
                s, t = r[lo:hi] @ u, r[lo:hi] @ w
                found[lo:hi] = s[:, k] + t[np.arange(hi - lo), slot[lo:hi] - k * SPAN]
                found[lo:hi] -= _log_sum(s) + _log_sum(t)
        out = np.empty_like(found)
        out[order] = found
        return out


def _log_sum(x: np.ndarray) -> np.ndarray:
    """The log of the sum of exponentials of each row; x is used up. Rows with large numbers are worked out with care."""
    top = np.float32(0) if x.max(initial=0) < 60 else x.max(axis=1)
    if np.ndim(top):
        x -= top[:, None]
    return top + np.log(np.maximum(np.exp(x, out=x).sum(axis=1), np.float32(1e-37)))


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct row numbers, sums of their values)."""
    order = np.argsort(rows.astype(np.uint16) if len(rows) and rows.max() < 1 << 16 else rows, kind="stable")
    sorted_ = rows[order]
    begin = np.flatnonzero(np.diff(sorted_, prepend=-1))
    return sorted_[begin], np.add.reduceat(values.take(order, axis=0), begin, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.clip(x, -30, 30, out=x)
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive estimation with per-parameter step sizes; classes and slots within a class apart."""

    def __init__(self, counts: np.ndarray, seed: int = 0):
        self.m, self.rng, self.seen = Model.start(counts), np.random.default_rng(seed), 0
        share = np.maximum(counts, 0) / max(1, counts.sum())
        self.p_class = share.reshape(-1, SPAN).sum(axis=1)
        within = share.reshape(-1, SPAN) / np.maximum(self.p_class[:, None], 1e-12)
        log = lambda p: np.log(np.maximum(p, 1e-12)).astype(np.float32)
        self.class_upto, self.slot_upto = np.cumsum(self.p_class), np.cumsum(within, axis=1)
        self.line = (np.arange(len(within))[:, None] + np.minimum(self.slot_upto / np.maximum(self.slot_upto[:, -1:], 1e-12), 1)).ravel()  # all classes on one line
        self.log_class, self.log_slot = log(CLASS_NOISE * self.p_class), log(SLOT_NOISE * within.ravel())
        self.sums = {n: np.full_like(getattr(self.m, n), CALM) for n in Model.NAMES}

    def step(self, name: str, rows: np.ndarray, g: np.ndarray) -> None:
        """A step against the gradients of some rows (each once)."""
        seen, x = self.sums[name], getattr(self.m, name)
        own = seen[rows] + g * g
        seen[rows] = own
        x[rows] -= RATE * g / np.sqrt(own)

    def learn(self, slot: np.ndarray, before: np.ndarray) -> None:
        m, n, rng = self.m, len(slot), self.rng
        self.seen += n
        scale = np.float32(32 / n)
        order = np.argsort((slot // SPAN).astype(np.uint16), kind="stable")
        slot, before = slot.take(order), before.take(order, axis=0)
        cls = slot // SPAN
        first = np.flatnonzero(np.diff(cls, prepend=-1))
        ends = np.append(first[1:], n)
        qs = [m.q.take(before[:, j], axis=0) for j in range(PLACES)]
        r = sum(q * m.c[j] for j, q in enumerate(qs))
        # Classes: the true one, and noise that all tokens of the batch share.
        drawn = np.minimum(np.searchsorted(self.class_upto, rng.random(CLASS_NOISE) * self.class_upto[-1], "right"), len(m.a) - 1)
        noise = _sigmoid(r @ m.u[drawn].T + (m.a[drawn] - self.log_class[drawn]))
        noise *= scale
        own = m.u.take(cls, axis=0)
        true = (_sigmoid(np.einsum("nd,nd->n", r, own) + (m.a[cls] - self.log_class[cls])) - 1) * scale
        gr = noise @ m.u[drawn] + true[:, None] * own
        gu = (np.concatenate([cls[first], drawn]), np.concatenate([np.add.reduceat(true[:, None] * r, first, axis=0), noise.T @ r]))
        ga = (gu[0], np.concatenate([np.add.reduceat(true, first), noise.sum(axis=0)]))
        # Slots: the true one, and noise of its class that all tokens of the class share.
        some = np.searchsorted(self.line, cls[first][:, None] + rng.random((len(first), SLOT_NOISE)), "right")
        some = np.minimum(some, cls[first][:, None] * SPAN + SPAN - 1)
        ws, bias = m.v[some], m.b[some] - self.log_slot[some]
        grads = np.empty((*some.shape, DIM + 1), np.float32)
        for k, (lo, hi) in enumerate(zip(first.tolist(), ends.tolist())):
            part = r[lo:hi]
            g = part @ ws[k].T
            g += bias[k]
            g = _sigmoid(g)
            g *= scale
            gr[lo:hi] += g @ ws[k]
            grads[k, :, :-1] = g.T @ part
            grads[k, :, -1] = g.sum(axis=0)
        own = m.v.take(slot, axis=0)
        true = (_sigmoid(np.einsum("nd,nd->n", r, own) + (m.b[slot] - self.log_slot[slot])) - 1) * scale
        gr += true[:, None] * own
        at = np.concatenate([slot, some.ravel()])
        gv = np.concatenate([np.column_stack([true[:, None] * r, true]), grads.reshape(-1, DIM + 1)])
        gc = np.stack([np.einsum("nd,nd->d", gr, q) for q in qs])
        gq = _sums(before.T.ravel(), np.concatenate([gr * m.c[j] for j in range(PLACES)]))
        at, gv = _sums(at, gv)
        self.step("u", *_sums(*gu))
        self.step("a", *_sums(*ga))
        self.step("v", at, gv[:, :-1])
        self.step("b", at, gv[:, -1])
        self.step("q", *gq)
        self.step("c", np.arange(PLACES), gc)


class Lookup:
    """Slots of token hashes: the frequent words from 2 on, all others by hash among the last slots."""

    def __init__(self, hashes: np.ndarray, slots: int):
        order = np.argsort(hashes)
        self.h, self.slot, self.first, self.mask = hashes[order], order + 2, slots - hashed(slots), np.uint64(hashed(slots) - 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        other = self.first + (h & self.mask).astype(np.int64)
        if not len(self.h):
            return other
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.slot[at], other)


def with_ends(values: np.ndarray, splits: np.ndarray, end) -> np.ndarray:
    """One value behind each text."""
    return np.insert(values, splits[1:], end)


def contexts(slot: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The slots before each token, the nearest first; ends stand before a text. ends: places of the end tokens."""
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(slot)) - np.repeat(starts, ends + 1 - starts)
    out = np.full((len(slot), PLACES), END, np.int64)
    for j in range(PLACES):
        on = np.flatnonzero(place > j)
        out[on, j] = slot[on - j - 1]
    return out


def token_counts(docs: DataFrame) -> DataFrame:
    """(h, n) of every training token of docs (doc_id, text, held_out); the end token has h = 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in text_slices(batches, limit=16 << 20):
            text = text.filter(pa.array(~batch.column("held_out").to_numpy(zero_copy_only=False)))
            if not len(text):
                continue
            words = Words(text, SPACED)
            h, n = np.unique(token_hashes(words), return_inverse=True)
            n = np.bincount(n[words.codes], minlength=len(h))
            h, n = np.append(h, END_HASH)[: len(h) + 1], np.append(n, len(text))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return docs.mapInArrow(run, "h long, n long").where("n > 0").groupBy("h").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """hashes, counts: of the frequent words; slot_counts: smoothed counts of each slot; mass: what the smoothed counts of the words
    of each hashed slot add up to; ends, tokens, types: of the training texts."""

    hashes: np.ndarray
    counts: np.ndarray
    slot_counts: np.ndarray
    mass: np.ndarray
    ends: int
    tokens: int
    types: int

    @classmethod
    def of(cls, counts: DataFrame, slots: int) -> Vocabulary:
        """Three collects of bounded size: sums, the frequent words, a row for each hashed slot."""
        tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        ends = counts.where("h = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        k = hashed(slots)
        top = counts.where("h <> 0").orderBy(F.desc("n"), "h").limit(slots - k - 2).collect()
        rest = counts.where("h <> 0").groupBy(F.col("h").bitwiseAND(F.lit(k - 1)).alias("s")).agg(F.sum("n"), F.count(F.lit(1))).collect()
        h, n = np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([r[1] for r in top], np.int64)
        every, kinds = np.zeros(k), np.zeros(k)
        for s, total, distinct in rest:
            every[s], kinds[s] = total, distinct
        own = (h & np.uint64(k - 1)).astype(np.int64)
        every, kinds = every - np.bincount(own, n, k), kinds - np.bincount(own, minlength=k)
        slot_counts = np.zeros(slots)
        slot_counts[END], slot_counts[UNKNOWN], slot_counts[2 : 2 + len(h)], slot_counts[slots - k :] = ends + (ends > 0), 1, n + 1, every + kinds  # smoothed
        return cls(h, n, slot_counts, np.maximum(every + kinds, 1), ends, tokens, types)

    def look(self) -> Lookup:
        return Lookup(self.hashes, len(self.slot_counts))

    def mixed(self, logs: np.ndarray, slot: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Natural log of the probability of tokens from that of their slots; c: counts of the tokens."""
        base = np.log((c + 1) / (self.tokens + self.types + 1))
        if not self.tokens:
            return base
        shared = slot - (len(self.slot_counts) - len(self.mass))
        logs = logs + np.where(shared >= 0, np.log((c + 1) / self.mass[np.maximum(shared, 0)]), 0)
        return np.logaddexp(logs + math.log(1 - MIX), base + math.log(MIX))


def train(docs: DataFrame, vocabulary: Vocabulary) -> Model:
    """The average of the models that the tasks have trained on their training texts."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, trainer = sent.value.look(), Trainer(sent.value.slot_counts)
        for batch, text in text_slices(batches):
            text = text.filter(pa.array(~batch.column("held_out").to_numpy(zero_copy_only=False)))
            if not len(text):
                continue
            words = Words(text, SPACED)
            slot = with_ends(look(token_hashes(words))[words.codes], words.splits, END)
            before = contexts(slot, words.splits[1:] + np.arange(len(text)))
            batches_ = -(-len(slot) // BATCH)
            for k in range(batches_):  # each takes tokens from all over the slice
                trainer.learn(slot[k::batches_], before[k::batches_])
        if trainer.seen:
            flat = trainer.m.pack()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(np.full(len(flat), float(trainer.seen))), pa.FixedSizeListArray.from_arrays(pa.array((flat * np.float32(trainer.seen)).ravel()), DIM).cast(pa.list_(pa.float32()))], names=["part", "weight", "sums"])

    tasks = docs.mapInArrow(run, "part long, weight double, sums array<float>")
    means = tasks.groupBy("part").agg(*[(F.sum(F.col("sums")[d]) / F.sum("weight")).alias(f"d{d}") for d in range(DIM)])
    like, found = Model.start(vocabulary.slot_counts), means.orderBy("part").toArrow()  # a fixed number of rows: the model
    return Model.unpack(np.column_stack([found[f"d{d}"].to_numpy() for d in range(DIM)]).ravel(), like) if found.num_rows else like


def lm_score(docs: DataFrame, held_out: str = "held_out", bucket_bytes: int = BUCKET_BYTES, slots: int = SLOTS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for docs (doc_id, text, held_out).

    slots: a power of two, 4 * SPAN at least; more of them tell more words apart and cost time with their root.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col(held_out).alias("held_out"))
    counts = stored(token_counts(docs), "token-counts")
    vocabulary = Vocabulary.of(counts, slots)
    model = train(docs, vocabulary)

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    shards = max(1, -(-vocabulary.types // SHARD_WORDS), buckets // 4)
    dealt = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)))
    sent = spark.sparkContext.broadcast((model, vocabulary))

    def distinct(group: pa.Table) -> pa.Table:
        """The different rarer words of a bucket, packed for each shard."""
        h = [np.zeros(0, np.uint64)]
        look = sent.value[1].look()
        for _, text in text_slices(group.to_batches()):
            h.append(np.unique(token_hashes(Words(text, SPACED))))
        h = np.unique(np.concatenate(h))
        h = h[look(h) >= look.first]
        shard = ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = [(k, packed(h[order[cuts[k] : cuts[k + 1]]])) for k in np.flatnonzero(np.diff(cuts)).tolist()]
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([group["bucket"][0].as_py()] * len(rows), pa.int64()), "data": pa.array([r[1] for r in rows], pa.binary())})

    def counted(asked: pa.Table, have: pa.Table) -> pa.Table:
        """The asked words of a shard with their counts, packed for each bucket; unknown words are left out."""
        h, n = have["h"].to_numpy().view(np.uint64), have["n"].to_numpy()
        order = np.argsort(h)
        h, n, data = h[order], n[order], []
        for blob in asked["data"].to_pylist():
            (own,) = joined([blob], "<u8")
            at = np.minimum(np.searchsorted(h, own), max(0, len(h) - 1))
            ok = h[at] == own if len(h) else np.zeros(len(own), bool)
            data.append(packed(own[ok], n[at[ok]]))
        return pa.table({"bucket": asked["bucket"], "data": pa.array(data, pa.binary())})

    asked = dealt.groupBy("bucket").applyInArrow(distinct, "shard long, bucket long, data binary")
    shard = F.pmod(F.shiftrightunsigned("h", 32), F.lit(shards)).alias("shard")
    known = asked.groupBy("shard").cogroup(counts.where("h <> 0").select(shard, "h", "n").groupBy("shard")).applyInArrow(counted, "bucket long, data binary")

    def score(group: pa.Table, have: pa.Table) -> pa.Table:
        model, vocabulary = sent.value
        look = vocabulary.look()
        h, n = joined(have["data"].to_pylist(), "<u8", "<i8")
        h, n = np.append(h, vocabulary.hashes), np.append(n, vocabulary.counts)
        order = np.argsort(h)
        h, n = np.append(h[order], np.uint64(2**64 - 1)), np.append(n[order], 0)
        out = []
        for batch, text in text_slices(group.to_batches(), limit=2 << 20):
            words = Words(text, SPACED)
            mine = token_hashes(words)
            at = np.searchsorted(h, mine)
            c = with_ends(np.where(h[at] == mine, n[at], 0)[words.codes], words.splits, vocabulary.ends)
            ends_at = words.splits[1:] + np.arange(len(text))
            slot = with_ends(look(mine)[words.codes], words.splits, END)
            before, slot = contexts(slot, ends_at), np.where(c > 0, slot, UNKNOWN)
            logs = vocabulary.mixed(model.log_probs(slot, before).astype(float), slot, c)
            base = np.log((c + 1) / (vocabulary.tokens + vocabulary.types + 1))
            starts = np.concatenate([[0], ends_at[:-1] + 1])
            total = lambda x: np.add.reduceat(x, starts)
            out.append(pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(words.counts + 1), pa.array(total((c > 0).astype(np.int64))), pa.array(np.full(len(text), vocabulary.tokens)), pa.array(total(base) / math.log(10)), pa.array(total(logs) / math.log(10))], names=NAMES))
        return pa.Table.from_batches(out, SCHEMA)

    return dealt.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
SCHEMA = pa.schema(list(zip(NAMES, [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()])))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lm_score(docs.select("doc_id", "text", (crc_mod("doc_id", 7) == 2).alias("held_out")))
