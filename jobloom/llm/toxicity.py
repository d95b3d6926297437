"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text (each counts once): words, pairs of neighbours, pairs with one word between, and the first four
characters of a word (for spellings never seen in training), all as 64-bit hashes. Training runs in one task over a
bounded sample of labelled rows: at most `max_rows`, and at most `max_bytes` of text, chosen by a hash of the id; one row
for each id, that with the least hash of its text. A text that is longer than a LARGEST-th of max_bytes, or than what is left
of them when its turn comes, isn't learned from, and those behind it are. A feature takes part if MIN_DOCS training texts have it, so that
single texts can't be learned by heart; L1 leaves few weights (the bias is free of it), and only those are sent: at most
one for each feature of the sample.

Edge cases: null and empty texts score as the bias alone; a null id counts as the id ""; labels that are null are left
out, several labels of one id count as their maximum; very long texts are scored whole, in a slice of their own; without labels every score is 0 (not toxic). Texts that are
repeated score alike. Other columns of the input stay out of the features and keep their values, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .words import K1, SPACED, Words, crc_mod, inside, mix, stored, text_slices

MAX_ROWS, MAX_BYTES, LARGEST, MIN_DOCS = 12_000, 64 << 20, 16, 3
TRIM = b".,;:!?\"'()[]{}<>|*#$&%-_/"
EPOCHS, BLOCK, POSITIVE = 6, 32, 4.0
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.5
SIEVE_BITS = 22
PART_BITS = 4
BIAS = np.uint64(0)  # its place among the hashes


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash of the feature) for each occurrence of a feature."""
    words = Words(text, SPACED)
    unique = [w.strip(TRIM) for w in words.unique.cast(pa.binary()).to_pylist()]
    whole = np.fromiter(map(xxhash.xxh3_64_intdigest, unique), np.uint64, len(unique))[words.codes]
    head = np.fromiter((xxhash.xxh3_64_intdigest(w.decode("utf-8", "ignore")[:4].encode(), 7) for w in unique), np.uint64, len(unique))[words.codes]
    rows, n = words.rows(), len(words)
    found, owners = [whole, head], [rows, rows]
    for gap in (1, 2):
        ok = inside(words.splits, gap + 1, n)
        pair = mix(whole[: max(0, n - gap)] * K1 + whole[gap:] + np.uint64(gap))
        found.append(pair[ok])
        owners.append(rows[: len(ok)][ok])
    return np.concatenate(owners), np.concatenate(found)


def once(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, feature) once, by text."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """FTRL-proximal: z and n for each coordinate; the weight follows from them. The first one is the bias."""

    def __init__(self, size: int):
        self.z, self.n, self.l1 = np.zeros(size), np.zeros(size), np.full(size, L1)
        self.l1[:1] = 0

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n, l1 = self.z[at], self.n[at], self.l1[at]
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > l1, w, 0)

    def learn(self, rows: np.ndarray, places: np.ndarray, y: np.ndarray) -> None:
        """One step on a block of texts; rows: 0..len(y)-1, each with the place of the bias."""
        at, back = np.unique(places, return_inverse=True)
        w = self.weights(at)
        p = sigmoid(np.bincount(rows, w[back], len(y)))
        g = np.bincount(back, ((p - y) * np.where(y > 0, POSITIVE, 1.0))[rows], len(at))
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def frequent(blocks: list[np.ndarray]) -> np.ndarray:
    """The hashes that occur at least MIN_DOCS times, sorted, without that of the bias: a part of their range at a time, so
    that they never lie in memory twice."""
    found, bits = [], np.uint64(64 - PART_BITS)
    for part in range(1 << PART_BITS):
        every = np.concatenate([np.zeros(0, np.uint64), *[h[(h >> bits) == part] for h in blocks]])
        every.sort()
        if len(every) >= MIN_DOCS:
            found.append(np.unique(every[MIN_DOCS - 1 :][every[MIN_DOCS - 1 :] == every[: len(every) - MIN_DOCS + 1]]))
    often = np.concatenate([np.zeros(0, np.uint64), *found])
    return often[often > BIAS]


def train(texts: pa.Array, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sorted; weights) of the features with a weight; the bias always comes first."""
    blocks = []
    for start in range(0, len(y), BLOCK):
        rows, h = once(*features(texts.slice(start, BLOCK)))
        blocks.append((rows.astype(np.uint8), h))
    known = np.concatenate([[BIAS], frequent([h for _, h in blocks])])
    parts = []
    blocks.reverse()
    for start in range(0, len(y), BLOCK):
        rows, h = blocks.pop()  # let go one by one
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        keep, k = known[at] == h, min(BLOCK, len(y) - start)
        parts.append((np.concatenate([rows[keep], np.arange(k)]).astype(np.int32), np.concatenate([at[keep], np.zeros(k, np.int64)]).astype(np.int32), y[start : start + k]))
    model = Ftrl(len(known))
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(parts)):
            model.learn(*parts[k])
    w = model.weights()
    keep = (w != 0) | (known == BIAS)
    return known[keep], w[keep]


class Scorer:
    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        self.hashes, self.weights = hashes, weights
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[hashes[1:] >> np.uint64(64 - SIEVE_BITS)] = True

    def __call__(self, text: pa.Array) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(text))
        rows, h = features(text)
        likely = self.sieve[h >> np.uint64(64 - SIEVE_BITS)]
        rows, h = rows[likely], h[likely]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = (self.hashes[at] == h) & (at > 0)
        rows, at = once(rows[hit], at[hit])
        return sigmoid(np.bincount(rows, self.weights[at], len(text)) + self.weights[0])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, weights) of the non-zero weights, learned from labelled rows of `docs`, one for each id: at most max_rows
    of them, and as many as fit into max_bytes (those that don't fit are passed over)."""
    chosen = labels.where("toxic is not null and doc_id is not null").where(crc_mod("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("__y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows (id, label) pairs: a bounded side.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "__y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    rows = stored(rows.select("doc_id", F.col("least.text").alias("text"), "__y", F.lit(0).alias("__one")), "taught")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    lengths = rows.select("doc_id", size).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # max_rows pairs of numbers at most
    taken, room = [], max_bytes
    for doc, n in lengths:
        if n <= min(room, max_bytes // LARGEST):
            taken.append((doc,))
            room -= n
    fitting = docs.sparkSession.createDataFrame(taken, "doc_id long").select(F.col("doc_id").cast(rows.schema["doc_id"].dataType).alias("doc_id"))
    rows = rows.join(F.broadcast(fitting), "doc_id")

    def one(group: pa.Table) -> pa.Table:
        order = np.argsort(np.fromiter((xxhash.xxh3_64_intdigest(str(i)) for i in group["doc_id"].to_pylist()), np.uint64, group.num_rows), kind="stable")
        group = group.take(order)
        text, y = group["text"].combine_chunks().fill_null(""), group["__y"].to_numpy()
        del group  # one copy of the texts is enough
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        h, w = train(text, y)
        return pa.table({"hashes": pa.array([h.view(np.int64)], pa.list_(pa.int64())), "weights": pa.array([w], pa.list_(pa.float64()))})

    found = rows.groupBy("__one").applyInArrow(one, "hashes array<bigint>, weights array<double>").collect()
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0)
    return np.array(found[0][0], np.int64).view(np.uint64), np.array(found[0][1], float)


def score(docs: DataFrame, hashes: np.ndarray, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """`doc` (the columns `keep` of docs, in a struct, so that no name can clash) and `score` (0 to 1). Without a model all score 0."""
    sent = docs.sparkSession.sparkContext.broadcast((hashes, weights))
    whole = docs.select(F.struct(*keep).alias("doc"), *([] if "text" in keep else ["text"]))
    out = T.StructType([whole.schema["doc"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for batch in batches:
            doc, at = batch.column("doc"), 0
            text = doc.field("text") if "text" in keep else batch.column("text")
            for part, t in text_slices([pa.RecordBatch.from_arrays([text], names=["text"])]):
                yield pa.RecordBatch.from_arrays([doc.slice(at, part.num_rows), pa.array(scorer(t))], names=["doc", "score"])
                at += part.num_rows

    return whole.mapInArrow(run, out)


def scored(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """Fit on the labels, then score every text: `doc` (a struct of the columns `keep`, all by default) and `score`."""
    return score(docs, *fit(docs, labels, max_rows), keep or docs.columns)


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """As scored(), but flat: the columns `keep` less one named score, and `score`."""
    names = [c for c in keep or docs.columns if c != "score"]
    return scored(docs, labels, keep, max_rows).select(*[F.col("doc").getField(c).alias(c) for c in names], "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity(docs, labels, ["doc_id"])
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
