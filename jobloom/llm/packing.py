"""Packing: tokenised documents into windows of `size` ids by best-fit decreasing.

A document longer than a window is first cut into full windows. The remaining pieces, longest first, each go to the
open window with the least remaining capacity that still holds them; a segment tree over the capacities 0..size finds
it in log(size) steps. Spark deals the pieces (a few numbers each, no ids) by hash over shards; every shard packs its
own pieces, so padding grows by at most some windows a shard, and `per_shard` pieces fill a shard.

Edge cases: a null or empty text is the end id alone; a null id packs like any other row (its pieces carry the null);
repeated rows are packed once each; an empty table gives no rows. Other columns of the input are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .words import Words, stored, table, text_slices

SIZE, END_ID = 2048, 1
PER_SHARD = 100_000

#: Cut at ASCII white space only: the tokenizer drops white space and never joins ids across it.
BLANK = bytearray(range(256))
BLANK[9:14] = b" " * 5
BLANK = bytes(BLANK)

PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("__copy", pa.int64())])


class Encoder:
    """Ids of texts by a tokenizer file. The ids of a word are kept, by the word's hash, in arrays that a Python worker
    holds over all its tasks; only words not met before are encoded, many in one call with a mark between them."""

    MARK, PER_CALL, BLOCK, KEEP = "\0", 500, 20_000, 3_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.mark = self.tok.encode(self.MARK, add_special_tokens=False).ids[0]
        self.forget()

    def forget(self) -> None:
        self.hash, self.at, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, words: list[str], hashes: np.ndarray) -> None:
        """Encode words (none of them known) and keep their ids."""
        if any(self.MARK in w for w in words):
            each = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
            size, flat = np.array([len(e) for e in each], np.int64), np.concatenate(each)
        else:
            joined = [f" {self.MARK} ".join([*words[k : k + self.PER_CALL], ""]) for k in range(0, len(words), self.PER_CALL)]
            flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(joined, add_special_tokens=False)])
            marks = np.flatnonzero(flat == self.mark)
            size = np.diff(marks, prepend=-1) - 1
            flat = flat[flat != self.mark]
        order = np.argsort(hashes)
        at = len(self.flat) + np.cumsum(size) - size
        into = np.searchsorted(self.hash, hashes[order])
        self.hash, self.at, self.size = np.insert(self.hash, into, hashes[order]), np.insert(self.at, into, at[order]), np.insert(self.size, into, size[order])
        self.flat = np.concatenate([self.flat, flat])

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id; how many ids each text has)."""
        words = Words(text, BLANK)
        hashes = words.hashes_of_unique()
        if len(self.hash) > self.KEEP:
            self.forget()
        new = np.flatnonzero(~np.isin(hashes, self.hash, assume_unique=True)) if len(self.hash) else np.arange(len(hashes))
        for lo in range(0, len(new), self.BLOCK):
            part = new[lo : lo + self.BLOCK]
            self.learn(words.unique.take(pa.array(part)).to_pylist(), hashes[part])
        known = np.searchsorted(self.hash, hashes)
        at, n = self.at[known][words.codes] if len(hashes) else np.zeros(0, np.int64), self.size[known][words.codes] if len(hashes) else np.zeros(0, np.int64)
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(at - (ends - n), n) + np.arange(ends[-1])] if len(n) else np.zeros(0, np.uint32)
        total = np.concatenate([[0], ends])[words.splits]
        return np.insert(ids, total[1:], np.uint32(END_ID)), np.diff(total) + 1


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """Each document's ids cut at multiples of `size`: doc_id, start, length, ids_crc32, doc_tokens (and a row number)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, copy = encoder(path), 0
        for batch, text in text_slices(batches):
            ids, counts = encode(text)
            raw, at = ids.astype("<u4").tobytes(), np.cumsum(counts) - counts
            parts = -(-counts // size)
            row = np.repeat(np.arange(len(counts)), parts)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * size
            length = np.minimum(counts[row] - start, size)
            first = (at[row] + start) * 4
            crc = [zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(first.tolist(), length.tolist())]
            yield table(PIECE, doc_id=batch.column("doc_id").take(pa.array(row)), start=start, length=length, ids_crc32=crc, doc_tokens=counts[row], __copy=row + copy)
            copy += len(counts)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, __copy long")


class Windows:
    """Open windows by remaining capacity: a segment tree of counts, and for each capacity the windows that have it."""

    def __init__(self, size: int):
        self.leaf = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaf)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def _count(self, capacity: int, by: int) -> None:
        k = capacity + self.leaf
        while k:
            self.tree[k] += by
            k >>= 1

    def put(self, window: int, capacity: int) -> None:
        self.at[capacity].append(window)
        self._count(capacity, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """(window, its capacity) with the least capacity of at least `need`; it is taken out."""
        k, tree = need + self.leaf, self.tree
        if not tree[k]:
            while k > 1 and (k & 1 or not tree[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaf:
                k = 2 * k if tree[2 * k] else 2 * k + 1
        self._count(k - self.leaf, -1)
        return self.at[k - self.leaf].pop(), k - self.leaf


def best_fit(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset in it) of each piece; pieces of `lengths`, none above size, are taken longest first."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_, made = Windows(size), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        if found := open_.tightest(n):
            w, capacity = found
        else:
            w, capacity, made = made, size, made + 1
        window[k], offset[k] = w, size - capacity
        if capacity > n:
            open_.put(w, capacity - n)
    return window, offset


def pack(docs: DataFrame, path: str, size: int = SIZE, per_shard: int = PER_SHARD) -> DataFrame:
    """Pieces with sequence_id and offset. The number of shards follows the text (about one piece in 300 words)."""
    cut = stored(pieces(docs, path, size), "pieces")
    shards = max(1, -(-cut.count() // per_shard))
    keyed = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "__copy"), F.lit(shards)))

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        window, offset = best_fit(group["length"].to_numpy(), size)
        sequence = (np.int64(group["shard"][0].as_py()) << 40) + window
        return group.drop_columns(["shard", "__copy"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return keyed.groupBy("shard").applyInArrow(one, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
