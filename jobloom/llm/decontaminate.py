"""Benchmark decontamination: suffix arrays over the training texts, searched for the suffixes of the test items.

A task turns each slice of documents into one shard: all suffixes of its words, each up to the end of its text, sorted by
prefix doubling over the numbers of words. Every suffix of a test item is looked up by bisection, some words at a time; both
bounds of its first n words (or of the whole of a shorter item) give all places of that window at once, and where it would
stand among the training suffixes gives each of these its nearest test suffixes, hence its longest verbatim match, of any
length. The test items are sent in blocks of `block_bytes`, made ready once and sent as arrays, one pass over the documents
per block; a block is let go before the next one is sent, so what is broadcast has a fixed bound (an item is not split).

Edge cases: null or empty texts and items have no words and match nothing; an item of fewer than n words is one window;
repeated items all count; repeated documents are judged alike; a very long text is a shard by itself, about 150 bytes a word;
an empty benchmark leaves every document; null document ids are carried; an item whose id is null marks words and removes
documents like any other, but is not listed. Other columns pass through untouched, whatever their names. Words are told apart
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .words import ALNUM, Words, stored, text_slices

N = 10
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 2 << 20
LISTS = ("starts", "ends", "items")
FOUND = T.StructType([T.StructField(c, T.ArrayType(T.LongType()) if c in LISTS else T.LongType()) for c in ("n_words", *LISTS, "longest", "longest_at")])
FOUND_PA = pa.schema([(c, pa.list_(pa.int64()) if c in LISTS else pa.int64()) for c in FOUND.names])


class Suffixes:
    """The suffix array of the words of some texts: `places`, sorted by the words from there to the end of the text."""

    def __init__(self, words: Words):
        self.h, self.stop = words.hashes(), np.repeat(words.splits[1:], words.counts)
        self.known = np.unique(words.hashes_of_unique())
        # Even numbers for words; an odd one is for a word between them that these texts don't have.
        number = 2 * (np.searchsorted(self.known, words.hashes_of_unique()).astype(np.uint64) + np.uint64(1))
        self.bits = int(2 * len(self.known) + 2).bit_length()
        self.depth = 63 // self.bits
        n = len(words)
        self.keys = self.packed(number[words.codes] if n else np.zeros(0, np.uint64), np.arange(n), self.stop)
        self.places = self._sorted(np.argsort(self.keys))

    def packed(self, number: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The next `depth` words from each place as one number that sorts like them; nothing (0) stands behind the end."""
        pad, out = np.concatenate([number, np.zeros(self.depth, np.uint64)]), np.zeros(len(at), np.uint64)
        for k in range(self.depth):
            out = (out << np.uint64(self.bits)) | np.where(at + k < stop, pad[np.minimum(at + k, len(number))], np.uint64(0))
        return out

    def _sorted(self, order: np.ndarray) -> np.ndarray:
        """Prefix doubling from the first `depth` words on; only places that are not told apart yet are sorted again."""
        n, width = len(order), self.depth
        if not n:
            return order
        new = np.append(True, self.keys[order[1:]] != self.keys[order[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        todo = np.flatnonzero(~(new & np.append(new[1:], True)))  # rows of groups of several places
        while len(todo):
            place = order[todo]
            ahead = place + width
            then = np.where(ahead < self.stop[place], rank[np.minimum(ahead, n - 1)] + 1, 0)
            group = rank[place]
            by = np.argsort(group * (n + 1) + then)
            place, then, group = place[by], then[by], group[by]
            order[todo] = place
            fresh = np.append(True, (group[1:] != group[:-1]) | (then[1:] != then[:-1]))
            rank[place] = np.maximum.accumulate(np.where(fresh, todo, 0))
            alone = fresh & np.append(fresh[1:], True)
            width *= 2
            todo = todo[~alone & (then > 0)]  # those at their end are equal for good
        return order

    def key(self, rows: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """The packed words of the suffixes in some rows of the array, `skip` words further on."""
        place = self.places[rows]
        at = place + skip
        return np.where(at < self.stop[place], self.keys[np.minimum(at, len(self.keys) - 1)], np.uint64(0))

    def bound(self, lo: np.ndarray, hi: np.ndarray, skip: np.ndarray, value: np.ndarray, above: bool) -> np.ndarray:
        """By bisection in rows [lo, hi): the first whose key isn't below the value (above: is above it)."""
        lo, hi = lo.copy(), hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            key = self.key(mid, skip[live])
            right = key <= value[live] if above else key < value[live]
            lo[live[right]] = mid[right] + 1
            hi[live[~right]] = mid[~right]
            live = live[lo[live] < hi[live]]
        return lo


class Tests:
    """The suffixes of some test items in order, made once and sent to the tasks."""

    def __init__(self, ids: list[int | None], texts: list[str | None], n: int):
        words = Words(pa.array([t or "" for t in texts], pa.string()), ALNUM)
        suffixes = Suffixes(words)
        at = suffixes.places
        self.h, self.at, self.stop, self.item = words.hashes(), at, suffixes.stop[at] if len(at) else at, words.rows()[at]
        whole = words.counts[self.item]
        left = self.stop - at
        self.window = np.where(left >= n, n, np.where((whole < n) & (left == whole), whole, 0))  # words of the window, 0 for none
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        self.named = np.array([i is not None for i in ids], bool)

    def __len__(self) -> int:
        return len(self.at)

    def find(self, shard: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each test suffix: rows [lo, hi) of the places of its window, and the row before which it would stand."""
        n, rows = len(self), len(shard.places)
        where = np.searchsorted(shard.known, self.h)
        there = shard.known[np.minimum(where, len(shard.known) - 1)] == self.h if len(shard.known) else np.zeros(len(self.h), bool)
        number = 2 * where.astype(np.uint64) + np.where(there, np.uint64(2), np.uint64(1))
        low, high, stand = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        live, lo, hi, skip = np.arange(n), np.zeros(n, np.int64), np.full(n, rows), np.zeros(n, np.int64)
        while len(live):
            # As many words as a key holds, but a window ends where a key does.
            left, window = self.stop[live] - self.at[live] - skip, self.window[live] - skip
            step = np.minimum(np.where(window > 0, np.minimum(window, shard.depth), shard.depth), left)
            value = shard.packed(number, self.at[live] + skip, self.stop[live])
            rest = ((shard.depth - step) * shard.bits).astype(np.uint64)
            bottom = (value >> rest) << rest
            top = bottom | ((np.uint64(1) << rest) - np.uint64(1))
            if not skip.any():
                keys = shard.keys[shard.places]
                a, z = np.searchsorted(keys, bottom, "left"), np.searchsorted(keys, top, "right")
            else:
                a, z = shard.bound(lo, hi, skip, bottom, False), shard.bound(lo, hi, skip, top, True)
            skip = skip + step
            done = self.window[live] == skip
            low[live[done]], high[live[done]] = a[done], z[done]
            ends = (a >= z) | (left == step)
            # Where the words differ, it stands before the first suffix that is greater; where it ends, before all that go on.
            stand[live[ends]] = np.where(a < z, a, shard.bound(lo, hi, skip - step, value, False) if skip.any() else a)[ends]
            live, lo, hi, skip = live[~ends], a[~ends], z[~ends], skip[~ends]
        return low, high, np.maximum.accumulate(stand) if n else stand

    def longest(self, shard: Suffixes, stand: np.ndarray) -> np.ndarray:
        """For each place of the shard the words of its longest match with any test suffix: one of its two neighbours in order."""
        out = np.zeros(len(shard.places), np.int64)
        first = (shard.keys[shard.places] >> np.uint64(shard.bits * (shard.depth - 1))).astype(np.int64) // 2 - 1
        row = np.flatnonzero(np.isin(shard.known, self.h)[first]) if len(out) else out  # whose first word the items have at all
        before = np.searchsorted(stand, row, "right") - 1
        for test in (before, before + 1):
            live = np.flatnonzero((test >= 0) & (test < len(self)))
            place, at, end = shard.places[row[live]], self.at[test[live]], self.stop[test[live]]
            size = np.zeros(len(live), np.int64)
            go = np.arange(len(live))
            while len(go):
                p, t = place[go] + size[go], at[go] + size[go]
                ok = (p < shard.stop[place[go]]) & (t < end[go])
                ok[ok] = shard.h[p[ok]] == self.h[t[ok]]
                go = go[ok]
                size[go] += 1
            out[place] = np.maximum(out[place], size)
        return out


def search(tests: Tests, text: pa.Array) -> dict[str, list]:
    """For each text: words, merged spans that hold a test window, the items, the longest verbatim match and its place."""
    words, n = Words(text, ALNUM), len(text)
    total, rows = len(words), words.rows()
    shard = Suffixes(words)
    low, high, stand = tests.find(shard)
    hit = np.flatnonzero(high > low)
    # Test suffixes with the same window have the same rows: each window's places are listed once.
    key = np.stack([low[hit], high[hit], tests.window[hit]])
    windows, which = np.unique(key, axis=1, return_inverse=True) if len(hit) else (key, hit)
    size = windows[1] - windows[0]
    window = np.repeat(np.arange(len(size)), size)
    place = shard.places[np.arange(len(window)) + np.repeat(windows[0] - (np.cumsum(size) - size), size)]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + windows[2][window], -1)
    cover = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    new = np.zeros(total + 1, bool)
    new[words.splits] = True
    begin = np.flatnonzero(cover[1:] & (~cover[:-1] | new))[: total + 1]
    end = np.flatnonzero(cover[:-1] & (~cover[1:] | new))
    base = words.splits[rows[begin]] if len(begin) else begin
    of = rows[begin] if len(begin) else begin
    # Documents with each window once, then the items that have it.
    pair = np.unique(np.stack([window, rows[place]]), axis=1) if len(place) else np.zeros((2, 0), np.int64)
    owner = np.argsort(which.ravel(), kind="stable")
    per = np.bincount(which.ravel(), minlength=len(size))
    first, many = (np.cumsum(per) - per)[pair[0]], per[pair[0]]
    item = tests.item[hit][owner[np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)]]
    doc = np.repeat(pair[1], many)
    named = tests.named[item] if len(item) else np.zeros(0, bool)
    listed = np.unique(np.stack([doc[named], tests.ids[item[named]]]), axis=1) if named.any() else np.zeros((2, 0), np.int64)
    # The longest match of each text, the first of equals.
    longest, longest_at = np.zeros(n, np.int64), np.full(n, -1)
    if total:
        match = tests.longest(shard, stand)
        full = np.flatnonzero(words.counts)
        longest[full] = np.maximum.reduceat(match, words.splits[:-1][full])
        best = np.flatnonzero((match > 0) & (match == longest[rows]))
        owners, at = np.unique(rows[best], return_index=True)
        longest_at[owners] = best[at] - words.splits[owners]
    cut = lambda owners, values: [x.tolist() for x in np.split(values, np.searchsorted(owners, np.arange(1, n)))]
    return {"n_words": words.counts, "starts": cut(of, begin - base), "ends": cut(of, end - base), "items": cut(listed[0], listed[1]), "longest": longest, "longest_at": longest_at}


def matches(docs: DataFrame, benchmark: DataFrame, n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`doc` (the row, as a struct) and, for each, n_words, spans (starts, ends, in words, merged), items, longest, longest_at."""
    spark, items = docs.sparkSession, benchmark.select("item_id", "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))

    def sent(b: int):
        part = (items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)).collect()  # about block_bytes
        return spark.sparkContext.broadcast(Tests([r[0] for r in part], [r[1] for r in part], n))

    whole = docs.select(F.struct("*").alias("doc"))
    if blocks == 1:
        return _searched(whole, sent(0))
    # A pass for each block: what it finds is written down, then the block is let go.
    key = [F.xxhash64("doc.doc_id", "doc.text").alias("h"), F.xxhash64("doc.text", "doc.doc_id").alias("g")]
    parts = []
    for b in range(blocks):
        block = sent(b)
        found = _searched(whole.select(F.struct("doc.doc_id", "doc.text").alias("doc")), block)
        parts.append(stored(found.where("longest > 0").select(*key, *FOUND.names).dropDuplicates(["h", "g"]), "block-matches"))
        block.destroy()
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)

    def merge(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        best = max(rows, key=lambda r: (r["longest"], -r["longest_at"]))
        spans: list[list[int]] = []
        for a, z in sorted(x for r in rows for x in zip(r["starts"], r["ends"])):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], z)
            else:
                spans.append([a, z])
        one = {"starts": [s[0] for s in spans], "ends": [s[1] for s in spans], "items": sorted({i for r in rows for i in r["items"]}), "longest": best["longest"], "longest_at": best["longest_at"]}
        return pa.Table.from_pylist([{"h": rows[0]["h"], "g": rows[0]["g"], "n_words": rows[0]["n_words"]} | one], schema=pa.schema([("h", pa.int64()), ("g", pa.int64()), *FOUND_PA]))

    merged = union.groupBy("h", "g").applyInArrow(merge, T.StructType([T.StructField("h", T.LongType()), T.StructField("g", T.LongType()), *FOUND.fields]))
    none = _searched(whole, spark.sparkContext.broadcast(Tests([], [], n))).select("doc", *key, F.col("n_words").alias("own_words"))
    joined = none.join(merged, ["h", "g"], "left")
    empty = {"n_words": F.col("own_words"), **{c: F.array().cast("array<bigint>") for c in LISTS}, "longest": F.lit(0).cast("long"), "longest_at": F.lit(-1).cast("long")}
    return joined.select("doc", *[F.coalesce(c, v).alias(c) for c, v in empty.items()])


def _searched(whole: DataFrame, sent) -> DataFrame:
    """whole (doc, a struct with `text`) and what the items of one block match in each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = sent.value
        for batch in batches:
            doc, at = batch.column("doc"), 0
            for part, text in text_slices([pa.RecordBatch.from_arrays([doc.field("text")], names=["text"])], limit=SHARD_BYTES):
                got = search(tests, text)
                yield pa.RecordBatch.from_arrays([doc.slice(at, part.num_rows), *[pa.array(got[f.name], f.type) for f in FOUND_PA]], names=["doc", *FOUND.names])
                at += part.num_rows

    return whole.mapInArrow(run, T.StructType([whole.schema["doc"], *FOUND.fields]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The documents that hold no window of a test item."""
    kept = matches(docs, benchmark, n).where(F.size("starts") == 0)
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = matches(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, z: z - a), F.lit(0).cast("long"), lambda s, x: s + x)
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.col("longest").alias("longest_match"), F.col("longest_at").alias("longest_match_start"))
