"""Document fingerprints from prefix polynomial hashes.

`Prefix` holds modular prefix arrays of a text, under two bases: the hash of any span takes a subtraction and a product,
spans are compared by it, and the longest common extension of two places is found by binary search over lengths.
The fingerprint of a text is its whole hash and, for each of BINS bins, eight bits of the least hash among the spans of
GRAM code points that fall in the bin. Likeness of two fingerprints estimates the share of spans that both texts hold.
How far a text agrees with its edited text, and with the next document, from the start on, is found by the same arrays.

Documents are dealt by ranges of ids; the last of each range meets the first of the next one by a join on the number of
the range. A text takes about 50 bytes a code point while it is worked on; texts are taken RUN code points at a time, a
longer one alone.

Edge cases: a null text is empty; an empty text has a fingerprint of zeros, and two empty texts have likeness 1; a text
shorter than GRAM is one span; equal ids follow each other by text; null ids come first; a single document is its own
next; an empty table gives no rows. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .words import mix, stored, text_slices

P = np.uint64(2**31 - 1)
BASES = (1_000_003, 998_244_353)
GRAM, BINS = 8, 128
RUN = 1 << 20


@lru_cache(maxsize=8)
def powers(base: int, bits: int) -> np.ndarray:
    """base**0, base**1, ... modulo P: 2**bits of them, each doubling one product."""
    out = np.ones(1 << bits, np.uint64)
    for k in range(bits):
        out[1 << k : 2 << k] = out[: 1 << k] * np.uint64(pow(base, 1 << k, int(P))) % P
    return out


class Prefix:
    """Prefix hashes of an array of code points (whole texts, or several behind each other)."""

    def __init__(self, points: np.ndarray):
        self.bits, self.sums = max(1, len(points)).bit_length(), []
        shifted = points.astype(np.uint64) + np.uint64(1)
        for base in BASES:
            terms = shifted * powers(base, self.bits)[: len(points)] % P
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)]))

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62-bit hash of each span [start, end)."""
        halves = []
        for base, sums in zip(BASES, self.sums):
            back = powers(pow(base, -1, int(P)), self.bits)
            halves.append((sums[end] - sums[start]) % P * back[start] % P)
        return (halves[0] << np.uint64(31)) | halves[1]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, other: Prefix | None = None) -> np.ndarray:
        """How far the text from each a on and the other (or this) text from b on agree, up to `most`: the longest common
        extensions, by binary search over their lengths, all at once."""
        low, high, other = np.zeros(len(a), np.int64), most.copy(), other or self
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.span(a, a + mid) == other.span(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def fingerprints(prefix: Prefix, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of 8 + BINS bytes for each text [start, end) of the prefix arrays."""
    n, sizes = len(starts), ends - starts
    whole = mix(prefix.span(starts, ends) + sizes.astype(np.uint64))
    whole[sizes == 0] = 0
    grams = np.where(sizes > 0, np.maximum(sizes - GRAM + 1, 1), 0)
    row = np.repeat(np.arange(n), grams)
    at = np.arange(len(row)) + np.repeat(starts - (np.cumsum(grams) - grams), grams)
    h = mix(prefix.span(at, np.minimum(at + GRAM, ends[row])))
    least = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, row * BINS + (h % np.uint64(BINS)).astype(np.int64), h >> np.uint64(7))
    value = np.where(least == np.iinfo(np.uint64).max, 0, mix(least) % np.uint64(255) + np.uint64(1)).astype(np.uint8).reshape(n, BINS)
    return np.concatenate([whole.astype(">u8").view(np.uint8).reshape(n, 8), value], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of rows: shared bins among those used, less what chance alone makes equal."""
    x, y = a[:, 8:], b[:, 8:]
    used = ((x > 0) | (y > 0)).sum(axis=1)
    same = ((x == y) & (x > 0)).sum(axis=1)
    share = np.where(used > 0, same / np.maximum(used, 1), 1.0)
    return np.where((a == b).all(axis=1), 1.0, np.clip((share - 1 / 255) / (1 - 1 / 255), 0, 1))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def portions(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Stretches of texts with RUN code points in all, or a longer text alone."""
    k = 0
    while k < len(sizes):
        stop, size = k, 0
        while stop < len(sizes) and (stop == k or size + sizes[stop] <= RUN):
            size += sizes[stop]
            stop += 1
        yield k, stop
        k = stop


def indexed(texts: list[str]) -> tuple[Prefix, np.ndarray, np.ndarray]:
    """(prefix arrays of the texts behind each other, where each starts, where it ends)."""
    points = [code_points(t) for t in texts]
    ends = np.cumsum([len(p) for p in points], dtype=np.int64)
    return Prefix(np.concatenate(points)), np.concatenate([[0], ends[:-1]]), ends


def prints(texts: list[str]) -> np.ndarray:
    """Fingerprints of texts."""
    out = [fingerprints(*indexed(texts[k:z])) for k, z in portions(list(map(len, texts)))]
    return np.concatenate([np.zeros((0, 8 + BINS), np.uint8), *out])


def shared_starts(texts: list[str], others: list[str]) -> np.ndarray:
    """How many code points each text and the other one have in common from the start on."""
    out = [np.zeros(0, np.int64)]
    for k, z in portions([len(t) + len(o) for t, o in zip(texts, others)]):
        (p, a, a_end), (q, b, b_end) = indexed(texts[k:z]), indexed(others[k:z])
        out.append(p.common(a, b, np.minimum(a_end - a, b_end - b), q))
    return np.concatenate(out)


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by as many first characters of the following one (or all it has)."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


SCHEMA = "doc_id long, n_chars long, sha binary, print binary, edited_print binary, near_edited double, near_next double, common_edited long, common_next long, part long, edge long, text string"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]


def compare(ids: list, texts: list[str], following: list[str], own: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
    """The result for some documents and those that follow them. own, after: their fingerprints."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    new = prints(changed)
    cells = lambda rows: [r.tobytes() for r in rows]
    shas = [hashlib.sha256(c.encode()).digest() for c in changed]
    values = [ids, [len(t) for t in texts], shas, cells(own), cells(new), likeness(own, new), likeness(own, after), shared_starts(texts, changed), shared_starts(texts, following), *[[None] * len(ids)] * 3]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, KINDS)], names=COLUMNS)


def edge_row(part: int, edge: int, doc_id, text: str) -> pa.RecordBatch:
    cells = [doc_id, *[None] * 8, part, edge, text]
    return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, KINDS)], names=COLUMNS)


def in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document beside its follower; a task's first (edge 0) and last (edge 1) document are left for later."""
    part, held, first = TaskContext.get().partitionId(), None, True
    for batch, text in text_slices(batches):
        ids, texts = batch.column("doc_id").to_pylist(), text.to_pylist()
        if first:
            yield edge_row(part, 0, ids[0], texts[0])
            first = False
        own = prints(texts)
        if held:
            ids, texts, own = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], own])
        if len(ids) > 1:
            yield compare(ids[:-1], texts[:-1], texts[1:], own[:-1], own[1:])
        held = (ids[-1], texts[-1], own[-1:])
    if held:
        yield edge_row(part, 1, held[0], held[1])


def closed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task's last document (doc_id, text) and the document that follows it."""
    for batch in batches:
        if batch.num_rows:
            texts, following = batch.column("text").to_pylist(), batch.column("following").to_pylist()
            yield compare(batch.column("doc_id").to_pylist(), texts, following, prints(texts), prints(following))


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, in order of doc_id; the last document of each task is closed apart."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    found = stored(ordered.mapInArrow(in_order, SCHEMA), "prints")
    heads, tails = found.where("edge = 0"), found.where("edge = 1").select("part", "doc_id", "text")
    # The task before each one that had rows (before the first: the last); one number for each task goes through the window.
    order = Window.orderBy("part")
    before = heads.select("part", F.coalesce(F.lag("part").over(order), F.max("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    follows = heads.select("part", F.col("text").alias("following")).join(before, "part").select(F.col("before").alias("part"), "following")
    edges = tails.join(follows, "part").select("doc_id", "text", "following").mapInArrow(closed, SCHEMA)
    text = lambda c: F.lower(F.hex(c))
    return found.where("edge is null").unionByName(edges).select(
        "doc_id", "n_chars", text("sha").alias("edited_sha256"), text("print").alias("fingerprint"), text("edited_print").alias("edited_fingerprint"),
        "near_edited", "near_next", "common_edited", "common_next")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))
