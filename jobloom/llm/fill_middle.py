"""Fill-in-the-middle: documents cut into lines and put together in another order, by a secondary sort.

Every text is cut into lines; a hash of its id picks two lines as cuts and the form (plain; prefix, suffix, middle; or
suffix, prefix, middle). One pass emits the text as pieces of whole lines, PIECE bytes at most (a longer line in parts), each
with its place in the output and the markers as pieces of their own. Pieces are dealt by document and sorted by (document,
place) within each partition, so a task streams a document's output piece by piece: into a digest, or into a text. The same
stream reads which part of the output it is in from the form and the markers, and gives each piece its place in the restored
text; a second sort within the partition, without another shuffle, streams the restored text.

No task holds more than a piece of a document: both sorts spill, and a document's digest goes on from piece to piece. A
document is keyed by a hash of id and text, its task and its number among equal rows of it, so copies are dealt apart and a task that
runs again gives the same keys.

Edge cases: a null or empty text is plain and has no lines; texts that hold a marker are plain; a null id counts as the
empty text for its cuts; repeated rows are done one by one; very long texts and lines are cut into pieces; an empty table
gives no rows. Only doc_id is carried besides the results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .words import raw_bytes, text_slices

PIECE = 64 << 10
#: The markers.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
SEED = 7

_SCHEMA = "document binary, place long, doc_id long, n long, form string, prefix_chars long, middle_chars long, piece binary"
_ARROW = pa.schema([("document", pa.binary()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("piece", pa.binary())])
ROWS = 8 << 20


def choices(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers for a document: the first groups of eight digits of a hash of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4))


def cut(raw: bytes, breaks: np.ndarray, start: int, end: int, size: int = PIECE) -> Iterator[bytes]:
    """raw[start:end] in pieces of whole lines of at most `size` bytes; a longer line in parts. breaks: where lines end."""
    while end - start > size:
        last = np.searchsorted(breaks, start + size, "right") - 1
        stop = int(breaks[last]) if last >= 0 and breaks[last] > start else start + size
        yield raw[start:stop]
        start = stop
    yield raw[start:end]


def pieces(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = SEED, size: int = PIECE) -> DataFrame:
    """The output of every document in pieces with their place (markers too). rate: percent that are transformed at all;
    spm: percent of these with the suffix first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), {}
        for batch, text in text_slices(batches):
            rows, held = [], 0
            data, off = raw_bytes(text)
            raw, ends, chars = data.tobytes(), np.flatnonzero(data == 10) + 1, np.append(0, np.cumsum((data & 0xC0) != 0x80))
            marked = np.zeros(len(text), bool)
            for m in MARKERS:
                at = raw.find(m)
                while at >= 0:
                    k = np.searchsorted(off, at, "right") - 1
                    marked[k] |= at + len(m) <= off[k + 1]
                    at = raw.find(m, at + 1)
            low, high = np.searchsorted(ends, off[:-1], "right"), np.searchsorted(ends, off[1:], "right")
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                a, b = int(off[k]), int(off[k + 1])
                breaks = ends[low[k] : high[k]]
                if b > a and (not len(breaks) or breaks[-1] < b):
                    breaks = np.append(breaks, b)
                n = len(breaks)
                h1, h2, h3, h4 = choices(doc, seed)
                if a == b or marked[k] or h3 % 100 >= rate:
                    form, prefix, middle = "plain", None, None
                    parts = [cut(raw, breaks, a, b, size)]
                else:
                    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
                    x, y = (int(breaks[z - 1]) if z else a for z in (x, y))
                    prefix, middle = int(chars[x] - chars[a]), int(chars[y] - chars[x])
                    ranges = {PREFIX: (a, x), MIDDLE: (x, y), SUFFIX: (y, b)}
                    form = "spm" if h4 % 100 < spm else "psm"
                    parts = [[m, *cut(raw, breaks, *ranges[m], size)] for m in ((SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE))]
                key = xxhash.xxh3_128_digest(b"%d:" % (-1 if doc is None else doc) + raw[a:b])
                seen[key] = copy = seen.get(key, -1) + 1
                key += task.to_bytes(4, "big") + copy.to_bytes(4, "big")
                for place, piece in enumerate(p for part in parts for p in part):
                    rows.append((key, place, doc, n, form, prefix, middle, piece))
                    held += len(piece)
                if held > ROWS:
                    yield batch_of(rows)
                    rows, held = [], 0
            yield batch_of(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def batch_of(rows: list[tuple], schema: pa.Schema = _ARROW) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def dealt(cut_up: DataFrame) -> DataFrame:
    """Pieces of a document in one partition, in order of place: the secondary sort."""
    return cut_up.repartition("document").sortWithinPartitions("document", "place")


def streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """(whether a document begins, its row) for every piece of sorted batches; a batch is taken apart in small stretches."""
    last = None
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            for row in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns)):
                yield row[0] != last, row
                last = row[0]


def restored_places(form: str, place: int, piece: bytes, part: int) -> tuple[int, bool]:
    """(part of the text that the output is in from this piece on: 0 prefix, 1 middle, 2 suffix; whether the piece is text)."""
    if form == "plain":
        return 0, True
    if place == 0:
        return (2 if form == "spm" else 0), False
    opens = {("spm", 2): (PREFIX, 0), ("spm", 0): (MIDDLE, 1), ("psm", 0): (SUFFIX, 2), ("psm", 2): (MIDDLE, 1)}.get((form, part))
    if opens and piece == opens[0]:  # no text of these forms holds a marker
        return opens[1], False
    return part, True


_RESTORED = "document binary, part int, place long, doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, piece binary"
_RESTORED_ARROW = pa.schema([("document", pa.binary()), ("part", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("piece", pa.binary())])


def outputs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Output pieces in order: each text piece with its place in the restored text, and behind a document's pieces a row (part 3) with
    the digest of its output."""
    rows, held, digest, head, part = [], 0, None, None, 0
    close = lambda: rows.append((head[0], 3, 0, *head[2:7], digest.hexdigest(), None))
    for begins, row in streamed(batches):
        if begins:
            if head:
                close()
            digest, head, part = hashlib.sha256(), row, 0
        digest.update(row[7])
        part, text = restored_places(row[4], row[1], row[7], part)
        if text:
            rows.append((row[0], part, row[1], *[None] * 6, row[7]))
            held += len(row[7])
        if held > ROWS or len(rows) > 10_000:
            yield batch_of(rows, _RESTORED_ARROW)
            rows, held = [], 0
    if head:
        close()
    yield batch_of(rows, _RESTORED_ARROW)


_DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
_DIGESTS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])


def restored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Restored pieces in order: the digest of the text, beside what the document's last row says."""
    rows, digest = [], None
    for begins, row in streamed(batches):
        if begins:
            digest = hashlib.sha256()
        if row[1] < 3:
            digest.update(row[9])
        else:
            rows.append((*row[3:9], digest.hexdigest()))
        if len(rows) >= 10_000:
            yield batch_of(rows, _DIGESTS_ARROW)
            rows = []
    yield batch_of(rows, _DIGESTS_ARROW)


def round_trip(cut_up: DataFrame) -> DataFrame:
    """Digests of the output of every document and of the text restored from it: one shuffle, two sorts."""
    back = dealt(cut_up).mapInArrow(outputs, _RESTORED).sortWithinPartitions("document", "part", "place")
    return back.mapInArrow(restored, _DIGESTS)


def fill_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = SEED) -> DataFrame:
    """doc_id, form and the whole output text of every document, put together from its pieces."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, parts = None, []
        row_of = lambda: pa.RecordBatch.from_pydict({"doc_id": pa.array([head[2]], pa.int64()), "form": [head[4]], "text": [b"".join(parts).decode()]})
        for begins, row in streamed(batches):
            if begins:
                if head:
                    yield row_of()
                head, parts = row, []
            parts.append(row[7])
        if head:
            yield row_of()

    return dealt(pieces(docs, rate, spm, seed)).mapInArrow(run, "doc_id long, form string, text string")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
