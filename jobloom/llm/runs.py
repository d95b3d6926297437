"""Periodic runs of words: maximal stretches whose words repeat with a period, and texts without the repeats.

A run of period q has at least max(LEAST, 2 * q) words, and no word beside it goes on with the period. So each of its words
stands in it twice or more, and a word that stands only once in a segment is in no run and splits the segment; the parts are
counted again, and so on until nothing splits. Ordinary prose falls apart into parts of fewer than LEAST words. What survives
is scanned by lags: up to DIRECT every place is compared with the one a lag behind it; above that, for lags from Q/2 to Q,
only places a quarter of Q apart are, by prefix hashes of a quarter of Q words: any run with such a period holds one of these
places with its counterpart. What agrees is extended to both sides by bisection over prefix hashes. Work therefore grows with
n log n, whatever the text repeats.

All texts of a slice are split and scanned together, with a code of its own between texts; hashes have 62 bits and are taken
as equality. SPLITS bounds the rounds of splitting, which saves work but decides nothing: the scan is exact without it.

Edge cases: a null, empty or blank text has no words and no runs; long texts stand alone in a slice, about 200 bytes a word;
repeated rows and rows with equal ids are looked at each by itself; a null id is kept (crc32 of no text, 0, where texts are
planted); an empty table gives no rows. Only doc_id is carried besides the results.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .fingerprint import Prefix
from .packing import BLANK
from .words import Words, text_slices

LEAST, DIRECT, SPLITS, BLOCK = 12, 16, 200, 1 << 22


def surviving(codes: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Places that are left once words that stand only once in their segment have split it, again and again. Segments are
    numbered in order of place; parts below LEAST words go as well."""
    at, settled = np.arange(len(codes)), []
    for _ in range(SPLITS):
        start = np.append(True, segment[1:] != segment[:-1]) | np.append(True, np.diff(at) != 1) if len(at) else np.zeros(0, bool)
        segment = np.cumsum(start) - 1
        big = np.bincount(segment, minlength=1)[segment] >= LEAST if len(at) else start
        at, segment = at[big], segment[big]
        if not len(at):
            break
        key = segment.astype(np.int64) << 32 | codes[at]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        once = np.zeros(len(at), bool)
        once[order] = ~(np.append(False, same) | np.append(same, False))
        touched = np.zeros(segment[-1] + 1, bool)
        touched[segment[once]] = True
        changed = touched[segment]
        settled.append(at[~changed])  # a segment that nothing splits is never counted again
        keep = changed & ~once
        at, segment = at[keep], segment[keep]
    return np.sort(np.concatenate([*settled, at]))


def reach(codes: np.ndarray, prefix: Prefix, back: Prefix, at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretch [start, end) around each place with the words `lag` apart equal, where words at and at + lag are."""
    n = len(codes)
    ahead = prefix.common(at, at + lag, n - at - lag)
    behind = back.common(n - at, n - at - lag, at)
    return at - behind, at + lag + ahead


def scan(codes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs (start, end, smallest period) of codes; no run is longer than `longest`."""
    n = len(codes)
    starts, ends, periods = [], [], []

    def add(start: np.ndarray, end: np.ndarray, lag: np.ndarray | int) -> None:
        lag = np.broadcast_to(lag, start.shape)
        fits = end - start >= np.maximum(LEAST, 2 * lag)
        starts.append(start[fits])
        ends.append(end[fits])
        periods.append(lag[fits])

    for q in range(1, min(DIRECT, longest // 2, n - 1) + 1):
        edge = np.flatnonzero(np.diff(codes[:-q] == codes[q:], prepend=False, append=False))
        add(edge[::2], edge[1::2] + q, q)
    scale = 2 * DIRECT
    if scale // 2 < longest // 2:
        prefix, back = Prefix(codes), Prefix(codes[::-1])
    while scale // 2 < longest // 2:
        k, half = scale // 4, scale // 2
        width = n - k + 1
        if width > half:
            name = prefix.span(np.arange(width), np.arange(k, n + 1))
            padded = np.append(name, np.zeros(scale, np.uint64))
            rows = -(-(width - half) // k)
            ahead = np.lib.stride_tricks.as_strided(padded[half + 1 :], (rows, half), (8 * k, 8))  # row r: the names from r * k + half + 1 on
            lags = []
            for lo in range(0, rows, per := max(1, BLOCK // half)):
                r, c = np.nonzero(ahead[lo : lo + per] == name[: rows * k : k][lo : lo + per, None])
                lags.append(np.stack([r + lo, c + half + 1]))
            r, lag = np.concatenate(lags, axis=1) if lags else np.zeros((2, 0), np.int64)
            real = r * k + lag < width
            r, lag = r[real], lag[real]
            order = np.lexsort((r, lag))
            r, lag = r[order], lag[order]
            first = np.append(True, (np.diff(r) != 1) | (np.diff(lag) != 0)) if len(r) else np.zeros(0, bool)  # places in a row lie in one stretch
            for lo in range(0, int(first.sum()), BLOCK // 8):
                at, q = r[first][lo : lo + BLOCK // 8] * k, lag[first][lo : lo + BLOCK // 8]
                add(*reach(codes, prefix, back, at, q), q)
        scale *= 2
    start, end, period = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (starts, ends, periods))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.append(True, (np.diff(start) != 0) | (np.diff(end) != 0)) if len(start) else np.zeros(0, bool)  # the least period of a stretch
    return start[new], end[new], period[new]


def runs_of(codes: np.ndarray, splits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs in texts [splits[k], splits[k + 1]) of codes, by start, then period."""
    at = surviving(codes, np.repeat(np.arange(len(splits) - 1), np.diff(splits)))
    text = np.searchsorted(splits, at, "right")
    part = np.cumsum((np.diff(at, prepend=-2) != 1) | (np.diff(text, prepend=-1) != 0)) - 1  # segments, one after another
    if not len(at):
        return at, at, at
    dense = np.unique(codes[at], return_inverse=True)[1].astype(np.int64)
    place = np.arange(len(at)) + part  # a code of its own behind each segment
    apart = np.full(place[-1] + 1, -1, np.int64)
    apart[place] = dense
    gaps = np.flatnonzero(apart < 0)
    apart[gaps] = len(at) + np.arange(len(gaps))
    start, end, period = scan(apart, int(np.bincount(part).max()))
    back = np.searchsorted(place, start)
    start, end = at[back], at[back] + (end - start)
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a text whose tail is made periodic, for a tenth of the ids; else None."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])


def periodic_runs(docs: DataFrame, edit: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start, then period) and collapsed (the words that are in no
    run behind its first period, joined by a space) of every text. edit: the words that stand at each place instead."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in text_slices(batches):
            words = Words(text, BLANK)
            codes, splits = words.codes.astype(np.int64), words.splits
            for k, doc in enumerate(batch.column("doc_id").to_pylist() if edit else ()):
                if (order := edit(doc, int(splits[k + 1] - splits[k]))) is not None:
                    codes[splits[k] : splits[k + 1]] = codes[splits[k] + order]
            start, end, period = runs_of(codes, splits)
            cover = np.zeros(len(codes) + 1, np.int64)
            np.add.at(cover, start + period, 1)
            np.add.at(cover, end, -1)
            kept = np.cumsum(cover)[:-1] == 0
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept))[splits].astype(np.int32)), words.unique.take(pa.array(codes[kept])))
            off = np.searchsorted(start, splits).astype(np.int32)
            base = splits[np.searchsorted(splits, start, "right") - 1]
            values = pa.StructArray.from_arrays([pa.array(start - base, pa.int64()), pa.array(end - start, pa.int64()), pa.array(period, pa.int64())], fields=list(RUN))
            found = [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(splits), pa.int64()), pa.ListArray.from_arrays(pa.array(off), values), pc.binary_join(lists, " ")]
            yield pa.RecordBatch.from_arrays(found, schema=FOUND)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), planted)
    # The longest run: greatest length, then smallest start and period, so their opposites for the greatest struct.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("(1000 * best.length) div (-best.p)").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
