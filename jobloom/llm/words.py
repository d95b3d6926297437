"""Arrow and numpy helpers shared by the text operators: slicing of batches, words as codes, hashes.

Everything here works on one Arrow batch inside a task; Spark deals out the batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.folders import shared_dir

SLICE_BYTES = 4 << 20

_LOWER = bytes(range(97, 123))

#: Words are runs of anything but space and \t \n \v \f \r; A-Z become a-z.
SPACED = bytearray(range(256))
SPACED[65:91] = _LOWER
SPACED[9:14] = b" " * 5
SPACED = bytes(SPACED)

#: Words are runs of 0-9, a-z and non-ASCII characters; A-Z become a-z, all else separates.
ALNUM = bytearray(b" " * 128 + bytes(range(128, 256)))
ALNUM[48:58] = b"0123456789"
ALNUM[65:91] = _LOWER
ALNUM[97:123] = _LOWER
ALNUM = bytes(ALNUM)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends here, on storage all executors see."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: all that came of them has been written."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut batches so that each piece has about `limit` bytes of text (a longer text stands alone); nulls become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
        sizes = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start), text.slice(start, stop - start)
            start = stop


def raw_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of the texts, offsets of each text in them), without nulls."""
    off = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, off - off[0]


class Words:
    """The words of some texts: codes into `unique`, one run of codes per text (splits)."""

    def __init__(self, text: pa.Array, table: bytes):
        data, off = raw_bytes(text)
        data = data.tobytes().translate(table)
        again = pa.Array.from_buffers(pa.string(), len(text), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])
        parts = pc.ascii_split_whitespace(again)
        coded = parts.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        splits = np.asarray(parts.offsets.to_numpy(zero_copy_only=False), np.int64)
        splits = splits - splits[0]
        self.unique = coded.dictionary
        if (empty := pc.index(self.unique, "").as_py()) >= 0:
            keep = codes != empty
            splits = np.concatenate([[0], np.cumsum(keep)])[splits]
            codes = codes[keep]
        self.codes, self.splits = codes, splits

    def __len__(self) -> int:
        return len(self.codes)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.splits)

    def rows(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.splits) - 1), self.counts)

    def hashes_of_unique(self) -> np.ndarray:
        """A 64-bit hash of each distinct word; never 0."""
        return word_hashes(self.unique)

    def hashes(self) -> np.ndarray:
        """The hash of each word, in text order."""
        return self.hashes_of_unique()[self.codes]


K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
LONG = 64
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first k bytes


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (multiply and shift, twice)."""
    h = (h ^ (h >> np.uint64(32))) * K1
    h = (h ^ (h >> np.uint64(29))) * K2
    return h ^ (h >> np.uint64(32))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, never 0: eight bytes of all words at a time; words over LONG bytes by xxh3."""
    data, off = raw_bytes(words)
    size, data = np.diff(off), np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place on
    h = mix(size.astype(np.uint64) + K2)
    todo = np.flatnonzero(size <= LONG)
    at, left = off[:-1][todo], size[todo]
    while len(todo):
        h[todo] = mix(h[todo] * K1 + (eight[at] & FIRST[np.minimum(left, 8)]))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG):
        h[k] = xxhash.xxh3_64_intdigest(data[off[k] : off[k + 1]])
    return np.maximum(h, np.uint64(1))


def run_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (len(h)-n+1 of them); order matters."""
    size = max(0, len(h) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * K1 + mix(h[k : k + size] + np.uint64(k + 1))
    return mix(out)


@lru_cache(maxsize=1)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    out = []
    for base in (int(K1), pow(int(K1), -1, 1 << 64)):
        x = np.ones(1 << bits, np.uint64)
        for k in range(bits):
            x[1 << k : 2 << k] = x[: 1 << k] * np.uint64(pow(base, 1 << k, 1 << 64))
        out.append(x)
    return out[0], out[1]


def span_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each span values[start:stop], from prefix sums; equal spans have equal hashes."""
    up, down = powers(len(values).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


def inside(splits: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which starts of runs of n words stay within one text."""
    starts = np.arange(max(0, total - n + 1))
    if not len(starts):
        return np.zeros(0, bool)
    ends = np.repeat(splits[1:], np.diff(splits))[: len(starts)]
    return starts + n <= ends


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of the schema from arrays or lists."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def codec() -> pa.Codec:
    return pa.Codec("zstd", 1)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers as bytes: byte planes of each, compressed."""
    n = len(columns[0])
    planes = [np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(n, c.dtype.itemsize).T).tobytes() for c in columns]
    raw = b"".join(planes)
    return n.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + codec().compress(raw, asbytes=True)


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    n, size = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
    raw, at, out = np.frombuffer(codec().decompress(data[8:], size, asbytes=True), np.uint8), 0, []
    for kind in map(np.dtype, kinds):
        out.append(np.ascontiguousarray(raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).ravel())
        at += n * kind.itemsize
    return out


def joined(blobs: Iterable[bytes], *kinds: str) -> list[np.ndarray]:
    parts = [unpacked(b, *kinds) for b in blobs]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate(kinds)]
