"""Line dedup by pairwise alignment.

A block is a run of consecutive lines with MIN_BLOCK characters or more. Documents that share a block are paired, aligned
by patience diff over their line hashes, and the common blocks are deleted from the later document (larger doc_id; equal
ids: by the hash of the text). So a line goes if it lies in a block that some earlier document holds as well.

Pairing is complete: `windows` gives the least blocks from each line on and up to each line (mostly single lines), and every
common block is covered by such windows that lie inside it. Each window links a document with the nearest earlier document
that has it, so a window adds at most one pair for each document, however frequent it is. A document is aligned with the
partners that it shares rare windows with first, and only what these leave with those of frequent ones. The nearest earlier
document is looked for first among the documents of a block of ids (about BLOCK_DOCS of them), then, for the first of a block,
over the ends of the blocks before; so no task holds all documents of a frequent line. How rare a window is, is counted within
a block of ids. Pairs carry hashes, not texts. Only what patience diff aligns is deleted.

Edge cases: null texts have no lines and stay null; empty texts stay; rows equal in doc_id and text are one document and
are treated alike; a null doc_id comes before all others; a very long text is one row of line hashes, 12 bytes a line; an empty
table gives no rows. All other columns pass through,
whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .words import mix, span_hashes, stored

BLOCK_DOCS, MIN_BLOCK = 1024, 30
NULL_ID = -(1 << 63)


def rising(places: list[int]) -> list[int]:
    """Positions of a longest rising subsequence."""
    ends: list[int] = []
    tails: list[int] = []
    came: list[int] = []
    for k, x in enumerate(places):
        at = bisect_left(tails, x)
        came.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(x)
            ends.append(k)
        else:
            tails[at], ends[at] = x, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = came[k]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Patience diff: common blocks (start in a, start in b, length), in order."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: k for k, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        anchors = [(k, where[x]) for k, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in where]
        kept = [anchors[k] for k in rising([j for _, j in anchors])]
        for i, j in kept:
            todo.append((a0, i, b0, j))
            pairs.append((i, j))
            a0, b0 = i + 1, j + 1
        if kept:
            todo.append((a0, a1, b0, b1))
    out: list[list[int]] = []
    for i, j in sorted(pairs):
        if out and (i, j) == (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]):
            out[-1][2] += 1
        else:
            out.append([i, j, 1])
    return [tuple(x) for x in out]


def windows(lines: np.ndarray, sizes: np.ndarray, splits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, behind the last line, hash) of the least blocks that begin or end at a line, each once.

    lines, sizes: hashes and characters of the lines of some texts; splits: where the lines of each text begin and end.
    """
    n, per = len(lines), np.diff(splits)
    total, at = np.concatenate([[0], np.cumsum(sizes)]), np.arange(n)
    stop = np.searchsorted(total, total[:-1] + MIN_BLOCK, "left")
    start = np.searchsorted(total, total[1:] - MIN_BLOCK, "right") - 1
    on, upto = stop <= np.repeat(splits[1:], per), (start >= np.repeat(splits[:-1], per)) & (total[1:] >= MIN_BLOCK)
    both = np.unique(np.concatenate([at[on] * (n + 1) + stop[on], start[upto] * (n + 1) + at[upto] + 1]))
    a, z = both // (n + 1), both % (n + 1)
    return a, z, span_hashes(mix(lines.view(np.uint64)), a, z)


def common_lines(a: np.ndarray, a_windows: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """Which lines of a lie in a block that b has: its least blocks are aligned with those of b, what was aligned goes, and what
    is left is aligned again, until no block is left that both have. b is read forward and backward in turn: of n blocks in
    any order one of both ways aligns the root of n at least, so few passes are needed. Repeats of an aligned block go with it."""
    first, stop, h = a_windows
    gone, held = np.zeros(len(a), bool), {}
    b_first, _, b_h = windows(b, b_sizes, np.array([0, len(b)]))
    for x, at in zip(b_h.tolist(), b_first.tolist()):
        held.setdefault(x, at)
    left = np.flatnonzero(np.isin(h, b_h))
    ahead = True
    while len(left):
        mine = list(dict.fromkeys(h[left].tolist()))
        own = set(mine)
        theirs = [x for x in held if x in own]
        found = align(mine, theirs if ahead else theirs[::-1])
        if not found and not ahead:
            break
        aligned = np.array([x for i, _, n in found for x in mine[i : i + n]], h.dtype)
        for k in left[np.isin(h[left], aligned)].tolist():
            i, z, j = int(first[k]), int(stop[k]), held[int(h[k])]
            if np.array_equal(a[i:z], b[j : j + z - i]):
                gone[i:z] = True
        left = left[~np.isin(h[left], aligned)]
        if len(left):
            left = left[~covered((first[left], stop[left], h[left]), gone)]
        ahead = not ahead
    return gone


def covered(own: tuple[np.ndarray, np.ndarray, np.ndarray], gone: np.ndarray) -> np.ndarray:
    """Which windows have no line that is left."""
    before = np.concatenate([[0], np.cumsum(gone)])
    return before[own[1]] - before[own[0]] == own[1] - own[0]


def keyed(docs: DataFrame) -> DataFrame:
    """Key (id, h) and text of every document, and the whole row as `doc`: names of other columns can't clash."""
    return docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("h"))


def linked(own: DataFrame) -> DataFrame:
    """(id, h, e_id, e_h, rarity), once each: each document with the nearest earlier one for every window that both have;
    rarity: how many documents of a block of ids have the rarest of these windows."""

    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lines, sizes = batch.column("hashes"), batch.column("sizes")
            splits = lines.offsets.to_numpy().astype(np.int64)
            flat = lambda x: x.values.to_numpy()[x.offsets[0].as_py() : x.offsets[-1].as_py()]
            first, _, h = windows(flat(lines), flat(sizes), splits - splits[0])
            row = np.searchsorted(splits - splits[0], first, "right") - 1
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
            take = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), batch.column("id").take(take), batch.column("h").take(take)], names=["window", "id", "h"])

    n, inner = own.where(F.col("id") != NULL_ID).agg(F.count(F.lit(1)), F.percentile_approx("id", [0.05, 0.95], 1000)).first()
    low, high = inner or (0, 0)  # outlying ids don't count
    bits = max(0, ((high - low) * BLOCK_DOCS // (n * 9 // 10 + 1)).bit_length() - 1) if n else 0  # ids of about BLOCK_DOCS documents
    each = own.select("id", "h", "hashes", "sizes").mapInArrow(explode, "window long, id long, h long").withColumn("block", F.shiftright("id", bits))
    key, in_block, in_all = F.struct("id", "h"), Window.partitionBy("window", "block").orderBy("id", "h"), Window.partitionBy("window").orderBy("id", "h")
    rarity = F.count(F.lit(1)).over(in_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("rarity")
    near = each.select("window", "id", "h", F.lag(key).over(in_block).alias("early"), F.lead(key).over(in_block).alias("late"), rarity)
    # What stands before the first of a block, among the ends of all blocks, is the last of the nearest earlier block.
    ends = near.where("early is null or late is null").withColumn("before", F.lag(key).over(in_all)).where("early is null and before is not null")
    found = near.where("early is not null").select("id", "h", "early", "rarity").unionAll(ends.select("id", "h", F.col("before").alias("early"), "rarity"))
    return found.groupBy("id", "h", F.col("early.id").alias("e_id"), F.col("early.h").alias("e_h")).agg(F.min("rarity").alias("rarity"))


def kept_lines(docs: DataFrame) -> DataFrame:
    """id, h, `keep` (a flag for each line) and `n_removed` of the documents that lose lines."""
    lines = F.split("text", "\n")
    listed = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("h"), F.transform(lines, lambda x: F.xxhash64(x)).alias("hashes"), F.transform(lines, lambda x: F.length(x)).alias("sizes"))
    own = stored(listed.dropDuplicates(["id", "h"]), "lines")
    early = own.select(F.col("id").alias("e_id"), F.col("h").alias("e_h"), "hashes", "sizes")
    pairs = linked(own).join(early, ["e_id", "e_h"]).select("id", "h", F.col("rarity").alias("kind"), "hashes", "sizes")
    # The rows of a document come together, its own lines first and then those of each earlier document, rare links first. The number of
    # partitions is given: the work is in Python, so few bytes aren't little work.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = own.select("id", "h", F.lit(0).cast("long").alias("kind"), "hashes", "sizes").unionByName(pairs).repartition(parts, "id", "h").sortWithinPartitions("id", "h", "kind")

    def diff(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = mine = seen = gone = None
        names, out = ["id", "h", "keep", "n_removed"], []

        def close() -> None:
            if gone is not None and gone.any():
                out.append((*key, (~gone).tolist(), int(gone.sum())))

        for batch in batches:
            own_id, own_h, kind = (batch.column(c).to_pylist() for c in ("id", "h", "kind"))
            for k in range(batch.num_rows):
                row = lambda c: batch.column(c)[k].values.to_numpy()
                if kind[k] == 0:
                    close()
                    key, mine, seen, gone = (own_id[k], own_h[k]), (row("hashes"), row("sizes")), None, None
                    continue
                if seen is None:
                    seen, gone = windows(*mine, np.array([0, len(mine[0])])), np.zeros(len(mine[0]), bool)
                if not gone.all():
                    gone |= common_lines(mine[0], tuple(w[~covered(seen, gone)] for w in seen), row("hashes"), row("sizes"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.bool_()), pa.int64()))], names=names)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.bool_()), pa.int64()))], names=names)

    return rows.mapInArrow(diff, "id long, h long, keep array<boolean>, n_removed long")


def without_lines(docs: DataFrame) -> DataFrame:
    """`doc` (the columns of docs; text less its deleted lines) and `n_removed` (how many; 0 for most)."""
    joined = keyed(docs).join(kept_lines(docs), ["id", "h"], "left")
    kept = F.array_join(F.filter(F.split("doc.text", "\n"), lambda x, i: F.get("keep", i)), "\n")
    text = F.when(F.col("keep").isNull(), F.col("doc.text")).otherwise(kept)
    return joined.select(F.struct(*[(text if c == "text" else F.col("doc").getField(c)).alias(c) for c in docs.columns]).alias("doc"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """Documents with repeated blocks deleted; a document that loses all its lines goes. n_chars follows the text where lines went."""
    kept = without_lines(docs).where("n_removed = 0 or doc.text <> ''")
    n_chars = lambda: F.when(F.col("n_removed") > 0, F.length("doc.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return kept.select(*[(n_chars() if c == "n_chars" else F.col("doc").getField(c)).alias(c) for c in docs.columns])


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    text = F.coalesce("doc.text", F.lit(""))
    return kept.select("doc.doc_id", F.length(text).cast("long").alias("n_kept_chars"), F.col("n_removed").alias("n_lines_removed"), F.sha2(text, 256).alias("kept_sha256"))
