"""N-gram Jaccard join: all links between documents whose shingle sets reach a Jaccard similarity.

The shingles of a document are ordered rare first, by counts over all documents kept in 2**COUNT_BITS counters (shared
counters only change the order, never the result). Documents with equal sets form one class. Two classes that reach the
similarity share a shingle in their prefixes; pairs come from those shingles, pass the length, positional and suffix
filters, and are verified once with their whole sets. The suffix filter compares parities of the counts of shingles in
buckets (a power of two, as many as shingles or more): each differing bucket is at least one shingle that only one set
has. Sets whose numbers of buckets differ are compared by the smaller number: halves of the larger fold by XOR.

Pairs come in two rounds, so that a group of copies doesn't emit all its pairs: first each class with one likely partner
among the next smaller ones of its shingles' groups; then the pairs of a group that aren't yet in one component, tried
inside a task and emitted only if they pass all filters. Together they hold every link that could join two components.
In the second round a pair counts only at the first shingle that both have in the common order: there, none before it is
shared, so the smaller set has it very early (an index row). Groups without an index row hold no pair; of a large group
the rows are dealt over tasks of about PORTION rows, each with all index rows of the group.

Edge cases: null and empty texts have no shingles and no links (n_shingles 0, their own component); a text with fewer
words than a shingle is one shingle; a very long text is read whole, in a slice of its own, and its whole set goes only to
where it is a candidate; rows that share a doc_id count as one document; a null doc_id is never linked and has a null
component; an empty table gives no rows. Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .components import components
from .words import SPACED, Words, discard, inside, mix, run_hash, stored, text_slices

WORDS, PERCENT = 3, 90
COUNT_BITS, LEAST_BINS = 22, 256
BROADCAST_IDS = 500_000  # 8 bytes each
PORTION = 512


def shingles(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number of texts' rows) of each distinct n-word shingle, sorted by text and hash."""
    words = Words(text, SPACED)
    h, rows, counts = words.hashes(), words.rows(), words.counts
    g = run_hash(h, n)
    ok = inside(words.splits, n, len(h))
    parts, owners = [g[ok]], [rows[: len(g)][ok]]
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        if len(short):
            parts.append(run_hash(h, k)[words.splits[short]])
            owners.append(short)
    g, rows = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(g)
    order = order[np.argsort(rows[order], kind="stable")]
    g, rows = g[order], rows[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (rows[1:] != rows[:-1])
    return g[first], rows[first]


def cell(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def set_keys(g: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """16 bytes for each set: equal for equal sets."""
    ends = np.cumsum(sizes)
    a, b = (np.concatenate([[np.uint64(0)], np.cumsum(mix(g + np.uint64(s)))]) for s in (1, 2))
    out = np.stack([x[ends] - x[ends - sizes] for x in (a, b)] + [sizes.astype(np.uint64)], axis=1)
    return [r.tobytes() for r in np.stack([mix(out[:, 0] + out[:, 2]), mix(out[:, 1] ^ out[:, 2])], axis=1)]


def shingle_counts(docs: DataFrame, n: int) -> np.ndarray:
    """For each counter how often its shingles occur, on a scale of logarithms: a fixed number of bytes.

    A task counts up to 255 for each counter; only the order of shingles depends on it.
    """
    width = 1 << 14

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for _, text in text_slices(batches):
            words = Words(text, SPACED)
            g = run_hash(words.hashes(), n)
            total += np.bincount(cell(g[inside(words.splits, n, len(words))]), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) // width)), pa.array([r.astype(np.uint8).tobytes() for r in np.minimum(total, 255).reshape(-1, width)], pa.binary())], names=["part", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.uint8).astype(np.int64) for c in group["counts"].to_pylist())
        return pa.table({"part": group["part"].slice(0, 1), "counts": pa.array([np.minimum(np.round(np.log2(1 + total) * 10), 255).astype(np.uint8).tobytes()], pa.binary())})

    found = docs.select("text").mapInArrow(count, "part long, counts binary").groupBy("part").applyInArrow(add, "part long, counts binary").collect()
    rank = np.zeros(1 << COUNT_BITS, np.uint8)
    for part, counts in found:
        rank[part * width : (part + 1) * width] = np.frombuffer(counts, np.uint8)
    return rank


def parities(g: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64 parities in a number, for all sets; where the numbers of each set begin and end)."""
    bins = np.maximum(LEAST_BINS, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(bins)])
    at = ends[rows] + (mix(g) & (bins[rows] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=ends[-1]) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8"), (ends // 64).astype(np.int32)


def folded(parity, other):
    """parity by as many buckets as other has, if it has twice as many (an expression)."""
    n = F.size(other)
    return F.when(F.size(parity) <= n, F.col(parity)).otherwise(F.transform(F.slice(parity, F.lit(1), n), lambda x, i: x.bitwiseXOR(F.get(parity, i + n))))


def prefixes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, size, key (of the set), prefix (rare first), parity for each document."""
    sent = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, n))
    names = ["doc_id", "size", "key", "prefix", "parity"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sent.value
        for batch, text in text_slices(batches):
            g, rows = shingles(text, n)
            sizes = np.bincount(rows, minlength=len(text))
            keys = set_keys(g, rows, sizes)
            parity, ends = parities(g, rows, sizes)
            length = np.where(sizes > 0, sizes - (percent * sizes + 99) // 100 + 1, 0)
            order = np.argsort((rows.astype(np.uint64) << np.uint64(8)) | rank[cell(g)], kind="stable")  # ties: by hash
            place = np.arange(len(g)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kept = order[place < length[rows]]
            split = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(split, pa.array(g[kept].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(parity))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, size long, key binary, prefix array<long>, parity array<long>")


def need(x: str, y: str, percent: int):
    """Shared shingles that two sets of these sizes need."""
    return F.expr(f"ceil({percent} * ({x} + {y}) / {100 + percent})")


def neighbours(listed: DataFrame, percent: int) -> DataFrame:
    """Rows (gram, rep, size, pos) of classes that have another class of a fitting size in the shingle's group, each with
    a partner (b, b_size, b_pos): the smallest class of about its size, so that copies get the same partner in all their
    groups, or else the one before it in order of size. One shuffle, and a row for a row."""
    w = Window.partitionBy("gram").orderBy("size", "rep")
    mine = F.struct("rep", "size", "pos")
    fits = lambda small, large: F.coalesce(100 * small >= percent * large, F.lit(False))
    rows = listed.withColumn("x", F.lag(mine).over(w)).withColumn("after", F.lead("size").over(w)).withColumn("near", fits(F.col("x.size"), F.col("size")))
    rows = rows.where(F.col("near") | fits(F.col("size"), F.col("after"))).withColumn("scale", F.floor(F.log("size") / F.log(F.lit(100 / percent))))
    rows = rows.withColumn("y", F.min(mine).over(Window.partitionBy("gram", "scale")))
    partner = F.when(F.col("y.rep") != F.col("rep"), F.col("y")).when(F.col("near"), F.col("x"))
    return rows.withColumn("z", partner).select("gram", "rep", "size", "pos", F.col("z.rep").alias("b"), F.col("z.size").alias("b_size"), F.col("z.pos").alias("b_pos"))


def passing(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) that pass the length and positional filters; pairs: a, a_size, a_pos and the same for b."""
    left = F.least(F.col("a_size") - F.col("a_pos"), F.col("b_size") - F.col("b_pos"))
    ok = (100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size")) & (F.least("a_pos", "b_pos") + left >= need("a_size", "b_size", percent))
    return pairs.where(ok).select("a", "b").distinct()


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, percent: int, one_each: bool = False) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity, after the suffix filter. one_each: only one likely pair of
    each a is verified (the others are left to a later round)."""
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("size").alias(f"{c}_size"), F.col("parity").alias(f"{c}_parity"))
    apart = F.aggregate(F.zip_with(folded("a_parity", "b_parity"), folded("b_parity", "a_parity"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    likely = pairs.join(side("a"), "a").join(side("b"), "b").where(apart <= F.col("a_size") + F.col("b_size") - 2 * need("a_size", "b_size", percent)).select("a", "b")
    likely = stored(likely.groupBy("a").agg(F.min("b").alias("b")) if one_each else likely.distinct(), "pairs")
    ids = stored(likely.select(F.col("a").alias("rep")).union(likely.select("b")).distinct().join(classes.select("rep", "key"), "rep"), "needed")
    # The ids are broadcast only up to a fixed number; beyond it Spark joins by shuffle.
    wanted = ids.count()
    small = F.broadcast if wanted <= BROADCAST_IDS else lambda x: x
    needed = small(ids.select(F.col("rep").alias("doc_id")))

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in text_slices(batches):
            g, rows = shingles(text, n)
            sizes = np.bincount(rows, minlength=len(text))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(set_keys(g, rows, sizes), pa.binary()), pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(g.view(np.int64)))], names=["rep", "key", "grams"])

    found = docs.select("doc_id", "text").join(needed, "doc_id", "left_semi").mapInArrow(sets, "rep long, key binary, grams array<long>")
    found = kept = stored(found.join(small(ids), ["rep", "key"], "left_semi").select("rep", "grams"), "sets")
    if found.count() > wanted:  # rows that repeat
        found = found.dropDuplicates(["rep"])

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                flat, n = [], []
                for c in ("x", "y"):
                    sets = batch.column(c)
                    n.append(np.diff(sets.offsets.to_numpy()))
                    flat.append(sets.flatten().to_numpy())
                row, value = np.concatenate([np.repeat(np.arange(batch.num_rows), k) for k in n]), np.concatenate(flat)
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                twice = (row[1:] == row[:-1]) & (value[1:] == value[:-1])  # a set has each shingle once
                both = np.bincount(row[1:][twice], minlength=batch.num_rows)
                keep = 100 * both >= percent * (n[0] + n[1] - both)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    whole = likely.join(found.select(F.col("rep").alias("a"), F.col("grams").alias("x")), "a").join(found.select(F.col("rep").alias("b"), F.col("grams").alias("y")), "b")
    links = stored(whole.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "links")
    discard(likely, ids, kept)
    return links


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """Buckets in which two sets differ, after folding to the smaller number of buckets."""
    n = min(len(x), len(y))
    x, y = (p.reshape(-1, n) for p in (x, y))
    return int(np.bitwise_count(np.bitwise_xor.reduce(x, axis=0) ^ np.bitwise_xor.reduce(y, axis=0)).sum())


def cross_pairs(part: np.ndarray, rep: np.ndarray, size: np.ndarray, pos: np.ndarray, index: np.ndarray, probe: np.ndarray, parity: list[np.ndarray], percent: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an index row and a probe row of one shingle's group that lie in different components and pass all filters;
    in blocks of bounded size."""
    out, index, probe = [np.zeros((2, 0), np.int64)], np.flatnonzero(index), np.flatnonzero(probe)
    for i0 in range(0, len(index), block):
        for j0 in range(0, len(probe), block):
            i, j = index[i0 : i0 + block][:, None], probe[j0 : j0 + block][None, :]
            low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            needed = -(-percent * (size[i] + size[j]) // (100 + percent))
            ok = (part[i] != part[j]) & (100 * low >= percent * high)
            ok &= np.minimum(size[i] - pos[i], size[j] - pos[j]) >= needed  # if none before is shared
            a, b = np.nonzero(ok)
            a, b = i[a, 0], j[0, b]
            apart = np.fromiter((differing(parity[x], parity[y]) for x, y in zip(a, b)), np.int64, len(a))
            keep = apart <= size[a] + size[b] - 2 * -(-percent * (size[a] + size[b]) // (100 + percent))
            out.append(np.stack([rep[a[keep]], rep[b[keep]]]))
    x = np.concatenate(out, axis=1)
    return np.minimum(x[0], x[1]), np.maximum(x[0], x[1])


def across(placed: DataFrame, classes: DataFrame, percent: int, portion: int = PORTION) -> DataFrame:
    """Distinct (a, b) of classes that share a prefix shingle, lie in different components and pass the filters.

    Groups with one component, or without an index row, are left out first. The others come sorted, so a task holds one
    portion of a group at a time; pairs are tried within it and only those that pass all filters are emitted.
    """
    early = F.expr(f"size - pos >= ceil({2 * percent} * size / {100 + percent})")
    marked = placed.withColumn("index", early)
    several = marked.groupBy("gram").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("n"), F.max("index").alias("any")).where("low <> high and any")
    several = several.select("gram", F.ceil(F.col("n") / portion).alias("portions"))
    own = F.pmod(F.xxhash64("rep"), F.col("portions"))
    rows = marked.join(several, "gram").join(classes.select("rep", "parity"), "rep").withColumn("own", own)
    dealt = rows.withColumn("to", F.explode(F.when(F.col("index"), F.sequence(F.lit(0).cast("long"), F.col("portions") - 1)).otherwise(F.array("own"))))
    dealt = dealt.withColumn("probe", F.col("to") == F.col("own")).withColumn("gram", F.when(F.col("portions") > 1, F.xxhash64("gram", "to")).otherwise(F.col("gram")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(done: pa.Table) -> pa.RecordBatch:
            gram, part, rep, size, pos, index, probe = (done[c].to_numpy() for c in ("gram", "part", "rep", "size", "pos", "index", "probe"))
            whole = done["parity"].combine_chunks()
            whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
            ends = whole.offsets.to_numpy()
            parity = np.split(whole.values.to_numpy().view(np.uint64), ends[1:-1]) if not whole.offset and ends[0] == 0 else [x.values.to_numpy().view(np.uint64) for x in whole]
            cuts = np.append(np.flatnonzero(np.diff(gram, prepend=gram[:1] + 1)), len(gram))
            found = [cross_pairs(*(x[a:z] for x in (part, rep, size, pos, index, probe)), parity[a:z], percent) for a, z in zip(cuts[:-1], cuts[1:])]
            a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            a, b = np.unique(np.stack([a, b]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column("gram")[batch.num_rows - 1].as_py()
            split = int(np.searchsorted(batch.column("gram").to_numpy(), last, "left"))
            if split or held and held[-1].column("gram")[0].as_py() != last:
                done = pa.Table.from_batches([*held, batch.slice(0, split)])
                held = []
                if done.num_rows:
                    yield pairs(done)
            held.append(batch.slice(split))
        if held:
            yield pairs(pa.Table.from_batches(held))

    ordered = dealt.select("gram", "part", "rep", "size", F.col("pos").cast("long").alias("pos"), "index", "probe", "parity").repartition("gram").sortWithinPartitions("gram")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def similar(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every document."""
    every = stored(prefixes(docs, n, percent), "prefixes")
    rows = every.where("doc_id is not null and size > 0")
    reps = rows.groupBy("key").agg(F.min("doc_id").alias("rep"))
    classes = stored(rows.withColumnRenamed("doc_id", "rep").join(reps, ["rep", "key"]).dropDuplicates(["rep", "key"]), "classes")  # a key has one rep
    shared = stored(neighbours(classes.select("rep", "size", F.posexplode("prefix").alias("pos", "gram")), percent), "shared")
    chains = shared.where("b is not null").select(F.col("rep").alias("a"), F.col("size").alias("a_size"), F.col("pos").alias("a_pos"), "b", "b_size", "b_pos")
    links = verified(docs, classes, passing(chains, percent), n, percent, one_each=True)

    parts = components(links)
    placed = shared.join(parts, F.col("rep") == F.col("node"), "left").select("gram", "rep", "size", "pos", F.coalesce("component", "rep").alias("part"))
    placed = stored(placed, "placed")
    discard(shared)
    links = links.unionByName(verified(docs, classes, across(placed, classes, percent), n, percent))
    discard(placed)

    parts = components(links)
    named = classes.select("key", "rep").join(parts, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    out = every.select("doc_id", F.col("size").alias("n_shingles"), "key").join(named, "key", "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))
