"""Removal of long repeated byte strings, by a run-length index over the places where documents can overlap.

Every string of LENGTH bytes has one anchor: its leftmost least hash of GRAM bytes. Equal strings have equal anchors, so
a task cuts a text into contexts (neighbouring strings with one anchor) and sends for each only hashes of the anchor and
of the context, the document and the place. A context that an earlier document has as a whole is settled by its hash:
among the texts of one portion of a task at once, so that of a context that many documents share one row a portion is
sent, and then among all. Of the others the bytes are fetched, once for each different context.

Two contexts of an anchor that hold one string also agree in the SIDE bytes before the anchor or in those behind it; what
agrees with no other context is done, and the others form families. A hash of each string leaves out what can't repeat: only the stretch of a context from the first to the
last string whose hash an earlier document has as well is looked up, and of that string's places the one in the least document is
indexed (a run-compressed Burrows-Wheeler transform with sampled run ends). The stretches are streamed through the index once:
matching statistics of LENGTH bytes, and the least document of the window class that the match ends in, decide which
strings an earlier document has.

A family of more than HOT contexts (the edge of a passage that very many documents hold) is not sent to one task: its
contexts are taken apart into their strings, which are dealt by their own hash, one row for each portion of texts, and
streamed against the first of them. Places of a context that repeats within its first document follow as numbers.

Messages are packed: one row for a task slice and bucket, not for a place. Texts are dealt by a hash of the id into groups of about
GROUP_BYTES, the same for fetching and for the result.

Edge cases: null texts are empty; texts under LENGTH bytes keep all; a null doc_id counts as the smallest; rows that
share a doc_id aren't earlier than each other (equal rows lose the same bytes; of unequal ones each loses the places
marked for any of them); an empty table gives no rows. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .run_index import RunIndex
from .words import K1, K2, joined, mix, packed, raw_bytes, span_hashes, stored, text_slices, unpacked

LENGTH, GRAM = 50, 16
SIDE = (LENGTH - GRAM + 1) // 2  # a string has as many bytes on one side of its anchor
NULL_ID = -(1 << 63)
SLICE, BUCKET_BYTES, GROUP_BYTES, PARTS = 1 << 18, 32 << 20, 16 << 20, 2
MANY, HOT = 1 << 16, 2048
SETTLED, ASKED, COPIES, CONTEXTS = range(4)  # kinds of messages
PLACE = np.uint64((1 << 24) - 1)


def slide_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x, step = np.minimum(x[:-step], x[step:]), 2 * step
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def contexts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """For all contexts of the texts: start, strings in it, hash of the anchor (40 bits), of the context (48 bits), of the
    SIDE bytes before and of those behind the anchor (16 bits each; 0 if the context has fewer)."""
    n, window = len(data), LENGTH - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH or n >= 1 << 24:
        return (none, none, *[none.view(np.uint64)] * 2, *[none.astype(np.uint16)] * 2) if n < LENGTH else _long(data, off)
    words = np.ndarray((n - 7,), "<u8", data, 0, (1,))
    h = mix(words[: n - GRAM + 1] * K1 + words[8:] * K2)
    least = slide_min((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), window)
    sizes = np.diff(off)
    inside = np.zeros(n + 1, np.int32)
    long = sizes >= LENGTH
    np.add.at(inside, off[:-1][long], 1)
    np.add.at(inside, off[1:][long] - LENGTH + 1, -1)
    valid = np.cumsum(inside[: len(least)]) > 0
    owner = np.where(valid, (least & PLACE).astype(np.int64), -1)
    edge = np.ones(len(owner), bool)
    edge[1:] = owner[1:] != owner[:-1]
    edge[off[:-1][off[:-1] < len(owner)]] = True
    start = np.flatnonzero(edge)
    count = np.diff(start, append=len(owner))
    keep = owner[start] >= 0
    start, count = start[keep], count[keep]
    whole = span_hashes(data.astype(np.uint64) + np.uint64(1), start, start + count + LENGTH - 1)
    at = owner[start]
    sides = []
    for begin, ok in ((at - SIDE, at - SIDE >= start), (at + GRAM, at + GRAM + SIDE <= start + count + LENGTH - 1)):
        w = [words[np.clip(begin + k, 0, len(words) - 1)] for k in (0, 8, SIDE - 8)]
        sides.append(np.where(ok, np.maximum(mix(mix(w[0] * K1 + w[1]) * K1 + w[2]) >> np.uint64(48), np.uint64(1)), np.uint64(0)).astype(np.uint16))
    return start, count, h[at] >> np.uint64(24), whole >> np.uint64(16), *sides


def _long(data: np.ndarray, off: np.ndarray):
    """Texts of 16 MB and more, in stretches that overlap by LENGTH - 1 bytes; a context may be cut at a seam."""
    step = 8 << 20
    parts = []
    for k in range(len(off) - 1):
        for a in range(int(off[k]), max(int(off[k]) + 1, int(off[k + 1]) - LENGTH + 1), step):
            z = min(int(off[k + 1]), a + step + LENGTH - 1)
            s, *rest = contexts(data[a:z], np.array([0, z - a]))
            parts.append((s + a, *rest))
    return tuple(np.concatenate(x) for x in zip(*parts))


def together(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by the low bits of the keys, equal ones by place; where a new one begins in it), by a plain sort of numbers,
    which is the fastest there is. Keys that differ only in the bits for which a place leaves no room count as equal."""
    bits = np.uint64(max(1, len(key).bit_length()))
    both = np.sort(key << bits | np.arange(len(key), dtype=np.uint64))
    new = np.ones(len(both), bool)
    new[1:] = (both[1:] ^ both[:-1]) >> bits != 0
    return (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), new


def firsts(*keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by the keys and doc, where a new combination of the keys begins in that order)."""
    order = np.lexsort((doc, *keys[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    return order, new


def message(rows: list[tuple[int | None, int | None, int, bytes, bytes | None]]) -> pa.Table:
    """Rows (key of the next step, group, kind, data, bytes)."""
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate((("key", pa.int64()), ("group", pa.int64()), ("kind", pa.int32()), ("data", pa.binary()), ("bytes", pa.binary())))})


MESSAGE = "key long, group long, kind int, data binary, bytes binary"


def crc_of(doc: np.ndarray) -> np.ndarray:
    unique, back = np.unique(doc, return_inverse=True)
    return np.array([zlib.crc32(b"%d" % d) for d in unique.tolist()], np.int64)[back]  # group_of() says the same to Spark


def grouped(groups: int, kind: int, doc: np.ndarray, *columns: np.ndarray, keys: int = 0) -> list:
    """Messages of the packed doc and columns for each group of texts; a key from 0 to keys deals them over tasks."""
    if not len(doc):
        return []
    crc = crc_of(doc)
    group = crc % groups
    order, new = together(group.astype(np.uint64))
    return [(int((group[o[0]] * 7919 + crc[o[0]] // groups) % keys) if keys else None, int(group[o[0]]), kind, packed(doc[o], *[c[o] for c in columns]), None) for o in np.split(order, np.flatnonzero(new)[1:])]


def group_of(groups: int) -> Column:
    """The group of a text: by a hash of its id, so that ids with a common step are spread as well."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(groups))


def by_key(key: np.ndarray, kind: int, *columns: np.ndarray) -> list:
    """Messages of the packed columns for each key."""
    if not len(key):
        return []
    order, new = together(key.astype(np.uint64))
    return [(int(key[o[0]]), None, kind, packed(*[c[o] for c in columns]), None) for o in np.split(order, np.flatnonzero(new)[1:])]


def sketch(docs: DataFrame, buckets: int, groups: int) -> DataFrame:
    """Messages to buckets: hashes, documents and places of contexts, about MANY * 8 of them a round. What an earlier
    document of the same round has as a whole is settled at once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            start, count, anchor, whole, left, right, doc = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order, new = together(mix(anchor * K1 + whole))
            new[1:] |= (anchor[order[1:]] != anchor[order[:-1]]) | (whole[order[1:]] != whole[order[:-1]])
            done = np.zeros(len(doc), bool)
            done[order] = doc[order] > np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]
            rows = by_key(crc_of(doc[done]) % groups % buckets, SETTLED, doc[done], start[done].astype(np.uint32), count[done].astype(np.uint32))
            rest = ~done
            rows += by_key((anchor[rest] % np.uint64(buckets)).astype(np.int64), CONTEXTS, anchor[rest], whole[rest], doc[rest], start[rest].astype(np.uint32), count[rest].astype(np.uint8), left[rest], right[rest])
            return message(rows).combine_chunks().to_batches()[0]

        for batch, text in text_slices(batches, limit=SLICE):
            data, off = raw_bytes(text)
            start, *rest = contexts(data, off)
            row = np.searchsorted(off, start, "right") - 1
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)[row]
            held.append((start - off[row], *rest, doc))
            size += len(start)
            if size >= 8 * MANY:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, MESSAGE)


CONTEXT = ("<u8", "<u8", "<i8", "<u4", "u1", "<u2", "<u2")  # anchor, whole, doc, start, count, left, right
SPAN = ("<i8", "<u4", "<u4")  # doc, start, count
ASK = ("<i8", "<u4", "u1", "<u4", "<u8", "u1")  # doc, start, count, part, key of the context, whether its family is hot
COPY = ("<u8", "<i8", "<u4")  # key, doc, start
STRING = ("<i8", "<u4", "u1", "<u8")  # doc, start, count, key


def kind_of(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pc.equal(table["kind"], kind))


def families(anchor: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each context: that of the first one of its family (those linked by equal sides of one anchor)."""
    label, links = np.arange(len(anchor)), []
    for side in (left, right):
        on = np.flatnonzero(side)
        key = (anchor[on].astype(np.uint64) << np.uint64(16)) | side[on]
        order = np.argsort(key, kind="stable")
        on, begin = on[order], np.flatnonzero(np.diff(key[order], prepend=np.uint64(2**64 - 1)))
        links.append((on, begin, np.repeat(np.arange(len(begin)), np.diff(begin, append=len(on)))))
    while True:
        before = label.copy()
        for on, begin, of in links:
            if len(on):
                label[on] = np.minimum.reduceat(label[on], begin)[of]
        if np.array_equal(before, label):
            return label


def settle(groups: int, parts: int, hot: int):
    """For one bucket: spans that are settled, contexts whose bytes are asked for, other places of those.

    Its families are dealt over `parts` index tasks.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = grouped(groups, SETTLED, *joined(kind_of(table, SETTLED)["data"].to_pylist(), *SPAN))  # those of a few groups, from all rounds
        blobs = kind_of(table, CONTEXTS)["data"].to_pylist()
        anchors = [unpacked(b, CONTEXT[0])[0] for b in blobs]
        if not anchors:
            return message(rows)
        order, new = together(np.concatenate(anchors))
        number = np.diff(np.flatnonzero(new), append=len(new))
        often = np.zeros(len(order), bool)
        often[order] = np.repeat(number > 1, number)  # an anchor that stands alone shares nothing
        if not often.any():
            return message(rows)
        kept = np.split(often, np.cumsum([len(x) for x in anchors])[:-1])
        anchor, whole, doc, start, count, left, right = (np.concatenate(x) for x in zip(*([c[k] for c in unpacked(b, *CONTEXT)] for b, k in zip(blobs, kept))))
        order = np.lexsort((start, doc, whole, anchor))
        anchor, whole, doc, start, count, left, right = (x[order] for x in (anchor, whole, doc, start, count, left, right))
        new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new_whole = new_anchor | np.concatenate([[True], whole[1:] != whole[:-1]])
        w0, w = np.flatnonzero(new_whole), np.cumsum(new_whole) - 1
        done = doc > doc[w0][w]  # sorted by doc within a context
        rows += grouped(groups, SETTLED, doc[done], start[done], count[done].astype(np.uint32))
        label = families((np.cumsum(new_anchor) - 1)[w0], left[w0], right[w0])
        many = np.bincount(label, minlength=len(w0))  # different contexts of each family
        ask = ~done & (many[label] > 1)[w]
        part = (int(table["key"][0].as_py()) * parts + (mix(label.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)).astype(np.uint32)[w]
        key, apart = mix(anchor * K1 + whole), (many > hot)[label][w]
        own = ask & (new_whole | apart)  # of a hot family all places are taken apart
        rows += grouped(groups, ASKED, doc[own], start[own], count[own], part[own], key[own], apart[own].astype(np.uint8))
        copy = ask & ~own
        rows += by_key(part[copy].astype(np.int64), COPIES, key[copy], doc[copy], start[copy])
        return message(rows)

    return run


def rows_of(docs: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which asked entry, row) for every row of docs that has the asked id."""
    order = np.argsort(docs, kind="stable")
    lo, hi = np.searchsorted(docs[order], asked, "left"), np.searchsorted(docs[order], asked, "right")
    n = hi - lo
    entry = np.repeat(np.arange(len(asked)), n)
    return entry, order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(entry))]


def one_text(table: pa.Table) -> pa.Array:
    text = table["text"].combine_chunks()
    return text.chunk(0) if isinstance(text, pa.ChunkedArray) else text


def string_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the LENGTH bytes at each place."""
    words, h = np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,)), np.zeros(len(at), np.uint64)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        h = mix(h * K1 + words[at + k])
    return h


def counted(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, step): every k as often as n[k] says, with steps from 0."""
    each = np.repeat(np.arange(len(n)), n)
    return each, np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)


def fetch(groups: int, all_parts: int):
    """The bytes of the contexts that are asked of a group of texts; those of hot families as single strings."""

    def run(texts: pa.Table, asks: pa.Table) -> pa.Table:
        rows: list = []
        if asks.num_rows and texts.num_rows:
            doc, start, count, part, key, apart = joined(asks["data"].to_pylist(), *ASK)
            data, off = raw_bytes(one_text(texts))
            entry, row = rows_of(texts["doc_id"].to_numpy(), doc)
            a = off[row] + start[entry]
            ok = a + count[entry] + LENGTH - 1 <= off[row + 1]
            entry, a = entry[ok], a[ok]
            cool = apart[entry] == 0
            e = entry[cool]
            rows += strings(data, a[cool], doc[e], start[e], count[e], part[e], key[e])
            if not cool.all():
                e = entry[~cool]
                each, step = counted(count[e].astype(np.int64))
                at, owner, place = a[~cool][each] + step, doc[e][each], (start[e][each] + step).astype(np.uint32)
                h = string_hashes(data, at)
                order, new = firsts(h, doc=owner)
                at, owner, place, h = at[order], owner[order], place[order], h[order]
                later = owner > owner[np.flatnonzero(new)][np.cumsum(new) - 1]
                rows += grouped(groups, SETTLED, owner[later], place[later], np.ones(later.sum(), np.uint32), keys=all_parts)
                to = (h % np.uint64(all_parts)).astype(np.uint32)
                rows += strings(data, at[new], owner[new], place[new], np.ones(new.sum(), np.uint8), to[new], h[new])
                copy = ~new & ~later
                rows += by_key(to[copy].astype(np.int64), COPIES, h[copy], owner[copy], place[copy])
        return message(rows)

    return run


def strings(data: np.ndarray, at: np.ndarray, doc, start, count, part, key) -> list:
    """Messages to index tasks with the bytes of some contexts."""
    if not len(at):
        return []
    rows, order = [], np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order].astype(np.int64), prepend=-1))
    for o in np.split(order, cuts[1:]):
        n = count[o].astype(np.int64) + LENGTH - 1
        bytes_ = data[np.repeat(at[o] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        rows.append((int(part[o[0]]), None, ASKED, packed(doc[o], start[o], count[o], key[o]), packed(bytes_)))
    return rows


def repeating(text: np.ndarray, base: np.ndarray, count: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of contexts that may matter, (context, first string, strings) to index and the same to look up: by hashes
    of the strings, what an earlier document may have as well, and its first place in the least document. Equal strings
    have equal hashes, so nothing is missed; whether strings are equal isn't decided here."""
    by_doc = np.argsort(doc, kind="stable")
    each, step = counted(count[by_doc].astype(np.int64))
    each = by_doc[each]
    order, new = together(string_hashes(text, base[each] + step))
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # the least document of a hash
    later = doc[each[order]] > doc[each[head]]
    out = []
    for place in (head[later], order[later]):
        is_in = np.zeros(len(each), bool)
        is_in[place] = True
        at = np.flatnonzero(is_in)  # in order, so the places of a context stand together
        begin = np.flatnonzero(np.diff(each[at], prepend=-1))
        first = step[at[begin]]
        out += [each[at[begin]], first, step[at[np.append(begin[1:], len(at)) - 1]] - first + 1] if len(at) else [at, at, at]
    return tuple(out)


def marked(groups: int):
    """Index and stream the contexts of one part, and return the spans that an earlier document has."""

    def run(table: pa.Table) -> pa.Table:
        own, rows = kind_of(table, ASKED), []
        doc, start, count, key = joined(own["data"].to_pylist(), *STRING)
        text = joined(own["bytes"].to_pylist(), "u1")[0]
        size = count.astype(np.int64) + LENGTH - 1
        base = np.cumsum(size) - size
        early, e0, en, late, l0, ln = repeating(text, base, count, doc)
        if len(late):
            both, n = np.concatenate([early, late]), np.concatenate([en, ln])
            which, a, z = earlier(text, base[both] + np.concatenate([e0, l0]), n + LENGTH - 1, doc[both], np.arange(len(early)), len(early) + np.arange(len(late)))
            o, a, z = late[which], a + l0[which], z + l0[which]
            spans = [(doc[o], start[o] + a, z - a)]
            copied = joined(kind_of(table, COPIES)["data"].to_pylist(), *COPY)
            order = np.argsort(copied[0], kind="stable")
            copy_key, copy_doc, copy_start = (c[order] for c in copied)
            lo, hi = np.searchsorted(copy_key, key[o], "left"), np.searchsorted(copy_key, key[o], "right")
            each, step = counted(hi - lo)
            c = lo[each] + step
            same = copy_doc[c] == doc[o][each]
            c, each = c[same], each[same]
            spans.append((copy_doc[c], copy_start[c] + a[each], (z - a)[each]))
            doc, start, count = (np.concatenate(x) for x in zip(*spans))
            rows = grouped(groups, SETTLED, doc, start.astype(np.uint32), count.astype(np.uint32))
        return pa.concat_tables([message(rows), kind_of(table, SETTLED)])

    return run


def earlier(text: np.ndarray, base: np.ndarray, size: np.ndarray, doc: np.ndarray, early: np.ndarray, late: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which of late, first, behind the last) of the runs of strings that a context of `early` with a smaller document has."""
    take = lambda k: text[np.repeat(base[k] - (np.cumsum(size[k]) - size[k]), size[k]) + np.arange(size[k].sum())]
    index = RunIndex(take(early), size[early], doc[early], LENGTH)
    length, window = index.statistics(take(late), size[late])
    of = np.repeat(np.arange(len(late)), size[late])
    hit = length >= LENGTH
    hit[hit] = index.least[window[hit]] < doc[late][of[hit]]
    same = of[1:] == of[:-1]
    begin = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1] & same]))
    stop = np.flatnonzero(hit & ~np.concatenate([hit[1:] & same, [False]])) + 1
    first = np.cumsum(size[late]) - size[late]
    return of[begin], begin - first[of[begin]], stop - first[of[begin]]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def finish(with_text: bool):
    """Join the spans of a group of texts and take them out."""

    def run(texts: pa.Table, spans: pa.Table) -> pa.Table:
        doc, start, count = joined(spans["data"].to_pylist(), *SPAN)
        data, off = raw_bytes(one_text(texts)) if texts.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        ids = texts["doc_id"].to_numpy()
        entry, row = rows_of(ids, doc)
        a = np.minimum(off[row] + start[entry], off[row + 1])
        z = np.minimum(a + count[entry] + LENGTH - 1, off[row + 1])
        a, z, row = (x[z > a] for x in (a, z, row))
        order = np.argsort(a, kind="stable")
        a, z, row, n = a[order], z[order], row[order], len(ids)
        far = np.maximum.accumulate(z)
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] > far[:-1]) | (row[1:] != row[:-1])  # spans that touch are one, within a text
        head = np.flatnonzero(new)
        a, z, row = a[head], far[np.append(head[1:], len(far)) - 1] if len(head) else z, row[head]
        removed, n_spans = np.zeros(n, np.int64), np.bincount(row, minlength=n)
        np.add.at(removed, row, z - a)
        change = np.zeros(len(data) + 1, np.int8)
        change[a] += 1
        change[z] -= 1
        kept = data[np.cumsum(change[:-1], dtype=np.int8) == 0].tobytes()
        ends = off - np.concatenate([[0], np.cumsum(removed)])
        parts = [kept[ends[k] : ends[k + 1]] for k in range(n)]
        return pa.table({
            "doc_id": pa.array([None if i == NULL_ID else i for i in ids.tolist()], pa.int64()), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(removed),
            "n_spans": pa.array(n_spans), "kept_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()),
            "kept": pa.array(parts if with_text else [None] * n, pa.binary())})

    return run


def without_repeats(docs: DataFrame, with_text: bool = True, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) of every document."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, groups = max(1, min(MANY, -(-size // bucket_bytes))), max(1, -(-size // GROUP_BYTES)) | 1
    hints = stored(sketch(docs, buckets, groups).repartition(buckets * PARTS, "key").groupBy("key").applyInArrow(settle(groups, PARTS, hot), MESSAGE), "repeat-hints")
    dealt = docs.withColumn("group", group_of(groups))
    asked = hints.where(F.col("kind") == ASKED).select("group", "data")
    texts = dealt.groupBy("group").cogroup(asked.groupBy("group")).applyInArrow(fetch(groups, buckets * PARTS), MESSAGE)
    found = texts.unionByName(hints.where(F.col("kind") == COPIES)).repartition(buckets * PARTS, "key").groupBy("key").applyInArrow(marked(groups), MESSAGE)
    spans = found.unionByName(hints.where(F.col("kind") == SETTLED)).select("group", "data")
    return dealt.groupBy("group").cogroup(spans.groupBy("group")).applyInArrow(finish(with_text), RESULT)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).drop("kept")
