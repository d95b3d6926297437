"""Byte-pair encoding and decoding with a byte-level vocabulary file, as the tokenizers library does it.

Texts are cut into words by array operations over their code points (the rule of byte-level vocabularies: contractions,
letters, numbers, other signs, each with a space before it, and white space). What a code point is, letter, number, white
space or other, is asked of the library once, so both follow the same Unicode version. The distinct words of a slice go
through merge rounds together: their symbols lie in one flat array, the rank of each neighbouring pair is found by binary
search over the sorted keys of all pairs, and every word merges its pair of lowest rank. Words of more than LONG symbols
take the pairs rank by rank over linked symbols, so a run of a million letters costs in proportion to its merges.

A worker keeps the ids of words it has met (KEEP of them at most, then it starts again). Texts are taken in slices of a
megabyte; a longer text is cut before white space, where no word can reach across, about 40 bytes a code point of a slice.

Edge cases: a null or empty text has no ids and decodes to the empty text; the special token's string within a text is
that token; ids outside of the vocabulary decode to nothing; bytes that aren't UTF-8 decode to U+FFFD; repeated rows and
null ids stand as they are; an empty table gives no rows; the very longest texts need a slice only if they hold white
space. Only doc_id is carried besides the results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .words import raw_bytes, text_slices

LONG, KEEP = 128, 300_000
SLICE, IDS = 1 << 20, 1 << 19  # bytes of text, ids taken at once (a longer text stands alone)
NONE = np.int32(1 << 30)
OTHER, LETTER, NUMBER, WHITE, UNASKED = range(5)
ASCII_SPACE = b" \t\n\v\f\r"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merges:
    """The merge rules: sorted keys of pairs, with the rank and the merged symbol of each."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.key_of, self.made = keys, np.array([vocab[a + b] for a, b in merges], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; NONE where there is no such rule."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def rounds(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of `size` symbols each behind one another, merged: (symbols, sizes)."""
        word = np.repeat(np.arange(len(size)), size)
        done_sym, done_word = [], []
        last = lambda w: np.append(w[1:] != w[:-1], True)
        rank = np.where(last(word), NONE, self.rank(sym, np.append(sym[1:], 0))) if len(sym) else np.zeros(0, np.int32)
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            if (over := best == NONE).any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank, best = sym[~over], word[~over], rank[~over], best[~over]
                if not len(sym):
                    break
            hit = alternate(rank == best)
            sym[hit] = self.made[best[hit]]
            gone = np.append(False, hit[:-1])
            sym, word, rank, new = sym[~gone], word[~gone], rank[~gone], hit[~gone]
            at = np.flatnonzero(new | np.append(new[1:], False))  # pairs with a merged symbol on either side
            rank[at] = self.rank(sym[at], np.append(sym[1:], 0)[at])
            rank[last(word)] = NONE
        if not done_sym:
            return sym, size
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(size))

    def by_rank(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for long words: pairs wait by rank, and a merge touches its neighbours alone. A new pair always ranks
        behind the one that made its symbol, so each rank comes once for all words."""
        word = np.repeat(np.arange(len(size)), size)
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(size)
        after[ends - 1], before[ends - size] = -1, -1
        alive, waiting, heap = np.ones(n, bool), {}, []

        def put(at: np.ndarray) -> None:
            at = at[after[at] >= 0]
            rank = self.rank(sym[at], sym[after[at]])
            at, rank = at[rank < NONE], rank[rank < NONE]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for part, r in zip(np.split(at, cuts), rank[np.append(0, cuts)].tolist() if len(at) else []):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(part)

        put(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (after[at] >= 0)]
            at = at[self.rank(sym[at], sym[after[at]]) == r]
            if not len(at):
                continue
            chained = np.append(False, after[at[:-1]] == at[1:])  # x x x: the second pair begins within the first
            at = at[alternate(chained, lead=True)] if chained.any() else at
            right = after[at]
            sym[at], alive[right], after[at] = self.made[r], False, after[right]
            inner = after[at] >= 0
            before[after[at[inner]]] = at[inner]
            put(np.unique(np.concatenate([at, before[at][before[at] >= 0]])))
        return sym[alive], np.bincount(word[alive], minlength=len(size))


def alternate(flags: np.ndarray, lead: bool = False) -> np.ndarray:
    """Of each stretch of set flags the first, third, ... (pairs that overlap are merged from the left). lead: the flag
    stands for "overlaps the one before", so a stretch begins one place earlier."""
    at = np.arange(len(flags))
    start = np.maximum.accumulate(np.where(flags, -1, at)) if len(flags) else at
    return (at - start) % 2 == 0 if lead else flags & ((at - start) % 2 == 1)


class Tokenizer:
    """Encodes and decodes slices of texts; one for each file in a worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        spec = json.loads(open(path, encoding="utf-8").read())
        vocab, letters = spec["model"]["vocab"], byte_letters()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.merges = Merges(vocab, merges)
        self.of_byte = np.array([vocab[c] for c in letters], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = Library.from_file(path).pre_tokenizer.pre_tokenize_str
        self.kind = np.full(0x110000, UNASKED, np.uint8)
        value = {c: b for b, c in enumerate(letters)}
        tokens: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, k in (vocab | self.special).items():
            tokens[k] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        self.token_size = np.array([len(t) for t in tokens], np.int64)
        self.token_at, self.token_bytes = np.cumsum(self.token_size) - self.token_size, np.frombuffer(b"".join(tokens), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """What each code point is; those not met before are asked of the library."""
        kind = self.kind[points]
        for p in np.unique(points[kind == UNASKED]).tolist() if (kind == UNASKED).any() else ():
            joins = lambda c: len(self.split(c + chr(p))) == 1  # noqa: B023, E731
            self.kind[p] = LETTER if joins("x") else NUMBER if joins("1") else OTHER if joins("!") else WHITE
        return self.kind[points]

    def words(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where words begin, in code points of texts that begin at `starts` (none of them empty)."""
        kind, n = self.kinds(points), len(points)
        opens = np.zeros(n + 1, bool)
        opens[starts] = opens[n] = True
        run = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]) | opens[:n])
        end, k = np.append(run[1:], n), kind[run]
        begins = np.zeros(n + 1, bool)
        begins[run] = True
        white = (k == WHITE) & ~opens[end]  # with a word behind it
        begins[end[white] - 1] = True
        taken = white & (points[end - 1] == 32)  # its last space belongs to that word
        begins[end[taken]] = False
        # An apostrophe by itself before s, t, m, d, re, ve or ll takes these letters.
        bare = (k == OTHER) & (end - run == 1) & (points[run] == 39) & ~opens[end] & begins[run]
        at = end[bare & np.append(k[1:] == LETTER, False)]
        room = np.searchsorted(run, at, "right")
        room = np.append(run, n)[room] - at
        one, two = points[at], np.where(room > 1, points[np.minimum(at + 1, n - 1)], 0)
        letters = np.where(np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), np.uint32)), 1, np.where(((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108), 2, 0))
        at, letters = at[letters > 0], letters[letters > 0]
        begins[at] = False
        begins[at + letters] = True
        return np.flatnonzero(begins[:n])

    def learn(self, words: list[bytes]) -> None:
        """Merge words (none of them known) and keep their ids."""
        size = np.array([len(w) for w in words], np.int64)
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        long = size > LONG
        ids, sizes, order = [], [], []
        for which, merge in ((~long, self.merges.rounds), (long, self.merges.by_rank)):
            if which.any():
                s, z = merge(sym[np.repeat(which, size)], size[which])
                ids.append(s)
                sizes.append(z)
                order.append(np.flatnonzero(which))
        z = np.concatenate(sizes)
        at = len(self.flat) + np.cumsum(z) - z
        for k, w in zip(np.concatenate(order).tolist(), range(len(self.at), len(self.at) + len(words))):
            self.known[words[k]] = w
        self.at, self.size, self.flat = np.concatenate([self.at, at]), np.concatenate([self.size, z]), np.concatenate([self.flat, *ids])

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        data, off = raw_bytes(text)
        raw = data.tobytes()
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(text), np.int64)
        width = 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
        byte = np.append(0, np.cumsum(width))  # where each code point begins
        special = sorted((k, k + len(s.encode()), i) for s, i in self.special.items() for k in found(raw, s.encode(), off))
        cuts = np.unique(np.concatenate([off[:-1], *[[a, b] for a, b, _ in special]]).astype(np.int64))
        begin = byte[self.words(points, np.searchsorted(byte, cuts[cuts < len(data)]))]
        if special:  # one word each
            a, b = np.array([s[0] for s in special]), np.array([s[1] for s in special])
            begin = begin[~((begin > a[k := np.maximum(np.searchsorted(a, begin, "right") - 1, 0)]) & (begin < b[k]))]
        spans = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data)).astype(np.int32)), pa.py_buffer(raw)])
        coded = spans.dictionary_encode()
        unique, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        if len(self.known) > KEEP:
            self.forget()
        if new := [w for w in unique if w not in self.known]:
            self.learn(new)
        number = np.array([self.known[w] for w in unique], np.int64)[codes]
        at, size = self.at[number], self.size[number]
        ids = self.flat[spread(at, size)]
        if special:
            ends = np.cumsum(size)
            which = np.searchsorted(begin, [s[0] for s in special])
            keep = np.ones(len(ids), bool)
            keep[spread((ends - size)[which], size[which])] = False
            keep[(ends - size)[which]] = True
            ids[(ends - size)[which]] = [s[2] for s in special]
            size[which], ids = 1, ids[keep]
        total = np.append(0, np.cumsum(size))[np.searchsorted(begin, off)]
        return ids, np.diff(total)

    def decode(self, ids: np.ndarray, size: np.ndarray) -> list[str]:
        """The text of each run of `size` ids."""
        ids = np.where((ids >= 0) & (ids < len(self.token_size)), ids, -1)
        width = np.where(ids >= 0, self.token_size[ids], 0)
        portions = ((ids[k : k + IDS], width[k : k + IDS]) for k in range(0, len(ids), IDS))
        data = b"".join(self.token_bytes[spread(self.token_at[i], w)].tobytes() for i, w in portions)
        off = np.append(0, np.cumsum(width))[np.append(0, np.cumsum(size))].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(off, off[1:])]


def spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places at, at + 1, ..., size of them, of each run, behind one another."""
    ends = np.cumsum(size)
    return np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def found(raw: bytes, part: bytes, off: np.ndarray) -> Iterator[int]:
    """Places of a part within one text each."""
    at = raw.find(part)
    while at >= 0:
        if np.searchsorted(off, at, "right") == np.searchsorted(off, at + len(part) - 1, "right"):
            yield at
            at = raw.find(part, at + len(part))
        else:
            at = raw.find(part, at + 1)


def stretches(text: pa.Array, limit: int = SLICE) -> Iterator[pa.Array]:
    """A text in stretches of at most `limit` bytes, cut before white space that stands behind a printed ASCII sign; where
    there is none, the stretch is longer."""
    data = raw_bytes(text)[0].tobytes()
    start = 0
    while len(data) - start > limit:
        cut = start + limit
        while cut > start and not (data[cut] in ASCII_SPACE and 32 < data[cut - 1] < 127):
            cut -= 1
        if cut == start:
            cut = next((k for k in range(start + limit, len(data)) if data[k] in ASCII_SPACE and 32 < data[k - 1] < 127), len(data))
        yield pa.array([data[start:cut].decode()], pa.string())
        start = cut
    if start < len(data) or not start:
        yield pa.array([data[start:].decode()], pa.string())


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
DECODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded", pa.string())])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ids (array of int) of every text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch, text in text_slices(batches, limit=SLICE):
            if len(raw_bytes(text)[0]) > 2 * SLICE:  # one long text
                ids = np.concatenate([tok.encode(t)[0] for t in stretches(text)])
                size = np.array([len(ids)], np.int64)
            else:
                ids, size = tok.encode(text)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(size), lists], schema=ENCODED)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The text of every row of ids, and the SHA-256 of the ids as little-endian 32-bit integers. Null ids are none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            lists = batch.column("ids").fill_null([])
            off = lists.offsets.to_numpy().astype(np.int64)
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(off, off[start] + IDS, "right")) - 1)
                cut = off[start : stop + 1]
                ids = lists.values.slice(cut[0], cut[-1] - cut[0]).to_numpy(zero_copy_only=False).astype("<i4")
                raw, size = ids.tobytes(), np.diff(cut)
                texts = tok.decode(ids, size)
                sha = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip((cut[:-1] - cut[0]).tolist(), (cut[1:] - cut[0]).tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, stop - start), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())], schema=DECODED)
                start = stop

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded string")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    back = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
