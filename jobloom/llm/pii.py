"""Personal data: exact patterns, and a linear-chain conditional random field over word-shape features.

The patterns give the base spans. The field is trained on the driver from a small labelled table (`labelled`, made by a
rule from written forms of each kind and of things that only look like them), and its weights (a fixed 2**BITS by tag
array) go to the tasks. It reads the words within REACH of a word with a digit, an @ or a spelled-out at or dot; all
other words are outside by definition of the model. Runs of words, each whole, are decoded together by Viterbi in numpy batches.
A decoded span is kept if it holds what its kind needs and meets no base span.

Edge cases: null and empty texts have no spans; very long words cost time in proportion to their length; repeated rows
give equal results; null ids are carried; an empty table gives no rows. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .words import raw_bytes, text_slices

KINDS = ("email", "ip", "card", "phone")
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
BITS, REACH, LONG_WORD = 12, 5, 64  # words longer than the last aren't kept in the cache
STEPS, PLACES = 512, 256 * 512
SPELLED = re.compile(rb"dot|[(\[{]at[)\]}]|\bat\s+[a-z0-9-]+\.[a-z]")  # in small letters; texts without these, digits and @ have no trigger

# Fixed values of the base patterns.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match can only start where a run of digits does
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def luhn(number: str) -> bool:
    own = [int(c) for c in reversed(number)]
    return (sum(own[::2]) + sum(d * 2 - 9 * (d > 4) for d in own[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the run of name characters before it and a dotted domain behind it; linear in the text."""
    done, seen, at = 0, 0, text.find("@")
    while at >= 0:
        low = max(done, seen)
        start = low + len(text[low:at].rstrip(LOCAL))
        if at >= done and start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        seen = at + 1
        at = text.find("@", seen)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, z) for a, z in emails(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(n := digits(m[0])) <= 19 and luhn(n)]
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return found


# The field.


def shape(word: str) -> str:
    """a for small letters, A for others, 9 for digits; small letters in a row count once, others twice, digits up to seven."""
    s = re.sub(r"[^\W\d_]", lambda m: "a" if m[0].islower() else "A", word)
    return re.sub(r"9{7,}", "9999999", re.sub(r"A{2,}", "AA", re.sub(r"a+", "a", re.sub(r"\d", "9", s))))


CUES = {
    "at", "dot", "(at)", "[at]", "{at}", "(dot)", "[dot]", "{dot}", "mail", "email", "e-mail", "phone", "tel", "call", "fax", "mobile", "card", "visa", "ip", "host", "server", "write", "contact", "to", "from",
    "us", "look", "is", "are", "it", "more", "online", "available", "visit", "found", "me", "see", "here", "page", "site", "website", "work", "works", "meet", "live", "read", "home", "shop", "that", "the", "a",
}


def word_features(word: str) -> list[str]:
    core = word.strip(".,;:!?\"'<>|")
    s, low = shape(core), core.lower().rstrip(":")
    n = sum(c.isdigit() for c in core)
    dotted = "d" if DOTTED.fullmatch(core) else ""
    return ["s" + s, "c" + re.sub(r"9+", "9", s).lower(), "n" + str(min(n, 20)), "w" + (low if low in CUES else ""), "@" + str("@" in core) + dotted, "p" + str(len(core.split(".")) if n else 0)]


DOTTED = re.compile(r"[^\W_][\w-]*(\.[^\W\d_][\w-]*)+")  # words with dots, as names of sites are


def place(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) & ((1 << BITS) - 1)


class Features:
    """Places of the features of words: a word's own, and those of its neighbours; each distinct word is worked out once."""

    WIDTH = 6

    def __init__(self) -> None:
        self.known: dict[str, list[tuple[int, ...]]] = {}

    def word(self, w: str) -> list[tuple[int, ...]]:
        if (f := self.known.get(w)) is None:
            if len(self.known) > 200_000:
                self.known = {}
            names = word_features(w)
            f = [tuple(place(side + x) for x in names) for side in "=<>"]
            if len(w) <= LONG_WORD:
                self.known[w] = f
        return f

    def __call__(self, words: list[str]) -> np.ndarray:
        """len(words) by 3 * WIDTH places."""
        padded = [self.word("")] + [self.word(w) for w in words] + [self.word("")]
        return np.array([padded[k][0] + padded[k - 1][1] + padded[k + 1][2] for k in range(1, len(words) + 1)], np.int64).reshape(-1, 3 * self.WIDTH)


def batch_of(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows by longest by features, padded; which places are words)."""
    longest = max(map(len, rows))
    out, mask = np.zeros((len(rows), longest, 3 * Features.WIDTH), np.int64), np.zeros((len(rows), longest), bool)
    for k, r in enumerate(rows):
        out[k, : len(r)], mask[k, : len(r)] = r, True
    return out, mask


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Field:
    """weights: by feature place and tag; moves: from tag to tag; the row behind the last tag is the start."""

    def __init__(self) -> None:
        k = len(TAGS)
        self.weights, self.moves = np.zeros((1 << BITS, k)), np.zeros((k + 1, k))

    def emissions(self, places: np.ndarray) -> np.ndarray:
        return self.weights[places].sum(axis=-2)

    def train(self, rows: list[np.ndarray], tags: list[np.ndarray], rounds: int = 80, rate: float = 0.3, decay: float = 1e-4) -> None:
        """Full-batch gradient ascent on the log-likelihood (forward-backward), with per-weight step sizes."""
        places, mask = batch_of(rows)
        n, longest, k = len(rows), mask.shape[1], len(TAGS)
        gold = np.zeros((n, longest), np.int64)
        for r, t in enumerate(tags):
            gold[r, : len(t)] = t
        true, flat = np.eye(k)[gold] * mask[..., None], places[mask].ravel()
        seen_w, seen_m = np.full_like(self.weights, 1e-3), np.full_like(self.moves, 1e-3)
        for _ in range(rounds):
            e, inner = self.emissions(places), self.moves[:k]
            fwd, bwd = np.zeros((n, longest, k)), np.zeros((n, longest, k))
            fwd[:, 0] = e[:, 0] + self.moves[k]
            for t in range(1, longest):
                step = log_sum(fwd[:, t - 1, :, None] + inner, 1) + e[:, t]
                fwd[:, t] = np.where(mask[:, t, None], step, fwd[:, t - 1])
            for t in range(longest - 2, -1, -1):
                step = log_sum(inner + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
                bwd[:, t] = np.where(mask[:, t + 1, None], step, 0)
            total = log_sum(fwd[:, -1], 1)
            single = np.exp(fwd + bwd - total[:, None, None]) * mask[..., None]
            g_m = np.zeros_like(self.moves)
            g_m[k] = (true[:, 0] - single[:, 0]).sum(axis=0)
            for t in range(1, longest):
                on = mask[:, t]
                pair = np.exp(fwd[on, t - 1, :, None] + inner + (e[on, t] + bwd[on, t])[:, None, :] - total[on, None, None])
                g_m[:k] += np.einsum("na,nb->ab", true[on, t - 1], true[on, t]) - pair.sum(axis=0)
            diff = (true - single)[mask]
            g_w = np.stack([np.bincount(flat, np.repeat(diff[:, t], places.shape[2]), 1 << BITS) for t in range(k)], axis=1)
            for x, g, seen in ((self.weights, g_w - decay * n * self.weights, seen_w), (self.moves, g_m - decay * n * self.moves, seen_m)):
                seen += g * g
                x += rate * g / np.sqrt(seen)

    def decode(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest tags of each row (Viterbi over all rows at once)."""
        places, mask = batch_of(rows)
        k, longest = len(TAGS), mask.shape[1]
        best, back = np.zeros((len(rows), k)), np.zeros((len(rows), longest, k), np.int8)
        for t in range(longest):
            if t % STEPS == 0:  # emissions of a long run are worked out in parts; the state is carried over
                e = self.emissions(places[:, t : t + STEPS])
            if t == 0:
                best = e[:, 0] + self.moves[k]
                continue
            scores = best[:, :, None] + self.moves[:k]
            came = scores.argmax(axis=1)
            on = mask[:, t, None]
            back[:, t] = np.where(on, came, np.arange(k))
            best = np.where(on, scores.max(axis=1) + e[:, t % STEPS], best)
        tags = np.zeros((len(rows), longest), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(longest - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(len(rows)), t, tags[:, t]]
        return [t[: len(r)] for t, r in zip(tags, rows)]


def labelled(rows: int = 1200, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """The labelled table: words and tags of `rows` short texts, each with one written form among invented words."""
    rng = np.random.default_rng(seed)
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    plain = lambda: "".join(rng.choice(["ta", "en", "ing", "ch", "ré", "os", "the", "und", "de", "ör"], rng.integers(1, 4)))
    name = lambda: plain().replace("é", "e").replace("ö", "o")
    byte = lambda: str(rng.integers(1, 256))
    full = lambda: str(rng.choice([name(), f"{name()}.{name()}", f"{name()}_{num(2)}", f"{name()}{num(1)}"]))
    site = lambda: f"{name()}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'co.uk', 'io'])}"
    end = lambda: str(rng.choice(["com", "org", "net", "de", "fr", "edu"]))
    lead = lambda *w: str(rng.choice(w))
    # Written forms of each kind, and under "" what only looks like one. A | parts what belongs to the form from its surroundings.
    forms = {
        "phone": [
            lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", lambda: f"00{num(2)} {num(2)} {num(7)}",
            lambda: f"0{num(2)} {num(3)} {num(4)}", lambda: f"+{num(2)} {num(3)} {num(7)}", lambda: f"1-{num(3)}-{num(3)}-{num(4)}", lambda: f"0{num(3)}/{num(7)}", lambda: f"0{num(3)} {num(8)}", lambda: f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}",
            lambda: f"({num(3)}){num(3)}-{num(4)}", lambda: f"{lead('tel', 'Phone:', 'call', 'Tel.:', 'fax', 'mobile')} | {num(3)} {num(3)} {num(4)}",
        ],
        "email": [
            lambda: f"{name()}.{num(2)}@{name()}.com", lambda: f"{full()} (at) {name()} (dot) {end()}", lambda: f"{full()} at {name()} dot {end()}", lambda: f"{full()}[at]{site()}", lambda: f"{full()} [at] {name()} [dot] {end()}",
            lambda: f"{full()}(at){site()}", lambda: f"{full()} (at) {site()}", lambda: f"{full()} [at] {site()}", lambda: f"{full()} {{at}} {name()} {{dot}} {end()}", lambda: f"{full()} at {name()} dot {name()} dot {end()}", lambda: f"{name()} dot {name()} at {name()} dot {end()}",
            lambda: f"{full()} @ {site()}", lambda: f"{lead('mail', 'email', 'write', 'contact', 'e-mail:', 'write to')} | {full()} at {site()}", *[lambda: f"{name()} at {site()}"] * 3, lambda: f"{lead('to', 'from', 'contact')} | {full()} at {site()}",
        ],
        "card": [lambda: num(16), lambda: f"{num(4)} {num(4)} {num(4)} {num(4)}", lambda: f"{num(4)}-{num(4)}-{num(4)}-{num(4)}", lambda: f"{num(4)}.{num(4)}.{num(4)}.{num(4)}", lambda: f"{num(4)} {num(6)} {num(5)}", lambda: f"{num(4)}/{num(4)}/{num(4)}/{num(4)}"],
        "ip": [lambda: f"{byte()}.{byte()}.{byte()}.{byte()}", lambda: f"{byte()}.{byte()}.{byte()}.{byte()}:{num(4)}"],
        "": [
            lambda: f"password={num(3)}a{num(4)}cf{num(2)}", lambda: f'token = "{num(4)}ab{num(5)}cd{num(5)}"', lambda: f"AKIA{num(1)}QX{num(2)}KZ{num(3)}VT", lambda: f"version {num(1)}.", lambda: f"CC BY-NC {num(1)}.{num(1)}.", lambda: f"20{num(2)}-0{num(1)}-1{num(1)}",
            lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: f"${num(1)},{num(3)},{num(3)}", lambda: f"ISBN 978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: f"v{num(1)}.{num(2)}.{num(1)}", lambda: f"{num(2)} {num(3)} | {num(4)}", lambda: f"{num(4)}", lambda: f"dot {plain()}",
            lambda: f"{num(3)} {plain()} {num(3)}", lambda: f"{num(1)}.{num(1)}.{num(1)}", plain, *[lambda: f"{lead('us', 'look', 'is', 'more', 'online', 'available', 'visit', 'found', 'me', 'it', 'are', 'here', 'works', 'shop')} at {site()}"] * 6,
            lambda: f"at {num(2)}:{num(2)}", lambda: f"at {num(1)} dot", lambda: f"{plain()} dot com {plain()}", lambda: f"{lead('the', 'a', 'that', 'page', 'site')} {site()} {plain()}", lambda: f"{plain()} at {plain()}. {plain()}", lambda: f"{lead('meet', 'live', 'home', 'work')} at {plain()} {num(2)}",
            lambda: f"{num(2)}/{num(2)}/20{num(2)}", lambda: f"{num(1)}/{num(1)}", lambda: f"{num(2)} {num(2)} {num(2)}", lambda: "the dot at the end", lambda: f"{num(3)}-{num(2)}",
        ],
    }
    turn = [str, str, str, str.upper, str.title]  # some in capitals
    kinds, out = [*forms, ""], []
    for k in range(rows):
        kind = kinds[k % len(kinds)]
        before, _, form = forms[kind][(k // len(kinds)) % len(forms[kind])]().rpartition(" | " if kind else "\0")
        change = turn[rng.integers(0, len(turn))]
        inner = (change(form) if kind else form).split(" ")
        left, right = [plain() for _ in range(rng.integers(0, 6))] + before.split(), [plain() for _ in range(rng.integers(0, 6))]
        if rng.random() < 0.3:
            inner[-1] += str(rng.choice([".", ","]))
        tags = [("B-" if j == 0 else "I-") + kind if kind else "O" for j in range(len(inner))]
        out.append(([*left, *inner, *right], ["O"] * len(left) + tags + ["O"] * len(right)))
    return out


@lru_cache(maxsize=1)
def standard() -> Field:
    """The field of the labelled table; trained once in a driver."""
    return trained(labelled())


def trained(table: list[tuple[list[str], list[str]]] | None = None) -> Field:
    if table is None:
        return standard()
    field, features = Field(), Features()
    field.train([features(w) for w, _ in table], [np.array([TAGS.index(t) for t in tags]) for _, tags in table])
    return field


def plausible(kind: str, text: str) -> bool:
    """What a decoded span must hold."""
    n = len(digits(text))
    if kind == "email":
        return bool(re.search(r"@|\bat\b", text, re.IGNORECASE)) and bool(re.search(r"\.\w|\bdot\b", text, re.IGNORECASE))
    if kind == "ip":
        return bool(re.fullmatch(r"\d+(\.\d+){3}(:\d+)?", text)) and all(int(p[:9]) <= 255 for p in text.split(":")[0].split("."))
    return 13 <= n <= 19 and luhn(digits(text)) if kind == "card" else 7 <= n <= 15 and not re.search(r"[^\W\d_]", text)


WORD = re.compile(r"\S+")
TRIGGER = re.compile(r"[0-9@]|^dot$|[(\[{](?:at|dot)[)\]}]", re.IGNORECASE)


def near(words: list[str]) -> list[tuple[int, int]]:
    """Runs of words within REACH of a trigger."""
    out: list[list[int]] = []
    for k, w in enumerate(words):
        if TRIGGER.search(w) or w.lower() == "at" and k + 1 < len(words) and DOTTED.fullmatch(words[k + 1].strip(".,;:!?\"'<>|()")):
            if out and k - REACH <= out[-1][1]:
                out[-1][1] = min(len(words), k + REACH + 1)
            else:
                out.append([max(0, k - REACH), min(len(words), k + REACH + 1)])
    return [tuple(r) for r in out]


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], field: Field, features: Features) -> list[list[tuple[str, int, int]]]:
    """Decoded spans of each text that meet no base span."""
    where, rows = [], []
    for t, text in enumerate(texts):
        found = list(WORD.finditer(text))
        words = [m[0] for m in found]
        for a, z in near(words):
            where.append((t, found[a:z]))
            rows.append(features(words[a:z]))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    order = sorted(range(len(rows)), key=lambda k: len(rows[k]))
    lo = 0
    while lo < len(order):
        hi = lo + 1  # padded places are bounded; a longer run stands alone
        while hi < min(lo + 256, len(order)) and (hi + 1 - lo) * len(rows[order[hi]]) <= PLACES:
            hi += 1
        part, lo = order[lo:hi], hi
        for k, tags in zip(part, field.decode([rows[k] for k in part])):
            t, found = where[k]
            start = 0
            while start < len(tags):
                kind, stop = (tags[start] + 1) // 2, start + 1
                if kind:
                    while stop < len(tags) and tags[stop] == 2 * kind:
                        stop += 1
                    a, z = found[start].start(), found[stop - 1].end()
                    a += len(texts[t][a:z]) - len(texts[t][a:z].lstrip(".,;:!?\"'<>|="))
                    z -= len(texts[t][a:z]) - len(texts[t][a:z].rstrip(".,;:!?\"'<>|="))
                    if plausible(KINDS[kind - 1], texts[t][a:z]) and not any(a < e and s < z for _, s, e in base[t]):
                        out[t].append((KINDS[kind - 1], a, z))
                start = stop
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_email long, base_ip long, base_card long, base_phone long, base_sha256 string, spans string"


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Counts and spans of every text: doc_id; n_email to n_phone, of all spans; base_email to base_phone, of those of the
    exact patterns; base_sha256, spans."""
    sent = docs.sparkSession.sparkContext.broadcast(field or trained())
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, features = sent.value, Features()
        for batch, text in text_slices(batches):
            data, off = raw_bytes(text)
            hit = np.concatenate([[0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))])
            look = hit[off[1:]] > hit[off[:-1]]
            for m in SPELLED.finditer(data.tobytes().lower()):
                look[np.searchsorted(off, m.start(), "right") - 1] = True
            rows = np.flatnonzero(look)
            texts = text.take(pa.array(rows)).to_pylist()
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, field, features)
            counts = np.zeros((8, batch.num_rows), np.int64)  # all spans by kind, then the base ones
            shas, spans = [none] * batch.num_rows, [""] * batch.num_rows
            for k, b, a in zip(rows.tolist(), base, more):
                for kind, _, _ in b + a:
                    counts[KINDS.index(kind), k] += 1
                for kind, _, _ in b:
                    counts[4 + KINDS.index(kind), k] += 1
                shas[k], spans[k] = hashlib.sha256(listed(b).encode()).hexdigest(), listed(b + a)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts n_email to n_phone are those of the exact patterns; all_email to all_phone count what the field adds, too."""
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.col(f"{own}_{kind}").alias(f"{name}_{kind}") for own, name in (("base", "n"), ("n", "all")) for kind in KINDS]
    return found.select("doc_id", *counts[:4], "base_sha256", "spans", *counts[4:])
