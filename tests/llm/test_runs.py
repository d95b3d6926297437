"""Against a scan of every lag of every text."""

import hashlib
import random
import re
import zlib

import numpy as np
from data import LONG, TEXTS, frame

from jobloom.llm import runs


def brute(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(12, 2 * q):
                found.setdefault((s, i + q), q)
    return sorted((s, e, q) for (s, e), q in found.items())


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plant(doc, w):
    h = zlib.crc32(b"" if doc is None else str(doc).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc, text):
    w = plant(doc, words(text))
    found = brute(w)
    dropped = {k for s, e, q in found for k in range(s + q, e)}
    best = max(found, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in sorted(found, key=lambda r: (r[0], r[2])))
    return (len(found), *four, sha(lines), sha(" ".join(x for k, x in enumerate(w) if k not in dropped)))


def some(rnd):
    w = []
    for _ in range(rnd.randint(0, 8)):
        v = rnd.choice([1, 2, 3, 5, 50])
        if rnd.random() < 0.5:
            unit = [rnd.randrange(v) for _ in range(rnd.randint(1, rnd.choice([3, 10, 40, 90])))]
            w += [unit[k % len(unit)] for k in range(rnd.randint(len(unit), 5 * len(unit)))]
        else:
            w += [rnd.randrange(20 * v) for _ in range(rnd.randint(0, 60))]
    return w


def test_against_brute_force():
    rnd = random.Random(5)
    for _ in range(300):
        docs = [some(rnd) for _ in range(3)]
        splits = np.cumsum([0, *map(len, docs)])
        got = list(zip(*(x.tolist() for x in runs.runs_of(np.array(sum(docs, []), np.int64), splits))))
        assert got == [(s + o, e + o, q) for d, o in zip(docs, splits.tolist()) for s, e, q in sorted(brute(d), key=lambda r: (r[0], r[2]))]


def test_splitting_saves_work_only(monkeypatch):
    monkeypatch.setattr(runs, "SPLITS", 1)
    test_against_brute_force()
    monkeypatch.setattr(runs, "BLOCK", 64)
    test_against_brute_force()


def test_prose_falls_apart_and_runs_survive():
    one, twice = np.zeros(3000, np.int64), np.arange(3000) % 1499
    assert len(runs.surviving(np.arange(3000), one)) == 0
    assert len(runs.surviving(twice, one)) == 3000 and [x.tolist() for x in runs.runs_of(twice, np.array([0, 3000]))] == [[0], [3000], [1499]]
    assert len(runs.surviving(np.concatenate([np.arange(100), np.arange(50, 60), np.arange(200, 300), np.arange(90, 100)]), one[:220])) == 0  # splits again and again


def test_one_word_and_nested_periods_take_no_square_time():
    import time

    start = time.time()
    for codes in (np.zeros(200_000, np.int64), np.tile(np.append(np.zeros(100, np.int64), 1), 2000), np.tile(np.arange(60_000), 3)):
        s, e, q = runs.runs_of(codes, np.array([0, len(codes)]))
        assert e.max() - s.min() == len(codes)
    assert time.time() - start < 60


def test_table(spark):
    texts = [*TEXTS, "u v w " * 5, " ".join(["x"] * 11), " ".join(["x"] * 12), LONG * 40 + " " + "p q r s t u v " * 50_000]
    got = runs.periodic_runs(frame(spark, texts)).collect()
    assert len(got) == len(texts) + 2
    long = next(r for r in got if r.doc_id == len(texts) - 1)
    assert (350_000, 7) in [(r.length, r.period) for r in long.runs]
    for r in got:
        if r.doc_id is not None and r.doc_id < len(texts) - 1 and r.doc_id not in (6, 7):
            found = [(x.start, x.start + x.length, x.period) for x in r.runs]
            assert found == sorted(brute(words(texts[r.doc_id])), key=lambda x: (x[0], x[2])) and r.n_words == len(words(texts[r.doc_id]))
    assert next(r for r in got if r.doc_id == len(texts) - 2).collapsed == "x" and runs.periodic_runs(frame(spark).limit(0)).count() == 0


def test_query(spark, sf_dir, tmp_path):
    from jobloom.llm.queries import QUERIES

    short = [t for t in TEXTS if len(t or "") < 9000] + ["a b c d e f " * 9, "tick tock " * 30]
    frame(spark, short * 8).write.parquet(str(tmp_path / "documents.parquet"))
    for path in (sf_dir, str(tmp_path)):
        got = sorted(map(tuple, QUERIES["op12_periodic_runs"](spark, path).collect()), key=str)
        docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
        assert got == sorted([(d.doc_id, *expected(d.doc_id, d.text)) for d in docs], key=str)
