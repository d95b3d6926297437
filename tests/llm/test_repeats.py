import hashlib

import numpy as np
import pyarrow as pa
import pytest
from data import TEXTS, frame

from jobloom.llm.repeats import ASKED, CONTEXTS, HOT, by_key, contexts, earlier, fetch, kind_of, marked, message, settle, without_repeats
from jobloom.llm.run_index import RunIndex
from jobloom.llm.words import raw_bytes, unpacked


@pytest.mark.parametrize("own", [False, True])
def test_matching_statistics(own):
    rng = np.random.default_rng(1)
    strings = [bytes(rng.integers(97, 100, rng.integers(5, 30)).astype(np.uint8)) for _ in range(30)]
    strings += strings[:5] + [b"aaaaaaaaaaaa"]
    index = RunIndex(np.frombuffer(b"".join(strings), np.uint8), np.array(list(map(len, strings))), np.arange(len(strings)), 8)
    patterns = strings if own else [bytes(rng.integers(97, 101, 20).astype(np.uint8)) for _ in range(20)]
    length, window = index.statistics(np.frombuffer(b"".join(patterns), np.uint8), np.array(list(map(len, patterns))), own)
    k = 0
    for p in patterns:
        for i in range(len(p)):
            best = max(n for n in range(len(p) - i + 1) if any(p[i : i + n] in s for s in strings))
            assert length[k] == best
            if best >= 8:
                assert index.least[window[k]] == min(j for j, s in enumerate(strings) if p[i : i + 8] in s)
            k += 1
    assert len(index.run) < len(index.text)


def brute(rows):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    key = lambda i: -(1 << 63) if i is None else i
    for i, b in data:
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], key(i)), key(i))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < key(i):
                gone[k : k + 50] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((str(i), len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def test_against_brute_force(spark):
    docs = frame(spark)
    got = without_repeats(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_empty(spark):
    assert without_repeats(frame(spark).limit(0)).count() == 0
    assert TEXTS[0] is None and without_repeats(frame(spark, [None, ""], False)).count() == 2


@pytest.mark.parametrize("hot", [2048, 3, 0])
def test_passages_with_different_text_around(spark, hot):
    """One anchor in most documents, rulers of many lengths, periods: with anchors taken apart (hot) and without."""
    rng = np.random.default_rng(8)
    letters = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passages = [letters(120), letters(70), letters(51), "=" * 90, "ab" * 60]
    texts = []
    for k in range(90):
        text = letters(int(rng.integers(0, 60)))
        for p in rng.choice(len(passages), rng.integers(0, 4)):
            cut = passages[p][int(rng.integers(0, 20)) :] if rng.random() < 0.5 else passages[p]
            text += cut + letters(int(rng.integers(0, 40)))
        texts.append(text)
    texts += ["-" * int(n) for n in rng.integers(40, 400, 8)] + ["x" + "-" * 3000, "y" + "-" * 3000 + "z", "-" * 80 + "q" + "-" * 80, texts[7], texts[8] + "tail"]
    docs = frame(spark, texts, False)
    got = without_repeats(docs, hot=hot, bucket_bytes=5000).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r.n_removed for r in got) > 1000


def test_statistics_decide(spark):
    """Strings of later contexts are found in an index of earlier ones only; jumps are taken."""
    jumps, jump = [], RunIndex._jump
    RunIndex._jump = lambda self, who, *rest: (jumps.append(len(who)), jump(self, who, *rest))[1]
    try:
        common = "".join(chr(97 + k * 7 % 26) for k in range(60))
        text = np.frombuffer((("p" * 30 + common + "q" * 30) + ("r" * 25 + common[2:] + "s" * 30)).encode(), np.uint8)
        size = np.array([120, 113])
        which, a, z = earlier(text, np.array([0, 120]), size, np.array([1, 2]), np.array([0]), np.array([1]))
    finally:
        RunIndex._jump = jump
    assert which.tolist() == [0] and (a[0], z[0] + 49) == (25, 83) and sum(jumps) > 0


def test_text_of_17_mb(spark):
    rng = np.random.default_rng(3)
    big = rng.integers(97, 123, 17 << 20).astype(np.uint8).tobytes().decode()
    part, new = big[5_000_000:6_000_000], "".join(chr(c) for c in rng.integers(65, 91, 1000))
    docs = spark.createDataFrame([(1, big), (2, "0" + part + new), (3, big)], "doc_id long, text string")
    got = {r.doc_id: r for r in without_repeats(docs, with_text=False).collect()}
    assert [got[k].n_removed for k in (1, 2, 3)] == [0, 1_000_000, 17 << 20] and got[2].n_spans == 1
    assert got[2].kept_sha256 == hashlib.sha256(("0" + new).encode()).hexdigest()


def test_ids_with_a_common_step_are_spread(spark):
    import numpy as np

    from jobloom.llm.repeats import group_of, grouped

    ids = [73 * k for k in range(400)] + [-(1 << 63), -5]
    by_spark = {r.doc_id: r.g for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", group_of(73).alias("g")).collect()}
    for i in ids:
        assert grouped(73, 0, np.array([i]), np.zeros(1, np.uint32))[0][1] == by_spark[i]
    assert len(set(by_spark.values())) > 60


def test_places_are_indexed_and_streamed_once(monkeypatch):
    """However many contexts a family has: no byte that is asked for goes into an index or through one twice, contexts whose
    strings all stand alone don't at all, and a group of texts gets one message."""
    rng = np.random.default_rng(5)
    letters = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    around = lambda k, part: letters(40) + chr(65 + k // 26) + chr(97 + k % 26) + part + chr(65 + k // 26) + chr(97 + k % 26) + letters(40)
    built, streamed, init, statistics = [], [], RunIndex.__init__, RunIndex.statistics
    monkeypatch.setattr(RunIndex, "__init__", lambda self, strings, *rest: (built.append(len(strings)), init(self, strings, *rest))[1])
    monkeypatch.setattr(RunIndex, "statistics", lambda self, patterns, *rest: (streamed.append(len(patterns)), statistics(self, patterns, *rest))[1])
    for part in (letters(47), letters(60)):  # under 50 bytes one family, but nothing that repeats
        texts = [around(k, part) for k in range(300)]
        data, off = raw_bytes(pa.array(texts))
        start, count, anchor, whole, left, right = contexts(data, off)
        doc = np.searchsorted(off, start, "right") - 1
        hints = settle(1, 1, HOT)(message(by_key(np.zeros(len(start), np.int64), CONTEXTS, anchor, whole, doc, (start - off[doc]).astype(np.uint32), count.astype(np.uint8), left, right)))
        found = fetch(1, 1)(pa.table({"doc_id": pa.array(range(300), pa.int64()), "text": texts}), kind_of(hints, ASKED))
        asked = len(b"".join(unpacked(b, "u1")[0].tobytes() for b in kind_of(found, ASKED)["bytes"].to_pylist()))
        out = marked(1)(found)
        if len(part) < 50:
            assert asked > 300 * 50 and not built and not streamed and not out.num_rows
        else:
            assert 50 <= sum(built) <= asked and 299 * 50 <= sum(streamed) <= asked and out.num_rows == 1
