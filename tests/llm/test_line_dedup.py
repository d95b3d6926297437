import hashlib
import random
from collections import defaultdict

import numpy as np
from data import frame

from jobloom.llm.line_dedup import MIN_BLOCK, align, common_lines, line_dedup, windows, without_lines


def test_patience_diff():
    assert align([1, 2, 3, 4, 5], [9, 2, 3, 7, 5]) == [(1, 1, 2), (4, 4, 1)]
    assert align([], [1]) == [] and align([1], [2]) == []
    assert align([1, 2, 3], [1, 2, 3]) == [(0, 0, 3)]
    assert align([5, 1, 2, 8, 3], [1, 2, 9, 3, 5]) == [(1, 0, 2), (4, 3, 1)]  # a longest rising chain wins


def brute(rows):
    """Each document against all earlier ones: every common run of lines with MIN_BLOCK characters goes."""
    keyed = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1]))
    lines, gone = [t.split("\n") for _, t in keyed], {}
    for k, own in enumerate(lines):
        lost = set()
        for other in lines[:k]:
            for i in range(len(own)):
                for j in range(len(other)):
                    n = 0
                    while i + n < len(own) and j + n < len(other) and own[i + n] == other[j + n]:
                        n += 1
                    if sum(map(len, own[i : i + n])) >= MIN_BLOCK:
                        lost |= set(range(i, i + n))
        gone[keyed[k]] = lost
    return {key: "\n".join(x for k, x in enumerate(key[1].split("\n")) if k not in lost) for key, lost in gone.items()}


def result(docs):
    """Kept text by id and text."""
    own = docs.withColumn("before", docs["text"])
    return {(r.doc.doc_id, r.doc.before): r.doc.text for r in without_lines(own).collect()}


def test_against_brute_force(spark):
    body = lambda a, b: "\n".join(f"sentence {k} is long enough to count" for k in range(a, b))
    texts = [body(0, 10), body(0, 10), "new head\n" + body(3, 10) + "\nnew tail", None, "", body(50, 55) + "\n" + body(2, 4), "short\nshort", "the only line of this text is here", "the only line of this text is here\nmore"]
    docs = frame(spark, texts, False)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = result(docs)
    assert {k: v for k, v in got.items() if k[1] is not None} == want
    assert got[(3, None)] is None


def test_stage_keeps_columns_and_drops_emptied(spark):
    docs = frame(spark)
    out = line_dedup(docs)
    assert out.columns == docs.columns and out.schema["n_chars"] == docs.schema["n_chars"]
    texts = defaultdict(list)
    for r in out.collect():
        texts[r.doc_id].append(r.text)
        assert r.n_chars == (None if r.text is None or r.doc_id is None else len(r.text))  # the row without an id has no count, and loses no line
    assert 14 not in texts and 7 not in texts and texts[1] == [""] and 0 in texts  # copies of 13 and 6 are gone
    assert len(texts[3]) == 2  # equal rows are one document
    assert line_dedup(docs.limit(0)).count() == 0
    assert hashlib.sha256(texts[12][0].encode()).hexdigest() != hashlib.sha256("".encode()).hexdigest()


def test_frequent_lines_link_like_rare_ones(spark):
    p, q = ("\n".join(f"{name} line {k} of a frequent passage" for k in range(3)) for name in ("first", "second"))
    texts = [f"{(p, q)[k % 2]}\nthe very own line {k} of the text" for k in range(2200)]
    texts += ["a line that only two documents have", f"{p}\na line that only two documents have", f"{p}\nsomething in between\n{q}", f"head\n{p}"]
    rows = [(k * 97, t) for k, t in enumerate(texts)]  # over many blocks of ids
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {i: kept for (i, _), kept in result(docs).items()}
    heads = {p.split("\n")[0]: p, q.split("\n")[0]: q}  # all texts but the last four: a passage, and a line of its own
    want = {k * 97: t if k < 2 else t.split("\n")[-1] for k, t in enumerate(texts[:2200])}
    assert len(heads) == 2 and {i: got[i] for i in want} == want and got[2200 * 97] == texts[2200]
    assert got[2201 * 97] == "" and got[2202 * 97] == "something in between" and got[2203 * 97] == "head"


def test_a_document_in_between_hides_nothing(spark):
    lines = [f"line {k} of the text" for k in range(10, 20)]  # 18 characters each
    first, turned = "\n".join(lines), "\n".join(lines[::-1])
    rows = [(1, first), (2, turned), (3, first), (4, "\n".join(lines[5:] + lines[:5])), (5, "\n".join(lines[:2] * 3))]
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows) and got[(1, first)] == first and got[(2, turned)] == turned and {got[rows[k]] for k in (2, 3, 4)} == {""}


def test_random_texts_against_brute_force(spark):
    rng, rows = random.Random(3), []
    pool = ["", "ab", "short line", "of a middling length", "this line alone is long enough to go", "and this one is as long as that, too"]
    for i in range(60):
        own = [rng.choice(pool) if rng.random() < 0.8 else f"line {rng.randrange(9)}" for _ in range(rng.randrange(12))]
        rows.append((rng.randrange(10**9) if i % 7 else i, "\n".join(own)))
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_windows_are_least_blocks():
    sizes = np.array([10, 0, 25, 40, 5, 30, 3])
    a, z, _ = windows(np.arange(7), sizes, np.array([0, 4, 7]))
    assert sorted(zip(a.tolist(), z.tolist())) == [(0, 3), (1, 4), (2, 4), (3, 4), (4, 6), (5, 6), (5, 7)]
    x = np.array([1, 2, 3, 4])
    own = windows(x, np.full(4, 20), np.array([0, 4]))
    assert common_lines(x, own, np.array([3, 4, 1, 2]), np.full(4, 20)).all()  # moved text is met as well


def test_other_columns_keep_their_values(spark):
    text = "a line that is long enough to be a block"
    rows = [(k, text if k % 2 else f"{text}\nown line {k}", *[f"v{k}{c}" for c in range(9)]) for k in range(4)]
    names = ["gone", "__gone", "__id", "__h", "id", "h", "keep", "doc", "n_removed"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    out = line_dedup(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in out] == [(0, rows[0][1]), (2, "own line 2")]
    assert [tuple(r)[2:] for r in out] == [rows[0][2:], rows[2][2:]]


def test_only_what_is_aligned_goes(monkeypatch):
    from jobloom.llm import line_dedup as module

    x, sizes = np.arange(1, 50), np.full(49, 40)
    own = windows(x, sizes, np.array([0, 49]))
    assert common_lines(x, own, x[::-1].copy(), sizes).all() and common_lines(x, own, x, sizes).all()
    monkeypatch.setattr(module, "align", lambda a, b: [])
    assert not common_lines(x, own, x, sizes).any()


def test_any_order_takes_few_passes(monkeypatch):
    from jobloom.llm import line_dedup as module

    rng, calls = np.random.default_rng(2), []
    monkeypatch.setattr(module, "align", lambda a, b: calls.append(len(a)) or align(a, b))
    x = np.arange(1, 2001)
    for y in (x[::-1].copy(), rng.permutation(x), np.concatenate([x[1000:], x[:1000]])):
        calls.clear()
        assert common_lines(x, windows(x, np.full(2000, 40), np.array([0, 2000])), y, np.full(2000, 40)).all()
        assert len(calls) <= 2 * 2000**0.5 + 2
    repeated = np.tile(np.array([7, 8, 9]), 300)
    calls.clear()
    assert common_lines(repeated, windows(repeated, np.full(900, 40), np.array([0, 900])), np.array([9, 1, 8, 2, 7]), np.full(5, 40)).all() and len(calls) < 9


def test_counts_of_untouched_texts_stay(spark):
    line = "a line that is long enough to be a block"
    docs = spark.createDataFrame([(1, line, 7), (2, f"{line}\nmore", 99), (3, "own", 1), (4, None, 5)], "doc_id long, text string, n_chars int")
    assert sorted(map(tuple, line_dedup(docs).collect())) == [(1, line, 7), (2, "more", 4), (3, "own", 1), (4, None, 5)]


def test_an_outlying_id_puts_not_all_in_one_block(spark):
    text = lambda k: f"a passage that all of these texts have\nand line {k} of its own text"
    rows = [(k, text(k)) for k in range(3000)] + [(1 << 60, text(-1))]
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[(0, text(0))] == text(0) and all(got[(i, t)] == t.split("\n")[1] for i, t in rows[1:])
