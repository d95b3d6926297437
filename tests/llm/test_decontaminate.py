import re

from data import TEXTS, frame

from jobloom.llm.decontaminate import decontaminate, matches

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = [(1, "This PASSAGE of more-than fifty words alpha0 alpha1 alpha2 alpha3 alpha4 other end"), (2, "short"), (3, None), (4, "  "), (5, "the idiot"), (6, "word0 and0 word1 and1 word2 and2 word3 and3 word4 and4 word5 and5"), (6, "x y z x y z x y z x y z"), (None, "two words"), (8, "é" * 70)]


def split(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text):
    w, hit, items = split(text), set(), set()
    for i, t in ITEMS:
        x = split(t)
        if not x:
            continue
        n = min(10, len(x))
        for k in range(len(x) - n + 1):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[k : k + n]:
                    hit |= set(range(p, p + n))
                    items.add(i)
    return len(w), len(hit), sorted(items - {None})  # an item without an id marks words, but can't be listed


def longest(w, items):
    """Words of the longest run that w shares with an item, and where in w the first such run begins."""
    best = (0, 1)
    for x in items:
        length = [0] * (len(x) + 1)
        for p in range(len(w) - 1, -1, -1):
            length = [length[k + 1] + 1 if k < len(x) and w[p] == x[k] else 0 for k in range(len(x))] + [0]
            best = max(best, (max(length), -p))
    return best[0], -best[1]


def check(spark, **more):
    docs, bench = frame(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    for r in matches(docs, bench, **more).collect():
        spans = list(zip(r["starts"], r["ends"]))
        assert (r["n_words"], sum(z - a for a, z in spans), list(r["items"])) == brute(r.doc.text)
        assert all(a < z for a, z in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
        assert (r["longest"], r["longest_at"]) == longest(split(r.doc.text), [split(t) for _, t in ITEMS])  # of any length
    return docs, bench


def test_against_brute_force(spark):
    docs, bench = check(spark)
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not brute(r.text)[1] for r in docs.collect())


def test_blocks_of_items_agree(spark):
    check(spark, block_bytes=40)


def test_empty(spark):
    docs, none = frame(spark), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none).count() == docs.count() == len(TEXTS) + 2
    assert decontaminate(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_random_words_against_brute_force(spark):
    import random

    rng, pick = random.Random(5), lambda n: " ".join(rng.choice("ab c d the of".split()) for _ in range(n))
    items = [(k, pick(rng.choice((1, 2, 3, 9, 10, 11, 14)))) for k in range(6)]
    texts = [pick(rng.randrange(60)) for _ in range(60)] + [items[2][1]]
    docs = frame(spark, texts, False)
    for blocks in (8 << 20, 30):
        for r in matches(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=blocks).collect():
            w, hit, got = split(r.doc.text), set(), set()
            for i, t in items:
                x = split(t)
                n = min(10, len(x))
                for k in range(len(x) - n + 1):
                    for p in range(len(w) - n + 1):
                        if w[p : p + n] == x[k : k + n]:
                            hit |= set(range(p, p + n))
                            got.add(i)
            assert (r["n_words"], sum(z - a for a, z in zip(r["starts"], r["ends"])), list(r["items"])) == (len(w), len(hit), sorted(got))
            assert (r["longest"], r["longest_at"]) == longest(w, [split(t) for _, t in items])


def test_own_columns_keep_their_values(spark):
    names = ["__items", "__longest", "items", "longest", "doc", "n_words", "h"]
    docs = spark.createDataFrame([(1, "clean", *[f"v{c}" for c in range(7)]), (2, "the idiot", *["x"] * 7)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    out = decontaminate(docs, spark.createDataFrame([(5, "the idiot")], "item_id long, text string"))
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, "clean", *[f"v{c}" for c in range(7)])]


def test_suffix_array_against_sorting():
    import random

    import numpy as np
    import pyarrow as pa

    from jobloom.llm.decontaminate import Suffixes
    from jobloom.llm.words import ALNUM, Words

    rng = random.Random(8)
    for voc in (1, 2, 5, 40):
        texts = [" ".join(f"w{rng.randrange(voc)}" for _ in range(rng.randrange(80))) for _ in range(9)]
        words = Words(pa.array([*texts, *texts[:3], ""]), ALNUM)
        found = Suffixes(words)
        suffixes = [tuple(words.hashes()[p : found.stop[p]].tolist()) for p in found.places]
        assert suffixes == sorted(suffixes) and sorted(found.places.tolist()) == list(range(len(words)))
    assert len(Suffixes(Words(pa.array([""]), ALNUM)).places) == 0 and np.array_equal(Suffixes(Words(pa.array(["a"]), ALNUM)).places, [0])


def test_frequent_starts_and_long_texts_take_no_product_of_both():
    import random
    import time

    import pyarrow as pa

    from jobloom.llm.decontaminate import Tests, search

    rng = random.Random(1)
    some = lambda n: " ".join(rng.choice("abcdefghij") for _ in range(n))
    tests = Tests(list(range(2000)), [f"the of and {some(7)}" for _ in range(2000)], 10)
    texts = [" ".join(f"the of and {some(5)}" for _ in range(70_000)), "a b c " * 150_000]
    start = time.time()
    for t in texts:
        assert search(tests, pa.array([t]))["n_words"][0] == len(t.split())
    assert time.time() - start < 20
