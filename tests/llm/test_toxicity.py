import zlib

import numpy as np
import pyarrow as pa
from data import frame

from pyspark.sql import functions as F

from jobloom.llm.toxicity import ALPHA, BETA, L1, L2, POSITIVE, Ftrl, Scorer, features, fit, once, op10, scored, toxicity, train


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, quality int")


def test_features_count_once_and_by_text():
    rows, places = once(*features(pa.array(["a b a b", "", "a"])))
    assert set(rows) == {0, 2} and (rows == 2).sum() == 2  # the word and its head
    assert set(places[rows == 2]) < set(places[rows == 0])


def test_training_is_sparse_and_separates():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(300)], 40)) + (" vile" if k % 5 == 0 else "") for k in range(600)]
    hashes, weights = train(pa.array(texts), np.array([float(k % 5 == 0) for k in range(600)]))
    score = Scorer(hashes, weights)(pa.array(["w1 w2 vile w3", "w1 w2 w3", ""]))
    assert score[0] > 0.5 > score[1] and score[2] < 0.5 and (np.diff(hashes.astype(object)) > 0).all()
    assert len(weights) < 0.01 * len(np.unique(features(pa.array(texts))[1]))


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    got = op10(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95
    assert got.score[got.toxic == 1].mean() > got.score[got.toxic == 0].mean() + 0.4


def test_hard_cases(spark):
    docs = frame(spark)
    lab = labels(spark, [(k, int(k == 5), 0) for k in range(20)] + [(5, None, 0), (None, 1, 0), (5, 0, 1)])
    out = toxicity(docs, lab)
    assert out.columns == [c for c in docs.columns if c != "score"] + ["score"]  # a score that was there makes way
    assert toxicity(docs, lab, ["doc_id"]).count() == docs.count()
    none = toxicity(docs, labels(spark, [(1, 1, 0)]).where("false"), ["doc_id"])
    assert {r.score for r in none.collect()} == {0.0}
    assert toxicity(docs.limit(0), lab, ["doc_id"]).count() == 0


def test_held_out_rows_teach_nothing(spark):
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 0]
    docs = spark.createDataFrame([(k, f"word{k} vile") for k in held], "doc_id long, text string")
    assert len(fit(docs, labels(spark, [(k, 1, 0) for k in held]))[0]) == 0


def test_few_clean_labels_make_nothing_toxic(spark):
    docs = frame(spark)
    for n in (1, 2, 3):
        taught = [k for k in range(1, 20) if zlib.crc32(str(k).encode()) % 5][:n]
        assert all(r.score < 0.5 for r in toxicity(docs, labels(spark, [(k, 0, 0) for k in taught]), ["doc_id"]).collect())


def test_own_columns_keep_their_values(spark):
    docs = frame(spark)
    got = scored(docs, labels(spark, [(k, int(k == 5), 0) for k in range(20)]))
    assert sorted(map(repr, (r.doc for r in got.collect()))) == sorted(map(repr, docs.collect()))


def test_sample_is_bounded_in_bytes(spark):
    taught = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5][:40]
    docs = spark.createDataFrame([(k, f"{'vile' if k % 2 else 'kind'} text") for k in taught], "doc_id long, text string")
    lab = labels(spark, [(k, k % 2, 0) for k in taught])
    assert len(fit(docs, lab)[0]) > 1 and len(fit(docs, lab, max_bytes=8)[0]) == 0


def test_a_long_text_is_passed_over_and_the_others_are_learned(spark):
    taught = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5][:120]
    rows = [(k, f"{'vile' if k % 2 else 'kind'} text number {k % 9}") for k in taught]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, [(k, k % 2, 0) for k in taught])
    first = docs.orderBy(F.xxhash64("doc_id"), "doc_id").first().doc_id  # whose turn comes first
    without = docs.where(F.col("doc_id") != first)
    for size in (100_001, 20_000):  # more than all room, more than one text may take
        long = without.unionAll(spark.createDataFrame([(first, "vile " * (size // 5))], "doc_id long, text string"))
        want, got = fit(without, lab, max_bytes=100_000), fit(long, lab, max_bytes=100_000)
        assert len(want[0]) > 1 and all(np.array_equal(a, b) for a, b in zip(want, got))
    assert len({round(r.score, 6) for r in toxicity(long, lab, ["doc_id"]).where(F.col("doc_id") != first).collect()}) > 1
    assert [r.score > 0.5 for r in scored(long, lab).where(F.col("doc.doc_id") == first).collect()] == [True]


def test_ftrl_against_the_plain_rule():
    """One coordinate and one block at a time, in plain numbers."""
    rng, size = np.random.default_rng(4), 12
    model, z, n = Ftrl(size), [0.0] * size, [0.0] * size

    def weight(i):
        l1 = 0.0 if i == 0 else L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((BETA + n[i] ** 0.5) / ALPHA + L2)

    for _ in range(60):
        sets = [sorted({0, *rng.choice(size, 4).tolist()}) for _ in range(5)]
        y = rng.integers(0, 2, 5).astype(float)
        model.learn(np.repeat(np.arange(5), [len(s) for s in sets]), np.array([i for s in sets for i in s]), y)
        w = [weight(i) for i in range(size)]
        p = [1 / (1 + np.exp(-sum(w[i] for i in s))) for s in sets]
        for i in range(size):
            if any(i in s for s in sets):
                g = sum((p[k] - y[k]) * (POSITIVE if y[k] else 1) for k, s in enumerate(sets) if i in s)
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / ALPHA * w[i]
                n[i] += g * g
    assert np.allclose(model.weights(), [weight(i) for i in range(size)]) and np.count_nonzero(model.weights()[1:]) > 0


def test_repeated_ids_teach_once(spark):
    taught = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5 != 0]
    rows = [(k, f"word{k % 7} text {'vile' if k % 3 == 0 else 'kind'}") for k in taught]
    lab, once_each = labels(spark, [(k, int(k % 3 == 0), 0) for k in taught]), spark.createDataFrame(rows, "doc_id long, text string")
    again = spark.createDataFrame(rows + [rows[1]] * 500, "doc_id long, text string")
    want, got = fit(once_each, lab), fit(again, lab)
    assert len(want[0]) > 1 and all(np.array_equal(a, b) for a, b in zip(want, got))
    others = once_each.unionAll(spark.createDataFrame([(rows[1][0], f"odd mark {k}") for k in range(500)], "doc_id long, text string"))
    assert not {*features(pa.array(["odd mark"]))[1].tolist()} & {*fit(others, lab)[0].tolist()}


def test_frequent_hashes_against_counts():
    from jobloom.llm import toxicity as t

    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 40, 200).astype(np.uint64) << np.uint64(58) | rng.integers(0, 9, 200).astype(np.uint64) for _ in range(3)] + [np.zeros(5, np.uint64)]
    values, counts = np.unique(np.concatenate(blocks), return_counts=True)
    assert t.frequent(blocks).tolist() == values[(counts >= t.MIN_DOCS) & (values > 0)].tolist() and not len(t.frequent([]))
