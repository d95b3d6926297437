import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from data import TEXTS, frame, words

from jobloom.llm.lm_score import CLASS_NOISE, END, SLOT_NOISE, SLOTS, SPAN, UNKNOWN, Model, Trainer, Vocabulary, contexts, hashed, lm_score, token_counts, token_hashes, train
from jobloom.llm.words import SPACED, Words, crc_mod


def scored(spark, docs):
    return lm_score(docs.select("doc_id", "text", (crc_mod("doc_id", 7) == 2).alias("held_out")))


def test_base_scores(spark):
    docs = frame(spark)
    rows = [(r.doc_id, words(r.text) + [None]) for r in docs.collect()]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, ws in rows if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), out(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in rows)
    got = scored(spark, docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_no_training_texts_and_empty(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    row = scored(spark, spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    assert scored(spark, frame(spark, TEXTS).limit(0)).count() == 0


def test_model_is_normalised_and_learns():
    counts = np.zeros(SLOTS)
    counts[:40] = np.arange(40, 0, -1) * 100
    trainer, rng = Trainer(counts), np.random.default_rng(0)
    slot = rng.integers(2, 40, 4000)
    slot[1::2] = (slot[0::2] * 7) % 38 + 2  # every second token follows from the one before
    before = contexts(slot, np.array([len(slot) - 1]))
    assert before[5].tolist() == slot[4:1:-1].tolist() and before[1].tolist() == [slot[0], END, END]
    start = Model.start(counts).log_probs(slot, before).mean()
    for _ in range(60):
        trainer.learn(slot, before)
    every = np.arange(SLOTS)
    total = np.exp(trainer.m.log_probs(every, np.tile([[5, 9, 3]], (SLOTS, 1)))).sum()
    assert abs(total - 1) < 1e-3 and trainer.m.log_probs(slot, before).mean() > start + 0.3
    again = Model.unpack(trainer.m.pack().ravel(), trainer.m)
    assert all(np.array_equal(getattr(again, n), getattr(trainer.m, n)) for n in Model.NAMES)


def test_gradient_against_differences():
    """The step of one batch goes against the slope of the contrastive loss, found by small differences."""
    slots = 4 * SPAN
    counts = np.random.default_rng(1).integers(1, 50, slots).astype(float)
    rng = np.random.default_rng(2)
    slot, before = rng.integers(0, slots, 300), rng.integers(0, slots, (300, 3))

    def loss(m, t):  # with the noise that the trainer draws from the same seed
        draw, s = np.random.default_rng(0), 0.0
        order = np.argsort(slot // SPAN, kind="stable")
        r, k = m.context(before[order]).astype(float), slot[order] // SPAN
        drawn = np.searchsorted(t.class_upto, draw.random(CLASS_NOISE) * t.class_upto[-1], "right")
        soft = lambda x: np.logaddexp(0, x).sum()
        s += soft(r @ m.u[drawn].T + m.a[drawn] - t.log_class[drawn]) + soft(-((r * m.u[k]).sum(1) + m.a[k] - t.log_class[k]))
        for c in np.unique(k):
            some = c * SPAN + np.searchsorted(t.slot_upto[c], draw.random(SLOT_NOISE), "right")
            s += soft(r[k == c] @ m.v[some].T + m.b[some] - t.log_slot[some])
        w = slot[order]
        return s + soft(-((r * m.v[w]).sum(1) + m.b[w] - t.log_slot[w]))

    trainer = Trainer(counts)
    steps = {}
    trainer.step = lambda name, rows, g: steps.__setitem__(name, (rows, g))
    trainer.learn(slot, before)
    for name in Model.NAMES:
        x, (rows, g) = getattr(trainer.m, name).astype(float), steps[name]
        setattr(trainer.m, name, x)
        for at in (0, len(rows) // 2):
            cell = (rows[at], 3) if x.ndim == 2 else (rows[at],)
            old, ends = x[cell], []
            for e in (1e-3, -1e-3):
                x[cell] = old + e
                ends.append(loss(trainer.m, trainer))
            x[cell] = old
            got = g[at][3] if x.ndim == 2 else g[at]
            assert abs(got * 300 / 32 - (ends[0] - ends[1]) / 2e-3) < 2e-2 * max(1, abs(got * 300 / 32))


def test_whole_vocabulary_sums_to_one(spark):
    """The end, frequent words, words that share slots, and one unknown."""
    rng, slots = np.random.default_rng(4), 4 * SPAN
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.3, 400) % 3000) for _ in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "false held_out")
    counts = token_counts(docs)
    v = Vocabulary.of(counts, slots)
    c = Counter(w for t in texts for w in t.split())
    h = Words(pa.array([" ".join(c)]), SPACED)
    every, k = token_hashes(h)[h.codes], hashed(slots)
    n = np.array([c[w.as_py()] for w in h.unique.take(pa.array(h.codes))])
    assert len(v.hashes) == slots - k - 2 < len(c) and v.types == len(c) + 1 and v.tokens == sum(c.values()) + 8
    slot, n = np.concatenate([[END], v.look()(every), [UNKNOWN]]), np.concatenate([[v.ends], n, [0]])
    model = Model.start(v.slot_counts)
    logs = model.log_probs(slot, np.tile([[7, END, slots - 1]], (len(slot), 1))).astype(float)
    assert abs(np.exp(v.mixed(logs, slot, n)).sum() - 1) < 1e-4
    # The query's scores are those of its model, worked out token by token.
    got = {r.doc_id: r.score for r in lm_score(docs, slots=slots, bucket_bytes=2000).collect()}
    model = train(docs, v)
    by_word = dict(zip([w.as_py() for w in h.unique.take(pa.array(h.codes))], zip(v.look()(every).tolist(), n[1:-1].tolist())))
    for i, t in enumerate(texts):
        before, score = [END, END, END], 0.0
        for s, m in [*(by_word[w] for w in t.split()), (END, v.ends)]:
            r = model.context(np.array([before[::-1]])).astype(float)[0]
            soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
            p = soft(model.u @ r + model.a)[s // SPAN] * soft(model.v[s // SPAN * SPAN :][:SPAN] @ r + model.b[s // SPAN * SPAN :][:SPAN])[s % SPAN]
            if s >= slots - k:
                p *= (m + 1) / v.mass[s - slots + k]
            score += math.log10(0.9 * p + 0.1 * (m + 1) / (v.tokens + v.types + 1))
            before = [*before[1:], s]
        assert abs(score - got[i]) < 1e-3 * abs(score)


def test_better_than_base_on_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = scored(spark, docs).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert s[0] > s[1]


def test_rarer_words_that_end_alike_share_a_slot():
    words = Words(pa.array(["nation station ration option été", "é x ab nation"]), SPACED)
    h, names = token_hashes(words), words.unique.to_pylist()
    low = {w: int(x) & 1023 for w, x in zip(names, h)}
    assert len(set(h.tolist())) == len(names) and low["nation"] == low["station"] == low["ration"] == low["option"] != low["x"]
    again = Words(pa.array(["x", "station é"]), SPACED)
    assert {w: x for w, x in zip(again.unique.to_pylist(), token_hashes(again))}.items() <= dict(zip(names, h)).items()
