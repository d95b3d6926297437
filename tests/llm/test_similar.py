import random

from data import TEXTS, frame, words

from jobloom.llm.components import components
from jobloom.llm.similar import similar


def brute(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets.setdefault(i, set()).update({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def check(spark, docs, n, percent):
    want = brute([(r.doc_id, r.text) for r in docs.collect()], n, percent)
    got = similar(docs, n, percent).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r


def test_hard_cases(spark):
    check(spark, frame(spark), 3, 90)


def test_groups_of_copies(spark):
    """Exact and near copies, chains, and texts that share only a frequent passage."""
    rng, texts = random.Random(3), []
    vocabulary = [f"w{k}" for k in range(400)]
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 150]))]
        texts += [" ".join(base)] * 3
        for _ in range(12):
            base = list(base) if rng.random() < 0.5 else base
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append(" ".join(base))
    texts += [" ".join(["common"] * 3 + [f"line{k}" for k in range(20)] + [rng.choice(vocabulary) for _ in range(10)]) for _ in range(30)]
    rng.shuffle(texts)
    for n, percent in ((3, 90), (5, 80)):
        check(spark, frame(spark, texts, False), n, percent)


def test_empty(spark):
    assert similar(frame(spark, TEXTS).limit(0)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 50), (60, 100), (7, 7), (50, 60)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 1 for k in range(1, 41)} | {50: 50, 60: 50, 100: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_short_texts_alone_in_a_partition(spark):
    """Batches of one text with fewer words than a shingle, or as many."""
    for n in (3, 4, 5, 7):
        texts = [" ".join("abcdefgh"[:k]) for k in range(9)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9, "doc_id")
        check(spark, docs, n, 80)
    assert [tuple(r) for r in similar(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), 5, 80).collect()] == [(1, 1, 1)]


def test_form_letters_in_portions(spark, monkeypatch):
    """A template with own parts of many lengths: groups of one shingle are large, some letters link and some don't."""
    import jobloom.llm.similar as module

    rng = random.Random(6)
    template = [f"t{k}" for k in range(80)]
    texts = [" ".join(template + [f"own{k}x{j}" for j in range(rng.randrange(2, 22))]) for k in range(45)]
    texts += [" ".join([f"front{k}y{j}" for j in range(rng.randrange(1, 12))] + template) for k in range(20)]
    docs = frame(spark, texts, False)
    across = module.across
    for portion in (512, 4):
        monkeypatch.setattr(module, "across", lambda placed, classes, percent: across(placed, classes, percent, portion))  # noqa: B023
        check(spark, docs, 3, 90)
        check(spark, docs, 5, 80)
