import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import xxhash
from data import words
from test_line_dedup import brute as plain_line_dedup
from test_similar import brute as plain_groups
from tokenizers import Tokenizer

import corpus_pipeline
from jobloom.llm import toxicity as tox


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "packing"]
    counts = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), f"test-{name}")
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns and counts[-1] <= counts[-2]
    assert docs.select("doc_id").distinct().count() == counts[4] and counts[4] > counts[0] // 2
    assert corpus_pipeline.ORACLE_SQL is None


def test_registered(spark, sf_dir):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_short_documents_and_clashing_columns(spark, sf_dir):
    """Three-word texts alone in a partition; columns named like the operators' own keep their values up to packing."""
    names = ["score", "gone", "__gone", "__id", "id", "h", "keep", "doc", "items", "__items", "n_removed", "key", "rep", "component_id"]
    rows = [(k, text, *[f"v{k}{c}" for c in names]) for k, text in enumerate(["a b c", None, "", "one two", "a b c"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names)).repartition(5, "doc_id")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), f"test-{name}")
    assert sorted(map(tuple, docs.collect())) == [r for r in rows if r[0] < 4]  # of the copies the first stays
    packed = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir)
    assert sorted(r.doc_id for r in packed.collect()) == [0, 1, 2, 3]


def plain_features(text):
    """Words less marks around them, their heads, pairs of neighbours and pairs over one word."""
    w = [x.strip(tox.TRIM) for x in words(text)]
    pairs = {(gap, a, b) for gap in (1, 2) for a, b in zip(w, w[gap:])}
    return {("word", x) for x in w} | {("head", x.decode("utf-8", "ignore")[:4]) for x in w} | pairs


def plain_toxicity(rows, labels):
    """Scores by one dictionary of weights: the same steps, feature by feature."""
    texts = {i: t for i, t in rows if i in labels and zlib.crc32(str(i).encode()) % 5}
    order = sorted(texts, key=lambda i: xxhash.xxh3_64_intdigest(str(i)))
    sets, y = [plain_features(texts[i]) for i in order], [labels[i] for i in order]
    often = Counter(f for s in sets for f in s)
    sets = [{f for f in s if often[f] >= tox.MIN_DOCS} | {"bias"} for s in sets]
    z, n = Counter(), Counter()

    def weight(f):
        l1 = 0.0 if f == "bias" else tox.L1
        return 0.0 if abs(z[f]) <= l1 else -(z[f] - (l1 if z[f] > 0 else -l1)) / ((tox.BETA + n[f] ** 0.5) / tox.ALPHA + tox.L2)

    def chance(features):
        return 1 / (1 + np.exp(-sum(weight(f) for f in features)))

    starts = range(0, len(sets), tox.BLOCK)
    for epoch in range(tox.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(starts)):
            block, marks = sets[starts[k] : starts[k] + tox.BLOCK], y[starts[k] : starts[k] + tox.BLOCK]
            off, g = [chance(s) - m for s, m in zip(block, marks)], Counter()
            for s, d, m in zip(block, off, marks):
                for f in s:
                    g[f] += d * (tox.POSITIVE if m else 1)
            old = {f: weight(f) for f in g}
            for f, v in g.items():
                z[f] += v - ((n[f] + v * v) ** 0.5 - n[f] ** 0.5) / tox.ALPHA * old[f]
                n[f] += v * v
    return {i: chance({f for f in plain_features(t) if often[f] >= tox.MIN_DOCS} | {"bias"}) for i, t in rows}


def plain_contaminated(text, items):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = split(text)
    for item in map(split, items):
        n = min(10, len(item))
        if n and {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} & {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}:
            return True
    return False


def plain_pipeline(rows, labels, items):
    """(what each stage keeps, pieces in the end), document by document."""
    score = plain_toxicity(rows, labels)
    kept = [[(i, t) for i, t in rows if score[i] < 0.5]]
    lines = plain_line_dedup(kept[-1])
    kept.append([(i, t if t is None else lines[i, t]) for i, t in kept[-1] if not t or lines[i, t]])
    groups = plain_groups(kept[-1], 5, 80)
    kept.append([(i, t) for i, t in kept[-1] if groups[i][1] == i])
    kept.append([(i, t) for i, t in kept[-1] if not plain_contaminated(t, items)])
    tok, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, t in kept[-1]:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        pieces += [(i, len(ids), k, min(2048, len(ids) - k), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    return score, kept, sorted(pieces)


def test_against_plain_version(spark, tmp_path):
    rng = random.Random(11)
    pool = [f"{a}{b}" for a in ("river", "stone", "cloud", "table", "green", "north") for b in ("", "s", "ly", "ward", "ish", "most", "less", "like")]
    line = lambda n: " ".join(rng.choice(pool) + str(rng.randrange(40)) for _ in range(n))
    items = ["what " + line(14), line(9), "  ", None, line(30)]
    texts = ["\n".join(line(rng.randrange(3, 14)) for _ in range(rng.randrange(1, 6))) for _ in range(90)]
    toxic = [f"{line(6)} you vile worthless fool {line(4)}\n{line(8)}" for _ in range(40)]
    shared, base = "\n".join(line(12) for _ in range(3)), line(120).split()
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in (10, 50, 90)] + [" ".join(base)]
    texts += toxic + near + near[-1:] + ["tiny copy", "tiny copy", None, "", " \n", line(3000)]
    texts += [f"{line(5)}\n{shared}\n{line(6)}" for _ in range(4)] + [f"{line(7)} {items[0].upper()} {line(3)}", f"{line(7)} {items[1]} end", f"{line(4)} {' '.join(items[4].split()[5:15])}", f"{line(4)} {' '.join(items[4].split()[5:14])} x"]
    rng.shuffle(texts)
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)]
    labels = {i: float("vile" in (t or "")) for i, t in rows}
    spark.createDataFrame([(i, t, "en", f"s{i % 2}") for i, t in rows], "doc_id long, text string, lang string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(y), 0) for i, y in labels.items()], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    score, kept, pieces = plain_pipeline(rows, labels, items)
    sizes = [len(rows), *map(len, kept)]
    assert all(a > b for a, b in zip(sizes, sizes[1:])), sizes  # every stage has work to do
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc.doc_id: r.score for r in tox.scored(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    assert got.keys() == score.keys() and all(abs(got[i] - score[i]) < 1e-6 for i in got)
    for (name, stage), want in zip(corpus_pipeline.STAGES, kept):
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), f"plain-{name}")
        assert sorted((r.doc_id, r.text or "") for r in docs.collect()) == [(i, t or "") for i, t in want], name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32) for r in out) == pieces
    filled = Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert filled[r.sequence_id] == r.offset
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048
