import hashlib

import numpy as np
from data import frame

from jobloom.llm.fingerprint import BASES, BINS, GRAM, P, Prefix, code_points, edited, fingerprint, likeness, prints, shared_starts
from jobloom.llm.words import mix


def common(p, a, b, other=None):
    most = min(len(p.sums[0]) - 1 - a, len((other or p).sums[0]) - 1 - b)
    return p.common(np.array([a]), np.array([b]), np.array([most]), other)[0]


def plain_print(text):
    """The fingerprint by the rule, in plain Python: span hashes by definition, the least of each bin."""
    points, m64 = [ord(c) + 1 for c in text], (1 << 64) - 1

    def span(a, z):
        return sum((sum(x * pow(base, k, int(P)) for k, x in enumerate(points[a:z])) % int(P)) << s for base, s in zip(BASES, (31, 0)))

    def stir(h):
        return int(mix(np.array([h & m64], np.uint64))[0])

    least = {}
    for a in range(max(len(points) - GRAM + 1, 1) if points else 0):
        h = stir(span(a, min(a + GRAM, len(points))))
        least[h % BINS] = min(least.get(h % BINS, m64), h >> 7)
    whole = stir(span(0, len(points)) + len(points)) if points else 0
    return whole.to_bytes(8, "big") + bytes(stir(least[k]) % 255 + 1 if k in least else 0 for k in range(BINS))


def test_spans_and_common_extensions():
    text = "abcabcabd" * 3
    p, q = Prefix(code_points(text)), Prefix(code_points("xxabcabcx"))
    for a in range(0, 20, 3):
        for b in range(0, 20, 2):
            want = next((n for n in range(30) if text[a + n : a + n + 1] != text[b + n : b + n + 1] or a + n >= len(text) or b + n >= len(text)), 0)
            assert common(p, a, b) == want
    assert common(p, 0, 2, q) == 6
    assert p.span(np.array([0]), np.array([3]))[0] == p.span(np.array([3]), np.array([6]))[0] != p.span(np.array([6]), np.array([9]))[0]


def test_likeness():
    base = " ".join(f"w{k * 7919 % 1009}" for k in range(400))
    other = " ".join(f"v{k * 104729 % 1013}" for k in range(400))
    a, b, c, d, e, f = prints([base, base[: len(base) * 3 // 4] + other[: len(base) // 4], other, base, "", "x"])
    one = lambda x, y: likeness(x[None], y[None])[0]
    assert one(a, d) == 1 and one(e, e) == 1 and 0.4 < one(a, b) < 0.9 and one(a, c) < 0.15 and one(e, f) == 0 and (a == d).all()


def test_against_plain(spark):
    docs = frame(spark)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        e = edited(t, rows[(k + 1) % len(rows)][1])
        want.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest()))
    got = fingerprint(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = {r.doc_id: r.fingerprint for r in got}
    assert by[6] == by[7] and by[13] == by[14] and by[0] == by[1] and by[6] != by[13]
    assert fingerprint(docs.limit(0)).count() == 0
    one = fingerprint(docs.where("doc_id = 8")).first()
    assert one.near_next == 1


def test_fingerprints_by_the_rule_and_likeness_against_sets(spark):
    text = lambda seed, n: " ".join(f"{seed}{k * 7919 % 613}" for k in range(n))
    texts = ["", "x", "short é", text("w", 60), text("w", 40) + text("v", 20), text("w", 300), text("w", 250) + text("u", 50), text("q", 200)]
    docs = frame(spark, texts, False)
    grams = lambda t: {t[k : k + GRAM] for k in range(max(len(t) - GRAM + 1, 1))} if t else set()
    for r in fingerprint(docs).collect():
        own, after = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        e = edited(own, after)
        assert (r.fingerprint, r.edited_fingerprint) == (plain_print(own).hex(), plain_print(e).hex())
        start = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert (r.common_edited, r.common_next) == (start(own, e), start(own, after))
        for other, near in ((e, r.near_edited), (after, r.near_next)):
            x, y = grams(own), grams(other)
            if len(x) >= 100 and len(y) >= 100:
                assert abs(near - len(x & y) / len(x | y)) < 0.17
    assert shared_starts([], []).tolist() == []
