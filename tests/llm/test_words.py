import numpy as np
import pyarrow as pa

from jobloom.llm.words import ALNUM, SPACED, Words, inside, run_hash, span_hashes, text_slices, word_hashes


def test_words():
    w = Words(pa.array(["A b\x0b c", "", " É-x9 \t"]), SPACED)
    assert [w.unique[i].as_py() for i in w.codes] == ["a", "b", "c", "É-x9"] and w.splits.tolist() == [0, 3, 3, 4]
    w = Words(pa.array(["A-b_C 9é"]), ALNUM)
    assert [w.unique[i].as_py() for i in w.codes] == ["a", "b", "c", "9é"]
    assert len(Words(pa.array(["", "  "]), SPACED)) == 0


def test_slices_cover_everything():
    batch = pa.RecordBatch.from_pydict({"k": list(range(7)), "text": ["aa", None, "b" * 50, "", "cc", "d", "é"]})
    got = [(b.column("k").to_pylist(), t.to_pylist()) for b, t in text_slices([batch], limit=4)]
    assert sum((k for k, _ in got), []) == list(range(7)) and sum((t for _, t in got), []) == ["aa", "", "b" * 50, "", "cc", "d", "é"]


def test_runs_stay_inside():
    w = Words(pa.array(["a b c", "a b c d"]), SPACED)
    h = run_hash(w.hashes(), 3)
    assert h[0] == h[3] and inside(w.splits, 3, len(w)).tolist() == [True, False, False, True, True]
    assert len(np.unique(h)) == len(h) - 1


def test_runs_of_short_texts():
    for n in range(1, 9):
        for size in range(9):
            assert len(run_hash(np.arange(1, size + 1).astype(np.uint64), n)) == max(0, size - n + 1)


def test_span_hashes():
    x = np.array([5, 7, 9, 5, 7, 9, 5], np.uint64)
    h = span_hashes(x, np.array([0, 3, 1, 0]), np.array([3, 6, 4, 0]))
    assert h[0] == h[1] and len(np.unique(h)) == 3


def test_word_hashes():
    """Words of all lengths, with zero bytes and equal heads and tails, hash apart, and alike whatever stands beside them."""
    words = [w for n in range(80) for w in dict.fromkeys(["x" * n, "x" * n + "\0", "\0" * n + "x", "x" * n + "é", "yx" + "x" * n])]
    words = list(dict.fromkeys(words))
    h = word_hashes(pa.array(words))
    assert len(np.unique(h)) == len(words) and (h > 0).all()
    assert [word_hashes(pa.array([w]))[0] for w in words] == h.tolist()
    assert word_hashes(pa.array(words).slice(7, 100)).tolist() == h[7:107].tolist()
    assert len(word_hashes(pa.array([], pa.string()))) == 0
