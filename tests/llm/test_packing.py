import zlib

import numpy as np
import public_tokenizers
from data import frame
from tokenizers import Tokenizer

from jobloom.llm.packing import best_fit, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_best_fit_takes_the_tightest():
    window, offset = best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert window.tolist() == [0, 1, 0, 1, 1] and offset.tolist() == [0, 0, 6, 5, 8]
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 1025, 3000)
    window, offset = best_fit(sizes)
    fill = np.bincount(window, sizes)
    assert fill.max() <= 2048 and fill.sum() / (2048 * len(fill)) > 0.99
    open_ = {}
    for k in np.argsort(-sizes, kind="stable"):  # the same, by trying all windows
        fits = [c for c in open_.values() if c >= sizes[k]]
        took = 2048 - offset[k]
        assert took == (min(fits) if fits else 2048)
        open_[window[k]] = took - sizes[k]


def test_pieces(spark):
    tok = Tokenizer.from_file(PATH)
    docs = frame(spark)
    got = [r.asDict() for r in pack(docs, PATH).collect()]
    want = sorted((str(r.doc_id), tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in docs.collect())
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    pieces = sorted((i, len(ids), k, min(2048, len(ids) - k), crc(ids[k : k + 2048])) for i, ids in want for k in range(0, len(ids), 2048))
    assert sorted((str(r["doc_id"]), r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces
    by = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert by.get(r["sequence_id"], 0) == r["offset"]
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 2048
    assert pack(docs.limit(0), PATH).count() == 0
