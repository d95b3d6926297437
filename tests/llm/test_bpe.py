"""Against the tokenizers library, and an exact round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from data import LONG, TEXTS, frame
from pyspark.sql import functions as F

from jobloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["'", "s", "t", "re", "ve", "ll", "d", "m", "a", "E", " ", "  ", "\n", "\t", "\xa0", "　", "1", "٣", "é", "中", "𝒳", "😀", "!", "-", "_", "<|endoftext|>", "<|", "|>", "ᲊ", "́", "\r\n", "the", " of", "tion", "͸", "ꟲ"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Tokenizer(PATH)


def ids_of(own, texts):
    ids, size = own.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])], (ids, size)


def test_random_texts(own, library):
    rnd = random.Random(11)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 25))) for _ in range(4000)] + ["a" * 5000, "ab" * 3000, "中文" * 700, "-" * 999, " " * 300 + "x"]
    got, (ids, size) = ids_of(own, texts)
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.decode(ids, size) == texts


def test_long_words_by_rank_and_by_rounds_agree(own):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("ethanosir x") for _ in range(rnd.randint(1, 400))).encode() for _ in range(50)] + [b"aaaa" * 77, b"a", b"xx"]
    size = np.array([len(w) for w in words])
    sym = own.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    for x, y in zip(own.merges.rounds(sym.copy(), size), own.merges.by_rank(sym.copy(), size)):
        assert x.tolist() == y.tolist()


def test_decode_of_any_ids(own, library):
    rnd = random.Random(4)
    rows = [[rnd.randrange(50257) for _ in range(rnd.randint(0, 9))] for _ in range(2000)]
    assert own.decode(np.array(sum(rows, [])), np.array(list(map(len, rows)))) == [library.decode(r, skip_special_tokens=False) for r in rows]
    assert own.decode(np.array([-5, 64, 10**6]), np.array([3])) == [library.decode([64])]


def test_stretches_change_nothing(own, library):
    text = (LONG + " 　 it's\n\n<|endoftext|> 12 é" + "x" * 700) * 3
    parts = list(bpe.stretches(pa.array([text]), 512))
    assert len(parts) > 100 and "".join(p[0].as_py() for p in parts) == text
    assert np.concatenate([own.encode(p)[0] for p in parts]).tolist() == library.encode(text, add_special_tokens=False).ids
    assert [p[0].as_py() for p in bpe.stretches(pa.array(["x" * 2000]), 512)] == ["x" * 2000]  # nowhere to cut


def test_words_are_forgotten_and_learned_again(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEEP", 3)
    own = bpe.Tokenizer(PATH)
    for k in range(4):
        assert ids_of(own, [f"some words {k} or other"])[0] == [library.encode(f"some words {k} or other").ids]


def test_table(spark, library):
    texts = [*TEXTS, LONG * 90]  # the last one is longer than a slice
    got = bpe.decode(bpe.encode(frame(spark, texts), PATH), PATH).collect()
    want = [(k, t) for k, t in enumerate(texts)] + [(3, "short"), (None, next(t for t in [r.text for r in frame(spark, texts).collect()] if (t or "").startswith("null id")))]
    expected = sorted((str(k), hashlib.sha256(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest(), t or "") for k, t in want)
    assert sorted((str(r.doc_id), r.ids_sha256, r.decoded) for r in got) == expected
    assert bpe.decode(bpe.encode(frame(spark).limit(0), PATH), PATH).count() == 0


def test_query(spark, sf_dir, library):
    from jobloom.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op11_bpe_round_trip"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text, add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
