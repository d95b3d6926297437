"""Against a plain version on whole texts, and an exact round trip."""

import hashlib
import re

from data import LONG, TEXTS, frame

from jobloom.llm import fill_middle as fim


def plain(doc, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text, text
    if h4 % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def expected(doc, text):
    *rest, out, back = plain(doc, text)
    return (doc, *rest, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


MORE = ["one <M> marker\nand a line", "<P>", "<S\n>", "é\n" * 50, "\n\n\n", "no end\nat all", "<P\n<S\n<M\n", LONG.replace(" and", "\nand") * 20, "x" * 300_000, "\n".join("y" * 5000 for _ in range(60))]


def test_table(spark):
    texts = [*TEXTS, *MORE]
    docs = frame(spark, texts)
    want = sorted([expected(r.doc_id, r.text) for r in docs.collect()], key=str)
    for size in (fim.PIECE, 100):
        some = docs if size > 100 else docs.where("length(text) < 20000 or text is null")
        keep = want if size > 100 else sorted([expected(r.doc_id, r.text) for r in some.collect()], key=str)
        assert sorted(map(tuple, fim.round_trip(fim.pieces(some, size=size)).collect()), key=str) == keep
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    assert fim.round_trip(fim.pieces(docs.limit(0))).count() == 0


def test_texts(spark):
    docs = frame(spark, [*TEXTS, *MORE])
    got = sorted([(r.doc_id, r.form, r.text) for r in fim.fill_middle(docs).collect()], key=str)
    assert got == sorted([(r.doc_id, plain(r.doc_id, r.text)[1], plain(r.doc_id, r.text)[4]) for r in docs.collect()], key=str)
    assert {r.form for r in fim.fill_middle(docs, rate=0).collect()} == {"plain"} and "psm" not in {r.form for r in fim.fill_middle(docs, spm=100).collect()}


def test_pieces_are_lines_of_bounded_size(spark):
    cut = fim.pieces(frame(spark, ["".join("y" * 50 + "\n" for _ in range(60)), "z" * 500], extra=False), size=120).collect()
    assert max(len(r.piece) for r in cut) == 120 and all(r.piece.endswith(b"\n") for r in cut if b"y" in r.piece and len(r.piece) > 50)


def test_copies_are_dealt_apart_and_counted(spark):
    docs = frame(spark, ["a\nb\nc\n"], extra=False)
    many = docs.unionByName(docs).unionByName(docs).coalesce(1)
    assert fim.pieces(many).select("document").distinct().count() == 3
    assert [tuple(r) for r in fim.round_trip(fim.pieces(many)).collect()] == [expected(0, "a\nb\nc\n")] * 3


def test_one_shuffle(spark):
    plan = fim.round_trip(fim.pieces(frame(spark)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_query(spark, sf_dir):
    from jobloom.llm.queries import QUERIES

    got = sorted(map(tuple, QUERIES["op13_fill_middle"](spark, sf_dir).collect()), key=str)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted([expected(d.doc_id, d.text) for d in docs], key=str)
