"""A small documents table with hard cases, and a plain split of words."""

import re

UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket int"
LONG = " ".join(f"word{k % 977} and{k % 31}" for k in range(9000))
PASSAGE = "this passage of more than fifty words " + " ".join(f"alpha{k}" for k in range(60))
TEXTS = [
    None, "", " \t\n", "short", "two words", "the idiot said so", LONG, LONG, PASSAGE, "before it stands " + PASSAGE + " and something behind it", PASSAGE.upper(),
    "\n".join(f"line number {k} of the text with enough letters" for k in range(12)), "\n".join(f"line number {k} of the text with enough letters" for k in range(3, 15)),
    "mail a.b@example.com or +1 (555) 555-1234, card 4111 1111 1111 1111 at 10.0.0.1.", "mail a.b@example.com or +1 (555) 555-1234, card 4111 1111 1111 1111 at 10.0.0.1.",
    "é" * 70 + " ünïcode", "aaaa" * 60, "aaaa" * 40, "x y z " * 40, "<|endoftext|> tail \x00 nul", "no\x0bbreak\x1cspace", "a" * 5000,
]


def frame(spark, texts=TEXTS, extra=True):
    """Columns with clashing names stand beside; the last row has a null id, and the one before repeats the first text."""
    rows = [(k, t, "en", "s", None if t is None else len(t), 0.5, 1) for k, t in enumerate(texts)]
    if extra:
        rows += [(3, "short", "en", "s", 5, 0.5, 1), (None, "null id " + PASSAGE, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(UPPER))
