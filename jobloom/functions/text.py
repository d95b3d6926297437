"""Text expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ._args import ColumnOrName, column

#: Unicode white space, also the kinds that Java's \s leaves out.
WHITE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"

# Letters with marks and the letter each becomes.
LETTERS = {
    "a": "àáảãạăằắẳẵặâầấẩẫậäåā", "c": "çćč", "d": "đð", "e": "èéẻẽẹêềếểễệëē", "i": "ìíỉĩịîïī", "n": "ñ",
    "o": "òóỏõọôồốổỗộơờớởỡợöøō", "s": "šś", "u": "ùúủũụưừứửữựûüū", "y": "ỳýỷỹỵÿ", "z": "žźż",
}
# Letters that become two.
PAIRS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}

FROM = "".join(LETTERS.values())
TO = "".join(k * len(v) for k, v in LETTERS.items())


def slug(text: ColumnOrName) -> Column:
    """A keyword as part of an address: ASCII, lower case, a run of white space as one `-`, any other character as `-`.

    Covers Latin letters with marks (also decomposed); letters of other scripts become `-` one by one.
    """
    c = F.translate(F.lower(column(text)), FROM, TO)
    for letter, pair in PAIRS.items():
        c = F.replace(c, F.lit(letter), F.lit(pair))
    c = F.regexp_replace(c, r"\p{M}", "")
    return F.regexp_replace(F.regexp_replace(c, WHITE, "-"), "[^a-z0-9-]", "-")


def clean(text: ColumnOrName) -> Column:
    """Runs of white space as one space, none at the ends; an empty text is null."""
    return F.nullif(F.trim(F.regexp_replace(column(text), WHITE, " ")), F.lit(""))


def clean_ends(text: ColumnOrName) -> Column:
    """No white space at the ends; an empty text stays empty."""
    return F.regexp_replace(column(text), f"^{WHITE}|{WHITE}$", "")


# The entities that pages are written with, in the order in which they are replaced.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#x27;": "'", "&amp;": "&"}


def unescaped(text: ColumnOrName) -> Column:
    """ENTITIES as the characters they stand for; anything else that begins with & stays."""
    c = column(text)
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def only_whole_entities(html: ColumnOrName) -> Column:
    """HTML in which a parser finds no references but ENTITIES: any other & stands for itself, as `&amp` without its end does."""
    return F.regexp_replace(column(html), f"&(?!(?:{'|'.join(e[1:] for e in ENTITIES)}))", "&amp;")


def max_page(text: ColumnOrName) -> Column:
    """The page count in `n / m trang`; 1 if there is none, also for null."""
    return F.coalesce(F.nullif(F.regexp_extract(column(text), r"/\s*(\d+)\s*trang", 1), F.lit("")).try_cast("int"), F.lit(1))


def deadline(texts: ColumnOrName) -> Column:
    """From an array of texts: the first that says "Hạn nộp", its date d/m/yyyy or else the whole text; null if none."""
    # The words and the form of the date.
    t = F.try_element_at(F.filter(column(texts), lambda x: x.contains("Hạn nộp")), F.lit(1))
    return F.coalesce(F.nullif(F.regexp_extract(t, r"(\d{1,2}/\d{1,2}/\d{4})", 1), F.lit("")), t)


def without_brand(name: ColumnOrName) -> Column:
    """A name less the site's own suffix; the result may be empty."""
    return F.regexp_replace(column(name), r"(?iu)\s*\|\s*TopCV.*$", "")  # fixed value: the suffix


def without_label(text: ColumnOrName, label: ColumnOrName) -> Column:
    """A row's text less every occurrence of its label (any case, literal) and less ` :-–—` at the ends."""
    pattern = F.concat(F.lit(r"(?iu)\Q"), F.replace(column(label), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.trim(F.regexp_replace(column(text), pattern, F.lit("")), F.lit(" :-–—"))


def label_part(text: ColumnOrName) -> Column:
    """What stands before the first colon (ASCII or full width), trimmed; null without label or value."""
    return F.when(column(text).rlike(_PARTS), F.trim(F.regexp_extract(column(text), _PARTS, 1)))


def value_part(text: ColumnOrName) -> Column:
    """What stands behind the first colon, trimmed; null without label or value."""
    return F.when(column(text).rlike(_PARTS), F.trim(F.regexp_extract(column(text), _PARTS, 2)))


# Fixed value: label, colon (ASCII or full width) and value.
_PARTS = r"^([^:：]+)[:：]\s*(.+)$"

# Words in a label that name a field, in the order of the tests.
FIELDS = [("website", ("website", "trang web")), ("size", ("quy mô", "size", "nhân sự")), ("industry", ("lĩnh vực", "industry", "ngành")), ("address", ("địa chỉ", "address"))]


def company_field(label: ColumnOrName) -> Column:
    """Which field of a company a label names: website, size, industry, address or null; the first test that holds."""
    low = F.regexp_replace(F.lower(column(label)), WHITE, " ")
    out = F.lit(None).cast("string")
    for field, words in reversed(FIELDS):
        test = F.lit(False)
        for w in words:
            test = test | low.contains(w)
        out = F.when(test, F.lit(field)).otherwise(out)
    return out


def joined(items: ColumnOrName) -> Column:
    """Texts of an array with "; " between; null for an empty or null array."""
    return F.when(F.size(column(items)) > 0, F.array_join(column(items), "; "))


def last_text(blocks: ColumnOrName, title: str) -> Column:
    """The text of the last block (title, text) with a title."""
    return F.try_element_at(F.filter(column(blocks), lambda b: b["title"] == title), F.lit(-1))["text"]


def state_time(ts: ColumnOrName) -> Column:
    return F.date_format(column(ts), "yyyy-MM-dd HH:mm:ss")


def file_time(ts: ColumnOrName) -> Column:
    return F.date_format(column(ts), "yyyyMMddHHmmss")


def output_label(slug_: ColumnOrName, start: ColumnOrName, end: ColumnOrName, last: ColumnOrName, ts: ColumnOrName) -> Column:
    """The name of a crawl's output: slug, pages and time."""
    return F.concat(column(slug_), F.lit("-"), column(start).cast("string"), F.lit("_to_"), F.least(column(end), column(last)).cast("string"), F.lit("-"), file_time(ts))


def schedule_id(number: ColumnOrName, keyword: ColumnOrName) -> Column:
    """The id of a keyword's schedule; spaces and slashes become `_`."""
    return F.lower(F.concat(F.lit("crawl_keyword_"), column(number).cast("string"), F.lit("_"), F.translate(column(keyword), " /", "__")))
