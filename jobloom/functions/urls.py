"""URL expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ._args import ColumnOrName, column

# Fixed value: the site whose links are resolved.
BASE = "https://www.topcv.vn"
PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#;]*)"


def url_key(url: ColumnOrName) -> Column:
    """The last two segments before the first `?`; a fragment stays."""
    return F.substring_index(F.substring_index(column(url), "?", 1), "/", -2)


def url_hash(url: ColumnOrName) -> Column:
    """Lower-hex SHA-256 of the key; null for a null or empty URL."""
    c = column(url)
    return F.when(c != "", F.sha2(url_key(c), 256))


def url_path(url: ColumnOrName) -> Column:
    """The path, without query and fragment. A URL with line breaks or without a path gives what comes before."""
    return F.regexp_extract(column(url), PATH, 1)


def resolve(link: ColumnOrName, base: str = BASE) -> Column:
    """A link as an absolute URL, against a base that has no path."""
    c = column(link)
    scheme = base.split("//", 1)[0]
    up = F.regexp_replace(F.concat(F.lit("/"), c), r"^(?:/\.\.?(?=/|$))+", "")
    return (
        F.when(c.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), c)
        .when(c.startswith("//"), F.concat(F.lit(scheme), c))
        .when(c.startswith("/"), F.concat(F.lit(base), c))
        .when(c.startswith("?") | c.startswith("#") | (c == ""), F.concat(F.lit(base), c))
        .otherwise(F.concat(F.lit(base), F.when(up == "", F.lit("/")).otherwise(up)))
    )


def search_url(slug: ColumnOrName, page: ColumnOrName, base: str = BASE) -> Column:
    """The address of one result page of a keyword."""
    return F.concat(F.lit(f"{base}/tim-viec-lam-"), column(slug), F.lit("?type_keyword=1&page="), column(page).cast("string"), F.lit("&sba=1"))
