"""Columns by name or as they are."""

from __future__ import annotations

from typing import Union

from pyspark.sql import Column, functions as F

ColumnOrName = Union[Column, str]


def column(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c
