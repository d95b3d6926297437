"""All registered queries of the library, and their SQL."""

from __future__ import annotations

from . import pages, stores, tables

QUERIES = tables.QUERIES | pages.QUERIES | stores.QUERIES
ORACLE = tables.ORACLE | pages.ORACLE | stores.ORACLE
