"""The library's queries over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from vellum.catalog import language, pages, processing
from vellum.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "language", "pages", "processing"]
