"""Text functions. Normalisation has no built-in in Spark and runs as an Arrow function; all others are SQL expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as scripts in browsers see it.
SPACE = r"[\t\n\x0B\f\r    -     　﻿]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\u009F]"


def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """The composed form; null stays null."""
    return F.pandas_udf(_composed, T.StringType())(c)


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, with c worked out once however often f uses it; else what is nested would be worked out again and again."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def drop_controls(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def clean(c: Column) -> Column:
    """Without control characters, composed; only what isn't plain ASCII is sent to Python."""
    bare = drop_controls(c)
    return F.when(F.regexp_like(bare, F.lit(r"^[\x00-\x7F]*$")), bare).otherwise(nfc(bare))


def squash(c: Column) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def is_blank(c: Column) -> Column:
    return squash(c) == ""


def snippet(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]*)$", 1)


def is_pdf_name(c: Column) -> Column:
    return F.lower(c).endswith(".pdf")


def redacted_name(c: Column) -> Column:
    return F.concat(F.regexp_replace(F.coalesce(c, F.lit("document.pdf")), r"(?i)\.pdf$", ""), F.lit("-redacted.pdf"))


def percent_decode(c: Column) -> Column:
    """%HH becomes that byte; a plus sign stays. A bad escape gives null."""
    whole = F.regexp_replace(F.regexp_replace(c, r"\+", "%2B"), r"%([0-9A-Fa-f]?)$", "%25$1")
    return F.try_url_decode(whole)


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Halves go up, below zero too; whole numbers come as long."""
    if not digits:
        return F.floor(c + 0.5).cast("long")
    return F.floor(c * 10**digits + 0.5) / float(10**digits)
