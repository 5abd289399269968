"""Keys and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import round_half_up

#: The FNV-1a hash of 32 bits.
OFFSET, PRIME, MASK = 2166136261, 16777619, 0xFFFFFFFF


def fnv1a(text: Column) -> Column:
    """FNV-1a over UTF-16 code units, as long. Products stay below 2**57, so nothing can overflow."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    values = F.transform(units, lambda u: F.conv(u, 16, 10).cast("long"))
    return F.aggregate(values, F.lit(OFFSET).cast("long"), lambda h, u: (h.bitwiseXOR(u) * F.lit(PRIME).cast("long")).bitwiseAND(F.lit(MASK).cast("long")))


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def region_key(page: Column, b: Column, text: Column) -> Column:
    """page:x,y,width,height:hash of the text, the box in whole points."""
    edges = F.concat_ws(",", *(round_half_up(b[n]).cast("string") for n in ("x", "y", "width", "height")))
    return F.concat_ws(":", page.cast("string"), edges, base36(fnv1a(text)))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)
