"""Settings as JSON: every field is clamped to its range, or falls back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = 1
#: Least, most and fallback of each number; fallbacks of the flags.
NUMBERS = {"auto": (0.5, 0.99, 0.85), "uncertain": (0.3, 0.99, 0.6), "pad_x": (0.0, 12.0, 2.0), "pad_y": (0.0, 12.0, 1.0), "opacity": (0.5, 1.0, 1.0)}
FLAGS = {"showUncertain": True, "fillUncertain": False, "autoDetect": True, "ocrEnabled": True}
_PATHS = {"auto": "thresholds.auto", "uncertain": "thresholds.uncertain", "pad_x": "maskPadding.x", "pad_y": "maskPadding.y", "opacity": "maskOpacity"}


def parse(raw: Column) -> Column:
    """struct of settings; text that isn't settings of this version gives the fallbacks."""
    json = F.try_parse_json(raw)
    ours = F.coalesce(F.try_variant_get(json, "$.version", "int") == VERSION, F.lit(False))

    def number(name: str, most: Column | None = None) -> Column:
        least, top, fallback = NUMBERS[name]
        path = f"$.settings.{_PATHS[name]}"
        told = F.when(ours & ~F.coalesce(F.schema_of_variant(F.try_variant_get(json, path, "variant")).isin("STRING", "BOOLEAN", "VOID"), F.lit(False)), F.try_variant_get(json, path, "double"))
        top = F.lit(top) if most is None else most
        return F.when(told.isNotNull(), F.least(top, F.greatest(F.lit(least), told))).otherwise(F.least(F.lit(fallback), top))

    def flag(name: str) -> Column:
        path = f"$.settings.{name}"
        is_flag = F.schema_of_variant(F.try_variant_get(json, path, "variant")) == "BOOLEAN"
        return F.coalesce(F.when(ours & is_flag, F.try_variant_get(json, path, "boolean")), F.lit(FLAGS[name]))

    auto = number("auto")
    return F.struct(
        auto.alias("auto"), number("uncertain", auto).alias("uncertain"), number("pad_x").alias("pad_x"), number("pad_y").alias("pad_y"), number("opacity").alias("opacity"), *(flag(n).alias(n) for n in FLAGS)
    )


def dump(s: Column) -> Column:
    inner = F.struct(
        F.struct(s["auto"].alias("auto"), s["uncertain"].alias("uncertain")).alias("thresholds"),
        F.struct(s["pad_x"].alias("x"), s["pad_y"].alias("y")).alias("maskPadding"),
        s["opacity"].alias("maskOpacity"),
        *(s[n].alias(n) for n in FLAGS),
    )
    return F.to_json(F.struct(F.lit(VERSION).alias("version"), inner.alias("settings")))
