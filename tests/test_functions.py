from __future__ import annotations

import math
import unicodedata
from urllib.parse import unquote_to_bytes

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import geometry as g
from vellum.functions import keys, lexicon
from vellum.functions import text as tx


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def box(*four):
    return g.box(*map(F.lit, four))


def fields(row):
    return None if row is None else (row["x"], row["y"], row["width"], row["height"])


def test_boxes(spark):
    a, b, c = box(0, 0, 10, 10), box(5, 5, 10, 10), box(10, 0, 5, 5)
    got = one(spark, g.intersect(a, b), g.intersect(a, c), g.overlap_ratio(a, b), g.overlap_ratio(a, c), g.pad(a, -6, 1), g.from_edges(F.lit(4.0), F.lit(1.0), F.lit(1.0), F.lit(3.0)), g.rounded(box(0.005, 1.004, 2.346, 0.0)))
    assert fields(got[0]) == (5, 5, 5, 5) and got[1] is None and got[2] == 0.25 and got[3] == 0
    assert fields(got[4]) == (6, -1, 0, 12) and fields(got[5]) == (1, 1, 3, 2)
    assert fields(got[6]) == (0.01, 1.0, 2.35, 0.0)


boxes = st.tuples(*[st.integers(-50, 50)] * 2, *[st.integers(0, 60)] * 2)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(boxes, boxes), min_size=20, max_size=20))
def test_laws_of_boxes(spark, pairs):
    rows = spark.createDataFrame([(i, *map(float, a + b)) for i, (a, b) in enumerate(pairs)], "i int, ax double, ay double, aw double, ah double, bx double, by double, bw double, bh double")
    a, b = g.box(*map(F.col, ("ax", "ay", "aw", "ah"))), g.box(*map(F.col, ("bx", "by", "bw", "bh")))
    for r in rows.select(g.intersect(a, b).alias("p"), g.intersect(b, a).alias("q"), g.overlap_ratio(a, b).alias("r"), g.area(a).alias("s"), g.meets(a, b).alias("m")).collect():
        assert r["p"] == r["q"] and (r["p"] is not None) == r["m"]
        assert 0 <= r["r"] <= 1 and (r["p"] is None or r["p"]["width"] * r["p"]["height"] <= r["s"])


@pytest.mark.parametrize("turn", [0, 90, 180, 270, 360, -90, 44, 46])
def test_viewport_there_and_back(spark, turn):
    view = F.struct(F.lit(10.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(622.0).alias("x1"), F.lit(812.0).alias("y1"))
    v = g.viewport(view, F.lit(turn), F.lit(2.0), F.lit(1.5))
    b = box(100, 200, 30, 40)
    there, back, unit = one(spark, g.map_box(v["matrix"], b), g.map_box(g.invert(v["matrix"]), g.map_box(v["matrix"], b)), g.multiply(v["matrix"], g.invert(v["matrix"])))
    assert there["x"] >= 0 and there["y"] >= 0
    assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(fields(back), (100, 200, 30, 40), strict=True))
    assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(unit, (1, 0, 0, 1, 0, 0), strict=True))
    assert math.isclose(there["width"] * there["height"], 30 * 40 * (1.5 * 2 * 96 / 72) ** 2)


def test_singular_matrix_raises(spark):
    with pytest.raises(Exception, match="no inverse"):
        spark.range(1).select(g.invert(g.matrix(*[F.col("id") * 0.0] * 6))).collect()


def test_degrees(spark):
    for d, want in ((0, 0), (180, 180), (-180, 180), (190, -170), (-370, -10), (1e-12, 0), (720.5, 0.5)):
        assert math.isclose(one(spark, g.degrees(F.lit(float(d))))[0], want, abs_tol=1e-9)
    assert [one(spark, g.quarter_turn(F.lit(d)))[0] for d in (0, 44, 45, 89, -90, 450, 720)] == [0, 0, 90, 90, 270, 90, 0]


def fnv(text):
    h = 2166136261
    units = text.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h = (h ^ int.from_bytes(units[i : i + 2])) * 16777619 % 2**32
    return h


def base36(n):
    out = ""
    while n:
        n, d = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out or "0"


def test_keys(spark):
    texts = ["", "a", "Mục tiêu", "😀 astral", "x" * 500]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    key = keys.region_key(F.lit(3), box(1.5, -0.5, 2.4, 7), F.col("t"))
    for r in rows.select("t", keys.fnv1a(F.col("t")).alias("h"), key.alias("k"), keys.sha256(F.lit("abc")).alias("s")).collect():
        assert r["h"] == fnv(r["t"]) and r["k"] == f"3:2,0,2,7:{base36(fnv(r['t']))}"
        assert r["s"].startswith("ba7816bf")


def test_text(spark):
    rows = ["été", "a\x00b\x1f\u009fc\tD", None, "  x  　﻿ y ", "", "plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r["i"]: (r["c"], r["s"], r["b"]) for r in df.select("i", tx.clean(F.col("t")).alias("c"), tx.squash(F.col("t")).alias("s"), tx.is_blank(F.col("t")).alias("b")).collect()}
    assert got[0][0] == "été" and got[1][0] == "abc\tD" and got[2] == (None, None, None)
    assert got[3][1] == "x y" and got[4][2] and not got[5][2]
    assert [one(spark, tx.round_half_up(F.lit(v)))[0] for v in (0.5, -0.5, 1.49, -1.5)] == [1, 0, 1, -1]
    assert one(spark, tx.snippet(F.lit("abcdef"), 3), tx.redacted_name(F.lit(None).cast("string")), tx.redacted_name(F.lit("a.pdf.PDF"))) == ("abc…", "document-redacted.pdf", "a.pdf-redacted.pdf")


def test_percent_decode(spark):
    for s in ("/a%20b", "c%2Bd+e", "%C3%A9", "100%", "50%2"):
        assert one(spark, tx.percent_decode(F.lit(s)))[0].encode() == unquote_to_bytes(s)
    assert one(spark, tx.percent_decode(F.lit("%zz")))[0] is None


def test_syllables():
    marked, plain = lexicon.marked_syllables(), lexicon.plain_syllables()
    assert {"gi", "quôc", "nghe", "kê", "đương", "oanh", "ngươi"} <= set(marked)
    assert not {"ka", "ce", "nga" * 2, "quu", "quo", "gii", "ge"} & set(marked)
    assert {"quoc", "duong", "nguoi", "gi"} <= set(plain) and all(unicodedata.normalize("NFD", s) == s for s in plain)
    assert lexicon.strip_marks("Đường ẤM") == "Duong AM"
    for table in (lexicon.bare_table(), lexicon.tone_table()):
        assert len(table[0]) == len(table[1]) == len(set(table[0]))
