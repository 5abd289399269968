from __future__ import annotations

import math
import random
from functools import cmp_to_key

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vellum.functions import geometry as g
from vellum.operators import decisions as dc
from vellum.operators import detect as dt
from vellum.operators import layout as ly
from vellum.operators import masks as mk
from vellum.operators import verify as vf
from vellum.operators.lines import split_lines

SURE = ["Mục đích của bản vẽ này", "Kiểm tra trước khi giao", "Lỗi ở module login", "BÁO CÁO", "Đo lại sau mười phút", "Thay bơm mới", "Tốt", "Thợ máy", "Trạng thái máy"]
CLEAN = ["The pump is in the hall", "Résumé du système à vérifier", "Grüße aus Köln", "El niño", "", "12345", "v1.2", "Nguyen Van A", "Ho Chi Minh City", "Meeting in Hà Nội today", "패널 검사"]
DOUBT = ["Nguyễn Văn A", "Hải Phòng", "Khong duoc mo cua khi may dang chay"]


def score(spark, lines):
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, text string")
    found = dt.signals(rows).select("i", dt.confidence(F.col("signals")).alias("c")).collect()
    return {lines[r["i"]]: r["c"] for r in found}


def test_tiers_of_lines(spark):
    got = score(spark, SURE + CLEAN + DOUBT)
    assert [x for x in SURE if got[x] < 0.85] == []
    assert [x for x in CLEAN if got[x] >= 0.6] == []
    assert [x for x in DOUBT if not 0.6 <= got[x] < 0.85] == []


def test_caps(spark):
    got = score(spark, ["Nguyễn Văn A", "Đà Nẵng", "Khong duoc mo cua nguoi phai cac", "A B C"])
    assert got["Nguyễn Văn A"] == got["Đà Nẵng"] == 0.7
    assert got["Khong duoc mo cua nguoi phai cac"] <= 0.78 and got["A B C"] < 0.6


def test_composed_and_decomposed_text_score_alike(spark):
    import unicodedata

    from vellum.functions.text import clean

    rows = spark.createDataFrame([(i, unicodedata.normalize("NFD", t)) for i, t in enumerate(SURE)], "i int, text string").withColumn("text", clean(F.col("text")))
    got = dt.signals(rows).select("i", dt.confidence(F.col("signals")).alias("c")).collect()
    want = score(spark, SURE)
    assert all(r["c"] == want[SURE[r["i"]]] for r in got)


def test_null_lines_score_nothing(spark):
    rows = spark.createDataFrame([(None,), ("",)], "text string")
    assert {r[0] for r in dt.signals(rows).select(dt.confidence(F.col("signals"))).collect()} == {0.0}


def test_thresholds(spark):
    t = dt.Thresholds().with_auto(0.5)
    assert t.uncertain == 0.5 and dt.Thresholds.preset("high").auto == 0.65 and t.with_uncertain(0.9).uncertain == 0.5
    tiers = spark.createDataFrame([("auto", 0.9, 0.5), ("auto", 0.9, None), ("ignored", 0.9, None), ("confirmed", 0.1, None), ("manual", 1.0, None), ("auto", 0.7, 0.1)], "s string, c double, o double")
    assert [r[0] for r in tiers.select(dt.effective_tier(F.col("s"), F.col("c"), F.col("o"), dt.Thresholds())).collect()] == ["uncertain", "auto", "none", "auto", "auto", "uncertain"]


def test_split_lines(spark):
    docs = spark.createDataFrame([(1, "a\n\n  \nb"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in split_lines(docs).orderBy("line_no").collect()] == [(1, 0, "a"), (1, 3, "b")]


def item(i, text, x, y, size=12.0, rotation=0.0, width=None, dir="ltr"):
    w = len(text) * size * 0.5 if width is None else width
    return {"id": f"i{i}", "item_index": i, "text": text, "x": x, "y": y - 0.2 * size, "width": w, "height": size, "font_size": size, "rotation": rotation, "baseline_x": x, "baseline_y": y, "advance": w, "ascent": 0.8 * size, "descent": 0.2 * size, "dir": dir}


def texts(items):
    return [line[0] for line in ly.page_lines(items, ly.Grouping())]


def test_items_of_a_line_are_joined_with_spaces_at_gaps():
    assert texts([item(0, "Hel", 10, 100), item(1, "lo", 28, 100), item(2, "world", 46, 100)]) == ["Hello world"]


def test_columns_are_parted_and_read_left_to_right():
    got = texts([item(0, "left", 10, 100), item(1, "right", 300, 100), item(2, "below", 10, 80)])
    assert got == ["left", "right", "below"]


def test_overprint_is_dropped_in_chains():
    assert texts([item(i, "bold", 10 + 3 * i, 100) for i in range(2)] + [item(2, "x", 60, 100)])[0].startswith("bold")
    assert "boldbold" not in "".join(texts([item(i, "bold", 10 + 3 * i, 100) for i in range(2)]))


def test_small_marks_share_a_line_and_other_sizes_do_not():
    assert texts([item(0, "x", 10, 100), item(1, "2", 17, 103, size=6)]) == ["x2"]
    assert len(texts([item(0, "Title", 10, 100, size=24), item(1, "small text", 75, 102, size=10)])) == 2


def test_directions_are_apart():
    assert len(texts([item(0, "across", 10, 100), item(1, "up", 10, 100, rotation=90.0)])) == 2
    assert len(texts([item(0, "a", 10, 100), item(1, "b", 17, 100, rotation=1.5)])) == 1


def test_order_of_items_does_not_matter():
    rng = random.Random(4)
    items = [item(i, rng.choice(["ab", "cde", "f"]), 10 + 40 * rng.randint(0, 8), 700 - 14 * rng.randint(0, 9)) for i in range(60)]
    want = ly.page_lines(items, ly.Grouping())
    for _ in range(5):
        rng.shuffle(items)
        assert ly.page_lines(items, ly.Grouping()) == want


def brute_lines(items):
    """One item after the other, by the definitions: directions, bands, gaps, overprint, order."""
    left, out = sorted(items, key=lambda i: (i["rotation"], i["item_index"])), []
    while left:
        angle = left[0]["rotation"]
        bucket = [i for i in left if i["rotation"] - angle <= 2]
        left = left[len(bucket) :]
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        seen = []
        for i in bucket:
            v = i["baseline_y"] * c - i["baseline_x"] * s
            up, down = (i["font_size"] / 2, i["font_size"] / 2) if i["dir"] == "ttb" else (i["ascent"], i["descent"])
            u = i["baseline_x"] * c + i["baseline_y"] * s
            seen.append({**i, "u": u, "e": u + i["advance"], "v": v, "lo": v - down, "hi": v + up})
        rows = []
        for i in sorted(seen, key=lambda i: (-i["v"], i["u"])):
            for row in rows[::-1][:8]:
                j = row[0]
                least = min(i["hi"] - i["lo"], j["hi"] - j["lo"])
                shared = min(i["hi"], j["hi"]) - max(i["lo"], j["lo"])
                small, large = sorted((i, j), key=lambda k: k["font_size"])
                alike = large["font_size"] <= 1.5 * small["font_size"] or len(small["text"].strip()) <= 3
                if least > 0 and shared >= 0.5 * least and alike:
                    row.append(i)
                    break
            else:
                rows.append([i])
        for row in rows:
            lines = []
            for i in sorted(row, key=lambda i: (i["u"], i["item_index"])):
                last = lines[-1][-1] if lines else None
                if last and last["text"] == i["text"] and (min(last["e"], i["e"]) - max(last["u"], i["u"])) / max(last["e"] - last["u"], 1e-6) > 0.7:
                    continue
                far = last is not None and i["u"] - max(k["e"] for k in lines[-1]) > 1.5 * max(last["font_size"], i["font_size"])
                if last is None or far:
                    lines.append([])
                lines[-1].append(i)
            for line in lines:
                text = line[0]["text"]
                for n, i in enumerate(line[1:], 1):
                    gap = i["u"] - max(k["e"] for k in line[:n])
                    text += (" " if gap > 0.18 * i["font_size"] and not text[-1:].isspace() and not i["text"][:1].isspace() else "") + i["text"]
                x, y = min(i["x"] for i in line), min(i["y"] for i in line)
                w, h = max(i["x"] + i["width"] for i in line) - x, max(i["y"] + i["height"] for i in line) - y
                mid = len(line) // 2
                out.append((" ".join(text.split()), x, y, w, h, angle, sorted(i["font_size"] for i in line)[mid], sorted(i["baseline_y"] for i in line)[mid], [i["id"] for i in line]))
    by = lambda p, q: q[2] + q[4] - p[2] - p[4] if abs(q[2] + q[4] - p[2] - p[4]) > 0.5 * min(p[6], q[6]) else p[1] - q[1]
    return sorted(out, key=cmp_to_key(by))


def random_page(rng):
    n = rng.randint(0, 40)
    return [
        item(i, rng.choice(["ab", "cde", "f", " x", "long word", "tail "]), 10.0 + 7 * rng.randint(0, 60), 700.0 - 5 * rng.randint(0, 40), rng.choice([8.0, 10.0, 12.0, 20.0]), rng.choice([0.0, 0.0, 0.0, 1.5, 2.5, 4.0, 90.0]), dir=rng.choice(["ltr", "ltr", "ttb", "rtl"]))
        for i in range(n)
    ]


def test_grouping_matches_brute_force_on_random_pages(spark):
    rng = random.Random(12)
    pages = [random_page(rng) for _ in range(300)]
    for items in pages:
        want, got = brute_lines(items), ly.page_lines(items, ly.Grouping())
        assert [(x[0], x[8]) for x in got] == [(x[0], x[8]) for x in want]
        assert all(a[1:8] == pytest.approx(b[1:8]) for a, b in zip(got, want, strict=True))
    rows = [i | {"doc_id": d // 7, "page_index": d % 7} for d, items in enumerate(pages) for i in items]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)  # pages go on in the next batch
    out = ly.group_lines(spark.createDataFrame(pd.DataFrame(rows)), ["doc_id", "page_index"]).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["page_index"], r["line_no"])):
        found.setdefault((r["doc_id"], r["page_index"]), []).append((r["text"], r["item_ids"]))
    assert found == {(d // 7, d % 7): [(x[0], x[8]) for x in brute_lines(items)] for d, items in enumerate(pages) if items}


def test_group_lines_of_pages(spark):
    rows = [item(i, "w", 10 + 20 * i, 100) | {"doc_id": d, "page_index": p} for d in (1, 2) for p in (0, 1) for i in range(2)]
    out = ly.group_lines(spark.createDataFrame(pd.DataFrame(rows)), ["doc_id", "page_index"])
    assert out.count() == 4 and {r["text"] for r in out.collect()} == {"w w"}


def test_upper_median(spark):
    df = spark.createDataFrame([([10.0, 12.0, 14.0, 20.0],), ([3.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(ly.upper_median(F.col("v"))).collect()] == [14.0, 3.0, None]


def laid(rng, n):
    rows = []
    for i in range(n):
        size = rng.choice([10.0, 12.0, 20.0])
        x, base = float(rng.randint(0, 60)), 700.0 - 9 * i + rng.randint(-2, 2)
        rows.append((1, 0, f"l{i}", f"text {i}", (x, base - 0.25 * size, float(rng.randint(20, 90)), size), size, base, rng.choice([0.0, 0.0, 0.0, 90.0]), None, i))
    return rows


LINE = "doc_id int, page_index int, line_id string, text string, bbox struct<x:double,y:double,width:double,height:double>, font_size double, baseline double, rotation double, ocr_confidence double, ordinal int"


def brute_clip(own, others):
    _, _, name, _, (x, y, w, h), size, base, turn, _, _ = own
    left, right, low, high = x - 2, x + w + 2, y - 1, y + h + 1
    for o in others:
        ox, oy, ow, oh = o[4]
        if o[2] == name or min(right, ox + ow) <= max(left, ox) or min(high, oy + oh) <= max(low, oy):
            continue
        if abs(turn) < 1 and abs(o[7]) < 1 and abs(base - o[6]) > 0.3 * max(size, o[5]):
            if o[6] < base:
                cap, down = o[6] + 0.75 * o[5], base - 0.22 * size
                low = max(low, min(base, cap if cap <= down else (cap + down) / 2))
            else:
                cap = base + 0.75 * size
                high = min(high, max(base + 0.5 * size, o[6] if o[6] >= cap else (o[6] + cap) / 2))
        elif ox >= x + w / 2:
            right = min(right, max(x + w, (x + w + ox) / 2))
        elif ox + ow <= x + w / 2:
            left = max(left, min(x, (ox + ow + x) / 2))
    return left, low, max(0.0, right - left), max(0.0, high - low)


def test_clipping_matches_brute_force(spark):
    rows = laid(random.Random(9), 40)
    lines = spark.createDataFrame(rows, LINE)
    found = lines.select("doc_id", "page_index", "line_id", F.lit("d").alias("detector"), F.lit("vi").alias("language"), F.lit(0.9).alias("confidence"))
    out = {r["line_id"]: r["mask"] for r in mk.clip(mk.candidates(lines, found), lines).collect()}
    for own in rows:
        got = out[own[2]]
        assert [got["x"], got["y"], got["width"], got["height"]] == pytest.approx(brute_clip(own, rows))


def test_masked_neighbours_are_not_protected(spark):
    rows = laid(random.Random(2), 20)
    lines = spark.createDataFrame(rows, LINE)
    found = lines.select("doc_id", "page_index", "line_id", F.lit("d").alias("detector"), F.lit("vi").alias("language"), F.when(F.col("ordinal") % 2 == 0, 0.9).otherwise(0.7).alias("confidence"))
    none = spark.createDataFrame([], "doc_id int, key string, override string")
    out = {r["line_id"]: r["mask"] for r in mk.resolve(lines, found, none, dt.Thresholds()).collect()}
    seen = [r for r in rows if r[9] % 2]
    for own in rows:
        got = out[own[2]]
        assert [got["x"], got["y"], got["width"], got["height"]] == pytest.approx(brute_clip(own, seen))


def test_decisions_of_the_user(spark):
    masks = spark.createDataFrame([(1, "a", "auto"), (1, "b", "manual"), (1, "c", "auto")], "doc_id int, key string, status string")
    told = spark.createDataFrame([(1, "a", "ignored"), (1, "b", "ignored")], "doc_id int, key string, override string")
    shown = spark.createDataFrame([(1, "c"), (1, "c")], "doc_id int, key string")
    assert {(r["key"], r["status"], r["visible"]) for r in mk.decide(masks, told, shown).collect()} == {("a", "ignored", True), ("b", "manual", True), ("c", "auto", False)}


def test_leaks_and_controls(spark):
    region = g.box(F.lit(10.0), F.lit(10.0), F.lit(50.0), F.lit(10.0))
    regions = spark.range(2).select(F.lit(1).alias("doc_id"), F.lit(0).alias("page_index"), F.col("id").cast("int").alias("region_no"), region.alias("region"))
    items = spark.createDataFrame([(1, 0, 0, "secret", 12.0, 11.0, 20.0, 8.0), (1, 0, 1, "beside", 55.0, 11.0, 30.0, 8.0), (1, 0, 2, " ", 12.0, 11.0, 5.0, 5.0), (1, 1, 3, "other page", 12.0, 11.0, 5.0, 5.0)], "doc_id int, page_index int, item_index int, text string, x double, y double, w double, h double")
    items = items.withColumn("box", g.box(*map(F.col, "xywh")))
    found = vf.item_leaks(items, regions).collect()
    assert [(r["item_index"], r["region_no"]) for r in found] == [(0, 0)]
    chars = spark.createDataFrame([(1, 0, 0, "s", 10.5, 15.0), (1, 0, 1, "t", 10.4, 15.0), (1, 0, 2, " ", 20.0, 15.0)], "doc_id int, page_index int, char_index int, char string, cx double, cy double")
    assert [r["char_index"] for r in vf.char_leaks(chars, regions).collect()] == [0]
    pixels = spark.createDataFrame([(1, 0, n, v, v, v) for n, v in [(0, 5)] * 97 + [(0, 255)] * 3 + [(1, 5)] * 90 + [(1, 255)] * 10], "doc_id int, page_index int, region_no int, r int, g int, b int")
    assert [r["region_no"] for r in vf.pixel_leaks(pixels).collect()] == [1]
    vf.require_clean(vf.item_leaks(items.limit(0), regions))
    with pytest.raises(ValueError, match="can still be extracted"):
        vf.require_clean(vf.item_leaks(items, regions))


def test_decision_log(spark):
    d = dc.Decisions()
    for step in (("set", "a", "ignored"), ("set", "a", "ignored"), ("add", "m"), ("undo",), ("redo",), ("clear", "zz"), ("set", "b", "confirmed"), ("undo",), ("remove", "m"), ("redo",)):
        d.apply(*step)
    assert d.now == ({"a": "ignored"}, ()) and len(d.past) == 3 and not d.future
    for i in range(500):
        d.apply("set", "k", str(i))
    assert len(d.past) == dc.HISTORY
    log = spark.createDataFrame([(1, 2, "undo", None, None), (1, 1, "set", "a", "ignored"), (2, 1, "set", "a", "ignored"), (2, 2, "add", "m", None)], "doc_id int, seq int, op string, key string, value string")
    assert {(r["doc_id"], r["key"], r["manual"]) for r in dc.replay(log).collect()} == {(2, "a", False), (2, "m", True)}


def test_latest_update_wins_with_its_nulls(spark):
    rows = spark.createDataFrame([(1, 0, 1, "ocr", 5), (1, 0, 2, "ready", None)], "doc_id int, page_index int, seq int, state string, value int")
    assert [tuple(r) for r in dc.latest(rows, ["doc_id", "page_index"]).collect()] == [(1, 0, 2, "ready", None)]


def test_session_cache(spark):
    cache = dc.SessionCache(2)
    for h in "abc":
        cache.put(h, True, spark.range(1))
    assert cache.get("a", True) is None and cache.get("c", True).count() == 1 and cache.get("c", False) is None
    for df in (cache.get("b", True), cache.get("c", True)):
        df.unpersist()
