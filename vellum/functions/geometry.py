"""Boxes as struct<x,y,width,height> and affine maps as struct<a,b,c,d,e,f>, in double. A null box stays null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import once, round_half_up

#: Fixed value: pixels a point.
PX_PER_PT = 96 / 72


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (width, "width"), (height, "height"))])


def from_edges(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return box(F.least(x0, x1), F.least(y0, y1), F.abs(x1 - x0), F.abs(y1 - y0))


def pad(b: Column, dx: float, dy: float) -> Column:
    zero = F.lit(0.0)
    return box(b["x"] - dx, b["y"] - dy, F.greatest(zero, b["width"] + 2 * dx), F.greatest(zero, b["height"] + 2 * dy))


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def top(b: Column) -> Column:
    return b["y"] + b["height"]


def meets(a: Column, b: Column) -> Column:
    """Whether the boxes share more than an edge."""
    return (F.least(right(a), right(b)) > F.greatest(a["x"], b["x"])) & (F.least(top(a), top(b)) > F.greatest(a["y"], b["y"]))


def intersect(a: Column, b: Column) -> Column:
    """What the boxes share; null if that is no more than an edge."""
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    return F.when(meets(a, b), box(x, y, F.least(right(a), right(b)) - x, F.least(top(a), top(b)) - y))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["width"]) * F.greatest(F.lit(0.0), b["height"])


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared area over the smaller area; 0 if either is empty."""
    smaller = F.least(area(a), area(b))
    return F.when(meets(a, b) & (smaller > 0), area(intersect(a, b)) / smaller).otherwise(F.lit(0.0))


def rounded(b: Column, digits: int = 2) -> Column:
    return box(*(round_half_up(b[n], digits) for n in ("x", "y", "width", "height")))


def matrix(*six: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip(six, "abcdef", strict=True)])


def apply(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"]


def invert(m: Column) -> Column:
    """The inverse map; a map without one raises."""
    return once(m, _inverse)


def _inverse(m: Column) -> Column:
    det = m["a"] * m["d"] - m["b"] * m["c"]
    det = F.when(det == 0, F.raise_error(F.lit("the matrix has no inverse")).cast("double")).otherwise(det)
    ef = [(m["c"] * m["f"] - m["d"] * m["e"]) / det, (m["b"] * m["e"] - m["a"] * m["f"]) / det]
    return matrix(m["d"] / det, -m["b"] / det, -m["c"] / det, m["a"] / det, *ef)


def multiply(p: Column, q: Column) -> Column:
    """The map that does q first, then p."""
    return once(F.struct(p.alias("p"), q.alias("q")), lambda both: _product(both["p"], both["q"]))


def _product(p: Column, q: Column) -> Column:
    return matrix(
        *(p[r] * q[c0] + p[s] * q[c1] for c0, c1 in (("a", "b"), ("c", "d")) for r, s in (("a", "c"), ("b", "d"))),
        p["a"] * q["e"] + p["c"] * q["f"] + p["e"],
        p["b"] * q["e"] + p["d"] * q["f"] + p["f"],
    )


def map_box(m: Column, b: Column) -> Column:
    """The upright box around the mapped corners."""
    return once(F.struct(m.alias("m"), b.alias("b")), lambda both: _around(both["m"], both["b"]))


def _around(m: Column, b: Column) -> Column:
    xs, ys = zip(*(apply(m, x, y) for x in (b["x"], right(b)) for y in (b["y"], top(b))), strict=True)
    return box(F.least(*xs), F.least(*ys), F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys))


def quarter_turn(degrees: Column) -> Column:
    """The nearest of 0, 90, 180 and 270."""
    return F.pmod(F.floor(degrees / 90 + 0.5) * 90, F.lit(360)).cast("int")


def degrees(d: Column) -> Column:
    """In (-180, 180], with what is next to nothing as 0."""
    d = d % 360
    d = F.when(d <= -180, d + 360).when(d > 180, d - 360).otherwise(d)
    return F.when(F.abs(d) < 1e-9, F.lit(0.0)).otherwise(d)


def viewport(view: Column, rotate: Column, unit: Column, zoom: Column) -> Column:
    """struct<matrix,width,height> from user space of a page (view: struct<x0,y0,x1,y1>) to pixels, y down."""
    unit = F.when(F.coalesce(unit, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(unit)
    scale = (zoom * F.lit(PX_PER_PT) * unit).cast("double")
    given = F.struct(view.alias("view"), quarter_turn(rotate).alias("turn"), scale.alias("scale"))
    return once(given, lambda x: _viewport(x["view"], x["turn"], x["scale"]))


def _viewport(view: Column, turn: Column, scale: Column) -> Column:
    side = turn.isin(90, 270)
    cx, cy = (view["x0"] + view["x1"]) / 2, (view["y0"] + view["y1"]) / 2
    w, h = F.abs(view["x1"] - view["x0"]) * scale, F.abs(view["y1"] - view["y0"]) * scale
    dx, dy = F.abs(cx - view["x0"]) * scale, F.abs(cy - view["y0"]) * scale
    # columns of the turn's matrix at 0, 90, 180 and 270 degrees
    turns = ((1.0, 0.0, -1.0, 0.0), (0.0, 1.0, 0.0, -1.0), (0.0, 1.0, 0.0, -1.0), (-1.0, 0.0, 1.0, 0.0))
    a, b, c, d = (F.get(F.array(*map(F.lit, four)), (turn / 90).cast("int")) * scale for four in turns)
    e = F.when(side, dy).otherwise(dx) - a * cx - c * cy
    f = F.when(side, dx).otherwise(dy) - b * cx - d * cy
    return F.struct(matrix(a, b, c, d, e, f).alias("matrix"), F.when(side, h).otherwise(w).alias("width"), F.when(side, w).otherwise(h).alias("height"))


def radians(d: Column) -> Column:
    return d * math.pi / 180


def rectangle(m: Column, b: Column) -> Column:
    """A box under a matrix as [x0, y0, x1, y1]."""
    mapped = map_box(m, b)
    return F.array(mapped["x"], mapped["y"], right(mapped), top(mapped))


def share_of(b: Column, width: Column, height: Column) -> Column:
    """A box as shares, 0 to 1, of a page of that width and height."""
    return box(b["x"] / width, b["y"] / height, b["width"] / width, b["height"] / height)
