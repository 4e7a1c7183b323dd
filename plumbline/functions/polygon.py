"""Polygons as arrays of rings, and what can be said of them without a geometry library.

A polygon column is array<struct<hole boolean, pts array<struct<x double, y double>>>>; rings are closed (first = last point),
outer rings run one way and holes the other (`oriented`). An edge table has a row per edge: key columns, x1, y1, x2, y2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPE = "array<struct<hole:boolean,pts:array<struct<x:double,y:double>>>>"


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A rectangle."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(F.struct(F.lit(False).alias("hole"), F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0)).alias("pts")))


def _sides(pts: Column) -> Column:
    """Pairs (p, q) of neighbouring points."""
    return F.zip_with(F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def ring_area(pts: Column) -> Column:
    """Signed, around the first point."""
    o = F.element_at(pts, 1)
    return _sum(F.transform(_sides(pts), lambda s: ((s.p.x - o.x) * (s.q.y - o.y) - (s.q.x - o.x) * (s.p.y - o.y)) / F.lit(2.0)))


def oriented(rings: Column) -> Column:
    """Outer rings counter-clockwise, holes clockwise."""
    return F.transform(rings, lambda r: F.struct(r.hole.alias("hole"), F.when((ring_area(r.pts) < 0) != r.hole, F.reverse(r.pts)).otherwise(r.pts).alias("pts")))


def area(rings: Column) -> Column:
    return _sum(F.transform(rings, lambda r: F.when(r.hole, -F.abs(ring_area(r.pts))).otherwise(F.abs(ring_area(r.pts)))))


def centroid(rings: Column) -> Column:
    """x, y: area-weighted over oriented rings; null without area."""
    o = F.element_at(F.element_at(rings, 1).pts, 1)

    def moment(axis: str) -> Column:
        at = lambda v: v.getField(axis) - o.getField(axis)
        cross = lambda s: (s.p.x - o.x) * (s.q.y - o.y) - (s.q.x - o.x) * (s.p.y - o.y)
        return _sum(F.transform(F.flatten(F.transform(rings, lambda r: _sides(r.pts))), lambda s: (at(s.p) + at(s.q)) * cross(s) / F.lit(6.0)))

    whole = _sum(F.transform(rings, lambda r: ring_area(r.pts)))
    return F.when(whole != 0, F.struct((o.x + moment("x") / whole).alias("x"), (o.y + moment("y") / whole).alias("y")))


def bbox(rings: Column) -> Column:
    pts = F.flatten(F.transform(rings, lambda r: r.pts))
    xs, ys = F.transform(pts, lambda p: p.x), F.transform(pts, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd rule."""
    crossings = F.filter(F.flatten(F.transform(rings, lambda r: _sides(r.pts))), lambda s: ((s.p.y > y) != (s.q.y > y)) & (x < (s.q.x - s.p.x) * (y - s.p.y) / (s.q.y - s.p.y) + s.p.x))
    return F.size(crossings) % 2 == 1


def is_valid(rings: Column) -> Column:
    """Every ring closed, of at least four points, with area, and no two of its sides crossing (those that share an end aside)."""
    side = lambda a, b, c: F.signum((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x))
    crosses = lambda s, t: (side(s.p, s.q, t.p) * side(s.p, s.q, t.q) < 0) & (side(t.p, t.q, s.p) * side(t.p, t.q, s.q) < 0)
    ring = lambda r: (F.size(r.pts) >= 4) & (F.element_at(r.pts, 1) == F.element_at(r.pts, -1)) & (ring_area(r.pts) != 0) & ~F.exists(_sides(r.pts), lambda s: F.exists(_sides(r.pts), lambda t: crosses(s, t)))
    return F.coalesce((F.size(rings) > 0) & F.forall(rings, ring), F.lit(False))


def repaired(rings: Column) -> Column:
    """Without rings of no area and without doubled points; null if no outer ring is left. Not a full repair: crossing rings stay
    and `is_valid` still tells them."""
    single = F.transform(rings, lambda r: F.struct(r.hole.alias("hole"), F.filter(r.pts, lambda p, i: (i == 0) | (p != F.element_at(r.pts, F.greatest(i, F.lit(1))))).alias("pts")))
    kept = F.filter(single, lambda r: (F.size(r.pts) >= 4) & (ring_area(r.pts) != 0))
    return F.when(F.exists(kept, lambda r: ~r.hole), kept)


def structure(rings: Column) -> Column:
    return F.transform(rings, lambda r: F.size(r.pts))


def grid_digest(rings: Column, step: float = 1e-7) -> Column:
    """A hash of the structure and the points snapped to a grid."""
    snapped = F.transform(rings, lambda r: F.transform(r.pts, lambda p: F.struct(F.round(p.x / step).cast("long").alias("x"), F.round(p.y / step).cast("long").alias("y"))))
    return F.xxhash64(F.to_json(snapped))


def largest_shift(a: Column, b: Column) -> Column:
    """Metres of the largest shift between paired points, null where the structures differ."""
    from .metric import vertex_shift

    pts = lambda r: F.flatten(F.transform(r, lambda x: x.pts))
    moved = F.array_max(F.zip_with(pts(a), pts(b), lambda p, q: vertex_shift(p.x, p.y, q.x, q.y)))
    return F.when(structure(a).eqNullSafe(structure(b)), moved)


def moved(a: Column, b: Column, metres: float) -> Column:
    """Whether the structure differs or a point moved at least so far; never null."""
    return F.when(a.isNull() | b.isNull(), a.isNull() != b.isNull()).otherwise(~structure(a).eqNullSafe(structure(b)) | F.coalesce(largest_shift(a, b) >= metres, F.lit(False)))


def edges(df: DataFrame, keys: list[str], rings: str = "rings") -> DataFrame:
    """keys, x1, y1, x2, y2, a row per side of every ring."""
    sides = F.flatten(F.transform(F.col(rings), lambda r: _sides(r.pts)))
    return df.select(*keys, F.explode(sides).alias("_s")).select(*keys, F.col("_s.p.x").alias("x1"), F.col("_s.p.y").alias("y1"), F.col("_s.q.x").alias("x2"), F.col("_s.q.y").alias("y2"))


def _sloped(df: DataFrame, tag: str) -> DataFrame:
    """Non-vertical sides as left to right lines with a sign: +1 where the interior is below."""
    left = F.col("x1") < F.col("x2")
    return df.filter("x1 <> x2").select(
        *(c for c in df.columns if c not in ("x1", "y1", "x2", "y2")), F.when(left, F.lit(-1.0)).otherwise(F.lit(1.0)).alias(f"s{tag}"), F.least("x1", "x2").alias(f"l{tag}"), F.greatest("x1", "x2").alias(f"r{tag}"),
        F.when(left, F.col("y1")).otherwise(F.col("y2")).alias(f"b{tag}"), ((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))).alias(f"m{tag}"),
    )


def overlap_areas(pairs: DataFrame, a: DataFrame, b: DataFrame, a_key: str, b_key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """a_key, b_key, carry (other columns of pairs), overlap: area of the intersection of each pair of oriented polygons.

    The area is the sum over pairs of sides with common x range of sign * sign * integral of the lower of the two lines
    above a base below both polygons; a polygon's sides sum to its own area in the same way. pairs: a_key, b_key, base.
    """
    ea, eb = _sloped(edges(a, [a_key]), "a"), _sloped(edges(b, [b_key]), "b")
    both = pairs.join(ea, a_key).join(eb, b_key).withColumn("_l", F.greatest("la", "lb")).withColumn("_r", F.least("ra", "rb")).filter("_l < _r")
    f = lambda x: F.col("ba") - F.col("base") + F.col("ma") * (x - F.col("la"))
    g = lambda x: F.col("bb") - F.col("base") + F.col("mb") * (x - F.col("lb"))
    l, r = F.col("_l"), F.col("_r")
    cut = l + (r - l) * (g(l) - f(l)) / ((g(l) - f(l)) - (g(r) - f(r)))  # where the lines meet
    trapeze = lambda u, v, hu, hv: (v - u) * (hu + hv) / F.lit(2.0)
    low = lambda x: F.least(f(x), g(x))
    piece = F.when((g(l) - f(l)) * (g(r) - f(r)) < 0, trapeze(l, cut, low(l), f(cut)) + trapeze(cut, r, f(cut), low(r))).otherwise(trapeze(l, r, low(l), low(r)))
    return both.groupBy(a_key, b_key, *carry).agg(F.sum(F.col("sa") * F.col("sb") * piece).alias("overlap"))


def lines(rings: Column) -> Column:
    """The non-vertical sides of oriented rings as left to right lines from l to r: b, the height at l, m, the slope, and s, +1 where the interior is below."""
    every = F.filter(F.flatten(F.transform(rings, lambda r: _sides(r.pts))), lambda s: s.p.x != s.q.x)
    line = lambda s, p, q, sign: F.struct(F.lit(sign).alias("s"), p.x.alias("l"), q.x.alias("r"), p.y.alias("b"), ((q.y - p.y) / (q.x - p.x)).alias("m"))
    return F.transform(every, lambda s: F.when(s.p.x < s.q.x, line(s, s.p, s.q, -1.0)).otherwise(line(s, s.q, s.p, 1.0)))


def overlap(a: Column, b: Column, base: Column) -> Column:
    """The area of the intersection of two polygons, as `overlap_areas` has it, of their `lines` and a height below both: for pairs that are rows
    with their shapes, so that no table of sides is shuffled."""

    def piece(s, t, l, r):  # noqa: E741
        at = lambda line, x: line.b - base + line.m * (x - line.l)
        ends = F.struct(at(s, l).alias("f"), at(t, l).alias("g"), at(s, r).alias("u"), at(t, r).alias("v"))
        trapeze = lambda p, q, hp, hq: (q - p) * (hp + hq) / F.lit(2.0)
        whole = lambda e: trapeze(l, r, F.least(e.f, e.g), F.least(e.u, e.v))
        parted = lambda e: _once(l + (r - l) * (e.g - e.f) / ((e.g - e.f) - (e.v - e.u)), lambda x: trapeze(l, x, F.least(e.f, e.g), at(s, x)) + trapeze(x, r, at(s, x), F.least(e.u, e.v)))
        return s.s * t.s * _once(ends, lambda e: F.when((e.g - e.f) * (e.v - e.u) < 0, parted(e)).otherwise(whole(e)))

    def common(s, t):
        low, high = F.greatest(s.l, t.l), F.least(s.r, t.r)
        return F.when(low < high, _once(F.struct(low.alias("l"), high.alias("r")), lambda x: piece(s, t, x.l, x.r))).otherwise(F.lit(0.0))

    return F.aggregate(a, F.lit(0.0), lambda n, s: n + F.aggregate(b, F.lit(0.0), lambda k, t: k + common(s, t)))


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once: a name in a lambda stands for it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def touching(a: Column, b: Column) -> Column:
    """Whether two polygons meet, touching included: sides that cross or touch, or one inside the other. Only sides that reach into the other's
    box are compared with each other."""
    side = lambda p, q, c: F.signum((q.x - p.x) * (c.y - p.y) - (q.y - p.y) * (c.x - p.x))
    within = lambda p, q, c: c.x.between(F.least(p.x, q.x), F.greatest(p.x, q.x)) & c.y.between(F.least(p.y, q.y), F.greatest(p.y, q.y))

    def meets(s, t):
        turns = F.struct(side(s.p, s.q, t.p).alias("a"), side(s.p, s.q, t.q).alias("b"), side(t.p, t.q, s.p).alias("c"), side(t.p, t.q, s.q).alias("d"))
        on = lambda d: ((d.a == 0) & within(s.p, s.q, t.p)) | ((d.b == 0) & within(s.p, s.q, t.q)) | ((d.c == 0) & within(t.p, t.q, s.p)) | ((d.d == 0) & within(t.p, t.q, s.q))
        apart = (F.greatest(s.p.x, s.q.x) < F.least(t.p.x, t.q.x)) | (F.greatest(t.p.x, t.q.x) < F.least(s.p.x, s.q.x)) | (F.greatest(s.p.y, s.q.y) < F.least(t.p.y, t.q.y)) | (F.greatest(t.p.y, t.q.y) < F.least(s.p.y, s.q.y))
        return ~apart & F.exists(F.array(turns), lambda d: ((d.a * d.b < 0) & (d.c * d.d < 0)) | on(d))

    def near(rings: Column, o: Column) -> Column:
        reach = lambda s: (F.greatest(s.p.x, s.q.x) >= o.x0) & (F.least(s.p.x, s.q.x) <= o.x1) & (F.greatest(s.p.y, s.q.y) >= o.y0) & (F.least(s.p.y, s.q.y) <= o.y1)
        return F.flatten(F.transform(rings, lambda r: F.filter(_sides(r.pts), reach)))

    first = lambda r: F.element_at(F.element_at(r, 1).pts, 1)
    meet = _once(F.struct(bbox(a).alias("a"), bbox(b).alias("b")), lambda o: _once(F.struct(near(a, o.b).alias("s"), near(b, o.a).alias("t")), lambda n: F.exists(n.s, lambda s: F.exists(n.t, lambda t: meets(s, t)))))
    return meet | contains(a, first(b).x, first(b).y) | contains(b, first(a).x, first(a).y)
