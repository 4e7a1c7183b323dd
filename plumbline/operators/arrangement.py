"""Polygons from rings that cross, touch or lie in any order: sides are cut where they meet, kept where one side of them is inside
and the other is not, and stitched into rings.

Everything is joins over a table of sides: key, ring (a number), inner (whether the ring is a hole), x1, y1, x2, y2. Sides of one
key meet on slabs of their x range, as many as the key has sides, so a key's sides are not compared each with each; of two sides
that share several slabs the pair is taken in the first. What is inside is asked at the middle of each piece, of every ring by
the number of pieces above it (even-odd), so that the direction of a ring does not matter. Stitching doubles pointers from each piece to
the next, in as many rounds as the longest ring has bits; each round is a written table.

Rules: `union` is inside some outer ring and no inner one; `even_odd` is inside an odd number of rings. Sides without length and rings
without area vanish; a key without area has no row. A hole that touches its outer ring in one point becomes part of that ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import polygon
from ..sources.scratch import large, written

XY = ["x1", "y1", "x2", "y2"]


def sides(df: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """key, ring, inner and a side a row of polygons."""
    each = df.select(F.col(key).alias("key"), F.posexplode(rings).alias("ring", "_r")).select("key", "ring", F.col("_r.hole").alias("inner"), F.explode(polygon._sides(F.col("_r.pts"))).alias("_s"))
    return each.select("key", "ring", "inner", F.col("_s.p.x").alias("x1"), F.col("_s.p.y").alias("y1"), F.col("_s.q.x").alias("x2"), F.col("_s.q.y").alias("y2"))


def in_slabs(df: DataFrame, frame: DataFrame, low: Column, high: Column) -> DataFrame:
    """df with slab, a row for each slab of its key that low to high meets, and first, the slab of low. frame: key, _x0, _w."""
    at = lambda x: F.floor((x - F.col("_x0")) / F.col("_w")).cast("long")
    both = df.join(frame, "key").withColumn("first", at(low))
    return both.withColumn("slab", F.explode(F.sequence(F.col("first"), at(high)))).drop("_x0", "_w")


def slab_frame(edges: DataFrame) -> DataFrame:
    """key, _x0, _w: where a key's slabs start and how wide they are: as many as it has sides."""
    one = edges.groupBy("key").agg(F.min(F.least("x1", "x2")).alias("_x0"), F.max(F.greatest("x1", "x2")).alias("_x1"), F.count("*").alias("_n"))
    return one.select("key", "_x0", F.when(F.col("_x1") > F.col("_x0"), (F.col("_x1") - F.col("_x0")) / F.col("_n")).otherwise(F.lit(1.0)).alias("_w"))


def _turn(a: str, b: str, c: str) -> Column:
    """On which side of a to b lies c; names of struct columns x, y."""
    x, y = (lambda p: F.col(f"{p}.x")), (lambda p: F.col(f"{p}.y"))
    return (x(b) - x(a)) * (y(c) - y(a)) - (y(b) - y(a)) * (x(c) - x(a))


def _pairs(edges: DataFrame, frame: DataFrame) -> DataFrame:
    """key, id, p, q, _id, s, t, a, b, c, d: pairs of a key's sides whose boxes meet, and on which side of the one the other's ends lie."""
    p, q = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    own = in_slabs(edges.select("key", "id", *XY), frame, F.least("x1", "x2"), F.greatest("x1", "x2")).select("key", "slab", "first", "id", p.alias("p"), q.alias("q"))
    other = own.select("key", "slab", F.col("first").alias("_first"), F.col("id").alias("_id"), F.col("p").alias("s"), F.col("q").alias("t"))
    pair = own.join(other, ["key", "slab"]).filter("id < _id AND slab = greatest(first, _first)")
    pair = pair.filter(F.greatest("p.y", "q.y") >= F.least("s.y", "t.y")).filter(F.greatest("s.y", "t.y") >= F.least("p.y", "q.y"))
    pair = pair.select("*", _turn("p", "q", "s").alias("a"), _turn("p", "q", "t").alias("b"), _turn("s", "t", "p").alias("c"), _turn("s", "t", "q").alias("d"))
    return pair


def meetings(edges: DataFrame, frame: DataFrame) -> DataFrame:
    """key, id, x, y: points inside a side (not its ends) at which another side of the key crosses it or ends on it. edges: with id."""
    pair = _pairs(edges, frame)
    share = F.col("c") / (F.col("c") - F.col("d"))
    x, y = F.col("p.x") + (F.col("q.x") - F.col("p.x")) * share, F.col("p.y") + (F.col("q.y") - F.col("p.y")) * share
    at = F.struct(x.alias("x"), y.alias("y"))
    crossing = (F.col("a") * F.col("b") < 0) & (F.col("c") * F.col("d") < 0)

    def ends(which: str, lo: str, hi: str, turn: str) -> Column:  # an end on the inside of the other side
        w, l, h = F.col(which), F.col(lo), F.col(hi)
        return (F.col(turn) == 0) & w.x.between(F.least(l.x, h.x), F.greatest(l.x, h.x)) & w.y.between(F.least(l.y, h.y), F.greatest(l.y, h.y)) & (w != l) & (w != h)

    cut = lambda who, when, where: F.when(when, F.struct(F.col(who).alias("id"), where.alias("at")))
    cuts = [cut("id", crossing, at), cut("_id", crossing, at), cut("id", ends("s", "p", "q", "a"), F.col("s")), cut("id", ends("t", "p", "q", "b"), F.col("t")), cut("_id", ends("p", "s", "t", "c"), F.col("p")), cut("_id", ends("q", "s", "t", "d"), F.col("q"))]
    return pair.select("key", F.explode(F.array_compact(F.array(*cuts))).alias("_c")).select("key", "_c.id", "_c.at.x", "_c.at.y").distinct()


def pieces(edges: DataFrame) -> DataFrame:
    """key, x1, y1, x2, y2, rings: each distinct piece of a side, from its lower end (by x, then y), with how often each ring has it."""
    numbered = written(edges.filter("x1 <> x2 OR y1 <> y2").withColumn("id", F.monotonically_increasing_id()), "sides")
    met = meetings(numbered, slab_frame(numbered)).groupBy("key", "id").agg(F.collect_list(F.struct("x", "y")).alias("_cuts"))
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    both = numbered.join(met, ["key", "id"], "left")
    whole = F.array_sort(F.array_distinct(F.concat(F.array(point("x1", "y1"), point("x2", "y2")), F.coalesce("_cuts", F.array().cast("array<struct<x:double,y:double>>")))))
    each = both.select("key", "ring", "inner", F.explode(polygon._sides(whole)).alias("_s"))
    counted = each.groupBy("key", F.col("_s.p.x").alias("x1"), F.col("_s.p.y").alias("y1"), F.col("_s.q.x").alias("x2"), F.col("_s.q.y").alias("y2"), "ring", "inner").agg(F.count("*").alias("n")).filter("n % 2 = 1")
    return counted.groupBy("key", *XY).agg(F.collect_list(F.struct("ring", "inner")).alias("rings"))


def boundary(cut: DataFrame, rule: str = "union") -> DataFrame:
    """key, x1, y1, x2, y2: the pieces that part inside from outside, directed so that the inside is to the left."""
    cut = written(cut, "pieces")
    frame = slab_frame(cut)
    middle = F.struct(((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    asked = in_slabs(cut.select("key", *XY, "rings", middle.alias("m")), frame, F.col("m.x"), F.col("m.x")).drop("first")
    others = in_slabs(cut.filter("x1 < x2").select("key", *XY, "rings"), frame, F.col("x1"), F.col("x2")).drop("first").withColumnsRenamed({c: f"_{c}" for c in (*XY, "rings")})
    height = F.col("_y1") + (F.col("_y2") - F.col("_y1")) * ((F.col("m.x") - F.col("_x1")) / (F.col("_x2") - F.col("_x1")))
    above = (F.col("m.x") >= F.col("_x1")) & (F.col("m.x") <= F.col("_x2")) & (height > F.col("m.y")) & ~((F.col("x1") == F.col("_x1")) & (F.col("y1") == F.col("_y1")) & (F.col("x2") == F.col("_x2")) & (F.col("y2") == F.col("_y2")))
    # a ray up just right of the middle, and one just left of it: they differ where sides end at the middle's x only
    hit = asked.join(others, ["key", "slab"], "left").select("key", *XY, "rings", F.when(F.coalesce(above, F.lit(False)), F.struct((F.col("m.x") < F.col("_x2")).alias("right"), (F.col("m.x") > F.col("_x1")).alias("left"), F.col("_rings").alias("rings"))).alias("_h"))
    each = hit.select("key", *XY, "rings", F.explode_outer(F.transform("_h.rings", lambda r: F.struct(r.ring.alias("ring"), r.inner.alias("inner"), F.col("_h.right").alias("right"), F.col("_h.left").alias("left")))).alias("_o"))
    place = ["key", *XY]
    counts = each.groupBy(*place, F.col("_o.ring").alias("ring"), F.col("_o.inner").alias("inner")).agg(F.first("rings").alias("rings"), (F.count_if("_o.right") % 2).alias("right"), (F.count_if("_o.left") % 2).alias("left"))
    rings = counts.groupBy(*place).agg(F.first("rings").alias("rings"), F.collect_list(F.struct("ring", "inner", (F.col("right") == 1).alias("right"), (F.col("left") == 1).alias("left"))).alias("_c"))
    upright = F.col("x1") == F.col("x2")
    own, counted = F.col("rings"), F.filter("_c", lambda c: c.ring.isNotNull())
    has = lambda ring: F.exists(own, lambda r: r.ring == ring)
    every = F.concat(
        F.transform(counted, lambda c: F.struct(c.inner.alias("inner"), c.right.alias("one"), F.when(upright, c.left).otherwise(c.right != has(c.ring)).alias("two"))),
        F.when(~upright, F.transform(F.filter(own, lambda r: ~F.exists(counted, lambda c: c.ring == r.ring)), lambda r: F.struct(r.inner.alias("inner"), F.lit(False).alias("one"), F.lit(True).alias("two")))).otherwise(F.array().cast("array<struct<inner:boolean,one:boolean,two:boolean>>")),
    )  # one: above, or right of an upright piece; two: below, or left of it
    inside = {
        "union": lambda v, side: F.exists(v, lambda c: ~c.inner & c[side]) & ~F.exists(v, lambda c: c.inner & c[side]),
        "even_odd": lambda v, side: F.size(F.filter(v, lambda c: c[side])) % 2 == 1,
    }[rule]
    told = rings.withColumn("_v", every).select(*place, inside(F.col("_v"), "one").alias("one"), inside(F.col("_v"), "two").alias("two")).filter("one <> two")
    # from the lower end: the left is above, or the left of an upright piece
    ahead = F.when(upright, F.col("two")).otherwise(F.col("one"))
    turn = lambda a, b: F.when(ahead, F.col(a)).otherwise(F.col(b)).alias(a)
    return told.select("key", turn("x1", "x2"), turn("y1", "y2"), turn("x2", "x1"), turn("y2", "y1"))


def stitched(edges: DataFrame) -> DataFrame:
    """key, rings of directed sides (x1, y1 to x2, y2) whose inside is to the left: at a point where several leave, the leftmost is taken."""
    named = written(edges.withColumn("e", F.xxhash64("x1", "y1", "x2", "y2")), "boundary")
    angle = lambda x, y: F.atan2(y, x)
    back = named.select("key", "e", F.col("x2").alias("x"), F.col("y2").alias("y"), angle(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")).alias("_a"))
    out = named.select("key", F.col("e").alias("_e"), F.col("x1").alias("x"), F.col("y1").alias("y"), angle(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("_b"))
    turned = F.pmod(F.col("_a") - F.col("_b"), F.lit(6.283185307179586))
    turned = F.when(turned == 0, F.lit(6.283185307179586)).otherwise(turned)
    follow = back.join(out, ["key", "x", "y"]).groupBy("key", "e").agg(F.min_by("_e", turned).alias("to"))
    # after k rounds: the piece 2**k further on, the smallest name of these 2**k pieces and how far ahead it is
    now = written(follow.select("key", "e", "to", F.col("e").alias("low"), F.lit(0).cast("long").alias("far")), "rings")
    longest = now.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    step = 1
    while step < longest:
        then = now.select("key", F.col("e").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"), (F.col("far") + step).alias("_far"))
        sooner = F.col("low") <= F.col("_low")
        now = written(now.join(then, ["key", "to"]).select("key", "e", F.col("_to").alias("to"), F.least("low", "_low").alias("low"), F.when(sooner, F.col("far")).otherwise(F.col("_far")).alias("far")), "rings")
        step *= 2
    ordered = F.array_sort(F.collect_list(F.struct(F.when(F.col("far") == 0, F.lit(0)).otherwise(-F.col("far")).alias("o"), F.col("x1").alias("x"), F.col("y1").alias("y"))))
    # the smallest name comes first (0), then the rest from the farthest to the nearest before it
    ring = named.join(now.select("key", "e", "low", "far"), ["key", "e"]).groupBy("key", "low").agg(ordered.alias("_p"))
    first = F.element_at("_p", -1)
    pts = F.transform(F.concat(F.array(first), F.slice("_p", 1, F.size("_p") - 1), F.array(first)), lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))
    shaped = ring.select("key", "low", pts.alias("pts")).filter(F.size("pts") >= 4).withColumn("_a", polygon.ring_area(F.col("pts"))).filter("_a <> 0")
    return shaped.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((F.col("_a") < 0).alias("hole"), "pts"))).alias("rings")).filter(F.exists("rings", lambda r: ~r.hole))


def shaped(edges: DataFrame, rule: str = "union") -> DataFrame:
    """key, rings: the polygon of each key's sides."""
    edges = written(edges, "edges")
    if edges.isEmpty():
        return edges.select("key", F.lit(None).cast(polygon.TYPE).alias("rings"))
    return stitched(boundary(pieces(edges), rule))


def invalid(df: DataFrame, key: str, rings: str = "rings", small: int = 64) -> DataFrame:
    """key, rings of the polygons (one a key) that are not valid, as `polygon.is_valid` has it. Polygons of up to `small` points are judged row by
    row, larger ones by joining their sides on slabs of x."""
    points = F.aggregate(F.transform(rings, lambda r: F.size(r.pts)), F.lit(0), lambda a, n: a + n)
    own = df.filter(F.col(rings).isNotNull()).select(key, rings)
    few = own.filter(points <= small).filter(~polygon.is_valid(F.col(rings)))
    many = written(own.filter(points > small), "large")
    if many.isEmpty():
        return few
    sound = F.forall(rings, lambda r: (F.size(r.pts) >= 4) & (F.element_at(r.pts, 1) == F.element_at(r.pts, -1)) & (polygon.ring_area(r.pts) != 0))
    broken = many.filter(~F.coalesce(sound, F.lit(False))).select(key)
    each = written(sides(many.join(broken, key, "left_anti"), key, rings).select(F.struct("key", "ring").alias("key"), F.monotonically_increasing_id().alias("id"), *XY), "sides")
    crossed = _pairs(each, slab_frame(each)).filter("a * b < 0 AND c * d < 0").select(F.col("key.key").alias(key))
    return few.unionByName(many.join(broken.union(crossed).distinct(), key, "left_semi"))


def repaired(df: DataFrame, key: str, rings: str = "rings") -> tuple[DataFrame, DataFrame]:
    """df (one row a key) with invalid polygons made valid by the even-odd rule, those without area left out, and counts: checked, repaired,
    dropped. Rows without a polygon stay."""
    broken = written(invalid(df, key, rings), "broken")
    if broken.isEmpty():
        return df, df.agg(F.count("*").alias("checked"), F.lit(0).cast("long").alias("repaired"), F.lit(0).cast("long").alias("dropped"))
    fixed = written(shaped(sides(broken, key, rings), "even_odd").select(F.col("key").alias(key), F.col("rings").alias("_fixed"), F.lit(True).alias("_new")), "fixed")
    marked = df.join(large(broken.select(key, F.lit(True).alias("_broken"))), key, "left").join(large(fixed), key, "left")
    out = marked.filter("_broken IS NULL OR _new").withColumn(rings, F.coalesce("_fixed", rings)).select(*df.columns)
    counts = marked.agg(F.count("*").alias("checked"), F.count_if(F.expr("_broken AND _new")).alias("repaired"), F.count_if(F.expr("_broken AND _new IS NULL")).alias("dropped"))
    return out, counts
