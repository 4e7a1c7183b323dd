"""The map's element graph: geometry of ways and relations, and its change files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import polygon, text
from .scratch import large


def way_points(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """way, pts, n, complete: a way's points in order; with a missing node, or below two nodes, pts is null."""
    placed = ways.join(nodes, "node", "left")
    out = placed.groupBy("way").agg(F.count("*").alias("n"), F.count("lon").alias("_found"), F.sort_array(F.collect_list(F.struct("ord", "lon", "lat"))).alias("_p"))
    complete = (F.col("n") == F.col("_found")) & (F.col("n") >= 2)
    pts = F.transform("_p", lambda p: F.struct(p.lon.alias("x"), p.lat.alias("y")))
    return out.select("way", F.when(complete, pts).alias("pts"), F.col("n").cast("long").alias("n"), complete.alias("complete"))


def line_centroid(pts):
    """Length-weighted middle of a line."""
    pairs = polygon._sides(pts)
    length = lambda s: F.sqrt((s.q.x - s.p.x) * (s.q.x - s.p.x) + (s.q.y - s.p.y) * (s.q.y - s.p.y))
    whole = polygon._sum(F.transform(pairs, length))
    mean = lambda axis: polygon._sum(F.transform(pairs, lambda s: length(s) * (s.p[axis] + s.q[axis]) / F.lit(2.0))) / whole
    first = F.element_at(pts, 1)
    return F.when(whole > 0, F.struct(mean("x").alias("x"), mean("y").alias("y"))).otherwise(F.struct(first.x.alias("x"), first.y.alias("y")))


ADDRESS = ["osm_type", "osm_id", "housenumber", "street", "city", "postcode", "lon", "lat"]


def _address(kind: str, osm_id: Column, tags: Column, lon: Column, lat: Column) -> list[Column]:
    tag = lambda k: F.element_at(tags, k)
    values = [F.lit(kind), osm_id, tag("addr:housenumber"), tag("addr:street"), text.city_of(tags), tag("addr:postcode"), lon, lat]
    return [v.alias(n) for v, n in zip(values, ADDRESS, strict=True)]


def address_nodes(elements: DataFrame) -> DataFrame:
    """osm_type, osm_id, housenumber, street, city, postcode, lon, lat of nodes with a house number and a place."""
    rows = elements.filter((F.col("kind") == "node") & F.element_at("tags", "addr:housenumber").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    return rows.select(*_address("node", F.col("id"), F.col("tags"), F.col("lon"), F.col("lat")))


def points_of(elements: DataFrame) -> DataFrame:
    """way, pts, n, complete of the ways among elements. The readers below take it as `points` where it is known, so that it is made once."""
    refs = elements.filter("kind = 'way'").select(F.col("id").alias("way"), F.posexplode("refs").alias("ord", "node"))
    return way_points(refs, large(elements.filter("kind = 'node'").select(F.col("id").alias("node"), "lon", "lat")))


def _ways_of(elements: DataFrame, points: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    return elements.filter("kind = 'way'"), large(points_of(elements) if points is None else points)


def way_addresses(elements: DataFrame, points: DataFrame | None = None) -> DataFrame:
    ways, points = _ways_of(elements.filter("kind <> 'relation'"), points)
    rows = ways.filter(F.element_at("tags", "addr:housenumber").isNotNull()).join(points.filter("complete"), F.col("id") == F.col("way"))
    c = line_centroid(F.col("pts"))
    return rows.select(*_address("way", F.col("id"), F.col("tags"), c.x, c.y))


def _closed(pts):
    return (F.size(pts) >= 4) & (F.element_at(pts, 1) == F.element_at(pts, -1))


def _chosen(rows: DataFrame, former: bool) -> tuple[DataFrame, list[Column]]:
    """Rows with a building, or with a life-cycle key and none, and the columns that say which."""
    key = text.lifecycle_key(F.col("tags"))
    if former:
        return rows.filter(key.isNotNull()), [key.alias("lifecycle"), F.element_at("tags", key).alias("lifecycle_value")]
    return rows.filter(F.element_at("tags", "building").isNotNull()), [F.element_at("tags", "building").alias("building")]


def way_buildings(elements: DataFrame, former: bool = False, points: DataFrame | None = None) -> DataFrame:
    """osm_type, osm_id, rings, building (or lifecycle, lifecycle_value): closed ways with a building, or with a life-cycle key and none."""
    ways, points = _ways_of(elements.filter("kind <> 'relation'"), points)
    chosen, told = _chosen(ways, former)
    rows = chosen.join(points.filter("complete"), F.col("id") == F.col("way")).filter(_closed(F.col("pts")))
    rings = polygon.oriented(F.array(F.struct(F.lit(False).alias("hole"), F.col("pts"))))
    return rows.select(F.lit("way").alias("osm_type"), F.col("id").alias("osm_id"), rings.alias("rings"), *told)


MEMBERS = "array<struct<type:string,ref:bigint,role:string>>"


def _members(relations: DataFrame) -> DataFrame:
    """rel, ord, way, role of the ways among each relation's members; from `members`, or refs, ref_types and ref_roles."""
    if "members" in relations.columns:
        m = F.col("members")
    else:
        m = F.transform(F.arrays_zip("refs", "ref_types", "ref_roles"), lambda x: F.struct(x.ref_types.alias("type"), x.refs.alias("ref"), x.ref_roles.alias("role")))
    each = relations.select(F.col("id").alias("rel"), F.posexplode(m).alias("ord", "m")).filter("m.type = 'way'")
    return each.select("rel", "ord", F.col("m.ref").alias("way"), text.member_role(F.col("m.role")).alias("role"))


def unresolved_relations(relations: DataFrame, points: DataFrame) -> DataFrame:
    """rel, ways: relations with member ways that are missing or lack a node, and these ways."""
    return _members(relations).join(points.filter("complete"), "way", "left_anti").groupBy("rel").agg(F.sort_array(F.collect_set("way")).alias("ways"))


def relation_buildings(elements: DataFrame, former: bool = False, strict: bool = False, points: DataFrame | None = None) -> DataFrame:
    """osm_type, osm_id, rings, building (or lifecycle, lifecycle_value), doubtful: the union of the closed outer ways without that of the
    closed inner ones. Ways that are open, missing or lack a node are left out; `doubtful` tells so. strict: a relation with a member way that
    is missing or lacks a node has no row, as in the upkeep of the map."""
    from ..operators import arrangement

    _, points = _ways_of(elements.filter("kind <> 'relation'"), points)
    chosen, told = _chosen(elements.filter("kind = 'relation'"), former)
    if strict:
        chosen = chosen.join(large(unresolved_relations(chosen, points).select(F.col("rel").alias("id"))), "id", "left_anti")
    own = _members(chosen).filter("role <> 'other'").join(points, "way", "left").withColumn("_ok", F.coalesce(F.col("complete") & _closed(F.col("pts")), F.lit(False)))
    ring = F.struct("ord", F.struct((F.col("role") == "inner").alias("hole"), F.col("pts")).alias("r"))
    rows = own.groupBy("rel").agg(F.sort_array(F.collect_list(F.when(F.col("_ok"), ring))).alias("_r"), F.bool_or(~F.col("_ok")).alias("doubtful"), F.count_if(F.col("_ok") & (F.col("role") == "outer")).alias("_o")).filter("_o > 0")
    rows = rows.select("rel", polygon.oriented(F.transform("_r", lambda x: x.r)).alias("rings"), "doubtful")
    plain = rows.filter((F.size("rings") == 1) & polygon.is_valid(F.col("rings")))
    others = rows.join(large(plain.select("rel")), "rel", "left_anti")
    several = arrangement.shaped(arrangement.sides(others, "rel")).select(F.col("key").alias("rel"), "rings").join(large(others.select("rel", "doubtful")), "rel")
    shapes = plain.unionByName(several)
    return shapes.join(large(chosen.select(F.col("id").alias("rel"), *told)), "rel").select(F.lit("relation").alias("osm_type"), F.col("rel").alias("osm_id"), "rings", *(c for c in ("building", "lifecycle", "lifecycle_value") if c in [x for x in chosen.select(*told).columns]), "doubtful")


def relation_addresses(elements: DataFrame, strict: bool = False, points: DataFrame | None = None) -> DataFrame:
    """Addresses of relations with a house number: the length-weighted middle of all member ways that are whole (strict: only where all are)."""
    _, points = _ways_of(elements.filter("kind <> 'relation'"), points)
    chosen = elements.filter((F.col("kind") == "relation") & F.element_at("tags", "addr:housenumber").isNotNull())
    if strict:
        chosen = chosen.join(large(unresolved_relations(chosen, points).select(F.col("rel").alias("id"))), "id", "left_anti")
    lines = _members(chosen).join(points.filter("complete"), "way").select("rel", F.explode(polygon._sides(F.col("pts"))).alias("s"), F.element_at("pts", 1).alias("p"))
    dx, dy = F.col("s.q.x") - F.col("s.p.x"), F.col("s.q.y") - F.col("s.p.y")
    length = F.sqrt(dx * dx + dy * dy)
    middle = lines.select("rel", length.alias("l"), ((F.col("s.p.x") + F.col("s.q.x")) / 2).alias("x"), ((F.col("s.p.y") + F.col("s.q.y")) / 2).alias("y"))
    sums = middle.groupBy("rel").agg(F.sum("l").alias("l"), F.sum(F.col("l") * F.col("x")).alias("x"), F.sum(F.col("l") * F.col("y")).alias("y"), F.avg("x").alias("ax"), F.avg("y").alias("ay"))
    at = lambda c: F.when(F.col("l") > 0, F.col(c) / F.col("l")).otherwise(F.col(f"a{c}"))
    rows = chosen.join(large(sums.select(F.col("rel").alias("id"), at("x").alias("_x"), at("y").alias("_y"))), "id")
    return rows.select(*_address("relation", F.col("id"), F.col("tags"), F.col("_x"), F.col("_y")))


PROBLEMS = ["not found", "no ways", "missing ways", "open rings", "missing nodes", "no area"]


def relation_areas(asked: DataFrame, elements: DataFrame, named: int = 10) -> DataFrame:
    """rel, problem, ids, n_ids, message, rings, x0, y0, x1, y1 for every asked relation (rel): the area between its distinct outer and inner
    ways, holes by nesting, or the first of PROBLEMS that stands in the way, with the first ids that cause it."""
    from ..operators import arrangement
    from .scratch import written

    asked = asked.select("rel").distinct()
    found = elements.filter("kind = 'relation'").join(asked.select(F.col("rel").alias("id")), "id", "left_semi")
    members = written(_members(found).filter("role <> 'other'").select("rel", "way").distinct(), "members")
    ways = elements.filter("kind = 'way'").select(F.col("id").alias("way"), "refs")
    joined = written(members.join(ways, "way", "left"), "member-ways")
    lines = joined.filter(F.size("refs") >= 2)
    ends = open_ends(lines.select("rel", F.element_at("refs", 1).alias("first"), F.element_at("refs", -1).alias("last")))
    nodes = elements.filter("kind = 'node'").select(F.col("id").alias("node"), "lon", "lat")
    placed = written(lines.select("rel", "way", F.posexplode("refs").alias("ord", "node")).join(nodes, "node", "left"), "member-nodes")
    causes = [("missing ways", joined.filter("refs IS NULL").select("rel", F.col("way").alias("id"))), ("open rings", ends.select("rel", F.col("node").alias("id"))), ("missing nodes", placed.filter("lon IS NULL OR lat IS NULL").select("rel", F.col("node").alias("id")))]
    every = None
    for rank, (_, rows) in enumerate(causes):
        one = rows.distinct().groupBy("rel").agg(F.slice(F.sort_array(F.collect_list("id")), 1, named).alias("ids"), F.count("*").alias("n_ids")).withColumn("_rank", F.lit(rank))
        every = one if every is None else every.unionByName(one)
    worst = every.groupBy("rel").agg(F.min_by(F.struct("_rank", "ids", "n_ids"), "_rank").alias("_w"))
    points = placed.groupBy("rel", "way").agg(F.sort_array(F.collect_list(F.struct("ord", "lon", "lat"))).alias("_p")).join(worst, "rel", "left_anti")
    pts = F.transform("_p", lambda p: F.struct(p.lon.alias("x"), p.lat.alias("y")))
    edges = points.select(F.col("rel").alias("key"), F.explode(polygon._sides(pts)).alias("_s")).select("key", F.lit(0).alias("ring"), F.lit(False).alias("inner"), F.col("_s.p.x").alias("x1"), F.col("_s.p.y").alias("y1"), F.col("_s.q.x").alias("x2"), F.col("_s.q.y").alias("y2"))
    shapes = arrangement.shaped(edges, "even_odd").select(F.col("key").alias("rel"), "rings")
    there = found.select(F.col("id").alias("rel"), F.lit(True).alias("_there"))
    drawn = members.select("rel").distinct().withColumn("_drawn", F.lit(True))
    both = asked.join(there, "rel", "left").join(drawn, "rel", "left").join(worst, "rel", "left").join(shapes, "rel", "left")
    named_causes = F.element_at(F.array(*(F.lit(c) for c, _ in causes)), F.col("_w._rank") + 1)
    problem = F.when(F.col("_there").isNull(), "not found").when(F.col("_drawn").isNull(), "no ways").when(F.col("_w").isNotNull(), named_causes).when(F.col("rings").isNull(), "no area")
    out = both.select("rel", problem.alias("problem"), F.col("_w.ids").alias("ids"), F.coalesce("_w.n_ids", F.lit(0).cast("long")).alias("n_ids"), "rings")
    kind = F.when(F.col("problem") == "missing ways", "way/").otherwise("node/")
    listed = F.concat(F.array_join(F.transform("ids", lambda i: F.concat(kind, i.cast("string"))), ", "), F.when(F.col("n_ids") > named, F.concat(F.lit(" and "), (F.col("n_ids") - named).cast("string"), F.lit(" more"))).otherwise(""))
    message = F.when(F.col("problem").isNotNull(), F.concat(F.lit("relation "), F.col("rel").cast("string"), F.lit(": "), F.col("problem"), F.when(F.col("n_ids") > 0, F.concat(F.lit(" ("), listed, F.lit(")"))).otherwise("")))
    box = polygon.bbox(F.col("rings"))
    return out.select("rel", "problem", "ids", "n_ids", message.alias("message"), "rings", *(box.getField(c).alias(c) for c in ("x0", "y0", "x1", "y1")))


def open_ends(ways: DataFrame) -> DataFrame:
    """rel, node: nodes that end an odd number of a relation's ways. ways: rel, pts (or refs) as first and last node."""
    ends = ways.select("rel", F.explode(F.array("first", "last")).alias("node"))
    return ends.groupBy("rel", "node").agg(F.count("*").alias("n")).filter("n % 2 = 1").select("rel", "node")


def area_edges(members: DataFrame) -> DataFrame:
    """rel, a, b: undirected sides of a relation's distinct ways that occur an odd number of times. Membership is by the even-odd
    rule over them, so no rings need stitching. members: rel, way, refs."""
    sides = members.select("rel", "way", "refs").dropDuplicates(["rel", "way"]).select("rel", F.explode(F.arrays_zip(F.col("refs").alias("p"), F.slice("refs", 2, F.size("refs")).alias("q"))).alias("s")).filter("s.q IS NOT NULL")
    return sides.groupBy("rel", F.least("s.p", "s.q").alias("a"), F.greatest("s.p", "s.q").alias("b")).agg(F.count("*").alias("n")).filter("n % 2 = 1 AND a <> b").select("rel", "a", "b")


_tags = "tag array<struct<_k:string,_v:string>>"
CHANGE_ROW = f"node array<struct<_id:bigint,_version:bigint,_lat:double,_lon:double,{_tags.replace(' ', ':')}>>, way array<struct<_id:bigint,_version:bigint,nd:array<struct<_ref:bigint>>,{_tags.replace(' ', ':')}>>, relation array<struct<_id:bigint,_version:bigint,member:array<struct<_type:string,_ref:bigint,_role:string>>,{_tags.replace(' ', ':')}>>"
ACTIONS = ["create", "modify", "delete"]


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """kind, action, id, version, part, lon, lat, refs, members, tags of every element in change files, in one scan. part orders elements:
    by the number that the digits of a file's path make (000/123/456 is 123456), then by place in the file, creations before
    changes before deletions."""
    block = CHANGE_ROW.replace(" array<", ":array<").replace(", ", ",")
    raw = spark.read.format("xml").option("rowTag", "osmChange").schema(", ".join(f"{a} array<struct<{block}>>" for a in ACTIONS)).load(path)
    none = lambda kind: F.lit(None).cast(kind)

    def row(kind: str, action: str, e: Column) -> Column:
        tags = F.map_from_entries(F.transform(F.coalesce(e["tag"], F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"].alias("key"), t["_v"].alias("value"))))
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(action).alias("action"), e["_id"].alias("id"), e["_version"].alias("version"), (e["_lon"] if kind == "node" else none("double")).alias("lon"), (e["_lat"] if kind == "node" else none("double")).alias("lat"),
            (F.transform(e["nd"], lambda x: x["_ref"]) if kind == "way" else none("array<bigint>")).alias("refs"), (F.transform(e["member"], lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role"))) if kind == "relation" else none(MEMBERS)).alias("members"), tags.alias("tags"),
        )

    def of(action: str, kind: str) -> Column:
        return F.flatten(F.filter(F.transform(action, lambda b: F.transform(b[kind], lambda e: row(kind, action, e))), lambda x: x.isNotNull()))

    every = [of(action, kind) for action in ACTIONS for kind in ("node", "way", "relation")]
    empty = F.array().cast("array<struct<kind:string,action:string,id:bigint,version:bigint,lon:double,lat:double,refs:array<bigint>,members:" + MEMBERS + ",tags:map<string,string>>>")
    number = F.coalesce(F.regexp_replace(F.regexp_extract(F.input_file_name(), r"((?:\d+/)*\d+)[^/]*$", 1), "/", "").try_cast("long"), F.lit(0).cast("long"))
    whole = F.concat(*(F.coalesce(x, empty) for x in every))
    each = raw.select(number.alias("_n"), F.posexplode(whole).alias("_at", "e"))
    return each.select("e.kind", "e.action", "e.id", "e.version", (F.shiftleft("_n", 24) + F.col("_at")).alias("part"), "e.lon", "e.lat", "e.refs", "e.members", "e.tags")


def sequence_manifest(spark: SparkSession, path: str) -> DataFrame:
    """sequence, timestamp of state files."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.regexp_extract("value", r"sequenceNumber=(\d+)", 1).try_cast("long").alias("sequence"), F.to_timestamp(F.replace(F.regexp_extract("value", r"timestamp=(\S+)", 1), F.lit("\\:"), F.lit(":"))).alias("timestamp"))


def sequence_mismatches(spark: SparkSession, path: str) -> DataFrame:
    """path, named, sequence of state files whose number is not that of their path (000/123/456.state.txt is 123456)."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    named = F.regexp_replace(F.regexp_extract("path", r"((?:\d+/)*\d+)[^/]*$", 1), "/", "").try_cast("long")
    both = raw.select("path", named.alias("named"), F.regexp_extract("value", r"sequenceNumber=(\d+)", 1).try_cast("long").alias("sequence"))
    return both.filter(~F.col("named").eqNullSafe(F.col("sequence")))


def sequence_gaps(manifest: DataFrame) -> DataFrame:
    """sequence: numbers between the first and the last that are missing."""
    ends = manifest.agg(F.min("sequence").alias("a"), F.max("sequence").alias("b")).filter("a IS NOT NULL")
    return ends.select(F.explode(F.sequence("a", "b")).alias("sequence")).join(manifest, "sequence", "left_anti")
