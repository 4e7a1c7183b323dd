"""Which register rows does the map lack?

Buildings: an OSM footprint that covers a tenth of the register's footprint matches it; a former-building polygon that does
so vetoes it; an active report vetoes it. Pairs are found by small cells, then by bounding boxes, then by the exact overlap.
Addresses: the same normalised house number, within 50 m; or within 150 m with the same street, or, both streetless, the
same locality. Pairs are found by house number and a grid of 0.005 degrees, of which a row asks the squares within 150 m.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metric, polygon, text, tilemath
from ..sources.scratch import large

NEAR, NAMED, GRID, MIN_OVERLAP = 50.0, 150.0, 0.005, 0.10
#: Pairs of buildings are looked for in cells of this zoom (190 m wide at 52 degrees): few buildings touch two, and few others share one.
PAIR_ZOOM = 17


def with_cell(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return df.withColumn("cell_x", tilemath.cell_x(F.col(lon))).withColumn("cell_y", tilemath.cell_y(F.col(lat)))


def with_shape(df: DataFrame, rings: str = "rings", parts: tuple[str, ...] = ("box", "centroid", "area")) -> DataFrame:
    """df with x0, y0, x1, y1 (box), cx, cy (centroid) and area of a polygon column, as far as asked for, computed once."""
    made = {"box": polygon.bbox(F.col(rings)), "centroid": polygon.centroid(F.col(rings)), "area": polygon.area(F.col(rings))}
    names = {"box": ["_box.x0", "_box.y0", "_box.x1", "_box.y1"], "centroid": [F.col("_centroid.x").alias("cx"), F.col("_centroid.y").alias("cy")], "area": [F.col("_area").alias("area")]}
    own = df.drop(*(c for p in parts for c in {"box": ("x0", "y0", "x1", "y1"), "centroid": ("cx", "cy"), "area": ("area",)}[p]))
    # a generated row is computed once, where a projected expression would be repeated in every use of its column
    rows = F.inline(F.array(F.struct(*(made[p].alias(f"_{p}") for p in parts))))
    return own.select("*", rows).select(*own.columns, *(c for p in parts for c in names[p]))


BOX = ["x0", "y0", "x1", "y1"]


def by_cell(df: DataFrame) -> DataFrame:
    """df's rows in each small cell that their box touches: cell_x, cell_y, and left and up, the first of these cells. What is above 1,024 cells
    of zoom 14 is left out."""
    x, y = (lambda c: tilemath.cell_x(F.col(c), PAIR_ZOOM)), (lambda c: tilemath.cell_y(F.col(c), PAIR_ZOOM))
    each = df.select("*", x("x0").alias("left"), y("y1").alias("up"), x("x1").alias("_right"), y("y0").alias("_down"))
    most = 1024 << 2 * (PAIR_ZOOM - tilemath.CELL_ZOOM)
    each = each.filter((F.col("_right") - F.col("left") + 1).cast("long") * (F.col("_down") - F.col("up") + 1) <= most)
    own = [*df.columns, "left", "up"]
    return each.select(*own, "_down", F.explode(F.sequence("left", "_right")).alias("cell_x")).select(*own, "cell_x", F.explode(F.sequence("up", "_down")).alias("cell_y"))


def meeting(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of rows (as `by_cell` gives them) whose boxes meet, each once: in the first cell that both touch. b's columns with _ before."""
    cell = ["cell_x", "cell_y"]
    right = b.select(*(F.col(c).alias(f"_{c}") for c in b.columns if c not in cell), *cell)
    both = a.join(large(right), cell).filter("cell_x = greatest(left, _left) AND cell_y = greatest(up, _up)")
    return both.filter("x0 <= _x1 AND _x0 <= x1 AND y0 <= _y1 AND _y0 <= y1")


def coverage(gov: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """key, other_key, overlap, fraction of the gov footprint; both sides with rings and shape columns. Shapes go to the cells with their rows."""
    line = polygon.lines(F.col("rings")).alias("lines")
    both = meeting(by_cell(gov.select(key, "area", line, *BOX)), by_cell(other.select(F.col(other_key).alias("other"), line, *BOX))).filter("x0 < _x1 AND _x0 < x1")
    over = both.select(key, F.col("_other").alias(other_key), "area", polygon.overlap(F.col("lines"), F.col("_lines"), F.least("y0", "_y0")).alias("overlap"))
    return over.select(key, other_key, "overlap", (F.col("overlap") / F.col("area")).alias("fraction"))


def covered(gov: DataFrame, other: DataFrame, key: str, other_key: str, least: float = MIN_OVERLAP) -> DataFrame:
    return coverage(gov, other, key, other_key).filter(F.col("fraction") >= least).select(key).distinct()


def building_classes(gov: DataFrame, osm: DataFrame, former: DataFrame, reports: DataFrame, source: str, key: str, other_key: str = "osm_id") -> DataFrame:
    """gov with class: matched, suppressed, reported or unmatched, in this precedence."""
    active = reports.filter((F.col("status") == "active") & (F.col("source") == source)).select(F.col("record_key").alias(key)).distinct().withColumn("_r", F.lit(1))
    tagged = lambda df, tag: df.select(F.concat(F.lit(tag), F.col(other_key).cast("string")).alias("_o"), "rings", "x0", "y0", "x1", "y1")
    over = coverage(gov, tagged(osm, "m").unionByName(tagged(former, "s")), key, "_o").filter(F.col("fraction") >= MIN_OVERLAP)
    hits = over.groupBy(key).agg(F.max(F.startswith("_o", F.lit("m")).cast("int")).alias("_m"), F.max(F.startswith("_o", F.lit("s")).cast("int")).alias("_s"))
    out = gov.join(hits, key, "left").join(active, key, "left")
    kind = F.when(F.col("_m") == 1, "matched").when(F.col("_s") == 1, "suppressed").when(F.col("_r") == 1, "reported").otherwise("unmatched")
    return out.withColumn("class", kind).drop("_m", "_s", "_r")


def balance(classes: DataFrame) -> DataFrame:
    """class, n: four disjoint classes that sum to all comparable rows."""
    return classes.groupBy("class").agg(F.count("*").alias("n"))


def resolve_streets(addresses: DataFrame, mappings: DataFrame) -> DataFrame:
    """addresses with street: the mapping of its settlement, else the one without settlement, else as registered. Names compare
    without case. Mappings are a curated table of a few thousand rows and are broadcast: streets are few, and a join by them would deal whole
    streets to single tasks."""
    own = mappings.filter("teryt_simc_code IS NOT NULL").select(F.col("teryt_simc_code").alias("_c"), F.lower("prg_street_name").alias("_n"), F.col("osm_street_name").alias("_own"))
    every = mappings.filter("teryt_simc_code IS NULL").select(F.lower("prg_street_name").alias("_g"), F.col("osm_street_name").alias("_every"))
    out = addresses.join(F.broadcast(own), (F.lower("ulica") == F.col("_n")) & (F.col("teryt_miejscowosc") == F.col("_c")), "left").join(F.broadcast(every), F.lower("ulica") == F.col("_g"), "left")
    return out.withColumn("street", F.coalesce("_own", "_every", "ulica")).drop("_c", "_n", "_own", "_g", "_every")


def matched_addresses(gov: DataFrame, osm: DataFrame, mappings: DataFrame, key: str = "lokalny_id") -> DataFrame:
    """Keys of addresses that the map has. gov: lon, lat, numer_porzadkowy, ulica, miejscowosc, teryt_miejscowosc; osm: lon, lat, housenumber, street, city."""
    floor = lambda c: F.floor(c / GRID).cast("long")
    left = resolve_streets(gov, mappings).select(key, text.norm_housenumber(F.col("numer_porzadkowy")).alias("_hn"), F.col("lon").alias("_x"), F.col("lat").alias("_y"), text.norm_name(F.col("street")).alias("_s"), text.norm_name(F.col("miejscowosc")).alias("_p"))
    # 150 m in degrees, a little more: of latitude, and of longitude at the end of the stretch that is nearer to a pole
    high = NAMED / 111_000.0
    wide = F.lit(high) / F.cos(F.radians(F.least(F.abs("_y") + high, F.lit(85.0)))) * 1.01
    squares = lambda c, d: F.explode(F.sequence(floor(F.col(c) - d), floor(F.col(c) + d)))
    left = left.filter("_hn IS NOT NULL AND _x IS NOT NULL AND _y IS NOT NULL").withColumn("_w", wide).select("*", squares("_x", F.col("_w")).alias("gx")).select("*", squares("_y", F.lit(high)).alias("gy"))
    right = osm.select(text.norm_housenumber(F.col("housenumber")).alias("_hn"), F.col("lon").alias("_ox"), F.col("lat").alias("_oy"), text.norm_name(F.col("street")).alias("_os"), text.norm_name(F.col("city")).alias("_oc"), floor(F.col("lon")).alias("gx"), floor(F.col("lat")).alias("gy"))
    both = left.join(large(right), ["_hn", "gx", "gy"]).filter((F.abs(F.col("_x") - F.col("_ox")) <= F.col("_w")) & (F.abs(F.col("_y") - F.col("_oy")) <= high))
    metres = metric.sphere_distance(F.col("_x"), F.col("_y"), F.col("_ox"), F.col("_oy"))
    names = (F.col("_s") == F.col("_os")) | (F.col("_s").isNull() & F.col("_os").isNull() & (F.col("_p") == F.col("_oc")))
    return both.withColumn("_d", metres).filter((F.col("_d") <= NEAR) | ((F.col("_d") <= NAMED) & F.coalesce(names, F.lit(False)))).select(key).distinct()


def unmatched_addresses(gov: DataFrame, osm: DataFrame, mappings: DataFrame, reports: DataFrame, key: str = "lokalny_id", source: str = "prg") -> DataFrame:
    active = reports.filter((F.col("status") == "active") & (F.col("source") == source)).select(F.col("record_key").alias(key))
    return with_cell(gov.join(matched_addresses(gov, osm, mappings, key), key, "left_anti").join(active, key, "left_anti"))


def cell_totals(df: DataFrame, source: str) -> DataFrame:
    return df.groupBy("cell_x", "cell_y").agg(F.count("*").alias("total")).withColumn("source", F.lit(source))


def totals_for_cells(totals: DataFrame, df: DataFrame, source: str, cells: DataFrame) -> DataFrame:
    """totals with the rows of the given cells counted anew; a cell without rows loses its own."""
    keys = ["cell_x", "cell_y"]
    kept = totals.join(cells.select(*keys).distinct().withColumn("source", F.lit(source)), [*keys, "source"], "left_anti")
    return kept.select(*totals.columns).unionByName(cell_totals(df.join(cells.select(*keys).distinct(), keys, "left_semi"), source).select(*totals.columns))


def recompute_cells(unmatched: DataFrame, fresh: DataFrame, cells: DataFrame) -> DataFrame:
    """unmatched with the rows of the given cells replaced by those of fresh (computed over rows read wider than the cells)."""
    keys, own = ["cell_x", "cell_y"], cells.select("cell_x", "cell_y").distinct()
    return unmatched.join(own, keys, "left_anti").unionByName(fresh.join(own, keys, "left_semi").select(*unmatched.columns))


def around_cells(df: DataFrame, cells: DataFrame, buffer: float = 0.003, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows whose point is in a given cell widened by so many degrees: what recomputing those cells must read."""
    near = df.withColumn("_cell", F.explode(tilemath.cells_for_bbox(F.col(lon), F.col(lat), F.col(lon), F.col(lat), buffer)))
    own = cells.select(F.struct("cell_x", "cell_y").alias("_cell")).distinct()
    return near.join(own, "_cell", "left_semi").drop("_cell").distinct()


def flag_reported(df: DataFrame, reports: DataFrame, source: str, key: str) -> DataFrame:
    active = reports.filter((F.col("status") == "active") & (F.col("source") == source)).select(F.col("record_key").alias(key), F.lit(True).alias("reported")).distinct()
    return df.join(active, key, "left").withColumn("reported", F.coalesce("reported", F.lit(False)))


def building_layer(registers: dict[str, tuple[DataFrame, str]], reports: DataFrame) -> DataFrame:
    """source, key, reported and the columns of all building registers as one layer; a column that a register lacks is null in its rows.
    registers: rows and key column by source."""
    out = None
    for source, (df, key) in registers.items():
        one = flag_reported(df, reports, source, key).withColumnRenamed(key, "key").withColumn("source", F.lit(source))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def compare_all(registers: dict[str, tuple[DataFrame, str]], osm: DataFrame, former: DataFrame, addresses: DataFrame, osm_addresses: DataFrame, mappings: DataFrame, reports: DataFrame) -> dict[str, DataFrame]:
    """Unmatched rows of every building register (rows and key column by source) and of the addresses ("prg")."""
    out = {source: building_classes(df, osm, former, reports, source, key).filter("class = 'unmatched'").drop("class") for source, (df, key) in registers.items()}
    return out | {"prg": unmatched_addresses(addresses, osm_addresses, mappings, reports)}
