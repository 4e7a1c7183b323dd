"""The registered queries over the given tables, and their SQL for another engine.

Each query derives its registers from the given tables (plans.derived) and applies operators of this package to all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metric, polygon, text, tilemath
from .operators import change, enrich, matching, quality, reports, stats
from .plans.derived import prelude, views
from .sources import osm, registers
from .streaming import feed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# SQL texts shared by several queries
_CELLS = "CAST(floor((lon + 180) / 360 * 16384) AS INT) AS cell_x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384) AS INT) AS cell_y"
_HN = r"regexp_replace(upper(trim(replace(replace({c}, '\', '/'), '-', '/'))), '^(\d{{1,2}}) ([A-Za-z])$', '\1\2')"
_PRG = r"""prg AS (SELECT * REPLACE (regexp_replace(ulica, '^(ulica|ul\.)\s+(\S)', '\2', 'i') AS ulica) FROM gov_addresses WHERE lon IS NOT NULL)"""
_STREET = "coalesce((SELECT min(osm_street_name) FROM street_mappings m WHERE lower(m.prg_street_name) = lower(a.ulica) AND m.teryt_simc_code = a.teryt_miejscowosc), (SELECT min(osm_street_name) FROM street_mappings m WHERE lower(m.prg_street_name) = lower(a.ulica) AND m.teryt_simc_code IS NULL), a.ulica)"
_SPHERE = "2 * 6371008.8 * asin(sqrt(pow(sin(radians(o.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(o.lat)) * pow(sin(radians(o.lon - s.lon) / 2), 2)))"
_UNMATCHED = rf"""{prelude("gov_addresses", "osm_addresses", "street_mappings", "reports")}, {_PRG},
s AS (SELECT a.*, {_HN.format(c="numer_porzadkowy")} AS hn, nullif(lower(trim({_STREET})), '') AS st, nullif(lower(trim(miejscowosc)), '') AS pl FROM prg a),
o AS (SELECT lon, lat, {_HN.format(c="housenumber")} AS hn, nullif(lower(trim(street)), '') AS st, nullif(lower(trim(city)), '') AS ct FROM osm_addresses),
hit AS (SELECT DISTINCT lokalny_id FROM s JOIN o ON s.hn = o.hn AND abs(s.lat - o.lat) < 0.002 AND abs(s.lon - o.lon) < 0.004
    AND ({_SPHERE} <= 50 OR ({_SPHERE} <= 150 AND (s.st = o.st OR (s.st IS NULL AND o.st IS NULL AND s.pl = o.ct))))),
unmatched AS (SELECT *, {_CELLS} FROM prg WHERE lokalny_id NOT IN (SELECT lokalny_id FROM hit) AND lokalny_id NOT IN (SELECT record_key FROM reports WHERE source = 'prg' AND status = 'active'))"""
_COVER = "EXISTS (SELECT 1 FROM {t} o WHERE o.x0 < b.x1 AND b.x0 < o.x1 AND o.y0 < b.y1 AND b.y0 < o.y1 AND (least(o.x1, b.x1) - greatest(o.x0, b.x0)) * (least(o.y1, b.y1) - greatest(o.y0, b.y0)) >= 0.1 * ((b.x1 - b.x0) * (b.y1 - b.y0)))"
_CLASSES = f"""{prelude("gov_buildings", "osm_buildings", "former_buildings", "reports")},
classes AS (SELECT id_budynku, x0, y0, x1, y1, CASE WHEN {_COVER.format(t="osm_buildings")} THEN 'matched' WHEN {_COVER.format(t="former_buildings")} THEN 'suppressed'
    WHEN id_budynku IN (SELECT record_key FROM reports WHERE source = 'egib' AND status = 'active') THEN 'reported' ELSE 'unmatched' END AS class FROM gov_buildings b WHERE state = 'eksploatowany')"""
_STAGED = f"""{prelude("live", "staging")}, st AS (SELECT k, a, b, n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC NULLS LAST) AS r FROM staging WHERE k IS NOT NULL) WHERE r = 1),
diff AS (SELECT coalesce(l.k, s.k) AS k, CASE WHEN l.k IS NULL THEN 'added' WHEN s.k IS NULL THEN 'removed' WHEN (l.a, l.b) IS DISTINCT FROM (s.a, s.b) THEN 'modified' END AS kind FROM live l FULL JOIN st s ON l.k = s.k)"""


def _prg(spark, sf_dir):
    return registers.build_prg(views(spark, sf_dir, "gov_addresses")[0])


def _boxes(df, *parts):
    return matching.with_shape(df.withColumn("rings", polygon.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))), parts=parts or ("box", "centroid", "area"))


def _unmatched(spark, sf_dir):
    osm_rows, mappings, vetoes = views(spark, sf_dir, "osm_addresses", "street_mappings", "reports")
    return matching.unmatched_addresses(_prg(spark, sf_dir), osm_rows, mappings, vetoes)


def _classes(spark, sf_dir):
    gov, osm_rows, former, vetoes = views(spark, sf_dir, "gov_buildings", "osm_buildings", "former_buildings", "reports")
    return matching.building_classes(_boxes(quality.only_standing(gov), "box", "area"), _boxes(osm_rows, "box"), _boxes(former, "box"), vetoes, "egib", "id_budynku")


def _staged(spark, sf_dir):
    live, staging = views(spark, sf_dir, "live", "staging")
    rows = quality.dedupe_by_key(quality.require_keys(staging, ["k"]), ["k"], "version", text.signature(F.col("a"), F.col("b")))
    return live, rows.select("k", "a", "b", "n")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unmatched_by_cell(spark, sf_dir)


@query(_UNMATCHED + " SELECT lokalny_id, numer_porzadkowy, cell_x, cell_y FROM unmatched")
def unmatched_addresses(spark, sf_dir):
    return _unmatched(spark, sf_dir).select("lokalny_id", "numer_porzadkowy", "cell_x", "cell_y")


@query(_UNMATCHED + " SELECT cell_x, cell_y, count(*) AS total, 'prg' AS source FROM unmatched GROUP BY cell_x, cell_y")
def unmatched_by_cell(spark, sf_dir):
    return matching.cell_totals(_unmatched(spark, sf_dir), "prg")


@query(prelude("gov_addresses") + f", {_PRG}, c AS (SELECT {_CELLS} FROM prg) SELECT cell_x, cell_y, count(*) AS total, 'prg' AS source FROM c GROUP BY cell_x, cell_y")
def address_totals(spark, sf_dir):
    return matching.cell_totals(matching.with_cell(_prg(spark, sf_dir)), "prg")


@query(_UNMATCHED + f""", u AS (SELECT cell_x >> 4 AS bin_x, cell_y >> 4 AS bin_y, 1 AS u, 0 AS t FROM unmatched UNION ALL SELECT cell_x >> 4, cell_y >> 4, 0, 1 FROM (SELECT {_CELLS} FROM prg))
SELECT bin_x, bin_y, sum(u)::BIGINT AS unmatched, sum(t)::BIGINT AS total, CASE WHEN sum(t) > 0 THEN least(sum(u)::DOUBLE / sum(t), 1.0::DOUBLE) ELSE -1.0::DOUBLE END AS ratio FROM u GROUP BY bin_x, bin_y""")
def completeness_bins(spark, sf_dir):
    return stats.bins(_unmatched(spark, sf_dir), matching.cell_totals(matching.with_cell(_prg(spark, sf_dir)), "prg"), 10)


@query(_UNMATCHED + """, t AS (SELECT teryt_gmina, count(*) AS total FROM prg GROUP BY 1), u AS (SELECT teryt_gmina, count(*) AS unmatched FROM unmatched GROUP BY 1)
SELECT teryt_gmina, total, coalesce(unmatched, 0) AS unmatched, least(coalesce(unmatched, 0)::DOUBLE / total, 1.0::DOUBLE) AS ratio FROM t LEFT JOIN u USING (teryt_gmina) ORDER BY ratio DESC, teryt_gmina LIMIT 10""")
def area_ranking(spark, sf_dir):
    return stats.rank_areas(_prg(spark, sf_dir), _unmatched(spark, sf_dir), ["teryt_gmina"], per_page=10)


@query(prelude("gov_addresses") + rf" SELECT lokalny_id, {_HN.format(c='numer_porzadkowy')} AS hn, regexp_replace(ulica, '^(ulica|ul\.)\s+(\S)', '\2', 'i') AS street, nullif(lower(trim(miejscowosc)), '') AS place FROM gov_addresses")
def normalized_names(spark, sf_dir):
    (gov,) = views(spark, sf_dir, "gov_addresses")
    return gov.select("lokalny_id", text.norm_housenumber(F.col("numer_porzadkowy")).alias("hn"), text.strip_street_prefix(F.col("ulica")).alias("street"), text.norm_name(F.col("miejscowosc")).alias("place"))


@query(prelude("gov_addresses", "street_mappings") + f", {_PRG} SELECT lokalny_id, {_STREET} AS street FROM prg a")
def resolved_streets(spark, sf_dir):
    return enrich.resolve_streets(_prg(spark, sf_dir), views(spark, sf_dir, "street_mappings")[0]).select("lokalny_id", "street")


@query(prelude("gov_addresses", "street_mappings") + f""", {_PRG}, r AS (SELECT *, nullif(trim({_STREET}), '') AS street FROM prg a)
SELECT lokalny_id, trim(numer_porzadkowy) AS housenumber, street, CASE WHEN street IS NOT NULL THEN miejscowosc END AS city, CASE WHEN street IS NULL THEN miejscowosc END AS place, kod_pocztowy AS postcode,
    (2 + (street IS NOT NULL)::INT + (miejscowosc IS NOT NULL)::INT + (kod_pocztowy IS NOT NULL)::INT + 1)::INT AS n_tags FROM r""")
def address_tags(spark, sf_dir):
    out = enrich.address_features(_prg(spark, sf_dir), views(spark, sf_dir, "street_mappings")[0], "register")
    tag = lambda k, n: F.element_at("tags", k).alias(n)
    return out.select("lokalny_id", tag("addr:housenumber", "housenumber"), tag("addr:street", "street"), tag("addr:city", "city"), tag("addr:place", "place"), tag("addr:postcode", "postcode"), F.size("tags").alias("n_tags"))


@query(prelude("gov_addresses") + " SELECT 'no coordinates' AS reason, count(*) AS n, min(lokalny_id) AS first_example FROM gov_addresses WHERE lon IS NULL HAVING count(*) > 0")
def load_drop_reasons(spark, sf_dir):
    return registers.prg_drop_reasons(views(spark, sf_dir, "gov_addresses")[0]).select("reason", "n", F.get("examples", 0).alias("first_example"))


@query(prelude("gov_addresses") + " SELECT count(lon) AS n, count(*) FILTER (WHERE NOT (lon BETWEEN 14.0 AND 24.2 AND lat BETWEEN 49.0 AND 54.9)) AS outside, count(*) FILTER (WHERE NOT (lat BETWEEN 14.0 AND 24.2 AND lon BETWEEN 49.0 AND 54.9)) AS outside_exchanged, true AS ok FROM gov_addresses")
def axis_order(spark, sf_dir):
    return quality.check_axis_order(views(spark, sf_dir, "gov_addresses")[0])


@query(_CLASSES + " SELECT id_budynku, class FROM classes")
def building_classes(spark, sf_dir):
    return _classes(spark, sf_dir).select("id_budynku", "class")


@query(_CLASSES + " SELECT class, count(*) AS n FROM classes GROUP BY class")
def building_balance(spark, sf_dir):
    return matching.balance(_classes(spark, sf_dir))


@query(_CLASSES + f", c AS (SELECT {_CELLS} FROM (SELECT (x0 + x1) / 2 AS lon, (y0 + y1) / 2 AS lat FROM classes WHERE class = 'unmatched')) SELECT cell_x, cell_y, count(*) AS total, 'egib' AS source FROM c GROUP BY cell_x, cell_y")
def unmatched_buildings_by_cell(spark, sf_dir):
    return matching.cell_totals(matching.with_cell(matching.with_shape(_classes(spark, sf_dir).filter("class = 'unmatched'"), parts=("centroid",)), "cx", "cy"), "egib")


@query(prelude("gov_buildings", "osm_buildings") + """, f AS (SELECT id_budynku, max((least(o.x1, b.x1) - greatest(o.x0, b.x0)) * (least(o.y1, b.y1) - greatest(o.y0, b.y0)) / ((b.x1 - b.x0) * (b.y1 - b.y0))) AS f
    FROM gov_buildings b JOIN osm_buildings o ON o.x0 < b.x1 AND b.x0 < o.x1 AND o.y0 < b.y1 AND b.y0 < o.y1 GROUP BY id_budynku)
SELECT t::DOUBLE AS threshold, (SELECT count(*) FROM f WHERE f >= t) AS n FROM (VALUES (0.02), (0.1), (0.3), (0.5)) v(t)""")
def overlap_sweep(spark, sf_dir):
    gov, osm_rows = views(spark, sf_dir, "gov_buildings", "osm_buildings")
    return enrich.threshold_sweep(matching.coverage(_boxes(gov, "box", "area"), _boxes(osm_rows, "box"), "id_budynku", "osm_id"), "id_budynku", [0.02, 0.1, 0.3, 0.5])


@query(prelude("gov_buildings") + " SELECT id_budynku, CASE rodzaj WHEN 'm' THEN 'm' WHEN 'Budynki mieszkalne jednorodzinne' THEN 'm' WHEN 'biurowy' THEN 'b' WHEN 'g - produkcyjne (12)' THEN 'g' WHEN 'k1.' THEN 'k' END AS code FROM gov_buildings")
def class_codes(spark, sf_dir):
    return views(spark, sf_dir, "gov_buildings")[0].select("id_budynku", text.class_code(F.col("rodzaj")).alias("code"))


_TYPES = [(1, "m", 4, None, None, "building=apartments"), (1, "m", 1, 2, 0, "building=detached"), (1, "m", 1, 2, None, "building=house"), (1, "m", None, None, None, "building=residential"), (1, "b", None, None, None, "building=office"), (1, "g", None, None, None, "building=outbuilding")]


@query(prelude("gov_buildings") + """, g AS (SELECT *, CASE WHEN rodzaj IN ('m', 'Budynki mieszkalne jednorodzinne') THEN 'm' WHEN rodzaj = 'biurowy' THEN 'b' WHEN rodzaj = 'g - produkcyjne (12)' THEN 'g' WHEN rodzaj = 'k1.' THEN 'k' END AS code FROM gov_buildings),
n AS (SELECT a.id_budynku, count(*) AS neighbours FROM g a JOIN g b ON b.code = 'm' AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 AND (a.x0 + a.x1 <> b.x0 + b.x1 OR a.y0 + a.y1 <> b.y0 + b.y1) GROUP BY 1)
SELECT id_budynku, coalesce(neighbours, 0) AS neighbours, CASE code WHEN 'm' THEN CASE WHEN storeys BETWEEN 1 AND 2 THEN CASE WHEN neighbours IS NULL THEN 'building=detached' ELSE 'building=house' END WHEN storeys >= 4 THEN 'building=apartments' ELSE 'building=residential' END
    WHEN 'b' THEN 'building=office' WHEN 'g' THEN 'building=outbuilding' END AS type_tags, CASE WHEN storeys >= 1 THEN storeys::VARCHAR END AS levels FROM g LEFT JOIN n USING (id_budynku)""")
def building_tags(spark, sf_dir):
    gov = _boxes(views(spark, sf_dir, "gov_buildings")[0], "box", "centroid").withColumn("code", text.class_code(F.col("rodzaj")))
    types = spark.createDataFrame(_TYPES, "tier int, key string, min_levels int, max_levels int, max_neighbours int, tags string")
    out = enrich.tag_buildings(gov, gov, types, "id_budynku", [F.col("code")], "storeys", F.col("code") == "m", "register")
    return out.select("id_budynku", "neighbours", "type_tags", F.element_at("tags", "building:levels").alias("levels"))


@query(prelude("gov_buildings") + """, p AS (SELECT c_custkey, 16e0 + (c_custkey * 37) % 8192 / 4096e0 AS lon, 50e0 + (c_custkey * 101 + CAST(floor(c_custkey / 8192e0) AS BIGINT)) % 8192 / 4096e0 AS lat FROM customer),
k AS (SELECT *, radians(lat) AS r FROM p),
d AS (SELECT c_custkey, id_budynku, round(sqrt(pow(greatest(x0 - lon, lon - x1, 0) * (111412.84 * cos(r) - 93.5 * cos(3 * r) + 0.118 * cos(5 * r)), 2) + pow(greatest(y0 - lat, lat - y1, 0) * (111132.92 - 559.82 * cos(2 * r) + 1.175 * cos(4 * r)), 2)), 6) AS m
    FROM k JOIN gov_buildings ON lon BETWEEN x0 - 0.001 AND x1 + 0.001 AND lat BETWEEN y0 - 0.001 AND y1 + 0.001)
SELECT c_custkey, id_budynku, round(m, 3) AS metres FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY m, id_budynku) AS r FROM d WHERE m < 30) WHERE r = 1""")
def nearest_buildings(spark, sf_dir):
    points = spark.sql("SELECT c_custkey, 16e0 + (c_custkey * 37) % 8192 / 4096e0 AS lon, 50e0 + (c_custkey * 101 + CAST(floor(c_custkey / 8192e0) AS BIGINT)) % 8192 / 4096e0 AS lat FROM {customer}", customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return enrich.nearest_building(points, _boxes(views(spark, sf_dir, "gov_buildings")[0], "box"), "c_custkey", "id_budynku", 30.0).select("c_custkey", "id_budynku", F.round("metres", 3).alias("metres"))


_AREAS = "areas AS (SELECT CAST(n_nationkey AS STRING) AS area, 16e0 + (n_nationkey % 5) * 0.375e0 AS x0, 50e0 + CAST(floor(n_nationkey / 5e0) AS BIGINT) * 0.375e0 AS y0 FROM nation)"


@query(prelude("gov_addresses") + f", {_PRG}, {_AREAS} SELECT area, count(*) AS n, min(lokalny_id) AS first_id FROM prg JOIN areas ON lon > x0 AND lon < x0 + 0.25 AND lat > y0 AND lat < y0 + 0.25 GROUP BY area")
def area_export(spark, sf_dir):
    areas = spark.sql(f"WITH {_AREAS.replace('FROM nation', 'FROM {nation}')} SELECT area, concat_ws(',', x0, y0, x0 + 0.25e0, y0 + 0.25e0) AS text FROM areas", nation=spark.read.parquet(f"{sf_dir}/nation.parquet"))
    areas = quality.parse_areas(areas.withColumn("text", F.col("text")), "text", most=0.07).filter("problem IS NULL")
    inside = enrich.rows_in_areas(areas, _prg(spark, sf_dir), "area").filter("lon > 16 AND lat > 50")
    edge = areas.select("area", "x0", "y0", "x1", "y1")
    inside = inside.join(edge, "area").filter("lon > x0 AND lon < x1 AND lat > y0 AND lat < y1")
    return inside.groupBy("area").agg(F.count("*").alias("n"), F.min("lokalny_id").alias("first_id"))


@query(_STAGED + " SELECT k, kind FROM diff WHERE kind IS NOT NULL")
def snapshot_diff(spark, sf_dir):
    return change.diff(*_staged(spark, sf_dir), ["k"], ["a", "b"])


@query(_STAGED + " SELECT s.* FROM st s WHERE s.k IN (SELECT k FROM diff WHERE kind IN ('added', 'modified')) UNION ALL SELECT l.* FROM live l WHERE l.k NOT IN (SELECT k FROM diff WHERE kind IN ('removed', 'modified'))")
def snapshot_applied(spark, sf_dir):
    live, staging = _staged(spark, sf_dir)
    return change.refresh(live, staging, ["k"], ["a", "b"])["table"]


@query(_STAGED + """, e AS (SELECT DISTINCT k % 64 AS cell_x, n % 64 AS cell_y, d.k, kind FROM diff d JOIN st USING (k) WHERE kind IN ('added', 'modified') UNION SELECT DISTINCT k % 64, n % 64, d.k, kind FROM diff d JOIN live USING (k) WHERE kind IN ('removed', 'modified'))
SELECT cell_x, cell_y, count(*) FILTER (WHERE kind = 'added') AS added, count(*) FILTER (WHERE kind = 'modified') AS modified, count(*) FILTER (WHERE kind = 'removed') AS removed FROM e GROUP BY cell_x, cell_y""")
def change_areas(spark, sf_dir):
    live, staging = (df.withColumn("cell_x", F.col("k") % 64).withColumn("cell_y", F.col("n") % 64) for df in _staged(spark, sf_dir))
    return change.refresh(live, staging, ["k"], ["a", "b"])["cells"]


@query(prelude("live") + " SELECT k, md5(coalesce(a, chr(30)) || chr(31) || coalesce(b, chr(30)) || chr(31) || n::VARCHAR) AS signature FROM live")
def signatures(spark, sf_dir):
    return views(spark, sf_dir, "live")[0].select("k", text.signature(F.col("a"), F.col("b"), F.col("n")).alias("signature"))


@query(prelude("street_mappings", "gov_addresses") + f""", {_PRG}, gone AS (SELECT * FROM street_mappings WHERE prg_street_name = 'Street 3')
SELECT DISTINCT {_CELLS} FROM prg a WHERE EXISTS (SELECT 1 FROM gone g WHERE lower(g.prg_street_name) = lower(a.ulica) AND (g.teryt_simc_code IS NULL OR g.teryt_simc_code = a.teryt_miejscowosc))""")
def street_reload_cells(spark, sf_dir):
    (mappings,) = views(spark, sf_dir, "street_mappings")
    return enrich.reload_street_mappings(mappings, mappings.filter("prg_street_name <> 'Street 3'"), matching.with_cell(_prg(spark, sf_dir)))


@query(prelude("street_mappings", "gov_addresses") + f""", {_PRG}, n AS (SELECT DISTINCT lower(prg_street_name) AS k FROM street_mappings), d AS (SELECT lower(ulica) AS k FROM prg)
SELECT 'unused' AS side, count(DISTINCT k) AS keys, count(*) AS rows FROM n WHERE k NOT IN (SELECT k FROM d WHERE k IS NOT NULL) UNION ALL SELECT 'uncovered', count(DISTINCT k), count(*) FROM d WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM n)""")
def street_drift(spark, sf_dir):
    (mappings,) = views(spark, sf_dir, "street_mappings")
    return enrich.mapping_drift(mappings.select(F.lower("prg_street_name").alias("k")).distinct(), _prg(spark, sf_dir).select(F.lower("ulica").alias("k")), "k")


@query(prelude("street_mappings") + ", v AS (SELECT lower(prg_street_name) AS s, teryt_simc_code AS c FROM street_mappings) SELECT 'empty' AS rule, 0::BIGINT AS n UNION ALL SELECT 'duplicate', (SELECT count(*) FROM (SELECT 1 FROM v GROUP BY s, c HAVING count(*) > 1)) UNION ALL SELECT 'untrimmed', 0")
def street_mapping_rules(spark, sf_dir):
    return quality.mapping_violations(views(spark, sf_dir, "street_mappings")[0])


@query(prelude("osm_addresses") + r""", r AS (SELECT DISTINCT (osm_id % 20)::VARCHAR AS teryt_simc_code, trim(street) AS prg_street_name, CASE WHEN osm_id % 40 = 1 THEN 'Other' ELSE upper(trim(street)) END AS osm_street_name FROM osm_addresses WHERE street IS NOT NULL),
g AS (SELECT lower(prg_street_name) AS k, min(prg_street_name) AS p, min(osm_street_name) AS o FROM r GROUP BY 1 HAVING count(DISTINCT osm_street_name) = 1)
SELECT NULL::VARCHAR AS teryt_simc_code, p AS prg_street_name, o AS osm_street_name FROM g UNION ALL SELECT * FROM r WHERE lower(prg_street_name) NOT IN (SELECT k FROM g)""")
def proposed_mappings(spark, sf_dir):
    (rows,) = views(spark, sf_dir, "osm_addresses")
    rows = rows.filter("street IS NOT NULL").selectExpr("CAST(osm_id % 20 AS STRING) AS teryt_simc_code", "trim(street) AS prg_street_name", "CASE WHEN osm_id % 40 = 1 THEN 'Other' ELSE upper(trim(street)) END AS osm_street_name").distinct()
    return enrich.propose_global(rows)


@query(prelude("reports") + " SELECT source, status, count(*) AS n FROM reports GROUP BY source, status")
def report_counts(spark, sf_dir):
    return reports.counts(views(spark, sf_dir, "reports")[0])


@query(prelude("reports", "gov_buildings") + """ SELECT report_id, record_key, CASE WHEN status = 'active' AND source = 'egib' AND (NOT EXISTS (SELECT 1 FROM gov_buildings WHERE id_budynku = record_key AND state = 'eksploatowany')
    OR (SELECT max(storeys) FROM gov_buildings WHERE id_budynku = record_key) % 2 <> 0) THEN 'expired' ELSE status END AS status FROM reports""")
def report_expiry(spark, sf_dir):
    rows, gov = views(spark, sf_dir, "reports", "gov_buildings")
    live = gov.filter("state = 'eksploatowany'").selectExpr("id_budynku AS record_key", "CASE WHEN storeys % 2 = 0 THEN 'as reported' ELSE 'changed' END AS signature")
    return reports.reconcile(rows.withColumn("signature", F.lit("as reported")), live, "egib").select("report_id", "record_key", "status")


@query(prelude("reports", "gov_buildings") + " SELECT record_key, count(*) AS n, bool_and(record_key IN (SELECT id_budynku FROM gov_buildings)) AS accepted FROM reports GROUP BY record_key")
def report_targets(spark, sf_dir):
    rows, gov = views(spark, sf_dir, "reports", "gov_buildings")
    live = gov.select(F.col("id_budynku").alias("record_key"), F.lit("s").alias("signature"), F.lit(1).alias("cell_x"), F.lit(2).alias("cell_y"))
    return reports.resolve(rows.select("record_key"), live).groupBy("record_key").agg(F.count("*").alias("n"), F.bool_and("accepted").alias("accepted"))


@query(prelude("changes") + ", l AS (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY version DESC, part DESC) AS r FROM changes) SELECT kind, id, version, part, action FROM l WHERE r = 1")
def collapsed_changes(spark, sf_dir):
    return feed.collapse(views(spark, sf_dir, "changes")[0]).select("kind", "id", "version", "part", "action")


@query(prelude("changes") + """, c AS (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY version DESC, part DESC) AS r FROM changes WHERE part % 2 = 0), b AS (SELECT * FROM c WHERE r = 1 AND action <> 'delete'),
d AS (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY version DESC, part DESC) AS r FROM changes WHERE part % 2 = 1), n AS (SELECT d.* FROM d LEFT JOIN b ON d.kind = b.kind AND d.id = b.id WHERE d.r = 1 AND coalesce(b.version, -1) <= d.version)
SELECT kind, id, version, part FROM b WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.kind = b.kind AND n.id = b.id) UNION ALL SELECT kind, id, version, part FROM n WHERE action <> 'delete'""")
def applied_changes(spark, sf_dir):
    (rows,) = views(spark, sf_dir, "changes")
    first = feed.apply_changes(rows.limit(0).drop("action"), rows.filter("part % 2 = 0"))
    return feed.apply_changes(first, rows.filter("part % 2 = 1")).select("kind", "id", "version", "part")


@query(prelude("changes") + f""", p AS (SELECT DISTINCT {_CELLS} FROM changes) SELECT source, cell_x, cell_y FROM p, (VALUES ('bdot10k'), ('egib')) s(source)""")
def changed_feed_cells(spark, sf_dir):
    (rows,) = views(spark, sf_dir, "changes")
    boxes = rows.select(F.col("lon").alias("x0"), F.col("lat").alias("y0"), F.col("lon").alias("x1"), F.col("lat").alias("y1"))
    return feed.dirty_cells(boxes, boxes, ["bdot10k", "egib"])


_QUEUE = f"q AS (SELECT 'egib' AS source, ts AS enqueued_at, {_CELLS} FROM changes)"


@query(prelude("changes") + f", {_QUEUE} SELECT source, count(DISTINCT (cell_x, cell_y)) AS cells, min(enqueued_at) AS oldest FROM q GROUP BY source")
def queue_depth(spark, sf_dir):
    return stats.queue_depth(_queue(spark, sf_dir))


@query(prelude("changes") + f""", {_QUEUE}, t AS (SELECT source, cell_x, cell_y FROM q WHERE enqueued_at <= (SELECT median(enqueued_at) FROM q) GROUP BY source, cell_x, cell_y ORDER BY min(enqueued_at), cell_x >> 3, cell_y >> 3, cell_x, cell_y, source LIMIT 200)
SELECT q.cell_x, q.cell_y, count(*) AS n FROM q WHERE NOT ((source, cell_x, cell_y) IN (SELECT (source, cell_x, cell_y) FROM t) AND enqueued_at <= (SELECT median(enqueued_at) FROM q)) GROUP BY ALL""")
def drained_queue(spark, sf_dir):
    rows = _queue(spark, sf_dir)
    cutoff = rows.agg(F.median(F.col("enqueued_at").cast("timestamp").cast("double"))).first()[0]  # one number, captured once
    _, left = feed.drain(rows, ["egib"], F.timestamp_micros(F.lit(round(cutoff * 1_000_000))).cast("timestamp_ntz"), 200)
    return left.groupBy("cell_x", "cell_y").agg(F.count("*").alias("n"))


def _queue(spark, sf_dir):
    return matching.with_cell(views(spark, sf_dir, "changes")[0]).select(F.lit("egib").alias("source"), F.col("ts").alias("enqueued_at"), "cell_x", "cell_y")


@query(prelude("ways", "nodes") + " SELECT way, count(*) AS n, count(lon) = count(*) AND count(*) >= 2 AS complete FROM ways LEFT JOIN nodes USING (node) GROUP BY way")
def way_geometry(spark, sf_dir):
    return osm.way_points(*views(spark, sf_dir, "ways", "nodes")).select("way", "n", "complete")


@query(prelude("ways", "changes") + """, w AS (SELECT DISTINCT way FROM ways WHERE node IN (SELECT id FROM changes WHERE kind = 'node')) SELECT 'way' AS kind, way AS id FROM w UNION ALL SELECT DISTINCT 'relation', o_custkey FROM orders WHERE o_orderkey IN (SELECT way FROM w)""")
def propagated_changes(spark, sf_dir):
    ways, changes = views(spark, sf_dir, "ways", "changes")
    members = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("rel"), F.col("o_orderkey").alias("way"))
    return feed.propagate(changes.filter("kind = 'node'").select(F.col("id").alias("node")), ways.select("way", "node"), members)


@query(prelude("ways", "nodes") + """, p AS (SELECT way, count(lon) = count(*) AND count(*) >= 2 AS complete FROM ways LEFT JOIN nodes USING (node) GROUP BY way)
SELECT 'way' AS kind, way AS id FROM p WHERE NOT complete UNION ALL SELECT DISTINCT 'relation', o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT way FROM p WHERE complete)""")
def unresolved_elements(spark, sf_dir):
    members = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("rel"), F.col("o_orderkey").alias("way"))
    return feed.unresolved(osm.way_points(*views(spark, sf_dir, "ways", "nodes")), members)


@query(prelude("ways") + """, e AS (SELECT way, o_custkey AS rel, arg_min(node, {'o': ord, 'n': node}) AS a, arg_max(node, {'o': ord, 'n': node}) AS b FROM ways JOIN orders ON o_orderkey = way GROUP BY ALL)
SELECT rel, node FROM (SELECT rel, a AS node FROM e UNION ALL SELECT rel, b FROM e) GROUP BY rel, node HAVING count(*) % 2 = 1""")
def open_ring_ends(spark, sf_dir):
    (ways,) = views(spark, sf_dir, "ways")
    ends = ways.groupBy("way").agg(F.min_by("node", F.struct("ord", "node")).alias("first"), F.max_by("node", F.struct("ord", "node")).alias("last"))
    return osm.open_ends(ends.join(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("rel"), F.col("o_orderkey").alias("way")), "way"))


@query(prelude("gov_addresses") + f""", {_PRG}, c AS (SELECT DISTINCT {_CELLS} FROM prg), r AS (SELECT 14 AS z, cell_x + dx AS x, cell_y + dy AS y FROM c, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy) UNION SELECT 13, cell_x >> 1, cell_y >> 1 FROM c UNION SELECT 12, cell_x >> 2, cell_y >> 2 FROM c)
SELECT DISTINCT z, x, y FROM r""")
def covered_tiles(spark, sf_dir):
    return stats.covered_tiles(matching.cell_totals(matching.with_cell(_prg(spark, sf_dir)), "prg"))


@query(prelude("gov_addresses") + f", {_PRG}, c AS (SELECT {_CELLS} FROM prg) SELECT cell_x >> 1 AS x, cell_y >> 1 AS y, count(*) AS n, 13 AS z FROM c GROUP BY ALL")
def point_tiles(spark, sf_dir):
    return stats.point_tiles(_prg(spark, sf_dir).withColumn("key", F.col("lokalny_id")), 13).select("x", "y", "n", "z")


@query(prelude("gov_buildings") + " SELECT rodzaj AS value, count(*) AS n FROM gov_buildings GROUP BY rodzaj ORDER BY n DESC, value LIMIT 3")
def top_classes(spark, sf_dir):
    return stats.top_values(views(spark, sf_dir, "gov_buildings")[0], "rodzaj", 3)


@query(prelude("units") + " SELECT code, level, name FROM units")
def unit_catalogue(spark, sf_dir):
    return views(spark, sf_dir, "units")[0].orderBy("code")


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_runs(spark, sf_dir):
    return change.latest(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "event_id", "value"), ["event_type"], "event_id")


@query()
def projected_points(spark, sf_dir):
    """National grid metres to lon and lat; other engines have no such series, so this one is tested by its golden point."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    place = metric.grid_to_lonlat(F.lit(300000.0) + F.col("o_orderkey") % 400000, F.lit(300000.0) + F.col("o_custkey") % 300000)
    return orders.select("o_orderkey", F.round(place.lon, 9).alias("lon"), F.round(place.lat, 9).alias("lat"))


@query()
def building_tiles(spark, sf_dir):
    """Clipped features of zoom 14 by tile; clipping has no plain SQL and is tested against areas."""
    rows = _boxes(views(spark, sf_dir, "gov_buildings")[0], "box").select(F.col("id_budynku").alias("key"), F.array(F.struct(F.lit("class").alias("k"), F.col("rodzaj").alias("v"))).alias("tags"), "rings", "x0", "y0", "x1", "y1")
    return stats.tile_features(rows, tilemath.CELL_ZOOM, "buildings")


@query()
def shift_bands(spark, sf_dir):
    """Register rows by how far their largest vertex moved between two snapshots."""
    gov = _boxes(views(spark, sf_dir, "gov_buildings")[0], "box").select("id_budynku", "rings", "storeys")
    step = F.col("storeys") * F.lit(2.0**-23)
    moved = gov.withColumn("rings", F.transform("rings", lambda r: F.struct(r.hole.alias("hole"), F.transform(r.pts, lambda p: F.struct((p.x + step).alias("x"), p.y.alias("y"))).alias("pts"))))
    return change.shift_histogram(gov, moved, ["id_budynku"], [0.001, 0.02, 0.05])


def queries() -> dict:
    from . import catalog_map  # noqa: F401  registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalog_map  # noqa: F401

    return dict(SQL)


@query(prelude("gov_addresses", "reports") + f""", {_PRG}, t AS (SELECT lokalny_id, EXISTS (SELECT 1 FROM reports r WHERE r.record_key = lokalny_id AND r.source = 'prg' AND r.status = 'active') AS reported FROM prg) SELECT * FROM t""")
def flagged_addresses(spark, sf_dir):
    return matching.flag_reported(_prg(spark, sf_dir).select("lokalny_id"), views(spark, sf_dir, "reports")[0], "prg", "lokalny_id")


@query(prelude("gov_buildings", "osm_buildings") + " SELECT id_budynku, osm_id FROM gov_buildings b JOIN osm_buildings o ON (b.x0 + b.x1) / 2 > o.x0 AND (b.x0 + b.x1) / 2 < o.x1 AND (b.y0 + b.y1) / 2 > o.y0 AND (b.y0 + b.y1) / 2 < o.y1")
def paired_buildings(spark, sf_dir):
    """Register buildings whose centroid lies in a mapped one; centroids on a side count for neither engine."""
    gov, osm_rows = views(spark, sf_dir, "gov_buildings", "osm_buildings")
    pairs = enrich.register_pairs(_boxes(gov, "centroid"), _boxes(osm_rows, "box"), "id_budynku", "osm_id")
    inner = osm_rows.select("osm_id", "x0", "y0", "x1", "y1")
    points = gov.selectExpr("id_budynku", "(x0 + x1) / 2 AS cx", "(y0 + y1) / 2 AS cy")
    return pairs.join(inner, "osm_id").join(points, "id_budynku").filter("cx > x0 AND cx < x1 AND cy > y0 AND cy < y1").select("id_budynku", "osm_id")


@query(prelude("gov_buildings") + """, t AS (SELECT storeys, CASE o_custkey % 6 WHEN 0 THEN 'm' WHEN 1 THEN 'm' WHEN 2 THEN 'b' WHEN 3 THEN 'g' WHEN 4 THEN 'k' END AS a, o_custkey FROM orders JOIN gov_buildings ON id_budynku = 'b' || o_orderkey)
SELECT storeys, count(*) AS n, count(*) FILTER (WHERE a IS NOT DISTINCT FROM CASE WHEN o_custkey % 2 = 0 THEN 'm' ELSE 'g' END) AS agreeing, count(*) FILTER (WHERE a IS NOT DISTINCT FROM CASE WHEN o_custkey % 2 = 0 THEN 'm' ELSE 'g' END)::DOUBLE / count(*) AS share FROM t GROUP BY storeys""")
def class_agreement(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("'b' || CAST(o_orderkey AS STRING) AS id_budynku", "CASE WHEN o_custkey % 2 = 0 THEN 'm' ELSE 'g' END AS other")
    rows = views(spark, sf_dir, "gov_buildings")[0].join(orders, "id_budynku").withColumn("code", text.class_code(F.col("rodzaj")))
    return enrich.mapping_agreement(rows, "code", "other", ["storeys"])


@query(prelude("gov_addresses") + f", {_PRG} SELECT min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1, bool_and(lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90) AS ok FROM prg")
def address_extent(spark, sf_dir):
    return quality.grid_extent(_prg(spark, sf_dir))


@query(prelude("gov_addresses", "changes") + f""", {_PRG}, t AS (SELECT cell_x >> 4 AS bin_x, cell_y >> 4 AS bin_y, count(*)::BIGINT AS total FROM (SELECT {_CELLS} FROM prg) GROUP BY ALL),
c AS (SELECT cell_x >> 4 AS bin_x, cell_y >> 4 AS bin_y, floor(epoch(max(ts)))::BIGINT AS changed_at FROM (SELECT ts, {_CELLS} FROM changes) WHERE ts >= TIMESTAMP '2024-01-02' GROUP BY ALL) SELECT bin_x, bin_y, total, coalesce(changed_at, 0) AS changed_at FROM t LEFT JOIN c USING (bin_x, bin_y)""")
def bins_with_change_times(spark, sf_dir):
    totals = matching.cell_totals(matching.with_cell(_prg(spark, sf_dir)), "prg")
    binned = stats.bins(totals.limit(0), totals, 10).select("bin_x", "bin_y", "total")
    changes = matching.with_cell(views(spark, sf_dir, "changes")[0]).select("cell_x", "cell_y", F.col("ts").cast("timestamp").alias("detected_at"))
    return stats.with_change_times(binned, changes, 10, F.lit("2024-01-02").cast("timestamp"))


@query(prelude("gov_addresses") + f", {_PRG} SELECT DISTINCT 'prg' AS source, cell_x, cell_y, 7::BIGINT AS enqueued_at FROM (SELECT {_CELLS} FROM prg)")
def enqueued_cells(spark, sf_dir):
    return feed.enqueue_all(matching.with_cell(_prg(spark, sf_dir)), "prg", F.lit(7).cast("long"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def retained_events(spark, sf_dir):
    return change.expire(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", F.lit("2024-01-10").cast("timestamp")).select("event_id")


@query(_STAGED + " SELECT count(*) FILTER (WHERE kind = 'added') AS added, count(*) FILTER (WHERE kind = 'modified') AS modified, count(*) FILTER (WHERE kind = 'removed') AS removed, count(kind) > 0.5 * (SELECT count(*) FROM live) AS warned FROM diff")
def refresh_history(spark, sf_dir):
    live, staging = _staged(spark, sf_dir)
    done = change.refresh(live, staging, ["k"], ["a", "b"], etag="e", at=F.current_timestamp())
    return done["history"].select("added", "modified", "removed", "warned")


@query(_UNMATCHED + """, t AS (SELECT teryt_gmina, count(*) AS total FROM prg GROUP BY 1), u AS (SELECT teryt_gmina, count(*) AS unmatched FROM unmatched GROUP BY 1)
SELECT teryt_gmina, total, coalesce(unmatched, 0) AS unmatched, least(coalesce(unmatched, 0)::DOUBLE / total, 1.0::DOUBLE) AS ratio, count(*) OVER () AS total_items FROM t LEFT JOIN u USING (teryt_gmina) ORDER BY total DESC, teryt_gmina LIMIT 10 OFFSET 10""")
def area_ranking_page(spark, sf_dir):
    return stats.rank_areas(_prg(spark, sf_dir), _unmatched(spark, sf_dir), ["teryt_gmina"], sort="total", page=2, per_page=10, total_items=True)


_W = f"(1 - {metric.E2!r}::DOUBLE * pow(sin(radians((y0 + y1) / 2)), 2))"
_M2 = f"CAST(round((x1 - x0) * (y1 - y0) * {metric.LON_METRES * metric.LAT_METRES!r}::DOUBLE * cos(radians((y0 + y1) / 2)) / ({_W} * {_W})) AS INT)"


@query(prelude("gov_buildings", "reports") + f""" SELECT 'bdot10k' AS source, id_budynku AS key, false AS reported, state, NULL AS rodzaj, NULL::INT AS storeys, {_M2} AS approx_area_m2 FROM gov_buildings WHERE state = 'eksploatowany'
UNION ALL SELECT 'egib', id_budynku, id_budynku IN (SELECT record_key FROM reports WHERE source = 'egib' AND status = 'active'), NULL, rodzaj, storeys, {_M2} FROM gov_buildings""")
def building_layer(spark, sf_dir):
    gov, vetoes = views(spark, sf_dir, "gov_buildings", "reports")
    gov = _boxes(gov, "box", "area")
    registers_ = {"bdot10k": (quality.only_standing(gov).drop("rodzaj", "storeys"), "id_budynku"), "egib": (gov.drop("state"), "id_budynku")}
    layer = matching.building_layer(registers_, vetoes)
    return layer.select("source", "key", "reported", "state", "rodzaj", "storeys", metric.approx_area_m2(polygon.area(F.col("rings")), (F.col("y0") + F.col("y1")) / 2).alias("approx_area_m2"))


_FINISHED = "CASE WHEN user_id % 2 = 0 THEN 'egib' ELSE 'prg' END AS source"
_OWN = prelude("gov_addresses", "osm_addresses", "street_mappings", "reports")


@query(prelude("gov_addresses", "osm_addresses", "street_mappings", "reports", "gov_buildings", "osm_buildings", "former_buildings") + _UNMATCHED.removeprefix(_OWN) + _CLASSES.removeprefix(prelude("gov_buildings", "osm_buildings", "former_buildings", "reports")) + f""",
f AS (SELECT source, max(ts) AS refreshed_at FROM (SELECT {_FINISHED}, ts FROM events) GROUP BY source),
n AS (SELECT 'egib' AS source, count(*) AS comparable, count(*) FILTER (WHERE class = 'unmatched') AS unmatched FROM classes UNION ALL SELECT 'bdot10k', count(*), count(*) FILTER (WHERE class IN ('unmatched', 'reported')) FROM classes
UNION ALL SELECT 'prg', (SELECT count(*) FROM prg), (SELECT count(*) FROM unmatched)) SELECT source, comparable, unmatched, refreshed_at FROM n LEFT JOIN f USING (source)""")
def source_summary(spark, sf_dir):
    gov, osm_boxes, former, osm_rows, mappings, vetoes = views(spark, sf_dir, "gov_buildings", "osm_buildings", "former_buildings", "osm_addresses", "street_mappings", "reports")
    standing, prg = _boxes(quality.only_standing(gov), "box", "area"), _prg(spark, sf_dir)
    missing = matching.compare_all({"bdot10k": (standing, "id_budynku"), "egib": (standing, "id_budynku")}, _boxes(osm_boxes, "box"), _boxes(former, "box"), prg, osm_rows, mappings, vetoes)
    refreshes = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(_FINISHED, "ts AS finished_at")
    return stats.summary({"bdot10k": (standing, missing["bdot10k"]), "egib": (standing, missing["egib"]), "prg": (prg, missing["prg"])}, refreshes)


@query(prelude("changes") + f""", {_QUEUE}, d AS (SELECT source, count(DISTINCT (cell_x, cell_y)) AS cells, min(enqueued_at) AS oldest FROM q GROUP BY source),
r AS (SELECT {_FINISHED}, arg_max(event_type, event_id) AS outcome, CAST(epoch(TIMESTAMP '2030-01-01') - floor(epoch(max(ts))) AS BIGINT) AS lag_seconds FROM events GROUP BY ALL)
SELECT source, coalesce(cells, 0) AS cells, oldest, outcome, lag_seconds FROM d FULL JOIN r USING (source)""")
def freshness(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(_FINISHED, "event_id AS run_id", "event_type AS outcome", "ts AS stamped_at")
    return stats.freshness(_queue(spark, sf_dir), rows, rows, F.lit("2030-01-01").cast("timestamp_ntz"))


@query(prelude("gov_addresses", "gov_buildings") + f""", {_PRG}, {_AREAS}, b AS (SELECT (x0 + x1) / 2 AS lon, (y0 + y1) / 2 AS lat FROM gov_buildings)
SELECT area, (SELECT count(*) FROM prg p WHERE p.lon > a.x0 + 0.00001 AND p.lon < a.x0 + 0.25 AND p.lat > a.y0 + 0.00001 AND p.lat < a.y0 + 0.25)::INT AS address_count,
(SELECT count(*) FROM b WHERE b.lon > a.x0 + 0.00001 AND b.lon < a.x0 + 0.25 AND b.lat > a.y0 + 0.00001 AND b.lat < a.y0 + 0.25)::INT AS building_count FROM areas a""")
def export_counts(spark, sf_dir):
    """The log rows of an export of every area; areas start beside the grid of the derived points, so that none lies on a side."""
    areas = spark.sql(f"WITH {_AREAS.replace('FROM nation', 'FROM {nation}')} SELECT area, x0 + 0.00001e0 AS x0, y0 + 0.00001e0 AS y0, x0 + 0.249999e0 AS x1, y0 + 0.249999e0 AS y1 FROM areas", nation=spark.read.parquet(f"{sf_dir}/nation.parquet"))
    areas = areas.withColumn("rings", polygon.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    homes = views(spark, sf_dir, "gov_buildings")[0].selectExpr("id_budynku", "(x0 + x1) / 2 AS lon", "(y0 + y1) / 2 AS lat")
    log = enrich.export_log(areas, enrich.rows_in_areas(areas, _prg(spark, sf_dir), "area"), enrich.rows_in_areas(areas, homes, "area"), "area", ["prg", "egib"], F.lit("2024-01-10").cast("timestamp"))
    return enrich.recent_exports(log, F.lit("2024-01-10 00:05:00").cast("timestamp"), 30).select("area", "address_count", "building_count")
