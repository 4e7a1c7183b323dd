"""Register-like inputs derived from the given tables.

None of the given tables has geometry. Each view here derives one input from keys by integer arithmetic over powers of two, in
SQL that Spark and other engines read alike, so its rows grow with the table. Coordinates are exact binary fractions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LON = "16e0 + ({k} * 37) % 8192 / 4096e0"
LAT = "50e0 + ({k} * 101 + CAST(floor({k} / 8192e0) AS BIGINT)) % 8192 / 4096e0"
_lon, _lat = LON.format(k="o_orderkey"), LAT.format(k="o_orderkey")
_number = "CASE WHEN o_orderkey % 7 = 0 THEN CAST(1 + o_orderkey % 40 AS STRING) || ' a' WHEN o_orderkey % 11 = 0 THEN CAST(1 + o_orderkey % 40 AS STRING) || '-' || CAST(3 + o_orderkey % 40 AS STRING) ELSE CAST(1 + o_orderkey % 40 AS STRING) END"

VIEWS = {
    "gov_addresses": f"""SELECT 'a' || CAST(o_orderkey AS STRING) AS lokalny_id, {_number} AS numer_porzadkowy,
        CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 9 = 0 THEN '' WHEN o_custkey % 17 = 3 THEN 'ul.Street ' || CAST(o_custkey % 50 AS STRING) WHEN o_custkey % 19 = 2 THEN ' ul. Street ' || CAST(o_custkey % 50 AS STRING) WHEN o_custkey % 23 = 1 THEN 'ULICA  Street ' || CAST(o_custkey % 50 AS STRING) WHEN o_custkey % 29 = 0 THEN 'ulica' ELSE 'ul. Street ' || CAST(o_custkey % 50 AS STRING) END AS ulica,
        CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE 'Town ' || CAST(o_custkey % 20 AS STRING) END AS miejscowosc,
        CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE '00-' || substr(CAST(1000 + o_custkey % 1000 AS STRING), 2, 3) END AS kod_pocztowy,
        CAST(100000 + o_custkey % 20 AS STRING) AS teryt_miejscowosc, CAST(1000001 + o_custkey % 25 AS STRING) AS teryt_gmina,
        CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE {_lon} END AS lon, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE {_lat} END AS lat, o_orderkey AS wersja_id
        FROM orders""",
    "osm_addresses": f"""SELECT 'node' AS osm_type, o_orderkey AS osm_id, CASE WHEN o_orderkey % 7 = 0 THEN CAST(1 + o_orderkey % 40 AS STRING) || 'A' WHEN o_orderkey % 11 = 0 THEN CAST(1 + o_orderkey % 40 AS STRING) || '/' || CAST(3 + o_orderkey % 40 AS STRING) ELSE ' ' || CAST(1 + o_orderkey % 40 AS STRING) END AS housenumber,
        CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 50 = 3 THEN 'Avenue 3' ELSE 'STREET ' || CAST(o_custkey % 50 AS STRING) || ' ' END AS street,
        CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE ' town ' || CAST(o_custkey % 20 AS STRING) END AS city, {_lon} + (o_orderkey % 10) / 4096e0 AS lon, {_lat} AS lat
        FROM orders WHERE o_orderkey % 3 <> 0""",
    "street_mappings": """SELECT DISTINCT CASE WHEN c_custkey % 50 = 7 THEN CAST(100000 + c_custkey % 20 AS STRING) END AS teryt_simc_code, 'Street ' || CAST(c_custkey % 50 AS STRING) AS prg_street_name,
        'Avenue ' || CAST(c_custkey % 50 AS STRING) AS osm_street_name FROM customer WHERE c_custkey % 50 IN (3, 7, 21)""",
    "gov_buildings": f"""SELECT 'b' || CAST(o_orderkey AS STRING) AS id_budynku, {_lon} AS x0, {_lat} AS y0, {_lon} + (1 + o_custkey % 3) / 32768e0 AS x1, {_lat} + CASE WHEN o_custkey % 2 = 0 THEN 1 / 4096e0 ELSE 1 / 32768e0 END AS y1,
        CASE WHEN o_orderkey % 10 = 0 THEN 'w budowie' ELSE 'eksploatowany' END AS state, CASE o_custkey % 6 WHEN 0 THEN 'm' WHEN 1 THEN 'Budynki mieszkalne jednorodzinne' WHEN 2 THEN 'biurowy' WHEN 3 THEN 'g - produkcyjne (12)' WHEN 4 THEN 'k1.' ELSE 'unknown' END AS rodzaj,
        CAST(o_orderkey % 6 AS INT) AS storeys FROM orders""",
    "osm_buildings": f"""SELECT 'way' AS osm_type, o_orderkey AS osm_id, {_lon} + (o_orderkey % 4) / 65536e0 AS x0, {_lat} + (o_orderkey % 3) / 65536e0 AS y0, {_lon} + (o_orderkey % 4 + 2) / 65536e0 AS x1, {_lat} + (o_orderkey % 3 + 2) / 65536e0 AS y1
        FROM orders WHERE o_orderkey % 5 <> 0""",
    "former_buildings": f"""SELECT 'way' AS osm_type, o_orderkey AS osm_id, {_lon} AS x0, {_lat} AS y0, {_lon} + 1 / 65536e0 AS x1, {_lat} + 1 / 65536e0 AS y1 FROM orders WHERE o_orderkey % 35 IN (5, 10, 11)""",
    "reports": """SELECT o_orderkey AS report_id, 'egib' AS source, 'b' || CAST(o_orderkey AS STRING) AS record_key, CASE WHEN o_orderkey % 4 = 0 THEN 'revoked' ELSE 'active' END AS status, o_orderdate AS created_at FROM orders WHERE o_orderkey % 25 IN (3, 15)
        UNION ALL SELECT o_orderkey + 10000000000, 'egib', 'b' || CAST(o_orderkey AS STRING), 'active', o_orderdate FROM orders WHERE o_orderkey % 50 = 15
        UNION ALL SELECT o_orderkey + 20000000000, 'prg', 'a' || CAST(o_orderkey AS STRING), 'active', o_orderdate FROM orders WHERE o_orderkey % 45 = 9""",
    "live": """SELECT o_orderkey AS k, o_orderstatus AS a, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderpriority END AS b, o_custkey AS n FROM orders WHERE o_orderkey % 29 <> 0""",
    "staging": """SELECT CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE o_orderkey END AS k, CASE WHEN o_orderkey % 31 = 0 THEN 'X' ELSE o_orderstatus END AS a, CASE WHEN o_orderkey % 19 = 0 AND o_orderkey % 2 = 0 THEN NULL ELSE o_orderpriority END AS b, o_custkey AS n, o_orderkey AS version FROM orders WHERE o_orderkey % 23 <> 0
        UNION ALL SELECT o_orderkey, 'old', o_orderpriority, o_custkey, o_orderkey - 1 FROM orders WHERE o_orderkey % 41 = 0 AND o_orderkey % 23 <> 0""",
    "changes": """SELECT CASE WHEN user_id % 3 = 0 THEN 'way' WHEN user_id % 3 = 1 THEN 'node' ELSE 'relation' END AS kind, user_id AS id, event_id % 7 AS version, event_id AS part, CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'signup' THEN 'create' ELSE 'modify' END AS action,
        16e0 + (event_id * 37) % 8192 / 4096e0 AS lon, 50e0 + (user_id * 101) % 8192 / 4096e0 AS lat, ts FROM events""",
    "ways": """SELECT l_orderkey AS way, l_linenumber AS ord, CASE WHEN l_orderkey % 37 = 0 AND l_linenumber = 2 THEN -1 ELSE l_partkey END AS node FROM lineitem""",
    "nodes": """SELECT p_partkey AS node, 16e0 + (p_partkey * 37) % 8192 / 4096e0 AS lon, 50e0 + (p_partkey * 101) % 8192 / 4096e0 AS lat FROM part""",
    "topo_buildings": """SELECT 'PL' || CAST(c_nationkey AS STRING) AS PRZESTRZENNAZW, 't' || CAST(c_custkey AS STRING) AS LOKALNYID, 16e0 + (c_custkey * 37) % 8192 / 4096e0 AS x0, 50e0 + (c_custkey * 101) % 8192 / 4096e0 AS y0, 16e0 + (c_custkey * 37) % 8192 / 4096e0 + 1 / 8192e0 AS x1, 50e0 + (c_custkey * 101) % 8192 / 4096e0 + (1 + c_custkey % 3 * 4) / 16384e0 AS y1,
        16e0 + (c_custkey * 37) % 8192 / 4096e0 + 1 / 16384e0 AS xm, 50e0 + (c_custkey * 101) % 8192 / 4096e0 + 1 / 32768e0 AS ym, CASE WHEN c_custkey % 9 = 0 THEN 'zniszczony' ELSE 'eksploatowany' END AS KATEGORIAISTNIENIA, ' ' || c_mktsegment AS detail, CASE WHEN c_custkey % 2 = 0 THEN 'Business' ELSE c_mktsegment END AS general, CAST(c_custkey % 5 AS INT) AS storeys FROM customer""",
    "units": """SELECT CAST(10 + n_nationkey AS STRING) AS code, 'county' AS level, n_name AS name FROM nation UNION ALL SELECT CAST(r_regionkey AS STRING), 'region', r_name FROM region""",
}

_given = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named views as frames."""
    out = []
    for name in names:
        sql = VIEWS[name]
        frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _given if f" {t}" in sql}
        for t in frames:
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
        out.append(spark.sql(sql, **frames))
    return out


def prelude(*names: str) -> str:
    """WITH clauses of the named views, for SQL engines."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
