"""Readers of the registers and curated tables."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import metric, polygon, text

# Column and element names of the sources.
BDOT_COLUMNS = ["PRZESTRZENNAZW", "LOKALNYID", "WERSJA", "KATEGORIAISTNIENIA", "PRZEWAZAJACAFUNKCJABUDYNKU", "FUNKCJAOGOLNABUDYNKU", "LICZBAKONDYGNACJI", "NAZWA", "FSBUD", "INFORMACJADODATKOWA", "KODKST", "ZRODLODANYCHGEOMETRYCZNYCH"]
EGIB_COLUMNS = ["id_budynku", "rodzaj", "kondygnacje_nadziemne", "kondygnacje_podziemne", "czas_pozyskania"]


def wkb_rings(raw: bytes | None) -> list | None:
    """Rings of a WKB polygon or multipolygon of either byte order, Z and M ignored; None for null or other shapes."""
    if not raw:
        return None
    at, rings = 0, []

    def read(fmt: str):
        nonlocal at
        out = struct.unpack_from(fmt, raw, at)
        at += struct.calcsize(fmt)
        return out

    def shape() -> bool:
        order = "<" if read("B")[0] else ">"
        (kind,) = read(order + "I")
        if kind & 0x20000000:
            read(order + "I")
        flat = kind & 0xFFFF
        size = 2 + bool(kind & 0x80000000 or flat // 1000 in (1, 3)) + bool(kind & 0x40000000 or flat // 1000 in (2, 3))
        if flat % 1000 == 3:
            for i in range(read(order + "I")[0]):
                (n,) = read(order + "I")
                values = read(f"{order}{n * size}d")
                rings.append({"hole": i > 0, "pts": [{"x": values[j], "y": values[j + 1]} for j in range(0, n * size, size)]})
            return True
        return flat % 1000 == 6 and all(shape() for _ in range(read(order + "I")[0]))

    return rings if shape() else None


def decode_wkb(df: DataFrame, column: str, out: str = "rings") -> DataFrame:
    """df with the polygon of a WKB column in place of it."""
    kept = [c for c in df.columns if c not in (column, out)]
    kind = pa.list_(pa.struct([("hole", pa.bool_()), ("pts", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))]))
    schema = ", ".join([f"`{n}` {t}" for n, t in df.dtypes if n in kept] + [f"{out} {polygon.TYPE}"])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array([wkb_rings(x) for x in part.column(column).to_pylist()], kind)], names=[*kept, out])

    return df.mapInArrow(run, schema)


def reprojected(df: DataFrame, rings: str = "rings") -> DataFrame:
    """National grid metres to lon and lat, and rings turned the usual way."""
    to = lambda p: metric.grid_to_lonlat(p.x, p.y)
    moved = F.transform(rings, lambda r: F.struct(r.hole.alias("hole"), F.transform(r.pts, lambda p: F.struct(to(p).lon.alias("x"), to(p).lat.alias("y"))).alias("pts")))
    return df.withColumn(rings, polygon.oriented(moved))


def read_bdot10k(spark: SparkSession, path: str, geometry: str = "GEOM") -> DataFrame:
    return reprojected(decode_wkb(spark.read.parquet(path).select(*BDOT_COLUMNS, geometry), geometry))


def read_egib(spark: SparkSession, path: str, geometry: str = "geometry") -> DataFrame:
    out = reprojected(decode_wkb(spark.read.parquet(path).select(*EGIB_COLUMNS, geometry), geometry))
    return out.withColumn("rodzaj_kod", text.class_code(F.col("rodzaj")))


# Element names of the source.
PRG_SCHEMA = "lokalnyId string, wersjaId string, numerPorzadkowy string, ulica string, miejscowosc string, kodPocztowy string, terytMiejscowosc string, terytGmina string, waznyOd date, pos string"


def read_prg_gml(spark: SparkSession, path: str, units: DataFrame, row_tag: str = "adres", order: str = "xy") -> DataFrame:
    """Address rows of unzipped GML, with their municipality's name. Axis order xy or yx of the point's two numbers."""
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(PRG_SCHEMA).load(path)
    first, second = (F.get(F.split(F.trim("pos"), r"\s+"), i).try_cast("double") for i in range(2))
    east, north = (first, second) if order == "xy" else (second, first)
    place = metric.grid_to_lonlat(east, north)
    out = raw.select(
        F.col("lokalnyId").alias("lokalny_id"), F.col("wersjaId").alias("wersja_id"), F.col("numerPorzadkowy").alias("numer_porzadkowy"), "ulica", "miejscowosc", F.col("kodPocztowy").alias("kod_pocztowy"),
        F.col("terytMiejscowosc").alias("teryt_miejscowosc"), F.col("terytGmina").alias("teryt_gmina"), F.col("waznyOd").alias("wazny_od_lub_data_nadania"), place.lon.alias("lon"), place.lat.alias("lat"),
    )
    return out.join(units.select(F.col("code").alias("teryt_gmina"), F.col("name").alias("gmina")), "teryt_gmina", "left")


def build_prg(raw: DataFrame) -> DataFrame:
    """Keyed rows with coordinates, streets without their prefix, one row a key."""
    from ..operators import quality

    rows = quality.drop_missing_coordinates(quality.require_keys(raw, ["lokalny_id"])).withColumn("ulica", text.strip_street_prefix(F.col("ulica")))
    return quality.dedupe_by_key(rows, ["lokalny_id"], "wersja_id", text.signature(F.col("numer_porzadkowy"), F.col("ulica"), F.col("miejscowosc")))


def prg_drop_reasons(raw: DataFrame) -> DataFrame:
    from ..operators import quality

    later = F.row_number().over(Window.partitionBy("lokalny_id").orderBy(F.col("wersja_id").desc_nulls_last())) > 1
    rows = raw.filter("lokalny_id IS NOT NULL").withColumn("_later", later).unionByName(raw.filter("lokalny_id IS NULL").withColumn("_later", F.lit(False)))
    return quality.drop_reasons(rows, [("no key", F.col("lokalny_id").isNull()), ("no coordinates", F.col("lon").isNull() | F.col("lat").isNull()), ("older version", F.col("_later"))], F.col("lokalny_id"))


def load_street_mappings(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    return raw.select(F.nullif(F.trim("teryt_simc_code"), F.lit("")).alias("teryt_simc_code"), F.trim("prg_street_name").alias("prg_street_name"), F.trim("osm_street_name").alias("osm_street_name"))


def load_building_types(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    number = lambda c: F.nullif(F.trim(c), F.lit("")).cast("int").alias(c)
    return raw.select(number("tier"), F.lower(F.trim("key")).alias("key"), number("min_levels"), number("max_levels"), number("max_neighbours"), F.trim("tags").alias("tags"))


def build_teryt_units(terc: DataFrame) -> DataFrame:
    """code, level, name of voivodeships, counties and municipalities (types 1 to 3) from WOJ, POW, GMI, RODZ, NAZWA."""
    woj, pow_, gmi = F.col("WOJ"), F.col("POW"), F.col("GMI")
    one = terc.filter(pow_.isNull()).select(woj.alias("code"), F.lit("voivodeship").alias("level"), F.col("NAZWA").alias("name"))
    two = terc.filter(pow_.isNotNull() & gmi.isNull()).select(F.concat(woj, pow_), F.lit("county"), F.col("NAZWA"))
    three = terc.filter(gmi.isNotNull() & F.col("RODZ").isin("1", "2", "3")).select(F.concat(woj, pow_, gmi, F.col("RODZ")), F.lit("municipality"), F.col("NAZWA"))
    return one.union(two).union(three).dropDuplicates(["code"])
