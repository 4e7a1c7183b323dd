"""Registers and answers kept in a `Store`: refreshes that become visible whole, and cells recomputed narrow.

A register lies in blocks of hashed keys, so that a refresh rewrites the blocks of changed rows only; unmatched rows lie in blocks of
16 x 16 cells, so that recomputing cells rewrites their blocks only. Tables of a source s: register_s, unmatched_s, totals_s;
shared by all: refreshes, change_areas, queue, reports. Row counts of blocks are not kept: a block is replaced whole.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tilemath
from ..functions.text import signature
from ..sources.scratch import written
from ..sources.store import Part, Store, added, names
from . import change, matching, quality, reports, stats

REFRESH = "snapshot_id long, source string, at timestamp, etag string, added long, modified long, removed long, warned boolean"
CELL = ["cell_x", "cell_y"]


class Register(NamedTuple):
    """A source's key columns (its record key is the array of their texts) and the columns whose change makes a row modified."""

    source: str
    keys: list[str]
    compared: list[str]


#: What identifies a record and what is compared.
BDOT10K = Register("bdot10k", ["PRZESTRZENNAZW", "LOKALNYID"], ["WERSJA", "KATEGORIAISTNIENIA", "PRZEWAZAJACAFUNKCJABUDYNKU", "FUNKCJAOGOLNABUDYNKU", "LICZBAKONDYGNACJI", "NAZWA", "FSBUD", "INFORMACJADODATKOWA", "KODKST", "ZRODLODANYCHGEOMETRYCZNYCH"])
EGIB = Register("egib", ["id_budynku"], ["rodzaj", "kondygnacje_nadziemne", "kondygnacje_podziemne"])
PRG = Register("prg", ["lokalny_id"], ["numer_porzadkowy", "ulica", "miejscowosc", "kod_pocztowy", "teryt_miejscowosc"])


def record_key(keys: list[str]) -> Column:
    """The record key: an array of the key columns' texts."""
    return F.array(*(F.col(k).cast("string") for k in keys))


def signed(df: DataFrame, register: Register) -> DataFrame:
    """record_key, signature, cell_x, cell_y of a register's rows, as reports store them."""
    return df.select(record_key(register.keys).alias("record_key"), signature(*(F.col(c) for c in register.compared)).alias("signature"), *CELL)


def check_targets(targets: DataFrame, registers: dict[str, Register], most: int = 100) -> DataFrame:
    """targets (request, source, key: map of column to value) with record_key and problem, null if the target can be looked up: an unknown
    source, other columns than exactly the key's, a blank value; or "too many" for all targets of a request with over `most`."""
    order = F.lit(None).cast("array<string>")
    for source, r in registers.items():
        order = F.when(F.col("source") == source, F.array(*(F.lit(k) for k in r.keys))).otherwise(order)
    counted = targets.groupBy(F.col("request").alias("_r")).agg(F.count("*").alias("_n"))
    own = targets.join(counted, F.col("request").eqNullSafe(F.col("_r")), "left").drop("_r").withColumn("_order", order)
    values = F.transform("_order", lambda k: F.element_at("key", k))
    problem = (
        F.when(F.col("_n") > most, "too many")
        .when(F.col("_order").isNull(), "unknown source")
        .when(F.coalesce(F.array_sort(F.map_keys("key")) != F.array_sort("_order"), F.lit(True)), "wrong key columns")
        .when(F.exists(values, lambda v: F.coalesce(F.trim(v) == "", F.lit(True))), "empty key column")
    )
    return own.withColumn("problem", problem).withColumn("record_key", F.when(F.col("problem").isNull(), values)).drop("_n", "_order")


def add_reports(store: Store, targets: DataFrame, registers: dict[str, Register], at: Column, most: int = 100) -> DataFrame:
    """Files reports on the targets that live registers have, with their signature and cell, and queues these cells, in one commit. Returns
    targets with problem: null if accepted, "not found", or what `check_targets` says. A record reported already (active) is accepted once
    more without a new report."""
    checked = written(check_targets(targets, registers, most), "targets")
    live = None
    for source, r in registers.items():
        if f"register_{source}" in store.manifest()["tables"]:
            one = signed(store.read(f"register_{source}"), r).withColumn("source", F.lit(source))
            live = one if live is None else live.unionByName(one)
    resolved = checked.join(live.withColumn("_there", F.lit(True)), ["source", "record_key"], "left")
    resolved = written(resolved.withColumn("problem", F.coalesce("problem", F.when(F.col("_there").isNull(), "not found"))), "resolved")
    old = store.read("reports") if "reports" in store.manifest()["tables"] else None
    new = resolved.filter("problem IS NULL").select("source", "record_key", "signature", *CELL).distinct()
    if old is not None:
        new = new.join(old.filter("status = 'active'").select("source", "record_key"), ["source", "record_key"], "left_anti")
    rows = new.withColumn("status", F.lit("active")).withColumn("created_at", at)
    numbered = change.numbered(rows, "report_id", ["source", "record_key"], change.last_id(old, "report_id"))
    parts = {"reports": added(numbered), "queue": added(new.select("source", *CELL).distinct().withColumn("enqueued_at", at))}
    store.commit(parts)
    return resolved.select(*targets.columns, "record_key", "problem")


def revoke_reports(store: Store, which: Column, at: Column) -> None:
    """Revokes the active reports that `which` selects and queues their cells, in one commit."""
    old = written(store.read("reports"), "reports")
    hit = (F.col("status") == "active") & F.coalesce(which, F.lit(False))
    store.commit({"reports": Part(reports.revoke(old, which), F.lit("all")), "queue": added(old.filter(hit).select("source", *CELL).distinct().withColumn("enqueued_at", at))})


def key_block(keys: list[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*(F.col(k) for k in keys)), F.lit(blocks)).cast("string")


def cell_block() -> Column:
    return F.concat_ws("_", F.shiftright("cell_x", 4), F.shiftright("cell_y", 4))


def last_etag(store: Store, source: str) -> str | None:
    """The etag of the source's last refresh."""
    if "refreshes" not in store.manifest()["tables"]:
        return None
    row = store.read("refreshes").filter(F.col("source") == source).agg(F.max_by("etag", "snapshot_id").alias("etag")).first()
    return row.etag


def _history(store: Store, register: Register, at: Column, etag: str | None, counts: tuple, warned: bool) -> tuple[int, DataFrame]:
    before = store.read("refreshes").agg(F.max("snapshot_id")).first()[0] if "refreshes" in store.manifest()["tables"] else None
    snapshot = (before or 0) + 1
    row = store.spark.createDataFrame([(register.source, etag, *counts, warned)], "source string, etag string, added long, modified long, removed long, warned boolean")
    return snapshot, row.select(F.lit(snapshot).cast("long").alias("snapshot_id"), "source", at.alias("at"), "etag", "added", "modified", "removed", "warned")


def refresh(store: Store, register: Register, staging: DataFrame | Callable[[], DataFrame], at: Column, etag: str | None = None, blocks: int = 256) -> int:
    """Folds a new snapshot of a register into the store, all or nothing; returns its snapshot id. With the etag of the last refresh
    nothing is loaded: a row of zeros is added to the history. The first snapshot makes the register; later ones must have its columns
    and rows (else `Refused`), and rewrite only blocks with changed rows. In the same commit: counts and etag, changes by cell,
    the cells to match again, and reports of this source that expire because their record changed or went.
    Rows have their key columns, the compared ones, cell_x and cell_y, and are unique by key."""
    manifest, table = store.manifest(), f"register_{register.source}"
    if etag is not None and etag == last_etag(store, register.source):
        snapshot, row = _history(store, register, at, etag, (0, 0, 0), False)
        store.commit({"refreshes": added(row)})
        return snapshot
    staging = staging() if callable(staging) else staging
    quality.refuse_empty(staging)
    block = key_block(register.keys, blocks)
    if table not in manifest["tables"]:
        rows = written(staging, "snapshot")
        snapshot, row = _history(store, register, at, etag, (rows.count(), 0, 0), False)
        areas = rows.groupBy(*CELL).agg(F.count("*").alias("added")).select(F.lit(snapshot).cast("long").alias("snapshot_id"), F.lit(register.source).alias("source"), *CELL, "added", F.lit(0).cast("long").alias("modified"), F.lit(0).cast("long").alias("removed"))
        store.commit({table: Part(rows, block), "refreshes": added(row), "change_areas": added(areas), "queue": added(rows.select(F.lit(register.source).alias("source"), *CELL).distinct().withColumn("enqueued_at", at))}, {f"{table}_blocks": blocks})
        return snapshot
    block = key_block(register.keys, manifest["note"][f"{table}_blocks"])
    live = store.read(table)
    quality.check_schema(live, staging)
    found = written(change.diff(live, staging, register.keys, register.compared), "diff")
    counts = found.agg(*(F.count_if(F.col("kind") == k) for k in ("added", "modified", "removed"))).first()
    warned = quality.churn(sum(counts), live.count())
    snapshot, row = _history(store, register, at, etag, tuple(counts), warned)
    areas = written(change.changed_cells(live, staging, found, register.keys), "cells")
    touched = names(found, block)
    parts = {"refreshes": added(row), "change_areas": added(areas.select(F.lit(snapshot).cast("long").alias("snapshot_id"), F.lit(register.source).alias("source"), *CELL, "added", "modified", "removed")), "queue": added(areas.select(F.lit(register.source).alias("source"), *CELL).withColumn("enqueued_at", at))}
    if touched:
        old = store.read(table, touched)
        parts[table] = Part(change.apply_delta(old, staging, found, register.keys).select(*live.columns), block, touched)
    if "reports" in manifest["tables"] and touched:
        after = live.join(found.filter("kind <> 'added'"), register.keys, "left_anti").unionByName(staging.join(found.filter("kind <> 'removed'"), register.keys, "left_semi"))
        parts["reports"] = Part(written(reports.reconcile(store.read("reports"), signed(after, register).drop(*CELL), register.source), "reports"), F.lit("all"))
    store.commit(parts)
    return snapshot


def drained(store: Store, sources: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]], cutoff: Column, n: int) -> int:
    """Recomputes the n oldest cells queued up to the cutoff, in one commit; returns how many. sources: by source, what gives the
    unmatched rows and the comparable rows of given cells (cell_x, cell_y), both with their cell. A cell that is recomputed without rows
    loses those it had. Queue rows of these cells up to the cutoff and of unknown sources go, later ones stay."""
    from ..streaming import feed

    taken, left = feed.drain(store.read("queue"), list(sources), cutoff, n)
    taken = written(taken, "drained")
    parts: dict[str, Part] = {"queue": Part(written(left, "queue"), F.lit("all"))}
    for source, recompute in sources.items():
        cells = taken.filter(F.col("source") == source).select(*CELL)
        touched = names(cells, cell_block())
        if not touched:
            continue
        unmatched, comparable = recompute(cells)
        for table, fresh in ((f"unmatched_{source}", unmatched), (f"totals_{source}", matching.cell_totals(comparable, source))):
            known = table in store.manifest()["tables"]
            kept = store.read(table, touched).join(cells, CELL, "left_anti").select(*store.read(table).columns) if known else fresh.limit(0)
            rows = written(kept.unionByName(fresh.join(cells, CELL, "left_semi").select(*kept.columns)), table)
            parts[table] = Part(rows, cell_block(), touched if known else None)
    store.commit(parts)
    return taken.count()


def rows_in_cells(df: DataFrame, cells: DataFrame) -> DataFrame:
    return df.join(cells, CELL, "left_semi")


def meeting_boxes(df: DataFrame, boxes: DataFrame) -> DataFrame:
    """Rows of df whose box touches a cell that some box touches: what recomputing these rows must read, wider than their cells."""
    cells = F.explode(tilemath.cells_for_bbox(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))))
    own = boxes.select(cells.alias("_c")).distinct()
    return df.withColumn("_c", cells).join(own, "_c", "left_semi").drop("_c").distinct()


def buildings_of_cells(gov: DataFrame, osm: DataFrame, former: DataFrame, vetoes: DataFrame, source: str, key: str) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """For `drained`: unmatched and comparable buildings of cells; the map is read where their boxes reach. gov with cell_x, cell_y and shape."""

    def of(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
        own = written(rows_in_cells(gov, cells), "own")
        near = lambda df: meeting_boxes(df.select("osm_id", "x0", "y0", "x1", "y1"), own).select("osm_id").distinct().join(df, "osm_id")
        classes = matching.building_classes(own, near(osm), near(former), vetoes, source, key)
        return classes.filter("class = 'unmatched'").drop("class"), own

    return of


def addresses_of_cells(gov: DataFrame, osm: DataFrame, mappings: DataFrame, vetoes: DataFrame) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """For `drained`: unmatched and comparable addresses of cells; the map is read 0.003 degrees beyond them. gov with cell_x, cell_y."""

    def of(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
        own = written(rows_in_cells(gov, cells), "own")
        near = matching.around_cells(osm, cells)
        return matching.unmatched_addresses(own.drop(*CELL), near, mappings, vetoes), own

    return of
