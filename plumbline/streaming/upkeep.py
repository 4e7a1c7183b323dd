"""The map's elements and what is served of them, kept current batch by batch.

A `Store` holds the element tables (nodes, ways, relations), reverse references (node to way, way to relation), what is served
(addresses, buildings, former buildings), the queue of cells to match again, and logs of what could not be resolved or was refused. Element
and reference tables lie in blocks of hashed ids, served ones in blocks of hashed (type, id). A batch reads and rewrites only the
blocks that hold something it touches, and becomes visible with its sequence stamp in one commit; a batch that fails leaves
the last version, and applying it again gives the same tables.

A batch's objects are collapsed to their last version; one below the stored version is late and has no effect. Touched are the changed
objects, the ways on changed nodes, and the relations on touched ways. Each touched object is built anew from its own tags (an edited
one's tags are the change's, one that only moved keeps its own) and current coordinates. A way with a missing node, or a relation with
such a way or one that is missing, serves nothing and is named in the log; it comes back when what it lacks arrives.

Cells to match again are those of old and new boxes: buildings and former buildings for both building registers, addresses widened by
0.003 degrees for the address register. A box of more than 1,024 cells (a node at 0, 0) is not queued but logged as refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import polygon, tilemath
from ..operators import arrangement
from ..sources import osm
from ..sources.scratch import large, written
from ..sources.store import Part, Store, added, names
from .feed import collapse

TAGS = "map<string,string>"
ELEMENTS = {"nodes": ["id", "version", "lon", "lat", "tags"], "ways": ["id", "version", "refs", "tags"], "relations": ["id", "version", "members", "tags"]}
KINDS = {"node": "nodes", "way": "ways", "relation": "relations"}
BOX = ["x0", "y0", "x1", "y1"]
SERVED = {"addresses": osm.ADDRESS, "buildings": ["osm_type", "osm_id", "building", "rings", *BOX], "former": ["osm_type", "osm_id", "lifecycle", "lifecycle_value", "rings", *BOX]}
SOURCES = {"addresses": (["prg"], 0.003), "buildings": (["bdot10k", "egib"], 0.0), "former": (["bdot10k", "egib"], 0.0)}


def hashed(blocks: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("string")


def _elements(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """One table of all three kinds, as the readers of `sources.osm` take it."""
    out = None
    kinds = {"lon": "double", "lat": "double", "refs": "array<bigint>", "members": osm.MEMBERS}
    for kind, df in (("node", nodes), ("way", ways), ("relation", relations)):
        own = df.select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), "tags", *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))
        out = own if out is None else out.unionByName(own)
    return out


def served_rows(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """addresses, buildings and former buildings of the elements, invalid shapes repaired, and `unresolved`: kind, id, missing (ids)."""
    e = written(_elements(nodes, ways, relations), "elements")
    points = written(osm.points_of(e), "points")
    rel = e.filter("kind = 'relation'")
    own = written(points.join(large(osm._members(rel).select("way").distinct()), "way", "left_semi"), "member-points")
    addresses = osm.address_nodes(e).unionByName(osm.way_addresses(e, points)).unionByName(osm.relation_addresses(rel, strict=True, points=own))
    out = {"addresses": addresses.select(*osm.ADDRESS)}
    for table, former in (("buildings", False), ("former", True)):
        told = ["lifecycle", "lifecycle_value"] if former else ["building"]
        way, _ = arrangement.repaired(osm.way_buildings(e, former=former, points=points), "osm_id")
        shapes = written(way.unionByName(osm.relation_buildings(rel, former=former, strict=True, points=own).drop("doubtful")).select("osm_type", "osm_id", *told, "rings"), "shapes")
        box = polygon.bbox(F.col("rings"))
        out[table] = shapes.select("*", *(box.getField(c).alias(c) for c in BOX)).select(*SERVED[table])
    refs = e.filter("kind = 'way'").select("id", F.explode("refs").alias("node")).join(large(e.filter("kind = 'node' AND lon IS NOT NULL AND lat IS NOT NULL").select(F.col("id").alias("node"))), "node", "left_anti")
    lacking = refs.groupBy("id").agg(F.sort_array(F.collect_set("node")).alias("missing")).select(F.lit("way").alias("kind"), "id", "missing")
    rels = osm.unresolved_relations(rel, large(own)).select(F.lit("relation").alias("kind"), F.col("rel").alias("id"), F.col("ways").alias("missing"))
    return out | {"unresolved": lacking.unionByName(rels)}


def _references(ways: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    member = F.explode(F.filter("members", lambda m: m.type == "way"))
    return {
        "node_ways": ways.select(F.explode("refs").alias("node"), F.col("id").alias("way")).distinct(),
        "way_relations": relations.select(member.alias("m"), "id").select(F.col("m.ref").alias("way"), F.col("id").alias("relation")).distinct(),
    }


def _keys(blocks: int) -> dict[str, Column]:
    own = dict.fromkeys(ELEMENTS, hashed(blocks, "id")) | dict.fromkeys(SERVED, hashed(blocks, "osm_type", "osm_id"))
    return own | {"node_ways": hashed(blocks, "node"), "way_relations": hashed(blocks, "way")}


def load(store: Store, nodes: DataFrame, ways: DataFrame, relations: DataFrame, blocks: int = 1024, sequence: int | None = None) -> int:
    """Builds all tables from whole element tables; returns the version. blocks: how many a table has, for good."""
    tables = {n: written(df.select(*ELEMENTS[n]), n) for n, df in (("nodes", nodes), ("ways", ways), ("relations", relations))}
    served = served_rows(tables["nodes"], tables["ways"], tables["relations"])
    lacking = served.pop("unresolved")
    keys = _keys(blocks)
    whole = tables | _references(tables["ways"], tables["relations"]) | served
    return store.commit({n: Part(df, keys[n]) for n, df in whole.items()} | {"unresolved": Part(lacking, F.lit("new"))}, {"blocks": blocks, "sequence": sequence})


def cells_of_boxes(boxes: DataFrame, sources: list[str], buffer: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """source, cell_x, cell_y of boxes (osm_type, osm_id, x0, y0, x1, y1), each once; and the rows refused for touching too many cells."""
    cells = tilemath.cells_for_bbox(*(F.col(c) for c in BOX), buffer)
    own = boxes.filter(" AND ".join(f"{c} IS NOT NULL" for c in BOX)).withColumn("_cells", cells)
    good = own.select(F.explode("_cells").alias("c")).select("c.*").distinct()
    return good.select(F.explode(F.array(*map(F.lit, sources))).alias("source"), "cell_x", "cell_y"), own.filter("_cells IS NULL").select("osm_type", "osm_id", *BOX).distinct()


def apply_batch(store: Store, changes: DataFrame, at: Column, sequence: int | None = None) -> int:
    """Folds a batch of changes (as `sources.osm.read_changes` gives them) into the store; returns the new version. at: the time of the queue's
    rows; sequence: the stamp that goes with the data. A sequence at or below the stored one has been applied and does nothing."""
    now = store.manifest()
    blocks, last_sequence = now["note"]["blocks"], now["note"].get("sequence")
    if sequence is not None and last_sequence is not None and sequence <= last_sequence:
        return now["version"]
    version, keys = now["version"], _keys(blocks)

    def stored(table: str, ids: DataFrame, key: str = "id") -> DataFrame:
        """The stored blocks of a table that hold some ids."""
        return store.read(table, names(ids, hashed(blocks, key)), version)

    last = written(collapse(changes), "changes")
    fresh = None
    for kind, table in KINDS.items():
        own = last.filter(F.col("kind") == kind)
        late = own.join(large(stored(table, own).select("id", F.col("version").alias("_v"))), "id").filter("_v > version").select("id")
        one = own.join(large(late), "id", "left_anti")
        fresh = one if fresh is None else fresh.unionByName(one)
    fresh = written(fresh, "fresh")
    change = {table: fresh.filter(F.col("kind") == kind) for kind, table in KINDS.items()}
    ids = {table: df.select("id").distinct() for table, df in change.items()}
    parts = {}

    def current(table: str, wanted: DataFrame) -> DataFrame:
        """Rows of wanted ids as they are after the batch."""
        old = stored(table, wanted).join(large(wanted), "id", "left_semi").join(large(ids[table]), "id", "left_anti")
        return old.unionByName(change[table].filter("action <> 'delete'").join(large(wanted), "id", "left_semi").select(*ELEMENTS[table]))

    def replaced(table: str, old: DataFrame, gone: DataFrame, on: list[str], new: DataFrame, touched: list[str]) -> None:
        if touched:
            parts[table] = Part(old.join(large(gone), on, "left_anti").select(*old.columns).unionByName(new.select(*old.columns)), keys[table], touched)

    for table in ELEMENTS:
        touched = names(ids[table], hashed(blocks, "id"))
        replaced(table, store.read(table, touched, version), ids[table], ["id"], change[table].filter("action <> 'delete'"), touched)

    # reverse references: those of changed ways and relations go, their new ones come
    reverse = {}
    for table, owner, key, ref in (("node_ways", "ways", "way", "node"), ("way_relations", "relations", "relation", "way")):
        before = stored(owner, ids[owner]).join(large(ids[owner]), "id", "left_semi")
        after = change[owner].filter("action <> 'delete'")
        old_refs, new_refs = (_references(df, df)[table] if owner == "ways" else _references(df.limit(0), df)[table] for df in ((before.withColumn("members", F.lit(None).cast(osm.MEMBERS)), after) if owner == "ways" else (before.withColumn("refs", F.lit(None).cast("array<bigint>")), after)))
        new_refs = written(new_refs, table)
        touched = names(old_refs.select(ref).union(new_refs.select(ref)), hashed(blocks, ref))
        replaced(table, store.read(table, touched, version), ids[owner].select(F.col("id").alias(key)), [key], new_refs, touched)
        reverse[table] = (owner, key, ref, new_refs)

    def referring(table: str, refs: DataFrame) -> DataFrame:
        """id of the ways (relations) on given nodes (ways) after the batch."""
        owner, key, ref, new_refs = reverse[table]
        wanted = refs.select(F.col("id").alias(ref)).distinct()
        old = stored(table, wanted, ref).join(large(ids[owner].select(F.col("id").alias(key))), key, "left_anti").select(ref, key)
        return old.unionByName(new_refs.select(ref, key)).join(large(wanted), ref, "left_semi").select(F.col(key).alias("id"))

    ways = written(ids["ways"].union(referring("node_ways", ids["nodes"])).distinct(), "touched-ways")
    relations = written(ids["relations"].union(referring("way_relations", ways)).distinct(), "touched-relations")

    relation_rows = written(current("relations", relations), "relation-rows")
    member_ways = relation_rows.select(F.explode(F.filter("members", lambda m: m.type == "way")).alias("m")).select(F.col("m.ref").alias("id"))
    way_rows = written(current("ways", ways.union(member_ways).distinct()), "way-rows")
    node_rows = current("nodes", way_rows.select(F.explode("refs").alias("id")).union(ids["nodes"]).distinct())
    served = served_rows(node_rows, way_rows, relation_rows)

    kinds = {"node": ids["nodes"], "way": ways, "relation": relations}
    objects = None
    for kind, df in kinds.items():
        one = df.select(F.lit(kind).alias("osm_type"), F.col("id").alias("osm_id"))
        objects = one if objects is None else objects.union(one)
    objects = written(objects, "touched")
    touched = names(objects, hashed(blocks, "osm_type", "osm_id"))
    queue, refused = None, None
    for table, columns in SERVED.items():
        old = store.read(table, touched, version)
        new = written(served[table].join(large(objects), ["osm_type", "osm_id"], "left_semi").select(*columns), table)
        replaced(table, old, objects, ["osm_type", "osm_id"], new, touched)
        gone = old.join(large(objects), ["osm_type", "osm_id"], "left_semi")
        box = [F.col(c) for c in BOX] if table != "addresses" else [F.col(c).alias(b) for c, b in zip(("lon", "lat", "lon", "lat"), BOX, strict=True)]
        both = gone.select("osm_type", "osm_id", *box).unionByName(new.select("osm_type", "osm_id", *box))
        cells, wide = cells_of_boxes(both, *SOURCES[table])
        wide = wide.withColumn("layer", F.lit(table))
        queue, refused = (cells, wide) if queue is None else (queue.union(cells), refused.union(wide))
    unresolved = served["unresolved"].join(large(objects.select(F.col("osm_type").alias("kind"), F.col("osm_id").alias("id"))), ["kind", "id"], "left_semi")
    logs = {"queue": queue.distinct().withColumn("enqueued_at", at), "refused": refused, "unresolved": unresolved}
    return store.commit(parts | {n: added(df) for n, df in logs.items()}, {"sequence": last_sequence if sequence is None else sequence})


def start(changes: DataFrame, store: Store, checkpoint: str):
    """Folds a stream of changes into the store, a commit a micro-batch. The batch's number is the sequence stamp, so that a batch that is
    repeated after a failure does nothing if it was committed."""

    def fold(batch: DataFrame, n: int) -> None:
        apply_batch(Store(batch.sparkSession, store.root), batch, F.current_timestamp(), n)

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
