"""The change feed: versions collapsed, cells marked, queues drained; as batches and as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tilemath


def collapse(changes: DataFrame) -> DataFrame:
    """The last version of each object (kind, id): highest version, the later part among equals; combined on the map side."""
    rest = [c for c in changes.columns if c not in ("kind", "id")]
    return changes.groupBy("kind", "id").agg(F.max_by(F.struct(*rest), F.struct("version", "part")).alias("_r")).select("kind", "id", *(F.col(f"_r.{c}").alias(c) for c in rest))


def apply_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """state (kind, id, version, ...) after a batch: deletes go, creates and modifies replace; a version below the stored one is late and dropped."""
    last = collapse(changes)
    late = last.join(state.select("kind", "id", F.col("version").alias("_v")), ["kind", "id"]).filter("_v > version").select("kind", "id")
    fresh = last.join(late, ["kind", "id"], "left_anti")
    return state.join(fresh.select("kind", "id"), ["kind", "id"], "left_anti").unionByName(fresh.filter("action <> 'delete'").select(*state.columns))


def dirty_cells(before: DataFrame, after: DataFrame, sources: list[str], buffer: float = 0.0) -> DataFrame:
    """source, cell_x, cell_y: cells of old and new boxes (x0, y0, x1, y1), widened, for each source to match again."""
    boxes = before.select("x0", "y0", "x1", "y1").unionByName(after.select("x0", "y0", "x1", "y1"))
    cells = boxes.select(F.explode(tilemath.cells_for_bbox(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), buffer)).alias("c")).select("c.*").distinct()
    return cells.select(F.explode(F.array(*map(F.lit, sources))).alias("source"), "cell_x", "cell_y")


def propagate(changed_nodes: DataFrame, way_refs: DataFrame, members: DataFrame) -> DataFrame:
    """kind, id: ways on changed nodes (node) and relations on those ways. way_refs: way, node; members: rel, way."""
    ways = way_refs.join(changed_nodes.select("node").distinct(), "node", "left_semi").select("way").distinct()
    rels = members.join(ways, "way", "left_semi").select("rel").distinct()
    return ways.select(F.lit("way").alias("kind"), F.col("way").alias("id")).unionByName(rels.select(F.lit("relation").alias("kind"), F.col("rel").alias("id")))


def kept_tags(changed: DataFrame, stored: DataFrame) -> DataFrame:
    """id, tags: a changed object states its tags; one rebuilt for its nodes keeps those it has."""
    both = changed.select("id", "tags", F.lit(True).alias("_stated")).join(stored.select("id", F.col("tags").alias("_old")), "id", "full_outer")
    return both.select("id", F.when(F.coalesce("_stated", F.lit(False)), F.col("tags")).otherwise(F.col("_old")).alias("tags"))


def unresolved(points: DataFrame, members: DataFrame) -> DataFrame:
    """kind, id: ways with a missing node, and relations with such a way or one that is not there."""
    bad = points.filter("NOT complete").select("way")
    known = points.filter("complete").select("way")
    rels = members.join(known, "way", "left_anti").select("rel").distinct()
    return bad.select(F.lit("way").alias("kind"), F.col("way").alias("id")).unionByName(rels.select(F.lit("relation").alias("kind"), F.col("rel").alias("id")))


def enqueue_all(df: DataFrame, source: str, at: Column) -> DataFrame:
    return df.select(F.lit(source).alias("source"), "cell_x", "cell_y").distinct().withColumn("enqueued_at", at)


def drain(queue: DataFrame, known: list[str], cutoff: Column, n: int) -> tuple[DataFrame, DataFrame]:
    """The n oldest distinct cells enqueued up to the cutoff, and what stays: later rows, and cells beyond n. Rows of unknown sources go."""
    from ..operators.stats import oldest_cells

    own = queue.filter(F.col("source").isin(known))
    taken = oldest_cells(own.filter(F.col("enqueued_at") <= cutoff), n)
    done = taken.select("source", "cell_x", "cell_y", F.lit(True).alias("_done"))
    left = own.join(done, ["source", "cell_x", "cell_y"], "left").filter(~(F.coalesce("_done", F.lit(False)) & (F.col("enqueued_at") <= cutoff))).drop("_done")
    return taken, left


def chunks(sequences: list[int], most: int) -> list[list[int]]:
    """Pending sequence numbers in batches."""
    return [sequences[i : i + most] for i in range(0, len(sequences), most)]


STATE = "version long, part long"


def latest_versions(changes: DataFrame) -> DataFrame:
    """Streaming form of `collapse`: emits an object's change whenever a higher version (or later part of it) arrives; late,
    lower versions emit nothing. changes: kind, id, version, part, action."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = tuple(state.get) if state.exists else (-1, -1)
        rows = pd.concat(frames).sort_values(["version", "part"]).tail(1)
        at = (int(rows["version"].iloc[0]), int(rows["part"].iloc[0])) if len(rows) else best
        if at > best:
            state.update(at)
            yield rows.assign(kind=key[0], id=key[1])[["kind", "id", "version", "part", "action"]]

    return changes.select("kind", "id", "version", "part", "action").groupBy("kind", "id").applyInPandasWithState(step, "kind string, id long, version long, part long, action string", STATE, "update", "NoTimeout")


def recent_changes(changes: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Streaming counts of changed cells by window of detection, with a watermark."""
    return changes.withWatermark("ts", late).groupBy(F.window("ts", window), "cell_x", "cell_y").agg(F.count("*").alias("n"))


def start_apply(changes: DataFrame, path: str, checkpoint: str):
    """Folds a change stream into versioned element tables below path: each batch writes version n + 1, then its stamp. A batch that
    is repeated after a failure writes the same version again."""

    def fold(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/v{n}") if n else batch.limit(0).drop("action")
        apply_changes(before, batch).write.mode("overwrite").parquet(f"{path}/v{n + 1}")
        batch.agg(F.lit(n).alias("batch"), F.max("part").alias("last_part")).write.mode("overwrite").parquet(f"{path}/stamps/batch={n}")

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
