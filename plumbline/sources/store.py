"""Tables in blocks below one folder, with a manifest for every version.

A commit writes the blocks that it replaces into folders of its own, then one manifest that says which folder holds each
block of each table. Writing that file is what makes the version visible: a reader sees the last manifest's tables, whole, before and
after; a commit that fails earlier leaves files that no manifest names and the next commit overwrites. Blocks that a commit does not
replace keep their files. A table's blocks are named by a column expression of the writer's: hashed ids, or coarse cells; a
log is a table to which each commit adds a block. The manifest is one entry a block, so blocks should stay below some ten thousand.

Commits must come one at a time: one that finds its version's manifest there already raises `Conflict`.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another commit has made this version."""


class Part(NamedTuple):
    """What a commit writes of a table: rows, the column that names each row's block, and the blocks replaced (None: all of the table).
    A block that is replaced and gets no rows is gone."""

    rows: DataFrame
    block: Column
    blocks: list[str] | None = None


def added(rows: DataFrame) -> Part:
    """Rows to append to a log."""
    return Part(rows, F.lit("new"), [])


def names(df: DataFrame, block: Column) -> list[str]:
    """The distinct blocks of rows: a bounded list."""
    return sorted(r.b for r in df.select(block.cast("string").alias("b")).filter("b IS NOT NULL").distinct().collect())


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _listed(self, *parts: str) -> list[str]:
        path, files = self._path(*parts)
        return [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []

    def latest(self) -> int:
        """The last version; 0 before the first commit."""
        return max((int(x.split(".")[0]) for x in self._listed("manifests") if x[0] != "." and x.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        if not version:
            return {"version": 0, "tables": {}, "note": {}}
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{version:09d}.json", wholetext=True).first()[0])

    def read(self, table: str, blocks: list[str] | None = None, version: int | None = None) -> DataFrame:
        """A table as of a version (the last unless given), or some of its blocks."""
        known = self.manifest(version)["tables"][table]
        schema = StructType.fromJson(known["schema"])
        some = known["blocks"] if blocks is None else {b: known["blocks"][b] for b in blocks if b in known["blocks"]}
        if not some:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{table}/{folder}" for folder in some.values()))

    def commit(self, parts: dict[str, Part], note: dict | None = None) -> int:
        """Writes the parts, then the manifest; returns the version. note: what else belongs to the version (merged into the last one's)."""
        before = self.manifest()
        version = before["version"] + 1
        tables = dict(before["tables"])

        def write(table: str) -> None:
            part = parts[table]
            part.rows.withColumn("_block", part.block.cast("string")).repartition("_block").write.mode("overwrite").partitionBy("_block").parquet(f"{self.root}/{table}/v{version}")

        with ThreadPoolExecutor(4) as pool:  # jobs of their own, which share the cluster
            list(pool.map(write, parts))
        for table, part in parts.items():
            old = tables.get(table, {"blocks": {}})["blocks"]
            kept = {} if part.blocks is None else {b: f for b, f in old.items() if b not in set(part.blocks)}
            new = {x.split("=", 1)[1]: f"v{version}/{x}" for x in self._listed(table, f"v{version}") if x.startswith("_block=")}
            if part.blocks == []:
                new = {f"{b}-{version}": f for b, f in new.items()}
            tables[table] = {"schema": part.rows.schema.jsonValue(), "blocks": kept | new}
        self._publish(version, {"version": version, "tables": tables, "note": before["note"] | (note or {})})
        return version

    def _publish(self, version: int, content: dict) -> None:
        final, files = self._path("manifests", f"{version:09d}.json")
        draft, _ = self._path("manifests", f".{version:09d}.draft")
        if files.exists(final):
            raise Conflict(f"version {version} is there already")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if not files.rename(draft, final):
            raise Conflict(f"version {version} is there already")

    def vacuum(self, keep: int = 2) -> int:
        """Deletes folders that none of the last `keep` manifests names; returns how many. Readers of older versions must be done."""
        last = self.latest()
        named = {f"{t}/{f}" for v in range(max(1, last - keep + 1), last + 1) for t, x in self.manifest(v)["tables"].items() for f in x["blocks"].values()}
        gone = 0
        for table in self.manifest()["tables"]:
            for folder in self._listed(table):
                for block in self._listed(table, folder):
                    if block.startswith("_block=") and f"{table}/{folder}/{block}" not in named:
                        path, files = self._path(table, folder, block)
                        gone += bool(files.delete(path, True))
        return gone
