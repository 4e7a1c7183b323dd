"""Shared-folder paths and small helpers that every operator of this folder uses."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: What a Python worker keeps between tasks, by operator; and the operator that it worked for last.
worker_models: dict[str, dict] = {}
_last = ""


def take_up(operator: str) -> None:
    """Called by a task before it makes or reads a model. Python workers outlive operators: where another one came before, its kept models
    go, and what it (and its broadcasts) freed returns to the system, so that a worker holds one operator's memory, not the sum of all."""
    global _last
    if operator == _last:
        return
    for other, kept in worker_models.items():
        if other != operator:
            kept.clear()
    _last = operator
    give_back()


def give_back() -> None:
    """Returns what this process has freed to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc keeps freed memory below its top
        libc.malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset (tests), one of this session's own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-plumbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found if "://" in found else f"file://{found}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, for one run of one step."""
    return f"{shared_dir(spark).rstrip('/')}/plumbline/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df below the shared folder and reads it back, so that its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """The Arrow file system of a URI and the path in it; works on executors and for any scheme Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def text_slices(batches, columns: list[str], text: str = "text", chars: int = 4_000_000):
    """Cuts Arrow batches into runs of rows with about so many characters of text: yields dicts of lists; null texts are empty."""
    for batch in batches:
        own = {c: batch.column(c).to_pylist() for c in columns}
        texts = batch.column(text)
        start, size = 0, 0
        lengths = pc.binary_length(texts).to_pylist()
        for i, n in enumerate(lengths):
            size += n or 0
            if size >= chars or i == len(lengths) - 1:
                part = {c: v[start : i + 1] for c, v in own.items()}
                part[text] = [x or "" for x in texts.slice(start, i + 1 - start).to_pylist()]
                yield part
                start, size = i + 1, 0
