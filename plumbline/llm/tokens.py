"""Token-id files: flat unsigned integers with 64-bit document offsets.

A corpus is a folder of parts and a manifest. Part p consists of

- ``<stem>.bin``  the ids of its documents one after another, each document closed by the end id, little-endian
  unsigned integers of 2 bytes (vocabularies up to 65,536) or 4 bytes;
- ``<stem>.idx``  n + 1 little-endian 64-bit offsets, in ids, of the documents' starts and of the part's end;
- ``<stem>.doc``  n little-endian signed 64-bit document ids (the smallest one stands for null).

The manifest (Parquet: part, stem, n_docs, n_tokens, base, width) has each part's base: the ids of all parts before
it, a prefix sum over one row per part. A document starts at base + offset. Parts follow ascending document ids.

A part is written under a name of its own attempt and enters the manifest only with its task's success, so a task
that is repeated after a lost executor leaves at worst a file that no manifest names.

Nulls and odd rows: null text is empty (its ids are the end id alone); null doc_id sorts first; rows with equal
doc_id are all written, ordered by text; an empty table gives an empty manifest; other columns are not read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import Remembered
from .common import file_system, text_slices

NULL_ID = -(2**63)
_encoders: dict = {}


def _encoder(path: str, width: int) -> Remembered:
    """One per Python worker. Chunks without a line feed are encoded in one call, joined by line feeds, which the
    pre-tokenizer cuts off from the space that begins a chunk. A text that has one of the tokenizer's added tokens in it,
    such as its end mark, is one chunk: the library finds these before it cuts."""
    if (path, width) not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        special = sorted((x.content for x in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        special = re.compile("|".join(map(re.escape, special))) if special else None
        tokenizer.model._resize_cache(0)  # no chunk comes twice
        kind = f"<u{width}"
        (line_feed,) = tokenizer.encode("\n", add_special_tokens=False).ids
        plain = re.compile(r" ?\S+").fullmatch

        def many(new: list[str]) -> list[bytes]:
            out = {"": b""}
            joined = [c for c in new if plain(c) and not (special and special.search(c))]
            groups = [joined[at : at + 50] for at in range(0, len(joined), 50)]
            for some, coded in zip(groups, tokenizer.encode_batch_fast(["\n".join(x) for x in groups], add_special_tokens=False), strict=True):
                ids = np.array([*coded.ids, line_feed], dtype=kind)
                raw, at = ids.tobytes(), 0
                for c, end in zip(some, (np.flatnonzero(ids == line_feed) * width).tolist(), strict=True):
                    out[c] = raw[at:end]
                    at = end + width
            rest = [c for c in new if c not in out]
            for c, e in zip(rest, tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else (), strict=True):
                out[c] = np.array(e.ids, dtype=kind).tobytes()
            return [out[c] for c in new]

        _encoders[path, width] = Remembered(many, 800_000, special)
    return _encoders[path, width]


def write_token_files(docs: DataFrame, dest: str, tokenizer: str, end_id: int = 0, width: int = 2) -> DataFrame:
    """Encodes docs (doc_id, text) in ascending doc_id order into files below the URI dest; returns the manifest.

    tokenizer is the path of a tokenizer file of the tokenizers library, there on every machine.
    """
    spark = docs.sparkSession

    def write(batches):
        from pyspark import TaskContext

        part, kind = TaskContext.get().partitionId(), f"<u{width}"
        encoder, end = _encoder(tokenizer, width), np.array([end_id], kind).tobytes()
        fs, folder = file_system(dest)
        stem, outs, at, n = f"part-{part:06d}-{uuid.uuid4().hex[:8]}", None, 0, 0
        for rows in text_slices(batches, ["doc_id"]):
            if outs is None:
                fs.create_dir(folder, recursive=True)
                outs = [fs.open_output_stream(f"{folder}/{stem}.{x}") for x in ("bin", "idx", "doc")]
            coded = encoder.encode(rows["text"])
            sizes = np.array([len(x) // width + 1 for x in coded], "<i8")
            outs[0].write(end.join([*coded, b""]))
            outs[1].write((at + np.cumsum(sizes) - sizes).astype("<i8").tobytes())
            outs[2].write(np.array([NULL_ID if x is None else x for x in rows["doc_id"]], "<i8").tobytes())
            at, n = at + int(sizes.sum()), n + len(coded)
        if outs is not None:
            outs[1].write(np.array([at], "<i8").tobytes())
            for x in outs:
                x.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "stem": [stem], "n_docs": [n], "n_tokens": [at]}, pa.schema([("part", pa.int64()), ("stem", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    parts = ordered.mapInArrow(write, "part long, stem string, n_docs long, n_tokens long")
    parts.write.parquet(f"{dest}/parts")
    parts = spark.read.schema(parts.schema).parquet(f"{dest}/parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    manifest = parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long")).withColumn("width", F.lit(width))
    manifest.write.parquet(f"{dest}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{dest}/manifest")


def read_token_files(spark: SparkSession, dest: str, with_ids: bool = False) -> DataFrame:
    """Reads every part back through a memory map (a random-access file where the folder is not local).

    Returns doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), part and, if
    asked for, ids as an array of longs.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64())]
    fields += [("ids", pa.list_(pa.int64()))] * with_ids
    schema = pa.schema(fields)

    def read(batches):
        fs, folder = file_system(dest)
        local = dest.startswith("file:")

        def raw(name: str):
            if not fs.get_file_info(name).size:
                return b""
            with pa.memory_map(name) if local else fs.open_input_file(name) as f:
                return f.read_buffer() if local else f.read()

        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(raw(f"{folder}/{row['stem']}.bin"), f"<u{row['width']}")
                at = np.frombuffer(raw(f"{folder}/{row['stem']}.idx"), "<i8")
                names = np.frombuffer(raw(f"{folder}/{row['stem']}.doc"), "<i8")
                for lo in range(0, len(names), 2000):
                    hi = min(lo + 2000, len(names))
                    own = [ids[at[i] : at[i + 1]] for i in range(lo, hi)]
                    cols = [[None if x == NULL_ID else x for x in names[lo:hi].tolist()], (at[lo:hi] + row["base"]).tolist(), (at[lo + 1 : hi + 1] - at[lo:hi]).tolist(), [zlib.crc32(x.astype("<u4").tobytes()) for x in own], [row["part"]] * (hi - lo)]
                    cols += [[x.astype(np.int64) for x in own]] * with_ids
                    yield pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(cols, fields, strict=True)], schema=schema)

    manifest = spark.read.parquet(f"{dest}/manifest")
    n = max(1, manifest.count())
    out = "doc_id long, start long, n_tokens long, ids_crc32 long, part long" + ", ids array<long>" * with_ids
    return manifest.repartitionByRange(n, "part").mapInArrow(read, out)


class TokenPart:
    """One local part, memory-mapped: part[i] are the ids of its i-th document, without reading the others."""

    def __init__(self, stem: str, width: int = 2):
        self.ids = np.memmap(f"{stem}.bin", f"<u{width}", "r")
        self.offsets = np.memmap(f"{stem}.idx", "<i8", "r")

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]
