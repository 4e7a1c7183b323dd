"""WARC archives with per-record Zstandard compression and an embedded dictionary.

Each file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, followed by one frame for each
record, so that any record can be read by its offset. The first record is a warcinfo record. Every record has a date (that of
the run, a parameter) and an id of its own, made from the page's id, its payload's digest and its number among the rows that share both. The dictionary is trained on at most `sample` records, those of
smallest digest, each by at most eight pieces of 2,000 characters spread over all of it; with too few or too small records to train on, the records themselves become a raw-content dictionary.

Of the records with equal payloads the one with the smallest page_id is a response; the others become revisit records
that name it and carry no payload. Payloads below `min_bytes` are always responses.

Nulls and odd rows: null html is an empty payload; null url is an empty URI; a null page_id counts as larger than any
other and comes back as null (a group of only null page_ids has responses throughout, for nothing could name one);
rows with equal page_id and equal payload are all responses of that page_id if it is the smallest; an empty table gives
no archives; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import file_system, stored, text_slices

MAGIC, DICT_MAGIC = 0x184D2A5D, b"\x37\xa4\x30\xec"
DATE = "1970-01-01T00:00:00Z"


def now() -> str:
    """The time as a WARC-Date, for a run to name itself by."""
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: the smallest page_id of an equal payload, null on responses.

    Digests that occur once are left out before the join; what is joined is a digest and an id.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("_digest", F.sha1(F.encode("html", "UTF-8")))
    sized = own.filter(F.octet_length("html") >= min_bytes)
    first = sized.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1 AND _first IS NOT NULL").select("_digest", "_first")
    other = F.col("_first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("_first")))
    return own.join(first, "_digest", "left").select("page_id", "url", "html", F.when(other, F.col("_first")).alias("refers_to"))


def _numbered(own: DataFrame) -> DataFrame:
    """own with copy: 0, and for rows that share page_id and html numbers from 0 on."""
    named = own.withColumn("_name", F.xxhash64("page_id", F.sha1("html")))
    again = stored(named.groupBy("_name").agg(F.count("*").alias("_n")).filter("_n > 1").select("_name"), "repeated-pages")
    if again.isEmpty():
        return own.withColumn("copy", F.lit(0))
    single = named.join(again, "_name", "left_anti").withColumn("copy", F.lit(0))
    several = named.join(again, "_name", "left_semi").withColumn("copy", F.row_number().over(Window.partitionBy("_name").orderBy("url")) - 1)
    return single.unionByName(several).drop("_name")


def train_dictionary(pages: DataFrame, size: int = 65_536, sample: int = 2_000) -> bytes:
    """At most `size` bytes, from at most `sample` records; of one longer than 16,000 characters, eight pieces evenly spread."""
    html = F.coalesce("html", F.lit(""))
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(html, F.floor((F.char_length(html) - 2000) * i / 7).cast("int") + 1, F.lit(2000))), "")
    body = F.when(F.char_length(html) <= 16_000, html).otherwise(spread)
    keyed = pages.select(body.alias("_body"), F.sha1(F.coalesce("html", F.lit(""))).alias("_k"))
    keys = keyed.select("_k").orderBy("_k").limit(sample).distinct()  # `sample` digests at most
    some = keyed.join(F.broadcast(keys), "_k").groupBy("_k").agg(F.first("_body").alias("_body")).select(F.encode("_body", "UTF-8").alias("body"))

    def train(batches):
        import zstandard

        bodies = [x for b in batches for x in b.column("body").to_pylist() if x]
        if not bodies:
            return
        try:
            made = zstandard.train_dictionary(size, bodies).as_bytes()
        except zstandard.ZstdError:
            made = b"".join(bodies)[:size]
        yield pa.RecordBatch.from_pydict({"d": [made]})

    rows = some.coalesce(1).mapInArrow(train, "d binary").collect()
    return bytes(rows[0].d) if rows else b""


def _dictionary(raw: bytes):
    import zstandard

    if not raw:
        return None
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if raw[:4] == DICT_MAGIC else zstandard.DICT_TYPE_RAWCONTENT)


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {copy} {digest}')}>"


def _framed(head: list[str], payload: bytes) -> bytes:
    head = [*head, f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def warcinfo(name: str, date: str) -> bytes:
    """The record that describes a file."""
    body = b"software: plumbline\r\nformat: WARC File Format 1.1\r\n"
    own = uuid.uuid5(uuid.NAMESPACE_URL, name)
    return _framed(["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{own}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], body)


def record(page_id: int | None, url: str, html: str, refers_to: int | None, copy: int = 0, date: str = DATE) -> bytes:
    """A WARC/1.1 record. An address with characters that a header can't hold is percent-encoded; X-Target-URI has it as it was."""
    payload = html.encode()
    digest = base32_sha1(payload)
    safe = quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest, copy)}", f"WARC-Date: {date}", f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8", f"X-Payload-Length: {len(payload)}"]
    head += [f"X-Page-ID: {page_id}"] * (page_id is not None) + [f"X-Target-URI: {json.dumps(url)}"] * (safe != url)
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
        payload = b""
    return _framed(head, payload)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def write_archives(pages: DataFrame, dest: str, level: int = 3, min_bytes: int = 0, dictionary: bytes | None = None, date: str = DATE) -> DataFrame:
    """Writes a .warc.zst file per task below the URI dest; returns the manifest (path, n_records, n_bytes). date: WARC-Date of all records.

    A file gets the name of its attempt, and only files of tasks that succeeded enter the manifest.
    """
    spark = pages.sparkSession
    raw = train_dictionary(pages) if dictionary is None else dictionary

    def write(batches):
        import zstandard
        from pyspark import TaskContext

        fs, folder = file_system(dest)
        out, n, size, name = None, 0, 0, f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc.zst"
        packer = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(raw))
        for rows in text_slices(batches, ["page_id", "url", "refers_to", "copy"], "html"):
            if out is None:
                fs.create_dir(folder, recursive=True)
                out = fs.open_output_stream(f"{folder}/{name}")
                size += out.write(struct.pack("<II", MAGIC, len(raw)) + raw) or 0
                frame = packer.compress(warcinfo(name, date))
                out.write(frame)
                size += len(frame)
            for x in zip(rows["page_id"], rows["url"], rows["html"], rows["refers_to"], rows["copy"], strict=True):
                frame = packer.compress(record(*x, date))
                out.write(frame)
                n, size = n + 1, size + len(frame)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "n_records": [n], "n_bytes": [size]}, pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    made = _numbered(with_originals(pages, min_bytes)).mapInArrow(write, "path string, n_records long, n_bytes long")
    made.write.parquet(f"{dest}/manifest")
    return spark.read.schema(made.schema).parquet(f"{dest}/manifest")


def frames(stream, chunk: int = 1 << 20):
    """The records of one archive, each decompressed by itself; reads the stream in pieces."""
    import zstandard

    magic, length = struct.unpack("<II", stream.read(8))
    if magic != MAGIC:
        raise ValueError("the archive has no dictionary frame")
    unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(stream.read(length)))
    held, one, got = b"", None, []
    while True:
        if not held and not (held := stream.read(chunk)):
            break
        one = one or unpacker.decompressobj()
        got.append(one.decompress(held))
        held = b""
        if one.eof:
            yield b"".join(got)
            held, one, got = one.unused_data, None, []
    if one is not None:
        raise ValueError("the archive ends inside a record")


def read_archives(spark: SparkSession, dest: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives that the manifest names: page_id, url, record_type, payload_bytes, payload_digest,
    refers_to, and the payload if asked for (null on revisits). A response's size and digest are taken from the payload
    that was read, and must agree with its header."""
    manifest = spark.read.parquet(f"{dest}/manifest")
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload
    schema = pa.schema(fields)

    def read(batches):
        fs, folder = file_system(dest)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{folder}/{path}") as f:
                    for raw in frames(f):
                        head, payload = parse(raw)
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        number = lambda k: int(head[k]) if k in head else None
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = head["WARC-Type"] == "response"
                        if response and (base32_sha1(payload) != digest or len(payload) != number("X-Payload-Length")):
                            raise ValueError(f"a record of {path} doesn't match its digest")
                        rows.append([number("X-Page-ID"), json.loads(head["X-Target-URI"]) if "X-Target-URI" in head else head["WARC-Target-URI"], head["WARC-Type"], len(payload) if response else number("X-Payload-Length"), digest, number("X-Refers-To-Page-ID")] + [payload if response else None] * with_payload)
                        size += len(raw)
                        if len(rows) == 2000 or size > 8_000_000 and with_payload:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=schema)

    n = max(1, manifest.count())
    out = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload
    return manifest.repartitionByRange(n, "path").mapInArrow(read, out)
