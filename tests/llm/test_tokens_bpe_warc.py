import random
import re
import zlib

import public_tokenizers as P
import pytest

from plumbline.llm import bpe, tokens, warc
from plumbline.llm.chunks import chunks
from plumbline.llm.common import file_system, scratch

ODD = ["", "a", " ", "  ", "a  b", "a   b \n c", "tab\t x", " lead", "trail ", "trail  ", "x\n\n  y", "don't  it's", "naïve Ünïcödé 漢字 🙂🙂", "\x1c \x85 y", "1234 5678", "!! ## <|endoftext|>", "<|endoftext|>", "a <|endoftext|> b\n<|endoftext|>.", "<|endoftext|> <|endoftext|>x", "ab" * 300, "　 x", "\n a", "a \nb"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice("ab é\n\t '.1漢A") for _ in range(rng.randint(1, 60))) for _ in range(300)] + [" ".join(rng.choice(["the", "thing", "ofthis,", "Ön.", "x\ny"]) for _ in range(400))]


def test_chunks_join(texts):
    assert all("".join(chunks(x)) == x for x in texts)


def test_token_files_round_trip(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)] + [(None, None, "z")], "doc_id long, text string, part string")
    for width, end in ((2, 0), (4, 50256)):
        dest = scratch(spark, "t")
        tokens.write_token_files(docs.repartition(3), dest, P.path("byte_bpe_50k.json"), end, width)
        got = {r.doc_id: r for r in tokens.read_token_files(spark, dest, with_ids=True).collect()}
        start = 1
        assert got[None].start == 0 and got[None].ids == [end]
        for i, x in enumerate(texts):
            ids = [*t.encode(x, add_special_tokens=False).ids, end]
            assert (got[i].ids, got[i].start, got[i].n_tokens) == (ids, start, len(ids))
            assert got[i].ids_crc32 == zlib.crc32(b"".join(k.to_bytes(4, "little") for k in ids))
            start += len(ids)
    r = spark.read.parquet(f"{dest}/manifest").orderBy("part").first()
    part = tokens.TokenPart(f"{dest.removeprefix('file://')}/{r.stem}", 4)
    assert part[0].tolist() == [50256] and len(part) == r.n_docs
    dest = scratch(spark, "t")
    tokens.write_token_files(docs.limit(0), dest, P.path("byte_bpe_50k.json"))
    assert tokens.read_token_files(spark, dest).count() == 0


def test_bpe_equals_tiktoken(spark, texts):
    import base64

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own, special_tokens={})
    docs = spark.createDataFrame([(i, x, 7) for i, x in enumerate(texts)] + [(None, None, 7)], "doc_id long, text string, ids int")
    got = bpe.decode(bpe.encode(docs, path, P.PATTERN), path).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r.ids == ref.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "")
    assert bpe.digests(docs.limit(0), path, P.PATTERN).count() == 0


def test_archives_round_trip(spark):
    rows = [(5, "http://a", "<p>x</p>"), (3, "http://b", "<p>x</p>"), (4, None, None), (9, "u\r\nX: y", ""), (None, "n", "<p>x</p>"), (7, "http://c", "é\r\n\r\nlong" * 5000), (8, "d", "only"), (3, "http://b", "<p>x</p>")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to int")
    dest = scratch(spark, "w")
    warc.write_archives(pages, dest)
    got = warc.read_archives(spark, dest, with_payload=True).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert (by[5].record_type, by[5].refers_to, by[5].payload) == ("revisit", 3, None)
    assert (by[None].record_type, by[None].refers_to) == ("revisit", 3)
    assert [r.record_type for r in got if r.page_id == 3] == ["response"] * 2
    assert (by[9].refers_to, by[4].record_type, by[4].payload_bytes) == (4, "response", 0)
    assert bytes(by[7].payload).decode() == rows[5][2] and by[7].payload_digest == warc.base32_sha1(rows[5][2].encode())
    assert by[5].payload_bytes == 8 and by[5].payload_digest == by[3].payload_digest
    assert by[9].url == "u\r\nX: y" and by[5].url == "http://a"
    heads, (files, folder) = [], file_system(dest)
    for x in spark.read.parquet(f"{dest}/manifest").collect():
        with files.open_input_stream(f"{folder}/{x.path}") as f:
            own = [warc.parse(raw)[0] for raw in warc.frames(f)]
        assert own[0]["WARC-Type"] == "warcinfo" and own[0]["WARC-Filename"] == x.path and all(h["WARC-Type"] != "warcinfo" for h in own[1:])
        heads += own
    ids = [h["WARC-Record-ID"] for h in heads]
    assert len(set(ids)) == len(ids) and all(h["WARC-Date"] == warc.DATE for h in heads)
    assert all(h["WARC-Refers-To"] in ids for h in heads if h["WARC-Type"] == "revisit") and all("\r" not in h.get("WARC-Target-URI", "") for h in heads)
    dest = scratch(spark, "w")
    warc.write_archives(pages.limit(0), dest)
    assert warc.read_archives(spark, dest).count() == 0


def test_pages_that_share_an_id(spark):
    """Unequal payloads under one page_id, and equal ones, against plain grouping."""
    rows = [(i % 7, f"http://h/{i}", f"<p>{i % 5}</p>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    dest = scratch(spark, "w")
    warc.write_archives(pages, dest)
    got = {r.url: r for r in warc.read_archives(spark, dest, with_payload=True).collect()}
    assert len(got) == len(rows)
    for i, url, text in rows:
        first = min(j for j, _, x in rows if x == text)
        assert (got[url].page_id, got[url].record_type, got[url].refers_to) == (i, "response" if i == first else "revisit", None if i == first else first)
        assert got[url].payload_digest == warc.base32_sha1(text.encode())


def test_records_bear_the_date_of_the_run():
    date = warc.now()
    assert re.fullmatch(r"20\d\d-\d\d-\d\dT\d\d:\d\d:\d\dZ", date)
    fields, payload = warc.parse(warc.record(7, "https://example.org/", "<p>x</p>", None, date=date))
    assert fields["WARC-Date"] == date and payload == b"<p>x</p>"
