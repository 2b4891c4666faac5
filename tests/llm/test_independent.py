"""Archives read by a parser of their own, shards against a plain sum, and columns of clashing names."""

import base64
import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pathledger.llm import sharding, spotsigs, suffix_dedup, warc


def members(data: bytes):
    """The gzip members of a file: a record must stand alone in one."""
    while data:
        z = zlib.decompressobj(31)
        yield z.decompress(data) + z.flush()
        data = z.unused_data


def parsed(record: bytes):
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("ascii").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    assert version == "WARC/1.1" and len(fields) == len(lines)
    block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    assert end == b"\r\n\r\n"
    http, _, payload = block.partition(b"\r\n\r\n")
    status, *inner = http.decode("ascii").split("\r\n")
    assert status == "HTTP/1.1 200 OK"
    return fields, block, dict(x.split(": ", 1) for x in inner), payload


def test_archives_by_another_parser(spark, tmp_path):
    """Every record once, alone in its gzip member, with digests and lengths that hold; revisits lead to the response's record."""
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    r = random.Random(4)
    bodies = ["<p>é</p>", "", None, "x\r\n\r\ny", "same", "z" * 70_000]
    pages = {i: (f"http://h/{i}?ü\r\n" if i % 7 else None, r.choice(bodies)) for i in range(0, 300, 3)}
    df = spark.createDataFrame([(i, *v) for i, v in pages.items()], "page_id bigint, url string, html string")
    df = df.select("*", *(F.lit("x").alias(c) for c in ("bin", "sha", "ref", "kind", "shard", "size")))
    manifest = {m.file: m for m in warc.write_warc(df, f"file://{tmp_path}/w", shards=4, roll_bytes=2000).collect()}
    files = sorted((tmp_path / "w").glob("*.warc.gz"))
    assert sorted(manifest) == [f.name for f in files] and len(files) > 4
    seen, order, ids = {}, [], {}
    for f in files:
        data = f.read_bytes()
        own = [parsed(m) for m in members(data)]
        assert (manifest[f.name].records, manifest[f.name].bytes, manifest[f.name].sha256) == (len(own), len(data), hashlib.sha256(data).hexdigest())
        assert len(gzip.decompress(data)) == sum(map(len, members(data)))
        for fields, block, inner, payload in own:
            page = int(fields["X-Page-Id"])
            order.append(page)
            seen[page] = (fields, payload)
            ids[fields["WARC-Record-ID"]] = page
            assert fields["WARC-Block-Digest"] == sha1(block)
            want = (pages[page][1] or "").encode()
            assert fields["WARC-Payload-Digest"] == sha1(want) and int(inner["Content-Length"]) == len(want)
            assert payload == (want if fields["WARC-Type"] == "response" else b"")
    assert order == sorted(pages) and len(ids) == len(pages)
    last = {}
    for page, (_, html) in pages.items():
        last[html or ""] = max(page, last.get(html or "", -1))
    for page, (fields, _) in seen.items():
        first = last[pages[page][1] or ""]
        assert fields["WARC-Type"] == ("response" if page == first else "revisit")
        if page != first:
            assert ids[fields["WARC-Refers-To"]] == first


@pytest.mark.parametrize("shards, n", [(16, 400), (3, 7), (5, 3)])
def test_shards_against_plain_sums(spark, shards, n):
    r = random.Random(n)
    rows = [(i * i % 10_007 - 50, r.choice([None, "", "é" * r.randint(1, 300), "x" * r.randint(1, 90)])) for i in range(n)]
    rows = list({i: (i, t) for i, t in rows}.values())
    size = lambda t: len((t or "").encode()) + 1
    total, start, want, slots = sum(size(t) for _, t in rows), 0, {}, {}
    for i, t in sorted(rows):
        shard = min(start * shards // total, shards - 1)
        want[i] = (size(t), zlib.crc32((t or "").encode()), shard, slots.get(shard, 0))
        slots[shard] = slots.get(shard, 0) + 1
        start += size(t)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", *(F.lit("x").alias(c) for c in ("task", "bin", "part", "bytes", "n", "start", "rank", "shard")))
    got = {x.doc_id: (x.size, x.text_crc32, x.shard, x.slot) for x in sharding.shard_by_bytes(df, shards, bins=8).collect()}
    assert got == want


def test_columns_of_clashing_names(spark):
    rows = [(i, ("the quick brown fox jumps over the lazy dog " * 9)[i % 3 :]) for i in range(6)]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string")
    clash = plain.select("*", *(F.lit("x").alias(c) for c in ("h", "starts", "open", "packed", "bucket", "start", "n", "key", "shard", "bin", "tail", "near_group", "component_id", "message")))
    for op in (suffix_dedup.dedup, spotsigs.fingerprint_with_edit):
        assert sorted(map(str, op(clash).collect())) == sorted(map(str, op(plain).collect()))
