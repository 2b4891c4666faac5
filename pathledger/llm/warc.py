"""Deterministic sharded WARC archives: range-sorted records, files rolled by compressed size, temporary names, manifest."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathledger.llm.common import balanced_cuts, checkpoint_dir, cut_lineage, id_bins, partitions

ROLL_BYTES = 64 << 20
#: Payload of a shard, which one task writes; there are at least as many shards as shuffle partitions.
SHARD_BYTES = 256 << 20
# Fixed value: the date in every record, so that equal input gives equal bytes.
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "file string, shard int, sequence int, records bigint, bytes bigint, sha256 string"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """Executors and driver reach the shared folder by its own scheme."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    if "://" not in folder:
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri(folder.replace("s3a://", "s3://").rstrip("/"))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{payload_digest}')}>"


def clean(value: str) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member with regenerated headers and digests."""
    d = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, d)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean(url or f'urn:page:{page_id}')}", f"WARC-Payload-Digest: sha1:{d}", f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, d)}", f"X-Refers-To-Page-Id: {refers_to}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


class Archive:
    """Files of one shard: written under a name of this attempt, moved to the final one when whole."""

    def __init__(self, folder: str, shard: int, roll: int):
        (self.fs, self.path), self.shard, self.roll, self.sequence, self.out = filesystem(folder), shard, roll, 0, None

    def add(self, data: bytes) -> dict | None:
        if self.out is None:
            self.fs.create_dir(self.path, recursive=True)
            self.temp = f"{self.path}/_temp-{uuid.uuid4().hex}"
            self.out, self.n, self.size, self.hash = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.hash.update(data)
        self.n, self.size = self.n + 1, self.size + len(data)
        return self.close() if self.size >= self.roll else None

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        name = f"part-{self.shard:05d}-{self.sequence:05d}.warc.gz"
        self.fs.move(self.temp, f"{self.path}/{name}")  # another attempt writes the same bytes
        done = {"file": name, "shard": self.shard, "sequence": self.sequence, "records": self.n, "bytes": self.size, "sha256": self.hash.hexdigest()}
        self.out, self.sequence = None, self.sequence + 1
        return done


def _writer(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, archive, made, page, marks, seen = None, None, [], object(), {}, set()
        for batch in batches:
            cols = [batch.column(i) for i in range(7)]
            for k in range(batch.num_rows):
                s, p, kind, url, html, sha, ref = (c[k].as_py() for c in cols)
                if s != shard:
                    made += [archive.close()] if archive else []
                    shard, archive, page = s, Archive(folder, s, roll), object()
                if p != page:
                    page, marks, seen = p, {}, set()
                if kind == 0:
                    marks[sha] = ref
                    continue
                revisit = sha in marks and (marks[sha] != p or sha in seen)
                seen.add(sha)
                made.append(archive.add(record(p, url, (html or "").encode(), marks.get(sha), revisit)))
        made += [archive.close()] if archive else []
        rows = [m for m in made if m]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("shard", pa.int32()), ("sequence", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    return run


def write_warc(pages: DataFrame, folder: str, *, shards: int | None = None, roll_bytes: int = ROLL_BYTES, least_revisit_bytes: int = 0) -> DataFrame:
    """Write one record per row (page_id, url, html) below `folder` and return the manifest.

    Records lie in page_id order; shards are contiguous ranges of page_id of about equal payload bytes, derived
    from an exact histogram of page_id, so the same input gives the same files byte for byte. Of records with equal payloads
    of at least `least_revisit_bytes`, the one with the largest page_id is the response and the others are
    revisits; among repeated rows of that page_id the first is the response. Null html is an empty payload, a null
    url is named by the page, null page_ids come first. An empty table gives no files and an empty manifest.

    A task writes under names of its own and renames whole files, so a retry repeats harmlessly; `_MANIFEST.json`
    is written last and is the commit. Files without a manifest line don't belong to the archive.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    sha = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    narrow = cut_lineage(rows.select("page_id", sha.alias("sha"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("size")))
    add_bin, weights = id_bins(narrow, "page_id", F.col("size") + 300)
    shards = shards or max(partitions(spark), -(-sum(weights.values()) // SHARD_BYTES))
    cuts = spark.createDataFrame(list(balanced_cuts(weights, shards).items()) or [(0, 0)], "bin int, shard int")
    same = narrow.groupBy("sha").agg(F.max("page_id").alias("ref"), F.count("*").alias("n"), F.max("size").alias("size")).filter((F.col("n") > 1) & (F.col("size") >= least_revisit_bytes)).select("sha", "ref")
    marks = narrow.select("page_id", "sha").join(same, "sha").filter("ref is not null")
    none = F.lit(None).cast("string")
    both = rows.select("page_id", F.lit(1).alias("kind"), "url", "html", sha.alias("sha"), F.lit(None).cast("bigint").alias("ref")).unionByName(
        marks.select("page_id", F.lit(0).alias("kind"), none.alias("url"), none.alias("html"), "sha", "ref")
    )
    dealt = add_bin(both).join(F.broadcast(cuts), "bin").select("shard", "page_id", "kind", "url", "html", "sha", "ref")
    ranged = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "kind", "sha", "url")
    manifest = cut_lineage(ranged.mapInArrow(_writer(folder, roll_bytes), MANIFEST))
    commit(spark, folder, manifest)
    return manifest


def commit(spark: SparkSession, folder: str, manifest: DataFrame) -> None:
    """One line per file, in order, through a temporary name."""
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/_temp-manifest", compression=None) as out:
        for line in manifest.orderBy("shard", "sequence").toJSON().toLocalIterator():
            out.write(line.encode() + b"\n")
    fs.move(f"{path}/_temp-manifest", f"{path}/_MANIFEST.json")
    for left in fs.get_file_info(pafs.FileSelector(path)):  # of attempts that failed
        if left.base_name.startswith("_temp-"):
            fs.delete_file(left.path)


def members(stream) -> Iterator[bytes]:
    """Decompressed gzip members of a stream, one at a time."""
    z, parts = zlib.decompressobj(31), []
    while True:
        data = stream.read(1 << 20)
        if not data:
            break
        while data:
            parts.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts = zlib.decompressobj(31), []
            else:
                break
    if parts and any(parts):
        raise ValueError("truncated archive")


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda x: {k.lower(): v for k, _, v in (s.partition(": ") for s in x.decode().split("\r\n")[1:])}
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    if warc["warc-block-digest"] != "sha1:" + digest(block):
        raise ValueError(f"block digest of {warc['warc-record-id']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """Records of the manifest's files: page_id, payload_bytes, payload_digest, record_type, refers_to. Digests are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{path}/{file}", compression=None) as stream:
                    for data in members(stream):
                        warc, http, payload = parse(data)
                        d = warc["warc-payload-digest"].removeprefix("sha1:")
                        if warc["warc-type"] == "response" and digest(payload) != d:
                            raise ValueError(f"payload digest of {warc['warc-record-id']}")
                        page, ref = warc.get("x-page-id"), warc.get("x-refers-to-page-id")
                        rows.append((int(page) if page else None, int(http["content-length"]), d, warc["warc-type"], int(ref) if ref else None))
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    files = manifest.select("file", "bytes")
    return files.repartition(partitions(manifest.sparkSession), "file").select("file").mapInArrow(run, RECORDS)


def scratch(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
