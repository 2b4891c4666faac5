"""Object stores through Spark's own connectors: listings, immutable puts, deletes, JSON metrics."""

from __future__ import annotations

import contextlib
import ctypes
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, StringStartsWith

from pathledger.functions import paths
from pathledger.runtime import cut_lineage



class Below(InputPartition):
    """Keys below a folder, or (shallow) the files right in it."""

    def __init__(self, folder: str, shallow: bool):
        self.folder, self.shallow = folder, shallow


class ListingReader(DataSourceReader):
    """One partition for each folder next below the prefix's own, so that large stores are listed by many tasks."""

    def __init__(self, top: str, prefix: str = ""):
        self.top, self.prefix = top.rstrip("/"), prefix

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("key",) and f.value.startswith(self.prefix):
                self.prefix = f.value
            yield f  # Spark checks it again: a folder's listing may hold more

    def store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.top) if "://" in self.top else (fs.LocalFileSystem(), self.top)

    def partitions(self) -> list[Below]:
        from pyarrow import fs

        files, top = self.store()
        own = f"{top}/{self.prefix.rpartition('/')[0]}".rstrip("/")
        found = files.get_file_info(fs.FileSelector(own, allow_not_found=True))
        below = [x.path for x in found if x.type == fs.FileType.Directory and x.path[len(top) + 1 :].startswith(self.prefix)]
        return [Below(own, True), *(Below(x, False) for x in sorted(below))]

    def read(self, partition: Below):
        from pyarrow import fs

        files, top = self.store()
        for x in files.get_file_info(fs.FileSelector(partition.folder, allow_not_found=True, recursive=not partition.shallow)):
            key = x.path[len(top) + 1 :]
            if x.type == fs.FileType.File and key.startswith(self.prefix):
                yield key, int(x.mtime_ns // 10**9) if x.mtime_ns is not None else None, x.size


class ObjectListing(DataSource):
    """key, mtime (seconds, null if unknown), size of a store's objects."""

    @classmethod
    def name(cls) -> str:
        return "pathledger_objects"

    def schema(self) -> str:
        return "key string, mtime bigint, size bigint"

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"])


METRICS_SCHEMA = (
    "space_id string, commits bigint, pulls_applied bigint, conflicts bigint, feed_errors bigint, stale_alerts bigint, started_at bigint, last_head_seen bigint, "
    "last_commit bigint, quarantines bigint, quarantined boolean, last_quarantine bigint, last_quarantine_error string"
)


def walk(spark: SparkSession, folder: str, glob: str | None = None, content: bool = False) -> DataFrame:
    """Files below a folder: p, sz, mtime and, if asked, content. Without it the bytes are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    top = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/") + "/"
    p = F.expr(f"substring(path, instr(path, '{top}') + {len(top)})")
    return raw.select(p.alias("p"), F.col("length").alias("sz"), F.unix_seconds("modificationTime").alias("mtime"), *(["content"] if content else []))


def listing(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """key, mtime, size of objects whose key starts with the prefix, empty ones too. Only the folders that it leads into are
    listed, and so with any later filter on key.startswith(): Spark hands it to the source, which the session is told to allow."""
    spark.dataSource.register(ObjectListing)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(ObjectListing.name()).load(folder).filter(F.col("key").startswith(prefix))


def put(blobs: DataFrame, folder: str) -> int:
    """Append objects (key, body) that the store lacks; returns how many. Keys are checked before anything is written."""
    spark = blobs.sparkSession
    bad = blobs.filter(~paths.valid_object_key(F.col("key"))).limit(1).count()
    if bad:
        raise ValueError("unsafe object key")
    fresh = blobs.select("key", "body").dropDuplicates(["key"])
    store = spark._jvm.org.apache.hadoop.fs.Path(folder)
    born = 0
    if store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store):
        fresh = fresh.join(stored(spark, folder).select("key"), "key", "left_anti")
        born = spark.read.schema("born bigint").parquet(folder).agg(F.coalesce(F.max("born"), F.lit(-1))).first()[0] + 1
    fresh = cut_lineage(fresh)
    fresh.select("key", "body", F.lit(born).cast("bigint").alias("born"), F.substring(F.sha2("key", 256), 1, 2).alias("shard")).write.mode("append").partitionBy("shard").parquet(folder)
    return fresh.count()


def get(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """Bodies of the keys asked for; the shard makes Spark skip the other folders."""
    want = keys.select("key").distinct().withColumn("shard", F.substring(F.sha2("key", 256), 1, 2))
    return stored(spark, folder).join(want, ["shard", "key"], "left_semi").select("key", "body")


def remaining(store: DataFrame, doomed: DataFrame) -> DataFrame:
    """The store without the doomed keys, for a rewrite; deleting twice is the same as once."""
    return store.join(doomed.select("key").distinct(), "key", "left_anti")


def save_metrics(metrics: DataFrame, folder: str) -> None:
    """feed.space_metrics() as one JSON object a line; times that never were are left out."""
    metrics.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(folder)


def load_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Counters that a line lacks are zero, times that it lacks null; a broken line is a row of defaults and a folder that isn't
    there an empty table: metrics must never stop the work they are about."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], METRICS_SCHEMA)
    raw = spark.read.text(folder).select(F.from_json("value", METRICS_SCHEMA).alias("m")).select("m.*")
    return raw.fillna(0, ["commits", "pulls_applied", "conflicts", "feed_errors", "stale_alerts", "quarantines"]).fillna(False, ["quarantined"])


TOMBS = "_tombstones"


def bury(keys: DataFrame, folder: str) -> int:
    """Delete objects by a tombstone each, in one job: what readers see is gone when the job commits, all of it or nothing.
    Keys that aren't stored are passed over; returns how many objects went. compact() drops their bytes."""
    spark = keys.sparkSession
    doomed = stored(spark, folder).select("key", "born").join(keys.select("key").distinct(), "key", "left_semi")
    doomed = cut_lineage(doomed)
    doomed.select("key", F.col("born").alias("buried")).write.mode("append").parquet(f"{folder}/{TOMBS}")
    return doomed.count()


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """key, body, born, shard of the objects that no tombstone has met; one that was put again after its burial lives."""
    body = spark.read.parquet(folder).schema["body"].dataType.simpleString()
    rows = spark.read.schema(f"key string, body {body}, born bigint, shard string").parquet(folder)  # two digits are no number
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{TOMBS}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return rows
    last = spark.read.schema("key string, buried bigint").parquet(f"{folder}/{TOMBS}").groupBy("key").agg(F.max("buried").alias("buried"))
    return rows.join(last, "key", "left").filter("buried is null or born > buried").select("key", "body", "born", "shard")


def compact(spark: SparkSession, folder: str, to: str) -> None:
    """The living objects as a store of their own."""
    stored(spark, folder).write.partitionBy("shard").parquet(to)


def place(root: str, p: str) -> str:
    """Where a path lies below root, with the folders above it made; a folder on the way that is a link is an error."""
    to = root
    for part in p.split("/")[:-1]:
        to = os.path.join(to, part)
        if os.path.islink(to):
            raise ValueError(f"{p}: a parent is a link")
    if not os.path.isdir(to):
        os.makedirs(to, exist_ok=True)
    return os.path.join(to, p.split("/")[-1])


AT_ONCE, BYTES_AT_ONCE = 256, 1 << 26
#: ext, xfs, btrfs, nfs: syncfs() of these waits until all files are on the disk, and reports those that failed since Linux 5.8.
SYNCED_WHOLE = {0xEF53, 0x58465342, 0x9123683E, 0x6969}


def synced_whole(f) -> bool:
    """Whether syncfs() says as much as an fsync() of each file."""
    libc, told = ctypes.CDLL(None), (ctypes.c_long * 64)()
    if not hasattr(libc, "syncfs") or [int(x) for x in os.uname().release.split("-")[0].split(".")[:2]] < [5, 8]:
        return False
    return libc.fstatfs(f.fileno(), told) == 0 and told[0] in SYNCED_WHOLE


def flush(files: list) -> None:
    """The bytes of open files are on the disk: by one call for each file system, or else by one for each file, all of them begun before any is waited for."""
    stores: dict[int, list] = {}
    for f in files:
        f.flush()
        stores.setdefault(os.fstat(f.fileno()).st_dev, []).append(f)
    for of in stores.values():
        if len(of) > 1 and synced_whole(of[0]):
            libc = ctypes.CDLL(None, use_errno=True)
            if libc.syncfs(of[0].fileno()):  # opened before any was written, so it is told of their failures
                raise OSError(ctypes.get_errno(), os.strerror(ctypes.get_errno()))
            continue
        for f in of:
            os.posix_fadvise(f.fileno(), 0, 0, os.POSIX_FADV_DONTNEED)
        for f in of:
            os.fsync(f.fileno())


class Landing:
    """Files and links that are written under temporary names, and renamed when all their bytes are on the disk: AT_ONCE of them, or
    what comes to BYTES_AT_ONCE, at a time.

    A disk commits some hundred files in hardly more time than one, so it isn't waited for at each. Renames keep the order of
    writing. After an error what hasn't been renamed goes. over_folders: an empty folder gives way, else it is an error.
    """

    def __init__(self, over_folders: bool = False):
        self.over_folders, self.mark, self.n, self.size = over_folders, uuid.uuid4().hex, 0, 0
        self.waiting: list[tuple] = []  # (open file or None, temporary name, name)

    def __enter__(self) -> Landing:
        return self

    def aside(self, to: str) -> str:
        """A temporary name beside `to`; what waits lands before if it is enough."""
        if self.waiting and self.waiting[-1][0]:
            self.size += self.waiting[-1][0].tell()
        if len(self.waiting) >= AT_ONCE or self.size >= BYTES_AT_ONCE:
            self.land()
        self.n += 1
        return os.path.join(os.path.dirname(to), f".{os.path.basename(to)}.{self.mark}{self.n:x}.ft-tmp")

    def file(self, to: str, x: bool):
        """An open file that will be `to`. It must be complete when the next is asked for, and isn't to be closed."""
        aside = self.aside(to)
        self.waiting.append((open(aside, "wb"), aside, to))
        f = self.waiting[-1][0]
        os.fchmod(f.fileno(), 0o755 if x else 0o644)
        return f

    def link(self, to: str, target: str) -> None:
        aside = self.aside(to)
        os.symlink(target, aside)
        self.waiting.append((None, aside, to))

    def land(self) -> None:
        flush([f for f, _, _ in self.waiting if f])
        while self.waiting:
            f, aside, to = self.waiting[0]
            try:
                os.replace(aside, to)
            except IsADirectoryError:
                if not self.over_folders:
                    raise
                os.rmdir(to)  # fails where it isn't empty
                os.replace(aside, to)
            self.waiting.pop(0)
            if f:
                f.close()
        self.size = 0

    def __exit__(self, kind, *_) -> None:
        try:
            if kind is None:
                self.land()
        finally:
            for f, aside, _ in self.waiting:
                with contextlib.suppress(OSError):
                    os.remove(aside)
                with contextlib.suppress(OSError):
                    if f:
                        f.close()


def materialize(entries: DataFrame, folder: str) -> None:
    """Write entries (p, t, x, lt, content) below a shared local folder: folders, files with their exec bit, links.

    Files go to a temporary name, then are renamed; what lies there already is replaced unless it is a folder with content. Nothing is
    written through a link: a parent that is one is an error, as is an untrusted path, before anything is written.
    Derived entries (type 2) are left out. A retry repeats harmlessly.
    """

    def write(rows):
        with Landing(over_folders=True) as landing:
            for r in rows:
                to = place(folder, r.p)
                if r.t == 3:
                    if os.path.lexists(to) and (os.path.islink(to) or not os.path.isdir(to)):
                        os.remove(to)
                    os.makedirs(to, exist_ok=True)
                elif r.t == 1:
                    landing.link(to, r.lt)
                else:
                    landing.file(to, r.x).write(r.content or b"")

    bad = entries.filter(~paths.is_trusted(F.col("p"))).limit(1).count()
    if bad:
        raise ValueError("untrusted path")
    rows = entries.filter("t <> 2").select("p", "t", "x", "lt", "content")
    rows.filter("t = 3").foreachPartition(write)  # folders first, so that no file takes a folder's name
    rows.filter("t <> 3").foreachPartition(write)


def walk_tree(spark: SparkSession, folder: str, ignore: list[str] | None = None, control: str = ".pathledger") -> DataFrame:
    """p, is_dir, is_symlink, lt, x, sz, mtime, route of everything below a shared local folder; links aren't followed.

    One round per level: the folders of a level are listed by tasks, and only those that snapshot.scan() routes as items are
    entered, so ignored, derived and control folders cost one row. Folders that can't be listed have route `unreadable`.
    """
    from pathledger.operators.snapshot import scan  # noqa: PLC0415

    schema = "p string, is_dir boolean, is_symlink boolean, lt string, x boolean, sz bigint, mtime bigint, readable boolean"

    def look(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for p in pdf.p:
                try:
                    with os.scandir(os.path.join(folder, p)) as found:
                        for e in found:
                            st, link = e.stat(follow_symlinks=False), e.is_symlink()
                            is_dir = e.is_dir(follow_symlinks=False)
                            if link or is_dir or e.is_file(follow_symlinks=False):  # no sockets, pipes, devices
                                rows.append((f"{p}/{e.name}".lstrip("/"), is_dir, link, os.readlink(e.path) if link else None, bool(st.st_mode & 0o100) and not is_dir and not link, st.st_size, int(st.st_mtime), True))
                except OSError:
                    rows.append((p, True, False, None, False, 0, 0, False))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"sz": "int64", "mtime": "int64"})

    now, out = spark.createDataFrame([("",)], "p string"), None
    while True:
        seen = scan(now.mapInPandas(look, schema).filter(F.col("p") != control), ignore or [])
        seen = cut_lineage(seen.withColumn("route", F.when(~F.col("readable"), "unreadable").otherwise(F.col("route"))))
        out = seen if out is None else out.unionByName(seen)
        now = seen.filter("is_dir and readable and route = 'item'").select("p")
        if now.isEmpty():
            return out.drop("readable")
        now = now.repartition(spark.sparkContext.defaultParallelism)


def dumps(metrics: dict) -> str:
    return json.dumps(metrics, indent=2, sort_keys=True)
