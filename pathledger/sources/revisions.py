"""The revision log as a stream: a Python data source over `<folder>/<space>/<seq>`, and a sink that commits each batch once."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from pathledger.operators import revlog

#: Revisions that one task reads.
RANGE = revlog.WINDOW


class Revisions(InputPartition):
    def __init__(self, space: str, low: int, high: int):
        self.space, self.low, self.high = space, low, high


class RevisionReader(DataSourceStreamReader):
    """Offsets: the next seq of each space. A space's files are listed once; later only the names that may follow are asked for."""

    def __init__(self, folder: str, start: str):
        self.folder, self.start = folder, start
        self.seen: dict[str, int] = {}

    def store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)

    def heads(self) -> dict[str, int]:
        """Each space's next seq."""
        from pyarrow import fs

        files, top = self.store()
        for space in files.get_file_info(fs.FileSelector(top, allow_not_found=True)):
            name = space.base_name
            if space.type != fs.FileType.Directory or name.startswith(("_", ".")):
                continue
            if name not in self.seen:
                have = [int(x.base_name) for x in files.get_file_info(fs.FileSelector(space.path)) if x.base_name.isdigit()]
                self.seen[name] = max(have, default=-1) + 1
            else:
                while files.get_file_info(f"{space.path}/{self.seen[name]}").type == fs.FileType.File:
                    self.seen[name] += 1
        return {k: v for k, v in self.seen.items() if v}

    def initialOffset(self) -> dict:  # noqa: N802
        return {s: n - 1 for s, n in self.heads().items()} if self.start == "head" else {}

    def latestOffset(self) -> dict:  # noqa: N802
        return self.heads()

    def partitions(self, start: dict, end: dict) -> list[Revisions]:
        """A first batch that is repeated after the head has moved finds its start behind its end: it was the end's head."""
        out = []
        for space, high in sorted(end.items()):
            low = start.get(space, 0)
            low = high - 1 if low > high else low
            out += [Revisions(space, k, min(k + RANGE, high)) for k in range(low, high, RANGE)]
        return out

    def read(self, partition: Revisions) -> Iterator[tuple]:
        files, top = self.store()
        for seq in range(partition.low, partition.high):
            with files.open_input_stream(f"{top}/{partition.space}/{seq}") as f:
                yield partition.space, seq, f.read()

    def commit(self, end: dict) -> None:
        pass


class RevisionFeed(DataSource):
    """space_id, seq, payload of revisions. Options: path, and `start`: head (each space's newest first, then all that follow) or all.

    A space that appears later is read from its first revision. Restarts go on where the checkpoint ended; nothing is lost or repeated.
    """

    @classmethod
    def name(cls) -> str:
        return "pathledger_revisions"

    def schema(self) -> str:
        return "space_id string, seq bigint, payload binary"

    def streamReader(self, schema) -> RevisionReader:  # noqa: N802
        start = self.options.get("start", "head")
        if start not in ("head", "all"):
            raise ValueError("start is head or all")
        return RevisionReader(self.options["path"].rstrip("/"), start)


def revision_stream(spark: SparkSession, folder: str, start: str = "head") -> DataFrame:
    spark.dataSource.register(RevisionFeed)
    return spark.readStream.format(RevisionFeed.name()).option("start", start).load(folder)


def head(spark: SparkSession, folder: str, space: str) -> int | None:
    """A space's newest seq; None if it has no revision."""
    return revlog.head(spark, folder, space)


def newest(spark: SparkSession, folder: str, space: str) -> tuple[int | None, dict]:
    """(head, its content) of a space whose revisions hold JSON."""
    seq = head(spark, folder, space)
    if seq is None:
        return None, {}
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{space}/{seq}")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return seq, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def committing_sink(spark: SparkSession, folder: str, space: str, query: str, attempts: int = revlog.MOST_ATTEMPTS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch becomes one revision of the space, whatever is killed and repeated.

    The batch's rows are staged under a name of (query, batch), which a repetition overwrites; then the head moves by
    compare-and-swap. Each revision carries the last batch of every query (`applied`), so that the head alone tells whether a
    batch is in. Of writers that race for a seq one wins, and the others look at the new head.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        for _ in range(attempts):
            at, content = newest(spark, folder, space)
            applied = content.get("applied", {})
            if applied.get(query, -1) >= batch_id:
                return
            data = f"{folder}/{space}/_data/{query}-{batch_id}"
            batch.write.mode("overwrite").parquet(data)
            body = {"query": query, "batch": batch_id, "data": data, "applied": applied | {query: batch_id}}
            if revlog.commit(spark, folder, space, at, json.dumps(body, sort_keys=True).encode()) is not None:
                return
        raise RuntimeError(f"{space}: {attempts} attempts lost the race")

    return sink
