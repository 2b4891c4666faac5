"""Files larger than a row: chunked from slices, all slices at once; written block by block.

A chunk's end hangs on its start and on the `most` bytes after it alone. Slices are put together to runs of some largest chunks.
Each run, with `most` bytes of what follows, is a function from a chunk start within it to the first chunk start behind it.
Starts that content can give are known beforehand: they follow the run's candidate cuts. The functions of all runs are made in
parallel and composed by doubling; where a chunk ends for another reason (a forced cut, or one just behind the least size) its
successor's function gets that start too. A file of one run is chunked at once: bytes are shuffled once for it, else twice, and
again for those runs alone that learn of a start.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathledger.functions import paths
from pathledger.functions.cdc import SOURCE_CODE, Cutter, Profile, gear_table
from pathledger.runtime import cut_lineage
from pathledger.sources import objects

SLICE = 1 << 20
#: A run has four times the bytes of a largest chunk, but not above this (or one largest chunk): what it is sent of its neighbours stays small beside it.
RUN = 1 << 20
#: Rounds in which runs learn of starts they hadn't known; files that need more, long stretches of one byte, are read in order.
ROUNDS = 6
#: Up to so many names of files or runs are broadcast, so that only the bytes they pick are shuffled.
MOST_SENT = 500_000
CHUNK = "file string, slice bigint, offset bigint, len bigint, cid string"
#: Edges have no chunk, and the chunks of files of one run no edge.
EDGE = f"{CHUNK}, start bigint, next bigint"
CHUNK_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())


def _per_run(profile: Profile, size: int) -> int:
    return math.ceil(min(4 * profile.most, max(profile.most, RUN)) / size)


def _with_context(slices: DataFrame, profile: Profile, size: int, per: int) -> DataFrame:
    """file, slice, nth, piece, start: the `per` slices of each run (nth 0, 1, ...), after the last 64 bytes before it (-1) and before the `most` bytes that follow (per, ...).

    From here on `slice` is the run's number.
    """
    run, nth = F.expr(f"slice div {per}"), (F.col("slice") % per).cast("int")
    row = lambda to, at, piece: F.struct(to.alias("slice"), at.alias("nth"), piece.alias("piece"))
    own = row(run, nth, F.col("bytes"))
    tail = F.when(nth == per - 1, row(run + 1, F.lit(-1), F.expr("substring(bytes, -64)")))
    left = F.lit(profile.most) - nth * size
    ahead = F.when((run > 0) & (left > 0), row(run - 1, nth + per, F.col("bytes").substr(F.lit(1), F.least(left, F.lit(size)))))
    sent = slices.select("file", F.explode(F.array_compact(F.array(own, tail, ahead))).alias("x")).select("file", "x.*")
    return sent.withColumn("start", F.lit(None).cast("bigint"))


def _groups(batches: Iterator[pa.RecordBatch], per: int) -> Iterator[tuple[str, int, bytes, int, int, list[int]]]:
    """(file, run, bytes, how many of them come before the run, the run's size, starts asked for)."""
    now, parts, starts = None, {}, []

    def done():
        if now is not None and 0 in parts:
            before = parts.get(-1, b"")
            yield *now, before + b"".join(parts[k] for k in sorted(parts) if k >= 0), len(before), sum(len(parts[k]) for k in parts if 0 <= k < per), starts

    for b in batches:
        for file, at, nth, piece, start in zip(*(b.column(i).to_pylist() for i in range(5))):
            if (file, at) != now:
                yield from done()
                now, parts, starts = (file, at), {}, []
            if start is None:
                parts[nth] = piece
            else:
                starts.append(start)
    yield from done()


def _walk(cutter: Cutter, data: bytes, start: int, stop: int, at_end: bool) -> Iterator[tuple[int, int]]:
    """(start, end) of chunks from `start` until one ends at `stop` or behind it."""
    while start < stop:
        left = len(data) - start if at_end else cutter.profile.most + 1
        end = start + cutter.size(start, left)
        yield start, end
        start = end


def _edges(gear: np.ndarray, profile: Profile, size: int, per: int):
    """From each start that a run's content can give (and those asked for) to the first start behind the run; of a file of one run, its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, at, data, before, own, asked in _groups(batches, per):
            cutter, stop, base = Cutter(data, gear, profile), before + own, at * per * size - before
            if at == 0 and stop == len(data):
                cols = _chunk_columns(file, at, data, base, _walk(cutter, data, 0, stop, True))
                yield pa.RecordBatch.from_arrays([*cols, *[pa.nulls(len(cols[0]), pa.int64())] * 2], names=EDGE.split()[::2])
                continue
            at_end = len(data) - stop < profile.most
            if asked:
                entries = {s - base for s in asked}
            else:
                cuts = np.union1d(cutter.strict, cutter.lax) + 1
                entries = set(cuts[(cuts >= before) & (cuts < stop)].tolist()) | ({before} if at == 0 else set())
            out: dict[int, int] = {}
            for s in sorted(entries, reverse=True):
                seen = []
                for a, b in _walk(cutter, data, s, stop, at_end):
                    seen.append(a)
                    if b in out:
                        b = out[b]
                    if b >= stop:
                        out.update(dict.fromkeys(seen, b))
                        break
            keep = sorted(entries)
            n = len(keep)
            cols = [pa.array([file] * n, pa.string()), pa.array([at] * n, pa.int64()), *(pa.nulls(n, t) for t in CHUNK_TYPES[2:])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([s + base for s in keep], pa.int64()), pa.array([out[s] + base for s in keep], pa.int64())], names=EDGE.split()[::2])

    return run


def _chunk_columns(file: str, at: int, data: bytes, base: int, spans: Iterator[tuple[int, int]]) -> list[pa.Array]:
    rows = [(file, at, a + base, b - a, hashlib.sha256(data[a:b]).hexdigest()) for a, b in spans]
    return [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, CHUNK_TYPES)]


def _chunks(gear: np.ndarray, profile: Profile, size: int, per: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, at, data, before, own, starts in _groups(batches, per):
            stop, base = before + own, at * per * size - before
            cutter = Cutter(data, gear, profile)
            spans = (x for s in starts for x in _walk(cutter, data, s - base, stop, len(data) - stop < profile.most))
            yield pa.RecordBatch.from_arrays(_chunk_columns(file, at, data, base, spans), names=CHUNK.split()[::2])

    return run


def _in_order(gear: np.ndarray, profile: Profile, size: int, per: int):
    """A file's runs one after the other: the starts that chunks really have, one of each run that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start = None, 0
        for file, at, data, before, own, _ in _groups(batches, per):
            if file != now:
                now, start = file, 0
            base, stop = at * per * size - before, before + own
            if start - base >= stop:
                continue
            entry = start
            cutter = Cutter(data, gear, profile)
            for _, b in _walk(cutter, data, start - base, stop, len(data) - stop < profile.most):
                start = b + base
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([at], pa.int64()), pa.array([entry], pa.int64())], ["file", "slice", "start"])

    return run


def _by_slice(rows: DataFrame, whole_files: bool = False) -> DataFrame:
    keys = ["file"] if whole_files else ["file", "slice"]
    n = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, *keys).sortWithinPartitions("file", "slice", "nth")


def _picked(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows of the given keys, a checkpoint's distinct ones."""
    few = keys.limit(MOST_SENT + 1).count() <= MOST_SENT
    return rows.join(F.broadcast(keys) if few else keys, [*on], "left_semi")


def _asked(starts: DataFrame) -> DataFrame:
    return starts.select("file", "slice", F.lit(-2).alias("nth"), F.lit(None).cast("binary").alias("piece"), "start")


def chunk_slices(slices: DataFrame, secret: bytes, profile: Profile = SOURCE_CODE, size: int = SLICE) -> DataFrame:
    """file, pos, offset, len, cid: the chunks that functions.cdc.spans() gives of each whole file, from its slices.

    slices: file, slice (0, 1, ...), bytes; every slice of a file but the last has `size` bytes. A task holds a run of
    slices and the `profile.most` bytes after it. An empty file has no chunks. A missing slice is an error.
    """
    gear = gear_table(secret)
    holes = slices.groupBy("file").agg(F.count("*").alias("n"), F.max("slice").alias("last"), F.sum(F.octet_length("bytes")).alias("sz"), F.max_by(F.octet_length("bytes"), "slice").alias("end"))
    bad = holes.filter((F.col("n") != F.col("last") + 1) | (F.col("sz") != F.col("last") * size + F.col("end"))).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].file}: slices are missing, or not of {size} bytes")
    per = _per_run(profile, size)
    unit, how = per * size, (gear, profile, size, per)
    slices = slices.filter(F.octet_length("bytes") > 0)
    first = cut_lineage(_by_slice(_with_context(slices, profile, size, per)).mapInArrow(_edges(*how), EDGE))
    names = [c.split()[0] for c in CHUNK.split(", ")]
    chunks = first.filter("start is null").select(*names)
    ends = cut_lineage(holes.filter(F.col("sz") > unit).select("file", "sz", "last"))
    if not ends.isEmpty():
        chunks = chunks.unionByName(_composed(slices, ends, first.filter("start is not null").select("file", "start", "next"), profile, how))
    counts = chunks.groupBy("file", "slice").agg(F.count("*").alias("n"))
    before = counts.select("file", "slice", (F.sum("n").over(W.partitionBy("file").orderBy("slice")) - F.col("n")).alias("before"))
    nth = F.row_number().over(W.partitionBy("file", "slice").orderBy("offset")) - 1
    return chunks.join(before, ["file", "slice"]).select("file", (F.col("before") + nth).alias("pos"), "offset", "len", "cid")


def _composed(slices: DataFrame, ends: DataFrame, edges: DataFrame, profile: Profile, how: tuple) -> DataFrame:
    """CHUNK rows of the files of many runs. ends: file, sz, last (slice). edges: what their runs' functions give of the starts that content can give."""
    *_, size, per = how
    unit = per * size
    pieces = _with_context(_picked(slices, ends.select("file"), "file"), profile, size, per)
    for _ in range(ROUNDS):
        heard = edges.select("file", F.col("next").alias("start")).distinct().join(ends, "file").filter("start < sz").select("file", F.expr(f"start div {unit}").alias("slice"), "start")
        news = cut_lineage(heard.join(edges.select("file", "start"), ["file", "start"], "left_anti").select("file", "slice", "start"))
        if news.isEmpty():
            break
        some = _picked(pieces, cut_lineage(news.select("file", "slice").distinct()), "file", "slice").unionByName(_asked(news))
        edges = cut_lineage(edges.unionByName(_by_slice(some).mapInArrow(_edges(*how), EDGE).select("file", "start", "next")))
    found = ends.select("file", F.lit(0).cast("bigint").alias("slice"), F.lit(0).cast("bigint").alias("start"))
    jump, runs_at_most = edges, ends.agg(F.max("last")).first()[0] // per + 1
    for _ in range(runs_at_most.bit_length()):  # what 2**k functions in a row reach
        step = found.join(jump, ["file", "start"]).select("file", F.col("next").alias("start")).join(ends, "file").filter("start < sz")
        found = cut_lineage(found.unionByName(step.select("file", F.expr(f"start div {unit}").alias("slice"), "start")).distinct())
        ahead = jump.select("file", F.col("start").alias("next"), F.col("next").alias("after"))
        jump = cut_lineage(jump.join(ahead, ["file", "next"]).select("file", "start", F.col("after").alias("next")))
    open_ = cut_lineage(found.join(edges.select("file", "start"), ["file", "start"], "left_anti").select("file").distinct())
    if not open_.isEmpty():
        dull = _by_slice(_picked(pieces, open_, "file"), whole_files=True).mapInArrow(_in_order(*how), "file string, slice bigint, start bigint")
        found = cut_lineage(found.join(open_, "file", "left_anti").select("file", "slice", "start").unionByName(dull))
    return cut_lineage(_by_slice(pieces.unionByName(_asked(found))).mapInArrow(_chunks(*how), CHUNK))


def sliced(spark, folder: str, size: int = SLICE) -> DataFrame:
    """Slices of the files below a shared local folder: the files are listed, then each task reads its slices by offset."""
    files = objects.walk_tree(spark, folder).filter("t = 0 and route = 'item'").select(F.col("p").alias("file"), "sz")
    cuts = files.select("file", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("sz") / size) - 1, F.lit(0)))).alias("slice"))
    top = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, k in zip(*(c.to_pylist() for c in b.columns)):
                with open(f"{top}/{file}", "rb") as f:
                    f.seek(k * size)
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k], pa.int64()), pa.array([f.read(size)], pa.binary())], ["file", "slice", "bytes"])

    return cuts.repartition(max(8, spark.sparkContext.defaultParallelism), "file", "slice").mapInArrow(read, "file string, slice bigint, bytes binary")


def write_files(entries: DataFrame, blocks: DataFrame, folder: str) -> None:
    """Write files below a shared local folder block by block: no file is ever whole in memory.

    entries: p, x, sz, pcid (the SHA-256 of the file). blocks: p, pos (0, 1, ...), bytes. A file's blocks meet in order in one
    task, which appends them to a temporary file under a running hash and renames it once content and size are what the
    entry says. Otherwise the temporary file goes, what lay there before stays, and the job fails. Nothing is written through a link.
    A retry repeats harmlessly; an entry of no blocks is an empty file; blocks of no entry are ignored.
    """
    if not entries.filter(~F.coalesce(paths.is_trusted(F.col("p")), F.lit(False))).isEmpty():
        raise ValueError("untrusted path")
    head = entries.select("p", F.lit(-1).alias("pos"), F.lit(None).cast("binary").alias("bytes"), "x", "sz", "pcid")
    body = blocks.select("p", F.col("pos").cast("int").alias("pos"), "bytes", F.lit(None).cast("boolean").alias("x"), F.lit(None).cast("bigint").alias("sz"), F.lit(None).cast("string").alias("pcid"))
    n = max(8, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = head.unionByName(body.join(entries.select("p"), "p", "left_semi")).repartition(n, "p").sortWithinPartitions("p", "pos")
    rows.foreachPartition(lambda it: append_files(it, folder))


def append_files(rows: Iterator, folder: str) -> None:
    """Rows (p, pos, bytes, x, sz, pcid) in order, each file's entry (pos -1) before its blocks."""
    with objects.Landing() as landing:
        for _, mine in itertools.groupby(rows, key=lambda r: r.p):
            entry = next(mine)
            f = landing.file(objects.place(folder, entry.p), entry.x)
            digest, size = hashlib.sha256(), 0
            for at, r in enumerate(mine):
                if r.pos != at or r.bytes is None:
                    raise ValueError(f"{entry.p}: block {at} is missing")
                f.write(r.bytes)
                digest.update(r.bytes)
                size += len(r.bytes)
            if size != entry.sz or digest.hexdigest() != entry.pcid:
                raise ValueError(f"{entry.p}: content isn't what its entry says")
