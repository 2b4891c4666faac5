"""The linear revision log: heads, integrity, windows, compare-and-swap."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_ROWS = 4096
WINDOW = 1024
MOST_ATTEMPTS = 8


def heads(revisions: DataFrame) -> DataFrame:
    """The newest revision of each space: one partial aggregation."""
    return revisions.groupBy("space_id").agg(F.max("seq").alias("head_seq"), F.max_by("revision_id", "seq").alias("head_revision"), F.count("*").alias("revisions"))


def chain_breaks(revisions: DataFrame) -> DataFrame:
    """Rows whose seq isn't the one before plus one, or whose parent isn't the row before."""
    w = W.partitionBy("space_id").orderBy("seq")
    r = revisions.withColumns({"prev_seq": F.lag("seq").over(w), "prev_id": F.lag("revision_id").over(w)})
    bad = F.when(F.col("prev_seq").isNull(), (F.col("seq") != 0) | F.col("parent").isNotNull()).otherwise((F.col("seq") != F.col("prev_seq") + 1) | ~F.col("parent").eqNullSafe(F.col("prev_id")))
    return r.filter(bad).select("space_id", "seq", "prev_seq")


def range_by_seq(revisions: DataFrame, space: str | int, low: int, high: int | None = None, cap: int = MOST_ROWS) -> DataFrame:
    """Revisions from `low`; an error beyond `cap` rows, so that no caller mistakes a part for the whole."""
    out = revisions.filter(F.col("space_id") == space).filter(F.col("seq") >= low)
    out = out if high is None else out.filter(F.col("seq") <= high)
    if out.limit(cap + 1).count() > cap:
        raise ValueError(f"more than {cap} revisions; use windows()")
    return out.orderBy("seq")


def windows(heads: DataFrame, low: int = 0, size: int = WINDOW) -> DataFrame:
    """The [from, to] windows that a paged reader asks for, up to each head."""
    at = F.explode(F.sequence(F.lit(low).cast("bigint"), F.col("head_seq").cast("bigint"), F.lit(size).cast("bigint")))
    return heads.filter(F.col("head_seq") >= low).select("space_id", "head_seq", at.alias("from_seq")).withColumn("to_seq", F.least(F.col("from_seq") + size - 1, F.col("head_seq")))


def retention_floor(devices: DataFrame, heads: DataFrame) -> DataFrame:
    """The least base any device still uses, within [0, head]."""
    least = devices.groupBy("space_id").agg(F.min("base_seq").alias("least"))
    return heads.join(least, "space_id", "left").select("space_id", F.greatest(F.lit(0), F.least(F.coalesce("least", F.col("head_seq")), F.col("head_seq"))).cast("bigint").alias("floor_seq"))


def cas_replay(attempts: DataFrame) -> DataFrame:
    """Fold commit attempts of each space in order: accepted iff the expected base is the head.

    attempts: space_id, attempt_no, expected (null: no base). A fold by nature; state is one number a space.
    """

    def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, head = None, -1
        for pdf in it:
            ok, seq = [], []
            for s, e in zip(pdf.space_id, pdf.expected):
                if s != space:
                    space, head = s, -1
                hit = (head == -1) if pd.isna(e) else (head == int(e) and head >= 0)
                head += hit
                ok.append(bool(hit))
                seq.append(head if hit else None)
            yield pd.DataFrame({"space_id": pdf.space_id, "attempt_no": pdf.attempt_no, "accepted": ok, "seq": pd.array(seq, "Int64")})

    ordered = attempts.select("space_id", "attempt_no", F.col("expected").cast("bigint")).repartition("space_id").sortWithinPartitions("space_id", "attempt_no")
    kind = attempts.schema["space_id"].dataType.simpleString()
    return ordered.mapInPandas(fold, f"space_id {kind}, attempt_no bigint, accepted boolean, seq bigint")


def head(spark: SparkSession, folder: str, space: str) -> int | None:
    """A space's newest seq; None if it has no revision. The listing reaches Python as one string: a call for each of its files would take most of the time."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{space}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    listed = jvm.scala.Predef.genericWrapArray(jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(fs.listStatus(path))).mkString("\0")  # no path holds it
    names = (x.rpartition("/")[2] for x in listed.split("\0"))
    return max((int(x) for x in names if x.isdigit()), default=None)


def commit(spark: SparkSession, folder: str, space: str, expected: int | None, payload: bytes) -> int | None:
    """Write aside, then rename to `<folder>/<space>/<seq>` unless it exists; None if another writer has that seq or
    the base is stale. A crash before the rename leaves no revision."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{space}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if head(spark, folder, space) != expected:
        return None
    seq = 0 if expected is None else expected + 1
    aside = jvm.org.apache.hadoop.fs.Path(f"{folder}/{space}/_{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(payload))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{folder}/{space}/{seq}")), options)
    except Exception as e:  # noqa: BLE001
        fs.delete(aside, False)
        if "already exists" in str(e) or "FileAlreadyExists" in str(e):
            return None
        raise
    return seq


def commit_with_retry(spark: SparkSession, folder: str, space: str, read_head, payload, attempts: int = MOST_ATTEMPTS) -> int:
    """Commit, on conflict look at the head again; `payload` builds the content for a given base."""
    for _ in range(attempts):
        base = read_head()
        seq = commit(spark, folder, space, base, payload(base))
        if seq is not None:
            return seq
    raise RuntimeError(f"{space}: {attempts} attempts lost the race")


def status(heads: DataFrame, base: DataFrame) -> DataFrame:
    """up_to_date, behind by n, diverged (base beyond the head) or none (no head)."""
    j = base.join(heads, "space_id", "left")
    verdict = (
        F.when(F.col("head_seq").isNull(), "none").when(F.col("base_seq") == F.col("head_seq"), "up_to_date")
        .when(F.col("base_seq") < F.col("head_seq"), F.concat(F.lit("behind "), (F.col("head_seq") - F.col("base_seq")).cast("string"))).otherwise("diverged")
    )
    return j.select("space_id", "base_seq", "head_seq", verdict.alias("verdict"))


def by_seq(revisions: DataFrame, space: str | int, seq: int) -> DataFrame:
    """The one revision of a space with that seq; two of them are an error."""
    out = revisions.filter((F.col("space_id") == space) & (F.col("seq") == seq))
    if out.limit(2).count() > 1:
        raise ValueError(f"{space}: seq {seq} isn't unique")
    return out


def catch_up(pull, commit, attempts: int = MOST_ATTEMPTS):
    """What a start does: pull, then commit; a lost race pulls again."""
    for _ in range(attempts):
        pull()
        out = commit()
        if out is not None:
            return out
    raise RuntimeError(f"{attempts} attempts lost the race")


def staging_report(pages: DataFrame, lists: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: distinct pages, block lists and blocks that a commit uploads."""
    one = lambda df, kind: df.select("cid", F.lit(kind).alias("kind"))
    every = one(pages, "pages").unionByName(one(lists, "blocklists")).unionByName(one(blocks, "blocks")).distinct()
    n = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    return every.agg(n("pages"), n("blocklists"), n("blocks"))
