"""Merkle pages: rank, cut every `fanout` rows, hash the ordered rows, repeat until one root remains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathledger.functions.content import canonical_row
from pathledger.runtime import cut_lineage

FANOUT = 256
EXTERNAL_BYTES = 262_144
MOST_DEPTH = 64


def ranked(df: DataFrame, order: str) -> DataFrame:
    """A global zero-based rank without a single-task window.

    Range-partition, count per partition, add the counts before. The checkpoint fixes the
    sampled ranges, so that counts and ranks see the same partitions.
    """
    ranged = cut_lineage(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(W.partitionBy("_part").orderBy(order))
    return ranged.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + local - 1).drop("_part", "_before")


def running_totals(df: DataFrame, order: str, size: str) -> DataFrame:
    """Adds `before`: the sum of `size` over all rows before in a global order, as ranked() adds a rank."""
    ranged = cut_lineage(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.sum(size).alias("_n"))
    before = sums.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.coalesce(F.sum(size).over(W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(before), "_part").withColumn("before", F.col("_before") + local).drop("_part", "_before")


def encode(df: DataFrame) -> DataFrame:
    return df.withColumn("row", canonical_row(*(F.col(c) for c in ("key", "p", "t", "x", "sz", "pcid", "lt"))))


def leaves(entries: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """(rows with page and page_cid, one row per leaf: page, first, last, n, page_cid)."""
    rows = ranked(encode(entries), "key").withColumn("page", F.floor(F.col("rank") / fanout).cast("bigint"))
    made = _hashed(rows, "key", "key")
    return rows.join(made.select("page", "page_cid"), "page"), made


def _hashed(rows: DataFrame, low: str, high: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("rank", "row")))["row"]  # at most `fanout` rows a group
    return rows.groupBy("page").agg(
        F.min(low).alias("first"), F.max(high).alias("last"), F.count("*").alias("n"), F.sha2(F.array_join(ordered, "|"), 256).alias("page_cid")
    )


def index_levels(made: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Every page of every level: level, page, parent, first, last, n, page_cid. The last level has one row, the root.

    The loop runs once per level: log_fanout(rows) times.
    """
    level, out, now = 0, [], made.withColumn("level", F.lit(0))
    while True:
        now = cut_lineage(now.withColumn("parent", F.floor(F.col("page") / fanout).cast("bigint")))
        out.append(now)
        if now.count() <= 1:
            break
        if level >= MOST_DEPTH:
            raise ValueError(f"more than {MOST_DEPTH} levels of pages")
        level += 1
        rows = now.select(F.col("parent").alias("page"), F.col("page").alias("rank"), canonical_row(F.col("first"), F.col("page_cid")).alias("row"), "first", "last")
        now = _hashed(rows, "first", "last").withColumn("level", F.lit(level))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def root(entries: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row: root id, levels and pages. An empty tree has one empty page."""
    _, made = leaves(entries, fanout)
    every = index_levels(made, fanout)
    empty = F.sha2(F.lit(""), 256)
    return every.agg(F.coalesce(F.max_by("page_cid", "level"), empty).alias("root"), F.greatest(F.coalesce(F.max("level"), F.lit(0)) + 1, F.lit(1)).alias("levels"), F.greatest(F.count("*"), F.lit(1)).alias("pages"))


def externalize(df: DataFrame, blocks: str = "bk", limit: int = EXTERNAL_BYTES) -> tuple[DataFrame, DataFrame]:
    """Block lists above the limit move to a table of their own and leave a reference."""
    encoded = F.array_join(blocks, ",")
    big = F.length(encoded) > limit
    out = df.withColumns({"bk_ref": F.when(big, F.sha2(encoded, 256)), blocks: F.when(~big, F.col(blocks))})
    return out, df.filter(big).select(F.sha2(encoded, 256).alias("bk_ref"), F.col(blocks).alias("list")).dropDuplicates(["bk_ref"])


def reachable(edges: DataFrame, roots: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """Every node at or below a root, with its least depth: one join per level of the DAG.

    edges: parent, child. roots: node. The frontier holds new nodes only, so cycles end. A DAG deeper than
    `most_depth` is an error: a part of what is reachable must never pass for the whole.
    """
    seen = cut_lineage(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, level = seen, 0
    while True:
        level += 1
        found = edges.join(frontier.select(F.col("node").alias("parent")), "parent").select(F.col("child").alias("node")).distinct()
        frontier = cut_lineage(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        if level > most_depth:
            raise ValueError(f"nodes deeper than {most_depth}")
        seen = cut_lineage(seen.unionByName(frontier))
    return seen


def unequal_pages(old: DataFrame, new: DataFrame, by_level: dict[int, int] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Leaves that one tree alone has, found from the roots down, and how many pages were read for it.

    old, new: index_levels(). A page is read only if no page of the other side's has its id; equal subtrees are never
    entered. Equal roots read nothing. A taller tree descends alone until both are level. by_level is given the pages read of each level.
    """
    top = [t.agg(F.max("level")).first()[0] for t in (old, new)]
    if None in top:
        return old.filter("level = 0"), new.filter("level = 0"), sum(t.count() for t in (old, new))
    ids = lambda t: t.select("page_cid").distinct()
    level, read = max(top), 0
    now = [t.filter(F.col("level") == k) for t, k in zip((old, new), top)]
    while True:
        here = [level <= k for k in top]
        if all(here):
            now = [cut_lineage(now[i].join(ids(now[1 - i]), "page_cid", "left_anti")) for i in (0, 1)]
        paid = sum(n.count() for n, on in zip(now, here) if on)
        read += paid
        if by_level is not None:
            by_level[level] = paid
        if level == 0:
            return now[0], now[1], read
        level -= 1
        for i, t in enumerate((old, new)):
            if here[i]:
                up = now[i].select(F.col("page").alias("parent"))
                now[i] = t.filter(F.col("level") == level).join(up, "parent", "left_semi")


def same_root(old: DataFrame, new: DataFrame) -> bool:
    """Snapshots are equal exactly if their roots (root()) are."""
    return old.first()["root"] == new.first()["root"]
