"""Snapshots: the FileEntry table of a tree, built, listed and reduced."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathledger.functions import paths
from pathledger.operators.pages import running_totals
from pathledger.runtime import cut_lineage, dealt


def from_content(df: DataFrame, path: Column, content: Column) -> DataFrame:
    """Entries of plain files, one block each; wide inputs go through functions.cdc.chunk instead."""
    cid = F.sha2(content, 256)
    return df.select(
        path.alias("p"), paths.casefold_key(path).alias("key"), F.lit(0).cast("tinyint").alias("t"), F.lit(False).alias("x"), F.octet_length(content).cast("bigint").alias("sz"),
        cid.alias("pcid"), F.array(cid).alias("bk"), F.lit(None).cast("string").alias("bk_ref"), F.lit(None).cast("string").alias("lt"), F.lit(None).cast("boolean").alias("wu"),
    )


def scan(items: DataFrame, ignore: list[str]) -> DataFrame:
    """Route walked items: `route` is item, ignored, junk, derived, unsyncable or untrusted.

    items: p, is_dir, is_symlink, lt, and whatever else is carried along.
    """
    p = F.col("p")
    route = (
        F.when(~paths.is_trusted(p), "untrusted").when(paths.is_unsyncable(p), "unsyncable").when(paths.is_junk(p), "junk")
        .when(paths.is_ignored(p, F.col("is_dir"), ignore), "ignored").when(paths.is_derived(p), "derived").otherwise("item")
    )
    return items.withColumns({"route": route, "t": paths.classify(p, F.col("is_symlink"), F.col("is_dir"))})


class Scan(NamedTuple):
    """entries: the snapshot, with `how` each came about. skipped: p, reason, retained. deletions: p, retention (delete or hold)."""

    entries: DataFrame
    skipped: DataFrame
    deletions: DataFrame


def scan_with_base(items: DataFrame, index: DataFrame, base: DataFrame, blocks: DataFrame, read: Callable[[DataFrame], DataFrame], ignore: list[str], now: int) -> Scan:
    """A whole scan: what is on disk becomes the next snapshot, and nothing that was merely not seen passes for deleted.

    items: p, is_dir, is_symlink, lt, x, sz, mtime (sources.objects.walk_tree()). index: LOCAL_ENTRY rows of the space. base: the
    published entries (p, key, t, x, sz, pcid, bk, lt). blocks: cid. read: content of files, (p) -> (p, pcid, bk); a file that it
    leaves out couldn't be read. It is asked for files alone whose blocks can't be reused.

    Of two paths with one key the first counts. The other, and what lies below it, is declined, like ignored and unreadable
    paths: what the base has of a declined path or below it is published again. So are rebuilt folders (type 2) that vanished.
    Other index rows that vanished are deleted, or held if they are most of what is tracked. Untrusted names and names that another
    system can't hold are reported; the latter leave the snapshot. No key has two entries: what is on disk comes before the base.
    """
    seen = scan(items, ignore)
    seen = cut_lineage(seen.withColumn("key", paths.casefold_key(F.col("p"))))
    mapped = seen.filter(F.col("route").isin("item", "derived"))
    _, lost = first_per_key(mapped)
    colliding = cut_lineage(declined_subtrees(mapped, lost.select(F.col("p").alias("prefix"))).select("p"))
    fit = cut_lineage(mapped.join(dealt(colliding), "p", "left_anti"))
    files = fit.filter("t = 0")
    reused = cut_lineage(unchanged_reuse(files.select("p", "sz", "x", "mtime"), index, base, blocks, now))
    fresh = cut_lineage(read(files.select("p").join(dealt(reused), "p", "left_anti")).select("p", "pcid", "bk"))
    content = reused.select("p", "pcid", F.col("blocks.cid").alias("bk"), F.lit("reused").alias("how")).unionByName(fresh.withColumn("how", F.lit("read")))
    unread = files.select("p").join(dealt(content), "p", "left_anti")
    none = lambda t: F.lit(None).cast(t)
    kept_link = paths.symlink_policy(F.col("p"), F.col("lt")) == "preserve"
    own = files.join(dealt(content), "p").select("p", "key", "t", "x", "sz", "pcid", "bk", none("string").alias("lt"), "how").unionByName(
        fit.filter((F.col("t") > 1) | ((F.col("t") == 1) & kept_link)).select(
            "p", "key", "t", F.lit(False).alias("x"), none("bigint").alias("sz"), F.when(F.col("t") == 1, F.sha2("lt", 256)).alias("pcid"), none("array<string>").alias("bk"),
            F.when(F.col("t") == 1, F.col("lt")).alias("lt"), F.element_at(F.array(F.lit("link"), F.lit("derived"), F.lit("folder")), F.col("t").cast("int")).alias("how"),
        )
    )
    reason = lambda df, r: df.select("p", F.lit(r).alias("reason"))
    declined = reason(colliding, "collision").unionByName(reason(unread, "unreadable")).unionByName(seen.filter(F.col("route").isin("ignored", "junk", "unreadable")).select("p", F.col("route").alias("reason")))
    declined = cut_lineage(declined)
    present = fit.select("p").unionByName(declined.select("p")).distinct()
    gone = index.withColumnRenamed("path", "p").join(dealt(present), "p", "left_anti")
    below = declined_subtrees(gone.select("p"), declined.select(F.col("p").alias("prefix"))).select("p", F.lit(True).alias("below"))
    tracked = (F.col("local_only") == 0) | (F.col("type") == 2)
    lost_rows = cut_lineage(gone.join(dealt(below), "p", "left").select("p", tracked.alias("tracked"), (F.coalesce("below", F.lit(False)) | (F.col("type") == 2)).alias("keep")))
    counts = index.agg(F.count_if(tracked).alias("tracked")).crossJoin(lost_rows.agg(F.count_if(~F.col("keep") & F.col("tracked")).alias("deleted"))).first()
    hold = counts.tracked >= 50 and counts.deleted * 100 >= counts.tracked * 90
    again = declined.select("p").unionByName(lost_rows.filter("keep").select("p")).distinct()
    taken = base.join(dealt(again), "p", "left_semi").join(dealt(own.select("key")), "key", "left_anti").select("p", "key", "t", "x", "sz", "pcid", "bk", "lt", F.lit("published again").alias("how"))
    entries = cut_lineage(own.unionByName(taken))
    skipped = declined.unionByName(reason(fit.filter((F.col("t") == 1) & ~kept_link), "local_only")).unionByName(seen.filter(F.col("route").isin("untrusted", "unsyncable")).select("p", F.col("route").alias("reason")))
    kept = taken.select("p", F.lit(True).alias("retained"))
    skipped = skipped.join(dealt(kept), "p", "left").withColumn("retained", F.coalesce("retained", F.lit(False)))
    return Scan(entries, skipped, lost_rows.filter("not keep").select("p", F.lit("hold" if hold else "delete").alias("retention")))


def added(head: DataFrame) -> DataFrame:
    """First clone: everything in the head is new, no diff is needed."""
    return head.select("key", F.lit("Added").alias("change"), F.lit(None).cast("string").alias("old_pcid"), F.col("pcid").alias("new_pcid"))


def content_dedup(df: DataFrame, cid: str, *, name: str, size: str) -> DataFrame:
    """One row per content id: copies, first name, bytes stored once and bytes saved. One partial aggregation."""
    return df.groupBy(cid).agg(F.count("*").alias("copies"), F.min(name).alias("first_path"), F.max(size).alias("bytes"), (F.sum(size) - F.max(size)).alias("saved"))


def first_per_key(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lexicographically first path of each key wins; losers come second. An aggregate, not a window: hot keys combine early."""
    first = df.groupBy("key").agg(F.min("p").alias("first_p"))
    joined = df.join(dealt(first), "key")
    return joined.filter("p = first_p").drop("first_p"), joined.filter("p <> first_p").drop("first_p")


def casefold_collisions(df: DataFrame) -> DataFrame:
    return df.groupBy("key").agg(F.count("*").alias("n"), F.min("p").alias("first_p"), F.max("p").alias("last_p")).filter("first_p <> last_p")


def declined_subtrees(df: DataFrame, declined: DataFrame) -> DataFrame:
    """Rows at or below a declined prefix: explode ancestors, then an equi-join."""
    up = df.withColumn("prefix", F.explode(paths.ancestors(F.col("p"))))
    return up.join(dealt(declined.select("prefix").distinct()), "prefix", "left_semi").drop("prefix").dropDuplicates(["p"])


def duplicate_keys(df: DataFrame) -> DataFrame:
    return df.groupBy("key").count().filter("count > 1")


def listing(df: DataFrame) -> DataFrame:
    """Type letter, size, path, in path order."""
    letter = F.when(F.col("t") == 3, "d").when(F.col("t") == 2, "D").when(F.col("t") == 1, "l").when(F.col("x"), "x").otherwise("f")
    return df.select(letter.alias("letter"), F.col("sz"), F.col("p")).orderBy("p")


def top_with_rest(df: DataFrame, order: str, n: int = 20) -> DataFrame:
    """The report's first n rows and how many more there are."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(order).limit(n).crossJoin(F.broadcast(total)).withColumn("more", F.greatest(F.col("total") - n, F.lit(0))).drop("total")


def unchanged_reuse(disk: DataFrame, index: DataFrame, base: DataFrame, blocks: DataFrame, now: int) -> DataFrame:
    """Paths whose stored blocks may be reused without reading: size, exec bit and mtime agree, the mtime is
    settled (0 < mtime < now), the base agrees, and every block is present."""
    i = index.select(F.col("path").alias("p"), F.col("size").alias("i_size"), F.col("exec").alias("i_exec"), F.col("mtime").alias("i_mtime"), F.col("pcid").alias("i_pcid"), "blocks")
    b = base.select("p", F.col("pcid").alias("b_pcid"))
    same = disk.join(dealt(i), "p").join(dealt(b), "p").filter("sz = i_size and cast(x as int) = i_exec and mtime = i_mtime and mtime > 0 and i_pcid = b_pcid").filter(F.col("mtime") < now)
    missing = same.select("p", F.explode("blocks.cid").alias("cid")).join(dealt(blocks.select("cid").distinct()), "cid", "left_anti").select("p").distinct()
    return same.join(dealt(missing), "p", "left_anti").select("p", F.col("i_pcid").alias("pcid"), "blocks")


def deletion_hold(index: DataFrame, disk: DataFrame, declined: DataFrame, *, least: int = 50, percent: int = 90) -> DataFrame:
    """What becomes of index rows that vanished: delete, keep (below a declined prefix) or hold (mass delete)."""
    gone = index.join(disk.select("p"), "p", "left_anti")
    kept = declined_subtrees(gone, declined).select("p", F.lit(True).alias("declined"))
    marked = gone.join(kept, "p", "left").withColumn("declined", F.coalesce("declined", F.lit(False)))
    counts = index.agg(F.count("*").alias("tracked")).crossJoin(marked.agg(F.count_if(~F.col("declined")).alias("deleted")))
    held = (F.col("tracked") >= least) & (F.col("deleted") * 100 >= F.col("tracked") * percent)
    return marked.crossJoin(F.broadcast(counts)).select("p", F.when(F.col("declined"), "keep").when(held, "hold").otherwise("delete").alias("retention"))


def mass_delete_guard(df: DataFrame, group: str, deleted: Column, *, least: int = 50, percent: int = 90) -> DataFrame:
    out = df.groupBy(group).agg(F.count("*").alias("tracked"), F.count_if(deleted).alias("deleted"))
    return out.withColumn("blocked", (F.col("tracked") >= least) & (F.col("deleted") * 100 >= F.col("tracked") * percent))


def upload_budget(df: DataFrame, group: str | None, order: str, size: str, budget: int) -> DataFrame:
    """Files in order while the bytes before them are below the budget; the rest wait for the next commit.

    Deferred files come after every taken one, so the running sum over all files decides as a fold would. Without a group all
    files are one scan, whose sums are made by ranges of the order; a group is one task's.
    """
    if group is None:
        summed = running_totals(df, order, size)
    else:
        summed = df.withColumn("before", F.coalesce(F.sum(size).over(W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return summed.withColumn("deferred", F.col("before") >= budget)
