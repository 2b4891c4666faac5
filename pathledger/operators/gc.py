"""Garbage collection: listed minus reachable, behind grace and proportion guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathledger.runtime import cut_lineage

SKEW_SECONDS = 3600
GUARD_LEAST = 32
GUARD_FRACTION = 0.5


def window_seconds(grace: int) -> int:
    """The enforced age: grace plus clock skew, but zero stays zero."""
    return grace + SKEW_SECONDS if grace > 0 else 0


def classify(listed: DataFrame, live: DataFrame, now: int, grace: int) -> DataFrame:
    """state: reachable, grace (too young, in the future or of unknown age) or sweepable.

    listed: key, mtime (seconds, may be null). live: key.
    """
    marked = listed.join(live.select("key", F.lit(True).alias("live")).distinct(), "key", "left")
    old = F.lit(now) - F.col("mtime") >= window_seconds(grace)
    ok = F.col("mtime").isNotNull() & (F.col("mtime") <= now) & old
    return marked.withColumn("state", F.when(F.col("live"), "reachable").when(ok, "sweepable").otherwise("grace")).drop("live")


def sweep_plan(classified: DataFrame) -> DataFrame:
    """Oldest first, then by key."""
    return classified.filter("state = 'sweepable'").select("key", "mtime").orderBy("mtime", "key")


def report(classified: DataFrame, most: float = GUARD_FRACTION) -> DataFrame:
    share = GUARD_FRACTION if most != most else most
    n = lambda s: F.count_if(F.col("state") == s)
    return classified.agg(F.count("*").alias("scanned"), n("reachable").alias("reachable"), n("grace").alias("kept_by_grace"), n("sweepable").alias("sweepable")).withColumn(
        "blocked", (F.col("scanned") >= GUARD_LEAST) & (F.col("sweepable") > F.col("scanned") * F.lit(share))
    )


def full_report(classified: DataFrame, heads: DataFrame, retained: DataFrame) -> DataFrame:
    """report() with how many spaces and revisions the reachable set was drawn from."""
    more = heads.agg(F.count("*").alias("spaces")).crossJoin(retained.agg(F.count("*").alias("retained_revisions")))  # one row each
    return report(classified).crossJoin(F.broadcast(more))


def future_skew(listed: DataFrame, now: int) -> DataFrame:
    return listed.agg(F.max(F.col("mtime") - now).alias("skew")).select(F.when(F.col("skew") > 0, F.col("skew")).alias("future_seconds"))


def heads_moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Spaces whose head differs between two readings, one side missing included."""
    b = after.select("space_id", F.col("head_seq").alias("after_seq"))
    return before.select("space_id", F.col("head_seq").alias("before_seq")).join(b, "space_id", "full_outer").filter(~F.col("before_seq").eqNullSafe(F.col("after_seq")))


class Refused(RuntimeError):
    """A guard stopped the collection. `deleted` says how many objects were gone by then."""

    def __init__(self, why: str, deleted: int = 0):
        super().__init__(f"{why}; {deleted} deleted")
        self.deleted = deleted


def guard_roots(heads: DataFrame, revisions: DataFrame, space: str | int) -> None:
    """What isn't reachable from a known space is garbage, so the spaces must be the right ones and whole: some at all, the
    caller's among them, and none with a head but without revisions."""
    if heads.isEmpty():
        raise Refused("the account owns no space, so everything would be garbage")
    if heads.filter(F.col("space_id") == space).isEmpty():
        raise Refused(f"space {space} isn't among the account's")
    torn = heads.filter("head_seq is not null").join(revisions.select("space_id").distinct(), "space_id", "left_anti").limit(1).collect()
    if torn:
        raise Refused(f"space {torn[0].space_id} has a head but no revisions")


def collect_garbage(listed: DataFrame, live: DataFrame, heads, revisions: DataFrame, space: str | int, now: int, grace: int, delete, *, most: float = GUARD_FRACTION, dry_run: bool = True) -> dict:
    """The report of a sweep, after it. Every guard that stops it is an error (Refused).

    `heads()` returns the current heads (space_id, head_seq), `delete` takes a DataFrame (key, mtime) and is called once:
    the sweep is one job whatever there is to delete, oldest first within its partitions. The heads are read again before and after it:
    moved before, nothing is deleted; moved after, the error says how many objects a racing commit may miss. A dry run
    deletes nothing and reports `blocked` where the sweep would be refused for its share of all objects.
    """
    first = cut_lineage(heads())
    guard_roots(first, revisions, space)
    state = cut_lineage(classify(listed, live, now, grace))
    out = report(state, most).first().asDict() | {"spaces": first.count(), "retained_revisions": revisions.count(), "deleted": 0}
    if dry_run or not out["sweepable"]:
        return out
    if out["blocked"]:
        raise Refused(f"{out['sweepable']} of {out['scanned']} objects would go")
    if not heads_moved(first, heads()).isEmpty():
        raise Refused("a head moved before the sweep")
    delete(state.filter("state = 'sweepable'").select("key", "mtime").repartitionByRange("mtime", "key").sortWithinPartitions("mtime", "key"))
    out["deleted"] = out["sweepable"]
    if not heads_moved(first, heads()).isEmpty():
        raise Refused("a head moved during the sweep: commit again where it moved", out["deleted"])
    return out
