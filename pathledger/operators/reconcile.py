"""Three-way reconcile: base, local and remote meet in one shuffle, a verdict for every key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathledger.functions import paths
from pathledger.functions.merge3 import merge3_udf
from pathledger.operators.diff import same_content
from pathledger.runtime import cut_lineage

FIELDS = ["key", "p", "t", "x", "sz", "pcid", "lt"]
SLOTS = 32


def three_way(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """key, b, l, r (entry structs or null). A tagged union and one groupBy: one exchange, partial aggregation."""
    tagged = None
    for side, df in (("b", base), ("l", local), ("r", remote)):
        one = df.select("key", F.lit(side).alias("side"), F.struct(*FIELDS).alias("e"))
        tagged = one if tagged is None else tagged.unionByName(one)
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("e"))).alias(s)
    return tagged.groupBy("key").agg(pick("b"), pick("l"), pick("r"))


def _changed(side: str) -> Column:
    b, s = F.col("b").isNull(), F.col(side).isNull()
    return F.when(b & s, False).when(b | s, True).otherwise(~same_content("b", side))


def resolve(joined: DataFrame, label: str = "device", seq: int = 0) -> DataFrame:
    """Adds verdict, winner, loser and copy_name. The remote wins a real conflict; the local side becomes a copy."""
    l, r = F.col("l"), F.col("r")
    lc, rc = _changed("l"), _changed("r")
    verdict = (
        F.when(~lc & ~rc, "NoChange")
        .when(lc & ~rc, F.when(l.isNotNull(), "FastForwardToLocal").otherwise("KeepLocal"))
        .when(rc & ~lc, F.when(r.isNotNull(), "FastForwardToRemote").otherwise("TakeRemoteDeletion"))
        .when(l.isNull() & r.isNull(), "NoChange")
        .when(l.isNull() | r.isNull(), "DeleteVsEditKeepEdit")
        .when(same_content("l", "r"), "NoChange")
        .otherwise("ConflictCopy")
    )
    out = joined.withColumn("verdict", verdict)
    v = F.col("verdict")
    winner = F.when(v == "FastForwardToLocal", l).when(v.isin("FastForwardToRemote", "ConflictCopy"), r).when(v == "DeleteVsEditKeepEdit", F.coalesce(l, r))
    copy = F.when(v == "ConflictCopy", paths.conflict_copy_name(F.col("l.p"), F.lit(label), F.lit(seq)))
    return out.withColumns({"winner": winner, "loser": F.when(v == "ConflictCopy", l), "copy_name": copy})


def merged_exec(base: Column, local: Column, remote: Column) -> Column:
    """The side that left the base wins."""
    return F.when(~local.eqNullSafe(base), local).otherwise(remote)


def merge_conflicts(resolved: DataFrame, blobs: DataFrame) -> DataFrame:
    """Line-merge the conflicts alone: content is joined only to their rows, the UDF sees nothing else."""
    out = resolved.filter("verdict = 'ConflictCopy' and b is not null")
    for side in ("b", "l", "r"):
        own = blobs.select(F.col("pcid").alias(f"{side}_id"), F.col("content").alias(f"{side}_content"))
        out = out.withColumn(f"{side}_id", F.col(f"{side}.pcid")).join(own, f"{side}_id", "left")
    return out.withColumn("merge", merge3_udf("b_content", "l_content", "r_content")).select("key", "copy_name", "merge.status", "merge.content")


def case_collisions(local: DataFrame, remote: DataFrame) -> DataFrame:
    """The same key under two spellings: a collision copy, even with equal content."""
    b = remote.select("key", F.col("p").alias("remote_p"))
    return local.select("key", F.col("p").alias("local_p")).join(b, "key").filter("local_p <> remote_p")


def parked_copy_exists(conflicts: DataFrame, local: DataFrame) -> DataFrame:
    """Conflicts whose loser already lies parked as a copy with the same content."""
    parked = local.select(paths.conflict_origin(F.col("p")).alias("origin"), F.col("pcid").alias("parked")).filter("origin is not null")
    return conflicts.join(parked, (F.col("l.p") == F.col("origin")) & (F.col("l.pcid") == F.col("parked")), "left_semi")


def copy_paths(conflicts: DataFrame, local: DataFrame, blocked: DataFrame, label: str, seq: int, slots: int = SLOTS) -> DataFrame:
    """p, copy_name: where each losing version (p, t, pcid) is kept.

    Candidates carry the label, then `label 2`, `label 3`, ... One is taken if no local entry has its key, or if
    that entry is this very copy already. Keys that the reconcile itself writes or deletes (`blocked`) are out, and of two conflicts
    that want one name the lesser path gets it. A conflict without a free slot is an error: nothing may be lost.
    """
    n = F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
    name = paths.conflict_copy_name(F.col("p"), F.when(F.col("slot") == 0, F.lit(label)).otherwise(F.concat(F.lit(f"{label} "), (F.col("slot") + 1).cast("string"))), F.lit(seq))
    tried = conflicts.select("p", "t", "pcid", n.alias("slot")).withColumn("copy_name", name).withColumn("ckey", paths.casefold_key(F.col("copy_name")))
    there = local.select(F.col("key").alias("ckey"), F.col("t").alias("has_t"), F.col("pcid").alias("has_pcid"))
    free = F.col("has_t").isNull() | (F.col("has_t").eqNullSafe(F.col("t")) & F.col("has_pcid").eqNullSafe(F.col("pcid")))
    open_ = cut_lineage(tried.join(there, "ckey", "left").filter(free).join(blocked.select(F.col("key").alias("ckey")), "ckey", "left_anti").select("p", "slot", "copy_name", "ckey"))
    done = None
    left = conflicts.select("p").distinct()
    while True:
        wish = open_.groupBy("p").agg(F.min_by(F.struct("copy_name", "ckey"), "slot").alias("w")).select("p", "w.*")
        if not left.join(wish, "p", "left_anti").isEmpty():
            raise ValueError(f"all {slots} names for a conflict copy are taken")
        won = cut_lineage(wish.groupBy("ckey").agg(F.min(F.struct("p", "copy_name")).alias("w")).select("ckey", "w.*"))
        done = won if done is None else done.unionByName(won)
        left = left.join(won, "p", "left_anti")
        if left.isEmpty():
            return done.select("p", "copy_name")
        open_ = cut_lineage(open_.join(won.select("p"), "p", "left_anti").join(won.select("ckey"), "ckey", "left_anti"))


def execute(base: DataFrame, local: DataFrame, remote: DataFrame, blobs: DataFrame, label: str, seq: int) -> DataFrame:
    """key, action, p, pcid, content, copy_name: the whole plan of a reconcile.

    Verdicts first; the same key under two spellings is a conflict whatever the content. Conflicting files with a
    common base try a line merge: a clean one is written as `merge`. Every other conflict takes the remote side and
    keeps the local one under a free copy name (`keep_both`), unless it lies parked with the same content already (`take`).
    """
    seen = resolve(three_way(base, local, remote), label, seq)
    spelled = F.col("l").isNotNull() & F.col("r").isNotNull() & (F.col("l.p") != F.col("r.p"))
    seen = cut_lineage(seen.withColumn("verdict", F.when(spelled, "ConflictCopy").otherwise(F.col("verdict"))))
    conflict = seen.filter("verdict = 'ConflictCopy'")
    merged = merge_conflicts(conflict.filter("l.t = 0 and r.t = 0 and b.t = 0 and l.p = r.p"), blobs).filter("status = 'clean'").select("key", "content")
    merged = cut_lineage(merged)
    rest = conflict.join(merged, "key", "left_anti")
    parked = parked_copy_exists(rest, local).select("key").distinct()
    keep = rest.join(parked, "key", "left_anti").select("key", "l.p", "l.t", "l.pcid")
    blocked = remote.select("key").unionByName(base.join(remote, "key", "left_anti").select("key"))
    names = copy_paths(keep, local, blocked, label, seq).join(keep.select("p", "key"), "p").select("key", F.col("copy_name").alias("copy"))
    v = F.col("verdict")
    action = (
        F.when(F.col("content").isNotNull(), "merge").when(F.col("copy").isNotNull(), "keep_both").when(v == "ConflictCopy", "take")
        .when(v == "FastForwardToRemote", "take").when(v == "TakeRemoteDeletion", "delete")
        .when((v == "DeleteVsEditKeepEdit") & F.col("l").isNull(), "take").otherwise("none")
    )
    out = seen.drop("copy_name").join(merged, "key", "left").join(names, "key", "left").withColumn("action", action)
    side = F.when(F.col("action").isin("merge", "delete"), F.col("l")).when(F.col("action") != "none", F.col("r"))
    pcid = F.when(F.col("action") == "merge", F.sha2("content", 256)).when(F.col("action") != "delete", side["pcid"])
    return out.select("key", "action", side["p"].alias("p"), pcid.alias("pcid"), "content", F.col("copy").alias("copy_name"))
