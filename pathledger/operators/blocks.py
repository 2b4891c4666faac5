"""Blocks: presence, reassembly and the local index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def block_lists(pieces: DataFrame, owner: str, order: list[str], block: str) -> DataFrame:
    """Ordered block ids of each owner."""
    ordered = F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*order, block]))))
    return pieces.groupBy(owner).agg(F.transform(ordered, lambda s: s[block]).alias("bk"))


def missing(needed: DataFrame, have: DataFrame, cid: str = "cid", first_commit: bool = False) -> DataFrame:
    """Distinct needed blocks that the store lacks; a first commit has nothing to compare with."""
    want = needed.select(cid).distinct()
    return want if first_commit else want.join(have.select(cid), cid, "left_anti")


def complete_owners(pieces: DataFrame, have: DataFrame, owner: str, cid: str = "cid") -> DataFrame:
    """Owners all of whose blocks are present."""
    lacking = pieces.join(have.select(cid).distinct(), cid, "left_anti").select(owner).distinct()
    return pieces.select(owner).distinct().join(lacking, owner, "left_anti")


def stale(have: DataFrame, referenced: DataFrame, cid: str = "cid") -> DataFrame:
    return have.join(referenced.select(cid).distinct(), cid, "left_anti")


def dereference(entries: DataFrame, lists: DataFrame) -> DataFrame:
    """bk from the entry or, by reference, from the side table; a list that fails its hash is an error."""
    ok = F.sha2(F.array_join("list", ","), 256) == F.col("bk_ref")
    good = lists.withColumn("list", F.when(F.assert_true(ok, F.lit("block list fails its hash")).isNull(), F.col("list")))
    return entries.join(good, "bk_ref", "left").withColumn("bk", F.coalesce("bk", "list")).drop("list")


def reassemble(pieces: DataFrame, blobs: DataFrame, owner: str) -> DataFrame:
    """Owner, content. pieces: owner, pos, cid; blobs: cid, bytes. Order comes from pos, not from the shuffle."""
    got = pieces.join(blobs.dropDuplicates(["cid"]), "cid", "left")
    whole = F.expr("listagg(bytes) WITHIN GROUP (ORDER BY pos)")  # one buffer, however many blocks
    return got.groupBy(owner).agg(F.count_if(F.col("bytes").isNull()).alias("lost"), F.coalesce(whole, F.lit(b"")).alias("content"))


def verified(whole: DataFrame, expected: DataFrame, owner: str) -> DataFrame:
    """ok: nothing is lost, the content's hash and size are the ones expected (pcid, sz)."""
    j = whole.join(expected, owner)
    return j.withColumn("ok", (F.col("lost") == 0) & (F.sha2("content", 256) == F.col("pcid")) & (F.octet_length("content") == F.col("sz")))


def upsert(index: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key: union, newest by max_by, one shuffle with partial aggregation."""
    cols = [c for c in index.columns if c not in keys]
    both = index.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*cols), "_new").alias("_s"))
    return best.select(*keys, "_s.*").select(*index.columns)


def insert_or_ignore(index: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    fresh = rows.dropDuplicates(keys).join(index.select(*keys), keys, "left_anti")
    return index.unionByName(fresh)


def delete(index: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return index.join(rows.select(*keys).distinct(), keys, "left_anti")


def first_write_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*cols), order).alias("_s")).select(*keys, "_s.*").select(*df.columns)


def get_or_create_devices(devices: DataFrame, wanted: DataFrame) -> DataFrame:
    """One device per (account, name): the stored one, else the first wanted; a missing secret is filled in."""
    both = devices.withColumn("_o", F.lit(0)).unionByName(wanted.withColumn("_o", F.lit(1)))
    w = W.partitionBy("account_id", "name").orderBy("_o", "device_id")
    secret = F.first("secret", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return both.withColumns({"secret": secret, "_n": F.row_number().over(w)}).filter("_n = 1").drop("_n", "_o")


def claim_account(devices: DataFrame, spaces: DataFrame, source: str, target: str) -> DataFrame:
    """Move the source's devices to the target, but for names that the target has. A target with spaces is an error."""
    if not spaces.filter(F.col("account_id") == target).isEmpty():
        raise ValueError("the target account owns spaces")
    names = devices.filter(F.col("account_id") == target).select("name")
    moved = devices.filter(F.col("account_id") == source).join(names, "name", "left_anti").withColumn("account_id", F.lit(target))
    return devices.filter(~F.col("account_id").isin(source)).unionByName(moved.select(*devices.columns))


def owned(rows: DataFrame, spaces: DataFrame, account: str) -> DataFrame:
    return rows.join(spaces.filter(F.col("account_id") == account).select("space_id"), "space_id", "left_semi")


def with_local_folder(spaces: DataFrame, mapping: DataFrame) -> DataFrame:
    return spaces.join(mapping, "space_id", "left").withColumn("mapped", F.col("local_root_path").isNotNull())
