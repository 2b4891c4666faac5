"""The local index: ordered listing, lookups by key, presence and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathledger.functions import paths

# Exit codes by class of error.
EXIT_CODES = {"not_authenticated": 3, "unavailable": 4, "conflict": 5, "refused": 6, "space_locked": 7}


def entries(index: DataFrame, space: str | int) -> DataFrame:
    """A space's entries by case-folded key, then path."""
    return index.filter(F.col("space_id") == space).orderBy("casefold_key", "path")


def by_path(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entries for the (space_id, path) pairs asked for."""
    return index.join(wanted.select("space_id", "path").distinct(), ["space_id", "path"], "left_semi")


def by_casefold(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entries whose key is that of a path asked for, in whatever spelling."""
    keys = wanted.select("space_id", paths.casefold_key(F.col("path")).alias("casefold_key")).distinct()
    return index.join(keys, ["space_id", "casefold_key"], "left_semi")


def known_blocks(dedup: DataFrame, wanted: DataFrame) -> DataFrame:
    """pcid, cid of contents that the account has stored already."""
    return dedup.join(wanted.select("account_id", "pcid").distinct(), ["account_id", "pcid"], "left_semi").select("account_id", "pcid", "cid")


def presence(wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """The wanted (space_id, cid) with `present`."""
    have = blocks.select("space_id", "cid").distinct().withColumn("present", F.lit(True))
    return wanted.join(have, ["space_id", "cid"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def status_counts(index: DataFrame) -> DataFrame:
    """Per space: tracked paths and, among them, conflict copies. Local-only rows don't count, but for derived folders (type 2)."""
    tracked = index.filter("local_only = 0 or type = 2")
    return tracked.groupBy("space_id").agg(F.count("*").alias("tracked"), F.count_if(paths.is_conflict_copy(F.col("path"))).alias("conflict_copies"))


def union_of_prefixes(objects: DataFrame, prefixes: list[str]) -> DataFrame:
    """Objects under any of a few prefixes; overlapping prefixes count an object once."""
    under = F.lit(False)
    for p in prefixes:
        under = under | F.col("key").startswith(p)
    return objects.filter(under)


def exit_code(kind: Column) -> Column:
    """The exit code of an error class; 0 for none, 1 for any class without a code of its own."""
    out = F.when(kind.isNull(), 0)
    for name, code in EXIT_CODES.items():
        out = out.when(kind == name, code)
    return out.otherwise(1)
