"""The local index as a table whose batches apply whole or not at all.

Rows lie in buckets by a hash of their key. A batch rewrites the buckets that it touches beside the old ones, then one new version,
which names the file set of every bucket, is created under the next number if nobody else has it. Until then readers see the old
version, afterwards the new one; a batch that fails leaves files that no version names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathledger.operators import revlog
from pathledger.runtime import cut_lineage
from pathledger.sources.revisions import newest

BUCKETS = 64
LOG = "versions"


def _current(spark: SparkSession, folder: str) -> tuple[int | None, dict]:
    head, content = newest(spark, folder, LOG)
    return head, content or {"buckets": {}}


def _rows(spark: SparkSession, folder: str, schema, buckets: dict[str, str]) -> DataFrame:
    names = [f"{folder}/data/{tx}/bucket={b}" for b, tx in sorted(buckets.items())]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def read(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of the newest version; an index that was never written is empty."""
    return _rows(spark, folder, schema, _current(spark, folder)[1]["buckets"])


def apply(batch: DataFrame, folder: str, keys: list[str], how: str = "upsert", attempts: int = revlog.MOST_ATTEMPTS) -> dict[str, int]:
    """Apply a batch as one transaction; returns how many rows were inserted, updated, deleted and kept as they were.

    how: upsert (the batch's row replaces the stored one), ignore (the stored one stays) or delete (the batch needs the keys alone).
    Of rows of one key in a batch the greatest counts. Buckets without rows of the batch aren't read. A writer that loses the race
    for a version starts anew from the one that won.
    """
    if how not in ("upsert", "ignore", "delete"):
        raise ValueError("how is upsert, ignore or delete")
    spark = batch.sparkSession
    values = [c for c in batch.columns if c not in keys] if how != "delete" else []
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")
    row = F.struct(*(values or [F.lit(1).alias("one")]))
    news = cut_lineage(batch.groupBy(*keys).agg(F.max(row).alias("new")))
    touched = [str(r[0]) for r in news.select(bucket).distinct().collect()]  # BUCKETS at most
    for _ in range(attempts):
        head, content = _current(spark, folder)
        old_buckets = content["buckets"]
        schema = batch.schema if how != "delete" else content.get("schema")
        if schema is None or not touched:
            return {"inserted": 0, "updated": 0, "deleted": 0, "kept": 0}
        mine = {b: old_buckets[b] for b in touched if b in old_buckets}
        stored = _rows(spark, folder, schema, mine)
        columns = stored.columns
        values = [c for c in columns if c not in keys]
        old = stored.select(*keys, F.struct(*values).alias("old")) if values else stored.select(*keys, F.struct(F.lit(1).alias("one")).alias("old"))
        both = old.join(news, keys, "full_outer")
        is_new, is_old = F.col("new").isNotNull(), F.col("old").isNotNull()
        if how == "delete":
            fate = F.when(is_new & is_old, "deleted").when(is_old, "kept")
            value = F.col("old")
        else:
            fate = F.when(~is_old, "inserted").when(is_new & ~F.col("new").eqNullSafe(F.col("old")), "updated" if how == "upsert" else "kept").otherwise("kept")
            value = F.when(is_new & F.lit(how == "upsert"), F.col("new")).otherwise(F.coalesce("old", "new"))
        merged = cut_lineage(both.select(*keys, value.alias("v"), fate.alias("fate"), bucket).filter("fate is not null"))
        counts = {r.fate: r.n for r in merged.groupBy("fate").agg(F.count("*").alias("n")).collect()}
        tx = uuid.uuid4().hex
        out = merged.filter("fate <> 'deleted'").select(*keys, *(F.col(f"v.{c}").alias(c) for c in values), "bucket").select(*columns, "bucket")
        out.repartition("bucket").sortWithinPartitions("bucket", *keys).write.partitionBy("bucket").parquet(f"{folder}/data/{tx}")
        full = {str(r[0]) for r in merged.filter("fate <> 'deleted'").select("bucket").distinct().collect()}
        kept = {b: t for b, t in old_buckets.items() if b not in touched} | {b: tx for b in touched if b in full}
        body = {"buckets": kept, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema), "counts": counts}
        if revlog.commit(spark, folder, LOG, head, json.dumps(body, sort_keys=True).encode()) is not None:
            return {k: counts.get(k, 0) for k in ("inserted", "updated", "deleted", "kept")}
    raise RuntimeError(f"{folder}: {attempts} attempts lost the race")
