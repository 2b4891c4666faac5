"""Contiguous balanced shards by global byte-size prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathledger.llm.common import BINS, cut_lineage, id_bins


def shard_by_bytes(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", bins: int = BINS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: documents in key order, cut at equal byte targets.

    Size is the text's UTF-8 bytes plus 1 (null text: 1). A document belongs to the shard in which its first byte
    falls, so sizes differ from the target by less than one document. Rows of a null key come first; rows that
    share a key stand together, in no order to rely on. Other columns of the
    input are ignored whatever their names; an empty table gives an empty result.

    One scan reads the text and keeps three numbers a row. Ranges of the key take the part of partitions: no range
    weighs more than a `bins`-th, and one that a single repeated key fills is divided by checksum and by the task that
    read the row. The ranges' totals are summed in order, then each runs its own window from its offset.
    """
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    narrow = cut_lineage(docs.select(F.col(key).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.spark_partition_id().alias("task")))
    add_bin, weights = id_bins(narrow, "doc_id", F.col("size"), bins)
    most = 2 * max(1, sum(weights.values()) // bins)
    heavy = F.col("bin").isin([b for b, w in weights.items() if w > most] or [-2])
    binned = add_bin(narrow).withColumns({"part": F.when(heavy, F.shiftright("text_crc32", 24)).otherwise(0).cast("int"), "task": F.when(heavy, F.col("task")).otherwise(0)})
    at = ["bin", "part", "task"]
    totals = binned.groupBy(*at).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    up_to = W.orderBy(*at).rowsBetween(W.unboundedPreceding, W.currentRow)
    everything = W.orderBy(*at).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = totals.select(*at, (F.sum("bytes").over(up_to) - F.col("bytes")).alias("bytes_before"), (F.sum("n").over(up_to) - F.col("n")).alias("rows_before"), F.sum("bytes").over(everything).alias("total"))
    inside = W.partitionBy(*at).orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = binned.join(F.broadcast(offsets), at).select(
        "doc_id", "size", "text_crc32", "total", (F.col("bytes_before") + F.sum("size").over(inside) - F.col("size")).alias("start"), (F.col("rows_before") + F.count("*").over(inside) - 1).alias("rank")
    )
    cut = cut_lineage(placed.withColumn("shard", F.least(F.floor(F.col("start") * F.lit(shards).cast("decimal(10,0)") / F.col("total")).cast("int"), F.lit(shards - 1))))
    first = cut.groupBy("shard").agg(F.min("rank").alias("first_rank"))  # one row a shard
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first_rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
