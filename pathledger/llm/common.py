"""What the operators share: tables, reliable checkpoints, components."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathledger.runtime import checkpoint_dir, cut_lineage, table

__all__ = ["balanced_cuts", "checkpoint_dir", "components", "cut_lineage", "frees_shuffles", "id_bins", "partitions", "table"]


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def frees_shuffles(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The shuffle files of an operator's queries go as each query ends, those of its result when that has been read.

    What later steps need is checkpointed, so nothing reads them again; a result that is read twice is made twice.
    """

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        conf = docs.sparkSession.conf
        before = conf.get(CLEANUP)
        conf.set(CLEANUP, "true")
        try:
            return operator(docs, *args, **kwargs)
        finally:
            conf.set(CLEANUP, before)

    return run


def partitions(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for nodes of undirected edges (a, b).

    Alternating large-star and small-star: stars merge in a logarithmic number of rounds, each a partial
    aggregation and a join; a hub with very many neighbours is a skewed join key, which adaptive execution splits.
    """
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = cut_lineage(small)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError("components did not settle")
    leaves = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


BINS = 2048


def merged(edges: list[int], weights: list[int], most: int) -> tuple[list[int], list[int]]:
    """Neighbouring bins joined while they weigh `most` at most."""
    out_e: list[int] = []
    out_w: list[int] = []
    for e, w in zip(edges, weights):
        if out_w and out_w[-1] + w <= most:
            out_w[-1] += w
        else:
            out_e.append(e)
            out_w.append(w)
    return out_e, out_w


def id_bins(narrow: DataFrame, key: str, weight, bins: int = BINS) -> tuple[Callable[[DataFrame], DataFrame], dict[int, int]]:
    """(adds a column `bin`, weight of each bin): ranges of an integer key, ascending; null keys are bin -1.

    No bin weighs more than a `bins`-th of the whole, but for single keys: equal widths first, then heavy bins are divided
    again, so neither a far id nor a cluster crowds a bin. Exact and the same every time. A table of some thousand
    numbers reaches the driver in each of a few rounds.
    """
    low, high, total = narrow.agg(F.min(key), F.max(key), F.coalesce(F.sum(weight), F.lit(0))).first()
    spark = narrow.sparkSession
    low, high = (0, 0) if low is None else (int(low), int(high))
    most = max(1, int(total) // bins)

    def binner(edges: list[int]) -> Callable[[DataFrame], DataFrame]:
        rows = [edges[i : i + 64] for i in range(0, len(edges), 64)]
        cuts = spark.createDataFrame([([r[0] for r in rows], rows)], "coarse array<bigint>, fine array<array<bigint>>")

        def add(df: DataFrame) -> DataFrame:
            reached = lambda a: F.size(F.filter(a, lambda x: x <= F.col(key)))
            at = F.greatest(reached(F.col("coarse")), F.lit(1))
            fine = (at - 1) * 64 + reached(F.element_at("fine", at)) - 1
            return df.crossJoin(F.broadcast(cuts)).withColumn("bin", F.coalesce(F.when(F.col(key).isNotNull(), fine), F.lit(-1)).cast("int")).drop("coarse", "fine")  # one row

        return add

    def split(a: int, b: int, n: int) -> list[int]:
        n = min(n, b - a)
        return [a + (b - a) * i // n for i in range(n)]

    edges = split(low, high + 1, 4096)
    while True:
        add = binner(edges)
        got = {r.bin: int(r.w) for r in add(narrow.select(key, weight.alias("w"))).groupBy("bin").agg(F.sum("w").alias("w")).collect()}
        ends = [*edges[1:], high + 1]
        heavy = [i for i in range(len(edges)) if got.get(i, 0) > most and ends[i] - edges[i] > 1]
        if not heavy:
            break
        split_up = set(heavy)
        nxt: list[int] = []
        for i, (a, b) in enumerate(zip(edges, ends)):
            nxt += split(a, b, 64) if i in split_up else [a] if got.get(i, 0) or not nxt else []
        edges = nxt
    kept, weights = merged(edges, [got.get(i, 0) for i in range(len(edges))], most)
    out = dict(enumerate(weights)) | ({-1: got[-1]} if -1 in got else {})
    return binner(kept), out


def balanced_cuts(weights: dict[int, int], shards: int) -> dict[int, int]:
    """bin -> shard: contiguous, cut at equal targets of the weight before each bin's middle."""
    total, before, out = max(1, sum(weights.values())), 0, {}
    for b in sorted(weights):
        out[b] = min(shards - 1, (2 * before + weights[b]) * shards // (2 * total))
        before += weights[b]
    return out
