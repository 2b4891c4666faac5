"""Queries through the sources and sinks: trees on disk, listings, metrics files, the revision log as a stream, commits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathledger.functions import paths
from pathledger.operators import revlog
from pathledger.plans import sync_catalog  # noqa: F401
from pathledger.plans.catalog import ORACLES, QUERIES, query
from pathledger.runtime import checkpoint_dir, table
from pathledger.sources import objects, revisions


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, as a local path, since trees and the log's source are reached through the file system."""
    scheme, _, rest = checkpoint_dir(spark).rpartition(":")
    if scheme not in ("", "file"):
        raise RuntimeError("trees need a shared folder that is mounted")
    return f"/{rest.lstrip('/')}/{name}-{uuid.uuid4().hex}"


def files(df: DataFrame, p, content) -> DataFrame:
    return df.select(p.alias("p"), F.lit(0).alias("t"), F.lit(False).alias("x"), F.lit(None).cast("string").alias("lt"), content.cast("binary").alias("content"))


TREE = "concat(CASE WHEN doc_id % 7 = 0 THEN 'logs' WHEN doc_id % 7 = 1 THEN concat(lang, '/target') ELSE concat(lang, '/', source) END, '/', doc_id, CASE WHEN doc_id % 7 = 2 THEN '.lnk' ELSE '.txt' END)"


@query("tree_round_trip", f"""WITH e AS (SELECT *, {TREE} AS p FROM documents), items AS (SELECT * FROM e WHERE doc_id % 7 > 1),
folders AS (SELECT DISTINCT lang AS p, 'item' AS route FROM items UNION SELECT DISTINCT lang || '/' || source, 'item' FROM items UNION SELECT DISTINCT lang, 'item' FROM e WHERE doc_id % 7 = 1
UNION SELECT DISTINCT lang || '/target', 'derived' FROM e WHERE doc_id % 7 = 1 UNION SELECT 'logs', 'ignored' FROM e WHERE doc_id % 7 = 0)
SELECT p, CASE WHEN doc_id % 7 = 2 THEN 1 ELSE 0 END AS t, doc_id % 7 = 3 AS x, CASE WHEN doc_id % 7 = 2 THEN '../' || source || '/' || doc_id END AS lt, CASE WHEN doc_id % 7 <> 2 THEN coalesce(octet_length(encode(text)), 0) END AS sz, 'item' AS route FROM items
UNION ALL SELECT p, 3, FALSE, NULL, NULL, route FROM folders""")
def tree_round_trip(spark, sf):
    """documents written as a tree (every seventh a link, every seventh executable, some in an ignored or rebuilt folder) and walked
    again: folders that aren't to be synchronised cost one row, links aren't followed."""
    k, p = F.col("doc_id") % 7, F.expr(TREE)
    d = table(spark, sf, "documents")
    to = F.concat_ws("/", F.lit(".."), F.col("source"), F.col("doc_id").cast("string"))
    entries = d.select(p.alias("p"), F.when(k == 2, 1).otherwise(0).alias("t"), (k == 3).alias("x"), F.when(k == 2, to).alias("lt"), F.col("text").cast("binary").alias("content"))
    folder = fresh_folder(spark, "tree")
    objects.materialize(entries, folder)
    got = objects.walk_tree(spark, folder, ["logs/"])
    t = F.when(F.col("is_symlink"), 1).when(F.col("is_dir"), 3).otherwise(0)
    return got.select("p", t.alias("t"), "x", "lt", F.when(t == 0, F.col("sz")).alias("sz"), "route")


@query("listed_blocks", "SELECT DISTINCT 'blocks/' || substr(cid, 1, 2) || '/' || cid AS key, sz FROM (SELECT sha256(text) AS cid, octet_length(encode(text)) AS sz FROM documents WHERE text IS NOT NULL) WHERE cid LIKE 'a%'")
def listed_blocks(spark, sf):
    """Texts as block objects under their ids; those whose id starts with a are listed from their own folders alone."""
    d = table(spark, sf, "documents").filter("text is not null")
    folder = fresh_folder(spark, "objects")
    objects.materialize(files(d, paths.object_key("blocks", F.sha2("text", 256)), F.col("text")).dropDuplicates(["p"]), folder)
    return objects.listing(spark, folder, "blocks/a").select("key", F.col("size").alias("sz"))


@query("metrics_on_disk", ORACLES["space_metrics"].replace("SELECT space_id", "SELECT CAST(space_id AS VARCHAR) AS space_id", 1))
def metrics_on_disk(spark, sf):
    """Each space's metrics written as JSON and read back, all fields."""
    folder = f"{checkpoint_dir(spark)}/metrics-{uuid.uuid4().hex}"
    objects.save_metrics(QUERIES["space_metrics"](spark, sf), folder)
    return objects.load_metrics(spark, folder)


LOG_SQL = "SELECT CAST(s_nationkey AS VARCHAR) AS space_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS seq, s_name AS payload FROM supplier"


def supplier_log(spark: SparkSession, sf: str, name: str) -> tuple[DataFrame, str]:
    """(revisions, folder) of a log on disk: a space a nation, a revision a supplier."""
    rank = F.expr("row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1").cast("bigint")
    log = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("space_id"), rank.alias("seq"), F.col("s_name").alias("payload"))
    folder = fresh_folder(spark, name)
    entries = files(log, F.concat_ws("/", "space_id", "seq"), F.col("payload"))
    objects.materialize(entries.repartition(max(8, spark.sparkContext.defaultParallelism)), folder)  # so few bytes would be one task's
    return log, folder


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives until nothing is left, as a table."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query("feed_source", f"WITH r AS ({LOG_SQL}) SELECT 'all' AS start, space_id, seq, payload FROM r UNION ALL SELECT 'head', space_id, max(seq), arg_max(payload, seq) FROM r GROUP BY space_id")
def feed_source(spark, sf):
    """The revision log read as a stream: from the first revision, and from each space's head."""
    _, folder = supplier_log(spark, sf, "feed")
    out = [drained(revisions.revision_stream(spark, folder, start), fresh_folder(spark, "fed")).withColumn("start", F.lit(start)) for start in ("all", "head")]
    return out[0].unionByName(out[1]).withColumn("payload", F.col("payload").cast("string"))


@query("feed_catch_up", f"WITH r AS ({LOG_SQL}), h AS (SELECT space_id, max(seq) AS head FROM r GROUP BY space_id) SELECT * FROM r UNION ALL SELECT space_id, head + 1, 'theirs' FROM h UNION ALL SELECT space_id, head + 2, 'ours' FROM h")
def feed_catch_up(spark, sf):
    """Each space on its start: it pulls its head, another writer moves it, the commit is refused; it pulls again and commits behind the other.

    Returns the logs as the stream then gives them. The loop over spaces (one a nation) is the clients' own: a commit is one rename.
    """
    log, folder = supplier_log(spark, sf, "catchup")
    for (space,) in log.select("space_id").distinct().collect():
        heads: list[int | None] = []

        def push(space=space, heads=heads):
            if len(heads) == 1:
                revlog.commit(spark, folder, space, heads[-1], b"theirs")
            return revlog.commit(spark, folder, space, heads[-1], b"ours")

        revlog.catch_up(lambda space=space, heads=heads: heads.append(revisions.head(spark, folder, space)), push)
    return drained(revisions.revision_stream(spark, folder, "all"), fresh_folder(spark, "caught")).withColumn("payload", F.col("payload").cast("string"))


BATCH = "query string, batch bigint, data string, applied map<string, bigint>"


@query("committed_batches", "SELECT CAST(k AS BIGINT) AS seq, CAST(k AS BIGINT) AS batch, (SELECT count(*) FROM documents WHERE doc_id % 4 = k) AS n_rows, (SELECT CAST(coalesce(sum(n_chars), 0) AS BIGINT) FROM documents WHERE doc_id % 4 = k) AS chars FROM range(4) r(k)")
def committed_batches(spark, sf):
    """documents in four micro-batches through the committing sink, each of them handed over twice, as after a crash: one revision a batch."""
    folder = fresh_folder(spark, "sink")
    sink = revisions.committing_sink(spark, folder, "s", "docs")
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    for k in range(4):
        for _ in range(2):
            sink(d.filter(F.col("doc_id") % 4 == k), k)
    log = drained(revisions.revision_stream(spark, folder, "all"), fresh_folder(spark, "sunk"))
    log = log.select("seq", F.from_json(F.col("payload").cast("string"), BATCH).alias("b")).select("seq", "b.batch")
    data = spark.read.schema("doc_id bigint, n_chars bigint").parquet(*[f"{folder}/s/_data/docs-{k}" for k in range(4)])
    batch = F.regexp_extract(F.input_file_name(), r"/docs-(\d+)/", 1).cast("bigint")
    sums = data.groupBy(batch.alias("batch")).agg(F.count("*").alias("n_rows"), F.sum("n_chars").alias("chars"))
    return log.join(sums, "batch", "left").select("seq", "batch", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("chars", F.lit(0)).alias("chars"))
