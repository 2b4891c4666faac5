"""The query catalog: operators bound to the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathledger.functions import cdc, paths
from pathledger.functions.content import canonical_row
from pathledger.functions.merge3 import merge3_udf
from pathledger.operators import blocks, diff, gc, pages, reconcile, revlog, snapshot
from pathledger.runtime import table
from pathledger.streaming import feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


PATH = "concat(lang, '/', source, '/Doc_', cast(doc_id as string), '.txt')"
PATH_SQL = "lang || '/' || source || '/Doc_' || CAST(doc_id AS VARCHAR) || '.txt'"
SECRET = bytes([0x5A]) * 32


def side(spark: SparkSession, sf: str, drop: int, edit: int, mark: str) -> DataFrame:
    """documents as a snapshot; rows with doc_id % drop = 1 are absent, those with doc_id % edit = 2 edited."""
    d = table(spark, sf, "documents").filter(F.col("doc_id") % drop != 1)
    text = F.when(F.col("doc_id") % edit == 2, F.concat("text", F.lit(mark))).otherwise(F.col("text"))
    return snapshot.from_content(d, F.expr(PATH), text)


def side_sql(drop: int, edit: int, mark: str) -> str:
    return (
        f"SELECT lower({PATH_SQL}) AS key, {PATH_SQL} AS p, octet_length(encode(tx)) AS sz, sha256(tx) AS pcid FROM "
        f"(SELECT *, CASE WHEN doc_id % {edit} = 2 THEN text || '{mark}' ELSE text END AS tx FROM documents WHERE doc_id % {drop} <> 1)"
    )


OLD, NEW = (25, 10**9, ""), (31, 17, "+")
DIFF_SQL = f"""WITH a AS ({side_sql(*OLD)}), b AS ({side_sql(*NEW)})
SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'Added' WHEN b.key IS NULL THEN 'Deleted' ELSE 'Modified' END AS change,
a.pcid AS old_pcid, b.pcid AS new_pcid FROM a FULL OUTER JOIN b ON a.key = b.key WHERE a.pcid IS DISTINCT FROM b.pcid"""


@query("snapshot_diff", DIFF_SQL)
def snapshot_diff(spark, sf):
    return diff.diff(side(spark, sf, *OLD), side(spark, sf, *NEW))


@query("snapshot_diff_pruned", DIFF_SQL)
def snapshot_diff_pruned(spark, sf):
    (a, la), (b, lb) = (pages.leaves(side(spark, sf, *x)) for x in (OLD, NEW))
    return diff.diff_pruned(a, b, la, lb)


@query("first_clone", f"SELECT key, 'Added' AS change, CAST(NULL AS VARCHAR) AS old_pcid, pcid AS new_pcid FROM ({side_sql(*NEW)})")
def first_clone(spark, sf):
    return snapshot.added(side(spark, sf, *NEW))


ROW_SQL = "key || chr(31) || p || chr(31) || '0' || chr(31) || 'false' || chr(31) || CAST(sz AS VARCHAR) || chr(31) || pcid || chr(31) || chr(0)"
LEAF_SQL = f"""SELECT CAST(page AS BIGINT) AS page, min(key) AS first, max(key) AS last, count(*) AS n, sha256(string_agg(row, '|' ORDER BY key)) AS page_cid
FROM (SELECT key, {ROW_SQL} AS row, (row_number() OVER (ORDER BY key) - 1) // 256 AS page FROM ({side_sql(1, 10**9, "")})) GROUP BY page"""


@query("manifest_leaves", LEAF_SQL)
def manifest_leaves(spark, sf):
    return pages.leaves(side(spark, sf, 1, 10**9, ""))[1]


@query(
    "manifest_root",
    f"""WITH leaf AS ({LEAF_SQL}),
i1 AS (SELECT page // 256 AS page, min(first) AS first, count(*) AS n, sha256(string_agg(first || chr(31) || page_cid, '|' ORDER BY page)) AS page_cid FROM leaf GROUP BY page // 256),
i2 AS (SELECT sha256(string_agg(first || chr(31) || page_cid, '|' ORDER BY page)) AS page_cid FROM i1)
SELECT CASE WHEN (SELECT count(*) FROM leaf) = 1 THEN (SELECT max(page_cid) FROM leaf) WHEN (SELECT count(*) FROM i1) = 1 THEN (SELECT max(page_cid) FROM i1) ELSE (SELECT page_cid FROM i2) END AS root,
CASE WHEN (SELECT count(*) FROM leaf) = 1 THEN 1 WHEN (SELECT count(*) FROM i1) = 1 THEN 2 ELSE 3 END AS levels,
(SELECT count(*) FROM leaf) + CASE WHEN (SELECT count(*) FROM leaf) = 1 THEN 0 ELSE (SELECT count(*) FROM i1) END + CASE WHEN (SELECT count(*) FROM i1) = 1 THEN 0 ELSE 1 END AS pages""",
)
def manifest_root(spark, sf):
    return pages.root(side(spark, sf, 1, 10**9, "")).select("root", "levels", "pages")


BASE, LOCAL, REMOTE = (1, 10**9, ""), (13, 7, "L"), (11, 5, "R")
VERDICT_SQL = f"""WITH b AS ({side_sql(*BASE)}), l AS ({side_sql(*LOCAL)}), r AS ({side_sql(*REMOTE)}),
k AS (SELECT key FROM b UNION SELECT key FROM l UNION SELECT key FROM r),
j AS (SELECT k.key, b.pcid AS bp, l.pcid AS lp, r.pcid AS rp, l.p AS path FROM k LEFT JOIN b USING (key) LEFT JOIN l USING (key) LEFT JOIN r USING (key))
SELECT key, CASE WHEN bp IS NOT DISTINCT FROM lp AND bp IS NOT DISTINCT FROM rp THEN 'NoChange'
WHEN bp IS NOT DISTINCT FROM rp THEN CASE WHEN lp IS NULL THEN 'KeepLocal' ELSE 'FastForwardToLocal' END
WHEN bp IS NOT DISTINCT FROM lp THEN CASE WHEN rp IS NULL THEN 'TakeRemoteDeletion' ELSE 'FastForwardToRemote' END
WHEN lp IS NULL AND rp IS NULL THEN 'NoChange' WHEN lp IS NULL OR rp IS NULL THEN 'DeleteVsEditKeepEdit'
WHEN lp = rp THEN 'NoChange' ELSE 'ConflictCopy' END AS verdict, lp, rp, path FROM j"""


def verdicts(spark, sf):
    return reconcile.resolve(reconcile.three_way(*(side(spark, sf, *x) for x in (BASE, LOCAL, REMOTE))), "laptop", 7)


@query("three_way_verdict", f"SELECT key, verdict, lp AS local_pcid, rp AS remote_pcid FROM ({VERDICT_SQL})")
def three_way_verdict(spark, sf):
    return verdicts(spark, sf).select("key", "verdict", F.col("l.pcid").alias("local_pcid"), F.col("r.pcid").alias("remote_pcid"))


@query("three_way_summary", f"SELECT verdict, count(*) AS n FROM ({VERDICT_SQL}) GROUP BY verdict")
def three_way_summary(spark, sf):
    return verdicts(spark, sf).groupBy("verdict").agg(F.count("*").alias("n"))


@query("conflict_copy_names", f"SELECT key, regexp_replace(path, '\\.txt$', ' (conflicto laptop, seq 7).txt') AS copy_name FROM ({VERDICT_SQL}) WHERE verdict = 'ConflictCopy'")
def conflict_copy_names(spark, sf):
    return verdicts(spark, sf).filter("verdict = 'ConflictCopy'").select("key", "copy_name")


@query("conflict_copies_recognised", f"SELECT {PATH_SQL} AS origin, CAST(doc_id AS BIGINT) AS doc_id FROM documents")
def conflict_copies_recognised(spark, sf):
    name = paths.conflict_copy_name(F.expr(PATH), F.lit("a/b(c)"), F.col("doc_id"))
    return table(spark, sf, "documents").select(paths.conflict_origin(name).alias("origin"), "doc_id")


@query("content_dedup", f"SELECT sha256(text) AS pcid, count(*) AS copies, min({PATH_SQL}) AS first_path, max(octet_length(encode(text))) AS bytes, CAST(sum(octet_length(encode(text))) - max(octet_length(encode(text))) AS BIGINT) AS saved FROM documents GROUP BY 1")
def content_dedup(spark, sf):
    return snapshot.content_dedup(side(spark, sf, *BASE), "pcid", name="p", size="sz")


@query("block_lists", "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_suppkey, l_partkey) AS bk FROM lineitem GROUP BY 1")
def block_lists(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return blocks.block_lists(li, "l_orderkey", ["l_linenumber", "l_suppkey", "l_partkey"], "l_partkey").select("l_orderkey", F.array_join("bk", ",").alias("bk"))


HAVE = "p_partkey % 3 <> 0"


@query("missing_blocks", f"SELECT DISTINCT l_partkey AS cid FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE {HAVE})")
def missing_blocks(spark, sf):
    return blocks.missing(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("cid")), table(spark, sf, "part").filter(HAVE).select(F.col("p_partkey").alias("cid")))


@query("complete_owners", f"SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE {HAVE})) = 0")
def complete_owners(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("cid"))
    return blocks.complete_owners(li, table(spark, sf, "part").filter(HAVE).select(F.col("p_partkey").alias("cid")), "l_orderkey")


REFERENCED = "l_quantity > 49"


@query("stale_blocks", f"SELECT p_partkey AS cid FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE {REFERENCED})")
def stale_blocks(spark, sf):
    return blocks.stale(table(spark, sf, "part").select(F.col("p_partkey").alias("cid")), table(spark, sf, "lineitem").filter(REFERENCED).select(F.col("l_partkey").alias("cid")))


NOW, GRACE = 50 * 86400, 86400 * 9
LIVE_SQL = "SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_quantity > 48"
GC_SQL = f"""SELECT p_partkey AS key, p_size * 86400 AS mtime, CASE WHEN p_partkey IN ({LIVE_SQL}) THEN 'reachable'
WHEN {NOW} - p_size * 86400 >= {GRACE} + 3600 THEN 'sweepable' ELSE 'grace' END AS state FROM part"""


def gc_state(spark, sf):
    listed = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), (F.col("p_size") * 86400).cast("bigint").alias("mtime"))
    kept = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    live = table(spark, sf, "lineitem").filter("l_quantity > 48").join(kept, "l_orderkey", "left_semi").select(F.col("l_partkey").alias("key"))
    return gc.classify(listed, live, NOW, GRACE)


@query("gc_sweep_plan", f"SELECT key, CAST(mtime AS BIGINT) AS mtime FROM ({GC_SQL}) WHERE state = 'sweepable' ORDER BY mtime, key")
def gc_sweep_plan(spark, sf):
    return gc.sweep_plan(gc_state(spark, sf))


@query(
    "gc_report",
    f"""SELECT *, scanned >= 32 AND sweepable > scanned * 0.5 AS blocked FROM (SELECT count(*) AS scanned, count(*) FILTER (WHERE state = 'reachable') AS reachable,
count(*) FILTER (WHERE state = 'grace') AS kept_by_grace, count(*) FILTER (WHERE state = 'sweepable') AS sweepable FROM ({GC_SQL}))""",
)
def gc_report(spark, sf):
    return gc.report(gc_state(spark, sf))


@query("gc_future_skew", f"SELECT CASE WHEN max(p_size * 86400 - {20 * 86400}) > 0 THEN CAST(max(p_size * 86400 - {20 * 86400}) AS BIGINT) END AS future_seconds FROM part")
def gc_future_skew(spark, sf):
    return gc.future_skew(table(spark, sf, "part").select((F.col("p_size") * 86400).cast("bigint").alias("mtime")), 20 * 86400)


HEADS_SQL = "SELECT conv_id AS space_id, max(turn) AS head_seq FROM conversations {} GROUP BY 1"


@query("heads_moved", f"SELECT coalesce(a.space_id, b.space_id) AS space_id, a.head_seq AS before_seq, b.head_seq AS after_seq FROM ({HEADS_SQL.format('WHERE turn < 4')}) a FULL OUTER JOIN ({HEADS_SQL.format('')}) b ON a.space_id = b.space_id WHERE a.head_seq IS DISTINCT FROM b.head_seq")
def heads_moved(spark, sf):
    r = revisions(spark, sf)
    return gc.heads_moved(revlog.heads(r.filter("seq < 4")), revlog.heads(r))


@query("page_reachability", "WITH RECURSIVE t(node, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT d.doc_id, t.depth + 1 FROM t JOIN documents d ON d.doc_id <> 0 AND (d.doc_id - 1) // 8 = t.node AND d.doc_id % 7 <> 3) SELECT node, depth FROM t")
def page_reachability(spark, sf):
    d = table(spark, sf, "documents").filter("doc_id <> 0 and doc_id % 7 <> 3")
    edges = d.select(F.expr("(doc_id - 1) div 8").alias("parent"), F.col("doc_id").alias("child"))
    return pages.reachable(edges, spark.range(1).select(F.col("id").alias("node")))


def revisions(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("space_id"), F.col("turn").alias("seq"), F.sha2(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")), 256).alias("revision_id"),
                    F.when(F.col("turn") > 0, F.sha2(F.concat_ws("/", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")), 256)).alias("parent"))


@query("revision_head", "SELECT conv_id AS space_id, max(turn) AS head_seq, sha256(CAST(conv_id AS VARCHAR) || '/' || CAST(max(turn) AS VARCHAR)) AS head_revision, count(*) AS revisions FROM conversations GROUP BY 1")
def revision_head(spark, sf):
    return revlog.heads(revisions(spark, sf))


@query("chain_integrity", """SELECT conv_id AS space_id, turn AS seq, prev AS prev_seq FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations WHERE (conv_id + turn) % 6 <> 1)
WHERE (prev IS NULL AND turn <> 0) OR (prev IS NOT NULL AND turn <> prev + 1)""")
def chain_integrity(spark, sf):
    return revlog.chain_breaks(revisions(spark, sf).filter("(space_id + seq) % 6 <> 1"))


@query("cas_replay", """WITH RECURSIVE a AS (SELECT o_custkey AS space_id, o_orderkey AS attempt_no, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
e AS (SELECT *, CASE WHEN k = 1 THEN NULL ELSE k - 2 - (attempt_no % 3 = 0)::INT END AS expected FROM a),
t AS (SELECT space_id, attempt_no, k, TRUE AS accepted, CAST(0 AS BIGINT) AS head FROM e WHERE k = 1
UNION ALL SELECT e.space_id, e.attempt_no, e.k, e.expected = t.head, t.head + (e.expected = t.head)::INT FROM t JOIN e ON e.space_id = t.space_id AND e.k = t.k + 1)
SELECT space_id, attempt_no, accepted, CASE WHEN accepted THEN head END AS seq FROM t""")
def cas_replay(spark, sf):
    k = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("space_id"), F.col("o_orderkey").alias("attempt_no"), k.alias("k"))
    return revlog.cas_replay(o.withColumn("expected", F.when(F.col("k") > 1, F.col("k") - 2 - (F.col("attempt_no") % 3 == 0).cast("int"))))


@query("retention_floor", """SELECT c_custkey AS space_id, CAST(greatest(0, least(coalesce(m, h), h)) AS BIGINT) AS floor_seq FROM (SELECT c_custkey, count(o_orderkey) AS h, min(o_orderkey % 40 - 5) AS m
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)""")
def retention_floor(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("space_id"), "o_orderkey")
    h = table(spark, sf, "customer").select(F.col("c_custkey").alias("space_id")).join(o, "space_id", "left").groupBy("space_id").agg(F.count("o_orderkey").alias("head_seq"))
    return revlog.retention_floor(o.select("space_id", (F.col("o_orderkey") % 40 - 5).alias("base_seq")), h)


@query("revision_windows", "SELECT space_id, h AS head_seq, f AS from_seq, least(f + 3, h) AS to_seq FROM (SELECT space_id, h, unnest(generate_series(0, h, 4)) AS f FROM (SELECT o_custkey AS space_id, count(*) - 1 AS h FROM orders GROUP BY 1))")
def revision_windows(spark, sf):
    h = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("space_id")).agg((F.count("*") - 1).alias("head_seq"))
    return revlog.windows(h, size=4)


@query("revisions_from", "SELECT conv_id AS space_id, turn AS seq FROM conversations WHERE conv_id = 3 AND turn >= 1")
def revisions_from(spark, sf):
    return revlog.range_by_seq(revisions(spark, sf), 3, 1).select("space_id", "seq")


@query("status_verdict", """SELECT space_id, base_seq, head_seq, CASE WHEN head_seq IS NULL THEN 'none' WHEN base_seq = head_seq THEN 'up_to_date' WHEN base_seq < head_seq THEN 'behind ' || CAST(head_seq - base_seq AS VARCHAR) ELSE 'diverged' END AS verdict
FROM (SELECT c_custkey AS space_id, CAST(c_custkey % 7 AS BIGINT) AS base_seq FROM customer) LEFT JOIN (SELECT conv_id AS space_id, max(turn) AS head_seq FROM conversations GROUP BY 1) USING (space_id)""")
def status_verdict(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("space_id"), (F.col("c_custkey") % 7).alias("base_seq"))
    return revlog.status(revlog.heads(revisions(spark, sf)), base)


def micros(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


DAY = 86_400_000_000


@query("event_throttle", f"""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
t AS (SELECT *, us AS last, TRUE AS keep FROM e WHERE k = 1 UNION ALL SELECT e.*, CASE WHEN e.us - t.last >= {DAY} THEN e.us ELSE t.last END, e.us - t.last >= {DAY}
FROM t JOIN e ON e.user_id = t.user_id AND e.event_type = t.event_type AND e.k = t.k + 1) SELECT event_id, user_id, event_type, us FROM t WHERE keep""")
def event_throttle(spark, sf):
    return feed.throttle(micros(spark, sf), ["user_id", "event_type"], "us", "event_id", DAY)


@query("commit_debounce", f"""SELECT user_id, burst, min(us) AS first_ts, max(us) AS last_ts, count(*) AS n FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY us) AS BIGINT) AS burst FROM
(SELECT user_id, us, CASE WHEN coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us), {DAY // 4}) >= {DAY // 4} THEN 1 ELSE 0 END AS new FROM (SELECT user_id, epoch_us(ts) AS us FROM events))) GROUP BY 1, 2""")
def commit_debounce(spark, sf):
    return feed.debounce(micros(spark, sf), ["user_id"], "us", DAY // 4)


ECHO_SQL = "SELECT event_id, user_id AS path, epoch_us(ts) // 86400000000 AS mtime, event_type AS pcid, epoch_us(ts) // 1000 AS ts_ms FROM events"


@query("echo_suppression", f"""WITH e AS ({ECHO_SQL}), m AS (SELECT path, recorded_ms, max({{'recorded_ms': recorded_ms, 'mtime': mtime, 'pcid': pcid}}) AS m FROM (SELECT path, mtime, pcid, ts_ms - 1000 AS recorded_ms FROM e WHERE event_id % 5 = 0) GROUP BY 1, 2),
u AS (SELECT path, ts_ms AS moment, 1 AS kind, event_id, mtime, pcid, NULL AS m FROM e UNION ALL SELECT path, recorded_ms, 0, NULL, NULL, NULL, m FROM m),
t AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY path ORDER BY moment, kind, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur FROM u),
h AS (SELECT *, coalesce(mtime = cur.mtime AND pcid = cur.pcid AND moment - cur.recorded_ms < 300000, FALSE) AS hit FROM t WHERE kind = 1)
SELECT event_id, path, mtime, pcid, moment AS ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY path, cur, hit ORDER BY moment, event_id) AS nth FROM h) WHERE NOT hit OR nth > 1""")
def echo_suppression(spark, sf):
    us = F.col("us")
    e = micros(spark, sf).select("event_id", F.col("user_id").alias("path"), F.floor(us / F.lit(86400000000)).alias("mtime"), F.col("event_type").alias("pcid"), F.expr("us div 1000").alias("ts_ms"))
    marks = e.filter("event_id % 5 = 0").select("path", "mtime", "pcid", (F.col("ts_ms") - 1000).alias("recorded_ms"))
    return feed.suppress_echo(e, marks).select("event_id", "path", "mtime", "pcid", "ts_ms")


KIND_SQL = "CASE event_type {} END"


@query("sync_metrics", """SELECT user_id, count(*) FILTER (WHERE k = 0) AS commits, count(*) FILTER (WHERE k = 1) AS pulls, count(*) FILTER (WHERE k = 2) AS conflicts, count(*) FILTER (WHERE k = 3) AS feed_errors, count(*) FILTER (WHERE k = 4) AS stale_alerts,
count(*) FILTER (WHERE k = 5) AS quarantines, max(CASE WHEN k = 0 THEN us END) AS last_commit, max(CASE WHEN k = 1 THEN us END) AS last_pull FROM (SELECT user_id, event_id % 6 AS k, epoch_us(ts) AS us FROM events) GROUP BY 1""")
def sync_metrics(spark, sf):
    kinds = F.array(*map(F.lit, ["commit", "pull", "conflict", "feed_error", "stale_alert", "quarantine"]))
    return feed.sync_metrics(micros(spark, sf).withColumn("kind", F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int"))), "user_id", "kind", "us")


@query("stale_alerts", "SELECT user_id, s + 172800 AS alert_at FROM (SELECT user_id, s, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS n FROM (SELECT user_id, epoch_us(ts) // 1000000 AS s FROM events)) WHERE n - s > 172800")
def stale_alerts(spark, sf):
    return feed.stale_alerts(micros(spark, sf).select("user_id", F.expr("us div 1000000").alias("s")), "user_id", "s", 172_800)


@query("watchdog_changes", "SELECT conv_id, turn, k FROM (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT conv_id, turn, turn // 2 AS k FROM conversations)) WHERE p IS NULL OR p <> k")
def watchdog_changes(spark, sf):
    return feed.changed_counters(table(spark, sf, "conversations").select("conv_id", "turn", F.expr("turn div 2").alias("k")), "conv_id", "turn", ["k"])


@query("retry_backoff", """SELECT key, n, ran_seconds, CAST(least(5 * power(2, least(row_number() OVER (PARTITION BY key, streak ORDER BY n) - 1, 20)), 300) AS BIGINT) AS delay FROM
(SELECT *, sum((ran_seconds >= 60)::INT) OVER (PARTITION BY key ORDER BY n) AS streak FROM (SELECT o_custkey AS key, o_orderkey AS n, o_orderkey * 7 % 71 AS ran_seconds FROM orders))""")
def retry_backoff(spark, sf):
    return feed.backoff(table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("n"), (F.col("o_orderkey") * 7 % 71).alias("ran_seconds")))


URL_PATH = "regexp_replace(url, '^[a-z]+://', '')"


@query("path_validation", """SELECT page_id, p <> '' AND NOT regexp_matches(p, '(^|/)(|[.]|[.][.])(/|$)') AS trusted, contains(p, chr(92)) OR regexp_matches(p, '(^|/)[^/]:') AS unsyncable
FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') || CASE WHEN page_id % 5 = 0 THEN '/../x' WHEN page_id % 7 = 0 THEN '/c:x' ELSE '' END AS p FROM pages)""")
def path_validation(spark, sf):
    p = F.concat(F.expr(URL_PATH), F.when(F.col("page_id") % 5 == 0, "/../x").when(F.col("page_id") % 7 == 0, "/c:x").otherwise(""))
    return table(spark, sf, "pages").select("page_id", p.alias("p")).select("page_id", paths.is_trusted(F.col("p")).alias("trusted"), paths.is_unsyncable(F.col("p")).alias("unsyncable"))


IGNORES = ["en/src1", "src3/", "Doc_*7.txt"]


@query("ignore_filter", f"SELECT doc_id FROM documents WHERE NOT (starts_with({PATH_SQL}, 'en/src1/') OR source = 'src3' OR regexp_matches({PATH_SQL}, '(^|/)Doc_[^/]*7\\.txt(/|$)'))")
def ignore_filter(spark, sf):
    return table(spark, sf, "documents").filter(~paths.is_ignored(F.expr(PATH), F.lit(False), IGNORES)).select("doc_id")


@query("derived_filter", "SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 2 WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 5 = 0 THEN 3 ELSE 0 END AS t FROM documents")
def derived_filter(spark, sf):
    p = F.concat("source", F.when(F.col("doc_id") % 4 == 1, "/node_modules/x").otherwise("/x"))
    return table(spark, sf, "documents").select("doc_id", paths.classify(p, F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 == 0).cast("int").alias("t"))


@query("casefold_collisions", "SELECT lower(p) AS key, count(*) AS n, min(p) AS first_p, max(p) AS last_p FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'DIR' ELSE 'dir' END || '/' || CAST(doc_id // 3 AS VARCHAR) AS p FROM documents) GROUP BY 1 HAVING min(p) <> max(p)")
def casefold_collisions(spark, sf):
    p = F.concat(F.when(F.col("doc_id") % 2 == 0, "DIR").otherwise("dir"), F.lit("/"), F.expr("doc_id div 3").cast("string"))
    return snapshot.casefold_collisions(table(spark, sf, "documents").select(p.alias("p"), paths.casefold_key(p).alias("key")))


@query("ls_listing", f"SELECT 'f' AS letter, octet_length(encode(text)) AS sz, {PATH_SQL} AS p FROM documents ORDER BY p")
def ls_listing(spark, sf):
    return snapshot.listing(side(spark, sf, *BASE))


@query("mass_delete_guard", "SELECT *, tracked >= 50 AND deleted * 100 >= tracked * 90 AS blocked FROM (SELECT source, count(*) AS tracked, count(*) FILTER (WHERE source = 'src0' OR doc_id % 2 = 0) AS deleted FROM documents GROUP BY 1)")
def mass_delete_guard(spark, sf):
    return snapshot.mass_delete_guard(table(spark, sf, "documents"), "source", (F.col("source") == "src0") | (F.col("doc_id") % 2 == 0))


DECLINED = ["en/src1", "de"]


@query("prefix_retention", f"SELECT {PATH_SQL} AS p FROM documents WHERE lang = 'de' OR (lang = 'en' AND source = 'src1')")
def prefix_retention(spark, sf):
    declined = spark.createDataFrame([(x,) for x in DECLINED], "prefix string")
    return snapshot.declined_subtrees(table(spark, sf, "documents").select(F.expr(PATH).alias("p")), declined)


@query("upload_budget", "SELECT doc_id, coalesce(CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 65536 AS deferred FROM documents")
def upload_budget(spark, sf):
    return snapshot.upload_budget(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars", 65_536).select("doc_id", "before", "deferred")


@query("index_upsert", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN -1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 5 <> 1 OR p_partkey % 4 = 0")
def index_upsert(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    return blocks.upsert(part.filter("p_partkey % 5 <> 1"), part.filter("p_partkey % 4 = 0").withColumn("p_size", F.lit(-1)), ["p_partkey"])


@query("index_insert_ignore", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 1 THEN -1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 5 <> 1 OR p_partkey % 4 = 0")
def index_insert_ignore(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    return blocks.insert_or_ignore(part.filter("p_partkey % 5 <> 1"), part.filter("p_partkey % 4 = 0").withColumn("p_size", F.lit(-1)), ["p_partkey"])


@query("index_delete", "SELECT p_partkey, p_size FROM part WHERE p_partkey % 4 <> 0")
def index_delete(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    return blocks.delete(part, part.filter("p_partkey % 4 = 0"), ["p_partkey"])


@query("space_folders", "SELECT c_custkey AS space_id, n_name AS local_root_path, n_name IS NOT NULL AS mapped FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def space_folders(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey"), F.col("c_nationkey").alias("space_id"))
    m = table(spark, sf, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("space_id"), F.col("n_name").alias("local_root_path"))
    return blocks.with_local_folder(c, m).select(F.col("c_custkey").alias("space_id"), "local_root_path", "mapped")


@query("humanized_age", """SELECT o_orderkey, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' || CASE WHEN s % 60 = 0 THEN '' ELSE ' ' || s % 60 || 's' END
WHEN s < 86400 THEN s // 3600 || 'h' || CASE WHEN s % 3600 // 60 = 0 THEN '' ELSE ' ' || s % 3600 // 60 || 'm' END
ELSE s // 86400 || 'd' || CASE WHEN s % 86400 // 3600 = 0 THEN '' ELSE ' ' || s % 86400 // 3600 || 'h' END END AS age FROM (SELECT o_orderkey, o_orderkey * o_orderkey AS s FROM orders)""")
def humanized_age(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", paths.humanize_seconds(F.col("o_orderkey") * F.col("o_orderkey")).alias("age"))


@query("object_keys", "SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN '/' WHEN 2 THEN '../' ELSE '' END || 'blocks/' || CASE WHEN p_partkey % 5 = 3 THEN 'zz' ELSE substr(h, 1, 2) END || '/' || h AS key, p_partkey % 5 IN (0, 4) AS valid FROM (SELECT p_partkey, sha256(p_name) AS h FROM part)")
def object_keys(spark, sf):
    k, good = F.col("p_partkey") % 5, paths.object_key("blocks", F.sha2("p_name", 256))
    key = F.when(k == 1, F.concat(F.lit("/"), good)).when(k == 2, F.concat(F.lit("../"), good)).when(k == 3, F.regexp_replace(good, "^blocks/..", "blocks/zz")).otherwise(good)
    return table(spark, sf, "part").select("p_partkey", key.alias("key"), (paths.valid_object_key(key) & paths.parse_object_key(key).isNotNull()).alias("valid"))


CHUNKS = cdc.Profile(256, 1024, 4096, 12, 8)


@query("cdc_chunks", "SELECT doc_id, octet_length(encode(text)) AS total, TRUE AS dense FROM documents WHERE octet_length(encode(text)) > 0")
def cdc_chunks(spark, sf):
    c = cdc.chunk(table(spark, sf, "documents"), "text", ["doc_id"], SECRET, CHUNKS)
    return c.groupBy("doc_id").agg(F.sum("len").alias("total"), (F.max("pos") + 1 == F.count("*")).alias("dense"))


@query("reassemble_verify", "SELECT doc_id, sha256(text || CASE WHEN doc_id % 10 = 3 THEN '!' ELSE '' END) AS pcid, doc_id % 10 NOT IN (3, 4) AS ok FROM documents WHERE octet_length(encode(text)) > 0")
def reassemble_verify(spark, sf):
    d = table(spark, sf, "documents")
    c = cdc.chunk(d, "text", ["doc_id"], SECRET, CHUNKS)
    cut = c.join(d.select("doc_id", F.col("text").cast("binary").alias("b")), "doc_id").select("doc_id", "pos", "cid", F.expr("substring(b, cast(offset + 1 as int), cast(len as int))").alias("bytes"))
    pieces = cut.select("doc_id", "pos", F.when((F.col("doc_id") % 10 == 4) & (F.col("pos") == 0), F.lit("lost")).otherwise(F.col("cid")).alias("cid"))
    whole = blocks.reassemble(pieces, cut.select("cid", "bytes"), "doc_id")
    named = F.concat("text", F.when(F.col("doc_id") % 10 == 3, "!").otherwise(""))
    want = d.select("doc_id", F.sha2(named, 256).alias("pcid"), F.octet_length("text").cast("bigint").alias("sz"))
    return blocks.verified(whole, want, "doc_id").select("doc_id", "pcid", "ok")


@query("merge3_lines", """SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'conflict' WHEN doc_id % 4 = 2 THEN 'binary' ELSE 'clean' END AS status,
CASE WHEN doc_id % 4 IN (0, 3) THEN sha256('head' || chr(10) || text || chr(10) || 'tail' || chr(10)) END AS merged FROM documents WHERE octet_length(encode(text)) > 0""")
def merge3_lines(spark, sf):
    d = table(spark, sf, "documents").filter("octet_length(text) > 0")
    base = F.concat("text", F.lit("\n"))
    k = F.col("doc_id") % 4  # 1: both sides write another first line; 2: one side is binary
    right = F.when(k == 1, F.concat(F.lit("other\n"), base)).when(k == 2, F.concat(F.lit("\0"), base)).otherwise(F.concat(base, F.lit("tail\n")))
    m = d.select("doc_id", merge3_udf(base.cast("binary"), F.concat(F.lit("head\n"), base).cast("binary"), right.cast("binary")).alias("m"))
    return m.select("doc_id", "m.status", F.sha2("m.content", 256).alias("merged"))


@query("externalized_lists", "SELECT l_orderkey, length(bk) > 40 AS external, CASE WHEN length(bk) > 40 THEN sha256(bk) END AS bk_ref FROM (SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_suppkey, l_partkey) AS bk FROM lineitem GROUP BY 1)")
def externalized_lists(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").cast("string").alias("cid"), "l_partkey")
    bk = blocks.block_lists(li, "l_orderkey", ["l_linenumber", "l_suppkey", "l_partkey"], "cid")
    out, lists = pages.externalize(bk, limit=40)
    back = blocks.dereference(out, lists)
    return back.select("l_orderkey", F.col("bk_ref").isNotNull().alias("external"), "bk_ref")


@query("row_identity", f"SELECT doc_id, sha256({PATH_SQL} || chr(31) || CAST(n_chars AS VARCHAR)) AS rid FROM documents")
def row_identity(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(canonical_row(F.expr(PATH), F.col("n_chars")), 256).alias("rid"))
