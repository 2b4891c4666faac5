import pytest
from pyspark.sql import functions as F

from pathledger.runtime import table
from pathledger.sources import objects
from pathledger.streaming import feed

SF = "/root/testdata/sf0.001"


def stream_of(spark, df, tmp_path, make, name, mode="append", ends=True):
    """ends: False for processing-time state, whose timers keep a query of all available data running."""
    df.write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = make(s).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    done = q.awaitTermination(180 if ends else 45)
    assert done or not ends
    q.stop()
    assert q.exception() is None
    return spark.table(name)


def shuffled_stream(spark, rows, last, tmp_path, make, name, files=8, seed=1):
    """Rows in any order over many files, one a batch; then the row `last`, so late that all before it are released."""
    import random

    at = rows.collect()
    random.Random(seed).shuffle(at)
    for k in range(files):
        spark.createDataFrame(at[k::files], rows.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = make(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    start = lambda: q.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    for _ in range(2):
        run = start()
        assert run.awaitTermination(300) and run.exception() is None
        spark.createDataFrame([last], rows.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.read.schema(q.schema).parquet(f"{tmp_path}/out")


def test_throttle_stream_of_shuffled_files_equals_batch(spark, tmp_path):
    """Ten events share each millisecond, so ties hang on event_id; no order of arrival matters."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = table(spark, SF, "events").select("event_id", (F.col("user_id") % 3).alias("user_id"), (ms - ms % 40_000_000).alias("ms"))
    got = shuffled_stream(spark, e, (-1, -1, 4 * 10**12), tmp_path, lambda s: feed.throttle_stream(s, ["user_id"], "ms", "event_id", 86_400_000, "10000 days"), "thr")
    want = feed.throttle(e, ["user_id"], "ms", "event_id", 86_400_000)
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in want.collect()) != []


def test_stream_releases_what_the_watermark_has_passed(spark, tmp_path):
    """Within `late` order of arrival is free; what is released comes without waiting for the end."""
    rows = spark.createDataFrame([(i, "k", 10**6 + i * 1000) for i in range(40)], "id bigint, k string, t bigint")
    for k, part in enumerate(([3, 1, 0, 2, 5], [4, 9, 7, 6, 8], list(range(39, 9, -1)))):
        rows.filter(F.col("id").isin(part)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
    q = feed.throttle_stream(s, ["k"], "t", "id", 2500, "6 seconds").writeStream.format("memory").queryName("rel").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    got = sorted(r.t for r in spark.table("rel").collect())
    want = [r.t for r in feed.throttle(rows, ["k"], "t", "id", 2500).orderBy("t").collect()]
    assert got == [t for t in want if t <= 10**6 + 33_000] and len(got) == 12


def test_throttle_rule(spark):
    d = spark.createDataFrame([(i, "p", t) for i, t in enumerate([0, 20, 40, 60, 80, 120])], "id int, k string, t bigint")
    assert sorted(r.t for r in feed.throttle(d, ["k"], "t", "id", 50).collect()) == [0, 60, 120]


def test_echo_stream_of_shuffled_files_equals_batch(spark, tmp_path):
    """Marks and events at one time, two marks at one time, events before their mark in the files."""
    rows = [(True, "a", 1, "h", 0, 0), (False, "a", 1, "h", 10, 1), (False, "a", 1, "h", 20, 2), (True, "b", 1, "h", 0, 0), (False, "b", 1, "h", 10**7, 3), (False, "c", 1, "h", 5, 4), (True, "d", 1, "h", 0, 0), (False, "d", 2, "h", 5, 5)]
    rows += [(False, "e", 1, "h", 7, 6), (True, "e", 1, "h", 7, 0), (False, "e", 1, "h", 7, 7), (True, "f", 1, "h", 3, 0), (True, "f", 2, "g", 3, 0), (False, "f", 1, "h", 4, 8), (False, "f", 2, "g", 4, 9)]
    e = spark.createDataFrame([(*r[:4], r[4] + 10**9, r[5]) for r in rows], "mark boolean, path string, mtime bigint, pcid string, ts_ms bigint, event_id bigint")
    got = shuffled_stream(spark, e, (False, "z", 0, "", 10**12, -1), tmp_path, lambda s: feed.suppress_echo_stream(s, "2000 days", ["event_id"]), "echo")
    want = feed.suppress_echo(e.filter("not mark").drop("mark"), e.filter("mark").select("path", "mtime", "pcid", F.col("ts_ms").alias("recorded_ms")))
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in want.collect()) == [2, 3, 4, 5, 7, 8]


def test_head_feed_stream(spark, tmp_path):
    r = spark.createDataFrame([("s", i, f"r{i}") for i in range(5)], "space_id string, seq bigint, revision_id string").coalesce(1)
    got = stream_of(spark, r, tmp_path, feed.head_feed, "heads", "complete")
    assert [tuple(x) for x in got.collect()] == [("s", 4, "r4")]


def test_user_changes_and_kinds(spark):
    e = spark.createDataFrame([("a", "Modified", False, 1, 1), ("b", "Modified", True, 1, 1), (".pathledger/x", "Added", False, 1, 1), ("c", "Removed", False, 1, 1), (".z.ft-tmp", "Added", False, 1, 1), ("d", "Modified", False, 2, 9)], "path string, kind string, is_dir boolean, size bigint, mtime bigint")
    i = spark.createDataFrame([("a", 1, 1), ("c", 1, 1), ("d", 2, 2)], "path string, size bigint, mtime bigint")
    assert sorted(r.path for r in feed.user_changes(e, i).collect()) == ["c", "d"]
    k = spark.createDataFrame([("Create",), ("Access",)], "kind string")
    assert [r.change for r in feed.map_kinds(k).collect()] == ["Added"]


def test_object_store_round_trip(spark, tmp_path):
    store = f"{tmp_path}/store"
    b = spark.createDataFrame([("blocks/aa/x", b"1"), ("blocks/bb/y", b"2")], "key string, body binary")
    assert objects.put(b, store) == 2
    assert objects.put(b, store) == 0
    assert [bytes(r.body) for r in objects.get(spark, store, b.filter("key like '%y'")).collect()] == [b"2"]
    f = spark.createDataFrame([("d/a.txt", 0, False, None, b"hi")], "p string, t int, x boolean, lt string, content binary")
    objects.materialize(f, f"{tmp_path}/tree")
    w = objects.walk(spark, f"{tmp_path}/tree", content=True).collect()
    assert [(r.p, r.sz, bytes(r.content)) for r in w] == [("d/a.txt", 2, b"hi")]
    assert objects.bury(b.filter("key like '%x'").unionByName(b.limit(1).withColumn("key", F.lit("no/such"))), store) == 1
    assert [r.key for r in objects.get(spark, store, b).collect()] == ["blocks/bb/y"] and objects.bury(b.filter("key like '%x'"), store) == 0
    objects.compact(spark, store, f"{tmp_path}/compact")
    assert [r.key for r in objects.stored(spark, f"{tmp_path}/compact").collect()] == ["blocks/bb/y"]
    assert objects.put(b, store) == 1 and objects.get(spark, store, b).count() == 2  # put again after its burial


def test_metrics_round_trip(spark, tmp_path):
    rows = [("s", "commit", 0, 100, None), ("s", "reconcile", 2, 120, None), ("s", "quarantine", 0, 130, "disk"), ("t", "commit", 0, 5, None)]
    m = feed.space_metrics(spark.createDataFrame(rows, "space_id string, kind string, n bigint, ts bigint, cause string"), 99)
    objects.save_metrics(m, f"{tmp_path}/m")
    back = objects.load_metrics(spark, f"{tmp_path}/m")
    assert sorted(map(str, back.select(*m.columns).collect())) == sorted(map(str, m.collect())) and len(back.columns) == 13
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x").write_text('{"space_id": "old", "commits": 7}\n{broken\n')
    old, broken = objects.load_metrics(spark, f"{tmp_path}/bad").collect()
    assert (old.commits, old.quarantines, old.quarantined, old.last_commit) == (7, 0, False, None) and broken.commits == 0 and broken.space_id is None
    assert objects.load_metrics(spark, f"{tmp_path}/none").count() == 0


def test_materialize_and_walk_a_tree(spark, tmp_path):
    top = tmp_path / "t"
    cols = "p string, t int, x boolean, lt string, content binary"
    rows = [("a", 3, False, None, None), ("a/run.sh", 0, True, None, b"#!"), ("a/b/deep.txt", 0, False, None, b"x"), ("ln", 1, False, "a/run.sh", None), ("target", 2, False, None, None), ("empty", 3, False, None, None)]
    d = spark.createDataFrame(rows, cols)
    for _ in range(2):  # a retry changes nothing
        objects.materialize(d, str(top))
    for extra in ("target/skip.o", ".pathledger/state", "logs/x.log", "a/.DS_Store"):
        (top / extra).parent.mkdir(parents=True, exist_ok=True)
        (top / extra).write_bytes(b"1")
    got = {r.p: r for r in objects.walk_tree(spark, str(top), ["logs/"]).collect()}
    assert {p: r.route for p, r in got.items()} == {"a": "item", "a/run.sh": "item", "a/b": "item", "a/b/deep.txt": "item", "ln": "item", "target": "derived", "empty": "item", "logs": "ignored", "a/.DS_Store": "junk"}
    assert got["a/run.sh"].x and not got["a/b/deep.txt"].x and got["ln"].lt == "a/run.sh" and got["ln"].t == 1 and got["a"].t == 3
    objects.materialize(spark.createDataFrame([("a/b/deep.txt", 1, False, "../run.sh", None), ("empty", 0, False, None, b"now a file")], cols), str(top))
    assert (top / "a/b/deep.txt").is_symlink() and (top / "empty").read_bytes() == b"now a file"
    for bad in ("ln2/x", "../up"):
        (top / "ln2").is_symlink() or (top / "ln2").symlink_to(tmp_path)
        with pytest.raises(Exception, match="link|untrusted"):
            objects.materialize(spark.createDataFrame([(bad, 0, False, None, b"")], cols), str(top))


def test_listing_and_deletes(spark, tmp_path):
    for name in ("blocks/aa/1", "blocks/bb/2", "manifest/aa/3"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = objects.listing(spark, f"file://{tmp_path}", "blocks/").collect()
    assert sorted(r.key for r in got) == ["blocks/aa/1", "blocks/bb/2"] and all(r.mtime > 0 for r in got)
    assert objects.dumps({"b": 1, "a": 2}).index('"a"') < objects.dumps({"b": 1, "a": 2}).index('"b"')


def test_cas_stream_of_shuffled_files_equals_batch(spark, tmp_path):
    from pathledger.operators import revlog

    rows = [("s", 1, None), ("s", 2, None), ("s", 3, 0), ("s", 4, 0), ("s", 5, 1), ("t", 1, 0), ("t", 2, None), ("t", 3, 0)]
    a = spark.createDataFrame([(*r, 10**9 + 50 * (r[1] // 3)) for r in rows], "space_id string, attempt_no bigint, expected bigint, at bigint")
    got = shuffled_stream(spark, a, ("z", 1, None, 10**12), tmp_path, lambda s: feed.cas_stream(s, "at", "2000 days"), "cas")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, revlog.cas_replay(a).collect()), key=str)


def test_watchdog_stream_of_shuffled_files_equals_batch(spark, tmp_path):
    rows = [("s", i, v, v // 2) for i, v in enumerate([1, 1, 2, 2, 3, 2])] + [("t", 0, None, 1), ("t", 1, None, 1)]
    a = spark.createDataFrame([(*r, 10**9 + r[1] // 2) for r in rows], "space string, n bigint, x bigint, y bigint, at bigint")
    got = shuffled_stream(spark, a, ("z", 0, 0, 0, 10**12), tmp_path, lambda s: feed.changed_counters_stream(s, "space", "at", "n", ["x", "y"], "2000 days"), "dog")
    want = feed.changed_counters(a, "space", "n", ["x", "y"])
    assert sorted((r.space, r.n) for r in got.collect()) == sorted((r.space, r.n) for r in want.collect()) == [("s", 0), ("s", 2), ("s", 4), ("s", 5), ("t", 0)]


def test_stale_stream(spark, tmp_path):
    """Silences of more than 300 seconds within the data alert as they end, the last ones once the watermark is past."""
    at = [("a", 0), ("a", 200), ("a", 900), ("b", 0), ("b", 100), ("c", 5000)]
    d = spark.createDataFrame(at, "space string, s bigint").withColumn("ts", F.timestamp_seconds("s")).coalesce(1)
    got = stream_of(spark, d, tmp_path, lambda s: feed.stale_alerts_stream(s, "space", "ts"), "stale")
    assert sorted((r.space, r.alert_ms) for r in got.collect()) == [("a", 500_000), ("a", 1_200_000), ("b", 400_000)]


def test_debounce_stream(spark, tmp_path):
    rows = [("p", 0), ("p", 200), ("p", 400), ("p", 2000), ("q", 10**7)]
    d = spark.createDataFrame(rows, "path string, ms bigint").withColumn("ts", F.timestamp_millis("ms")).coalesce(1)
    got = stream_of(spark, d, tmp_path, lambda s: feed.debounce_stream(s, ["path"], "ts", late="1 second"), "deb")
    assert sorted((r.path, r.n) for r in got.collect()) == [("p", 1), ("p", 3)]


def test_polls_run_on_a_schedule(spark):
    class Writer:
        def trigger(self, **kw):
            return kw

    assert feed.polled(Writer()) == {"processingTime": "30 seconds"}


def test_the_last_burst_ends_by_the_clock(spark, tmp_path):
    """Two bursts of one key; nothing comes after the second, and it is committed all the same."""
    import time

    schema = "path string, ms bigint"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put(("p", 1), ("p", 2), ("q", 5))
    s = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = feed.quiet_bursts_stream(s, ["path"], "ms", 1500).writeStream.format("memory").queryName("quiet").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="100 milliseconds").start()

    def until(n):
        end = time.time() + 60
        while time.time() < end and spark.table("quiet").count() < n:
            time.sleep(0.3)
        return sorted(map(tuple, spark.table("quiet").collect()))

    try:
        assert until(2) == [("p", 1, 2, 2), ("q", 5, 5, 1)]
        put(("p", 9),)
        assert until(3) == [("p", 1, 2, 2), ("p", 9, 9, 1), ("q", 5, 5, 1)]
    finally:
        q.stop()


def commit_all(spark, folder, space, n, start=0):
    from pathledger.operators import revlog

    for k in range(start, start + n):
        assert revlog.commit(spark, folder, space, k - 1 if k else None, f"{space}{k}".encode()) == k


def test_revision_feed_restarts_without_loss_or_repeats(spark, tmp_path):
    from pathledger.sources import revisions

    log = f"{tmp_path}/log"
    commit_all(spark, log, "s", 4)
    commit_all(spark, log, "t", 1)

    def run(name):
        q = revisions.revision_stream(spark, log).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        return sorted((r.space_id, r.seq, bytes(r.payload).decode()) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run("a") == [("s", 3, "s3"), ("t", 0, "t0")]  # each head first
    assert run("b") == [("s", 3, "s3"), ("t", 0, "t0")]
    commit_all(spark, log, "s", 3, 4)
    commit_all(spark, log, "u", 2)
    want = [("s", k, f"s{k}") for k in range(3, 7)] + [("t", 0, "t0"), ("u", 0, "u0"), ("u", 1, "u1")]
    assert run("c") == want


def test_revision_reader_ranges():
    from pathledger.sources import revisions

    r = revisions.RevisionReader("/nowhere", "head")
    assert r.initialOffset() == {} == r.latestOffset()
    spans = lambda a, b: [(p.space, p.low, p.high) for p in r.partitions(a, b)]
    assert spans({}, {"s": 2500}) == [("s", 0, 1024), ("s", 1024, 2048), ("s", 2048, 2500)]
    assert spans({"s": 7}, {"s": 6}) == [("s", 5, 6)] and spans({"s": 6}, {"s": 6}) == []  # the head moved before the first batch was repeated


def test_a_batch_commits_once_though_killed(spark, tmp_path):
    """The query dies after the revision is in and before Spark knows: the repeated batch commits nothing more."""
    from pathledger.operators import revlog
    from pathledger.sources import revisions

    log, died = f"{tmp_path}/log", []
    sink = revisions.committing_sink(spark, log, "s", "q1")

    def killed(df, batch_id):
        sink(df, batch_id)
        if batch_id in (1, 2) and batch_id not in died:
            died.append(batch_id)
            raise RuntimeError("killed")

    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(3):
        s = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = s.writeStream.foreachBatch(killed).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
        except Exception as e:  # noqa: BLE001
            assert "killed" in str(e)
        if died == [1]:  # another writer gets in between
            revlog.commit(spark, log, "s", 1, b'{"applied": {"q1": 1, "q2": 5}}')
    assert died == [1, 2]
    head, content = revisions.newest(spark, log, "s")
    assert head == 3 and content["applied"] == {"q1": 2, "q2": 5}
    data = [f"{log}/s/_data/q1-{k}" for k in range(3)]
    assert sorted(r.id for r in spark.read.parquet(*data).collect()) == list(range(30))
    lost = revisions.committing_sink(spark, log, "s", "q3", attempts=0)
    with pytest.raises(RuntimeError, match="lost the race"):
        lost(spark.range(1), 0)
