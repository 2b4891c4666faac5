"""What grows with the data goes neither through the driver nor through one task."""

import time

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from pathledger.operators import pagestore
from pathledger.plans import store_catalog  # noqa: F401
from pathledger.plans.catalog import ORACLES, QUERIES
from pathledger.sources import objects

SMALL = "/root/testdata/sf0.001"


def plans(spark, run):
    """The last plans of all executions that `run` starts."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = store.executionsList()
    return [found.apply(i).physicalPlanDescription() for i in range(before, found.size())]


def test_a_scan_broadcasts_nothing(spark):
    seen = plans(spark, lambda: QUERIES["whole_scan"](spark, SMALL).collect())
    assert seen and not any("BroadcastHashJoin" in p for p in seen)  # what is crossed with a row of counts doesn't grow


def test_the_head_of_a_long_log_takes_few_calls(spark, tmp_path, monkeypatch):
    """Files of other names beside the revisions; the calls into the JVM don't grow with them."""
    from py4j.java_gateway import GatewayClient

    from pathledger.operators import revlog

    calls, send = [], GatewayClient.send_command
    monkeypatch.setattr(GatewayClient, "send_command", lambda self, command, *a, **b: (calls.append(command), send(self, command, *a, **b))[1])
    took = []
    for space, n in (("short", 3), ("long", 400)):
        (tmp_path / space).mkdir()
        for name in (*range(n), "_aside", "x, 900", "a\n901"):
            (tmp_path / space / str(name)).write_bytes(b"x")
        calls.clear()
        assert revlog.head(spark, str(tmp_path), space) == n - 1
        took.append(sum(not c.startswith("m\n") for c in calls))
    assert took[0] == took[1]
    assert revlog.commit(spark, str(tmp_path), "long", 398, b"y") is None and revlog.commit(spark, str(tmp_path), "long", 399, b"y") == 400
    assert revlog.head(spark, str(tmp_path), "none") is None and revlog.commit(spark, str(tmp_path), "none", None, b"y") == 0


def test_a_log_is_written_by_many_tasks(spark, monkeypatch):
    from pathledger.plans import source_catalog

    parts = []
    monkeypatch.setattr(objects, "materialize", lambda entries, folder: parts.append(entries.rdd.getNumPartitions()))
    source_catalog.supplier_log(spark, SMALL, "parts")
    assert parts[0] >= 8


@pytest.fixture(scope="module")
def deep(spark, tmp_path_factory):
    """documents of 66,000 rows: trees of three levels."""
    top = str(tmp_path_factory.mktemp("deep"))
    k = F.col("doc_id")
    d = spark.range(66_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    d.withColumn("n_chars", F.length("text").cast("bigint")).orderBy(k).write.parquet(f"{top}/documents.parquet")
    return top


@pytest.mark.parametrize("name, most_named", [("page_diff_reads", 4096), ("stored_page_diff_reads", 4096), ("stored_page_diff_reads", 50)])
def test_reads_of_trees_of_three_levels(spark, deep, monkeypatch, name, most_named):
    """Named frontiers, and joined ones, as those of some million entries are."""
    monkeypatch.setattr(pagestore, "MOST_NAMED", most_named)
    assert_same(QUERIES[name](spark, deep), ORACLES[name], deep)


def test_bounds_of_many_rows_are_checked_in_one_walk(spark):
    """An array of 20,000, under a filter that is pushed below it as walk()'s is; a lambda that looked its neighbour up built the array anew for each."""
    rows = spark.range(2).select("id", F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: i * 2 - F.when((i == 9000) & (F.col("id") == 1), 1).otherwise(0)).alias("xs"))
    bodies = F.transform("xs", lambda x: F.struct(x.alias("lo"), (x + 1).alias("hi")))
    start = time.time()
    bad = rows.withColumn("bodies", bodies).withColumn("ok", pagestore.ascends(F.col("bodies"))).filter("not ok").select("id").collect()
    assert [r.id for r in bad] == [1] and time.time() - start < 20
    few = spark.sql("select array() as b union all select array(named_struct('lo', 'b', 'hi', 'a')) union all select array(named_struct('lo', 'a', 'hi', 'b'))".replace("array() as b", "cast(array() as array<struct<lo:string,hi:string>>) as b"))
    assert [r[0] for r in few.select(pagestore.ascends(F.col("b"))).collect()] == [True, False, True]


@pytest.fixture
def here(monkeypatch, spark):
    """What tasks write is written by the test's own process; the disk is told to be one that syncfs() serves. Gives the calls, in order."""
    import ctypes
    import os

    calls = []
    frame = type(spark.range(0))
    monkeypatch.setattr(frame, "foreachPartition", lambda df, f: f(iter(df.collect())))
    monkeypatch.setattr(objects, "synced_whole", lambda f: True, raising=False)
    for name in ("fsync", "replace"):
        monkeypatch.setattr(os, name, lambda *a, f=getattr(os, name), name=name: (calls.append(name), f(*a))[1])
    libc = ctypes.CDLL(None, use_errno=True)

    class Counted:
        def __getattr__(self, name):
            return lambda *a: (calls.append(name), getattr(libc, name)(*a))[1]

    monkeypatch.setattr(ctypes, "CDLL", lambda *a, **k: Counted())
    return calls


ENTRY = "p string, t int, x boolean, lt string, content binary"


def test_a_tree_waits_for_the_disk_once_for_many_files(spark, here, tmp_path):
    rows = [(f"d{k % 3}/{k}", int(k % 7 == 2), k % 7 == 3, "to" if k % 7 == 2 else None, None if k % 7 == 2 else b"%d" % k) for k in range(700)]
    objects.materialize(spark.createDataFrame(rows, ENTRY), str(tmp_path))
    assert sum(c in ("fsync", "syncfs") for c in here) < 10 and here.count("replace") == 700
    assert here[0] != "replace" and sorted(p.name for p in tmp_path.glob("d*/*")) == sorted(str(k) for k in range(700))
    for p, t, x, _, body in rows:
        f = tmp_path / p
        assert f.is_symlink() if t else (f.read_bytes(), f.stat().st_mode & 0o777) == (body, 0o755 if x else 0o644)


def test_blocks_wait_for_the_disk_once_for_many_files(here, tmp_path):
    import hashlib
    from types import SimpleNamespace as Row

    from pathledger.operators import slices

    bodies = [b"%d" % k for k in range(600)]
    rows = [r for k, b in enumerate(bodies) for r in (Row(p=f"f{k}", pos=-1, bytes=None, x=False, sz=len(b), pcid=hashlib.sha256(b).hexdigest()), Row(p=f"f{k}", pos=0, bytes=b))]
    slices.append_files(iter(rows), str(tmp_path))
    assert sum(c in ("fsync", "syncfs") for c in here) < 10 and [(tmp_path / f"f{k}").read_bytes() for k in range(600)] == bodies
    with pytest.raises(ValueError, match="content"):
        slices.append_files(iter([rows[0], Row(p="f0", pos=0, bytes=b"?")]), str(tmp_path))
    assert (tmp_path / "f0").read_bytes() == b"0" and len(list(tmp_path.iterdir())) == 600


def test_nothing_takes_its_name_before_the_disk_has_it(monkeypatch, tmp_path):
    (tmp_path / "kept").write_bytes(b"old")
    (tmp_path / "folder").mkdir()

    def fails(files):
        raise OSError("no space")

    def land(**k):
        with objects.Landing(**k) as landing:
            for name in ("kept", "new", "kept", "folder"):
                landing.file(f"{tmp_path}/{name}", False).write(b"%d" % len(landing.waiting))
            landing.link(f"{tmp_path}/ln", "new")

    with monkeypatch.context() as m:
        m.setattr(objects, "flush", fails)
        with pytest.raises(OSError, match="space"):
            land()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["folder", "kept"] and (tmp_path / "kept").read_bytes() == b"old"
    with pytest.raises(IsADirectoryError):
        land()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["folder", "kept", "new"] and (tmp_path / "kept").read_bytes() == b"3"
    land(over_folders=True)
    assert (tmp_path / "folder").read_bytes() == b"4" and (tmp_path / "ln").is_symlink() and len(list(tmp_path.iterdir())) == 4


def test_disks_without_a_common_sync_are_asked_for_each_file(here, monkeypatch, tmp_path):
    monkeypatch.setattr(objects, "synced_whole", lambda f: False)
    monkeypatch.setattr(objects, "BYTES_AT_ONCE", 10)
    with objects.Landing() as landing:
        for k in range(6):
            landing.file(f"{tmp_path}/{k}", False).write(b"12345")
    assert here == (["fsync"] * 2 + ["replace"] * 2) * 3
