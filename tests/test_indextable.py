"""Batches of the index apply whole or not at all; listings look only where a prefix leads."""

import pytest
from pyspark.sql import functions as F

from pathledger.sources import indextable, objects

SCHEMA = "space string, path string, size bigint"


def index_rows(spark, folder):
    return sorted(map(tuple, indextable.read(spark, folder, SCHEMA).collect()))


def test_batches_are_transactions(spark, tmp_path, monkeypatch):
    folder, keys = f"{tmp_path}/i", ["space", "path"]
    df = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    assert index_rows(spark, folder) == []
    assert indextable.apply(df(("s", "a", 1), ("s", "b", 2), ("s", "b", 3)), folder, keys) == {"inserted": 2, "updated": 0, "deleted": 0, "kept": 0}
    assert indextable.apply(df(("s", "b", 9), ("s", "a", 1), ("t", "a", None)), folder, keys)["updated"] == 1
    now = [("s", "a", 1), ("s", "b", 9), ("t", "a", None)]
    assert index_rows(spark, folder) == sorted(now, key=str)
    assert indextable.apply(df(("s", "a", 5), ("s", "c", 5)), folder, keys, "ignore")["inserted"] == 1
    assert indextable.apply(df(("s", "a", 0), ("s", "zz", 0)), folder, keys, "delete")["deleted"] == 1
    now = sorted([("s", "b", 9), ("t", "a", None), ("s", "c", 5)], key=str)
    assert index_rows(spark, folder) == now
    torn = df(("s", "b", 1), ("s", "d", 1)).withColumn("size", F.when(F.col("path") == "d", F.raise_error(F.lit("torn")).cast("bigint")).otherwise(F.col("size")))
    with pytest.raises(Exception, match="torn"):
        indextable.apply(torn, folder, keys)
    assert index_rows(spark, folder) == now

    def dies(*args):
        raise OSError("disk")

    with monkeypatch.context() as m:  # all files are written, but not the version
        m.setattr(indextable.revlog, "commit", dies)
        with pytest.raises(OSError):
            indextable.apply(df(("s", "b", 1)), folder, keys)
    assert index_rows(spark, folder) == now
    real, raced = indextable.revlog.commit, []

    def loses_once(*args):
        if not raced:
            raced.append(1)
            monkeypatch.setattr(indextable.revlog, "commit", real)
            indextable.apply(df(("s", "b", 7)), folder, keys)
            return None
        return real(*args)

    monkeypatch.setattr(indextable.revlog, "commit", loses_once)
    assert indextable.apply(df(("s", "b", 8)), folder, keys)["updated"] == 1
    assert ("s", "b", 8) in index_rows(spark, folder)
    with pytest.raises(ValueError):
        indextable.apply(df(("s", "b", 8)), folder, keys, "other")


def test_a_prefix_lists_its_own_folders(spark, tmp_path):
    for name in ("blocks/aa/1", "blocks/ab/2", "blocks/b", "manifest/aa/3", "blockz/aa/4"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name.endswith("2") else b"x")
    folders = lambda prefix: [(p.folder.removeprefix(str(tmp_path)), p.shallow) for p in objects.ListingReader(str(tmp_path), prefix).partitions()]
    assert folders("blocks/") == [("/blocks", True), ("/blocks/aa", False), ("/blocks/ab", False)]
    assert folders("blocks/aa/") == [("/blocks/aa", True)] and folders("bl") == [("", True), ("/blocks", False), ("/blockz", False)]
    assert folders("none/x") == [("/none", True)]
    keys = lambda df: sorted((r.key, r.size) for r in df.collect())
    assert keys(objects.listing(spark, str(tmp_path), "blocks/")) == [("blocks/aa/1", 1), ("blocks/ab/2", 0), ("blocks/b", 1)]
    assert keys(objects.listing(spark, f"file://{tmp_path}", "blocks/a")) == [("blocks/aa/1", 1), ("blocks/ab/2", 0)]
    assert objects.listing(spark, str(tmp_path)).count() == 5
    reader = objects.ListingReader(str(tmp_path), "")
    f = objects.StringStartsWith(("key",), "blocks/ab")
    assert list(reader.pushFilters([f])) == [f] and reader.prefix == "blocks/ab"
