"""Session helpers shared by every operator family."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; where none is configured, a temporary one in local mode and an error elsewhere."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = path or tempfile.mkdtemp(prefix="pathledger-")
    spark.sparkContext.setCheckpointDir(path)
    return jsc.getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: survives lost executors, and later plans start from it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: both sides are shuffled, and it never passes through the driver as a broadcast."""
    return df.hint("merge")


def last_scan(spark: SparkSession) -> dict[str, int]:
    """rows and files that the file scans of the session's last query read, by Spark's own metrics."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last().executionId()
    values, nodes = store.executionMetrics(last), store.planGraph(last).allNodes()
    out = {"rows": 0, "files": 0}
    for i in range(nodes.size()):
        node = nodes.apply(i)
        metrics = node.metrics()
        if not any(metrics.apply(j).name() == "number of files read" for j in range(metrics.size())):
            continue
        for j in range(metrics.size()):
            name = {"number of output rows": "rows", "number of files read": "files"}.get(metrics.apply(j).name())
            value = values.get(metrics.apply(j).accumulatorId()) if name else None
            if value is not None and value.isDefined():
                out[name] += int(value.get().replace(",", ""))
    return out
