"""Schemas of the catalog, with a version that readers check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1

FILE, SYMLINK, DERIVED, DIRECTORY = 0, 1, 2, 3

ENTRY = T.StructType(
    [
        T.StructField("p", T.StringType(), False),
        T.StructField("key", T.StringType(), False),
        T.StructField("t", T.ByteType(), False),
        T.StructField("x", T.BooleanType()),
        T.StructField("sz", T.LongType()),
        T.StructField("pcid", T.StringType()),
        T.StructField("bk", T.ArrayType(T.StringType())),
        T.StructField("bk_ref", T.StringType()),
        T.StructField("lt", T.StringType()),
        T.StructField("wu", T.BooleanType()),
    ]
)
REVISION = T.StructType.fromDDL("space_id string, seq bigint, revision_id string, parent string, root string, author_device_id string, created_at bigint")
DEVICE = T.StructType.fromDDL("account_id string, device_id string, name string, base_seq bigint")
LOCAL_ENTRY = T.StructType.fromDDL(
    "space_id string, path string, casefold_key string, type int, exec int, size bigint, mtime bigint, pcid string, base_seq bigint, blocks array<struct<pcid:string,cid:string>>, local_only int"
)
CHANGE_EVENT = T.StructType.fromDDL("seq bigint, kind string, path string, ts_ms bigint")


def stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("schema_version", F.lit(SCHEMA_VERSION))


def checked(df: DataFrame) -> DataFrame:
    """Refuse rows written by a newer schema, when they are read."""
    ok = F.assert_true(F.col("schema_version") <= SCHEMA_VERSION, F.lit("table was written by a newer schema"))
    return df.filter(ok.isNull()).drop("schema_version")
