"""Merkle manifest of a dataset: sorted leaf runs, an external node store of level-partitioned Parquet, proofs by coordinate.

A leaf is the SHA-256 of a row. The leaves of a source stand in order of their id; while several nodes remain, every three
consecutive ones become one. What remains is the source's subroot, and the subroots by source become the root alike.

A node's coordinate is (source, level, index). Leaves are sorted once and never gathered: a task streams aligned runs of 3**7
leaves, builds all their levels and writes them to the store; the next round reads only the runs' tops. Proofs go the other way:
a run's rows and the siblings above its top meet in a merge scan by coordinate, and the run's own levels give the rest. So a
source of a third of all rows is as many runs as it needs, and no task holds more than a run.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathledger.llm.common import checkpoint_dir, partitions
from pathledger.operators.pages import ranked

ARITY = 3
STEP = 7
RUN = ARITY**STEP
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NODE = "s string, level int, idx bigint, digest string, top boolean"
PATH = "s string, idx bigint, left array<string>, right array<string>, subroot string, root string"
PROOF = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """Byte count, colon, value; a dash for null: no two rows have one encoding."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    return F.sha2(F.concat(*(encoded(changed.get(c, F.col(c))) for c in FIELDS)).cast("binary"), 256)


def levels(digests: list[str], run: int) -> list[list[str]]:
    """The levels of a run from its members up. Runs after the first climb STEP levels, as others stand beside them; a first
    run climbs until one node is left, which for a full one is as many."""
    out = [digests]
    while len(out) <= STEP if run else len(out[-1]) > 1:
        now = out[-1]
        out.append([sha("".join(now[i : i + ARITY])) for i in range(0, len(now), ARITY)])
    return out


def siblings(built: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a member's ancestors within their groups of three, level by level."""
    left, right = [], []
    for level in built[:-1]:
        low = at - at % ARITY
        left.append("".join(level[low:at]))
        right.append("".join(level[at + 1 : low + ARITY]))
        at //= ARITY
    return left, right


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[tuple]]]:
    """(s, run, rows) of a stream that is sorted by s and run; rows without these two columns."""
    now, rows = None, []
    for b in batches:
        for s, run, *row in zip(*(c.to_pylist() for c in b.columns)):
            if (s, run) != now:
                if rows:
                    yield *now, rows
                now, rows = (s, run), []
            rows.append(row)
    if rows:
        yield *now, rows


def by_lots(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    lot: list[tuple] = []
    for r in rows:
        lot.append(r)
        if len(lot) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lot), schema.types)], schema=schema)
            lot = []
    if lot:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lot), schema.types)], schema=schema)


def dealt(members: DataFrame, *order: str) -> DataFrame:
    """Rows by aligned runs: a run is whole in one task and in order. Adaptive execution leaves such an exchange alone."""
    spark = members.sparkSession
    return members.repartition(partitions(spark), "s", "run").sortWithinPartitions("s", "run", *order)


def climb(members: DataFrame, base: int) -> DataFrame:
    """s, level, idx, digest, top: the nodes above members (s, idx, digest), level `base`, up to the tops of their runs.

    A run of one node that stands alone is its own top and comes out as it is.
    """
    schema = pa.schema([("s", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("top", pa.bool_())])

    def nodes(batches):
        for s, run, rows in runs(batches):
            built = levels([r[1] for r in rows], run)
            last = len(built) - 1
            for k in range(min(1, last), last + 1):
                first = run * ARITY ** (STEP - k)
                for j, h in enumerate(built[k]):
                    yield s, base + k, run if k == last else first + j, h, k == last

    keyed = members.select("s", F.expr(f"idx div {RUN}").alias("run"), "idx", "digest")
    return dealt(keyed, "idx").mapInArrow(lambda b: by_lots(nodes(b), schema), NODE)


def build(members: DataFrame, folder: str) -> list[DataFrame]:
    """The members of each round, the last being the single node of every s. Nodes go to `<folder>/round=<r>/level=<k>`."""
    spark, rounds = members.sparkSession, [members]
    while True:
        at = len(rounds) - 1
        climb(rounds[-1], at * STEP).write.partitionBy("level").parquet(f"{folder}/round={at}")
        stored = spark.read.schema(NODE).parquet(f"{folder}/round={at}")
        rounds.append(stored.filter("top").select("s", "idx", "digest"))
        if not rounds[-1].agg(F.max("idx")).first()[0]:
            return rounds


def with_paths(members: DataFrame, above: DataFrame, *more: str) -> DataFrame:
    """One stream of paths (tag 0) and members (tag 1) by run: each path is followed by the members below it."""
    paths = above.select("s", F.col("idx").alias("run"), F.lit(0).alias("tag"), F.lit(0).cast("bigint").alias("idx"), F.lit(None).cast("string").alias("digest"), "left", "right", "subroot", "root")
    rows = members.select("s", F.expr(f"idx div {RUN}").alias("run"), F.lit(1).alias("tag"), "idx", "digest", *more)
    return dealt(paths.unionByName(rows, allowMissingColumns=True), "tag", "idx")


def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(s, run, the path's row, the members' rows, their levels)."""
    for s, run, rows in runs(batches):
        path, members = rows[0], rows[1:]
        yield s, run, path, members, levels([r[2] for r in members], run)


def descend(rounds: list[DataFrame], above: DataFrame, to: int) -> DataFrame:
    """Paths of the members of round `to`, from those of the last single nodes."""
    text = pa.list_(pa.string())
    schema = pa.schema([("s", pa.string()), ("idx", pa.int64()), ("left", text), ("right", text), ("subroot", pa.string()), ("root", pa.string())])

    def longer(batches):
        for s, _, path, members, built in paired(batches):
            for at, m in enumerate(members):
                left, right = siblings(built, at)
                yield s, m[1], left + path[3], right + path[4], path[5], path[6]

    for r in range(len(rounds) - 2, to - 1, -1):
        above = with_paths(rounds[r], above).mapInArrow(lambda b: by_lots(longer(b), schema), PATH)
    return above


def sorted_leaves(docs: DataFrame, folder: str) -> DataFrame:
    """s, idx, digest, doc_id, tampered: leaves with their place among their source's, from one external sort.

    The sort's task and the row's place in it (`at`) are written with the rows, so counts of (task, source) give each row its
    index without a window over a source. s is the source behind a mark, empty for null: null comes first, bytes decide.
    """
    spark = docs.sparkSession
    newline = F.contains(F.col("text"), F.lit("\n")) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    rows = docs.select(
        F.coalesce(F.concat(F.lit("+"), "source"), F.lit("")).alias("s"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf_digest().alias("digest"),
        F.when(newline, leaf_digest(text=F.replace("text", F.lit("\n"), F.lit("")))).alias("tampered"), F.monotonically_increasing_id().alias("nth"),
    )
    order = ["s", "doc_id", "digest", "nth"]  # equal rows are dealt by nth; which of them comes first changes nothing
    ranged = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).drop("nth")
    ranged.withColumn("at", F.monotonically_increasing_id()).write.parquet(folder)
    stored = spark.read.parquet(folder).withColumn("task", F.shiftright("at", 33))
    counted = stored.groupBy("task", "s").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(W.partitionBy("s").orderBy("task")) - F.col("n")
    starts = counted.select("task", "s", (before - F.col("first")).alias("shift"))
    return stored.join(starts, ["task", "s"]).select("s", (F.col("at") + F.col("shift")).alias("idx"), "digest", "doc_id", "tampered")


def manifest(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of docs (doc_id, source, lang, n_chars, text).

    Where 2 divides the CRC-32 of the decimal doc_id, the row is tampered with: its text has lost its line feeds. The root
    folded from its leaf and the original siblings is compared with the root. Rows of one source and doc_id, nulls first, stand
    by their leaves; equal rows have equal leaves and proofs of their own. Null fields are a dash in the leaf, empty texts
    `0:`; a null doc_id is never tampered with. Columns beyond the five, whatever their names, are no part of a leaf. An empty
    table gives an empty result and no root. The node store stays in `folder`, by default in the session's shared folder.
    """
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/merkle-{uuid.uuid4().hex}"
    leaves = sorted_leaves(docs.select(*FIELDS), f"{folder}/leaves")
    rounds = build(leaves, f"{folder}/nodes")
    subroots = ranked(rounds[-1].select("s", "digest"), "s").select("s", F.col("rank").alias("idx"), "digest")
    tops = build(subroots.select(F.lit("").alias("s"), "idx", "digest"), f"{folder}/sources")
    none = F.array().cast("array<string>")
    root = tops[-1].select("s", "idx", none.alias("left"), none.alias("right"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    up = descend(tops, root, 0)
    own = subroots.join(up.drop("s", "subroot"), "idx").select("s", F.lit(0).cast("bigint").alias("idx"), "left", "right", F.col("digest").alias("subroot"), "root")
    return proved(leaves, descend(rounds, own, 1)).withColumn("verified", F.col("folded_root") == F.col("root"))


def proved(leaves: DataFrame, above: DataFrame) -> DataFrame:
    """Every leaf's proof and the root that its row folds to now, run by run."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"))])

    def rows(batches):
        for _, _, path, members, built in paired(batches):
            over = list(zip(path[3], path[4]))
            tail = "".join(x + y for x, y in over)
            for at, m in enumerate(members):
                near = list(zip(*siblings(built, at)))
                h = m[8] or m[2]
                for x, y in near + over:
                    h = sha(x + h + y)
                yield m[7], m[2], path[5], path[6], sha("".join(x + y for x, y in near) + tail), h

    return with_paths(leaves, above, "doc_id", "tampered").mapInArrow(lambda b: by_lots(rows(b), schema), PROOF)


def stored_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The node store of manifest(): s, level, idx, digest, top, round; a filter on round and level reads those folders alone."""
    return spark.read.parquet(f"{folder}/nodes")


def sql(depth: int = 12, source_depth: int = 6) -> str:
    """manifest() over `documents` in SQL, for up to 3**depth leaves a source and 3**source_depth sources."""
    enc = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(enc, FIELDS[:4]), enc(text)]) + ")"
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda d, z: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384::BIGINT) ELSE d >> 1 END)"
    crc = f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {bits}))"
    ctes = [
        "d0 AS (SELECT *, coalesce('+' || source, '') AS s, replace(text, chr(10), '') AS flat FROM documents)",
        f"d AS (SELECT s, doc_id, {leaf('text')} AS leaf, CASE WHEN {crc} % 2 = 0 THEN {leaf('flat')} ELSE {leaf('text')} END AS now FROM d0)",
        "p0 AS (SELECT *, now AS f, '' AS proof, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
        "n0 AS (SELECT s, i, leaf AS h FROM p0)",
    ]

    def grow(p: str, n: str, k: int, extra: str) -> None:
        ctes.append(f"{n}g{k} AS (SELECT s, i // 3 AS i, list(h ORDER BY i) AS hs, any_value(m) AS m FROM (SELECT *, count(*) OVER (PARTITION BY s) AS m FROM {n}{k}) GROUP BY s, i // 3)")
        ctes.append(f"{n}{k + 1} AS (SELECT s, i, CASE WHEN m = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {n}g{k})")
        x, y = "array_to_string(hs[1:p.i % 3], '')", "array_to_string(hs[p.i % 3 + 2:], '')"
        ctes.append(f"{p}{k + 1} AS (SELECT {extra}, p.s, p.i // 3 AS i, CASE WHEN m = 1 THEN f ELSE sha256({x} || f || {y}) END AS f, CASE WHEN m = 1 THEN proof ELSE proof || {x} || {y} END AS proof FROM {p}{k} p JOIN {n}g{k} g ON p.s = g.s AND p.i // 3 = g.i)")

    for k in range(depth):
        grow("p", "n", k, "p.doc_id, p.leaf")
    ctes.append(f"r AS (SELECT s AS src, h AS subroot, row_number() OVER (ORDER BY s) - 1 AS i FROM n{depth})")
    ctes.append("t0 AS (SELECT '' AS s, i, subroot AS h FROM r)")
    ctes.append(f"q0 AS (SELECT doc_id, leaf, subroot, '' AS s, r.i, f, proof FROM p{depth} p JOIN r ON p.s = r.src)")
    for k in range(source_depth):
        grow("q", "t", k, "p.doc_id, p.leaf, p.subroot")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM q{source_depth}, t{source_depth}"
