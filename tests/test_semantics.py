"""Rules that the driver's tables don't show: line merges, echoes, copies, page depth, apply order, refusals."""

import pytest
from pyspark.sql import functions as F

from pathledger.functions import cdc, content
from pathledger.functions.merge3 import MOST_BYTES, merge3
from pathledger.operators import diff, pages, reconcile, revlog
from pathledger.streaming import feed

CLEAN = [
    (b"l1\nl2\n", b"HEAD\nl1\nl2\n", b"l1\nl2\nTAIL\n", b"HEAD\nl1\nl2\nTAIL\n"),
    (b"a\nb\nc\n", b"a\nb\nc\nd\n", b"a\nb\nc\n", b"a\nb\nc\nd\n"),
    (b"a\nb\nc\nd\ne\n", b"a\nB!\nc\nd\ne\n", b"a\nb\nc\nD!\ne\n", b"a\nB!\nc\nD!\ne\n"),
    (b"a\nb\nc\n", b"a\nCHANGED\nc\n", b"a\nCHANGED\nc\n", b"a\nCHANGED\nc\n"),
    (b"a\nb\nc\nd\ne\n", b"a\nB\nc\nd\ne\n", b"a\nb\nc\nD\ne\n", b"a\nB\nc\nD\ne\n"),
    (b"", b"x\n", b"x\n", b"x\n"),
    (b"a\nb", b"a\nb\nc\n", b"PRE\na\nb", b"PRE\na\nb\nc\n"),
    (b"a\r\nb\r\n", b"HEAD\r\na\r\nb\r\n", b"a\r\nb\r\nTAIL\r\n", b"HEAD\r\na\r\nb\r\nTAIL\r\n"),
    (b"a\nb\nc\nd\n", b"a\nc\nd\n", b"a\nb\nc\nD!\n", b"a\nc\nD!\n"),
    (b"one\ntwo\nthree\nfour\n", b"one\ntwoL\nthree\nfour\nfive\n", b"zero\none\ntwo\nthree\nfour\n", b"zero\none\ntwoL\nthree\nfour\nfive\n"),
    (b"h1\na\nh2\nb\nh3\n}\n}\n}\n", b"h1\nA!\nh2\nb\nh3\n}\n}\n", b"h1\na\nh2\nB!\nh3\n}\n}\n", b"h1\nA!\nh2\nB!\nh3\n}\n}\n"),
    (b"h1\nx\nx\nh2\nc\nh3\n", b"h1\nh2\nc\nh3\n", b"h1\nx\nx\nh2\nC!\nh3\n", b"h1\nh2\nC!\nh3\n"),
    (b"fn a() {\n\n}\nfn b() {\n\n}\n", b"fn a() {\n  x;\n}\nfn b() {\n\n}\n", b"fn a() {\n\n}\nfn b() {\n  y;\n}\n", b"fn a() {\n  x;\n}\nfn b() {\n  y;\n}\n"),
]
CONFLICT = [
    (b"a\nb\nc\n", b"a\nBL\nc\n", b"a\nBR\nc\n"),
    (b"a\nb\nc\nd\n", b"a\nB\nc\nd\n", b"a\nb\nC\nd\n"),
    (b"a\nb\n", b"a\nX\nb\n", b"a\nY\nb\n"),
    (b"", b"x\n", b"y\n"),
    (b"a\nb\nc", b"a\nb\nLOCAL", b"a\nb\nREMOTE"),
    (b"a\n", b"a" * (MOST_BYTES + 1), b"b\n"),
    (b"a\n", b"a" * (MOST_BYTES + 1), b"a" * (MOST_BYTES + 1)),
]


@pytest.mark.parametrize(("base", "local", "remote", "want"), CLEAN)
def test_clean_merges(base, local, remote, want):
    assert merge3(base, local, remote) == ("clean", want)
    assert merge3(base, remote, local) == ("clean", want)


@pytest.mark.parametrize(("base", "local", "remote"), CONFLICT)
def test_conflicts(base, local, remote):
    assert merge3(base, local, remote) == ("conflict", None)


@pytest.mark.parametrize("bad", [b"\xff\xfe\x00\x01", b"a\x00b\n"])
def test_binary_sides(bad):
    assert merge3(b"a\nb\n", bad, b"a\nb\nc\n") == ("binary", None)


@pytest.mark.parametrize(
    ("base", "local", "remote", "copies"),
    [
        (b"a\nb\nc\n}\n}\n}\n", b"A!\nb\nc\n}\n}\n", b"a\nb\nc\n}\n}\n", 2),
        (b"h1\na\nh2\n}\n}\n", b"h1\nA!\nh2\n}\n}\n}\n", b"h1\na\nh2\n}\n}\n}\n", 3),
    ],
)
def test_runs_of_equal_lines_lose_and_gain_no_copy(base, local, remote, copies):
    status, got = merge3(base, local, remote)
    assert status == "conflict" or got.count(b"}\n") == copies


def test_binary_predicate(spark):
    rows = [(1, b"plain\n0\n0"), (2, b"0\n\x00"), (3, b"\xff\xfe"), (4, b"x" * 8192 + b"\x00"), (5, b"x" * 8191 + b"\x00"), (6, b"")]
    d = spark.createDataFrame(rows, "i int, b binary")
    assert {r.i for r in d.filter(content.is_binary(F.col("b"))).collect()} == {2, 3, 5}


def echoes(spark, events, marks):
    e = spark.createDataFrame(events, "event_id bigint, path string, mtime bigint, pcid string, ts_ms bigint")
    m = spark.createDataFrame(marks, "path string, mtime bigint, pcid string, recorded_ms bigint")
    return {x[0] for x in events} - {r.event_id for r in feed.suppress_echo(e, m).collect()}


def test_echoes(spark):
    # a match consumes its mark; another content or time leaves it
    assert echoes(spark, [(1, "a", 42, "edited", 5), (2, "a", 41, "applied", 6), (3, "a", 42, "applied", 7), (4, "a", 42, "applied", 8)], [("a", 42, "applied", 0)]) == {3}
    # an unmarked path is never an echo, a mark expires exactly at the TTL, a later mark replaces an earlier one
    assert echoes(spark, [(1, "other", 7, "h", 1)], [("x", 7, "h", 0)]) == set()
    assert echoes(spark, [(1, "x", 7, "h", feed.ECHO_TTL_MS)], [("x", 7, "h", 0)]) == set()
    assert echoes(spark, [(1, "x", 7, "h", feed.ECHO_TTL_MS - 1)], [("x", 7, "h", 0)]) == {1}
    assert echoes(spark, [(1, "x", 1, "h1", 20), (2, "x", 2, "h2", 21)], [("x", 1, "h1", 0), ("x", 2, "h2", 10)]) == {2}
    assert echoes(spark, [(1, "x", 1, "h", 5), (2, "x", 1, "h", 15)], [("x", 1, "h", 0), ("x", 1, "h", 10)]) == {1, 2}


def test_deep_pages_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "parent bigint, child bigint")
    top = spark.createDataFrame([(0,)], "node bigint")
    assert pages.reachable(chain, top, 6).count() == 7
    with pytest.raises(ValueError, match="deeper"):
        pages.reachable(chain, top, 5)
    loop = chain.unionByName(spark.createDataFrame([(6, 0)], "parent bigint, child bigint"))
    assert pages.reachable(loop, top, 6).count() == 7


def entries(spark, n, edit=()):
    d = spark.range(n).select(F.format_string("file%05d", "id").alias("key"), F.col("id").isin(list(edit) or [-1]).alias("e"))
    return d.select("key", F.col("key").alias("p"), F.lit(0).cast("tinyint").alias("t"), F.lit(False).alias("x"), F.lit(1).cast("bigint").alias("sz"), F.sha2(F.concat("key", F.col("e").cast("string")), 256).alias("pcid"), F.lit(None).cast("string").alias("lt"))


@pytest.mark.parametrize(("n", "edit", "read", "every"), [(600, [10], 4, 8), (5000, [2500], 4, 42), (600, [], 0, 8)])
def test_pages_read(spark, n, edit, read, every):
    rows = [pages.leaves(entries(spark, n, e)) for e in ([], edit)]
    levels = [pages.index_levels(made) for _, made in rows]
    changed, got = diff.diff_by_pages(rows[0][0], rows[1][0], *levels)
    assert got == read and sum(x.count() for x in levels) == every
    assert [r.key for r in changed.collect()] == [f"file{i:05}" for i in edit]


def test_trees_of_unlike_height(spark):
    rows = [pages.leaves(entries(spark, n), 4) for n in (6, 40)]
    changed, _ = diff.diff_by_pages(rows[0][0], rows[1][0], *(pages.index_levels(made, 4) for _, made in rows))
    assert sorted(r.key for r in changed.collect()) == [f"file{i:05}" for i in range(6, 40)]


def test_copies_refuse_when_all_names_are_taken(spark):
    c = spark.createDataFrame([("a.txt", 0, "h")], "p string, t int, pcid string")
    names = ["laptop", *(f"laptop {k}" for k in range(2, 4))]
    taken = spark.createDataFrame([(f"a (conflicto {x}, seq 7).txt", 0, "other") for x in names], "key string, t int, pcid string")
    none = taken.limit(0).select("key")
    assert reconcile.copy_paths(c, taken, none, "laptop", 7, slots=4).first().copy_name == "a (conflicto laptop 4, seq 7).txt"
    same = taken.withColumn("pcid", F.lit("h"))  # this very copy lies there already: a retry reuses its name
    assert reconcile.copy_paths(c, same, none, "laptop", 7, slots=3).first().copy_name == "a (conflicto laptop, seq 7).txt"
    with pytest.raises(ValueError, match="taken"):
        reconcile.copy_paths(c, taken, none, "laptop", 7, slots=3)


def test_apply_order(spark):
    cols = "key string, p string, t int, x boolean, pcid string, lt string"
    row = lambda p, t, h=None: (p, p, t, False, h, None)
    old = spark.createDataFrame([row("a", 3), row("a/b", 3), row("a/b/f", 0, "1"), row("turns", 3), row("turns/in", 0, "2"), row("grows", 0, "3"), row("c:x", 0, "9")], cols)
    new = spark.createDataFrame([row("turns", 0, "4"), row("grows", 3), row("grows/deep", 3), row("grows/deep/f", 0, "5"), row("c:x", 0, "8")], cols)
    got = [(r.p, r.phase) for r in diff.apply_plan(diff.diff(old, new), old, new).collect()]
    assert got == [("grows", 0), ("grows/deep", 0), ("a/b/f", 1), ("grows/deep/f", 1), ("turns/in", 1), ("a/b", 2), ("a", 2), ("turns", 3)]
    bad = spark.createDataFrame([row("../up", 0, "1")], cols)
    with pytest.raises(Exception, match="untrusted"):
        diff.apply_plan(diff.diff(bad, new), bad, new).collect()


def test_commit_leaves_no_half_revision(spark, tmp_path):
    folder = f"file://{tmp_path}"
    assert revlog.commit(spark, folder, "s", None, b"one") == 0
    assert revlog.commit(spark, folder, "s", None, b"again") is None
    heads = iter([None, 0])
    assert revlog.commit_with_retry(spark, folder, "s", lambda: next(heads), lambda base: b"two") == 1
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if not p.name.startswith(".")) == ["0", "1"]
    assert (tmp_path / "s" / "1").read_bytes() == b"two"
    tries = iter([None, 5])
    assert revlog.catch_up(lambda: None, lambda: next(tries)) == 5
    with pytest.raises(RuntimeError):
        revlog.catch_up(lambda: None, lambda: None, 2)


def corpus(n, seed):
    x, out = seed | 1, bytearray()
    while len(out) < n:
        x ^= x >> 12
        x ^= (x << 25) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 27
        out += ((x * 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little")
    return bytes(out[:n])


def cuts(data, profile=cdc.SOURCE_CODE):
    return cdc.spans(data, cdc.gear_table(bytes([0x5A]) * 32), profile)


def test_a_byte_replaced_moves_two_chunks_at_most():
    data = corpus(1_500_000, 0xDE17A)
    other = data[:750_000] + bytes([data[750_000] ^ 1]) + data[750_001:]
    a, b = ({s[o : o + n] for o, n in cuts(s)} for s in (data, other))
    assert len(b - a) <= 2 and len(a & b) >= 0.9 * len(a)


def test_a_byte_inserted_loses_two_boundaries_at_most():
    data = corpus(1_500_000, 0xBEEF)
    other = data[:700_000] + b"!" + data[700_000:]
    a = {len(data) - o for o, _ in cuts(data) if o > 700_000} | {o for o, _ in cuts(data) if o <= 700_000}
    b = {len(other) - o for o, _ in cuts(other) if o > 700_001} | {o for o, _ in cuts(other) if o <= 700_000}
    assert len(a - b) <= 2 and len(a & b) >= 0.9 * len(a)


def test_large_binaries_have_a_quarter_of_the_chunks():
    data = corpus(8 << 20, 0xB16B00B5)
    small, large = cuts(data), cuts(data, cdc.LARGE_BINARY)
    assert len(small) >= 4 * len(large) and sum(n for _, n in large) == len(data)
