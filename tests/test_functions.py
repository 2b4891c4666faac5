import os
import random

from hypothesis import given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from pathledger.functions import cdc, content, paths
from pathledger.functions.merge3 import merge3
from pathledger.operators import blocks, gc, pages, reconcile, revlog, snapshot

GEAR = cdc.gear_table(bytes([0x5A]) * 32)
P = cdc.Profile(256, 1024, 4096, 12, 8)


def slow_spans(data, gear, p):
    out, start = [], 0
    while start < len(data):
        left = len(data) - start
        if left <= p.least:
            out.append((start, left))
            break
        fp, cut = 0, min(p.most, left)
        for i in range(p.least, cut):
            fp = ((fp << 1) + int(gear[data[start + i]])) & (2**64 - 1)
            if fp >> (64 - (p.strict_bits if i < min(p.average, left) else p.lax_bits)) == 0:
                cut = i + 1
                break
        out.append((start, cut))
        start += cut
    return out


def test_chunks_match_the_plain_loop_and_tile():
    r = random.Random(1)
    for n in (0, 1, 255, 256, 257, 5000, 60_000):
        data = r.randbytes(n)
        got = cdc.spans(data, GEAR, P)
        assert got == slow_spans(data, GEAR, P)
        assert sum(x for _, x in got) == n


def test_a_substitution_moves_few_chunks():
    data = bytearray(random.Random(2).randbytes(100_000))
    a = {bytes(data[o : o + n]) for o, n in cdc.spans(bytes(data), GEAR, P)}
    data[50_000] ^= 1
    b = {bytes(data[o : o + n]) for o, n in cdc.spans(bytes(data), GEAR, P)}
    assert len(b - a) <= 3


def test_merge3_cases():
    base = b"a\nb\nc\nd\n"
    assert merge3(base, b"a\nB\nc\nd\n", b"a\nb\nc\nD\n") == ("clean", b"a\nB\nc\nD\n")
    assert merge3(base, b"a\nB\nc\nd\n", b"a\nX\nc\nd\n")[0] == "conflict"
    assert merge3(base, b"a\n\0", b"x")[0] == "binary"
    assert merge3(base, base, b"x\n") == ("clean", b"x\n")
    assert merge3(b"", b"a\n", b"b\n")[0] == "conflict"
    assert merge3(b"a\r\nb\r\n", b"a\r\nb\r\nc\r\n", b"z\r\na\r\nb\r\n") == ("clean", b"z\r\na\r\nb\r\nc\r\n")
    assert merge3(None, b"q", None) == ("clean", b"q")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a\n", b"b\n", b"c\n"]), max_size=8), st.lists(st.sampled_from([b"a\n", b"b\n"]), max_size=8))
def test_merge3_one_sided_is_that_side(x, y):
    b, o = b"".join(x), b"".join(y)
    assert merge3(b, o, b) == ("clean", o)
    assert merge3(b, b, o) == ("clean", o)


def test_paths(spark):
    names = [("a.txt", "a (conflicto l_x, seq 3).txt"), (".gitignore", ".gitignore (conflicto l_x, seq 3)"), ("d.x/..hid", "d.x/..hid (conflicto l_x, seq 3)"), ("a.tar.gz", "a.tar (conflicto l_x, seq 3).gz"), ("foo.", "foo. (conflicto l_x, seq 3)")]
    df = spark.createDataFrame(names, "p string, want string")
    for r in df.select("want", paths.conflict_copy_name(F.col("p"), F.lit("l/x"), F.lit(3)).alias("got")).collect():
        assert r.got == r.want
    c = spark.createDataFrame([("a/./b/../c", "a/c"), ("../x", None), ("/x", None), ("a//b", "a/b"), ("a\\b", "a/b")], "p string, want string")
    for r in c.select("p", "want", paths.canonicalize(F.col("p")).alias("got")).collect():
        assert r.got == r.want, r
    t = spark.createDataFrame([("a/l", "../x", True), ("a/l", "../../x", False), ("l", "/x", False), ("a/b/l", "../../x/y", True), ("l", "C:x", False), ("l", "", False)], "p string, t string, ok boolean")
    for r in t.select("*", paths.symlink_target_ok(F.col("p"), F.col("t")).alias("got")).collect():
        assert r.got == r.ok, r
    k = spark.createDataFrame([("éA",)], "p string").select(paths.casefold_key(F.col("p"))).first()[0]
    assert k == "éa"
    n = spark.createDataFrame([(".DS_Store", True), (".DS_Store.bak", False), (".x.ft-tmp", True), (".ft-tmp", False), ("q/Thumbs.db", True)], "p string, junk boolean")
    assert all(r.junk == r.got for r in n.select("junk", paths.is_junk(F.col("p")).alias("got")).collect())


def test_ignore_patterns(spark):
    rows = [("build/x.o", ["*.o"], True), ("a/b/x.o", ["/x.o"], False), ("x.o", ["/x.o"], True), ("src/gen/y", ["src/gen"], True), ("a/src/gen", ["src/gen"], False), ("logs", ["logs/"], False), ("logs/a", ["logs/"], True)]
    for p, pats, want in rows:
        assert spark.range(1).select(paths.is_ignored(F.lit(p), F.lit(False), pats)).first()[0] == want, (p, pats)
    assert paths.ignore_regex("!x")[1] and paths.ignore_regex("a**b")[1]


def test_header_and_seal_round_trip(spark):
    d = spark.createDataFrame([(b"hello",), (b"",), (os.urandom(3000),)], "b binary")
    head = content.encode_header(F.lit(1), F.lit(2), F.lit(0), F.octet_length("b"), F.lit(b"n" * 24))
    got = d.select("b", content.decode_header(F.concat(head, "b")).alias("h"), content.decode_header(F.concat(head, "b", F.lit(b"x"))).alias("bad")).collect()
    assert all(r.h.length == len(r.b) and r.h.kind == 2 and r.bad is None for r in got)
    s = d.withColumn("id", F.sha2("b", 256))
    s = s.withColumns({"e": content.seal(F.col("b"), F.col("id"), b"k")}).withColumn("d", content.unseal(F.col("e"), F.col("id"), b"k"))
    assert all(r.d == r.b and r.e != r.b for r in s.collect())
    lines = spark.createDataFrame([("a\nb\n",), ("a\nb",), ("",)], "t string").select(content.lines_kept(F.col("t"))).collect()
    assert [r[0] for r in lines] == [["a\n", "b\n"], ["a\n", "b"], []]


def test_three_level_pages(spark):
    d = spark.range(20).select(F.format_string("k%05d", "id").alias("p"))
    e = snapshot.from_content(d, F.col("p"), F.col("p"))
    r = pages.root(e, 4).first()
    assert (r.levels, r.pages) == (3, 5 + 2 + 1)
    changed = snapshot.from_content(d, F.col("p"), F.when(F.col("p") == "k00010", "other").otherwise(F.col("p")))
    assert pages.root(changed.repartition(3), 4).first().root != r.root
    a, la = pages.leaves(e, 4)
    b, lb = pages.leaves(changed, 4)
    assert a.join(lb.select("page_cid"), "page_cid", "left_anti").count() == 4


def test_resolve_matrix(spark):
    rows, want = {"b": [], "l": [], "r": []}, {}
    kinds = {"000": "NoChange", "111": "NoChange", "121": "FastForwardToLocal", "112": "FastForwardToRemote", "122": "NoChange", "123": "ConflictCopy", "101": "KeepLocal", "110": "TakeRemoteDeletion", "100": "NoChange", "102": "DeleteVsEditKeepEdit", "120": "DeleteVsEditKeepEdit", "011": "NoChange", "012": "ConflictCopy", "010": "FastForwardToLocal", "001": "FastForwardToRemote"}
    for code, verdict in kinds.items():
        for side, v in zip("blr", code):
            if v != "0":
                rows[side].append((f"k{code}", v))
        if code != "000":
            want[f"k{code}"] = verdict
    mk = lambda s: snapshot.from_content(spark.createDataFrame(rows[s], "p string, c string"), F.col("p"), F.col("c"))
    got = {r.key: r.verdict for r in reconcile.resolve(reconcile.three_way(mk("b"), mk("l"), mk("r"))).collect()}
    assert got == want


def test_gc_guards_and_cas(spark, tmp_path):
    listed = spark.createDataFrame([("a", 10), ("b", None), ("c", 10**6), ("d", 20), ("e", 5)], "key string, mtime bigint")
    live = spark.createDataFrame([("a",)], "key string")
    state = {r.key: r.state for r in gc.classify(listed, live, 10_000, 60).collect()}
    assert state == {"a": "reachable", "b": "grace", "c": "grace", "d": "sweepable", "e": "sweepable"}
    assert gc.window_seconds(0) == 0
    heads = lambda: spark.createDataFrame([("s", 1)], "space_id string, head_seq bigint")
    revisions = spark.createDataFrame([("s", 0), ("s", 1)], "space_id string, seq bigint")
    gone = []
    sweep = lambda df: gone.extend(r.key for r in df.collect())
    run = lambda h=heads, r=revisions, space="s", **kw: gc.collect_garbage(listed, live, h, r, space, 10_000, 60, sweep, **kw)
    assert run()["deleted"] == 0 and gone == [] and run()["sweepable"] == 2 and run()["retained_revisions"] == 2
    for why, kw in (
        ("no space", {"h": lambda: heads().limit(0)}), ("isn't among", {"space": "other"}), ("no revisions", {"r": revisions.limit(0)}),
        ("no revisions", {"h": lambda: spark.createDataFrame([("s", 1), ("t", 0)], "space_id string, head_seq bigint")}),
    ):
        with pytest.raises(gc.Refused, match=why):
            run(dry_run=False, **kw)
    many = spark.range(40).select(F.col("id").cast("string").alias("key"), F.col("id").alias("mtime"))
    with pytest.raises(gc.Refused, match="40 of 40"):
        gc.collect_garbage(many, live, heads, revisions, "s", 10_000, 60, sweep, dry_run=False)
    assert gc.collect_garbage(many, live, heads, revisions, "s", 10_000, 60, sweep)["blocked"]
    for after, deleted in ((1, 0), (2, 2)):  # a head moves before the sweep, or during it
        read = []

        def moving():
            read.append(1)
            return spark.createDataFrame([("s", 1 + (len(read) > after))], "space_id string, head_seq bigint")

        gone.clear()
        with pytest.raises(gc.Refused, match="moved") as e:
            run(h=moving, dry_run=False)
        assert e.value.deleted == deleted == len(gone)
    gone.clear()
    assert run(dry_run=False)["deleted"] == 2 and gone == ["e", "d"]
    folder = f"file://{tmp_path}/rev"
    assert revlog.commit(spark, folder, "s", None, b"x") == 0
    assert revlog.commit(spark, folder, "s", None, b"y") is None
    assert revlog.commit(spark, folder, "s", 0, b"z") == 1


def test_index_operators(spark):
    idx = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, blocks.upsert(idx, new, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, blocks.insert_or_ignore(idx, new, ["k"]).collect())) == [("a", 1), ("b", 2), ("c", 4)]
    dev = spark.createDataFrame([("A", "d1", "mac", None)], "account_id string, device_id string, name string, secret string")
    want = spark.createDataFrame([("A", "d9", "mac", "s"), ("A", "d2", "pc", "t")], dev.schema)
    assert sorted(tuple(r) for r in blocks.get_or_create_devices(dev, want).select("device_id", "secret").collect()) == [("d1", "s"), ("d2", "t")]
    spaces = spark.createDataFrame([("x", "s1")], "account_id string, space_id string")
    assert blocks.claim_account(dev, spaces, "A", "B").first().account_id == "B"
