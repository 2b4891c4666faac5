"""Files chunked from slices give the chunks of the whole file; files are written block by block."""

import hashlib

import numpy as np
import pytest

from pathledger.functions import cdc
from pathledger.operators import slices

SECRET = bytes([0x5A]) * 32
GEAR = cdc.gear_table(SECRET)


def noise(n, seed):
    return np.random.default_rng(seed).integers(0, 256, n, dtype=np.uint8).tobytes()


def rows(spark, files, size):
    return spark.createDataFrame([(f, k // size, d[k : k + size]) for f, d in files.items() for k in range(0, max(1, len(d)), size)], "file string, slice bigint, bytes binary").repartition(4)


def check(spark, files, profile, size):
    got = {}
    for r in slices.chunk_slices(rows(spark, files, size), SECRET, profile, size).collect():
        got.setdefault(r.file, []).append((r.pos, r.offset, r.len, r.cid))
    for f, d in files.items():
        want = [(k, a, n, hashlib.sha256(d[a : a + n]).hexdigest()) for k, (a, n) in enumerate(cdc.spans(d, GEAR, profile))]
        assert sorted(got.get(f, [])) == want, f


def test_slices_of_32_mib(spark):
    """The published profile for large binaries, whose chunks span up to four slices of 1 MiB, and the small one."""
    data = noise(32 << 20, 0xB16B00B5)
    check(spark, {"big": data}, cdc.LARGE_BINARY, 1 << 20)
    check(spark, {"big": data[: 5 << 20]}, cdc.SOURCE_CODE, 1 << 20)


def test_slices_of_odd_files(spark, monkeypatch):
    """Forced cuts by the dozen, runs of one byte, repeats, short and empty files, slices smaller than a chunk."""
    p = cdc.Profile(64, 256, 1024, 10, 6)
    files = {"zeros": bytes(40_000), "mixed": noise(9000, 1) + bytes(20_000) + noise(9000, 2), "loop": noise(100, 3) * 300, "short": b"abc", "least": noise(64, 4), "slice": noise(4096, 5), "none": b""}
    files |= {f"n{k}": noise(3000 + 1000 * k, k) for k in range(6)}
    check(spark, files, p, 4096)
    monkeypatch.setattr(slices, "ROUNDS", 1)
    check(spark, files, p, 700)


def test_missing_slices_are_an_error(spark):
    df = rows(spark, {"f": noise(5000, 1)}, 1000)
    for bad in (df.filter("slice <> 2"), df.filter("slice <> 0")):
        with pytest.raises(ValueError, match="missing"):
            slices.chunk_slices(bad, SECRET, cdc.SOURCE_CODE, 1000)


def test_slices_read_from_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.bin").write_bytes(noise(2500, 1))
    (tmp_path / "empty").write_bytes(b"")
    got = {(r.file, r.slice): bytes(r.bytes) for r in slices.sliced(spark, str(tmp_path), 1000).collect()}
    assert got == {("d/a.bin", 0): noise(2500, 1)[:1000], ("d/a.bin", 1): noise(2500, 1)[1000:2000], ("d/a.bin", 2): noise(2500, 1)[2000:], ("empty", 0): b""}


def test_files_are_written_block_by_block(spark, tmp_path):
    top = tmp_path / "t"
    big = noise(3 << 20, 7)
    files = {"a/big.bin": big, "run.sh": b"#!", "empty": b""}
    entries = spark.createDataFrame([(p, p == "run.sh", len(d), hashlib.sha256(d).hexdigest()) for p, d in files.items()], "p string, x boolean, sz bigint, pcid string")
    blocks = spark.createDataFrame([(p, k, d[a : a + n]) for p, d in files.items() for k, (a, n) in enumerate(cdc.spans(d, GEAR, cdc.SOURCE_CODE))] + [("stray", 0, b"x")], "p string, pos int, bytes binary").repartition(7)
    for _ in range(2):
        slices.write_files(entries, blocks, str(top))
    assert {str(f.relative_to(top)): f.read_bytes() for f in top.rglob("*") if f.is_file()} == files
    assert (top / "run.sh").stat().st_mode & 0o100 and not (top / "empty").stat().st_mode & 0o100
    for bad, what in ((blocks.filter("pos <> 1 or p <> 'a/big.bin'"), "missing"), (blocks.filter("p <> 'run.sh'"), "isn't what")):
        with pytest.raises(Exception, match=what):
            slices.write_files(entries, bad, str(top))
    (top / "ln").symlink_to(tmp_path)
    for p, what in (("ln/x", "link"), ("../x", "untrusted")):
        with pytest.raises(Exception, match=what):
            slices.write_files(entries.filter("p = 'empty'").replace("empty", p, "p"), blocks, str(top))
    assert {str(f.relative_to(top)): f.read_bytes() for f in top.rglob("*") if f.is_file() and "ln" not in f.parts} == files


def test_a_large_file_takes_little_memory(tmp_path):
    import collections
    import tracemalloc

    row = collections.namedtuple("row", "p pos bytes x sz pcid")
    block, n = noise(1 << 16, 1), 3200
    digest = hashlib.sha256()
    for _ in range(n):
        digest.update(block)
    tracemalloc.start()
    slices.append_files(iter([row("f", -1, None, False, n << 16, digest.hexdigest()), *(row("f", k, block, None, None, None) for k in range(n))]), str(tmp_path))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (tmp_path / "f").stat().st_size == n << 16 and peak < 8 << 20


@pytest.mark.parametrize("most_sent", [500_000, 0])
def test_runs_of_few_slices(spark, monkeypatch, most_sent):
    """Runs of one largest chunk, by broadcast and by shuffled names: files of one run beside files of many, ends at, before and behind a run's end."""
    p = cdc.Profile(64, 256, 1024, 10, 6)
    monkeypatch.setattr(slices, "RUN", 0)
    monkeypatch.setattr(slices, "MOST_SENT", most_sent)
    files = {f"n{k}": noise(k, k) for k in (1, 300, 1399, 1400, 1401, 2800, 2801, 5000, 9000)} | {"zeros": bytes(20_000), "mixed": noise(3000, 1) + bytes(6000) + noise(2000, 2)}
    check(spark, files, p, 700)


def test_neighbours_bytes_are_few(spark):
    """What runs are sent of each other is at most about a quarter of the bytes; six slices each got every slice of 700 before."""
    p = cdc.Profile(256, 1024, 4096, 12, 8)
    df = rows(spark, {"f": noise(400_000, 1), "g": noise(900, 2)}, 700)
    sent = slices._with_context(df, p, 700, slices._per_run(p, 700)).selectExpr("sum(octet_length(piece))").first()[0]
    assert 400_900 < sent < 1.26 * 400_900
