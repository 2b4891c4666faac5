"""Three-way line merge."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_BYTES = 5 << 20
MOST_CELLS = 4_000_000
SCHEMA = T.StructType([T.StructField("status", T.StringType()), T.StructField("content", T.BinaryType())])


def is_binary(b: bytes) -> bool:
    try:
        b.decode()
    except UnicodeDecodeError:
        return True
    return b"\0" in b[:8192]


def split_lines(b: bytes) -> list[bytes]:
    return b.splitlines(keepends=True) if b"\r" not in b else [x + b"\n" for x in b.split(b"\n")[:-1]] + ([b.split(b"\n")[-1]] if b.split(b"\n")[-1] else [])


def matches(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]] | None:
    """Pairs of a longest common subsequence; ties advance `a` first. None if the table would be too large."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    tail = 0
    while tail < min(len(a), len(b)) - lo and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[lo : len(a) - tail], b[lo : len(b) - tail]
    if len(x) * len(y) > MOST_CELLS:
        return None
    ids: dict[bytes, int] = {}
    p, q = (np.array([ids.setdefault(s, len(ids)) for s in side], dtype=np.int64) for side in (x, y))
    table = np.zeros((len(x) + 1, len(y) + 1), dtype=np.int32)
    for i in range(len(x) - 1, -1, -1):  # a row at once: the running maximum carries values from the right
        best = np.maximum(table[i + 1, :-1], np.where(q == p[i], table[i + 1, 1:] + 1, 0))
        table[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    out, i, j = [(k, k) for k in range(lo)], 0, 0
    while i < len(x) and j < len(y):
        if p[i] == q[j]:
            out.append((lo + i, lo + j))
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return out + [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]


def _runs(lines: list[bytes]) -> list[tuple[int, int]]:
    """[first, end) of runs of two or more equal lines in a row."""
    starts = [i for i in range(len(lines)) if i == 0 or lines[i] != lines[i - 1]] + [len(lines)]
    return [(a, b) for a, b in pairwise(starts) if b - a > 1]


def _reconciled(base: list[bytes], gaps: list[tuple[int, int, list[bytes], list[bytes], list[bytes]]]) -> bool:
    """Within a run of equal base lines copies can't be told apart, so what the gaps that touch it take away or add
    must lie between what either side did there. gaps: (first, end, local, remote, taken)."""
    for first, end in _runs(base):
        line, local, remote, got = base[first], 0, 0, 0
        for a, b, p, q, taken in gaps:
            if a <= end and b >= first:
                had = base[a:b].count(line)
                local, remote, got = local + p.count(line) - had, remote + q.count(line) - had, got + taken.count(line) - had
        if not min(local, remote, 0) <= got <= max(local, remote, 0):
            return False
    return True


def merge3(base: bytes | None, local: bytes | None, remote: bytes | None) -> tuple[str, bytes | None]:
    """('clean', bytes), ('conflict', None) or ('binary', None)."""
    base, local, remote = base or b"", local or b"", remote or b""
    if max(map(len, (base, local, remote))) > MOST_BYTES:
        return "conflict", None
    if any(map(is_binary, (base, local, remote))):
        return "binary", None
    if local == remote or remote == base:
        return "clean", local
    if local == base:
        return "clean", remote
    b, p, q = map(split_lines, (base, local, remote))
    one, two = matches(b, p), matches(b, q)
    if one is None or two is None:
        return "conflict", None
    in_p, in_q = dict(one), dict(two)
    sync = [(-1, -1, -1)] + [(i, in_p[i], in_q[i]) for i in range(len(b)) if i in in_p and i in in_q] + [(len(b), len(p), len(q))]
    out: list[bytes] = []
    gaps = []
    for (i, j, k), (i2, j2, k2) in pairwise(sync):
        gap, left, right = b[i + 1 : i2], p[j + 1 : j2], q[k + 1 : k2]
        if left != right and left != gap and right != gap:
            return "conflict", None
        taken = right if left == gap else left
        gaps.append((i + 1, i2, left, right, taken))
        out += taken + b[i2 : i2 + 1]
    return ("clean", b"".join(out)) if _reconciled(b, gaps) else ("conflict", None)


@F.pandas_udf(SCHEMA)
def merge3_udf(base: pd.Series, local: pd.Series, remote: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([merge3(*x) for x in zip(base, local, remote)], columns=["status", "content"])
