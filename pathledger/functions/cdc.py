"""Content-defined chunks: a gear hash whose cuts depend only on the bytes nearby."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SHIFTS = np.arange(1, 64, dtype=np.uint64)
SPAN_SCHEMA = "pos int, offset bigint, len bigint, cid string"


@dataclass(frozen=True)
class Profile:
    """Sizes in bytes, and the one-bits of the masks before and after the average size."""

    least: int
    average: int
    most: int
    strict_bits: int
    lax_bits: int


SOURCE_CODE = Profile(16 << 10, 64 << 10, 256 << 10, 18, 14)
LARGE_BINARY = Profile(256 << 10, 1 << 20, 4 << 20, 22, 18)


def gear_table(secret: bytes) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.sha256(b"gear" + secret + bytes([i])).digest()[:8], "little") for i in range(256)], dtype=np.uint64)


class Cutter:
    """Where chunks end in a stretch of bytes.

    A shift-left gear hash forgets a byte after 64 steps, and its top b bits after b steps,
    so the hash that restarts in each chunk equals, from 64 bytes on, one computed in bulk.
    """

    def __init__(self, data: bytes, gear: np.ndarray, profile: Profile):
        n, self.profile = len(data), profile
        table = gear[np.frombuffer(data, np.uint8)] if n else gear[:0]
        rolling, step = table.copy(), 1
        while step < min(64, max(n, 1)):  # doubling: the sum of 2*step shifted values from two sums of step
            rolling[step:] = rolling[step:] + (rolling[:-step] << np.uint64(step))
            step *= 2
        self.rolling = rolling
        self.strict = np.flatnonzero((rolling >> np.uint64(64 - profile.strict_bits)) == 0)
        self.lax = np.flatnonzero((rolling >> np.uint64(64 - profile.lax_bits)) == 0)

    def first(self, hits: np.ndarray, bits: int, begin: int, lo: int, hi: int) -> int | None:
        """The first cut in [lo, hi); the hash begins at `begin`, so its first 63 values are redone."""
        stop = min(begin + 63, hi)
        if lo < stop:  # what came before the restart is shifted out of the bulk value
            before = self.rolling[begin - 1] if begin else np.uint64(0)
            fresh = self.rolling[begin:stop] - (before << SHIFTS[: stop - begin])
            at = np.flatnonzero((fresh >> np.uint64(64 - bits)) == 0) + begin
            at = at[at >= lo]
            if len(at):
                return int(at[0])
        k = np.searchsorted(hits, max(lo, begin + 63))
        return int(hits[k]) if k < len(hits) and hits[k] < hi else None

    def size(self, start: int, left: int) -> int:
        """The size of the chunk that begins at `start`, with `left` bytes up to the end of the file."""
        p = self.profile
        if left <= p.least:
            return left
        begin, middle, end = start + p.least, start + min(p.average, left), start + min(p.most, left)
        at = self.first(self.strict, p.strict_bits, begin, begin, middle)
        if at is None:
            at = self.first(self.lax, p.lax_bits, begin, middle, end)
        return (at + 1 if at is not None else end) - start


def spans(data: bytes, gear: np.ndarray, profile: Profile) -> list[tuple[int, int]]:
    """Offsets and lengths that tile `data`."""
    cutter, n, out, start = Cutter(data, gear, profile), len(data), [], 0
    while start < n:
        size = cutter.size(start, n - start)
        out.append((start, size))
        start += size
    return out


def chunk(df: DataFrame, content: str, keys: list[str], secret: bytes, profile: Profile = SOURCE_CODE) -> DataFrame:
    """One row per span of each row's content, with the span's content id. Null content gives no row."""
    gear = gear_table(secret)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, found = [], []
            for i, value in enumerate(batch.column(content)):
                data = value.as_py()
                data = data.encode() if isinstance(data, str) else data
                for pos, (offset, size) in enumerate(spans(data or b"", gear, profile)):
                    take.append(i)
                    found.append((pos, offset, size, hashlib.sha256(data[offset : offset + size]).hexdigest()))
            own = [batch.column(k).take(pa.array(take, pa.int64())) for k in keys]
            cols = list(zip(*found)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([*own, pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], [*keys, "pos", "offset", "len", "cid"])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, content).mapInArrow(run, f"{schema}, {SPAN_SCHEMA}")
