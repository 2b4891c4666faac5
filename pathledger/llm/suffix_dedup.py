"""Removal of long repeated byte strings by suffix sorting.

A string of `length` bytes has an anchor: its first least hash of `gram` bytes. The anchor depends on the string's
bytes alone, so equal strings meet at equal anchors and everything else can be left out without loss. Strings that
start in a row and share their anchor form a run. Runs of one anchor with equal bytes are copies: the earliest stays,
the others' strings all start earlier elsewhere. Only anchors with unlike runs are left; their bytes go to shards by
anchor hash, where a suffix array (induced sorting, external queues) finds equal strings exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathledger.llm import textcore as tc
from pathledger.llm.common import cut_lineage, frees_shuffles, partitions
from pathledger.llm.induced import suffix_array

LENGTH = 100
GRAM = 32
SEGMENT = 1 << 23
BUCKET_BYTES = 24 << 20
MESSAGE_RUNS = 400_000
SHARD_BYTES = 1 << 20
#: Unlike runs of one anchor beyond which they are dealt by parts of `STEP` starts and the bytes those share.
HOT_RUNS = 4096
STEP = 5


def byte_hash(data: np.ndarray) -> np.ndarray:
    """Running sums over the mixed hashes of 8 bytes at each place: repetitive bytes have no structure left that a
    polynomial modulo 2**64 would fall for."""
    g = tc.byte_grams(data, 8)
    total = np.zeros(len(g) + 1, np.uint64)
    np.cumsum(g * tc.powers(len(g)), out=total[1:])
    return total


def span_hash(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the bytes [a, b), 8 at least."""
    return tc.mix((total[b - 7] - total[a]) * tc.powers(len(total), True)[a] + (b - a).astype(np.uint64))


def runs(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, bytes hash, document, anchor position in the document, first and last start relative to it)."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 4
    g = tc.byte_grams(data, gram)
    c = (g & ~tc.U((1 << 24) - 1)) | np.arange(len(g)).astype(np.uint64)
    width, step, low = length - gram + 1, 1, c
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    start = np.arange(len(low))
    doc = np.searchsorted(offs, start, "right") - 1
    ok = start + length <= offs[doc + 1]
    start, doc = start[ok], doc[ok]
    if not len(start):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 4
    at = (low[ok] & tc.U((1 << 24) - 1)).astype(np.int64)
    head = np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1])])
    i = np.flatnonzero(head)
    first, last, anchor, d = start[i], start[np.append(i[1:], len(start)) - 1], at[i], doc[i]
    lo, hi = first - anchor, last - anchor
    total = byte_hash(data)
    body = tc.mix(span_hash(total, first, last + length) + (lo + 200).astype(np.uint64) * tc.GRAM[30])
    return g[anchor], body, d, anchor - offs[d], lo, hi


def segments(column: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Chunks, and for very long documents pieces that overlap by length - 1 bytes: (first row, bytes, offsets, shift)."""
    for lo, data, offs in tc.chunks(column):
        if len(data) <= SEGMENT:
            yield lo, data, offs, 0
        else:
            for a in range(0, len(data) - length + 1, SEGMENT):
                part = data[a : a + SEGMENT + length - 1]
                yield lo, part, np.array([0, len(part)]), a


def _pack(rows: list[tuple], buckets: int, covered: list) -> Iterator[pa.RecordBatch]:
    """Messages per bucket: equal runs within the message leave their earliest, the others are covered at once."""
    h, body, doc, pos, lo, hi = (np.concatenate(x) for x in zip(*rows))
    order = np.lexsort((pos, doc, body, h))
    h, body, doc, pos, lo, hi = (x[order] for x in (h, body, doc, pos, lo, hi))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (body[1:] == body[:-1])
    covered.append((doc[again], (pos + lo)[again], (pos + hi)[again]))
    keep = ~again
    h, body, doc, pos, lo, hi = (x[keep] for x in (h, body, doc, pos, lo, hi))
    bucket = (tc.mix(h) % tc.U(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[by], np.arange(buckets + 1))
    cols: list[list] = [[] for _ in range(7)]
    for b in np.flatnonzero(np.diff(at)):
        m = by[at[b] : at[b + 1]]
        own, local = np.unique(doc[m], return_inverse=True)
        for c, v in zip(cols, (int(b), h[m].tobytes(), body[m].tobytes(), own.tobytes(), local.astype(np.uint32).tobytes(), pos[m].astype(np.uint32).tobytes(), np.stack([lo[m], hi[m]]).astype(np.int8).tobytes())):
            c.append(v)
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:]), pa.nulls(len(cols[0]), pa.int64()), pa.nulls(len(cols[0]), pa.binary())], MESSAGE_NAMES)


MESSAGE_NAMES = ["bucket", "h", "body", "ids", "doc", "pos", "span", "doc_id", "starts"]
MESSAGE = "bucket int, h binary, body binary, ids binary, doc binary, pos binary, span binary, doc_id bigint, starts binary"


def _span_rows(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Per document its merged runs of starts, packed."""
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    if not len(doc):
        return [], []
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (a[1:] > b[:-1] + 1)])
    i = np.flatnonzero(new)
    doc, a, b = doc[i], a[i], b[np.append(i[1:], len(b)) - 1]
    heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    ends = np.append(heads[1:], len(doc))
    return doc[heads].tolist(), [np.stack([a[x:y], b[x:y]]).astype(np.int64).tobytes() for x, y in zip(heads, ends)]


def _messages(buckets: int, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, covered = [], 0, []

        def done() -> Iterator[pa.RecordBatch]:
            yield from _pack(rows, buckets, covered)
            ids, packed = _span_rows(*(np.concatenate(x) for x in zip(*covered)))
            covered.clear()
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.binary()) for _ in range(6)), pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], MESSAGE_NAMES)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, data, offs, shift in segments(batch.column(1), length):
                h, body, d, pos, a, b = runs(data, offs, length, gram)
                rows.append((h, body, ids[lo + d], pos + shift, a, b))
                size += len(h)
                if size > MESSAGE_RUNS:
                    yield from done()
                    rows, size = [], 0
        if size:
            yield from done()

    return run


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket of anchors -> (doc_id, starts, open): covered starts, and runs whose anchor has unlike runs."""
    parts = []
    for batch in batches:
        parts += list(zip(*(batch.column(i).to_pylist() for i in range(1, 7))))
    if not parts:
        return
    h = np.concatenate([np.frombuffer(p[0], np.uint64) for p in parts])
    body = np.concatenate([np.frombuffer(p[1], np.uint64) for p in parts])
    doc = np.concatenate([np.frombuffer(p[2], np.int64)[np.frombuffer(p[3], np.uint32)] for p in parts])
    pos = np.concatenate([np.frombuffer(p[4], np.uint32) for p in parts]).astype(np.int64)
    lo, hi = np.concatenate([np.frombuffer(p[5], np.int8).reshape(2, -1) for p in parts], axis=1).astype(np.int64)
    parts.clear()
    order = np.argsort(h, kind="stable")
    hs = h[order]
    multi = np.zeros(len(hs), bool)
    multi[1:] = hs[1:] == hs[:-1]
    multi[:-1] |= multi[1:]
    order = order[multi]
    h, body, doc, pos, lo, hi = (x[order] for x in (h, body, doc, pos, lo, hi))
    order = np.lexsort((pos, doc, body, h))
    h, body, doc, pos, lo, hi = (x[order] for x in (h, body, doc, pos, lo, hi))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (body[1:] == body[:-1])
    ids, packed = _span_rows(doc[again], (pos + lo)[again], (pos + hi)[again])
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.nulls(len(ids), pa.binary())], ["doc_id", "starts", "open"])
    h, doc, pos, lo, hi = (x[~again] for x in (h, doc, pos, lo, hi))
    unlike = np.zeros(len(h), bool)
    unlike[1:] = h[1:] == h[:-1]
    unlike[:-1] |= unlike[1:]
    h, doc, pos, lo, hi = (x[unlike] for x in (h, doc, pos, lo, hi))
    hot = np.unique(h, return_counts=True)[1].repeat(np.unique(h, return_counts=True)[1]) > HOT_RUNS  # h is sorted
    order = np.argsort(doc, kind="stable")
    h, doc, pos, lo, hi, hot = (x[order] for x in (h, doc, pos, lo, hi, hot))
    heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, int)
    ends = np.append(heads[1:], len(doc))
    rows = [np.stack([tc.signed(h[x:y]), pos[x:y], lo[x:y], hi[x:y], hot[x:y]]).tobytes() for x, y in zip(heads, ends)]
    yield pa.RecordBatch.from_arrays([pa.array(doc[heads], pa.int64()), pa.nulls(len(rows), pa.binary()), pa.array(rows, pa.binary())], ["doc_id", "starts", "open"])


def core_key(anchor: int, part: int, core: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(core, digest_size=8, key=f"{anchor}/{part}".encode()).digest(), "little", signed=True)


def _contexts(length: int):
    """(doc_id, text, opens) -> the bytes of each open run, by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1).cast(pa.large_binary())
            for k, opens in enumerate(batch.column(2).to_pylist()):
                text = col[k].as_py() or b""
                h, pos, lo, hi, hot = np.concatenate([np.frombuffer(o, np.int64).reshape(5, -1) for o in opens], axis=1)
                d = batch.column(0)[k].as_py()
                rows = []
                for key, at, x, y, much in zip(h.tolist(), pos.tolist(), lo.tolist(), hi.tolist(), hot.tolist()):
                    # equal strings start equally far from their anchors: a hot anchor's runs are cut at the same
                    # distances, and a part goes by the bytes that all strings which start in it contain
                    for q in range(x // STEP, y // STEP + 1) if much else (None,):
                        i, j = (x, y) if q is None else (max(x, q * STEP), min(y, q * STEP + STEP - 1))
                        to = key if q is None else core_key(key, q, text[at + q * STEP + STEP - 1 : at + q * STEP + length])
                        rows.append((to, d, at + i, j - i + 1, text[at + i : at + j + length]))
                cols = list(zip(*rows)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["h", "doc_id", "start", "n", "bytes"])

    return run


def sort_shard(doc: np.ndarray, start: np.ndarray, count: np.ndarray, pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of strings of `length` bytes in the pieces that also start earlier, by suffix and LCP arrays."""
    size = np.array([len(p) + 1 for p in pieces])
    text = np.zeros(int(size.sum()), np.int64)  # 0 ends a piece
    first = np.cumsum(size) - size
    flat = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int64) + 1
    flat[first + size - 1] = 0
    text[:] = flat
    order, lcp = suffix_array(text, 257)
    own = np.repeat(np.arange(len(pieces)), size)[order]
    off = order - first[own]
    group = np.cumsum(lcp < length)
    valid = off < count[own]
    own, off, group = own[valid], off[valid], group[valid]
    d, s = doc[own], start[own] + off
    by = np.lexsort((s, d, group))
    later = np.zeros(len(by), bool)
    later[1:] = group[by][1:] == group[by][:-1]
    return d[by][later], s[by][later]


def _shards(length: int, most: int):
    """Sorted rows (h, doc_id, start, n, bytes) of a partition -> covered starts; anchors are never split over sorts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        copies: list[tuple] = []
        seen: set[bytes] = set()
        size, last = 0, None

        def done() -> pa.RecordBatch:
            doc, start, n, pieces = (list(x) for x in zip(*held))
            d, s = sort_shard(np.array(doc), np.array(start), np.array(n), pieces, length)
            more = np.array(copies, np.int64).reshape(-1, 3).T
            copies.clear()
            ids, packed = _span_rows(np.concatenate([d, more[0]]), np.concatenate([s, more[1]]), np.concatenate([s, more[2]]))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "starts"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > most and row[0] != last:
                    yield done()
                    held, size = [], 0
                seen = seen if row[0] == last else set()
                last = row[0]
                if row[4] in seen:  # rows come earliest first: an equal piece starts earlier throughout
                    copies.append((row[1], row[2], row[2] + row[3] - 1))
                    continue
                seen.add(row[4])
                held.append(row[1:])
                size += len(row[4])
        if held:
            yield done()

    return run


def merged(packed: list[bytes], length: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Removed byte runs [a, b) from packed runs of starts."""
    if not packed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate([np.frombuffer(p, np.int64).reshape(2, -1) for p in packed], axis=1)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order] + length)
    new = np.concatenate([[True], a[1:] > b[:-1]])
    i = np.flatnonzero(new)
    return a[i], b[np.append(i[1:], len(b)) - 1]


def removals(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, packed runs of covered starts: any number of rows a document."""
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(partitions(spark), total // BUCKET_BYTES)
    sent = docs.filter(F.octet_length("text") >= length).mapInArrow(_messages(buckets, length, gram), MESSAGE)
    sent = sent.withColumn("to", F.coalesce("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")))
    met = sent.repartitionById(buckets, F.col("to")).drop("to").mapInArrow(_split_messages, "doc_id bigint, starts binary, open binary")
    met = cut_lineage(met)
    opens = met.filter("open is not null").groupBy("doc_id").agg(F.collect_list("open").alias("opens"))  # at most a document's own runs
    pieces = docs.select("doc_id", "text").join(opens, "doc_id").mapInArrow(_contexts(length), "h bigint, doc_id bigint, start bigint, n int, bytes binary")
    dealt = pieces.repartition(buckets, "h").sortWithinPartitions("h", "doc_id", "start")
    found = dealt.mapInArrow(_shards(length, SHARD_BYTES), "doc_id bigint, starts binary")
    return met.filter("starts is not null").select("doc_id", "starts").unionByName(found)


def _split_messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass covered starts on, gather anchors."""
    held = []
    for batch in batches:
        mask = batch.column(7).is_valid()
        done = batch.filter(mask)
        yield pa.RecordBatch.from_arrays([done.column(7), done.column(8), pa.nulls(done.num_rows, pa.binary())], ["doc_id", "starts", "open"])
        held.append(batch.filter(batch.column(7).is_null()))
    yield from _match(iter(held))


def _cut(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1).cast(pa.large_binary())
            rows = []
            for k, packed in enumerate(batch.column(2).to_pylist()):
                text = col[k].as_py() or b""
                a, b = merged(packed or [], length, len(text))
                kept, at = [], 0
                for x, y in zip(a.tolist(), b.tolist()):
                    kept.append(text[at:x])
                    at = y
                rest = b"".join([*kept, text[at:]]) if kept else text
                rows.append((batch.column(0)[k].as_py(), len(text), len(text) - len(rest), len(a), hashlib.sha256(rest).hexdigest(), *((rest, rest.decode("utf-8", "ignore")) if with_text else ())))
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
            n = 7 if with_text else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:n], kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"][:n])

    return run


@frees_shuffles
def dedup(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, kept (bytes) and kept_text (without the
    bytes of characters that a cut has split): every whole text without the
    bytes covered by a `length`-byte string that also starts earlier (smaller doc_id, or the same and further left).

    Strings are judged on the input. Null and empty texts have nothing removed; texts below `length` bytes neither.
    doc_id identifies a document: rows that repeat one are distinct inputs only if their ids differ, so repeated
    rows of an id keep the strings of one of them alike. A null doc_id is never compared. An empty table gives an
    empty result; further columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = removals(base.filter("doc_id is not null"), length=length, gram=gram).groupBy("doc_id").agg(F.collect_list("starts").alias("packed"))  # a document's own
    joined = base.join(spans, "doc_id", "left").select("doc_id", "text", "packed")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary, kept_text string" if with_text else "")
    return joined.mapInArrow(_cut(length, with_text), schema)
