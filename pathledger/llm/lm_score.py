"""Stupid-backoff scores: n-gram count tables partitioned by hash, joined to exploded n-grams, summed per document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathledger.llm import textcore as tc
from pathledger.llm.common import cut_lineage, frees_shuffles, partitions

ORDER = 3
BACKOFF = 0.4
MESSAGE_WORDS = 1_000_000
BUCKET_WORDS = 4_000_000
#: Stand-in for the hash of the symbol before a text's first word.
START = tc.U(0x5354415254)
ROW = "message bigint, n int, bucket int, keys binary, counts binary, ids binary, nulls binary, n_words binary, words binary, places binary"
#: In column n: the row tells what a message's documents are; else it is the order of the n-grams in the row.
TEXT = 0


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, and texts that have any."""
    for batch in batches:
        n = full = 0
        for _, data, offs in tc.chunks(batch.column(0)):
            doc = tc.words(data, offs)[1]
            n, full = n + len(doc), full + len(np.unique(doc))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([full], pa.int64())], ["n", "texts"])


def _pack(a: np.ndarray) -> bytes:
    """The numbers' bytes by significance, so that equal high bytes stand together, compressed after their length."""
    raw = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unpack(b: bytes, kind: type) -> np.ndarray:
    size, raw = np.dtype(kind).itemsize, pa.Codec("zstd").decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _rows(rows: list[dict]) -> pa.RecordBatch:
    fields = [x.split() for x in ROW.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], [n for n, _ in fields])


def ngrams(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n-gram that ends with each word; before a text's first word stand start symbols."""
    out, past = words * tc.GRAM[0], np.zeros(len(words), np.int64)
    start = np.maximum.accumulate(np.where(first, np.arange(len(words)), 0))
    place = np.arange(len(words))
    for k in range(1, n):
        past = place - k
        out = out + np.where(past >= start, words[np.maximum(past, 0)], START) * tc.GRAM[k]
    return tc.mix(out + tc.U(n))


def _firsts(n_words: np.ndarray) -> np.ndarray:
    first = np.zeros(int(n_words.sum()), bool)
    full = n_words[n_words > 0].astype(np.int64)
    first[np.cumsum(full) - full] = True
    return first


def _explode(order: int, buckets: int, texts: bool):
    """Messages of whole texts. Either the row that holds their words, in order, or their distinct n-grams with counts,
    dealt by ranges of the hash. Both runs cut the same messages and give them the same name."""

    def message(ids: list[pa.Array], words: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        w, n_words = np.concatenate(words), np.concatenate(counts).astype(np.uint32)
        known = pa.concat_arrays(ids)
        number, null = known.fill_null(0).to_numpy(), known.is_null().to_numpy(zero_copy_only=False)
        digest = hashlib.blake2b(w.tobytes(), digest_size=8)
        for a in (n_words, number, null):
            digest.update(a.tobytes())
        own = int.from_bytes(digest.digest(), "little", signed=True)
        if texts:
            word, place = np.unique(w, return_inverse=True)
            yield _rows([{"message": own, "n": TEXT, "ids": number.tobytes(), "nulls": null.tobytes(), "n_words": _pack(n_words), "words": _pack(np.diff(word, prepend=tc.U(0))), "places": _pack(place.astype(np.uint32))}])
            return
        first = _firsts(n_words)
        for n in range(1, order + 1):
            key, count = np.unique(ngrams(w, first, n), return_counts=True)
            bucket = ((key >> tc.U(32)) * tc.U(buckets) >> tc.U(32)).astype(np.int64)  # ascends with the keys
            at = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(at)):
                mine = slice(at[b], at[b + 1])
                rows.append({"message": own, "n": n, "bucket": int(b), "keys": _pack(np.diff(key[mine], prepend=tc.U(0))), "counts": _pack(count[mine].astype(np.uint32))})
            yield _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, counts, size = [], [], [], 0
        for batch in batches:
            for lo, data, offs in tc.chunks(batch.column(1)):
                h, doc, _, _ = tc.words(data, offs)
                ids.append(batch.column(0).slice(lo, len(offs) - 1))
                words.append(h)
                counts.append(np.bincount(doc, minlength=len(offs) - 1))
                size += len(h)
                if size > MESSAGE_WORDS:
                    yield from message(ids, words, counts)
                    ids, words, counts, size = [], [], [], 0
        if size:
            yield from message(ids, words, counts)

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket of the count tables: sums the messages' counts and answers each with the corpus's, in the same order."""
    parts: list[tuple] = []
    for batch in batches:
        parts += list(zip(*(batch.column(i).to_pylist() for i in range(5))))
    for n in sorted({p[1] for p in parts}):
        mine = [p for p in parts if p[1] == n]
        keys = [np.cumsum(_unpack(p[3], np.uint64), dtype=np.uint64) for p in mine]
        every = np.concatenate(keys)
        order = np.argsort(every)
        new = np.diff(every[order], prepend=~every[order[:1]]) != 0
        group = np.cumsum(new) - 1
        count = np.bincount(group, weights=np.concatenate([_unpack(p[4], np.uint32) for p in mine])[order].astype(np.float64))  # exact up to 2**53
        total = np.empty(len(every), np.uint64)
        total[order] = count.astype(np.uint64)[group]
        at = 0
        for p, k in zip(mine, keys):
            yield _rows([{"message": p[0], "n": n, "bucket": p[2], "counts": _pack(total[at : at + len(k)])}])
            at += len(k)


def _score(order: int, total: int, full: int, backoff: float, leave_out: bool):
    """Sorted rows of messages -> one row per document of each message."""

    def done(texts: list[dict], counts: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
        t = texts[0]  # further ones are equal messages: the same rows of the table once more
        n_words = _unpack(t["n_words"], np.uint32).astype(np.int64)
        w, first = np.cumsum(_unpack(t["words"], np.uint64), dtype=np.uint64)[_unpack(t["places"], np.uint32)], _firsts(n_words)
        doc = np.repeat(np.arange(len(n_words), dtype=np.int32), n_words)
        ctx, ctx_own = np.full(len(w), float(total)), n_words[doc].astype(np.float64)
        value, level = np.zeros(len(w)), np.zeros(len(w), np.int8)
        for n in range(1, order + 1):
            gram = ngrams(w, first, n)
            by = np.argsort(gram, kind="stable")  # documents ascend within each
            new = np.diff(gram[by], prepend=~gram[by[:1]]) != 0
            group = np.cumsum(new, dtype=np.int32) - 1
            have, own = np.empty(len(w)), np.zeros(len(w))
            have[by] = np.concatenate(counts[n]).astype(np.float64)[group]
            if leave_out:
                use = new.copy()
                use[1:] |= np.diff(doc[by]) != 0
                at = np.flatnonzero(use)
                own[by] = np.repeat(np.diff(at, append=len(by)), np.diff(at, append=len(by)))
            else:
                ctx_own = np.zeros(len(w))
            rest = have - own
            seen = rest > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                here = np.log(np.maximum(rest, 1.0) if n == 1 else rest) - np.log(np.maximum(ctx - ctx_own, 1.0))
            use = seen if n > 1 else np.ones(len(w), bool)
            value[use], level[use] = here[use], n
            # what precedes the next word: this order's n-gram of the word before; the start symbols at a text's begin
            ctx, ctx_own = np.roll(have, 1), np.roll(own, 1)
            ctx[first], ctx_own[first] = full, 1
        value += (order - level) * np.log(backoff)
        sums = [np.bincount(doc, weights=x, minlength=len(n_words)) * len(texts) for x in (value, level < order)]
        ids, null = np.frombuffer(t["ids"], np.int64), np.frombuffer(t["nulls"], bool)
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(sums[0]), pa.array(n_words * len(texts)), pa.array(sums[1].astype(np.int64))], ["doc_id", "log_score", "n_words", "backoffs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, counts = None, [], {}
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}
                if r["message"] != now and texts:
                    yield done(texts, {n: list(c.values()) for n, c in counts.items()})
                    texts, counts = [], {}
                now = r["message"]
                if r["n"] == TEXT:
                    texts.append(r)
                else:
                    counts.setdefault(r["n"], {})[r["bucket"]] = _unpack(r["counts"], np.uint64)
        if texts:
            yield done(texts, {n: list(c.values()) for n, c in counts.items()})

    return run


@frees_shuffles
def stupid_backoff(docs: DataFrame, *, order: int = ORDER, backoff: float = BACKOFF, leave_out: bool = True) -> DataFrame:
    """doc_id, n_words, log_score, backoffs, mean_score: one row per doc_id.

    Words are split at ASCII white space, A-Z lower-cased; all of them and all n-grams up to `order` have counts. A
    word scores count(n-gram) / count(its first n - 1 words) for the longest n-gram that is counted, times `backoff` for each
    order less than `order`; start symbols precede a text's first word. With `leave_out` a text is scored by all other
    texts: its own n-grams are taken off the counts (over the whole corpus nothing would ever back off), and a word that no other text has
    counts as 1. log_score is the sum of natural logarithms, mean_score that over n_words, backoffs the words scored
    below the full order.

    Null, empty and blank texts have n_words 0, log_score 0 and a null mean. Rows that share a doc_id add up, each one
    a text of its own. An empty table gives an empty result; further columns are ignored.

    Words and n-grams are 64-bit hashes. A message of whole texts sends each distinct n-gram once, with its count, to its
    hash range of the count table, which answers with the corpus's count; so the commonest n-gram weighs no more than a
    number per message, and no count table reaches the driver.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total, full = base.select("text").mapInArrow(_tally, "n bigint, texts bigint").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0))).first()
    buckets = max(partitions(spark), total // BUCKET_WORDS)
    counted = cut_lineage(base.mapInArrow(_explode(order, buckets, False), ROW).repartitionById(buckets, F.col("bucket")).mapInArrow(_total, ROW))
    texts = base.mapInArrow(_explode(order, buckets, True), ROW)
    ordered = counted.unionByName(texts).repartition(partitions(spark), "message").sortWithinPartitions("message", "n", "bucket")
    scored = ordered.mapInArrow(_score(order, total, full, backoff, leave_out), "doc_id bigint, log_score double, n_words bigint, backoffs bigint")
    none = base.select("doc_id", F.lit(0.0).alias("log_score"), F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("backoffs"))
    out = scored.unionByName(none).groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("log_score").alias("log_score"), F.sum("backoffs").alias("backoffs"))
    return out.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
