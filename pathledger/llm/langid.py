"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathledger.llm import textcore as tc

BITS = 15
ORDERS = (1, 2, 3)
SCALE = 20.0
FIT_DOCUMENTS = 2000
FIT_BYTES = 1 << 16
BLOCK_DOCS = 256
NO_LANGUAGE = "und"

_tables: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """(lower-case form, is a letter) by code point; made once a process."""
    if not _tables:
        low = np.arange(0x110000, dtype=np.uint32)
        letter = np.zeros(0x110000, bool)
        for i in range(0x110000):
            if not 0xD800 <= i < 0xE000:
                c = chr(i)
                letter[i] = c.isalpha()
                if letter[i] and len(c.lower()) == 1:
                    low[i] = ord(c.lower())
        _tables.extend([low, letter])
    return _tables[0], _tables[1]


def gram_buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, document) of every n-gram of letters and word ends, and whether a document has a letter."""
    low, letter = tables()
    docs = len(offs) - 1
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    is_start = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(is_start)])[offs]
    if at[-1] != len(code):  # malformed bytes were replaced: go document by document
        parts = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offs[:-1], offs[1:])]
        code, at = np.concatenate(parts) if parts else code[:0], np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    doc = np.repeat(np.arange(docs), np.diff(at))
    is_letter = letter[code]
    any_letter = np.bincount(doc, weights=is_letter, minlength=docs) > 0
    c = np.where(is_letter, low[code], 32).astype(np.uint64)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (doc[1:] != doc[:-1])
    c, doc = c[keep], doc[keep]
    buckets, owner = [], []
    for n in ORDERS:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint64)
        for i in range(n):
            h += c[i : len(c) - n + 1 + i] * tc.GRAM[i]
        ok = doc[: len(h)] == doc[n - 1 :]
        buckets.append((tc.mix(h[ok]) >> tc.U(64 - BITS)).astype(np.int64))
        owner.append(doc[: len(ok)][ok])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), any_letter
    return np.concatenate(buckets), np.concatenate(owner), any_letter


def histogram(data: np.ndarray, piece: int = tc.CHUNK) -> tuple[np.ndarray, bool]:
    """(how often each bucket's grams occur, whether there is a letter) in one text, piece by piece: memory follows the piece.

    The grams are those of gram_buckets(): the last characters of a piece are carried into the next.
    """
    low, letter = tables()
    total, some, at = np.zeros(1 << BITS, np.int64), False, 0
    carry = np.zeros(0, np.uint64)
    while at < len(data):
        end = min(len(data), at + piece)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        code = np.frombuffer(data[at:end].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        is_letter = letter[code]
        some = some or bool(is_letter.any())
        c = np.concatenate([carry, np.where(is_letter, low[code], 32).astype(np.uint64)])
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
        c = c[keep]
        for n in ORDERS:
            first = max(0, len(carry) - n + 1)
            if len(c) - first < n:
                continue
            h = np.full(len(c) - first - n + 1, n, np.uint64)
            for i in range(n):
                h += c[first + i : len(c) - n + 1 + i] * tc.GRAM[i]
            total += np.bincount((tc.mix(h) >> tc.U(64 - BITS)).astype(np.int64), minlength=1 << BITS)
        carry, at = c[len(c) - min(len(c), max(ORDERS) - 1) :], end
    return total, some


def blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks of at most BLOCK_DOCS documents."""
    for lo, data, offs in tc.chunks(column):
        for k in range(0, len(offs) - 1, BLOCK_DOCS):
            o = offs[k : k + BLOCK_DOCS + 1]
            yield lo + k, data[o[0] : o[-1]], o - o[0]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages, sparse by the l1 penalty
    bias: np.ndarray
    temperature: float = 1.0

    @functools.cached_property
    def table(self) -> np.ndarray:
        return self.weights * self.idf[:, None] * SCALE

    def logits_of(self, counts: np.ndarray) -> np.ndarray:
        """logits() of one text from its histogram."""
        return (counts @ self.table)[None] / max(1, int(counts.sum())) + self.bias

    def logits(self, bucket: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
        """x_b = SCALE * tf_b / n * idf_b is linear in occurrences: a gather and one sum per document."""
        n = np.maximum(np.bincount(owner, minlength=docs), 1)
        return np.stack([np.bincount(owner, weights=self.table[:, k][bucket], minlength=docs) / n for k in range(len(self.languages))], axis=1) + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, *, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader, proximal form, with l1 and l2 penalties; the bias is free of them."""
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))
    zb, nb = np.zeros(classes), np.zeros(classes)

    def weights(zz: np.ndarray, nn: np.ndarray, one: float, two: float) -> np.ndarray:
        w = -(zz - np.sign(zz) * one) / ((beta + np.sqrt(nn)) / alpha + two)
        return np.where(np.abs(zz) <= one, 0.0, w)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            b, v = rows[i]
            w, wb = weights(z[b], n[b], l1, l2), weights(zb, nb, 0.0, l2)
            g = softmax(v @ w + wb)
            g[y[i]] -= 1
            grad = v[:, None] * g[None, :]
            z[b] += grad - (np.sqrt(n[b] + grad * grad) - np.sqrt(n[b])) / alpha * w
            n[b] += grad * grad
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * wb
            nb += g * g
    return weights(z, n, l1, l2), weights(zb, nb, 0.0, l2)


def train(docs: DataFrame, *, most: int = FIT_DOCUMENTS, most_bytes: int = FIT_BYTES) -> Model:
    """Document frequencies count all training rows; weights come from at most `most` of them, of at most
    `most_bytes` bytes, the first by a hash of doc_id. A fifth of those is kept for the temperature.

    Training rows have a language and a doc_id whose crc32 modulo 5 isn't 0.
    """
    mine = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    mine = mine.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for _, data, offs in blocks(batch.column(0)):
                rows += len(offs) - 1
                if len(data) > tc.CHUNK:  # one text
                    df += histogram(data)[0] > 0
                    continue
                bucket, owner, _ = gram_buckets(data, offs)
                seen = np.zeros((len(offs) - 1) << BITS, bool)
                seen[(owner << BITS) | bucket] = True
                df += seen.reshape(len(offs) - 1, -1).sum(axis=0)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], rows))], ["bucket", "n"])

    found = mine.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 2**BITS + 1 rows
    counts = dict(zip(found.bucket, found.n))
    total = counts.pop(-1, 0)
    df = np.zeros(1 << BITS)
    df[list(counts)] = list(counts.values())
    idf = np.log((1 + total) / (1 + df)) + 1

    lots = mine.filter(F.octet_length("text") <= most_bytes).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = mine.join(F.broadcast(lots), "doc_id", "left_semi")  # at most `most` ids

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offs in blocks(batch.column(2)):
                bucket, owner, _ = gram_buckets(data, offs)
                pair, tf = np.unique((owner << BITS) | bucket, return_counts=True)
                at = np.searchsorted(pair >> BITS, np.arange(len(offs)))
                b = (pair & ((1 << BITS) - 1)).astype(np.int32)
                flat = [b[x:y].tobytes() for x, y in zip(at[:-1], at[1:])]
                flat2 = [tf[x:y].astype(np.int32).tobytes() for x, y in zip(at[:-1], at[1:])]
                rows = len(offs) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), batch.column(1).slice(lo, rows), pa.array(flat, pa.binary()), pa.array(flat2, pa.binary())], ["doc_id", "lang", "b", "tf"])

    got = chosen.select("doc_id", "lang", "text").mapInArrow(vectors, "doc_id bigint, lang string, b binary, tf binary").toPandas()
    got = got.sort_values(["doc_id", "lang", "b"]).drop_duplicates("doc_id").reset_index(drop=True)
    languages = sorted(set(got.lang))
    if not languages:
        return Model([], idf, np.zeros((1 << BITS, 0)), np.zeros(0))
    rows = []
    for b, tf in zip(got.b, got.tf):
        at, n = np.frombuffer(b, np.int32), np.frombuffer(tf, np.int32)
        rows.append((at, SCALE * n / max(1, n.sum()) * idf[at]))
    y = np.array([languages.index(x) for x in got.lang])
    kept = np.arange(len(rows)) % 5 == 4
    w, bias = ftrl([r for r, k in zip(rows, kept) if not k], y[~kept], len(languages))
    model = Model(languages, idf, w, bias)
    if kept.any():
        z = np.stack([v @ w[b] + bias for (b, v), k in zip(rows, kept) if k])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(z)), y[kept]], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, from the text alone.

    A null text or one without a letter is `und` with score 0, as is every text if nothing was learnt. Repeated
    rows get equal results; an empty table gives an empty result; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo, data, offs in blocks(batch.column(1)):
                rows = len(offs) - 1
                if len(data) > tc.CHUNK:  # one text
                    counts, any_letter = histogram(data)
                    z, some = m.logits_of(counts), np.array([any_letter])
                else:
                    bucket, owner, some = gram_buckets(data, offs)
                    z = m.logits(bucket, owner, rows)
                if m.languages:
                    p = softmax(z / m.temperature)
                    best, score = [m.languages[k] for k in p.argmax(axis=1)], p.max(axis=1)
                else:
                    best, score, some = [NO_LANGUAGE] * rows, np.zeros(rows), np.zeros(rows, bool)
                lang = [x if ok else NO_LANGUAGE for x, ok in zip(best, some)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), pa.array(lang, pa.string()), pa.array(np.where(some, score, 0.0))], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame) -> DataFrame:
    """predict() by the model that train() learns from docs: doc_id, held_out, lang_pred, score for every row.

    Null texts and those without a letter are `und`; rows of a null doc_id or lang aren't learnt from; repeated rows get equal
    results, and an empty table gives an empty result.
    """
    return predict(docs, train(docs))
