"""Benchmark decontamination by spaced seeds, verified along diagonals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathledger.llm import textcore as tc

#: Masks over token positions: 1 takes part in the hash, 0 may hold any token. Each run of 13 to 25 words with a fifth
#: substituted, wherever, has a place for one of them, and a longer run has a part of 13 to 25 words with a fifth at most.
MASKS = ("111111", "1101100101", "1011001011", "110100110011", "110110101")
#: The same for items of so many words, of which all but a fifth must stand there.
SHORT_MASKS = {
    5: ("1111", "11101", "11011", "10111"),
    6: ("1111", "11011"),
    7: ("11111", "111011", "110111"),
    8: ("111111", "1111011", "1101111"),
    9: ("1111011", "1101111"),
    10: ("111011", "11010011", "11111"),
    11: ("1101011", "1110011"),
    12: ("11101011", "101100111", "111111"),
}
LEAST_WORDS = 13
SIMILARITY = 0.8
BLOCK_BYTES = 8 << 20
SCHEMA = "doc_id bigint, item_id bigint, contaminated boolean, item_words int, matched int, span_words int, first_word int, similarity double"


def spaced(h: np.ndarray, doc: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) for each place where the mask fits into a document."""
    span, n = len(mask), len(h) - len(mask) + 1
    if n <= 0:
        return h[:0], np.zeros(0, np.int64)
    out = np.full(n, salt, np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out += h[i : n + i] * tc.GRAM[i]
    at = np.flatnonzero(doc[:n] == doc[span - 1 :])
    return tc.mix(out[at]), at


def hundredths(similarity: float) -> int:
    if abs(similarity * 100 - round(similarity * 100)) > 1e-9:
        raise ValueError("similarity must be a number of hundredths")
    return round(similarity * 100)


def best_segment(same: np.ndarray, similarity: float, least: int) -> tuple[int, int, int] | None:
    """(start, end, matches) of the run of a diagonal with most matches, of these the longest and then the first, among
    the runs of `least` words or more whose share of matches is `similarity` at least; None without any.

    Score +1 a match and -s/(1-s) a mismatch: a run has a score of zero or more iff its share is s or more.
    """
    # exact integer weights: similarity is a fraction in hundredths
    p = hundredths(similarity)
    score = np.where(same, 100 - p, -p).cumsum()
    prefix = np.concatenate([[0], score])
    hits = np.concatenate([[0], same.cumsum()])
    lo = np.minimum.accumulate(prefix)  # earliest start whose prefix is at most prefix[end]
    starts = np.searchsorted(-lo, -prefix, "left")
    got = hits - hits[starts]
    long = np.arange(len(prefix)) - starts
    order = np.where(long >= least, got * len(prefix) + long, -1)
    end = int(np.argmax(order))
    return (int(starts[end]), end, int(got[end])) if order[end] >= 0 else None


def allowed(n: int, similarity: float) -> int:
    """Substitutions that a run of n words may have."""
    return n - -(-hundredths(similarity) * n // 100)


def masks_for(n: int, least: int, similarity: float, masks: tuple[str, ...] = MASKS) -> tuple[str, ...]:
    """Masks of which one at least fits into every run that counts on an item of n words.

    A run of twice the least length has a half that counts, so only shorter ones matter. Where no masks are given for
    the length and similarity, it is the stretch that some run must have between its substitutions.
    """
    short = min(least, n)
    if similarity >= SIMILARITY and short >= LEAST_WORDS:
        return masks
    if similarity >= SIMILARITY and short == n and n in SHORT_MASKS:
        return SHORT_MASKS[n]
    runs = range(max(short, 1), min(n, 2 * short - 1) + 1)
    return ("1" * min((-(-(m - allowed(m, similarity)) // (allowed(m, similarity) + 1)) for m in runs), default=1),)


class Index:
    """Seeds and word hashes of a bounded block of benchmark items."""

    def __init__(self, items: list[tuple[int, str | None]], masks: tuple[str, ...] = MASKS, least: int = LEAST_WORDS, similarity: float = SIMILARITY):
        self.ids, seeds, used = [], [], set()
        self.words: list[np.ndarray] = []
        for item, text in items:
            data = np.frombuffer((text or "").encode(), np.uint8)
            h, doc, _, _ = tc.words(data, np.array([0, len(data)]), tc.ALNUM)
            k = len(self.ids)
            self.ids.append(item)
            self.words.append(h)
            for mask in masks_for(len(h), least, similarity, masks) if len(h) else ():
                used.add(mask)
                seeds += [(s, k, p) for s, p in zip(*map(list, spaced(h, doc, mask, int("1" + mask, 2))))]
        self.masks = sorted(used)
        seeds.sort()
        self.seed = np.array([x[0] for x in seeds], np.uint64)
        self.item = np.array([x[1] for x in seeds], np.int64)
        self.pos = np.array([x[2] for x in seeds], np.int64)

    def hits(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (item, diagonal start in words) of all seed hits."""
        items, starts = [], []
        small = np.zeros(1 << 16, bool)
        small[(self.seed >> tc.U(48)).astype(np.int64)] = True
        for mask in self.masks:
            s, at = spaced(h, doc, mask, int("1" + mask, 2))
            maybe = small[(s >> tc.U(48)).astype(np.int64)]
            s, at = s[maybe], at[maybe]
            lo, hi = np.searchsorted(self.seed, s, "left"), np.searchsorted(self.seed, s, "right")
            n = hi - lo
            some = n > 0
            if some.any():
                n = n[some]
                k = np.repeat(lo[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                items.append(self.item[k])
                starts.append(np.repeat(at[some], n) - self.pos[k] + (doc[np.repeat(at[some], n)] << 40))
        if not items:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(items), np.concatenate(starts)]), axis=1)
        return pairs[0], pairs[1]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, masks: tuple[str, ...] = MASKS, least: int = LEAST_WORDS, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each (document, item) that share a passage: on one diagonal a run of at least min(`least`, the
    item's words) words of which a share of `similarity` or more are equal and in place.

    Words are runs of letters, digits and bytes above ASCII, A-Z lower-cased. Spaced seeds ignore the positions
    that a mask leaves out, and every run that counts has a place for one of the masks, so substituted words don't hide a
    passage; other `masks` may lose some. An item of one word marks every document that holds it. Null and empty texts match nothing; repeated
    rows of a document or item give one row (the best run); other columns are ignored; an empty table gives none.

    The benchmark is a stated query set: it is held in blocks of at most `block_bytes` of text, each broadcast with
    that bound (a longer item is an error) and run against all rows, so a larger benchmark means more passes and never a larger broadcast.
    """
    sized = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    total, longest = sized.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.max(F.octet_length("text")), F.lit(0))).first()
    if longest > max(block_bytes, BLOCK_BYTES):
        raise ValueError(f"a benchmark item of {longest} bytes is larger than a block")
    count = max(1, -(-2 * total // block_bytes))
    out = None
    for b in range(count):
        part = sized if count == 1 else sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b)
        items = sorted({(r.item_id, r.text) for r in part.toLocalIterator() if r.text and r.item_id is not None})
        one = _scan(docs, Index(items, masks, least, similarity), least, similarity)
        out = one if out is None else out.unionByName(one)
    cols = [c for c in out.columns if c not in ("doc_id", "item_id")]
    return out.groupBy("doc_id", "item_id").agg(F.max_by(F.struct(*cols), F.struct("matched", "span_words", -F.col("first_word"))).alias("s")).select("doc_id", "item_id", "s.*")


def _scan(docs: DataFrame, index: Index, least: int, similarity: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            ids, found = batch.column(0), []
            for first, data, offs in tc.chunks(batch.column(1)):
                h, doc, _, _ = tc.words(data, offs, tc.ALNUM)
                begin = np.searchsorted(doc, np.arange(len(offs)))
                for item, diagonal in zip(*ix.hits(h, doc)):
                    d, at = int(diagonal >> 40), int(diagonal & ((1 << 40) - 1))
                    if at >> 39:  # a start before the first document's first word
                        d, at = d + 1, at - (1 << 40)
                    w = ix.words[item]
                    lo, hi = max(at, int(begin[d])), min(at + len(w), int(begin[d + 1]))
                    same = h[lo:hi] == w[lo - at : hi - at]
                    if run_of := best_segment(same, similarity, min(least, len(w))):
                        a, b, n = run_of
                        found.append((ids[first + d].as_py(), ix.ids[item], True, len(w), n, b - a, lo + a - int(begin[d]), n / (b - a)))
            cols = list(zip(*found)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
