"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathledger.llm import textcore as tc

#: Bounds of the fit: labelled documents, bytes of the longest text among them, and lines of them all, whose features
#: (244 bytes a line) reach the driver.
FIT_DOCUMENTS = 4000
FIT_BYTES = 1 << 16
FIT_LINES = 400_000
THRESHOLD = 0.7
BAD, GOOD = 0, 1

_classes = np.zeros((8, 256), bool)
_classes[0, [*range(97, 123)]] = True  # lower
_classes[1, [*range(65, 91)]] = True  # upper
_classes[2, [*range(48, 58)]] = True  # digits
_classes[3, [*b" \t\r\x0b\x0c"]] = True  # spaces
_classes[4, [*b".,;:!?'\"()-"]] = True  # prose punctuation
_classes[5, [*b"#$%&*|<>{}[]\\/=+~^_@`"]] = True  # symbols
_classes[6, [*range(128, 256)]] = True  # beyond ASCII
_classes[7, [*b"|"]] = True  # columns
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
OWN = 20


def own_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line but the last one, its document, its bytes, its hash).

    Lines are runs between line feeds; blank text is one empty line, so that every document has a line.
    """
    docs = len(offs) - 1
    starts, ends, owner = tc.word_bounds(data, offs, ~_NEWLINE)
    none = np.setdiff1d(np.arange(docs), owner)
    starts, ends, owner = (np.concatenate(x) for x in ((starts, offs[none]), (ends, offs[none]), (owner, none)))
    order = np.lexsort((starts, owner))
    starts, ends, owner = starts[order], ends[order], owner[order]
    size = (ends - starts).astype(float)
    n = np.maximum(size, 1)
    f = np.zeros((len(starts), OWN))
    for c in range(8):
        total = np.concatenate([[0], np.cumsum(_classes[c][data], dtype=np.int64)])
        f[:, c] = (total[ends] - total[starts]) / n
    h, _, ws, we = tc.words(data, offs)
    line = np.searchsorted(starts, ws, "right") - 1 if len(ws) else np.zeros(0, np.int64)
    count = np.bincount(line, minlength=len(starts)).astype(float)
    w = np.maximum(count, 1)
    pair = np.lexsort((h, line))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[pair][1:] != h[pair][:-1]) | (line[pair][1:] != line[pair][:-1])
    distinct = np.bincount(line[pair], weights=fresh, minlength=len(starts))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    edge = np.flatnonzero(fresh)
    most = np.zeros(len(starts))
    if len(edge):
        np.maximum.at(most, line[pair][edge], np.diff(np.append(edge, len(h))))
    bare = tc.ALNUM[data[np.maximum(we - 1, 0)]] | _classes[4][data[np.maximum(we - 1, 0)]] if len(we) else np.zeros(0, bool)
    f[:, 8] = np.log1p(size) / 8
    f[:, 9] = np.log1p(count) / 6
    f[:, 10] = np.bincount(line, weights=we - ws, minlength=len(starts)) / w / 10
    f[:, 11] = distinct / w
    f[:, 12] = np.bincount(line, weights=again, minlength=len(starts)) / w
    f[:, 13] = most / w
    f[:, 14] = 1 - np.bincount(line, weights=bare, minlength=len(starts)) / w
    f[:, 15] = np.bincount(line, weights=(we - ws) > 20, minlength=len(starts)) / w
    f[:, 16] = np.bincount(line, weights=(we - ws) == 1, minlength=len(starts)) / w
    last, head = (data[np.maximum(ends - 1, 0)], data[np.minimum(starts, max(len(data) - 1, 0))]) if len(data) else (np.zeros(len(starts), np.uint8),) * 2
    f[:, 17] = np.isin(last, list(b".!?:")) & (size > 0)
    f[:, 18] = _classes[1][head] & (size > 0)
    whole = np.zeros(len(starts), np.uint64)
    whole[size > 0] = tc.words(data, offs, ~_NEWLINE, lower=False)[0]
    return f, owner, n, whole


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line with those of its neighbours, first line of each document, bytes of each line); the last of its
    own says whether an equal line of the document comes before."""
    docs = len(offs) - 1
    f, owner, n, whole = own_features(data, offs)
    dup = np.lexsort((whole, owner))
    same = np.zeros(len(whole), bool)
    same[1:] = (whole[dup][1:] == whole[dup][:-1]) & (owner[dup][1:] == owner[dup][:-1])
    f[dup, 19] = same
    first = np.searchsorted(owner, np.arange(docs + 1))
    out = np.zeros((len(f), 3 * OWN + 1), np.float32)
    out[:, :OWN] = f
    inner = owner[1:] == owner[:-1]
    out[1:, OWN : 2 * OWN] = f[:-1] * inner[:, None]
    out[:-1, 2 * OWN : 3 * OWN] = f[1:] * inner[:, None]
    out[:, -1] = 1
    return out, first, n


def marginals(unary: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(good) of each line, expected transition counts, log partition sum) of chains laid end to end.

    All chains advance together, longest first, so each step is one vector operation over those still running.
    """
    size = np.diff(first)
    by = np.argsort(-size, kind="stable")
    alpha = np.zeros((len(unary), 2))
    beta = np.zeros((len(unary), 2))
    score = np.stack([np.zeros(len(unary)), unary], axis=1)
    steps = int(size.max(initial=0))
    live = np.searchsorted(-size[by], -np.arange(steps), "left")  # chains longer than t
    at = first[:-1][by]
    alpha[at] = score[at]
    for t in range(1, steps):
        i = at[: live[t]] + t
        prev = alpha[i - 1][:, :, None] + trans[None]
        alpha[i] = np.logaddexp(prev[:, 0], prev[:, 1]) + score[i]
    pairs = np.zeros((2, 2))
    end = first[1:][by] - 1
    z = np.logaddexp(alpha[end, 0], alpha[end, 1])
    for t in range(steps - 2, -1, -1):
        i = at[: live[t + 1]] + t
        following = trans[None] + (score[i + 1] + beta[i + 1])[:, None, :]
        pairs += np.exp(alpha[i][:, :, None] + following - z[: live[t + 1]][:, None, None]).sum(axis=0)
        beta[i] = np.logaddexp(following[:, :, 0], following[:, :, 1])
    both = alpha + beta
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -50, 50))), pairs, float(z.sum())


BLOCK = 1024
LEAST = 1e-120


def one_chain(unary: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(good) of each line of one long chain: blocks of lines advance together, from states that the blocks' products carry.

    In probabilities scaled to 1 at each step, which marginals allow; the same as marginals() but for rounding and for
    probabilities below LEAST. Three numbers a line are held.
    """
    n = len(unary)
    rows = -(-n // BLOCK)
    steps = np.full((rows, BLOCK), np.nan)  # lines beyond the end change nothing
    steps.reshape(-1)[:n] = unary
    steps = np.ascontiguousarray(steps.T)
    m = np.exp(trans - trans.max())

    def scaled(x: np.ndarray) -> np.ndarray:
        return np.maximum(x / x.sum(axis=-1, keepdims=True), LEAST)

    def emitted(t: int) -> tuple[np.ndarray, np.ndarray]:
        """(weights of both states, whether the line is there) of line t of each block."""
        u = np.nan_to_num(steps[t])
        top = np.maximum(u, 0)
        return np.maximum(np.exp(np.stack([-top, u - top], axis=1)), LEAST), ~np.isnan(steps[t])[:, None]

    product = np.tile(np.eye(2), (rows, 1, 1))
    grown = np.zeros((rows, 2))  # logarithms of what scaling took from the rows of each product
    for t in range(BLOCK):
        w, there = emitted(t)
        product = np.where(there[:, :, None], (product @ m) * w[:, None, :], product)
        grown += np.log(product.sum(axis=2))
        product = scaled(product)
    product *= np.maximum(np.exp(grown - grown.max(axis=1, keepdims=True)), LEAST)[:, :, None]
    before, after = np.ones((rows, 2)), np.ones((rows, 2))
    first = state = scaled(emitted(0)[0][0])  # no transition comes before the chain's first line
    for t in range(1, min(n, BLOCK)):
        state = scaled((state @ m) * emitted(t)[0][0])
    for r in range(1, rows):
        before[r] = state
        state = scaled(state @ product[r])
    state = np.ones(2)
    for r in range(rows - 1, -1, -1):
        after[r] = state
        state = scaled(product[r] @ state)
    good = np.empty((BLOCK, rows))
    now = before
    for t in range(BLOCK):
        w, there = emitted(t)
        now = np.where(there, scaled((now @ m) * w), now)
        if t == 0:
            now[0] = first
        good[t] = now[:, 1]
    now = after
    for t in range(BLOCK - 1, -1, -1):
        w, there = emitted(t)
        p = np.stack([np.maximum(1 - good[t], LEAST), good[t]], axis=1) * now
        good[t] = p[:, 1] / p.sum(axis=1)
        now = np.where(there, scaled((w * now) @ m.T), now)
    return good.T.reshape(-1)[:n]


def pieces(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Whole lines of about `most` bytes; a longer line is a piece of its own, and stretches without a line are left out."""
    ends = np.append(np.flatnonzero(data == 10), len(data))
    low = 0
    while low < len(data):
        high = int(ends[max(np.searchsorted(ends, low), np.searchsorted(ends, low + most, "right") - 1)])
        part = data[low:high]
        if (part != 10).any():
            yield part
        low = high + 1


@dataclass
class Crf:
    weights: np.ndarray
    trans: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def lines(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return marginals((x * self.scale) @ self.weights, first, self.trans)[0]

    def documents(self, x: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals."""
        p = self.lines(x, first)
        return np.add.reduceat(p * size, first[:-1]) / np.add.reduceat(size, first[:-1])

    def long_document(self, data: np.ndarray, most: int = tc.CHUNK) -> np.ndarray:
        """documents() of one text of many lines: features are made piece by piece, a line keeps some 60 bytes."""
        w = (self.weights * self.scale)[: 3 * OWN].reshape(3, OWN)  # of a line, of the one before, of the one after
        dots, sizes, hashes = [], [], []
        for part in pieces(data, most):
            f, _, n, whole = own_features(part, np.array([0, len(part)]))
            dots.append((f.astype(np.float32).astype(float) @ w.T).astype(np.float32))
            sizes.append(n.astype(np.int32))
            hashes.append(whole)
        if not dots:
            return self.documents(*line_features(data[:0], np.array([0, 0])))
        dot, size, whole = (np.concatenate(x) for x in (dots, sizes, hashes))
        del dots, sizes, hashes
        order = np.argsort(whole, kind="stable").astype(np.int32 if len(whole) < 1 << 31 else np.int64)
        whole = whole[order]
        again = order[1:][whole[1:] == whole[:-1]]
        del whole, order
        unary = np.full(len(dot), self.weights[-1] * self.scale[-1])
        for k, (to, of) in enumerate(((slice(None), slice(None)), (slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None)))):
            part = dot[:, k].copy()
            part[again] += w[k, OWN - 1]
            unary[to] += part[of]
        del dot, again, part
        return np.array([np.dot(one_chain(unary, self.trans), size) / size.sum(dtype=np.int64)])

    def calibrated(self, mean: np.ndarray) -> np.ndarray:
        m = np.clip(mean, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(m / (1 - m)) + self.shift)))


def _ascend(x: np.ndarray, first: np.ndarray, y: np.ndarray, start: Crf, rounds: int, penalty: float) -> Crf:
    """Maximise the penalised conditional likelihood of line labels with Adam; deterministic."""
    w, t = start.weights.copy(), start.trans.copy()
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
    m = [np.zeros_like(w), np.zeros_like(t)]
    v = [np.zeros_like(w), np.zeros_like(t)]
    xs = x * start.scale
    n = max(1, len(y))
    for step in range(1, rounds + 1):
        p, pairs, _ = marginals(xs @ w, first, t)
        grads = [xs.T @ (y - p) / n - penalty * w, (seen - pairs) / n - penalty * t]
        for k, (param, g) in enumerate(zip((w, t), grads)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            param += 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Crf(w, t, start.scale)


def fit(x: np.ndarray, first: np.ndarray, size: np.ndarray, quality: np.ndarray, *, rounds: int = 120, penalty: float = 1e-4) -> Crf:
    """Documents carry the labels, lines learn them: a bad document's lines start as bad, then those that look
    good stay out, but for its worst line. Platt scaling of the aggregate follows on the same documents."""
    scale = 1 / np.maximum(x.std(axis=0), 0.05)
    scale[-1] = 1
    owner = np.repeat(np.arange(len(quality)), np.diff(first))
    y = quality[owner].astype(int)
    crf = _ascend(x, first, y, Crf(np.zeros(x.shape[1]), np.zeros((2, 2)), scale), rounds, penalty)
    for _ in range(2):
        p = crf.lines(x, first)
        worst = np.minimum.reduceat(p, first[:-1])[owner]
        y = np.where(quality[owner] == 1, 1, (p > np.maximum(0.5, worst)).astype(int))
        crf = _ascend(x, first, y, crf, rounds // 2, penalty)
    mean = np.clip(crf.documents(x, first, size), 1e-6, 1 - 1e-6)
    z = np.log(mean / (1 - mean))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic fit
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r = np.maximum(q * (1 - q), 1e-9)
        h = np.array([[np.sum(r * z * z) + 1e-3, np.sum(r * z)], [np.sum(r * z), np.sum(r) + 1e-3]])
        da, db = np.linalg.solve(h, [np.sum((quality - q) * z), np.sum(quality - q)])
        a, b = a + np.clip(da, -2, 2), b + np.clip(db, -2, 2)
    crf.slope, crf.shift = float(max(a, 0.05)), float(b)
    return crf


def train(docs: DataFrame, labels: DataFrame, *, most: int = FIT_DOCUMENTS, most_bytes: int = FIT_BYTES, most_lines: int = FIT_LINES) -> Crf:
    """Fit on at most `most` labelled documents of at most `most_bytes` bytes, the first by a hash of doc_id, while they
    have `most_lines` lines in all. Of several rows of a doc_id the one with the least features is taken; several
    labels count as the least."""
    names = ["doc_id", "text"]
    one = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    pool = docs.select(*names).filter(F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("lines")
    short = pool.filter(F.octet_length(text) <= most_bytes).groupBy("doc_id").agg(F.sum(lines).alias("lines"))
    lots = short.join(one, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()  # three numbers each
    kept = [r for r, n in zip(lots, np.cumsum([r.lines for r in lots])) if n <= most_lines]
    lots = docs.sparkSession.createDataFrame([(r.doc_id, r.quality) for r in kept], "doc_id bigint, quality int")
    chosen = docs.select(*names).filter(F.octet_length(text) <= most_bytes).join(F.broadcast(lots), "doc_id")  # at most `most` ids
    chosen = chosen.select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offs in tc.chunks(batch.column(2)):
                x, first, size = line_features(data, offs)
                flat = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                rows = len(offs) - 1
                sizes = [size[a:b].astype(np.float64).tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), batch.column(1).slice(lo, rows), pa.array(flat, pa.binary()), pa.array(sizes, pa.binary())], ["doc_id", "quality", "x", "size"])

    got = chosen.select(F.col("doc_id").cast("bigint"), "quality", F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, quality int, x binary, size binary").toPandas()
    got = got.sort_values(["doc_id", "x"]).drop_duplicates("doc_id")
    if got.empty:
        return Crf(np.zeros(3 * OWN + 1), np.zeros((2, 2)), np.ones(3 * OWN + 1))
    xs = [np.frombuffer(b, np.float32).reshape(-1, 3 * OWN + 1) for b in got.x]
    first = np.concatenate([[0], np.cumsum([len(v) for v in xs])])
    return fit(np.concatenate(xs).astype(float), first, np.concatenate([np.frombuffer(b, np.float64) for b in got["size"]]), got.quality.to_numpy())


def score(docs: DataFrame, crf: Crf, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, from the text alone.

    Null and empty texts are one empty line and get that line's score. Repeated rows get the same score; an empty
    table gives an empty result; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offs in tc.chunks(batch.column(1)):
                model = shared.value
                mean = model.long_document(data) if len(data) > tc.CHUNK else model.documents(*line_features(data, offs))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(offs) - 1), pa.array(model.calibrated(mean))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """score() by the model that train() learns from docs and labels: doc_id, held_out, score, predicted for every row.

    Null and empty texts are one empty line; null ids aren't learnt from; without labels every score is 0.5; repeated rows get
    equal scores, and an empty table gives an empty result.
    """
    return score(docs, train(docs, labels), **kw)
