"""SpotSigs fingerprints: chains of content words that follow common-word anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathledger.llm import textcore as tc
from pathledger.llm.common import balanced_cuts, cut_lineage, frees_shuffles, id_bins, partitions
from pathledger.llm.jaccard_join import BROADCAST_IDS, grouped

#: Common words of four languages; each place where one stands is a spot.
ANCHORS = (
    "the a an is of and to in that it was for on are as with by this be at "
    "der die das und ist in zu den mit ein eine nicht von auf im es "
    "le la les de et un une est que dans en pour du des il "
    "el los las y de que en un una es por con se no para"
).split()
CHAIN = 3
HEX = 12


def _anchor_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(sorted(set(ANCHORS))).encode(), np.uint8)
    return np.unique(tc.words(data, np.array([0, len(data)]), tc.ALNUM)[0])


def signatures(data: np.ndarray, offs: np.ndarray, chain: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """(distinct signatures sorted within each document, bounds).

    A signature is an anchor with the `chain` content words after it (fewer at the end of a text). The start of a
    text counts as an anchor. A content word in no such chain, as more than `chain` follow an anchor, starts a chain
    itself, so every content word is in a signature, whatever the language; where common words are rare these are
    the text's shingles. A text of common words alone has a signature of all its words, and a text without words one
    of its bytes (the empty text too).
    """
    docs = len(offs) - 1
    h, doc, _, _ = tc.words(data, offs, tc.ALNUM)
    anchor = np.isin(h, _anchor_hashes())
    content = np.flatnonzero(~anchor)
    ch, cd = h[content], doc[content]
    begin = np.searchsorted(doc, np.arange(docs))
    spots = np.concatenate([np.flatnonzero(anchor), begin - 1])
    spot_doc = np.concatenate([doc[anchor], np.arange(docs)])
    spot_hash = np.concatenate([h[anchor], np.full(docs, tc.GRAM[50])])
    pad_h, pad_d = np.append(ch, np.zeros(chain + 1, np.uint64)), np.append(cd, np.full(chain + 1, -1))
    alone = np.ones(len(content), bool)

    def chained(k: np.ndarray, spot_doc: np.ndarray, spot_hash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sig, got = spot_hash * tc.GRAM[0], np.zeros(len(k), bool)
        for i in range(chain):
            at = np.minimum(k + i, len(pad_d) - 1)
            ok = pad_d[at] == spot_doc
            sig = sig + np.where(ok, pad_h[at] * tc.GRAM[i + 1], tc.U(0))
            alone[at[ok]] = False
            got |= ok
        return tc.mix(sig[got]), spot_doc[got]

    sig, sd = chained(np.searchsorted(content, spots, "right"), spot_doc, spot_hash)
    rest = np.flatnonzero(alone)
    more, md = chained(rest, cd[rest], np.full(len(rest), tc.GRAM[51]))
    sig, sd = np.concatenate([sig, more]), np.concatenate([sd, md])
    bare = np.setdiff1d(np.arange(docs), sd)
    if len(bare):
        extra = [int.from_bytes(hashlib.sha256(bytes(tc.LOWER[data[offs[b] : offs[b + 1]]])).digest()[:8], "little") for b in bare]
        sig, sd = np.concatenate([sig, np.array(extra, np.uint64)]), np.concatenate([sd, bare])
    sig = sig >> tc.U(64 - 4 * HEX)
    order = np.lexsort((sig, sd))
    sig, sd = sig[order], sd[order]
    keep = np.ones(len(sig), bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (sd[1:] != sd[:-1])
    return sig[keep], np.searchsorted(sd[keep], np.arange(docs + 1))


def pruned_jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0 without looking at elements where the sizes alone keep it below `least`."""
    x, y = len(a), len(b)
    if not x or not y or min(x, y) < least * max(x, y):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (x + y - both)


def as_text(sig: np.ndarray) -> str:
    return "".join(f"{x:0{HEX}x}" for x in sig.tolist())


def _lists(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, data, offs in tc.chunks(pa.array(texts, pa.large_string())):
        sig, at = signatures(data, offs)
        out += [sig[a:b] for a, b in zip(at[:-1], at[1:])]
    return out


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, key, tail, doc_id, text) in order: each document with the next one's text."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    ids: list[int | None] = []
    texts: list[str] = []
    tails: list[int] = []
    size = 0
    carry: tuple[int, np.ndarray] | None = None

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal ids, texts, tails, size, carry
        n = len(ids) if last else len(ids) - 1
        if n <= 0:
            return
        sets = _lists(texts)
        edited, rows = [], []
        for i in range(n):
            t = texts[i]
            q = len(t) // 4
            follow = texts[i + 1] if i + 1 < len(texts) else t
            edited.append(t[: len(t) - q] + follow[:q])
        for i, e in enumerate(_lists(edited)):
            if not tails[i]:
                nxt = sets[i + 1] if i + 1 < len(sets) else sets[i]
                rows.append((ids[i], len(texts[i]), hashlib.sha256(edited[i].encode()).hexdigest(), as_text(sets[i]), as_text(e), pruned_jaccard(sets[i], e), pruned_jaccard(sets[i], nxt)))
        cols = list(zip(*rows)) or [[]] * 7
        ids, texts, tails = ids[n:], texts[n:], tails[n:]
        size = sum(map(len, texts))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    for batch in batches:
        shard = batch.column(0).to_pylist()
        for s, tail, d, t in zip(shard, batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
            if carry is not None and s != carry[0]:
                yield from flush(True)
            carry = (s, None)
            ids.append(d)
            texts.append(t.as_py() or "")
            tails.append(tail)
            size += len(texts[-1])
            if size > tc.CHUNK and len(ids) > 1:
                yield from flush(False)
    yield from flush(True)


@frees_shuffles
def fingerprint_with_edit(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_group.

    A document's edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of
    the next document in ascending doc_id; after the last comes the first. Null texts are empty; null ids come
    first; rows that share a doc_id follow their texts; a lone row is its own successor. An empty table gives an
    empty result; further columns are ignored. The fingerprint is the whole signature set, sorted, in hexadecimal.

    Ranges of doc_id of about equal bytes go to one partition each; a range's successor is a copy of the next
    range's first document, so text moves once.
    """
    spark = docs.sparkSession
    near = near_duplicates(docs, percent).filter("component_id <> doc_id").groupBy("doc_id").agg(F.min("component_id").alias("near_group"))
    copies = cut_lineage(near)  # the documents that aren't the first of their group
    few = copies.count() <= BROADCAST_IDS
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    narrow = cut_lineage(base.select("doc_id", F.octet_length("text").alias("n")))
    add_bin, weights = id_bins(narrow, "doc_id", F.col("n") + 64)
    shards = max(1, 2 * partitions(spark))
    cut = balanced_cuts(weights, shards) or {0: 0}
    cuts = F.broadcast(spark.createDataFrame(list(cut.items()), "bin int, shard int"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    dealt = add_bin(base).withColumn("key", key).join(cuts, "bin").select("shard", "key", "doc_id", "text")
    low = add_bin(narrow).withColumn("key", key).join(cuts, "bin").groupBy("shard").agg(F.min("key").alias("key"))
    used = sorted(r.shard for r in low.collect())  # a row a shard
    before = spark.createDataFrame([(s, used[i - 1]) for i, s in enumerate(used)] or [(0, 0)], "shard int, into int")
    heads = dealt.join(F.broadcast(low), ["shard", "key"]).groupBy("shard").agg(F.min("text").alias("text"))  # a row a shard
    tails = heads.join(F.broadcast(before), "shard").select(F.col("into").alias("shard"), F.lit(2**63 - 1).alias("key"), F.lit(1).alias("tail"), F.lit(None).cast("bigint").alias("doc_id"), "text")
    rows = dealt.select("shard", "key", F.lit(0).alias("tail"), "doc_id", "text").unionByName(tails)
    ranged = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "tail", "key", "text")
    out = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    made = ranged.mapInArrow(_pairs, out)
    return made.join(F.broadcast(copies) if few else copies, "doc_id", "left").withColumn("near_group", F.coalesce("near_group", "doc_id"))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, component_id: documents linked by a SpotSigs Jaccard of `percent` or more, closed transitively.

    Sets of unlike length can't be that similar: documents meet only within classes of set length (1.5 apart, a set in
    each class that a link could lead to), there by a part of their signatures that linked sets must share, and are
    compared only where the lengths allow a link. Equal sets become one representative first. A text without content
    links only with equal texts. Exact; nothing is capped. Null ids get the component of an equal set, or null.
    """
    return grouped(docs, signatures, percent).select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
