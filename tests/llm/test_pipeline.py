"""The pipeline's stages on the small tables: each against brute force or its operator's own verdicts."""

import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from pathledger.llm import decontaminate, quality, sentencepieces
from pathledger.runtime import table

SF = "/root/testdata/sf0.001"


def shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return set(zip(*[w[k:] for k in range(n)])) if len(w) >= n else {tuple(w)} if w else set()


def groups(texts, percent=80):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def cut(texts, length=100):
    seen, out = set(), {}
    for i in sorted(texts):
        b = texts[i].encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            gone[p : p + length] |= s in seen
            seen.add(s)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")
        if not gone.any() or re.search(r"[^\x20\x09-\x0D]", kept):
            out[i] = kept
    return out


def text_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, text_of(docs)
    outputs = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        inputs, docs = docs, stage(spark, docs, SF).cache()
        outputs[name] = docs.count()
        if k < 4:
            assert docs.columns == columns, name
            after = text_of(docs)
            assert len(after) == outputs[name]
        if k == 0:
            good = {r.doc_id for r in quality.classify(inputs, table(spark, SF, "labels")).filter("predicted = 1").collect()}
            assert after == {i: t for i, t in before.items() if i in good} and len(after) < len(before)
        elif k == 1:
            root = groups(before)
            assert after == {i: t for i, t in before.items() if root[i] == i} and len(after) < len(before)
        elif k == 2:
            assert after == cut(before) and any(after[i] != before[i] for i in after)
            assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0
        elif k == 3:
            bad = {r.doc_id for r in decontaminate.decontaminate(inputs, table(spark, SF, "benchmark")).collect()}
            assert after == {i: t for i, t in before.items() if i not in bad} and bad
        else:
            back = {(r.doc_id, r.text) for r in sentencepieces.decode(docs).collect()}
            assert back == set(before.items()) and outputs[name] == 2 * len(before)
        before = after
    ran = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.rank, r.ids_sha256) for r in ran.collect()) == sorted((r.doc_id, r.rank, r.ids_sha256) for r in docs.collect())


def test_documents_without_id_are_judged_and_kept(spark):
    docs = table(spark, SF, "documents").filter("length(text) > 0").cache()
    nameless = docs.withColumn("doc_id", F.lit(None).cast("bigint"))
    good = sorted(r.text for r in corpus_pipeline.quality(spark, docs, SF).collect())
    got = corpus_pipeline.quality(spark, docs.unionByName(nameless), SF)
    assert got.columns == docs.columns and sorted(r.text for r in got.filter("doc_id is null").collect()) == good
    clean = sorted(r.text for r in corpus_pipeline.contamination(spark, docs, SF).collect())
    assert sorted(r.text for r in corpus_pipeline.contamination(spark, nameless, SF).collect()) == clean
    words = [" ".join(f"{c}{k}" for k in range(40)) for c in "abc"]
    rows = [(7, words[0]), (None, words[0]), (None, words[1]), (None, words[1]), (None, words[2] + " end"), (None, None)]
    some = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.length("text").cast("bigint"))
    key = lambda r: (r.doc_id or 0, r.text or "")
    want = sorted([(7, words[0]), (0, words[1]), (0, words[2] + " end"), (0, "")])
    assert sorted(map(key, corpus_pipeline.near_duplicates(spark, some, SF).collect())) == want
    assert sorted(map(key, corpus_pipeline.repeats(spark, some.filter("text is not null"), SF).collect())) == want[1:]


def test_odd_inputs_of_every_stage(spark):
    """Empty tables, nulls in every column, blank texts, repeated rows and a further column named like an operator's."""
    docs = table(spark, SF, "documents").withColumn("score", F.lit("x"))
    some = docs.filter("doc_id < 12")
    odd = some.limit(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema))
    blank = some.limit(1).withColumns({"doc_id": F.lit(10**6).cast("bigint"), "text": F.lit(" \n")})
    mixed = some.unionByName(some.filter("doc_id < 3")).unionByName(odd).unionByName(blank)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), SF)
        got = stage(spark, mixed, SF)
        assert none.count() == 0 and none.columns == got.columns
        ids = [r.doc_id for r in got.select("doc_id").collect()]
        if name in ("ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "sentencepiece"):
            assert 10**6 in ids and None in ids, name
        if name != "sentencepiece":
            assert got.columns == docs.columns and len(ids) <= mixed.count(), name
