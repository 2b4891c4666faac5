"""Queries op1 to op13 and the pipeline, each over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathledger.llm.common import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


@query("op7_sharding")
def op7_sharding(spark, sf_dir):
    from pathledger.llm.sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"))


@query("op9_benchmark_decontamination")
def op9_benchmark_decontamination(spark, sf_dir):
    from pathledger.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_warc")
def op4_warc(spark, sf_dir):
    from pathledger.llm.warc import read_warc, scratch, write_warc

    folder = scratch(spark)
    return read_warc(write_warc(table(spark, sf_dir, "pages"), folder), folder)


@query("op6_ngram_jaccard_join")
def op6_ngram_jaccard_join(spark, sf_dir):
    from pathledger.llm.jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"), shingle=3, percent=90)


@query("op3_quality_classifier")
def op3_quality_classifier(spark, sf_dir):
    from pathledger.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_document_fingerprints")
def op5_document_fingerprints(spark, sf_dir):
    from pathledger.llm.spotsigs import fingerprint_with_edit

    return fingerprint_with_edit(table(spark, sf_dir, "documents"))


@query("op8_language_id")
def op8_language_id(spark, sf_dir):
    from pathledger.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


@query("op10_sentencepiece_encoding_and_decoding")
def op10_sentencepiece_encoding_and_decoding(spark, sf_dir):
    from pathledger.llm.sentencepieces import encode

    return encode(table(spark, sf_dir, "documents"))


@query("op1_lm_scoring")
def op1_lm_scoring(spark, sf_dir):
    from pathledger.llm.lm_score import stupid_backoff

    return stupid_backoff(table(spark, sf_dir, "documents"))


@query("op2_suffix_array_dedup")
def op2_suffix_array_dedup(spark, sf_dir):
    from pathledger.llm.suffix_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"))


def _merkle_sql() -> str:
    from pathledger.llm.merkle import sql

    return sql()


@query("op11_merkle_dataset_manifest", _merkle_sql())
def op11_merkle_dataset_manifest(spark, sf_dir):
    from pathledger.llm.merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


@query("op12_url_filters")
def op12_url_filters(spark, sf_dir):
    from pathledger.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark, sf_dir):
    from pathledger.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
