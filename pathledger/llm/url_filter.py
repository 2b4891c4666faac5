"""URL filters: rules by host and path, else naive Bayes over the words that a unigram Viterbi finds in host and path.

Everything grows as joins and aggregates over distinct urls: words of the corpus are counted, the letter runs of urls meet the
counts through their substrings, a task segments one run at a time, and counts of segments by class become log odds that are
joined back. No vocabulary, host list or model is collected or broadcast. While urls are taken apart a 32-byte digest of
host and path stands for them, so that a very long one isn't copied to each of its parts.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathledger.llm.common import checkpoint_dir

#: (host, path, verdict): the query's policy.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Words that mark a url as unwanted while the classifier is trained; a parameter.
SEEDS = ("adult", "ads", "bet", "bets", "betting", "casino", "escort", "gambling", "jackpot", "loans", "lottery", "malware", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "warez", "xxx")
LONGEST_WORD = 24
LONGEST_RUN = 63  # a host label has no more
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first `://`: the host up to `/`, `?`, `#` or the end, A-Z lower-cased, and the path up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host, path = (F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", i) for i in (1, 2))
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """rule, verdict of the longest rule that fits: its host or a subdomain of it, and a path that starts with its own."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest last, so that it is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def letter_runs(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def corpus_words(pages: DataFrame, seeds=SEEDS) -> DataFrame:
    """word, n: words of the pages' html without its tags, of hosts and paths whose parts a hyphen or underscore divides, and
    the seeds once each. Undivided names don't count: else every name would be a word of its own."""
    shown = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    host, path = host_and_path(F.col("url"))
    divided = F.filter(F.split(F.concat_ws(".", host, path), r"[^\p{L}_-]+"), lambda x: x.rlike(r"\p{L}[_-]+\p{L}"))
    marked = pages.select(F.explode(F.flatten(F.array(letter_runs(shown), letter_runs(F.array_join(divided, " "))))).alias("word"))
    fine = F.length("word").between(2, LONGEST_WORD)
    counted = marked.filter(fine).groupBy("word").agg(F.count("*").alias("n"))
    own = pages.sparkSession.createDataFrame([(w, 1) for w in seeds], "word string, n bigint")
    return counted.unionByName(own).groupBy("word").agg(F.sum("n").alias("n"))


def split_run(run: str, known: dict[tuple[int, int], float], total: float) -> list[str]:
    """The most probable words of a run: of known ones n / total, of others 10 / (total * 10**length). Of equally probable
    segmentations the one whose last word is longest, then the one before it."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        got = (-math.inf, 0)
        for start in range(max(0, end - LONGEST_WORD), end):
            size = end - start
            p = known.get((start, size), math.log(10 / total) - size * math.log(10))
            if best[start][0] + p > got[0]:
                got = (best[start][0] + p, start)
        best.append(got)
    out, end = [], len(run)
    while end:
        start = best[end][1]
        out.append(run[start:end])
        end = start
    return out[::-1]


def segmented(runs: DataFrame, words: DataFrame) -> DataFrame:
    """run, words for each distinct run of letters. A run of more than 63 letters is no name and stays one word."""
    total = float(words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) or 1.0
    starts = F.explode(F.sequence(F.lit(1), F.length("run") - 1)).alias("start")
    short = runs.filter(F.length("run") <= LONGEST_RUN)
    spans = short.filter(F.length("run") >= 2).select("run", starts)
    sized = spans.select("run", "start", F.explode(F.sequence(F.lit(2), F.least(F.lit(LONGEST_WORD), F.length("run") - F.col("start") + 1))).alias("size"))
    met = sized.withColumn("word", F.substring("run", F.col("start"), F.col("size"))).join(words, "word")
    hits = met.groupBy("run").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("size").cast("int").alias("size"), "n")).alias("hits"))  # at most 63 * 23

    def viterbi(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for run, found in zip(pdf.run, pdf.hits):
                known = {(h["start"] - 1, h["size"]): math.log(h["n"] / total) for h in (found if found is not None else ())}
                out.append(split_run(run, known, total))
            yield pd.DataFrame({"run": pdf.run, "words": out})

    whole = runs.filter(F.length("run") > LONGEST_RUN).select("run", F.array("run").alias("words"))
    return short.join(hits, "run", "left").mapInPandas(viterbi, "run string, words array<string>").unionByName(whole)


def tokens_of(urls: DataFrame, words: DataFrame) -> DataFrame:
    """u, n, tokens of urls (u, host, path, n): `h:word` and `p:word` as segmented, and `h:#3`, `p:#3` for a number of three digits."""
    cut = lambda side, text: F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|\p{Nd}+"), F.lit(0)), lambda x: F.struct(F.lit(side).alias("side"), x.alias("run")))
    parts = urls.select("u", F.explode(F.concat(cut("h:", F.col("host")), cut("p:", F.col("path")))).alias("part")).select("u", "part.*")
    is_number = F.col("run").rlike(r"^\p{Nd}")
    cuts = segmented(parts.filter(~is_number).select("run").distinct(), words)
    own = parts.filter(is_number).select("u", F.array(F.concat("side", F.lit("#"), F.length("run").cast("string"))).alias("own"))
    named = parts.filter(~is_number).join(cuts, "run").select("u", F.expr("transform(words, w -> concat(side, w))").alias("own"))
    found = own.unionByName(named).groupBy("u").agg(F.flatten(F.collect_list("own")).alias("tokens"))  # one url's
    return urls.select("u", "n").join(found, "u", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def log_odds(urls: DataFrame, seeds=SEEDS) -> tuple[DataFrame, float]:
    """(token, weight; unseen tokens weigh nothing), and the prior: multinomial naive Bayes with add-one smoothing, each url as often
    as it stands. While training, a url is unwanted if one of its tokens is a seed. Without both classes nothing is known."""
    bad = F.exists("tokens", lambda t: F.substring(t, 3, LONGEST_WORD).isin(*seeds)).cast("int")
    labelled = urls.withColumn("bad", bad)
    counts = labelled.select("n", "bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum(F.col("n") * F.col("bad")).alias("b"), F.sum(F.col("n") * (1 - F.col("bad"))).alias("a"))
    sums = counts.agg(F.sum("b"), F.sum("a"), F.count("*")).first()
    urls_of = labelled.agg(F.sum(F.col("n") * F.col("bad")), F.sum(F.col("n") * (1 - F.col("bad")))).first()
    if not all(urls_of):
        return counts.select("token", F.lit(0.0).alias("weight")), 0.0 if not any(urls_of) else -math.inf if not urls_of[0] else math.inf
    b, a, kinds = map(float, sums)
    weight = F.log((F.col("b") + 1) / (b + kinds)) - F.log((F.col("a") + 1) / (a + kinds))
    return counts.select("token", weight.alias("weight")), math.log(urls_of[0] / urls_of[1])


def judge(pages: DataFrame, rules=RULES, seeds=SEEDS) -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row of pages (page_id, url, html).

    The longest rule that fits decides, else the classifier: block if the odds are above even. score is the classifier's
    probability of block, whatever decided. Null urls and those without `://` have an empty host and path, no rule, and are
    judged by the prior alone. Rows that repeat come out as often as they stand, null ids as null; equal urls have equal
    results. A url of many megabytes is as many tokens. If no url of the table holds a seed nothing is blocked but by rule, and
    if all do everything is. An empty table gives an empty result; further columns, whatever their names, are ignored.
    """
    spark = pages.sparkSession
    folder = f"{checkpoint_dir(spark)}/urls-{uuid.uuid4().hex}"
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("u", F.unhex(F.sha2(F.concat_ws("/", F.octet_length("host"), "host", "path").cast("binary"), 256)))
    urls = rows.groupBy("u").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.count("*").alias("n"))
    corpus_words(pages.select("url", "html"), seeds).write.parquet(f"{folder}/words")  # counted once, asked for twice
    tokens_of(urls, spark.read.parquet(f"{folder}/words")).write.parquet(f"{folder}/urls")
    urls = spark.read.parquet(f"{folder}/urls")
    weights, prior = log_odds(urls, seeds)
    summed = urls.select("u", F.explode("tokens").alias("token")).join(weights, "token").groupBy("u").agg(F.sum("weight").alias("weight"))
    decided = ruled(F.col("host"), F.col("path"), rules)
    odds = F.coalesce("weight", F.lit(0.0)) + prior
    judged = rows.join(summed, "u", "left").withColumns({"r": decided, "odds": odds})
    verdict = F.coalesce("r.verdict", F.when(F.col("odds") > 0, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), (1 / (1 + F.exp(-F.col("odds")))).alias("score"))
