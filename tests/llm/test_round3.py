"""Merkle manifest, URL filters and whitening against brute force, with nulls, repeats, odd columns and empty tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathledger.llm import merkle, url_filter, whitening

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def leaf(doc_id, text, lang, source, n_chars):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """(root, siblings left and right of each node on its way up), built at once."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, at):
            low = i - i % 3
            p.append(("".join(nodes[low:i]), "".join(nodes[i + 1 : low + 3])))
        nodes, at = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], paths


def brute_manifest(docs):
    groups = collections.defaultdict(list)
    for d in docs:
        groups[d[3]].append(d)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    rows, subs = [], []
    for s in order:
        mine = sorted(groups[s], key=lambda d: (d[0] is not None, d[0] or 0, leaf(*d)))
        sub, paths = tree([leaf(*d) for d in mine])
        subs.append(sub)
        rows.append((mine, paths, sub))
    root, tops = tree(subs)
    out = []
    for (mine, paths, sub), top in zip(rows, tops):
        for d, p in zip(mine, paths):
            text = d[1]
            if text is not None and d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            h = leaf(d[0], text, *d[2:])
            for x, y in p + top:
                h = H(x, h, y)
            out.append((d[0], leaf(*d), sub, root, H(*(x + y for x, y in p + top)), h, h == root))
    return sorted(out, key=str)


def manifest_rows(df):
    return sorted((tuple(r) for r in merkle.manifest(df).collect()), key=str)


def test_manifest_of_odd_rows(spark):
    docs = [(1, "a\nb", "en", "x", 3), (2, "a\nb", "en", "x", 3), (3, None, None, None, None), (3, "", "de", None, 0), (None, "c\n", "en", "x", 2), (None, None, "en", "", 2)]
    docs += [docs[0], docs[0], (4, "Ünï\n\n", "fr", "é", 5), (9, "1:", "en", "zz", 2), (10**18, "\n" * 50, "en", "Z", 50), (-5, "q\n", "en", "x", 2)]
    df = spark.createDataFrame(docs, DOC)
    want = brute_manifest(docs)
    clash = df.select("*", *(F.lit("x").alias(c) for c in ("s", "run", "idx", "at", "task", "digest", "leaf", "root", "tampered", "level", "tag", "top")))
    assert manifest_rows(clash) == want and not all(r[6] for r in want) and any(r[6] for r in want)


@pytest.mark.parametrize("sizes", [[("a", 5000), ("b", 2187), ("c", 2188), ("d", 1), (None, 3)], [("only", 2)], [(None, 1)], [(f"s{i:04}", 1) for i in range(2300)]])
def test_manifest_of_many_runs(spark, sizes):
    """Sources below, at and above a run's 2,187 leaves, and more sources than a run."""
    docs, n = [], 0
    for s, k in sizes:
        for _ in range(k):
            n += 1
            docs.append((n * 7919 % 100_003, f"t{n}\n" if n % 3 else None, "en", s, n))
    got = manifest_rows(spark.createDataFrame(docs, DOC).repartition(5))
    assert got == brute_manifest(docs)


def test_manifest_of_nothing_and_its_store(spark, tmp_path):
    empty = spark.createDataFrame([], DOC)
    assert merkle.manifest(empty).count() == 0
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
    r = merkle.manifest(docs, f"{tmp_path}/m").first()
    nodes = merkle.stored_nodes(spark, f"{tmp_path}/m")
    assert {x.level: x.n for x in nodes.groupBy("level").agg(F.count("*").alias("n")).collect()} == {1: 14, 2: 5, 3: 2, 4: 1}
    assert nodes.filter("level = 4").first().digest == r.subroot == r.root


PAGES = [
    (1, "http://Cheap-Pills.example.net/en/1", "<p>the house and the garden</p>"),
    (2, "https://cheappills.shop.net:80/en/2?x=/de/", "<script>var cheap=1</script><b>House</b> of cheap pills"),
    (3, "https://blog.gardenhouse.net/en/2#top", "garden house"),
    (4, "http://x.example.org/es/9", None), (5, "http://example.org/en/12", ""), (6, "http://notexample.org/en/12", "x"), (7, "http://example.org", "y"),
    (8, "http://a.b.com/fr/z_house-garden", "z"), (9, "http://com/de/", "z"), (10, None, "z"), (11, "no scheme", "z"), (None, "http://free-bets.net/en/1", "z"), (None, "http://free-bets.net/en/1", "z"),
    (12, "ftp://ÄÖ.net/" + "pillshouse" * 9 + "/777", "z"), (13, "://", "z"), (14, "http://?q", "z"), (15, "http://EXAMPLE.ORG/ES/1", "z"), (16, "http://my-house.net/en/3", "my"), (17, "http://free-garden.net/en/\n9", "z"),
]


def brute_judge(pages):
    letters = lambda t: [w for w in re.split(r"[^a-zäö]+", t.lower()) if w]
    host_path = lambda u: re.match(r"(?s)([^/?#]*)([^?#]*)", u.split("://", 1)[1]).groups() if u and "://" in u else ("", "")
    lower = lambda h: "".join(c.lower() if c.isascii() else c for c in h)
    words = collections.Counter(url_filter.SEEDS)
    split = {}
    for _, url, html in pages:
        shown = re.sub(r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ", html or "")
        h, p = host_path(url)
        split[url] = (lower(h), p)
        divided = [x for x in re.split(r"[^A-Za-zäöÄÖ_-]+", lower(h) + "." + p) if re.search(r"[a-zäö][_-]+[a-zäö]", x.lower())]
        words.update(w for w in letters(shown) + [w for x in divided for w in letters(x)] if 2 <= len(w) <= 24)
    total = sum(words.values())

    def cut(run):
        if len(run) > 63:
            return [run]
        best = [(0.0, [])]
        for end in range(1, len(run) + 1):
            best.append(max(((best[s][0] + (math.log(words[run[s:end]] / total) if words[run[s:end]] and end - s > 1 else math.log(10 / total) - (end - s) * math.log(10)), -s, best[s][1] + [run[s:end]]) for s in range(max(0, end - 24), end)), key=lambda t: t[:2])[::2])
        return best[-1][1]

    def tokens(url):
        return [side + w for side, t in zip(("h:", "p:"), split[url]) for x in re.findall(r"[a-zäö]+|[0-9]+", t.lower()) for w in (["#" + str(len(x))] if x[0].isdigit() else cut(x))]

    bag, urls = {0: collections.Counter(), 1: collections.Counter()}, collections.Counter()
    for _, url, _ in pages:
        t = tokens(url)
        bad = int(any(x[2:] in url_filter.SEEDS for x in t))
        bag[bad].update(t)
        urls[bad] += 1
    kinds = len(set(bag[0]) | set(bag[1]))
    n = {k: sum(v.values()) for k, v in bag.items()}
    out = []
    for page, url, _ in pages:
        odds = math.log(urls[1] / urls[0]) + sum(math.log((bag[1][x] + 1) / (n[1] + kinds)) - math.log((bag[0][x] + 1) / (n[0] + kinds)) for x in tokens(url))
        h, p = split[url]
        fit = max(((len(a + b), a + b, v) for a, b, v in url_filter.RULES if (h == a or h.endswith("." + a)) and p.startswith(b)), default=(0, None, "block" if odds > 0 else "allow"))
        out.append((page, h, p, *fit[1:], round(1 / (1 + math.exp(-odds)), 9)))
    return sorted(out, key=str)


def test_url_filter(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    clash = df.select("*", *(F.lit("x").alias(c) for c in ("host", "path", "n", "run", "tokens", "word", "r", "odds", "weight", "rule")))
    got = sorted(((*r[:5], round(r.score, 9)) for r in url_filter.judge(clash).collect()), key=str)
    assert got == brute_judge(PAGES)
    by = {r[0]: r for r in got}
    assert by[2][4] == "block" and by[3][4] == "allow"  # cheappills is cheap and pills
    assert by[4][3:5] == ("example.org/es/", "block") and by[5][3:5] == ("example.org/en/1", "block") and by[6][3] == "org/" and by[7][3] is None and by[15][3] == "org/"


def test_url_filter_of_odd_tables(spark):
    schema = "page_id bigint, url string, html string"
    assert url_filter.judge(spark.createDataFrame([], schema)).count() == 0
    clean = url_filter.judge(spark.createDataFrame([(1, "http://a.net/x", "a"), (2, None, None)], schema)).collect()
    assert [r.verdict for r in clean] == ["allow", "allow"]
    long = [(1, "http://h.net/" + "ab-1/" * 100_000, ""), (2, "http://" + "q" * 300_000, "<" * 1000), (3, "http://casino.net/", None)]
    assert {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(long, schema)).collect()}[3] == "block"


def test_split_run():
    known = {(0, 2): math.log(0.2), (2, 3): math.log(0.2)}
    assert url_filter.split_run("abcde", known, 100) == ["ab", "cde"]
    assert url_filter.split_run("", {}, 10) == []


def fixture(rows=400, dims=7, seed=1):
    g = np.random.default_rng(seed)
    x = (g.normal(size=(rows, dims)) * np.arange(1, dims + 1) * 0.3 + 0.2).astype(np.float32)
    x[rows // 2 :: 3] = x[0]  # a third of copies
    return [(i, [float(v) for v in r]) for i, r in enumerate(x)]


def brute_whiten(rows, wanted=4):
    x = {i: np.floor(np.array(v, np.float64) * 256).astype(np.int64) for i, v in rows}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, total = len(fit), fit.sum(axis=0)
    c = (fit * n - total) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    return n, e, {i: ([int(d) for d in [((r * n - total).astype(object) ** 2).sum()]][0], ((r * n - total) / n) @ v[:, :wanted] / np.sqrt(e[:wanted])) for i, r in x.items()}


SCHEMA = "vec_id bigint, embedding array<float>"


def test_whitening(spark):
    rows = fixture()
    odd = [(9001, None), (9002, [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0]), (9003, [float("nan")] * 7), (9004, [float("inf")] * 7), (9005, [1.0]), (9006, [])]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(4)
    clash = df.select("*", *(F.lit("x").alias(c) for c in ("x", "n", "component", "deviation", "at", "v", "d", "count")))
    got = whitening.whiten(clash).collect()
    n, e, want = brute_whiten(rows)
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n}
    sign = {}
    for r in got:
        deviation, w = want[r.vec_id]
        s = sign.setdefault(r.component, 1.0 if r.whitened * w[r.component - 1] > 0 else -1.0)
        assert r.deviation == deviation and abs(s * r.whitened - w[r.component - 1]) < 1e-9
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-9 and r.identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make([(1, []), (2, None)])).count() == 0
    one = whitening.whiten(make([(1, [0.5, -0.5]), (1, [0.5, -0.5]), (None, [0.5, -0.5])])).collect()
    assert len(one) == 6 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in one)
    line = whitening.whiten(make([(i, [i / 4, -i / 4, 0.0]) for i in range(9)])).collect()  # one dimension of three varies
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True), (3, True)}
    assert {round(r.explained, 12) for r in line} == {1.0, 0.0} and all(r.identity_error < 1e-9 for r in line)
    big = whitening.whiten(spark.createDataFrame([(i, [float(2**40 + i), float(i * i)]) for i in range(30)], "vec_id bigint, embedding array<double>")).collect()
    n, e, want = brute_whiten([(i, [float(2**40 + i), float(i * i)]) for i in range(30)], 2)
    assert all(r.deviation == want[r.vec_id][0] and abs(abs(r.whitened) - abs(want[r.vec_id][1][r.component - 1])) < 1e-6 for r in big)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e16, 0.0]), (2, [-1e16, 1.0]), (3, [1e300, 1.0])], "vec_id bigint, embedding array<double>")).collect()
    assert {r.vec_id for r in huge} == {1, 2} and all(r.deviation is None for r in huge)


def test_exact_sums_beyond_a_long():
    x = np.array([[2**61, -(2**61)], [2**61 - 1, 5]], np.int64)
    t, d = whitening.spread(x, 2, [2**62 - 1, 5 - 2**61])
    assert d == [sum(int(v) ** 2 for v in row) for row in t] and t[0][0] == 1


def test_language_of_long_texts_is_counted_in_pieces(spark):
    import random

    from pathledger.llm import langid

    r = random.Random(5)
    text = "".join(r.choice("ab ßÉ\n1.  \U0001F600日") for _ in range(3000))
    data = np.frombuffer(text.encode(), np.uint8)
    bucket, _, some = langid.gram_buckets(data, np.array([0, len(data)]))
    want = np.bincount(bucket, minlength=1 << langid.BITS)
    for piece in (1, 2, 3, 7, 100, 10**6):
        got, any_letter = langid.histogram(data, piece)
        assert (got == want).all() and any_letter == bool(some[0])
    assert not langid.histogram(np.frombuffer(b"12 3 " * 50, np.uint8), 7)[1] and langid.histogram(data[:0])[0].sum() == 0
    model = langid.Model(["x", "y"], np.ones(1 << langid.BITS), np.random.default_rng(1).normal(size=(1 << langid.BITS, 2)), np.zeros(2))
    assert np.allclose(model.logits_of(want), model.logits(bucket, np.zeros(len(bucket), np.int64), 1))
    long = ["the house " * 150_000, "das haus " * 150_000, " 1" * 700_000]
    rows = [(i, t[:60] if i > 2 else t, ("en", "de")[i % 2] if i % 3 != 2 else None) for i, t in enumerate([*long, *(["the house is on the hill", "das haus ist auf dem berg"] * 30)])]
    rows = [(i, t, ("en" if "the" in t else "de") if i > 2 else None) for i, t, _ in rows]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    clash = df.select("*", *(F.lit("x").alias(c) for c in ("bucket", "n", "score", "held_out", "b", "tf")))
    assert [x.lang_pred for x in langid.identify(clash).orderBy("doc_id").limit(3).collect()] == ["en", "de", "und"]


def test_quality_of_long_texts_in_pieces(spark):
    import random

    from pathledger.llm import quality

    r, g = random.Random(7), np.random.default_rng(7)
    say = lambda: r.choice(["", "A line.", "a line", "| x | y |", "zz" * r.randint(1, 60), "Ünï cödé!", "a line", "\r", " "])
    crf = quality.Crf(g.normal(size=61) / 4, g.normal(size=(2, 2)), 1 / np.maximum(g.random(61), 0.2), 1.3, 0.2)
    for lines in (1, 2, 5, 1023, 1024, 1025, 2049, 5000):
        data = np.frombuffer("\n".join(say() for _ in range(lines)).encode() + b"\nend", np.uint8)
        want = crf.documents(*quality.line_features(data, np.array([0, len(data)])))
        for most in (1, 50, 10**6) if lines < 1100 else (3000,):
            assert np.allclose(crf.long_document(data, most), want, atol=1e-6), (lines, most)
    steep = quality.Crf(g.normal(size=61) * 30, g.normal(size=(2, 2)) * 5, np.ones(61))
    assert np.allclose(steep.long_document(data, 999), steep.documents(*quality.line_features(data, np.array([0, len(data)]))), atol=1e-4)
    for n in (1, 5, 1024, 3000):
        u = g.normal(size=n) * 40
        t = g.normal(size=(2, 2)) * 6
        assert np.allclose(quality.one_chain(u, t), quality.marginals(u, np.array([0, n]), t)[0], atol=1e-12)
    blank = np.frombuffer(b"\n" * 40, np.uint8)
    assert np.allclose(crf.long_document(blank, 7), crf.documents(*quality.line_features(blank, np.array([0, 40]))))
    beside = np.frombuffer(b"End.Start", np.uint8)  # an empty text takes nothing from its neighbours
    alone = crf.documents(*quality.line_features(blank[:0], np.array([0, 0])))
    assert np.allclose(crf.documents(*quality.line_features(beside, np.array([0, 4, 4, 9])))[1], alone[0])


def test_quality_without_labels_and_with_clashing_columns(spark):
    from pathledger.llm import quality

    docs = spark.createDataFrame([(1, "a\n" * 600_000), (2, "Some text."), (3, None), (3, None)], "doc_id bigint, text string")
    docs = docs.select("*", *(F.lit("x").alias(c) for c in ("quality", "x", "size", "lines", "score")))
    got = quality.classify(docs, spark.createDataFrame([], "doc_id bigint, quality int")).collect()
    assert len(got) == 4 and all(x.score == 0.5 for x in got)
