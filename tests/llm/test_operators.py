"""Each operator against a brute-force version on a small fixture with nulls, empty and long texts, copies, repeated
rows, clashing columns, and on an empty table."""

import collections
import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathledger.llm import decontaminate, induced, jaccard_join, langid, lm_score, quality, sentencepieces, sharding, spotsigs, suffix_dedup, warc

R = random.Random(3)
WORDS = ["".join(R.choice("abcdefg") for _ in range(R.randint(2, 7))) for _ in range(300)]
SAY = lambda n: " ".join(R.choice(WORDS) for _ in range(n))
BASE = [SAY(60) for _ in range(12)]
NEAR = BASE[0].split()
NEAR[30] = "zzz"
TEXTS = [*BASE, BASE[3], BASE[3], " ".join(NEAR), BASE[5] + " " + SAY(40), SAY(20) + " " + BASE[7], None, "", "   \n", "one", "Ünï cödé ▁ \U0001F600 ñ", SAY(4000), "a" * 700]
DOCS = [(i, t, "en" if i % 2 else "de") for i, t in enumerate(TEXTS)]
DOCS.append((3, TEXTS[3], "en"))  # a repeated row
CLASH = ["shard", "bin", "key", "score", "h", "size", "rank", "n"]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string")
    return d.withColumns({c: F.lit("x") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def unique(spark):
    return spark.createDataFrame(DOCS[:-1], "doc_id bigint, text string, lang string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_sharding(docs, empty):
    got = sharding.shard_by_bytes(docs, 4, bins=5).collect()
    assert len(got) == len(DOCS)
    size = collections.Counter()
    for r in got:
        size[r.shard] += r.size
    want = sum(len((t or "").encode()) + 1 for _, t, _ in DOCS)
    assert sum(size.values()) == want
    assert all(abs(v - want / 4) <= max(len((t or "").encode()) + 1 for _, t, _ in DOCS) for v in size.values())
    for s in size:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    order = [r.shard for r in sorted(got, key=lambda r: (r.doc_id, r.slot))]
    assert order == sorted(order)
    assert sharding.shard_by_bytes(empty).count() == 0


def test_bins_of_wide_and_clustered_ids(spark):
    from pathledger.llm.common import id_bins

    ids = [-9 * 10**18, 9 * 10**18, *range(3000), *([77] * 400)]
    d = spark.createDataFrame([(i,) for i in ids] + [(None,)], "k bigint").withColumn("w", F.lit(1))
    add, weights = id_bins(d, "k", F.col("w"), bins=50)
    rows = [(r.k, r.bin) for r in add(d).collect()]
    got = collections.Counter(b for _, b in rows)
    assert dict(got) == {b: w for b, w in weights.items() if w}
    assert all(w <= len(ids) // 50 + 1 for b, w in got.items() if b != dict(rows)[77])
    order = [b for k, b in sorted(r for r in rows if r[0] is not None)]
    assert order == sorted(order) and dict(rows)[None] == -1


def test_sharding_of_wide_and_repeated_ids(spark):
    rows = [(-9 * 10**18, "a"), (9 * 10**18, "b"), (None, "n"), *((5, "same") for _ in range(300)), *((5, f"t{i}") for i in range(200)), *((i, "x" * (i % 7)) for i in range(400))]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), 4, bins=20).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    for s in range(4):
        mine = [r for r in got if r.shard == s]
        assert abs(sum(r.size for r in mine) - total / 4) <= 8 and sorted(r.slot for r in mine) == list(range(len(mine)))
    order = [r.shard for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.shard))]
    assert order == sorted(order)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_jaccard_join(docs, empty):
    for n, percent in ((3, 90), (5, 80), (3, 60)):
        sets = {}
        for i, t, _ in DOCS:
            w = words(t)
            sets[i] = set(zip(*[w[k:] for k in range(n)])) if len(w) >= n else ({tuple(w)} if w else set())
        root = {i: i for i in sets}
        for _ in sets:
            for a in sets:
                for b in sets:
                    if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        root[a] = root[b] = min(root[a], root[b])
        got = jaccard_join.jaccard_join(docs, shingle=n, percent=percent).collect()
        assert len(got) == len(DOCS)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), root[i]) for i, s in sets.items()}
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_metric_join_of_dense_regions_is_exact():
    r = np.random.default_rng(1)
    for spread in (5, 20, 60):
        core = r.integers(0, 2**62, 120).astype(np.uint64)
        sets = []
        for _ in range(150):
            s = core.copy()
            k = r.integers(0, spread)
            s[r.integers(0, 120, k)] = r.integers(0, 2**62, k).astype(np.uint64)
            sets.append(np.unique(s))
        s = jaccard_join.Sets(list(range(150)), sets, 90)
        s.join(np.arange(150))
        t = jaccard_join.Sets(list(range(150)), sets, 90)
        for i in range(150):
            for j in range(i):
                if t.linked(i, j):
                    t.union(i, j)
        assert [b for _, b in s.edges()] == [b for _, b in t.edges()]


def brute_links(sets, percent):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.fixture(scope="module")
def crowd(spark):
    """Groups of near copies at several distances, a passage that many share, and loners."""
    r, rows = random.Random(11), []
    passage = [f"p{k}" for k in range(30)]
    for g in range(6):
        core = [f"g{g}w{k}" for k in range(80)]
        for _ in range(25):
            w = list(core)
            for _ in range(r.randint(0, 4 * (g + 1))):
                w[r.randrange(len(w))] = f"e{r.randrange(10**9)}"
            rows.append(" ".join(w))
    rows += [" ".join([*(f"l{k}x{j}" for j in range(40)), *passage]) for k in range(40)]
    r.shuffle(rows)
    return spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string"), dict(enumerate(rows))


@pytest.mark.parametrize("percent", [60, 80, 90])
@pytest.mark.parametrize("cell", [2_000_000, 300])
def test_jaccard_join_of_a_dense_corpus(crowd, percent, cell, monkeypatch):
    """With cells of 300 elements everything goes through the distributed division."""
    if cell == 300:
        monkeypatch.setattr(jaccard_join, "LEAF", 4)
    docs, texts = crowd
    want = brute_links({i: set(zip(*[t.split()[k:] for k in range(3)])) for i, t in texts.items()}, percent)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(docs, shingle=3, percent=percent, cell_shingles=cell).collect()}
    assert got == want
    assert 6 <= len(set(want.values())) < len(want)


def test_links_come_from_pivots_and_windows(monkeypatch):
    """In a dense cell pivots and their windows settle every link; the prefix filter isn't needed."""
    r = np.random.default_rng(5)
    core = r.integers(0, 2**62, 200).astype(np.uint64)
    sets = []
    for _ in range(40):
        s = core.copy()
        k = r.integers(0, 30)
        s[r.integers(0, 200, k)] = r.integers(0, 2**62, k).astype(np.uint64)
        sets.append(np.unique(s))
    monkeypatch.setattr(jaccard_join.Sets, "leaf", lambda *_: pytest.fail("prefix filter"))
    s = jaccard_join.Sets(list(range(40)), sets, 90)
    s.join(np.arange(40), 0)
    want = brute_links({i: set(x.tolist()) for i, x in enumerate(sets)}, 90)
    assert dict(enumerate(b for _, b in s.edges())) == want


def test_equal_hashes_need_equal_words(spark):
    """Two Thue-Morse words that differ everywhere collide under any polynomial modulo 2**64."""
    w = "a"
    while len(w) < 4096:
        w += w.translate(str.maketrans("ab", "ba"))
    rows = [(1, w), (2, w.translate(str.maketrans("ab", "ba"))), (3, w)]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=3, percent=90).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_linked_sets_share_a_part():
    r = np.random.default_rng(2)
    for percent in (34, 60, 67, 80, 90):
        for _ in range(60):
            n = int(r.integers(1, 60))
            a = np.unique(r.integers(0, 2**62, n).astype(np.uint64))
            extra = int(len(a) * (100 / percent - 1))
            b = np.unique(np.concatenate([a, r.integers(0, 2**62, extra).astype(np.uint64)]))
            doc, key = jaccard_join.part_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
            same = len(a) == len(b)
            assert same or set(key[doc == 0].tolist()) & set(key[doc == 1].tolist())


def test_suffix_and_lcp_arrays():
    r = np.random.default_rng(0)
    for n in (1, 2, 3, 8, 60, 200):
        for a in (1, 2, 3, 10):
            for _ in range(6):
                t = r.integers(0, a, n)
                t = np.tile(t[: max(1, n // 3)], 4) if r.random() < 0.3 else t
                order, lcp = induced.suffix_array(t, memory=5)
                s = list(t)
                want = sorted(range(len(s)), key=lambda i: s[i:])
                assert list(order) == want
                for k in range(1, len(s)):
                    x, y = s[want[k - 1] :], s[want[k] :]
                    m = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
                    assert lcp[k] == m


def brute_removal(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        m = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                m[p : p + length] = True
            seen.add(b[p : p + length])
        spans = int((np.diff(np.concatenate([[0], m.astype(int), [0]])) == 1).sum())
        out[i] = (len(b), int(m.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~m])).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup(unique, empty, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    got = suffix_dedup.dedup(unique).collect()
    want = brute_removal([(i, t) for i, t, _ in DOCS[:-1]], 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert suffix_dedup.dedup(empty).count() == 0


def test_decontamination(spark, docs, empty):
    passage = BASE[2].split()[10:40]
    changed = list(passage)
    changed[4] = changed[11] = changed[19] = "qqq"
    bench = spark.createDataFrame([(1, " ".join(changed).upper()), (2, SAY(30)), (3, None), (4, "lonely short"), (5, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {(2, 1): 27}
    blocks = decontaminate.decontaminate(docs, bench, block_bytes=64)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == {(2, 1)}
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 0


def test_best_segment_against_all_runs():
    r = np.random.default_rng(4)
    for _ in range(400):
        same = r.random(r.integers(1, 30)) < 0.8
        least = int(r.integers(1, 16))
        runs = [(int(same[a:b].sum()), b - a, -a) for b in range(len(same) + 1) for a in range(b - least + 1) if 100 * same[a:b].sum() >= 80 * (b - a)]
        want = max(runs, default=None)
        assert decontaminate.best_segment(same, 0.8, least) == (want and (-want[2], want[1] - want[2], want[0]))


def test_decontamination_counts_replaced_last_words(spark):
    item = [f"i{k}" for k in range(15)]
    cases = [(1, 15, 3), (2, 14, 2), (3, 13, 1), (4, 8, 1)]
    bench = spark.createDataFrame([(i, " ".join(item[:n])) for i, n, _ in cases], "item_id bigint, text string")
    for i, n, cut in cases:
        d = spark.createDataFrame([(7, " ".join([*item[: n - cut], *["x"] * cut, "and", "more"]))], "doc_id bigint, text string")
        got = {r.item_id: (r.matched, r.span_words) for r in decontaminate.decontaminate(d, bench).collect()}
        assert got[i] == (n - cut, n)


def test_masks_hit_every_pattern_of_allowed_substitutions():
    import itertools

    def all_hit(masks, n, k):
        bits = [[sum(1 << (a + i) for i, c in enumerate(m) if c == "1") for a in range(n - len(m) + 1)] for m in masks]
        left = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(n), k)], np.int64)
        for b in itertools.chain(*bits):
            left = left[left & b != 0]
        return not len(left)

    for item in range(1, 31):
        for least, similarity in ((13, 0.8), (8, 0.8), (13, 0.9), (6, 0.7)):
            short = min(item, least)
            for n in range(short, min(item, 2 * short - 1) + 1):
                k = decontaminate.allowed(n, similarity)
                assert k == max(x for x in range(n) if 100 * (n - x) >= round(100 * similarity) * n)
                assert all_hit(decontaminate.masks_for(item, least, similarity), n, k), (item, least, similarity, n)


def test_decontamination_finds_substitutions_anywhere(spark):
    cases = [(1, 13, (3, 8)), (2, 15, (2, 7, 9)), (3, 8, (3,)), (4, 5, (2,)), (5, 3, ())]
    item = {i: [f"i{i}w{k}" for k in range(n)] for i, n, _ in cases}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in item.items()], "item_id bigint, text string")
    rows = [(i, " ".join(["so", *("x" if k in cut else w for k, w in enumerate(item[i])), "on"])) for i, _, cut in cases]
    got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert got == {(i, i): n - len(cut) for i, n, cut in cases}


def brute_backoff(rows, order, backoff, leave_out):
    def grams(w):
        out = collections.Counter()
        for n in range(1, order + 1):
            pad = ["<s>"] * (n - 1) + w
            out.update(tuple(pad[k : k + n]) for k in range(len(w)))
        for n in range(1, order):
            out["<s>",] += 0
            out[("<s>",) * n] += bool(w)
        return out

    texts = [(i, words(t)) for i, t in rows]
    every, total = collections.Counter(), sum(len(w) for _, w in texts)
    for _, w in texts:
        every.update(grams(w))
    score, backs, n_words = collections.Counter(), collections.Counter(), collections.Counter()
    for i, w in texts:
        own = grams(w) if leave_out else collections.Counter()
        n_words[i] += len(w)
        score[i] += 0
        for k in range(len(w)):
            for n in range(order, 0, -1):
                g = tuple((["<s>"] * (n - 1) + w)[k : k + n])
                c = every[g] - own[g]
                if n == 1:
                    rest = total - (len(w) if leave_out else 0)
                    score[i] += math.log(max(c, 1) / max(rest, 1)) + (order - 1) * math.log(backoff)
                    backs[i] += order > 1
                elif c > 0:
                    score[i] += math.log(c / (every[g[:-1]] - own[g[:-1]])) + (order - n) * math.log(backoff)
                    backs[i] += n < order
                    break
    return score, backs, n_words


@pytest.mark.parametrize("message", [lm_score.MESSAGE_WORDS, 500])
@pytest.mark.parametrize(("order", "leave_out"), [(3, True), (3, False), (2, True), (4, True), (1, False)])
def test_stupid_backoff(spark, docs, order, leave_out, message, monkeypatch):
    monkeypatch.setattr(lm_score, "MESSAGE_WORDS", message)
    rows = [*((i, t) for i, t, _ in DOCS), (None, "a b"), (None, "a b"), (40, "a b c"), (41, "the the the")]
    if order == 3:  # more than 65,536 words
        rows += [(1000 + k, " ".join(f"w{j} x{j}" for j in range(k * 100, k * 100 + 101))) for k in range(400)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in CLASH})
    got = {r.doc_id: r for r in lm_score.stupid_backoff(d, order=order, leave_out=leave_out).collect()}
    score, backs, n_words = brute_backoff(rows, order, 0.4, leave_out)
    assert set(got) == set(n_words)
    for i in got:
        assert got[i].n_words == n_words[i]
        assert got[i].log_score == pytest.approx(score[i], rel=1e-9, abs=1e-6), i
        assert got[i].backoffs == backs[i]
        assert (got[i].mean_score is None) == (n_words[i] == 0)
    assert leave_out or sum(backs.values()) == 0


def test_backoff_of_empty_tables_and_hot_ngrams(spark, empty):
    assert lm_score.stupid_backoff(empty).count() == 0
    d = spark.createDataFrame([(i, "of the of the of the") for i in range(300)], "doc_id bigint, text string").repartition(4)
    rows = lm_score.stupid_backoff(d).collect()
    assert len(rows) == 300 and len({r.log_score for r in rows}) == 1 and rows[0].backoffs == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/ü", "x"), (1, None, "x"), (9, "u", ""), (2, "u", None), (7, "u", "é" * 5000), (7, "u", "é" * 5000), (None, "n", "lone"), (3, "a\r\nb", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("shard", F.lit(1))
    for roll in (1, 1 << 20):
        folder = f"file://{tmp_path}/{roll}"
        got = warc.read_warc(warc.write_warc(pages, folder, shards=3, roll_bytes=roll), folder).collect()
        assert len(got) == len(rows)
        by = collections.defaultdict(list)
        for r in got:
            by[r.page_id].append((r.record_type, r.refers_to))
        assert by[5] == [("response", None)] and by[1] == by[3] == [("revisit", 5)]
        assert by[9] == [("response", None)] and by[2] == [("revisit", 9)]
        assert sorted(by[7], key=str) == [("response", None), ("revisit", 7)]
        assert {r.page_id: r.payload_bytes for r in got}[7] == 10_000
        assert {r.page_id: r.payload_digest for r in got}[1] == warc.digest(b"x")
    a = [r.sha256 for r in warc.write_warc(pages, f"file://{tmp_path}/a", shards=3).orderBy("file").collect()]
    b = [r.sha256 for r in warc.write_warc(pages.repartition(5), f"file://{tmp_path}/b", shards=3).orderBy("file").collect()]
    assert a == b and (tmp_path / "a" / "_MANIFEST.json").exists()
    assert warc.write_warc(pages.limit(0), f"file://{tmp_path}/e").count() == 0


def test_fingerprints(unique, empty):
    got = {r.doc_id: r for r in spotsigs.fingerprint_with_edit(unique).collect()}
    texts = [t or "" for t in TEXTS]
    assert sorted(got) == list(range(len(texts)))
    for i, t in enumerate(texts):
        nxt, q = texts[(i + 1) % len(texts)], len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
    assert got[3].fingerprint == got[12].fingerprint == got[13].fingerprint != got[4].fingerprint
    assert got[12].near_next == 1.0 and got[17].fingerprint == got[18].fingerprint
    assert spotsigs.fingerprint_with_edit(empty).count() == 0
    near = {r.doc_id: r.component_id for r in spotsigs.near_duplicates(unique).collect()}
    assert near[12] == near[13] == 3 and near[4] == 4
    assert {i: r.near_group for i, r in got.items()} == near
    sets = {i: set(x.tolist()) for i, x in enumerate(spotsigs._lists(texts))}
    for i in got:  # likeness of the printed fingerprints
        e, n = texts[i], texts[(i + 1) % len(texts)]
        parts = lambda t: {t[k : k + spotsigs.HEX] for k in range(0, len(t), spotsigs.HEX)}
        mine, edited, nxt = parts(got[i].fingerprint), parts(got[i].edited_fingerprint), parts(got[(i + 1) % len(texts)].fingerprint)
        assert got[i].near_edited == pytest.approx(len(mine & edited) / len(mine | edited))
        assert got[i].near_next == pytest.approx(len(mine & nxt) / len(mine | nxt))
    assert near == brute_links(sets, 80)


def test_fingerprint_groups_against_brute_force(crowd):
    docs, texts = crowd
    sets = dict(enumerate(set(x.tolist()) for x in spotsigs._lists([texts[i] for i in range(len(texts))])))
    for percent in (70, 80):
        got = {r.doc_id: r.component_id for r in spotsigs.near_duplicates(docs, percent).collect()}
        assert got == brute_links(sets, percent)
    assert len(set(got.values())) < len(got)


def test_signatures_are_chains_after_common_words():
    """The rule, word by word: an anchor with the three content words after it, and content that no such chain holds."""
    text = "alpha the beta gamma delta epsilon zeta of the eta theta iota kappa"
    anchors = set(spotsigs.ANCHORS)
    w = text.split()
    content = [k for k, x in enumerate(w) if x not in anchors]
    chains = set()
    for at, name in [(-1, "^"), *((k, x) for k, x in enumerate(w) if x in anchors)]:
        chains.add((name, *[w[k] for k in content if k > at][:3]))
    held = {x for c in chains for x in c[1:]}
    for k in content:
        if w[k] not in held:
            chains.add(("", *[w[j] for j in content if j >= k][:3]))
    assert len(spotsigs._lists([text])[0]) == len(chains)
    again = spotsigs._lists([text.replace("kappa", "lambda")])[0]
    changed = {c for c in chains if "kappa" in c}
    assert len(np.setdiff1d(spotsigs._lists([text])[0], again)) == len(changed)



def test_signatures_cover_texts_without_anchors(spark):
    plain = [f"слово{k}" for k in range(60)]
    for text in (plain, [*"the cat sat on the mat".split(), *plain, "of", "it"]):
        for k in range(6, 60):
            a, b = spotsigs._lists([" ".join(text), " ".join([*text[:k], "другое", *text[k + 1 :]])])
            assert 0.8 < spotsigs.pruned_jaccard(a, b) < 1, k
    rows = [(1, " ".join(plain)), (2, " ".join([*plain[:3], *(f"z{k}" for k in range(60))]))]
    got = {r.doc_id: r for r in spotsigs.fingerprint_with_edit(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].fingerprint != got[2].fingerprint and got[1].near_next < 0.1 and 0.4 < got[1].near_edited < 0.6


def test_quality(spark, empty):
    good = [(i, SAY(30) + ".\n" + SAY(20) + ".", 1) for i in range(160)]
    bad = [(200 + i, "\n".join(f"{w}$$$ {w} | {w} ###" for w in SAY(12).split()), 0) for i in range(160)]
    rows = good + bad
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id bigint, text string").withColumn("quality", F.lit(1))
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.classify(d, labels).collect()}
    held = [(i, q) for i, _, q in rows if got[i].held_out]
    assert len(held) > 40 and np.mean([got[i].predicted == q for i, q in held]) > 0.95
    assert got[900].score == got[901].score and 0 <= got[900].score <= 1
    crf = quality.train(d.limit(0), labels)
    assert quality.score(d, crf).count() == len(rows) + 2 and quality.classify(d.limit(0), labels).count() == 0
    r = np.random.default_rng(0)
    first, unary, trans = np.array([0, 3, 4, 8]), r.normal(size=8), r.normal(size=(2, 2))
    p, _, _ = quality.marginals(unary, first, trans)
    import itertools

    for a, b in zip(first[:-1], first[1:]):
        w = np.zeros((b - a, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            s = math.exp(sum(unary[a + i] * v for i, v in enumerate(y)) + sum(trans[u, v] for u, v in zip(y, y[1:])))
            for i, v in enumerate(y):
                w[i, v] += s
        assert np.allclose(p[a:b], w[:, 1] / w.sum(axis=1))


def test_language(spark, empty):
    syl = {"xx": ["ka", "lo", "mi"], "yy": ["sch", "ein", "ung"]}
    rows = [(i, " ".join("".join(R.choice(syl[x]) for _ in range(3)) for _ in range(20)), x) for i in range(200) for x in [["xx", "yy"][i % 2]]]
    d = spark.createDataFrame([*rows, (500, None, None), (501, "123 !!", None), (502, "", "xx")], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(d).collect()}
    held = [(i, x) for i, _, x in rows if got[i].held_out]
    assert len(held) > 20 and all(got[i].lang_pred == x for i, x in held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (500, 501, 502))
    assert langid.identify(empty).count() == 0


def test_sampled_pieces(docs, empty):
    e = sentencepieces.encode(docs, samples=3, with_ids=True)
    rows = e.collect()
    text = {i: t or "" for i, t, _ in DOCS}
    by = collections.defaultdict(set)
    for r in rows:
        assert r.round_trip and 0 <= r.inclusion <= 1  # a very long text's may underflow
        by[r.doc_id].add(tuple(r.ids))
    assert {i for i in by} == set(text) and len(by[0]) == 3 and len(by[18]) == 1
    assert {(r.doc_id, r.text) for r in sentencepieces.decode(e).collect()} == set(text.items())
    assert sentencepieces.encode(empty).count() == 0


def test_sampling_without_replacement_follows_the_lattice():
    v = sentencepieces.Vocabulary()
    raw, n = b" hat in", 4000
    pieces = {b: i for i, b in reversed(list(enumerate(v.bytes_of))) if b and i >= 259}
    p = {}

    def walk(at, ids, w):
        if at == len(raw):
            p[tuple(ids)] = w
        for k in range(1, v.most + 1):
            b = raw[at : at + k]
            if len(b) == k and b in pieces:
                walk(at + k, [*ids, pieces[b]], w * v.weight[pieces[b]])

    walk(0, [], 1.0)
    z = sum(p.values())
    data = np.frombuffer(raw * n, np.uint8)
    from pathledger.llm import textcore as tc

    lat, paths, kappa = sentencepieces.sample_chunk(v, data, np.arange(n + 1) * len(raw), tc.mix(np.arange(n).astype(np.uint64)), 3)
    drawn = [[tuple(x.tolist()) for x in np.split(path.pieces(lat), path.at[1:-1])] for path in paths]
    assert all(len(path.docs) == n for path in paths) and all(len(set(x)) == 3 for x in zip(*drawn))
    q = {a: x / z for a, x in p.items()}
    want = [q, collections.Counter(), collections.Counter()]
    for a, x in q.items():
        for b, y in q.items():
            if a != b:
                two = x * y / (1 - x)
                want[1][b] += two
                for c, w in q.items():
                    if c not in (a, b):
                        want[2][c] += two * w / (1 - x - y)
    for got, share in zip(drawn, want):
        seen = collections.Counter(got)
        assert 0.5 * sum(abs(seen[k] / n - share[k]) for k in q) < 0.02
    # weighted by the inverse of their inclusion, the samples estimate any sum over all segmentations without bias
    lp = np.stack([path.log_prob for path in paths])
    assert all(abs(math.log(q[a]) - x) < 1e-6 for a, x in zip(drawn[2], paths[2].log_prob))
    assert (np.diff(np.stack([*lp, lp[0]]), axis=0) != 0).any()
    ratio = np.exp(lp) / -np.expm1(-np.exp(lp - kappa))
    length = np.array([[len(x) for x in d] for d in drawn])
    assert abs(ratio.sum(axis=0).mean() - 1) < 0.02
    assert abs((ratio * length).sum(axis=0).mean() - sum(q[a] * len(a) for a in q)) < 0.1


def test_a_text_without_spaces_takes_linear_time(spark):
    r = random.Random(8)
    d = spark.createDataFrame([(1, "".join(r.choice("abcdefgh") for _ in range(500_000)))], "doc_id bigint, text string")
    start = time.time()
    rows = sentencepieces.encode(d, samples=3).collect()
    assert len({x.ids_sha256 for x in rows}) == 3 and all(x.round_trip for x in rows)
    assert time.time() - start < 30  # a call for each byte took 100 microseconds


def test_units_finished_one_by_one_give_the_same_pieces(monkeypatch):
    from pathledger.llm import textcore as tc

    v, r = sentencepieces.Vocabulary(), random.Random(5)
    texts = [SAY(30), "", "\n\n", "Ünï cödé ▁ \U0001F600 ñ", "".join(r.choice("abcdeé\U0001F600") for _ in range(3000)), SAY(5), "aaaa"]
    parts = [f" {t}".encode() for t in texts]
    data, offs = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    got = []
    for few, stretch in ((0, 1 << 16), (8, 64), (10**9, 7), (10**9, 1 << 16)):
        monkeypatch.setattr(sentencepieces, "FEW", few)
        monkeypatch.setattr(sentencepieces, "STRETCH", stretch)
        lat, paths, kappa = sentencepieces.sample_chunk(v, data, offs, tc.mix(np.arange(len(texts)).astype(np.uint64)), 3)
        got.append(([p.pieces(lat).tolist() for p in paths], [p.docs.tolist() for p in paths], np.concatenate([*(p.log_prob for p in paths), kappa])))
    for pieces, kept, figures in got[1:]:
        assert pieces == got[0][0] and kept == got[0][1]
        assert np.allclose(figures, got[0][2], rtol=1e-9)
    assert [len(p) for p in got[0][0]] and b"".join(v.bytes_of[i] for i in got[0][0][0]) == data.tobytes()
