"""Near duplicates against brute force over all pairs."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventlake.llm import catalog, minhash
from eventlake.llm.components import components
from eventlake.llm.textcols import words

SF01 = "/root/testdata/sf0.01"


def grams(text):
    w = "".join(c.lower() if c < "\x80" else c for c in text or "").encode().split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def counted_texts(spark, rows):
    """The texts over which document frequencies are taken."""
    least = {}
    for d, t in rows:
        least[t or ""] = min(d, least.get(t or "", d))
    texts = spark.createDataFrame([(d, t) for t, d in least.items()], "id long, text string")
    later = {r.id for r in minhash.first_of_kind(minhash.signatures(texts).where("id IS NOT NULL")).collect()}
    return [t for t, d in least.items() if d not in later]


def frequencies(counted, theta):
    df = Counter(g for t in counted for g in grams(t))
    least = max(20, math.ceil(theta * len(counted)))
    return {g: min(1.0, math.log1p(len(counted) / c) / math.log1p(1 / theta)) for g, c in df.items() if c >= least}


def brute_links(rows, idf, threshold):
    """Weighted Jaccard of every pair that shares a shingle; ``idf`` has the common ones."""
    sets = [grams(t) for _, t in rows]
    ws = [{g: c * idf.get(g, 1.0) for g, c in s.items()} for s in sets]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    share = Counter()
    for g, at in where.items():
        for x in range(len(at)):
            for y in range(x):
                share[at[y], at[x]] += min(ws[at[y]][g], ws[at[x]][g])
    total = [sum(w.values()) for w in ws]
    return {(i, j): both / (total[i] + total[j] - both) for (i, j), both in share.items() if both / (total[i] + total[j] - both) >= threshold}


def classes_of(rows, links):
    parent = {i: i for i in range(len(rows))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    by_text = {}
    for i, (_, t) in enumerate(rows):
        j = by_text.setdefault(t or "", i)
        parent[find(i)] = find(j)
    for i, j in links:
        parent[find(i)] = find(j)
    out = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        out[find(i)].append(d)
    return {d: min(m) for m in out.values() for d in m}


def test_given_documents(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF01}/documents.parquet'").fetchall()
    want = classes_of(rows, brute_links(rows, frequencies(counted_texts(spark, rows), minhash.THETA), 0.8))
    got = {r.doc_id: r for r in catalog.op2_minhash(spark, SF01).collect()}
    assert len(got) == len(rows) and sum(1 for d, c in want.items() if d != c) > 50
    assert {d: r.class_id for d, r in got.items()} == want
    assert all(r.kept == (d == want[d]) for d, r in got.items())


def test_edited_copies(spark, make_docs):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 5)))
    line = " ".join(word() for _ in range(40))
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(30, 200))]
        for j in range(rng.randint(1, 6)):
            e = list(w)
            for _ in range(j):
                e[rng.randrange(len(e))] = word()
            rows.append((1000 - len(rows), " ".join(e) + (" " + line if i % 2 else "")))
    links = brute_links(rows, frequencies(counted_texts(spark, rows), 0.05), 0.8)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(make_docs(rows)).collect()}
    want = classes_of(rows, links)
    assert len(links) > 80
    assert all(want[d] <= c and want[d] == want[c] for d, c in got.items())          # never links more than brute force
    assert sum(got[d] != c for d, c in want.items()) <= 0.01 * len(rows)             # and finds it


def test_many_copies_of_one_original(spark, make_docs):
    """Copies alike to their original only, whose id is in the middle."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(400)]
    rows = [(100, " ".join(base))]
    for i in range(200):
        e = list(base)
        for at in rng.sample(range(400), 7):
            e[at] = word()
        rows.append((i if i < 100 else i + 1, " ".join(e)))
    rows += [(1000 + i, " ".join(word() for _ in range(400))) for i in range(3800)]     # the group is 5 % of the rows
    links = brute_links(rows, frequencies(counted_texts(spark, rows), 0.05), 0.8)
    among = sum(1 for i, j in links if rows[i][0] != 100 and rows[j][0] != 100)
    want = classes_of(rows, links)
    assert sum(1 for c in want.values() if c == 0) >= 195 and among < 0.2 * 200 * 199 / 2
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(make_docs(rows)).collect()}
    assert sum(got[d] != c for d, c in want.items()) <= 2


def test_copies_do_not_weigh_down_their_text(spark, make_docs):
    """A text with exact copies in a third of the rows, and a near copy of plain Jaccard 0.83."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    hot = [word() for _ in range(120)]
    near = [*hot[:110], *[word() for _ in range(10)]]
    both = len(grams(" ".join(hot)).keys() & grams(" ".join(near)).keys())
    assert 0.83 < both / (2 * 116 - both) < 0.85
    rows = [(i, " ".join(hot)) for i in range(50)] + [(50, " ".join(near))] + [(100 + i, " ".join(word() for _ in range(50))) for i in range(100)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(make_docs(rows)).collect()}
    assert got[49] == 0 and got[50] == 0 and got[100] == 100


def test_texts_of_one_id_are_one_document(make_docs):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    got = Counter((r.doc_id, r.class_id) for r in minhash.near_duplicates(make_docs([(8, a), (8, b), (3, b)])).collect())
    assert got == Counter({(8, 3): 2, (3, 3): 1})


def test_samples_agree_as_often_as_the_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 1 << 44, 300, dtype=np.uint64))
    wx, wy = rng.choice([0.4, 1, 2, 5], 300), rng.choice([0.4, 1, 2, 5], 300)
    wy[:150] = wx[:150]
    want = np.minimum(wx, wy).sum() / np.maximum(wx, wy).sum()
    doc = np.zeros(300, dtype=np.int64)
    _, a = minhash.sample(doc, h, wx, 1, 4000)
    _, b = minhash.sample(doc, h, wy, 1, 4000)
    assert abs((a == b).mean() - want) < 0.03
    assert abs(minhash.weighted_jaccard((h, wx), (h, wy)) - want) < 1e-9


def test_frequent_shingles_are_exact(spark, make_docs):
    rows = duckdb.sql(f"select doc_id, text from '{SF01}/documents.parquet'").fetchall() + [(5000 + i, "one common line of text here") for i in range(90)]
    texts = make_docs(rows).withColumnRenamed("doc_id", "id")
    counted = minhash.signatures(texts).where("id IS NULL").select(F.posexplode("keys").alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))
    idf = minhash.frequent_shingles(texts, counted, 0.05)
    want = sorted(round(x, 9) for x in frequencies([t for _, t in rows], 0.05).values())
    assert len(want) >= 2 and sorted(round(x, 9) for x in idf.idf.tolist()) == want


def test_long_documents_do_not_move_the_bound(spark, make_docs):
    """The share of texts that makes a shingle common is theta, however many shingles the mean text has."""
    common = " ".join(f"c{i}" for i in range(6))
    texts = make_docs([(d, f"{common} " + " ".join(f"{d}x{i}" for i in range(60_000))) for d in range(24)]).withColumnRenamed("doc_id", "id")
    counted = minhash.signatures(texts, bands=1, rows=1).where("id IS NULL").select(F.posexplode("keys").alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))
    idf = minhash.frequent_shingles(texts, counted, 0.05)
    assert idf.idf.tolist() == pytest.approx([math.log1p(1) / math.log1p(20)] * 2, abs=1e-12)


def test_cases(spark, make_docs):
    long = " ".join(str(i % 9000) for i in range(250_000))
    rows = [(1, ""), (2, None), (3, "a b"), (4, "A  b"), (5, "a b c"), (6, long), (7, long + " x"), (None, "a b"), (None, "only"), (None, "only"),
            (8, "q w e r t y"), (8, "q w e r t y"), (9, " ")]
    got = [(r.doc_id, r.class_id, r.kept) for r in minhash.near_duplicates(make_docs(rows)).collect()]
    assert Counter(got) == Counter([(1, 1, True), (2, 1, False), (3, 3, True), (4, 3, False), (5, 5, True), (6, 6, True), (7, 6, False), (None, 3, False),
                                    (None, None, True), (None, None, True), (8, 8, True), (8, 8, False), (9, 9, True)])
    docs = make_docs([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, id int, class_id string")
    left = minhash.one_of_each(docs)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter([1, 3, 5, 6, None, None, 8, 9])
    assert minhash.near_duplicates(make_docs([])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        if a != b:
            parent[max(x, y)] = min(x, y)
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: find(n) for n in nodes}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("text", ["", "a", "a b c d", "a b c d e f a b c d e"])
def test_shingles(text):
    w = next(iter(words(pa.array([text], type=pa.large_string()), lower=True)))
    _, h, tf = minhash.shingles(w)
    assert sorted(tf.tolist()) == sorted(grams(text).values()) and len(set(h.tolist())) == len(grams(text))


def hot_group(n_copies, n_other, words_each=400, edits=(2, 14), seed=11):
    """Copies of one original, edited at a few of its words, among other texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(words_each)]
    rows = []
    for _ in range(n_copies):
        e = list(base)
        for at in rng.sample(range(words_each), rng.randint(*edits)):
            e[at] = word()
        rows.append(" ".join(e))
    rows += [" ".join(word() for _ in range(words_each)) for _ in range(n_other)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("n_copies, n_other", [(100, 400), (60, 600), (200, 0)])
def test_recall_where_one_group_is_hot(spark, make_docs, n_copies, n_other):
    """Of all pairs with a Jaccard similarity of 0.8 or more, plain or weighted, few are in different classes."""
    rows = hot_group(n_copies, n_other)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(make_docs(rows)).collect()}
    for idf in ({}, frequencies(counted_texts(spark, rows), minhash.THETA)):
        pairs = brute_links(rows, idf, 0.8)
        lost = sum(got[rows[i][0]] != got[rows[j][0]] for i, j in pairs)
        assert len(pairs) > 200 and lost <= 0.01 * len(pairs)
    others = [d for d, t in rows if all(got[d] != got[e] for e, _ in rows if e != d)]
    assert len(others) >= n_other


def test_a_group_near_the_threshold(spark, make_docs):
    """Most pairs of the group fall short of 0.8; those that reach it are found."""
    rows = hot_group(150, 300, words_each=300, edits=(2, 5), seed=12)
    links = brute_links(rows, frequencies(counted_texts(spark, rows), minhash.THETA), 0.8)
    assert 0.01 < len(links) / (150 * 149 / 2) < 0.6
    want = classes_of(rows, links)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(make_docs(rows)).collect()}
    assert all(want[d] <= c and want[d] == want[c] for d, c in got.items())
    assert sum(got[rows[i][0]] != got[rows[j][0]] for i, j in links) <= 0.03 * len(links)


def test_signatures_where_nothing_is_common(spark, make_docs):
    texts = make_docs([(1, "a b c d e f"), (2, "")]).withColumnRenamed("doc_id", "id")
    none = spark.sparkContext.broadcast(minhash.Idf(np.zeros(1, np.uint64), np.array([0.5]), np.zeros(1 << 16, bool)))
    assert minhash.signatures(texts, none, only_common=True).count() == 0


def test_buckets_are_compared_in_full(spark):
    """All pairs of different classes in a bucket of any size, whatever the blocks."""
    rng = random.Random(4)
    rows = [(k, i, 1.0 + i % 3 / 20, rng.choice([0, 0, 0, i, 7])) for k, n in ((1, 150), (2, 40), (3, 2)) for i in rng.sample(range(200), n)]
    named = spark.createDataFrame(rows, "key long, id long, weight double, root long")
    want = {(max(x[1], y[1]), min(x[1], y[1])) for x in rows for y in rows if x[0] == y[0] and x[3] != y[3]}
    for block in (8, 1024):
        got = [tuple(r) for r in minhash.rest_pairs(named, 0.8, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_no_link_of_a_shared_bucket_is_lost(spark, make_docs):
    """Every pair at the threshold that shares a sample key ends in one class, in a group that mostly falls short of it."""
    rows = hot_group(150, 0, words_each=300, edits=(3, 7), seed=12)
    texts = make_docs(rows).withColumnRenamed("doc_id", "id")
    sigs = minhash.signatures(texts, None).where("id IS NOT NULL")
    none = spark.sparkContext.broadcast(minhash.Idf(np.zeros(0, np.uint64), np.zeros(0), np.zeros(1 << 16, bool)))
    root = {r.node: r.root for r in minhash.classes(sigs, texts, none, 0.8).collect()}
    keys = {r.id: set(r["keys"]) for r in sigs.collect()}
    links = [(rows[i][0], rows[j][0]) for i, j in brute_links(rows, {}, 0.8)]
    met = [(a, b) for a, b in links if keys[a] & keys[b]]
    assert len(met) > 5 and all(root.get(a, a) == root.get(b, b) for a, b in met)


def unlinked_group(n):
    """Copies of one text, each with about 28 % of its shingles edited: no two are near the threshold, most share a sample key."""
    return hot_group(n, 0, words_each=300, edits=(15, 20), seed=21)


def test_a_group_below_the_threshold_is_not_compared_pair_by_pair(make_docs, monkeypatch):
    rows, compared, verify = unlinked_group(250), [], minhash.verified_links

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verify(pairs, *rest)
    monkeypatch.setattr(minhash, "verified_links", counted)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(make_docs(rows)).collect()}
    assert all(d == c for d, c in got.items())
    assert len(compared) >= 3 and compared[-1] <= 2 * len(rows)        # of 31125 pairs


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_documents_at_the_threshold_meet_at_a_rare_shingle(spark, make_docs, threshold):
    """Whatever the weights, no pair at the threshold is left out, whether it shares a sample key or not."""
    rows = hot_group(120, 40, words_each=200, edits=(1, 8), seed=13)
    rows += [(1000 + i, " ".join(t.split()[:n])) for i, (_, t) in enumerate(rows[:40]) for n in [3 + 5 * i]] + [(2000, ""), (2001, " ".join(["a b c d e f"] * 30))]
    texts = make_docs(rows).withColumnRenamed("doc_id", "id")
    h = np.unique(np.concatenate([minhash.shingles(w)[1] for w in words(pa.array([t for _, t in rows], type=pa.large_string()), lower=True)]))
    some = h[::3]
    hot = np.zeros(1 << 16, bool)
    hot[minhash._bucket(some)] = True
    idf = spark.sparkContext.broadcast(minhash.Idf(some, np.linspace(0.05, 1, len(some)), hot))
    named = texts.withColumn("root", F.when(F.col("id") < 30, F.lit(0)).otherwise(F.col("id")))
    got = {tuple(r) for r in minhash.rest_pairs(minhash.rarest_shingles(named, idf, threshold), threshold, 16).collect()}
    sets = dict(zip([d for d, _ in rows], minhash._sets(pa.array([t for _, t in rows], type=pa.large_string()), idf.value), strict=True))
    root = lambda d: 0 if d < 30 else d
    links = {(a, b) for a in sets for b in sets if a > b and root(a) != root(b) and minhash.weighted_jaccard(sets[a], sets[b]) >= threshold}
    assert len(links) > 500 and links <= got
    assert all(a > b and root(a) != root(b) for a, b in got) and len(got) < len(rows) * (len(rows) - 1) / 2
