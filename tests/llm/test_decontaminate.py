"""Benchmark decontamination against a plain edit-distance search."""

import random

import duckdb
import pytest

from eventlake.llm import catalog, decontaminate as dc

SF01 = "/root/testdata/sf0.01"


def substring_distance(p, t):
    """Least edit distance of p to a substring of t (plain dynamic programme)."""
    col = list(range(len(p) + 1))
    best = col[-1]
    for ch in t:
        new = [0]
        for i, x in enumerate(p, 1):
            new.append(min(new[-1] + 1, col[i] + 1, col[i - 1] + (x != ch)))
        col = new
        best = min(best, col[-1])
    return best


def edit(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        op = rng.randrange(3)
        if op == 0:
            s[i] = rng.choice("abcxyz")
        elif op == 1:
            s.insert(i, rng.choice("abcxyz"))
        else:
            del s[i]
    return "".join(s)


def test_myers_matches_the_plain_programme():
    rng = random.Random(2)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + edit(rng, p, rng.randint(0, 4)) if len(p) > 5 else "abcab"
        assert dc.myers(dc.masks(p), len(p), t)[0] == substring_distance(p, t)


def test_edited_copies(make_docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(4, 30)))) for i in range(25)]
    rows = []
    for i in range(150):
        text = " ".join(word() for _ in range(60))
        if i % 2:
            it = rng.choice(items)[1]
            text = text + " " + edit(rng, it, rng.randint(0, 2 * dc.budget(len(it)))) + " " + text[:50]
        rows.append((i, text))
    bench = make_docs(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in dc.find_leaks(make_docs(rows), bench, block_chars=300).collect()}
    want = {}
    for d, t in rows:
        for i, p in items:
            n = substring_distance(dc.normalised(p), dc.normalised(t))
            if n <= dc.budget(len(dc.normalised(p))):
                want[d, i] = n
    assert len(want) > 20 and {k: r.distance for k, r in got.items()} == want
    text = dict(rows)
    for (d, i), r in got.items():
        assert substring_distance(dc.normalised(dict(items)[i]), dc.normalised(text[d])[r.start:r.end]) == r.distance
    left = {r.doc_id for r in dc.drop_leaks(make_docs(rows), bench, block_chars=300).collect()}
    assert left == {d for d, _ in rows} - {d for d, _ in want}


def test_given_documents(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF01}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{SF01}/benchmark.parquet'").fetchall()
    exact = {(d, i) for d, t in docs for i, p in items if dc.normalised(p) in dc.normalised(t)}
    got = {(r.doc_id, r.item_id) for r in catalog.op6_decontamination(spark, SF01).collect()}
    assert len(exact) > 5 and exact <= got
    texts, wanted = dict(docs), dict(items)
    for d, i in got - exact:
        p = dc.normalised(wanted[i])
        assert substring_distance(p, dc.normalised(texts[d])) <= dc.budget(len(p))


def test_cases(make_docs):
    bench = make_docs([(1, "Short one"), (2, None), (3, " "), (4, "short one"), (None, "other")], "item_id long, text string")
    rows = [(1, "a SHORT  one."), (2, "ashort one"), (3, None), (4, ""), (None, "the other"), (5, "x " * 200_000 + "short one"), (5, "short one")]
    got = sorted(((r.doc_id, r.item_id) for r in dc.find_leaks(make_docs(rows), bench).collect()), key=str)
    assert got == sorted([(1, 1), (1, 4), (None, None), (5, 1), (5, 4), (5, 1), (5, 4)], key=str)
    docs = make_docs([(d, t, 1) for d, t in rows], "doc_id long, text string, item_id int")
    assert sorted((r.doc_id for r in dc.drop_leaks(docs, bench).collect())) == [2, 3, 4]
    assert dc.find_leaks(make_docs([]), bench).count() == 0
    none = make_docs([], "item_id long, text string")
    assert dc.find_leaks(make_docs(rows), none).count() == 0 and dc.drop_leaks(make_docs(rows), none).count() == 7


@pytest.mark.parametrize("m", [1, 23, 24, 100, 500])
def test_pieces_cover_the_item(m):
    t, k = "x" * m, dc.budget(m)
    got = dc.pieces(t, k)
    assert len(got) == k + 1 and "".join(p for _, p in got) == t and all(p for _, p in got)
