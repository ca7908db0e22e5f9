"""Substring deduplication against brute force over word windows."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from eventlake.llm import catalog, substring, textcols

SF01 = "/root/testdata/sf0.01"


def brute(rows, window):
    """doc_id -> (n_words, n_removed, sha256 of the kept words)."""
    big = 1 << 63
    toks = [(big if i is None else i, i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for key, _, w in toks:
        for p in range(len(w) - window + 1):
            g = tuple(w[p:p + window])
            first[g] = min(first.get(g, big), key)
    out = []
    for key, i, w in toks:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < key:
                gone[p:p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def as_rows(df):
    return sorted(((r[0], r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect()), key=str)


def test_given_documents(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF01}/documents.parquet'").fetchall()
    got = sorted(map(tuple, catalog.op7_substring_dedup(spark, SF01).collect()), key=str)
    want = brute(rows, 50)
    assert sum(x[2] for x in want) > 1000 and got == want


@pytest.mark.parametrize("window", [1, 3, 10, 50])
def test_random_overlaps(spark, make_docs, window):
    rng = random.Random(window)
    pool = [[f"w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 3 * window))] for _ in range(12)]
    rows = []
    for i in range(80):
        w = [x for _ in range(rng.randint(0, 4)) for x in (*rng.choice(pool), *[f"u{rng.random()}"] * rng.randint(0, 2))]
        rows.append((rng.randint(0, 60) if i % 9 else None, rng.choice([" ", "\n", "  "]).join(w) or None))
    assert as_rows(substring.remove_repeats(make_docs(rows), window)) == brute(rows, window)


def test_long_text_ties_and_empty(spark, make_docs):
    words = " ".join(str(i % 70_000) for i in range(300_000))
    rows = [(5, words), (5, words), (6, "x " + words), (7, ""), (8, None), (None, words)]
    assert as_rows(substring.remove_repeats(make_docs(rows))) == brute(rows, 50)
    assert substring.remove_repeats(make_docs([])).count() == 0
    clash = make_docs([(1, "a", 3, "m")], "doc_id long, text string, id int, marks string")
    assert substring.remove_repeats(clash).columns == ["doc_id", "n_words", "n_removed", "kept"]


@pytest.mark.parametrize("v", [1, 2, 7, 13, 21, 31, 40])
def test_difference_covers(v):
    d = substring.difference_cover(v)
    assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é\n\t") for _ in range(rng.randint(0, 400))) for _ in range(60)] + ["z" * 900, ""]
    col = pa.array(texts, type=pa.large_string())

    def flat():
        out = []
        for w in textcols.words(col, seeds=2, spans=True):
            for d in range(w.hi - w.lo):
                a, b = w.offsets[d], w.offsets[d + 1]
                out.append((w.hashes[0][a:b].tolist(), w.hashes[1][a:b].tolist(), b - a))
        return out
    whole = flat()
    assert [n for _, _, n in whole] == [len(t.encode().split()) for t in texts]
    monkeypatch.setattr(textcols, "SLICE_BYTES", 64)
    assert flat() == whole
    seen = {}
    for t, (h, _, _) in zip(texts, whole, strict=True):
        for w, x in zip(t.encode().split(), h, strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    g = textcols.gram_hashes(np.arange(20, dtype=np.uint64), 7)
    h = textcols.gram_hashes(np.arange(3, 20, dtype=np.uint64), 7)
    assert g[3:14].tolist() == h[:11].tolist()
