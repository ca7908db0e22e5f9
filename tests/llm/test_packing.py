"""Packing: an exact round trip of the token ids, and the mixture of every window."""

import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from eventlake.llm import catalog, packing

SF01 = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


def reference(texts):
    return [[*e.ids, 1] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_layout(rows, window):
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    assert sorted(seqs) == list(range(len(seqs)))
    for s, parts in seqs.items():
        at = 0
        for off, n in sorted(parts):
            assert off == at and n > 0
            at += n
        assert at == window or s == len(seqs) - 1 and at <= window


def test_given_documents(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF01}/documents.parquet' order by 1").fetchall()
    rows = catalog.op1_packing(spark, SF01).collect()
    check_layout(rows, 2048)
    ids = dict(zip([d for d, _ in docs], reference([t for _, t in docs]), strict=True))
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    assert set(got) == set(ids)
    for d, parts in got.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            want = np.array(ids[d][at:at + r.length], dtype="<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids[d]), zlib.crc32(want))
            at += r.length
        assert at == len(ids[d])
    share = defaultdict(int)
    for r in rows:
        share[r.source] += r.length
    total = sum(share.values())
    taken = defaultdict(lambda: defaultdict(int))
    for r in rows:
        taken[r.sequence_id][r.source] += r.length
    for s, by in taken.items():
        if s < max(taken):
            for src, n in share.items():
                assert abs(by[src] - 2048 * n / total) <= 2 * 5    # within the depth of the tree at either end


def test_words_can_be_encoded_alone(monkeypatch):
    rng = random.Random(1)
    odd = ["".join(rng.choice("aB é́\n\t\x0b\x0c\x1c\x85  ΣσİßÅÅ<|endoftext|>'s 12日😀") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    odd += ["<|ENDOFTEXT|> A.", "a. b, c.d e., f.. 1. ». é. İa ǅ ﬁ ʼn Ǆ. end.", "x.\n\ny,", "..", ",", "a,"]
    odd += ["<|endoftext|> x<|startoftext|>y", "don't 'S 'll", ""]
    words = [w for _, t in duckdb.sql(f"select doc_id, text from '{SF01}/documents.parquet' limit 60").fetchall() for w in [t]]
    odd += words
    monkeypatch.setattr(packing, "MEMO", 500)
    tok = packing.WordTokenizer(PATH)

    def encoded(texts):
        ids, off = tok.encode(pa.array(texts, pa.large_string()), 1)
        return [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)]

    assert [encoded([t])[0] for t in words] == encoded(words)
    assert encoded(odd) == reference(odd)
    assert encoded([]) == [] and encoded(["", " "]) == [[1], [1]]


@pytest.mark.parametrize("weights", [None, {"a": 3, "b": 1}, {"a": 1.5}, {"x": 1, "c": 0.25, "a": 0.5}])
def test_phases_serve_every_token_once(weights):
    totals = {"a": 1000, "b": 37, "c": 4, "x": 2500}
    plan = packing.plan_phases(totals, weights)
    seen = {}
    rng = random.Random(0)
    for q, n in totals.items():
        x = 0
        while x < n:
            k = min(rng.randint(1, 90), n - x)
            at = 0
            for start, size, seq, off in packing.place(plan[q], x, k, 64):
                assert start == at and size > 0
                at += size
                for j in range(size):
                    assert seen.setdefault((seq, off + j), (q, x + start + j)) == (q, x + start + j)
            assert at == k
            x += k
    assert sorted(seen) == [(i // 64, i % 64) for i in range(sum(totals.values()))]
    if weights == {"a": 3, "b": 1}:
        first = [seen[0, j][0] for j in range(64)]
        assert first.count("a") == 48 and first.count("b") == 16


def test_cases(spark, make_docs):
    schema = "doc_id long, text string, source string, ids int, offset string"
    rows = [(1, None, "s", 1, ""), (2, "", None, 1, ""), (None, "hello world", "none", 1, ""), (3, "b " * 50_000, "s", 1, ""), (3, "b c", "s", 1, ""), (3, "b c", "s", 1, "")]
    got = packing.pack(make_docs(rows, schema), PATH).collect()
    check_layout(got, 2048)
    assert sum(r.length for r in got) == sum(map(len, reference([t for _, t, *_ in rows])))
    assert {r.source for r in got} == {"s", None, "none"}
    assert {r.doc_tokens for r in got if r.doc_id in (1, 2)} == {1}
    assert packing.pack(make_docs([], schema), PATH).count() == 0


@pytest.mark.parametrize("weights", [None, {"s3": 2, "s4": 1}])
def test_more_sources_than_queues(spark, weights):
    """Sources beyond the bound share queues; no token is lost and every window keeps the groups' shares."""
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choices(["red", "green", "blue", "tokeniser", "x9"], k=rnd.randint(1, 40))), f"s{i % 60}") for i in range(900)]
    docs = spark.createDataFrame([*rows, (900, "no source", None)], "doc_id long, text string, source string").repartition(5)
    got = packing.pack(docs, PATH, window=64, weights=weights, max_queues=7).collect()
    check_layout(got, 64)
    want = dict(zip(range(901), reference([*[t for _, t, _ in rows], "no source"]), strict=True))
    parts = defaultdict(list)
    for r in got:
        parts[r.doc_id].append(r)
    for d, ids in want.items():
        assert np.frombuffer(b"".join(r.ids for r in sorted(parts[d], key=lambda r: r.start)), dtype="<u4").tolist() == ids
    assert {r.source for r in got} == {f"s{i}" for i in range(60)} | {None}
    if weights:                     # while both last, two thirds of a window are s3's
        first = sum(r.length for r in got if r.sequence_id == 0 and r.source == "s3")
        assert abs(first - 64 * 2 / 3) <= 1
