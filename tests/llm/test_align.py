"""Cross-tokenizer alignment against a plain programme."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventlake.llm.align import _byte_symbols, alignment, lanes, lockstep, token_links

from tests.llm.conftest import SF001

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

ODD = [(101, None), (102, ""), (103, "a ▁ b"), (104, "  lead  two\n\n tab\t x <|endoftext|> <s> tail "), (105, "日本語 テキスト　全角 ﬁ ½"), (106, "word " * 9000),
       (107, "x" * 5000), (108, " "), (109, "é à b c"), (110, "don't we'll it's 123,456 a1b2"), (111, "\x00 nul \x1c sep"), (112, "emoji 😀😃 end"),
       (113, "ＦＵＬＬ width"), (110, "the id again"), (110, "the id again"), (None, "no id"), (114, "\n"), (115, "a b c d"), (116, "end ")]


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(A)
    a_tok.encode_special_tokens = True
    b_tok, symbol = sentencepiece.SentencePieceProcessor(model_file=B), _byte_symbols()
    count, texts = Counter(), []
    for doc_id, text in rows:
        text = text or ""
        a, b, want = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text), (" " + text).encode()
        a_bytes = [bytes(symbol[c] for c in a_tok.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            texts.append((doc_id, None))
            continue
        end_a, end_b = (np.cumsum([len(x) for x in t]).tolist() for t in (a_bytes, b_bytes))
        start_a, start_b = [0, *end_a], [0, *end_b]
        links, at = [], 0
        for i, e in enumerate(end_a):
            while end_b[at] <= start_a[i]:
                at += 1
            j = at
            while j < len(b) and start_b[j] < e:
                links.append((i, j, a[i], b[j], max(start_a[i], start_b[j]), min(e, end_b[j])))
                j += 1
        groups, x, y = [], 0, 0
        both = set(end_b)
        for cut in [e for e in end_a if e in both]:
            i, j = end_a.index(cut, x) + 1, end_b.index(cut, y) + 1
            groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
            x, y = i, j
        count.update((k[2], k[3]) for k in links)
        texts.append((doc_id, (len(a), len(b), groups, links)))
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for doc_id, t in texts:
        if t is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n = [count[k[2], k[3]] for k in t[3]]
        out.append((doc_id, t[0], t[1], len(t[2]), len(n), sum(c == best[k[3]] for c, k in zip(n, t[3], strict=True)), sum(n),
                    hashlib.sha256(";".join(t[2]).encode()).hexdigest()))
    return sorted(out, key=str), texts


@pytest.mark.parametrize("frequent", [500_000, 300, 0])
def test_against_brute_force(spark, frequent):
    given_rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    rows = given_rows + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in alignment(df, A, B, frequent=frequent).collect()), key=str)
    assert got == brute(rows)[0]


def test_links_with_their_spans(spark):
    rows = [(1, "Unbelievable tokenization, naïve café\tx"), (2, "日本 x"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in token_links(df, A, B).collect())
    assert got == sorted((d, *k) for d, t in brute(rows)[1] if t for k in t[3])


def test_empty_table_and_clashing_columns(spark):
    assert alignment(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    wide = spark.createDataFrame([(1, "a b", 5, 6, 7, 8)], "doc_id long, text string, id int, row int, pairs int, n_best int")
    assert [tuple(r)[:5] for r in alignment(wide, A, B).collect()] == [(1, 2, 2, 2, 2)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.lists(st.integers(1, 4), min_size=1, max_size=40)), min_size=1, max_size=6),
       st.integers(2, 8))
def test_lockstep_and_lanes(texts, lane):
    """Links are the pairs of overlapping ranges, cuts the shared ends, whatever the lanes."""
    ends_a, ends_b, off_a, off_b, base = [], [], [0], [0], 0
    for x, y in texts:
        total = max(sum(x), sum(y))
        x, y = [*x, *[1] * (total - sum(x))], [*y, *[1] * (total - sum(y))]
        ends_a += (base + np.cumsum(x)).tolist()
        ends_b += (base + np.cumsum(y)).tolist()
        base += total
        off_a.append(len(ends_a))
        off_b.append(len(ends_b))
    given_arrays = [np.array(x) for x in (ends_a, ends_b, off_a, off_b)]
    first, _, stop = lanes(*given_arrays, lane)
    assert (stop[:-1] == first[1:]).all()
    i, j, cut_a, cut_b = lockstep(*given_arrays, lane)
    span = lambda e, k: (e[k - 1] if k else 0, e[k])
    want = {(x, y) for x in range(len(ends_a)) for y in range(len(ends_b)) if max(span(ends_a, x)[0], span(ends_b, y)[0]) < min(span(ends_a, x)[1], span(ends_b, y)[1])}
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want
    assert [e for e, c in zip(ends_a, cut_a, strict=True) if c] == sorted(set(ends_a) & set(ends_b)) == [e for e, c in zip(ends_b, cut_b, strict=True) if c]
