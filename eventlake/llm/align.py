"""Alignment of the tokens of two tokenizers on the same text.

* A text is encoded by a byte-level tokenizer (A) with a space in front, and by
  a piece tokenizer (B), which adds that space itself.  If the tokens' bytes give
  the text back, both cut the same bytes.
* Lockstep merging: a state vector holds the A and B token at which every
  document stands.  Each step emits one link for each of them, then moves A on
  where A's token ends first, B where B's does, and both where they end together,
  which is a cut.  Documents that are through leave the vector.  A long document
  is dealt as several lanes that begin at ends both tokenizers share, so the
  steps of a batch do not grow with its longest document.
* How often an id pair is linked is counted over the corpus: per document, then
  per task, then by a shuffle.  The most frequent pairs, a table of a fixed size
  at most, are broadcast and looked up where the documents lie; the links of all
  other pairs are joined with the whole table of counts.

Both tokenizers cut at a space between two characters that are not white space,
so a text's units between such spaces are encoded by themselves, each distinct
one once and many at a time, and remembered (two generations, bounded).
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import written
from eventlake.llm.textcols import raw, text_array

LANE = 1024                  # tokens after which a document goes on in another lane
SLICE_BYTES = 2 << 20        # of texts aligned at a time
FREQUENT = 500_000           # rows of the broadcast table of pair counts, at most
MEMO = 200_000               # units remembered in a worker, per generation
LONG_UNIT = 64               # characters beyond which a unit is not remembered
_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: white space beside white space, at either end, or other than ASCII's
_ODD = r"^[\s\x0b\x1c-\x1f]|[\s\x0b\x1c-\x1f]$|[\s\x0b\x1c-\x1f]{2}|[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: bytes
    that print stand for themselves, the others for characters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenizerPair:
    """Both tokenizers, the bytes of their tokens and a memory of units."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True          # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        symbol, vocab = _byte_symbols(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values(), default=-1) + 1)
        for t, i in vocab.items():
            self.bytes_a[i] = bytes(symbol[c] for c in t) if all(c in symbol for c in t) else t.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.vocab_size()))]
        self.len_a, self.len_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        self.opens_a, self.opens_b = (np.array([x[:1] == b" " for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.name_a, self.name_b = (pa.array([str(i) for i in range(len(t))], pa.string()) for t in (self.bytes_a, self.bytes_b))
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def _whole(self, texts: list[str]) -> list[tuple]:
        """(ids of A, ids of B) of each text by itself, packed; None where bytes differ."""
        out = []
        for t, x, y in zip(texts, self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False), self.b.encode(texts, num_threads=1), strict=True):
            a, b = x.ids, y
            want = b" " + t.encode()
            ok = b"".join([self.bytes_a[i] for i in a]) == want == b"".join([self.bytes_b[i] for i in b])
            out.append((np.array(a, np.int32).tobytes(), np.array(b, np.int32).tobytes()) if ok else (None, None))
        return out

    def _plain(self, units: list[str]) -> list[tuple]:
        """The same of units without a space, many at a time: a token that opens
        with a space opens a unit."""
        out = []
        for lo in range(0, len(units), 200):
            part = units[lo:lo + 200]
            joined = " ".join(part)
            want = b" " + joined.encode()
            a = np.array(self.a.encode_batch_fast([" " + joined], add_special_tokens=False)[0].ids, np.int32)
            b = np.array(self.b.encode([joined], num_threads=1)[0], np.int32)
            cut_a, cut_b = np.flatnonzero(self.opens_a[a]), np.flatnonzero(self.opens_b[b])
            if (len(cut_a) == len(cut_b) == len(part) and b"".join([self.bytes_a[i] for i in a.tolist()]) == want
                    and b"".join([self.bytes_b[i] for i in b.tolist()]) == want):
                x, y = a.tobytes(), b.tobytes()
                ends_a, ends_b = [*(4 * cut_a[1:]).tolist(), len(x)], [*(4 * cut_b[1:]).tolist(), len(y)]
                i = j = 0
                for k, m in zip(ends_a, ends_b, strict=True):
                    out.append((x[i:k], y[j:m]))
                    i, j = k, m
            else:
                out += self._whole(part)
        return out

    def units(self, units: list[str]) -> list[tuple]:
        """(ids of A, ids of B) of each distinct unit, (None, None) where the
        bytes of either differ from a space and the unit."""
        young, old = self.young, self.old
        found, new = [], []
        for u in units:
            got = young.get(u)
            if got is None and u in old:
                got = young[u] = old[u]
            if got is None:
                new.append(u)
            found.append(got)
        plain, odd = [], []
        for u in new:
            (plain if u and " " not in u and u.strip() == u else odd).append(u)
        learnt = dict(zip([*plain, *odd], [*self._plain(plain), *(self._whole(odd) if odd else [])], strict=True))
        young.update({u: v for u, v in learnt.items() if len(u) <= LONG_UNIT})
        out = [learnt[u] if v is None else v for u, v in zip(units, found, strict=True)]
        if len(young) > MEMO:
            self.old, self.young = young, {}
        return out


_PAIRS: dict[tuple[str, str], TokenizerPair] = {}


def _pair(a_path: str, b_path: str) -> TokenizerPair:
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = TokenizerPair(a_path, b_path)
    return _PAIRS[a_path, b_path]


@dataclass
class Tokens:
    """Tokens of some texts: ids and offsets by text of either tokenizer."""

    a: np.ndarray
    b: np.ndarray
    off_a: np.ndarray
    off_b: np.ndarray


def _ragged(ids: list[bytes], pick: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the picked units one after the other, and offsets by text."""
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), np.int32)
    begin = np.cumsum(size) - size
    many = size[pick]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(many)])
    at = np.arange(ends[-1]) + np.repeat(begin[pick] - ends[:-1], many)
    return flat[at], ends[off]


def tokens(texts: pa.Array, pair: TokenizerPair) -> Tokens:
    """The tokens of every text; of texts that are empty or that either
    tokenizer changes, none."""
    odd = np.array(pc.match_substring_regex(texts, _ODD))
    lists = pc.split_pattern(texts, " ")
    if odd.any():
        at = np.flatnonzero(odd)
        instead = pa.array([_SPACE.split(t) for t in texts.take(pa.array(at)).to_pylist()], lists.type)
        place = np.arange(len(texts))
        place[at] = len(texts) + np.arange(len(at))
        lists = pa.concat_arrays([lists, instead]).take(pa.array(place))
    off = lists.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    coded = lists.flatten().dictionary_encode()
    pick = coded.indices.to_numpy()
    ids = pair.units(coded.dictionary.to_pylist())
    bad_unit = np.array([x is None for x, _ in ids], dtype=bool)
    # empty texts, and texts with a unit that does not come back, stand alone
    bad = np.add.reduceat(np.append(bad_unit[pick], False), np.minimum(off[:-1], len(pick))).astype(bool) if len(off) > 1 else np.zeros(0, bool)
    empty = np.array(pc.equal(texts, ""))
    drop = bad | empty
    if drop.any():
        ids = [(b"", b"") if x is None else (x, y) for x, y in ids]
        again = dict(zip(np.flatnonzero(bad & ~empty).tolist(), pair._whole(texts.filter(pa.array(bad & ~empty)).to_pylist()), strict=True))
        kept = np.repeat(~drop, np.diff(off))
        extra = [(b"", b"") if again.get(d, (None,))[0] is None else again[d] for d in np.flatnonzero(drop).tolist()]
        own = np.flatnonzero(drop)
        # a dropped text counts as one unit of its own
        order = np.concatenate([np.flatnonzero(kept), off[own]]) if len(own) else np.flatnonzero(kept)
        number = np.concatenate([pick[kept], len(ids) + np.arange(len(own))])
        sort = np.argsort(order, kind="stable")
        pick = number[sort]
        off = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.where(drop, 1, np.diff(off)))])
        ids = [*ids, *extra]
    a, off_a = _ragged([x for x, _ in ids], pick, off)
    b, off_b = _ragged([y for _, y in ids], pick, off)
    return Tokens(a, b, off_a, off_b)


def lanes(end_a: np.ndarray, end_b: np.ndarray, off_a: np.ndarray, off_b: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first A token, first B token, A token after the last) of every lane."""
    some = np.flatnonzero(off_a[1:] > off_a[:-1])
    i, j, stop = off_a[some], off_b[some], off_a[some + 1]
    more_i, more_j = [], []
    for d in np.flatnonzero(stop - i > lane).tolist():
        marks = np.arange(i[d] + lane, stop[d] - 1, lane)
        near = np.minimum(marks[:, None] + np.arange(64), stop[d] - 2)       # ends of A in which a shared one is sought
        hit = np.searchsorted(end_b, end_a[near])
        shared = end_b[np.minimum(hit, len(end_b) - 1)] == end_a[near]
        at = np.argmax(shared, axis=1)
        found = np.flatnonzero(shared.any(axis=1))
        cut, first = np.unique(near[found, at[found]], return_index=True)
        more_i.append(cut + 1)
        more_j.append(hit[found, at[found]][first] + 1)
    if more_i:
        i, j = np.concatenate([i, *more_i]), np.concatenate([j, *more_j])
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        stop = np.append(i[1:], off_a[-1])           # lanes follow each other without gaps
    return i, j, stop


def lockstep(end_a: np.ndarray, end_b: np.ndarray, off_a: np.ndarray, off_b: np.ndarray,
             lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (A token, B token), and whether a cut follows each A and B token.

    Ends are byte offsets that run on from text to text.
    """
    i, j, stop = lanes(end_a, end_b, off_a, off_b, lane)
    cut_a, cut_b = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool)
    out_i, out_j = [], []
    while len(i):
        ea, eb = end_a[i], end_b[j]
        out_i.append(i)
        out_j.append(j)
        on_a, on_b = ea <= eb, eb <= ea
        both = on_a & on_b
        cut_a[i[both]] = True
        cut_b[j[both]] = True
        i, j = i + on_a, j + on_b
        going = i < stop                              # A's and B's last tokens of a lane end together
        if not going.all():
            i, j, stop = i[going], j[going], stop[going]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j]), cut_a, cut_b


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    _, off = raw(column)
    lo = 0
    while lo < len(column):
        hi = min(max(int(np.searchsorted(off, off[lo] + SLICE_BYTES, side="right")) - 1, lo + 1), len(column))
        yield lo, hi
        lo = hi


def _group_texts(t: Tokens, pair: TokenizerPair, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``, and their number."""

    def side(ids: np.ndarray, cut: np.ndarray, names: pa.Array) -> pa.Array:
        off = np.concatenate([np.zeros(1, np.int32), np.flatnonzero(cut).astype(np.int32) + 1])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(off, pa.int32()), names.take(pa.array(ids))), ",")

    each = pc.binary_join_element_wise(side(t.a, cut_a, pair.name_a), side(t.b, cut_b, pair.name_b), "|")
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(cut_a)])
    off = before[t.off_a].astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(off), each), ";").to_pylist(), np.diff(off)


def _aligned(texts: pa.Array, pair: TokenizerPair):
    t = tokens(texts, pair)
    end_a, end_b = np.cumsum(pair.len_a[t.a]), np.cumsum(pair.len_b[t.b])
    return (t, end_a, end_b, *lockstep(end_a, end_b, t.off_a, t.off_b))


def token_links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per link: ``<id_col>, a_index, b_index, a_id, b_id, start, end``,
    the bytes both tokens share, counted in the text with a space in front."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_path, b_path)
        for batch in batches:
            column = text_array(batch.column("text"))
            for lo, hi in _slices(column):
                t, end_a, end_b, i, j, _, _ = _aligned(column.slice(lo, hi - lo), pair)
                doc = np.searchsorted(t.off_a, i, side="right") - 1
                base = np.concatenate([np.zeros(1, np.int64), end_a])[t.off_a[doc]]
                start = np.maximum(end_a[i] - pair.len_a[t.a[i]], end_b[j] - pair.len_b[t.b[j]]) - base
                cols = [i - t.off_a[doc], j - t.off_b[doc], t.a[i], t.b[j], start, np.minimum(end_a[i], end_b[j]) - base]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc + lo)), *[pa.array(c.astype(np.int64)) for c in cols]],
                                                 names=["id", "a_index", "b_index", "a_id", "b_id", "start", "end"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ddl = f"id {id_type}, a_index bigint, b_index bigint, a_id bigint, b_id bigint, start bigint, end bigint"
    return src.mapInArrow(run, ddl).withColumnRenamed("id", id_col)


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """A row per document: numbers, digest of its groups, and how often it links
    each id pair (pairs: A id * size of B's vocabulary + B id)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    wide = _pair(a_path, b_path)
    size_b = len(wide.bytes_b)
    narrow = len(wide.bytes_a) * size_b < 1 << 31
    key_np, key_pa, key_sql = (np.int32, pa.int32(), "int") if narrow else (np.int64, pa.int64(), "bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, row = _pair(a_path, b_path), TaskContext.get().partitionId() << 33
        for batch in batches:
            column = text_array(batch.column("text"))
            for lo, hi in _slices(column):
                t, _, _, i, j, cut_a, cut_b = _aligned(column.slice(lo, hi - lo), pair)
                doc = np.searchsorted(t.off_a, i, side="right") - 1
                groups, n_groups = _group_texts(t, pair, cut_a, cut_b)
                n_links = np.bincount(doc, minlength=hi - lo)
                key = t.a[i].astype(np.int64) * size_b + t.b[j]
                order = np.lexsort((key, doc)) if (hi - lo) << 40 > 1 << 62 or int(key.max(initial=0)) >= 1 << 40 else np.argsort((doc << 40) | key, kind="stable")
                doc, key = doc[order], key[order]
                first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
                many = np.diff(np.append(first, len(key)))
                off = pa.array(np.searchsorted(doc[first], np.arange(hi - lo + 1)).astype(np.int32))
                digest = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(hi - lo, dtype=np.int64)), batch.column("id").slice(lo, hi - lo),
                     *[pa.array(x.astype(np.int64)) for x in (np.diff(t.off_a), np.diff(t.off_b), n_groups, n_links)], pa.array(digest, pa.string()),
                     pa.ListArray.from_arrays(off, pa.array(key[first].astype(key_np), key_pa)), pa.ListArray.from_arrays(off, pa.array(many.astype(np.int32)))],
                    names=["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts"])
                row += hi - lo

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"row bigint, id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<{key_sql}>, counts array<int>")


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): links of every id pair in the corpus, and whether no
    other pair of its B id has more."""

    def merged(held: list) -> tuple[np.ndarray, np.ndarray]:
        key, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return key, np.bincount(back, np.concatenate([n for _, n in held])).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            held.append((batch.column("pairs").flatten().to_numpy().astype(np.int64), batch.column("counts").flatten().to_numpy()))
            many += len(held[-1][0])
            if many > 1 << 22:
                held = [merged(held)]
                many = len(held[0][0])
                if many > 1 << 21:                     # mostly different pairs: hand them on
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["pair", "n"])
                    held, many = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(held)], names=["pair", "n"])

    counted = written(rows.select("pairs", "counts").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")), "align-counts")
    most = counted.groupBy(F.pmod("pair", F.lit(size_b)).alias("b")).agg(F.max("n").alias("most"))
    joined = counted.withColumn("b", F.pmod("pair", F.lit(size_b))).join(most, "b")
    return joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, at_most: int):
    """Sorted pairs with their counts and marks: all pairs of some count or
    more, which are ``at_most`` at the most."""
    steps = counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("n")).orderBy(F.desc("step")).collect()
    least, total = None, 0
    for s in steps:                                    # some hundred steps
        total += s.pairs
        if total > at_most:
            break
        least = s.n
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    got = counts.where(F.col("n") >= least).toArrow().sort_by("pair")
    return tuple(got.column(c).to_numpy() for c in ("pair", "n", "best"))


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per document: ``<id_col>, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256``.

    A link's count is how many links of the corpus have its id pair; n_best
    are the links whose count no other pair of that B id exceeds, count_sum adds
    the counts of all.  Texts that are null, empty or changed by a tokenizer have
    no tokens: zeros and an empty digest.  Rows that repeat an id are documents
    each; other columns are ignored; an empty table gives an empty result.
    ``frequent`` bounds the broadcast table; no result depends on it.
    """
    size_b = len(_pair(a_path, b_path).bytes_b)
    rows = written(aligned(docs, a_path, b_path, id_col, text_col), "align-documents", compression="zstd")
    counts = written(pair_counts(rows, size_b), "align-pairs")
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(counts, frequent))
    own = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            lists, size = batch.column("pairs"), batch.num_rows
            doc = np.repeat(np.arange(size), np.diff(lists.offsets.to_numpy()))
            key, many = lists.flatten().to_numpy().astype(np.int64), batch.column("counts").flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(pair, key), max(len(pair) - 1, 0))
            known = pair[at] == key if len(pair) else np.zeros(len(key), bool)
            total, marked = np.zeros(size, np.int64), np.zeros(size, np.int64)
            np.add.at(total, doc[known], many[known] * n[at[known]])
            np.add.at(marked, doc[known], many[known] * best[at[known]])
            rare = np.flatnonzero(~known)
            fill = lambda c: pa.concat_arrays([batch.column(c), pa.nulls(len(rare), batch.column(c).type)])
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([batch.column("row"), batch.column("row").take(pa.array(doc[rare]))]), *[fill(c) for c in own],
                 pa.concat_arrays([pa.array(marked), pa.array(many[rare])]), pa.concat_arrays([pa.array(total), pa.nulls(len(rare), pa.int64())]),
                 pa.concat_arrays([pa.nulls(size, pa.int64()), pa.array(key[rare])])],
                names=["row", *own, "n_best", "count_sum", "pair"])

    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = ", ".join(["row bigint", *[f"{c} {fields[c]}" for c in own], "n_best bigint", "count_sum bigint", "pair bigint"])
    found = written(rows.mapInArrow(run, ddl), "align-found")          # a row per document, and one per rare pair of it
    rare = found.where("pair is not null").select("row", "pair", F.col("n_best").alias("many")).join(counts, "pair").select(
        "row", *[F.lit(None).cast(fields[c]).alias(c) for c in own],
        F.when(F.col("best"), F.col("many")).otherwise(0).alias("n_best"), (F.col("many") * F.col("n")).alias("count_sum"))
    both = found.where("pair is null").drop("pair").unionByName(rare)
    out = both.groupBy("row").agg(*[F.max(c).alias(c) for c in own], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
