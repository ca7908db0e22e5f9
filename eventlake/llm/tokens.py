"""Count-only Viterbi token counts for a unigram vocabulary.

An Aho-Corasick automaton over the vocabulary reports, for each end position,
every piece that ends there; the dynamic programme keeps for each position only
the best score and the number of tokens of that best path.  Tie rules are the
tokenizer's: a candidate replaces the best one only when its score is strictly
greater, candidates come by ascending start (the longest piece first), and a
character that no single-character piece covers costs the lowest score less 10
and counts as its UTF-8 bytes (byte fallback).

No piece of the vocabulary crosses from a non-space into a space, so a text
splits exactly in front of each run of spaces and scores add up; segments
repeat, so each distinct one is solved once per worker (bounded memo).
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.textcols import text_array

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MEMO = 1_000_000          # distinct segments kept per worker
LONGEST_KEPT = 64       # longer segments are solved without keeping them


class Counter:
    """Token counts by the vocabulary [(piece, score)]."""

    def __init__(self, vocab: list[tuple[str, float]], dummy_prefix: bool = True) -> None:
        self.pieces = {p: float(s) for p, s in vocab if p}
        self.unknown = min(self.pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.dummy_prefix = dummy_prefix
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.auto = ahocorasick.Automaton()
        for p, s in self.pieces.items():
            self.auto.add_word(p, (len(p), s))
        if self.pieces:
            self.auto.make_automaton()
        self.memo: dict[str, int] = {}

    def segment(self, seg: str) -> int:
        """Tokens of the best path through one segment."""
        n = len(seg)
        best = [0.0] * (n + 1)
        count = [0] * (n + 1)
        reached = 0
        hits = self.auto.iter(seg) if self.pieces else iter(())
        hit = next(hits, None)
        for end in range(1, n + 1):
            score = None
            one = False
            tokens = 0
            while hit is not None and hit[0] == end - 1:      # longest piece first
                size, s = hit[1]
                c = best[end - size] + s
                if score is None or c > score:
                    score, tokens = c, count[end - size] + 1
                one = one or size == 1
                hit = next(hits, None)
            if not one:
                c = best[end - 1] + self.unknown
                if score is None or c > score:
                    score, tokens = c, count[end - 1] + len(seg[end - 1].encode("utf-8"))
            best[end], count[end] = score, tokens
            reached = end
        return count[reached]

    def count(self, text: str) -> int:
        if not text:
            return 0
        full = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        if not self.splits:
            return self.segment(full)
        return sum(map(self.of, _segments(full)))

    def of(self, seg: str) -> int:
        got = self.memo.get(seg)
        if got is None:
            got = self.segment(seg)
            if len(seg) <= LONGEST_KEPT:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[seg] = got
        return got


def _segments(full: str) -> Iterator[str]:
    """Pieces of the text, cut in front of each run of spaces."""
    lead = ""
    for part in full.split(SPACE):
        if part:
            yield lead + part
            lead = SPACE
        else:
            lead += SPACE
    # split() gives one part more than separators: the last lead holds one too many
    if len(lead) > 1:
        yield lead[:-1]


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the normal pieces of a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not skip(i)]


_COUNTERS: dict[tuple, Counter] = {}


def _counter(path: str, dummy_prefix: bool) -> Counter:
    key = (path, dummy_prefix)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(read_vocabulary(path), dummy_prefix)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
                 dummy_prefix: bool = True) -> DataFrame:
    """One row per document: ``<id_col>, n_tokens`` (long).

    ``vocab_path`` names a vocabulary file present on every worker.  Null and
    empty texts have 0 tokens; a null id stays null; repeated rows are counted
    each; other columns are ignored.  No shuffle.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocab_path, dummy_prefix)
        for batch in batches:
            col = text_array(batch.column("text"))
            for lo in range(0, len(col), 256):
                part = col.slice(lo, 256)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, 256), pa.array(_counts(part, counter), type=pa.int64())], names=["id", "n_tokens"])

    return src.mapInArrow(run, f"id {id_type}, n_tokens bigint").select(F.col("id").alias(id_col), "n_tokens")


def _counts(part: pa.Array, counter: Counter) -> list[int]:
    if not counter.splits:
        return [counter.count(t) for t in part.to_pylist()]
    out = []
    for t in part.to_pylist():
        if not t:
            out.append(0)
        elif "  " in t or t[0] == " " or t[-1] == " " or SPACE in t or not counter.dummy_prefix:
            out.append(counter.count(t))
        else:                                   # single spaces: every word is one segment
            memo, total = counter.memo, 0
            for w in t.split(" "):
                got = memo.get(SPACE + w)
                total += counter.of(SPACE + w) if got is None else got
            out.append(total)
    return out
