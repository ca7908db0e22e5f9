"""Benchmark decontamination by pigeonhole edit matching.

Texts are normalised (lower case, white space squeezed to one space).  An item
of m characters may differ by up to ``k = floor(rate * m)`` edits.  Cut into
k+1 pieces, at least one piece of any copy within k edits is unchanged, so:

1. An Aho-Corasick automaton over all pieces finds exact piece hits in a text.
2. Each hit places the item; the text around it, k characters wider on both
   sides, is searched for the item with Myers' bit-parallel edit distance.

The benchmark is a stated query set: it is taken in blocks of bounded size, one
pass over the documents each, so nothing unbounded is shipped to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake.llm.textcols import text_array

RATE = 0.05                  # edits per character of an item
SHORT = 24                   # shorter items must occur unchanged, as whole words
BLOCK_CHARS = 4_000_000      # benchmark characters per block
_HITS = "id {0}, item_id {1}, distance int, start int, end int"


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def budget(m: int, rate: float = RATE) -> int:
    return int(rate * m) if m >= SHORT else 0


def pieces(text: str, k: int) -> list[tuple[int, str]]:
    """k+1 pieces of nearly equal length with their offsets."""
    cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern_masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to a substring of the text, its end).

    Bit i of the vertical delta vectors belongs to pattern character i; the
    bottom row's score moves by the top bit of the horizontal deltas.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, best_end = m, 0
    for j, ch in enumerate(text, 1):
        eq = pattern_masks.get(ch, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        h_plus = minus | (full & ~(diag | plus))
        h_minus = plus & diag
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus = (h_plus << 1) & full        # row 0 stays 0: a match may begin anywhere
        h_minus = (h_minus << 1) & full
        plus = h_minus | (full & ~(diag | h_plus))
        minus = h_plus & diag
        if score < best:
            best, best_end = score, j
    return best, best_end


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


class Matcher:
    """Finds the items of one benchmark block in normalised texts."""

    def __init__(self, items: list[tuple[object, str]], rate: float = RATE) -> None:
        self.items = [(i, normalised(t)) for i, t in items]
        self.items = [(i, t, budget(len(t), rate), masks(t), masks(t[::-1])) for i, t in self.items if t]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k, _, _) in enumerate(self.items):
            for at, piece in pieces(t, k):
                where.setdefault(piece, []).append((n, at))
        self.auto = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.auto.add_word(piece, (len(piece), uses))
        if where:
            self.auto.make_automaton()
        self.empty = not where

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item id, distance, start, end) of each item's best place in the text."""
        if self.empty or not text:
            return []
        best: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for last, (size, uses) in self.auto.iter(text):
            for n, at in uses:
                _, item, k, fwd, back = self.items[n]
                place = last - size + 1 - at
                if (n, place) in tried or (n in best and best[n][0] == 0):
                    continue
                tried.add((n, place))
                m = len(item)
                if k == 0:
                    if place < 0 or (m < SHORT and not _whole(text, place, place + m)):
                        continue
                    best[n] = (0, place, place + m)
                    continue
                lo, hi = max(0, place - k), min(len(text), place + m + k)
                if text.startswith(item, max(0, place)) and place >= 0:
                    best[n] = (0, place, place + m)
                    continue
                d, end = myers(fwd, m, text[lo:hi])
                if d <= k and (n not in best or d < best[n][0]):
                    _, width = myers(back, m, text[lo:lo + end][::-1])
                    best[n] = (d, lo + end - width, lo + end)
        return [(self.items[n][0], *x) for n, x in sorted(best.items())]


def _whole(text: str, a: int, b: int) -> bool:
    return (a == 0 or not text[a - 1].isalnum()) and (b >= len(text) or not text[b].isalnum())


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The benchmark's items in blocks of bounded size, one block held at a time."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(item_col, text_col)
    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE,
               item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per (document, benchmark item it holds): ``<id_col>, item_id,
    distance, start, end`` (places in the normalised text).

    Null and empty texts hold nothing, null and empty items are in nothing;
    items under 24 characters must occur unchanged as whole words; equal items
    are reported each; a null id stays null; repeated rows are reported each;
    other columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    id_t, item_t = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ddl = _HITS.format(id_t.simpleString(), item_t.simpleString())
    out = spark.createDataFrame([], T._parse_datatype_string(ddl))
    for block in blocks_of(benchmark, item_col, item_text_col, block_chars):
        out = out.unionByName(src.mapInArrow(_scan(spark.sparkContext.broadcast(block), rate), ddl))
    return out.select(F.col("id").alias(id_col), "item_id", "distance", "start", "end")


def _scan(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, rate)
        for batch in batches:
            col, at, found = text_array(batch.column("text")), [], []
            for i in range(len(col)):
                for hit in matcher.find(normalised(col[i].as_py())):
                    at.append(i)
                    found.append(hit)
            if found:
                item, dist, start, end = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(at)), pa.array(item), pa.array(dist, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                    names=["id", "item_id", "distance", "start", "end"])
    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = RATE, item_col: str = "item_id",
               item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no benchmark item, with their columns (no shuffle)."""
    spark, out = docs.sparkSession, docs
    for block in blocks_of(benchmark, item_col, item_text_col, block_chars):
        out = out.mapInArrow(_clean(spark.sparkContext.broadcast(block), rate, text_col), docs.schema)
    return out


def _clean(shared, rate: float, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, rate)
        for batch in batches:
            col = text_array(batch.column(text_col))
            yield batch.filter(pa.array([not matcher.find(normalised(t)) for t in col.to_pylist()], type=pa.bool_()))
    return run
