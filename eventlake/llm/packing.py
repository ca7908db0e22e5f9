"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens.  Time counts packed tokens; a window is
``window`` of them.  With shares p_s each window takes from queue s its quota
``p_s * window`` plus the deficit the earlier windows left, in whole tokens.
Carrying deficits that way has a closed form: the queues are the leaves of a
binary tree, and of the t tokens served to a node ``floor(t * left / total)``
went to its left child and the others to its right.  Every count grows with t,
the leaves add up to t, and each stays within the tree's depth (log2 of the
number of queues) of its share.  So any task can place any document alone: the
deficit at any window, in any partition, is known without visiting the earlier
ones.

When a queue with a given share runs dry a new phase begins with the shares of
the rest.  Without given shares the corpus's own proportions are used, which
empty every queue in the last window: one phase, padding in one sequence only.

Passes: tokenise once (ids written with their place in the task's own queues),
add up (task, source) totals, then cut every document by arithmetic.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.common import written
from eventlake.llm.textcols import raw, text_array

WINDOW = 2048
END_ID = 1
MEMO = 600_000               # distinct words per generation of a worker's memory
_STOP = r"([A-Za-z0-9])([.,])([\x20\x09-\x0D]|$)"       # a full stop or comma that ends a word
MAX_BROADCAST_ROWS = 200_000  # (task, source) offsets; beyond it they are joined by a shuffle
MAX_QUEUES = 100_000         # queues of a mixture, planned on the driver; of more sources, those without a weight share as many queues by hash


class WordTokenizer:
    """Token ids of texts by a lower-casing tokenizer whose pieces never cross
    ASCII white space nor the border between a letter and a full stop or comma.
    A batch of texts is cut into words by Arrow; each distinct word is looked up
    once a batch and encoded once (two generations of memory, so frequent words
    stay and memory is bounded), and the ids are gathered by word number."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.dtype = np.dtype("<u2") if max(vocab.values(), default=0) < 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _one_by_one(self, group: list[str]) -> None:
        for w, e in zip(group, self.tok.encode_batch_fast(group, add_special_tokens=False), strict=True):
            self.young[w] = np.array(e.ids, dtype=self.dtype).tobytes()

    def _learn(self, new: list[str]) -> None:
        """Encode new words: plain words many at a time, told apart by the
        tokens that end a word; the others one by one."""
        plain, odd = [], []
        for w in new:
            (plain if w.lower().isalpha() else odd).append(w)
        for at in range(0, len(plain), 4000):
            groups = [plain[i:i + 100] for i in range(at, min(at + 4000, len(plain)), 100)]
            found = self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
            for g, e in zip(groups, found, strict=True):
                ids = np.array(e.ids, dtype=self.dtype)
                cut = np.flatnonzero(self.ends[ids]) + 1
                if len(cut) != len(g) or cut[-1] != len(ids):       # some word is more than one piece
                    self._one_by_one(g)
                    continue
                packed, size, a = ids.tobytes(), self.dtype.itemsize, 0
                for w, b in zip(g, (cut * size).tolist(), strict=True):
                    self.young[w] = packed[a:b]
                    a = b
        for at in range(0, len(odd), 4000):
            self._one_by_one(odd[at:at + 4000])

    def _ids(self, words: list[str]) -> list[bytes]:
        """Packed ids of distinct words."""
        young, old, new = self.young, self.old, []
        for w in words:
            if w not in young:
                if w in old:
                    young[w] = old[w]
                else:
                    new.append(w)
        self._learn(new)
        out = [young[w] for w in words]
        if len(young) > MEMO:
            self.old, self.young = young, {"": b""}
        return out

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``end``; offsets by text)."""
        # lower-casing first could only change a special token's spelling
        special = pc.match_substring(texts, "<|")
        low = pc.if_else(special, texts, pc.ascii_lower(texts)) if pc.any(special).as_py() else pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(low, _STOP, r"\1 \2\3"))
        off = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        ids = [*self._ids(coded.dictionary.to_pylist()), np.array([end], dtype=self.dtype).tobytes()]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        pick = np.insert(coded.indices.to_numpy().astype(np.int64), off[1:] - off[0], len(ids) - 1)
        flat, begin, many = np.frombuffer(b"".join(ids), self.dtype), np.cumsum(size) - size, size[pick]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(many)])
        at = np.arange(ends[-1]) + np.repeat(begin[pick] - ends[:-1], many)
        return flat[at], ends[off - off[0] + np.arange(len(off))]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def tokenise(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, source_col: str, end_id: int) -> DataFrame:
    """(id, queue, task, at, n, ids): ids packed; at = tokens of the queue before it in its task."""
    id_type = docs.schema[id_col].dataType.simpleString()
    queue = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("none"))
    src = docs.select(F.col(id_col).alias("id"), queue.alias("queue"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer_path)
        task, filled = TaskContext.get().partitionId(), {}
        for batch in batches:
            column = text_array(batch.column("text"))
            _, off = raw(column)
            lo = 0
            while lo < batch.num_rows:
                hi = min(max(int(np.searchsorted(off, off[lo] + (2 << 20), side="right")) - 1, lo + 1), batch.num_rows)
                ids, cut = tok.encode(column.slice(lo, hi - lo), end_id)
                queues, n = batch.column("queue").slice(lo, hi - lo).to_pylist(), np.diff(cut)
                at = []
                for q, k in zip(queues, n.tolist(), strict=True):
                    at.append(filled.get(q, 0))
                    filled[q] = at[-1] + k
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(cut * tok.dtype.itemsize), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array(queues, pa.string()), pa.array([task] * (hi - lo), pa.int32()),
                     pa.array(at, pa.int64()), pa.array(n, pa.int64()), packed.cast(pa.binary())],
                    names=["id", "queue", "task", "at", "n", "ids"])
                lo = hi

    return src.mapInArrow(run, f"id {id_type}, queue string, task int, at bigint, n bigint, ids binary")


@dataclass(frozen=True)
class Share:
    """A queue's part of one phase: its ``tokens`` tokens from number ``first``
    on are served between times begin and begin+length.  ``path`` leads from the
    tree's root to the queue: (tokens of the left child, of the node, go right?)."""

    first: int
    begin: int
    length: int
    tokens: int
    path: tuple[tuple[int, int, bool], ...]

    def served(self, t: int) -> tuple[int, int]:
        """(tokens of the queues before it, its own) up to time t of the phase."""
        before = 0
        for left, total, right in self.path:
            to_left = t * left // total
            if right:
                before += to_left
                t -= to_left
            else:
                t = to_left
        return before, t


def _paths(queues: list[tuple[str, int]], path: tuple = ()) -> Iterator[tuple[str, tuple]]:
    if len(queues) == 1:
        yield queues[0][0], path
    else:
        half = len(queues) // 2
        left, total = sum(n for _, n in queues[:half]), sum(n for _, n in queues)
        yield from _paths(queues[:half], (*path, (left, total, False)))
        yield from _paths(queues[half:], (*path, (left, total, True)))


def plan_phases(totals: Mapping[str, int], weights: Mapping[str, float] | None = None) -> dict[str, list[Share]]:
    """The phases of a mixture.  Queues without a weight come after the weighted
    ones ran dry, in proportion to their sizes; no weights: corpus proportions."""
    left = {q: n for q, n in sorted(totals.items()) if n > 0}
    done = dict.fromkeys(left, 0)
    out: dict[str, list[Share]] = {q: [] for q in left}
    begin = 0
    while left:
        given = {q: Fraction(weights[q]) for q in left if weights and weights.get(q, 0) > 0}
        w = given or {q: Fraction(n) for q, n in left.items()}
        rounds = min(left[q] / x for q, x in w.items())
        take = {q: min(left[q], int(rounds * x)) for q, x in w.items()}
        length = sum(take.values())
        for q, path in _paths([(q, n) for q, n in take.items() if n]):
            out[q].append(Share(done[q], begin, length, take[q], path))
            done[q] += take[q]
            left[q] -= take[q]
        left = {q: n for q, n in left.items() if n}
        begin += length
    return out


def place(shares: list[Share], x: int, n: int, window: int) -> Iterator[tuple[int, int, int, int]]:
    """Pieces (start, length, sequence, offset) of the queue's tokens x..x+n-1."""
    at, end = x, x + n
    for s in shares:
        if at >= end:
            return
        if at >= s.first + s.tokens:
            continue
        y = at - s.first
        w = (s.begin + max(0, y - len(s.path)) * s.length // s.tokens) // window
        before, own = s.served(max(w * window - s.begin, 0))
        while own > y:
            w -= 1
            before, own = s.served(max(w * window - s.begin, 0))
        while at < end and y < s.tokens:
            tb = min((w + 1) * window - s.begin, s.length)
            next_before, upto = s.served(tb)
            if upto > y:
                size = min(upto, end - s.first) - y
                ta = max(w * window - s.begin, 0)
                yield at - x, size, w, ta + s.begin - w * window + next_before - before + y - own
                at += size
                y += size
            before, own = next_before, upto
            w += 1


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, weights: Mapping[str, float] | None = None,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_queues: int = MAX_QUEUES) -> DataFrame:
    """One row per piece: ``<id_col>, start, length, doc_tokens, sequence_id,
    offset, source, ids`` (ids: little-endian unsigned 32-bit, as binary).

    Null text counts as empty, which is one end id; rows without a source form
    one queue; a null id stays null; repeated rows are packed each; other
    columns are ignored; an empty table gives an empty result.  ``weights``
    gives target shares by source.  With more than ``max_queues`` sources, those
    without a weight are dealt to ``max_queues`` queues by hash: every window then
    holds the target proportions of these groups, and all documents are packed.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    ids = written(tokenise(docs, tokenizer_path, id_col, text_col, source_col, end_id), "pack-ids")
    totals = written(ids.groupBy("task", "queue").agg(F.sum("n").alias("n")), "pack-totals")
    named = {f"={k}": v for k, v in weights.items()} if weights else None
    merged = totals.select("queue").distinct().count() > max_queues
    shared = F.concat(F.lit("#"), F.pmod(F.xxhash64("queue"), F.lit(max_queues)).cast("string"))
    line = F.when(F.col("queue").isin(list(named or ())), F.col("queue")).otherwise(shared) if merged else F.col("queue")
    totals = totals.withColumn("line", line)
    before = Window.partitionBy("line").orderBy("task", "queue").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("task", "queue", "line", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = totals.groupBy("line").agg(F.sum("n").alias("n")).collect()       # max_queues and one for each weight at most
    plan = docs.sparkSession.sparkContext.broadcast(plan_phases({r.line: r.n for r in rows}, named))
    small = totals.count() <= MAX_BROADCAST_ROWS
    placed = ids.join(F.broadcast(offsets) if small else offsets, ["task", "queue"])
    wide = _tokenizer(tokenizer_path).dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {k: batch.column(k).to_pylist() for k in ("queue", "line", "at", "n", "base")}
            out, row = [], []
            for i in range(batch.num_rows):
                doc = np.frombuffer(batch.column("ids")[i].as_buffer(), dtype=wide).astype("<u4").tobytes()
                for start, size, seq, offset in place(plan.value[cols["line"][i]], cols["base"][i] + cols["at"][i], cols["n"][i], window):
                    out.append((start, size, cols["n"][i], seq, offset, cols["queue"][i][1:] if cols["queue"][i] != "none" else None,
                                doc[4 * start:4 * (start + size)]))
                    row.append(i)
                if len(out) >= 5_000 or i == batch.num_rows - 1:
                    if out:
                        yield _pieces(batch, row, out)
                    out, row = [], []

    ddl = f"id {id_type}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string, ids binary"
    return placed.select("id", "queue", "line", "at", "n", "base", "ids").mapInArrow(run, ddl).withColumnRenamed("id", id_col)


def _pieces(batch: pa.RecordBatch, row: list[int], out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True))
    kinds = [pa.int64()] * 5 + [pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [batch.column("id").take(pa.array(row)), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
        names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "source", "ids"])
