"""Hard negatives by rotated one-bit codes.

* Vectors become integers, floor(scale * x), so that scores are exact.
* A vector is rotated (signs and Hadamard transforms from a seed) and coded by
  its signs, one bit a component.  Stored with the code is its alignment with
  the vector, alpha = <vector, code>; what the code misses, the residual, stands
  at right angles to it.  The residual is rotated and coded again, ``LEVELS``
  times in all.
* For an anchor, <anchor, code> comes from popcounts of the code with the bit
  planes of the rotated anchor.  By Cauchy-Schwarz the rest of the score is at
  most |anchor without its part along the code| * |residual|, which gives an
  interval that holds the score for certain: no row is lost.
* Only rows whose interval reaches what an anchor still needs are scored, as
  integers.

Anchors are taken in blocks of a bounded number; each block is broadcast, meets
all rows where they lie, and is given up before the next.  A task keeps the best
few of each anchor, so what is shuffled does not depend on the rows of a label
or on repeated vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.common import written
from eventlake.streaming.common import run_dir

SCALE = 256
LEVELS = 3                   # one-bit codes of a vector, each of what the one before misses
PLANES = 8                   # bits of a rotated anchor's components
BLOCK = 4096                 # anchors broadcast at a time, about
CHUNK = 256                  # rows that meet a block at a time
NEAREST = 5
_SLACK = 1e-9                # of the lengths' product, for rounding in the estimates


def rotated(x: np.ndarray, level: int) -> np.ndarray:
    """The rows of x under the level's rotation; their length is a power of two."""
    n, d = x.shape
    for turn in range(3):
        x = x * np.random.default_rng([level, turn]).choice([-1.0, 1.0], d)
        half = 1
        while half < d:
            x = x.reshape(n, d // (2 * half), 2, half)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
            half *= 2
        x = x / np.sqrt(d)
    return x


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), dtype=np.uint8)
    wide[:, :bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


@dataclass
class Codes:
    """Of n vectors: signs [levels, n, words], alignments [levels, n], lengths
    of what each level misses [levels, n]."""

    signs: np.ndarray
    align: np.ndarray
    rest: np.ndarray


def encode(v: np.ndarray, levels: int = LEVELS) -> Codes:
    left, signs, align, rest = v.astype(float), [], [], []
    root = np.sqrt(max(v.shape[1], 1))
    for level in range(levels):
        left = rotated(left, level)
        up = left >= 0
        a = np.abs(left).sum(axis=1) / root
        left = left - np.where(up, 1.0, -1.0) * (a / root)[:, None]
        signs.append(_packed(up))
        align.append(a)
        rest.append(np.sqrt((left * left).sum(axis=1)))
    return Codes(np.array(signs), np.array(align), np.array(rest))


@dataclass
class Anchors:
    """A block of anchors: their rows, and for each level their rotated
    components as bit planes: low + step * bits."""

    row: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    v: np.ndarray
    length: np.ndarray
    low: np.ndarray
    step: np.ndarray
    error: np.ndarray            # length of what the planes miss
    planes: np.ndarray           # [levels, planes, n, words]
    filled: np.ndarray           # bits set in each plane
    positives: np.ndarray | None = None      # scores [n, NEAREST], descending; nan where there is none
    positive_id: np.ndarray | None = None

    @classmethod
    def of(cls, row: np.ndarray, vec_id: np.ndarray, label: np.ndarray, v: np.ndarray, levels: int = LEVELS) -> Anchors:
        left, top = v.astype(float), (1 << PLANES) - 1
        low, step, error, planes, filled = [], [], [], [], []
        for level in range(levels):
            left = rotated(left, level)
            lo = left.min(axis=1)
            wide = np.maximum((left.max(axis=1) - lo) / top, 1e-12)
            q = np.clip(np.rint((left - lo[:, None]) / wide[:, None]), 0, top).astype(np.int64)
            off = left - lo[:, None] - q * wide[:, None]
            bits = np.stack([_packed((q >> p) & 1) for p in range(PLANES)])
            low.append(lo)
            step.append(wide)
            error.append(np.sqrt((off * off).sum(axis=1)))
            planes.append(bits)
            filled.append(np.bitwise_count(bits).sum(axis=2).astype(np.int64))
        return cls(row, vec_id, label, v, np.sqrt((v.astype(float) ** 2).sum(axis=1)), *map(np.array, (low, step, error, planes, filled)))

    def along(self, level: int, a: np.ndarray, code: np.ndarray) -> np.ndarray:
        """<anchor, code> of anchors a and as many codes, by popcounts."""
        d = self.v.shape[1]
        both = np.zeros(len(a), dtype=np.int64)
        for p in range(PLANES):
            hit = np.bitwise_count(self.planes[level, p, a] & code).sum(axis=1, dtype=np.int64)
            both += (2 * hit - self.filled[level, p, a]) << p
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        return (self.low[level, a] * (2 * ones - d) + self.step[level, a] * both) / np.sqrt(max(d, 1))

    def intervals(self, a: np.ndarray, n: np.ndarray, codes: Codes, wanted) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (a, n) whose interval ``wanted(a, low, high)`` accepts at
        every level, from the coarsest on."""
        sure = np.zeros(len(a))                      # of the estimate so far
        unsure = np.zeros(len(a))
        for level in range(len(codes.align)):
            g = self.along(level, a, codes.signs[level, n])
            alpha, e = codes.align[level, n], self.error[level, a]
            sure = sure + alpha * g
            unsure = unsure + alpha * e
            # what the anchor has along the code is at least |g| - e
            beside = np.sqrt(np.maximum(self.length[a] ** 2 - np.maximum(np.abs(g) - e, 0) ** 2, 0))
            half = unsure + beside * codes.rest[level, n] + _SLACK * self.length[a] * (codes.align[0, n] + codes.rest[0, n]) + 1e-6
            keep = np.flatnonzero(wanted(a, sure - half, sure + half))
            a, n, sure, unsure = a[keep], n[keep], sure[keep], unsure[keep]
        return a, n


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of x and y, pair by pair."""
    out = np.zeros(len(x), dtype=np.int64)
    for lo in range(0, len(x), 1 << 15):
        out[lo:lo + (1 << 15)] = np.einsum("ij,ij->i", x[lo:lo + (1 << 15)].astype(np.int64), y[lo:lo + (1 << 15)].astype(np.int64))
    return out


class Best:
    """The best few (slot, score, id) of each slot: higher scores first, then smaller ids."""

    def __init__(self, slots: int, few: int = NEAREST) -> None:
        self.few = few
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(slots, -np.inf)         # what a slot that is full still takes

    def add(self, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        if len(slot) == 0:
            return
        slot, score, vec_id = np.append(self.slot, slot), np.append(self.score, score), np.append(self.id, vec_id)
        order = np.lexsort((vec_id, -score, slot))
        slot, score, vec_id = slot[order], score[order], vec_id[order]
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        keep = rank < self.few
        self.slot, self.score, self.id = slot[keep], score[keep], vec_id[keep]
        full = rank == self.few - 1
        self.least[slot[full]] = score[full]


def _near(block: Anchors, best: Best, row, vec_id, label, v, codes: Codes) -> None:
    """Rows of an anchor's own label."""
    for one in np.intersect1d(block.label, label):
        mine, rows = np.flatnonzero(block.label == one), np.flatnonzero(label == one)
        a, n = np.repeat(mine, len(rows)), np.tile(rows, len(mine))
        other = block.row[a] != row[n]
        a, n = block.intervals(a[other], n[other], codes, lambda a, lo, hi: hi >= best.least[a])
        best.add(a, scores(block.v[a], v[n]), vec_id[n])


def _hard(block: Anchors, best: Best, row, vec_id, label, v, codes: Codes) -> None:
    """Rows of other labels between 80 % of a positive's score and that score."""
    a, n = np.divmod(np.arange(len(block.row) * len(row)), len(row))
    apart = (block.label[a] != label[n]) & ~np.isnan(block.positives[a, 0])
    least = best.least.reshape(len(block.row), NEAREST)

    def wanted(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), dtype=bool)
        for k in range(NEAREST):
            p = block.positives[a, k]
            out |= (lo <= p) & (hi >= np.maximum(0.8 * p, least[a, k]))      # false where p is nan
        return out

    a, n = block.intervals(a[apart], n[apart], codes, wanted)
    s = scores(block.v[a], v[n])
    for k in range(NEAREST):
        p = block.positives[a, k]
        some = np.flatnonzero(~np.isnan(p))
        p = p[some].astype(np.int64)
        fits = some[(80 * p <= 100 * s[some]) & (s[some] <= p)]
        best.add(a[fits] * NEAREST + k, s[fits], vec_id[n[fits]])


_CODED = "row bigint, vec_id bigint, label int, v array<int>, signs binary, align array<double>, rest array<double>"
_FOUND = "anchor bigint, anchor_id bigint, k int, positive_id bigint, positive_score bigint, id bigint, score bigint"


def _lists(x: np.ndarray) -> pa.Array:
    off = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.ascontiguousarray(x).reshape(-1)))


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    """Lists as rows of a matrix, filled up with zeros."""
    size = np.diff(column.offsets.to_numpy(zero_copy_only=False)) if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(column), width), dtype=kind)
    out[np.arange(width)[None, :] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(row, vec_id, label, v): the rows that take part, each with a number of its own."""
    whole = lambda x: F.floor(x.cast("double") * scale)
    limit = float(1 << 31)
    usable = F.forall(vec_col, lambda x: F.coalesce(F.abs(x.cast("double") * scale) < limit, F.lit(False)) & ~F.isnan(x))
    square = F.aggregate("v", F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double"))
    return (vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull()).where(usable)
            .select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"),
                    F.transform(vec_col, lambda x: whole(x).cast("int")).alias("v")).where(square < float(1 << 62)))


def coded(rows: DataFrame, width: int) -> DataFrame:
    """The rows with their one-bit codes, alignments and residual lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, (1 << 20) // width)
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                codes = encode(_matrix(part.column("v"), width, np.int32))
                signs = np.ascontiguousarray(codes.signs.transpose(1, 0, 2)).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in ("row", "vec_id", "label", "v")], pa.array([x.tobytes() for x in signs], pa.binary()),
                     _lists(codes.align.T), _lists(codes.rest.T)], names=["row", "vec_id", "label", "v", "signs", "align", "rest"])

    return rows.mapInArrow(run, _CODED)


def _searched(rows: DataFrame, shared, width: int, step) -> DataFrame:
    """Every row meets the anchors of a block; each task gives its best few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Anchors = shared.value
        per = 1 if block.positives is None else NEAREST
        best = Best(len(block.row) * per)
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                n = part.num_rows
                signs = np.frombuffer(b"".join(part.column("signs").to_pylist()), dtype="<u8").reshape(n, LEVELS, -1).transpose(1, 0, 2)
                codes = Codes(signs, _matrix(part.column("align"), LEVELS, float).T, _matrix(part.column("rest"), LEVELS, float).T)
                ids = [part.column(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "label")]
                step(block, best, *ids, _matrix(part.column("v"), width, np.int32), codes)
        a, k = best.slot // per, best.slot % per
        none = np.zeros(len(a), np.int64)
        pos = [none, none] if per == 1 else [block.positive_id[a, k], block.positives[a, k].astype(np.int64)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.row[a]), pa.array(block.vec_id[a]), pa.array(k.astype(np.int32)), *map(pa.array, pos), pa.array(best.id), pa.array(best.score)],
            names=["anchor", "anchor_id", "k", "positive_id", "positive_score", "id", "score"])

    return rows.mapInArrow(run, _FOUND)


def _first(found: DataFrame, few: int = NEAREST) -> DataFrame:
    order = Window.partitionBy("anchor", "k").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= few)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding",
                   label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``:
    for each anchor row and each of its NEAREST best rows of the same label, the
    NEAREST best rows of other labels that score 80 to 100 % of that positive.

    ``is_anchor`` tells the anchors by the column ``vec_id``; ``label`` may give
    another label, from the columns ``vec_id`` and ``label``.  Rows with a null
    id, label, vector or component, or a component that is not finite, take no
    part; nor do components of 2^31 / scale or more and vectors whose squared
    integer length reaches 2^62, whose scores may not fit a long.  Shorter
    vectors are filled up with zeros; an empty vector scores 0.  Rows that
    repeat an id are rows each, anchors too, and meet each other.  Ties go to
    the smaller id.  Other columns are ignored; no anchors, no rows.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vec_col, label_col, scale)
    if label is not None:
        rows = rows.withColumn("label", label.cast("int"))
    rows = written(rows, "hn-integers")
    size = rows.agg(F.max(F.size("v"))).first()[0] or 1
    width = 1 << max(int(size) - 1, 0).bit_length()
    rows = written(coded(rows, width), "hn-codes")
    anchors = rows.where(is_anchor).select("row", "vec_id", "label", "v")
    count = anchors.count()
    blocks = max(1, -(-count // BLOCK))
    to = run_dir(spark, "hn-found")
    ddl = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], ddl).write.parquet(to)
    for b in range(blocks if count else 0):
        own = anchors.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow().combine_chunks().sort_by("row")       # about BLOCK rows
        if own.num_rows == 0:
            continue
        cols = [own.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "label")]
        block = Anchors.of(*cols, _matrix(own.column("v").combine_chunks(), width, np.int32))
        shared = spark.sparkContext.broadcast(block)
        near = _first(_searched(rows, shared, width, _near)).select("anchor", "rank", "id", "score").toArrow()             # NEAREST a row of the block
        block.positives, block.positive_id = np.full((own.num_rows, NEAREST), np.nan), np.zeros((own.num_rows, NEAREST), np.int64)
        at = np.searchsorted(block.row, near.column("anchor").to_numpy()), near.column("rank").to_numpy() - 1
        block.positives[at], block.positive_id[at] = near.column("score").to_numpy(), near.column("id").to_numpy()
        again = spark.sparkContext.broadcast(block)
        _first(_searched(rows, again, width, _hard)).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.mode("append").parquet(to)
        shared.destroy()
        again.destroy()
    return spark.read.schema(ddl).parquet(to)
