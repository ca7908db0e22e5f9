"""Associative recall over sparse patterns without the N x N matrix
(SURVEY F14, F15, I3).

Memory = (bank, pattern_id, neuron) rows; a cue = (bank, cue_id, neuron).
With ``a = k/N``, ``d_p = |xi_p & s| - a|s|`` and
``S_i = sum_{p contains i} d_p - [i in s](cnt_i (1-a)^2 + (P - cnt_i) a^2)``.
Splitting ``sum d_p = sum |xi_p & s| - a |s| cnt_i`` leaves per-neuron counts
``cnt_i`` and sums of overlaps: over the patterns of the cue's bank, held in one
row beside its cues, all steps in one task; of a bank of many patterns, and over
many neurons, over a sparse co-occurrence table.  Both are built once.
Every neuron of [0, N) is a candidate for the top-k (untouched neurons
score ``-a|s|cnt_i`` or 0).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake.functions.rng import hash_uniform
from eventlake.session import cut_lineage
from eventlake.streaming.common import run_dir

LARGE = 256         # patterns of a bank that are kept in one row, at most; no result depends on it
CUES = 1024         # cues of a bank that are kept in one row, about; no result depends on it
MEET = 1 << 20      # meetings of a cue with a pattern's neuron that are held at once


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet into the shared checkpoint folder."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _run_lengths(df: DataFrame, sorted_col: str, name: str) -> DataFrame:
    """df with a map, value -> how often the sorted array holds it, for the array."""
    n = F.size(sorted_col)
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(sorted_col, i) != F.get(sorted_col, i - 1)))
    df = df.withColumn("_ends", F.when(n > 0, ends).otherwise(F.array().cast("array<int>")))
    often = F.transform("_ends", lambda e, i: (e - F.coalesce(F.get("_ends", i - 1), F.lit(0))).cast("bigint"))
    return df.withColumn(name, F.map_from_arrays(F.transform("_ends", lambda e: F.get(sorted_col, e - 1)), often)).drop("_ends", sorted_col)


class MemoryIndex:
    """Per-bank tables reused by every recall step: pattern count P, neuron
    counts cnt, and every neuron of [0, N) ranked by (cnt asc, neuron asc) —
    the order in which neurons untouched by a cue compete (their field is
    ``-a|s|cnt``)."""

    extra: tuple[str, ...] = ()         # further columns of the memory that the counts need
    name = "bank"                       # a cue's bank, as the memory names it

    def counted(self, rows: DataFrame, by: list[str], name: str) -> DataFrame:
        return rows.groupBy("bank", *by).agg(F.count(F.lit(1)).alias(name))

    def held(self, patterns: DataFrame) -> DataFrame:
        """(bank, members): a bank's patterns in one row."""
        return patterns.groupBy("bank").agg(F.collect_list("members").alias("members"))

    def __init__(self, memory: DataFrame, n: int, checkpoint: bool = False):
        memory = memory.select("bank", "pattern_id", "neuron", *self.extra)
        self.memory = memory
        self.n = n
        self._checkpoint = checkpoint
        self._kept: dict[str, DataFrame] = {}

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table of the index, made at its first use and, with ``checkpoint``,
        materialised hash-partitioned on its key, so that later steps shuffle
        only the (small) cue side."""
        if name not in self._kept:
            df = make()
            if self._checkpoint:
                keys = [k for k in ("bank", "neuron") if k in df.columns]
                df = cut_lineage(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys))
            self._kept[name] = df
        return self._kept[name]

    @staticmethod
    def _together(rows: DataFrame) -> DataFrame:
        return rows.join(rows.select("bank", "pattern_id", F.col("neuron").alias("other")), ["bank", "pattern_id"])

    @property
    def pair(self) -> DataFrame:
        """Sparse co-occurrence: in how many patterns of the bank j and i are both set.
        sum_{p has i} |p & s| = sum_{j in s} together(j, i), so a step needs neither
        patterns nor (cue, pattern) pairs; its size is sum |p|^2, whatever the cues."""
        return self._once("pair", lambda: self.counted(self._together(self.memory), ["neuron", "other"], "together"))

    @property
    def P(self) -> DataFrame:
        return self._once("P", lambda: self.counted(self.memory.select("bank", "pattern_id", *self.extra).where("pattern_id IS NOT NULL").distinct(), [], "P"))

    @property
    def cnt(self) -> DataFrame:
        return self._once("cnt", lambda: self.counted(self.memory, ["neuron"], "cnt"))

    # ---- array form: a bank of few patterns is one row of them
    @property
    def patterns(self) -> DataFrame:
        """(bank, pattern_id, members, size): the patterns as arrays, and their rows."""
        if "patterns" not in self._kept:
            self._kept["patterns"] = kept(self.memory.where("bank IS NOT NULL AND pattern_id IS NOT NULL").groupBy(
                "bank", "pattern_id", *self.extra).agg(F.collect_list("neuron").alias("members"), F.count(F.lit(1)).alias("size")), "memory-patterns")
        return self._kept["patterns"]

    @property
    def large(self) -> DataFrame | None:
        """The banks of too many patterns for one row: they keep the counted
        pairs, at most n^2 a bank.  None: there are none."""
        if "large" not in self._kept:
            banks = self.patterns.groupBy("bank").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > LARGE).select("bank")
            self._kept["large"] = None if banks.isEmpty() else banks
        return self._kept["large"]

    @property
    def large_memory(self) -> DataFrame:
        return self.memory.where("pattern_id IS NOT NULL AND neuron IS NOT NULL").join(F.broadcast(self.large), "bank")

    @property
    def large_pair(self) -> DataFrame:
        return self._once("large_pair", lambda: self.counted(self._together(self.large_memory), ["neuron", "other"], "together"))

    @property
    def bank_rows(self) -> DataFrame:
        """(bank, members): the patterns of every bank that is not large."""
        return self.held(self.patterns if self.large is None else self.patterns.join(F.broadcast(self.large), "bank", "left_anti"))

    def split(self, sets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The cues of the banks in one row, and those of large ones."""
        if self.large is None:
            return sets, None
        large = self.large.withColumnRenamed("bank", "_large")
        on = F.col(self.name) == F.col("_large")
        return sets.join(F.broadcast(large), on, "left_anti"), sets.join(F.broadcast(large), on, "left_semi")

    @property
    def bank_arrays(self) -> DataFrame:
        """(bank, cmap, P): a large bank's neuron -> count map and the number of
        its patterns; once per index."""
        def make() -> DataFrame:
            cnt = self.counted(self.large_memory, ["neuron"], "cnt").groupBy("bank").agg(F.map_from_entries(F.collect_list(F.struct("neuron", "cnt"))).alias("cmap"))
            of = self.counted(self.patterns.join(F.broadcast(self.large), "bank"), [], "P")
            return of.join(cnt, "bank", "left").select("bank", "cmap", "P")
        return self._once("bank_arrays", make)

    def overlaps(self, sets: DataFrame) -> DataFrame:
        """Every cue (bank, cue_id, s) of a large bank beside its bank's arrays, and
        ``omap``: neuron -> sum of |p & s| over the patterns p that hold it."""
        cues = sets.select("bank", "cue_id", F.explode("s").alias("neuron"))
        summed = (cues.join(self.large_pair, ["bank", "neuron"]).groupBy("bank", "cue_id", F.col("other").alias("neuron")).agg(F.sum("together").alias("O"))
                  .groupBy("bank", "cue_id").agg(F.map_from_entries(F.collect_list(F.struct("neuron", "O"))).alias("omap")))
        return sets.join(self.bank_arrays, "bank").join(summed, ["bank", "cue_id"], "left")

    def untouched(self, most: Column) -> Column:
        """The first ``most`` neurons of [0, N) by (cnt, neuron), from a bank's ``cmap``."""
        none = F.array().cast("array<int>")
        empty = F.array_except(F.sequence(F.lit(0), F.lit(self.n - 1)), F.coalesce(F.map_keys("cmap"), none))
        own = F.filter(F.map_entries("cmap"), lambda e: (e["key"] >= 0) & (e["key"] < F.lit(self.n)))
        counted = F.sort_array(F.transform(own, lambda e: F.struct(e["value"].alias("cnt"), e["key"].alias("neuron"))))
        enough = F.lit(self.n) - F.coalesce(F.size(F.map_keys("cmap")), F.lit(0)) >= most       # then the others need no sorting
        return F.slice(F.when(enough, empty).otherwise(F.concat(empty, F.coalesce(F.transform(counted, lambda x: x["neuron"]), none))), F.lit(1), most)

    @property
    def ranked(self) -> DataFrame:
        """The untouched order as rows, for the step over many neurons."""
        def make() -> DataFrame:
            spine = self.P.select("bank", F.explode(F.sequence(F.lit(0), F.lit(self.n - 1))).alias("neuron"))
            w = Window.partitionBy("bank").orderBy(F.col("c0"), F.col("neuron"))
            return (spine.join(self.cnt, ["bank", "neuron"], "left")
                    .withColumn("c0", F.coalesce(F.col("cnt"), F.lit(0)))
                    .withColumn("rank", F.row_number().over(w)).select("bank", "rank", "neuron"))
        return make()


class NestedIndex(MemoryIndex):
    """One index for several load levels: a bank at load j stores the patterns
    of ``level`` j or less.  Every pattern is collected once, and every row of a
    large bank (and of its pairs) counted once, for all loads.
    Banks are named (bank, load)."""

    extra = ("level",)
    name = "bank.bank"

    def __init__(self, memory: DataFrame, n: int, loads: int, checkpoint: bool = False):
        self.loads = loads
        super().__init__(memory, n, checkpoint)

    def counted(self, rows: DataFrame, by: list[str], name: str) -> DataFrame:
        each = F.array(*[F.struct(F.lit(j).alias("load"), F.count_if(F.col("level") <= j).alias("n")) for j in range(self.loads)])
        return (rows.groupBy("bank", *by).agg(each.alias("each")).select("bank", *by, F.explode("each").alias("x")).where("x.n > 0")
                .select(F.struct("bank", F.col("x.load").alias("load")).alias("bank"), *by, F.col("x.n").alias(name)))

    def held(self, patterns: DataFrame) -> DataFrame:
        rows = patterns.groupBy("bank").agg(F.collect_list(F.struct("level", "members")).alias("each")).select(
            "bank", "each", F.explode(F.sequence(F.lit(0), F.lit(self.loads - 1))).alias("load"))
        stored = F.transform(F.filter("each", lambda p: p["level"] <= F.col("load")), lambda p: p["members"])
        return rows.select(F.struct("bank", "load").alias("bank"), stored.alias("members")).where(F.size("members") > 0)


def load_levels(memory: DataFrame, loads: Sequence[float], seed: int) -> DataFrame:
    """The memory with ``level``, the first of the rising load shares that stores
    a pattern.  A pattern's hash decides, so loads are nested, need no ranking,
    and a bank may be of any size."""
    u = hash_uniform(seed, F.col("pattern_id"))
    level = F.lit(len(loads) - 1)
    for j in range(len(loads) - 2, -1, -1):
        level = F.when(u < loads[j], F.lit(j)).otherwise(level)
    return memory.withColumn("level", level)


def capacity_sweep(memory: DataFrame, noises: Sequence[float], loads: Sequence[float], n: int, k: int, alien: Column,
                   steps: int = 8, floor: float = 0.9, seed: int = 0) -> DataFrame:
    """Recall over noise and load: ``bank, drop_fraction, load, stored,
    mean_recall, knee``, one row per bank, noise and load that stores a pattern.

    At a load every stored pattern is a cue, without the neurons that the noise
    drops and with the neuron ``alien``; cues run to their fixed point (or
    ``steps``).  ``mean_recall`` is the mean share of the patterns' own neurons
    found; ``knee`` is the number of patterns stored at the least load whose
    mean is under ``floor``, null if there is none.  Rows with a null take no
    part; repeated rows count once; an empty memory gives an empty result."""
    memory = memory.select("bank", "pattern_id", "neuron").na.drop().distinct()
    index = NestedIndex(load_levels(memory, loads, seed), n, len(loads), checkpoint=True)
    each = index.patterns.select("*", luck(seed).alias("luck"), F.explode(F.sequence("level", F.lit(len(loads) - 1))).alias("load")).select(
        "pattern_id", "members", "luck", F.struct("bank", "load").alias("bank"), F.explode(F.array(*[F.lit(float(x)) for x in noises])).alias("drop"))
    sets = each.select("bank", F.struct("pattern_id", "drop", "members").alias("cue_id"), damaged(F.col("drop"), alien).alias("s"))
    share = F.size(F.array_intersect("new", "cue_id.members")) / F.size("cue_id.members")
    rows = (recall_sets(index, sets, n, k, steps).groupBy("bank", F.col("cue_id.drop").alias("drop"))
            .agg(F.count(F.lit(1)).alias("stored"), F.avg(share).alias("mean_recall")))
    rows = rows.select("bank.bank", F.col("drop").alias("drop_fraction"), F.element_at(F.array(*[F.lit(float(x)) for x in loads]), F.col("bank.load") + 1).alias("load"),
                       "stored", "mean_recall")
    knee = F.min(F.when(F.col("mean_recall") < floor, F.col("stored"))).over(Window.partitionBy("bank", "drop_fraction"))
    return rows.withColumn("knee", knee)


def luck(seed: int) -> Column:
    """The uniform number of every neuron of a pattern (pattern_id, members) that decides which noise drops it."""
    return F.transform("members", lambda i: hash_uniform(seed, F.col("pattern_id"), i))


def damaged(drop: Column, alien: Column) -> Column:
    """A pattern (pattern_id, members, luck) as a cue: without the neurons that the noise drops, with the neuron ``alien``."""
    left = F.filter("members", lambda i, at: F.get("luck", at) >= drop)
    return F.array_compact(F.array_distinct(F.concat(left, F.array(alien.cast("int")))))


def recall_step(memory, cues: DataFrame, n: int, k: int, dense_limit: int = 512, as_sets: bool = False) -> DataFrame:
    """One kWTA step for every cue: (bank, cue_id, neuron) of the new active set,
    or (bank, cue_id, new) ``as_sets``.  Cues are rows of neurons or, up to
    ``dense_limit``, sets (bank, cue_id, s).

    Candidates per cue: neurons touched by an overlapping pattern or active
    in the cue, plus the first ``k + |touched|`` neurons of the bank's
    untouched order — at least k untouched ones are among them, so the
    top-k over all N neurons is exact while only O(|touched| + k) rows
    per cue are scored.  For ``n <= dense_limit`` all N neurons are scored
    directly (bounded per cue, fewer shuffles); both forms are exact.
    """
    idx = memory if isinstance(memory, MemoryIndex) else MemoryIndex(memory, n)
    a = k / n
    hi2, lo2 = (1 - a) ** 2, a * a
    if n <= dense_limit:
        return recall_sets(idx, cue_sets(cues), n, k, 1).select("bank", "cue_id", F.col("new") if as_sets else F.explode("new").alias("neuron"))
    else:
        cues = cues.select("bank", "cue_id", "neuron")
        m = cues.groupBy("bank", "cue_id").agg(F.count(F.lit(1)).alias("m"))
        o = (cues.join(idx.pair, ["bank", "neuron"]).groupBy("bank", "cue_id", F.col("other").alias("neuron"))
             .agg(F.sum("together").alias("O")))
        touched = o.select("bank", "cue_id", "neuron").unionByName(cues).distinct()
        nt = touched.groupBy("bank", "cue_id").agg(F.count(F.lit(1)).alias("nt"))
        fill = (nt.select("bank", "cue_id", F.explode(F.sequence(F.lit(1), F.least(F.lit(n), F.col("nt") + F.lit(k))))
                          .alias("rank"))
                .join(idx.ranked, ["bank", "rank"]).select("bank", "cue_id", "neuron"))
        cand = touched.unionByName(fill).distinct()
    act = cues.withColumn("active", F.lit(True))
    s = (cand.join(o, ["bank", "cue_id", "neuron"], "left")
         .join(idx.cnt, ["bank", "neuron"], "left")
         .join(act, ["bank", "cue_id", "neuron"], "left")
         .join(m, ["bank", "cue_id"])
         .join(idx.P, "bank"))
    c = F.coalesce(F.col("cnt"), F.lit(0)).cast("double")
    field = (F.coalesce(F.col("O"), F.lit(0)).cast("double") - F.lit(a) * F.col("m") * c
             - F.when(F.col("active"), c * F.lit(hi2) + (F.col("P") - c) * F.lit(lo2)).otherwise(F.lit(0.0)))
    w = Window.partitionBy("bank", "cue_id").orderBy(F.col("S").desc(), F.col("neuron"))
    return (s.withColumn("S", field).withColumn("rk", F.row_number().over(w))
            .filter(F.col("rk") <= k).select("bank", "cue_id", "neuron"))


def cue_sets(cues: DataFrame) -> DataFrame:
    """(bank, cue_id, s) of cue rows; sets stay as they are."""
    return cues if "s" in cues.columns else cues.groupBy("bank", "cue_id").agg(F.collect_set("neuron").alias("s"))


class _Banks:
    """Some banks' patterns and cues as flat arrays: the fields of a step for all neurons, all cues at once."""

    def __init__(self, members: pa.Array, cues: pa.Array, n: int, k: int):
        self.n, self.k, self.a = n, k, k / n
        patterns, sets = members.flatten(), cues.flatten().field("s")
        value, own = patterns.flatten().to_numpy().astype(np.int64), sets.flatten().to_numpy().astype(np.int64)
        strange = np.unique(np.concatenate([x[(x < 0) | (x >= n)] for x in (value, own)]))
        neurons = np.concatenate([strange[strange < 0], np.arange(n), strange[strange >= n]])      # in order, for ties
        self.neurons, self.width, self.usual = neurons, len(neurons), (neurons >= 0) & (neurons < n)
        of = lambda x: np.searchsorted(neurons, x)
        lengths = lambda lists: np.diff(lists.offsets.to_numpy())
        self.P = lengths(members)
        self.first_pattern = np.cumsum(self.P) - self.P
        self.column, size = of(value), lengths(patterns)
        self.pattern = np.repeat(np.arange(len(size)), size)
        ends = np.append(0, np.cumsum(size))
        self.first, until = ends[self.first_pattern], ends[self.first_pattern + self.P]
        self.entries = until - self.first
        bank = np.repeat(np.arange(len(self.P)), self.entries)
        self.cnt = np.bincount(bank * self.width + self.column, minlength=len(self.P) * self.width).reshape(-1, self.width).astype(float)
        self.bank = np.repeat(np.arange(len(self.P)), lengths(cues))
        self.sets = np.zeros((len(self.bank), self.width), dtype=bool)
        self.sets[np.repeat(np.arange(len(self.bank)), lengths(sets)), of(own)] = True

    def _overlaps(self, sets: np.ndarray, bank: np.ndarray) -> np.ndarray:
        """[cue, neuron]: the sum of |p & s| over the patterns p that hold the neuron."""
        entries, patterns = self.entries[bank], self.P[bank]
        cue = np.repeat(np.arange(len(bank)), entries)
        at = np.arange(len(cue)) - np.repeat(np.cumsum(entries) - entries - self.first[bank], entries)
        met = self.pattern[at] + np.repeat(np.cumsum(patterns) - patterns - self.first_pattern[bank], entries)
        column = self.column[at]
        shared = np.bincount(met, sets[cue, column], minlength=int(patterns.sum()))[met]
        some = np.flatnonzero(shared)
        return np.bincount(cue[some] * self.width + column[some], shared[some], minlength=sets.size).reshape(sets.shape)

    def step(self, sets: np.ndarray, bank: np.ndarray) -> np.ndarray:
        """The new sets, in the terms and the order of :func:`_step_arrays`."""
        o, c, m = self._overlaps(sets, bank), self.cnt[bank], sets.sum(axis=1).astype(float)
        field = o - (self.a * m)[:, None] * c
        at = np.nonzero(sets)
        c_at = c[at]
        field[at] -= c_at * (1 - self.a) ** 2 + (self.P[bank[at[0]]] - c_at) * (self.a * self.a)
        empty = m == 0
        field[empty] = -c[empty]                        # neurons that no cue touches, by their counts
        field[:, ~self.usual] = np.where((o > 0) | sets, field, -np.inf)[:, ~self.usual]
        new, rows = np.zeros_like(sets), np.arange(len(sets))
        for _ in range(min(self.k, self.width)):        # the first of equal fields is the least neuron
            best = field.argmax(axis=1)
            new[rows, best] |= field[rows, best] > -np.inf
            field[rows, best] = -np.inf
        return new

    def settle(self, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """The sets at their fixed point or after ``steps``, and the steps used."""
        used = np.full(len(self.bank), steps, dtype=np.int32)
        weight = np.cumsum(self.entries[self.bank] + self.width) // MEET
        for some in np.split(np.arange(len(self.bank)), np.flatnonzero(np.diff(weight)) + 1):
            left = some
            for step in range(1, steps + 1):
                old = self.sets[left]
                new = self.step(old, self.bank[left])
                self.sets[left] = new
                changed = (new != old).any(axis=1)
                used[left[~changed]] = step
                left = left[changed]
                if not len(left):
                    break
        return self.sets, used


def recall_sets(idx: MemoryIndex, sets: DataFrame, n: int, k: int, steps: int) -> DataFrame:
    """(bank, cue_id, new, steps_used) of cues (bank, cue_id, s): the sets at
    their fixed point or after ``steps``.

    Patterns and cues of a bank meet in one row, some hundred cues of a bank at
    most, and stay there for all steps; large banks take the counted pairs."""
    sets = kept(sets, "memory-cues")
    small, large = idx.split(sets)
    busy = small.groupBy("bank").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > CUES).select("bank", F.ceil(F.col("m") / CUES).alias("parts"))
    part = F.lit(0)
    if not busy.isEmpty():
        small = small.join(F.broadcast(busy), "bank", "left")
        part = F.pmod(F.xxhash64("cue_id"), F.coalesce("parts", F.lit(1)))
    rows = small.groupBy("bank", part.alias("part")).agg(F.collect_list(F.struct("cue_id", "s")).alias("cues")).join(idx.bank_rows, "bank").select("bank", "members", "cues")
    wide = any(isinstance(t.elementType, T.LongType) for t in (sets.schema["s"].dataType, idx.patterns.schema["members"].dataType))
    neuron = T.LongType() if wide else T.IntegerType()
    schema = T.StructType([T.StructField("bank", sets.schema["bank"].dataType), T.StructField("cue_id", sets.schema["cue_id"].dataType),
                           T.StructField("new", T.ArrayType(neuron)), T.StructField("steps_used", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = np.diff(batch.column("cues").offsets.to_numpy())
            for some in np.split(np.arange(len(count)), np.flatnonzero(np.diff(np.cumsum(count + 1) // 4096)) + 1):
                if not len(some):
                    continue
                part = batch.slice(int(some[0]), len(some))
                banks = _Banks(part.column("members"), part.column("cues"), n, k)
                new, used = banks.settle(steps)
                off = np.append(0, np.cumsum(new.sum(axis=1))).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(off), pa.array(banks.neurons[np.nonzero(new)[1]], pa.int64() if wide else pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("bank").take(pa.array(banks.bank)), part.column("cues").flatten().field("cue_id"), found, pa.array(used)],
                                                 names=["bank", "cue_id", "new", "steps_used"])

    out = rows.mapInArrow(run, schema)
    return out if large is None else out.unionByName(_recall_large(idx, large, n, k, steps))


def _recall_large(idx: MemoryIndex, sets: DataFrame, n: int, k: int, steps: int) -> DataFrame:
    """The same for cues of large banks, step by step."""
    parts, active = [], sets
    for step in range(1, steps + 1):
        res = cut_lineage(_step_arrays(idx, active, n, k))
        done = res if step == steps else res.filter(~F.col("changed"))
        parts.append(done.select("bank", "cue_id", "new", F.lit(step).alias("steps_used")))
        active = res.filter(F.col("changed")).select("bank", "cue_id", F.col("new").alias("s"))
        if step == steps or active.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _step_arrays(idx: MemoryIndex, sets: DataFrame, n: int, k: int) -> DataFrame:
    """Array form of the step for cues of large banks: one row per cue carrying its
    touched neurons (<= N) and its bank's neuron ranking (N entries); the
    field and the top-k are evaluated with higher-order functions, so no
    per-(cue, neuron) rows are shuffled."""
    a = k / n
    hi2, lo2 = (1 - a) ** 2, a * a
    t = idx.overlaps(sets)
    t = t.withColumn("touched", F.array_union(F.coalesce(F.map_keys("omap"), F.array().cast("array<int>")), F.col("s")))
    m = F.size("s").cast("double")

    def cnt_of(i):
        return F.coalesce(F.element_at(F.col("cmap"), i), F.lit(0)).cast("double")

    def field(i):
        c = cnt_of(i)
        diag = F.when(F.array_contains(F.col("s"), i), c * F.lit(hi2) + (F.col("P") - c) * F.lit(lo2)).otherwise(F.lit(0.0))
        return F.coalesce(F.element_at(F.col("omap"), i), F.lit(0)).cast("double") - F.lit(a) * m * c - diag

    scored = F.transform("touched", lambda i: F.struct((-field(i)).alias("ns"), i.alias("neuron")))
    head = idx.untouched(F.size("touched") + F.lit(k))
    free = F.slice(F.filter(head, lambda i: ~F.array_contains(F.col("touched"), i)), 1, k)
    free_scored = F.transform(free, lambda i: F.struct((F.lit(a) * m * cnt_of(i)).alias("ns"), i.alias("neuron")))
    top = F.slice(F.sort_array(F.concat(scored, free_scored)), 1, k)
    new = F.sort_array(F.transform(top, lambda x: x["neuron"]))
    return t.select("bank", "cue_id", new.alias("new"), (new != F.sort_array(F.col("s"))).alias("changed"))


def recall(memory: DataFrame, cues: DataFrame, n: int, k: int, steps: int = 8, dense_limit: int = 512) -> DataFrame:
    """Iterate :func:`recall_step` until each cue's set is a fixed point or
    ``steps`` is reached; settled cues leave the loop.  Up to ``dense_limit``
    neurons a bank's cues run all steps in one task (:func:`recall_sets`); else the
    memory index is built and partitioned once, and the per-cue result is
    checkpointed each step (reliable checkpoint, shared folder), so lineage stays
    one step deep.  Cues as for the step.  Returns (bank, cue_id, neuron, steps_used)."""
    idx = memory if isinstance(memory, MemoryIndex) else MemoryIndex(memory, n, checkpoint=True)
    if n <= dense_limit:
        return recall_sets(idx, cue_sets(cues), n, k, steps).select("bank", "cue_id", F.explode("new").alias("neuron"), "steps_used")
    parts = []
    active = cut_lineage(cues.select("bank", "cue_id", "neuron"))
    for step in range(1, steps + 1):
        new = cut_lineage(recall_step(idx, active, n, k, dense_limit))
        if step == steps:
            parts.append(new.withColumn("steps_used", F.lit(step)))
            break
        changed = (active.select("bank", "cue_id", "neuron", F.lit(1).alias("d"))
                   .unionByName(new.select("bank", "cue_id", "neuron", F.lit(-1).alias("d")))
                   .groupBy("bank", "cue_id", "neuron").agg(F.sum("d").alias("d"))
                   .groupBy("bank", "cue_id").agg(F.max(F.abs("d")).alias("changed")))
        tagged = cut_lineage(new.join(changed, ["bank", "cue_id"]))
        parts.append(tagged.filter(F.col("changed") == 0).drop("changed").withColumn("steps_used", F.lit(step)))
        active = tagged.filter(F.col("changed") != 0).drop("changed")
        if active.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overlap(recalled: DataFrame, original: DataFrame) -> DataFrame:
    """Fraction of each stored pattern recovered: ``|recalled & original| / |original|``."""
    inter = recalled.join(original, ["bank", "cue_id", "neuron"]).groupBy("bank", "cue_id").agg(
        F.count(F.lit(1)).alias("hit"))
    size = original.groupBy("bank", "cue_id").agg(F.count(F.lit(1)).cast("double").alias("size"))
    return size.join(inter, ["bank", "cue_id"], "left").select(
        "bank", "cue_id", (F.coalesce(F.col("hit"), F.lit(0)) / F.col("size")).alias("overlap"))
