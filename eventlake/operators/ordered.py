"""Shared primitives for order-dependent operators that must not collapse a
hot stream into one task.

* :func:`seq_number` — row number per key in a total order, computed per
  (key, block) plus prefix offsets from a small per-block summary.
* :func:`prev_value` — ``lag(t)`` per key across block borders the same way.
* :func:`gap_segments` — split each stream where consecutive rows are at
  least (or more than) ``gap`` apart; segments are independent for folds
  whose state expires after ``gap``.
* :func:`with_halo` — time blocks with a copied margin of the neighbouring
  block, so bounded-lookahead / lookback windows run per (stream, block).
* :func:`ordered_fold` — sorted per-partition Arrow batches into a Python
  fold whose memory is bounded by the fold's own window.

The summaries have one row per (key, block); Spark/AQE decides whether to
broadcast them from their runtime size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 1 << 22   # time steps per block


def _cols(cs: Iterable[str | Column]) -> list[Column]:
    return [c if isinstance(c, Column) else F.col(c) for c in cs]


def block_of(t: str | Column, block: int) -> Column:
    tc = t if isinstance(t, Column) else F.col(t)
    return F.floor(tc / F.lit(int(block))).cast("bigint")


def seq_number(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
               block: Column, out: str = "seq") -> DataFrame:
    """1-based row number per ``keys`` in ``order``.

    ``block`` must be monotone in ``order`` (a coarsening of its leading
    column).  Rows are numbered inside (keys, block) and shifted by the row
    count of all earlier blocks of the key, so no single task ever sees the
    whole key.
    """
    b = "__blk"
    d = df.withColumn(b, block)
    counts = d.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*keys, b, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    wr = Window.partitionBy(*keys, b).orderBy(*_cols(order))
    return (d.withColumn("__rn_in", F.row_number().over(wr))
             .join(offs, [*keys, b])
             .withColumn(out, (F.col("__rn_in") + F.col("__off")).cast("bigint"))
             .drop("__rn_in", "__off", b))


def prev_value(df: DataFrame, keys: Sequence[str], t: str, block: int,
               out: str = "prev_t", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Previous ``t`` per key in ``(t, *tiebreak)`` order (null for the first row)."""
    b = "__blk"
    d = df.withColumn(b, block_of(t, block))
    summ = d.groupBy(*keys, b).agg(F.max(t).alias("__bmax"))
    ws = Window.partitionBy(*keys).orderBy(b)
    summ = summ.select(*keys, b, F.lag("__bmax").over(ws).alias("__carry"))
    wr = Window.partitionBy(*keys, b).orderBy(t, *tiebreak)
    return (d.withColumn("__lag", F.lag(t).over(wr))
             .join(summ, [*keys, b])
             .withColumn(out, F.coalesce("__lag", "__carry"))
             .drop("__lag", "__carry", b))


def gap_segments(df: DataFrame, keys: Sequence[str], t: str, gap: int, block: int = DEFAULT_BLOCK,
                 strict: bool = False, out: str = "seg_start", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Label each row with the start time of its gap segment.

    A new segment starts at the first row of a key and wherever
    ``t - prev_t >= gap`` (``> gap`` when ``strict``).
    """
    d = prev_value(df, keys, t, block, "__prev", tiebreak)
    diff = F.col(t) - F.col("__prev")
    brk = F.col("__prev").isNull() | ((diff > gap) if strict else (diff >= gap))
    b = "__blk"
    d = d.withColumn(b, block_of(t, block)).withColumn("__bt", F.when(brk, F.col(t)))
    # RANGE frame: all rows with the same t see the same boundaries, so
    # duplicates never straddle a segment border whatever their order.
    wr = (Window.partitionBy(*keys, b).orderBy(t)
          .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("__inblk", F.max("__bt").over(wr))
    summ = d.groupBy(*keys, b).agg(F.max("__bt").alias("__last"))
    ws = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.select(*keys, b, F.max("__last").over(ws).alias("__carry"))
    return (d.join(summ, [*keys, b])
             .withColumn(out, F.coalesce("__inblk", "__carry"))
             .drop("__prev", "__bt", "__inblk", "__carry", b))


def with_halo(df: DataFrame, t: str, block: int, halo: int, direction: str) -> DataFrame:
    """Assign ``blk = floor(t/block)``; copy rows into a neighbour block as halo.

    direction='forward': a block also gets the first ``halo`` steps of the next
    block (for windows that look ahead up to ``halo``).  direction='backward':
    a block also gets the last ``halo`` steps of the previous block.
    Requires ``halo <= block``; adds columns ``blk`` and ``is_halo``.
    """
    if halo > block:
        raise ValueError("halo must not exceed the block size")
    tc = F.col(t)
    blk = block_of(t, block)
    start = blk * F.lit(int(block))
    if direction == "forward":
        extra = F.when(tc - start < F.lit(int(halo)), F.struct((blk - 1).alias("blk"), F.lit(True).alias("is_halo")))
    elif direction == "backward":
        extra = F.when(start + F.lit(int(block)) - tc <= F.lit(int(halo)),
                       F.struct((blk + 1).alias("blk"), F.lit(True).alias("is_halo")))
    else:
        raise ValueError(direction)
    core = F.struct(blk.alias("blk"), F.lit(False).alias("is_halo"))
    copies = F.filter(F.array(core, extra), lambda x: x.isNotNull())
    return df.withColumn("__c", F.explode(copies)).select("*", "__c.blk", "__c.is_halo").drop("__c")


def ordered_fold(df: DataFrame, part_keys: Sequence[str], order: Sequence[str],
                 make_fold: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
                 schema: str, num_partitions: int | None = None) -> DataFrame:
    """Hash-partition by ``part_keys``, sort by ``part_keys + order`` inside each
    partition, and stream the sorted rows through a stateful pandas fold.

    ``make_fold()`` returns a callable fed consecutive sorted batches of one
    partition; it carries state across batches and must itself reset when the
    ``part_keys`` values change.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = df.repartition(n, *part_keys).sortWithinPartitions(*part_keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = make_fold()
        for pdf in batches:
            res = fold(pdf)
            if res is not None and len(res):
                yield res

    return parted.mapInPandas(run, schema)
