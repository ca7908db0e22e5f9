"""Mixing sources to target weights along a time-varying curriculum.

Built from DataFrame functions only.

* A source's schedule is a piecewise linear weight over training time 0 to 1.
  Its integral is the source's weight in the whole mix.
* Targets: the integrals share the budget (all words of the table) by weight;
  a target stops at ``max_epochs`` times its source's size and the excess goes
  to the others by weight.  That is min(cap, level * weight) at one level, the
  greatest of (budget - caps before) / (weights from here on) over the sources
  by cap / weight.
* A source's documents stand in a fixed shuffled order (keyed md5 of the id),
  repeated until the target; the last copy is cut, so the words taken equal the
  target to the nearest word.
* Demand: by time t a source has given target * W(t) / W(1) words, W being the
  integral of its schedule.  The middle word of every copy is put through the
  inverse of that function, a root of a quadratic in one segment of the
  schedule; the result is the copy's training position, by which the mix is
  range-sorted.

A hot source is dealt into buckets of the shuffled order; running word counts
are kept per (source, bucket) and per bucket, so no task holds a whole source.
Ranks and running sums over the sources use one range-partitioned pass each,
so their number is not bounded either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.common import written

MAX_EPOCHS = 3
BUCKETS = 4096               # parts of a source's shuffled order; no result depends on it
WORD = r"[^\x20\x09-\x0D]+"

#: (time, weight) of the three kinds of source; they integrate to 1, 2 and 3
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (0.25, 2.0), (0.75, 2.5), (1.0, 1.5)),
    ((0.0, 2.0), (0.5, 3.0), (1.0, 4.0)),
)


def integral(knots: Sequence[tuple[float, float]]) -> float:
    """The area under a piecewise linear schedule."""
    return sum((v + w) * (y - x) / 2 for (x, v), (y, w) in zip(knots[:-1], knots[1:], strict=True))


def running(df: DataFrame, order: Sequence[Column], **sums: str) -> DataFrame:
    """df with, for each name=column in ``sums``, the sum of that column over all
    rows before this one in the given order, and ``_n`` rows before it.

    Rows are range-partitioned; only one row of sums per partition meets in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "mix-ranges")
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    named = {"_n": F.lit(1)} | {k: F.col(c) for k, c in sums.items()}
    parts = dealt.groupBy("_part").agg(*[F.sum(c).alias(k) for k, c in named.items()]).select(
        "_part", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_base") for k in named])
    return (dealt.withColumns({k: F.coalesce(F.sum(c).over(own), F.lit(0)) for k, c in named.items()})
            .join(F.broadcast(parts), "_part")             # at most n rows
            .withColumns({k: F.col(k) + F.col(f"{k}_base") for k in named})
            .drop("_part", *[f"{k}_base" for k in named]))


def ranked_weights(sources: DataFrame, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> DataFrame:
    """(source, weight, knots) of the sources by code point, null last, which
    take the given schedules in turn."""
    ranked = running(sources.select("source"), [F.col("source").asc_nulls_last()])
    kind = F.pmod("_n", F.lit(len(schedules)))
    knots = F.array(*[F.array(*[F.struct(F.lit(float(t)).alias("at"), F.lit(float(w)).alias("w")) for t, w in s]) for s in schedules])
    weights = F.array(*[F.lit(float(integral(s))) for s in schedules])
    return ranked.select("source", F.get(weights, kind.cast("int")).alias("weight"), F.get(knots, kind.cast("int")).alias("knots"))


def shared_targets(sources: DataFrame, budget: int, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources (source, source_size, weight, ...) with ``target``: the budget by
    weight, at most max_epochs times the size.  No weight, no target."""
    able = sources.where("weight > 0 and source_size > 0").withColumn("_cap", F.col("source_size") * F.lit(max_epochs))
    by_cap = running(able, [(F.col("_cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()], _caps="_cap", _ws="weight")
    total = F.lit(able.agg(F.sum("weight")).first()[0] or 1.0)
    level = by_cap.agg(F.max((F.lit(int(budget)) - F.col("_caps")) / (total - F.col("_ws")))).first()[0]
    share = F.least(F.col("source_size") * F.lit(float(max_epochs)), F.lit(float(level or 0.0)) * F.col("weight"))
    return sources.withColumn("target", F.when((F.col("weight") > 0) & (F.col("source_size") > 0), share).otherwise(F.lit(0.0)))


def position(share: Column, knots: Column, weight: Column) -> Column:
    """The time by which a source has given this share of its words: the inverse
    of the integral of its schedule."""
    n = F.size(knots)
    width = lambda i: F.get(knots, i)["at"] - F.get(knots, i - 1)["at"]
    area = lambda i: (F.get(knots, i - 1)["w"] + F.get(knots, i)["w"]) * width(i) / 2
    empty = F.struct(F.lit(0).alias("i"), (share * weight).alias("left"))
    # the first segment that holds what is left of the area, and what is left there
    found = F.aggregate(F.sequence(F.lit(1), n - 1), empty, lambda s, i: F.when(s["i"] > 0, s).when(
        (s["left"] < area(i)) | (i == n - 1), F.struct(i.alias("i"), s["left"].alias("left"))).otherwise(
        F.struct(F.lit(0).alias("i"), (s["left"] - area(i)).alias("left"))))

    def root(s: Column) -> Column:
        first, h = F.get(knots, s["i"] - 1), width(s["i"])
        slope = (F.get(knots, s["i"])["w"] - first["w"]) / h
        below = first["w"] + F.sqrt(F.greatest(first["w"] * first["w"] + 2 * slope * s["left"], F.lit(0.0)))
        step = F.coalesce(F.try_divide(2 * s["left"], below), F.lit(0.0))
        return first["at"] + F.least(F.greatest(step, F.lit(0.0)), h)

    return F.get(F.transform(F.array(found), root), F.lit(0))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, bucket, place): a document's words and its place in its
    source's shuffled order."""
    place = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit("none")))), 1, 12), 16, 10).cast("bigint")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), place.alias("place")).withColumn(
        "bucket", F.floor(F.col("place") * F.lit(BUCKETS) / F.lit(float(1 << 48))))


def curriculum(docs: DataFrame, schedule: DataFrame | None = None, max_epochs: int = MAX_EPOCHS, budget: int | None = None,
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: ``<id_col>, source, size, source_size, target,
    taken, copies array<struct<position, words>>``.

    ``schedule`` gives (source, weight, knots array<struct<at, w>>), ``weight``
    being the integral of the knots, which run from 0 to 1; without it the
    sources take SCHEDULES in turn.  A source that the schedule lacks has no
    target.  ``budget`` is the size of the mix, all words by default; what the
    caps leave over is not taken.

    Null text counts as empty; a document without words, or past its source's
    target, has no copies.  Null sources are one source.  Repeated rows are
    documents each; rows that repeat an id stand side by side, ordered by size.
    Other columns are ignored; an empty table gives an empty result.  The order
    of rows, partitions or runs changes nothing.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = written(sized(docs, id_col, text_col, source_col), "mix-sizes")
    buckets = written(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    sources = written(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), "mix-sources")
    schedule = ranked_weights(sources) if schedule is None else schedule
    planned = sources.alias("s").join(schedule.alias("w"), F.expr("s.source <=> w.source"), "left").select(
        "s.source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"), "knots")
    if budget is None:
        budget = sources.agg(F.sum("source_size")).first()[0] or 0
    planned = written(shared_targets(written(planned, "mix-weights"), budget, max_epochs), "mix-targets")

    # where each bucket's words begin in its source's order, and its source's plan
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = buckets.withColumn("base", F.coalesce(F.sum("words").over(along), F.lit(0)))
    begins = begins.alias("b").join(planned.alias("p"), F.expr("b.source <=> p.source")).select(
        F.coalesce(F.concat(F.lit("="), F.col("b.source")), F.lit("none")).alias("queue"), F.col("bucket").alias("b_bucket"),
        "base", "source_size", "target", "weight", "knots")
    inside = Window.partitionBy("queue", "bucket").orderBy("place", F.col("id").cast("string"), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (rows.withColumn("queue", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("none")))
              .withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d")
              .join(begins.alias("q"), (F.col("d.queue") == F.col("q.queue")) & (F.col("bucket") == F.col("b_bucket"))))
    wanted = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * max_epochs)
    first = F.col("base") + F.col("before")
    passes = F.sequence(F.lit(0), F.lit(max_epochs - 1))
    held = F.transform(passes, lambda k: F.least(F.greatest(F.col("wanted") - k * F.col("source_size") - F.col("first"), F.lit(0)), F.col("size")).cast("bigint"))
    middle = lambda words, k: (k * F.col("source_size") + F.col("first") + words / 2) / F.col("wanted")
    copies = F.filter(F.transform("held", lambda words, k: F.when(words > 0, F.struct(
        F.round(position(middle(words, k), F.col("knots"), F.col("weight")), 9).alias("position"), words.alias("words")))), lambda c: c.isNotNull())
    taken = F.aggregate("held", F.lit(0).cast("bigint"), lambda n, words: n + words)
    measured = placed.select(F.col("id").cast(id_type).alias(id_col), "source", "size", "source_size", "target", "knots", "weight",
                             first.alias("first"), wanted.alias("wanted")).withColumn("held", held)
    return measured.select(id_col, "source", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"))


def training_order(planned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix itself, range-sorted: one row per copy, ``<id_col>, source, epoch,
    position, words`` (the first ``words`` words of the document)."""
    each = planned.select(id_col, "source", F.posexplode("copies").alias("epoch", "c"))
    return each.select(id_col, "source", "epoch", "c.position", "c.words").orderBy("position", "source", id_col, "epoch")
