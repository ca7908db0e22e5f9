"""Exact deduplication by 128-bit content hash with a byte comparison.

Texts are grouped by (hash, text): the hash routes a text to its group, the
text itself is part of the grouping key, so the aggregate's key comparison is
the byte comparison and two texts with one hash fall into two groups.  The
aggregation combines on the map side, so a group of copies of any size reaches
the shuffle as one row per task.  Only (hash, digest, keep, size) go back to
the rows, by an equi-join that AQE may split where one group is hot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.common import ascii_lower

_P = "_xd_"


def content_hash(text: Column) -> Column:
    """128-bit content hash (md5 of the UTF-8 bytes, as hex)."""
    return F.md5(text)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                 normalise: Callable[[Column], Column] = ascii_lower,
                 hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: ``<id_col>, keep_id, group_size, kept, text_sha256``.

    ``keep`` is "smallest" or "largest" stable id.  Null text counts as empty.
    Empty texts are equal to each other.  Rows with a null id count in
    ``group_size`` and stay only when no row of their group has an id.  Rows
    equal in id and text are one document repeated: exactly one is kept.
    An empty table gives an empty result; other columns are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    norm = normalise(F.coalesce(F.col(text_col), F.lit("")))
    base = docs.select(F.col(id_col).alias(f"{_P}id"), norm.alias(f"{_P}t")).select(
        f"{_P}id", f"{_P}t", hash_fn(F.col(f"{_P}t")).alias(f"{_P}h"), F.sha2(f"{_P}t", 256).alias(f"{_P}d"))
    best = F.max if keep == "largest" else F.min
    by_bytes = base.groupBy(f"{_P}h", f"{_P}d", f"{_P}t").agg(
        best(f"{_P}id").alias(f"{_P}keep"), F.count(F.lit(1)).alias(f"{_P}n"))
    # two different texts under one (hash, digest) would make this label ambiguous: fail, never merge
    groups = (by_bytes.groupBy(f"{_P}h", f"{_P}d")
              .agg(F.max(f"{_P}keep").alias("keep_id"), F.max(f"{_P}n").alias("group_size"),
                   F.count(F.lit(1)).alias(f"{_P}m"))
              .where(F.when(F.col(f"{_P}m") > 1, F.raise_error(F.lit("two texts share hash and digest")).cast("boolean"))
                     .otherwise(F.lit(True)))
              .drop(f"{_P}m"))
    # number repeated rows before the join: keyed by id, so a hot group stays spread and its join can be split
    same = Window.partitionBy(f"{_P}id", f"{_P}h", f"{_P}d").orderBy(F.lit(0))
    numbered = base.select(f"{_P}id", f"{_P}h", f"{_P}d", F.row_number().over(same).alias(f"{_P}r"))
    # one joint key: the groups then pass an exchange of their own, without which AQE could not split a hot group's rows
    joint = F.concat(f"{_P}h", f"{_P}d")
    rows = (numbered.select(f"{_P}id", f"{_P}d", f"{_P}r", joint.alias(f"{_P}k"))
            .join(groups.select(joint.alias(f"{_P}k"), "keep_id", "group_size"), f"{_P}k"))
    kept = F.col(f"{_P}id").eqNullSafe(F.col("keep_id")) & (F.col(f"{_P}r") == 1)
    # without any id in the group every row is numbered by the same key, so exactly one is kept there too
    return rows.select(F.col(f"{_P}id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
                       kept.alias("kept"), F.col(f"{_P}d").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                      normalise: Callable[[Column], Column] = ascii_lower) -> DataFrame:
    """The documents that stay, with all their columns (same cases as above)."""
    verdict = exact_groups(docs, id_col, text_col, keep, normalise)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("none"))
    stays = verdict.where("kept").select(key.alias(f"{_P}k"), F.col("text_sha256").alias(f"{_P}d"))
    digest = F.sha2(normalise(F.coalesce(F.col(text_col), F.lit(""))), 256)
    left = (docs.withColumns({f"{_P}k": key, f"{_P}d": digest})
            .join(stays, [f"{_P}k", f"{_P}d"], "left_semi"))
    same = Window.partitionBy(f"{_P}k", f"{_P}d").orderBy(F.lit(0))
    return left.withColumn(f"{_P}r", F.row_number().over(same)).where(f"{_P}r = 1").drop(f"{_P}k", f"{_P}d", f"{_P}r")
