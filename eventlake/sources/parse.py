"""Text sources: numeric lines, serial logs, JSON events, outcome lines.

Each parser returns parsed rows; the ``*_rejects`` twins return the lines
that did not parse (dead letters) instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.schema import JSON_EVENT

# Fixed pattern: one strict decimal/scientific number token.  Python's float()
# also takes 'nan', 'inf' and '1_0'; Spark's cast takes '1d'.  Lines with such
# tokens are rejected rather than parsed differently by each engine.
NUMBER_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
WS = r"\s+"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _tokens(c: Column) -> Column:
    return F.split(_strip(F.regexp_replace(c, ",", " ")), WS)


def numeric_lines(lines: DataFrame, id_col: str = "line_id", text: str = "line") -> DataFrame:
    """Comma- or space-separated numbers -> (id, vals ARRAY<DOUBLE>); blank,
    '#' comments and garbage are dropped (see :func:`numeric_rejects`)."""
    # materialise the stripped line and its tokens once; the checks and the
    # conversion below only read these columns
    d = lines.select(id_col, _strip(F.col(text)).alias("__s"), _tokens(F.col(text)).alias("__toks"))
    ok = ((F.col("__s") != "") & ~F.col("__s").startswith("#")
          & F.forall("__toks", lambda x: x.rlike(NUMBER_RE)))
    return d.filter(ok).select(id_col, F.transform("__toks", lambda x: x.try_cast("double")).alias("vals"))


def numeric_rejects(lines: DataFrame, id_col: str = "line_id", text: str = "line") -> DataFrame:
    s = _strip(F.col(text))
    toks = _tokens(F.col(text))
    bad = (s == "") | s.startswith("#") | ~F.forall(toks, lambda x: x.rlike(NUMBER_RE))
    return lines.filter(bad).select(id_col, text)


def serial_log(lines: DataFrame, id_col: str = "line_id", text: str = "line") -> DataFrame:
    """'HH:MM:SS,d, t' -> drop everything up to the first comma, parse the rest.
    Lines without a comma (banners) and non-numeric remainders (header) drop."""
    rest = F.expr(f"CASE WHEN instr({text}, ',') > 0 THEN substr({text}, instr({text}, ',') + 1) END")
    return numeric_lines(lines.select(id_col, rest.alias("__rest")).filter(F.col("__rest").isNotNull()),
                         id_col, "__rest")


def json_events(messages: DataFrame, id_col: str = "line_id", text: str = "line") -> DataFrame:
    """``{"t": int, "channel": int}`` messages -> (id, t, channel); malformed or
    mistyped messages go to :func:`json_dead_letters`."""
    p = messages.select(id_col, F.from_json(F.col(text), JSON_EVENT, {"mode": "PERMISSIVE"}).alias("e"))
    return p.filter(F.col("e.t").isNotNull() & F.col("e.channel").isNotNull()).select(
        id_col, F.col("e.t").alias("t"), F.col("e.channel").alias("channel"))


def json_dead_letters(messages: DataFrame, id_col: str = "line_id", text: str = "line") -> DataFrame:
    p = messages.select(id_col, text, F.from_json(F.col(text), JSON_EVENT, {"mode": "PERMISSIVE"}).alias("e"))
    return p.filter(F.col("e").isNull() | F.col("e.t").isNull() | F.col("e.channel").isNull()).select(id_col, text)


def outcome(line: Column | str) -> Column:
    """'OUTCOME <r>' (case-insensitive prefix) -> r clamped to [-1, 1], else null."""
    c = line if isinstance(line, Column) else F.col(line)
    s = _strip(c)
    tok = F.get(F.split(s, WS), 1)
    val = tok.try_cast("double")
    ok = F.upper(s).startswith("OUTCOME") & F.coalesce(tok.rlike(NUMBER_RE), F.lit(False))
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), val)))
