"""Ingest queries: line parsers and count windows over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlake.functions.timecols import SQL_T_MS
from eventlake.operators import encode
from eventlake.plans.common import events, spikes
from eventlake.plans.registry import query
from eventlake.sources import adapters, parse
from eventlake.sources.tables import table

NUM_RE_SQL = parse.NUMBER_RE
WINDOW_ROWS = 4

# Lines derived from lineitem: numbers (comma / space / padded / exponent),
# comments, blanks and garbage, chosen by line number.
LINES_SQL = ("SELECT l_orderkey * 8 + l_linenumber AS line_id, CASE l_linenumber "
             "WHEN 1 THEN printf('%.2f, %.2f, %.2f', l_quantity, l_discount, l_tax) "
             "WHEN 2 THEN printf('%.2f %.2f %.2f', l_quantity, l_discount, l_tax) "
             "WHEN 3 THEN '# order ' || CAST(l_orderkey AS VARCHAR) "
             "WHEN 4 THEN '' "
             "WHEN 5 THEN 'nope,' || printf('%.2f', l_quantity) "
             "WHEN 6 THEN '  ' || printf('%.2f,%.2f   %.2f', l_quantity, l_discount, l_tax) || ' ' "
             "ELSE printf('%.2f', l_quantity) || 'e1, ' || printf('%.2f', l_tax) END AS line FROM lineitem")


def lines_df(spark, sf):
    li = table(spark, sf, "lineitem")
    ln = F.col("l_linenumber")
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    line = (F.when(ln == 1, F.format_string("%.2f, %.2f, %.2f", q, d, t))
            .when(ln == 2, F.format_string("%.2f %.2f %.2f", q, d, t))
            .when(ln == 3, F.concat(F.lit("# order "), F.col("l_orderkey").cast("string")))
            .when(ln == 4, F.lit(""))
            .when(ln == 5, F.concat(F.lit("nope,"), F.format_string("%.2f", q)))
            .when(ln == 6, F.concat(F.lit("  "), F.format_string("%.2f,%.2f   %.2f", q, d, t), F.lit(" ")))
            .otherwise(F.concat(F.format_string("%.2f", q), F.lit("e1, "), F.format_string("%.2f", t))))
    return li.select((F.col("l_orderkey") * 8 + ln).alias("line_id"), line.alias("line"))


def _explode_vals(df):
    return df.select("line_id", F.posexplode_outer("vals").alias("i", "v")).select(
        "line_id", F.col("i").cast("bigint").alias("i"), "v")


_PARSE_SQL = ("SELECT line_id, toks FROM (SELECT line_id, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s, "
              "string_split_regex(regexp_replace(replace(line, ',', ' '), '^\\s+|\\s+$', '', 'g'), '\\s+') AS toks "
              "FROM ({src})) WHERE s <> '' AND NOT starts_with(s, '#') "
              f"AND list_bool_and(list_transform(toks, lambda x: regexp_full_match(x, '{NUM_RE_SQL}')))")
_UNNEST = ("SELECT line_id, generate_subscripts(toks, 1) - 1 AS i, CAST(unnest(toks) AS DOUBLE) AS v "
           "FROM ({p})")


@query("parse_numeric_lines", _UNNEST.format(p=_PARSE_SQL.format(src=LINES_SQL)))
def q_parse_numeric(spark, sf):
    return _explode_vals(parse.numeric_lines(lines_df(spark, sf)))


@query("numeric_rejects",
       "SELECT line_id FROM (SELECT line_id, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s, "
       "string_split_regex(regexp_replace(replace(line, ',', ' '), '^\\s+|\\s+$', '', 'g'), '\\s+') AS toks "
       f"FROM ({LINES_SQL})) WHERE s = '' OR starts_with(s, '#') "
       f"OR NOT list_bool_and(list_transform(toks, lambda x: regexp_full_match(x, '{NUM_RE_SQL}')))")
def q_numeric_rejects(spark, sf):
    return parse.numeric_rejects(lines_df(spark, sf)).select("line_id")


SERIAL_SQL = ("SELECT l_orderkey * 8 + l_linenumber AS line_id, CASE WHEN l_linenumber = 1 THEN 'timestamp,distance,temp' "
              "WHEN l_linenumber = 7 THEN 'boot ok' ELSE printf('%02d:%02d:%02d', l_linenumber, l_orderkey % 60, "
              "l_partkey % 60) || ',' || printf('%.2f, %.2f', l_quantity, l_tax) END AS line FROM lineitem")


def serial_df(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_id"), serial_line().alias("line"))


def serial_line():
    """Serial capture line of a lineitem row: header / banner / 'HH:MM:SS,d, t'."""
    ln = F.col("l_linenumber")
    line = (F.when(ln == 1, F.lit("timestamp,distance,temp")).when(ln == 7, F.lit("boot ok"))
            .otherwise(F.concat(F.format_string("%02d:%02d:%02d", ln, F.pmod("l_orderkey", F.lit(60)),
                                                F.pmod("l_partkey", F.lit(60))), F.lit(","),
                                F.format_string("%.2f, %.2f", F.col("l_quantity"), F.col("l_tax")))))
    return line


@query("parse_serial_log",
       _UNNEST.format(p=_PARSE_SQL.format(
           src=f"SELECT line_id, substr(line, instr(line, ',') + 1) AS line FROM ({SERIAL_SQL}) "
               "WHERE instr(line, ',') > 0")))
def q_serial(spark, sf):
    return _explode_vals(parse.serial_log(serial_df(spark, sf)))


JSON_SQL = (f"SELECT event_id AS line_id, CASE event_type "
            f"WHEN 'error' THEN '{{\"t\":' || CAST({SQL_T_MS} AS VARCHAR) || ',\"channel\":' "
            f"WHEN 'signup' THEN '{{\"t\":\"x' || CAST({SQL_T_MS} AS VARCHAR) || '\",\"channel\":' || "
            "CAST(user_id AS VARCHAR) || '}' "
            f"ELSE '{{\"t\":' || CAST({SQL_T_MS} AS VARCHAR) || ',\"channel\":' || CAST(user_id AS VARCHAR) || '}}' "
            "END AS line FROM events")


def json_df(spark, sf):
    return json_lines(events(spark, sf))


def json_lines(ev):
    """Events -> JSON messages; error rows are truncated and signup rows carry a
    mistyped t, so both land in the dead-letter path."""
    from eventlake.functions.timecols import millis_since
    t = millis_since("ts").cast("string")
    et = F.col("event_type")
    u = F.col("user_id").cast("string")
    line = (F.when(et == "error", F.concat(F.lit('{"t":'), t, F.lit(',"channel":')))
            .when(et == "signup", F.concat(F.lit('{"t":"x'), t, F.lit('","channel":'), u, F.lit("}")))
            .otherwise(F.concat(F.lit('{"t":'), t, F.lit(',"channel":'), u, F.lit("}"))))
    return ev.select(F.col("event_id").alias("line_id"), line.alias("line"))


@query("parse_json_events",
       f"SELECT line_id, t, channel FROM (SELECT line_id, "
       "CASE WHEN json_valid(line) THEN TRY_CAST(json_extract(line, '$.t') AS BIGINT) END AS t, "
       "CASE WHEN json_valid(line) THEN TRY_CAST(json_extract(line, '$.channel') AS INTEGER) END AS channel, "
       "CASE WHEN json_valid(line) THEN json_type(line, '$.t') END AS tt "
       f"FROM ({JSON_SQL})) WHERE tt IN ('BIGINT', 'UBIGINT') AND t IS NOT NULL AND channel IS NOT NULL")
def q_json(spark, sf):
    return parse.json_events(json_df(spark, sf))


@query("json_dead_letters",
       f"SELECT line_id FROM ({JSON_SQL}) WHERE NOT json_valid(line) OR json_type(line, '$.t') NOT IN ('BIGINT', 'UBIGINT') "
       "OR json_extract(line, '$.channel') IS NULL")
def q_json_dead(spark, sf):
    return parse.json_dead_letters(json_df(spark, sf)).select("line_id")


OUTCOME_SQL = ("SELECT event_id AS line_id, CASE event_type "
               "WHEN 'purchase' THEN 'OUTCOME ' || CAST((event_id % 21) - 10 AS VARCHAR) || '.5' "
               "WHEN 'click' THEN '  outcome 0.' || CAST(event_id % 10 AS VARCHAR) "
               "WHEN 'view' THEN 'OUTCOME abc' WHEN 'error' THEN 'OUTCOME' "
               "ELSE 'hello ' || CAST(user_id AS VARCHAR) END AS line FROM events")


def outcome_df(spark, sf):
    ev = events(spark, sf)
    et = F.col("event_type")
    eid = F.col("event_id")
    line = (F.when(et == "purchase", F.concat(F.lit("OUTCOME "), (F.pmod(eid, F.lit(21)) - 10).cast("string"), F.lit(".5")))
            .when(et == "click", F.concat(F.lit("  outcome 0."), F.pmod(eid, F.lit(10)).cast("string")))
            .when(et == "view", F.lit("OUTCOME abc")).when(et == "error", F.lit("OUTCOME"))
            .otherwise(F.concat(F.lit("hello "), F.col("user_id").cast("string"))))
    return ev.select(eid.alias("line_id"), line.alias("line"))


@query("parse_outcomes",
       "SELECT line_id, CASE WHEN starts_with(upper(s), 'OUTCOME') AND regexp_full_match(tok, "
       f"'{NUM_RE_SQL}') THEN greatest(-1.0, least(1.0, CAST(tok AS DOUBLE))) END AS reward FROM ("
       "SELECT line_id, s, string_split_regex(s, '\\s+')[2] AS tok FROM (SELECT line_id, "
       f"regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM ({OUTCOME_SQL})))")
def q_outcomes(spark, sf):
    return outcome_df(spark, sf).select("line_id", parse.outcome("line").alias("reward"))


# ---- count windows over supplier samples (G2/G3)
SAMPLES_SQL = ("SELECT l_suppkey AS device_id, l_returnflag AS label, l_quantity AS q, l_discount AS d, l_tax AS x, "
               "row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, "
               "l_quantity, l_discount, l_tax, l_returnflag) AS seq "
               "FROM lineitem")
WIN_SQL = (f"WITH s AS ({SAMPLES_SQL}), w AS (SELECT device_id, (seq - 1) // {WINDOW_ROWS} AS window_id, "
           f"count(*) OVER (PARTITION BY device_id, (seq - 1) // {WINDOW_ROWS}) AS n_rows, * FROM s)")


@query("count_windows",
       f"{WIN_SQL}, vals AS (SELECT device_id, window_id, ((seq - 1) % {WINDOW_ROWS}) * 3 + k AS i, "
       "CASE k WHEN 0 THEN q WHEN 1 THEN d ELSE x END AS v FROM w, range(0, 3) r(k) "
       f"WHERE n_rows = {WINDOW_ROWS}), "
       "b AS (SELECT device_id, window_id, least(min(v), 0.0) AS lo, greatest(max(v), 0.0) AS hi FROM vals GROUP BY ALL), "
       f"pos AS (SELECT device_id, window_id, lo, hi, unnest(range(0, {encode.N})) AS i FROM b) "
       "SELECT p.device_id, p.window_id, p.i, CASE WHEN p.hi - p.lo > 1e-9 THEN (coalesce(v.v, 0.0) - p.lo) / (p.hi - p.lo) "
       "ELSE 0.0 END AS v FROM pos p LEFT JOIN vals v USING (device_id, window_id, i)")
def q_count_windows(spark, sf):
    w = encode.count_windows(adapters.samples(table(spark, sf, "lineitem")), WINDOW_ROWS)
    return w.select("device_id", "window_id", F.posexplode_outer("vec").alias("i", "v")).select(
        "device_id", "window_id", F.col("i").cast("bigint").alias("i"), "v")


@query("labelled_windows",
       f"{WIN_SQL} SELECT device_id, window_id, arg_min(label, seq) AS label, count(*) AS n_rows FROM w "
       f"WHERE n_rows = {WINDOW_ROWS} GROUP BY ALL")
def q_labelled_windows(spark, sf):
    w = encode.count_windows(adapters.samples(table(spark, sf, "lineitem")), WINDOW_ROWS)
    return w.select("device_id", "window_id", "label", F.lit(WINDOW_ROWS).cast("bigint").alias("n_rows"))
