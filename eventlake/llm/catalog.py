"""The thin ``opN_<name>`` queries and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.llm.align import alignment
from eventlake.llm.common import documents, pages
from eventlake.llm.curriculum import SCHEDULES, curriculum, integral
from eventlake.llm.decontaminate import find_leaks
from eventlake.llm.exact_dedup import exact_groups
from eventlake.llm.minhash import near_duplicates
from eventlake.llm.negatives import hard_negatives
from eventlake.llm.packing import pack
from eventlake.llm.pii import scan_personal_data
from eventlake.llm.quality import is_held_out, score_quality
from eventlake.llm.secrets import scan_secrets
from eventlake.llm.substring import remove_repeats
from eventlake.llm.tokens import count_tokens
from eventlake.llm.warc import archive_round_trip
from eventlake.plans.registry import Entry
from eventlake.sources.tables import table

LLM: dict[str, Entry] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        LLM[key] = Entry(key, fn, sql)
        return fn
    return deco


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _digest_columns(spans: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """doc_id, n_<kind> of the base kinds, base_sha256, spans."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    return spans.select("doc_id", *[of(k) for k in base], F.sha2(_joined(own), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))


def packed(docs: DataFrame) -> DataFrame:
    """The packing of the given documents with the digest of each piece's ids."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))


@query("op2_minhash")
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "kept")


@query("op3_secrets")
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest_columns(scan_secrets(documents(spark, sf_dir)), ("assign", "access", "hex"))


@query("op4_personal_data")
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest_columns(scan_personal_data(documents(spark, sf_dir)), ("email", "ip", "card", "phone"))


@query("op5_exact_dedup", """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir), keep="largest")


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("op7_substring_dedup")
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_warc", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest,
  coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY h)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN g.keep IS NULL OR g.keep = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.keep <> p.page_id THEN g.keep END AS refers_to
FROM p LEFT JOIN g USING (h)
""")
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(pages(spark, sf_dir)).drop("payload")


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def _curriculum_sql() -> str:
    """The schedules as a table of segments; targets, order and positions as in the operator."""
    segments, before = [], 0.0
    for kind, knots in enumerate(SCHEDULES):
        before = 0.0
        for i, ((t, v), (u, w)) in enumerate(zip(knots[:-1], knots[1:], strict=True)):
            area = integral(((t, v), (u, w)))
            last = i == len(knots) - 2
            segments.append(f"({kind}, {t!r}::DOUBLE, {u - t!r}::DOUBLE, {v!r}::DOUBLE, {w!r}::DOUBLE, {before!r}::DOUBLE, {1e9 if last else before + area!r}::DOUBLE)")
            before += area
    kinds = ", ".join(f"({k}, {integral(s)!r}::DOUBLE)" for k, s in enumerate(SCHEDULES))
    return f"""
WITH seg(kind, t0, h, w0, w1, lo, hi) AS (VALUES {', '.join(segments)}),
kinds(kind, weight) AS (VALUES {kinds}),
d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'none')), 1, 12) AS BIGINT) AS place FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(SCHEDULES)} AS kind FROM d GROUP BY source),
w AS (SELECT src.*, weight, source_size * 3 AS cap FROM src JOIN kinds USING (kind)),
able AS (SELECT *, sum(cap) OVER o - cap AS caps, sum(weight) OVER o - weight AS ws, sum(weight) OVER () AS total
  FROM w WHERE source_size > 0 WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
lev AS (SELECT max(((SELECT sum(source_size) FROM w) - caps) / (total - ws)) AS level FROM able),
tgt AS (SELECT w.*, CASE WHEN source_size > 0 THEN least(CAST(cap AS DOUBLE), level * weight) ELSE 0.0 END AS target FROM w, lev),
want AS (SELECT *, CAST(least(floor(target + 0.5), cap) AS BIGINT) AS wanted FROM tgt),
p AS (SELECT d.doc_id, d.size, want.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, CAST(d.doc_id AS VARCHAR), d.size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM d JOIN want ON d.source IS NOT DISTINCT FROM want.source),
c AS (SELECT *, greatest(least(wanted - first, size), 0) AS one, greatest(least(wanted - source_size - first, size), 0) AS two,
  greatest(least(wanted - 2 * source_size - first, size), 0) AS three FROM p),
y AS (SELECT c.*, CASE WHEN one > 0 THEN (first + one / 2) / wanted * weight END AS part FROM c)
SELECT y.doc_id, y.size, y.source_size, y.target, CAST(one + two + three AS BIGINT) AS taken,
  CAST((one > 0)::INT + (two > 0)::INT + (three > 0)::INT AS INTEGER) AS copies,
  round(seg.t0 + least(coalesce(2 * (part - lo) / nullif(w0 + sqrt(greatest(w0 * w0 + 2 * ((w1 - w0) / h) * (part - lo), 0)), 0), 0), h), 6) AS position
FROM y LEFT JOIN seg ON seg.kind = y.kind AND part >= lo AND part < hi
"""


@query("op11_curriculum", _curriculum_sql())
def op11_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum(documents(spark, sf_dir))
    first = F.round(F.get("copies", F.lit(0))["position"], 6)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("copies").alias("copies"), first.alias("position")).orderBy("position", "doc_id")


@query("op12_hard_negatives", """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v, row_number() OVER () AS rn
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rn AS anchor, a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, CAST(list_dot_product(a.v, o.v) AS BIGINT) AS score
  FROM (SELECT * FROM r WHERE vec_id % 100 = 0) a JOIN r o ON a.rn <> o.rn),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS k FROM s WHERE same QUALIFY k <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT * FROM n WHERE rank <= 5
""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
