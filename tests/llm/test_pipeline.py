"""The pipeline stage by stage against brute force, and its odd inputs."""

import duckdb

import corpus_pipeline as cp
from eventlake.llm import decontaminate as dc
from eventlake.llm import minhash, quality
from tests.llm.test_minhash import brute_links, classes_of, counted_texts, frequencies
from tests.llm.test_packing import check_layout

SF01 = "/root/testdata/sf0.01"


def test_stages_on_given_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    cols = docs.columns
    kept = {}
    now = docs
    for name, stage in cp.STAGES[:-1]:
        now = stage(spark, now, SF01)
        assert now.columns == cols, name
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r.text for r in now.select("doc_id", "text").collect()}
        assert now.count() == len(kept[name])
    # quality: as its scores say, clean documents stay
    scores = {r.doc_id: r.score for r in quality.score_quality(docs, spark.read.parquet(f"{SF01}/labels.parquet")).collect()}
    assert set(kept["quality"]) == {d for d, s in scores.items() if s >= 0.3}
    good = [d for d, q in duckdb.sql(f"select doc_id, quality from '{SF01}/labels.parquet'").fetchall() if q == 1]
    assert sum(d in kept["quality"] for d in good) >= 0.97 * len(good)
    # exact: the smallest id of each text (A-Z lower-cased)
    low = lambda t: "".join(c.lower() if c < "\x80" else c for c in t)
    first = {}
    for d, t in sorted(kept["quality"].items()):
        first.setdefault(low(t), d)
    assert set(kept["exact_dedup"]) == set(first.values())
    # near: the smallest id of each class
    rows = sorted(kept["exact_dedup"].items())
    classes = classes_of(rows, brute_links(rows, frequencies(counted_texts(spark, rows), minhash.THETA), 0.8))
    assert set(kept["near_dedup"]) == set(classes.values()) and len(set(classes.values())) < len(rows)
    # decontaminate: no text within the budget of an item
    items = [dc.normalised(t) for _, t in duckdb.sql(f"select item_id, text from '{SF01}/benchmark.parquet'").fetchall()]
    bad = {d for d, t in kept["near_dedup"].items() if any(p in dc.normalised(t) for p in items)}
    assert bad and not bad & set(kept["decontaminate"])
    assert len(kept["decontaminate"]) >= len(kept["near_dedup"]) - len(bad) - 2
    # packing: every token once
    pieces = cp.packing(spark, now, SF01).collect()
    check_layout(pieces, 2048)
    assert {r.doc_id for r in pieces} == set(kept["decontaminate"])
    total = {}
    for r in pieces:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert all(total[r.doc_id] == r.doc_tokens for r in pieces)


def test_odd_and_empty_tables(spark, table_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, id int, row int"
    rows = [(1, None, None, None, None, "x", 1, 1), (2, "", "en", "s", 0, "x", 1, 1), (None, "same text here", "en", "s", 1, "x", 1, 1),
            (3, "same text here", "en", None, 1, "x", 1, 1), (3, "same text here", "en", None, 1, "x", 1, 1), (4, "other " * 30, "en", "s", 1, "x", 1, 1)]
    labels = spark.createDataFrame([(3, 1, 0), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(None, None), (1, "")], "item_id long, text string")
    d = table_dir(documents=spark.createDataFrame(rows, schema), labels=labels, benchmark=bench)
    now = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        now = stage(spark, now, d)
        assert now.columns == [c.split()[0] for c in schema.split(", ")], name
    assert sorted(r.doc_id for r in now.collect()) == [1, 3, 4]
    assert {r.doc_id for r in cp.run(spark, d).collect()} == {1, 3, 4}
    empty = table_dir(documents=spark.createDataFrame([], schema))
    assert cp.run(spark, empty).count() == 0
