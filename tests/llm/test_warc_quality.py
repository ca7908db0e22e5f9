import gzip
import hashlib
import os
import zlib

import duckdb

from eventlake.llm import catalog, quality, warc

SF01 = "/root/testdata/sf0.01"


def test_archive_cases(spark, tmp_path):
    big, big2 = "<p>é</p>" * 300, "x" * 1000
    rows = [(1, "http://a", big), (2, "http://b\r\nEvil: 1", big), (3, None, big2), (4, "u", "small"), (5, "u", "small"),
            (6, "u", None), (7, "u", ""), (None, "u", "n" * 2000), (8, "u", "n" * 2000), (9, "u", "a\r\n\r\nContent-Length: 3\r\n\r\n" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive_round_trip(pages, folder=f"file://{tmp_path}/w", roll_bytes=3000).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for pid, _, html in rows:
        body = (html or "").encode()
        assert by[pid].payload_bytes == len(body) and by[pid].payload_digest == hashlib.sha1(body).hexdigest()
        assert by[pid].record_type == "revisit" or bytes(by[pid].payload) == body
    assert (by[1].record_type, by[1].refers_to) == ("revisit", 2) and by[2].record_type == "response"
    assert (by[None].record_type, by[None].refers_to) == ("revisit", 8)
    assert all(by[i].record_type == "response" for i in (3, 4, 5, 6, 7, 8, 9))


def test_members_and_sidecar(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "z" * i * 50) for i in range(40)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(warc.classify(pages), folder, roll_bytes=5000)
    for r in manifest.collect():
        path = r.path.removeprefix("file://")
        raw = open(path, "rb").read()
        d = zlib.decompressobj(31)
        d.decompress(raw)
        assert d.eof and not d.unused_data                  # one monolithic member
    index = warc.normalise(manifest, folder).collect()
    assert sorted(int(r.record_id[12:-1]) for r in index) == list(range(40))
    for r in index:
        path = r.path.removeprefix("file://")
        with open(path, "rb") as f:
            f.seek(r.offset)
            rec = zlib.decompress(f.read(r.length), 31)
        assert rec.startswith(b"WARC/1.1\r\n") and r.record_id.encode() in rec
        lines = open(path + ".idx").read().splitlines()
        assert f"{r.offset} {r.length} {r.record_type} {r.record_id} {r.target_uri}" in lines
        assert gzip.open(path).read().count(b"WARC/1.1\r\n") == len(lines)
    assert os.path.isdir(f"{tmp_path}/w/members")


def test_empty_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(pages, folder=f"file://{tmp_path}/w").count() == 0


def test_held_out_quality(spark):
    got = {r.doc_id: r for r in catalog.op9_quality(spark, SF01).collect()}
    labels = duckdb.sql(f"select doc_id, quality from '{SF01}/labels.parquet'").fetchall()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [(got[i].predicted, q) for i, q in labels if got[i].held_out]
    good = [p for p, q in held if q == 1]
    bad = [p for p, q in held if q == 0]
    assert sum(good) / len(good) >= 0.97 and sum(bad) / len(bad) <= 0.35


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "abc"), (3, "w " * 400_000), (3, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (3, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert quality.score_quality(docs, one).count() == 5
    assert quality.score_quality(docs.limit(0), one).count() == 0
    assert quality.keep_good(docs.withColumn("score", docs.doc_id), one).columns == ["doc_id", "text", "score"]


def test_rule_columns_match_the_trees(spark):
    rule = quality._and(quality._and((), (0, True, 1.0)), (0, True, 2.0))
    assert rule == ((0, True, 2.0),)
    assert quality._and(quality._and((), (3, False, 5.0)), (3, False, 4.0)) == ((3, False, 4.0),)
