"""Substring deduplication with difference-cover anchors.

A window is ``window`` consecutive words of one document.  A word goes when a
window over it also starts in a document with a smaller id; windows are judged
on the input.

* D is a difference cover modulo v: any two positions i, j have a k < v with
  (i+k) mod v and (j+k) mod v both in D.  Hashing only the anchors, the runs of
  ``window - v + 1`` words at positions p with p mod v in D, makes any two equal
  windows share an anchor at the same distance from their starts.
* An anchor that occurs in a single document lies in no repeated window.  The
  others are *extended*: every window over them is hashed with 96 bits.
* A window hash goes to the smallest document that holds it; the later ones
  lose the words it covers.

Of equal texts only the one with the smallest id takes part: a later copy of
``window`` words or more loses all of them.  Anchors and windows are thin rows
(hash, id, position), combined before the shuffle for the minimum and maximum
id; the join back may be split where one passage is hot.  The texts are
shuffled once, compressed, by id, and every step reads that exchange again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.textcols import Words, gram_hashes, long_column, raw, starts_of_grams, text_array, words


def difference_cover(v: int) -> tuple[int, ...]:
    """A small set D with {a - b mod v} = all residues (greedy; v >= 1)."""
    best: tuple[int, ...] = ()
    for second in range(1, min(v, 6) + 1):
        cover = {0, second % v}
        missing = set(range(v)) - {(a - b) % v for a in cover for b in cover}
        while missing:
            x = max(range(v), key=lambda c: (len(missing & ({(c - a) % v for a in cover} | {(a - c) % v for a in cover})), -c))
            cover.add(x)
            missing -= {(a - b) % v for a in cover for b in cover}
        if not best or len(cover) < len(best):
            best = tuple(sorted(cover))
    return best


def period_for(window: int) -> int:
    """The largest usable period q*q+q+1 that leaves anchors of a third of the window or more."""
    fits = [q * q + q + 1 for q in range(1, 40) if window - (q * q + q + 1) + 1 >= max(1, window // 3)]
    return max(fits, default=1)


def cover_mask(v: int) -> np.ndarray:
    mask = np.zeros(v, dtype=bool)
    mask[list(difference_cover(v))] = True
    return mask


def packed_texts(rows: DataFrame) -> DataFrame:
    """(id, row, packed): each whole text compressed, as it goes through the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=6, write_checksum=False, write_content_size=True)
        for batch in batches:
            data, off = raw(text_array(batch.column("text")))
            packed = [z.compress(data[off[i]:off[i + 1]]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(packed, pa.binary())], names=["id", "row", "packed"])

    return rows.mapInArrow(run, "id bigint, row bigint, packed binary")


def _unpacked(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of a batch with their texts."""
    z = zstandard.ZstdDecompressor()
    for lo in range(0, batch.num_rows, rows):
        part = batch.slice(lo, rows)
        texts = [z.decompress(x.as_buffer()) for x in part.column("packed")]
        yield part, pa.array(texts, pa.large_binary()).view(pa.large_string())


def _position(w: Words) -> np.ndarray:
    """Word number within its document."""
    return np.arange(int(w.offsets[-1])) - np.repeat(w.offsets[:-1], np.diff(w.offsets))


def anchors(rows: DataFrame, window: int, key: list[str]) -> DataFrame:
    """(anchor, row, id, pos) of the documents of at least ``window`` words; the
    48-bit anchor hash only selects, so a collision costs work, not correctness."""
    v = period_for(window)
    size, mask = window - v + 1, cover_mask(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in (x for whole in batches for x in _unpacked(whole)):
            row = batch.column("row").to_numpy(zero_copy_only=False)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for w in words(texts):
                total = int(w.offsets[-1])
                if not total:
                    continue
                pos = _position(w)
                long_doc = np.repeat(np.diff(w.offsets) >= window, np.diff(w.offsets))
                pick = np.flatnonzero(mask[pos % v] & starts_of_grams(w.offsets, size) & long_doc)
                doc = w.doc_of_word()[pick] + w.lo
                yield pa.RecordBatch.from_arrays(
                    [long_column(gram_hashes(w.hashes[0], size)[pick] >> np.uint64(16)), pa.array(row[doc]), pa.array(ids[doc]), pa.array(pos[pick].astype(np.int32))],
                    names=["anchor", "row", "id", "pos"])

    return rows.mapInArrow(run, "anchor bigint, row bigint, id bigint, pos int").select("anchor", *key, "pos")


def extended_windows(rows_with_anchors: DataFrame, window: int, key: list[str]) -> DataFrame:
    """(h1, place, *key): every window over a shared anchor.  ``h1`` is 64 bits
    of its hash; ``place`` holds its position and, in the low 32 bits, the rest."""
    size = window - period_for(window) + 1
    back = window - size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in (x for whole in batches for x in _unpacked(whole)):
            row = batch.column("row").to_numpy(zero_copy_only=False)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            marks, mark_off = _list(batch.column("marks"))
            for w in words(texts, seeds=2):
                n = int(w.offsets[-1])
                if not n:
                    continue
                part = marks[mark_off[w.lo]:mark_off[w.hi]]
                at = part + np.repeat(w.offsets[:-1], np.diff(mark_off[w.lo:w.hi + 1]))
                base = np.repeat(w.offsets[:-1], np.diff(mark_off[w.lo:w.hi + 1]))
                edge = np.zeros(n + 1, dtype=np.int64)
                np.add.at(edge, np.maximum(at - back, base), 1)
                np.add.at(edge, at + 1, -1)
                pick = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & starts_of_grams(w.offsets, window))
                doc = w.doc_of_word()[pick] + w.lo
                yield pa.RecordBatch.from_arrays(
                    [long_column(gram_hashes(w.hashes[0], window)[pick]), pa.array((_position(w)[pick] << 32) | (gram_hashes(w.hashes[1], window, 77)[pick] >> np.uint64(32)).astype(np.int64)),
                     pa.array(row[doc]), pa.array(ids[doc])], names=["h1", "place", "row", "id"])

    return rows_with_anchors.mapInArrow(run, "h1 bigint, place bigint, row bigint, id bigint").select("h1", "place", *key)


def _list(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list<int> column; null counts as an empty list."""
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=np.int64), np.append(0, np.cumsum(sizes))


def cut(rows_with_windows: DataFrame, window: int) -> DataFrame:
    """(id, n_words, n_removed, kept): the kept words of each row joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in (x for whole in batches for x in _unpacked(whole)):
            marks, off = _list(batch.column("marks"))
            copy = batch.column("copy").to_pylist()
            data, toff = raw(texts)
            for lo in range(0, batch.num_rows, 256):
                hi = min(lo + 256, batch.num_rows)
                n_words, n_removed, kept = [], [], []
                for i in range(lo, hi):
                    ws = data[toff[i]:toff[i + 1]].tobytes().split()
                    starts = marks[off[i]:off[i + 1]]
                    gone = 0
                    if copy[i] and len(ws) >= window:
                        gone = len(ws)
                        kept.append(b"")
                    elif len(starts):
                        edge = np.zeros(len(ws) + 1, dtype=np.int64)
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + window, -1)
                        stay = np.cumsum(edge[:-1]) == 0
                        gone = int(len(ws) - stay.sum())
                        kept.append(b" ".join([x for x, s in zip(ws, stay.tolist(), strict=True) if s]))
                    else:
                        kept.append(b" ".join(ws))
                    n_words.append(len(ws))
                    n_removed.append(gone)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return rows_with_windows.mapInArrow(run, "id bigint, n_words bigint, n_removed bigint, kept string")


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``<id_col>, n_words, n_removed, kept`` (the text left).

    Null text has no words; a document under ``window`` words loses none.  A
    null id sorts after every id, so its row can lose words but never makes an
    identified document lose any; rows with one id are one document and never
    cut each other.  Other columns are ignored; an empty table gives none.
    """
    last = (1 << 63) - 1
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("id"))
    repeated = not ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    # (id, row) names a row; rows equal in both are equal and get equal results
    row = F.xxhash64(text) if repeated else F.lit(0).cast("bigint")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("id"), row.alias("row"), text.alias("text"))
    key = ["id", "row"] if repeated else ["id"]
    names = rows.select("id", "row", F.unhex(F.md5("text")).alias("md5"))
    first = names.groupBy("md5").agg(F.min(F.struct("id", "row")).alias("f")).select("md5", F.col("f.id").alias("fid"), F.col("f.row").alias("frow"))
    # said here, since joins would infer it on some sides only and the exchange could not be reused
    rows = packed_texts(rows).where(F.col("id").isNotNull())
    alone = first.select(F.col("fid").alias("id"), F.col("frow").alias("row")).select(*key)
    copies = names.join(first.select("md5", "fid"), "md5").where("id > fid").select(*key).distinct()
    found = anchors(rows.join(alone, key, "left_semi"), window, key)
    shared = (found.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select(F.col("anchor").alias("shared")))
    marks = found.join(shared, F.col("anchor") == F.col("shared")).groupBy(*key).agg(F.collect_set("pos").alias("marks"))
    windows = extended_windows(rows.join(marks, key), window, key)
    rest = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    least = (windows.groupBy("h1", rest.alias("h2")).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
             .select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "lo"))
    covered = (windows.join(least, (F.col("h1") == F.col("g1")) & (rest == F.col("g2")))
               .where(F.col("id") > F.col("lo")).groupBy(*key).agg(F.collect_set(F.shiftright("place", 32).cast("int")).alias("marks")))
    verdict = covered.withColumn("copy", F.lit(False)).unionByName(
        copies.select(*key, F.array().cast("array<int>").alias("marks"), F.lit(True).alias("copy")))
    out = cut(rows.join(verdict, key, "left"), window)
    return out.select(F.nullif("id", F.lit(last)).alias(id_col), "n_words", "n_removed", "kept")
