"""Near-duplicate documents by consistent weighted sampling.

* A document is the weighted set of its 5-word shingles (ASCII-lower-cased
  words): weight = tf * idf, idf = ln(1 + N/df) / ln(1 + 1/theta), at most 1.
  N and df count texts that are first of their kind: of equal texts, and of
  texts that share a long run of plain samples (tf only) with an earlier one,
  only the first counts.  So a large group of copies, equal or near, does not
  make its own words cheap; a line that many different texts hold is cheap.
  The idf ceiling makes weights alike at every size: only shingles in a share
  ``theta`` of the texts or more (and at least 20) weigh less, and there are at
  most (mean shingles per document) / theta of these, a bounded table whatever N.
* Improved consistent weighted sampling (Ioffe, 2010) draws samples that agree
  for two documents with probability equal to their weighted Jaccard similarity.
* Samples are banded, with a second, narrower key of two neighbouring bands.
  First every member of a bucket meets one centre, the member that shares most
  with all its buckets.  Then come rounds: the documents of buckets that hold
  several classes draw fresh, independent samples with longer keys, which split large
  buckets; in a new bucket of a few members all pairs of different classes are
  compared, in a larger one every member meets one drawn at random.  Rounds go
  on until one links fewer than one in 200 of its documents.  A round's pairs are linear in its documents, whatever the size of a group.
  The rounds only join the bulk of large groups cheaply; what they leave is done
  in full: of all documents that shared a bucket with another class, every pair of
  different classes that can reach the threshold is compared.  Two such documents
  share one of the rarest shingles of both, and what is left of either from the
  first shared one on, in one order of all shingles, weighs what the threshold
  asks for.  Both bounds are exact: a large group below the threshold makes few
  pairs, and no link is lost.
* Every pair is verified by its exact weighted Jaccard similarity on the whole
  texts; links are closed to classes.  Equal texts are grouped first, and stand
  for one document, so copies cost nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.common import written
from eventlake.llm.components import components
from eventlake.llm.textcols import Words, gram_hashes, long_column, mix64, odd_constant, starts_of_grams, text_array, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 3
THETA = 0.05
BUCKET_BITS = 16
ORDER_BITS = 20               # of the counts that order shingles in the full comparison after the rounds
SMALL = 32                    # members of a bucket whose pairs are all compared in a round
BLOCK = 1024                  # members of a bucket that meet in one task, in the full comparison after the rounds
ENOUGH = 1 / 200              # rounds end with one that links a smaller share of its documents
SLACK = 1e-6                  # for rounding, as a share of the weights compared
LEAST_COMMON = 20             # documents that hold a common shingle, at least
_KEEP = np.uint64((1 << 44) - 1)
_P = "_nd_"


def shingles(w: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, 44-bit shingle, tf), sorted; a document of fewer than n words
    but some has one shingle of all its words."""
    if len(w.hashes[0]) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = np.diff(w.offsets)
    full = starts_of_grams(w.offsets, n)
    doc = w.doc_of_word()[full].astype(np.uint64)
    gram = gram_hashes(w.hashes[0], n)[full]
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        own = [gram_hashes(w.hashes[0][w.offsets[d]:w.offsets[d + 1]], int(size[d]))[0] for d in short]
        doc = np.concatenate([doc, short.astype(np.uint64)])
        gram = np.concatenate([gram, np.array(own, dtype=np.uint64)])
    key = np.sort((doc << np.uint64(44)) | (gram >> np.uint64(20)))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    tf = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(44)).astype(np.int64), key & _KEEP, tf


def _bucket(h: np.ndarray, bits: int = BUCKET_BITS) -> np.ndarray:
    return (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def _count_rows(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])


@dataclass(frozen=True)
class Idf:
    """The weights below 1: sorted shingles and their idf, and their buckets."""

    shingle: np.ndarray
    idf: np.ndarray
    hot: np.ndarray

    def weights(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = tf.astype(float)
        if len(self.shingle):
            at = np.flatnonzero(self.hot[_bucket(h)])
            i = np.minimum(np.searchsorted(self.shingle, h[at]), len(self.shingle) - 1)
            w[at] *= np.where(self.shingle[i] == h[at], self.idf[i], 1.0)
        return w


def first_of_kind(sigs: DataFrame, bands: int = BANDS) -> DataFrame:
    """(id) of documents that share a wide key with one of a smaller id."""
    wide = sigs.select("id", F.explode(F.slice("keys", bands + 1, bands)).alias("key"))
    least = wide.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    return wide.join(least, "key").where("id > first").select("id").distinct()


def frequent_shingles(texts: DataFrame, counted: DataFrame, theta: float = THETA) -> Idf:
    """Exact document frequencies, over ``texts``, of every shingle in a share
    theta of them or more.  ``counted`` has (key, n): shingles by hash bucket (a
    fixed number) over these texts at least; only the shingles of buckets that
    reach the bound are counted one by one.  Both cover every document.  The
    table holds no more shingles than 1 / theta mean documents, whatever their
    length, and comes as arrays of 16 bytes a shingle."""
    n = texts.count()
    least = max(LEAST_COMMON, int(np.ceil(theta * n)))
    hot = np.zeros(1 << BUCKET_BITS, dtype=bool)
    hot[counted.where(F.col("n") >= least).select("key").toArrow().column("key").to_numpy()] = True
    if not hot.any():
        return Idf(np.zeros(0, np.uint64), np.zeros(0), hot)
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        many = 0
        for batch in batches:
            for w in words(text_array(batch.column("text")), lower=True):
                h = shingles(w)[1]
                held.append(h[shared.value[_bucket(h)]])
                many += len(held[-1])
                if many > 1 << 20:
                    yield _count_rows(*np.unique(np.concatenate(held), return_counts=True))
                    held, many = [], 0
        if held:
            yield _count_rows(*np.unique(np.concatenate(held), return_counts=True))

    rows = (texts.mapInArrow(exact, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least).toArrow().sort_by("key"))          # at most mean / theta rows
    h = rows.column("key").to_numpy().astype(np.uint64)
    df = rows.column("n").to_numpy().astype(float)
    return Idf(h, np.minimum(1.0, np.log1p(n / np.maximum(df, 1)) / np.log1p(1 / theta)), hot)


def _gamma_table() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the centres of 2^16 equal steps (bisection)."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    lo, hi = np.zeros(1 << 16), np.full(1 << 16, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _TABLES:
        g = _gamma_table()
        _TABLES.extend([g.astype(np.float32), (1 / g).astype(np.float32), np.log(g).astype(np.float32)])
    return _TABLES


def sample(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, n_samples: int, draw: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(documents with a shingle, their samples as uint64 [documents, samples])."""
    start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    owner = doc[start]
    out = np.zeros((len(start), n_samples), dtype=np.uint64)
    if not len(start):
        return owner, out
    size = np.diff(np.append(start, len(doc)))
    log_w = np.log(weight).astype(np.float32)
    gamma, inverse, log_gamma = _tables()
    low16, sixteen = np.uint64(0xFFFF), np.uint64(16)
    for k in range(n_samples):
        z = h * odd_constant(100 + k + 10_000 * draw)
        z ^= z >> np.uint64(32)
        z *= odd_constant(900 + k + 10_000 * draw)
        a = (z >> np.uint64(48)).astype(np.int64)
        b = ((z >> np.uint64(32)) & low16).astype(np.float32)
        c = ((z >> sixteen) & low16).astype(np.int64)
        beta = (b + np.float32(0.5)) * np.float32(1 / 65536)
        t = np.floor(log_w * inverse[a] + beta)
        value = log_gamma[c] - gamma[a] * (t - beta + np.float32(1))
        least = np.minimum.reduceat(value, start)
        at = np.flatnonzero(value == np.repeat(least, size))
        at = at[np.append(True, doc[at[1:]] != doc[at[:-1]])]
        out[:, k] = mix64(h[at] * np.uint64(0x9E3779B97F4A7C15) + t[at].astype(np.int64).view(np.uint64) + np.uint64(k))
    return owner, out


def band_keys(samples: np.ndarray, bands: int, rows: int, widths: tuple[int, ...] = (1, 2)) -> np.ndarray:
    """For each width w, ``bands`` keys: each band's samples with those of the w - 1 next ones."""
    keys = np.zeros((len(samples), bands), dtype=np.uint64)
    for b in range(bands):
        for r in range(rows):
            keys[:, b] = mix64(keys[:, b] * np.uint64(31) + samples[:, b * rows + r])
    out = []
    for w in widths:
        wide = keys
        for step in range(1, w):
            wide = mix64(wide * np.uint64(31) + np.roll(keys, -step, axis=1))
        out.append(wide)
    return np.concatenate(out, axis=1)


def signatures(texts: DataFrame, idf=None, bands: int = BANDS, rows: int = ROWS, draw: int = 0, widths: tuple[int, ...] = (1, 2),
               only_common: bool = False) -> DataFrame:
    """(id, weight, keys array<long>) of every document with a word; weight is
    the sum of its shingles'.  Without ``idf`` a shingle weighs its tf, and every
    task adds one row without an id whose keys are its documents with a shingle,
    by hash bucket.  ``only_common``: just the documents with a common shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in batches:
            ids = batch.column("id")
            for w in words(text_array(batch.column("text")), lower=True):
                doc, h, tf = shingles(w)
                weight = tf.astype(float) if idf is None else idf.value.weights(h, tf)
                if idf is None:
                    total += np.bincount(_bucket(h), minlength=1 << BUCKET_BITS)
                if only_common:
                    use = np.zeros(w.hi - w.lo, bool)
                    use[doc[weight < tf]] = True
                    use = use[doc]
                    doc, h, weight = doc[use], h[use], weight[use]
                owner, got = sample(doc, h, weight, w.hi - w.lo, bands * rows, draw)
                keys = band_keys(got, bands, rows, widths)
                off = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1])
                sums = np.bincount(doc, weight, minlength=w.hi - w.lo).astype(float)[owner]      # of nothing, it counts integers
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner + w.lo)), pa.array(sums), pa.ListArray.from_arrays(off, long_column(keys.reshape(-1)))], names=["id", "weight", "keys"])
        if idf is None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([total], pa.list_(pa.int64()))], names=["id", "weight", "keys"])

    return texts.mapInArrow(run, "id bigint, weight double, keys array<bigint>")


def bucket_rows(sigs: DataFrame, *extra: str) -> DataFrame:
    """(key, id, weight, m, ...) of the members of every bucket of m > 1."""
    rows = sigs.select("id", "weight", *extra, F.explode("keys").alias("key"))
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return rows.join(size, "key").select("key", "id", "weight", "m", *extra)


def _met(centres: DataFrame, members: DataFrame, apart, threshold: float) -> DataFrame:
    """Distinct (a, b) of centres (key, c, c_weight) and members of their buckets;
    a pair's similarity is at most the lesser weight over the greater."""
    fits = F.least("weight", "c_weight") >= (threshold - 1e-9) * F.greatest("weight", "c_weight")
    return (members.join(centres, "key").where(apart & fits)
            .select(F.greatest("id", "c").alias("a"), F.least("id", "c").alias("b")).distinct())


def star_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Every member of a bucket with the one that has most company in all its buckets."""
    company = rows.groupBy("id").agg(F.sum("m").alias("company"))
    best = F.max_by(F.struct("id", "weight"), F.struct("company", -F.col("id")))
    centre = rows.join(company, "id").groupBy("key").agg(best.alias("x")).select("key", F.col("x.id").alias("c"), F.col("x.weight").alias("c_weight"))
    return _met(centre, rows, F.col("id") != F.col("c"), threshold)


def named_rows(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows with each document's class (root)."""
    return rows.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def mixed_documents(named: DataFrame) -> DataFrame:
    """(id) of the members of buckets that hold several classes."""
    mixed = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    return named.join(mixed, "key", "left_semi").select("id").distinct()


def round_pairs(named: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different classes: in a bucket of up to SMALL members all of
    them, in a larger one every member with one drawn at random."""
    as_centre = [F.col("id").alias("c"), F.col("weight").alias("c_weight"), F.col("root").alias("c_root")]
    apart = F.col("root") != F.col("c_root")
    few, many = named.where(F.col("m") <= SMALL), named.where(F.col("m") > SMALL)
    drawn = many.groupBy("key").agg(F.min_by(F.struct("id", "weight", "root"), F.xxhash64("key", "id")).alias("x")).select("key", "x.*")
    return (_met(few.select("key", *as_centre), few, apart & (F.col("id") < F.col("c")), threshold)
            .unionByName(_met(drawn.select("key", *as_centre), many, apart, threshold)).distinct())


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Documents with a shingle, by hash bucket of it (2^ORDER_BITS of them, whatever the input)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << ORDER_BITS, dtype=np.int64)
        for batch in batches:
            for w in words(text_array(batch.column("text")), lower=True):
                total += np.bincount(_bucket(shingles(w)[1], ORDER_BITS), minlength=1 << ORDER_BITS)
        some = np.flatnonzero(total)
        yield _count_rows(some, total[some])

    several = texts.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    out = np.ones(1 << ORDER_BITS, dtype=np.int32)
    out[several.column("key").to_numpy()] = several.column("n").to_numpy().clip(max=(1 << 31) - 1)
    return out


def rarest_shingles(named: DataFrame, idf, threshold: float) -> DataFrame:
    """(key, id, weight, root, left) of the documents (id, text, root): the
    shingles (key) at which a document can first meet one like it.

    Shingles have one order, rare buckets first; ``left`` is the weight of a
    document's shingles from this one on.  Two documents share at most the lesser
    ``left`` of their first common shingle, and at the threshold that share of
    either's whole weight.  Any order would do; this one makes few common keys."""
    counts = named.sparkSession.sparkContext.broadcast(bucket_counts(named.select("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, roots = batch.column("id"), batch.column("root")
            for w in words(text_array(batch.column("text")), lower=True):
                doc, h, tf = shingles(w)
                weight = idf.value.weights(h, tf)
                order = np.lexsort((h, counts.value[_bucket(h, ORDER_BITS)], doc))
                doc, h, weight = doc[order], h[order], weight[order]
                until = np.cumsum(weight)
                end = np.append(0.0, until)[np.searchsorted(doc, np.arange(w.hi - w.lo), side="right")]
                sums = np.bincount(doc, weight, minlength=w.hi - w.lo).astype(float)
                left = end[doc] - until + weight
                keep = np.flatnonzero(left >= (threshold - SLACK) * sums[doc])
                at = pa.array(doc[keep] + w.lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[keep].astype(np.int64)), ids.take(at), pa.array(sums[doc[keep]]), roots.take(at), pa.array(left[keep])],
                    names=["key", "id", "weight", "root", "left"])

    return named.select("id", "text", "root").mapInArrow(run, "key bigint, id bigint, weight double, root bigint, left double")


def rest_pairs(named: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """All pairs of members of different classes in every bucket, but those that
    share too little: at most the lesser ``left`` (all of the weight where there
    is no such column) of the two.

    A bucket's largest class is met by the others, never by itself; the members
    met are dealt into blocks, so a large bucket is many tasks."""
    rows = named.select("key", "id", "weight", "root", (F.col("left") if "left" in named.columns else F.col("weight")).alias("left"))
    sizes = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    most = (sizes.groupBy("key").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("main"), F.sum("n").alias("m"), F.count(F.lit(1)).alias("classes"))
            .where("classes > 1").select("key", "main", F.ceil(F.col("m") / F.lit(block)).cast("int").alias("blocks")))
    rows = rows.join(most, "key")
    others = rows.where("root <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = rows.select("key", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.col("id").alias("c"), F.col("weight").alias("c_weight"),
                      F.col("root").alias("c_root"), F.col("left").alias("c_left"))
    fits = F.least("left", "c_left") >= (threshold / (1 + threshold) - SLACK) * (F.col("weight") + F.col("c_weight"))
    once = (F.col("c_root") == F.col("main")) | (F.col("id") < F.col("c"))
    return (others.join(met, ["key", "block"]).where((F.col("root") != F.col("c_root")) & once & fits)
            .select(F.greatest("id", "c").alias("a"), F.least("id", "c").alias("b")).distinct())


def contracted(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The classes (node, root) after more links (a, b): every class is one node."""
    to = lambda c, r: roots.select(F.col("node").alias(c), F.col("root").alias(r))
    between = links.join(to("a", "ra"), "a", "left").join(to("b", "rb"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    merged = components(between, "a", "b")
    old = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("least")), "root", "left").select("node", F.coalesce("least", "root").alias("root"))
    return old.unionByName(merged.join(roots.select("node"), "node", "left_anti"))


def classes(sigs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """(node, root) of all documents linked, directly or over others."""
    base = written(bucket_rows(sigs), "nd-buckets-of-two")
    compared = written(star_pairs(base, threshold), "nd-pairs")
    roots = written(components(written(verified_links(compared, texts, idf, threshold), "nd-links"), "a", "b"), "nd-classes")
    rest, draw = mixed_documents(named_rows(base, roots)), 1
    all_mixed = None                                            # a later round's documents are among the first one's
    while True:
        some = written(texts.join(rest, "id", "left_semi"), "nd-mixed")
        all_mixed = some if all_mixed is None else all_mixed
        fresh = written(signatures(some, idf, draw=draw, widths=(2, 4)), "nd-signatures")
        named = written(bucket_rows(named_rows(fresh, roots), "root"), "nd-buckets-of-two")      # classes are joined to documents, not to their keys
        pairs = written(round_pairs(named, threshold).join(compared, ["a", "b"], "left_anti"), "nd-pairs")
        links = written(verified_links(pairs, some, idf, threshold), "nd-links")
        new, of = links.count(), some.count()
        if new:
            roots = written(contracted(roots, links), "nd-classes")
        compared, draw = compared.unionByName(pairs), draw + 1
        if new <= ENOUGH * of:
            break
        rest = mixed_documents(named_rows(fresh, roots).select("id", "root", F.explode("keys").alias("key")))
    shared = written(rarest_shingles(named_rows(all_mixed, roots), idf, threshold), "nd-rarest")
    pairs = written(rest_pairs(shared, threshold).join(compared, ["a", "b"], "left_anti"), "nd-pairs")
    links = written(verified_links(pairs, all_mixed, idf, threshold), "nd-links")
    return roots if links.isEmpty() else written(contracted(roots, links), "nd-classes")


def weighted_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets given as (sorted distinct keys, weights)."""
    (kx, wx), (ky, wy) = (x, y) if len(x[0]) <= len(y[0]) else (y, x)
    if len(kx) == 0:
        return 0.0
    i = np.minimum(np.searchsorted(ky, kx), len(ky) - 1)
    same = ky[i] == kx
    both = float(np.minimum(wx[same], wy[i[same]]).sum())
    return both / (float(wx.sum()) + float(wy.sum()) - both)


def _sets(column: pa.Array, idf: Idf) -> list[tuple[np.ndarray, np.ndarray]]:
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for w in words(column, lower=True):
        doc, h, tf = shingles(w)
        weight = idf.weights(h, tf)
        cut = np.searchsorted(doc, np.arange(w.hi - w.lo + 1))
        out += [(h[a:b], weight[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return out


def _sets_once(column: pa.Array, idf: Idf) -> list[tuple[np.ndarray, np.ndarray]]:
    """The weighted set of every text, made once where a text comes again."""
    each = column.dictionary_encode()
    own = _sets(each.dictionary, idf)
    return [own[i] for i in each.indices.to_pylist()]


def verified_links(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs at or over the threshold.

    The texts are shuffled by id once; both joins read that exchange, and both
    may be split where one centre is hot."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                xs = _sets_once(text_array(part.column("text_a")), idf.value)
                ys = _sets_once(text_array(part.column("text_b")), idf.value)
                sim = np.array([weighted_jaccard(x, y) for x, y in zip(xs, ys, strict=True)])
                keep = pa.array(np.flatnonzero(sim >= threshold))
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").take(keep), part.column("b").take(keep), pa.array(sim).take(keep)], names=["a", "b", "similarity"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, similarity double")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    bands: int = BANDS, rows: int = ROWS, theta: float = THETA) -> DataFrame:
    """One row per document: ``<id_col>, class_id`` (least id of its class),
    ``kept`` (one row of each class) and ``text_md5``.

    Equal texts, empty ones too, are one class; null counts as empty; a text
    without words is linked to equal texts only.  A row without an id joins the
    class of an identified equal text, else its class id is null and it is
    kept.  Rows that repeat an id are one document; of rows equal in id and
    text one is kept.  Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("md5", F.md5("text"))
    thin = base.select("id", "md5")
    unique = written(base.groupBy("md5", "text").agg(F.min("id").alias("rep")), "nd-texts")      # every text once
    copies = unique.select("md5", "rep")
    named = unique.where(F.col("rep").isNotNull()).select(F.col("rep").alias("id"), "text")
    plain = written(signatures(named, None, bands, rows), "nd-signatures")
    counted = plain.where("id IS NULL").select(F.posexplode("keys").alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))
    plain = plain.where("id IS NOT NULL")
    first = named.join(first_of_kind(plain, bands), "id", "left_anti")
    idf = spark.sparkContext.broadcast(frequent_shingles(first, written(counted, "nd-buckets"), theta))
    sigs = plain
    if len(idf.value.shingle):                  # the other documents weigh what they did
        again = written(signatures(named, idf, bands, rows, only_common=True), "nd-signatures")
        sigs = plain.join(again, "id", "left_anti").unionByName(again)
    # a text of a document that stands for another text, too
    reps = named.select("id").distinct()
    also = thin.join(copies, "md5").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).join(reps, F.col("a") == reps["id"], "left_semi")
    roots = contracted(classes(sigs, named, idf, threshold), also)
    found = copies.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("md5").alias("m"), F.coalesce("root", "rep").alias("class_id"))
    same = Window.partitionBy("id", "md5").orderBy(F.lit(0))
    numbered = thin.withColumn("n", F.row_number().over(same))
    out = numbered.join(found, F.col("md5") == F.col("m"))
    first = out.where("id = class_id").groupBy("id").agg(F.min("md5").alias("first_md5")).withColumnRenamed("id", "k")
    out = out.join(first, F.col("id") == F.col("k"), "left")
    kept = F.col("class_id").isNull() | (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("md5") == F.col("first_md5")) & (F.col("n") == 1))
    return out.select(F.col("id").alias(id_col), "class_id", F.coalesce(kept, F.lit(False)).alias("kept"), F.col("md5").alias("text_md5"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay, one of each class, with their columns."""
    stay = near_duplicates(docs, id_col, text_col, **options).where("kept").select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("none")).alias(f"{_P}k"), F.col("text_md5").alias(f"{_P}m"))
    left = (docs.withColumns({f"{_P}k": F.coalesce(F.col(id_col).cast("string"), F.lit("none")),
                              f"{_P}m": F.md5(F.coalesce(F.col(text_col), F.lit("")))})
            .join(stay, [f"{_P}k", f"{_P}m"], "left_semi"))
    same = Window.partitionBy(f"{_P}k", f"{_P}m").orderBy(F.lit(0))
    return (left.withColumn(f"{_P}n", F.when(F.col(id_col).isNull(), 1).otherwise(F.row_number().over(same)))
            .where(f"{_P}n = 1").drop(f"{_P}k", f"{_P}m", f"{_P}n"))
