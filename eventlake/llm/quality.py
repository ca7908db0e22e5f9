"""Quality classifier: a sparse rule ensemble over text statistics.

1. Text statistics per document (byte classes, word repetition, line shape).
2. A random forest (Spark ML) on labelled rows; every path from a root to a
   node is a conjunctive rule over the statistics.
3. Lasso logistic regression (Spark ML) weighs the rules; most become 0.
4. The rest is compiled into one Spark column expression, the score.

Training uses at most about ``max_train_rows`` labelled rows, chosen by a hash
of the id; statistics and scores cover every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake.llm.common import written
from eventlake.llm.textcols import SLICE_BYTES, raw, text_array, words

PREFIX = "_q_"
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "white", "newline", "bang", "pipe", "sentence_end", "comma",
    "other_symbol", "non_ascii", "control", "distinct_words", "top_word", "repeat_next", "distinct_pairs", "words_per_line",
)
MAX_TRAIN_ROWS = 20_000


def _class_matrix() -> np.ndarray:
    groups = [range(65, 91), range(48, 58), (9, 11, 12, 13, 32), (10,), b"!", b"|", b".?", b",", None, range(128, 256), (*range(0, 9), *range(14, 32), 127)]
    named = {x for g in groups if g is not None for x in g} | set(range(97, 123))
    m = np.zeros((256, len(groups)))
    for i, g in enumerate(groups):
        m[[x for x in range(256) if x not in named] if g is None else list(g), i] = 1
    return m


_CLASSES = _class_matrix()


def _histogram(x: np.ndarray) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    for a in range(0, len(x), SLICE_BYTES):
        out += np.bincount(x[a:a + SLICE_BYTES], minlength=256)
    return out


def _distinct(key: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: number of distinct keys and the largest count of one key."""
    if len(key) == 0:
        return np.zeros(n), np.zeros(n)
    k = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (key >> np.uint64(20)))
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    owner = (k[first] >> np.uint64(44)).astype(np.int64)
    runs = np.diff(np.append(first, len(k)))
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, owner, runs)
    return np.bincount(owner, minlength=n), top


def statistics(column: pa.Array) -> np.ndarray:
    """The statistics of each text, one row per document; empty texts give zeros."""
    data, off = raw(column)
    out = np.zeros((len(off) - 1, len(STATISTICS)))
    for w in words(column):
        n = w.hi - w.lo
        size = np.diff(off[w.lo:w.hi + 1]).astype(float)
        hist = np.stack([_histogram(data[off[d]:off[d + 1]]) for d in range(w.lo, w.hi)])
        cls = hist @ _CLASSES
        count = np.diff(w.offsets).astype(float)
        doc, h = w.doc_of_word(), w.hashes[0]
        one = np.maximum(count, 1)
        distinct, top = _distinct(h, doc, n)
        same = doc[1:] == doc[:-1]
        repeat = np.bincount(doc[1:][same & (h[1:] == h[:-1])], minlength=n)
        pair, _ = _distinct((h[1:] * np.uint64(3) + h[:-1])[same], doc[1:][same], n)
        share = cls / np.maximum(size, 1)[:, None]
        out[w.lo:w.hi] = np.column_stack([
            np.log1p(size), np.log1p(count), (size - cls[:, 2]) / one, share[:, :11],
            distinct / one, top / one, repeat / one, pair / np.maximum(count - 1, 1), count / (cls[:, 3] + 1)])
    return out


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with one ``_q_<statistic>`` column each added."""
    schema = T.StructType([*docs.schema.fields, *[T.StructField(PREFIX + s, T.DoubleType()) for s in STATISTICS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = statistics(text_array(batch.column(text_col)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(np.ascontiguousarray(values[:, i])) for i in range(values.shape[1])]],
                names=[*batch.schema.names, *[PREFIX + s for s in STATISTICS]])

    return docs.mapInArrow(run, schema)


Condition = tuple[int, bool, float]          # statistic, is it "greater than", threshold


@dataclass
class RuleModel:
    """score = sigmoid(intercept + sum of the weights of the rules that hold)."""

    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule_column(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def rule_column(rule: tuple[Condition, ...]) -> Column:
    """A conjunctive rule as a Spark column."""
    out = F.lit(True)
    for stat, above, cut in rule:
        c = F.col(PREFIX + STATISTICS[stat])
        out = out & ((c > cut) if above else (c <= cut))
    return out


def tree_paths(node, path: tuple[Condition, ...] = ()) -> Iterator[tuple[Condition, ...]]:
    """Every root-to-node path of a Spark ML tree as a simplified conjunction."""
    if path:
        yield path
    if node.subtreeDepth() == 0:
        return
    split = node.split()
    stat, cut = int(split.featureIndex()), float(split.threshold())
    yield from tree_paths(node.leftChild(), _and(path, (stat, False, cut)))
    yield from tree_paths(node.rightChild(), _and(path, (stat, True, cut)))


def _and(path: tuple[Condition, ...], new: Condition) -> tuple[Condition, ...]:
    bounds = {(s, above): cut for s, above, cut in path}
    stat, above, cut = new
    have = bounds.get((stat, above))
    bounds[stat, above] = cut if have is None else max(have, cut) if above else min(have, cut)
    return tuple(sorted((s, a, c) for (s, a), c in bounds.items()))


def fit_rules(train: DataFrame, trees: int = 20, depth: int = 3, reg: float = 1e-3, seed: int = 7) -> RuleModel:
    """Fit on rows of statistics with a 0/1 double column ``label``.

    Without rows, or with one class only, the score is the smoothed base rate.
    """
    n, ones = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones == 0 or ones == n:
        return RuleModel(float(np.log((ones + 1) / (n - ones + 1))))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird",
                                    subsamplingRate=0.7, featuresCol="stats", labelCol="label", maxBins=64)
    stats = VectorAssembler(inputCols=[PREFIX + s for s in STATISTICS], outputCol="stats").transform(train)
    model = forest.fit(stats.select("stats", "label"))
    rules = list(dict.fromkeys(p for t in model.trees for p in tree_paths(t._java_obj.rootNode())))
    if not rules:
        return RuleModel(float(np.log((ones + 1) / (n - ones + 1))))
    fired = train.select("label", *[rule_column(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    vec = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="rules").transform(fired).select("label", "rules")
    lasso = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=reg, maxIter=60,
                               standardization=False).fit(vec)
    weights = lasso.coefficients.toArray()
    return RuleModel(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9])


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def train_on(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
             max_train_rows: int = MAX_TRAIN_ROWS) -> RuleModel:
    """Fit on labelled rows outside the held-out fifth.

    Rows without id or label are left out; several labels of one id count by
    their mean (1 from one half on).  About ``max_train_rows`` rows are taken, by hash.
    """
    by_id = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~is_held_out(id_col))
             .groupBy(F.col(id_col).alias("_l_id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("double").alias("label")))
    n = by_id.count()
    part = min(1.0, max_train_rows / max(n, 1))
    chosen = by_id.where(F.pmod(F.xxhash64("_l_id"), F.lit(1_000_000)) < int(part * 1_000_000))
    rows = (stats.select(F.col(id_col).alias("_l_id"), *[PREFIX + s for s in STATISTICS]).join(chosen, "_l_id"))
    return fit_rules(written(rows.select("label", *[PREFIX + s for s in STATISTICS]), "quality-train"))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """One row per document: ``<id_col>, score`` (0 to 1, higher: label 1 likelier).

    Null text counts as empty; empty texts are scored too; a null id stays null
    and is never trained on; repeated rows are scored each; other columns are
    ignored; an empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).alias("_d_id"), F.col(text_col).alias("_d_text"))
    stats = written(with_statistics(src, "_d_text").drop("_d_text").withColumnRenamed("_d_id", id_col), "quality-stats")
    model = train_on(stats, labels, id_col, max_train_rows=max_train_rows)
    return stats.select(id_col, model.score().alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score ``threshold`` or more, with their columns."""
    src = docs.select(F.col(id_col).alias("_d_id"), F.col(text_col).alias("_d_text"))
    stats = written(with_statistics(src, "_d_text").drop("_d_text").withColumnRenamed("_d_id", id_col), "quality-stats")
    model = train_on(stats, labels, id_col)
    return with_statistics(docs, text_col).where(model.score() >= threshold).select(*docs.columns)
