"""Readout, time-to-first-decision, routing and response labelling
(SURVEY F17-F21, G5, E10, E14, E15).

Weight tables are ordinary DataFrames ``(class, i, w)`` /
``(expert, class, i, w)``; inference is an equi-join of spike events to
weights followed by grouped sums, so only active inputs do work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def weight_table(spark: SparkSession, n_classes: int, n_inputs: int, n_experts: int | None = None,
                 salt: int = 0) -> DataFrame:
    """Deterministic weights in multiples of 1/4 (exact in any summation order):
    ``w = (((c*7 + i*13 + e*5 + salt) % 11) - 5) / 4``."""
    e_n = n_experts or 1
    df = spark.range(e_n * n_classes * n_inputs).select(
        F.floor(F.col("id") / F.lit(n_classes * n_inputs)).cast("int").alias("expert"),
        F.pmod(F.floor(F.col("id") / F.lit(n_inputs)), F.lit(n_classes)).cast("int").alias("class"),
        (F.col("id") % n_inputs).cast("int").alias("i"))
    w = (F.pmod(F.col("class") * 7 + F.col("i") * 13 + F.col("expert") * 5 + F.lit(salt), F.lit(11)) - 5) / F.lit(4.0)
    df = df.withColumn("w", w)
    return df if n_experts else df.drop("expert")


def spike_counts(events: DataFrame, id_col: str = "window_id") -> DataFrame:
    return events.groupBy(id_col, "i").agg(F.count(F.lit(1)).alias("n"))


def class_currents(counts: DataFrame, weights: DataFrame, id_col: str = "window_id") -> DataFrame:
    """currents(id, class) = sum_i n_i * w(class, i)."""
    return (counts.join(weights, "i").groupBy(id_col, "class")
            .agg(F.sum(F.col("n") * F.col("w")).alias("current")))


def argmax(df: DataFrame, key: str, arg: str, val: str, out: str = "pred") -> DataFrame:
    """Per key: arg of the largest value (ties -> smaller arg)."""
    best = df.groupBy(key).agg(F.max(F.struct(F.col(val).alias("v"), (-F.col(arg)).alias("na"))).alias("b"))
    return best.select(key, (-F.col("b.na")).alias(out), F.col("b.v").alias(val))


def readout(events: DataFrame, weights: DataFrame, id_col: str = "window_id") -> DataFrame:
    """Rate-mode readout: argmax of class currents; ids without spikes are absent."""
    cur = class_currents(spike_counts(events, id_col), weights, id_col)
    return argmax(cur, id_col, "class", "current")


def winning_current_threshold(ttfs_events: DataFrame, weights: DataFrame, frac: float,
                              id_col: str = "window_id") -> DataFrame:
    """TTFS threshold = frac x mean over ids of the largest final class current."""
    final = class_currents(spike_counts(ttfs_events, id_col), weights, id_col)
    win = final.groupBy(id_col).agg(F.max("current").alias("m"))
    return win.agg((F.lit(frac) * F.avg("m")).alias("thresh"))


def ttfs_decide(ttfs_events: DataFrame, weights: DataFrame, thresh: DataFrame, t_steps: int,
                id_col: str = "window_id") -> DataFrame:
    """First time step at which the leading class current reaches the
    threshold, else the leader after the last step (t = T-1).

    Currents only change at steps with events, so only those steps are
    evaluated; window partitions are one id's (step, class) rows.
    """
    per_step = (ttfs_events.join(weights, "i").groupBy(id_col, "t", "class")
                .agg(F.sum("w").alias("dw")))
    w = (Window.partitionBy(id_col, "class").orderBy("t")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cum = per_step.withColumn("cur", F.sum("dw").over(w))
    # a class without events at a step keeps its previous current: fill the
    # (step x class) grid per id from the classes that have any event so far
    steps = per_step.select(id_col, "t").distinct()
    classes = weights.select("class").distinct()
    grid = steps.join(F.broadcast(classes), how="cross")
    wl = (Window.partitionBy(id_col, "class").orderBy("t")
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    full = (grid.join(cum.select(id_col, "t", "class", "cur"), [id_col, "t", "class"], "left")
            .withColumn("cur", F.coalesce(F.last("cur", ignorenulls=True).over(wl), F.lit(0.0))))
    lead = Window.partitionBy(id_col, "t").orderBy(F.col("cur").desc(), F.col("class"))
    leaders = full.withColumn("rk", F.row_number().over(lead)).filter(F.col("rk") == 1).drop("rk")
    leaders = leaders.join(F.broadcast(thresh), how="cross")
    dec = leaders.groupBy(id_col).agg(F.min(F.when(F.col("cur") >= F.col("thresh"), F.col("t"))).alias("td"),
                                      F.max("t").alias("tlast"))
    pick = dec.select(id_col, "td", F.coalesce("td", "tlast").alias("t"))
    return (pick.join(leaders.select(id_col, "t", "class"), [id_col, "t"])
            .select(id_col, F.col("class").alias("pred"),
                    F.coalesce(F.col("td"), F.lit(t_steps - 1)).alias("t_decide"),
                    F.col("td").isNotNull().alias("early")))


def synops(events: DataFrame, n_classes: int, n_inputs: int, t_steps: int, id_col: str = "window_id") -> DataFrame:
    """Spike-driven ops (spikes x classes) vs the dense T x N x C count."""
    return events.groupBy(id_col).agg((F.count(F.lit(1)) * F.lit(n_classes)).alias("synops")).withColumn(
        "dense_ops", F.lit(t_steps * n_inputs * n_classes).cast("bigint"))


def expert_route(counts: DataFrame, n_inputs: int, steps: int, n_clusters: int = 16, n_experts: int = 8,
                 top_k: int = 2, temp: float = 0.5, id_col: str = "window_id",
                 bias: DataFrame | None = None) -> DataFrame:
    """Firing-rate routing: cluster = i % n_clusters, cluster rate = mean rate of
    its inputs, expert score = mean of its clusters / temp + bias; top-k
    experts (ties -> smaller expert) with softmax gates over their scores."""
    per = n_clusters // n_experts
    size = n_inputs // n_clusters
    cl = counts.groupBy(id_col, (F.col("i") % n_clusters).alias("cluster")).agg(F.sum("n").alias("cn"))
    ex = cl.groupBy(id_col, (F.col("cluster") / F.lit(per)).cast("int").alias("expert")).agg(
        F.sum("cn").alias("en"))
    score = F.col("en") / F.lit(float(steps * size * per)) / F.lit(max(temp, 0.01))
    ids = counts.select(id_col).distinct()
    spine = ids.select(id_col, F.explode(F.sequence(F.lit(0), F.lit(n_experts - 1))).alias("expert"))
    s = spine.join(ex, [id_col, "expert"], "left").select(id_col, "expert", F.coalesce(score, F.lit(0.0)).alias("score"))
    if bias is not None:
        s = s.join(bias, "expert", "left").select(id_col, "expert", (F.col("score") + F.coalesce("bias", F.lit(0.0))).alias("score"))
    w = Window.partitionBy(id_col).orderBy(F.col("score").desc(), F.col("expert"))
    top = s.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= top_k)
    wk = Window.partitionBy(id_col)
    top = top.withColumn("m", F.max("score").over(wk)).withColumn("ex", F.exp(F.col("score") - F.col("m")))
    return top.select(id_col, "expert", "score", (F.col("ex") / F.sum("ex").over(wk)).alias("gate"))


def mixture_infer(counts: DataFrame, routes: DataFrame, expert_weights: DataFrame, id_col: str = "window_id") -> DataFrame:
    """Gate-weighted class currents of the routed experts only, argmax."""
    cur = (counts.join(routes.select(id_col, "expert", "gate"), id_col)
           .join(expert_weights, ["expert", "i"])
           .groupBy(id_col, "expert", "class").agg(F.sum(F.col("n") * F.col("w")).alias("cur")))
    comb = (cur.join(routes.select(id_col, "expert", "gate"), [id_col, "expert"])
            .groupBy(id_col, "class").agg(F.sum(F.col("gate") * F.col("cur")).alias("combined")))
    return argmax(comb, id_col, "class", "combined")


def expert_usage(routes: DataFrame) -> DataFrame:
    """How often each expert is selected and its share of all selections."""
    u = routes.groupBy("expert").agg(F.count(F.lit(1)).alias("used"))
    tot = routes.agg(F.count(F.lit(1)).alias("total"))
    return u.join(F.broadcast(tot), how="cross").select("expert", "used", (F.col("used") / F.col("total")).alias("share"))


def unit_labels(responses: DataFrame, labels: DataFrame, n_classes: int, normalise: bool = True) -> DataFrame:
    """unit -> class with the largest mean (or, unnormalised, total) response
    per class; classes without responses count as 0, ties -> smaller class."""
    per_class = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_c"))
    s = responses.join(labels, "sample_id").groupBy("unit", "label").agg(F.sum("response").alias("r"))
    units = responses.select("unit").distinct()
    spine = units.select("unit", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("label"))
    full = spine.join(s, ["unit", "label"], "left").join(per_class, "label", "left")
    val = F.coalesce(F.col("r"), F.lit(0.0)).cast("double")
    if normalise:
        val = val / F.greatest(F.coalesce(F.col("n_c"), F.lit(0)), F.lit(1))
    return argmax(full.select("unit", "label", val.alias("mean_response")), "unit", "label", "mean_response", "assigned")


def population_vote(responses: DataFrame, assignment: DataFrame, n_classes: int) -> DataFrame:
    """Predicted class = class whose assigned units responded most (0 for
    classes without units; all classes compete, ties -> smaller class)."""
    sc = (responses.join(assignment.select("unit", F.col("assigned").alias("label")), "unit")
          .groupBy("sample_id", "label").agg(F.sum("response").alias("score")))
    ids = responses.select("sample_id").distinct()
    spine = ids.select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("label"))
    full = spine.join(sc, ["sample_id", "label"], "left").select(
        "sample_id", "label", F.coalesce(F.col("score"), F.lit(0)).cast("double").alias("score"))
    return argmax(full, "sample_id", "label", "score")


def fit_readout(windows: DataFrame, vec: str = "vec", label: str = "label", split: str = "split",
                max_iter: int = 100) -> DataFrame:
    """Supervised readout: multinomial logistic regression without intercept
    on binarised windows (the delta-rule readout's batch counterpart);
    returns one row with hold-out accuracy and sizes."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    d = windows.withColumn("features", array_to_vector(F.transform(vec, lambda v: F.when(v >= 0.5, 1.0).otherwise(0.0))))
    idx = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc").fit(d)
    d = idx.transform(d)
    train = d.filter(F.col(split) == "train")
    test = d.filter(F.col(split) == "test")
    model = LogisticRegression(featuresCol="features", labelCol="y", family="multinomial", fitIntercept=False,
                               maxIter=max_iter, regParam=0.0).fit(train)
    pred = model.transform(test)
    return pred.agg(F.count(F.lit(1)).alias("n_test"),
                    F.count_if(F.col("prediction") == F.col("y")).alias("correct")).withColumn(
        "accuracy", F.col("correct") / F.col("n_test"))


def learned_labeller(train: DataFrame, vec: str = "vec", label: str = "label", max_iter: int = 50):
    """Fit the readout on ``train`` and return a function that adds ``learned``
    (the most likely label) to windows: a projection, no shuffle."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    lit = lambda d: d.withColumn("__features", array_to_vector(F.transform(vec, lambda v: F.when(v >= 0.5, 1.0).otherwise(0.0))))
    index = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(train)
    model = LogisticRegression(featuresCol="__features", labelCol="__y", family="multinomial", fitIntercept=False,
                               maxIter=max_iter, predictionCol="__at", rawPredictionCol="__raw", probabilityCol="__p").fit(lit(index.transform(train)))
    names = F.array(*[F.lit(x) for x in index.labels])
    return lambda d: model.transform(lit(d)).select(*d.columns, F.get(names, F.col("__at").cast("int")).alias("learned"))


LOAD_BALANCE = 6.0   # fixed value: router penalty on over-used experts


def affinity_route(counts: DataFrame, expert_weights: DataFrame, usage: DataFrame, steps: int, top_k: int = 2,
                   load: float = LOAD_BALANCE, id_col: str = "window_id") -> DataFrame:
    """Affinity routing: ``aff_e = sum_i rate_i * colsum_e[i]`` with
    ``colsum_e[i] = sum_c w_e(c, i)``; score ``aff_e - load * share_e * aff_e``
    with ``share_e`` from a usage table (expert, share); top-k, ties -> smaller expert."""
    colsum = expert_weights.groupBy("expert", "i").agg(F.sum("w").alias("cs"))
    aff = (counts.join(colsum, "i").groupBy(id_col, "expert")
           .agg(F.sum(F.col("n") / F.lit(float(steps)) * F.col("cs")).alias("aff")))
    s = aff.join(F.broadcast(usage.select("expert", "share")), "expert", "left").select(
        id_col, "expert", (F.col("aff") - F.lit(load) * F.coalesce(F.col("share"), F.lit(0.0)) * F.col("aff")).alias("score"))
    w = Window.partitionBy(id_col).orderBy(F.col("score").desc(), F.col("expert"))
    return s.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= top_k)
