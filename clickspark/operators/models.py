"""Purchase and abandonment models, N71-N91, on ``pyspark.ml``.

Both boosted configurations are grown by ``operators.boosting`` (second-order
gain; level by level with an L2 of 1, or best-first with 31 leaves), the forest
and the logistic model by ``pyspark.ml``.  Hyper-parameters default to the
reference's values and, where it sets none, to those libraries' published
defaults.  Metrics that ``pyspark.ml`` lacks are distributed jobs here:
step-wise average precision (aggregate by score, running sums from
per-partition offsets), macro F1 from a confusion count table, split-count and
gain importance from the trees' nodes, exact Shapley values of boosted trees
and, for other models, sampled ones scored with ``model.transform`` on an
exploded (sample x permutation x prefix) frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickspark.functions.numeric import exact_avg, round_np
from clickspark.operators.boosting import BoostedTrees, fit_boosted, fit_boosted_together
from clickspark.operators.features import stratified_folds, stratified_split, time_filter
from clickspark.operators.ranking import stage_table
from clickspark.schema import FEATURE_COLS
from clickspark.staging import in_scope

# Fixed hyper-parameters of the reference's models.
MODEL_PARAMS = {
    "RandomForest": dict(numTrees=100, maxDepth=10, minInstancesPerNode=5),
    "XGBoost": dict(maxIter=100, maxDepth=6, stepSize=0.05, maxBins=256),
    "LightGBM": dict(maxIter=100, maxDepth=8, stepSize=0.05, maxBins=255),
    "LogisticReg": dict(maxIter=500),
}
ABANDON_PARAMS = dict(maxIter=200, maxDepth=8, stepSize=0.05, maxBins=255)
# Fixed defaults of the two boosted libraries that the reference leaves as they are.
GROWTH = {"XGBoost": dict(leaves=None, l2=1.0, minHessian=1.0, minRows=1),
          "LightGBM": dict(leaves=31, l2=0.0, minHessian=1e-3, minRows=20)}
GROWTH["Abandonment"] = GROWTH["LightGBM"]
SEED = 42


def estimator(name: str, label: str = "label", n_train: int | None = None,
              features: Sequence[str] = FEATURE_COLS, **overrides) -> Pipeline:
    """Pipeline (assembler [+ scaler] + classifier) of a ``pyspark.ml`` model."""
    p = {**MODEL_PARAMS.get(name, {}), **overrides}
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    if name == "RandomForest":
        clf = RandomForestClassifier(labelCol=label, featuresCol="features", seed=SEED, **p)
    elif name == "LogisticReg":
        # sklearn's default L2 with C = 1 on the summed loss equals Spark's
        # mean loss with regParam = 1 / n_train
        reg = 1.0 / max(1, n_train or 1)
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
        clf = LogisticRegression(labelCol=label, featuresCol="scaled", regParam=reg, elasticNetParam=0.0,
                                 standardization=False, **p)
        return Pipeline(stages=[asm, scaler, clf])
    else:
        raise ValueError(name)
    return Pipeline(stages=[asm, clf])


def _boosted(name: str, overrides: dict) -> dict:
    """Settings of a boosted model."""
    own = ABANDON_PARAMS if name == "Abandonment" else MODEL_PARAMS[name]
    return {**own, **GROWTH[name], **overrides}


def fit(name: str, train: DataFrame, label: str = "label", **overrides) -> PipelineModel | BoostedTrees:
    """Fit a named model; the input is cached for the iterations of the
    fit and released after."""
    from pyspark import StorageLevel
    if name in GROWTH:
        return fit_boosted(stage_table(train), label, **_boosted(name, overrides))
    t = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = t.count() if name == "LogisticReg" else None
        return estimator(name, label, n_train=n, **overrides).fit(t)
    finally:
        t.unpersist()


def score(model: PipelineModel | BoostedTrees, df: DataFrame, out: str = "score") -> DataFrame:
    """Add the positive-class probability ``out`` and the 0.5 prediction."""
    if isinstance(model, BoostedTrees):
        return model.predict(df, out).withColumn("pred", (F.col(out) > 0.5).cast("int"))
    s = model.transform(df)
    return (s.withColumn(out, vector_to_array("probability")[1])
             .withColumn("pred", (F.col(out) > 0.5).cast("int"))
             .drop("features", "scaled", "rawPrediction", "probability", "prediction"))


def _thresholds(scored: DataFrame, label: str, out: str) -> DataFrame:
    """One row per distinct score, high to low: ``pos`` and ``cnt`` rows at
    it, running ``tp`` and ``n`` down to it, total positives ``_tp`` and rows
    ``_tn``.  Running sums come from range partitions and per-partition
    offsets (no single-partition window over the scores)."""
    g = scored.groupBy(out).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("cnt"))
    t = stage_table(g.repartitionByRange(F.col(out).desc())
                 .withColumn("_pid", F.spark_partition_id()))
    part = t.groupBy("_pid").agg(F.sum("pos").alias("_p"), F.sum("cnt").alias("_c"))
    w0 = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offs = part.select("_pid", F.coalesce(F.sum("_p").over(w0), F.lit(0)).alias("_op"),
                       F.coalesce(F.sum("_c").over(w0), F.lit(0)).alias("_oc"),
                       F.sum("_p").over(Window.partitionBy()).alias("_tp"),
                       F.sum("_c").over(Window.partitionBy()).alias("_tn"))
    wl = Window.partitionBy("_pid").orderBy(F.col(out).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (t.join(F.broadcast(offs), "_pid")
             .withColumn("tp", F.col("_op") + F.sum("pos").over(wl))
             .withColumn("n", F.col("_oc") + F.sum("cnt").over(wl)))


def ranking_metrics(scored: DataFrame, label: str = "label", out: str = "score") -> tuple[float, float]:
    """Area under the ROC curve (trapezoids over the distinct
    scores, in whole numbers until the last division) and step-wise average
    precision, in one pass; NaN when a class is absent."""
    whole = lambda c: c.cast("decimal(18,0)")
    double_area = F.sum(whole(F.col("cnt") - F.col("pos")) * whole(F.col("tp") * 2 - F.col("pos"))).cast("double")
    pairs = F.max(F.col("_tp").cast("double") * (F.col("_tn") - F.col("_tp")))
    r = _thresholds(scored, label, out).agg(
        F.try_divide(double_area, pairs * 2).alias("auc"),
        F.sum(F.try_divide(F.col("pos"), F.col("_tp")) * (F.col("tp") / F.col("n"))).alias("ap")).first()
    return tuple(float("nan") if x is None else float(x) for x in r)


def auc_roc(scored: DataFrame, label: str = "label", out: str = "score") -> float:
    """Area under the ROC curve, exact at any number of scores."""
    return ranking_metrics(scored, label, out)[0]


def average_precision(scored: DataFrame, label: str = "label", out: str = "score") -> float:
    """Step-wise average precision ``Σ ΔR · P`` over distinct score
    thresholds (high to low)."""
    return ranking_metrics(scored, label, out)[1]


def classification_report(scored: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Per-class precision, recall, F1 and support at threshold 0.5,
    plus the macro average row."""
    cm = scored.groupBy(F.col(label).cast("int").alias("y"), F.col(pred).cast("int").alias("p")).count()
    rows = {(r["y"], r["p"]): r["count"] for r in cm.collect()}  # at most 4 cells
    out = []
    for k in (0, 1):
        tp = rows.get((k, k), 0)
        fp = sum(v for (y, p), v in rows.items() if p == k and y != k)
        fn = sum(v for (y, p), v in rows.items() if y == k and p != k)
        prec = tp / (tp + fp) if tp + fp else 0.0
        rec = tp / (tp + fn) if tp + fn else 0.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        out.append((str(k), prec, rec, f1, tp + fn))
    m = [sum(x[i] for x in out) / 2 for i in (1, 2, 3)]
    out.append(("macro avg", m[0], m[1], m[2], sum(x[4] for x in out)))
    return scored.sparkSession.createDataFrame(out, "class string, precision double, recall double, "
                                                    "f1_score double, support long")


def macro_f1(scored: DataFrame, label: str = "label", pred: str = "pred") -> float:
    return float(classification_report(scored, label, pred).where(F.col("class") == "macro avg").first()["f1_score"])


def cross_validate(name: str, ds: DataFrame, label: str = "label", k: int = 3, seed: int = SEED,
                   parallelism: int | None = None, folds: DataFrame | None = None,
                   models: Sequence[BoostedTrees] | None = None, **overrides) -> tuple[float, float]:
    """Mean and population std of fold AUC over k stratified folds of
    the whole dataset (``folds``: already made, with a ``fold`` column).  The
    k fits are independent Spark jobs submitted concurrently (as
    ``CrossValidator(parallelism=k)``); boosted models are grown side by side
    (``models``: already grown, by fold)."""
    from concurrent.futures import ThreadPoolExecutor
    f = stage_table(stratified_folds(ds, label, k, seed)) if folds is None else folds
    if name in GROWTH and models is None:
        models = fit_boosted_together([(f.where(F.col("fold") != i), _boosted(name, overrides)) for i in range(k)], label)

    def one(i: int) -> float:
        m = models[i] if models else fit(name, f.where(F.col("fold") != i), label, **overrides)
        return auc_roc(score(m, f.where(F.col("fold") == i)), label)

    with ThreadPoolExecutor(max_workers=parallelism or k) as pool:
        aucs = list(pool.map(in_scope(one), range(k)))
    mean = sum(aucs) / k
    std = (sum((a - mean) ** 2 for a in aucs) / k) ** 0.5
    return mean, std


def split(ds: DataFrame, label: str = "label", test_size: float = 0.2, seed: int = SEED):
    """N71 applied: (train, test) frames."""
    s = stage_table(stratified_split(ds, label, test_size, seed))
    return s.where(F.col("is_test") == 0).drop("is_test"), s.where(F.col("is_test") == 1).drop("is_test")


def model_comparison(ds: DataFrame, label: str = "label", models: Sequence[str] = tuple(MODEL_PARAMS),
                     cv_folds: int = 3, **overrides) -> tuple[DataFrame, dict]:
    """AUC, AP, CV AUC mean / std and macro F1 per model (4 dp).
    Returns the table and the fitted models (trained on the train split).
    The boosted models of the split and of the folds are grown side by side."""
    from concurrent.futures import ThreadPoolExecutor
    ds = stage_table(ds)  # the split and the folds read it
    train, test = split(ds, label)
    folds = stage_table(stratified_folds(ds, label, cv_folds, SEED))  # the same for every model
    given = {n: {k: v for k, v in overrides.items() if k in MODEL_PARAMS.get(n, {})} for n in models}
    parts = [train, *[folds.where(F.col("fold") != i) for i in range(cv_folds)]]
    asked = [(n, t) for n in models if n in GROWTH for t in parts]

    def together() -> list[BoostedTrees]:
        return fit_boosted_together([(t, _boosted(n, given[n])) for n, t in asked], label) if asked else []

    with ThreadPoolExecutor(max_workers=len(models) + 1) as pool:
        grown = pool.submit(in_scope(together))

        def one(name: str):
            m, *of_folds = ([m for m, (n, _) in zip(grown.result(), asked) if n == name] if name in GROWTH
                            else [fit(name, train, label, **given[name])])
            s = stage_table(score(m, test))
            cvm, cvs = cross_validate(name, ds, label, cv_folds, folds=folds, models=of_folds or None, **given[name])
            return name, m, (name, *ranking_metrics(s, label), cvm, cvs, macro_f1(s, label))

        res = list(pool.map(in_scope(one), models))
    fitted = {n: m for n, m, _ in res}
    rows = [r for _, _, r in res]
    df = ds.sparkSession.createDataFrame(rows, "model string, auc double, ap double, cv_mean double, "
                                               "cv_std double, f1 double")
    return df.select("model", round_np("auc", 4).alias("AUC_ROC"), round_np("ap", 4).alias("Avg_Precision"),
                     round_np("cv_mean", 4).alias("CV_AUC_mean"), round_np("cv_std", 4).alias("CV_AUC_std"),
                     round_np("f1", 4).alias("F1_macro")), fitted


def _active():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


def importance_split_count(model: BoostedTrees, features: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """Number of splits per feature over all trees (the split-count
    importance), every feature listed, by importance desc."""
    cnt = model.nodes(_active()).where("feature is not null").groupBy("feature").count()
    return _named(cnt, "count", features)


def importance_gain(model: BoostedTrees, features: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """Mean split gain per feature, normalised to sum 1 (the gain
    importance)."""
    g = model.nodes(_active()).where("feature is not null").groupBy("feature").agg(exact_avg("gain").alias("g"))
    tot = F.sum("g").over(Window.partitionBy())  # one row per feature
    return _named(g.select("feature", (F.col("g") / tot).alias("g")), "g", features)


def importance_forest(model: PipelineModel, features: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """Impurity importance of a fitted forest (``featureImportances``)."""
    imp = model.stages[-1].featureImportances.toArray()
    spark = _active()
    return (spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")
                 .orderBy(F.desc("importance"), "feature"))


def _named(df: DataFrame, col: str, features: Sequence[str]) -> DataFrame:
    names = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return (names.join(df, "feature", "left")
                 .select("feature", F.coalesce(F.col(col).cast("double"), F.lit(0.0)).alias("importance"))
                 .orderBy(F.desc("importance"), "feature"))


def seeded_sample(df: DataFrame, n: int, seed: int = SEED, key: str = "user_id") -> DataFrame:
    """``min(n, rows)`` rows, the first by the MD5 of ``seed:key``: the
    same rows at any partitioning, and in any SQL engine."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return df.withColumn("_h", F.md5(name)).orderBy("_h", key).limit(n).drop("_h")


def shap_importance(model: PipelineModel | BoostedTrees, sample: DataFrame, background: DataFrame,
                    features: Sequence[str] = FEATURE_COLS, n_perm: int = 20, max_rows: int = 2000,
                    seed: int = SEED, key: str = "user_id") -> DataFrame:
    """Mean |Shapley value| per feature over a seeded sample of at most
    ``max_rows`` rows (the reference's sample of the test set): exact values of
    the margin for boosted trees, permutation sampling of the probability for
    other models."""
    rows = seeded_sample(sample, max_rows, seed, key)
    if isinstance(model, BoostedTrees):
        # the sample may sit in one partition; a row's work is the same everywhere
        phi = model.attributions(rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key), key)
    else:
        phi = shap_values(model, rows, background, features=features, n_perm=n_perm, seed=seed, key=key)
    imp = phi.groupBy("idx").agg(exact_avg(F.abs("phi")).alias("mean_abs_shap"))
    names = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("idx") + 1)
    return _named(imp.withColumn("feature", names), "mean_abs_shap", features).withColumnRenamed("importance", "mean_abs_shap")


def shap_values(model: PipelineModel, sample: DataFrame, background: DataFrame,
                features: Sequence[str] = FEATURE_COLS, n_perm: int = 20,
                seed: int = SEED, key: str = "user_id") -> DataFrame:
    """Per-row Shapley estimates ``(key, idx, phi)``.

    For each explained row and each of ``n_perm`` seeded feature
    permutations, the prefixes of the permutation switch features from the
    background (feature means of ``background``, one aggregate row) to the
    row's values; the model scores every prefix and the score difference
    between consecutive prefixes is the contribution of the feature added.
    Per row the contributions sum to f(x) - f(background) exactly.  The
    (row x permutation x prefix) frame is built with array functions and
    scored by ``model.transform`` in one job; the lag window is per
    (row, permutation), d + 1 rows each."""
    d = len(features)
    bg = background.agg(*[F.avg(c).alias(c) for c in features]).first()
    rows = sample.select(key, F.array(*[F.col(c).cast("double") for c in features]).alias("_x"))
    r = rows.select(key, "_x", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("_perm"))
    # permutation = feature indices ordered by a seeded hash of (row, perm, feature)
    keyed = F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                        lambda i: F.struct(F.xxhash64(F.lit(seed), F.col(key), F.col("_perm"), i).alias("h"),
                                           i.alias("i")))
    r = r.withColumn("_order", F.transform(F.array_sort(keyed), lambda st: st["i"]))
    r = r.select("*", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("_j"))
    bgv = F.array(*[F.lit(float(bg[c]) if bg[c] is not None else 0.0) for c in features])
    # a feature takes the row's value when its position in the permutation is < j
    pos = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.array_position(F.col("_order"), i) - 1)
    z = F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                    lambda i: F.when(F.element_at(pos, i + 1) < F.col("_j"), F.element_at(F.col("_x"), i + 1))
                               .otherwise(F.element_at(bgv, i + 1)))
    zz = r.select(key, "_perm", "_j", "_order", *[F.element_at(z, i + 1).alias(c) for i, c in enumerate(features)])
    # the sample may sit in one partition; the scoring is spread by what the window needs
    s = score(model, zz.repartition(zz.sparkSession.sparkContext.defaultParallelism, key, "_perm"), "_f")
    w = Window.partitionBy(key, "_perm").orderBy("_j")
    contrib = (s.select(key, "_perm", "_j", "_order", (F.col("_f") - F.lag("_f").over(w)).alias("_c"))
                .where(F.col("_j") > 0)
                .select(key, "_perm", F.element_at("_order", F.col("_j")).alias("idx"), "_c"))
    return contrib.groupBy(key, "idx").agg(F.avg("_c").alias("phi"))


def purchase_probabilities(model: PipelineModel, ds: DataFrame, out: str = "purchase_probability") -> DataFrame:
    """Score every user with a fitted model."""
    return score(model, ds, out).drop("pred")


# Fixed probability bands (right-closed, 0 excluded) and labels.
PROB_EDGES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
PROB_LABELS = ("0-20%", "20-40%", "40-60%", "60-80%", "80-100%")


def probability_buckets(probs: DataFrame, col: str = "purchase_probability") -> DataFrame:
    """Users per right-closed 20 % band, all five bands in order."""
    p = F.col(col)
    b = F.lit(None).cast("int")
    for i in range(len(PROB_LABELS) - 1, -1, -1):
        b = F.when((p > PROB_EDGES[i]) & (p <= PROB_EDGES[i + 1]), F.lit(i + 1)).otherwise(b)
    cnt = probs.groupBy(b.alias("o")).agg(F.count("*").alias("count")).where(F.col("o").isNotNull())
    spine = probs.sparkSession.createDataFrame(list(enumerate(PROB_LABELS, 1)), "o int, bucket string")
    return (spine.join(cnt, "o", "left")
                 .select("bucket", F.coalesce("count", F.lit(0)).cast("long").alias("count"), "o")
                 .orderBy("o").drop("o"))


def abandonment_labels(ev: DataFrame, since=None) -> DataFrame:
    """Per user, carted and never purchased, over all time as the
    reference (so the label overlaps the feature window); ``since`` (the
    feature cutoff) counts only later events, a leakage-free label."""
    if since is not None:
        ev = time_filter(ev, since, past=False)
    g = ev.groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "cart", 1)).alias("_c"),
                                  F.count(F.when(F.col("event_type") == "purchase", 1)).alias("_p"))
    return g.select("user_id", ((F.col("_c") > 0) & (F.col("_p") == 0)).cast("int").alias("abandoned"))


def abandonment_dataset(ds: DataFrame, ab: DataFrame) -> DataFrame:
    """ML dataset ⟕ abandonment labels (0 when absent), users with
    carts > 0."""
    ab = ab.withColumnRenamed("user_id", "_u")
    return (ds.join(ab, ds.user_id.eqNullSafe(ab["_u"]), "left").drop("_u").withColumn("abandoned", F.coalesce("abandoned", F.lit(0)))
              .where(F.col("carts") > 0))


def train_abandonment(ab_ds: DataFrame, **overrides) -> tuple[BoostedTrees, DataFrame, DataFrame]:
    """Boosted abandonment model on a stratified split; returns the
    model, a one-row metrics frame (AUC, AP, macro F1) and the per-class
    report."""
    train, test = split(ab_ds, "abandoned")
    m = fit("Abandonment", train, "abandoned", **overrides)
    s = stage_table(score(m, test))
    report = classification_report(s, "abandoned")
    f1 = report.where(F.col("class") == "macro avg").first()["f1_score"]
    met = ab_ds.sparkSession.createDataFrame([(*ranking_metrics(s, "abandoned"), float(f1))],
                                             "auc double, ap double, f1_macro double")
    return m, met, report


def abandon_probabilities(model: PipelineModel, ab_ds: DataFrame) -> DataFrame:
    """Abandonment probability of every carted user."""
    return score(model, ab_ds, "abandon_probability").select("user_id", "abandon_probability")
