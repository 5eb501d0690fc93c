import pytest
from pyspark.sql import functions as F

from clickspark.operators import models as mo
from clickspark.schema import FEATURE_COLS


def test_average_precision_hand_value(spark):
    # scores desc: 0.9(+) 0.8(-) 0.7(+) 0.6(-): AP = 0.5*1 + 0.5*(2/3)
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0)], "score double, label int")
    assert abs(mo.average_precision(df) - (0.5 + 1 / 3)) < 1e-12
    # ties share a threshold
    t = spark.createDataFrame([(0.5, 1), (0.5, 0)], "score double, label int")
    assert abs(mo.average_precision(t) - 0.5) < 1e-12


@pytest.fixture(scope="module")
def planted(spark):
    rows = []
    for i in range(400):
        x = (i * 37) % 100
        rows.append((i, *[float((x + k * 13) % 100) for k in range(len(FEATURE_COLS))], int(x > 60)))
    cols = ", ".join(f"{c} double" for c in FEATURE_COLS)
    return spark.createDataFrame(rows, f"user_id long, {cols}, label int")


def test_models_learn_planted_signal(planted):
    train, test = mo.split(planted)
    for name, kw in (("RandomForest", dict(numTrees=10)), ("XGBoost", dict(maxIter=5)), ("LogisticReg", {})):
        s = mo.score(mo.fit(name, train, **kw), test)
        assert mo.auc_roc(s) > 0.8
        assert s.where((F.col("score") < 0) | (F.col("score") > 1)).count() == 0


def test_shapley_telescopes(planted):
    m = mo.fit("RandomForest", planted, numTrees=5)
    phi = mo.shap_values(m, planted.limit(10), planted, n_perm=4)
    tot = {r.user_id: r.s for r in phi.groupBy("user_id").agg(F.sum("phi").alias("s")).collect()}
    bg = planted.agg(*[F.avg(c).alias(c) for c in FEATURE_COLS])
    fbg = mo.score(m, bg.withColumn("user_id", F.lit(-1))).first().score
    fx = {r.user_id: r.score for r in mo.score(m, planted.where(F.col("user_id").isin(list(tot)))).collect()}
    for u, s in tot.items():
        assert abs(s - (fx[u] - fbg)) < 1e-9


def test_shapley_takes_every_row(planted):
    """No cap on the explained rows, and the scored frame is spread."""
    m = mo.fit("RandomForest", planted, numTrees=1, maxDepth=1)
    many = planted.crossJoin(planted.sparkSession.range(6).withColumnRenamed("id", "_k")).withColumn(
        "user_id", F.col("user_id") * 6 + F.col("_k")).drop("_k")
    phi = mo.shap_values(m, many.coalesce(1), planted, n_perm=1)
    assert phi.select("user_id").distinct().count() == 2400
    plan = phi._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_auc_is_exact(spark):
    """More distinct scores than any bin count: equal to the pair count."""
    import numpy as np
    rs = np.random.RandomState(3)
    y = (rs.rand(6000) < 0.2).astype(int)
    x = np.round(rs.randn(6000) + y, 3 + rs.randint(0, 3))
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "score double, label int")
    pos, neg = np.sort(x[y == 1]), np.sort(x[y == 0])
    below = np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")
    assert mo.auc_roc(df) == below.sum() / 2 / (len(pos) * len(neg))
    assert mo.auc_roc(df.where("label = 1")) != mo.auc_roc(df.where("label = 1"))  # NaN: no pairs


def test_null_users_keep_their_label(spark, make_events):
    """Events without a user are one user on both sides of the join."""
    from clickspark.operators import features as fe
    import datetime as dt
    ev = make_events([(None, "2024-01-01T00:00:00", "view"), (None, "2024-01-03T00:00:00", "purchase"),
                      (1, "2024-01-01T00:00:00", "view")])
    ds = fe.ml_dataset(ev, cutoff=dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc))
    assert {r.user_id: r.label for r in ds.collect()} == {None: 1, 1: 0}


def test_importances(planted):
    m = mo.fit("XGBoost", planted, maxIter=3, maxDepth=2)
    sc = mo.importance_split_count(m).toPandas()
    assert len(sc) == len(FEATURE_COLS) and sc.importance.sum() > 0
    g = mo.importance_gain(m).toPandas()
    assert abs(g.importance.sum() - 1.0) < 1e-9
