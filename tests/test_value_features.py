from pyspark.sql import functions as F

from clickspark.operators import features as fe
from clickspark.operators import value as va


def test_clv_all_equal(spark):
    rows = [(u, 10, 5, 1, 0, 1, 0.5) for u in (1, 2, 3)]
    df = spark.createDataFrame(rows, "user_id long, total_events long, views long, carts long, past_purchases long, "
                                     "has_past_purchase int, purchase_probability double")
    d = va.clv_decile(va.clv_score(df)).orderBy("user_id").collect()
    assert [r.clv_score_norm for r in d] == [0.0, 0.0, 0.0]
    assert [r.clv_decile for r in d] == ["D1", "D5", "D10"]


def test_event_at_cutoff_is_feature_side(make_events):
    ev = make_events([(1, "2024-01-01T10:00:00", "view"), (1, "2024-01-02T10:00:00", "purchase")])
    from tests.conftest import ts
    cut = ts("2024-01-02T10:00:00")
    f = fe.past_features(ev, cut).first()
    assert f.total_events == 2 and f.past_purchases == 1
    assert fe.future_labels(ev, cut).count() == 0


def test_stratified_split_reproducible(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("user_id"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    a = fe.stratified_split(df).where("is_test = 1").select("user_id").collect()
    b = fe.stratified_split(df.repartition(13)).where("is_test = 1").select("user_id").collect()
    assert sorted(a) == sorted(b)
    t = fe.stratified_split(df).groupBy("label").agg(F.sum("is_test").alias("t"), F.count("*").alias("n"))
    assert {r.label: (r.t, r.n) for r in t.collect()} == {0: (160, 800), 1: (40, 200)}
