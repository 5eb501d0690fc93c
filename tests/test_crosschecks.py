"""Cross-checks against pandas and funnel / session invariants (SURVEY
§5.2 items 3 and 4)."""

import numpy as np
import pandas as pd

from clickspark.fixtures import clean_fixture
from clickspark.operators import funnel as fn
from clickspark.operators import models as mo
from clickspark.operators import sequence as sq
from clickspark.operators import sessions as ss

SF = "/root/testdata/sf0.001"


def test_time_buckets_match_pd_cut(spark):
    rs = np.random.RandomState(2)
    hours = np.concatenate([rs.exponential(20, 400), [0.0, 1.0, 4.0, 12.0, 24.0, 72.0, 72.0001]])
    df = spark.createDataFrame([(float(h * 3600),) for h in hours], "time_to_purchase_sec double")
    got = {r.bucket: r["count"] for r in sq.time_to_purchase_buckets(df).collect()}
    exp = pd.cut(pd.Series(hours), bins=[0, 1, 4, 12, 24, 72, float("inf")],
                 labels=["<1h", "1-4h", "4-12h", "12-24h", "1-3d", "3d+"]).value_counts()
    assert got == {str(k): int(v) for k, v in exp.items()}


def test_probability_buckets_match_pd_cut(spark):
    p = np.concatenate([np.random.RandomState(4).uniform(0, 1, 300), [0.0, 0.2, 0.4, 1.0]])
    df = spark.createDataFrame([(float(x),) for x in p], "purchase_probability double")
    got = {r.bucket: r["count"] for r in mo.probability_buckets(df).collect()}
    exp = pd.cut(pd.Series(p), bins=[0, .2, .4, .6, .8, 1.0],
                 labels=["0-20%", "20-40%", "40-60%", "60-80%", "80-100%"]).value_counts()
    assert got == {str(k): int(v) for k, v in exp.items()}


def test_funnel_and_session_invariants(spark):
    ev = clean_fixture(spark, SF)
    d, r = fn.funnel_dedup(ev).first(), fn.funnel_raw(ev).first()
    assert d.views_unique <= r.views_unique and d.carts_unique <= r.carts_unique
    assert d.purchases_unique <= r.purchases_unique
    ses = ss.session_table(ev)
    n = ses.count()
    for f in (ss.session_duration_distribution, ss.products_per_session, ss.session_engagement,
              ss.session_cart_abandonment, ss.hourly_session_patterns):
        col = "total_sessions" if f is ss.hourly_session_patterns else "session_count"
        assert sum(x[col] for x in f(ses).collect()) == n, f.__name__
    tp = sq.transition_probs(ev).toPandas()
    assert (tp.groupby("from_event").prob.sum().round(3) == 1.0).all()


def test_dataset_stats_approx_close_to_exact(spark):
    from clickspark.fixtures import raw_fixture
    from clickspark.operators import profile as pr
    raw = raw_fixture(spark, SF)
    ex, ap = pr.dataset_stats(raw).first(), pr.dataset_stats(raw, approx=True).first()
    assert ex.total_rows == ap.total_rows
    for c in ("unique_users", "unique_products", "unique_sessions"):
        assert abs(ap[c] - ex[c]) <= max(2, 0.05 * ex[c]), c
