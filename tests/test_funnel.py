from clickspark.operators import funnel as fn


def test_repeat_views_dedup_vs_raw(make_events):
    ev = make_events([(1, "2024-01-01T10:00:00", "view", 9), (1, "2024-01-01T10:01:00", "view", 9),
                      (1, "2024-01-01T10:02:00", "view", 9), (1, "2024-01-01T10:03:00", "cart", 9)])
    d = fn.funnel_dedup(ev).first()
    r = fn.funnel_raw(ev).first()
    assert (d.views_unique, d.carts_unique) == (1, 1)
    assert (r.views_unique, r.carts_unique) == (3, 1)


def test_pair_abandonment_can_be_negative(make_events):
    ev = make_events([(1, "2024-01-01T10:00:00", "view", 1), (1, "2024-01-01T10:01:00", "purchase", 1)])
    r = fn.pair_cart_abandonment(ev).first()
    assert r.total_carts == 0 and r.abandonment_rate is None
    ev2 = make_events([(1, "2024-01-01T10:00:00", "view", 1), (1, "2024-01-01T10:01:00", "purchase", 1),
                       (1, "2024-01-01T10:02:00", "cart", 2), (1, "2024-01-01T10:03:00", "purchase", 2)])
    assert fn.pair_cart_abandonment(ev2).first().abandonment_rate == -1.0
    assert fn.pair_cart_abandonment(ev2, strict=True).first().abandonment_rate == 0.0


def test_zero_view_dimension(make_events):
    ev = make_events([(1, "2024-01-01T10:00:00", "cart", 1, 10.0, "X"),
                      (2, "2024-01-01T10:00:00", "view", 2, 10.0, "Y")])
    b = {r.brand: r for r in fn.brand_funnel(ev).collect()}
    assert b["X"].view_to_cart is None and b["X"].drop_view_cart is None
    assert b["Y"].view_to_cart == 0.0
    only_cart = make_events([(1, "2024-01-01T10:00:00", "cart", 1)])
    dd = fn.funnel_dropoff(fn.funnel_dedup(only_cart)).first()
    assert dd.dropoff_view_to_cart_pct == 100.0


def test_extra_event_types_are_no_stage(make_events):
    ev = make_events([(1, "2024-01-01T10:00:00", "signup"), (1, "2024-01-01T10:01:00", "view"),
                      (1, "2024-01-01T10:02:00", "error")])
    r = fn.funnel_raw(ev).first()
    assert (r.views_unique, r.carts_unique, r.purchases_unique) == (1, 0, 0)
    c = {x.event_type: x["count"] for x in fn.funnel_event_counts(ev).collect()}
    assert c == {"view": 1, "signup": 1, "error": 1}


def test_histogram_numpy_rules(spark):
    import numpy as np
    vals = [0, 3, 3, 7, 10, 20, 55, 100, 100]
    df = spark.createDataFrame([(v,) for v in vals], "views_raw long")
    got = [r["count"] for r in fn.category_traffic_histogram(df).collect()]
    assert got == np.histogram(vals, bins=20)[0].tolist()
    same = spark.createDataFrame([(5,), (5,)], "views_raw long")
    assert [r["count"] for r in fn.category_traffic_histogram(same).collect()] == np.histogram([5, 5], bins=20)[0].tolist()
