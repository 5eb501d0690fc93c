from pyspark.sql import functions as F

from clickspark.operators import users as us


def test_rfm_rules(spark):
    df = spark.createDataFrame([(5, 2, 2), (3, 3, 3), (5, 5, 5), (1, 1, 5), (3, 5, 2)], "r int, f int, m int")
    got = [r[0] for r in df.select(us.rfm_segment_expr(F.col("r"), F.col("f"), F.col("m"))).collect()]
    assert got == ["Potential Loyalists", "Others", "Champions", "Hibernating", "Price Sensitive"]


def test_behaviour_edges(make_events):
    rows = []
    for u, n in ((1, 50), (2, 51)):
        rows += [(u, f"2024-01-01T{i // 60:02d}:{i % 60:02d}:00", "view") for i in range(n)]
    rows += [(3, f"2024-01-01T10:0{i}:00", "view") for i in range(5)]
    rows += [(4, f"2024-01-01T10:0{i}:00", "view") for i in range(6)]
    seg = us.behavioral_segment(us.user_table(make_events(rows)))
    got = {r.user_id: r.Behavioral_Segment for r in seg.collect()}
    assert got == {1: "Active Browsers", 2: "Window Shoppers", 3: "Casual Browsers", 4: "Active Browsers"}


def test_recency_floor_uses_all_users(make_events):
    ev = make_events([(1, "2024-01-01T23:00:00", "purchase"), (2, "2024-01-03T22:00:00", "view")])
    r = us.rfm_values(us.user_table(ev)).collect()
    assert [(x.user_id, x.Recency) for x in r] == [(1, 1)]


def test_single_purchaser_quintile(make_events):
    ev = make_events([(1, "2024-01-01T10:00:00", "purchase")])
    s = us.rfm_scores(us.rfm_values(us.user_table(ev))).first()
    assert (s.R_Score, s.F_Score, s.M_Score, s.RFM_Score) == (5, 1, 1, "511")


def test_segments_partition_users(make_events):
    import random
    rnd = random.Random(0)
    rows = [(rnd.randint(1, 30), f"2024-01-0{rnd.randint(1, 9)}T10:00:00", rnd.choice(["view", "cart", "purchase"]),
             rnd.randint(1, 5), float(rnd.randint(1, 99))) for _ in range(400)]
    usr = us.user_table(make_events(rows))
    dist = us.behavioral_distribution(us.behavioral_segment(usr)).toPandas()
    assert dist.User_Count.sum() == usr.count()
    seg = us.rfm_segment(us.rfm_scores(us.rfm_values(usr))).toPandas()
    assert seg.groupby("R_Score").size().max() - seg.groupby("R_Score").size().min() <= 1


def test_user_table_counts_distinct_values_apart(spark, make_events):
    ev = make_events([(1, "2024-01-01T10:00:00", "view", 7), (1, "2024-01-01T11:00:00", "purchase", 7, 5.0),
                      (1, "2024-01-02T10:00:00", "cart", 8), (2, "2024-01-01T10:00:00", "view", None),
                      (None, "2024-01-01T10:00:00", "view", 9)])
    unseen = ev.where("user_id = 2").withColumn("user_id", F.lit(3).cast("long")).withColumn("event_time", F.lit(None).cast("timestamp"))
    got = us.user_table(ev.unionByName(unseen))
    assert {r.user_id: (r.total_sessions, r.days_active, r.total_events, r.unique_products_viewed, r.total_revenue)
            for r in got.collect()} == {1: (2, 2, 3, 2, 5.0), 2: (1, 1, 1, 0, 0.0), 3: (0, 0, 1, 0, 0.0)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan  # three rows per event, each with every sum's buffer
