import random

import pandas as pd
import pytest

from clickspark.operators import sequence as sq


def brute_transitions(rows):
    df = pd.DataFrame(rows, columns=["user_id", "t", "event_type", "product_id", "price"])
    df = df.sort_values(["user_id", "t", "event_type", "product_id", "price"])
    out = {}
    for _, g in df.groupby("user_id"):
        e = g.event_type.tolist()
        for a, b in zip(e, e[1:]):
            out[(a, b)] = out.get((a, b), 0) + 1
    return out


@pytest.mark.parametrize("nparts", [1, 4, 17])
def test_transitions_match_brute_force_with_hot_user(make_events, nparts):
    rnd = random.Random(nparts)
    rows = []
    for i in range(600):
        u = 1 if i % 3 == 0 else rnd.randint(2, 40)   # user 1 holds a third of the events
        rows.append((u, f"2024-01-0{rnd.randint(1, 9)}T{rnd.randint(0, 23):02d}:{rnd.randint(0, 1):02d}:00",
                     rnd.choice(["view", "view", "cart", "purchase"]), rnd.randint(1, 3), 10.0))
    ev = make_events([(u, t, e, p, pr) for u, t, e, p, pr in rows])
    got = {(r.from_event, r.to_event): r["count"] for r in sq.transition_counts(ev, num_partitions=nparts).collect()}
    assert got == brute_transitions(rows)


def test_equal_times_tie_break_is_stable(make_events):
    ev = make_events([(1, "2024-01-01T10:00:00", "view", 2), (1, "2024-01-01T10:00:00", "cart", 1),
                      (1, "2024-01-01T10:05:00", "purchase", 1)])
    for n in (1, 3, 8):
        got = sorted((r.from_event, r.to_event) for r in sq.transition_counts(ev, num_partitions=n).collect())
        assert got == [("cart", "view"), ("view", "purchase")]


def test_probs_sum_to_one(make_events):
    ev = make_events([(1, f"2024-01-01T10:0{i}:00", t) for i, t in enumerate(["view", "cart", "view", "purchase", "view"])])
    tp = sq.transition_probs(ev).toPandas()
    assert (tp.groupby("from_event").prob.sum().round(4) == 1.0).all()


def test_time_to_purchase_edges(make_events):
    ev = make_events([
        (1, "2024-01-01T10:00:00", "view"), (1, "2024-01-01T10:00:00", "purchase"),   # 0 s: no bucket
        (2, "2024-01-01T10:00:00", "view"), (2, "2024-01-01T11:00:00", "purchase"),   # 1 h: <1h
        (3, "2024-01-01T10:00:00", "view"), (3, "2024-01-01T11:00:01", "purchase"),   # 1 h + 1 s: 1-4h
        (4, "2024-01-01T10:00:00", "purchase"), (4, "2024-01-01T11:00:00", "view"),   # negative: dropped
        (5, "2024-01-01T10:00:00", "purchase"),                                       # no view: dropped
    ])
    clean = sq.time_to_purchase_clean(sq.time_to_purchase(ev))
    assert sorted(r.user_id for r in clean.collect()) == [1, 2, 3]
    b = {r.bucket: r["count"] for r in sq.time_to_purchase_buckets(clean).collect()}
    assert b == {"<1h": 1, "1-4h": 1, "4-12h": 0, "12-24h": 0, "1-3d": 0, "3d+": 0}


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_null_event_types_are_counted_alike_at_any_partitioning(make_events, parts):
    from clickspark.operators import sequence as sq
    rows = [(1, f"2024-01-01T00:{m:02d}:00", t) for m, t in enumerate(["view", None, "cart", "view", None, None, "view"])]
    got = {(r.from_event, r.to_event): r["count"]
           for r in sq.transition_counts(make_events(rows, clean=False), num_partitions=parts).collect()}
    assert got == {("view", None): 2, (None, "cart"): 1, ("cart", "view"): 1, (None, None): 1, (None, "view"): 1}
