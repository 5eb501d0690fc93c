"""Degenerate inputs: empty tables, no purchasers, no carts."""

from clickspark.operators import features as fe
from clickspark.operators import funnel as fn
from clickspark.operators import sequence as sq
from clickspark.operators import sessions as ss
from clickspark.operators import users as us
from clickspark.operators import value as va


def test_empty_events(make_events):
    ev = make_events([(1, "2024-01-01T10:00:00", "view")]).limit(0)
    assert fn.funnel_raw(ev).first().views_unique == 0
    assert fn.funnel_dedup(ev).first().view_to_cart is None
    assert ss.session_summary(ss.session_table(ev)).first().total_sessions == 0
    assert sq.transition_probs(ev).count() == 0
    assert sq.time_to_purchase_buckets(sq.time_to_purchase_clean(sq.time_to_purchase(ev))).count() == 6
    assert us.rfm_scores(us.rfm_values(us.user_table(ev))).count() == 0
    assert fe.time_cutoff(ev).first().cutoff_time is None


def test_no_purchases_or_carts(make_events):
    ev = make_events([(u, f"2024-01-0{d}T10:00:00", "view", p) for u in (1, 2, 3) for d in (1, 2) for p in (1, 2)])
    assert us.rfm_values(us.user_table(ev)).count() == 0
    seg = us.behavioral_distribution(us.behavioral_segment(us.power_users(us.user_table(ev)))).collect()
    assert {r.Segment for r in seg} == {"Casual Browsers"}  # 4 events each, no cart
    assert fn.pair_cart_abandonment(ev).first().abandonment_rate is None
    ml = fe.ml_dataset(ev)
    d = va.clv_decile(va.clv_score(va.engagement_probability(ml))).collect()
    assert len(d) == 3 and all(r.clv_score_norm == 0.0 for r in d)
    st = sq.time_to_purchase_stats(sq.time_to_purchase_clean(sq.time_to_purchase(ev))).first()
    assert st["count"] == 0 and st.median_hours is None
