from clickspark.operators import sequence as sq
from clickspark.operators import sessions as ss


def test_duration_bucket_edges(make_events):
    # session durations 0.99, 1, 5, 15, 30, 60 minutes (one user per day)
    rows = []
    for i, mins in enumerate([0.99, 1, 5, 15, 30, 60]):
        day = f"2024-01-0{i + 1}"
        end = f"{day}T10:{int(mins):02d}:{int(round((mins % 1) * 60)):02d}" if mins < 60 else f"{day}T11:00:00"
        rows += [(1, f"{day}T10:00:00", "view"), (1, end, "view")]
    ses = ss.session_table(make_events(rows))
    got = {r.duration_bucket: r.session_count for r in ss.session_duration_distribution(ses).collect()}
    assert got == {"< 1 min": 1, "1-5 min": 1, "5-15 min": 1, "15-30 min": 1, "30-60 min": 1, "60+ min": 1}


def test_midnight_split_two_sessions_one_transition(make_events):
    ev = make_events([(1, "2024-01-01T23:59:00", "view"), (1, "2024-01-02T00:01:00", "cart")])
    assert ss.session_table(ev).count() == 2
    t = sq.transition_counts(ev).collect()
    assert [(r.from_event, r.to_event, r["count"]) for r in t] == [("view", "cart", 1)]
    assert sq.transition_counts(ev, by=("user_id", "session_date")).count() == 0


def test_session_table_columns(make_events):
    ev = make_events([(7, "2024-01-06T10:00:00", "view", 1, 10.0), (7, "2024-01-06T10:30:00", "purchase", 2, 20.005)])
    r = ss.session_table(ev).first()
    assert r.session_id == "7_2024-01-06"
    assert r.session_duration_minutes == 30.0
    assert (r.total_events, r.unique_products_viewed, r.purchase_count, r.has_purchase) == (2, 2, 1, 1)
    assert r.total_revenue == 20.005 and r.is_weekend_session == 1 and r.session_start_hour == 10


def test_session_report_keeps_section_order(make_events):
    from clickspark.plans.reports import session_report
    rows = []
    for i, mins in enumerate([0.5, 3, 70, 20, 10, 45]):
        day = f"2024-01-0{i + 1}"
        rows += [(i + 1, f"{day}T10:00:00", "view"), (i + 1, f"{day}T10:00:00", "view")]
        rows += [(i + 1, f"{day}T{10 + int(mins) // 60:02d}:{int(mins) % 60:02d}:{int((mins % 1) * 60):02d}", "view")]
    rep = session_report(ss.session_table(make_events(rows))).first()
    labels = [r["duration_bucket"] for r in rep["duration_distribution"]]
    assert labels == ["< 1 min", "1-5 min", "5-15 min", "15-30 min", "30-60 min", "60+ min"]
    assert [r["hour"] for r in rep["hourly_patterns"]] == sorted(r["hour"] for r in rep["hourly_patterns"])
