"""Feature / label queries N66-N72 and their oracle SQL."""

from clickspark.operators import features as fe
from clickspark.plans.oracle import with_ev
from clickspark.plans.registry import cutoff, ev_orders, query

CUT = "cut AS (SELECT quantile_cont(event_time, 0.8) AS c FROM ev)"
PF = """pf AS (
  SELECT user_id, COUNT(*) AS total_events,
    COUNT(*) FILTER (WHERE event_type = 'view') AS views,
    COUNT(*) FILTER (WHERE event_type = 'cart') AS carts,
    COUNT(*) FILTER (WHERE event_type = 'purchase') AS past_purchases,
    COUNT(DISTINCT product_id) AS unique_products,
    CAST(epoch_us(MAX(event_time)) - epoch_us(MIN(event_time)) AS DOUBLE) / 1000000.0 AS active_span_sec
  FROM ev WHERE event_time <= (SELECT c FROM cut) GROUP BY user_id)"""
FL = """fl AS (
  SELECT user_id, CASE WHEN COUNT(*) FILTER (WHERE event_type = 'purchase') > 0 THEN 1 ELSE 0 END AS label
  FROM ev WHERE event_time > (SELECT c FROM cut) GROUP BY user_id)"""
ML = """ml AS (
  SELECT pf.user_id, total_events, views, carts, past_purchases, unique_products,
    COALESCE(fl.label, 0) AS label, active_span_sec,
    total_events / (active_span_sec / 86400.0 + 1.0) AS events_per_day,
    carts / (views + 1.0) AS cart_to_view_ratio,
    unique_products / (views + 1.0) AS product_diversity,
    CASE WHEN past_purchases > 0 THEN 1 ELSE 0 END AS has_past_purchase,
    past_purchases / (total_events + 1.0) AS purchase_rate
  FROM pf LEFT JOIN fl ON pf.user_id = fl.user_id)"""
ML_CTES = (CUT, PF, FL, ML)


def ml(spark, d):
    return fe.ml_dataset(ev_orders(spark, d), cutoff(spark, d))


@query("time_cutoff", with_ev("SELECT c AS cutoff_time FROM cut", CUT))
def _tc(spark, d):
    return fe.time_cutoff(ev_orders(spark, d))


@query("past_features", with_ev("SELECT * FROM pf", CUT, PF))
def _pf(spark, d):
    return fe.past_features(ev_orders(spark, d), cutoff(spark, d))


@query("future_labels", with_ev("SELECT * FROM fl", CUT, FL))
def _fl(spark, d):
    return fe.future_labels(ev_orders(spark, d), cutoff(spark, d))


@query("ml_dataset", with_ev("SELECT * FROM ml", *ML_CTES))
def _ml(spark, d):
    return ml(spark, d)


@query("label_balance", with_ev('SELECT label, COUNT(*) AS "count" FROM ml GROUP BY label', *ML_CTES))
def _lb(spark, d):
    return fe.label_balance(ml(spark, d))


ML_COLS = ["user_id", "total_events", "views", "carts", "past_purchases", "unique_products", "label",
           "active_span_sec", "events_per_day", "cart_to_view_ratio", "product_diversity",
           "has_past_purchase", "purchase_rate"]


def _describe_sql() -> str:
    from clickspark.plans.oracle import rnp
    from clickspark.plans.q_sequence import np_quantile_sql

    def stat_row(name, expr):
        return f"SELECT '{name}' AS statistic, " + ", ".join(
            f"{rnp(expr.format(c=f'CAST({c} AS DOUBLE)'), 3)} AS {c}" for c in ML_COLS) + " FROM ml"

    def q_row(name, p):
        return f"SELECT '{name}' AS statistic, " + ", ".join(
            f"{rnp(np_quantile_sql('ml', c, p, 'x')[:-len(' AS x')], 3)} AS {c}" for c in ML_COLS)
    parts = [stat_row("count", "CAST(COUNT({c}) AS DOUBLE)"), stat_row("mean", "AVG({c})"),
             stat_row("std", "STDDEV_SAMP({c})"), stat_row("min", "MIN({c})"),
             q_row("25%", 0.25), q_row("50%", 0.5), q_row("75%", 0.75), stat_row("max", "MAX({c})")]
    return with_ev("\nUNION ALL\n".join(parts), *ML_CTES)


@query("feature_summary", _describe_sql())
def _fs(spark, d):
    return fe.feature_summary(ml(spark, d), ML_COLS)


def split_cte(src: str = "ml", label: str = "label", name: str = "sp", seed: int = 42) -> str:
    """``src`` with is_test: the first fifth of each label by the digest."""
    return f"""{name} AS (SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY {label} ORDER BY md5('{seed}:' || user_id), user_id)
    <= ceil(COUNT(*) OVER (PARTITION BY {label}) * CAST(0.2 AS DOUBLE)) THEN 1 ELSE 0 END AS is_test FROM {src})"""


@query("stratified_split", with_ev("SELECT user_id, label, is_test FROM sp", *ML_CTES, split_cte()))
def _ss(spark, d):
    return fe.stratified_split(ml(spark, d)).select("user_id", "label", "is_test")


@query("stratified_folds", with_ev("""SELECT user_id, label, CAST((ROW_NUMBER() OVER (PARTITION BY label
    ORDER BY md5('43:' || user_id), user_id) - 1) % 3 AS INTEGER) AS fold FROM ml""", *ML_CTES))
def _sf(spark, d):
    return fe.stratified_folds(ml(spark, d)).select("user_id", "label", "fold")
