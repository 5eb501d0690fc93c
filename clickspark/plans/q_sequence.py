"""Sequence and time-to-purchase queries N44-N51 and their oracle SQL."""

from clickspark.operators import sequence as sq
from clickspark.plans.oracle import rsql, with_ev
from clickspark.plans.registry import ev_events, ev_orders, query


def moves(within: str = "user_id") -> tuple[str, str]:
    """CTEs: ``nexts``, every event with the type of the one after it in the
    same stretch, and ``tp``, their counts and shares."""
    order = f"(PARTITION BY {within} ORDER BY event_time, event_type, product_id, price)"
    share = rsql('CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY from_event)', 4)
    return (f"""nexts AS (SELECT event_type AS from_event, LEAD(event_type) OVER {order} AS to_event, LEAD(1) OVER {order} AS more
  FROM ev WHERE user_id IS NOT NULL)""",
            f"""tp AS (SELECT from_event, to_event, n AS "count", {share} AS prob
  FROM (SELECT from_event, to_event, COUNT(*) AS n FROM nexts WHERE more = 1 GROUP BY from_event, to_event) m)""")


@query("dataset_totals", with_ev("SELECT COUNT(*) AS total_events, COUNT(DISTINCT user_id) AS unique_users FROM ev"))
def _dt(spark, d):
    return sq.dataset_totals(ev_orders(spark, d))


@query("transition_probs", with_ev("SELECT * FROM tp", *moves()))
def _tp(spark, d):
    return sq.transition_probs(ev_orders(spark, d))


@query("transition_probs_eventsfix", with_ev("SELECT * FROM tp", *moves(), fixture="events"))
def _tp_e(spark, d):
    return sq.transition_probs(ev_events(spark, d))


@query("transition_probs_by_session", with_ev("SELECT * FROM tp", *moves("user_id, CAST(event_time AS DATE)")))
def _tps(spark, d):
    return sq.transition_probs(ev_orders(spark, d), by=("user_id", "session_date"))


@query("transition_matrix", with_ev("""SELECT from_event,
  COALESCE(MAX(CASE WHEN to_event = 'cart' THEN prob END), 0.0) AS cart,
  COALESCE(MAX(CASE WHEN to_event = 'purchase' THEN prob END), 0.0) AS purchase,
  COALESCE(MAX(CASE WHEN to_event = 'view' THEN prob END), 0.0) AS "view"
FROM tp GROUP BY from_event""", *moves()))
def _tm(spark, d):
    return sq.transition_matrix(sq.transition_probs(ev_orders(spark, d)), ["cart", "purchase", "view"])


@query("top_transitions", with_ev(
    'SELECT * FROM tp ORDER BY prob DESC, from_event, to_event LIMIT 10', *moves()))
def _tt(spark, d):
    return sq.top_transitions(sq.transition_probs(ev_orders(spark, d)))


TTP = """ttp AS (
  SELECT user_id, first_view, purchase_time, converted,
    CAST(epoch_us(purchase_time) - epoch_us(first_view) AS DOUBLE) / 1000000.0 AS time_to_purchase_sec
  FROM (SELECT user_id,
          MIN(event_time) FILTER (WHERE event_type = 'view') AS first_view,
          MIN(event_time) FILTER (WHERE event_type = 'purchase') AS purchase_time,
          CASE WHEN COUNT(*) FILTER (WHERE event_type = 'purchase') > 0 THEN 1 ELSE 0 END AS converted
        FROM ev GROUP BY user_id) t)"""
TTPC = "ttpc AS (SELECT * FROM ttp WHERE converted = 1 AND time_to_purchase_sec >= 0)"


@query("time_to_purchase", with_ev("SELECT * FROM ttp", TTP))
def _ttp(spark, d):
    return sq.time_to_purchase(ev_orders(spark, d))


@query("time_to_purchase_clean", with_ev("SELECT * FROM ttpc", TTP, TTPC))
def _ttpc(spark, d):
    return sq.time_to_purchase_clean(sq.time_to_purchase(ev_orders(spark, d)))


def np_quantile_sql(src: str, col: str, p: float, alias: str) -> str:
    """numpy linear quantile of ``col`` over ``src`` written with ranks."""
    return f"""(SELECT CASE WHEN t >= 0.5 THEN hi - (hi - lo) * (1.0 - t) ELSE lo + (hi - lo) * t END
  FROM (SELECT MAX(CASE WHEN rn - 1 = floor(pos) THEN v END) AS lo,
               MAX(CASE WHEN rn - 1 = ceil(pos) THEN v END) AS hi,
               MAX(pos - floor(pos)) AS t
        FROM (SELECT {col} AS v, ROW_NUMBER() OVER (ORDER BY {col}) AS rn,
                     CAST({p} AS DOUBLE) * (COUNT(*) OVER () - 1) AS pos FROM {src} WHERE {col} IS NOT NULL) r) x) AS {alias}"""


@query("time_to_purchase_stats", with_ev(f"""SELECT
  (SELECT COUNT(*) FROM ttpc) AS "count",
  (SELECT CAST(SUM(epoch_us(purchase_time) - epoch_us(first_view)) AS DOUBLE) / COUNT(*) / 3600000000.0 FROM ttpc) AS mean_hours,
  {np_quantile_sql('ttph', 'h', 0.5, 'median_hours')},
  {np_quantile_sql('ttph', 'h', 0.25, 'p25_hours')},
  {np_quantile_sql('ttph', 'h', 0.75, 'p75_hours')},
  {np_quantile_sql('ttph', 'h', 0.95, 'p95_hours')}""", TTP, TTPC,
    "ttph AS (SELECT time_to_purchase_sec / 3600.0 AS h FROM ttpc)"))
def _ttps(spark, d):
    return sq.time_to_purchase_stats(sq.time_to_purchase_clean(sq.time_to_purchase(ev_orders(spark, d))))


@query("time_to_purchase_buckets", with_ev("""SELECT b.bucket, COALESCE(c.cnt, 0) AS "count"
FROM (VALUES (1, '<1h'), (2, '1-4h'), (3, '4-12h'), (4, '12-24h'), (5, '1-3d'), (6, '3d+')) b(o, bucket)
LEFT JOIN (SELECT CASE WHEN h > 0 AND h <= 1 THEN 1 WHEN h > 1 AND h <= 4 THEN 2 WHEN h > 4 AND h <= 12 THEN 3
                       WHEN h > 12 AND h <= 24 THEN 4 WHEN h > 24 AND h <= 72 THEN 5 WHEN h > 72 THEN 6 END AS o,
                  COUNT(*) AS cnt
           FROM (SELECT time_to_purchase_sec / 3600.0 AS h FROM ttpc) x GROUP BY 1) c ON c.o = b.o""", TTP, TTPC))
def _ttpb(spark, d):
    return sq.time_to_purchase_buckets(sq.time_to_purchase_clean(sq.time_to_purchase(ev_orders(spark, d))))
