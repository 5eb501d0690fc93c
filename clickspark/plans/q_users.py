"""User, RFM and behaviour queries N52-N64 and their oracle SQL."""

from clickspark.operators import users as us
from clickspark.plans.oracle import rnp, rsql, with_ev, xavg, xsum
from clickspark.plans.q_sequence import np_quantile_sql
from clickspark.plans.registry import ev_orders, query

PAID = "CASE WHEN event_type = 'purchase' THEN price END"
UT = f"""ut AS (
  SELECT user_id, MIN(event_time) AS first_event, MAX(event_time) AS last_event,
    COUNT(DISTINCT CAST(event_time AS DATE)) AS total_sessions, COUNT(*) AS total_events,
    COUNT(*) FILTER (WHERE event_type = 'view') AS total_views,
    COUNT(*) FILTER (WHERE event_type = 'cart') AS total_carts,
    COUNT(*) FILTER (WHERE event_type = 'purchase') AS total_purchases,
    COALESCE({xsum(PAID)}, 0.0) AS total_revenue,
    {rsql(xavg(PAID))} AS avg_order_value,
    COUNT(DISTINCT CAST(event_time AS DATE)) AS days_active,
    COUNT(DISTINCT product_id) AS unique_products_viewed
  FROM ev WHERE user_id IS NOT NULL GROUP BY user_id)"""

RFM = """rfm AS (
  SELECT *, CAST(floor(CAST(epoch_us((SELECT MAX(last_event) FROM ut)) - epoch_us(last_event) AS DOUBLE)
                       / 86400000000.0) AS BIGINT) AS Recency,
    total_purchases AS Frequency, total_revenue AS Monetary
  FROM ut WHERE total_purchases > 0)"""


def qb(order: str, q: int = 5) -> str:
    rn = f"ROW_NUMBER() OVER (ORDER BY {order})"
    return (f"CAST(CASE WHEN COUNT(*) OVER () <= 1 THEN 1 ELSE GREATEST(1, (({rn} - 1) * {q} + "
            f"(COUNT(*) OVER () - 1) - 1) // (COUNT(*) OVER () - 1)) END AS INTEGER)")


SC = f"""sc AS (
  SELECT *, CAST(R_Score AS VARCHAR) || CAST(F_Score AS VARCHAR) || CAST(M_Score AS VARCHAR) AS RFM_Score
  FROM (SELECT *, CAST(6 - {qb('Recency, user_id')} AS INTEGER) AS R_Score,
          {qb('Frequency, user_id')} AS F_Score, {qb('Monetary, user_id')} AS M_Score FROM rfm) s)"""

SEG = """seg AS (
  SELECT *, CASE
    WHEN R_Score >= 4 AND F_Score >= 4 AND M_Score >= 4 THEN 'Champions'
    WHEN R_Score >= 3 AND F_Score >= 4 AND M_Score >= 3 THEN 'Loyal Customers'
    WHEN R_Score >= 4 AND F_Score >= 2 AND M_Score >= 2 THEN 'Potential Loyalists'
    WHEN R_Score >= 4 AND F_Score <= 2 THEN 'New Customers'
    WHEN R_Score <= 2 AND F_Score >= 4 AND M_Score >= 3 THEN 'Can''t Lose Them'
    WHEN R_Score <= 2 AND F_Score >= 3 THEN 'At Risk'
    WHEN R_Score <= 2 AND F_Score <= 2 THEN 'Hibernating'
    WHEN M_Score <= 2 THEN 'Price Sensitive'
    ELSE 'Others' END AS Segment
  FROM sc)"""

PU = f"""pu AS (
  SELECT *, CASE WHEN total_events > {np_quantile_sql('ut', 'total_events', 0.9, 'p')[:-len(' AS p')]} THEN 1 ELSE 0 END AS is_power_user
  FROM ut)"""

BS = """bs AS (
  SELECT *, CASE WHEN total_purchases > 0 THEN 'Buyers' WHEN total_carts > 0 THEN 'Cart Abandoners'
    WHEN total_views > 50 THEN 'Window Shoppers' WHEN total_events <= 5 THEN 'Casual Browsers'
    ELSE 'Active Browsers' END AS Behavioral_Segment
  FROM pu)"""


def usr(spark, d):
    """The user table, materialised: the RFM and behaviour queries read it
    for a scalar (latest event, p90) and for the main work."""
    from clickspark.operators.ranking import stage_table
    return stage_table(us.user_table(ev_orders(spark, d)))


def seg(spark, d):
    return us.rfm_segment(us.rfm_scores(us.rfm_values(usr(spark, d))))


@query("user_table", with_ev("SELECT * FROM ut", UT))
def _ut(spark, d):
    return us.user_table(ev_orders(spark, d))


@query("user_level_features", with_ev("""SELECT user_id, COUNT(*) AS total_events,
  COUNT(*) FILTER (WHERE event_type = 'view') AS views, COUNT(*) FILTER (WHERE event_type = 'cart') AS carts,
  COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchases, COUNT(DISTINCT product_id) AS unique_products,
  CAST(epoch_us(MAX(event_time)) - epoch_us(MIN(event_time)) AS DOUBLE) / 1000000.0 AS active_span_sec
FROM ev GROUP BY user_id"""))
def _ulf(spark, d):
    return us.user_level_features(ev_orders(spark, d))


@query("rfm_values", with_ev("SELECT * FROM rfm", UT, RFM))
def _rv(spark, d):
    return us.rfm_values(usr(spark, d))


@query("rfm_scores", with_ev("SELECT * FROM sc", UT, RFM, SC))
def _rs(spark, d):
    return us.rfm_scores(us.rfm_values(usr(spark, d)))


@query("score_quintile", with_ev("SELECT user_id, R_Score FROM sc", UT, RFM, SC))
def _sq(spark, d):
    r = us.rfm_values(us.user_table(ev_orders(spark, d)))
    return us.score_quintile(r, "Recency", ascending_good=False, out="R_Score").select("user_id", "R_Score")


@query("rfm_segment", with_ev("SELECT * FROM seg", UT, RFM, SC, SEG))
def _rseg(spark, d):
    return seg(spark, d)


def _dist_sql(src: str, col: str) -> str:
    return f"""SELECT {col} AS Segment, COUNT(*) AS User_Count,
  {rnp('CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER () * 100.0')} AS Percentage
FROM {src} GROUP BY {col}"""


@query("rfm_segment_distribution", with_ev(_dist_sql("seg", "Segment"), UT, RFM, SC, SEG))
def _rsd(spark, d):
    return us.rfm_segment_distribution(seg(spark, d))


@query("rfm_segment_characteristics", with_ev(f"""SELECT Segment, COUNT(*) AS User_Count,
  {rnp('CAST(SUM(Recency) AS DOUBLE) / COUNT(*)')} AS Avg_Recency_Days,
  {rnp('CAST(SUM(Frequency) AS DOUBLE) / COUNT(*)')} AS Avg_Frequency,
  {rnp(xsum('Monetary') + ' / COUNT(*)')} AS Avg_Monetary,
  {rnp(xsum('Monetary'))} AS Total_Revenue,
  {rnp('CAST(SUM(total_sessions) AS DOUBLE) / COUNT(*)')} AS Avg_Sessions,
  {rnp('CAST(SUM(days_active) AS DOUBLE) / COUNT(*)')} AS Avg_Days_Active
FROM seg GROUP BY Segment""", UT, RFM, SC, SEG))
def _rsc(spark, d):
    return us.rfm_segment_characteristics(seg(spark, d))


@query("clv_insights", with_ev(f"""SELECT
  (SELECT COUNT(*) FROM rfm) AS total_purchasing_users,
  (SELECT {xsum('Monetary')} FROM rfm) AS total_revenue,
  (SELECT {xsum('Monetary')} / COUNT(*) FROM rfm) AS avg_customer_value,
  {np_quantile_sql('rfm', 'Monetary', 0.5, 'median_customer_value')},
  (SELECT top FROM t10) AS top_10_percent_revenue,
  (SELECT top FROM t10) / (SELECT {xsum('Monetary')} FROM rfm) * 100 AS top_10_percent_share,
  (SELECT CAST(SUM(Frequency) AS DOUBLE) / COUNT(*) FROM rfm) AS avg_purchases_per_user,
  (SELECT CAST(SUM(days_active) AS DOUBLE) / COUNT(*) FROM rfm) AS avg_days_active""", UT, RFM,
    f"""t10 AS (SELECT {xsum('Monetary')} AS top
  FROM (SELECT Monetary, ROW_NUMBER() OVER (ORDER BY Monetary DESC, user_id) AS rn,
               GREATEST(1, CAST(floor(CAST(COUNT(*) OVER () AS DOUBLE) * CAST(0.1 AS DOUBLE)) AS BIGINT)) AS k
        FROM rfm) r WHERE rn <= k)"""))
def _clvi(spark, d):
    return us.clv_insights(us.rfm_values(usr(spark, d)))


@query("power_users", with_ev("SELECT user_id, total_events, is_power_user FROM pu", UT, PU))
def _pu(spark, d):
    return us.power_users(usr(spark, d), materialize=False).select("user_id", "total_events", "is_power_user")


def bseg(spark, d):
    return us.behavioral_segment(us.power_users(usr(spark, d), materialize=False))


@query("behavioral_segment", with_ev("SELECT user_id, is_power_user, Behavioral_Segment FROM bs", UT, PU, BS))
def _bs(spark, d):
    return bseg(spark, d).select("user_id", "is_power_user", "Behavioral_Segment")


@query("behavioral_distribution", with_ev(_dist_sql("bs", "Behavioral_Segment"), UT, PU, BS))
def _bd(spark, d):
    return us.behavioral_distribution(bseg(spark, d))


@query("power_user_summary", with_ev("""SELECT Behavioral_Segment, CAST(SUM(is_power_user) AS BIGINT) AS Power_User_Count
FROM bs GROUP BY Behavioral_Segment""", UT, PU, BS))
def _pus(spark, d):
    return us.power_user_summary(bseg(spark, d))


@query("rfm_report")
def _rr(spark, d):
    from clickspark.plans.reports import rfm_report
    return rfm_report(us.user_table(ev_orders(spark, d)))


def _rfm_outputs_sql():
    from clickspark.plans.jobs import RFM_OUTPUTS
    from clickspark.plans.q_sessions import _manifest_sql
    return _manifest_sql(RFM_OUTPUTS)


@query("rfm_report_counts", with_ev("""SELECT 'rfm_user_segmentation_synced' AS analysis_type, 'events' AS data_source,
  COUNT(*) AS total_users, COUNT(*) FILTER (WHERE total_purchases > 0) AS purchasing_users,
  COUNT(*) FILTER (WHERE total_purchases = 0) AS non_purchasing_users FROM ut""", UT))
def _rrc(spark, d):
    from clickspark.plans.reports import rfm_report
    return rfm_report(us.user_table(ev_orders(spark, d))).select(
        "analysis_type", "data_source", "total_users", "purchasing_users", "non_purchasing_users")


@query("rfm_analysis_outputs", _rfm_outputs_sql())
def _rao(spark, d):
    """The RFM job's files, written under the checkpoint folder, and their
    manifest."""
    from clickspark.plans.jobs import rfm_analysis_job
    from clickspark.staging import new_path
    out = new_path(spark, "clickspark_outputs")
    return rfm_analysis_job(ev_orders(spark, d), out)
