"""Customer value queries N92-N100 with the data-derived probability
stand-in (``engagement_probability``) so that SQL can check them; the
model-scored variants are in ``q_models``."""

from clickspark.operators import value as va
from clickspark.plans.oracle import rnp, with_ev, xavg, xsum
from clickspark.plans.q_features import ML_CTES, ml
from clickspark.plans.registry import query

SCORED = f"""sc0 AS (
  SELECT *, (past_purchases + carts) / (total_events + 1.0) AS purchase_probability FROM ml),
raw AS (SELECT *, purchase_probability * ln(1 + total_events) * (carts + 1) * (1 + has_past_purchase) AS clv_raw
        FROM sc0),
lg AS (SELECT *, ln(1 + clv_raw) AS clv_log FROM raw),
scored AS (
  SELECT *, {rnp('(clv_log - (SELECT MIN(clv_log) FROM lg)) / ((SELECT MAX(clv_log) FROM lg) - (SELECT MIN(clv_log) FROM lg) + 1e-9) * 100.0')} AS clv_score_norm
  FROM lg),
dec AS (
  SELECT *, 'D' || CAST(b AS VARCHAR) AS clv_decile FROM (
    SELECT *, CAST(CASE WHEN COUNT(*) OVER () <= 1 THEN 1 ELSE GREATEST(1,
      ((ROW_NUMBER() OVER (ORDER BY clv_score_norm, user_id) - 1) * 10 + (COUNT(*) OVER () - 1) - 1)
      // (COUNT(*) OVER () - 1)) END AS INTEGER) AS b FROM scored) x),
seg AS (
  SELECT *, CASE WHEN has_past_purchase <> 0 AND purchase_probability >= 0.6 THEN 'High-value buyer'
    WHEN has_past_purchase <> 0 THEN 'Occasional buyer'
    WHEN carts > 0 AND label = 0 THEN 'Cart abandoner'
    WHEN views > 0 THEN 'Browser' ELSE 'Dormant' END AS segment
  FROM dec)"""

# the ``raw`` CTE name is taken by the fixture; rename ours
SCORED = SCORED.replace("raw AS (SELECT *, purchase", "clvr AS (SELECT *, purchase").replace(
    "FROM raw),", "FROM clvr),")
CTES = (*ML_CTES, SCORED)
AUD = "user_id, segment, views, carts, unique_products, cart_to_view_ratio, purchase_probability, clv_score_norm, clv_decile".split(", ")


def scored(spark, d):
    # materialised: min / max are read before the scaling pass
    from clickspark.operators.ranking import stage_table
    return va.clv_score(stage_table(va.engagement_probability(ml(spark, d))))


def dec(spark, d):
    return va.clv_decile(scored(spark, d))


def seg(spark, d):
    return va.value_segment(dec(spark, d))


@query("clv_scores", with_ev("SELECT user_id, clv_score_norm, clv_decile FROM dec", *CTES))
def _cs(spark, d):
    return va.clv_scores(dec(spark, d))


@query("clv_score_linear", with_ev(f"""SELECT user_id,
  {rnp('(clv_raw - (SELECT MIN(clv_raw) FROM clvr)) / ((SELECT MAX(clv_raw) FROM clvr) - (SELECT MIN(clv_raw) FROM clvr) + 1e-9) * 100.0')} AS clv_score_norm
FROM clvr""", *CTES))
def _csl(spark, d):
    from clickspark.operators.ranking import stage_table
    return va.clv_score(stage_table(va.engagement_probability(ml(spark, d))), log=False).select(
        "user_id", "clv_score_norm")


@query("clv_decile_summary", with_ev(f"""SELECT clv_decile,
  {rnp(xavg('clv_score_norm'))} AS mean,
  MIN(clv_score_norm) AS min, MAX(clv_score_norm) AS max, COUNT(clv_score_norm) AS "count"
FROM dec GROUP BY clv_decile""", *CTES))
def _cds(spark, d):
    return va.clv_decile_summary(dec(spark, d))


@query("value_segment_summary", with_ev(f"""SELECT segment, COUNT(*) AS users,
  {rnp(xsum('clv_score_norm') + ' / COUNT(*)', 3)} AS avg_clv,
  {rnp(xavg('purchase_probability'), 3)} AS avg_purchase_p,
  {rnp('CAST(SUM(carts) AS DOUBLE) / COUNT(*)', 3)} AS avg_carts,
  {rnp('CAST(SUM(views) AS DOUBLE) / COUNT(*)', 3)} AS avg_views
FROM seg GROUP BY segment""", *CTES))
def _vss(spark, d):
    return va.value_segment_summary(seg(spark, d))


@query("value_segment_users", with_ev(
    "SELECT user_id, segment, purchase_probability, clv_score_norm FROM seg", *CTES))
def _vsu(spark, d):
    return va.value_segment_users(seg(spark, d))


@query("target_audience_browsers", with_ev(
    "SELECT user_id, segment, views, carts, unique_products, cart_to_view_ratio, purchase_probability, clv_score_norm, clv_decile FROM seg WHERE segment = 'Browser' AND cart_to_view_ratio > 0.12 AND unique_products > 3",
    *CTES))
def _tab(spark, d):
    return va.target_audience(seg(spark, d), "Browser").select(*AUD)


@query("target_audience_dormant", with_ev(
    "SELECT user_id, segment, views, carts, unique_products, cart_to_view_ratio, purchase_probability, clv_score_norm, clv_decile FROM seg WHERE segment = 'Dormant' AND clv_score_norm > 40", *CTES))
def _tad(spark, d):
    return va.target_audience(seg(spark, d), "Dormant").select(*AUD)


# A stand-in probability spread over [0, 1) by the user's number, and users from
# whom views are taken away and carts cut to one: every label of N98 and every
# targeting rule has rows.
SPREAD = f"""sp AS (SELECT *, CAST((user_id * 37) % 100 AS DOUBLE) / 100.0 AS purchase_probability,
    CAST((user_id * 53) % 100 AS DOUBLE) / 100.0 AS abandon_probability FROM
    (SELECT user_id, total_events, views * CASE WHEN user_id % 9 = 0 THEN 0 ELSE 1 END AS views,
       CASE WHEN user_id % 3 = 0 THEN 0 ELSE LEAST(carts, 1) END AS carts, past_purchases, unique_products, label,
       active_span_sec, events_per_day, cart_to_view_ratio, product_diversity, has_past_purchase, purchase_rate FROM ml) m),
clvr AS (SELECT *, ln(1 + purchase_probability * ln(1 + total_events) * (carts + 1) * (1 + has_past_purchase)) AS clv_log FROM sp),
nrm AS (SELECT *, {rnp('(clv_log - (SELECT MIN(clv_log) FROM clvr)) / ((SELECT MAX(clv_log) FROM clvr) - (SELECT MIN(clv_log) FROM clvr) + 1e-9) * 100.0')} AS clv_score_norm FROM clvr),
five AS (SELECT *, CASE WHEN has_past_purchase <> 0 AND purchase_probability >= 0.6 THEN 'High-value buyer'
    WHEN has_past_purchase <> 0 THEN 'Occasional buyer' WHEN carts > 0 AND label = 0 THEN 'Cart abandoner'
    WHEN views > 0 THEN 'Browser' ELSE 'Dormant' END AS segment FROM nrm)"""


def five(spark, d):
    from pyspark.sql import functions as F
    from clickspark.staging import stage_table
    m = ml(spark, d)
    user = F.col("user_id")
    m = (m.withColumn("views", F.when(user % 9 == 0, 0).otherwise(F.col("views")).cast("long"))
          .withColumn("carts", F.when(user % 3 == 0, 0).otherwise(F.least(F.col("carts"), F.lit(1))).cast("long"))
          .withColumn("purchase_probability", (user * 37 % 100).cast("double") / 100.0)
          .withColumn("abandon_probability", (user * 53 % 100).cast("double") / 100.0))
    return va.value_segment(va.clv_score(stage_table(m)))


@query("value_segments_all_labels", with_ev(f"""SELECT segment, COUNT(*) AS users,
  {rnp(xsum('clv_score_norm') + ' / COUNT(*)', 3)} AS avg_clv,
  {rnp(xavg('purchase_probability'), 3)} AS avg_purchase_p, {rnp('CAST(SUM(carts) AS DOUBLE) / COUNT(*)', 3)} AS avg_carts,
  {rnp('CAST(SUM(views) AS DOUBLE) / COUNT(*)', 3)} AS avg_views FROM five GROUP BY segment""", *ML_CTES, SPREAD))
def _vsal(spark, d):
    return va.value_segment_summary(five(spark, d))


def _five_rows(segment, rule):
    return with_ev(f"SELECT user_id, segment, clv_score_norm FROM five WHERE segment = '{segment}' AND {rule}", *ML_CTES, SPREAD)


@query("target_abandoners_stand_in", _five_rows("Cart abandoner", "abandon_probability > 0.6"))
def _tas(spark, d):
    return va.target_audience(five(spark, d), "Cart abandoner").select("user_id", "segment", "clv_score_norm")


@query("target_dormant_stand_in", _five_rows("Dormant", "clv_score_norm > 40"))
def _tds(spark, d):
    return va.target_audience(five(spark, d), "Dormant").select("user_id", "segment", "clv_score_norm")
