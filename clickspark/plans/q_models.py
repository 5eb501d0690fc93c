"""Model queries N73-N91, plus the abandonment labels / dataset and the
value layer scored by the boosted model.  Fitted models have no SQL oracle
(rows-only check); the metrics, bands and targeting rules that are applied to
them are checked by SQL on data-derived stand-in scores."""

from pyspark.sql import functions as F

from clickspark.operators import models as mo
from clickspark.operators import value as va
from clickspark.plans.oracle import with_ev
from clickspark.plans.q_features import ML_CTES, ml
from clickspark.plans.registry import cutoff, ev_orders, query

#: Splits and models of a run, by what their input holds; ``forget`` drops them.
_FITTED: dict[tuple, object] = {}


def forget() -> None:
    _FITTED.clear()


def _key(spark, d, *parts):
    from clickspark.fixtures import _TABLES, _fingerprint
    return (spark.sparkContext.applicationId, d, _fingerprint(spark, d, _TABLES["orders"]), *parts)


def _split(spark, d):
    k = _key(spark, d, "split")
    if k not in _FITTED:
        _FITTED[k] = mo.split(ml(spark, d))
    return _FITTED[k]


def fitted(spark, d, name):
    """A model fitted on the stratified train split (memoised per input)."""
    k = _key(spark, d, "model", name)
    if k not in _FITTED:
        train, _ = _split(spark, d)
        _FITTED[k] = mo.fit(name, train)
    return _FITTED[k]


@query("model_comparison")
def _mc(spark, d):
    ds = ml(spark, d)
    table, models = mo.model_comparison(ds)
    for name, m in models.items():
        _FITTED.setdefault(_key(spark, d, "model", name), m)
    return table


@query("classification_report_boosted")
def _crb(spark, d):
    _, test = _split(spark, d)
    return mo.classification_report(mo.score(fitted(spark, d, "XGBoost"), test))


@query("importance_split_count")
def _isc(spark, d):
    return mo.importance_split_count(fitted(spark, d, "LightGBM"))


@query("importance_gain")
def _ig(spark, d):
    return mo.importance_gain(fitted(spark, d, "XGBoost"))


@query("importance_forest")
def _if(spark, d):
    return mo.importance_forest(fitted(spark, d, "RandomForest"))


@query("shap_importance")
def _shap(spark, d):
    train, test = _split(spark, d)
    return mo.shap_importance(fitted(spark, d, "LightGBM"), test, train)


def probs(spark, d):
    return mo.purchase_probabilities(fitted(spark, d, "XGBoost"), ml(spark, d))


@query("purchase_probabilities")
def _pp(spark, d):
    return probs(spark, d).select("user_id", "purchase_probability")


@query("probability_buckets")
def _pb(spark, d):
    return mo.probability_buckets(probs(spark, d))


AB = """ab AS (SELECT user_id, CASE WHEN COUNT(*) FILTER (WHERE event_type = 'cart') > 0
   AND COUNT(*) FILTER (WHERE event_type = 'purchase') = 0 THEN 1 ELSE 0 END AS abandoned
  FROM ev GROUP BY user_id)"""


@query("abandonment_labels", with_ev("SELECT * FROM ab", AB))
def _al(spark, d):
    return mo.abandonment_labels(ev_orders(spark, d))


@query("abandonment_labels_since_cutoff", with_ev("""SELECT user_id, CASE WHEN COUNT(*) FILTER (WHERE event_type = 'cart') > 0
   AND COUNT(*) FILTER (WHERE event_type = 'purchase') = 0 THEN 1 ELSE 0 END AS abandoned
FROM ev WHERE event_time > (SELECT c FROM cut) GROUP BY user_id""", "cut AS (SELECT quantile_cont(event_time, 0.8) AS c FROM ev)"))
def _als(spark, d):
    return mo.abandonment_labels(ev_orders(spark, d), since=cutoff(spark, d))


def ab_ds(spark, d):
    return mo.abandonment_dataset(ml(spark, d), mo.abandonment_labels(ev_orders(spark, d)))


@query("abandonment_dataset", with_ev("""SELECT ml.*, COALESCE(ab.abandoned, 0) AS abandoned
FROM ml LEFT JOIN ab ON ml.user_id = ab.user_id WHERE ml.carts > 0""", *ML_CTES, AB))
def _ad(spark, d):
    return ab_ds(spark, d)


# Stand-in scores: metrics, bands and rules do not depend on where scores come from.
EP = """sc AS (SELECT user_id, label AS y, (past_purchases + carts) / (total_events + 1.0) AS s FROM ml)"""
PER_SCORE = "ps AS (SELECT s, SUM(y) AS p, COUNT(*) AS c FROM sc GROUP BY s)"
RUNNING = """run AS (SELECT s, p, c, SUM(p) OVER (ORDER BY s DESC) AS tp, SUM(c) OVER (ORDER BY s DESC) AS n,
  (SELECT SUM(y) FROM sc) AS np, (SELECT COUNT(*) FROM sc) AS nn FROM ps)"""


def stand_in(spark, d):
    e = va.engagement_probability(ml(spark, d), "score")
    return e.withColumn("pred", (F.col("score") > 0.5).cast("int"))


@query("ranking_metrics_engagement", with_ev("""SELECT
  CAST(SUM((c - p) * (2 * tp - p)) AS DOUBLE) / 2.0 / (CAST(MAX(np) AS DOUBLE) * (MAX(nn) - MAX(np))) AS auc,
  round_even(SUM(CAST(p AS DOUBLE) / np * (CAST(tp AS DOUBLE) / n)) * 1e9, 0) / 1e9 AS ap FROM run""",
                                             *ML_CTES, EP, PER_SCORE, RUNNING))
def _rme(spark, d):
    auc, ap = mo.ranking_metrics(stand_in(spark, d))
    return spark.range(1).select(F.lit(auc).alias("auc"), (F.rint(F.lit(ap) * 1e9) / 1e9).alias("ap"))


@query("classification_report_engagement", with_ev("""SELECT CAST(k AS VARCHAR) AS class, prec AS precision, rec AS recall,
  CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1_score, support
FROM (SELECT k, COALESCE(CAST(hit AS DOUBLE) / NULLIF(said, 0), 0) AS prec, COALESCE(CAST(hit AS DOUBLE) / NULLIF(support, 0), 0) AS rec, support
  FROM (SELECT k, COUNT(*) FILTER (WHERE y = k AND p = k) AS hit, COUNT(*) FILTER (WHERE p = k) AS said,
          COUNT(*) FILTER (WHERE y = k) AS support
        FROM (SELECT y, CASE WHEN s > 0.5 THEN 1 ELSE 0 END AS p FROM sc) z CROSS JOIN (VALUES (0), (1)) v(k) GROUP BY k) a) b""",
                                                    *ML_CTES, EP))
def _cre(spark, d):
    return mo.classification_report(stand_in(spark, d)).where(F.col("class") != "macro avg")


@query("probability_buckets_engagement", with_ev("""SELECT name AS bucket, COUNT(s) AS "count"
FROM (VALUES (0, 0.2, '0-20%'), (0.2, 0.4, '20-40%'), (0.4, 0.6, '40-60%'), (0.6, 0.8, '60-80%'), (0.8, 1.0, '80-100%'))
  b(low, high, name) LEFT JOIN sc ON s > CAST(low AS DOUBLE) AND s <= CAST(high AS DOUBLE) GROUP BY name""", *ML_CTES, EP))
def _pbe(spark, d):
    return mo.probability_buckets(stand_in(spark, d), "score")


def ab_model(spark, d):
    k = _key(spark, d, "abandonment")
    if k not in _FITTED:
        _FITTED[k] = mo.train_abandonment(ab_ds(spark, d))
    return _FITTED[k]


@query("abandonment_model_metrics")
def _amm(spark, d):
    return ab_model(spark, d)[1]


@query("abandonment_report")
def _ar(spark, d):
    return ab_model(spark, d)[2]


@query("abandon_probabilities")
def _ap(spark, d):
    return mo.abandon_probabilities(ab_model(spark, d)[0], ab_ds(spark, d))


def model_segments(spark, d):
    sc = va.clv_decile(va.clv_score(probs(spark, d)))
    return va.value_segment(sc)


@query("clv_scores_model")
def _csm(spark, d):
    return va.clv_scores(model_segments(spark, d))


@query("value_segment_summary_model")
def _vssm(spark, d):
    return va.value_segment_summary(model_segments(spark, d))


@query("target_audience_abandoners")
def _taa(spark, d):
    seg = model_segments(spark, d)
    ap = mo.abandon_probabilities(ab_model(spark, d)[0], ab_ds(spark, d))
    return (va.target_audience(seg.join(ap, "user_id", "left"), "Cart abandoner")
              .select("user_id", "segment", "abandon_probability", "clv_score_norm"))
