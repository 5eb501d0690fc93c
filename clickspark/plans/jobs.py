"""End-to-end jobs: one call per analysis script of the reference, writing
its output files (CSV folders, JSON documents) under an output folder, and
a manifest of what was written.

Small aggregated results are written as one CSV part; data-sized tables
(sessions, users, per-user scores) as multi-part CSV folders.  Tables read
by several outputs are materialised once (``staging.stage_table``) and
removed when the job ends.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from clickspark.operators import funnel as fn
from clickspark.operators import profile as pr
from clickspark.operators import sequence as sq
from clickspark.operators import sessions as ss
from clickspark.operators import users as us
from clickspark.operators import features as fe
from clickspark.operators import value as va
from clickspark.staging import stage_table, staging
from clickspark.plans import reports
from clickspark.sources.files import output_manifest, write_csv, write_json

# Output names of the reference's analyses.
SESSION_OUTPUTS = [
    "session_summary.json", "session_level_table.csv", "session_behavior_comparison.csv",
    "session_duration_distribution.csv", "products_per_session.csv", "cart_abandonment.csv",
    "session_engagement.csv", "hourly_session_patterns.csv", "weekend_weekday_sessions.csv",
    "session_analysis_master.json",
]
RFM_OUTPUTS = [
    "user_level_table.csv", "user_segments.csv", "segment_characteristics.csv", "clv_insights.json",
    "behavioral_segments.csv", "power_user_summary.csv", "rfm_analysis_master.json",
]
FUNNEL_OUTPUTS = [
    "unique_pairs_funnel_summary.csv", "all_pairs_funnel_summary.csv", "unique_pairs_funnel_dropoff.csv",
    "all_pairs_funnel_dropoff.csv", "category_funnel.csv", "brand_funnel.csv", "hourly_funnel.csv",
    "brand_analysis.csv", "cart_abandonment.csv", "combined_funnel_for_category.csv", "weekend_funnel.csv",
    "hourly_weekend_funnel.csv", "monthly_funnel.csv", "user_level_features.csv", "session_approximation.csv",
]
NOTEBOOK_OUTPUTS = [
    "event_breakdown.csv", "transition_probs.csv", "transition_matrix.csv", "top_transitions.csv",
    "funnel.csv", "time_to_purchase.csv", "time_to_purchase_clean.csv", "ml_dataset.csv",
    "clv_scores.csv", "clv_decile_summary.csv", "segment_summary.csv", "user_segments.csv",
]


def _small(df: DataFrame, out: str, name: str) -> None:
    write_csv(df, f"{out}/{name}", single_file=True)


def _big(df: DataFrame, out: str, name: str) -> None:
    write_csv(df, f"{out}/{name}")


def _job(fn):
    """Staged tables of the call are removed when it ends."""
    @functools.wraps(fn)
    def run(first, *args, **kwargs):
        with staging(first if isinstance(first, SparkSession) else first.sparkSession):
            return fn(first, *args, **kwargs)
    return run


@_job
def session_analysis_job(ev: DataFrame, out: str) -> DataFrame:
    """Daily-proxy session analysis: every table and the master document."""
    ses = stage_table(ss.session_table(ev))
    write_json(ss.session_summary(ses), f"{out}/session_summary.json")
    _big(ses, out, "session_level_table.csv")
    _small(ss.session_behavior_comparison(ses), out, "session_behavior_comparison.csv")
    _small(ss.session_duration_distribution(ses), out, "session_duration_distribution.csv")
    _small(ss.products_per_session(ses), out, "products_per_session.csv")
    _small(ss.session_cart_abandonment(ses), out, "cart_abandonment.csv")
    _small(ss.session_engagement(ses), out, "session_engagement.csv")
    _small(ss.hourly_session_patterns(ses), out, "hourly_session_patterns.csv")
    _small(ss.weekend_weekday_sessions(ses), out, "weekend_weekday_sessions.csv")
    write_json(reports.session_report(ses, staged=True), f"{out}/session_analysis_master.json")
    return output_manifest(ev.sparkSession, out, SESSION_OUTPUTS)


@_job
def rfm_analysis_job(ev: DataFrame, out: str) -> DataFrame:
    """User table, RFM segments, CLV insights, behaviour segments."""
    usr = stage_table(us.user_table(ev))
    _big(usr, out, "user_level_table.csv")
    rfm = us.rfm_values(usr)
    seg = stage_table(us.rfm_segment(us.rfm_scores(rfm)))
    _small(us.rfm_segment_distribution(seg), out, "user_segments.csv")
    _small(us.rfm_segment_characteristics(seg), out, "segment_characteristics.csv")
    write_json(us.clv_insights(rfm), f"{out}/clv_insights.json")
    beh = us.behavioral_segment(us.power_users(usr, materialize=False))
    _small(us.behavioral_distribution(beh), out, "behavioral_segments.csv")
    _small(us.power_user_summary(beh), out, "power_user_summary.csv")
    write_json(reports.rfm_report(usr, staged=True), f"{out}/rfm_analysis_master.json")
    return output_manifest(ev.sparkSession, out, RFM_OUTPUTS)


@_job
def funnel_analysis_job(ev: DataFrame, out: str) -> DataFrame:
    """Raw and deduplicated funnels and their breakdowns."""
    dd, raw = fn.funnel_dedup(ev), fn.funnel_raw(ev)
    _small(dd, out, "unique_pairs_funnel_summary.csv")
    _small(raw, out, "all_pairs_funnel_summary.csv")
    _small(fn.funnel_dropoff(dd), out, "unique_pairs_funnel_dropoff.csv")
    _small(fn.funnel_dropoff(raw), out, "all_pairs_funnel_dropoff.csv")
    _small(fn.category_funnel(ev), out, "category_funnel.csv")
    _small(fn.brand_funnel(ev), out, "brand_funnel.csv")
    _small(fn.hourly_funnel(ev), out, "hourly_funnel.csv")
    _small(fn.brand_analysis(ev), out, "brand_analysis.csv")
    _small(fn.pair_cart_abandonment(ev), out, "cart_abandonment.csv")
    _small(fn.combined_category_funnel(ev), out, "combined_funnel_for_category.csv")
    _small(fn.weekend_funnel(ev), out, "weekend_funnel.csv")
    _small(fn.hourly_weekend_funnel(ev), out, "hourly_weekend_funnel.csv")
    _small(fn.monthly_funnel(ev), out, "monthly_funnel.csv")
    _big(us.user_level_features(ev), out, "user_level_features.csv")
    _big(ss.session_approximation(ev), out, "session_approximation.csv")
    return output_manifest(ev.sparkSession, out, FUNNEL_OUTPUTS)


@_job
def clickstream_job(ev: DataFrame, out: str, probability: DataFrame | str = "model", **overrides) -> DataFrame:
    """Sequences, time to purchase, features and value.  ``probability``:
    ``"model"`` fits the boosted model on the stratified training split and
    scores every user with it (``overrides``: its parameters), a frame
    (user_id, purchase_probability) brings scores of a model fitted before,
    ``"engagement"`` asks for the data-derived stand-in."""
    _small(pr.event_distribution(ev), out, "event_breakdown.csv")
    tp = stage_table(sq.transition_probs(ev))
    _small(tp, out, "transition_probs.csv")
    _small(sq.transition_matrix(tp), out, "transition_matrix.csv")
    _small(sq.top_transitions(tp), out, "top_transitions.csv")
    _small(fn.user_funnel(ev), out, "funnel.csv")
    ttp = stage_table(sq.time_to_purchase(ev))
    _big(ttp, out, "time_to_purchase.csv")
    _big(sq.time_to_purchase_clean(ttp), out, "time_to_purchase_clean.csv")
    ml = stage_table(fe.ml_dataset(ev))
    _big(ml, out, "ml_dataset.csv")
    if probability == "model":
        from clickspark.operators import models as mo
        scored = mo.purchase_probabilities(mo.fit("XGBoost", mo.split(ml)[0], **overrides), ml)
    elif probability == "engagement":
        scored = va.engagement_probability(ml)
    else:
        scored = ml.join(probability, "user_id", "left")
    dec = stage_table(va.clv_decile(va.clv_score(stage_table(scored))))
    _big(va.clv_scores(dec), out, "clv_scores.csv")
    _small(va.clv_decile_summary(dec), out, "clv_decile_summary.csv")
    seg = va.value_segment(dec)
    _small(va.value_segment_summary(seg), out, "segment_summary.csv")
    _big(va.value_segment_users(seg), out, "user_segments.csv")
    return output_manifest(ev.sparkSession, out, NOTEBOOK_OUTPUTS)


PREPROCESSING_OUTPUTS = ["file_profile.csv", "file_event_mix.csv", "dataset_stats.json",
                         "missing_patterns.csv", "missing_policy.csv", "top_brands.csv",
                         "preprocessing_log.json"]
MODEL_OUTPUTS = [
    "model_comparison.csv", "feature_importance_lgbm.csv", "feature_importance_xgb.csv",
    "feature_importance_rf.csv", "shap_importance.csv", "purchase_probabilities.csv",
    "abandonment_report.csv", "abandon_probabilities.csv",
]


@_job
def preprocessing_job(spark: SparkSession, raw: DataFrame, out: str) -> DataFrame:
    """Profiling of the raw rows and the missing-value decisions (the
    conversion itself is ``sources.convert_csv_to_parquet``)."""
    _small(pr.file_profile(raw), out, "file_profile.csv")
    _small(pr.file_event_mix(raw), out, "file_event_mix.csv")
    write_json(pr.dataset_stats(raw), f"{out}/dataset_stats.json")
    pats = pr.missing_patterns(raw)
    _small(pats, out, "missing_patterns.csv")
    _small(pr.missing_policy(pats), out, "missing_policy.csv")
    _small(pr.top_brands(raw), out, "top_brands.csv")
    write_json(reports.assemble({"analysis_type": "preprocessing_log"},
                                {"file_stats": pr.file_profile(raw), "missing_patterns": pats,
                                 "decisions": pr.missing_policy(pats)},
                                {"metrics": pr.dataset_stats(raw)}),
               f"{out}/preprocessing_log.json")
    return output_manifest(spark, out, PREPROCESSING_OUTPUTS)


@_job
def model_outputs_job(ev: DataFrame, out: str, **overrides) -> tuple[DataFrame, DataFrame]:
    """The notebook's model outputs: comparison table, the three
    importance tables, SHAP importance, purchase and abandonment
    probabilities.  Returns (manifest, purchase probabilities) so that
    ``clickstream_job`` can score CLV with the model.  ``overrides`` change
    model hyper-parameters (tests use small ones)."""
    from clickspark.operators import models as mo
    ds = stage_table(fe.ml_dataset(ev))
    table, fitted = mo.model_comparison(ds, **overrides)
    _small(table, out, "model_comparison.csv")
    _small(mo.importance_split_count(fitted["LightGBM"]), out, "feature_importance_lgbm.csv")
    _small(mo.importance_gain(fitted["XGBoost"]), out, "feature_importance_xgb.csv")
    _small(mo.importance_forest(fitted["RandomForest"]), out, "feature_importance_rf.csv")
    train, test = mo.split(ds)
    _small(mo.shap_importance(fitted["LightGBM"], test, train), out, "shap_importance.csv")
    scored = mo.purchase_probabilities(fitted["XGBoost"], ds).select("user_id", "purchase_probability")
    _big(scored, out, "purchase_probabilities.csv")
    probs = ev.sparkSession.read.schema(scored.schema).option("header", True).csv(f"{out}/purchase_probabilities.csv")
    ab = mo.abandonment_dataset(ds, mo.abandonment_labels(ev))
    ab_over = {k: v for k, v in overrides.items() if k in mo.ABANDON_PARAMS}
    model, _, report = mo.train_abandonment(ab, **ab_over)
    _small(report, out, "abandonment_report.csv")
    _big(mo.abandon_probabilities(model, ab), out, "abandon_probabilities.csv")
    return output_manifest(ev.sparkSession, out, MODEL_OUTPUTS), probs


def main(argv: list[str] | None = None) -> None:
    """Command line: ``python -m clickspark.plans.jobs <analysis> --input
    <path> --output <dir>``.  ``convert`` reads raw CSV files (paths or a
    folder) and writes the cleaned, date-partitioned Parquet table; the
    analyses read such a cleaned table.  Uses the session the cluster
    provides (``spark-submit``) or a local one."""
    import argparse
    from pyspark.sql import SparkSession
    from clickspark.sources.files import convert_csv_to_parquet, read_events_csv, split_corrupt
    ap = argparse.ArgumentParser(prog="clickspark.plans.jobs")
    ap.add_argument("analysis", choices=["convert", "preprocess", "funnel", "sessions", "rfm",
                                         "clickstream", "models"])
    ap.add_argument("--input", nargs="+", required=True)
    ap.add_argument("--output", required=True)
    ap.add_argument("--bad-rows", default=None, help="folder for rejected CSV rows (convert)")
    ap.add_argument("--files-per-date", type=int, default=None)
    ap.add_argument("--probability", choices=["model", "engagement"], default="model",
                    help="where the CLV of clickstream takes purchase probabilities from")
    ap.add_argument("--iterations", type=int, default=None, help="boosting rounds (clickstream, models)")
    ap.add_argument("--timezone", default="UTC", help="zone for hour / day / weekend of event_time")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"clickspark-{a.analysis}").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", a.timezone)
    if a.analysis == "convert":
        print(convert_csv_to_parquet(spark, a.input, a.output, bad_dir=a.bad_rows, clean=True,
                                     files_per_partition=a.files_per_date))
        return
    rounds = {} if a.iterations is None else {"maxIter": a.iterations}
    if a.analysis == "preprocess":
        good, _ = split_corrupt(read_events_csv(spark, a.input))
        man = preprocessing_job(spark, good, a.output)
    else:
        ev = spark.read.parquet(*a.input)
        if a.analysis == "models":
            man, _ = model_outputs_job(ev, a.output, **rounds)
        else:
            job = {"funnel": funnel_analysis_job, "sessions": session_analysis_job, "rfm": rfm_analysis_job,
                   "clickstream": functools.partial(clickstream_job, probability=a.probability, **rounds)}[a.analysis]
            man = job(ev, a.output)
    man.show(truncate=False)


if __name__ == "__main__":
    main()
