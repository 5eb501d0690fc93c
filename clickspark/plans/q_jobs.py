"""End-to-end job queries: each writes a reference script's output files
under the checkpoint folder and returns the manifest; the oracle is the
expected file list, every file present."""

from clickspark.plans import jobs
from clickspark.plans.q_sessions import _manifest_sql
from clickspark.plans.registry import ev_orders, query
from clickspark.staging import new_path


def _out(spark):
    return new_path(spark, "clickspark_outputs")


@query("funnel_analysis_outputs", _manifest_sql(jobs.FUNNEL_OUTPUTS))
def _fao(spark, d):
    return jobs.funnel_analysis_job(ev_orders(spark, d), _out(spark))


@query("clickstream_outputs", _manifest_sql(jobs.NOTEBOOK_OUTPUTS))
def _co(spark, d):
    return jobs.clickstream_job(ev_orders(spark, d), _out(spark), probability="engagement")


@query("preprocessing_outputs", _manifest_sql(jobs.PREPROCESSING_OUTPUTS))
def _po(spark, d):
    from clickspark.plans.q_profile import raw_tagged
    return jobs.preprocessing_job(spark, raw_tagged(spark, d), _out(spark))
