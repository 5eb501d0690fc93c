"""Sinks S8-S12: results written by the library's writers and read back with
the schema they had; the oracle is the SQL of the result itself."""

from clickspark.operators import funnel as fn
from clickspark.operators import sequence as sq
from clickspark.operators import sessions as ss
from clickspark.operators import users as us
from clickspark.plans.registry import ORACLE, ev_orders, query
from clickspark.sources import files as src
from clickspark.staging import new_path


def _csv(df, single_file):
    path = new_path(df.sparkSession, "clickspark_outputs")
    src.write_csv(df, path, single_file=single_file)
    # an empty text and a null are one in CSV; the results have no empty texts
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


@query("written_clean_parquet", ORACLE["clean_events"])
def _wcp(spark, d):
    path = new_path(spark, "clickspark_outputs")
    ev = ev_orders(spark, d)
    src.write_clean_parquet(ev, path, files_per_partition=2)
    return src.read_clean_parquet(spark, path).select(*ev.columns)


@query("written_session_table_csv", ORACLE["session_table"])
def _wst(spark, d):
    return _csv(ss.session_table(ev_orders(spark, d)), single_file=False)


@query("written_brand_funnel_csv", ORACLE["brand_funnel"])
def _wbf(spark, d):
    return _csv(fn.brand_funnel(ev_orders(spark, d)), single_file=True)


@query("written_transition_probs_csv", ORACLE["transition_probs"])
def _wtp(spark, d):
    return _csv(sq.transition_probs(ev_orders(spark, d)), single_file=True)


@query("written_clv_insights_json", ORACLE["clv_insights"])
def _wci(spark, d):
    df = us.clv_insights(us.rfm_values(us.user_table(ev_orders(spark, d))))
    path = new_path(spark, "clickspark_outputs")
    src.write_json(df, path)
    return spark.read.schema(df.schema).json(path)
