"""Plan properties: filters reach the scan, user-sized ranks never go
through a single partition, the cleaned table is pruned by column."""

from clickspark.fixtures import clean_fixture
from clickspark.operators import features as fe
from clickspark.operators import users as us
from clickspark.operators.ranking import global_rank

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cutoff_filter_pushed_to_scan(spark):
    ev = clean_fixture(spark, SF)
    cut = fe.cutoff_value(ev)
    p = _plan(fe.past_features(ev, cut))
    assert "PushedFilters: [IsNotNull(event_time), LessThanOrEqual(event_time" in p


def test_column_pruning(spark):
    ev = clean_fixture(spark, SF)
    from clickspark.operators.funnel import funnel_raw
    p = _plan(funnel_raw(ev))
    assert "ReadSchema: struct<event_type:string>" in p


def test_no_single_partition_on_user_rows(spark):
    from pyspark.sql import functions as F
    usr = us.user_table(clean_fixture(spark, SF))
    ranked = global_rank(usr, [F.col("total_events"), F.col("user_id")])
    p = _plan(ranked)
    # the only single-partition exchange carries the per-partition sizes
    for seg in p.split("Exchange SinglePartition")[1:]:
        assert "HashAggregate(keys=[_pid" in seg.split("\n")[1]


def test_cutoff_keeps_events_whatever_the_session_zone(spark, make_events, tmp_path):
    """Dates written in one zone, read in another: the date predicate must
    not drop events that the time predicate keeps."""
    import datetime as dt
    from clickspark.operators import features as fe
    from clickspark.sources.files import write_clean_parquet
    ev = make_events([(u, f"2024-01-05T{h:02d}:30:00", "view") for u, h in enumerate((0, 2, 4, 20, 23))])
    write_clean_parquet(ev, str(tmp_path / "clean"))
    cutoff = dt.datetime(2024, 1, 5, 3, tzinfo=dt.timezone.utc)
    try:
        for zone in ("UTC", "America/New_York", "Pacific/Auckland"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            back = spark.read.parquet(str(tmp_path / "clean"))
            assert fe.time_filter(back, cutoff, past=True).count() == 2, zone
            assert fe.time_filter(back, cutoff, past=False).count() == 3, zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
