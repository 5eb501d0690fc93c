import os
import tempfile

from pyspark.sql import functions as F

from clickspark.sources import files as src

CSV = """event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session
2019-10-01 00:00:00 UTC,view,1,10,a.b,x,10.5,100,s1
2019-10-01 00:00:01 UTC,cart,oops,10,a.b,x,10.5,100,s1
2019-10-01 00:00:02 UTC,view,2,10,,,not_a_price,101,s2
not a time,view,3,10,a.b,x,1.0,102,s3
2019-10-01 00:00:04 UTC,purchase,4,10,a.b,,99.0,103,s4
2019-10-01 00:00:05 UTC,view,5,10,a.b,x,1.0,abc,s5
"""


def _write(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_bad_rows_split_consistently(spark):
    d = tempfile.mkdtemp(prefix="cs-csv-")
    p = _write(d, "2019-Oct.csv", CSV)
    good, bad = src.split_corrupt(src.read_events_csv(spark, p))
    assert good.count() == 2 and bad.count() == 4
    assert {r.event_type: r["count"] for r in good.groupBy("event_type").count().collect()} == {"view": 1, "purchase": 1}
    assert good.select("source_file").distinct().first()[0] == "2019-Oct.csv"


def test_multi_file_scan_tags_files(spark):
    d = tempfile.mkdtemp(prefix="cs-csv-")
    a = _write(d, "a.csv", CSV)
    b = _write(d, "b.csv", CSV)
    good, _ = src.split_corrupt(src.read_events_csv(spark, [a, b]))
    got = {r.source_file: r["count"] for r in good.groupBy("source_file").count().collect()}
    assert got == {"a.csv": 2, "b.csv": 2}


def test_parquet_roundtrip_and_inventory(spark, make_events):
    d = tempfile.mkdtemp(prefix="cs-pq-")
    ev = make_events([(1, "2024-01-01T10:00:00", "view"), (2, "2024-01-02T10:00:00", "cart")])
    src.write_clean_parquet(ev, f"{d}/clean")
    back = src.read_clean_parquet(spark, f"{d}/clean")
    assert back.count() == 2 and sorted(r.date.isoformat() for r in back.select("date").collect()) == ["2024-01-01", "2024-01-02"]
    inv = src.source_inventory(spark, d, ["clean", "missing.csv"])
    size = sum(os.path.getsize(os.path.join(p, f)) for p, _, fs in os.walk(d) for f in fs if f.endswith(".parquet") and not f.startswith("."))
    assert [(r.name, r.status, r.files, r.size_bytes) for r in inv.collect()] == [
        ("clean", "found", 2, size), ("missing.csv", "not_found", 0, None)]
    t = src.inventory_totals(inv).first()
    assert (t.wanted, t.found, t.files, t.total_bytes) == (2, 1, 2, size)
    inv = src.source_inventory(spark, os.path.dirname(__file__), ["conftest.py", "missing.csv"]).collect()
    assert [(r.name, r.status) for r in inv] == [("conftest.py", "found"), ("missing.csv", "not_found")]
    man = src.output_manifest(spark, d, ["clean", "nope"]).collect()
    assert [(r.name, r.status) for r in man] == [("clean", "OK"), ("nope", "MISSING")]


def test_streaming_ingest(spark):
    from clickspark.streaming.ingest import read_streamed, stream_clean_events
    d = tempfile.mkdtemp(prefix="cs-stream-")
    os.makedirs(f"{d}/in")
    _write(f"{d}/in", "m1.csv", CSV)
    q = stream_clean_events(spark, f"{d}/in", f"{d}/out", f"{d}/chk", bad_dir=f"{d}/bad")
    q.awaitTermination()
    out = read_streamed(spark, f"{d}/out")
    assert out.count() == 2
    assert spark.read.json(f"{d}/bad").count() == 4
    assert out.where(F.col("brand") == "Unknown").count() == 1


def test_bulk_conversion_split(spark):
    d = tempfile.mkdtemp(prefix="cs-conv-")
    p = _write(d, "2019-Nov.csv", CSV)
    src.convert_csv_to_parquet(spark, p, f"{d}/good", bad_dir=f"{d}/bad")
    good = spark.read.parquet(f"{d}/good")
    assert good.count() == 2 and spark.read.json(f"{d}/bad").count() == 4
    assert good.select("source_file").first()[0] == "2019-Nov.csv"
    src.convert_csv_to_parquet(spark, p, f"{d}/clean", clean=True)
    c = spark.read.parquet(f"{d}/clean")
    assert c.count() == 2 and "is_weekend" in c.columns and "date" in c.columns


def test_files_per_partition(spark, make_events):
    import glob
    d = tempfile.mkdtemp(prefix="cs-pq-")
    rows = [(u, f"2024-01-0{1 + u % 3}T10:00:00", "view", u) for u in range(300)]
    src.write_clean_parquet(make_events(rows).repartition(7), f"{d}/c", files_per_partition=2)
    per_date = [len(glob.glob(f"{p}/*.parquet")) for p in glob.glob(f"{d}/c/date=*")]
    assert len(per_date) == 3 and max(per_date) <= 2
    assert spark.read.parquet(f"{d}/c").count() == 300


def test_streaming_ingest_is_incremental(spark):
    """A second run with the same checkpoint picks up only the new file; the
    output holds every good row exactly once."""
    from clickspark.streaming.ingest import read_streamed, stream_clean_events
    d = tempfile.mkdtemp(prefix="cs-stream-")
    os.makedirs(f"{d}/in")
    _write(f"{d}/in", "m1.csv", CSV)
    stream_clean_events(spark, f"{d}/in", f"{d}/out", f"{d}/chk").awaitTermination()
    assert read_streamed(spark, f"{d}/out").count() == 2
    _write(f"{d}/in", "m2.csv", CSV.replace("2019-10-01", "2019-10-02"))
    stream_clean_events(spark, f"{d}/in", f"{d}/out", f"{d}/chk").awaitTermination()
    out = read_streamed(spark, f"{d}/out")
    assert out.count() == 4
    assert sorted(r.date.isoformat() for r in out.select("date").distinct().collect()) == ["2019-10-01", "2019-10-02"]


def test_manifest_below_a_folder_with_signs(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="cs-man-"), "out+v1(a)")
    src.write_csv(spark.range(3), f"{d}/t.csv")
    for form in (d, f"{d}/", f"file://{d}"):
        assert [r.status for r in src.output_manifest(spark, form, ["t.csv", "u.csv"]).collect()] == ["OK", "MISSING"]


def test_batch_and_stream_read_the_same_times(spark):
    """Fractions, zone names and offsets: equal rows by both paths."""
    from clickspark.operators.cleaning import clean_events
    from clickspark.schema import CLEAN_COLUMNS
    from clickspark.streaming.ingest import read_streamed, stream_clean_events
    d = tempfile.mkdtemp(prefix="cs-times-")
    os.makedirs(f"{d}/in")
    head = CSV.split("\n")[0]
    times = ["2019-10-01 00:00:00 UTC", "2019-10-01 00:00:00.250000 UTC", "2019-10-01 00:00:00", "2019-10-01 02:00:00+02:00", "10/01/2019"]
    p = _write(f"{d}/in", "m.csv", "\n".join([head, *(f"{t},view,{i},10,a.b,x,1.0,{i},s" for i, t in enumerate(times))]) + "\n")
    good, bad = src.split_corrupt(src.read_events_csv(spark, p))
    stream_clean_events(spark, f"{d}/in", f"{d}/out", f"{d}/chk", bad_dir=f"{d}/bad").awaitTermination()
    rows = lambda df: sorted(map(tuple, df.select(*CLEAN_COLUMNS).collect()), key=repr)
    assert rows(clean_events(good)) == rows(read_streamed(spark, f"{d}/out")) and good.count() == 4
    assert bad.count() == spark.read.json(f"{d}/bad").count() == 1


def test_conversion_counts(spark):
    d = tempfile.mkdtemp(prefix="cs-count-")
    p = _write(d, "m.csv", CSV)
    assert src.convert_csv_to_parquet(spark, p, f"{d}/a", bad_dir=f"{d}/bad") == {"rows_written": 2, "rows_rejected": 4}
    assert src.convert_csv_to_parquet(spark, p, f"{d}/b") == {"rows_written": 2, "rows_rejected": 4}


def test_staged_tables_go_with_their_owner(spark, make_events):
    from clickspark.plans import jobs
    from clickspark.staging import shared_folder, stage_table, staging
    folder = shared_folder(spark).replace("file:", "")
    count = lambda: len(os.listdir(folder)) if os.path.isdir(folder) else 0
    before = count()
    with staging(spark):
        assert stage_table(spark.range(5)).count() == 5 and count() == before + 1
    assert count() == before
    ev = make_events([(u, f"2024-01-0{1 + u % 3}T10:00:00", t, u) for u in range(9) for t in ("view", "cart", "purchase")])
    jobs.rfm_analysis_job(ev, tempfile.mkdtemp(prefix="cs-job-"))
    jobs.session_analysis_job(ev, tempfile.mkdtemp(prefix="cs-job-"))
    assert count() == before


def test_staging_needs_a_shared_folder(spark, monkeypatch):
    import pytest
    from clickspark import staging
    monkeypatch.setattr(staging, "ensure_checkpoint_dir", lambda s: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.stage_table(spark.range(1))
