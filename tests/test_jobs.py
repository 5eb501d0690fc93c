import tempfile

from clickspark.fixtures import clean_fixture, raw_fixture
from clickspark.plans import jobs

SF = "/root/testdata/sf0.001"


def test_jobs_write_every_output(spark):
    ev = clean_fixture(spark, SF)
    from functools import partial
    for job in (jobs.session_analysis_job, jobs.rfm_analysis_job, jobs.funnel_analysis_job,
                partial(jobs.clickstream_job, probability="engagement")):
        out = tempfile.mkdtemp(prefix="cs-job-")
        man = job(ev, out).collect()
        assert all(r.status == "OK" for r in man), (str(job), [r for r in man if r.status != "OK"])
    raw = raw_fixture(spark, SF).withColumnRenamed("user_session", "user_session")
    from pyspark.sql import functions as F
    raw = raw.withColumn("source_file", F.lit("f.csv"))
    man = jobs.preprocessing_job(spark, raw, tempfile.mkdtemp(prefix="cs-job-")).collect()
    assert all(r.status == "OK" for r in man)


def test_model_outputs_job(spark):
    ev = clean_fixture(spark, SF)
    out = tempfile.mkdtemp(prefix="cs-job-")
    man, probs = jobs.model_outputs_job(ev, out, numTrees=5, maxIter=3, maxDepth=3)
    assert all(r.status == "OK" for r in man.collect())
    man2 = jobs.clickstream_job(ev, tempfile.mkdtemp(prefix="cs-job-"), probability=probs).collect()
    assert all(r.status == "OK" for r in man2)


def test_command_line_clv_uses_the_model(spark):
    """The segments' probabilities are those of the model, by default."""
    from pyspark.sql import functions as F
    from clickspark.operators import features as fe, models as mo
    d = tempfile.mkdtemp(prefix="cs-cli-")
    ev = clean_fixture(spark, SF)
    ev.write.mode("overwrite").partitionBy("date").parquet(f"{d}/clean")
    jobs.main(["clickstream", "--input", f"{d}/clean", "--output", f"{d}/out", "--iterations", "2"])
    got = spark.read.option("header", True).option("inferSchema", True).csv(f"{d}/out/user_segments.csv")
    ml = fe.ml_dataset(spark.read.parquet(f"{d}/clean"))
    model = mo.fit("XGBoost", mo.split(ml)[0], maxIter=2)
    want = mo.purchase_probabilities(model, ml).select("user_id", F.col("purchase_probability").alias("p"))
    j = got.join(want, "user_id")
    assert j.count() == got.count() == ml.count()
    assert j.where(F.abs(F.col("p") - F.col("purchase_probability")) > 1e-12).count() == 0


def test_command_line(spark, capsys):
    import os
    d = tempfile.mkdtemp(prefix="cs-cli-")
    with open(os.path.join(d, "m.csv"), "w") as f:
        f.write("event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session\n"
                "2019-10-01 00:00:00 UTC,view,1,10,a.b,x,10.5,100,s1\n"
                "2019-10-01 00:05:00 UTC,cart,1,10,a.b,x,10.5,100,s1\n"
                "oops,row\n")
    jobs.main(["convert", "--input", os.path.join(d, "m.csv"), "--output", f"{d}/clean", "--bad-rows", f"{d}/bad"])
    assert spark.read.parquet(f"{d}/clean").count() == 2 and spark.read.json(f"{d}/bad").count() == 1
    jobs.main(["sessions", "--input", f"{d}/clean", "--output", f"{d}/out"])
    assert "MISSING" not in capsys.readouterr().out
