"""Owners of staged tables: jobs side by side, threads of a job, the end of the
application."""

import os
import subprocess
import sys
import textwrap
import threading

from pyspark.sql import functions as F

from clickspark.staging import in_scope, new_path, shared_folder, stage_table, staging


def _there(path):
    return os.path.exists(path.removeprefix("file:"))


def test_two_jobs_side_by_side(spark):
    """The second job ends while the first still reads its table."""
    opened, ended, seen = threading.Event(), threading.Event(), {}

    def first():
        with staging(spark):
            df = stage_table(spark.range(1000))
            opened.set()
            assert ended.wait(60)
            seen["first"] = df.agg(F.sum("id")).first()[0]

    def second():
        assert opened.wait(60)
        with staging(spark):
            seen["second"] = stage_table(spark.range(10)).count()
        ended.set()

    threads = [threading.Thread(target=t) for t in (first, second)]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    assert seen == {"first": 499500, "second": 10}


def test_scopes_own_what_is_made_in_them(spark):
    with staging(spark):
        outer = new_path(spark)
        spark.range(3).write.parquet(outer)
        with staging(spark):
            inner = new_path(spark)
            spark.range(3).write.parquet(inner)
            got = {}
            t = threading.Thread(target=in_scope(lambda: got.update(p=new_path(spark))))
            t.start()
            t.join()
            spark.range(3).write.parquet(got["p"])
        assert _there(outer) and not _there(inner) and not _there(got["p"])
    assert not _there(outer)
    free = new_path(spark)
    spark.range(3).write.parquet(free)
    assert _there(free) and free.startswith(shared_folder(spark))


def test_nothing_is_left_after_stop(tmp_path):
    """Of an application that stops its session, and of one that just ends."""
    for last in ("spark.stop(); spark.stop()", ""):
        code = textwrap.dedent(f"""
            from pyspark.sql import SparkSession
            spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
                     .config("spark.checkpoint.dir", "{tmp_path}/ckpt").getOrCreate())
            from clickspark.staging import new_path, stage_table
            assert stage_table(spark.range(5)).count() == 5
            spark.range(2).write.parquet(new_path(spark, "clickspark_outputs"))
            {last}
        """)
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        subprocess.run([sys.executable, "-W", "error::RuntimeWarning", "-c", code], check=True, cwd=root, timeout=240)
        assert [f for _, _, files in os.walk(tmp_path / "ckpt") for f in files] == []
