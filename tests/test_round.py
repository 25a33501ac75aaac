"""Whole results, money and parameters."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rentlens import Workspace, job
from rentlens.operators import fact
from rentlens.plans import segments
from rentlens.sources import from_star

ROOT = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def ws(spark):
    return Workspace(spark, from_star(spark, ROOT))


def test_lists_are_whole(ws):
    everyone = segments.customer_table(ws).count()
    assert everyone == ws.size.customers > 200
    assert segments.customer_table(ws, limit=5).count() == 5
    assert segments.customer_search(ws, name="^building ").count() > 10


def test_float_money_is_refused(ws):
    from dataclasses import replace

    payment = ws.relations.payment.withColumn("amount", F.col("amount").cast("double"))
    with pytest.raises(ValueError, match="double"):
        fact.payment_totals(replace(ws.relations, payment=payment))


def test_overdue_sums_are_exact(spark):
    rows = spark.range(0, 4).select(
        F.lit("2000-01-01").cast("timestamp_ntz").alias("rental_date"),
        F.expr("timestamp_ntz'2000-01-01' + make_interval(200, 0, 0, 0, 0, 0, id / 1000000)").alias("return_date"),
        F.lit(0).alias("allowed_days"),
    )
    total = rows.select(F.sum(fact.overdue_us() * 1000)).first()[0]
    each = [int(r[0]) for r in rows.select(fact.overdue_us()).collect()]
    assert int(total) == 1000 * sum(each) > 2**53


def test_job_takes_parameters(ws, tmp_path, spark):
    job.run(ws, str(tmp_path), ["customer_search"], params={"customer_search": {"name": "", "customer_id": "7"}})
    assert [r.customer_id for r in spark.read.parquet(f"{tmp_path}/customer_search").collect()] == [7]


def test_close_removes_the_folder(spark):
    own = Workspace(spark, from_star(spark, "/root/testdata/sf0.001"))
    own.customer_genre.count()
    own.close()
    path = spark._jvm.org.apache.hadoop.fs.Path(own._folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
