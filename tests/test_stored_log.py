"""A written audit log: filters reach the scan, results equal those on the metadata."""

import json

from pyspark.sql import functions as F

from foliate.operators import audit as U


def logs(spark):
    keys = ("version_number", "version", "version_intent")
    rows = [
        (i, "x", json.dumps({"document_id": str(i % 50), "job_id": str(i % 7), keys[i % 3]: i % 5} | ({"template_version_id": "t"} if i % 2 else {})), i)
        for i in range(2000)
    ]
    df = spark.createDataFrame(rows + [(3000, "x", None, 0), (3001, "x", "broken", 0)], "id bigint, action string, metadata string, s int")
    return df.withColumn("timestamp", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, s)")).drop("s")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_lookups(spark, tmp_path):
    df = logs(spark)
    U.write_log(df, str(tmp_path / "log"), rows_per_file=300)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == df.count()
    assert ids(U.stored_by_key(log, "job_id", 3)) == ids(U.by_key(df, "job_id", 3))
    assert ids(U.stored_by_version(log, 7, 2)) == ids(U.by_version(df, 7, 2))
    wanted = spark.createDataFrame([(1,), (2,), (2,)], "document_id bigint")
    assert ids(U.stored_by_keys(log, "document_id", wanted)) == ids(U.by_keys(df, "document_id", wanted))
    assert [r["id"] for r in U.stored_by_key(log, "job_id", 3, skip=1, limit=2).collect()] == [r["id"] for r in U.by_key(df, "job_id", 3, skip=1, limit=2).collect()]


def test_filters_reach_the_scan(spark, tmp_path):
    U.write_log(logs(spark), str(tmp_path / "log"), rows_per_file=300)
    log = spark.read.parquet(str(tmp_path / "log"))
    plan = U.stored_by_key(log, "job_id", 3).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(job_id,3)" in plan.split("PushedFilters")[1] and "metadata" not in plan.split("ReadSchema")[1]
    plan = U.stored_by_version(log, 7, 2)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(document_id,7)" in plan.split("PushedFilters")[1]
    # a document's rows lie in one or two of the files
    files = log.filter("document_id = '7'").select(F.input_file_name()).distinct().count()
    assert files <= 2 < log.select(F.input_file_name()).distinct().count()
