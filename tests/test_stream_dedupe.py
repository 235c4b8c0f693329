import datetime as dt

from foliate.plans import ingest


def test_a_repeat_after_months_does_not_pass(spark, tmp_path, monkeypatch):
    schema = "user_id bigint, k bigint, status string, ts timestamp_ntz"
    for i, (day, user) in enumerate([(0, 1), (200, 2), (400, 3), (401, 1)]):
        row = (user, 1, "PENDING", dt.datetime(2024, 1, 1) + dt.timedelta(days=day))
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{tmp_path}/part{i}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    monkeypatch.setattr(ingest, "_event_stream", lambda *_: stream)
    assert sorted(r["job_id"] for r in ingest.stream_dedupe(spark, "").collect()) == [1, 2, 3]
