"""Streams over files, run to their end."""

from pyspark.sql import functions as F

from maskwright.streaming import stream


def test_hits_of_stream(spark, tmp_path):
    spark.createDataFrame([(1, "почта a@b.ru")], "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / "in"))
    q = stream.hits_of_stream(source).writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.value for r in spark.table("hits").collect()] == ["a@b.ru"]


def test_sessions_expire(spark, tmp_path):
    rows = "session_id string, created_at timestamp, expires_at timestamp"
    for k, (s, at) in enumerate([("a", "2024-01-01 00:00:00"), ("b", "2024-01-03 00:00:00"), ("c", "2024-01-05 00:00:00")]):
        one = spark.createDataFrame([(s, at)], "session_id string, t string").select("session_id", F.to_timestamp("t").alias("created_at"), (F.to_timestamp("t") + F.expr("interval 1 day")).alias("expires_at"))
        one.coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    source = spark.readStream.schema(rows).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = stream.expiring_sessions(source).writeStream.outputMode("update").format("memory").queryName("sessions").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.session_id, r.status) for r in spark.table("sessions").collect()}
    assert {("a", "live"), ("b", "live"), ("c", "live"), ("a", "expired")} <= got


def test_mask_stream(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / "in"))
    q = stream.mask_stream(source, lambda b: b.withColumn("text", F.upper("text")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["X"]
