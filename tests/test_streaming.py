from pyspark.sql import functions as F

from seqfold.streaming import windowed_symbols


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "event_type")
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_symbols(stream, "1 day", "1000 days").writeStream.outputMode("complete").format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("seen").collect()} == {tuple(r) for r in windowed_symbols(events, "1 day").collect()}
