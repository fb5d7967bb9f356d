"""The windowed counts give the same rows on a stream as on a batch."""

from pyspark.sql import functions as F

from tessera.streaming import windowed_events

from oracle import DATA


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").orderBy("ts").limit(2000)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windowed_events(stream).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination()
    rounded = lambda df: sorted(map(tuple, df.withColumn("total", F.round("total", 4)).collect()))
    assert rounded(spark.table("windows")) == rounded(windowed_events(events))
