"""Streaming forms give what the batch operators give on the same events."""

from pyspark.sql import functions as F

from tessera.streaming import logs


def collected(spark, stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_windows_and_sessions(spark, tmp_path):
    rows = [(k * 60, k % 3) for k in range(60)] + [(10_000, 9), (90_000, 9)]
    frame = spark.createDataFrame(rows, "t long, key long").select(F.timestamp_seconds("t").alias("ts"), "key")
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    got = collected(spark, logs.windowed_multiset(stream, "10 minutes", "1 minute"), "w").filter("key < 9")
    want = frame.groupBy(F.window("ts", "10 minutes").start.alias("start"), "key").agg(F.count("*").alias("cnt")).filter("key < 9")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got = collected(spark, logs.sessions(stream, "5 minutes", "1 minute"), "s").filter("key < 9")
    assert sorted((r["key"], r["cnt"]) for r in got.collect()) == [(0, 20), (1, 20), (2, 20)]
    got = collected(spark, logs.windowed_majority(stream, "1 hour", "1 minute"), "m").collect()
    assert [tuple(r)[1:] for r in sorted(got, key=lambda r: r["start"])] == [(0, 20, 60, False), (9, 1, 1, True)]
