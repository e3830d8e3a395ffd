import pandas as pd

from parlance.streaming.pauses import pause_stream, sessions, windowed_counts


def test_pause_stream(spark, tmp_path):
    schema = "meeting_id string, word string, start double, end double"
    source = tmp_path / "in"
    source.mkdir()
    one = [("m", "a", 0.0, 0.2), ("m", "b", 0.3, 0.5), ("m", "c", 1.0, 1.2)]
    two = [("m", "d", 1.3, 1.4), ("m", "e", 5.0, 5.1)]
    stream = pause_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    out = str(tmp_path / "out")
    for k, rows in enumerate((one, two)):  # each run goes on from the state of the one before
        pd.DataFrame(rows, columns=["meeting_id", "word", "start", "end"]).to_parquet(source / f"{k}.parquet")
        query = stream.writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
    got = spark.read.parquet(out).orderBy("chunk_idx").select("chunk_idx", "text", "n_words", "start", "end").collect()
    assert [tuple(r) for r in got] == [(0, "a b", 2, 0.0, 0.5), (1, "c d", 2, 1.0, 1.4)]  # the third is open still


def test_windows_and_sessions(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", "x", 1.0), (1, "2024-01-01 00:20:00", "x", 2.0), (1, "2024-01-01 02:00:00", "y", 4.0)], "user_id int, ts string, event_type string, value double").selectExpr("user_id", "cast(ts as timestamp) ts", "event_type", "value")
    assert sorted(r.n for r in sessions(rows).collect()) == [1, 2]
    assert sorted((r.event_type, r.n, r.total) for r in windowed_counts(rows).collect()) == [("x", 2, 3.0), ("y", 1, 4.0)]
