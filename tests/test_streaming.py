import datetime as dt

from pyspark.sql import functions as F

from sparkloom.streaming import windows

SCHEMA = "event_id long, ts timestamp, user_id long, value double"
T = dt.datetime(2024, 1, 1)


def rows():
    return [(i, T + dt.timedelta(minutes=7 * i), i % 3, float(i)) for i in range(40)]


def run(df, spark, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_windows_match_their_batch_twins(spark, tmp_path):
    batch = spark.createDataFrame(rows(), SCHEMA)
    for i, part in enumerate(batch.randomSplit([0.5, 0.5], 1)):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = lambda: windows.read_events(spark, str(tmp_path / "in" / "*"), SCHEMA)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(run(windows.tumbling(stream(), "ts", ["user_id"], "value", "1 hour", "1 day"), spark, "tumbling", "complete")) == key(windows.tumbling(batch, "ts", ["user_id"], "value", "1 hour"))
    assert key(run(windows.sessions(stream(), "ts", "user_id", "10 minutes", "1 day"), spark, "sessions", "complete")) == key(windows.sessions(batch, "ts", "user_id", "10 minutes"))
    assert run(windows.deduplicated(stream().select("ts", F.lit(1).alias("k")), "ts", ["k"], "1 day"), spark, "dedup", "append").count() == 1
    assert windows.sliding(batch, "ts", [], "1 hour", "30 minutes").agg(F.sum("n_events")).first()[0] == 80


def test_custom_state(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(windows.running_totals(windows.read_events(spark, str(tmp_path / "in"), SCHEMA), "user_id", "value"), spark, "totals", "update")
    want = {k: (sum(1 for r in rows() if r[2] == k), sum(r[3] for r in rows() if r[2] == k)) for k in range(3)}
    assert {r.user_id: (r.n_events, r.total) for r in got.collect()} == want
