from pyspark.sql import functions as F

from gridstat.streaming import series as T


def stream(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{data}/event*.parquet"), events


def run(spark, df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_windows_agree_with_batch(spark, data, tmp_path):
    s, events = stream(spark, data)
    got = run(spark, T.windowed(s, "1 day"), "windows", "complete", tmp_path)
    want = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").count()
    assert got.count() == want.count() and got.agg(F.sum("n")).first()[0] == events.count()


def test_sessions_hold_every_row(spark, data, tmp_path):
    s, events = stream(spark, data)
    assert run(spark, T.sessions(s), "sessions", "complete", tmp_path).agg(F.sum("n")).first()[0] == events.count()


def test_state_folds_each_user(spark, data, tmp_path):
    s, events = stream(spark, data)
    got = {r["user_id"]: r for r in run(spark, T.smoothed(s, 0.5), "smoothed", "update", tmp_path).collect()}
    rows = events.orderBy("ts", "event_id").collect()
    user = rows[0]["user_id"]
    x = None
    for r in rows:
        if r["user_id"] == user:
            x = r["value"] if x is None else 0.5 * x + 0.5 * r["value"]
    assert abs(got[user]["smoothed"] - x) < 1e-9
    assert sum(r["n"] for r in got.values()) == events.count()
