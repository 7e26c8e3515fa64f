import datetime

from stratoscope.streaming import online

START = datetime.datetime(2024, 1, 1)


def write(spark, path, rows):
    spark.createDataFrame(
        [(s, START + datetime.timedelta(seconds=t), float(t), float(y)) for s, t, y in rows], "subject string, ts timestamp, t double, y double"
    ).coalesce(1).write.mode("append").parquet(path)


def drained(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_confirmed_bouts_and_sessions(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [("A", t, 10) for t in range(0, 8)] + [("A", t, 0) for t in range(8, 40)] + [("A", t, 10) for t in range(40, 43)] + [("B", t, 10) for t in range(0, 3)]
    write(spark, path, rows)
    write(spark, path, [("A", t, 10) for t in range(43, 50)] + [("B", t, 10) for t in range(30, 40)] + [("A", 4000, 0)])
    schema = spark.read.parquet(path).schema
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    made = drained(spark, online.confirmed_bouts(stream(), 5.0, 5.0, 3.0), "confirmed").orderBy("subject", "start_s").collect()
    assert [(r.subject, r.start_s, r.confirmed_s) for r in made] == [("A", 0.0, 5.0), ("A", 40.0, 45.0), ("B", 30.0, 35.0)]
    bouts = drained(spark, online.stream_bouts(stream(), 5.0, "5 seconds", "1 minute"), "bouts", "append")
    batch = online.stream_bouts(spark.read.parquet(path), 5.0, "5 seconds", "1 minute")
    key = lambda df: sorted((r.subject, r.start_ts, r.n) for r in df.collect())
    assert set(key(bouts)) <= set(key(batch)) and len(key(batch)) == 4


def test_window_summary(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [("A", t * 600, t) for t in range(12)])
    df = spark.read.parquet(path).withColumnRenamed("subject", "channel")
    made = online.stream_summary(df).orderBy("window_start").collect()
    assert [(r.n, r.max) for r in made] == [(6, 5.0), (6, 11.0)]
    assert online.stream_summary(df, "1 hour", "30 minutes").count() == 5


def test_confirmed_bouts_of_subjects_that_workers_get_in_parts(spark, tmp_path):
    """A subject's rows come in no order of time, and no more than five of them at once."""
    path, size = str(tmp_path / "in"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = [(s, (k * 37) % 101 + 1000 * (k % 3), 10) for s in "AB" for k in range(303)]
    write(spark, path, [*rows, ("A", 50, 0)])
    spark.createDataFrame([("A", None, None, 10.0), ("B", START, 0.0, None)], "subject string, ts timestamp, t double, y double").write.mode("append").parquet(path)
    before = spark.conf.get(size)
    spark.conf.set(size, "5")
    try:
        made = drained(spark, online.confirmed_bouts(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path), 5.0, 40.0, 3.0), "parts")
    finally:
        spark.conf.set(size, before)
    assert sorted(made.collect()) == [(s, t, t + 40.0) for s in "AB" for t in (0.0, 1000.0, 2000.0)]
