import random
import shutil

from pyspark.sql import functions as F

from kinelog.streaming import events as E

SF = "/root/testdata/sf0.001"


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{SF}/events.parquet", tmp_path / "in")
    return E.source(spark, str(tmp_path / "in"))


def table(spark):
    return spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def test_closed_windows_equal_the_table(spark, tmp_path):
    got = {(r.start, r.n) for r in drained(E.counted(source(spark, tmp_path), "1 day", late="1 hour"), "tumbling").collect()}
    want = {(r.start, r.n) for r in E.counted(table(spark), "1 day").collect()}
    assert got < want and len(got) >= len(want) - 1


def test_sessions_equal_the_table(spark, tmp_path):
    got = {(r.user_id, r.start, r.n) for r in drained(E.sessions(source(spark, tmp_path), "2 hours", late="1 hour"), "sessions").collect()}
    want = {(r.user_id, r.start, r.n) for r in E.sessions(table(spark), "2 hours").collect()}
    assert got < want and len(got) > 0.9 * len(want)


def test_motion_keeps_the_last_state(spark, tmp_path):
    kind = "agent_id long, scene_ts long, x double, y double"
    for k, rows in enumerate(([(1, 0, 0.0, 0.0), (1, 1, 2.0, 0.0), (2, 0, 5.0, 5.0)], [(1, 3, 8.0, 1.0), (1, 1, 99.0, 99.0)])):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = sorted(map(tuple, drained(E.motion(stream).drop("n_late"), "motion", "append").collect()))
    assert got == [(1, 0, 0.0, 0.0, 0.0, 0.0), (1, 1, 2.0, 0.0, 2.0, 0.0), (1, 3, 8.0, 1.0, 3.0, 0.5), (2, 0, 5.0, 5.0, 0.0, 0.0)]


def test_motion_counts_late_rows_and_forgets(spark, tmp_path):
    kind = "agent_id long, scene_ts long, x double, y double"
    for k, rows in enumerate(([(1, 5, 0.0, 0.0), (1, 7, 4.0, 0.0), (1, 5, 9.0, 9.0)], [(1, 6, 1.0, 1.0), (1, 2, 1.0, 1.0)], [(1, 8, 7.0, 0.0)])):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = sorted(map(tuple, drained(E.motion(stream, "1 hour").select("scene_ts", "vx", "n_late"), "late", "append").collect()))
    assert [g[0] for g in got] == [5, 7, 8] and got[-1][1:] == (3.0, 2) and sum(g[2] for g in got) == 3


def plain_episodes(rows, closing, pause, mark):
    """Over (user, us, id, type, value) up to the watermark ``mark``, all in microseconds."""
    out = []
    for user in sorted({r[0] for r in rows}):
        open_ = None
        for _, us, _, kind, value in sorted((r for r in rows if r[0] == user and r[1] <= mark), key=lambda r: r[1:3]):
            if open_ and us - open_[2] > pause:
                out.append((*open_, "expired"))
                open_ = None
            open_ = (user, open_[1] if open_ else us, us, open_[3] + 1 if open_ else 1, (open_[4] if open_ else 0.0) + value)
            if kind == closing:
                out.append((*open_, "closed"))
                open_ = None
        if open_ and mark - open_[2] > pause:
            out.append((*open_, "expired"))
    return sorted(out)


def test_episodes_whatever_the_order_of_arrival(spark, tmp_path):
    rng = random.Random(4)
    minutes = sorted(rng.sample(range(1, 3000), 160))
    rows = [(rng.randrange(5), m * 60_000_000, k, rng.choice(("view", "view", "click", "buy")), float(rng.randrange(9))) for k, m in enumerate(minutes)]
    rows += [(u, minutes[-1] * 60_000_000, 900 + u, "view", 1.0) for u in (0, 1)]
    for batch in range(6):  # rows come at most about 500 minutes out of order
        part = rows[batch * 27 : (batch + 1) * 27]
        rng.shuffle(part)
        df = spark.createDataFrame([*part, (1, None, 1, "view", 1.0), (None, part[0][1], 1, "view", 1.0)], "user_id long, us long, event_id long, event_type string, value double")
        df.selectExpr("event_id", "timestamp_micros(us) AS ts", "user_id", "event_type", "value").coalesce(1).write.parquet(f"{tmp_path}/in/part{batch}")
    kind = "event_id long, ts timestamp, user_id long, event_type string, value double"
    mark = (minutes[-1] - 60) * 60_000_000
    for k, files in enumerate((1, 100)):
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", files).parquet(f"{tmp_path}/in/*")
        got = E.run(E.episodes(stream, "buy", "90 minutes", "1 hour"), f"{tmp_path}/out{k}")
        assert sorted(map(tuple, got.collect())) == plain_episodes(rows, "buy", 90 * 60_000_000, mark)
