import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rosterline.operators import usage
from rosterline.streaming import drain, engagement_stream, ingest_releases, sessions_stream, usage_windows

START = datetime(2026, 1, 1)


def events(spark, rows):
    data = [(i, user, START + timedelta(seconds=at)) for i, (user, at) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id long, user_id long, ts timestamp")


def brute_sessions(rows, gap=1800):
    found = []
    for user in {u for u, _ in rows}:
        times = sorted(t for u, t in rows if u == user)
        runs = [[times[0]]]
        for t in times[1:]:
            runs[-1].append(t) if t - runs[-1][-1] <= gap else runs.append([t])
        found += [(user, i + 1, len(r), r[-1] - r[0]) for i, r in enumerate(runs)]
    return sorted(found)


def test_exactly_the_gap_stays_in_the_session(spark):
    rows = [(1, 0), (1, 1800), (1, 3601), (2, 1799), (2, 3600)]
    got = usage.sessions(events(spark, rows)).collect()
    assert sorted((r.user_id, r.session_no, r.events) for r in got) == [(1, 1, 2), (1, 2, 1), (2, 1, 1), (2, 2, 1)]


def test_sessions_match_brute_force(spark):
    rng = random.Random(11)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randint(0, 400_000)) for _ in range(900)]
    df = events(spark, rows)
    got = sorted((r.user_id, r.session_no, r.events, (r.end_us - r.start_us) // 1_000_000) for r in usage.sessions(df).collect())
    assert got == brute_sessions(rows)
    tagged = usage.sessionize(df).groupBy("user_id", "session_no").count().collect()
    assert sorted((r.user_id, r.session_no, r["count"]) for r in tagged) == [r[:3] for r in got]


def test_engagement_and_consent(spark):
    df = spark.createDataFrame([(1, 1, 999), (1, 1, 1000), (1, 2, 9999), (2, 1, 10000), (3, 1, 5)],
                               "user_id long, session_no long, engagement_ms long")
    got = {(r.user_id, r.session_no): (r.pings, r.engaged_ms, r.engaged) for r in usage.engagement(df).collect()}
    assert got == {(1, 1): (1, 1000, False), (1, 2): (1, 9999, False), (2, 1): (1, 10000, True),
                   (3, 1): (0, 0, False)}  # only a short ping: the session stays
    kept = usage.only_consented(df, spark.createDataFrame([(2,), (3,)], "user_id long"), "user_id")
    assert {r.user_id for r in kept.collect()} == {2, 3}


def test_events_without_client_or_time(spark):
    df = spark.createDataFrame([(None, START), (None, START + timedelta(hours=2)), (1, None), (1, START)],
                               "user_id long, ts timestamp")
    got = sorted((r.user_id or -1, r.session_no, r.events) for r in usage.sessions(df).collect())
    assert got == [(-1, 1, 1), (-1, 2, 1), (1, 1, 1)]
    tagged = sorted((r.user_id or -1, r.session_no) for r in usage.sessionize(df).collect())
    assert tagged == [(-1, 1), (-1, 2), (1, 1)]


def test_streamed_sessions_equal_batch_sessions(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randint(1, 5), rng.randint(0, 200_000)) for _ in range(300)]
    df = events(spark, rows)
    df.select("ts", "user_id").write.parquet(str(tmp_path / "in"))
    closing = spark.createDataFrame([(START + timedelta(days=900), -1)], "ts timestamp, user_id long")
    closing.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, user_id long").parquet(str(tmp_path / "in"))
    out = drain(sessions_stream(stream, "10 minutes"), str(tmp_path / "out"), str(tmp_path / "ck")).filter("user_id >= 0")
    batch = usage.sessions(df).drop("session_no")
    assert out.exceptAll(batch.select(*out.columns)).isEmpty() and out.count() == batch.count()


def test_streamed_engagement_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    # Whole half-gaps: many events lie exactly one gap apart.
    rows = [(rng.randint(1, 4), 900 * rng.randint(0, 300)) for _ in range(200)]
    df = events(spark, rows).withColumn("engagement_ms", F.pmod(F.xxhash64("ts", "user_id"), F.lit(14_000)))
    schema = "ts timestamp, user_id long, engagement_ms long"
    df.select("ts", "user_id", "engagement_ms").write.parquet(str(tmp_path / "in"))
    closing = spark.createDataFrame([(START + timedelta(days=900), -1, None)], schema)
    closing.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = drain(engagement_stream(stream, "10 minutes"), str(tmp_path / "out"), str(tmp_path / "ck")).filter("user_id >= 0")
    batch = usage.engagement(usage.sessionize(df))
    starts = usage.sessions(df).select("user_id", "session_no", "start_us")
    want = batch.join(starts, ["user_id", "session_no"]).select(*out.columns)
    assert out.exceptAll(want).isEmpty() and out.count() == want.count()
    assert 0 < out.filter("engaged").count() < out.count()


def test_a_release_waits_until_it_is_whole(spark, tmp_path):
    arriving, target = str(tmp_path / "in"), str(tmp_path / "out")
    unique = {"unique codes": lambda df: df.groupBy("code").count().filter("count > 1")}
    schema = SNAPSHOT + ", due long"

    def deliver(release, due, *codes):
        data = [(c, "N", None, "TX", 1.0, None, None, None, None, release, due) for c in codes]
        spark.createDataFrame(data, schema).write.mode("append").parquet(arriving)
        ingest_releases(spark, arriving, target, schema, gates=unique, size="due")

    deliver("2026-01", 2, "A", "B")
    deliver("2026-02", 3, "A", "C")
    assert not (tmp_path / "out" / "changes").exists()
    assert not (tmp_path / "out" / "snapshots" / "release=2026-02").exists()
    deliver("2026-02", 3, "D")
    changes = {(r.code, r.change_type) for r in spark.read.parquet(target + "/changes").collect()}
    assert changes == {("B", "removed"), ("C", "added"), ("D", "added")}
    with pytest.raises(Exception, match="unique codes"):
        deliver("2026-03", 2, "A", "A")
    assert not (tmp_path / "out" / "snapshots" / "release=2026-03").exists()


def test_more_rows_than_announced_are_refused(spark, tmp_path):
    arriving, target = str(tmp_path / "in"), str(tmp_path / "out")
    data = [(c, "N", None, "TX", 1.0, None, None, None, None, "2026-01", 1) for c in "AB"]
    spark.createDataFrame(data, SNAPSHOT + ", due long").write.parquet(arriving)
    with pytest.raises(Exception, match="were announced"):
        ingest_releases(spark, arriving, target, SNAPSHOT + ", due long", size="due")


def test_sliding_usage_windows(spark):
    df = events(spark, [(1, 0), (1, 3000), (2, 7000)]).withColumn("event_type", F.lit("view"))
    rows = usage_windows(df, "10 minutes", window="1 hour", slide="30 minutes").collect()
    base = 1767225600
    got = {(r.window_start_us // 1_000_000 - base): r.events for r in rows}
    assert got == {-1800: 1, 0: 2, 1800: 1, 3600: 1, 5400: 1}


SNAPSHOT = ("code string, name string, city string, state string, adp double, contract_type string, company string, "
            "last_rating string, last_end_date string, release string")


def arrive(spark, path, release, *rows):
    data = [(code, "N", None, "TX", adp, None, None, None, None, release) for code, adp in rows]
    spark.createDataFrame(data, SNAPSHOT).write.mode("append").parquet(path)


def test_a_release_in_two_batches_is_whole(spark, tmp_path):
    arriving, target = str(tmp_path / "in"), str(tmp_path / "out")
    for release, rows in (("2026-01", [("A", 100.0), ("B", 50.0)]), ("2026-02", [("A", 101.0)]),
                          ("2026-02", [("B", 51.0)]), ("2026-01", [("C", 9.0)])):
        arrive(spark, arriving, release, *rows)
        ingest_releases(spark, arriving, target, SNAPSHOT)
    kept = spark.read.option("basePath", target + "/snapshots").parquet(target + "/snapshots/release=2026-02/batch-*")
    assert {r.code for r in kept.collect()} == {"A", "B"}
    changes = {(r.code, r.change_type) for r in spark.read.parquet(target + "/changes").collect()}
    assert changes == {("C", "removed")}


def test_releases_are_compared_as_they_arrive(spark, tmp_path):
    arriving, target = str(tmp_path / "in"), str(tmp_path / "out")
    unique = {"unique codes": lambda df: df.groupBy("code").count().filter("count > 1")}
    arrive(spark, arriving, "2026-01", ("A", 100.0), ("B", 50.0))
    ingest_releases(spark, arriving, target, SNAPSHOT, gates=unique)
    arrive(spark, arriving, "2026-02", ("A", 200.0), ("C", 5.0))
    ingest_releases(spark, arriving, target, SNAPSHOT, gates=unique)
    ingest_releases(spark, arriving, target, SNAPSHOT, gates=unique)
    changes = {(r.release, r.code, r.change_type) for r in spark.read.parquet(target + "/changes").collect()}
    assert changes == {("2026-02", "A", "swings"), ("2026-02", "B", "removed"), ("2026-02", "C", "added")}
    arrive(spark, arriving, "2026-03", ("A", 1.0), ("A", 2.0))
    with pytest.raises(Exception, match="unique codes"):
        ingest_releases(spark, arriving, target, SNAPSHOT, gates=unique)
    assert {r.release for r in spark.read.parquet(target + "/snapshots").select("release").distinct().collect()} == {
        "2026-01", "2026-02"}
