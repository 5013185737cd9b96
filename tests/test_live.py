"""Streams over a job's life in several micro-batches: cancellation, chained totals, expiry, first results, upload speed."""

import random

import pytest
from pyspark.sql import functions as F

from pageflow.operators import jobs as j, progress as p
from pageflow.streaming import live as lv, progress as live, results as first
from tests.test_progress import EVENT, at, event, rows, stored


def test_cancellation_stops_later_events_of_all_files(spark, tmp_path):
    files = [f"f{i}" for i in range(40)]
    before = [event(i, 1, i, "page_done", f, i) for i, f in enumerate(files)] + [event(900, 2, 5, "page_done", "x", 0)]
    # The cancellation stands between events that it stops and one that it does not.
    second = [event(100 + i, 1, 101 + i, "page_done", f, i) for i, f in enumerate(files)]
    second = second[:20] + [event(500, 1, 100, "cancelled", None), event(501, 1, 300, "cancelled", None)] + second[20:]
    second += [event(502, 1, 99, "page_done", "f3", 9), event(503, 1, 100, "page_done", "f4", 9)]
    third = [event(600, 1, 400, "page_done", "new", 0), event(601, 1, 50, "page_done", "late", 0), event(602, 2, 400, "page_done", "x", 1)]
    stream, df = stored(spark, tmp_path, [before, second, third])
    got = live.replay(lv.drop_cancelled(stream, shards=5), str(tmp_path / "c"))
    assert got.columns == df.columns
    cancels = df.filter("kind = 'cancelled'").select("job_id", "ts")
    want = p.drop_cancelled(df.filter("kind <> 'cancelled'"), cancels)
    assert rows(got, *df.columns[:3], "filename") == rows(want, *df.columns[:3], "filename")
    assert {502, 601, 602} <= {r.event_id for r in got.collect()} and not {503, 600} & {r.event_id for r in got.collect()}


def job_events(seed=4, jobs=4):
    rng = random.Random(seed)
    events = []
    for i in range(400):
        kind = rng.choice(["page_done"] * 6 + ["status", "sealed"])
        status = {"page_done": "processing", "sealed": None, "status": rng.choice(["done", "failed", "processing"])}[kind]
        events.append(event(i, rng.randrange(jobs), rng.randrange(5000), kind, rng.choice("abc"), rng.randrange(12), status))
    return events


def test_chained_totals_equal_the_batch_snapshot(spark, tmp_path):
    events = job_events()
    stream, df = stored(spark, tmp_path, [events[:130], events[130:260], events[260:]])
    totals = live.replay(lv.job_totals(stream), str(tmp_path / "t"))
    columns = ["job_id", "total_files", "completed_files", "total_pages", "completed_pages"]
    last = totals.groupBy("job_id").agg(F.max_by(F.struct(*columns[1:]), "version").alias("s")).select("job_id", "s.*")
    files = df.groupBy(*p.FILE).agg(F.max("page").alias("pages"))
    snap = p.job_snapshot(p.file_snapshot(files, p.file_progress(df), p.sticky_status(df.filter("status is not null"))))
    assert rows(last, *columns) == rows(snap, *columns)
    assert totals.count() > last.count()
    state = lv.live_jobs(live.stream_session(spark), str(tmp_path / "t" / "state"))
    assert rows(state, *columns) == rows(snap, *columns)


def test_expired_jobs_come_from_the_state(spark, tmp_path):
    day = 86400
    events = [event(1, 1, 0, "page_done", "a", 0, "processing"), event(2, 2, 0, "page_done", "a", 0, "processing"),
              event(3, 2, day, "page_done", "a", 1, "processing"), event(4, 3, 9 * day, "page_done", "a", 0, "processing")]
    stream, _ = stored(spark, tmp_path, [events[:2], events[2:]])
    live.replay(lv.job_totals(stream), str(tmp_path / "t"))
    session = live.stream_session(spark)
    stale = lambda seconds: rows(lv.stale_keys(session, str(tmp_path / "t" / "state"), F.lit(at(seconds)).cast("timestamp")), "job_id")
    assert stale(7 * day) == []                      # exactly seven days
    assert stale(7 * day + 1) == [(1,)]
    assert stale(8 * day + 1) == [(1,), (2,)]


RESULT = "job_id long, filename string, page int, ts timestamp, s0 double"


def result_rows():
    rng = random.Random(9)
    return [(rng.randrange(3), rng.choice("ab"), rng.randrange(15), at(i), float(i)) for i in range(240)]


def test_a_batch_that_fails_after_its_write_is_stored_once(spark, tmp_path):
    data = result_rows()
    stream, df = stored(spark, tmp_path, [data[:80], data[80:160], data[160:]], RESULT)
    sink = first.FirstResultSink(str(tmp_path / "first"), ["ts", "s0"])
    runs = []

    def fails_once(batch, batch_id):
        sink(batch, batch_id)
        runs.append(batch_id)
        if runs == [0, 1]:
            raise RuntimeError("lost between write and commit")

    def run():
        writer = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        writer.foreachBatch(fails_once).start().awaitTermination()

    with pytest.raises(Exception, match="lost between"):
        run()
    run()
    assert runs == [0, 1, 1, 2]
    got = first.read_first_results(spark, sink.path)
    assert rows(got, *got.columns) == rows(j.first_result(df, j.KEYS, ["ts", "s0"]), *got.columns)


def test_a_repeated_early_batch_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame(result_rows(), RESULT)
    sink = first.FirstResultSink(str(tmp_path / "first"), ["ts", "s0"])
    parts = [df.filter(F.floor(F.col("s0") / 80) == k) for k in range(3)]
    for k in (0, 1, 2, 0, 1, 2):
        sink(parts[k], k)
    got = first.read_first_results(spark, sink.path)
    assert rows(got, *got.columns) == rows(j.first_result(df, j.KEYS, ["ts", "s0"]), *got.columns)


def test_speed_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    samples, t = [], {u: 0 for u in range(5)}
    for i in range(300):
        u = rng.randrange(5)
        t[u] += rng.choice([0, 1, 1, 2, 5, 25])
        samples.append((u, t[u], i * 10 + u, 100_000))
    schema = "upload_id long, t long, sent long, total long"
    stream, df = stored(spark, tmp_path, [samples[:100], samples[100:101], samples[101:220], samples[220:]], schema)
    got = live.replay(lv.upload_speed(stream), str(tmp_path / "u"))
    last = got.groupBy("upload_id").agg(F.max_by(F.struct("bytes_per_second", "eta_seconds"), F.struct("t", "bytes_per_second")).alias("s")).select("upload_id", "s.*")
    columns = ["upload_id", "bytes_per_second", "eta_seconds"]
    flat = lambda df: [v for row in rows(df, *columns) for v in row]
    assert flat(last) == pytest.approx(flat(p.upload_speed(df)))
