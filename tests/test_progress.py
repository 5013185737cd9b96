"""Progress: batch rules on their bounds, and streams replayed in several micro-batches equal to the batch twins."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pageflow.operators import progress as p
from pageflow.streaming import progress as live

START = datetime(2024, 1, 1)
EVENT = "event_id long, job_id long, ts timestamp, kind string, filename string, page int, status string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def at(seconds):
    return START + timedelta(seconds=seconds)


def event(i, job, seconds, kind, filename=None, page=None, status=None):
    return (i, job, at(seconds), kind, filename, page, status)


def stored(spark, tmp_path, batches, schema=EVENT):
    """Each batch one parquet file, read one file a micro-batch in writing order."""
    path = str(tmp_path / "in")
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
    s = live.stream_session(spark)
    s.conf.set("spark.sql.shuffle.partitions", "2")
    df = spark.read.parquet(path)
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), df


def test_rate_uses_the_last_thirty_pages(spark):
    warmup = [event(i, 1, i * 10, "page_done", "a", i) for i in range(5)]
    steady = [event(10 + i, 1, 100 + i, "page_done", "a", 10 + i) for i in range(30)]
    single = [event(90, 2, 5, "page_done", "b", 0)]
    same = [event(91 + i, 3, 5, "page_done", "b", i) for i in range(3)]
    df = spark.createDataFrame(warmup + steady + single + same, EVENT)
    assert rows(p.page_rate(df), "job_id", "rate") == [(1, 1.0), (2, 0.0), (3, 0.0)]


@pytest.mark.parametrize(
    "total, done, rate, expected, pipeline",
    [(10, 5, 2.0, 2, 2), (10, 3, 2.0, 4, 4), (10, 10, 0.0, 0, 0), (10, 5, 0.0, None, None), (0, 0, 0.0, None, 0), (10, 10, 1.0, 0, 0)],
)
def test_eta(spark, total, done, rate, expected, pipeline):
    df = spark.createDataFrame([(total, done, rate)], "total_pages long, completed_pages long, rate double")
    assert p.eta(df).first().eta_seconds == expected
    assert p.eta(df, pipeline=True).first().eta_seconds == pipeline


def test_snapshot_labels(spark):
    files = spark.createDataFrame([(1, "a", 4), (1, "b", 4), (1, "c", 4), (1, "d", 4)], "job_id long, filename string, pages int")
    done = spark.createDataFrame([(1, "a", 1), (1, "b", 9), (1, "c", 2)], "job_id long, filename string, done long")
    status = spark.createDataFrame([(1, "a", "done"), (1, "b", "processing"), (1, "c", "failed")], "job_id long, filename string, status string")
    snap = p.file_snapshot(files, done, status)
    jobs = spark.createDataFrame([(1, None, None, None, at(0)), (2, "FAILED", True, "x", at(50))], "job_id long, status string, sealed boolean, error string, created timestamp")
    rates = spark.createDataFrame([(1, 2.0)], "job_id long, rate double")
    shown = p.live_snapshot(jobs, p.job_snapshot(snap), rates, F.lit(at(60)))
    assert sorted(map(tuple, shown.collect())) == [
        (1, "PROCESSING", False, None, 4, 2, 16, 10, 60.0, 2.0, 3), (2, "FAILED", True, "x", 0, 0, 0, 0, 10.0, 0.0, None)]
    assert rows(snap, "filename", "completed_pages", "label") == [("a", 4, "done"), ("b", 4, "processing (4/4)"), ("c", 2, "failed"), ("d", 0, "queued")]
    assert tuple(p.job_snapshot(snap).first()) == (1, 4, 2, 16, 10)


def test_cancel_and_idle(spark):
    df = spark.createDataFrame([event(1, 1, 0, "page_done"), event(2, 1, 10, "page_done"), event(3, 2, 0, "page_done"), event(4, 3, 0, "sealed")], EVENT)
    cancels = spark.createDataFrame([(1, at(10))], "job_id long, ts timestamp")
    assert rows(p.drop_cancelled(df, cancels), "event_id") == [(1,), (3,), (4,)]
    now = F.lit(at(1801)).cast("timestamp")
    assert rows(p.autoseal(df, now), "job_id") == [(2,)]           # 1801 s idle; job 1 only 1791 s
    assert rows(p.autoseal(df, F.lit(at(1800)).cast("timestamp")), "job_id") == []  # exactly 30 minutes


MB = 1024 * 1024
CHUNKS = [
    (1, 0, 0, 4 * MB, 10 * MB), (1, 1, 0, 4 * MB, 10 * MB), (1, 2, 8 * MB, 2 * MB, 10 * MB), (1, 3, 4 * MB, 7 * MB, 10 * MB),
    (1, 4, 4 * MB, 6 * MB, 10 * MB), (1, 5, 4 * MB, 6 * MB, 10 * MB), (1, 6, 10 * MB, 1, 10 * MB),
    (2, 0, 0, 17 * MB, 20 * MB), (2, 1, 0, 16 * MB, 20 * MB),
]
CHUNK = "file_id long, arrival long, offset long, length long, size long"
LEDGER = [
    (1, 0, True, 4 * MB), (1, 1, False, 4 * MB), (1, 2, False, 4 * MB), (1, 3, False, 4 * MB), (1, 4, True, 10 * MB),
    (1, 5, False, 10 * MB), (1, 6, True, 10 * MB), (2, 0, False, 0), (2, 1, True, 16 * MB),
]


def test_ledger_batch_and_stream(spark, tmp_path):
    df = spark.createDataFrame(CHUNKS, CHUNK).repartition(5)
    assert rows(p.upload_ledger(df, ["arrival"]), "file_id", "arrival", "accepted", "received") == LEDGER
    halves = [[c for c in CHUNKS if c[1] < 3], [c for c in CHUNKS if c[1] >= 3]]
    stream, _ = stored(spark, tmp_path, halves, CHUNK)
    got = live.replay(live.upload_ledger(stream), str(tmp_path / "run"))
    assert rows(got, "file_id", "arrival", "accepted", "received") == LEDGER


def test_speed_keeps_the_last_value_and_spans_buckets(spark):
    # At 9 s the window holds 0 and 8; at 30 s only itself, so the sample at 9 s is the base.
    data = [(1, 0, 0, 1000), (1, 8, 80, 1000), (1, 9, 99, 1000), (1, 30, 309, 1000), (1, 31, 400, 1000), (2, 5, 50, 100), (2, 6, 60, 100)]
    df = spark.createDataFrame(data, "upload_id long, t long, sent long, total long")
    got = rows(p.upload_speed(df), "upload_id", "bytes_per_second", "eta_seconds")
    assert got == [(1, 10.0, 69.1)]  # 31 s against 30 s spans 1 s: no new value


def sample_events():
    rng = random.Random(5)
    events, i = [], 0
    for job in range(1, 5):
        for f in ("a", "b"):
            for page in range(6):
                events.append(event(i, job, rng.randrange(0, 600), "page_done", f, page, "processing"))
                i += 1
    copies = [(*e[:2], e[2] + timedelta(seconds=1), *e[3:]) for e in events[::3]]
    everything = events + [(1000 + n, *e[1:]) for n, e in enumerate(copies)]
    rng.shuffle(everything)
    return everything


def test_dedupe_and_counts_stream_equals_batch(spark, tmp_path):
    events = sample_events()
    stream, df = stored(spark, tmp_path, [events[:20], events[20:40], events[40:]])
    counted = live.replay(live.file_progress(live.dedupe_events_forever(stream)), str(tmp_path / "a"), "complete")
    last = counted.groupBy("job_id", "filename").agg(F.max("done").alias("done"))
    assert rows(last, "job_id", "filename", "done") == rows(p.file_progress(df), "job_id", "filename", "done")
    within = live.replay(live.dedupe_events(stream, "1 hour"), str(tmp_path / "b"))
    keys = ("job_id", "filename", "page")
    assert rows(within, *keys) == rows(p.dedupe_events(df), *keys)


def test_sticky_status_and_rate_stream_equal_batch(spark, tmp_path):
    updates = [
        event(1, 1, 1, "status", "a", None, "processing"), event(2, 1, 5, "status", "a", None, "done"),
        event(3, 1, 9, "status", "a", None, "processing"), event(4, 1, 2, "status", "b", None, "processing"),
        event(5, 1, 12, "status", "a", None, "failed"), event(6, 1, 13, "status", "b", None, "done"),
    ]
    stream, df = stored(spark, tmp_path, [updates[:2], updates[2:4], updates[4:]])
    changes = live.replay(live.sticky_status(stream), str(tmp_path / "s"))
    assert rows(changes, "filename", "status") == [("a", "done"), ("a", "failed"), ("b", "done"), ("b", "processing")]
    assert rows(p.sticky_status(df), "filename", "status") == [("a", "failed"), ("b", "done")]


def test_rate_stream_equals_batch(spark, tmp_path):
    events = [event(i, i % 2, i * i % 97, "page_done", "a", i) for i in range(90)]
    stream, df = stored(spark, tmp_path, [events[:30], events[30:]])
    rates = live.replay(live.page_rate(stream), str(tmp_path / "r"), "update")
    last = rates.groupBy("job_id").agg(F.max(F.struct("batch_id", "rate"))["rate"].alias("rate"))
    assert rows(last, "job_id", "rate") == rows(p.page_rate(df), "job_id", "rate")


def test_completion_is_announced_once(spark, tmp_path):
    first = [
        event(1, 1, 0, "file_added", "a"), event(2, 1, 0, "file_added", "b"), event(3, 1, 5, "status", "a", None, "done"),
        event(4, 1, 6, "sealed"), event(5, 2, 0, "sealed"), event(6, 3, 0, "file_added", "a"), event(7, 3, 1, "cancelled"),
        event(8, 4, 0, "file_added", "a"), event(9, 4, 1, "status", "a", None, "failed"), event(10, 5, 0, "file_added", "a"),
        event(11, 5, 3, "status", "a", None, "done"),
    ]
    second = [
        event(20, 1, 20, "status", "b", None, "processing"), event(21, 1, 21, "status", "b", None, "done"),
        event(22, 1, 22, "status", "b", None, "processing"), event(23, 3, 22, "status", "a", None, "done"), event(24, 3, 23, "sealed"),
        event(25, 4, 24, "sealed"), event(26, 2, 25, "sealed"),
    ]
    # The sealed job 7 still waits for a status that is reported an hour late; job 5 is never sealed.
    third = [event(28, 7, 7200, "file_added", "a"), event(29, 7, 7201, "sealed"), event(31, 6, 7200, "file_added", "z")]
    fourth = [event(32, 7, 3600, "status", "a", None, "done"), event(33, 1, 9000, "status", "a", None, "failed")]
    stream, _ = stored(spark, tmp_path, [first, second, third, fourth])
    done = live.replay(live.job_completion(stream), str(tmp_path / "c"))
    assert rows(done.fillna("-"), "job_id", "outcome", "error", "auto_sealed") == [
        (1, "SUCCESS", "-", False), (2, "FAILED", "No files were uploaded.", False),
        (4, "FAILED", "None of the files could be processed.", False), (7, "SUCCESS", "-", False),
    ]


def test_idle_job_is_sealed_by_wall_clock(spark, tmp_path):
    first = [event(1, 5, 0, "file_added", "a"), event(2, 5, 3, "status", "a", None, "done"), event(3, 6, 3, "file_added", "a")]
    stream, _ = stored(spark, tmp_path, [first, [event(4, 8, 4, "activity")], [event(5, 8, 5, "activity")]])
    done = live.replay(live.job_completion(stream, idle_seconds=0), str(tmp_path / "c"))
    assert (5, "SUCCESS", True) in rows(done.filter("job_id = 5"), "job_id", "outcome", "auto_sealed")
    assert done.filter("job_id = 6").count() == 0  # sealed, but its file has not settled


def test_chunks_without_numbers_are_refused(spark):
    rows_in = [(1, 0, 0, 5, 10), (1, 1, None, 5, 10), (1, 2, 5, None, 10), (1, 3, 5, 5, None), (1, 4, 5, 5, 10), (None, 0, 0, 1, 1)]
    got = p.upload_ledger(spark.createDataFrame(rows_in, CHUNK), ["arrival"])
    assert sorted(((r.file_id or 0, r.arrival, r.accepted, r.received) for r in got.collect())) == [
        (0, 0, False, 0), (1, 0, True, 5), (1, 1, False, 5), (1, 2, False, 5), (1, 3, False, 5), (1, 4, True, 10)]


def plain_ledger(chunks):
    """Row by row: chunks sorted by (file, arrival)."""
    out, current, received = [], object(), 0
    for file_id, arrival, offset, length, size in sorted(chunks, key=lambda c: (c[0], c[1])):
        if file_id != current:
            current, received = file_id, 0
        ok, received = p.next_ledger_state(received, offset, length, size)
        out.append((file_id, arrival, ok, received, received >= size))
    return out


def test_ledger_equals_the_row_by_row_rule_on_random_uploads(spark, monkeypatch):
    rng = random.Random(11)
    for block in (4096, 3):
        monkeypatch.setattr(p, "LEDGER_BLOCK", block)
        chunks = []
        for file_id in range(12):
            size = rng.choice([0, 5, 12, 40])
            for arrival in range(rng.choice([1, 5, 60])):
                chunks.append((file_id, arrival, rng.randrange(-1, size + 2), rng.choice([-1, 0, 1, 1, 2, 3, 17 * MB]), size + rng.choice([0, 0, 0, 1])))
        df = spark.createDataFrame(chunks, CHUNK).repartition(5)
        assert rows(p.upload_ledger(df, ["arrival"]), "file_id", "arrival", "accepted", "received", "complete") == plain_ledger(chunks)


def test_ledger_of_one_long_file_spreads_over_tasks(spark):
    """A file of 60,000 chunks, each sent twice, and 30,000 repeats of its first one."""
    n = 60_000
    ids = spark.range(n)
    once = ids.select(F.lit(1).cast("long").alias("file_id"), (F.col("id") * 3).alias("arrival"), (F.col("id") * 7).alias("offset"))
    again = once.withColumn("arrival", F.col("arrival") + 1)
    first = spark.range(n // 2).select(F.lit(1).cast("long").alias("file_id"), (F.col("id") * 6 + 2).alias("arrival"), F.lit(0).cast("long").alias("offset"))
    chunks = once.unionByName(again).unionByName(first).withColumns({"length": F.lit(7).cast("long"), "size": F.lit(n * 7).cast("long")})
    judged = p.upload_ledger(chunks, ["arrival"]).cache()
    assert judged.filter(F.col("accepted") & (F.col("received") < n * 7)).count() == n - 1
    wrong = judged.filter(F.col("arrival") % 3 == 0).filter(~F.col("accepted") | (F.col("received") != F.col("offset") + 7))
    assert wrong.count() == 0
    assert judged.filter("complete").count() == 2
    assert judged.rdd.glom().map(len).filter(lambda size: size > 0).count() > 1
    judged.unpersist()
