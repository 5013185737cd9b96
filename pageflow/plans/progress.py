"""Progress queries (P01..P14) over the given tables: batch twins and replayed streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from pageflow import fixtures as fx
from pageflow.operators import progress as p
from pageflow.plans.catalog import query
from pageflow.session import checkpoint_dir
from pageflow.streaming import live as jobs_live, progress as live

FILE = p.FILE

fx.SQL["fx_updates"] = """
    SELECT job_id, filename, event_id, ts, CASE kind WHEN 'file_failed' THEN 'failed' WHEN 'file_done' THEN 'done' ELSE 'processing' END AS status
    FROM fx_progress WHERE kind <> 'sealed'"""
fx.SQL["fx_sticky"] = """
    SELECT job_id, filename, arg_max(status, (status IN ('done', 'failed'), ts, event_id)) AS status FROM fx_updates GROUP BY job_id, filename"""
fx.SQL["fx_done"] = "SELECT job_id, filename, count(DISTINCT page) AS done FROM fx_progress WHERE kind = 'page_done' GROUP BY job_id, filename"
fx.SQL["fx_live_files"] = "SELECT job_id, filename, CAST(max(page) AS INT) AS pages FROM fx_progress GROUP BY job_id, filename"
fx.SQL["fx_file_snapshot"] = """
    SELECT *, CASE WHEN status IN ('done', 'failed') THEN status
        WHEN completed_pages > 0 THEN 'processing (' || CAST(completed_pages AS VARCHAR) || '/' || CAST(pages AS VARCHAR) || ')' ELSE 'queued' END AS label
    FROM (SELECT f.job_id, f.filename, pages, status,
                 CAST(CASE WHEN status = 'done' THEN pages ELSE least(coalesce(done, 0), pages) END AS BIGINT) AS completed_pages
          FROM fx_live_files f LEFT JOIN fx_done d ON f.job_id = d.job_id AND f.filename = d.filename
          LEFT JOIN fx_sticky s ON f.job_id = s.job_id AND f.filename = s.filename) q"""
fx.SQL["fx_job_snapshot"] = """
    SELECT job_id, count(*) AS total_files, count(*) FILTER (label IN ('done', 'failed')) AS completed_files,
           CAST(sum(pages) AS BIGINT) AS total_pages, CAST(sum(completed_pages) AS BIGINT) AS completed_pages FROM fx_file_snapshot GROUP BY job_id"""
fx.SQL["fx_page_rate"] = """
    SELECT job_id, CASE WHEN max(us) > min(us) THEN (count(*) - 1) / (CAST(max(us) - min(us) AS DOUBLE) / 1000000) ELSE CAST(0 AS DOUBLE) END AS rate
    FROM (SELECT job_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS age
          FROM fx_progress WHERE kind = 'page_done') q WHERE age <= 30 GROUP BY job_id"""


def _updates(t):
    status = F.when(F.col("kind") == "file_failed", "failed").when(F.col("kind") == "file_done", "done").otherwise("processing")
    return fx.progress_events(t).filter(F.col("kind") != "sealed").withColumn("status", status)


def _file_snapshot(t):
    events = fx.progress_events(t)
    files = events.groupBy(*FILE).agg(F.max("page").alias("pages"))
    return p.file_snapshot(files, p.file_progress(events), p.sticky_status(_updates(t)))


@query("P01_dedupe_events", """
    SELECT event_id, job_id, kind, filename, page FROM fx_progress
    QUALIFY row_number() OVER (PARTITION BY job_id, kind, filename, page ORDER BY ts, event_id) = 1""")
def _(t):
    return p.dedupe_events(fx.progress_events(t)).drop("ts")


@query("P02_file_progress", "SELECT * FROM fx_done")
def _(t):
    return p.file_progress(fx.progress_events(t))


@query("P03_sticky_status", "SELECT * FROM fx_sticky")
def _(t):
    return p.sticky_status(_updates(t))


@query("P04_file_snapshot", "SELECT job_id, filename, pages, completed_pages, label FROM fx_file_snapshot")
def _(t):
    return _file_snapshot(t).drop("status")


@query("P04_live_snapshot", """
    SELECT m.job_id, CASE WHEN m.job_id % 3 = 0 THEN 'FAILED' ELSE 'PROCESSING' END AS status, sealed,
           CASE WHEN m.job_id % 3 = 0 THEN 'stopped' END AS error, total_files, completed_files, total_pages, completed_pages,
           round(CAST(epoch_us(TIMESTAMP '2024-06-01 00:00:00') - created AS DOUBLE) / 1000000, 1) AS elapsed_seconds,
           round(coalesce(rate, 0), 3) AS pages_per_second,
           CASE WHEN r.rate > 0 AND total_pages > completed_pages THEN CAST(round_even((total_pages - completed_pages) / r.rate, 0) AS BIGINT)
                WHEN total_pages > 0 AND total_pages = completed_pages THEN 0 END AS eta_seconds
    FROM (SELECT job_id, min(epoch_us(ts)) AS created, count(*) FILTER (kind = 'sealed') > 0 AS sealed FROM fx_progress GROUP BY job_id) m
    JOIN fx_job_snapshot s ON m.job_id = s.job_id LEFT JOIN fx_page_rate r ON m.job_id = r.job_id""")
def _(t):
    events = fx.progress_events(t)
    stopped = F.col("job_id") % 3 == 0
    jobs = events.groupBy("job_id").agg(
        F.min("ts").cast("timestamp").alias("created"), (F.count_if(F.col("kind") == "sealed") > 0).alias("sealed")
    ).withColumns({"status": F.when(stopped, "FAILED"), "error": F.when(stopped, "stopped")})
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    return p.live_snapshot(jobs, p.job_snapshot(_file_snapshot(t)), p.page_rate(events), now)


@query("P04_job_snapshot", "SELECT * FROM fx_job_snapshot")
def _(t):
    return p.job_snapshot(_file_snapshot(t))


@query("P05_page_rate", "SELECT job_id, round(rate, 9) AS rate FROM fx_page_rate")
def _(t):
    return p.page_rate(fx.progress_events(t)).select("job_id", F.round("rate", 9).alias("rate"))


@query("P06_eta", """
    SELECT s.job_id, CASE WHEN r.rate > 0 AND total_pages > completed_pages THEN CAST(round_even((total_pages - completed_pages) / r.rate, 0) AS BIGINT)
        WHEN total_pages > 0 AND total_pages = completed_pages THEN 0 END AS eta_seconds
    FROM fx_job_snapshot s LEFT JOIN fx_page_rate r ON s.job_id = r.job_id""")
def _(t):
    rates = p.page_rate(fx.progress_events(t))
    snapshot = p.job_snapshot(_file_snapshot(t)).join(rates, "job_id", "left")
    return p.eta(snapshot).select("job_id", "eta_seconds")


@query("P07_cumulative_rate", """
    SELECT job_id, pages, round(CASE WHEN span > 0 THEN pages / (span / CAST(1000000 AS DOUBLE)) ELSE 0 END, 9) AS rate FROM (
        SELECT job_id, count(*) FILTER (kind = 'page_done') AS pages,
               max(epoch_us(ts)) FILTER (kind = 'page_done') - min(epoch_us(ts)) AS span FROM fx_progress GROUP BY job_id) q""")
def _(t):
    return p.cumulative_rate(fx.progress_events(t)).select("job_id", "pages", F.round("rate", 9).alias("rate"))


def _status_events(t):
    """Job events with a status where one says how its file stands."""
    status = F.when(F.col("kind") == "file_failed", "failed").when(F.col("kind") == "file_done", "done")
    kind = F.when(F.col("kind").isin("file_failed", "file_done"), "status").otherwise(F.col("kind"))
    return fx.progress_events(t).withColumns({"status": status, "kind": kind})


def _scratch(t) -> str:
    return f"{checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"


STEP_FILES = 4


def in_batches(t, rows, step, number: int = 3):
    """``rows`` stored step by step (``step`` is 0 to ``number`` - 1) and read as a stream, one step a micro-batch.

    The rows are computed once; every step is written by several tasks.
    """
    spark, whole, path = live.stream_session(t.spark), _scratch(t), _scratch(t)
    rows.withColumn("_step", step.cast("int")).write.parquet(whole)
    kept = t.spark.read.parquet(whole)
    for k in range(number):
        kept.filter(F.col("_step") == k).drop("_step").repartition(STEP_FILES).write.mode("append").parquet(path)
    return live.read_events(spark, path, rows.schema, "*.parquet", STEP_FILES)


def _squeezed(events):
    """Times drawn together to a tenth, so that a month lies inside the seven days that are remembered."""
    begin = F.lit("2024-01-01 00:00:00").cast("timestamp")
    us = F.unix_micros(begin) + F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(begin)) / 10)
    return events.withColumn("ts", F.timestamp_micros(us.cast("long")))


def _by_time(ts):
    """Thirds of a month, in order."""
    return F.least(F.floor((F.dayofmonth(ts) - 1) / 10), F.lit(2))


@query("P01_dedupe_events_stream", "SELECT DISTINCT job_id, kind, filename, page FROM fx_progress")
def _(t):
    """Copies of an event come in different micro-batches."""
    events = fx.progress_events(t).withColumn("ts", F.col("ts").cast("timestamp"))
    twice = events.unionByName(events.withColumn("event_id", F.col("event_id") + 1))
    seen = live.replay(live.dedupe_events(in_batches(t, _squeezed(twice), F.col("event_id") % 3)), _scratch(t))
    return seen.select("job_id", "kind", "filename", "page")


@query("P02_file_progress_stream", "SELECT * FROM fx_done")
def _(t):
    events = _squeezed(fx.progress_events(t))
    counted = live.file_progress(live.dedupe_events(in_batches(t, events, F.col("event_id") % 3)))
    runs = live.replay(counted, _scratch(t), "update")
    return runs.groupBy(*FILE).agg(F.max("done").alias("done"))


@query("P08_job_completion", """
    SELECT s.job_id, CASE WHEN coalesce(done, 0) = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS outcome,
           CASE WHEN coalesce(files, 0) = 0 THEN 'No files were uploaded.' WHEN done = 0 THEN 'None of the files could be processed.' END AS error,
           false AS auto_sealed
    FROM (SELECT DISTINCT job_id FROM fx_progress WHERE kind = 'sealed') s
    LEFT JOIN (SELECT job_id, count(*) AS files, count(*) FILTER (status = 'done') AS done FROM (
        SELECT job_id, filename, arg_max(status, (ts, event_id)) AS status FROM fx_updates WHERE status <> 'processing' GROUP BY job_id, filename) e
        GROUP BY job_id) q ON s.job_id = q.job_id""")
def _(t):
    """A file counts from its first status; seals come with the last of three micro-batches."""
    events = _status_events(t)
    step = F.when(F.col("kind") == "sealed", 2).otherwise(F.col("event_id") % 3)
    return live.replay(live.job_completion(in_batches(t, events, step)), _scratch(t))


@query("P03_sticky_status_stream", "SELECT * FROM fx_sticky")
def _(t):
    events = _status_events(t).filter(F.col("kind") != "sealed")
    updates = events.withColumn("status", F.coalesce("status", F.lit("processing")))
    changes = live.replay(live.sticky_status(in_batches(t, updates, F.col("event_id") % 3)), _scratch(t))
    newest = F.struct(F.col("status").isin(*p.TERMINAL).alias("terminal"), "ts", "event_id", "status")
    return changes.groupBy(*FILE).agg(F.max(newest)["status"].alias("status"))


@query("P04_job_snapshot_stream", "SELECT * FROM fx_job_snapshot")
def _(t):
    """The last row of every job after three micro-batches in mixed order."""
    totals = live.replay(jobs_live.job_totals(in_batches(t, _counted_events(t), F.col("event_id") % 3)), _scratch(t))
    newest = F.max_by(F.struct("total_files", "completed_files", "total_pages", "completed_pages"), "version")
    return totals.groupBy("job_id").agg(newest.alias("s")).select("job_id", "s.*")


def _counted_events(t):
    """Every event but a seal is an update of its file."""
    events = _status_events(t)
    processing = F.when(F.col("kind") != "sealed", F.coalesce("status", F.lit("processing")))
    return events.withColumn("status", processing)


@query("P05_page_rate_stream", "SELECT job_id, round(rate, 9) AS rate FROM fx_page_rate")
def _(t):
    events = _status_events(t)
    rates = live.replay(live.page_rate(in_batches(t, events, F.col("event_id") % 3)), _scratch(t), "update")
    last = rates.groupBy("job_id").agg(F.max(F.struct("batch_id", "rate"))["rate"].alias("rate"))
    return last.select("job_id", F.round("rate", 9).alias("rate"))


@query("P09_autoseal", """
    SELECT job_id FROM fx_progress WHERE kind <> 'sealed' OR page = 0
    GROUP BY job_id HAVING count(*) FILTER (kind = 'sealed') = 0
    AND epoch_us(TIMESTAMP '2024-01-30 22:00:00') - max(epoch_us(ts)) > 1800 * 1000000""")
def _(t):
    """Only seals of a first page count, so some jobs are still open."""
    events = fx.progress_events(t).filter((F.col("kind") != "sealed") | (F.col("page") == 0))
    return p.autoseal(events, F.lit("2024-01-30 22:00:00").cast("timestamp")).select("job_id")


@query("P10_drop_cancelled", """
    SELECT event_id, e.job_id, kind FROM fx_progress e LEFT JOIN (
        SELECT job_id, min(ts) AS stop FROM fx_progress WHERE kind = 'sealed' AND filename = 'f0.pdf' GROUP BY job_id) c
    ON e.job_id = c.job_id WHERE stop IS NULL OR e.ts < stop""")
def _(t):
    """A seal of the first file stands for the cancellation."""
    events = fx.progress_events(t)
    cancels = events.filter((F.col("kind") == "sealed") & (F.col("filename") == "f0.pdf")).select("job_id", "ts")
    return p.drop_cancelled(events, cancels).select("event_id", "job_id", "kind")


@query("P10_drop_cancelled_stream", """
    SELECT event_id, e.job_id, kind FROM fx_progress e LEFT JOIN (
        SELECT job_id, min(ts) AS stop FROM fx_progress WHERE kind = 'sealed' AND filename = 'f0.pdf' GROUP BY job_id) c
    ON e.job_id = c.job_id WHERE stop IS NULL OR e.ts < stop""")
def _(t):
    """Cancellations and events together, in three micro-batches by time."""
    events = fx.progress_events(t)
    cancels = events.filter((F.col("kind") == "sealed") & (F.col("filename") == "f0.pdf")).withColumn("kind", F.lit(jobs_live.CANCELLED))
    both = events.unionByName(cancels)
    passed = live.replay(jobs_live.drop_cancelled(in_batches(t, both, _by_time(F.col("ts")))), _scratch(t))
    return passed.select("event_id", "job_id", "kind")


_ARRIVAL = ["ts", "tie1", "tie2", "offset", "length"]
fx.SQL["fx_arrivals"] = """
    SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ts, tie1, tie2, "offset", length) AS arrival FROM fx_upload_chunks"""
fx.SQL["fx_ledger"] = """
    SELECT file_id, arrival, "offset" = 0 AND length <= 16777216 AND length <= size AS accepted,
           CASE WHEN "offset" = 0 AND length <= 16777216 AND length <= size THEN length ELSE 0 END AS received
    FROM fx_arrivals WHERE arrival = 1
    UNION ALL
    SELECT a.file_id, a.arrival,
           CASE WHEN l.received >= a.size THEN a."offset" >= a.size ELSE a."offset" = l.received AND a.length <= 16777216 AND a."offset" + a.length <= a.size END,
           CASE WHEN l.received < a.size AND a."offset" = l.received AND a.length <= 16777216 AND a."offset" + a.length <= a.size
                THEN l.received + a.length ELSE l.received END
    FROM fx_ledger l JOIN fx_arrivals a ON a.file_id = l.file_id AND a.arrival = l.arrival + 1"""


@query("P11_upload_ledger", """
    SELECT l.file_id, a."offset", a.length, accepted, received, received >= a.size AS complete
    FROM fx_ledger l JOIN fx_arrivals a ON l.file_id = a.file_id AND l.arrival = a.arrival""", recursive=True)
def _(t):
    """Every chunk's verdict."""
    return p.upload_ledger(fx.upload_chunks(t), _ARRIVAL).select("file_id", "offset", "length", "accepted", "received", "complete")


@query("P11_upload_ledger_stream", "SELECT file_id, arrival, accepted, received FROM fx_ledger", recursive=True)
def _(t):
    order = Window.partitionBy("file_id").orderBy(*_ARRIVAL)
    chunks = fx.upload_chunks(t).withColumn("arrival", F.row_number().over(order).cast("long"))
    # Arrivals 1-2, 3-4 and the rest are three micro-batches.
    step = F.least(F.floor((F.col("arrival") - 1) / 2), F.lit(2))
    stream = in_batches(t, chunks.select("file_id", "arrival", "offset", "length", "size"), step)
    return live.replay(live.upload_ledger(stream), _scratch(t))


@query("P12_upload_speed", """
    SELECT upload_id, round(arg_max(speed, t), 6) AS bytes_per_second,
           round(arg_max(CASE WHEN speed > 0 THEN (total - sent) / speed END, t), 6) AS eta_seconds
    FROM (SELECT *, (sent - b.sent_0) / CAST(t - b.t_0 AS DOUBLE) AS speed FROM (
        SELECT *, coalesce(min({'t_0': t, 'sent_0': sent}) OVER (PARTITION BY upload_id ORDER BY t RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING),
                           lag({'t_0': t, 'sent_0': sent}) OVER (PARTITION BY upload_id ORDER BY t)) AS b
        FROM (SELECT upload_id, t, max(sent) AS sent, max(total) AS total FROM fx_upload_samples GROUP BY 1, 2) o) q
    WHERE t - b.t_0 >= 2) r GROUP BY upload_id""")
def _(t):
    return p.upload_speed(fx.upload_samples(t)).select(
        "upload_id", F.round("bytes_per_second", 6).alias("bytes_per_second"), F.round("eta_seconds", 6).alias("eta_seconds")
    )


@query("P12_upload_speed_stream", """
    SELECT upload_id, round(arg_max(speed, t), 6) AS bytes_per_second,
           round(arg_max(CASE WHEN speed > 0 THEN (total - sent) / speed END, t), 6) AS eta_seconds
    FROM (SELECT *, (sent - b.sent_0) / CAST(t - b.t_0 AS DOUBLE) AS speed FROM (
        SELECT *, coalesce(min({'t_0': t, 'sent_0': sent}) OVER (PARTITION BY upload_id ORDER BY t RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING),
                           lag({'t_0': t, 'sent_0': sent}) OVER (PARTITION BY upload_id ORDER BY t)) AS b
        FROM (SELECT upload_id, t, max(sent) AS sent, max(total) AS total FROM fx_upload_samples GROUP BY 1, 2) o) q
    WHERE t - b.t_0 >= 2) r GROUP BY upload_id""")
def _(t):
    """Samples in three micro-batches by time; the last value of each upload."""
    step = _by_time(F.timestamp_seconds(F.col("t") * 100))
    speeds = live.replay(jobs_live.upload_speed(in_batches(t, fx.upload_samples(t), step)), _scratch(t))
    newest = F.max_by(F.struct("bytes_per_second", "eta_seconds"), "t")
    return speeds.groupBy("upload_id").agg(newest.alias("s")).select(
        "upload_id", *[F.round(f"s.{c}", 6).alias(c) for c in ("bytes_per_second", "eta_seconds")])


fx.SQL["fx_items"] = """
    SELECT upload_id, ord, CASE ord % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'invalid' WHEN 2 THEN 'retrying' WHEN 3 THEN 'uploading'
        WHEN 4 THEN 'queued' ELSE 'done' END AS status FROM fx_manifest"""


def _items(t):
    names = ["failed", "invalid", "retrying", "uploading", "queued", "done", "done"]
    status = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("ord") % 7 + 1).cast("int"))
    return fx.upload_manifest(t).select("upload_id", "ord", status.alias("status"))


@query("P13_upload_order", """
    SELECT upload_id, ord, status, CAST(CASE status WHEN 'failed' THEN 0 WHEN 'invalid' THEN 1 WHEN 'retrying' THEN 2
        WHEN 'uploading' THEN 3 WHEN 'queued' THEN 4 ELSE 5 END AS INT) AS status_rank,
        row_number() OVER (PARTITION BY upload_id ORDER BY CASE status WHEN 'failed' THEN 0 WHEN 'invalid' THEN 1 WHEN 'retrying' THEN 2
        WHEN 'uploading' THEN 3 WHEN 'queued' THEN 4 ELSE 5 END, ord) AS position FROM fx_items""")
def _(t):
    return p.upload_order(_items(t))


@query("P13_upload_counts", """
    SELECT upload_id, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'invalid') AS invalid,
           count(*) FILTER (status = 'retrying') AS retrying, count(*) FILTER (status = 'uploading') AS uploading,
           count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'done') AS done FROM fx_items GROUP BY upload_id""")
def _(t):
    return p.upload_counts(_items(t))


@query("P14_stale_keys", """
    SELECT job_id FROM fx_page_events GROUP BY job_id
    HAVING epoch_us(TIMESTAMP '2000-01-01 00:00:00') - max(epoch_us(ts)) > 7 * 86400 * CAST(1000000 AS BIGINT)""")
def _(t):
    return p.stale_keys(fx.page_events(t), F.lit("2000-01-01 00:00:00").cast("timestamp")).select("job_id")


@query("P14_stale_state", """
    SELECT job_id, epoch_us(max(ts)) AS touched_us FROM fx_progress GROUP BY job_id
    HAVING epoch_us(TIMESTAMP '2024-02-06 12:00:00') - max(epoch_us(ts)) > 7 * 86400 * CAST(1000000 AS BIGINT)""")
def _(t):
    """Runs the live totals and asks their state which jobs have expired."""
    path = _scratch(t)
    live.replay(jobs_live.job_totals(in_batches(t, _counted_events(t), F.col("event_id") % 3)), path)
    now = F.lit("2024-02-06 12:00:00").cast("timestamp")
    stale = jobs_live.stale_keys(live.stream_session(t.spark), f"{path}/state", now)
    return stale.select("job_id", F.unix_micros("touched").alias("touched_us"))
