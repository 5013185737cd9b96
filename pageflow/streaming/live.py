"""Structured Streaming over a job's life: cancellation, live totals by chained operators, expiry, upload speed.

State is kept by shards of keys (``shards``): a cancellation is known to a fixed number of shards
for its job, totals are counted per file and only changes of a file go on to its job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pageflow import rules
from pageflow.operators.progress import FILE, TERMINAL
from pageflow.streaming.progress import FILE_KEY, UPDATE
from pageflow.streaming.shards import NONE, SHARDS, TTL_MS, Held, restored, shard_of, whole

JOB_SHARDS = 32
CANCELLED = "cancelled"


# ---- cancellation ----------------------------------------------------------------------

class CancelGate(StatefulProcessor):
    """Key shard: passes events from before their job's first cancellation.

    Rows of one micro-batch are held until its cancellations are known, so their order inside
    it does not matter.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stop = Held(handle, "stop", FILE_KEY[:1], [T.StructField("us", T.LongType())])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, held = timerValues.getCurrentProcessingTimeInMs(), []
        stop = self.stop.read(now)
        touched = set()
        for batch in rows:
            cancel = batch["kind"] == CANCELLED
            for job, us in zip(batch.loc[cancel, "job_id"].tolist(), batch.loc[cancel, "us"].tolist()):
                if us != NONE:
                    stop[(job,)] = (min(us, stop[(job,)][0]) if (job,) in stop else us, now)
            events = batch[~cancel].drop(columns="shard")
            touched.update(events["job_id"].tolist())
            held.append(events)
        # A job's flag lives on as long as the job is heard of.
        stop.update({(job,): (stop[(job,)][0], now) for job in touched if (job,) in stop})
        self.stop.write(stop)
        for events in held:
            passes = [(job,) not in stop or NONE < us < stop[(job,)][0] for job, us in zip(events["job_id"].tolist(), events["us"].tolist())]
            yield events[passes]

    def close(self) -> None:
        pass


def drop_cancelled(events: DataFrame, shards: int = JOB_SHARDS, of: int = SHARDS) -> DataFrame:
    """A stream's events without those at or after their job's cancellation, append mode.

    ``events`` has ``job_id, kind, filename, ts`` and more; a row of kind ``cancelled`` cancels
    its job from its ``ts`` on and is not passed on itself. A late event from before the
    cancellation passes; an event that came in an earlier micro-batch than the cancellation has
    passed. The flag lives seven days. A job's files are spread over ``shards`` of all the ``of``
    shards, each of which receives the cancellation, so one job's traffic is shared by many tasks.
    """
    slim = events.withColumn("us", F.unix_micros("ts")).drop("ts").withColumns({c: whole(c) for c in ("job_id", "us")})
    part = lambda n: shard_of("job_id", n, shards=of)
    own = F.array(part(F.pmod(F.xxhash64("filename"), F.lit(shards)).cast("int")))
    every = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), part))
    keyed = slim.withColumn("shard", F.explode(F.when(F.col("kind") == CANCELLED, every).otherwise(own)))
    passed = keyed.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=CancelGate(), outputStructType=slim.schema, outputMode="append", timeMode="ProcessingTime")
    back = passed.withColumns({c: restored(c) for c in ("job_id", "us")})
    return back.withColumn("ts", F.timestamp_micros("us")).select(*events.columns)


# ---- live totals -----------------------------------------------------------------------

COUNTS = ("files", "completed_files", "pages", "completed_pages")
FILE_CHANGE = T.StructType([*FILE_KEY, T.StructField("us", T.LongType()), *[T.StructField(c, T.LongType()) for c in COUNTS]])
JOB_TOTALS = T.StructType(
    [T.StructField("job_id", T.LongType()), T.StructField("total_files", T.LongType()), T.StructField("completed_files", T.LongType()),
     T.StructField("total_pages", T.LongType()), T.StructField("completed_pages", T.LongType()), T.StructField("version", T.LongType())])


class FileTotals(StatefulProcessor):
    """Key shard: counts each finished page of its files once, keeps their sticky status, and reports
    by how much a file changes its job's totals."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        page = T.StructField("page", T.LongType())
        self.counted = Held(handle, "counted", FILE_KEY, [T.StructField(n, T.LongType()) for n in ("pages", "done", "completed")])
        self.best = Held(handle, "best", FILE_KEY, UPDATE)
        # Pages seen, one element a micro-batch: a page is remembered from its first time on.
        columns = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in (*FILE_KEY, page)])
        self.seen = handle.getListState("seen", columns, TTL_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        counted, best = self.counted.read(now), self.best.read(now)
        seen = {page for columns in self.seen.get() for page in zip(*columns)}
        fresh, touched = {}, {}
        for batch in rows:
            columns = (*FILE, "kind", "page", "status", "us", "event_id")
            for job, filename, kind, page, status, us, event_id in zip(*[batch[c].tolist() for c in columns]):
                file = (job, filename)
                if file not in touched:
                    known = counted.get(file)
                    before = (1, int(file in best and best[file][0]), known[0], known[2]) if known else (0, 0, 0, 0)
                    touched[file] = [before, *(known or (0, 0))[:2], 0]
                state = touched[file]
                state[1], state[3] = max(state[1], page), max(state[3], us)
                if kind == "page_done" and page != NONE and (*file, page) not in seen and (*file, page) not in fresh:
                    fresh[(*file, page)] = None
                    state[2] += 1
                if status is not None:
                    update, held = (status in TERMINAL, us, event_id, status), best.get(file)
                    best[file] = (*(update if held is None or update > held[:4] else held[:4]), now)
        changes = []
        for file, (before, pages, done, last) in touched.items():
            if file in best:
                best[file] = (*best[file][:4], now)
            terminal, status = (best[file][0], best[file][3]) if file in best else (False, None)
            shown = pages if status == "done" else min(done, pages)
            counted[file] = (pages, done, shown, now)
            changes.append((*file, last, *[a - b for a, b in zip((1, int(terminal), pages, shown), before)]))
        self.counted.write(counted)
        self.best.write(best)
        if fresh:
            self.seen.appendList([tuple([list(c) for c in zip(*fresh)])])
        yield pd.DataFrame(changes, columns=FILE_CHANGE.fieldNames())

    def close(self) -> None:
        pass


class JobTotals(StatefulProcessor):
    """Key shard: each job's totals from the changes of its files. One row per change, the greatest ``version`` is the newest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [*COUNTS, "version", "touched_us"]
        self.totals = Held(handle, "totals", FILE_KEY[:1], [T.StructField(n, T.LongType()) for n in fields], ttl_ms=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        totals, changed = self.totals.read(now), {}
        for batch in rows:
            for job_id, us, *change in zip(*[batch[c].tolist() for c in ("job_id", "us", *COUNTS)]):
                job = (job_id,)
                *sums, version, touched, _ = totals.get(job, (0,) * (len(COUNTS) + 3))
                changed.setdefault(job, version + 1)
                totals[job] = (*[s + c for s, c in zip(sums, change)], changed[job], max(touched, us), now)
        self.totals.write(totals)
        yield pd.DataFrame([(*job, *totals[job][: len(COUNTS) + 1]) for job in changed], columns=JOB_TOTALS.fieldNames())

    def close(self) -> None:
        pass


def _reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per Arrow batch: each finished page once with its last update, each other kind's last update of a file."""
    for batch in batches:
        batch = batch.assign(_terminal=batch["status"].isin(TERMINAL)).sort_values(["_terminal", "us", "event_id"])
        top = batch.groupby(FILE, sort=False, dropna=False)["page"].transform("max")
        keep = ~batch.duplicated([*FILE, "kind", "page"], keep="last") & (
            (batch["kind"] == "page_done") | (batch["page"] == top) | ~batch.duplicated([*FILE, "kind"], keep="last"))
        yield batch[keep].drop(columns="_terminal")


def job_totals(events: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Live totals per job from one query of two chained operators, append mode.

    ``events(event_id, job_id, ts, kind, filename, page, status)``; ``status`` is null where an
    event says nothing about its file, ``page`` the greatest page number known of it. Redelivered
    pages count once, a terminal status is final, files that are done count all their pages.
    """
    slim = events.withColumn("us", F.unix_micros("ts")).select(
        whole("job_id"), "filename", "kind", whole("page"), "status", whole("event_id"), whole("us"))
    files = slim.mapInPandas(_reduced, slim.schema).withColumn("shard", shard_of(*FILE, shards=shards))
    changes = files.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=FileTotals(), outputStructType=FILE_CHANGE, outputMode="append", timeMode="ProcessingTime")
    totals = changes.withColumn("shard", shard_of("job_id", shards=shards)).groupBy("shard").transformWithStateInPandas(
        statefulProcessor=JobTotals(), outputStructType=JOB_TOTALS, outputMode="append", timeMode="ProcessingTime")
    return totals.withColumn("job_id", restored("job_id"))


def live_jobs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a :func:`job_totals` query holds about every job, read from its state: totals and ``touched``."""
    # The per-job operator is the last one of the plan, so it is numbered first.
    state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "totals").load(checkpoint)
    columns = [F.col(f"value.{c}") for c in ("job_id", *COUNTS, "touched_us")]
    totals = state.select(F.explode(F.arrays_zip(*columns)).alias("t")).select("t.*")
    return totals.select(
        restored("job_id"), F.col("files").alias("total_files"), "completed_files", F.col("pages").alias("total_pages"),
        "completed_pages", F.timestamp_micros("touched_us").alias("touched"))


def stale_keys(spark: SparkSession, checkpoint: str, now: Column, days: int = rules.STATE_TTL_DAYS) -> DataFrame:
    """Jobs in a running query's state that nothing has touched for more than ``days``."""
    return live_jobs(spark, checkpoint).filter(
        F.unix_micros(now) - F.unix_micros("touched") > days * 86_400_000_000).select("job_id", "touched")


# ---- upload speed ----------------------------------------------------------------------

SPEED = T.StructType(
    [T.StructField("upload_id", T.LongType()), T.StructField("t", T.LongType()),
     T.StructField("bytes_per_second", T.DoubleType()), T.StructField("eta_seconds", T.DoubleType())])


class UploadSpeed(StatefulProcessor):
    """Key upload: the samples of the last ten seconds (and the one before), and the last speed.

    A sample is compared with the oldest of its last ten seconds, else with the one before it;
    where that spans under two seconds the last speed stays. Samples older than what is held are
    too late and ignored.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        sample = [T.StructField(n, T.LongType()) for n in ("t", "sent", "total")]
        self.recent = handle.getListState("recent", T.StructType(sample), TTL_MS)
        self.last = handle.getValueState("last", T.StructType([T.StructField("t", T.LongType()), *SPEED.fields[2:]]), TTL_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        span, held = rules.SPEED_WINDOW_SECONDS, {}
        for t, sent, total in self.recent.get():
            held[t] = (sent, total)
        oldest = min(held) if held else None
        fresh = set()
        for batch in rows:
            for t, sent, total in zip(batch["t"].tolist(), batch["sent"].tolist(), batch["total"].tolist()):
                if oldest is None or t >= oldest:
                    old = held.get(t, (sent, total))
                    held[t] = (max(sent, old[0]), max(total, old[1]))
                    fresh.add(t)
        known = self.last.get()
        last = tuple(known) if known else None
        times, begin = sorted(held), 0
        for i, t in enumerate(times):
            while times[begin] < t - span:
                begin += 1
            base = times[begin] if times[begin] < t else times[i - 1] if i else t
            # A late sample may have changed what later ones are compared with.
            if t >= min(fresh, default=t + 1) and t - base >= rules.SPEED_MIN_SPAN_SECONDS:
                sent, total = held[t]
                speed = (sent - held[base][0]) / (t - base)
                last = (t, speed, (total - sent) / speed if speed > 0 else None)
        kept = [t for t in times if t >= times[-1] - span]
        kept = times[max(0, len(times) - len(kept) - 1):]
        self.recent.put([(t, *held[t]) for t in kept])
        if last:
            self.last.update(last)
        out = [(int(key[0]), *last)] if last else []
        yield pd.DataFrame(out, columns=SPEED.fieldNames()).astype({"bytes_per_second": "float64", "eta_seconds": "float64"})

    def close(self) -> None:
        pass


def upload_speed(samples: DataFrame) -> DataFrame:
    """Bytes per second and time left of each upload after every micro-batch, from
    ``samples(upload_id, t, sent, total)`` in whole seconds; the row with the greatest ``t`` is the newest."""
    whole = samples.select(*[F.col(c).cast("long").alias(c) for c in ("upload_id", "t", "sent", "total")])

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby(["upload_id", "t"], as_index=False).max()

    return whole.mapInPandas(reduce, whole.schema).groupBy("upload_id").transformWithStateInPandas(
        statefulProcessor=UploadSpeed(), outputStructType=SPEED, outputMode="append", timeMode="ProcessingTime")
