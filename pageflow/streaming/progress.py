"""Structured Streaming: dedupe, progress, sticky status, completion, idle sealing, ledger.

State of files and jobs is kept by shards of keys (``shards``). Ahead of the exchange to the
per-job operator, each Arrow batch is reduced to the last update of every file and one activity
row a job, so a job with most of the traffic sends about as many rows as it has files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pageflow import rules
from pageflow.operators.progress import FILE, PAGE_EVENT, TERMINAL, next_ledger_state, with_chunk_numbers
from pageflow.session import tune
from pageflow.streaming.shards import SHARDS, TTL_MS, Held, restored, shard_of, whole


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application set up for keyed state: RocksDB, one partition per core."""
    session = tune(spark.newSession())
    session.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    session.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return session


def read_events(
    spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def dedupe_events(events: DataFrame, delay: str = f"{rules.STATE_TTL_DAYS} days") -> DataFrame:
    """Each page or file event once. Keys are remembered for ``delay``, by default as long as all
    live state; only an event more than that behind the newest one is too late."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(PAGE_EVENT)


def dedupe_events_forever(events: DataFrame) -> DataFrame:
    """The exact form: every key is remembered."""
    return events.dropDuplicates(PAGE_EVENT)


def file_progress(events: DataFrame) -> DataFrame:
    """Pages done per file so far (update mode), from deduplicated events."""
    return events.filter(F.col("kind") == "page_done").groupBy(*FILE).agg(F.count("*").alias("done"))


# ---- sticky file status ----------------------------------------------------------------

FILE_KEY = [T.StructField("job_id", T.LongType()), T.StructField("filename", T.StringType())]
UPDATE = [T.StructField("terminal", T.BooleanType()), T.StructField("us", T.LongType()),
          T.StructField("event_id", T.LongType()), T.StructField("status", T.StringType())]
STATUS_CHANGE = T.StructType([*FILE_KEY, *[UPDATE[i] for i in (3, 1, 2)]])


def _combined(batches: Iterator[pd.DataFrame], keys: list[str], order: list[str], keep: int = 1) -> Iterator[pd.DataFrame]:
    """Map-side combine: of every Arrow batch only the last ``keep`` rows per key go on."""
    for batch in batches:
        yield batch.sort_values(order).groupby(keys, sort=False, dropna=False).tail(keep)


class StickyStatus(StatefulProcessor):
    """Key shard: of each of its files, once ``done`` or ``failed``, later ``processing`` updates are ignored.

    The greatest (terminal, time, id) wins, so arrival order does not matter and a file's state is one row.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = Held(handle, "best", FILE_KEY, UPDATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        best = self.best.read(now)
        before = {}
        for batch in rows:
            for job, filename, us, event_id, status in zip(*[batch[c].tolist() for c in (*FILE, "us", "event_id", "status")]):
                file, candidate = (job, filename), (status in TERMINAL, us, event_id, status)
                known = best.get(file)
                before.setdefault(file, known and known[3])
                best[file] = (*(candidate if known is None or candidate > known[:4] else known[:4]), now)
        self.best.write(best)
        changes = [(*file, best[file][3], *best[file][1:3]) for file, old in before.items() if best[file][3] != old]
        yield pd.DataFrame(changes, columns=STATUS_CHANGE.fieldNames())

    def close(self) -> None:
        pass


def sticky_status(updates: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Status per file whenever a micro-batch changes it, from ``updates(job_id, filename, status, ts, event_id)``."""
    slim = updates.withColumn("us", F.unix_micros("ts")).select(
        whole("job_id"), "filename", "status", whole("event_id"), whole("us")
    ).withColumn("terminal", F.col("status").isin(*TERMINAL))
    reduced = slim.mapInPandas(lambda it: _combined(it, FILE, ["terminal", "us", "event_id"]), slim.schema)
    changes = reduced.withColumn("shard", shard_of(*FILE, shards=shards)).groupBy("shard").transformWithStateInPandas(
        statefulProcessor=StickyStatus(), outputStructType=STATUS_CHANGE, outputMode="append", timeMode="ProcessingTime"
    )
    return changes.withColumn("us", restored("us")).select(
        restored("job_id"), "filename", "status", F.timestamp_micros("us").alias("ts"), restored("event_id"))


# ---- job completion --------------------------------------------------------------------

COMPLETION = T.StructType(
    [
        T.StructField("job_id", T.LongType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("auto_sealed", T.BooleanType()),
    ]
)


class JobCompletion(StatefulProcessor):
    """Key shard: announces each job's outcome once, when the job is sealed and every file has settled.

    Kinds: ``file_added``, ``status`` (with ``status``), ``sealed``, ``cancelled``; others only show
    activity. A job's state is three counters (files, unsettled, failed), the flags, and per file the
    update that counts: the greatest (terminal, time, id), so neither a late event nor the order
    inside a micro-batch matters. The outcome is read from the counters after each micro-batch. A
    job without events for ``idle_seconds`` of wall clock is sealed with what it has: its time is
    in its state, and the shard's one timer is the earliest of its jobs. After a cancellation or
    the announcement everything is ignored; seven idle days later the state goes.
    """

    def __init__(self, idle_seconds: int = rules.IDLE_SECONDS):
        self.idle_ms = idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        job = [T.StructField(n, T.BooleanType()) for n in ("sealed", "auto", "closed")]
        job += [T.StructField(n, T.LongType()) for n in ("files", "unsettled", "failed", "due_ms")]
        self.jobs = Held(handle, "jobs", FILE_KEY[:1], job, ttl_ms=None)
        self.files = Held(handle, "files", FILE_KEY, UPDATE, ttl_ms=None)

    @staticmethod
    def _count(held: tuple | None, update: tuple, counts: list[int]) -> tuple:
        """One file update: ``counts`` are files, unsettled, failed. Returns the update that counts."""
        if held is not None and update <= held:
            return held
        if held is None:
            counts[0] += 1
        else:
            counts[1] -= not held[0]
            counts[2] -= held[3] == "failed"
        counts[1] += not update[0]
        counts[2] += update[3] == "failed"
        return update

    def _settle(self, jobs: dict, files: dict, now_ms: int, touched: dict[tuple, list]) -> pd.DataFrame:
        """Stores the shard, sets its timer and announces what is final of ``touched``: sealed, auto, closed, counts."""
        rows = []
        for job, (sealed, auto, closed, counts) in touched.items():
            total, unsettled, failed = counts
            if sealed and not closed and not unsettled:
                error = None if failed < total else rules.ALL_FAILED_ERROR if total else rules.NO_FILES_ERROR
                rows.append((*job, "FAILED" if error else "SUCCESS", error, auto))
                closed = True
            due = now_ms + (TTL_MS if sealed or closed else self.idle_ms)
            jobs[job] = (sealed, auto, closed, *counts, due, now_ms)
        self.jobs.write(jobs)
        self.files.write({f: u for f, u in files.items() if f[:1] in jobs and not jobs[f[:1]][2]})
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if jobs:
            self.handle.registerTimer(min(job[6] for job in jobs.values()))
        return pd.DataFrame(rows, columns=COMPLETION.fieldNames())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        jobs, files, touched = self.jobs.read(now), self.files.read(now), {}
        for batch in rows:
            columns = ("job_id", "kind", "filename", "status", "us", "event_id")
            for job_id, kind, filename, status, us, event_id in zip(*[batch[c].tolist() for c in columns]):
                job, file = (job_id,), (job_id, filename)
                if job not in touched:
                    sealed, auto, closed, *counts = jobs.get(job, (False, False, False, 0, 0, 0))[:6]
                    touched[job] = [sealed, auto, closed, counts]
                state = touched[job]
                if state[2] or kind == "cancelled":
                    state[2] = True
                elif kind == "sealed":
                    state[0] = True
                elif kind in ("status", "file_added"):
                    update = (status in TERMINAL, us, event_id, status) if kind == "status" else (False, -1, -1, "queued")
                    held = files.get(file)
                    files[file] = (*self._count(held and held[:4], update, state[3]), now)
        yield self._settle(jobs, files, now, touched)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, at = timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs()
        jobs, files, idle = self.jobs.read(now), self.files.read(now), {}
        for job, (sealed, _, closed, *counts, due, _) in list(jobs.items()):
            if due <= at or due < now:
                if sealed or closed:
                    del jobs[job]
                else:
                    idle[job] = [True, True, False, counts]
        yield self._settle(jobs, files, now, idle)

    def close(self) -> None:
        pass


JOB_KINDS = ("file_added", "status", "sealed", "cancelled")


def job_signals(events: DataFrame) -> DataFrame:
    """What the per-job operator needs, reduced per Arrow batch ahead of the exchange: the update
    that counts of every file, one row for each other decisive kind, one activity row per job. A
    hot job's traffic shrinks to about its files."""

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.assign(kind=batch["kind"].where(batch["kind"].isin(JOB_KINDS), "activity"))
            terminal = batch["status"].isin(TERMINAL)
            order = batch.assign(_terminal=terminal).sort_values(["_terminal", "us", "event_id"]).drop(columns="_terminal")
            per_file = order["kind"].isin(("file_added", "status"))
            files = order[per_file].groupby(["job_id", "kind", "filename"], sort=False, dropna=False).tail(1)
            others = order[~per_file].groupby(["job_id", "kind"], sort=False, dropna=False).tail(1)
            yield pd.concat([files, others])

    columns = events.withColumn("us", F.unix_micros("ts")).select(
        whole("job_id"), "kind", "filename", "status", whole("us"), whole("event_id"))
    return columns.mapInPandas(reduce, columns.schema)


def job_completion(events: DataFrame, idle_seconds: int = rules.IDLE_SECONDS, shards: int = SHARDS) -> DataFrame:
    """Completions from ``events(job_id, kind, filename, status, ts, event_id)``, append mode.

    No event is too late: there is no watermark, and idleness is wall clock.
    """
    done = job_signals(events).withColumn("shard", shard_of("job_id", shards=shards)).groupBy("shard").transformWithStateInPandas(
        statefulProcessor=JobCompletion(idle_seconds), outputStructType=COMPLETION,
        outputMode="append", timeMode="ProcessingTime",
    )
    return done.withColumn("job_id", restored("job_id"))


# ---- rolling rate ----------------------------------------------------------------------

RATE = T.StructType([T.StructField("job_id", T.LongType()), T.StructField("rate", T.DoubleType())])


class PageRate(StatefulProcessor):
    """Key job: pages per second over the last 30 completions, one row per update."""

    def __init__(self, n: int = rules.RATE_WINDOW):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", T.StructType([T.StructField("us", T.LongType())]), TTL_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stamps = [r[0] for r in self.recent.get()]
        for batch in rows:
            # Trimmed per Arrow batch: at most n + one batch of numbers is held.
            stamps = sorted(stamps + [int(v) for v in batch["us"]])[-self.n:]
        self.recent.put([(s,) for s in stamps])
        span = (stamps[-1] - stamps[0]) / 1e6
        yield pd.DataFrame([(int(key[0]), (len(stamps) - 1) / span if span > 0 else 0.0)], columns=RATE.fieldNames())

    def close(self) -> None:
        pass


def page_rate(events: DataFrame) -> DataFrame:
    """Rolling rate per job after every micro-batch (update mode)."""
    done = events.filter(F.col("kind") == "page_done").select("job_id", F.unix_micros("ts").alias("us"))
    recent = done.mapInPandas(lambda it: _combined(it, ["job_id"], ["us"], rules.RATE_WINDOW), done.schema)
    return recent.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=PageRate(), outputStructType=RATE, outputMode="update", timeMode="ProcessingTime"
    )


# ---- upload ledger ---------------------------------------------------------------------

LEDGER = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("arrival", T.LongType()),
        T.StructField("accepted", T.BooleanType()),
        T.StructField("received", T.LongType()),
    ]
)


class UploadLedger(StatefulProcessor):
    """Key shard: the bytes received so far of each of its files decide about the file's every next chunk."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.received = Held(handle, "received", LEDGER.fields[:1], LEDGER.fields[3:])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        received = self.received.read(now)
        # Five numbers a chunk of one micro-batch and shard: the rule needs them in arrival order.
        order = ["file_id", "arrival", "chunk_offset", "chunk_length", "chunk_size"]
        chunks = pd.concat(list(rows))[order].sort_values(order)
        accepted, reached = [], []
        current, so_far = None, 0
        for file_id, _, offset, length, size in zip(*[chunks[c].tolist() for c in order]):
            if file_id != current:
                current, so_far = file_id, received.get((file_id,), (0,))[0]
            ok, so_far = next_ledger_state(so_far, offset, length, size)
            accepted.append(ok)
            reached.append(so_far)
            received[(file_id,)] = (so_far, now)
        self.received.write(received)
        yield chunks[order[:2]].assign(accepted=accepted, received=reached)

    def close(self) -> None:
        pass


def upload_ledger(chunks: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Verdicts for ``chunks(file_id, arrival, offset, length, size)`` as they arrive."""
    known = with_chunk_numbers(chunks.filter("file_id is not null")).select(
        "file_id", "arrival", "chunk_offset", "chunk_length", "chunk_size", shard_of("file_id", shards=shards).alias("shard"))
    return known.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=UploadLedger(), outputStructType=LEDGER, outputMode="append", timeMode="ProcessingTime"
    )


# ---- running a stream over what is stored ----------------------------------------------

def replay(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run the stream over everything available into parquet below ``path`` and read it back.

    Update-mode streams are stored batch by batch with their ``batch_id``. Empty batches are
    off: state with a processing-time TTL would ask for another one for ever.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    out, state = f"{path}/out", f"{path}/state"
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", out).start()
    else:

        def store(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/b={batch_id}")

        query = writer.outputMode(mode).foreachBatch(store).start()
    query.awaitTermination()
    schema = stream.schema if mode == "append" else T.StructType([*stream.schema.fields, T.StructField("batch_id", T.IntegerType())])
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
