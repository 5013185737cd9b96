"""Live progress over stored events: the batch twins of the streaming operators.

Everything is a per-key aggregate or a first-k window; the one sequential rule, the upload
ledger, is solved by pointer jumping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageflow import rules
from pageflow.operators.ranking import first_k, page_block, positions
from pageflow.steps import Steps, numbered

FILE = ["job_id", "filename"]
PAGE_EVENT = ["job_id", "kind", "filename", "page"]
TERMINAL = ("done", "failed")


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def dedupe_events(events: DataFrame) -> DataFrame:
    """A redelivered page or file event counts once: the earliest copy stays."""
    return first_k(events, PAGE_EVENT, ["ts", "event_id"], 1, "_copy").drop("_copy")


def file_progress(events: DataFrame) -> DataFrame:
    """Pages done per file; copies are collapsed per page before they are counted."""
    done = events.filter(F.col("kind") == "page_done")
    return done.groupBy(*FILE).agg(F.count_distinct("page").alias("done"))


def sticky_status(updates: DataFrame) -> DataFrame:
    """Current status per file: the last ``done``/``failed`` if there was one, else the last update.

    ``updates(job_id, filename, status, ts, event_id)``.
    """
    order = F.struct(F.col("status").isin(*TERMINAL).cast("int"), "ts", "event_id")
    return updates.groupBy(*FILE).agg(F.max(F.struct(order.alias("o"), "status"))["status"].alias("status"))


def file_snapshot(files: DataFrame, done: DataFrame, status: DataFrame) -> DataFrame:
    """Per file: completed pages and the label the user sees. Inputs are unique on the file."""
    joined = files.join(done, FILE, "left").join(status, FILE, "left")
    pages = F.col("pages")
    completed = F.when(F.col("status") == "done", pages).otherwise(F.least(F.coalesce("done", F.lit(0)), pages))
    shown = joined.withColumn("completed_pages", completed.cast("long"))
    label = (
        F.when(F.col("status").isin(*TERMINAL), F.col("status"))
        .when(
            F.col("completed_pages") > 0,
            F.concat(F.lit("processing ("), F.col("completed_pages").cast("string"), F.lit("/"), pages.cast("string"), F.lit(")")),
        )
        .otherwise("queued")
    )
    return shown.select(*FILE, "pages", "completed_pages", "status", label.alias("label"))


def job_snapshot(file_rows: DataFrame) -> DataFrame:
    """Per job totals over :func:`file_snapshot` rows."""
    return file_rows.groupBy("job_id").agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("label").isin(*TERMINAL)).alias("completed_files"),
        F.sum("pages").cast("long").alias("total_pages"),
        F.sum("completed_pages").cast("long").alias("completed_pages"),
    )


def page_rate(events: DataFrame, n: int = rules.RATE_WINDOW) -> DataFrame:
    """Pages per second over each job's last ``n`` completions; 0 without two distinct times.

    Older completions would include the model's warm-up, so they are left out.
    """
    done = events.filter(F.col("kind") == "page_done")
    recent = first_k(done, ["job_id"], [F.desc("ts"), F.desc("event_id")], n, "_age")
    span = seconds_between(F.min("ts"), F.max("ts"))
    return recent.groupBy("job_id").agg(
        F.when(span > 0, (F.count("*") - 1) / span).otherwise(0.0).alias("rate")
    )


def eta(snapshot: DataFrame, pipeline: bool = False) -> DataFrame:
    """Seconds left from ``total_pages``, ``completed_pages`` and ``rate``; halves round to even.

    ``pipeline`` reports 0 whenever nothing remains, also for a job without pages.
    """
    left = F.col("total_pages") - F.col("completed_pages")
    settled = (left == 0) if pipeline else (F.col("total_pages") > 0) & (left == 0)
    moving = (F.col("rate") > 0) & (left > 0)
    safe_rate = F.when(F.col("rate") > 0, F.col("rate"))
    return snapshot.withColumn(
        "eta_seconds", F.when(moving, F.bround(left / safe_rate).cast("long")).when(settled, F.lit(0).cast("long"))
    )


def cumulative_rate(events: DataFrame) -> DataFrame:
    """Completed pages over the time since the job's first event."""
    elapsed = seconds_between(F.min("ts"), F.max(F.when(F.col("kind") == "page_done", F.col("ts"))))
    pages = F.count_if(F.col("kind") == "page_done")
    return events.groupBy("job_id").agg(
        pages.alias("pages"), F.when(elapsed > 0, pages / elapsed).otherwise(0.0).alias("rate")
    )


def autoseal(events: DataFrame, now: Column, idle_seconds: int = rules.IDLE_SECONDS) -> DataFrame:
    """Jobs neither sealed nor cancelled whose last event is more than 30 minutes before ``now``."""
    state = events.groupBy("job_id").agg(
        F.max("ts").alias("last_ts"), F.count_if(F.col("kind").isin("sealed", "cancelled")).alias("closed")
    )
    return state.filter((F.col("closed") == 0) & (seconds_between(F.col("last_ts"), now) > idle_seconds)).drop("closed")


def drop_cancelled(events: DataFrame, cancels: DataFrame) -> DataFrame:
    """Events up to their job's cancellation ``cancels(job_id, ts)``; later ones are ignored."""
    stop = cancels.groupBy("job_id").agg(F.min("ts").alias("_stop"))
    return (
        events.join(stop, "job_id", "left")
        .filter(F.col("_stop").isNull() | (F.col("ts") < F.col("_stop"))).drop("_stop")
    )


def stale_keys(events: DataFrame, now: Column, days: int = rules.STATE_TTL_DAYS) -> DataFrame:
    """Jobs whose live state expired: untouched for more than seven days."""
    last = events.groupBy("job_id").agg(F.max("ts").alias("last_ts"))
    return last.filter(seconds_between(F.col("last_ts"), now) > days * 86400)


def live_snapshot(jobs: DataFrame, totals: DataFrame, rates: DataFrame, now: Column) -> DataFrame:
    """The whole live answer of every job at ``now``: ``jobs(job_id, status, sealed, error, created)``
    with :func:`job_snapshot` totals, seconds since creation, pages a second and seconds left."""
    counts = ["total_files", "completed_files", "total_pages", "completed_pages"]
    joined = jobs.join(totals, "job_id", "left").join(rates, "job_id", "left").fillna(0, [*counts, "rate"])
    return eta(joined).select(
        "job_id", F.coalesce("status", F.lit("PROCESSING")).alias("status"), F.coalesce("sealed", F.lit(False)).alias("sealed"),
        "error", *counts, F.round(seconds_between(F.col("created"), now), 1).alias("elapsed_seconds"),
        F.round("rate", 3).alias("pages_per_second"), "eta_seconds",
    )


# ---- uploads ---------------------------------------------------------------------------

def next_ledger_state(received: int, offset: int, length: int, size: int) -> tuple[bool, int]:
    """One chunk against the bytes received so far: (accepted, bytes received afterwards)."""
    if received >= size:
        return offset >= size, received
    fits = offset == received and 0 <= length <= rules.MAX_CHUNK_BYTES and offset + length <= size
    return fits, received + length if fits else received


def with_chunk_numbers(chunks: DataFrame) -> DataFrame:
    """Adds ``chunk_offset, chunk_length, chunk_size`` without nulls: a chunk that lacks a number starts nowhere."""
    known = F.col("offset").isNotNull() & F.col("length").isNotNull() & F.col("size").isNotNull()
    return chunks.withColumns(
        {"chunk_offset": F.when(known, F.col("offset")).otherwise(-1), "chunk_length": F.coalesce("length", F.lit(0)),
         "chunk_size": F.coalesce("size", F.lit(0))}
    )


LEDGER_BLOCK = 4096


def _accepted_chain(steps: Steps, chunks: DataFrame) -> DataFrame:
    """``seq`` of every chunk that moves its file forward, by pointer jumping.

    ``chunks(seq, file_id, begin, end)`` are those that could. Each points to the first later one
    that begins where it ends; the accepted ones are the path from the file's first chunk at 0.
    A round follows pointers from what is marked and then doubles their reach, so a path of n
    chunks takes log2(n) rounds, whoever holds it.
    """
    block = F.floor(F.col("seq") / LEDGER_BLOCK).cast("long")
    place = ["file_id", "at", "block"]
    begins = chunks.select("file_id", F.col("begin").alias("at"), "seq", F.col("seq").alias("start"))
    ends = chunks.select("file_id", F.col("end").alias("at"), "seq", F.lit(None).cast("long").alias("start"))
    events = begins.unionByName(ends).withColumn("block", block)
    # The next start in the own block of arrivals, else the first one of the later blocks.
    after = Window.partitionBy(*place).orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    near = events.withColumn("near", F.min("start").over(after)).filter(F.col("start").isNull())
    firsts = events.groupBy(*place).agg(F.min("start").alias("first"))
    beyond = Window.partitionBy("file_id", "at").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    far = firsts.withColumn("far", F.min("first").over(beyond)).drop("first")
    links = near.join(far, place).select("seq", F.coalesce("near", "far").alias("next")).filter(F.col("next").isNotNull())
    links = steps.store(links)
    marked = steps.store(chunks.filter(F.col("begin") == 0).groupBy("file_id").agg(F.min("seq").alias("seq")).select("seq"))
    # Only what something points to can be on a path; repeats that nothing points to are left out.
    met = links.select(F.col("next").alias("seq")).distinct().unionByName(marked)
    jumps = steps.store(links.join(met, "seq", "left_semi"))
    steps.drop(links)
    while True:
        found = steps.store(marked.join(jumps, "seq").select(F.col("next").alias("seq")))
        if not found.limit(1).count():
            return marked
        marked = marked.unionByName(found)
        onward = jumps.select(F.col("seq").alias("next"), F.col("next").alias("beyond"))
        wider = steps.store(jumps.join(onward, "next").select("seq", F.col("beyond").alias("next")))
        steps.drop(jumps)
        jumps = wider


def upload_ledger(chunks: DataFrame, arrival: list[str]) -> DataFrame:
    """Every chunk with its verdict and where to resume, judged in arrival order.

    A chunk counts when it starts where the file ends, fits the declared size and the 16 MB
    limit; repeats after completion are harmless. Each verdict depends on the one before, but
    not on all rows in turn: the chunks that count are found by pointer jumping
    (:func:`_accepted_chain`), and what is received when a chunk arrives is the furthest end among
    those before it, from maxima per block of arrivals. So a file of any number of chunks spreads
    over all tasks. A chunk without file, offset, length or size or with a negative length is
    refused and changes nothing; chunks without file are one file's. Steps are stored below
    ``spark.checkpoint.dir``.
    """
    steps = Steps(chunks.sparkSession, "ledger")
    offset, length, size = (F.col(f"chunk_{n}") for n in ("offset", "length", "size"))
    rows = numbered(steps, with_chunk_numbers(chunks), ["file_id", *arrival], "seq")
    fits = F.col("file_id").isNotNull() & (offset >= 0) & (length >= 0) & (length <= rules.MAX_CHUNK_BYTES) & (offset + length <= size)
    chain = _accepted_chain(
        steps, rows.filter(fits & (length > 0)).select("seq", "file_id", offset.alias("begin"), (offset + length).alias("end")))
    counted = rows.join(chain.withColumn("counts", F.lit(True)), "seq", "left").withColumns(
        {"reach": F.when(F.col("counts"), offset + length), "block": F.floor(F.col("seq") / LEDGER_BLOCK).cast("long")})
    # A path's ends only grow, so the greatest one so far is what has been received.
    blocks = counted.groupBy("file_id", "block").agg(F.max("reach").alias("reach"))
    earlier = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(F.col("file_id").alias("of"), F.col("block").alias("in"), F.max("reach").over(earlier).alias("so_far"))
    inside = Window.partitionBy("file_id", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    held = F.greatest(F.coalesce("so_far", F.lit(0)), F.coalesce(F.max("reach").over(inside), F.lit(0)))
    known = counted.join(before, F.col("file_id").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in"))).withColumn("held", held)
    full, here = F.col("held") >= size, fits & (offset == F.col("held"))
    judged = known.withColumns(
        {"accepted": F.when(full, F.col("file_id").isNotNull() & (offset >= size)).otherwise(here),
         "received": F.when(~full & here, F.col("held") + length).otherwise(F.col("held")).cast("long")}
    ).withColumn("complete", F.col("received") >= size)
    return judged.select(*[F.col(f"`{c}`") for c in chunks.columns], "accepted", "received", "complete")


def upload_speed(samples: DataFrame) -> DataFrame:
    """Bytes per second and time left of each upload, from ``samples(upload_id, t, sent, total)``.

    A sample is compared with the oldest one of the last 10 seconds, or with the previous sample
    when those 10 seconds hold no other; spans under 2 seconds give no value and the last earlier
    one stays. Frames are computed in 10-second buckets (each sample also visits the next one),
    so an upload with very many samples spreads over its buckets.
    """
    span = rules.SPEED_WINDOW_SECONDS
    own = samples.groupBy("upload_id", "t").agg(F.max("sent").alias("sent"), F.max("total").alias("total"))
    own = own.withColumn("bucket", F.floor(F.col("t") / span).cast("long"))
    visits = own.withColumn("frame", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)))
    in_frame = Window.partitionBy("upload_id", "frame").orderBy("t").rangeBetween(-span, -1)
    oldest = visits.withColumn("first", F.min(F.struct("t", "sent")).over(in_frame)).filter(
        F.col("frame") == F.col("bucket")
    )
    # The sample before a bucket: last of the latest earlier bucket.
    tails = own.groupBy("upload_id", "bucket").agg(F.max(F.struct("t", "sent")).alias("tail"))
    before = tails.select(
        "upload_id", "bucket", F.lag("tail").over(Window.partitionBy("upload_id").orderBy("bucket")).alias("previous")
    )
    base = F.coalesce("first", "previous")
    timed = (
        oldest.join(before, ["upload_id", "bucket"])
        .withColumn("base", base)
        .withColumn("elapsed", F.col("t") - F.col("base.t"))
        .filter(F.col("elapsed") >= rules.SPEED_MIN_SPAN_SECONDS)
        .withColumn("speed", (F.col("sent") - F.col("base.sent")) / F.col("elapsed"))
    )
    last = timed.groupBy("upload_id").agg(F.max(F.struct("t", "speed", "sent", "total")).alias("s"))
    speed = F.col("s.speed")
    return last.select(
        "upload_id", speed.alias("bytes_per_second"),
        F.when(speed > 0, (F.col("s.total") - F.col("s.sent")) / F.when(speed > 0, speed)).alias("eta_seconds"),
    )


def status_rank(status: Column) -> Column:
    pairs = [F.lit(x) for item in rules.UPLOAD_STATUS_RANK.items() for x in item]
    return F.create_map(*pairs)[status]


def upload_order(items: DataFrame) -> DataFrame:
    """Upload items with their place in the list: trouble first, then work in flight, waiting, done.

    ``position`` comes from counts per upload, status and block of registrations.
    """
    ranked = items.withColumns({"status_rank": status_rank(F.col("status")), "_block": page_block(F.col("ord"))})
    return positions(ranked, ["upload_id"], ["status_rank", "_block"], ["ord"], "position").drop("_block")


def upload_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("upload_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in rules.UPLOAD_STATUS_RANK]
    )
