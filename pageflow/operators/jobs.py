"""From pages to files to jobs: first results, completeness, totals and outcomes.

Facts are always aggregated to the key of the next join first, so both join sides are
unique on it and a hot job or file never meets its duplicates in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageflow import rules
from pageflow.operators.orientation import score_map
from pageflow.operators.ranking import BLOCK_PAGES, first_k, page_block
from pageflow.schemas import PAGE_DETAIL

KEYS = ["job_id", "filename", "page"]
FILE = ["job_id", "filename"]


def first_result(results: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """A stored page is never analysed again: the first arrival of each key wins."""
    return first_k(results, keys, arrival, 1, "_arrival").drop("_arrival")


def expand_pages(files: DataFrame) -> DataFrame:
    """One row per page 0..pages-1; files with unknown or non-positive page counts give none.

    Files become blocks of pages first; blocks are spread before they become pages, so a very
    long file is not expanded by one task.
    """
    known = files.filter(F.col("pages") > 0)
    last_block = page_block(F.col("pages") - 1)
    blocks = known.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last_block)))
    first = F.col("_block") * BLOCK_PAGES
    last = F.least(first + BLOCK_PAGES, F.col("pages").cast("long")) - 1
    return (
        blocks.repartition(F.xxhash64(*files.columns, "_block"))
        .withColumn("page", F.explode(F.sequence(first.cast("int"), last.cast("int")))).drop("_block")
    )


def pending_pages(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Pages without a stored result yet."""
    return pages.join(results.select(*KEYS), KEYS, "left_anti")


def complete_files(files: DataFrame, results: DataFrame) -> DataFrame:
    """Files whose every page 0..pages-1 has a result.

    A file may be listed more than once (adding it again changes nothing); each of its rows is
    returned. One pass over the results: pages in range are kept by their file's page count, and
    distinct ones counted per block of 4096 and then per file.
    """
    known = files.filter(F.col("pages") > 0)
    listed = known.select(*FILE, F.col("pages").alias("_due")).distinct()
    held = (
        results.select(*FILE, "page").join(listed, FILE)
        .filter((F.col("page") >= 0) & (F.col("page") < F.col("_due")))
        .groupBy(*FILE, "_due", page_block(F.col("page")).alias("_block")).agg(F.count_distinct("page").alias("_held"))
    )
    full = held.groupBy(*FILE, F.col("_due").alias("pages")).agg(F.sum("_held").alias("_held"))
    return known.join(full.filter(F.col("_held") == F.col("pages")), [*FILE, "pages"], "left_semi")


def assemble_files(files: DataFrame, results: DataFrame) -> DataFrame:
    """Summaries of complete files: ``page_rotations`` and ``page_details`` keyed by page number text.

    A summary is split into blocks of 4096 pages (``block``), so one row stays bounded however
    long the file is; a reader takes the union of a file's blocks.
    """
    # Listed twice with different page counts, both of them held: the longer one.
    done = complete_files(files, results).groupBy(*FILE).agg(F.max("pages").alias("pages"))
    key = F.col("page").cast("string")
    detail = F.struct(*[f.name for f in PAGE_DETAIL.fields])
    # Pages that were not scored (declared or unreadable) carry no scores.
    scored = score_map(results).withColumn(
        "scores", F.when(F.col("method") == "universal_recognizer", F.col("scores"))
        .otherwise(F.create_map().cast("map<string,double>"))
    )
    in_range = scored.join(done, FILE).filter((F.col("page") >= 0) & (F.col("page") < F.col("pages")))
    blocks = in_range.groupBy(*FILE, page_block(F.col("page")).alias("block")).agg(
        F.array_sort(
            F.collect_list(F.struct("page", key.alias("key"), F.col("angle"), detail.alias("detail"))),
            lambda a, b: a["page"] - b["page"],
        ).alias("rows")
    )
    entries = lambda field: F.map_from_entries(
        F.transform("rows", lambda r: F.struct(r["key"], r[field]))
    )
    return blocks.select(
        *FILE, "block",
        entries("angle").alias("page_rotations"), entries("detail").alias("page_details"),
    )


def job_totals(added: DataFrame) -> DataFrame:
    """Files and pages per job; adding a file again changes nothing."""
    once = added.groupBy(*FILE).agg(F.min(F.struct("ts", "pages"))["pages"].alias("pages"))
    return once.groupBy("job_id").agg(
        F.count("*").alias("total_files"), F.sum("pages").cast("long").alias("total_pages")
    )


def job_result(summaries: DataFrame) -> DataFrame:
    """Files and pages processed, over finished files only."""
    per_file = summaries.groupBy(*FILE).agg(F.sum(F.size("page_rotations")).alias("pages"))
    return per_file.groupBy("job_id").agg(
        F.count("*").alias("files_processed"), F.sum("pages").cast("long").alias("pages_processed")
    )


def job_outcome(jobs: DataFrame, file_status: DataFrame) -> DataFrame:
    """Outcome of every sealed, uncancelled, running job; null ``outcome`` means still open."""
    counts = file_status.groupBy("job_id").agg(
        F.count("*").alias("files"),
        F.count_if(F.col("file_status").isin("done", "failed")).alias("settled"),
        F.count_if(F.col("file_status") == "failed").alias("failed"),
    )
    live = jobs.filter(F.col("sealed") & ~F.col("cancelled") & (F.col("status") == "PROCESSING"))
    joined = live.join(counts, "job_id", "left").fillna(0, ["files", "settled", "failed"])
    empty = F.col("files") == 0
    is_open = F.col("settled") < F.col("files")
    all_failed = F.col("failed") == F.col("files")
    return joined.select(
        "job_id",
        F.when(empty, "FAILED").when(is_open, None).when(all_failed, "FAILED").otherwise("SUCCESS")
        .alias("outcome"),
        F.when(empty, rules.NO_FILES_ERROR).when(is_open, None).when(all_failed, rules.ALL_FAILED_ERROR)
        .alias("error"),
    )


def refresh_status(jobs: DataFrame, live: DataFrame, disk: DataFrame, legacy: DataFrame, now: Column) -> DataFrame:
    """Running jobs brought up to date: live state first, then saved results, then a legacy task.

    ``live(job_id, live_status, live_error)``, ``disk(job_id)``, ``legacy(job_id, legacy_status,
    legacy_error)``, each unique on the job. A job that ends now is completed at ``now``; others
    keep their ``completed_at``.
    """
    finished = ["SUCCESS", "FAILED"]
    joined = (
        jobs.join(live.withColumn("_live", F.lit(True)), "job_id", "left")
        .join(disk.withColumn("_disk", F.lit(True)), "job_id", "left")
        .join(legacy, "job_id", "left")
    )
    running = F.col("status") == "PROCESSING"
    on_disk = F.col("_disk") & F.col("session_id").isNotNull()
    new_status = (
        F.when(~running, F.col("status"))
        .when(F.col("_live"), F.when(F.col("live_status").isin(finished), F.col("live_status")).otherwise(F.col("status")))
        .when(on_disk, "SUCCESS")
        .when(F.col("legacy_status").isin(finished), F.col("legacy_status"))
        .otherwise(F.col("status"))
    )
    error = (
        F.when(~running, None)
        .when(F.col("_live"), F.when(F.col("live_status") == "FAILED", F.col("live_error")))
        .when(on_disk, None)
        .when(F.col("legacy_status") == "FAILED", F.col("legacy_error"))
    )
    ended = running & new_status.isin(finished)
    before = F.col("completed_at") if "completed_at" in jobs.columns else F.lit(None).cast("timestamp")
    return joined.withColumns(
        {"new_status": new_status, "new_error": error, "completed_at": F.when(ended, now).otherwise(before)}
    ).drop(
        "_live", "_disk", "live_status", "live_error", "legacy_status", "legacy_error"
    )


def fail_missing(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """Registered files whose input is absent or has no pages."""
    seen = inventory.select(F.col("path").alias("file_path")).distinct().withColumn("_seen", F.lit(True))
    return (
        files.join(seen, "file_path", "left")
        .filter(F.col("_seen").isNull() | ~F.coalesce(F.col("pages") > 0, F.lit(False)))
        .drop("_seen")
        .withColumn("file_status", F.lit("failed"))
    )


def rotated_breakdown(results: DataFrame) -> DataFrame:
    """Per job: pages turned, pages left alone, files."""
    per_file = results.groupBy(*FILE).agg(
        F.count_if(F.col("angle") != 0).alias("turned"), F.count_if(F.col("angle") == 0).alias("kept")
    )
    return per_file.groupBy("job_id").agg(
        F.sum("turned").alias("pages_rotated"),
        F.sum("kept").alias("pages_unchanged"),
        F.count("*").alias("result_files"),
    )


def job_filenames(results: DataFrame) -> DataFrame:
    """File names per job in long form, one row each: a list column would be unbounded."""
    return results.select(*FILE).distinct()


def prefer_saved(saved: DataFrame, legacy: DataFrame, keys: list[str]) -> DataFrame:
    """One result shape for every reader; a job's saved copy hides its whole legacy copy."""
    jobs_saved = saved.select(*keys).distinct()
    return saved.unionByName(legacy.join(jobs_saved, keys, "left_anti"))


def committable_files(states: DataFrame, commits: DataFrame) -> DataFrame:
    """First commit of every upload: what it processes, or why it cannot.

    ``states(upload_id, filename, complete, invalid, pages)``, ``commits(upload_id, attempt)``.
    Later attempts receive the first one's stored answer, so only the first is listed.
    """
    usable = F.col("complete") & ~F.col("invalid")
    counts = states.groupBy("upload_id").agg(
        F.count_if(usable).alias("files"),
        F.coalesce(F.sum(F.when(usable, F.col("pages"))), F.lit(0)).cast("long").alias("pages"),
    )
    first = commits.groupBy("upload_id").agg(
        F.min("attempt").alias("attempt"), F.count("*").alias("attempts")
    )
    return (
        first.join(counts, "upload_id", "left")
        .fillna(0, ["files", "pages"])
        .withColumn("error", F.when(F.col("files") == 0, rules.NOTHING_TO_COMMIT))
    )
