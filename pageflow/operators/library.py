"""Library questions: folders, files, history, dashboard, bundles, retention.

``user``-scoped operators take the user as a parameter; those computed for all users at once
say so. Availability is an equi join with the storage inventory on the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageflow import rules
from pageflow.functions.text import is_pdf, plural, strip, underscored
from pageflow.operators.jobs import job_filenames, rotated_breakdown
from pageflow.operators.ranking import first_k, positions, running_total


def session_of(path: Column, root: str = "/store") -> Column:
    """Session id of an output path ``{root}/{session}/output...``; null elsewhere.

    Turns the "path starts with the session's output folder" test into an equi join key.
    """
    found = F.regexp_extract(path, "^" + root.rstrip("/") + "/([^/]+)/output", 1)
    return F.when(found != "", found)


def with_available(files: DataFrame, inventory: DataFrame) -> DataFrame:
    seen = inventory.select(F.col("path").alias("file_path")).distinct().withColumn("_seen", F.lit(True))
    return (
        files.join(seen, "file_path", "left")
        .withColumn("available", F.coalesce("_seen", F.lit(False)))
        .drop("_seen")
    )


def available_files(files: DataFrame, inventory: DataFrame) -> DataFrame:
    return files.join(inventory.select(F.col("path").alias("file_path")), "file_path", "left_semi")


# ---- folders and files -----------------------------------------------------------------

def folder_list(folders: DataFrame, files: DataFrame, user: int | None = None) -> DataFrame:
    """Folders with their file counts, empty ones included."""
    own = folders if user is None else folders.filter(F.col("user_id") == user)
    counts = files.filter(F.col("folder_id").isNotNull()).groupBy("folder_id").agg(F.count("*").alias("file_count"))
    return own.join(counts, "folder_id", "left").fillna(0, ["file_count"])


def folder_total(listing: DataFrame) -> DataFrame:
    return listing.groupBy("user_id").agg(F.sum("file_count").alias("files"), F.count("*").alias("folders"))


def newest_first(df: DataFrame, group: list[str], key: str) -> DataFrame:
    """Adds each row's ``position`` in its group, newest ``created_at`` first (rows without one
    last), from counts per group and day."""
    last = F.lit(1 << 62)
    stamped = df.withColumns(
        {"_day": F.coalesce(-F.floor(F.unix_seconds("created_at") / 86400), last), "_age": F.coalesce(-F.unix_micros("created_at"), last)}
    )
    return positions(stamped, group, ["_day"], ["_age", key], "position").drop("_day", "_age")


def folder_files(
    files: DataFrame, folders: DataFrame, inventory: DataFrame, user: int | None = None, folder: int | None = None
) -> DataFrame:
    """Files of every folder (of one owner, or one folder), placed newest first, with availability."""
    own = folders if user is None else folders.filter(F.col("user_id") == user)
    if folder is not None:
        own, files = own.filter(F.col("folder_id") == folder), files.filter(F.col("folder_id") == folder)
    listed = files.join(own.select("folder_id"), "folder_id", "left_semi")
    return newest_first(with_available(listed, inventory), ["folder_id"], "file_id")


def folder_jobs(jobs: DataFrame, user: int | None = None, folder: int | None = None, every: bool = False) -> DataFrame:
    """Jobs of a folder (``None``: without folder; ``every``: each folder by itself), of one user or
    of each user, placed newest first."""
    own = jobs if user is None else jobs.filter(F.col("user_id") == user)
    if not every:
        own = own.filter(F.col("folder_id").isNull() if folder is None else F.col("folder_id") == folder)
    return newest_first(own, ["user_id", "folder_id"], "job_id")


def unfiled(files: DataFrame, inventory: DataFrame, user: int | None = None) -> DataFrame:
    """Files without folder, of one user or of each, placed newest first."""
    listed = files.filter(F.col("folder_id").isNull())
    listed = listed.filter(F.col("user_id").isNotNull() if user is None else F.col("user_id") == user)
    return newest_first(with_available(listed, inventory), ["user_id"], "file_id")


def _with_owner(files: DataFrame, folders: DataFrame) -> DataFrame:
    owners = folders.select("folder_id", F.col("user_id").alias("folder_owner"))
    return files.join(owners, "folder_id", "left")


def accessible_files(files: DataFrame, folders: DataFrame, user: int | None = None) -> DataFrame:
    """Single-file rule: a filed file belongs to its folder's owner, an unfiled one to its own user.

    For one user, or for all with the user in ``reader``; files nobody may read are left out.
    """
    owner = F.when(F.col("folder_id").isNotNull(), F.col("folder_owner")).otherwise(F.col("user_id"))
    allowed = _with_owner(files, folders).withColumn("reader", owner).drop("folder_owner")
    return allowed.filter("reader is not null") if user is None else allowed.filter(F.col("reader") == user)


def deletable_files(files: DataFrame, folders: DataFrame, ids: DataFrame, user: int) -> DataFrame:
    """Batch rule, wider than the single one: folder owner *or* file user. ``ids`` has ``file_id``."""
    allowed = (F.col("folder_owner") == user) | (F.col("user_id") == user)
    wanted = files.join(ids.select("file_id"), "file_id", "left_semi")
    return _with_owner(wanted, folders).filter(allowed).drop("folder_owner")


def drop_files(files: DataFrame, doomed: DataFrame) -> DataFrame:
    return files.join(doomed.select("file_id"), "file_id", "left_anti")


def drop_folders(
    folders: DataFrame, files: DataFrame, ids: DataFrame, user: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(folders, files, dropped folders) after deleting the user's own among ``ids``.

    Files go with their folder; jobs keep a folder id that then leads nowhere.
    """
    doomed = folders.filter(F.col("user_id") == user).join(ids.select("folder_id"), "folder_id", "left_semi")
    gone = doomed.select("folder_id")
    return (
        folders.join(gone, "folder_id", "left_anti"),
        files.join(gone, "folder_id", "left_anti"),
        doomed,
    )


def put_folder(folders: DataFrame, name: str, user: int, folder: int | None = None) -> DataFrame:
    """Rename a folder the user owns, or add a new one when ``folder`` is None."""
    if folder is not None:
        mine = (F.col("folder_id") == folder) & (F.col("user_id") == user)
        return folders.withColumn("name", F.when(mine, F.lit(name)).otherwise(F.col("name")))
    added = folders.agg((F.coalesce(F.max("folder_id"), F.lit(0)) + 1).alias("folder_id")).select(
        F.col("folder_id"), F.lit(user).cast("long").alias("user_id"), F.lit(name).alias("name"),
        F.current_timestamp().alias("created_at"),
    )
    return folders.unionByName(added)


# ---- moving ----------------------------------------------------------------------------

def move_jobs(
    jobs: DataFrame, files: DataFrame, folders: DataFrame, moves: DataFrame, root: str = "/store"
) -> tuple[DataFrame, DataFrame]:
    """(jobs, files) after ``moves(job_id, user_id, target)``; a null target unfiles.

    A move counts when the job is the user's and the target is null or their own folder. Files
    under the job's output folder follow.
    """
    owned = folders.select(F.col("folder_id").alias("target"), F.col("user_id").alias("user_id"))
    legal = moves.filter(F.col("target").isNull()).unionByName(
        moves.filter(F.col("target").isNotNull()).join(owned, ["target", "user_id"], "left_semi")
    )
    # A job named twice goes to one place: the greatest target, and no folder only if none is named.
    once = legal.groupBy("job_id", "user_id").agg(F.max("target").alias("target"))
    ok = once.join(jobs.select("job_id", "user_id", "session_id"), ["job_id", "user_id"])
    to_job = ok.select("job_id", F.col("target").alias("_target"), F.lit(True).alias("_moved"))
    pick = F.when(F.col("_moved"), F.col("_target")).otherwise(F.col("folder_id"))
    moved_jobs = jobs.join(to_job, "job_id", "left").withColumn("folder_id", pick).drop("_target", "_moved")
    to_files = ok.filter(F.col("session_id").isNotNull()).select(
        F.col("session_id").alias("_session"), F.col("target").alias("_target"), F.lit(True).alias("_moved")
    )
    moved_files = (
        files.withColumn("_session", session_of(F.col("file_path"), root))
        .join(to_files, "_session", "left")
        .withColumn("folder_id", pick)
        .drop("_session", "_target", "_moved")
    )
    return moved_jobs, moved_files


def move_legacy(files: DataFrame, outputs: DataFrame, moves: DataFrame) -> DataFrame:
    """Files after moving jobs that have no session.

    ``moves(job_id, user_id, target, output_folder)``; every file below the output folder is
    replaced by a fresh listing ``outputs(output_folder, filename)`` when there is a target.
    The prefix test is an equi join on the path's ancestor folders.
    """
    parts = F.split("file_path", "/")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda n: F.array_join(F.slice(parts, 1, n), "/"),
    )
    below = (
        files.filter(F.col("file_path").isNotNull())
        .select("file_id", F.explode(ancestors).alias("output_folder"))
        .join(moves.select("output_folder").distinct(), "output_folder", "left_semi")
        .select("file_id").distinct()
    )
    kept = files.join(below, "file_id", "left_anti")
    listed = outputs.join(moves.filter(F.col("target").isNotNull()), "output_folder").select(
        F.col("target").alias("folder_id"), "user_id", "filename",
        F.concat_ws("/", "output_folder", "filename").alias("file_path"),
    )
    return kept.unionByName(listed, allowMissingColumns=True)


def discard_upload(
    jobs: DataFrame, files: DataFrame, uploads: DataFrame, root: str = "/store"
) -> tuple[DataFrame, DataFrame]:
    """(jobs, files) without the discarded ``uploads(session_id, user_id)`` of their owners."""
    gone = jobs.join(uploads, ["session_id", "user_id"], "left_semi").select("job_id", "session_id")
    left_files = files.withColumn("session_id", session_of(F.col("file_path"), root)).join(
        gone.select("session_id"), "session_id", "left_anti"
    )
    return jobs.join(gone.select("job_id"), "job_id", "left_anti"), left_files.drop("session_id")


# ---- bundles ---------------------------------------------------------------------------

def folder_bundle(folders: DataFrame, files: DataFrame, inventory: DataFrame) -> DataFrame:
    """Archive members of every folder: path, name inside, archive name."""
    names = folders.select("folder_id", F.col("name").alias("folder_name"))
    return available_files(files, inventory).join(names, "folder_id").select(
        "folder_id", "file_path", F.col("filename").alias("arcname"),
        underscored(F.concat("folder_name", F.lit("_all_files.zip"))).alias("bundle"),
    )


def bulk_bundle(
    requests: DataFrame, jobs: DataFrame, outputs: DataFrame, folders: DataFrame, files: DataFrame,
    inventory: DataFrame,
) -> DataFrame:
    """Members of archives over several jobs and folders.

    ``requests(request_id, user_id, task_ids, folder_ids)`` hold comma lists: blanks drop, folder
    ids that are no numbers drop, repeats stay. ``outputs(job_id, file_path, filename)``.
    """
    items = lambda col: F.explode(F.filter(F.transform(F.split(col, ","), strip), lambda x: x != ""))
    tasks = requests.select("request_id", "user_id", items("task_ids").alias("task_id"))
    done = jobs.filter(F.col("status") == "SUCCESS").select("task_id", "user_id", "job_id")
    from_jobs = tasks.join(done, ["task_id", "user_id"]).join(outputs, "job_id").select(
        "request_id", "file_path",
        F.concat(F.lit("job_"), F.substring("task_id", 1, 8), F.lit("/"), F.col("filename")).alias("arcname"),
    )
    wanted = requests.select("request_id", "user_id", items("folder_ids").alias("f")).filter(
        F.col("f").rlike(r"^\d+$") & F.col("f").try_cast("long").isNotNull()
    )
    owned = folders.select("folder_id", "user_id", F.col("name").alias("folder_name"))
    from_folders = (
        wanted.select("request_id", "user_id", F.col("f").try_cast("long").alias("folder_id"))
        .join(owned, ["folder_id", "user_id"])
        .join(available_files(files, inventory).select("folder_id", "file_path", "filename"), "folder_id")
        .select(
            "request_id", "file_path",
            F.concat(F.lit("folder_"), F.col("folder_name"), F.lit("/"), F.col("filename")).alias("arcname"),
        )
    )
    return from_jobs.unionByName(from_folders)


def job_bundle(outputs: DataFrame) -> DataFrame:
    """What a job's download is: its only PDF, or an archive of all."""
    pdfs = outputs.filter(is_pdf(F.col("filename")))
    return pdfs.groupBy("job_id", "task_id").agg(F.count("*").alias("files"), F.min("filename").alias("only")).select(
        "job_id", "files",
        F.when(F.col("files") == 1, F.col("only")).otherwise(F.concat("task_id", F.lit(".zip"))).alias("download"),
    )


def merge_plan(files: DataFrame, folders: DataFrame, inventory: DataFrame, slices: tuple[int, ...] = (60,)) -> DataFrame:
    """Per folder with at least two available PDFs: merge order, first page of each in the result.

    Start pages are running sums over slices of upload time, coarse to fine (``slices`` in
    seconds, each a multiple of the next), then over files. A folder's PDFs are counted by the
    same totals.
    """
    pdfs = available_files(files, inventory).filter(is_pdf(F.col("file_path")))
    names = folders.select("folder_id", underscored(F.concat(F.lit("Merged_"), F.col("name"), F.lit(".pdf"))).alias("merged_name"))
    levels = {f"_slice{n}": F.floor(F.unix_seconds("created_at") / n).cast("long") for n in slices}
    filed = pdfs.filter(F.col("folder_id").isNotNull())
    placed = running_total(filed, ["folder_id"], levels, ["created_at", "file_id"], "pages", "start_page", least=2)
    return placed.join(names, "folder_id")


def merged_files(plan: DataFrame, folders: DataFrame, root: str = "/store") -> DataFrame:
    """The new file row of every merged folder: its name, place, owner, pages and sources."""
    owners = folders.select("folder_id", "user_id")
    merged = plan.groupBy("folder_id", F.col("merged_name").alias("filename")).agg(
        F.sum("pages").cast("long").alias("pages"), F.count("*").alias("sources")
    )
    return merged.join(owners, "folder_id").withColumn("file_path", F.concat(F.lit(f"{root}/"), "filename"))


# ---- dashboard and history -------------------------------------------------------------

def latest_jobs(jobs: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest jobs of every user."""
    return first_k(jobs, ["user_id"], [F.desc("created_at"), F.col("job_id")], n, "recency")


def dashboard(jobs: DataFrame, folders: DataFrame, results: DataFrame) -> DataFrame:
    """One row per user with jobs: totals over all jobs, turned pages over the latest 50."""
    won = F.col("status") == "SUCCESS"
    totals = jobs.groupBy("user_id").agg(
        F.count("*").alias("total_jobs"), F.count_if(won).alias("successful_jobs"),
        F.coalesce(F.sum(F.when(won, F.col("total_files"))), F.lit(0)).alias("total_files"),
        F.coalesce(F.sum(F.when(won, F.col("total_pages"))), F.lit(0)).alias("total_pages"),
    )
    latest = latest_jobs(jobs, rules.DASHBOARD_JOBS).filter(won)
    # Results shrink to those jobs before they are counted.
    counted = rotated_breakdown(results.join(latest.select("job_id"), "job_id", "left_semi"))
    pages = (
        latest.join(counted, "job_id")
        .groupBy("user_id")
        .agg(F.sum("pages_rotated").alias("pages_rotated"), F.sum("pages_unchanged").alias("pages_unchanged"))
    )
    shelves = folders.groupBy("user_id").agg(F.count("*").alias("folder_count"))
    return (
        totals.join(pages, "user_id", "left").join(shelves, "user_id", "left")
        .fillna(0, ["pages_rotated", "pages_unchanged", "folder_count"])
    )


def recent_jobs(jobs: DataFrame, results: DataFrame, n: int = rules.RECENT_JOBS) -> DataFrame:
    """The ``n`` newest jobs of every user, one row per file name (a null name when there is none)."""
    top = latest_jobs(jobs, n)
    won = top.filter(F.col("status") == "SUCCESS").select("job_id")
    return top.join(job_filenames(results.join(won, "job_id", "left_semi")), "job_id", "left")


def name_preview(results: DataFrame) -> DataFrame:
    """Per job: up to three file names in order and how many there are; a bounded stand-in for the list."""
    names = job_filenames(results)
    counts = names.groupBy("job_id").agg(F.count("*").alias("result_files"))
    first = first_k(names, ["job_id"], ["filename"], 3, "_rank").groupBy("job_id").agg(
        F.array_join(F.sort_array(F.collect_list("filename")), ", ").alias("names")
    )
    more = F.col("result_files") - 3
    return counts.join(first, "job_id").select(
        "job_id", "result_files",
        F.when(more > 0, F.concat(F.col("names"), F.lit(" +"), more.cast("string"), F.lit(" more")))
        .otherwise(F.col("names")).alias("preview"),
    )


def fallback_preview(jobs: DataFrame) -> Column:
    """Text for a job without file names."""
    return F.concat(
        plural(F.coalesce("total_files", F.lit(0)), "file"), F.lit(" - "), plural(F.coalesce("total_pages", F.lit(0)), "page")
    )


def history(jobs: DataFrame, folders: DataFrame, results: DataFrame, n: int = rules.HISTORY_JOBS) -> DataFrame:
    """The ``n`` newest jobs of every user with turned and kept pages and folder name, one row per
    file name (``filename``; null for a job without files).

    Results shrink to the listed jobs and are counted per file; the job's totals are sums over
    those counts, which both branches share.
    """
    top = latest_jobs(jobs, n)
    won = top.filter(F.col("status") == "SUCCESS").select("job_id")
    per_file = results.join(won, "job_id", "left_semi").groupBy("job_id", "filename").agg(
        F.count_if(F.col("angle") != 0).alias("turned"), F.count_if(F.col("angle") == 0).alias("kept")
    )
    totals = per_file.groupBy("job_id").agg(
        F.sum("turned").alias("pages_rotated"), F.sum("kept").alias("pages_unchanged"), F.count("*").alias("result_files")
    )
    listed = per_file.select("job_id", "filename").join(totals, "job_id")
    names = folders.select("folder_id", F.col("name").alias("folder_name"))
    return (
        top.join(listed, "job_id", "left").join(names, "folder_id", "left")
        .fillna(0, ["pages_rotated", "pages_unchanged", "result_files"])
    )


def drop_history(jobs: DataFrame, user: int, ids: DataFrame | None = None) -> DataFrame:
    """Jobs left after deleting the user's entries (those in ``ids(task_id)``, or all)."""
    if ids is None:
        return jobs.filter(F.coalesce(F.col("user_id") != user, F.lit(True)))
    gone = ids.select("task_id").withColumn("user_id", F.lit(user).cast("long"))
    return jobs.join(gone, ["task_id", "user_id"], "left_anti")


# ---- storage and names -----------------------------------------------------------------

def expired(inventory: DataFrame, now: Column) -> DataFrame:
    """Session folders and top-level archives last changed more than 24 hours before ``now``.

    ``inventory(path, is_dir, modificationTime)``, ``path`` relative to the storage root.
    """
    top_level = ~F.col("path").contains("/")
    kind = F.col("is_dir") | F.col("path").endswith(".zip")
    old = F.col("modificationTime") < now - F.expr(f"INTERVAL {rules.RETENTION_HOURS} HOURS")
    return inventory.filter(top_level & kind & old)


def search_files(files: DataFrame, text: str) -> DataFrame:
    """File name contains the trimmed text, case ignored; blank text keeps everything."""
    wanted = text.strip().lower()
    return files.filter(F.contains(F.lower("filename"), F.lit(wanted))) if wanted else files


def compare_budget(files: DataFrame) -> DataFrame:
    """Pages shown for comparison: at most 20 a file and 40 a job, files by name.

    Every listed file shows a page or more, so only a job's first 40 files matter.
    """
    seen = files.filter(F.col("pages") > 0).withColumn(
        "_take", F.least(F.col("pages"), F.lit(rules.COMPARE_PAGES_PER_FILE))
    )
    few = first_k(seen, ["job_id"], ["filename"], rules.COMPARE_PAGES_PER_JOB, "_rank")
    before = Window.partitionBy("job_id").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(rules.COMPARE_PAGES_PER_JOB) - F.coalesce(F.sum("_take").over(before), F.lit(0))
    return (
        few.withColumn("shown", F.least(F.col("_take"), left).cast("int"))
        .filter(F.col("shown") > 0).drop("_take", "_rank")
    )
