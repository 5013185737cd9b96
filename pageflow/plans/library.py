"""Library queries (L01..L25) over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageflow import fixtures as fx
from pageflow.functions.text import format_bytes, format_duration
from pageflow.operators import library as lib
from pageflow.plans.catalog import query

USER = 7

fx.SQL["fx_available"] = "SELECT f.* FROM fx_library_files f WHERE EXISTS (SELECT 1 FROM fx_inventory i WHERE i.path = f.file_path)"
fx.SQL["fx_folder_list"] = """
    SELECT d.folder_id, d.user_id, d.name, coalesce(n, 0) AS file_count FROM fx_folders d
    LEFT JOIN (SELECT folder_id, count(*) AS n FROM fx_library_files GROUP BY folder_id) c ON d.folder_id = c.folder_id"""
fx.SQL["fx_breakdown"] = """
    SELECT job_id, count(*) FILTER (angle <> 0) AS turned, count(*) FILTER (angle = 0) AS kept, count(DISTINCT filename) AS result_files
    FROM fx_results GROUP BY job_id"""
fx.SQL["fx_latest"] = """
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, job_id) AS recency FROM fx_jobs"""


@query("L01_folder_list", "SELECT * FROM fx_folder_list")
def _(t):
    return lib.folder_list(fx.folders(t), fx.file_table(t)).select("folder_id", "user_id", "name", "file_count")


@query("L01_folder_total", "SELECT user_id, CAST(sum(file_count) AS BIGINT) AS files, count(*) AS folders FROM fx_folder_list GROUP BY user_id")
def _(t):
    return lib.folder_total(lib.folder_list(fx.folders(t), fx.file_table(t)))


@query("L02_folder_files", f"""
    SELECT f.file_id, f.folder_id, f.filename, EXISTS (SELECT 1 FROM fx_inventory i WHERE i.path = f.file_path) AS available,
           row_number() OVER (PARTITION BY f.folder_id ORDER BY f.created_at DESC, f.file_id) AS position
    FROM fx_library_files f JOIN fx_folders d ON f.folder_id = d.folder_id""")
def _(t):
    return lib.folder_files(fx.file_table(t), fx.folders(t), fx.inventory(t)).select(
        "file_id", "folder_id", "filename", "available", "position"
    )


@query("L03_folder_jobs", """
    SELECT job_id, task_id, status, row_number() OVER (PARTITION BY user_id, folder_id ORDER BY created_at DESC, job_id) AS position FROM fx_jobs""")
def _(t):
    return lib.folder_jobs(fx.job_table(t), every=True).select("job_id", "task_id", "status", "position")


@query("L04_unfiled", f"""
    SELECT file_id, filename, EXISTS (SELECT 1 FROM fx_inventory i WHERE i.path = f.file_path) AS available,
           row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, file_id) AS position
    FROM fx_library_files f WHERE folder_id IS NULL AND user_id IS NOT NULL""")
def _(t):
    return lib.unfiled(fx.file_table(t), fx.inventory(t)).select("file_id", "filename", "available", "position")


@query("L05_accessible_files", f"""
    SELECT file_id, reader FROM (SELECT file_id, CASE WHEN f.folder_id IS NOT NULL THEN d.user_id ELSE f.user_id END AS reader
        FROM fx_library_files f LEFT JOIN fx_folders d ON f.folder_id = d.folder_id) q WHERE reader IS NOT NULL""")
def _(t):
    return lib.accessible_files(fx.file_table(t), fx.folders(t)).select("file_id", "reader")


fx.SQL["fx_deletable"] = f"""
    SELECT file_id FROM fx_library_files f LEFT JOIN fx_folders d ON f.folder_id = d.folder_id
    WHERE file_id IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000) AND (d.user_id = {USER} OR f.user_id = {USER})"""


def _deletable(t):
    ids = t["orders"].filter(F.col("o_totalprice") > 200000).select(F.col("o_orderkey").alias("file_id"))
    return lib.deletable_files(fx.file_table(t), fx.folders(t), ids, USER)


@query("L06_deletable_files", "SELECT file_id FROM fx_deletable")
def _(t):
    return _deletable(t).select("file_id")


@query("L07_drop_files", "SELECT file_id, filename FROM fx_library_files WHERE file_id NOT IN (SELECT file_id FROM fx_deletable)")
def _(t):
    return lib.drop_files(fx.file_table(t), _deletable(t)).select("file_id", "filename")


@query("L08_drop_folders", f"""
    SELECT 'folder' AS kind, folder_id AS id FROM fx_folders WHERE NOT (user_id = {USER} AND folder_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 4000))
    UNION ALL
    SELECT 'file', file_id FROM fx_library_files f WHERE NOT EXISTS (
        SELECT 1 FROM fx_folders d WHERE d.folder_id = f.folder_id AND d.user_id = {USER} AND d.folder_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 4000))""")
def _(t):
    ids = t["supplier"].filter(F.col("s_acctbal") > 4000).select(F.col("s_suppkey").alias("folder_id"))
    folders, files, _ = lib.drop_folders(fx.folders(t), fx.file_table(t), ids, USER)
    return folders.select(F.lit("folder").alias("kind"), F.col("folder_id").alias("id")).unionByName(
        files.select(F.lit("file").alias("kind"), F.col("file_id").alias("id"))
    )


@query("L09_put_folder", f"""
    SELECT folder_id, user_id, CASE WHEN folder_id = 5 AND user_id = 5 % 25 THEN 'Renamed' ELSE name END AS name FROM fx_folders
    UNION ALL SELECT max(folder_id) + 1, CAST({USER} AS BIGINT), 'New' FROM fx_folders""")
def _(t):
    renamed = lib.put_folder(fx.folders(t), "Renamed", 5, 5)
    return lib.put_folder(renamed, "New", USER).select("folder_id", "user_id", "name")


def _moves(t):
    key = F.col("job_id")
    jobs = fx.job_table(t).filter(F.col("status") == "SUCCESS")
    return jobs.select(
        "job_id", F.when(key % 5 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
        F.when(key % 2 == 0, key % 100).alias("target"),
    )


fx.SQL["fx_moves"] = """
    SELECT m.job_id, m.target, j.session_id FROM (
        SELECT job_id, CASE WHEN job_id % 5 = 0 THEN user_id + 1 ELSE user_id END AS user_id,
               CASE WHEN job_id % 2 = 0 THEN job_id % 100 END AS target FROM fx_jobs WHERE status = 'SUCCESS') m
    JOIN fx_jobs j ON m.job_id = j.job_id AND m.user_id = j.user_id
    WHERE m.target IS NULL OR EXISTS (SELECT 1 FROM fx_folders d WHERE d.folder_id = m.target AND d.user_id = m.user_id)"""


@query("L10_move_jobs", """
    SELECT 'job' AS kind, j.job_id AS id, CASE WHEN m.job_id IS NOT NULL THEN m.target ELSE j.folder_id END AS folder_id
    FROM fx_jobs j LEFT JOIN fx_moves m ON j.job_id = m.job_id
    UNION ALL
    SELECT 'file', f.file_id, CASE WHEN m.job_id IS NOT NULL THEN m.target ELSE f.folder_id END
    FROM fx_library_files f LEFT JOIN fx_moves m ON f.file_path LIKE '/store/' || m.session_id || '/output%'""")
def _(t):
    jobs, files = lib.move_jobs(fx.job_table(t), fx.file_table(t), fx.folders(t), _moves(t))
    return jobs.select(F.lit("job").alias("kind"), F.col("job_id").alias("id"), "folder_id").unionByName(
        files.select(F.lit("file").alias("kind"), F.col("file_id").alias("id"), "folder_id")
    )


@query("L11_move_legacy", """
    SELECT file_id, folder_id, filename, file_path FROM fx_library_files f
    WHERE file_path IS NULL OR regexp_extract(file_path, '^(/store/s\\d+/output)/', 1) NOT IN (
        SELECT '/store/s' || CAST(job_id AS VARCHAR) || '/output' FROM fx_jobs WHERE session_id IS NULL)
    UNION ALL
    SELECT NULL, folder_id, filename, '/store/s' || CAST(job_id AS VARCHAR) || '/output/' || filename FROM (
        SELECT j.job_id, j.folder_id, r.filename FROM fx_jobs j JOIN (SELECT DISTINCT job_id, filename FROM fx_page_events) r
        ON j.job_id = r.job_id WHERE j.session_id IS NULL AND j.folder_id IS NOT NULL) q""")
def _(t):
    folder = F.concat(F.lit("/store/s"), F.col("job_id").cast("string"), F.lit("/output"))
    legacy = fx.job_table(t).filter(F.col("session_id").isNull())
    moves = legacy.select("job_id", "user_id", F.col("folder_id").alias("target"), folder.alias("output_folder"))
    outputs = fx.page_events(t).select("job_id", "filename").distinct().select(folder.alias("output_folder"), "filename")
    return lib.move_legacy(fx.file_table(t), outputs, moves).select("file_id", "folder_id", "filename", "file_path")


@query("L12_folder_bundle", """
    SELECT a.folder_id, file_path, filename AS arcname, replace(name || '_all_files.zip', ' ', '_') AS bundle
    FROM fx_available a JOIN fx_folders d ON a.folder_id = d.folder_id""")
def _(t):
    return lib.folder_bundle(fx.folders(t), fx.file_table(t), fx.inventory(t))


fx.SQL["fx_outputs"] = """
    SELECT j.job_id, task_id, filename, '/store/' || session_id || '/output/' || filename AS file_path
    FROM fx_job_files f JOIN fx_jobs j ON f.job_id = j.job_id WHERE session_id IS NOT NULL"""


def _outputs(t):
    jobs = fx.job_table(t).filter(F.col("session_id").isNotNull()).select("job_id", "task_id", "session_id")
    return fx.job_files(t).select("job_id", "filename").join(jobs, "job_id").select(
        "job_id", "task_id", "filename", F.concat(F.lit("/store/"), "session_id", F.lit("/output/"), "filename").alias("file_path")
    )


@query("L13_bulk_bundle", """
    SELECT j.user_id AS request_id, f.file_path, 'job_' || left(f.task_id, 8) || '/' || f.filename AS arcname
    FROM nation u JOIN fx_jobs j ON j.user_id = u.n_nationkey AND j.status = 'SUCCESS' JOIN fx_outputs f ON f.job_id = j.job_id
    UNION ALL
    SELECT d.user_id, a.file_path, 'folder_' || d.name || '/' || a.filename FROM nation u
    JOIN fx_folders d ON d.user_id = u.n_nationkey JOIN fx_available a ON a.folder_id = d.folder_id""")
def _(t):
    """Every job and folder owner asks for each of theirs, one request row per thing asked for."""
    user = F.col("user_id")
    jobs = fx.job_table(t)
    requests = jobs.select(
        user.alias("request_id"), user, F.concat(F.lit(", "), "task_id", F.lit(" ,")).alias("task_ids"), F.lit("x1").alias("folder_ids")
    ).unionByName(
        fx.folders(t).select(
            user.alias("request_id"), user, F.lit(" ").alias("task_ids"),
            F.concat(F.lit("x, "), F.col("folder_id").cast("string"), F.lit(" ,")).alias("folder_ids"),
        )
    )
    outputs = _outputs(t).select("job_id", "file_path", "filename")
    return lib.bulk_bundle(requests, jobs, outputs, fx.folders(t), fx.file_table(t), fx.inventory(t))


@query("L14_job_bundle", """
    SELECT job_id, count(*) AS files, CASE WHEN count(*) = 1 THEN min(filename) ELSE task_id || '.zip' END AS download
    FROM fx_outputs GROUP BY job_id, task_id""")
def _(t):
    return lib.job_bundle(_outputs(t))


_MERGE = """
    SELECT a.file_id, a.folder_id, replace('Merged_' || name || '.pdf', ' ', '_') AS merged_name,
           CAST(coalesce(sum(pages) OVER (PARTITION BY a.folder_id ORDER BY a.created_at, file_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_page
    FROM fx_available a JOIN fx_folders d ON a.folder_id = d.folder_id
    JOIN (SELECT folder_id FROM fx_available WHERE folder_id IS NOT NULL GROUP BY folder_id HAVING count(*) >= 2) s ON s.folder_id = a.folder_id"""


@query("L15_merge_plan", _MERGE)
def _(t):
    return lib.merge_plan(fx.file_table(t), fx.folders(t), fx.inventory(t)).select(
        "file_id", "folder_id", "merged_name", "start_page"
    )


@query("L15_merge_plan_sliced", _MERGE)
def _(t):
    """The same over slices of a year, a day and a minute."""
    slices = (86400 * 365, 86400, 60)
    return lib.merge_plan(fx.file_table(t), fx.folders(t), fx.inventory(t), slices).select(
        "file_id", "folder_id", "merged_name", "start_page"
    )


@query("L15_merged_files", f"""
    SELECT m.folder_id, d.user_id, m.merged_name AS filename, '/store/' || m.merged_name AS file_path,
           CAST(sum(f.pages) AS BIGINT) AS pages, count(*) AS sources
    FROM ({_MERGE}) m JOIN fx_folders d ON m.folder_id = d.folder_id JOIN fx_library_files f ON m.file_id = f.file_id
    GROUP BY m.folder_id, d.user_id, m.merged_name""")
def _(t):
    plan = lib.merge_plan(fx.file_table(t), fx.folders(t), fx.inventory(t))
    return lib.merged_files(plan, fx.folders(t)).select("folder_id", "user_id", "filename", "file_path", "pages", "sources")


@query("L16_dashboard", """
    SELECT a.user_id, total_jobs, successful_jobs, total_files, total_pages, coalesce(turned, 0) AS pages_rotated,
           coalesce(kept, 0) AS pages_unchanged, coalesce(n, 0) AS folder_count
    FROM (SELECT user_id, count(*) AS total_jobs, count(*) FILTER (status = 'SUCCESS') AS successful_jobs,
                 CAST(coalesce(sum(total_files) FILTER (status = 'SUCCESS'), 0) AS BIGINT) AS total_files,
                 CAST(coalesce(sum(total_pages) FILTER (status = 'SUCCESS'), 0) AS BIGINT) AS total_pages FROM fx_jobs GROUP BY user_id) a
    LEFT JOIN (SELECT user_id, CAST(sum(turned) AS BIGINT) AS turned, CAST(sum(kept) AS BIGINT) AS kept
               FROM fx_latest l JOIN fx_breakdown b ON l.job_id = b.job_id WHERE recency <= 50 AND status = 'SUCCESS' GROUP BY user_id) b
    ON a.user_id = b.user_id
    LEFT JOIN (SELECT user_id, count(*) AS n FROM fx_folders GROUP BY user_id) f ON a.user_id = f.user_id""")
def _(t):
    return lib.dashboard(fx.job_table(t), fx.folders(t), fx.results(t))


@query("L17_recent_jobs", """
    SELECT l.user_id, l.job_id, l.status, n.filename FROM fx_latest l
    LEFT JOIN (SELECT DISTINCT job_id, filename FROM fx_results) n ON l.job_id = n.job_id AND l.status = 'SUCCESS' WHERE recency <= 5""")
def _(t):
    return lib.recent_jobs(fx.job_table(t), fx.results(t)).select("user_id", "job_id", "status", "filename")


fx.SQL["fx_preview"] = """
    SELECT job_id, n AS result_files, names[1:3] AS three FROM (
        SELECT job_id, count(*) AS n, list(filename ORDER BY filename) AS names
        FROM (SELECT DISTINCT job_id, filename FROM fx_results) d GROUP BY job_id) q"""


@query("L18_history", """
    SELECT l.user_id, l.job_id, l.status, l.completed_at, l.error_message, coalesce(turned, 0) AS pages_rotated,
           coalesce(kept, 0) AS pages_unchanged, d.name AS folder_name, coalesce(p.result_files, 0) AS result_files, n.filename
    FROM (SELECT x.*, j.completed_at, j.error_message FROM fx_latest x JOIN fx_jobs j ON x.job_id = j.job_id) l
    LEFT JOIN fx_breakdown b ON l.job_id = b.job_id AND l.status = 'SUCCESS'
    LEFT JOIN fx_preview p ON l.job_id = p.job_id AND l.status = 'SUCCESS'
    LEFT JOIN (SELECT DISTINCT job_id, filename FROM fx_results) n ON l.job_id = n.job_id AND l.status = 'SUCCESS'
    LEFT JOIN fx_folders d ON l.folder_id = d.folder_id WHERE recency <= 20""")
def _(t):
    return lib.history(fx.job_table(t), fx.folders(t), fx.results(t)).select(
        "user_id", "job_id", "status", "completed_at", "error_message", "pages_rotated", "pages_unchanged",
        "folder_name", "result_files", "filename",
    )


@query("L19_drop_history", f"SELECT job_id FROM fx_jobs WHERE NOT (user_id = {USER} AND NOT sealed)")
def _(t):
    ids = fx.job_table(t).filter(~F.col("sealed")).select("task_id")
    return lib.drop_history(fx.job_table(t), USER, ids).select("job_id")


fx.SQL["fx_storage"] = """
    SELECT 's' || CAST(o_orderkey AS VARCHAR) || CASE o_orderkey % 4 WHEN 0 THEN '.zip' WHEN 1 THEN '/in.zip' ELSE '' END AS path,
           o_orderkey % 4 = 2 AS is_dir, o_orderdate AS changed FROM orders"""


@query("L20_expired", """
    SELECT path FROM fx_storage WHERE position('/' IN path) = 0 AND (is_dir OR path LIKE '%.zip')
    AND changed < TIMESTAMP '1998-01-02 00:00:00' - INTERVAL 24 HOURS""")
def _(t):
    key = F.col("o_orderkey")
    tail = F.when(key % 4 == 0, ".zip").when(key % 4 == 1, "/in.zip").otherwise("")
    stored = t["orders"].select(
        F.concat(F.lit("s"), key.cast("string"), tail).alias("path"), (key % 4 == 2).alias("is_dir"),
        F.col("o_orderdate").cast("timestamp").alias("modificationTime"),
    )
    return lib.expired(stored, F.lit("1998-01-02 00:00:00").cast("timestamp")).select("path")


@query("L21_search_files", "SELECT file_id, filename FROM fx_library_files WHERE position('oc 1' IN lower(filename)) > 0")
def _(t):
    return lib.search_files(fx.file_table(t), " OC 1 ").select("file_id", "filename")


@query("L22_name_preview", """
    SELECT job_id, result_files, array_to_string(three, ', ') || CASE WHEN result_files > 3
        THEN ' +' || CAST(result_files - 3 AS VARCHAR) || ' more' ELSE '' END AS preview FROM fx_preview""")
def _(t):
    return lib.name_preview(fx.results(t))


@query("L22_many_names", """
    SELECT user_id AS job_id, n AS result_files, array_to_string(three, ', ') || CASE WHEN n > 3 THEN ' +' || CAST(n - 3 AS VARCHAR) || ' more' ELSE '' END AS preview
    FROM (SELECT user_id, count(*) AS n, list(filename ORDER BY filename)[1:3] AS three FROM (
        SELECT DISTINCT user_id, filename FROM fx_library_files WHERE user_id IS NOT NULL) d GROUP BY user_id) q""")
def _(t):
    """Users stand for jobs: many more names than the preview shows."""
    files = fx.file_table(t).filter(F.col("user_id").isNotNull())
    return lib.name_preview(files.select(F.col("user_id").alias("job_id"), "filename"))


@query("L23_discard_upload", f"""
    SELECT 'job' AS kind, job_id AS id FROM fx_jobs WHERE NOT coalesce(session_id IS NOT NULL AND user_id = {USER}, false)
    UNION ALL
    SELECT 'file', file_id FROM fx_library_files f WHERE file_path IS NULL OR NOT EXISTS (
        SELECT 1 FROM fx_jobs j WHERE j.user_id = {USER} AND j.session_id = regexp_extract(f.file_path, '^/store/([^/]+)/output', 1))""")
def _(t):
    uploads = fx.job_table(t).select("session_id", F.lit(USER).cast("long").alias("user_id"))
    jobs, files = lib.discard_upload(fx.job_table(t), fx.file_table(t), uploads)
    return jobs.select(F.lit("job").alias("kind"), F.col("job_id").alias("id")).unionByName(
        files.select(F.lit("file").alias("kind"), F.col("file_id").alias("id"))
    )


@query("L24_format_duration", """
    SELECT job_id, CASE WHEN s < 60 THEN CAST(greatest(s, 1) AS VARCHAR) || 's'
        WHEN s // 60 < 60 THEN CAST(s // 60 AS VARCHAR) || 'm' || CASE WHEN s % 60 <> 0 THEN ' ' || CAST(s % 60 AS VARCHAR) || 's' ELSE '' END
        ELSE CAST(s // 3600 AS VARCHAR) || 'h ' || CAST(s // 60 % 60 AS VARCHAR) || 'm' END AS took
    FROM (SELECT o_orderkey AS job_id, o_orderkey * 3 AS s FROM orders) q""")
def _(t):
    return t["orders"].select(
        F.col("o_orderkey").alias("job_id"), format_duration(F.col("o_orderkey") * 3).alias("took")
    )


@query("L24_format_bytes", """
    SELECT job_id, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B'
        WHEN b < 1048576 THEN CASE WHEN b / 1024 >= 100 THEN printf('%.0f KB', b / 1024) ELSE printf('%.1f KB', b / 1024) END
        WHEN b < 1073741824 THEN CASE WHEN b / 1048576 >= 100 THEN printf('%.0f MB', b / 1048576) ELSE printf('%.1f MB', b / 1048576) END
        ELSE CASE WHEN b / 1073741824 >= 100 THEN printf('%.0f GB', b / 1073741824) ELSE printf('%.1f GB', b / 1073741824) END END AS shown
    FROM (SELECT o_orderkey AS job_id, o_orderkey * o_orderkey * 1001 AS b FROM orders) q""")
def _(t):
    size = F.col("o_orderkey") * F.col("o_orderkey") * 1001
    return t["orders"].select(F.col("o_orderkey").alias("job_id"), format_bytes(size).alias("shown"))


@query("L25_compare_budget", """
    SELECT job_id, filename, CAST(least(take, 40 - used) AS INT) AS shown FROM (
        SELECT *, coalesce(sum(take) OVER (PARTITION BY job_id ORDER BY filename ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
        FROM (SELECT job_id, filename, least(pages * 9, 20) AS take FROM fx_job_files WHERE pages > 0) p) q WHERE used < 40""")
def _(t):
    files = fx.job_files(t).withColumn("pages", F.col("pages") * 9)
    return lib.compare_budget(files).select("job_id", "filename", "shown")
