"""Source, sink and assembly queries (S01..S10, A08, F01..F11) over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pageflow import fixtures as fx
from pageflow.functions.text import file_key
from pageflow.operators import jobs as j, orientation as o
from pageflow.plans.catalog import query
from pageflow.session import PIECES, checkpoint_dir
from pageflow.sources import extract, files, results as res
from pageflow.streaming import results as first

KEYS, FILE = j.KEYS, j.FILE
_PAGE = "job_id, filename, page"


fx.SQL["fx_expected"] = """
    SELECT job_id, filename, pages, CAST(unnest(generate_series(0, pages - 1)) AS INT) AS page FROM fx_job_files WHERE pages > 0"""
fx.SQL["fx_complete"] = """
    SELECT e.job_id, e.filename, max(e.pages) AS pages FROM fx_expected e
    LEFT JOIN fx_pages p ON e.job_id = p.job_id AND e.filename = p.filename AND e.page = p.page
    GROUP BY e.job_id, e.filename HAVING count(*) = count(p.page)"""



# ---- sources and sinks -----------------------------------------------------------------

@query("S02_expand_pages", """
    SELECT file_id, filename, CAST(unnest(generate_series(0, pages - 1)) AS INT) AS page
    FROM fx_library_files WHERE pages > 0""")
def _(t):
    return j.expand_pages(fx.file_table(t)).select("file_id", "filename", "page")


_NAMED = r"""
    SELECT *, trim(regexp_extract(replace(filename, '\', '/'), '([^/]*)$', 1)) AS name FROM fx_manifest"""
_REFUSED = f"""
    SELECT *, CASE WHEN name IN ('', '.', '..') OR lower(name) NOT LIKE '%.pdf' THEN 'not_pdf'
                   WHEN size <= 0 THEN 'empty' WHEN size > 2147483648 THEN 'too_large' END AS refusal FROM ({_NAMED}) n"""


@query("S03_validate_manifest", f"""
    SELECT m.upload_id, m.ord, m.name,
           CASE WHEN refusal IS NOT NULL THEN refusal WHEN c.claim_ord IS NULL THEN 'over_limit'
                WHEN m.ord = c.claim_ord THEN 'accepted' WHEN m.size = c.claim_size THEN 'same_file' ELSE 'conflict' END AS verdict
    FROM ({_REFUSED}) m LEFT JOIN (
        SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY claim_ord) AS rk FROM (
            SELECT upload_id, name, min(ord) AS claim_ord, arg_min(size, ord) AS claim_size
            FROM ({_REFUSED}) r WHERE refusal IS NULL GROUP BY upload_id, name) q QUALIFY rk <= 3) c
    ON m.upload_id = c.upload_id AND m.name = c.name""")
def _(t):
    judged = files.validate_manifest(fx.upload_manifest(t), max_files=3)
    return judged.select("upload_id", "ord", "name", "verdict")


@query("S04_dedupe_names", """
    SELECT upload_id, filename, min(ord) AS ord, arg_min(size, ord) AS size, count(*) - 1 AS skipped
    FROM fx_manifest GROUP BY upload_id, filename""")
def _(t):
    return files.dedupe_names(fx.upload_manifest(t))


def _scratch(t, name: str) -> str:
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("S05_read_page_results", f"""
    SELECT sha1(filename)[1:20] AS file_key, page, angle, method, reason, s90, skew, word_count FROM fx_results""")
def _(t):
    """Page documents written as stored, beside each a damaged one and one named by no page number."""
    r = fx.results(t)
    detail = F.struct(
        F.create_map(F.lit("90"), F.col("s90")).alias("scores"), "needs_review", "reason", "skew",
        "ink_ratio", "word_count",
    )
    doc = F.to_json(F.struct("angle", "method", detail.alias("details"), F.array().cast(o.TEXT_LAYER).alias("text")))
    where = F.concat(F.lit("file:/store/s/results/pages/"), file_key(F.col("filename")), F.lit("/"))
    copies = F.array(
        F.struct(F.concat(where, F.col("page").cast("string"), F.lit(".json")).alias("path"), doc.alias("value")),
        F.struct(F.concat(where, F.col("page").cast("string"), F.lit(".json")).alias("path"), F.lit('{"angle": 9').alias("value")),
        F.struct(F.concat(where, F.lit("99999999999.json")).alias("path"), doc.alias("value")),
    )
    path = _scratch(t, "page-documents")
    r.select(F.explode(copies).alias("d")).select("d.*").write.parquet(path)
    stored = t.spark.read.schema("path string, value string").parquet(path)
    return res.parse_page_results(stored).select(
        "file_key", "page", "angle", "method", "details.reason",
        F.col("details.scores")["90"].alias("s90"), "details.skew", "details.word_count",
    )


@query("S06_read_file_summaries", f"""
    SELECT r.filename, r.page, r.angle AS rotation, r.method, r.reason, r.needs_review, r.word_count
    FROM fx_results r JOIN fx_complete c ON r.job_id = c.job_id AND r.filename = c.filename WHERE r.page < c.pages""")
def _(t):
    """Summaries written as JSON lines with damaged lines between them, read back by the reader."""
    summaries = j.assemble_files(fx.job_files(t), fx.results(t))
    whole = F.to_json(F.struct("filename", "page_rotations", "page_details"))
    path = _scratch(t, "summaries")
    summaries.select(F.explode(F.array(whole, F.lit("not json"), F.substring(whole, 1, 40))).alias("value")).write.text(path)
    rows = res.read_file_summaries(t.spark, path, glob="*.txt", lines=True)
    return rows.select("filename", "page", "rotation", "method", "reason", "needs_review", "word_count")


@query("S07_file_key", "SELECT doc_id, sha1(text)[1:20] AS file_key FROM documents")
def _(t):
    return t["documents"].select("doc_id", file_key(F.col("text")).alias("file_key"))


@query("S08_write_page_results", f"SELECT {_PAGE}, angle, method, reason FROM fx_results")
def _(t):
    """Write, then read back from the shared scratch folder."""
    path = _scratch(t, "page-results")
    res.write_page_results(fx.results(t), path)
    return res.read_stored_results(t.spark, path).select(*KEYS, "angle", "method", "reason")


@query("S08_bucketed_results", "SELECT job_id, filename, pages FROM fx_complete")
def _(t):
    """Written once by file, then asked for complete files."""
    table = f"page_results_{uuid.uuid4().hex}"
    buckets = res.write_bucketed_results(fx.page_events(t).select(*KEYS, "ts"), table, _scratch(t, "bucketed"), buckets=8)
    # The other side is cut as the table is, so the table is joined as it lies.
    t.spark.conf.set(PIECES, str(buckets))
    return j.complete_files(fx.job_files(t), t.spark.table(table)).select("job_id", "filename", "pages")


def line_extractor(_model, page: dict) -> dict:
    """Stands in for a recogniser: the document's lines are what is 'seen' upright."""
    if page["page"] % 29 == 0:
        raise ValueError("unreadable stream")
    lines = [
        {
            "angle": 0, "ord": i, "text": text, "conf": 0.9,
            "box": [{"x": float(x), "y": float(y)} for x, y in
                    ((50, 20 * i), (50 + 6 * len(text), 20 * i), (50 + 6 * len(text), 20 * i + 12), (50, 20 * i + 12))],
        }
        for i, text in enumerate(page["text"].split("\n")) if text
    ]
    return {"width": 850, "height": 1100, "ink_ratio": 0.5, "meta_rotation": 0, "lines": lines}


@query("S09_analyze_pages", r"""
    SELECT CAST(doc_id AS INT) AS page, CASE WHEN doc_id % 29 = 0 THEN 'error' ELSE 'universal_recognizer' END AS method,
           CASE WHEN doc_id % 29 = 0 THEN 'error' WHEN n * 0.9 < 5 THEN 'no_text' END AS reason,
           CAST(CASE WHEN doc_id % 29 = 0 THEN 0 ELSE n END AS INT) AS text_lines
    FROM (SELECT doc_id, count(CASE WHEN length(text) * 6 > 12 * 0.8 THEN 1 END) AS n FROM fx_doc_lines GROUP BY doc_id) q""")
def _(t):
    docs = t["documents"].select(
        F.regexp_extract("source", r"(\d+)$", 1).cast("long").alias("job_id"),
        F.concat(F.col("lang"), F.lit(".pdf")).alias("filename"), F.col("doc_id").cast("int").alias("page"), "text",
    )
    analyzed = o.analyze_orientation(extract.analyze_pages(docs, line_extractor))
    return analyzed.select("page", "method", "reason", F.size("text").alias("text_lines"))


@query("S10_export_results", """
    SELECT job_id, filename, page, angle, 'saved' AS copy FROM fx_results
    WHERE job_id IN (SELECT job_id FROM fx_jobs WHERE status = 'SUCCESS')
    UNION ALL
    SELECT job_id, filename, page, CAST(0 AS INT), 'legacy' FROM fx_results
    WHERE job_id IN (SELECT job_id FROM fx_jobs WHERE total_pages > 10 AND status <> 'SUCCESS')""")
def _(t):
    r = fx.results(t).select(*KEYS, "angle")
    jobs = fx.job_table(t)
    saved = r.join(jobs.filter(F.col("status") == "SUCCESS").select("job_id"), "job_id", "left_semi")
    legacy = r.join(jobs.filter(F.col("total_pages") > 10).select("job_id"), "job_id", "left_semi")
    saved = saved.withColumn("copy", F.lit("saved"))
    legacy = legacy.withColumns({"angle": F.lit(0), "copy": F.lit("legacy")})
    return j.prefer_saved(saved, legacy, ["job_id"])


@query("A08_ink_ratio", """
    SELECT doc_id, CAST(sum(CASE WHEN ('0x' || px[1:2])::INT * 299 + ('0x' || px[3:4])::INT * 587
             + ('0x' || px[5:6])::INT * 114 < 199500 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS ink_ratio
    FROM (SELECT doc_id, unnest(regexp_extract_all(h || repeat('F', CAST((6 - length(h) % 6) % 6 AS INT)), '.{6}')) AS px
          FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents) a) b GROUP BY doc_id""")
def _(t):
    """The bytes of each text, filled up with white to whole RGB pixels, are the image."""
    raw = F.hex(F.encode("text", "utf-8"))
    fill = F.pmod(-F.length(raw), F.lit(6))
    samples = F.unhex(F.concat(raw, F.repeat(F.lit("F"), fill)))
    return t["documents"].select("doc_id", extract.ink_ratio(samples, F.lit(3)).alias("ink_ratio"))


# ---- file and job assembly -------------------------------------------------------------


@query("F01_first_result", f"SELECT {_PAGE}, s0, s90, s180, skew FROM fx_pages")
def _(t):
    return j.first_result(fx.page_events(t), KEYS, fx.ARRIVAL).select(*KEYS, "s0", "s90", "s180", "skew")


@query("F01_first_result_stream", f"SELECT {_PAGE}, s0, s90, s180, skew FROM fx_pages")
def _(t):
    """Results in three micro-batches by time into the sink; every batch comes twice."""
    from pageflow.plans.progress import in_batches

    step = F.greatest(F.least(F.floor((F.year("ts") - 1995) / 2), F.lit(2)), F.lit(0))
    stream, path, checkpoint = in_batches(t, fx.page_events(t), step), _scratch(t, "first"), _scratch(t, "stream")
    sink = first.FirstResultSink(path, fx.ARRIVAL)

    def twice(batch, batch_id):
        sink(batch, batch_id)
        sink(batch, batch_id)

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(twice).start().awaitTermination()
    return first.read_first_results(t.spark, path).select(*KEYS, "s0", "s90", "s180", "skew")


@query("F02_pending_pages", f"""
    SELECT {_PAGE} FROM fx_expected e WHERE NOT EXISTS (
        SELECT 1 FROM fx_page_events p WHERE e.job_id = p.job_id AND e.filename = p.filename AND e.page = p.page)""")
def _(t):
    return j.pending_pages(j.expand_pages(fx.job_files(t)).select(*KEYS), fx.page_events(t))


@query("F03_complete_files", "SELECT job_id, filename, pages FROM fx_complete")
def _(t):
    return j.complete_files(fx.job_files(t), fx.page_events(t)).select("job_id", "filename", "pages")


@query("F04_assemble_files", """
    SELECT r.job_id, r.filename, CAST(0 AS BIGINT) AS block, CAST(count(*) AS INT) AS pages,
           string_agg(concat_ws(':', page, angle, method, CAST(needs_review AS VARCHAR), coalesce(reason, '-'), coalesce(CAST(CAST(skew AS DECIMAL(9, 1)) AS VARCHAR), '-'),
               coalesce(CAST(CAST(ink_ratio AS DECIMAL(9, 5)) AS VARCHAR), '-'), coalesce(CAST(word_count AS VARCHAR), '-'),
               CASE WHEN method = 'universal_recognizer' THEN concat_ws('/', CAST(floor(s0 * 10 + 0.5 + 1e-9) AS BIGINT), CAST(floor(s90 * 10 + 0.5 + 1e-9) AS BIGINT),
                   CAST(floor(s180 * 10 + 0.5 + 1e-9) AS BIGINT), CAST(floor(s270 * 10 + 0.5 + 1e-9) AS BIGINT)) ELSE '' END), ',' ORDER BY r.page) AS details
    FROM fx_results r JOIN fx_complete c ON r.job_id = c.job_id AND r.filename = c.filename AND r.page < c.pages
    GROUP BY r.job_id, r.filename""")
def _(t):
    number = lambda x, kind: F.coalesce(x.cast(kind).cast("string"), F.lit("-"))

    def entry(e):
        d = e["value"]
        return F.concat_ws(
            ":", e["key"], d["angle"].cast("string"), d["method"], d["needs_review"].cast("string"), F.coalesce(d["reason"], F.lit("-")),
            number(d["skew"], "decimal(9,1)"), number(d["ink_ratio"], "decimal(9,5)"), number(d["word_count"], "int"),
            F.array_join(F.transform(F.map_values(d["scores"]), lambda s: F.round(s * 10).cast("long").cast("string")), "/"),
        )

    return j.assemble_files(fx.job_files(t), fx.results(t)).select(
        *FILE, "block", F.size("page_rotations").alias("pages"),
        F.array_join(F.transform(F.map_entries("page_details"), entry), ",").alias("details"),
    )


@query("F05_job_totals", """
    SELECT job_id, count(*) AS total_files, CAST(sum(pages) AS BIGINT) AS total_pages FROM (
        SELECT job_id, filename, arg_min(page + 1, (ts, page)) AS pages FROM fx_page_events GROUP BY job_id, filename) q
    GROUP BY job_id""")
def _(t):
    added = fx.page_events(t).select(*FILE, "ts", (F.col("page") + 1).alias("pages"))
    return j.job_totals(added)


@query("F06_job_result", """
    SELECT job_id, count(*) AS files_processed, CAST(sum(pages) AS BIGINT) AS pages_processed FROM fx_complete GROUP BY job_id""")
def _(t):
    return j.job_result(j.assemble_files(fx.job_files(t), fx.results(t)))


fx.SQL["fx_file_status"] = """
    SELECT job_id, filename, CASE (job_id + pages) % 5 WHEN 0 THEN 'failed' WHEN 4 THEN 'processing' ELSE 'done' END AS file_status
    FROM fx_job_files"""


def file_status(t):
    mark = (F.col("job_id") + F.col("pages")) % 5
    return fx.job_files(t).select(
        *FILE, F.when(mark == 0, "failed").when(mark == 4, "processing").otherwise("done").alias("file_status")
    )


@query("F07_job_outcome", """
    SELECT j.job_id,
           CASE WHEN n IS NULL THEN 'FAILED' WHEN settled < n THEN NULL WHEN failed = n THEN 'FAILED' ELSE 'SUCCESS' END AS outcome,
           CASE WHEN n IS NULL THEN 'No files were uploaded.' WHEN settled < n THEN NULL
                WHEN failed = n THEN 'None of the files could be processed.' END AS error
    FROM fx_jobs j LEFT JOIN (
        SELECT job_id, count(*) AS n, count(*) FILTER (file_status IN ('done', 'failed')) AS settled,
               count(*) FILTER (file_status = 'failed') AS failed FROM fx_file_status GROUP BY job_id) c ON j.job_id = c.job_id
    WHERE sealed AND NOT cancelled AND status = 'PROCESSING'""")
def _(t):
    return j.job_outcome(fx.job_table(t), file_status(t))


@query("F08_refresh_status", """
    SELECT job_id,
           CASE WHEN status <> 'PROCESSING' THEN status
                WHEN sealed THEN CASE job_id % 5 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'FAILED' ELSE status END
                WHEN total_pages > 15 AND session_id IS NOT NULL THEN 'SUCCESS'
                ELSE CASE job_id % 7 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'FAILED' ELSE status END END AS new_status,
           CASE WHEN status = 'PROCESSING' AND CASE WHEN sealed THEN job_id % 5 < 2 WHEN total_pages > 15 AND session_id IS NOT NULL THEN true ELSE job_id % 7 < 2 END
                THEN TIMESTAMP '2030-01-01 00:00:00' ELSE completed_at END AS completed_at,
           CASE WHEN status <> 'PROCESSING' THEN NULL
                WHEN sealed THEN CASE WHEN job_id % 5 = 1 THEN 'live error' END
                WHEN total_pages > 15 AND session_id IS NOT NULL THEN NULL
                WHEN job_id % 7 = 1 THEN 'legacy error' END AS new_error
    FROM fx_jobs""")
def _(t):
    jobs = fx.job_table(t)
    key = F.col("job_id")
    live = jobs.filter("sealed").select(
        "job_id",
        F.when(key % 5 == 0, "SUCCESS").when(key % 5 == 1, "FAILED").otherwise("PROCESSING").alias("live_status"),
        F.lit("live error").alias("live_error"),
    )
    disk = jobs.filter(F.col("total_pages") > 15).select("job_id")
    legacy = jobs.select(
        "job_id",
        F.when(key % 7 == 0, "SUCCESS").when(key % 7 == 1, "FAILED").otherwise("PENDING").alias("legacy_status"),
        F.lit("legacy error").alias("legacy_error"),
    )
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    return j.refresh_status(jobs, live, disk, legacy, now).select("job_id", "new_status", "new_error", "completed_at")


@query("F09_fail_missing", """
    SELECT file_id, 'failed' AS file_status FROM fx_library_files f
    WHERE pages <= 0 OR NOT EXISTS (SELECT 1 FROM fx_inventory i WHERE i.path = f.file_path)""")
def _(t):
    return j.fail_missing(fx.file_table(t), fx.inventory(t)).select("file_id", "file_status")


@query("F10_rotated_breakdown", """
    SELECT job_id, CAST(count(*) FILTER (angle <> 0) AS BIGINT) AS pages_rotated,
           CAST(count(*) FILTER (angle = 0) AS BIGINT) AS pages_unchanged, count(DISTINCT filename) AS result_files
    FROM fx_results GROUP BY job_id""")
def _(t):
    return j.rotated_breakdown(fx.results(t))


@query("F10_job_filenames", "SELECT DISTINCT job_id, filename FROM fx_results")
def _(t):
    return j.job_filenames(fx.results(t))


@query("F11_committable_files", f"""
    SELECT c.upload_id, attempt, attempts, coalesce(files, 0) AS files, coalesce(pages, 0) AS pages,
           CASE WHEN coalesce(files, 0) = 0 THEN 'No completed PDF files to process' END AS error
    FROM (SELECT upload_id, min(ord) AS attempt, count(*) AS attempts FROM fx_manifest GROUP BY upload_id) c
    LEFT JOIN (SELECT upload_id, count(*) AS files, CAST(sum(ord % 8) AS BIGINT) AS pages FROM fx_manifest
               WHERE ord % 5 = 0 AND ord % 3 <> 0 GROUP BY upload_id) f ON c.upload_id = f.upload_id""")
def _(t):
    m = fx.upload_manifest(t)
    states = m.select(
        "upload_id", "filename", (F.col("ord") % 5 == 0).alias("complete"), (F.col("ord") % 3 == 0).alias("invalid"),
        (F.col("ord") % 8).alias("pages"),
    )
    commits = m.select("upload_id", F.col("ord").alias("attempt"))
    return j.committable_files(states, commits)
