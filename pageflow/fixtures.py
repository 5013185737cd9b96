"""Analytics tables derived from the given parquet tables.

Each table exists twice: as a DataFrame function (what the queries read) and as SQL text
(what the oracle reads). All but ``job_files`` and ``pages`` are plain projections, so they
cost one scan and no exchange.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pageflow.operators import jobs, orientation
from pageflow.rules import ROTATIONS


class Tables:
    """The parquet tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def _session(key: Column) -> Column:
    return F.concat(F.lit("s"), key.cast("string"))


# ---- library ---------------------------------------------------------------------------

def folders(t: Tables) -> DataFrame:
    return t["supplier"].select(
        F.col("s_suppkey").alias("folder_id"),
        F.col("s_nationkey").cast("long").alias("user_id"),
        F.concat(F.col("s_name"), F.lit(" box")).alias("name"),
        F.timestamp_seconds(F.col("s_suppkey") * 3600).alias("created_at"),
    )


def job_table(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    status = (
        F.when(F.col("o_orderstatus") == "F", "SUCCESS")
        .when(F.col("o_orderstatus") == "O", "PROCESSING").otherwise("FAILED")
    )
    return t["orders"].select(
        key.alias("job_id"),
        F.concat(F.lit("task-"), key.cast("string")).alias("task_id"),
        F.when(key % 11 != 0, _session(key)).alias("session_id"),
        (F.col("o_custkey") % 25).alias("user_id"),
        F.when(key % 4 != 0, key % 120).alias("folder_id"),
        status.alias("status"),
        F.when(key % 13 != 0, key % 4).cast("long").alias("total_files"),
        (F.col("o_custkey") % 30).alias("total_pages"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        (F.col("o_orderpriority") != "5-LOW").alias("sealed"),
        (key % 17 == 0).alias("cancelled"),
        F.when(F.col("o_orderstatus") != "O", F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + 3600))
        .alias("completed_at"),
        F.when(status == "FAILED", F.concat(F.lit("run "), key.cast("string"), F.lit(" failed"))).alias("error_message"),
    )


def file_table(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    name = F.concat(F.lit("Doc "), (F.col("o_custkey") % 50).cast("string"), F.lit(".pdf"))
    return t["orders"].select(
        key.alias("file_id"),
        F.when(key % 4 != 0, key % 120).alias("folder_id"),
        F.when(key % 6 != 0, F.col("o_custkey") % 25).alias("user_id"),
        name.alias("filename"),
        F.when(key % 7 != 0, F.concat(F.lit("/store/"), _session(key), F.lit("/output/"), name)).alias("file_path"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        (key % 9).cast("int").alias("pages"),
    )


def inventory(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    name = F.concat(F.lit("Doc "), (F.col("o_custkey") % 50).cast("string"), F.lit(".pdf"))
    return t["orders"].filter(F.col("o_orderpriority") != "1-URGENT").select(
        F.concat(F.lit("/store/"), _session(key), F.lit("/output/"), name).alias("path"),
        F.col("o_orderdate").cast("timestamp").alias("modificationTime"),
        key.alias("length"),
    )


# ---- pages -----------------------------------------------------------------------------

ARRIVAL = ["ts", "s0", "s90", "s180", "s270", "skew", "word_count"]


def page_events(t: Tables) -> DataFrame:
    n = F.col("l_linenumber") - 1
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    source = t["lineitem"].select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"
    )
    return source.select(
        F.col("l_orderkey").alias("job_id"),
        F.concat(F.lit("f"), (n % 3).cast("string"), F.lit(".pdf")).alias("filename"),
        F.floor(n / 3).cast("int").alias("page"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_quantity") / 5).alias("s0"),
        ((part % 97).cast("double") / 10).alias("s90"),
        ((supp % 89).cast("double") / 10).alias("s180"),
        (((part + F.col("l_linenumber")) % 83).cast("double") / 10).alias("s270"),
        (((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 1000).cast("double") / 100000).alias("ink_ratio"),
        ((part % 41 - 20).cast("double") / 10).alias("skew"),
        (supp % 200).cast("int").alias("word_count"),
    )


def pages(t: Tables) -> DataFrame:
    """First stored result of every page."""
    return jobs.first_result(page_events(t), orientation.KEYS, ARRIVAL)


def results(t: Tables) -> DataFrame:
    """Decided page results; metadata and error pages take precedence over scores."""
    decided = orientation.decide(pages(t))
    failed, declared = F.col("s90") == 9.6, F.col("s90") == 9.5
    return decided.select(
        *orientation.KEYS,
        F.when(failed, 0).when(declared, 90).otherwise(F.col("angle")).cast("int").alias("angle"),
        F.when(failed, "error").when(declared, "metadata").otherwise("universal_recognizer").alias("method"),
        F.when(failed, True).when(declared, False).otherwise(F.col("needs_review")).alias("needs_review"),
        F.when(failed, "error").when(declared, None).otherwise(F.col("reason")).alias("reason"),
        F.when(~(failed | declared), F.col("skew")).alias("skew"),
        *orientation.SCORES, "ink_ratio", "word_count",
    )


def job_files(t: Tables) -> DataFrame:
    job = F.col("job_id")
    return (
        page_events(t).groupBy("job_id", "filename")
        .agg(F.max("page").alias("last"), F.min("ts").alias("created_at"))
        .select(
            "job_id", "filename",
            (F.col("last") + 1 + F.when(job % 5 == 0, 1).otherwise(0)).cast("int").alias("pages"),
            F.when(job % 7 != 0, F.concat(job.cast("string"), F.lit("/output/"), F.col("filename"))).alias("file_path"),
            "created_at",
        )
    )


def reviewed(t: Tables) -> DataFrame:
    """Signed-off pages; a few belong to no stored page."""
    n = F.col("l_linenumber") - 1
    return (
        t["lineitem"].filter(F.col("l_returnflag") == "R")
        .select(
            F.col("l_orderkey").alias("job_id"),
            F.concat(F.lit("f"), (n % 3).cast("string"), F.lit(".pdf")).alias("filename"),
            (F.floor(n / 3) + F.when(F.col("l_orderkey") % 10 == 0, 1).otherwise(0)).cast("int").alias("page"),
        )
        .distinct()
    )


def _spread_documents(t: Tables) -> DataFrame:
    """Documents dealt by id over the session's shuffle partitions, ahead of heavy row-local work:
    the given file has fewer splits than any machine has cores."""
    number = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    return t["documents"].select("doc_id", "text", "lang", "source").repartition(number, "doc_id")


# ---- recognised lines ------------------------------------------------------------------

def page_ocr(t: Tables) -> DataFrame:
    """Nested recogniser output: one row per document, four tried angles in ``lines``."""
    doc = F.col("doc_id")
    upright = (doc % 4) * 90

    def line(angle: int):
        def build(text: Column, i: Column) -> Column:
            long_side = (F.length(text) * 6).cast("double")
            conf = F.when(F.lit(angle) == upright, 1.0).otherwise(0.7) * (50 + (doc * 31 + i * 17) % 50) / 100
            flat = (F.lit(angle) - upright) % 180 == 0
            w = F.when(flat, long_side).otherwise(12.0)
            h = F.when(flat, 12.0).otherwise(long_side)
            x0, y0 = F.lit(50.0), (50 + i * 20).cast("double")
            drop = (doc % 9 - 4).cast("double") / 100 * w
            point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
            return F.struct(
                F.lit(angle).alias("angle"), i.cast("int").alias("ord"),
                F.array(point(x0, y0), point(x0 + w, y0 + drop), point(x0 + w, y0 + h + drop), point(x0, y0 + h)).alias("box"),
                text.alias("text"), conf.alias("conf"),
            )
        return build

    per_angle = F.concat(*[F.transform("texts", line(a)) for a in ROTATIONS])
    docs = _spread_documents(t)
    return docs.withColumn("texts", F.split("text", "\n")).select(
        F.regexp_extract("source", r"(\d+)$", 1).cast("long").alias("job_id"),
        F.concat(F.col("lang"), F.lit(".pdf")).alias("filename"),
        doc.cast("int").alias("page"),
        F.lit(850).alias("width"), F.lit(1100).alias("height"),
        ((doc * 7 % 500).cast("double") / 10000).alias("ink_ratio"),
        F.when(doc % 23 == 0, (doc % 5) * 45).otherwise(0).cast("int").alias("meta_rotation"),
        F.when(doc % 29 == 0, "unreadable stream").alias("error"),
        F.filter(per_angle, lambda l: F.length(l["text"]) > 0).alias("lines"),
    )


def explode_lines(pages: DataFrame, keep: list[str]) -> DataFrame:
    """One row per element of ``lines``.

    ``explode`` would infer a filter on the array and push it below the projection that builds
    it, building everything again; ``explode_outer`` infers none.
    """
    return (
        pages.select(*keep, F.explode_outer("lines").alias("l"))
        .filter(F.col("l").isNotNull()).select(*keep, "l.*")
    )


def ocr_pages(t: Tables) -> DataFrame:
    return page_ocr(t).drop("lines")


def ocr_lines(t: Tables) -> DataFrame:
    return explode_lines(page_ocr(t), [*orientation.KEYS, "width", "height"])


def best_lines(t: Tables) -> DataFrame:
    """Readable lines of the winning rotation, chosen inside the page row: no join."""
    scored = page_ocr(t).withColumn(
        "lines", F.filter("lines", lambda l: orientation.is_readable(l["conf"], l["box"]))
    )
    best = scored.withColumns(
        {f"s{a}": orientation.angle_score("lines", a) for a in ROTATIONS}
    ).withColumn("best", orientation.best_rotation())
    return explode_lines(best, [*orientation.KEYS, "width", "height", "best"]).filter(
        F.col("angle") == F.col("best")
    )


# ---- text lines of the output pages ----------------------------------------------------

PAGE_LINE = "struct<ord:int,text:string,x0:double,y0:double,x1:double,y1:double,size:double>"


def page_layout(t: Tables) -> DataFrame:
    """Nested text layer of the output pages: two of three blocks of four lines sit on one row each."""
    doc = F.col("doc_id")

    def line(text: Column, i: Column) -> Column:
        block = F.floor(i / 4)
        tabular = (doc + block) % 3 != 0
        col = i % 4
        x0 = F.when(tabular, col * 150 + i % 3 + 40).otherwise(50).cast("double")
        y0 = (block * 80 + F.when(tabular, col * 2).otherwise(col * 20) + 40).cast("double")
        size = F.when(i == 0, 18.0).when(i % 11 == 5, 13.0).otherwise(10.0)
        return F.struct(
            i.cast("int").alias("ord"), text.alias("text"), x0.alias("x0"), y0.alias("y0"),
            (x0 + 100).alias("x1"), (y0 + size).alias("y1"), size.alias("size"),
        )

    return _spread_documents(t).select(
        F.regexp_extract("source", r"(\d+)$", 1).cast("long").alias("job_id"),
        F.concat(F.col("lang"), F.lit(".pdf")).alias("filename"),
        doc.cast("int").alias("page"),
        F.when(doc % 5 == 0, (doc % 4) * 90).otherwise(0).cast("int").alias("rotation"),
        F.lit(612.0).alias("page_w"), F.lit(792.0).alias("page_h"),
        ((doc % 41 - 20).cast("double") / 10).alias("skew"),
        F.transform(F.split("text", "\n"), line).alias("lines"),
    )


def page_lines(t: Tables) -> DataFrame:
    keep = [*orientation.KEYS, "rotation", "page_w", "page_h", "skew"]
    return explode_lines(page_layout(t), keep)


# ---- live progress and uploads ---------------------------------------------------------

def progress_events(t: Tables) -> DataFrame:
    kind = (
        F.when(F.col("event_type") == "signup", "sealed").when(F.col("event_type") == "error", "file_failed")
        .when(F.col("event_type") == "purchase", "file_done").otherwise("page_done")
    )
    return t["events"].select(
        "event_id",
        F.col("user_id").alias("job_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        kind.alias("kind"),
        F.concat(F.lit("f"), (F.col("event_id") % 5).cast("string"), F.lit(".pdf")).alias("filename"),
        (F.col("event_id") % 40).cast("int").alias("page"),
    )


def upload_chunks(t: Tables) -> DataFrame:
    """Chunks of 4 or 20 MB; lines of an order in shipping order, so many arrive too early or twice."""
    n = (F.col("l_linenumber") - 1).cast("long")
    mb = 1024 * 1024
    return t["lineitem"].select(
        F.col("l_orderkey").alias("file_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_partkey").alias("tie1"), F.col("l_suppkey").alias("tie2"),
        (F.floor(n / 2) * 4 * mb).alias("offset"),
        F.when(F.col("l_partkey") % 10 == 0, 20 * mb).otherwise(4 * mb).cast("long").alias("length"),
        F.lit(12 * mb).cast("long").alias("size"),
    )


def upload_samples(t: Tables) -> DataFrame:
    """Bytes sent so far per upload, one sample a row."""
    return t["events"].select(
        (F.col("user_id") % 5).alias("upload_id"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(100_000_000)).cast("long").alias("t"),
        (F.col("event_id") * 1000).alias("sent"),
    ).withColumn("total", F.lit(2_000_000_000).cast("long"))


def upload_manifest(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    k = (key % 6).cast("string")
    raw = (
        F.when(key % 13 == 0, F.concat(F.lit("C:\\scans\\f"), k, F.lit(".PDF")))
        .when(key % 13 == 1, F.concat(F.lit(" in/f"), k, F.lit(".pdf ")))
        .when(key % 13 == 2, "..").when(key % 13 == 3, "notes.txt").when(key % 13 == 4, "  ")
        .otherwise(F.concat(F.lit("f"), k, F.lit(".pdf")))
    )
    size = F.when(key % 19 == 0, 0).when(key % 19 == 1, 3_000_000_000).otherwise(1000 + key % 2)
    return t["orders"].select(
        F.col("o_custkey").alias("upload_id"), key.alias("ord"), raw.alias("filename"),
        size.cast("long").alias("size"),
    )


# ---- the same tables as oracle SQL -----------------------------------------------------

_NAME = "'Doc ' || CAST(o_custkey % 50 AS VARCHAR) || '.pdf'"
_LINE_FILE = "'f' || CAST((l_linenumber - 1) % 3 AS VARCHAR) || '.pdf'"

SQL = {
    "fx_folders": """
        SELECT s_suppkey AS folder_id, CAST(s_nationkey AS BIGINT) AS user_id, s_name || ' box' AS name,
               make_timestamp(s_suppkey * 3600 * 1000000) AS created_at FROM supplier""",
    "fx_jobs": """
        SELECT o_orderkey AS job_id, 'task-' || CAST(o_orderkey AS VARCHAR) AS task_id,
               CASE WHEN o_orderkey % 11 <> 0 THEN 's' || CAST(o_orderkey AS VARCHAR) END AS session_id,
               o_custkey % 25 AS user_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 120 END AS folder_id,
               CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'PROCESSING' ELSE 'FAILED' END AS status,
               CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 4 END AS total_files,
               o_custkey % 30 AS total_pages, o_orderdate AS created_at,
               o_orderpriority <> '5-LOW' AS sealed, o_orderkey % 17 = 0 AS cancelled,
               CASE WHEN o_orderstatus <> 'O' THEN make_timestamp(epoch_us(CAST(o_orderdate AS TIMESTAMP)) + 3600000000) END AS completed_at,
               CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'run ' || CAST(o_orderkey AS VARCHAR) || ' failed' END AS error_message
        FROM orders""",
    "fx_library_files": f"""
        SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 120 END AS folder_id,
               CASE WHEN o_orderkey % 6 <> 0 THEN o_custkey % 25 END AS user_id, {_NAME} AS filename,
               CASE WHEN o_orderkey % 7 <> 0
                    THEN '/store/s' || CAST(o_orderkey AS VARCHAR) || '/output/' || {_NAME} END AS file_path,
               o_orderdate AS created_at, CAST(o_orderkey % 9 AS INT) AS pages FROM orders""",
    "fx_inventory": f"""
        SELECT '/store/s' || CAST(o_orderkey AS VARCHAR) || '/output/' || {_NAME} AS path,
               o_orderdate AS modificationTime, o_orderkey AS length FROM orders WHERE o_orderpriority <> '1-URGENT'""",
    "fx_page_events": f"""
        SELECT l_orderkey AS job_id, {_LINE_FILE} AS filename, CAST((l_linenumber - 1) // 3 AS INT) AS page,
               l_shipdate AS ts, l_quantity / 5 AS s0, CAST(l_partkey % 97 AS DOUBLE) / 10 AS s90,
               CAST(l_suppkey % 89 AS DOUBLE) / 10 AS s180,
               CAST((l_partkey + l_linenumber) % 83 AS DOUBLE) / 10 AS s270,
               CAST((l_orderkey * 7 + l_linenumber) % 1000 AS DOUBLE) / 100000 AS ink_ratio,
               CAST(l_partkey % 41 - 20 AS DOUBLE) / 10 AS skew, CAST(l_suppkey % 200 AS INT) AS word_count
        FROM lineitem""",
    "fx_pages": """
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY job_id, filename, page
                ORDER BY ts, s0, s90, s180, s270, skew, word_count) AS rn FROM fx_page_events) q WHERE rn = 1""",
    "fx_best": """
        SELECT *, greatest(s0, s90, s180, s270) AS top,
               greatest(least(greatest(s0, s90), greatest(s180, s270)), least(s0, s90), least(s180, s270)) AS second,
               CASE greatest(s0, s90, s180, s270) WHEN s0 THEN 0 WHEN s90 THEN 90 WHEN s180 THEN 180 ELSE 270 END AS best
        FROM fx_pages""",
    "fx_decided": """
        SELECT *, CASE WHEN top < 5 OR (best <> 0 AND top - s0 < 2) THEN 0 ELSE (360 - best) % 360 END AS angle,
               CASE WHEN top < 5 THEN 'no_text' WHEN best <> 0 AND top - s0 < 2 THEN 'close_to_zero'
                    WHEN second > 0 AND (top - second) / top < 0.25 THEN 'ambiguous' END AS reason
        FROM fx_best""",
    "fx_flagged": """
        SELECT * REPLACE (CASE WHEN ink_ratio < 0.002 THEN 'blank' WHEN reason IS NOT NULL THEN reason
                               WHEN abs(skew) >= 0.75 THEN 'skewed' END AS reason)
        FROM fx_decided""",
    "fx_results": """
        SELECT job_id, filename, page,
               CAST(CASE WHEN failed THEN 0 WHEN declared THEN 90 ELSE angle END AS INT) AS angle,
               CASE WHEN failed THEN 'error' WHEN declared THEN 'metadata' ELSE 'universal_recognizer' END AS method,
               CASE WHEN failed THEN true WHEN declared THEN false ELSE reason IS NOT NULL END AS needs_review,
               CASE WHEN failed THEN 'error' WHEN declared THEN NULL ELSE reason END AS reason,
               CASE WHEN NOT (failed OR declared) THEN skew END AS skew,
               s0, s90, s180, s270, ink_ratio, word_count
        FROM (SELECT *, s90 = CAST(9.6 AS DOUBLE) AS failed, s90 = CAST(9.5 AS DOUBLE) AS declared FROM fx_flagged) q""",
    "fx_job_files": """
        SELECT job_id, filename,
               CAST(max(page) + 1 + CASE WHEN job_id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS pages,
               CASE WHEN job_id % 7 <> 0 THEN CAST(job_id AS VARCHAR) || '/output/' || filename END AS file_path,
               min(ts) AS created_at
        FROM fx_page_events GROUP BY job_id, filename""",
    "fx_reviewed": f"""
        SELECT DISTINCT l_orderkey AS job_id, {_LINE_FILE} AS filename,
               CAST((l_linenumber - 1) // 3 + CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END AS INT) AS page
        FROM lineitem WHERE l_returnflag = 'R'""",
    "fx_doc_lines": r"""
        SELECT doc_id, lang, source, CAST(i - 1 AS INT) AS ord, parts[i] AS text
        FROM (SELECT doc_id, lang, source, parts, unnest(generate_series(1, len(parts))) AS i
              FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents) q) p""",
    "fx_ocr_pages": r"""
        SELECT CAST(regexp_extract(source, '(\d+)$', 1) AS BIGINT) AS job_id, lang || '.pdf' AS filename,
               CAST(doc_id AS INT) AS page, 850 AS width, 1100 AS height,
               CAST(doc_id * 7 % 500 AS DOUBLE) / 10000 AS ink_ratio,
               CAST(CASE WHEN doc_id % 23 = 0 THEN doc_id % 5 * 45 ELSE 0 END AS INT) AS meta_rotation,
               CASE WHEN doc_id % 29 = 0 THEN 'unreadable stream' END AS error FROM documents""",
    "fx_ocr_lines": r"""
        SELECT CAST(regexp_extract(source, '(\d+)$', 1) AS BIGINT) AS job_id, lang || '.pdf' AS filename,
               CAST(doc_id AS INT) AS page, angle, ord, text,
               CASE WHEN angle = doc_id % 4 * 90 THEN CAST(1 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END
                   * (50 + (doc_id * 31 + ord * 17) % 50) / 100 AS conf,
               CAST(50 AS DOUBLE) AS x0, CAST(50 + ord * 20 AS DOUBLE) AS y0,
               CASE WHEN (angle - doc_id % 4 * 90) % 180 = 0 THEN CAST(length(text) * 6 AS DOUBLE) ELSE CAST(12 AS DOUBLE) END AS w,
               CASE WHEN (angle - doc_id % 4 * 90) % 180 = 0 THEN CAST(12 AS DOUBLE) ELSE CAST(length(text) * 6 AS DOUBLE) END AS h,
               CAST(doc_id % 9 - 4 AS DOUBLE) / 100 AS slope
        FROM fx_doc_lines CROSS JOIN (VALUES (0), (90), (180), (270)) a(angle) WHERE length(text) > 0""",
    "fx_readable": """
        SELECT *, slope * w AS fall FROM fx_ocr_lines
        WHERE conf > 0.6 AND w > (h + abs(slope * w)) * CAST(0.8 AS DOUBLE)""",
    "fx_ocr_scores": """
        SELECT p.*, coalesce(a, 0) / CAST(1e6 AS DOUBLE) AS s0, coalesce(b, 0) / CAST(1e6 AS DOUBLE) AS s90,
               coalesce(c, 0) / CAST(1e6 AS DOUBLE) AS s180, coalesce(d, 0) / CAST(1e6 AS DOUBLE) AS s270
        FROM fx_ocr_pages p LEFT JOIN (
            SELECT job_id, filename, page,
                   CAST(sum(CASE WHEN angle = 0 THEN CAST(round(conf * 1000000) AS BIGINT) END) AS BIGINT) AS a,
                   CAST(sum(CASE WHEN angle = 90 THEN CAST(round(conf * 1000000) AS BIGINT) END) AS BIGINT) AS b,
                   CAST(sum(CASE WHEN angle = 180 THEN CAST(round(conf * 1000000) AS BIGINT) END) AS BIGINT) AS c,
                   CAST(sum(CASE WHEN angle = 270 THEN CAST(round(conf * 1000000) AS BIGINT) END) AS BIGINT) AS d
            FROM fx_readable GROUP BY job_id, filename, page) s
        ON p.job_id = s.job_id AND p.filename = s.filename AND p.page = s.page""",
    "fx_ocr_best": """
        SELECT *, greatest(s0, s90, s180, s270) AS top,
               greatest(least(greatest(s0, s90), greatest(s180, s270)), least(s0, s90), least(s180, s270)) AS second,
               CASE greatest(s0, s90, s180, s270) WHEN s0 THEN 0 WHEN s90 THEN 90 WHEN s180 THEN 180 ELSE 270 END AS best
        FROM fx_ocr_scores""",
    "fx_best_lines": """
        SELECT r.*, b.best, b.width, b.height FROM fx_readable r JOIN fx_ocr_best b
        ON r.job_id = b.job_id AND r.filename = b.filename AND r.page = b.page AND r.angle = b.best""",
    "fx_page_lines": r"""
        SELECT CAST(regexp_extract(source, '(\d+)$', 1) AS BIGINT) AS job_id, lang || '.pdf' AS filename,
               CAST(doc_id AS INT) AS page,
               CAST(CASE WHEN doc_id % 5 = 0 THEN doc_id % 4 * 90 ELSE 0 END AS INT) AS rotation,
               CAST(612 AS DOUBLE) AS page_w, CAST(792 AS DOUBLE) AS page_h,
               CAST(doc_id % 41 - 20 AS DOUBLE) / 10 AS skew, ord, text, x0, y0, x0 + 100 AS x1, y0 + size AS y1, size
        FROM (SELECT *,
                CAST(CASE WHEN (doc_id + ord // 4) % 3 <> 0 THEN ord % 4 * 150 + ord % 3 + 40 ELSE 50 END AS DOUBLE) AS x0,
                CAST(ord // 4 * 80 + CASE WHEN (doc_id + ord // 4) % 3 <> 0 THEN ord % 4 * 2 ELSE ord % 4 * 20 END + 40 AS DOUBLE) AS y0,
                CASE WHEN ord = 0 THEN CAST(18 AS DOUBLE) WHEN ord % 11 = 5 THEN CAST(13 AS DOUBLE) ELSE CAST(10 AS DOUBLE) END AS size
              FROM fx_doc_lines) q""",
    "fx_progress": """
        SELECT event_id, user_id AS job_id, ts,
               CASE event_type WHEN 'signup' THEN 'sealed' WHEN 'error' THEN 'file_failed'
                    WHEN 'purchase' THEN 'file_done' ELSE 'page_done' END AS kind,
               'f' || CAST(event_id % 5 AS VARCHAR) || '.pdf' AS filename, CAST(event_id % 40 AS INT) AS page
        FROM events""",
    "fx_upload_chunks": """
        SELECT l_orderkey AS file_id, l_shipdate AS ts, l_partkey AS tie1, l_suppkey AS tie2,
               CAST((l_linenumber - 1) // 2 * 4 * 1048576 AS BIGINT) AS "offset",
               CAST(CASE WHEN l_partkey % 10 = 0 THEN 20 ELSE 4 END * 1048576 AS BIGINT) AS length,
               CAST(12 * 1048576 AS BIGINT) AS size FROM lineitem""",
    "fx_upload_samples": """
        SELECT user_id % 5 AS upload_id, epoch_us(ts) // 100000000 AS t, event_id * 1000 AS sent,
               CAST(2000000000 AS BIGINT) AS total FROM events""",
    "fx_manifest": r"""
        SELECT o_custkey AS upload_id, o_orderkey AS ord,
               CASE o_orderkey % 13 WHEN 0 THEN 'C:\scans\f' || CAST(o_orderkey % 6 AS VARCHAR) || '.PDF'
                    WHEN 1 THEN ' in/f' || CAST(o_orderkey % 6 AS VARCHAR) || '.pdf ' WHEN 2 THEN '..'
                    WHEN 3 THEN 'notes.txt' WHEN 4 THEN '  ' ELSE 'f' || CAST(o_orderkey % 6 AS VARCHAR) || '.pdf' END AS filename,
               CAST(CASE o_orderkey % 19 WHEN 0 THEN 0 WHEN 1 THEN 3000000000 ELSE 1000 + o_orderkey % 2 END AS BIGINT) AS size
        FROM orders""",
}


def with_fixtures(body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Oracle text: ``body`` preceded by the fixture views it needs, in dependency order."""
    views = {**SQL, **(extra or {})}
    order: list[str] = []
    seen: set[str] = set()

    def need(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in views and name not in seen:
                seen.add(name)  # first: a recursive view names itself
                need(views[name])
                order.append(name)

    need(body)
    if not order:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({views[n]})" for n in order) + "\n" + body
