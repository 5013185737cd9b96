"""Text and layout queries (T01..T16) over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageflow import fixtures as fx, rules
from pageflow.functions.text import md_escape
from pageflow.operators import layout as lay
from pageflow.plans.catalog import query
from pageflow.plans.orientation import SPLIT_WORDS

KEYS, FILE = lay.KEYS, lay.FILE
_PAGE = "job_id, filename, page"
_WS = "'" + rules.WHITESPACE + "'"

fx.SQL["fx_page_text"] = f"""
    SELECT {_PAGE}, text, CAST({SPLIT_WORDS.format('text')} AS INT) AS word_count FROM (
        SELECT {_PAGE}, trim(string_agg(text, chr(10) ORDER BY ord), {_WS}) AS text FROM fx_page_lines GROUP BY {_PAGE}) q"""
fx.SQL["fx_display"] = f"""
    SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY round(y0, 1), x0, ord) - 1 AS INT) AS k FROM (
        SELECT {_PAGE}, ord, trim(text, {_WS}) AS text, size, page_w, page_h, rotation,
               CASE rotation WHEN 90 THEN page_h - y1 WHEN 180 THEN page_w - x1 WHEN 270 THEN y0 ELSE x0 END AS x0,
               CASE rotation WHEN 90 THEN x0 WHEN 180 THEN page_h - y1 WHEN 270 THEN page_w - x1 ELSE y0 END AS y0,
               CASE rotation WHEN 90 THEN page_h - y0 WHEN 180 THEN page_w - x0 WHEN 270 THEN y1 ELSE x1 END AS x1,
               CASE rotation WHEN 90 THEN x1 WHEN 180 THEN page_h - y0 WHEN 270 THEN page_w - x0 ELSE y1 END AS y1,
               CASE WHEN rotation IN (90, 270) THEN page_h ELSE page_w END AS display_w
        FROM fx_page_lines WHERE trim(text, {_WS}) <> '') q"""
fx.SQL["fx_row_fold"] = """
    SELECT page, k, 1 AS row_no, (y0 + y1) / 2 AS total, 1 AS n FROM fx_display WHERE k = 0
    UNION ALL
    SELECT d.page, d.k,
           CASE WHEN abs((d.y0 + d.y1) / 2 - r.total / r.n) <= greatest(d.y1 - d.y0, 1) * CAST(0.6 AS DOUBLE) THEN r.row_no ELSE r.row_no + 1 END,
           CASE WHEN abs((d.y0 + d.y1) / 2 - r.total / r.n) <= greatest(d.y1 - d.y0, 1) * CAST(0.6 AS DOUBLE) THEN r.total ELSE 0 END + (d.y0 + d.y1) / 2,
           CASE WHEN abs((d.y0 + d.y1) / 2 - r.total / r.n) <= greatest(d.y1 - d.y0, 1) * CAST(0.6 AS DOUBLE) THEN r.n + 1 ELSE 1 END
    FROM fx_row_fold r JOIN fx_display d ON d.page = r.page AND d.k = r.k + 1"""
fx.SQL["fx_cells"] = """
    SELECT d.*, row_no, replace(replace(text, '|', '\\|'), chr(10), ' ') AS shown FROM fx_display d
    JOIN fx_row_fold r ON d.page = r.page AND d.k = r.k"""
fx.SQL["fx_rows"] = """
    SELECT job_id, filename, page, row_no, count(*) AS cells, string_agg(shown, ' ' ORDER BY x0, k) AS row_text,
           max(size) AS biggest, count(*) >= 3 AS wide FROM fx_cells GROUP BY 1, 2, 3, 4"""
fx.SQL["fx_blocked"] = """
    SELECT *, sum(CASE WHEN wide AND coalesce(before, false) THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY row_no) AS block FROM (
        SELECT *, lag(wide) OVER (PARTITION BY page ORDER BY row_no) AS before FROM fx_rows) q"""
fx.SQL["fx_blocks"] = """
    SELECT job_id, filename, page, block, bool_or(wide) AS wide, count(*) AS n, min(row_no) AS first_row FROM fx_blocked GROUP BY 1, 2, 3, 4"""
fx.SQL["fx_body"] = """
    SELECT job_id, filename, page, coalesce(list_sort(list(size) FILTER (size > 0))[count(*) FILTER (size > 0) // 2 + 1], 0) AS body
    FROM fx_display GROUP BY 1, 2, 3"""
fx.SQL["fx_starts"] = """
    SELECT c.page, b.block, c.x0, c.display_w * CAST(0.04 AS DOUBLE) AS tolerance,
           row_number() OVER (PARTITION BY c.page, b.block ORDER BY c.x0) AS rn
    FROM fx_cells c JOIN fx_blocked b ON c.page = b.page AND c.row_no = b.row_no
    JOIN fx_blocks k ON k.page = b.page AND k.block = b.block WHERE k.wide AND k.n >= 2"""
fx.SQL["fx_column_fold"] = """
    SELECT page, block, rn, x0 AS start_x, 0 AS col FROM fx_starts WHERE rn = 1
    UNION ALL
    SELECT s.page, s.block, s.rn, CASE WHEN s.x0 - f.start_x > s.tolerance THEN s.x0 ELSE f.start_x END,
           CASE WHEN s.x0 - f.start_x > s.tolerance THEN f.col + 1 ELSE f.col END
    FROM fx_column_fold f JOIN fx_starts s ON s.page = f.page AND s.block = f.block AND s.rn = f.rn + 1"""
fx.SQL["fx_columns"] = "SELECT DISTINCT page, block, col, start_x FROM fx_column_fold"
fx.SQL["fx_placed"] = """
    SELECT c.page, b.block, c.row_no, c.k, c.x0, c.shown, m.col FROM fx_cells c
    JOIN fx_blocked b ON c.page = b.page AND c.row_no = b.row_no
    JOIN fx_columns m ON m.page = b.page AND m.block = b.block
    QUALIFY row_number() OVER (PARTITION BY c.page, c.k ORDER BY abs(m.start_x - c.x0), m.col) = 1"""
fx.SQL["fx_table_rows"] = """
    SELECT b.page, b.block, b.row_no, '| ' || string_agg(coalesce(p.texts, ''), ' | ' ORDER BY m.col) || ' |' AS line, count(*) AS cols
    FROM fx_blocked b JOIN fx_columns m ON m.page = b.page AND m.block = b.block
    LEFT JOIN (SELECT page, block, row_no, col, string_agg(shown, ' ' ORDER BY x0, k) AS texts FROM fx_placed GROUP BY 1, 2, 3, 4) p
    ON p.page = b.page AND p.block = b.block AND p.row_no = b.row_no AND p.col = m.col GROUP BY 1, 2, 3"""
fx.SQL["fx_tables"] = """
    SELECT page, block, string_agg(CASE WHEN row_no = low THEN line || chr(10) || '|' || repeat(' --- |', CAST(cols AS INT)) ELSE line END, chr(10) ORDER BY row_no) AS md
    FROM (SELECT *, min(row_no) OVER (PARTITION BY page, block) AS low FROM fx_table_rows) q GROUP BY 1, 2"""
fx.SQL["fx_markdown"] = f"""
    SELECT a.job_id, a.filename, a.page, coalesce(md, '') AS markdown FROM (SELECT DISTINCT {_PAGE} FROM fx_page_lines) a LEFT JOIN (
        SELECT k.page, trim(string_agg(CASE WHEN k.wide AND k.n >= 2 THEN t.md WHEN k.wide THEN r.row_text
                   ELSE CASE WHEN body > 0 AND biggest >= body * CAST(1.5 AS DOUBLE) THEN '# ' WHEN body > 0 AND biggest >= body * CAST(1.25 AS DOUBLE) THEN '## ' ELSE '' END || r.row_text END,
                   chr(10) || chr(10) ORDER BY k.block), {_WS}) AS md
        FROM fx_blocks k JOIN fx_rows r ON r.page = k.page AND r.row_no = k.first_row JOIN fx_body o ON o.page = k.page
        LEFT JOIN fx_tables t ON t.page = k.page AND t.block = k.block GROUP BY k.page) m ON a.page = m.page"""


def _grouped(t):
    return lay.group_rows(lay.display_lines(fx.page_layout(t)))


def _numbered_rows(t):
    return _grouped(t).select(*KEYS, "display_w", "cells", F.posexplode("rows").alias("r", "row"))


def _wide_blocks(t):
    runs = lay.table_runs(_grouped(t))
    blocks = runs.select(*KEYS, "display_w", F.posexplode("blocks").alias("b", "block"))
    return blocks.filter(F.col("block.wide") & (F.size("block.rows") >= 2)).select(
        *KEYS, "display_w", (F.col("b") + 1).alias("block"), F.col("block.rows").alias("rows")
    )


@query("T01_page_text", "SELECT * FROM fx_page_text")
def _(t):
    return lay.page_text(fx.page_layout(t))


@query("T02_text_totals", """
    SELECT job_id, filename, CAST(sum(word_count) AS BIGINT) AS words, count(*) AS pages FROM fx_page_text GROUP BY job_id, filename
    UNION ALL SELECT job_id, NULL, CAST(sum(word_count) AS BIGINT), count(*) FROM fx_page_text GROUP BY job_id""")
def _(t):
    return lay.text_totals(lay.page_text(fx.page_layout(t)))


@query("T03_text_export", """
    SELECT job_id, filename, part,
           CASE WHEN part = min(part) OVER w THEN '===== ' || filename || ' =====' || chr(10) ELSE '' END || chunks
           || CASE WHEN part = max(part) OVER w THEN chr(10) ELSE '' END AS body
    FROM (SELECT job_id, filename, CAST(page // 256 AS BIGINT) AS part,
                 string_agg(chr(10) || '--- Page ' || CAST(page + 1 AS VARCHAR) || ' ---' || chr(10) || text, chr(10) ORDER BY page) AS chunks
          FROM fx_page_text GROUP BY 1, 2, 3) q WINDOW w AS (PARTITION BY job_id, filename)""")
def _(t):
    return lay.text_export(lay.page_text(fx.page_layout(t)))


@query("T04_display_lines", f"SELECT {_PAGE}, k, text, x0, y0, x1, y1, size FROM fx_display")
def _(t):
    shown = lay.display_lines(fx.page_layout(t)).select(*KEYS, F.explode("cells").alias("c"))
    return shown.select(*KEYS, "c.k", "c.text", "c.x0", "c.y0", "c.x1", "c.y1", "c.size")


@query("T05_group_rows", f"SELECT {_PAGE}, k, row_no FROM fx_cells", recursive=True)
def _(t):
    cells = _numbered_rows(t).select(*KEYS, (F.col("r") + 1).alias("row_no"), F.explode("row").alias("c"))
    return cells.select(*KEYS, "c.k", "row_no")


@query("T06_columns_of", "SELECT page, CAST(block AS INT) AS block, col, start_x FROM fx_columns", recursive=True)
def _(t):
    cols = _wide_blocks(t).select(
        "page", "block", F.posexplode(lay.columns_of(F.col("rows"), F.col("display_w"))).alias("col", "start_x")
    )
    return cols


@query("T07_assign_cells", """
    SELECT page, CAST(block AS INT) AS block, CAST(row_number() OVER (PARTITION BY page, block ORDER BY row_no) - 1 AS INT) AS r, line
    FROM fx_table_rows""", recursive=True)
def _(t):
    tables = _wide_blocks(t).withColumn("cols", lay.columns_of(F.col("rows"), F.col("display_w")))
    rows = tables.select("page", "block", F.posexplode(lay.assign_cells(F.col("rows"), F.col("cols"))).alias("r", "texts"))
    return rows.select("page", "block", "r", F.concat(F.lit("| "), F.array_join("texts", " | "), F.lit(" |")).alias("line"))


@query("T08_body_size", "SELECT p.page, coalesce(body, 0) AS body FROM (SELECT DISTINCT page FROM fx_page_lines) p LEFT JOIN fx_body b ON p.page = b.page")
def _(t):
    shown = lay.display_lines(fx.page_layout(t))
    return shown.select("page", lay.body_size(F.col("cells")).alias("body"))


@query("T09_table_runs", f"SELECT {_PAGE}, CAST(block AS INT) AS block, wide, CAST(n AS INT) AS n FROM fx_blocks", recursive=True)
def _(t):
    runs = lay.table_runs(_grouped(t)).select(*KEYS, F.posexplode("blocks").alias("b", "block"))
    return runs.select(*KEYS, (F.col("b") + 1).alias("block"), F.col("block.wide").alias("wide"), F.size("block.rows").alias("n"))


@query("T10_classify_rows", f"""
    SELECT r.job_id, r.filename, r.page, row_no,
           CASE WHEN body > 0 AND biggest >= body * CAST(1.5 AS DOUBLE) THEN '# ' WHEN body > 0 AND biggest >= body * CAST(1.25 AS DOUBLE) THEN '## ' ELSE '' END || row_text AS shown
    FROM fx_rows r JOIN fx_body b ON r.page = b.page""", recursive=True)
def _(t):
    return _numbered_rows(t).select(
        *KEYS, (F.col("r") + 1).alias("row_no"), lay.classify_row(F.col("row"), lay.body_size(F.col("cells"))).alias("shown")
    )


@query("T11_md_escape", rf"SELECT doc_id, trim(replace(replace(replace(text, 'e', '|'), '|', '\|'), chr(10), ' '), {_WS}) AS shown FROM documents")
def _(t):
    """The texts hold few bars: every ``e`` becomes one first."""
    return t["documents"].select("doc_id", md_escape(F.replace("text", F.lit("e"), F.lit("|"))).alias("shown"))


@query("T12_table_markdown", "SELECT page, CAST(block AS INT) AS block, md FROM fx_tables", recursive=True)
def _(t):
    return _wide_blocks(t).select("page", "block", lay.table_markdown(F.col("rows"), F.col("display_w")).alias("md"))


@query("T13_page_markdown", f"SELECT {_PAGE}, markdown FROM fx_markdown", recursive=True)
def _(t):
    return lay.page_markdown(fx.page_layout(t))


fx.SQL["fx_documents"] = """
    SELECT job_id, filename, part, part = min(part) OVER (PARTITION BY job_id, filename) AS is_first,
           CASE WHEN part = min(part) OVER (PARTITION BY job_id, filename) THEN '# ' || filename || chr(10) ELSE '' END || sections AS body
    FROM (SELECT job_id, filename, CAST(page // 256 AS BIGINT) AS part,
                 string_agg(chr(10) || '## Page ' || CAST(page + 1 AS VARCHAR) || chr(10) || chr(10)
                     || CASE WHEN markdown <> '' THEN markdown ELSE '_No text recognised on this page._' END, chr(10) ORDER BY page) AS sections
          FROM (SELECT job_id, filename, page, markdown FROM fx_markdown
                UNION ALL SELECT job_id, filename, max(page) + 1, '' FROM fx_markdown GROUP BY job_id, filename) m GROUP BY 1, 2, 3) q"""


def _documents(t):
    """The page list knows one more page of every file, without any text layer."""
    layout = fx.page_layout(t)
    listed = layout.select(*KEYS)
    blank = listed.groupBy(*KEYS[:2]).agg((F.max("page") + 1).cast("int").alias("page"))
    return lay.document_markdown(listed.unionByName(blank), lay.page_markdown(layout))


@query("T14_document_markdown", "SELECT * FROM fx_documents", recursive=True)
def _(t):
    return _documents(t).drop("opens_job")


@query("T15_job_markdown", """
    SELECT job_id, filename, part, CASE WHEN is_first AND filename <> min(filename) OVER (PARTITION BY job_id)
        THEN chr(10) || '---' || chr(10) || chr(10) ELSE '' END || body AS body FROM fx_documents""", recursive=True)
def _(t):
    return lay.job_markdown(_documents(t))


def _box(a: str, b: str, c: str) -> str:
    zero = "CAST(0 AS DOUBLE)"
    scale = "(CAST(200 AS DOUBLE) / 72)"
    return (f"(ceil(greatest({zero}, {a}, {b}, {c}) * {scale} - 0.001) - floor(least({zero}, {a}, {b}, {c}) * {scale} + 0.001)) / {scale}")


@query("T16_deskew_layer", f"""
    SELECT {_PAGE}, ord, round(new_w, 2) AS new_w, round(new_h, 2) AS new_h,
           round(new_w / 2 + mx * c - my * s - greatest(x1 - x0, 1) / 2, 4) AS anchor_x,
           round(new_h / 2 + mx * s + my * c + greatest(y1 - y0, 1) * CAST(0.35 AS DOUBLE), 4) AS anchor_y
    FROM (SELECT *, {_box('page_w * c', '-page_h * s', 'page_w * c - page_h * s')} AS new_w,
                 {_box('page_w * s', 'page_h * c', 'page_w * s + page_h * c')} AS new_h,
                 (x0 + x1) / 2 - page_w / 2 AS mx, (y0 + y1) / 2 - page_h / 2 AS my
          FROM (SELECT *, cos(radians(-skew)) AS c, sin(radians(-skew)) AS s FROM fx_page_lines) a) b""")
def _(t):
    turned = lay.deskew_layer(fx.page_lines(t))
    return turned.select(
        *KEYS, "ord", F.round("new_w", 2).alias("new_w"), F.round("new_h", 2).alias("new_h"),
        F.round("anchor_x", 4).alias("anchor_x"), F.round("anchor_y", 4).alias("anchor_y"),
    )
