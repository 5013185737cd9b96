"""Text statistics and Markdown from positioned text lines.

The nested shape ``page_layout`` has one row per page with ``lines
array<struct<ord,text,x0,y0,x1,y1,size>>``, ``rotation``, ``page_w`` and ``page_h`` (unrotated).
Rows and columns of a page depend on reading order, so they are folds; on the nested shape
they are ``aggregate()`` expressions inside the page row: JVM side, no exchange, any number
of pages per file or job. :func:`nest_page_lines` brings long lines into this shape.

Whole-file and whole-job texts are emitted in parts of 256 pages instead of one unbounded
string; parts in (file, part) order, joined by a newline, are the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageflow import rules
from pageflow.functions.binding import let
from pageflow.functions.geometry import display_rect
from pageflow.functions.text import md_escape, strip, word_count

KEYS = ["job_id", "filename", "page"]
FILE = ["job_id", "filename"]
PART_PAGES = 256

CELL = "struct<x0:double,k:int,y0:double,x1:double,y1:double,text:string,size:double>"
ROW = f"array<{CELL}>"


def nest_page_lines(pages: DataFrame, page_lines: DataFrame) -> DataFrame:
    """Long lines to the nested shape; pages without lines keep an empty array."""
    line = F.struct("ord", "text", "x0", "y0", "x1", "y1", "size")
    nested = page_lines.groupBy(*KEYS).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    empty = F.array().cast("array<struct<ord:int,text:string,x0:double,y0:double,x1:double,y1:double,size:double>>")
    return pages.join(nested, KEYS, "left").withColumn("lines", F.coalesce("lines", empty))


# ---- plain text ------------------------------------------------------------------------

def page_text(page_layout: DataFrame, file: str | None = None, page: int | None = None) -> DataFrame:
    """Trimmed body and word count of each page."""
    chosen = page_layout
    if file:
        chosen = chosen.filter(F.col("filename") == file)
    if page is not None:
        chosen = chosen.filter(F.col("page") == page)
    body = strip(F.array_join(F.transform("lines", lambda l: l["text"]), "\n"))
    return chosen.select(*KEYS, body.alias("text")).withColumn("word_count", word_count(F.col("text")))


def text_totals(texts: DataFrame) -> DataFrame:
    """Word totals per file, and per job where ``filename`` is null."""
    return texts.rollup("job_id", "filename").agg(
        F.sum("word_count").cast("long").alias("words"), F.count("*").alias("pages"), F.grouping_id().alias("level")
    ).filter(F.col("level") < 3).drop("level")


def _file_parts(pages: DataFrame, text: str, listed: DataFrame | None = None) -> DataFrame:
    """Bounded page blocks of every file with their texts in page order and marks: the file's
    first and last block, the first block of the job's first file.

    ``listed`` are the keys of the same pages, where they are at hand without the texts.
    """
    part = F.floor(F.col("page") / PART_PAGES).cast("long")
    blocks = pages.groupBy(*FILE, part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("page", F.col(text).alias("body")))).alias("pages")
    )
    # From page numbers alone: no text is gathered by file or job.
    keys = (pages if listed is None else listed).select(*KEYS)
    ends = keys.groupBy(*FILE).agg(F.min(part).alias("_first"), F.max(part).alias("_last"))
    ends = ends.withColumn("_opens", F.col("filename") == F.min("filename").over(Window.partitionBy("job_id")))
    return blocks.join(ends, FILE).withColumns(
        {"is_first": F.col("part") == F.col("_first"), "is_last": F.col("part") == F.col("_last")}
    ).withColumn("opens_job", F.col("is_first") & F.col("_opens")).drop("_first", "_last", "_opens")


def text_export(texts: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Plain-text export in parts: file header, pages with 1-based labels, a blank line after the file.

    ``listed`` may give the pages' keys without their texts; else they are taken from ``texts``.
    """
    chunks = F.transform(
        "pages",
        lambda p: F.concat(F.lit("\n--- Page "), (p["page"] + 1).cast("string"), F.lit(" ---\n"), p["body"]),
    )
    head = F.when(F.col("is_first"), F.concat(F.lit("===== "), F.col("filename"), F.lit(" =====\n"))).otherwise("")
    tail = F.when(F.col("is_last"), "\n").otherwise("")
    return _file_parts(texts, "text", listed).select(
        *FILE, "part", F.concat(head, F.array_join(chunks, "\n"), tail).alias("body")
    )


# ---- lines -> rows ---------------------------------------------------------------------

def _rect(l: Column) -> dict[str, Column]:
    return display_rect(
        l["x0"], l["y0"], l["x1"], l["y1"], F.col("rotation"), F.col("page_w"), F.col("page_h")
    )


def display_lines(page_layout: DataFrame) -> DataFrame:
    """Adds ``cells``: nonblank lines where the reader sees them, in (y to 1 decimal, x, order)."""

    def placed(l: Column) -> Column:
        r = _rect(l)
        return F.struct(
            F.round(r["y0"], 1).alias("yk"), r["x0"].alias("x0"), l["ord"].alias("ord"), r["y0"].alias("y0"),
            r["x1"].alias("x1"), r["y1"].alias("y1"), strip(l["text"]).alias("text"), l["size"].alias("size"),
        )

    shown = F.sort_array(
        F.transform(F.filter("lines", lambda l: strip(l["text"]) != ""), placed)
    )
    cells = F.transform(
        shown,
        lambda l, k: F.struct(
            l["x0"].alias("x0"), k.cast("int").alias("k"), l["y0"].alias("y0"), l["x1"].alias("x1"),
            l["y1"].alias("y1"), l["text"].alias("text"), l["size"].alias("size"),
        ),
    )
    width = F.when(F.col("rotation").isin(90, 270), F.col("page_h")).otherwise(F.col("page_w"))
    return page_layout.withColumns({"cells": cells, "display_w": F.greatest(width, F.lit(1.0))})


def group_rows(shown: DataFrame) -> DataFrame:
    """Adds ``rows``: cells sharing a visual row, each row by x.

    A cell joins the current row when its centre is within 0.6 of its own height (at least one
    unit) of the running mean of the row's centres.
    """
    state = f"struct<done:array<{ROW}>,row:{ROW},total:double,n:int>"
    start = F.struct(
        F.array().alias("done"), F.array().alias("row"), F.lit(0.0).alias("total"), F.lit(0).alias("n")
    ).cast(state)

    def step(s: Column, cell: Column) -> Column:
        centre = (cell["y0"] + cell["y1"]) / 2
        reach = F.greatest(cell["y1"] - cell["y0"], F.lit(1.0)) * rules.ROW_TOLERANCE
        joins = (s["n"] > 0) & (F.abs(centre - s["total"] / F.greatest(s["n"], F.lit(1))) <= reach)
        closes = (s["n"] > 0) & ~joins
        return F.struct(
            F.when(closes, F.concat(s["done"], F.array(s["row"]))).otherwise(s["done"]).alias("done"),
            F.when(joins, F.concat(s["row"], F.array(cell))).otherwise(F.array(cell)).alias("row"),
            F.when(joins, s["total"] + centre).otherwise(centre).alias("total"),
            F.when(joins, s["n"] + 1).otherwise(F.lit(1)).alias("n"),
        )

    def finish(s: Column) -> Column:
        rows = F.when(s["n"] > 0, F.concat(s["done"], F.array(s["row"]))).otherwise(s["done"])
        return F.transform(rows, lambda r: F.sort_array(r))

    return shown.withColumn("rows", F.aggregate("cells", start, step, finish))


# ---- rows -> tables --------------------------------------------------------------------

def columns_of(rows: Column, page_width: Column) -> Column:
    """Column starts of a run of rows: a new one when over 4 % of the page width right of the last."""
    starts = F.sort_array(F.flatten(F.transform(rows, lambda r: F.transform(r, lambda c: c["x0"]))))
    tolerance = page_width * rules.COLUMN_TOLERANCE
    opens = lambda cols, x: (F.size(cols) == 0) | (x - F.element_at(cols, -1) > tolerance)
    # A guard keeps element_at away from the empty array (ANSI mode).
    return F.aggregate(
        starts,
        F.array().cast("array<double>"),
        lambda cols, x: F.when(F.size(cols) == 0, F.array(x)).when(opens(cols, x), F.concat(cols, F.array(x))).otherwise(cols),
    )


def nearest_column(columns: Column, x: Column) -> Column:
    """0-based index of the closest column start, the leftmost on a tie."""
    return F.array_min(
        F.transform(columns, lambda c, i: F.struct(F.abs(c - x).alias("d"), i.alias("i")))
    )["i"]


def assign_cells(rows: Column, columns: Column) -> Column:
    """Table texts: per row one string per column, several cells of a column joined by a space.

    Columns that stay empty in every row are dropped.
    """
    placed = F.transform(
        rows,
        lambda r: F.transform(
            r, lambda c: F.struct(nearest_column(columns, c["x0"]).alias("i"), md_escape(c["text"]).alias("text"))
        ),
    )

    def table(p: Column) -> Column:
        used = F.array_distinct(F.flatten(F.transform(p, lambda r: F.transform(r, lambda c: c["i"]))))
        texts = lambda r, i: F.transform(F.filter(r, lambda c: c["i"] == i), lambda c: c["text"])
        return let(
            F.sort_array(used),
            lambda u: F.transform(p, lambda r: F.transform(u, lambda i: strip(F.array_join(texts(r, i), " ")))),
        )

    return let(placed, table)


def table_markdown(rows: Column, page_width: Column) -> Column:
    """Header, ruler and body lines of one table."""
    line = lambda texts: F.concat(F.lit("| "), F.array_join(texts, " | "), F.lit(" |"))

    def render(cells: Column) -> Column:
        ruler = line(F.transform(F.element_at(cells, 1), lambda _: F.lit("---")))
        numbered = F.transform(
            cells, lambda texts, i: F.when(i == 0, F.concat_ws("\n", line(texts), ruler)).otherwise(line(texts))
        )
        return F.array_join(numbered, "\n")

    return let(columns_of(rows, page_width), lambda columns: let(assign_cells(rows, columns), render))


def body_size(cells: Column) -> Column:
    """Upper median of the positive font sizes, 0 without any."""
    sizes = F.sort_array(F.filter(F.transform(cells, lambda c: c["size"]), lambda s: s > 0))
    return F.coalesce(F.get(sizes, F.floor(F.size(sizes) / 2).cast("int")), F.lit(0.0))


def table_runs(grouped: DataFrame) -> DataFrame:
    """Adds ``blocks``: maximal runs of rows with at least three cells, other rows alone."""
    block = f"struct<wide:boolean,rows:array<{ROW}>>"

    def step(blocks: Column, row: Column) -> Column:
        wide = F.size(row) >= rules.TABLE_MIN_CELLS
        last = F.get(blocks, F.size(blocks) - 1)
        extended = F.struct(F.lit(True).alias("wide"), F.concat(last["rows"], F.array(row)).alias("rows"))
        fresh = F.struct(wide.alias("wide"), F.array(row).alias("rows"))
        grows = wide & F.coalesce(last["wide"], F.lit(False))
        return F.when(
            grows, F.concat(F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0))), F.array(extended))
        ).otherwise(F.concat(blocks, F.array(fresh)))

    return grouped.withColumn("blocks", F.aggregate("rows", F.array().cast(f"array<{block}>"), step))


def row_text(row: Column) -> Column:
    return F.array_join(F.transform(row, lambda c: md_escape(c["text"])), " ")


def heading_prefix(biggest: Column, body: Column) -> Column:
    """``# `` / ``## `` for clearly larger text, nothing for paragraphs or an unknown body size."""
    top = body * rules.HEADING_RATIO * rules.TOP_HEADING_FACTOR
    return (
        F.when((body > 0) & (biggest >= top), "# ")
        .when((body > 0) & (biggest >= body * rules.HEADING_RATIO), "## ").otherwise("")
    )


def classify_row(row: Column, body: Column) -> Column:
    biggest = F.array_max(F.transform(row, lambda c: c["size"]))
    return F.concat(heading_prefix(biggest, body), row_text(row))


def _block_markdown(b: Column, body: Column, page_width: Column) -> Column:
    first = F.element_at(b["rows"], 1)
    return (
        F.when(b["wide"] & (F.size(b["rows"]) >= 2), table_markdown(b["rows"], page_width))
        .when(b["wide"], row_text(first))
        .otherwise(classify_row(first, body))
    )


def page_markdown(page_layout: DataFrame) -> DataFrame:
    """Markdown of every page; pages without lines give an empty text."""
    folded = table_runs(group_rows(display_lines(page_layout))).withColumn("body", body_size(F.col("cells")))
    parts = F.filter(
        F.transform("blocks", lambda b: _block_markdown(b, F.col("body"), F.col("display_w"))), lambda p: p != ""
    )
    return folded.select(*KEYS, strip(F.array_join(parts, "\n\n")).alias("markdown"))


def document_markdown(pages: DataFrame, markdown: DataFrame | None = None) -> DataFrame:
    """Markdown of every file in parts of 256 pages.

    ``pages`` are all pages of the files. ``markdown`` may lack some; they show a notice.
    ``opens_job`` marks the first part of the job's first file.
    """
    every = pages if markdown is None else pages.select(*KEYS).join(markdown, KEYS, "left")
    shown = every.withColumn(
        "markdown", F.when(F.coalesce("markdown", F.lit("")) != "", F.col("markdown")).otherwise(rules.EMPTY_PAGE_TEXT)
    )
    sections = F.transform(
        "pages", lambda p: F.concat(F.lit("\n## Page "), (p["page"] + 1).cast("string"), F.lit("\n\n"), p["body"])
    )
    head = F.when(F.col("is_first"), F.concat(F.lit("# "), F.col("filename"), F.lit("\n"))).otherwise("")
    return _file_parts(shown, "markdown", pages).select(
        *FILE, "part", "is_first", "opens_job", F.concat(head, F.array_join(sections, "\n")).alias("body")
    )


def job_markdown(documents: DataFrame) -> DataFrame:
    """Document parts with the rule that separates a file from the job's previous one: first parts
    carry it, except the job's first file."""
    separated = F.col("is_first") & ~F.col("opens_job")
    return documents.select(
        *FILE, "part", F.concat(F.when(separated, "\n---\n\n").otherwise(""), F.col("body")).alias("body")
    )


# ---- straightening ---------------------------------------------------------------------

DESKEW_DPI = 200.0


def deskew_layer(page_lines: DataFrame) -> DataFrame:
    """Text anchors after turning a page by ``-skew``: lines turn about the page centre into the new page's.

    ``page_w``/``page_h`` are the page as shown. The new page is the turned page's pixel bounding
    box at 200 dpi; a line's box keeps its size (at least 1 x 1).
    """
    theta = F.radians(-F.col("skew"))
    scale = DESKEW_DPI / rules.POINTS_PER_INCH
    w, h = F.col("page_w"), F.col("page_h")
    turned = page_lines.withColumns({"_c": F.cos(theta), "_s": F.sin(theta)})
    c, s = F.col("_c"), F.col("_s")

    def pixels(*corners: Column) -> Column:
        zero = F.lit(0.0)
        lo, hi = F.least(zero, *corners) * scale, F.greatest(zero, *corners) * scale
        return F.ceil(hi - 0.001) - F.floor(lo + 0.001)

    sized = turned.withColumns(
        {
            "new_w": pixels(w * c, -h * s, w * c - h * s) / scale,
            "new_h": pixels(w * s, h * c, w * s + h * c) / scale,
            "_mx": (F.col("x0") + F.col("x1")) / 2 - w / 2,
            "_my": (F.col("y0") + F.col("y1")) / 2 - h / 2,
            "width": F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0)),
            "height": F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0)),
        }
    )
    rx = F.col("new_w") / 2 + F.col("_mx") * c - F.col("_my") * s
    ry = F.col("new_h") / 2 + F.col("_mx") * s + F.col("_my") * c
    return sized.withColumns(
        {
            "anchor_x": rx - F.col("width") / 2,
            "anchor_y": ry + F.col("height") * 0.35,
        }
    ).drop("_c", "_s", "_mx", "_my")
