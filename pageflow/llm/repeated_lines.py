"""Line removal by site-relative frequency; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageflow.llm.scratch import same_key

MAX_RATIO = 0.1
MIN_PAGES = 1
MIN_REPEATS = 3
BLANK = " \t\r\x0b\x0c"


def _keys(text: Column) -> Column:
    """Hashes of a text's lines, trimmed; null for a line without content."""
    line_key = lambda line: F.when(F.length(F.btrim(line, F.lit(BLANK))) > 0, F.xxhash64(F.btrim(line, F.lit(BLANK))))
    return F.transform(F.split(text, "\n", -1), line_key)


def site_lines(pages: DataFrame, folder: str = "folder", text: str = "text",
               max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``folder, lines``: hashes of the lines on more than ``max_ratio`` of a folder's texts, and
    on at least ``MIN_REPEATS``.

    A line counts once per text. Counts are combined before the exchange on (folder, line), so
    a folder with a third of all texts is spread over all tasks. A list has at most (mean lines
    per text) / ``max_ratio`` entries, whatever the folder's size.
    """
    rows = pages.select(F.col(folder).alias("folder"), F.col(text).alias("text"))
    totals = rows.groupBy("folder").agg(F.count("*").alias("total")).filter(F.col("total") >= min_pages)
    counts = (
        rows.select("folder", F.explode(F.array_distinct(F.array_compact(_keys(F.col("text"))))).alias("line"))
        .groupBy("folder", "line").agg(F.count("*").alias("n"))
        # No folder that is judged can have fewer, so single lines never reach the join.
        .filter((F.col("n") > max_ratio * min_pages) & (F.col("n") >= MIN_REPEATS))
    )
    c, t = counts.alias("c"), totals.alias("t")
    return (
        c.join(t, same_key(F.col("c.folder"), F.col("t.folder")))
        .filter(F.col("n") > max_ratio * F.col("total"))
        .groupBy(F.col("c.folder").alias("folder")).agg(F.collect_list("line").alias("lines"))
    )


def drop_site_lines(pages: DataFrame, folder: str = "folder", text: str = "text",
                    max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Recognised texts without the lines that their folder repeats on most texts.

    Running headers, footers and stamps of a folder: a line is dropped where the texts of the
    folder containing it, divided by all texts of the folder, exceed ``max_ratio``, and are
    ``MIN_REPEATS`` at least (as they are in any folder of 20 texts at the default ratio). Every
    folder is judged; with ``min_pages`` those of fewer texts are left alone. Lines are compared
    without outer blanks.

    Returns all input columns with ``text`` cleaned, and ``lines_dropped``. Rows are never
    dropped: a text of boilerplate only becomes empty. Null text stays null (0 dropped); texts
    without a folder form one folder; a blank line is neither counted nor dropped; a repeated
    row counts as one more text; other columns pass through, but an input column named
    ``lines_dropped`` is replaced.
    """
    lists = site_lines(pages, folder, text, max_ratio, min_pages)
    kept = [c for c in pages.columns if c != "lines_dropped"]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    joined = rows.alias("p").join(
        lists.alias("s"), same_key(F.col(f"p.row.`{folder}`"), F.col("s.folder")), "left"
    )
    body = F.col(f"row.`{text}`")
    # Set intersection first: most texts then compare their lines with no or one hash.
    marked = joined.select(
        "row", F.coalesce(F.array_intersect(_keys(body), F.col("lines")), F.array().cast("array<bigint>")).alias("bad")
    )
    lines, keys = F.split(body, "\n", -1), _keys(body)
    keep = F.transform(
        F.filter(F.arrays_zip(lines.alias("line"), keys.alias("key")),
                 lambda z: z["key"].isNull() | ~F.array_contains(F.col("bad"), z["key"])),
        lambda z: z["line"],
    )
    clean = F.when(F.size("bad") > 0, F.array_join(keep, "\n")).otherwise(body)
    dropped = F.when(F.size("bad") > 0, F.size(lines) - F.size(keep)).otherwise(F.lit(0)).cast("long")
    return marked.select(
        *[clean.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in kept], dropped.alias("lines_dropped")
    )
