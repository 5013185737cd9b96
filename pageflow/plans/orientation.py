"""Orientation queries (A01..A19) over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageflow import fixtures as fx
from pageflow.functions.text import word_count
from pageflow.operators import orientation as o
from pageflow.plans.catalog import query
from pageflow.rules import GLYPH_WIDTHS, OTHER_GLYPH_WIDTH

KEYS = o.KEYS
_PAGE = "job_id, filename, page"


@query("A01_readable_lines", f"SELECT {_PAGE}, angle, ord, conf, CAST(length(text) AS INT) AS chars FROM fx_readable")
def _(t):
    return o.readable_lines(fx.ocr_lines(t)).select(*KEYS, "angle", "ord", "conf", F.length("text").alias("chars"))


@query("A02_rotation_scores", f"SELECT {_PAGE}, s0, s90, s180, s270 FROM fx_ocr_scores")
def _(t):
    return o.rotation_scores(fx.ocr_lines(t), fx.ocr_pages(t)).select(*KEYS, *o.SCORES)


@query("A03_best_rotation", f"SELECT {_PAGE}, CAST(best AS INT) AS best FROM fx_best")
def _(t):
    return fx.pages(t).select(*KEYS, o.best_rotation().alias("best"))


@query("A04_runner_up", f"SELECT {_PAGE}, second AS runner_up FROM fx_best")
def _(t):
    return fx.pages(t).select(*KEYS, o.runner_up().alias("runner_up"))


@query("A05_decide_angle", f"SELECT {_PAGE}, CAST(angle AS INT) AS angle, reason FROM fx_decided")
def _(t):
    return o.decide_angle(fx.pages(t)).select(*KEYS, F.col("angle").cast("int").alias("angle"), "reason")


@query("A06_metadata_shortcut", f"""
    SELECT {_PAGE}, meta_rotation AS angle, 'metadata' AS method, false AS needs_review, CAST(NULL AS VARCHAR) AS reason
    FROM fx_ocr_pages WHERE meta_rotation <> 0 AND meta_rotation % 90 = 0""")
def _(t):
    return o.metadata_shortcut(fx.ocr_pages(t))


@query("A07_error_result", f"""
    SELECT {_PAGE}, CAST(0 AS INT) AS angle, 'error' AS method, true AS needs_review, 'error' AS reason
    FROM fx_ocr_pages WHERE error IS NOT NULL""")
def _(t):
    return o.error_result(fx.ocr_pages(t))


@query("A09_flag_blank", f"""
    SELECT {_PAGE}, CASE WHEN ink_ratio < 0.002 THEN 'blank' ELSE reason END AS reason FROM fx_decided""")
def _(t):
    return o.flag_blank(o.decide_angle(fx.pages(t))).select(*KEYS, "reason")


@query("A10_skew_degrees", f"""
    SELECT {_PAGE}, round(median(degrees(atan2(fall, w))), 2) AS skew FROM fx_best_lines
    WHERE abs(w) >= 1 AND abs(degrees(atan2(fall, w))) <= 20 GROUP BY {_PAGE}""")
def _(t):
    return o.skew_degrees(fx.best_lines(t))


@query("A11_flag_skew", "SELECT reason, CAST(angle AS INT) AS angle, count(*) AS pages FROM fx_flagged GROUP BY 1, 2")
def _(t):
    flagged = o.decide(fx.pages(t))
    return flagged.groupBy("reason", F.col("angle").cast("int").alias("angle")).agg(F.count("*").alias("pages"))


_CORNERS = """
    SELECT job_id, filename, page, ord, text, conf, best, width, height,
           x0 AS ax, y0 AS ay, x0 + w AS bx, y0 + fall AS by_, x0 + w AS cx, y0 + h + fall AS cy, x0 AS dx, y0 + h AS dy
    FROM fx_best_lines"""


def _back(x: str, y: str) -> str:
    return (f"CASE best WHEN 90 THEN {y} WHEN 180 THEN width - {x} WHEN 270 THEN width - {y} ELSE {x} END",
            f"CASE best WHEN 90 THEN height - {x} WHEN 180 THEN height - {y} WHEN 270 THEN {x} ELSE {y} END")


_XS, _YS = zip(*[_back(x, y) for x, y in (("ax", "ay"), ("bx", "by_"), ("cx", "cy"), ("dx", "dy"))])


@query("A12_unrotate_box", f"""
    SELECT {_PAGE}, ord, round({_XS[0]}, 6) AS x0, round({_YS[0]}, 6) AS y0, round({_XS[2]}, 6) AS x2, round({_YS[2]}, 6) AS y2
    FROM ({_CORNERS}) q""")
def _(t):
    b = o.unrotate_box(fx.best_lines(t))
    return b.select(*KEYS, "ord", *[
        F.round(F.col("box")[i][a], 6).alias(f"{a}{i}") for i in (0, 2) for a in ("x", "y")
    ])


_RECT = f"""
    SELECT {_PAGE}, ord, text, round(conf, 3) AS conf,
           round(least({', '.join(_XS)}) * CAST(0.72 AS DOUBLE), 2) AS rx0, round(least({', '.join(_YS)}) * CAST(0.72 AS DOUBLE), 2) AS ry0,
           round(greatest({', '.join(_XS)}) * CAST(0.72 AS DOUBLE), 2) AS rx1, round(greatest({', '.join(_YS)}) * CAST(0.72 AS DOUBLE), 2) AS ry1
    FROM ({_CORNERS}) q"""


@query("A13_text_layer", _RECT)
def _(t):
    layer = o.text_layer_lines(o.unrotate_box(fx.best_lines(t)))
    return layer.select(*KEYS, "ord", "text", "conf", *[
        F.col("rect")[i].alias(n) for i, n in enumerate(("rx0", "ry0", "rx1", "ry1"))
    ])


# RE2 classes equal to the engine's White_Space plus U+001C..U+001F.
SPLIT_WORDS = r"""len(list_filter(string_split_regex({0}, '[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda w: w <> ''))"""


@query("A14_word_count", f"""
    SELECT {_PAGE}, CAST(sum({SPLIT_WORDS.format('text')}) AS BIGINT) AS word_count FROM fx_best_lines GROUP BY {_PAGE}""")
def _(t):
    return fx.best_lines(t).groupBy(*KEYS).agg(F.sum(word_count(F.col("text"))).alias("word_count"))


@query("A15_score_map", f"""
    SELECT {_PAGE}, CAST(u.angle AS VARCHAR) AS angle, floor(u.score * 10 + 0.5 + 1e-9) / 10 AS score
    FROM fx_ocr_scores, LATERAL (VALUES (0, s0), (90, s90), (180, s180), (270, s270)) u(angle, score)""")
def _(t):
    scored = o.score_map(o.rotation_scores(fx.ocr_lines(t), fx.ocr_pages(t)))
    return scored.select(*KEYS, F.explode("scores").alias("angle", "score"))


@query("A16_apply_rotation", f"""
    SELECT {_PAGE}, CAST(CASE WHEN angle = 0 THEN rotation WHEN method = 'metadata' THEN 0
        ELSE ((rotation - angle) % 360 + 360) % 360 END AS INT) AS new_rotation
    FROM (SELECT *, CAST(90 * (job_id % 4) AS INT) AS rotation FROM fx_results) q""")
def _(t):
    current = fx.results(t).withColumn("rotation", (90 * (F.col("job_id") % 4)).cast("int"))
    return o.apply_rotation(current).select(*KEYS, F.col("new_rotation").cast("int").alias("new_rotation"))


@query("A17_rotation_summary", """
    SELECT p.job_id, p.filename, CAST(coalesce(angle, 0) AS VARCHAR) || '_degrees_via_' || coalesce(method, 'default') AS outcome,
           count(*) AS pages
    FROM (SELECT job_id, filename, unnest(generate_series(0, pages - 1)) AS page FROM fx_job_files WHERE pages > 0) p
    LEFT JOIN fx_results r ON p.job_id = r.job_id AND p.filename = r.filename AND p.page = r.page
    GROUP BY 1, 2, 3""")
def _(t):
    from pageflow.operators.jobs import expand_pages

    return o.rotation_summary(expand_pages(fx.job_files(t)), fx.results(t))


_FLAG = "CASE WHEN error IS NOT NULL THEN 'error' WHEN declared THEN NULL WHEN ink_ratio < 0.002 THEN 'blank' ELSE coalesce(first_reason, CASE WHEN abs(tilt) >= 0.75 THEN 'skewed' END) END"


@query("A18_analyze_orientation", f"""
    SELECT {_PAGE},
           CAST(CASE WHEN error IS NOT NULL THEN 0 WHEN declared THEN meta_rotation ELSE decided END AS INT) AS angle,
           CASE WHEN error IS NOT NULL THEN 'error' WHEN declared THEN 'metadata' ELSE 'universal_recognizer' END AS method,
           CASE WHEN error IS NULL AND NOT declared THEN floor(s0 * 10 + 0.5 + 1e-9) / 10 END AS score_0,
           CASE WHEN error IS NULL AND NOT declared THEN floor(s90 * 10 + 0.5 + 1e-9) / 10 END AS score_90,
           CASE WHEN error IS NULL AND NOT declared THEN floor(s180 * 10 + 0.5 + 1e-9) / 10 END AS score_180,
           CASE WHEN error IS NULL AND NOT declared THEN floor(s270 * 10 + 0.5 + 1e-9) / 10 END AS score_270,
           {_FLAG} IS NOT NULL AS needs_review, {_FLAG} AS reason,
           CASE WHEN error IS NULL AND NOT declared THEN tilt END AS skew,
           CASE WHEN error IS NULL AND NOT declared THEN round(ink_ratio, 5) END AS ink_ratio,
           CAST(CASE WHEN error IS NULL AND NOT declared THEN words END AS INT) AS word_count,
           CAST(CASE WHEN error IS NULL AND NOT declared THEN layer_lines ELSE 0 END AS INT) AS text_lines
    FROM (
        SELECT b.*, meta_rotation <> 0 AND meta_rotation % 90 = 0 AS declared,
               CASE WHEN top < 5 OR (best <> 0 AND top - s0 < 2) THEN 0 ELSE (360 - best) % 360 END AS decided,
               CASE WHEN top < 5 THEN 'no_text' WHEN best <> 0 AND top - s0 < 2 THEN 'close_to_zero'
                    WHEN second > 0 AND (top - second) / top < 0.25 THEN 'ambiguous' END AS first_reason,
               coalesce(l.tilt, 0) AS tilt, coalesce(l.words, 0) AS words, coalesce(l.n, 0) AS layer_lines
        FROM fx_ocr_best b LEFT JOIN (
            SELECT {_PAGE}, count(*) AS n, sum({SPLIT_WORDS.format('text')}) AS words,
                   round(median(CASE WHEN abs(w) >= 1 AND abs(degrees(atan2(fall, w))) <= 20 THEN degrees(atan2(fall, w)) END), 2) AS tilt
            FROM fx_best_lines GROUP BY {_PAGE}) l
        ON b.job_id = l.job_id AND b.filename = l.filename AND b.page = l.page) q""")
def _(t):
    return o.analyze_orientation(fx.page_ocr(t)).select(
        *KEYS, "angle", "method",
        *[F.col("scores")[a].alias(f"score_{a}") for a in ("0", "90", "180", "270")],
        "needs_review", "reason", "skew", "ink_ratio", "word_count", F.size("text").alias("text_lines"),
    )


def _width_sql(text: str) -> str:
    """Natural width of ``text`` at size 1000, from the same metrics."""
    quoted = lambda characters: characters.replace("'", "''")
    cases = " ".join(f"WHEN contains('{quoted(c)}', x) THEN {w}" for w, c in GLYPH_WIDTHS.items())
    return f"list_sum([CASE {cases} ELSE {OTHER_GLYPH_WIDTH} END for x in string_split({text}, '')])"


@query("A19_text_layer_placeable", f"""
    SELECT {_PAGE}, count(*) AS lines, CAST(sum(CAST(round((ry1 - (ry1 - ry0) * 0.15) * 10000) AS BIGINT)) AS BIGINT) AS baselines,
           CAST(sum(CAST(round(greatest(least((rx1 - rx0) * 1000 / CAST({_width_sql("trim(text)")} AS DOUBLE), 100.0::DOUBLE), 0.5::DOUBLE) * 10000) AS BIGINT)) AS BIGINT) AS sizes
    FROM ({_RECT}) q WHERE rx1 - rx0 > 0 AND ry1 - ry0 > 0 AND length(trim(text)) > 0 GROUP BY {_PAGE}""")
def _(t):
    layer = o.text_layer_placeable(o.text_layer_lines(o.unrotate_box(fx.best_lines(t))))
    return layer.groupBy(*KEYS).agg(
        F.count("*").alias("lines"), F.sum(F.round(F.col("base_y") * 10000).cast("long")).alias("baselines"),
        F.sum(F.round(F.col("font_size") * 10000).cast("long")).alias("sizes"),
    )
