"""Page orientation: score four rotations, decide, flag, measure tilt, map boxes back.

Two input shapes. *Long* ``ocr_lines`` has one row per recognised line and costs one
exchange on the page key. *Nested* ``page_ocr`` has one row per page with its lines as an
array, exactly as a recogniser returns them; everything on it is a row-local expression,
so :func:`analyze_orientation` runs without any shuffle.

Confidences are added as whole millionths: the sum does not depend on row order, so the
5.0 / 2.0 / 0.25 thresholds give the same verdict under any partitioning.
Emitted values are rounded half up on their shortest decimal form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageflow import rules
from pageflow.functions import geometry
from pageflow.functions.binding import let
from pageflow.functions.text import natural_width, strip, word_count

KEYS = ["job_id", "filename", "page"]
SCORES = [f"s{a}" for a in rules.ROTATIONS]
TEXT_LAYER = "array<struct<text:string,conf:double,rect:array<double>>>"


# ---- lines -> scores -------------------------------------------------------------------

def is_readable(conf: Column, box: Column) -> Column:
    """A confident line whose box is wider than 0.8 of its height, so upright text only."""
    return (conf > rules.MIN_LINE_CONF) & (
        geometry.extent(box, "x") > geometry.extent(box, "y") * rules.UPRIGHT_ASPECT
    )


def readable_lines(ocr_lines: DataFrame) -> DataFrame:
    return ocr_lines.filter(is_readable(F.col("conf"), F.col("box")))


def _micros(conf: Column) -> Column:
    return F.round(conf * 1_000_000).cast("long")


def angle_score(lines: str, angle: int) -> Column:
    """Score of one rotation from a page's array of readable lines."""
    return F.aggregate(
        F.filter(lines, lambda l: l["angle"] == angle),
        F.lit(0).cast("long"),
        lambda acc, l: acc + _micros(l["conf"]),
    ) / F.lit(1e6)


def rotation_scores(ocr_lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Sum of confidence per tried rotation for every page, 0 where nothing was readable."""
    sums = readable_lines(ocr_lines).groupBy(*KEYS).agg(
        *[
            F.sum(F.when(F.col("angle") == a, _micros(F.col("conf")))).alias(f"s{a}")
            for a in rules.ROTATIONS
        ]
    )
    joined = pages.join(sums, KEYS, "left")
    return joined.withColumns({s: F.coalesce(F.col(s), F.lit(0)) / F.lit(1e6) for s in SCORES})


# ---- scores -> decision ----------------------------------------------------------------

def best_score() -> Column:
    return F.greatest(*[F.col(s) for s in SCORES])


def best_rotation() -> Column:
    """Rotation with the highest score; the lowest rotation wins a tie."""
    top = best_score()
    return (
        F.when(F.col("s0") == top, 0).when(F.col("s90") == top, 90)
        .when(F.col("s180") == top, 180).otherwise(270)
    )


def runner_up() -> Column:
    """Second largest of the four scores (the maximum itself on a tie), without building arrays."""
    a, b, c, d = (F.col(s) for s in SCORES)
    return F.greatest(F.least(F.greatest(a, b), F.greatest(c, d)), F.least(a, b), F.least(c, d))


def decide_angle(scores: DataFrame) -> DataFrame:
    """Adds ``best``, ``angle`` and the first ``reason`` (null when the decision is clear)."""
    with_best = scores.withColumns(
        {"best": best_rotation(), "top": best_score(), "second": runner_up()}
    )
    guess = F.col("top") < rules.LOW_SCORE
    near_zero = (F.col("best") != 0) & (F.col("top") - F.col("s0") < rules.ZERO_MARGIN)
    close_call = (F.col("second") > 0) & (
        (F.col("top") - F.col("second")) / F.col("top") < rules.AMBIGUOUS_RATIO
    )
    return with_best.withColumns(
        {
            "angle": F.when(guess | near_zero, 0).otherwise((360 - F.col("best")) % 360),
            "reason": F.when(guess, "no_text").when(near_zero, "close_to_zero")
            .when(close_call, "ambiguous"),
        }
    ).drop("top", "second")


def flag_blank(df: DataFrame) -> DataFrame:
    """Hardly any ink outranks every earlier reason; the angle stays."""
    return df.withColumn(
        "reason", F.when(F.col("ink_ratio") < rules.BLANK_INK, "blank").otherwise(F.col("reason"))
    )


def flag_skew(df: DataFrame) -> DataFrame:
    """A noticeable tilt is reported only on pages without another reason. Runs after :func:`flag_blank`."""
    tilted = F.col("reason").isNull() & (F.abs(F.col("skew")) >= rules.SKEW_REPORT_DEGREES)
    return df.withColumn("reason", F.when(tilted, "skewed").otherwise(F.col("reason")))


def review_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("needs_review", F.col("reason").isNotNull())


def decide(scores: DataFrame) -> DataFrame:
    """Scores, ink and skew columns to angle, reason and review flag; a pure projection."""
    return review_flag(flag_skew(flag_blank(decide_angle(scores))))


def has_metadata_angle(rotation: Column) -> Column:
    return F.coalesce((rotation != 0) & (rotation % 90 == 0), F.lit(False))


def metadata_shortcut(pages: DataFrame) -> DataFrame:
    """Pages whose declared rotation settles the matter; no scores, no review, no text."""
    return pages.filter(has_metadata_angle(F.col("meta_rotation"))).select(
        *KEYS,
        F.col("meta_rotation").cast("int").alias("angle"),
        F.lit("metadata").alias("method"),
        F.lit(False).alias("needs_review"),
        F.lit(None).cast("string").alias("reason"),
    )


def error_result(pages: DataFrame) -> DataFrame:
    """Pages whose analysis failed: left unrotated and sent to review."""
    return pages.filter(F.col("error").isNotNull()).select(
        *KEYS,
        F.lit(0).alias("angle"),
        F.lit("error").alias("method"),
        F.lit(True).alias("needs_review"),
        F.lit("error").alias("reason"),
    )


# ---- lines of the winning rotation -----------------------------------------------------

def skew_degrees(best_lines: DataFrame) -> DataFrame:
    """Exact median tilt of each page's lines, 2 decimals; pages without a usable line are absent."""
    return (
        best_lines.select(*KEYS, geometry.tilt_degrees(F.col("box")).alias("tilt"))
        .filter(F.col("tilt").isNotNull())
        .groupBy(*KEYS)
        .agg(F.round(F.median("tilt"), 2).alias("skew"))
    )


def unrotate_box(best_lines: DataFrame) -> DataFrame:
    """Boxes of the winning rotation in the coordinates of the original page (``width`` x ``height``)."""
    return best_lines.withColumn(
        "box", geometry.unrotate(F.col("box"), F.col("best"), F.col("width"), F.col("height"))
    )


def _point_rect(box: Column) -> Column:
    scale = rules.POINTS_PER_INCH / rules.RENDER_DPI
    corners = (
        geometry.low(box, "x"), geometry.low(box, "y"), geometry.high(box, "x"), geometry.high(box, "y")
    )
    return F.array(*[F.round(c * scale, 2) for c in corners])


def text_layer_lines(original_lines: DataFrame) -> DataFrame:
    """One row per searchable line: rectangle in points, confidence to 3 decimals."""
    return original_lines.withColumns(
        {"rect": _point_rect(F.col("box")), "conf": F.round(F.col("conf"), 3)}
    )


def score_map(scores: DataFrame) -> DataFrame:
    """``{"0": .., "90": .., "180": .., "270": ..}`` with one decimal."""
    pairs = [c for a in rules.ROTATIONS for c in (F.lit(str(a)), F.round(F.col(f"s{a}"), 1))]
    return scores.withColumn("scores", F.create_map(*pairs))


def text_layer_placeable(layer: DataFrame) -> DataFrame:
    """Lines that can be written back into the page, with baseline and the font size at which the
    text is as wide as its box.

    Text starts at 0.9 of the box height; that size times box width over natural width is the
    fitted one, kept between 0.5 and 100. The height cancels out unless the text has no width.
    """
    x0, y0, x1, y1 = (F.col("rect")[i] for i in range(4))
    height = y1 - y0
    natural = F.col("_natural")
    fitted = F.when(natural > 0, (x1 - x0) * 1000 / F.when(natural > 0, natural)).otherwise(height * rules.LAYER_HEIGHT)
    return (
        layer.filter((strip(F.col("text")) != "") & (x1 - x0 > 0) & (height > 0))
        .withColumn("_natural", natural_width(strip(F.col("text")))).withColumns(
            {
                "base_x": x0,
                "base_y": y1 - height * 0.15,
                "font_size": F.greatest(F.least(fitted, F.lit(rules.MAX_FONT_SIZE)), F.lit(rules.MIN_FONT_SIZE)),
            }
        ).drop("_natural")
    )


# ---- applying the decision -------------------------------------------------------------

def apply_rotation(pages: DataFrame) -> DataFrame:
    """New page rotation from ``rotation`` (current), ``angle`` and ``method``."""
    angle = F.coalesce(F.col("angle"), F.lit(0))
    return pages.withColumn(
        "new_rotation",
        F.when(angle == 0, F.col("rotation"))
        .when(F.col("method") == "metadata", 0)
        .otherwise(F.pmod(F.col("rotation") - angle, F.lit(360))),
    )


def rotation_summary(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Pages per ``{angle}_degrees_via_{method}`` of every file; undecided pages count as default."""
    label = F.concat(
        F.coalesce(F.col("angle"), F.lit(0)).cast("string"),
        F.lit("_degrees_via_"),
        F.coalesce(F.col("method"), F.lit("default")),
    )
    return (
        pages.select(*KEYS)
        .join(results.select(*KEYS, "angle", "method"), KEYS, "left")
        .groupBy("job_id", "filename", label.alias("outcome"))
        .agg(F.count("*").alias("pages"))
    )


# ---- flagship --------------------------------------------------------------------------

def nest_lines(pages: DataFrame, ocr_lines: DataFrame) -> DataFrame:
    """Long lines to the nested shape: the one exchange of the long path."""
    line = F.struct("angle", "ord", "box", "text", "conf")
    nested = ocr_lines.groupBy(*KEYS).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return pages.join(nested, KEYS, "left")


def analyze_orientation(page_ocr: DataFrame) -> DataFrame:
    """Nested pages to page results, one row in, one row out, no shuffle.

    Columns read: keys, ``width``, ``height``, ``ink_ratio``, ``meta_rotation``, ``error``
    and ``lines array<struct<angle,ord,box,text,conf>>`` in reading order.
    """
    readable = F.filter(
        F.coalesce(F.col("lines"), F.array().cast("array<struct<angle:int,ord:int,box:array<struct<x:double,y:double>>,text:string,conf:double>>")),
        lambda l: is_readable(l["conf"], l["box"]),
    )
    scored = page_ocr.withColumn("readable", readable).withColumns(
        {f"s{a}": angle_score("readable", a) for a in rules.ROTATIONS}
    )
    decided = decide_angle(scored)
    chosen = decided.withColumn(
        "chosen", F.filter("readable", lambda l: l["angle"] == F.col("best"))
    )
    tilts = F.sort_array(
        F.filter(
            F.transform("chosen", lambda l: geometry.tilt_degrees(l["box"])), lambda t: t.isNotNull()
        )
    )
    layer = F.transform(
        "chosen",
        lambda l: F.struct(
            l["text"].alias("text"),
            F.round(l["conf"], 3).alias("conf"),
            let(
                geometry.unrotate(l["box"], F.col("best"), F.col("width"), F.col("height")), _point_rect
            ).alias("rect"),
        ),
    )
    measured = chosen.withColumn("tilts", tilts).withColumns(
        {
            "skew": F.when(F.size("tilts") == 0, 0.0).otherwise(
                F.round(
                    (
                        F.get("tilts", F.floor((F.size("tilts") - 1) / 2).cast("int"))
                        + F.get("tilts", F.floor(F.size("tilts") / 2).cast("int"))
                    )
                    / 2,
                    2,
                )
            ),
            "layer": layer,
            "words": word_count(F.array_join(F.transform("chosen", lambda l: l["text"]), " ")),
        }
    )
    flagged = score_map(review_flag(flag_skew(flag_blank(measured))))

    failed = F.col("error").isNotNull()
    declared = has_metadata_angle(F.col("meta_rotation")) & ~failed
    skipped = failed | declared

    def read_only(value: Column, otherwise: Column) -> Column:
        return F.when(skipped, otherwise).otherwise(value)

    null = F.lit(None)
    return flagged.select(
        *KEYS,
        F.when(failed, 0).when(declared, F.col("meta_rotation")).otherwise(F.col("angle"))
        .cast("int").alias("angle"),
        F.when(failed, "error").when(declared, "metadata").otherwise("universal_recognizer")
        .alias("method"),
        read_only(F.col("scores"), F.create_map().cast("map<string,double>")).alias("scores"),
        F.when(failed, True).when(declared, False).otherwise(F.col("needs_review"))
        .alias("needs_review"),
        F.when(failed, "error").when(declared, null).otherwise(F.col("reason")).alias("reason"),
        read_only(F.col("skew"), null).alias("skew"),
        read_only(F.round("ink_ratio", 5), null).alias("ink_ratio"),
        read_only(F.col("words"), null).cast("int").alias("word_count"),
        read_only(F.col("layer"), F.array().cast(TEXT_LAYER)).alias("text"),
    )
