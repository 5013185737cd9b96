"""Review of uncertain pages: flags, pattern groups, samples, decisions.

Page-level joins use the full page key (unique on both sides). Everything per job, file or
group is a partial aggregate or a first-k window, so a job holding most pages is split like
any other data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageflow import rules
from pageflow.operators.ranking import first_k, page_block, positions

KEYS = ["job_id", "filename", "page"]
FILE = ["job_id", "filename"]
GROUP = ["job_id", "reason", "angle"]


# ---- signed-off pages ------------------------------------------------------------------

def parse_reviewed(jobs: DataFrame) -> DataFrame:
    """JSON lists of ``file::page`` keys to rows. Missing or broken JSON gives none; split at the last ``::``."""
    keys = jobs.select("job_id", F.explode(F.from_json("reviewed_pages", "array<string>")).alias("key"))
    shape = r"(?s)^(.*)::(\d+)$"
    return (
        keys.filter(F.col("key").rlike(shape))
        .select(
            "job_id", F.regexp_extract("key", shape, 1).alias("filename"),
            F.regexp_extract("key", shape, 2).try_cast("int").alias("page"),
        )
        .filter(F.col("page").isNotNull())
        .distinct()
    )


def pack_reviewed(reviewed: DataFrame) -> DataFrame:
    """Signed-off pages back to JSON lists, keys sorted as text (``p::10`` before ``p::2``).

    One list per file and block of 4096 pages, not per job: a row stays bounded, and
    :func:`parse_reviewed` accepts any number of lists for a job.
    """
    key = F.concat(F.col("filename"), F.lit("::"), F.col("page").cast("string"))
    return reviewed.groupBy(*FILE, page_block(F.col("page")).alias("block")).agg(
        F.to_json(F.array_sort(F.collect_set(key))).alias("reviewed_pages")
    )


def with_reviewed(results: DataFrame, reviewed: DataFrame) -> DataFrame:
    marks = reviewed.select(*KEYS).withColumn("_mark", F.lit(True))
    return (
        results.join(marks, KEYS, "left")
        .withColumn("reviewed", F.coalesce("_mark", F.lit(False)))
        .drop("_mark")
    )


# ---- listings --------------------------------------------------------------------------

def review_pages(
    results: DataFrame, reviewed: DataFrame, scope: str = "flagged",
    file: str | None = None, reason: str | None = None,
) -> DataFrame:
    """Pages to look at, with their ``reviewed`` flag; filters reach the scan before the join."""
    chosen = results if scope == "all" else results.filter("needs_review")
    if file:
        chosen = chosen.filter(F.col("filename") == file)
    if reason:
        chosen = chosen.filter(F.col("reason") == reason)
    return with_reviewed(chosen, reviewed)


def review_files(results: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Per file: pages, flagged pages, flagged and reviewed pages, whether every page is a guess."""
    flags = with_reviewed(results, reviewed)
    return (
        flags.groupBy(*FILE)
        .agg(
            F.count("*").alias("total_pages"),
            F.count_if("needs_review").alias("flagged"),
            F.count_if(F.col("needs_review") & F.col("reviewed")).alias("reviewed"),
        )
        .withColumn("all_low_confidence", F.col("flagged") == F.col("total_pages"))
    )


def review_summary(results: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Per job. ``reviewed`` counts every signed-off key, flagged or not."""
    pages = results.groupBy("job_id").agg(
        F.count("*").alias("total_pages"), F.count_if("needs_review").alias("flagged")
    )
    marks = reviewed.groupBy("job_id").agg(F.count("*").alias("reviewed"))
    return pages.join(marks, "job_id", "left").select(
        "job_id", "total_pages", "flagged",
        (F.col("total_pages") - F.col("flagged")).alias("auto_corrected"),
        F.coalesce("reviewed", F.lit(0)).alias("reviewed"),
        (F.col("flagged") == F.col("total_pages")).alias("all_low_confidence"),
    )


def clamp_limit(limit: int) -> int:
    return max(1, min(limit, rules.MAX_WINDOW))


def page_window(selected: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    """Rows offset+1 .. offset+limit of every job by file and page, as ``position``.

    Counts per block of pages place the blocks; only those that reach into the window are ranked.
    A job's blocks, which may be very many files, are placed range by range.
    """
    limit, offset = clamp_limit(limit), max(0, offset)
    blocked = selected.withColumn("_block", page_block(F.col("page")))
    window = (offset, offset + limit)
    return positions(blocked, ["job_id"], ["filename", "_block"], ["page"], "position", window, many_blocks=True).drop("_block")


def goto_page(selected: DataFrame, number: int, limit: int = 20, file: str | None = None, offset: int = 0) -> DataFrame:
    """Per job: the window offset that shows document page ``number`` (1-based), from counts only.

    The target is the first selected page with that number in (file, page) order, optionally in
    one file. Its index is the size of the earlier files plus the earlier pages of its own file.
    """
    limit, target = clamp_limit(limit), number - 1
    hit = F.col("page") == target
    if file:
        hit = hit & (F.col("filename") == file)
    per_file = selected.groupBy(*FILE).agg(
        F.count("*").alias("n"), F.count_if(F.col("page") < target).alias("n_before"), F.count_if(hit).alias("hits")
    )
    goals = per_file.groupBy("job_id").agg(
        F.min(F.when(F.col("hits") > 0, F.col("filename"))).alias("goal")
    )
    own = F.col("filename") == F.col("goal")
    index = F.sum(
        F.when(own, F.col("n_before")).when(F.col("filename") < F.col("goal"), F.col("n")).otherwise(0)
    )
    return (
        per_file.join(goals, "job_id")
        .groupBy("job_id")
        .agg(index.alias("index"), F.count_if(own).alias("found"))
        .select(
            "job_id",
            (F.col("found") > 0).alias("goto_found"),
            F.when(F.col("found") > 0, F.floor(F.col("index") / limit) * limit).otherwise(max(0, offset))
            .cast("long").alias("offset"),
        )
    )


# ---- pattern groups --------------------------------------------------------------------

def _lookup(col: Column, table: dict, other) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[col], F.lit(other))


def _named(results: DataFrame) -> DataFrame:
    reason = F.when(F.coalesce("reason", F.lit("")) == "", "unknown").otherwise(F.col("reason"))
    return results.withColumns({"reason": reason, "angle": F.coalesce("angle", F.lit(0))})


def _flagged(results: DataFrame) -> DataFrame:
    return _named(results.filter("needs_review"))


def review_groups(results: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Flagged pages by reason and decided angle, with label, hint, and the first page met."""
    per_file = (
        with_reviewed(_flagged(results), reviewed)
        .groupBy(*GROUP, "filename")
        .agg(F.count("*").alias("n"), F.count_if("reviewed").alias("r"), F.min("page").alias("page"))
    )
    groups = per_file.groupBy(*GROUP).agg(
        F.sum("n").alias("pages"), F.sum("r").alias("reviewed"), F.count("*").alias("files"),
        F.min(F.struct("filename", "page")).alias("first_page"),
    )
    return groups.withColumns(
        {
            "label": _lookup(F.col("reason"), rules.REASON_LABELS, rules.OTHER_LABEL),
            "hint": _lookup(F.col("reason"), rules.REASON_HINTS, rules.OTHER_HINT),
        }
    )


def order_groups(groups: DataFrame) -> DataFrame:
    """Position of each group in its job: riskiest reason, then most pages, then first met.

    A job has at most a handful of groups (reasons x angles), so the window is small.
    """
    rank = _lookup(F.col("reason"), rules.REASON_RANK, rules.OTHER_RANK)
    window = Window.partitionBy("job_id").orderBy(rank, F.desc("pages"), "first_page", "angle")
    return groups.withColumn("position", F.row_number().over(window))


def group_samples(results: DataFrame, samples: int = 6) -> DataFrame:
    """Round-robin samples of every group: page 1 of each file by name, then page 2, up to ``samples``.

    Both levels are first-k windows, so at most ``samples`` rows per task and group are shuffled.
    """
    n = max(1, min(samples, rules.MAX_SAMPLES))
    per_file = first_k(_flagged(results), [*GROUP, "filename"], ["page"], n, "depth")
    return first_k(per_file, GROUP, ["depth", "filename"], n, "position")


# ---- decisions -------------------------------------------------------------------------

def approve(reviewed: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds signed-off pages; adding twice equals adding once."""
    return reviewed.select(*KEYS).unionByName(keys.select(*KEYS)).distinct()


def group_pages(results: DataFrame, reason: str, angle: int) -> DataFrame:
    """Flagged pages of one pattern, in every job given."""
    # Behind a generator the filter reads values; pushed into the expressions that decide them, it
    # would compute each of their shared parts again wherever it is named.
    verdict = F.explode_outer(F.array(F.struct("needs_review", "reason", "angle")))
    judged = _named(results).withColumn("_judged", verdict)
    wanted = (F.col("_judged.reason") == reason) & (F.col("_judged.angle") == angle)
    return judged.filter(F.col("_judged.needs_review") & wanted).drop("_judged")


def turn_pages(rotations: DataFrame, targets: DataFrame, by: int) -> DataFrame:
    """Output ``rotation`` of the target pages turned by ``by``; pages without an output page are ignored."""
    marks = targets.select(*KEYS).distinct().withColumn("_turn", F.lit(True))
    turned = F.when(F.col("_turn"), F.pmod(F.col("rotation") + by, F.lit(360))).otherwise(F.col("rotation"))
    return rotations.join(marks, KEYS, "left").withColumn("rotation", turned).drop("_turn")


def decision_summary(touched: DataFrame, reviewed_after: DataFrame) -> DataFrame:
    """Per job: pages and files a decision touched and how many pages are signed off afterwards."""
    per_file = touched.groupBy(*FILE).agg(F.count("*").alias("n"))
    counts = per_file.groupBy("job_id").agg(F.sum("n").alias("pages"), F.count("*").alias("files"))
    marks = reviewed_after.groupBy("job_id").agg(F.count("*").alias("reviewed"))
    return counts.join(marks, "job_id", "left").fillna(0, ["reviewed"])


def group_action(
    results: DataFrame, reviewed: DataFrame, rotations: DataFrame, reason: str, angle: int,
    action: str, rotate_by: int = 0,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One decision for a whole pattern: (reviewed, rotations, summary) afterwards.

    ``rotations`` holds the existing output pages, so pages of missing files or beyond the end
    are signed off but not turned.
    """
    if action not in rules.GROUP_ACTIONS:
        raise ValueError("Unknown action")
    if action == "rotate" and rotate_by % 90:
        raise ValueError("Angle must be a multiple of 90")
    pages = group_pages(results, reason, angle).select(*KEYS)
    after = approve(reviewed, pages)
    if action == "rotate" and rotate_by % 360:
        rotations = turn_pages(rotations, pages, rotate_by)
    return after, rotations, decision_summary(pages, after)


def deskew_candidates(results: DataFrame, output_pages: DataFrame, reason: str = "skewed", angle: int = 0) -> DataFrame:
    """Pages of a pattern worth straightening; ``position`` is their place in the file, last page first."""
    tilted = group_pages(results, reason, angle).filter(
        F.abs(F.coalesce("skew", F.lit(0.0))) >= rules.DESKEW_MIN_DEGREES
    )
    existing = tilted.join(output_pages.select(*KEYS), KEYS, "left_semi")
    blocked = existing.withColumns({"_block": -page_block(F.col("page")), "_last_first": -F.col("page")})
    placed = positions(blocked, FILE, ["_block"], ["_last_first"], "position")
    return placed.select(*KEYS, "skew", "position")


def bulk_action(
    results: DataFrame, reviewed: DataFrame, rotations: DataFrame, action: str,
    angle: int = 0, file: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One decision for whole files: (reviewed, rotations, summary) afterwards.

    A turn touches every output page of the file and skips files without output, including
    their review marks; a multiple of 360 acts like accepting.
    """
    if action not in rules.BULK_ACTIONS:
        raise ValueError("Unknown action")
    if action == "rotate_all" and angle % 90:
        raise ValueError("Angle must be a multiple of 90")
    pages = results.select(*KEYS)
    if file:
        pages = pages.filter(F.col("filename") == file)
    if action == "rotate_all" and angle % 360:
        stored = rotations.select(*FILE).distinct()
        pages = pages.join(stored, FILE, "left_semi")
        # A named file is turned even when none of its pages has a result.
        chosen = stored.filter(F.col("filename") == file) if file else stored.join(
            results.select(*FILE).distinct(), FILE
        )
        marks = chosen.withColumn("_turn", F.lit(True))
        turned = F.when(F.col("_turn"), F.pmod(F.col("rotation") + angle, F.lit(360))).otherwise(F.col("rotation"))
        rotations = rotations.join(marks, FILE, "left").withColumn("rotation", turned).drop("_turn")
    after = approve(reviewed, pages)
    return after, rotations, decision_summary(pages, after)


def override(rotations: DataFrame, reviewed: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manual turns: (rotations, reviewed) afterwards. ``edits`` may hold many turns of a page; they
    add up, and every edited page is signed off."""
    sums = edits.groupBy(*KEYS).agg(F.sum("rotation").alias("_by"))
    turned = rotations.join(sums, KEYS, "left").withColumn(
        "rotation", F.pmod(F.col("rotation") + F.coalesce("_by", F.lit(0)), F.lit(360))
    ).drop("_by")
    return turned, approve(reviewed, edits)


def validate_decisions(requests: DataFrame) -> DataFrame:
    """Requests ``(kind group|bulk, action, angle)`` with the ``error`` they would be refused with."""
    group = F.col("kind") == "group"
    known = F.when(group, F.col("action").isin(*rules.GROUP_ACTIONS)).otherwise(
        F.col("action").isin(*rules.BULK_ACTIONS)
    )
    turns = F.when(group, F.col("action") == "rotate").otherwise(F.col("action") == "rotate_all")
    return requests.withColumn(
        "error",
        F.when(~known, "Unknown action").when(turns & (F.col("angle") % 90 != 0), "Angle must be a multiple of 90"),
    )


# ---- what the reviewer sees ------------------------------------------------------------

def next_file(files: DataFrame) -> DataFrame:
    """Per job with several files: the first with open flagged pages, else the first with any."""
    rank = F.when(F.col("flagged") > F.col("reviewed"), 0).when(F.col("flagged") > 0, 1)
    return (
        files.groupBy("job_id")
        .agg(F.count("*").alias("n"), F.min(F.when(rank.isNotNull(), F.struct(rank.alias("r"), "filename"))).alias("pick"))
        .filter((F.col("n") > 1) & F.col("pick").isNotNull())
        .select("job_id", F.col("pick.filename").alias("filename"))
    )


def split_clean(files: DataFrame) -> DataFrame:
    return files.withColumns(
        {"needs_none": F.col("flagged") == 0, "done": F.col("reviewed") >= F.col("flagged")}
    )


def review_progress(summary: DataFrame) -> DataFrame:
    flagged, reviewed = F.col("flagged"), F.col("reviewed")
    return summary.withColumns(
        {
            "remaining": F.greatest(flagged - reviewed, F.lit(0)),
            "percent": F.when(flagged > 0, F.least(reviewed / flagged * 100, F.lit(100.0))).otherwise(0.0),
            "view": F.when(flagged >= rules.GROUPS_THRESHOLD, "groups").otherwise("pages"),
        }
    )


def score_share(results: DataFrame) -> DataFrame:
    """Four rows a page: each rotation's score, its bar width in percent (at least 2), the best mark."""
    scores = [F.coalesce(F.col(f"s{a}"), F.lit(0.0)) for a in rules.ROTATIONS]
    top = F.greatest(*scores, F.lit(1.0))
    bars = F.array(
        *[
            F.struct(
                F.lit(a).alias("rotation"), s.alias("score"),
                F.greatest(s / top * 100, F.lit(2.0)).alias("percent"),
                ((s == top) & (s > 0)).alias("is_best"),
            )
            for a, s in zip(rules.ROTATIONS, scores)
        ]
    )
    return results.select(*KEYS, F.explode(bars).alias("bar")).select(*KEYS, "bar.*")
