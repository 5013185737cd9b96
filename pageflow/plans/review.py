"""Review queries (V01..V20) over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageflow import fixtures as fx, rules
from pageflow.operators import review as v
from pageflow.plans.catalog import query

KEYS, FILE = v.KEYS, v.FILE
_PAGE = "job_id, filename, page"
_ON = "a.job_id = b.job_id AND a.filename = b.filename AND a.page = b.page"

fx.SQL["fx_marked"] = f"""
    SELECT a.*, b.page IS NOT NULL AS reviewed FROM fx_results a LEFT JOIN fx_reviewed b ON {_ON}"""
fx.SQL["fx_review_files"] = """
    SELECT job_id, filename, count(*) AS total_pages, count(*) FILTER (needs_review) AS flagged,
           count(*) FILTER (needs_review AND reviewed) AS reviewed,
           count(*) FILTER (needs_review) = count(*) AS all_low_confidence FROM fx_marked GROUP BY job_id, filename"""
fx.SQL["fx_review_summary"] = """
    SELECT p.job_id, total_pages, flagged, total_pages - flagged AS auto_corrected, coalesce(n, 0) AS reviewed,
           flagged = total_pages AS all_low_confidence
    FROM (SELECT job_id, count(*) AS total_pages, count(*) FILTER (needs_review) AS flagged FROM fx_results GROUP BY job_id) p
    LEFT JOIN (SELECT job_id, count(*) AS n FROM fx_reviewed GROUP BY job_id) r ON p.job_id = r.job_id"""


def _case(column: str, table: dict, other) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    whens = " ".join(f"WHEN {quoted(k)} THEN {quoted(val)}" for k, val in table.items())
    return f"CASE {column} {whens} ELSE {quoted(other)} END"


fx.SQL["fx_groups"] = f"""
    SELECT job_id, reason, angle, count(*) AS pages, CAST(count(*) FILTER (reviewed) AS BIGINT) AS reviewed,
           count(DISTINCT filename) AS files, min((filename, page)) AS first_page,
           {_case('reason', rules.REASON_LABELS, rules.OTHER_LABEL)} AS label, {_case('reason', rules.REASON_HINTS, rules.OTHER_HINT)} AS hint
    FROM (SELECT * REPLACE (coalesce(reason, 'unknown') AS reason) FROM fx_marked WHERE needs_review) q
    GROUP BY job_id, reason, angle"""


def _output_pages(t):
    """Output pages with their rotation; pages above a score are not in the output."""
    r = fx.pages(t)
    return r.filter(F.col("s180") < 7).select(
        *KEYS, (90 * ((F.col("job_id") + F.col("page")) % 4)).cast("int").alias("rotation")
    )


fx.SQL["fx_output_pages"] = """
    SELECT job_id, filename, page, CAST(90 * ((job_id + page) % 4) AS INT) AS rotation FROM fx_pages
    WHERE s180 < 7"""


def _packed(t):
    """Every list, and beside each a damaged copy and one with a key that is no page number."""
    lists = v.pack_reviewed(fx.reviewed(t)).select("job_id", "reviewed_pages")
    broken = lists.select("job_id", F.concat(F.lit("["), "reviewed_pages").alias("reviewed_pages"))
    long_key = lists.select("job_id", F.lit('["a.pdf::99999999999", "b.pdf"]').alias("reviewed_pages"))
    return lists.unionByName(broken).unionByName(long_key)


@query("V01_parse_reviewed", f"SELECT {_PAGE} FROM fx_reviewed")
def _(t):
    return v.parse_reviewed(_packed(t))


@query("V02_pack_reviewed", """
    SELECT job_id, filename, CAST(page // 4096 AS BIGINT) AS block,
           '["' || string_agg(key, '","' ORDER BY key) || '"]' AS reviewed_pages
    FROM (SELECT *, filename || '::' || CAST(page AS VARCHAR) AS key FROM fx_reviewed) q GROUP BY 1, 2, 3""")
def _(t):
    return v.pack_reviewed(fx.reviewed(t))


@query("V03_review_pages", f"SELECT {_PAGE}, angle, reason, reviewed FROM fx_marked WHERE needs_review AND reason = 'ambiguous'")
def _(t):
    return v.review_pages(fx.results(t), fx.reviewed(t), reason="ambiguous").select(*KEYS, "angle", "reason", "reviewed")


@query("V04_review_files", "SELECT * FROM fx_review_files")
def _(t):
    return v.review_files(fx.results(t), fx.reviewed(t))


@query("V05_review_summary", "SELECT * FROM fx_review_summary")
def _(t):
    return v.review_summary(fx.results(t), fx.reviewed(t))


@query("V06_page_window", f"""
    SELECT {_PAGE}, position FROM (
        SELECT {_PAGE}, row_number() OVER (PARTITION BY job_id ORDER BY filename, page) AS position
        FROM fx_results WHERE needs_review) q WHERE position > 2 AND position <= 5""")
def _(t):
    flagged = fx.results(t).filter("needs_review")
    return v.page_window(flagged, offset=2, limit=3).select(*KEYS, "position")


@query("V06_far_window", f"""
    SELECT {_PAGE}, position FROM (
        SELECT CAST(0 AS BIGINT) AS job_id, filename, page, row_number() OVER (ORDER BY filename, page) AS position FROM (
            SELECT filename, CAST(job_id * 10 + page AS INT) AS page FROM fx_results) r) q WHERE position > 3000 AND position <= 3100""")
def _(t):
    """All pages as one job, a window beyond the first thousand."""
    one = fx.results(t).select(
        F.lit(0).cast("long").alias("job_id"), "filename", (F.col("job_id") * 10 + F.col("page")).cast("int").alias("page")
    )
    return v.page_window(one, offset=3000, limit=100).select(*KEYS, "position")


@query("V07_goto_page", """
    SELECT job_id, goal IS NOT NULL AS goto_found, CAST(coalesce(idx // 2 * 2, 0) AS BIGINT) AS "offset" FROM (
        SELECT job_id, min(CASE WHEN page = 1 THEN rn - 1 END) AS idx, min(CASE WHEN page = 1 THEN rn END) AS goal FROM (
            SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY filename, page) AS rn FROM fx_results WHERE needs_review) q
        GROUP BY job_id) g""")
def _(t):
    return v.goto_page(fx.results(t).filter("needs_review"), number=2, limit=2)


@query("V08_review_groups", """
    SELECT job_id, reason, angle, pages, reviewed, files, label, hint FROM fx_groups""")
def _(t):
    return v.review_groups(fx.results(t), fx.reviewed(t)).select(
        "job_id", "reason", "angle", F.col("pages").cast("long").alias("pages"), "reviewed", "files", "label", "hint"
    )


@query("V09_order_groups", f"""
    SELECT job_id, reason, angle, CAST(row_number() OVER (PARTITION BY job_id
        ORDER BY {_case('reason', rules.REASON_RANK, rules.OTHER_RANK)}, pages DESC, first_page, angle) AS INT) AS position FROM fx_groups""")
def _(t):
    ordered = v.order_groups(v.review_groups(fx.results(t), fx.reviewed(t)))
    return ordered.select("job_id", "reason", "angle", "position")


@query("V10_group_samples", """
    SELECT job_id, reason, angle, filename, page, position FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY job_id, reason, angle ORDER BY depth, filename) AS INT) AS position FROM (
            SELECT *, row_number() OVER (PARTITION BY job_id, reason, angle, filename ORDER BY page) AS depth
            FROM fx_results WHERE needs_review) d WHERE depth <= 3) q WHERE position <= 3""")
def _(t):
    return v.group_samples(fx.results(t), 3).select("job_id", "reason", "angle", "filename", "page", "position")


@query("V11_group_action", """
    SELECT t.job_id, pages, files, reviewed FROM (
        SELECT job_id, count(*) AS pages, count(DISTINCT filename) AS files FROM fx_results
        WHERE needs_review AND reason = 'ambiguous' AND angle = 90 GROUP BY job_id) t
    JOIN (SELECT job_id, count(*) AS reviewed FROM (
        SELECT job_id, filename, page FROM fx_reviewed UNION
        SELECT job_id, filename, page FROM fx_results WHERE needs_review AND reason = 'ambiguous' AND angle = 90) u GROUP BY job_id) r
    ON t.job_id = r.job_id""")
def _(t):
    _, _, summary = v.group_action(fx.results(t), fx.reviewed(t), _output_pages(t), "ambiguous", 90, "rotate", 90)
    return summary


@query("V11_group_rotations", f"""
    SELECT a.job_id, a.filename, a.page, CAST(CASE WHEN b.page IS NULL THEN rotation ELSE (rotation + 90) % 360 END AS INT) AS rotation
    FROM fx_output_pages a LEFT JOIN (SELECT {_PAGE} FROM fx_results WHERE needs_review AND reason = 'ambiguous' AND angle = 90) b ON {_ON}""")
def _(t):
    _, rotations, _ = v.group_action(fx.results(t), fx.reviewed(t), _output_pages(t), "ambiguous", 90, "rotate", 90)
    return rotations.withColumn("rotation", F.col("rotation").cast("int"))


@query("V11_group_accept", """
    SELECT t.job_id, pages, files, reviewed FROM (
        SELECT job_id, count(*) AS pages, count(DISTINCT filename) AS files FROM fx_results
        WHERE needs_review AND reason = 'close_to_zero' AND angle = 0 GROUP BY job_id) t
    JOIN (SELECT job_id, count(*) AS reviewed FROM (
        SELECT job_id, filename, page FROM fx_reviewed UNION
        SELECT job_id, filename, page FROM fx_results WHERE needs_review AND reason = 'close_to_zero' AND angle = 0) u GROUP BY job_id) r
    ON t.job_id = r.job_id""")
def _(t):
    _, _, summary = v.group_action(fx.results(t), fx.reviewed(t), _output_pages(t), "close_to_zero", 0, "accept")
    return summary


@query("V11_group_deskew", f"""
    SELECT {_PAGE} FROM fx_reviewed UNION SELECT {_PAGE} FROM fx_results WHERE needs_review AND reason = 'skewed' AND angle = 0""")
def _(t):
    after, _, _ = v.group_action(fx.results(t), fx.reviewed(t), _output_pages(t), "skewed", 0, "deskew")
    return after


@query("V12_deskew_candidates", f"""
    SELECT a.job_id, a.filename, a.page, skew, row_number() OVER (PARTITION BY a.job_id, a.filename ORDER BY a.page DESC) AS position FROM fx_results a JOIN fx_output_pages b ON {_ON}
    WHERE needs_review AND reason = 'skewed' AND angle = 0 AND abs(skew) >= 0.1""")
def _(t):
    return v.deskew_candidates(fx.results(t), _output_pages(t))


fx.SQL["fx_bulk_touched"] = """
    SELECT job_id, filename, page FROM fx_results r WHERE filename = 'f1.pdf' AND EXISTS (
        SELECT 1 FROM fx_output_pages o WHERE o.job_id = r.job_id AND o.filename = r.filename)"""


@query("V13_bulk_action", """
    SELECT t.job_id, pages, files, reviewed FROM (
        SELECT job_id, count(*) AS pages, count(DISTINCT filename) AS files FROM fx_bulk_touched GROUP BY job_id) t
    JOIN (SELECT job_id, count(*) AS reviewed FROM (
        SELECT job_id, filename, page FROM fx_reviewed UNION SELECT job_id, filename, page FROM fx_bulk_touched) u GROUP BY job_id) r
    ON t.job_id = r.job_id""")
def _(t):
    _, _, summary = v.bulk_action(fx.results(t), fx.reviewed(t), _output_pages(t), "rotate_all", 180, "f1.pdf")
    return summary


@query("V13_bulk_rotations", """
    SELECT job_id, filename, page, CAST(CASE WHEN filename = 'f1.pdf' THEN (rotation + 180) % 360 ELSE rotation END AS INT) AS rotation
    FROM fx_output_pages""")
def _(t):
    _, rotations, _ = v.bulk_action(fx.results(t), fx.reviewed(t), _output_pages(t), "rotate_all", 180, "f1.pdf")
    return rotations.withColumn("rotation", F.col("rotation").cast("int"))


@query("V13_bulk_accept_job", f"""
    SELECT {_PAGE} FROM fx_reviewed UNION SELECT {_PAGE} FROM fx_results""")
def _(t):
    """The whole-job form: every page of every file."""
    after, _, _ = v.bulk_action(fx.results(t), fx.reviewed(t), _output_pages(t), "accept_all")
    return after


@query("V13_bulk_rotate_job", """
    SELECT o.job_id, o.filename, o.page,
           CAST(CASE WHEN EXISTS (SELECT 1 FROM fx_results r WHERE r.job_id = o.job_id AND r.filename = o.filename)
                THEN (rotation + 90) % 360 ELSE rotation END AS INT) AS rotation FROM fx_output_pages o""")
def _(t):
    _, rotations, _ = v.bulk_action(fx.results(t), fx.reviewed(t), _output_pages(t), "rotate_all", 90)
    return rotations.withColumn("rotation", F.col("rotation").cast("int"))


@query("V14_approve", f"""
    SELECT {_PAGE} FROM fx_reviewed UNION SELECT {_PAGE} FROM fx_results WHERE method = 'error'""")
def _(t):
    return v.approve(fx.reviewed(t), fx.results(t).filter(F.col("method") == "error"))


@query("V15_override", f"""
    SELECT a.job_id, a.filename, a.page, CAST(((rotation + coalesce(d, 0)) % 360 + 360) % 360 AS INT) AS rotation
    FROM fx_output_pages a LEFT JOIN (
        SELECT {_PAGE}, CAST(sum(90 * (word_count % 6) - 180) AS BIGINT) AS d FROM fx_page_events GROUP BY {_PAGE}) b ON {_ON}""")
def _(t):
    edits = fx.page_events(t).select(
        *KEYS, (90 * (F.col("word_count") % 6) - 180).alias("rotation")
    )
    turned, _ = v.override(_output_pages(t), fx.reviewed(t), edits)
    return turned.select(*KEYS, F.col("rotation").cast("int").alias("rotation"))


@query("V15_override_reviewed", f"SELECT {_PAGE} FROM fx_reviewed UNION SELECT {_PAGE} FROM fx_page_events WHERE word_count > 150")
def _(t):
    edits = fx.page_events(t).filter("word_count > 150").select(*KEYS, F.lit(90).alias("rotation"))
    return v.override(_output_pages(t), fx.reviewed(t), edits)[1]


@query("V16_next_file", """
    SELECT job_id, filename FROM (
        SELECT *, count(*) OVER (PARTITION BY job_id) AS n, row_number() OVER (PARTITION BY job_id
            ORDER BY CASE WHEN flagged > reviewed THEN 0 WHEN flagged > 0 THEN 1 ELSE 2 END, filename) AS rn
        FROM fx_review_files) q WHERE n > 1 AND rn = 1 AND flagged > 0""")
def _(t):
    return v.next_file(v.review_files(fx.results(t), fx.reviewed(t)))


@query("V17_split_clean", "SELECT job_id, filename, flagged = 0 AS needs_none, reviewed >= flagged AS done FROM fx_review_files")
def _(t):
    return v.split_clean(v.review_files(fx.results(t), fx.reviewed(t))).select(*FILE, "needs_none", "done")


@query("V18_review_progress", """
    SELECT job_id, greatest(flagged - reviewed, 0) AS remaining,
           CASE WHEN flagged > 0 THEN least(CAST(reviewed AS DOUBLE) / flagged * 100, 100) ELSE CAST(0 AS DOUBLE) END AS percent,
           CASE WHEN flagged >= 20 THEN 'groups' ELSE 'pages' END AS view FROM fx_review_summary""")
def _(t):
    return v.review_progress(v.review_summary(fx.results(t), fx.reviewed(t))).select("job_id", "remaining", "percent", "view")


@query("V19_score_share", f"""
    SELECT {_PAGE}, CAST(u.rotation AS INT) AS rotation, u.score AS score,
           greatest(u.score / greatest(s0, s90, s180, s270, 1) * 100, 2) AS percent,
           u.score = greatest(s0, s90, s180, s270, 1) AND u.score > 0 AS is_best
    FROM fx_results, LATERAL (VALUES (0, s0), (90, s90), (180, s180), (270, s270)) u(rotation, score)""")
def _(t):
    return v.score_share(fx.results(t))


@query("V20_validate_decisions", """
    SELECT o_orderkey AS request_id, kind, action, angle,
           CASE WHEN kind = 'group' AND action NOT IN ('accept', 'rotate', 'deskew') THEN 'Unknown action'
                WHEN kind = 'bulk' AND action NOT IN ('accept_all', 'rotate_all') THEN 'Unknown action'
                WHEN action IN ('rotate', 'rotate_all') AND angle % 90 <> 0 THEN 'Angle must be a multiple of 90' END AS error
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'group' ELSE 'bulk' END AS kind,
                 CASE o_custkey % 5 WHEN 0 THEN 'accept' WHEN 1 THEN 'rotate' WHEN 2 THEN 'deskew' WHEN 3 THEN 'accept_all' ELSE 'rotate_all' END AS action,
                 CAST(45 * (o_orderkey % 9) - 90 AS INT) AS angle FROM orders) q""")
def _(t):
    kinds = ["accept", "rotate", "deskew", "accept_all", "rotate_all"]
    requests = t["orders"].select(
        F.col("o_orderkey").alias("request_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "group").otherwise("bulk").alias("kind"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("o_custkey") % 5 + 1).cast("int")).alias("action"),
        (45 * (F.col("o_orderkey") % 9) - 90).cast("int").alias("angle"),
    )
    return v.validate_decisions(requests)
