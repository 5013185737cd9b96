"""A third of all rows on one job, one user, one source and one page: results stay right."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from tests.oracle import TABLES, compare, duck

SOURCE = "/root/testdata/sf0.001"
SKEW = {
    "lineitem": "SELECT * REPLACE (CASE WHEN rn % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey, CASE WHEN rn % 9 = 0 THEN 1 ELSE l_linenumber END AS l_linenumber) FROM (SELECT *, row_number() OVER () AS rn FROM t) q",
    "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey) FROM t",
    "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id) FROM t",
    "documents": "SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN 'src1' ELSE source END AS source) FROM t",
}
NAMES = [
    "A02_rotation_scores", "A18_analyze_orientation", "F01_first_result", "F03_complete_files", "F04_assemble_files",
    "F05_job_totals", "F11_committable_files", "S03_validate_manifest", "V03_review_pages", "V05_review_summary",
    "V06_far_window", "V07_goto_page", "V08_review_groups", "V10_group_samples", "V16_next_file", "L10_move_jobs",
    "L15_merge_plan_sliced", "L16_dashboard", "L18_history", "L22_many_names", "P04_job_snapshot", "P05_page_rate",
    "P11_upload_ledger", "P12_upload_speed", "T02_text_totals", "T03_text_export", "T15_job_markdown",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for name in TABLES:
        sql = SKEW.get(name, "SELECT * FROM t").replace(" FROM t", f" FROM '{SOURCE}/{name}.parquet'")
        columns = "* EXCLUDE (rn)" if "AS rn" in sql else "*"
        con.execute(f"COPY (SELECT {columns} FROM ({sql})) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_hot_key(spark, skewed, name):
    problem, _ = compare(
        spark, duck(skewed), entry_points.queries()[name], entry_points.oracle_sql()[name], skewed
    )
    assert problem is None, problem
