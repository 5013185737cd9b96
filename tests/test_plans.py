"""What plans read: sources are scanned a bounded number of times, repeated rows change nothing."""

import pytest
from pyspark.sql import functions as F

from pageflow.operators import jobs as j
from pageflow.plans.all_queries import QUERIES
from pageflow.sources import results

SF = "/root/testdata/sf0.001"


def scans(df, table):
    """Reads of a table in the first physical plan, before exchanges are reused."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(f"{table}.parquet" in line for line in plan.split("\n") if "FileScan" in line)


@pytest.mark.parametrize(
    "name, table, most",
    [("L15_merge_plan", "orders", 4), ("L15_merge_plan", "supplier", 1), ("F03_complete_files", "lineitem", 3),
     ("F04_assemble_files", "lineitem", 4), ("T15_job_markdown", "documents", 7)],
)
def test_number_of_scans(spark, name, table, most):
    assert 0 < scans(QUERIES[name](spark, SF), table) <= most


def test_bucketed_results_are_joined_without_an_exchange(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") % 7).alias("job_id"), F.concat(F.lit("f"), F.col("id") % 50).alias("filename"),
                                    F.floor(F.col("id") / 350).cast("int").alias("page"))
    results.write_bucketed_results(rows, "bucketed_results", str(tmp_path / "b"), buckets=8)
    files = rows.groupBy("job_id", "filename").agg((F.max("page") + 1).alias("pages")).withColumn("note", F.lit("x"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        stored, plain = j.complete_files(files, spark.table("bucketed_results")), j.complete_files(files, rows)
        assert "Bucketed: true" in stored._jdf.queryExecution().executedPlan().toString()
        assert exchanges(stored) < exchanges(plain)
        joined = spark.table("bucketed_results").groupBy("job_id", "filename").agg(F.count("*").alias("n"))
        assert exchanges(joined) == 0
        assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE bucketed_results")


def test_texts_are_not_read_to_find_a_file_s_ends(spark):
    plan = QUERIES["T15_job_markdown"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    reads = [line for line in plan.split("\n") if "FileScan" in line and "documents.parquet" in line]
    assert sum("text:string" in line for line in reads) == 1


def test_a_file_listed_twice_is_complete_all_the_same(spark):
    files = [(1, "a.pdf", 2, "x"), (1, "a.pdf", 2, "y"), (1, "b.pdf", 1, "x"), (1, "c.pdf", 2, "x"), (1, "c.pdf", 3, "x"), (1, "d.pdf", 3, "x")]
    listed = spark.createDataFrame(files, "job_id long, filename string, pages int, note string")
    held = spark.createDataFrame([(1, "a.pdf", p) for p in (0, 1, 1)] + [(1, "b.pdf", 0)] + [(1, "c.pdf", p) for p in (0, 1)] + [(1, "d.pdf", 0)],
                                 "job_id long, filename string, page int")
    done = j.complete_files(listed, held)
    assert sorted(tuple(r) for r in done.select("filename", "pages", "note").collect()) == [
        ("a.pdf", 2, "x"), ("a.pdf", 2, "y"), ("b.pdf", 1, "x"), ("c.pdf", 2, "x")]
    assert done.columns == listed.columns or set(done.columns) == set(listed.columns)


def test_null_page_counts_and_pages_out_of_range(spark):
    listed = spark.createDataFrame([(1, "a", None), (1, "b", 0), (1, "c", 1)], "job_id long, filename string, pages int")
    held = spark.createDataFrame([(1, "a", 0), (1, "b", 0), (1, "c", 5), (1, "c", -1)], "job_id long, filename string, page int")
    assert j.complete_files(listed, held).count() == 0
    assert j.complete_files(listed, held.unionByName(held.limit(1).select("job_id", F.lit("c").alias("filename"), F.lit(0).alias("page")))).count() == 1
