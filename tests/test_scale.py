"""Work that must not grow with the number of keys or with the size of a task's input."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F, types as T

from pageflow.functions.binding import let
from pageflow.llm import archive
from pageflow.operators import jobs as j, progress as p, review as v
from pageflow.plans.all_queries import QUERIES
from pageflow.sources import results as res
from pageflow.streaming import live as lv, progress as live, shards
from tests.test_progress import CHUNK, at, event, rows, stored

KEYS = 4000


def state_keys(spark, path, name, operator=0):
    reader = live.stream_session(spark).read.format("statestore").option("operatorId", operator).option("stateVarName", name)
    return reader.load(f"{path}/state").count()


def many_files():
    rng = random.Random(3)
    statuses = [None, "processing", "done", "failed"]
    return [event(i, i % KEYS // 5, rng.randrange(90), "page_done", f"f{i % 5}", rng.randrange(4), rng.choice(statuses[1:])) for i in range(2 * KEYS)]


def test_ledger_state_of_many_files_is_a_few_shards(spark, tmp_path):
    chunks = [(f, a, 4 * a, 4, 8) for f in range(KEYS) for a in range(2)]
    stream, df = stored(spark, tmp_path, [chunks[::2], chunks[1::2]], CHUNK)
    got = live.replay(live.upload_ledger(stream), str(tmp_path / "l"))
    columns = ("file_id", "arrival", "accepted", "received")
    assert rows(got, *columns) == [(f, a, True, 4 * a + 4) for f in range(KEYS) for a in range(2)]
    assert state_keys(spark, tmp_path / "l", "received") <= shards.SHARDS


def test_cancellation_state_of_many_jobs_is_a_few_shards(spark, tmp_path):
    before = [event(i, i, 1, "page_done", "a", 0) for i in range(200)]
    after = [event(1000 + i, i, 5, "page_done", "a", 0) for i in range(200)] + [event(3000 + i, i, 3, "cancelled", None) for i in range(0, 200, 2)]
    stream, _ = stored(spark, tmp_path, [before, after])
    got = live.replay(lv.drop_cancelled(stream), str(tmp_path / "c"))
    assert {r.event_id for r in got.collect()} == {*range(200), *range(1001, 1200, 2)}
    assert state_keys(spark, tmp_path / "c", "stop") <= shards.SHARDS  # 32 of each job before


def test_sticky_state_of_many_files_is_a_few_shards(spark, tmp_path):
    events = many_files()
    stream, df = stored(spark, tmp_path, [events[:KEYS], events[KEYS:]])
    changes = live.replay(live.sticky_status(stream), str(tmp_path / "s"))
    newest = F.max(F.struct(F.col("status").isin(*p.TERMINAL).alias("terminal"), "ts", "event_id", "status"))["status"]
    last = changes.groupBy(*p.FILE).agg(newest.alias("status"))
    assert rows(last, *p.FILE, "status") == rows(p.sticky_status(df), *p.FILE, "status")
    assert state_keys(spark, tmp_path / "s", "best") <= shards.SHARDS


def test_totals_state_of_many_jobs_is_a_few_shards(spark, tmp_path):
    events = many_files()
    stream, df = stored(spark, tmp_path, [events[:KEYS], events[KEYS:]])
    live.replay(lv.job_totals(stream, shards=64), str(tmp_path / "t"))
    files = df.groupBy(*p.FILE).agg(F.max("page").alias("pages"))
    snap = p.job_snapshot(p.file_snapshot(files, p.file_progress(df), p.sticky_status(df)))
    columns = ["job_id", "total_files", "completed_files", "total_pages", "completed_pages"]
    assert rows(lv.live_jobs(live.stream_session(spark), str(tmp_path / "t" / "state")), *columns) == rows(snap, *columns)
    assert state_keys(spark, tmp_path / "t", "totals") <= 64 and state_keys(spark, tmp_path / "t", "counted", 1) <= 64


def test_completion_of_many_jobs_and_a_job_without_id(spark, tmp_path):
    first = [event(i, i or None, 0, "status", "a", None, "done") for i in range(300)]
    stream, _ = stored(spark, tmp_path, [first, [event(900 + i, i or None, 1, "sealed") for i in range(300)]])
    done = live.replay(live.job_completion(stream, shards=16), str(tmp_path / "c"))
    assert {(r.job_id, r.outcome) for r in done.collect()} == {(i or None, "SUCCESS") for i in range(300)} and done.count() == 300
    assert state_keys(spark, tmp_path / "c", "jobs") <= 16


def test_each_key_of_a_shard_is_forgotten_by_its_own_time():
    box = SimpleNamespace(value=None)
    state = SimpleNamespace(get=lambda: box.value, update=lambda x: setattr(box, "value", x), clear=lambda: setattr(box, "value", None))
    handle = SimpleNamespace(getValueState=lambda name, schema, ttl: state)
    key, number = T.StructField("k", T.LongType()), T.StructField("n", T.LongType())
    held = shards.Held(handle, "x", [key], [number], ttl_ms=10)
    held.write({(1,): (7, 100), (2,): (8, 105)})
    assert held.read(109) == {(1,): (7, 100), (2,): (8, 105)}
    assert held.read(110) == {(2,): (8, 105)}
    held.write({})
    assert held.read(110) == {}
    forever = shards.Held(handle, "x", [key], [number], ttl_ms=None)
    forever.write({(1,): (7, 0)})
    assert forever.read(10**15) == {(1,): (7, 0)}


def test_buckets_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(res, "BUCKET_ROWS", 100)
    table = spark.range(1000).select(F.col("id").alias("job_id"), F.lit("a").alias("filename"), F.lit(0).alias("page"))
    res.write_bucketed_results(table, "grown_buckets", str(tmp_path / "b"), buckets=2)
    try:
        found = {r.col_name: r.data_type for r in spark.sql("DESCRIBE FORMATTED grown_buckets").collect()}
        assert found["Num Buckets"] == "10" and spark.table("grown_buckets").count() == 1000
    finally:
        spark.sql("DROP TABLE grown_buckets")


@pytest.mark.parametrize("name", ["F03_complete_files", "F04_assemble_files", "F06_job_result"])
def test_exchanges_are_cut_finer_than_the_session_asks(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    pieces = [line for line in plan.split("\n") if "Exchange hashpartitioning(job_id" in line]
    assert pieces and all(", 200)" in line or ", 200," in line for line in pieces)


def test_documents_are_parsed_once_and_only_where_the_path_names_a_page(spark):
    where = "file:/s/results/pages/" + "a" * 20 + "/"
    docs = [(where + "3.json", '{"angle": 90, "method": "m"}'), (where + "4.json", '{"angle": 9'), (where + "99999999999.json", '{"angle": 90}'),
            ("elsewhere/5.json", '{"angle": 90}'), (where + "6.json", None), (where + "7.json", '{"method": "m"}'), (None, '{"angle": 90}')]
    parsed = res.parse_page_results(spark.createDataFrame(docs, "path string, value string"))
    assert rows(parsed, "file_key", "page", "angle", "method") == [("a" * 20, 3, 90, "m")]
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_group_pages_read_verdicts_instead_of_deciding_again(spark):
    shared = let(F.col("id"), lambda x: x % 3)
    table = spark.range(12).select(
        F.lit(1).alias("job_id"), F.lit("a").alias("filename"), F.col("id").cast("int").alias("page"), (shared < 2).alias("needs_review"),
        F.when(shared == 0, "ambiguous").alias("reason"), F.when(F.col("id") < 9, 90).alias("angle"))
    pages = lambda reason, angle: [r.page for r in v.group_pages(table, reason, angle).select(*j.KEYS).orderBy("page").collect()]
    assert pages("ambiguous", 90) == [0, 3, 6] and pages("unknown", 90) == [1, 4, 7] and pages("unknown", 0) == [10]
    plan = v.group_pages(table, "ambiguous", 90)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "lambda" in line]


def test_a_payload_is_digested_once(spark):
    table = spark.createDataFrame([("<p>a</p>",)], "html string")
    plan = table.select(archive.sha1_base32(F.col("html")).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha1(") == 1
