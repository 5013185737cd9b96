"""Review, job and library rules on small hand-made tables, hot groups included."""

import json

import pytest
from pyspark.sql import Window, functions as F

from pageflow import session
from pageflow.functions.text import base_name, format_bytes, format_duration
from pageflow.operators import jobs as j, library as lib, ranking, review as v
from pageflow.sources import files as src, results as res

KEYS = "job_id long, filename string, page int"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def results(spark, data):
    return spark.createDataFrame(data, KEYS + ", angle int, needs_review boolean, reason string, skew double, method string")


def test_reviewed_round_trip_and_damaged_json(spark):
    marks = [(1, "a::b.pdf", 2), (1, "a::b.pdf", 10), (1, "c.pdf", 5000), (2, "x.pdf", 0)]
    reviewed = spark.createDataFrame(marks, KEYS)
    packed = v.pack_reviewed(reviewed)
    first = packed.filter("filename = 'a::b.pdf'").first()
    assert json.loads(first.reviewed_pages) == ["a::b.pdf::10", "a::b.pdf::2"]
    assert rows(v.parse_reviewed(packed), "job_id", "filename", "page") == sorted(marks)
    bad = spark.createDataFrame([(3, "not json"), (4, None), (5, '["p.pdf::x", "q.pdf::1"]')], "job_id long, reviewed_pages string")
    assert rows(v.parse_reviewed(bad), "job_id", "filename", "page") == [(5, "q.pdf", 1)]


def test_group_order_ties_and_samples(spark):
    data = [(1, "b.pdf", p, 0, True, "blank", 0.0, "u") for p in range(3)]
    data += [(1, "a.pdf", p, 90, True, "ambiguous", 0.0, "u") for p in range(2)]
    data += [(1, "c.pdf", 0, 180, True, "ambiguous", 0.0, "u"), (1, "a.pdf", 9, 270, True, "ambiguous", 0.0, "u")]
    data += [(1, "z.pdf", 0, 0, True, None, 0.0, "u"), (1, "z.pdf", 1, 0, False, None, 0.0, "u")]
    r = results(spark, data)
    none = spark.createDataFrame([], KEYS)
    ordered = v.order_groups(v.review_groups(r, none))
    got = [(g.reason, g.angle, g.pages, g.files) for g in ordered.orderBy("position").collect()]
    assert got == [("ambiguous", 90, 2, 1), ("ambiguous", 270, 1, 1), ("ambiguous", 180, 1, 1), ("blank", 0, 3, 1), ("unknown", 0, 1, 1)]
    many = results(spark, [(1, f, p, 0, True, "blank", 0.0, "u") for f in "ab" for p in range(5)] + [(1, "c", 7, 0, True, "blank", 0.0, "u")])
    sample = v.group_samples(many, 4).orderBy("position").collect()
    assert [(s.filename, s.page) for s in sample] == [("a", 0), ("b", 0), ("c", 7), ("a", 1)]


def test_window_and_goto(spark):
    r = results(spark, [(1, f, p, 0, True, "blank", 0.0, "u") for f in ("b", "a") for p in range(6)])
    near = v.page_window(r, offset=4, limit=3).orderBy("position").collect()
    assert [(x.filename, x.page, x.position) for x in near] == [("a", 4, 5), ("a", 5, 6), ("b", 0, 7)]
    big = spark.range(6000).select(F.lit(1).cast("long").alias("job_id"), F.lit("f").alias("filename"), F.col("id").cast("int").alias("page"))
    far = v.page_window(big, offset=5990, limit=500).collect()
    assert sorted(x.page for x in far) == list(range(5990, 6000))
    found = v.goto_page(r, 3, limit=4, file="b").first()
    assert (found.goto_found, found.offset) == (True, 8)
    missing = v.goto_page(r, 99, limit=4).first()
    assert (missing.goto_found, missing.offset) == (False, 0)


def test_first_k_ships_few_rows_of_a_hot_group(spark):
    """The plan limits each group before the exchange."""
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    plan = ranking.first_k(df, ["g"], ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    # Printed top down: the partial limit is below the exchange.
    assert plan.index("Exchange hashpartitioning") < plan.index(", Partial")


def test_running_total_by_levels_equals_plain_window(spark):
    group = F.when(F.col("id") % 3 > 0, F.col("id") % 3)  # a null group is one too
    df = spark.range(5000).select(group.alias("g"), F.col("id").alias("o"), (F.col("id") % 7).alias("n"))
    levels = {"coarse": F.floor(F.col("o") / 500), "fine": F.floor(F.col("o") / 20)}
    before = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    plain = df.withColumn("s", F.coalesce(F.sum("n").over(before), F.lit(0)))
    got = ranking.running_total(df, ["g"], levels, ["o"], "n", "s")
    key = lambda r: (r.g or 0, r.o, r.s)
    assert sorted(map(key, got.collect())) == sorted(map(key, plain.collect()))


def test_page_window_near_and_far_are_alike(spark):
    pages = spark.range(6000).select(
        (F.col("id") % 2).alias("job_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("f"), F.col("id") % 3)).alias("filename"),
        F.col("id").cast("int").alias("page"))
    every = pages.withColumn("position", F.row_number().over(Window.partitionBy("job_id").orderBy("filename", "page")))
    for offset in (0, 950, 2950):
        got = v.page_window(pages, offset, 100)
        want = every.filter((F.col("position") > offset) & (F.col("position") <= offset + 100))
        assert dict(got.dtypes)["position"] == "bigint"
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_page_window_of_a_job_of_very_many_files(spark, monkeypatch):
    """More files than splitters: no window holds all of a job's files."""
    monkeypatch.setattr(ranking, "SPLITTERS", 16)
    pages = spark.range(20_000).select(
        F.when(F.col("id") % 5 > 0, 1).otherwise(2).alias("job_id"), F.concat(F.lit("f"), F.floor(F.col("id") / 4)).alias("filename"),
        (F.col("id") % 4).cast("int").alias("page"))
    every = pages.withColumn("position", F.row_number().over(Window.partitionBy("job_id").orderBy("filename", "page")))
    for offset in (0, 7_300, 15_990):
        got = v.page_window(pages, offset, 50)
        want = every.filter((F.col("position") > offset) & (F.col("position") <= offset + 50))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    plan = v.page_window(pages, 0, 10)._jdf.queryExecution().executedPlan().toString()
    sums = [line for line in plan.split("\n") if "Window [sum" in line]
    assert len(sums) == 2 and all("_range" in line for line in sums)


def test_no_job_runs_while_windows_and_totals_are_built(spark):
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    df = spark.range(10).select(F.lit(1).alias("job_id"), F.lit("a").alias("filename"), F.col("id").cast("int").alias("page"))
    v.page_window(df, 5000, 10)
    ranking.running_total(df, ["job_id"], {"_b": F.col("page")}, ["page"], "page", "s")
    assert set(tracker.getJobIdsForGroup(None)) == before


def test_expand_pages_crosses_blocks_and_complete_files_counts_pages_once(spark):
    files = spark.createDataFrame([(1, "a", 9000), (1, "b", 0), (1, "c", 2), (1, "d", 5000)], "job_id long, filename string, pages int")
    pages = j.expand_pages(files)
    assert pages.groupBy("filename").agg(F.count("*"), F.min("page"), F.max("page"), F.count_distinct("page")).orderBy("filename").collect() == [
        ("a", 9000, 0, 8999, 9000), ("c", 2, 0, 1, 2), ("d", 5000, 0, 4999, 5000)]
    keys = pages.select("job_id", "filename", "page")
    # c has a repeated page and one beyond its end instead of page 1; d has all and one beyond.
    odd = spark.createDataFrame([(1, "c", 0), (1, "c", 7), (1, "d", 5000), (1, "d", -1)], "job_id long, filename string, page int")
    results = keys.filter("filename <> 'c' or page = 0").unionByName(odd)
    assert [r.filename for r in j.complete_files(files, results).orderBy("filename").collect()] == ["a", "d"]


def test_bad_page_keys_are_no_pages(spark):
    jobs = spark.createDataFrame([(1, '["a::1", "a::99999999999", "b"]'), (2, "[broken"), (3, None)], "job_id long, reviewed_pages string")
    assert [(r.filename, r.page) for r in v.parse_reviewed(jobs).collect()] == [("a", 1)]
    doc = '{"angle": 90, "method": "m"}'
    key = "0" * 20
    docs = spark.createDataFrame([(f"x/results/pages/{key}/3.json", doc), (f"x/results/pages/{key}/99999999999.json", doc)], "path string, value string")
    assert [r.page for r in res.parse_page_results(docs).collect()] == [3]
    summary = '{"filename": "a", "page_rotations": {"1": 0, "99999999999": 0}, "page_details": {"1": {}, "99999999999": {}}}'
    assert [r.page for r in res.parse_file_summaries(spark.createDataFrame([(summary,)], "value string")).collect()] == [1]


def test_a_missing_angle_is_zero_in_groups_and_actions(spark):
    r = results(spark, [(1, "a", 0, None, True, "blank", 0.0, "u"), (1, "a", 1, 0, True, "blank", 0.0, "u")])
    none = spark.createDataFrame([], "job_id long, filename string, page int")
    assert [(g.angle, g.pages) for g in v.review_groups(r, none).collect()] == [(0, 2)]
    assert v.group_pages(r, "blank", 0).count() == 2


def test_repeats_in_inventory_and_moves_do_not_double_rows(spark):
    files = spark.createDataFrame([(1, "/p", 0)], "file_id long, file_path string, pages int")
    twice = spark.createDataFrame([("/p",), ("/p",)], "path string")
    assert j.fail_missing(files, twice).count() == 1
    jobs = spark.createDataFrame([(1, 5, "s1", None)], "job_id long, user_id long, session_id string, folder_id long")
    held = spark.createDataFrame([(7, "/store/s1/output/a.pdf", None)], "file_id long, file_path string, folder_id long")
    folders = spark.createDataFrame([(3, 5)], "folder_id long, user_id long")
    moves = spark.createDataFrame([(1, 5, 3), (1, 5, None)], "job_id long, user_id long, target long")
    moved, moved_files = lib.move_jobs(jobs, held, folders, moves)
    assert [x.folder_id for x in moved.collect()] == [3] and [x.folder_id for x in moved_files.collect()] == [3]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})()
        sparkContext = type("S", (), {"master": "spark://host:7077", "_jsc": type("J", (), {"sc": staticmethod(
            lambda: type("X", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)})())})())})()})()

    with pytest.raises(ValueError, match="share"):
        session.checkpoint_dir(Cluster())


def test_group_and_bulk_actions(spark):
    r = results(spark, [(1, "a", 0, 90, True, "ambiguous", 0.0, "u"), (1, "a", 7, 90, True, "ambiguous", 0.0, "u"),
                        (1, "gone", 0, 90, True, "ambiguous", 0.0, "u"), (1, "a", 1, 0, False, None, 0.0, "u")])
    rot = spark.createDataFrame([(1, "a", 0, 270), (1, "a", 1, 0)], KEYS + ", rotation int")
    marks = spark.createDataFrame([(1, "a", 0)], KEYS)
    after, turned, summary = v.group_action(r, marks, rot, "ambiguous", 90, "rotate", 180)
    assert rows(turned, "page", "rotation") == [(0, 90), (1, 0)]
    assert rows(after, "filename", "page") == [("a", 0), ("a", 7), ("gone", 0)]
    assert tuple(summary.first()) == (1, 3, 2, 3)
    after, turned, summary = v.bulk_action(r, marks, rot, "rotate_all", 90)
    assert rows(turned, "page", "rotation") == [(0, 0), (1, 90)]        # every output page turns
    assert ("gone", 0) not in rows(after, "filename", "page")           # skipped with its marks
    after, turned, _ = v.bulk_action(r, marks, rot, "rotate_all", 360)   # acts as accept
    assert rows(turned, "page", "rotation") == [(0, 270), (1, 0)] and ("gone", 0) in rows(after, "filename", "page")
    again, _, _ = v.bulk_action(r, after, rot, "accept_all")
    assert rows(again, "filename", "page") == rows(after, "filename", "page")
    with pytest.raises(ValueError):
        v.bulk_action(r, marks, rot, "rotate_all", 45)
    with pytest.raises(ValueError):
        v.group_action(r, marks, rot, "ambiguous", 90, "explode")


def test_deskew_needs_a_measurable_tilt(spark):
    r = results(spark, [(1, "a", p, 0, True, "skewed", s, "u") for p, s in enumerate([0.09, 0.1, -3.0, None])])
    pages = r.select("job_id", "filename", "page")
    assert [x.page for x in v.deskew_candidates(r, pages).orderBy("position").collect()] == [2, 1]


def test_job_outcomes(spark):
    jobs = spark.createDataFrame(
        [(i, "PROCESSING", True, False, "s") for i in range(5)] + [(5, "PROCESSING", False, False, "s"), (6, "PROCESSING", True, True, "s"), (7, "SUCCESS", True, False, "s")],
        "job_id long, status string, sealed boolean, cancelled boolean, session_id string",
    )
    status = spark.createDataFrame(
        [(1, "done"), (1, "queued"), (2, "failed"), (2, "failed"), (3, "done"), (3, "failed"), (4, "done")],
        "job_id long, file_status string",
    )
    got = {r.job_id: (r.outcome, r.error) for r in j.job_outcome(jobs, status).collect()}
    assert got == {0: ("FAILED", "No files were uploaded."), 1: (None, None), 2: ("FAILED", "None of the files could be processed."),
                   3: ("SUCCESS", None), 4: ("SUCCESS", None)}


def test_files_without_pages_never_complete(spark):
    files = spark.createDataFrame([(1, "a", 2), (1, "b", 0), (1, "c", None), (1, "d", 1)], "job_id long, filename string, pages int")
    done = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (1, "a", 5), (1, "d", 3)], KEYS)
    assert rows(j.complete_files(files, done), "filename") == [("a",)]
    assert rows(j.expand_pages(files), "filename", "page") == [("a", 0), ("a", 1), ("d", 0)]


def test_first_result_wins_with_many_copies(spark):
    copies = spark.range(2000).select(F.lit(1).cast("long").alias("job_id"), F.lit("a").alias("filename"), F.lit(0).alias("page"), F.col("id").alias("ts"))
    assert j.first_result(copies, ["job_id", "filename", "page"], ["ts"]).first().ts == 0


def test_single_and_batch_access_rules_differ(spark):
    folders = spark.createDataFrame([(1, 7), (2, 8)], "folder_id long, user_id long")
    files = spark.createDataFrame(
        [(10, 1, 7), (11, 2, 7), (12, None, 7), (13, 99, 7), (14, 1, None)], "file_id long, folder_id long, user_id long"
    )
    ids = files.select("file_id")
    assert rows(lib.accessible_files(files, folders, 7), "file_id") == [(10,), (12,), (14,)]
    assert rows(lib.deletable_files(files, folders, ids, 7), "file_id") == [(10,), (11,), (12,), (13,), (14,)]


def test_compare_budget_stops_at_forty(spark):
    files = spark.createDataFrame([(1, f"{i:02}", n) for i, n in enumerate([25, 0, 15, 30, 9])], "job_id long, filename string, pages int")
    assert rows(lib.compare_budget(files), "filename", "shown") == [("00", 20), ("02", 15), ("03", 5)]


def test_manifest_verdicts(spark):
    data = [(0, "C:\\x\\a.PDF", 10), (1, "a.PDF", 10), (2, "a.PDF", 11), (3, "b.pdf", 0), (4, "b.pdf", 5), (5, "c.pdf", 5),
            (6, ".pdf/..", 5), (7, "d.pdf", 3 * 2**30), (8, "c.pdf", 6), (9, None, 5), (10, "dir/", 5)]
    m = spark.createDataFrame([(1, o, n, s) for o, n, s in data], "upload_id long, ord int, filename string, size long")
    got = [r.verdict for r in src.validate_manifest(m, max_files=2).orderBy("ord").collect()]
    assert got == ["accepted", "same_file", "conflict", "empty", "accepted", "over_limit", "not_pdf", "too_large", "over_limit", "not_pdf", "not_pdf"]
    names = spark.createDataFrame([("a/b\\ c.pdf ",), ("/x/",), ("n.pdf",)], "s string")
    assert [r[0] for r in names.select(base_name(F.col("s"))).collect()] == ["c.pdf", "", "n.pdf"]


@pytest.mark.parametrize("s, text", [(None, None), (0.0, "1s"), (59.4, "59s"), (60.0, "1m"), (185.0, "3m 5s"), (3600.0, "1h 0m"), (7800.0, "2h 10m")])
def test_durations(spark, s, text):
    assert spark.createDataFrame([(s,)], "s double").select(format_duration(F.col("s"))).first()[0] == text


@pytest.mark.parametrize("n, text", [(0, "0 B"), (1023, "1023 B"), (1536, "1.5 KB"), (102400, "100 KB"), (5 * 2**20, "5.0 MB"), (3000 * 2**30, "3000 GB")])
def test_sizes(spark, n, text):
    assert spark.createDataFrame([(n,)], "n long").select(format_bytes(F.col("n"))).first()[0] == text


def test_stored_documents_round_trip(spark, tmp_path):
    key = "0123456789abcdef0123"
    folder = tmp_path / "results" / "pages" / key
    folder.mkdir(parents=True)
    (folder / "0.json").write_text(json.dumps({"angle": 90, "method": "u", "details": {"scores": {"0": 1.5}, "needs_review": True, "reason": "blank"}, "text": []}))
    (folder / "12.json").write_text(json.dumps({"angle": 0, "method": "metadata", "details": {"scores": {}, "needs_review": False, "reason": None}, "text": []}))
    (folder / "13.json").write_text('{"angle": ')
    got = rows(res.read_page_results(spark, str(tmp_path)), "file_key", "page", "angle", "method")
    assert got == [(key, 0, 90, "u"), (key, 12, 0, "metadata")]
    done = tmp_path / "files"
    done.mkdir()
    (done / "a.json").write_text(json.dumps({"filename": "a", "page_rotations": {"0": 90, "1": 0}, "page_details": {"0": {"angle": 90, "reason": "blank"}, "1": {"angle": 0}, "x": {}}}))
    (done / "b.json").write_text("nonsense")
    assert rows(res.read_file_summaries(spark, str(done)), "filename", "page", "rotation") == [("a", 0, 90), ("a", 1, 0)]


def test_scan_ignores_extension_case(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("a.PDF", "deep/b.pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    found = src.scan_files(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.PDF", "b.pdf"]


def test_results_written_in_key_order_and_prunable(spark, tmp_path):
    data = results(spark, [(i % 5, "a", i, 0, False, None, 0.0, "u") for i in range(100)])
    res.write_page_results(data, str(tmp_path / "out"))
    back = res.read_stored_results(spark, str(tmp_path / "out"))
    assert rows(back, "job_id", "page") == rows(data, "job_id", "page")
    plan = back.filter("job_id = 3").select("page")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(job_id), EqualTo(job_id,3)]" in plan and "reason" not in plan
