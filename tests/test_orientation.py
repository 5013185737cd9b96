"""Thresholds exactly on their bounds, ties, and shape invariants of page orientation."""

import pytest
from pyspark.sql import functions as F

from pageflow.functions import geometry
from pageflow.operators import orientation as o
from pageflow.rules import GLYPH_WIDTHS
from pageflow.sources import extract


def decide(spark, s0, s90, s180, s270, ink=0.5, skew=0.0):
    df = spark.createDataFrame(
        [(1, "a.pdf", 0, float(s0), float(s90), float(s180), float(s270), ink, skew)],
        "job_id long, filename string, page int, s0 double, s90 double, s180 double, s270 double, ink_ratio double, skew double",
    )
    row = o.decide(df).first()
    return row.angle, row.reason, row.needs_review


@pytest.mark.parametrize(
    "scores, expected",
    [
        ((4.999, 0, 0, 0), (0, "no_text", True)),
        ((5.0, 0, 0, 0), (0, None, False)),          # exactly the low score is enough
        ((8.0, 10.0, 0, 0), (270, "ambiguous", True)),  # margin exactly 2 is no longer close to zero
        ((8.001, 10.0, 0, 0), (0, "close_to_zero", True)),
        ((0, 8.0, 6.0, 0), (270, None, False)),      # ratio exactly 0.25 is clear
        ((0, 8.0, 6.01, 0), (270, "ambiguous", True)),
        ((0, 0, 9.0, 0), (180, None, False)),
        ((0, 0, 0, 9.0), (90, None, False)),
        ((9.0, 9.0, 9.0, 9.0), (0, "ambiguous", True)),  # tie: lowest rotation, runner-up equals best
        ((0, 0, 0, 0), (0, "no_text", True)),
    ],
)
def test_decision_bounds(spark, scores, expected):
    assert decide(spark, *scores) == expected


@pytest.mark.parametrize(
    "ink, skew, reason",
    [
        (0.002, 0.0, None), (0.0019, 0.0, "blank"), (0.0019, 3.0, "blank"),
        (0.5, 0.75, "skewed"), (0.5, -0.75, "skewed"), (0.5, 0.74, None),
    ],
)
def test_blank_and_skew(spark, ink, skew, reason):
    assert decide(spark, 9, 0, 0, 0, ink, skew)[1] == reason


def test_blank_outranks_and_skew_never_overrides(spark):
    assert decide(spark, 1, 0, 0, 0, 0.001, 5.0) == (0, "blank", True)
    assert decide(spark, 1, 0, 0, 0, 0.5, 5.0) == (0, "no_text", True)


LINES = (
    "job_id long, filename string, page int, angle int, ord int, "
    "box array<struct<x:double,y:double>>, text string, conf double"
)


def box(x, y, w, h, drop=0.0):
    return [(x, y), (x + w, y + drop), (x + w, y + h + drop), (x, y + h)]


def test_readable_is_strict_on_confidence_and_aspect(spark):
    rows = [
        (1, "a", 0, 0, 0, box(0., 0., 20., 10.), "at bound", 0.6),
        (1, "a", 0, 0, 1, box(0., 0., 20., 10.), "above", 0.61),
        (1, "a", 0, 0, 2, box(0., 0., 8., 10.), "w = 0.8 h", 0.9),
        (1, "a", 0, 0, 3, box(0., 0., 8.1, 10.), "square", 0.9),
    ]
    df = spark.createDataFrame(rows, LINES)
    assert [r.ord for r in o.readable_lines(df).orderBy("ord").collect()] == [1, 3]


def test_scores_of_pages_without_lines_are_zero(spark):
    pages = spark.createDataFrame([(1, "a", 0), (1, "a", 1)], "job_id long, filename string, page int")
    lines = spark.createDataFrame([(1, "a", 0, 90, 0, box(0., 0., 20., 10.), "x", 0.9)], LINES)
    got = {r.page: (r.s0, r.s90) for r in o.rotation_scores(lines, pages).collect()}
    assert got == {0: (0.0, 0.9), 1: (0.0, 0.0)}


def test_skew_is_exact_median_of_usable_lines(spark):
    rows = [
        (1, "a", 0, 0, 0, box(0., 0., 100., 10., 1.0), "a", 0.9),
        (1, "a", 0, 0, 1, box(0., 0., 100., 10., 2.0), "b", 0.9),
        (1, "a", 0, 0, 2, box(0., 0., 0.5, 0.1, 9.0), "dx below 1", 0.9),
        (1, "a", 0, 0, 3, box(0., 0., 10., 10., 9.0), "beyond 20 degrees", 0.9),
    ]
    got = o.skew_degrees(spark.createDataFrame(rows, LINES)).first().skew
    assert got == pytest.approx((0.573 + 1.146) / 2, abs=0.006)


@pytest.mark.parametrize("angle", [0, 90, 180, 270])
def test_unrotate_undoes_the_rotation(spark, angle):
    w, h, x, y = 850.0, 1100.0, 120.0, 300.0
    seen = {0: (x, y), 90: (h - y, x), 180: (w - x, h - y), 270: (y, w - x)}[angle]
    df = spark.createDataFrame([([seen],)], "box array<struct<x:double,y:double>>")
    back = df.select(geometry.unrotate(F.col("box"), F.lit(angle), F.lit(w), F.lit(h)).alias("b")).first().b[0]
    assert (back.x, back.y) == (x, y)


def page_of(lines, meta=0, error=None, ink=0.5, page=0):
    return (1, "a.pdf", page, 850, 1100, ink, meta, error, lines)


def test_flagship_special_pages_and_long_path_agree(spark):
    from pageflow.schemas import EXTRACTED

    seen = [(90, i, box(10., 10. + 20 * i, 100., 10.), f"wort {i} da", 0.95) for i in range(8)]
    order = ["job_id", "filename", "page", "width", "height", "ink_ratio", "meta_rotation", "error", "lines"]
    rows = [
        page_of(seen), page_of(seen, meta=180, page=1), page_of(seen, meta=45, page=2),
        page_of(seen, error="boom", meta=90, page=3), page_of([], page=4), page_of(None, page=5), page_of(seen, ink=0.001, page=6),
    ]
    df = spark.createDataFrame(rows, EXTRACTED)
    assert df.columns == order
    got = {r.page: r for r in o.analyze_orientation(df).collect()}
    assert (got[0].angle, got[0].method, got[0].reason, got[0].word_count) == (270, "universal_recognizer", None, 24)
    assert got[0].scores == {"0": 0.0, "90": 7.6, "180": 0.0, "270": 0.0}
    assert got[0].text[0].rect == [7.2, 712.8, 14.4, 784.8]
    assert (got[1].angle, got[1].method, got[1].scores, got[1].text, got[1].skew) == (180, "metadata", {}, [], None)
    assert got[2].method == "universal_recognizer"
    assert (got[3].angle, got[3].method, got[3].reason, got[3].needs_review) == (0, "error", "error", True)
    assert got[4].reason == got[5].reason == "no_text" and got[5].skew == 0.0
    assert (got[6].angle, got[6].reason) == (270, "blank")
    # The long shape, nested again, gives the same rows.
    long = df.filter("lines is not null").select("job_id", "filename", "page", F.explode("lines").alias("l")).select(
        "job_id", "filename", "page", "l.*"
    )
    again = o.analyze_orientation(o.nest_lines(df.drop("lines"), long)).orderBy("page").collect()
    assert again == [got[i] for i in range(7)]


def test_flagship_needs_no_exchange(spark):
    from pageflow.schemas import EXTRACTED

    plan = o.analyze_orientation(spark.createDataFrame([], EXTRACTED))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize(
    "rotation, angle, method, expected",
    [(90, 0, "universal_recognizer", 90), (90, 180, "universal_recognizer", 270), (0, 90, "universal_recognizer", 270),
     (90, 270, "metadata", 0), (180, None, None, 180)],
)
def test_apply_rotation(spark, rotation, angle, method, expected):
    df = spark.createDataFrame([(rotation, angle, method)], "rotation int, angle int, method string")
    assert o.apply_rotation(df).first().new_rotation == expected


def test_ink_ratio_counts_dark_pixels(spark):
    white, black = bytes([255] * 3), bytes([0] * 3)
    df = spark.createDataFrame(
        [(white * 3 + black, 3), (b"", 3), (bytes([199, 200, 255]), 1), (bytes([200, 200, 200]), 3), (bytes([199, 200, 200]), 3)],
        "samples binary, ch int",
    )
    got = [r.i for r in df.select(extract.ink_ratio(F.col("samples"), F.col("ch")).alias("i")).collect()]
    assert got == [0.25, 0.0, pytest.approx(1 / 3), 0.0, 0.0]


def test_extractor_errors_become_rows_and_init_runs_per_worker(spark):
    def init():
        return {"angle": 0}

    def extractor(model, page):
        if page["page"] == 1:
            raise RuntimeError("bad page")
        return {"width": 1, "height": 1, "ink_ratio": 0.5, "meta_rotation": 0, "lines": []}

    pages = spark.createDataFrame([(1, "a", i) for i in range(3)], "job_id long, filename string, page int")
    rows = {r.page: r.error for r in extract.analyze_pages(pages, extractor, init).collect()}
    assert rows == {0: None, 1: "bad page", 2: None}


def test_init_runs_once_per_worker_process(spark, tmp_path):
    log = str(tmp_path / "inits")

    def init():
        import os

        with open(log, "a") as fh:
            fh.write(f"{os.getpid()}\n")
        return None

    pages = spark.createDataFrame([(1, "a", i) for i in range(40)], "job_id long, filename string, page int")
    analyzed = extract.analyze_pages(pages, lambda m, p: {"lines": []}, init, partitions=16)
    for _ in range(2):
        analyzed.count()
    pids = open(log).read().split()
    assert pids and len(pids) == len(set(pids))


def test_each_call_has_its_own_model(spark):
    pages = spark.createDataFrame([(1, "a", i) for i in range(8)], "job_id long, filename string, page int")
    seen = lambda model, page: {"width": model, "lines": []}
    for value in (3, 4):
        got = extract.analyze_pages(pages, seen, lambda value=value: value).select("width").distinct().collect()
        assert [r.width for r in got] == [value]


def test_font_size_fits_the_text_to_its_box(spark):
    lines = [
        ("Hello", [0.0, 0.0, 56.95, 20.0]),                  # 722 + 556 + 222 + 222 + 556 = 2278: exactly 25
        ("iiii", [0.0, 0.0, 200.0, 10.0]),                   # would be 225.2: at most 100
        ("W" * 60, [0.0, 0.0, 10.0, 10.0]),                  # would be 0.177: at least 0.5
        ("\u00e9\u20ac\u540d", [0.0, 0.0, 13.9, 9.0]),     # 556 + 556 + 278 for a character without a glyph: 10
        ("  a  ", [0.0, 0.0, 5.56, 9.0]),                    # spaces around do not count: 10
        (" ", [0.0, 0.0, 5.0, 9.0]), ("x", [0.0, 0.0, 0.0, 9.0]), ("x", None),
    ]
    df = spark.createDataFrame(lines, "text string, rect array<double>")
    got = {r.text: r.font_size for r in o.text_layer_placeable(df).collect()}
    assert got == {"Hello": pytest.approx(25), "iiii": 100.0, "W" * 60: 0.5, "\u00e9\u20ac\u540d": pytest.approx(10), "  a  ": pytest.approx(10)}


def test_glyph_widths_list_each_character_of_the_code_page_once():
    listed = "".join(GLYPH_WIDTHS.values())
    page = {bytes([b]).decode("cp1252", "ignore") for b in range(32, 256) if b != 127} - {""}
    assert len(listed) == len(set(listed)) and set(listed) == page
