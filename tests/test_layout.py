"""Hand-made pages and properties of the row, column and Markdown folds; parts joined are the whole text."""

import random

import pytest
from pyspark.sql import functions as F

from pageflow.functions.text import word_count, strip, md_escape
from pageflow.operators import layout as lay

LAYOUT = (
    "job_id long, filename string, page int, rotation int, page_w double, page_h double, "
    "lines array<struct<ord:int,text:string,x0:double,y0:double,x1:double,y1:double,size:double>>"
)


def random_page(rng, page, n):
    lines = []
    for i in range(n):
        x, y = float(rng.randrange(0, 560, 5)), float(rng.randrange(0, 300, 4))
        h = rng.choice([0.5, 8.0, 10.0, 13.0, 16.0])
        text = rng.choice(["alpha", " beta ", "a|b", "", "\u00a0", "two words"])
        lines.append((i, text, x, y, x + 40, y + h, h))
    return (1, "a.pdf", page, rng.choice([0, 0, 90, 180, 270]), 612.0, 792.0, lines)


def line(i, text, x0, y0, size=10.0, height=None):
    return (i, text, float(x0), float(y0), float(x0) + 40, float(y0) + (height or size), size)


def page(number, lines, rotation=0):
    return (1, "a.pdf", number, rotation, 600.0, 800.0, lines)


# Pages written out by hand: (lines, expected Markdown). The page is 600 wide, so columns are
# told apart beyond 24.
HAND_MADE = [
    ([], ""),
    ([line(0, "  ", 10, 10), line(1, "\u00a0", 10, 30)], ""),
    ([line(0, "one", 10, 10), line(1, "two", 60, 12), line(2, "below", 10, 40)], "one two\n\nbelow"),
    # Reading order inside a row is by x, whatever the input order.
    ([line(0, "right", 300, 10), line(1, "left", 10, 11)], "left right"),
    # Headings: 1.25 and 1.5 times the body size, exactly on the border; a bar is escaped.
    ([line(0, "Top", 10, 10, 15.0), line(1, "Part", 10, 60, 12.5), line(2, "a|b", 10, 110), line(3, "c", 10, 140),
      line(4, "d", 10, 170)], "# Top\n\n## Part\n\na\\|b\n\nc\n\nd"),
    # Two rows of three cells are a table; x 100 and 124 are one column, 125 would be another.
    ([line(0, "A", 0, 10), line(1, "B", 100, 10), line(2, "C", 300, 10),
      line(3, "d", 0, 40), line(4, "e", 124, 40), line(5, "f", 300, 40)],
     "| A | B | C |\n| --- | --- | --- |\n| d | e | f |"),
    ([line(0, "A", 0, 10), line(1, "B", 100, 10), line(2, "C", 300, 10),
      line(3, "d", 0, 40), line(4, "e", 125, 40), line(5, "f", 300, 40)],
     "| A | B |  | C |\n| --- | --- | --- | --- |\n| d |  | e | f |"),
    # A single wide row is a paragraph.
    ([line(0, "A", 0, 10), line(1, "B", 100, 10), line(2, "C", 300, 10)], "A B C"),
    # Halfway between two columns goes left; two texts of one cell are joined.
    ([line(0, "A", 0, 10), line(1, "B", 30, 10), line(2, "C", 60, 10), line(3, "x", 0, 40), line(4, "y", 15, 40), line(5, "z", 60, 40)],
     "| A | B | C |\n| --- | --- | --- |\n| x y |  | z |"),
    # A paragraph between tables ends the first one.
    ([line(0, "A", 0, 10), line(1, "B", 100, 10), line(2, "C", 300, 10), line(3, "d", 0, 40), line(4, "e", 100, 40), line(5, "f", 300, 40),
      line(6, "text", 0, 80)], "| A | B | C |\n| --- | --- | --- |\n| d | e | f |\n\ntext"),
]


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(11)
    return [random_page(rng, p, rng.randrange(0, 40)) for p in range(60)]


def test_hand_made_pages(spark):
    df = spark.createDataFrame([page(i, lines) for i, (lines, _) in enumerate(HAND_MADE)], LAYOUT)
    got = {r.page: r.markdown for r in lay.page_markdown(df).collect()}
    assert got == {i: text for i, (_, text) in enumerate(HAND_MADE)}


@pytest.mark.parametrize("rotation", [90, 180, 270])
def test_a_turned_page_reads_like_the_upright_one(spark, rotation):
    lines, text = HAND_MADE[5]
    # Where the reader sees (x, y) of an upright 600 x 800 page, stored on a page turned by ``rotation``.
    place = {90: lambda x, y: (y, 600 - x), 180: lambda x, y: (600 - x, 800 - y), 270: lambda x, y: (800 - y, x)}[rotation]
    w, h = (600.0, 800.0) if rotation == 180 else (800.0, 600.0)
    turned = [(i, t, *place(x0, y0), *place(x1, y1), size) for i, t, x0, y0, x1, y1, size in lines]
    df = spark.createDataFrame([(1, "a.pdf", 0, rotation, w, h, turned)], LAYOUT)
    assert lay.page_markdown(df).first().markdown == text


def test_rows_and_columns_keep_their_promises(spark, pages):
    df = lay.group_rows(lay.display_lines(spark.createDataFrame(pages, LAYOUT)))
    for r in df.withColumn("cols", lay.columns_of(F.col("rows"), F.col("display_w"))).collect():
        texts = sorted(c.text for row in r.rows for c in row)
        assert texts == sorted(t.strip() for _, t, *_ in pages[r.page][6] if t.strip())  # every line once
        assert all(row == sorted(row, key=lambda c: c.x0) for row in r.rows)
        tops = [min(c.y0 for c in row) for row in r.rows]
        assert tops == sorted(tops)
        assert all(b - a > 0.04 * r.display_w for a, b in zip(r.cols, r.cols[1:]))
        starts = {c.x0 for row in r.rows for c in row}
        assert set(r.cols) <= starts and all(any(0 <= x - c <= 0.04 * r.display_w for c in r.cols) for x in starts)


def test_long_lines_give_the_same_markdown(spark, pages):
    df = spark.createDataFrame(pages, LAYOUT)
    long = df.select("job_id", "filename", "page", F.explode("lines").alias("l")).select("job_id", "filename", "page", "l.*")
    nested = lay.nest_page_lines(df.drop("lines"), long)
    key = lambda rows: sorted((r.page, r.markdown) for r in rows)
    assert key(lay.page_markdown(nested).collect()) == key(lay.page_markdown(df).collect())


def test_page_markdown_needs_no_exchange(spark):
    plan = lay.page_markdown(spark.createDataFrame([], LAYOUT))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_parts_joined_are_the_whole_text(spark):
    n = 600
    texts = [(1, f, p, f"text {p}") for f in ("b.pdf", "a.pdf") for p in range(n)]
    df = spark.createDataFrame(texts, "job_id long, filename string, page int, text string")
    parts = lay.text_export(df).orderBy("filename", "part").collect()
    assert len(parts) == 6
    want = []
    for f in ("a.pdf", "b.pdf"):
        want += [f"===== {f} ====="] + [f"\n--- Page {p + 1} ---\ntext {p}" for p in range(n)] + [""]
    assert "\n".join(r.body for r in parts) == "\n".join(want)


def test_job_markdown_parts(spark):
    md = [(1, f, p, "" if p == 1 else f"body {p}") for f in ("b.pdf", "a.pdf") for p in range(300)]
    df = spark.createDataFrame(md, "job_id long, filename string, page int, markdown string")
    parts = lay.job_markdown(lay.document_markdown(df)).orderBy("filename", "part").collect()
    docs = []
    for f in ("a.pdf", "b.pdf"):
        lines = [f"# {f}", ""]
        for p in range(300):
            lines += [f"## Page {p + 1}", "", f"body {p}" if p != 1 else "_No text recognised on this page._", ""]
        docs.append("\n".join(lines).strip())
    assert "\n".join(r.body for r in parts) == "\n\n---\n\n".join(docs)


def test_unicode_spaces(spark):
    samples = ["a b\u00a0c\u3000d", "", " \u2003 ", "x\x1cy\x85z", None, "tab\tnew\nline"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [tuple(r) for r in df.select(word_count(F.col("s")), strip(F.col("s"))).collect()]
    assert got == [(len(s.split()) if s else 0, s.strip() if s is not None else None) for s in samples]


def test_md_escape(spark):
    df = spark.createDataFrame([(" a|b\nc ",)], "s string")
    assert df.select(md_escape(F.col("s"))).first()[0] == "a\\|b c"


def test_body_size_is_upper_median(spark):
    sized = [line(0, "x", 0, 0, 0.0, 5), line(1, "x", 0, 20, 10.0), line(2, "x", 0, 40, 14.0)]
    df = spark.createDataFrame([page(0, sized)], LAYOUT)
    assert lay.display_lines(df).select(lay.body_size(F.col("cells"))).first()[0] == 14.0


def test_deskew_without_tilt_keeps_anchor(spark):
    df = spark.createDataFrame([(0.0, 612.0, 792.0, 100.0, 100.0, 140.0, 110.0)], "skew double, page_w double, page_h double, x0 double, y0 double, x1 double, y1 double")
    r = lay.deskew_layer(df).first()
    assert (round(r.new_w, 6), round(r.new_h, 6)) == (612.0, 792.0)
    assert (round(r.anchor_x, 6), round(r.anchor_y, 6)) == (100.0, 108.5)
