"""The pipeline's stages against plain versions, the queries against their SQL, and the guard."""

import os
import subprocess
import sys
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from pageflow.llm import mixing
from pageflow.llm.queries import ORACLES, QUERIES
from tests.llm.test_similar import brute
from tests.oracle import compare, duck

SF_DIR = os.environ.get("PAGEFLOW_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    problem, rows = compare(spark, con, QUERIES[name], ORACLES[name], SF_DIR)
    assert problem is None and rows > 0, problem


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


DOCS = "doc_id long, text string, lang string, source string, n_chars long, file_id int, score string, lines_dropped long"


@pytest.fixture(scope="module")
def stages(spark):
    """Documents with odd rows, and what every stage makes of them."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumns(
        {"file_id": F.lit(1), "score": F.lit("x"), "lines_dropped": F.lit(9).cast("long")})
    odd = [(None, None, None, None, None, 1, None, 9), (-1, "", "en", "src0", 0, 1, "x", 9)]
    odd += [(5, "a few plain words, twice here.", "en", None, 3, 1, "x", 9)] * 2
    docs = docs.unionByName(spark.createDataFrame(odd, DOCS))
    made, kept = [("input", docs)], docs
    for name, stage in cp.STAGES:
        kept = stage(spark, kept, SF_DIR).cache()
        made.append((name, kept))
    return dict(made)


def test_stages_have_the_columns_of_documents(stages):
    for name in ("quality", "lines", "near_copies", "mix"):
        assert stages[name].columns == stages["input"].columns and stages[name].count() > 0
        assert stages[name].filter("not (file_id = 1 and score <=> 'x' and lines_dropped = 9)").count() == 0


def test_quality_keeps_good_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages["quality"].collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert len([i for i in good if i in kept]) >= 0.97 * len(good)
    assert len([i for i, q in labels.items() if q == 0 and i in kept]) <= 2 and -1 not in kept


def test_one_document_of_each_group_stays(stages):
    before = sorted(stages["lines"].collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    _, label = brute([r.text for r in before])
    first = {}
    for r, group in zip(before, label):
        first.setdefault(group, (r.doc_id, r.text))
    assert sorted(((r.doc_id, r.text) for r in stages["near_copies"].collect()), key=str) == sorted(first.values(), key=str)


def test_mix_repeats_rows_as_often_as_the_operator_says(stages):
    docs = stages["near_copies"]
    files = docs.select(F.col("doc_id").alias("file_id"), F.col("source").alias("folder"), "text")
    targets = {r.folder: r.target for r in mixing.mix_files(files).select("folder", "target").distinct().collect()}
    words = lambda t: len((t or "").split())
    taken, largest = {}, max(words(r.text) for r in docs.collect())
    counts = {}
    for r in stages["mix"].collect():
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
        counts[(r.doc_id, r.text)] = counts.get((r.doc_id, r.text), 0) + 1
    assert max(counts.values()) <= 3
    assert all(abs(taken.get(s, 0) - t) <= largest for s, t in targets.items())


def test_pack_holds_every_copy(stages):
    rows = stages["pack"].collect()
    ends = sum(1 for r in rows if r.piece == 0)
    assert ends == stages["mix"].count()
    fills = {}
    for r in rows:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert max(fills.values()) <= 2048 and len(fills) <= sum(fills.values()) / 2048 * 1.02 + 2


def test_run_equals_the_stages_on_plain_documents(spark):
    rows = cp.run(spark, SF_DIR).collect()
    assert rows and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF_DIR)
    key = lambda rs: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rs)
    assert key(docs.collect()) == key(rows)
    assert zlib.crc32(b"\0\0\0\0") not in {r.ids_crc32 for r in rows if r.length > 1}


def test_empty_tables_pass_all_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.count() == 0


def test_the_rest_stands_without_this_part(tmp_path):
    """A copy without these folders and the pipeline still imports and registers its queries."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    copy = f"""
import shutil, sys
shutil.copytree({root!r}, {str(tmp_path / 'repo')!r}, ignore=shutil.ignore_patterns('.git', 'llm', 'corpus_pipeline.py', '__pycache__'))
sys.path.insert(0, {str(tmp_path / 'repo')!r})
import __spark_entry__ as e
names = set(e.queries())
assert 'A18_analyze_orientation' in names and not any(n.startswith('op') or n == 'pipeline' for n in names), names
assert set(e.oracle_sql()) <= names
"""
    subprocess.run([sys.executable, "-c", copy], check=True, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
