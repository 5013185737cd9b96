"""Linked vectors against all pairs, saturated lists, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageflow.llm import near_vectors
from pageflow.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label long, id string"


def brute(rows, similarity=0.9):
    good = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows
            if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = list({(i, tuple(v)): (i, v) for i, v in good}.values())
    x = np.array([v for _, v in good])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= similarity
    np.fill_diagonal(near, False)
    label = np.array([i for i, _ in good])
    while True:
        new = np.minimum(label, [label[row].min() if row.any() else own for row, own in zip(near, label)])
        if (new == label).all():
            break
        label = new
    out = [(i, int(n), int(c)) for (i, _), n, c in zip(good, near.sum(axis=1), label)]
    names = {i for i, _, _ in out}
    return sorted(out + [(i, 0, i) for i in dict.fromkeys(i for i, _ in rows) if i not in names and i is not None])


def rows_of(df):
    return sorted((r.vec_id, r.n_links, r.component_id) for r in df.filter("vec_id is not null").collect())


def crowd(draw, size, spread, n):
    centre = draw.standard_normal(size)
    return (centre + spread * draw.standard_normal((n, size))).tolist()


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(5)
    vectors = draw.standard_normal((400, 8)).tolist() + crowd(draw, 8, 0.02, 150) + crowd(draw, 8, 0.05, 3)
    # Two dense groups whose members link across.
    vectors += crowd(draw, 8, 0.15, 60) + [[1.0] * 8] * 70 + [[2.0] * 8] * 2
    ids = draw.permutation(len(vectors) * 3)[: len(vectors)].tolist()
    rows = list(zip(ids, vectors))
    odd = [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [float("inf")] * 8, [1.0] * 5, []]
    return rows + [(10_000 + i, v) for i, v in enumerate(odd)] + rows[:3] + [(None, [1.0] * 8)]


@pytest.mark.parametrize("k, chunk, crowd_size, block", [(12, 96, 64, 512), (4, 20, 16, 32)])
def test_equals_all_pairs_with_saturated_lists_and_odd_vectors(spark, rows, monkeypatch, k, chunk, crowd_size, block):
    for name, value in (("CHUNK", chunk), ("CROWD", crowd_size), ("BLOCK", block)):
        monkeypatch.setattr(near_vectors, name, value)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    found = near_vectors.link_near_vectors(df.repartition(4), k=k)
    want = brute(rows)
    got = rows_of(found)
    due = sum(n for _, n, _ in want)
    assert [i for i, _, _ in got] == [i for i, _, _ in want]
    assert all(n <= m for (_, n, _), (_, m, _) in zip(got, want))
    assert sum(n for _, n, _ in got) >= 0.97 * due
    assert sum(a == b for a, b in zip(got, want)) >= 0.97 * len(want)
    assert found.filter("kept <> (vec_id <=> component_id)").count() == 0


def test_recall_is_measured_against_all_vectors(spark):
    rows = [(i, v) for i, v in enumerate(crowd(np.random.default_rng(1), 8, 0.01, 40))]
    nodes = spark.createDataFrame(rows, "id long, vec array<float>").withColumn("n", F.lit(1).cast("long"))
    none = spark.createDataFrame([], "id long, label long, links long")
    half = nodes.select("id", F.lit(0).alias("label"), F.when(F.col("id") < 20, 39).otherwise(0).alias("links"))
    assert near_vectors.measured_recall(nodes, none, 8, 0.9) == 0
    assert near_vectors.measured_recall(nodes, half, 8, 0.9) == 0.5
    assert near_vectors.measured_recall(nodes.limit(0), none, 8, 0.9) == 1


def test_an_empty_table(spark):
    assert near_vectors.link_near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_registered_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    found = QUERIES["op12_embedding_near_dedup"](spark, sf).collect()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in table], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    assert {r.vec_id: r.n_links for r in found} == {r.vec_id: int(n) for r, n in zip(table, near.sum(axis=1))}
