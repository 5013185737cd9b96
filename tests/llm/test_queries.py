"""The registered queries without an oracle, as they stand, against plain versions on the smallest tables."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry_points
from pageflow.llm import neighbours
from pageflow.llm.queries import tokenizer_path

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry_points.queries()


def rows_of(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SF_DIR).collect()]


@pytest.fixture(scope="module")
def texts():
    documents = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return {i: t or "" for i, t in zip(documents["doc_id"], documents["text"])}


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    found = [(m.start(), i, kind, m.end()) for i, (kind, pattern, good) in enumerate(kinds)
             for m in re.finditer(pattern, text) if good(m.group())]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def test_op1_base_spans_and_digests(spark, texts):
    got = {r["doc_id"]: r for r in rows_of(spark, "op1_personal_data")}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        spans = [":".join(map(str, s)) for s in plain_spans(text)]
        assert got[doc]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        for kind in ("email", "ip", "card", "phone"):
            assert got[doc][f"n_{kind}"] == sum(s.startswith(kind) for s in spans)
        assert set(spans) <= set(got[doc]["spans"].split(",")) | ({""} if not spans else set())


def test_op4_neighbours_are_exact_and_mostly_found(spark):
    table = pq.read_table("/root/testdata/sf0.01/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict()
    vectors = {i: np.asarray(v, dtype=np.float64) for i, v in zip(table["vec_id"], table["embedding"])
               if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    got = {}
    for r in QUERIES["op4_nearest_neighbours"](spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    asked = [i for i in vectors if i % 100 == 0]
    assert got.keys() == set(asked)
    hits = 0
    for q in asked:
        found = sorted(got[q])
        assert [r for r, *_ in found] == list(range(1, 11))
        dist = {i: math.sqrt(((v - vectors[q]) ** 2).sum()) for i, v in vectors.items() if i != q}
        assert all(dist[i] == pytest.approx(s, rel=1e-12) for _, i, s in found)
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(sorted(dist, key=lambda i: (dist[i], i))[:10]))
    assert hits >= 0.9 * 10 * len(asked)


def test_settings_follow_the_table(spark):
    """Vectors in clusters need less looking than the same number without any."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    looked = []
    for points in (centres[np.arange(1200) % 40] + 0.02 * rng.normal(size=(1200, 16)), rng.normal(size=(1200, 16))):
        df = spark.createDataFrame([(p.tolist(),) for p in points], "vec array<double>")
        tables, width, probes = neighbours.fit_settings(df, 16, 4.0, 10)
        hashing = neighbours.Tables(16, width, tables, neighbours.HASHES)
        looked.append(sum(np.isin(hashing.cells(points, t), hashing.probes(points[:1], t, probes)[0]).sum() for t in range(tables)))
    assert looked[0] < looked[1] / 3


def test_double_components_keep_their_digits(spark):
    rows = [(i, [1.0, 1e-12 * i]) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest_vectors(df, df.filter("vec_id = 1"), k=2).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [2, 3] and got[0].score == math.sqrt((2e-12 - 1e-12) ** 2)


def test_op6_counts_equal_the_library(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in rows_of(spark, "op6_token_counts")}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        n = len(model.encode(text))
        assert (got[doc]["n_bytes"], got[doc]["n_tokens"], got[doc]["over_limit"]) == (len(text.encode()), n, n > 4096)


def test_op8_scores_rank_the_held_out_labels(spark):
    got = {r.doc_id: r for r in QUERIES["op8_line_quality"](spark, "/root/testdata/sf0.01").collect()}
    labels = dict(duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet' WHERE quality IS NOT NULL").fetchall())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for d, r in got.items())
    good = [got[d].score for d, q in labels.items() if got[d].held_out and q == 1]
    bad = [got[d].score for d, q in labels.items() if got[d].held_out and q == 0]
    ahead = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert ahead >= 0.97


def test_op9_pieces_hold_the_tokenizers_ids(spark, texts):
    import tokenizers

    model = tokenizers.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = rows_of(spark, "op9_best_fit_packing")
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == texts.keys()
    for doc, text in texts.items():
        ids = np.array(model.encode(text, add_special_tokens=False).ids + [0], dtype="<u4")
        cut = [ids[a : a + 2048] for a in range(0, len(ids), 2048)]
        want = [(i, 2048 * i, len(c), zlib.crc32(c.tobytes())) for i, c in enumerate(cut)]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[doc]) == want
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert least <= len(bins) <= 1.05 * least + 1
