"""Mixing, packing, vectors and archives on small tables, held against plain versions."""

import hashlib
import zlib
from base64 import b32encode
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageflow.llm import archive, mixing, neighbours, packing
from pageflow.llm.components import components
from pageflow.llm.queries import tokenizer_path
from pageflow.llm.scratch import scratch_path
from tests.llm.conftest import files


# ---- mixing ----------------------------------------------------------------------------

def plain_targets(sizes):
    """Shares by weight, the excess over three times a size shared again, until none is above."""
    names = sorted([n for n in sizes if n is not None]) + [n for n in sizes if n is None]
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    left, fixed = float(sum(sizes.values())), {}
    while True:
        open_ = [n for n in names if n not in fixed]
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = [n for n in open_ if share[n] > 3 * sizes[n]]
        if not over:
            return fixed | share
        for n in over:
            fixed[n] = 3.0 * sizes[n]
            left -= fixed[n]


def test_targets_equal_repeated_sharing(spark, rnd):
    for _ in range(5):
        sizes = {rnd.choice([None, *"abcdefgh", "é", "Z"]): rnd.choice([0, 1, 30, 500, 10_000]) for _ in range(7)}
        df = spark.createDataFrame([(n, s) for n, s in sizes.items()], "folder string, size long")
        got = {r.folder: r.target for r in mixing.folder_targets(df).collect()}
        want = plain_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
        assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n], rel=1e-12, abs=1e-9) for n in want)


def test_mix_comes_near_its_targets_and_is_repeatable(spark, rnd):
    rows = [(i, rnd.choice(["a", "a", "a", "b", "c", None]), "w " * rnd.randrange(1, 40)) for i in range(3000)]
    rows += [(5000, "a", None), (5001, "zz", ""), (None, "b", "x y"), (7, "b", "again")]
    table = files(spark, rows)
    key = lambda d: sorted((r.file_id or -1, r.folder or "", r.size, r.target, r.copies, r.taken) for r in d.collect())
    mixed = mixing.mix_files(table).cache()
    assert key(mixed) == key(mixing.mix_files(table.repartition(5)))
    assert mixed.count() == len(rows) and mixed.filter("taken > 3 * size or copies > 3 or taken <> copies * size").count() == 0
    for r in mixed.groupBy("folder").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("folder_size").alias("size")).collect():
        assert abs(r.taken - r.target) <= 40 and r.target <= 3 * r.size
    assert mixing.mix_files(table.limit(0)).count() == 0


def test_certain_copies_and_equal_rows(spark):
    rows = [(i, "big", "w " * 100) for i in range(50)] + [(100 + i, "small", "w " * 10) for i in range(5)] + [(1, "big", "w " * 100)] * 4
    mixed = mixing.mix_files(files(spark, rows)).collect()
    small = [r for r in mixed if r.folder == "small"]
    assert all(r.copies == 3 and r.target == 150 for r in small)
    big = [r for r in mixed if r.folder == "big"]
    assert abs(sum(r.taken for r in big) - big[0].target) <= 100


# ---- packing ---------------------------------------------------------------------------

def test_encoder_gives_the_ids_of_whole_texts(rnd):
    encode = packing.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    pieces = ["The", "quick", "don't", "it's,", "ÉCOLE", "straße", "ΑΣ", "İstanbul", "áb", "́", "x1y2", "3.14", "!!", "a|b", "<|endoftext|>",
              "<|startoftext|>a", " ", " ", "\t", "\n", "\r\n", "  ", "한국어", "𝒳", "...end", "ſ", "ﬁ", "word.", "word,", "Word", "-", "é,"]
    texts = ["".join(rnd.choice(pieces) + rnd.choice(["", " ", " ", "\n"]) for _ in range(rnd.randrange(0, 30))) for _ in range(1500)] + ["", " ", "word " * 500]
    want = encode.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    for store in (packing.CACHE_WORDS, 50):
        packing.CACHE_WORDS, before = store, packing.CACHE_WORDS
        for start in range(0, len(texts), 128):
            for e, got in zip(want[start : start + 128], encode(texts[start : start + 128])):
                assert np.array(e.ids, dtype="<u4").tobytes() == got
        packing.CACHE_WORDS = before


def test_words_with_marks_are_encoded_in_lines_once(monkeypatch):
    encode, alone = packing.WordEncoder(tokenizer_path("word_bpe_49k.json")), []
    one_by_one = encode._one_by_one
    monkeypatch.setattr(encode, "_one_by_one", lambda words: alone.extend(words) or one_by_one(words))
    texts = [" ".join(w + marks for w in ["Alpha", "École", "straße", ""]) for marks in ["", "***", "?!", "...", "'", "|", "\"),"]]
    texts += ["don't don't", "don't 3.14"]
    want = encode.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    for _ in range(2):
        assert encode(texts) == [np.array(e.ids, dtype="<u4").tobytes() for e in want]
    assert sorted(alone) == ["3.14", "don't"]
    assert encode([]) == [] and encode(["", " "]) == [b"", b""]


def test_known_words_do_not_age_the_cache(monkeypatch):
    encode, encoded = packing.WordEncoder(tokenizer_path("word_bpe_49k.json")), []
    by_lines = encode._by_lines
    monkeypatch.setattr(encode, "_by_lines", lambda parts: encoded.extend(parts) or by_lines(parts))
    monkeypatch.setattr(packing, "CACHE_WORDS", 100)
    words = [a + b for a in "abcdefgh" for b in "klmnopqrs"]
    for _ in range(5):
        encode([" ".join(words)])
    assert sorted(encoded) == words


def test_ids_are_gathered_over_several_rounds():
    encode = packing.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    text = "alpha beta, don't " * 200_000
    ids, bounds = encode.flat(packing.pa.array([text, "", text]), end=b"\0\0\0\0")
    line = encode.tokenizer.encode("alpha beta, don't", add_special_tokens=False).ids
    assert bounds.tolist() == [0, len(line) * 200_000 + 1, len(line) * 200_000 + 2, len(line) * 400_000 + 3]
    assert ids.tolist() == (line * 200_000 + [0]) + [0] + (line * 200_000 + [0])


def test_texts_are_taken_in_slices_of_bounded_size():
    sizes = [3, 0, 4, 50, 1, 1, 8, 2, 0]
    slices = list(packing.text_slices(packing.pa.array(["x" * n for n in sizes] + [None]), 10))
    assert [row for first, n in slices for row in range(first, first + n)] == list(range(10))
    assert all(sum(sizes[a + 1 : a + n]) < 10 for a, n in slices)
    assert len(slices) < 6


def test_best_fit_takes_the_fullest_bin_that_fits(rnd):
    sizes = sorted((rnd.randrange(1, 100) for _ in range(300)), reverse=True)
    bins, fills = [], []
    for i, s in enumerate(sizes):
        fit = [b for b in range(len(bins)) if fills[b] + s <= 100]
        if fit:
            b = max(fit, key=lambda k: fills[k])
        else:
            b = len(bins)
            bins.append([])
            fills.append(0)
        bins[b].append(i)
        fills[b] += s
    got = packing.best_fit(sizes, 100)
    assert sorted(sum(sizes[i] for i in b) for b in got) == sorted(fills)


def test_search_only_gains_and_empties_bins(rnd):
    fewer = 0
    for trial in range(60):
        cap = 100
        sizes = sorted((rnd.choice([rnd.randrange(1, 100), rnd.randrange(24, 50)]) for _ in range(rnd.randrange(1, 150))), reverse=True)
        start = packing.best_fit(sizes, cap) if trial % 2 else [[i] for i in range(len(sizes))]
        squares = lambda bins: sum(sum(sizes[i] for i in b) ** 2 for b in bins)
        search = packing.LocalSearch(sizes, [list(b) for b in start], cap)
        bins = search.run()
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= cap for b in bins)
        assert squares(bins) >= squares(start) and len(bins) <= len(start)
        fewer += len(bins) < len(start)
    assert fewer > 20


def test_a_two_for_one_exchange_empties_a_bin():
    # 60 + 30, 40 + 30 and 20 + 20: exchanging 30 for 40 fills one bin and makes room in the other.
    sizes = [60, 40, 30, 30, 20, 20]
    assert len(packing.LocalSearch(sizes, [[0, 2], [1, 3], [4, 5]], 100).run()) == 2


def check_packed(rows, texts, capacity):
    tokenizer = packing.WordEncoder(tokenizer_path("word_bpe_49k.json")).tokenizer
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.file_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(p.piece, p.start, p.length, p.ids_crc32) for p in pieces] == [
            (k, k * capacity, len(ids[k * capacity : (k + 1) * capacity]), zlib.crc32(ids[k * capacity : (k + 1) * capacity].tobytes()))
            for k in range(-(-len(ids) // capacity))]
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity


def test_packed_files_are_whole(spark, rnd):
    texts = {i: " ".join(rnd.choice(["alpha", "Beta,", "gamma3", "naïve"]) for _ in range(rnd.choice([0, 1, 30, 90, 200, 700]))) for i in range(200)}
    texts |= {500: None, 501: ""}
    table = files(spark, [(i, "f", t) for i, t in texts.items()])
    rows = packing.pack_files(table, tokenizer_path("word_bpe_49k.json"), capacity=128).collect()
    check_packed(rows, texts, 128)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= total / 128 * 1.03 + 1
    assert packing.pack_files(table.limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_blocks_bound_what_a_task_packs(spark):
    same = spark.createDataFrame([(1, 0, 0, 10, 5)] * 900, "file_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack_pieces(same, capacity=64, block_pieces=100).collect()
    per_block = {}
    for r in rows:
        per_block[r.sequence_id >> 32] = per_block.get(r.sequence_id >> 32, 0) + 1
    assert len(rows) == 900 and len(per_block) > 5 and max(per_block.values()) < 200


# ---- vectors ---------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, ids long, table string"


def brute(vectors, queries, k):
    out = {}
    for q in queries:
        best = {}
        for v in vectors:
            if v[0] != q[0]:
                d = float(np.sqrt(((np.array(v[1], dtype=np.float32).astype(float) - np.array(q[1], dtype=np.float32).astype(float)) ** 2).sum()))
                best[v[0]] = min(d, best.get(v[0], d))
        out[q[0]] = sorted((d, i) for i, d in best.items())[:k]
    return out


def test_neighbours_are_exact_where_found_and_mostly_found(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=16)).tolist(), 1, "t") for i in range(1500)]
    df = spark.createDataFrame(rows, VECTORS)
    queries = df.filter("vec_id % 50 = 0")
    got = {}
    for r in neighbours.nearest_vectors(df, queries).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = brute(rows, [r for r in rows if r[0] % 50 == 0], 10)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        assert [r for r, *_ in sorted(found)] == list(range(1, 11))
        by_id = dict((i, d) for d, i in brute(rows, [rows[q]], 1500)[q])
        assert all(by_id[i] == pytest.approx(s, rel=1e-12) for _, s, i in found)
        hits += len({i for *_, i in found} & {i for _, i in want[q]})
    assert hits >= 0.9 * 10 * len(want)


def test_copies_few_vectors_and_odd_vectors(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(i, one, 1, "t") for i in range(40)] + [(3, one, 1, "t"), (100, [0.0, 5.0, 0.0], 1, "t"), (101, [-0.5, 9.0, 2.0], 1, "t")]
    odd = [(200, None, 1, "t"), (201, [0.0, 0.0, 0.0], 1, "t"), (202, [1.0, float("nan"), 0.0], 1, "t"), (203, [1.0, None, 0.0], 1, "t"),
           (204, [float("inf"), 0.0, 0.0], 1, "t"), (205, [1.0, 2.0], 1, "t"), (None, one, 1, "t")]
    df = spark.createDataFrame(rows + odd, VECTORS)
    got = neighbours.nearest_vectors(df, df.filter("vec_id in (0, 39, 100, 201, 205) or vec_id is null"), k=10)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: [v for _, v in sorted(x)] for q, x in found.items()} == {
        0: list(range(1, 11)), 39: list(range(10)), 100: [101, *range(9)]}
    few = spark.createDataFrame([(1, one, 1, "t"), (2, [0.0, 90.0, 0.0], 1, "t"), (3, [0.0, 0.0, -70.0], 1, "t")], VECTORS)
    assert {(r.query_id, r.vec_id) for r in neighbours.nearest_vectors(few, few).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}
    assert neighbours.nearest_vectors(df.limit(0), df.limit(0)).count() == 0


def test_a_full_cell_is_split_and_still_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_VECTORS", 8)
    rng = np.random.default_rng(5)
    rows = [(i, (np.ones(8) + 0.01 * rng.normal(size=8)).tolist(), 1, "t") for i in range(300)]
    df = spark.createDataFrame(rows, VECTORS)
    got = neighbours.nearest_vectors(df, df.filter("vec_id = 7")).orderBy("rank").collect()
    assert [(r.vec_id) for r in got] == [i for _, i in brute(rows, [rows[7]], 10)[7]]


# ---- archives --------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, refers_to long, value string"


def test_archives_round_trip(spark):
    odd = "head\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "ünï𝒳\x00"
    texts = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, None, "same"), (3, "u\r\nX: y", odd), (4, "http://a/4", None), (6, "http://a/6", ""),
             (None, "http://a/n", "same"), (9, None, "same"), (-5, "x", "long " * 50_000)]
    df = spark.createDataFrame([(*t, 1, "v") for t in texts], PAGES)
    path = scratch_path(spark, "warc")
    archive.write_archives(df, path, file_bytes=60_000, written_at=datetime(2026, 1, 2))
    records = archive.read_archives(spark, path).cache()
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in records.collect()), key=str)
    want = []
    for i, _, html in texts:
        raw = (html or "").encode()
        refers = {1: 9, 2: 9, 4: 6}.get(i)
        want.append((i, "revisit" if refers else "response", refers, len(raw), b32encode(hashlib.sha1(raw).digest()).decode()))
    assert got == sorted(want, key=str)
    back = sorted(((r.page_id, r.html) for r in archive.restore_payloads(records).collect()), key=str)
    assert back == sorted([(i, t or "") for i, _, t in texts], key=str)
    assert {r.page_id: r.url for r in records.collect()}[3] == "u  X: y"
    small = scratch_path(spark, "warc")
    archive.write_archives(df, small, min_bytes=5)
    assert archive.read_archives(spark, small).filter("record_type = 'revisit'").count() == 0
    empty = scratch_path(spark, "warc")
    archive.write_archives(df.limit(0), empty)
    assert archive.read_archives(spark, empty).count() == 0


# ---- components ------------------------------------------------------------------------

def test_components_of_chains_and_stars(spark, rnd):
    edges = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(500, 500 + i) for i in range(1, 50)] + [(7, 7)] + [(30, 25)] * 3
    rnd.shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: i // 20 * 20 for i in range(60)}, **{500 + i: 500 for i in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def exchanges(sizes, bins, capacity):
    """Every allowed exchange between two underfull bins that raises the sum of squares."""
    from itertools import combinations

    some = lambda b, most: [()] + [c for k in range(1, most + 1) for c in combinations(b, k)]
    weight = lambda items: sum(sizes[i] for i in items)
    for j, receiver in enumerate(bins):
        for i, donor in enumerate(bins):
            if i == j or weight(receiver) == capacity or weight(donor) == capacity:
                continue
            for taken in some(donor, 2)[1:]:
                for given in some(receiver, 2 if len(taken) == 1 else 1):
                    d = weight(taken) - weight(given)
                    if d > 0 and weight(receiver) + d <= capacity and weight(receiver) + d > weight(donor):
                        yield j, i, taken, given


def test_the_search_ends_in_a_local_optimum(rnd):
    for capacity in (40, 400):
        for _ in range(25):
            sizes = [rnd.randrange(1, capacity * 2 // 3) if rnd.random() < 0.5 else rnd.randrange(1, 12) for _ in range(rnd.randrange(1, 45))]
            # Any start will do: bins in the order of arrival.
            start, room = [], 0
            for i, size in enumerate(sizes):
                if size > room:
                    start.append([])
                    room = capacity
                start[-1].append(i)
                room -= size
            bins = packing.LocalSearch(sizes, start, capacity).run()
            assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
            assert all(sum(sizes[i] for i in b) <= capacity for b in bins)
            assert next(exchanges(sizes, bins, capacity), None) is None
