"""The vocabulary audit of folders against a plain version, and its edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pageflow.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_files, top):
    counts, files, groups = {}, {}, {}
    for user, folder, text in rows:
        words = [w.translate(LOWER) for w in TERM.findall(text or "")]
        groups.setdefault(user, set()).add(folder)
        counts.setdefault((user, folder), Counter()).update(words)
        files.setdefault(user, Counter()).update(set(words))
    out = []
    for user, folders in groups.items():
        kept = [t for t, n in files[user].items() if n >= min_files]
        v = len(kept)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in kept}

        whole = Counter()
        for f in folders:
            whole.update(counts[user, f])
        q = shares(whole)
        p = {f: shares(counts[user, f]) for f in folders}
        for f in folders:
            pairs = [(str(g) if g is not None else None, sum(abs(p[f][t] - p[g][t]) for t in kept)) for g in folders if g != f]
            terms = [(t, p[f][t] - q[t]) for t in kept if counts[user, f][t] and p[f][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0] is not None, (x[0] or "").encode()))
                out += [(user, f, part, i, x, r + 1) for r, (i, x) in enumerate(items[:limit])]
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.select("user", "folder", "part", "item", "value", "rank").collect()), key=repr)


WORDS = ["Haus", "haus", "état", "a", "b", "c", "x1y", "ß", "É", "don't", "名前", "z" * 50, "tail", "rare"]


@pytest.mark.parametrize("postings", [250_000, 7])
def test_equals_a_plain_version(spark, postings, monkeypatch):
    """Also with blocks of a few postings and scatters of a few entries."""
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(divergence, "SCATTER", 3 if postings == 7 else 1 << 20)
    draw = random.Random(3)
    rows = []
    for _ in range(600):
        user, folder = draw.choice([1, 1, 1, 2, None]), draw.choice([10, 10, 10, 11, 12, None, 13])
        words = draw.choices(WORDS, weights=[folder or 5, 3, 9, 30, 20, 5, 2, 1, 1, 3, 2, 1, 1, 0.05], k=draw.randrange(30))
        rows.append((user, folder, draw.choice([None, " ".join(words), ",".join(words), "\n".join(words)])))
    rows += [(1, 99, ""), (1, 98, None), (5, 1, "only here"), (5, 2, "")] + [(2, 10, "tail " * 9)] * 50
    files = spark.createDataFrame([(*r, "x", 1) for r in rows], "user_id long, folder_id long, text string, term string, slot int")
    found = rows_of(divergence.audit_folders(files.repartition(4), min_files=5, top=4))
    assert found == sorted(brute(rows, 5, 4), key=repr)
    assert {r[3] for r in found if r[0] == 5} == {"1", "2"} and all(r[4] == 0 for r in found if r[0] == 5)


def test_an_empty_table_and_a_lone_folder(spark):
    files = spark.createDataFrame([], "user_id long, folder_id long, text string")
    assert divergence.audit_folders(files).count() == 0
    lone = spark.createDataFrame([(1, 1, "a b")] * 40, "user_id long, folder_id long, text string")
    assert divergence.audit_folders(lone).count() == 0


def test_a_very_long_text_is_counted_whole(spark):
    text = "Wort, " * 900_000 + "ende"
    assert sum(len(w) for w in divergence._words(text.encode())) == 900_001
    long = "x" * (divergence.SLICE_BYTES + 5)
    assert [w for ws in divergence._words(f"a {long} b".encode()) for w in ws] == [b"a", long.encode(), b"b"]


def test_shares_are_exact(spark):
    cases = [(0, 0, 1), (7, 9, 3), (10**12, 3 * 10**12 + 1, 12345), (9 * 10**14, 10**15, 7), (0, 0, 0), (0, 10, 1)]
    df = spark.createDataFrame(cases, "n long, total long, kept long")
    from pyspark.sql import functions as F
    got = [r.p for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("kept")).alias("p")).collect()]
    assert got == [1 + 10**9 * (n + 5) // (t + 5 * v) if v else 0 for n, t, v in cases]


def test_one_row_of_a_block_without_postings():
    block = divergence.Block(np.array([5, 9, 2]), np.zeros(0, dtype=object), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    assert block.row(1).tolist() == [0, 0, 0]
