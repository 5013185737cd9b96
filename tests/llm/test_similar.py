import random
from itertools import combinations

import numpy as np
import pytest

from pageflow.llm import similar_files as sim


def texts_of(seed, n):
    """Families of edited texts, shared passages and short texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(60)]
    out = []
    while len(out) < n:
        base = [word() for _ in range(rnd.choice([3, 8, 40, 120, 300]))]
        if rnd.random() < 0.4:
            base += passage
        for _ in range(rnd.randint(1, 8)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                copy[rnd.randrange(len(copy))] = word()
            if rnd.random() < 0.3:
                copy = copy[: int(len(copy) * rnd.uniform(0.75, 1)) + 1]
            out.append(" ".join(copy))
    return out[:n]


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common) and label[i] != label[j]:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return [len(s) for s in sets], label


@pytest.mark.parametrize("need", [1, 3, 7, 12])
def test_divide_skip_finds_what_counting_finds(need):
    rnd = random.Random(need)
    lists = [sorted(rnd.sample(range(60), rnd.randint(1, 50))) for _ in range(14)]
    counts = {v: sum(v in x for x in lists) for v in range(60)}
    want = {(v, c) for v, c in counts.items() if c >= need and 5 <= v < 55}
    assert set(sim.divide_skip(lists, need, 5, 55)) == want


def test_leading_parts_of_linked_sets_share_enough():
    rnd = np.random.default_rng(3)
    for _ in range(300):
        n = int(rnd.integers(1, 200))
        x = np.unique(rnd.integers(0, 1 << 62, n, dtype=np.int64))
        y = np.unique(np.concatenate([x[rnd.random(len(x)) < 0.9], rnd.integers(0, 1 << 62, n // 20, dtype=np.int64)]))
        common = len(np.intersect1d(x, y))
        if len(y) and sim.linked(common, len(x), len(y), 80):
            lead = np.intersect1d(x[: sim.leading(len(x))], y[: sim.leading(len(y))])
            assert len(lead) >= min(sim.early(len(x)), sim.early(len(y)))
            assert common >= sim.required(max(len(x), len(y)))


@pytest.mark.parametrize("part_files", [4, 512])
def test_groups_equal_brute_force(spark, monkeypatch, part_files):
    monkeypatch.setattr(sim, "PART_FILES", part_files)
    monkeypatch.setattr(sim, "PART_QUERIES", 3)
    texts = texts_of(5, 220)
    df = spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")
    got = {r.file_id: (r.n_shingles, r.component_id) for r in sim.group_similar(df).collect()}
    sizes, label = brute(texts)
    assert got == {i: (sizes[i], label[i]) for i in range(len(texts))}
    assert len(set(label)) < 200


def test_edges_of_the_contract(spark):
    rows = [
        (5, "one two three", "x"), (3, "ONE two\tthree", None), (9, None, "y"), (8, "", "y"), (None, "a b c d e f", "z"),
        (7, "a b c d e f", "z"), (7, "a b c d e f", "z"), (None, "lonely words", "q"), (1, " \n ", "q"),
    ]
    df = spark.createDataFrame(rows, "file_id long, text string, node string")
    got = sorted(((r.file_id, r.n_shingles, r.component_id) for r in sim.group_similar(df).collect()), key=str)
    assert got == sorted(
        [(5, 1, 3), (3, 1, 3), (9, 0, 9), (8, 0, 8), (None, 2, 7), (7, 2, 7), (7, 2, 7), (None, 1, None), (1, 0, 1)], key=str)
    assert sim.group_similar(df.limit(0)).count() == 0
