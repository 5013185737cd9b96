"""The Merkle manifest against a plain version, the log's closed form, and its edge cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pageflow import fixtures as fx
from pageflow.llm import manifest


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes):
    out = [list(nodes)]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([digest(last[i:i + 16]) for i in range(0, len(last), 16)])
    return out


def siblings_of(levels, index):
    out = []
    for nodes in levels[:-1]:
        begin = index // 16 * 16
        run = nodes[begin:begin + 16]
        out.append((index - begin, run[:index - begin] + run[index - begin + 1:]))
        index //= 16
    return out


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute(rows):
    """rows: (folder, file_id, other fields...) -> {row number: (leaf, subroot, root, proof)}."""
    leaves = [digest(written(v) for v in (r[1], r[0], *r[2:])) for r in rows]
    folders = {}
    for i, r in enumerate(rows):
        folders.setdefault(r[0], []).append(i)
    names = sorted(folders, key=lambda f: (f is not None, (f or "").encode()))
    trees = []
    for name in names:
        members = sorted(folders[name], key=lambda i: (rows[i][1] is not None, rows[i][1] or 0, leaves[i]))
        trees.append((members, levels_of([leaves[i] for i in members])))
    top = levels_of([levels[-1][0] for _, levels in trees])
    out = {}
    for t, (members, levels) in enumerate(trees):
        for k, i in enumerate(members):
            out[i] = (leaves[i], levels[-1][0], top[-1][0], siblings_of(levels, k) + siblings_of(top, t))
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "folder string, file_id long, text string, tree string")
    fields = ("file_id", "folder", "text", "tree")
    return manifest.prove_files(df.repartition(5), fields, folder="folder", **more).collect()


def test_equals_a_plain_version_with_a_hot_folder_nulls_repeats_and_clashing_names(spark):
    draw = random.Random(7)
    rows = [("hot", i, "t" * draw.randrange(5), "x") for i in range(4500)]
    rows += [(draw.choice(["a", "é", "Z", "", None]), draw.choice([None, i]), draw.choice([None, "", "Grüße"]), None) for i in range(400)]
    rows += [("lone", 1, "x" * 300_000, None)] + [("hot", 7, "again", "y")] * 40
    rows += [(f"f{i}", i, None, None) for i in range(300)]
    expected = brute([(f, i, t, x) for f, i, t, x in rows])
    found = run(spark, rows)
    flat = lambda leaf, sub, root, proof: (leaf, sub, root, tuple((s, tuple(x)) for s, x in proof))
    want = sorted(flat(*v) for v in expected.values())
    got = sorted(flat(r.leaf, r.subroot, r.root, [(s.slot, s.siblings) for s in r.proof]) for r in found)
    assert got == want
    assert all(r.verified and r.folded_root == r.root and r.current_leaf == r.leaf for r in found)


def test_changed_files_are_found_and_nothing_else(spark):
    rows = [("a", i, "Text" if i % 2 else "text", None) for i in range(300)]
    found = run(spark, rows, current={"text": F.lower("text")})
    assert all(r.verified == (r.file_id % 2 == 0) for r in found)
    gone = run(spark, rows, current={"text": F.when(F.col("file_id") == 5, None).otherwise(F.col("text"))})
    assert [r.file_id for r in gone if not r.verified] == [5]


@pytest.mark.parametrize("leaves", [1, 2, 15, 16, 17, 255, 256, 257, 4096, 4097, 5000])
def test_positions_are_the_order_of_completion(leaves):
    top = manifest.height(leaves)
    log = manifest.append_nodes([str(i) for i in range(leaves)], top)
    levels = levels_of([str(i) for i in range(leaves)])
    assert len(levels) == top + 1 and len(log) == sum(map(len, levels))
    for level, nodes in enumerate(levels):
        assert [log[manifest.position(level, i, leaves, top)] for i in range(len(nodes))] == nodes


def test_blocks_of_all_rounds_make_one_gapless_postorder_log(spark):
    leaves = spark.range(5000).select(
        F.lit(3).cast("long").alias("tree"), F.lit(5000).cast("long").alias("nodes"), F.col("id").alias("place"),
        F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    rounds = manifest.write_log(leaves, [])
    rows = manifest.log_nodes(rounds).orderBy("position").collect()
    plain = manifest.append_nodes([digest([str(i)]) for i in range(5000)], manifest.height(5000))
    assert [r.position for r in rows] == list(range(len(plain)))
    assert [r.digest for r in rows] == plain
    assert manifest.tree_roots(rounds).first().digest == plain[-1]


def test_runs_on_the_library_files(spark):
    files = fx.file_table(fx.Tables(spark, "/root/testdata/sf0.001"))
    found = manifest.prove_files(files, current={"filename": F.when(F.col("file_id") == 7, "other.pdf").otherwise(F.col("filename"))})
    rows = found.select("file_id", "folder", "verified", "root").collect()
    assert len(rows) == files.count() and len({r.root for r in rows}) == 1
    assert [r.file_id for r in rows if not r.verified] == [7]
    assert any(r.folder is None for r in rows)


def test_an_empty_table_gives_no_rows(spark):
    assert run(spark, []) == []
