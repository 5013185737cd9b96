"""Merkle manifest of library files: which folder holds which files, and proof of each of them.

A file's record is a leaf, a folder's leaves form a tree of runs of 16, and the folders' roots
form one tree more. Nodes go to a postorder log: a node is appended when its last child is
complete. Builders work on aligned blocks of 256 nodes each, all at once, so the blocks of a
folder that holds a third of all files spread over all tasks; their roots are the leaves of the
next round. Where a node stands in a log follows from the sizes of the subtrees before it
(:func:`position`), so a proof picks its siblings by place and nothing is searched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pageflow.llm.scratch import stored

RUN = 16
LEVELS = 2
BLOCK = RUN**LEVELS
FILE_FIELDS = ("file_id", "folder_id", "user_id", "filename", "file_path", "created_at")
STEPS = "array<struct<slot:int,siblings:array<string>>>"
ARROW_STEPS = pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.list_(pa.string()))]))


# ---- the shape of a tree ---------------------------------------------------------------

def join_digests(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def width(leaves: int, level: int) -> int:
    """Nodes of a level."""
    return -(-leaves // RUN**level)


def height(leaves: int) -> int:
    """Levels above the leaves until one node remains."""
    level = 0
    while width(leaves, level) > 1:
        level += 1
    return level


def position(level: int, index: int, leaves: int, top: int) -> int:
    """Place from 0 of node ``index`` of ``level`` in the log of ``leaves`` leaves under ``top`` levels.

    Before it stand: of each lower level all nodes that begin before its last leaf ends, of its
    own level those with a smaller index, of each higher level those that end where it begins.
    """
    begin, end = index * RUN**level, min((index + 1) * RUN**level, leaves)
    lower = sum(width(end, below) for below in range(level))
    higher = sum(begin // RUN**above for above in range(level + 1, top + 1))
    return lower + index + higher


def append_nodes(leaves: list[str], top: int) -> list[str]:
    """The log of one block: every node in the order in which it is complete."""
    log: list[str] = []
    waiting: list[list[str]] = [[] for _ in range(top + 1)]
    for i, leaf in enumerate(leaves):
        log.append(leaf)
        waiting[0].append(leaf)
        level, last = 0, i == len(leaves) - 1
        while level < top and (last or len(waiting[level]) == RUN):
            parent = join_digests(waiting[level])
            waiting[level].clear()
            log.append(parent)
            level += 1
            waiting[level].append(parent)
    return log


def steps_of(log: list[str], leaves: int, top: int) -> list[list[dict]]:
    """For every leaf of a block: per level, its slot in the run and the run's other digests."""
    paths: list[list[dict]] = [[] for _ in range(leaves)]
    for level in range(top):
        nodes = width(leaves, level)
        for begin in range(0, nodes, RUN):
            run = [log[position(level, j, leaves, top)] for j in range(begin, min(begin + RUN, nodes))]
            for slot in range(len(run)):
                step = {"slot": slot, "siblings": run[:slot] + run[slot + 1:]}
                first = (begin + slot) * RUN**level
                for leaf in range(first, min(first + RUN**level, leaves)):
                    paths[leaf].append(step)
    return paths


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``proof`` lead to."""
    def up(below: Column, step: Column) -> Column:
        siblings, slot = step["siblings"], step["slot"]
        before, after = F.slice(siblings, F.lit(1), slot), F.slice(siblings, slot + 1, F.size(siblings))
        return F.sha2(F.concat(F.array_join(before, ""), below, F.array_join(after, "")), 256)

    return F.aggregate(proof, leaf, up)


# ---- leaves ----------------------------------------------------------------------------

def _written(value: Column, kind: T.DataType) -> Column:
    text = F.unix_micros(value).cast("string") if isinstance(kind, T.TimestampType) else value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def file_leaves(files: DataFrame, fields: tuple[str, ...], folder: str, file_id: str, current: dict[str, Column]) -> DataFrame:
    """``folder, file_id, leaf, now``: ``now`` is the leaf of the ``current`` values where they differ."""
    kinds = {f.name: f.dataType for f in files.schema.fields}
    sealed = {c: F.col(f"`{c}`") for c in fields}
    leaf = lambda values: F.sha2(F.concat(*[_written(v, kinds[c]) for c, v in values.items()]), 256)
    same = F.lit(True)
    for c, value in current.items():
        same = same & sealed[c].eqNullSafe(value)
    return files.select(
        F.col(f"`{folder}`").alias("folder"), F.col(f"`{file_id}`").alias("file_id"), leaf(sealed).alias("leaf"),
        F.when(~same, leaf(sealed | current)).alias("now"),
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``place``, the running number in the partition."""
    begin = 0
    for batch in batches:
        place = pa.array(np.arange(begin, begin + batch.num_rows))
        begin += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, place], names=[*batch.schema.names, "place"])


def _in_trees(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves as ``tree, nodes, place`` and one row per tree: ``tree, nodes, folder``.

    Rows are range partitioned by folder and id, ties by digest and row, so a hot folder spans
    partitions; only row counts per partition and folder are windowed. A tree's number is its
    folder's place in order, null first.
    """
    unique = stored(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    order = ["folder", "file_id", "leaf", "row"]
    cut = unique.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = T.StructType([*cut.schema.fields, T.StructField("place", T.LongType())])
    rows = stored(cut.mapInArrow(_numbered, schema).drop("row"), "leaves")
    held = stored(rows.groupBy("part", "folder").agg(F.count("*").alias("rows"), F.min("place").alias("begin")), "folders")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = held.groupBy("part").agg(F.sum("rows").alias("rows")).select(
        "part", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("before"))
    spans = held.join(parts, "part").withColumn("begin", F.col("before") + F.col("begin"))
    folders = spans.groupBy("folder").agg(
        F.min("begin").alias("first"), F.sum("rows").alias("nodes"), F.min("part").alias("home"))
    homes = folders.groupBy("home").agg(F.count("*").alias("n")).select(
        "home", F.coalesce(F.sum("n").over(Window.orderBy("home").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("home").orderBy("first")) - 1
    trees = stored(
        folders.join(homes, "home").select("folder", "first", "nodes", (F.col("before") + inside).alias("tree")), "trees")
    known = spans.alias("s").join(trees.alias("t"), F.col("s.folder").eqNullSafe(F.col("t.folder"))).select(
        "part", "s.folder", (F.col("before") - F.col("first")).alias("shift"), "tree", "nodes")
    r, k = rows.alias("r"), known.alias("k")
    placed = r.join(k, (F.col("r.part") == F.col("k.part")) & F.col("r.folder").eqNullSafe(F.col("k.folder"))).select(
        "tree", "nodes", (F.col("shift") + F.col("place")).alias("place"), F.col("leaf").alias("digest"), "file_id", "now")
    return placed, trees.select("tree", "nodes", "folder")


# ---- the log ---------------------------------------------------------------------------

def _append(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """One builder per aligned block: ``tree, nodes, block, log`` and arrays of what the nodes carry."""
    block = F.floor(F.col("place") / BLOCK).cast("long")
    member = F.struct("place", "digest", *carried)
    blocks = nodes.groupBy("tree", "nodes", block.alias("block")).agg(F.sort_array(F.collect_list(member)).alias("m"))
    flat = blocks.select("tree", "nodes", "block", F.col("m.digest").alias("log"), *[F.col(f"m.{c}").alias(c) for c in carried])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [min(LEVELS, height(n)) for n in batch.column("nodes").to_pylist()]
            logs = [append_nodes(leaves, top) for leaves, top in zip(batch.column("log").to_pylist(), tops)]
            at = batch.schema.get_field_index("log")
            yield batch.set_column(at, "log", pa.array(logs, pa.list_(pa.string())))

    return flat.mapInArrow(build, flat.schema)


def write_log(leaves: DataFrame, carried: list[str]) -> list[DataFrame]:
    """Round by round the blocks of all trees: round 0 over the leaves, each next one over the
    block roots of trees that have more than one. A round has a 256th of the nodes."""
    rounds = [stored(_append(leaves, carried), "log")]
    while rounds[-1].filter(F.col("nodes") > BLOCK).limit(1).count():
        last = rounds[-1].filter(F.col("nodes") > BLOCK)
        roots = last.select(
            "tree", F.ceil(F.col("nodes") / BLOCK).cast("long").alias("nodes"), F.col("block").alias("place"),
            F.element_at("log", -1).alias("digest"))
        rounds.append(stored(_append(roots, []), "log"))
    return rounds


def tree_roots(rounds: list[DataFrame]) -> DataFrame:
    """``tree, digest``: the last entry of the one block in which a tree ends."""
    roots = None
    for blocks in rounds:
        done = blocks.filter(F.col("nodes") <= BLOCK).select("tree", F.element_at("log", -1).alias("digest"))
        roots = done if roots is None else roots.unionByName(done)
    return roots


def log_nodes(rounds: list[DataFrame]) -> DataFrame:
    """``tree, position, digest`` of every node: a tree's whole log in the order of ``position``."""
    sizes = rounds[0].groupBy("tree").agg(F.max("nodes").alias("leaves"))
    out = None
    for number, blocks in enumerate(rounds):
        base = number * LEVELS

        def place(batches: Iterator[pa.RecordBatch], base=base) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                trees, places, digests = [], [], []
                for row in batch.to_pylist():
                    top, begin = min(LEVELS, height(row["nodes"])), row["block"] * BLOCK
                    own = min(BLOCK, row["nodes"] - begin)
                    # The leaves of a later round are the block roots of the one before.
                    for level in range(1 if base else 0, top + 1):
                        for j in range(width(own, level)):
                            trees.append(row["tree"])
                            places.append(position(base + level, begin // RUN**level + j, row["leaves"], height(row["leaves"])))
                            digests.append(row["log"][position(level, j, own, top)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(trees, pa.int64()), pa.array(places, pa.int64()), pa.array(digests, pa.string())],
                    names=["tree", "position", "digest"])

        part = blocks.join(sizes, "tree").select("tree", "nodes", "block", "log", "leaves").mapInArrow(
            place, "tree long, position long, digest string")
        out = part if out is None else out.unionByName(part)
    return out


# ---- proofs ----------------------------------------------------------------------------

def _prove(blocks: DataFrame, above: DataFrame, carried: list[str], extra: list[str]) -> DataFrame:
    """Each node of ``blocks`` with its steps inside the block and those above it.

    ``above`` has one row per ``tree, block``. A block is one row on either side of the join.
    """
    joined = blocks.join(above, ["tree", "block"])
    kinds = {f.name: f.dataType for f in joined.schema.fields}
    schema = T.StructType(
        [T.StructField("tree", T.LongType()), T.StructField("block", T.LongType()), T.StructField("digest", T.StringType())]
        + [T.StructField(c, kinds[c].elementType) for c in carried] + [T.StructField(c, kinds[c]) for c in extra]
        + [T.StructField("above", T.DataType.fromDDL(STEPS))])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                nodes, block, log, rest = (row.column(c)[0].as_py() for c in ("nodes", "block", "log", "above"))
                own, top = min(BLOCK, nodes - block * BLOCK), min(LEVELS, height(nodes))
                again = pa.array(np.zeros(own, dtype=np.int64))
                proofs = [inside + rest for inside in steps_of(log, own, top)]
                leaves = [log[position(0, j, own, top)] for j in range(own)]
                yield pa.RecordBatch.from_arrays(
                    [row.column("tree").take(again), pa.array(np.arange(own) + block * BLOCK), pa.array(leaves, pa.string()),
                     *[row.column(c).flatten() for c in carried], *[row.column(c).take(again) for c in extra],
                     pa.array(proofs, ARROW_STEPS)],
                    names=schema.fieldNames())

    return joined.select("tree", "nodes", "block", "log", *carried, *extra, "above").mapInArrow(extract, schema)


def _proofs(rounds: list[DataFrame], roots: DataFrame, carried: list[str], extra: list[str]) -> DataFrame:
    """Proofs of all leaves, from the last round down. ``roots``: ``tree, nodes, above`` and ``extra``."""
    above = None
    for number in range(len(rounds) - 1, -1, -1):
        # A tree begins in the round in which it fits one block; in larger ones it was met above.
        begin = roots.filter(F.col("nodes") <= BLOCK ** (number + 1)).select("tree", F.lit(0).cast("long").alias("block"), *extra, "above")
        above = begin if above is None else begin.unionByName(above.select("tree", "block", *extra, "above"))
        above = _prove(rounds[number], above, carried if number == 0 else [], extra)
        if number:
            above = stored(above, "paths")
    return above


def prove_files(
    files: DataFrame, fields: tuple[str, ...] = FILE_FIELDS, folder: str = "folder_id", file_id: str = "file_id",
    current: dict[str, Column] | None = None,
) -> DataFrame:
    """Manifest of ``files`` and the audit of every file against it, one row a file.

    A leaf is the SHA-256 of the file's ``fields``, each ``-`` if null, else its length in bytes,
    ``:`` and the value (numbers in decimal, times in whole microseconds). In a folder leaves
    ascend by ``file_id``; 16 consecutive digests become one, level by level, until the folder's
    root remains; the folders' roots, in order of ``folder`` with null first, give the root of all
    in the same way. ``current`` holds values as they are found now (expressions over ``files``
    by field); a file is verified if its current leaf and its siblings still lead to the root.

    Returns ``folder, file_id, leaf, current_leaf, subroot, root, proof, folded_root, verified``;
    ``proof`` lists per level the file's slot in its run and the run's other digests, from the
    bottom to the root. Files without id come first in their folder, files without folder form one;
    files equal in folder and id stand by their digest, repeated rows are leaves of their own with
    equal contents; a lone file is its folder's root, a lone folder's root the root of all. Texts
    are hashed whole where they are read; what is shuffled is one digest a file (two where it has
    changed). An empty table gives no rows; columns that are not named are not read, whatever
    they are called.
    """
    found = file_leaves(files, fields, folder, file_id, current or {})
    leaves, trees = _in_trees(found)
    carried = ["file_id", "now"]
    rounds = write_log(leaves, carried)
    trees = stored(trees.join(tree_roots(rounds).withColumnRenamed("digest", "subroot"), "tree"), "trees")
    number = trees.count()
    tops = write_log(trees.select(
        F.lit(0).cast("long").alias("tree"), F.lit(number).cast("long").alias("nodes"), F.col("tree").alias("place"),
        F.col("subroot").alias("digest")), [])
    root = tree_roots(tops).select(
        "tree", F.lit(number).cast("long").alias("nodes"), F.col("digest").alias("root"), F.array().cast(STEPS).alias("above"))
    folders = _proofs(tops, root, [], ["root"]).select(F.col("block").alias("tree"), "root", "above")
    roots = stored(trees.join(folders, "tree"), "roots")
    proofs = _proofs(rounds, roots, carried, ["folder", "subroot", "root"])
    now = F.coalesce("now", "digest")
    return proofs.select(
        "folder", "file_id", F.col("digest").alias("leaf"), now.alias("current_leaf"), "subroot", "root",
        F.col("above").alias("proof"), folded(now, F.col("above")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
