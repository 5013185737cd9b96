"""Near-duplicate vectors by NN-descent.

The library's records hold no vectors, so this operator is general: ``vec_id, embedding``.

A graph gives every vector a list of its nearest ones known so far. It starts from neighbours in
sorted random sign codes and is refined by comparing, around every vector, those that have it in
their lists or that it has in its own: a neighbour's neighbour is probably a neighbour. Only
links at the threshold are kept in the end.

A list that is full of links is saturated and may hide more. It is then enlarged by all its
component at once: members of the component count as listed and leave its places free, and the
descent goes on among saturated vectors for links beyond their components, until no list is full
of links. Inside such components all members are compared in blocks, so lists stay short however
many near copies there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pageflow.llm.components import components
from pageflow.llm.neighbours import usable
from pageflow.llm.scratch import stored

SIMILARITY = 0.9
LIST = 12
TABLES = 6
CHUNK = 96
CROWD = 64
BLOCK = 512
SAMPLE = 1000
RECALL = 0.95
SETTLED = 0.01
SEED = 12
LISTED = "id long, other long, sim double"


def _units(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of length 1, in double precision; scaled first so that squares stay finite."""
    x = np.asarray(column.flatten()).reshape(-1, size).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str], size: int) -> Iterator[list[np.ndarray]]:
    """Runs of equal ``keys`` in sorted rows: the ``columns`` of each and its unit vectors."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        arrays = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys + columns] + [_units(batch.column("vec"), size)]
        if held:
            arrays = [np.concatenate(pair) for pair in zip(held, arrays)]
        change = np.zeros(len(arrays[0]) - 1, dtype=bool)
        for key in arrays[:len(keys)]:
            change |= key[1:] != key[:-1]
        bounds = [0, *(np.flatnonzero(change) + 1).tolist()]
        for begin, end in zip(bounds, bounds[1:]):
            yield [a[begin:end] for a in arrays[len(keys):]]
        held = [a[bounds[-1]:] for a in arrays]
    if held:
        yield held[len(keys):]


def _listed(found: Iterator[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best of every row of (ids, similarities); entries of -2 are none."""
    kept: list[tuple] = []
    count = 0

    def batch() -> pa.RecordBatch:
        ids, others, sims = (np.concatenate(x) for x in zip(*kept))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(others), pa.array(sims)], names=["id", "other", "sim"])

    for ids, sims in found:
        best = np.argpartition(-sims, k - 1, axis=1)[:, :k] if len(ids) > k else np.broadcast_to(np.arange(len(ids)), sims.shape)
        values = np.take_along_axis(sims, best, axis=1)
        row, column = np.nonzero(values > -2)
        if len(row):
            kept.append((ids[row], ids[best[row, column]], values[row, column]))
            count += len(row)
        if count > 50_000:
            yield batch()
            kept, count = [], 0
    if kept:
        yield batch()


def _best(entries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest entries of each list; an entry that was listed before is not fresh."""
    once = entries.repartition("id").groupBy("id", "other").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "other"))
    return once.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def _first_lists(nodes: DataFrame, size: int, k: int, tables: int) -> DataFrame:
    """Lists from ``tables`` orders of the vectors by 62 random signs, in chunks of ``CHUNK``."""
    along = np.random.default_rng(SEED).standard_normal((tables, size, 62))
    bits = np.int64(1) << np.arange(61, -1, -1, dtype=np.int64)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _units(batch.column("vec"), size)
            for t in range(tables):
                codes = ((x @ along[t]) > 0).astype(np.int64) @ bits
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, dtype=np.int32)), pa.array(codes), *(batch.column(c) for c in ("id", "label", "vec"))],
                    names=["tab", "code", "id", "label", "vec"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for ids, labels, x in _groups(batches, ["tab"], ["id", "label"], size):
                for begin in range(0, len(ids), CHUNK):
                    i, l, y = ids[begin:begin + CHUNK], labels[begin:begin + CHUNK], x[begin:begin + CHUNK]
                    sims = y @ y.T
                    sims[l[:, None] == l[None, :]] = -2
                    yield i, sims

        yield from _listed(chunks(), k)

    vec = nodes.schema["vec"].dataType.simpleString()
    coded = nodes.mapInArrow(code, f"tab int, code long, id long, label long, vec {vec}")
    order = ["tab", "code", "id"]
    listed = coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compare, LISTED)
    return stored(_best(listed.withColumn("fresh", F.lit(1)), k), "lists")


def _refined(nodes: DataFrame, lists: DataFrame, size: int, k: int, number: int) -> DataFrame:
    """One round: around every vector, those connected with it are compared with each other.

    A vector that very many lists hold is no hot spot: its crowd is dealt into parts of about
    ``CROWD``, anew in every round.
    """
    ways = lists.select(F.col("id").alias("pivot"), F.col("other").alias("member"), "fresh").unionByName(
        lists.select(F.col("other").alias("pivot"), F.col("id").alias("member"), "fresh"))
    crowd = ways.groupBy("pivot", "member").agg(F.max("fresh").alias("fresh"))
    sizes = crowd.groupBy("pivot").agg(F.ceil(F.count("*") / CROWD).alias("parts"), F.max("fresh").alias("any")).filter("any = 1")
    bars = lists.groupBy("id").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(-1.5).alias("bar"))
    known = nodes.join(bars, "id", "left").select(F.col("id").alias("member"), "label", F.coalesce("bar", F.lit(-1.5)).alias("bar"), "vec")
    dealt = crowd.join(sizes, "pivot").select(
        "pivot", F.pmod(F.xxhash64("member", F.lit(number)), F.col("parts")).cast("int").alias("part"), "member", "fresh")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def crowds() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for ids, labels, bar, fresh, x in _groups(batches, ["pivot", "part"], ["member", "label", "bar", "fresh"], size):
                fresh = fresh == 1
                if len(ids) > 1 and fresh.any():
                    sims = x @ x.T
                    known = (labels[:, None] == labels[None, :]) | ~(fresh[:, None] | fresh[None, :])
                    sims[known | (sims <= bar[:, None])] = -2
                    yield ids, sims

        yield from _listed(crowds(), k)

    order = ["pivot", "part"]
    found = dealt.join(known, "member").repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, LISTED)
    old = lists.withColumn("fresh", F.lit(0))
    return stored(_best(old.unionByName(found.withColumn("fresh", F.lit(1))), k), "lists")


def _descend(nodes: DataFrame, size: int, similarity: float, k: int, tables: int) -> DataFrame:
    """Lists refined until a round brings neither a new link nor many new entries."""
    lists = _first_lists(nodes, size, k, tables)
    number = 0
    while True:
        number += 1
        lists = _refined(nodes, lists, size, k, number)
        seen = lists.agg(F.count("*"), F.sum("fresh"), F.count_if((F.col("fresh") == 1) & (F.col("sim") >= similarity))).first()
        entries, fresh, links = (x or 0 for x in seen)
        if fresh <= SETTLED * entries or (number > 1 and not links):
            return lists


def _count_inside(crowds: DataFrame, size: int, similarity: float) -> DataFrame:
    """``id, links`` inside components of any size: every two blocks of about ``BLOCK`` members meet once.

    ``crowds`` has ``label, id, n, vec``; ``n`` vectors stand behind an id.
    """
    parts = crowds.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = crowds.join(parts, "label").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = dealt.select("label", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "n", "vec")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for low, high, own, ids, n, x in _groups(batches, ["label", "low", "high"], ["low", "high", "own", "id", "n"], size):
            a, b = np.flatnonzero(own == low), np.flatnonzero(own == high)
            near = x[a] @ x[b].T >= similarity
            if low[0] == high[0]:
                np.fill_diagonal(near, False)
                ids_out, links = ids[a], near @ n[b]
            else:
                ids_out, links = np.concatenate([ids[a], ids[b]]), np.concatenate([near @ n[b], n[a] @ near])
            yield pa.RecordBatch.from_arrays([pa.array(ids_out), pa.array(links.astype(np.int64))], names=["id", "links"])

    order = ["label", "low", "high"]
    counted = met.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "id long, links long")
    return counted.groupBy("id").agg(F.sum("links").alias("links"))


def _links(nodes: DataFrame, size: int, similarity: float, k: int, tables: int) -> DataFrame:
    """``id, label, links`` of all vectors that link with another."""
    near = F.col("sim") >= similarity
    active, edges, crowded = nodes.select("id", F.col("id").alias("label"), "vec"), None, None
    while True:
        lists = _descend(active, size, similarity, k, tables)
        found = lists.filter(near).select(F.col("id").alias("a"), F.col("other").alias("b"))
        edges = stored(found if edges is None else edges.unionByName(found), "edges")
        labels = components(edges)
        full = stored(lists.groupBy("id").agg(F.count("*").alias("entries"), F.min("sim").alias("worst"))
                      .filter((F.col("entries") >= k) & (F.col("worst") >= similarity)).select("id"), "full")
        crowded = full if crowded is None else crowded.unionByName(full)
        if not full.limit(1).count():
            break
        # Saturated: what the component holds is listed; links beyond it are looked for.
        active = stored(nodes.select("id", "vec").join(full, "id").join(
            labels.withColumnRenamed("node", "id"), "id").select("id", "label", "vec"), "active")
    labels = labels.withColumnRenamed("node", "id")
    dense = stored(labels.join(crowded.distinct(), "id").select("label").distinct(), "dense")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    few = both.join(nodes.select(F.col("id").alias("b"), "n"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    sparse = labels.join(dense, "label", "left_anti").join(few, "id").select("id", "label", "links")
    members = nodes.join(labels.join(dense, "label", "left_semi"), "id").select("label", "id", "n", "vec")
    many = labels.join(_count_inside(members, size, similarity), "id").select("id", "label", "links")
    return stored(sparse.unionByName(many), "linked")


def measured_recall(nodes: DataFrame, linked: DataFrame, size: int, similarity: float, sample: int = SAMPLE) -> float:
    """Share of the links of ``sample`` vectors (least hash of the id) that were found, against all vectors."""
    chosen = nodes.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "vec").collect()
    ids = np.array([r.id for r in chosen], dtype=np.int64)
    if not len(ids):
        return 1.0
    asked = _units(pa.array([r.vec for r in chosen], pa.list_(pa.float64())), size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = asked @ _units(batch.column("vec"), size).T >= similarity
            near &= ids[:, None] != batch.column("id").to_numpy()[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near @ batch.column("n").to_numpy())], names=["id", "due"])

    due = nodes.select("id", "n", "vec").mapInArrow(count, "id long, due long").groupBy("id").agg(F.sum("due").alias("due"))
    row = due.join(linked, "id", "left").agg(
        F.sum("due").alias("due"), F.sum(F.least("due", F.coalesce("links", F.lit(0)))).alias("found")).first()
    return row.found / row.due if row.due else 1.0


def link_near_vectors(vectors: DataFrame, similarity: float = SIMILARITY, k: int = LIST, tables: int = TABLES,
                      recall: float = RECALL) -> DataFrame:
    """Vectors whose cosine is ``similarity`` or more are linked: ``vec_id, n_links, component_id, kept``.

    ``vectors`` has ``vec_id, embedding``. ``n_links`` counts the other vectors linked directly,
    ``component_id`` is the least id reachable by links, ``kept`` says that it is the own one.
    Lists hold ``k`` entries. Recall is audited on a sample of at most 1,000 vectors compared
    with all; below ``recall`` everything is done again with lists and orders twice as many,
    which ends at the latest when a list holds all vectors.

    Equal vectors are one entry with a count, so a vector that a third of all rows share costs
    as much as any other. Vectors that are null, zero or hold null or non-finite components,
    rows without id and vectors of another length than most link with nothing. A repeated row
    counts once; an id with several vectors has one row for each; an empty table gives an empty
    result; other columns are not read. Similarities are computed in double precision.
    """
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec")).distinct()
    good = given.filter(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    shape = good.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = shape["size"] if shape else 1
    good = good.filter(F.size("vec") == size)
    nodes = stored(good.groupBy("vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "nodes")
    while True:
        linked = _links(nodes, size, similarity, k, tables)
        if measured_recall(nodes, linked, size, similarity) >= recall or k >= nodes.count():
            break
        k, tables = 2 * k, 2 * tables
    found = nodes.join(linked, "id", "left").select(
        "vec", F.coalesce("label", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    inside: Column = F.col("vec_id").isNotNull() & usable(F.col("vec")) & (F.size("vec") == size)
    placed = given.filter(inside).join(found, "vec").select("vec_id", "n_links", "component_id")
    alone = given.filter(~F.coalesce(inside, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
