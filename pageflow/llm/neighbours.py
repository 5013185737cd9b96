"""Approximate nearest neighbours by multiprobe p-stable hashing.

The library's records hold no vectors, so this operator is general: ``vec_id, embedding``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pageflow.llm.scratch import stored

HASHES = 6
TABLES = (2, 3, 4, 6)
WIDTHS = (0.8, 1.2, 1.6, 2.4, 3.6)
TARGET = 0.95
FIT_QUERIES = 200
FIT_VECTORS = 4096
CELL_VECTORS = 4096
SHARD_VECTORS = 32768
SEED = 20


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not all zero, every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Tables:
    """``tables`` groups of ``hashes`` functions floor((a x + b) / width), a standard normal."""

    def __init__(self, size: int, width: float, tables: int, hashes: int, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.tables, self.hashes, self.width = tables, hashes, width
        self.along = draw.standard_normal((tables, size, hashes))
        self.shift = draw.uniform(0, width, (tables, 1, hashes))
        self.mix = draw.integers(1 << 62, size=hashes, dtype=np.int64) | 1
        self.steps = np.array(list(itertools.product((-1, 0, 1), repeat=hashes)), dtype=np.int64)

    def places(self, vectors: np.ndarray, table: int) -> np.ndarray:
        return (vectors @ self.along[table] + self.shift[table]) / self.width

    def codes(self, floors: np.ndarray) -> np.ndarray:
        return (floors.astype(np.int64) * self.mix).sum(axis=-1)

    def cells(self, vectors: np.ndarray, table: int) -> np.ndarray:
        return self.codes(np.floor(self.places(vectors, table)))

    def probes(self, vectors: np.ndarray, table: int, count: int) -> np.ndarray:
        """The ``count`` most promising cells of each vector, in order.

        The chance that a neighbour lies across a border falls with the squared distance to
        it, so a perturbation is rated by the sum of its squared border distances.
        """
        place = self.places(vectors, table)
        floor = np.floor(place)
        below = (place - floor) ** 2
        above = (1 - (place - floor)) ** 2
        cost = below @ (self.steps == -1).T + above @ (self.steps == 1).T
        best = np.argsort(cost, axis=1, kind="stable")[:, :count]
        return self.codes(floor[:, None, :] + self.steps[best])


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, size)


def _true_neighbours(classes: DataFrame, drawn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` other vectors nearest to each drawn one, by a scan of all: place of the drawn one, neighbour."""
    size = drawn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = np.full((len(drawn), k + 1), np.inf)
        best = np.zeros((len(drawn), k + 1, size))
        for batch in batches:
            x = _matrix(batch.column("vec"), size).astype(np.float64)
            square = (drawn**2).sum(axis=1)[:, None] - 2 * drawn @ x.T + (x**2).sum(axis=1)
            every = np.concatenate([far, square], axis=1)
            first = np.argpartition(every, k, axis=1)[:, : k + 1]
            far = np.take_along_axis(every, first, axis=1)
            for i, chosen in enumerate(first):
                best[i] = np.concatenate([best[i], x[np.maximum(chosen - k - 1, 0)]])[
                    np.where(chosen <= k, chosen, k + 1 + np.arange(k + 1))]
        place, nth = np.nonzero(np.isfinite(far))
        for begin in range(0, len(place), 1000):
            p, n = place[begin : begin + 1000], nth[begin : begin + 1000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(p), pa.array(far[p, n]), pa.array(list(best[p, n]), pa.list_(pa.float64()))], names=["place", "square", "vec"])

    found = classes.select("vec").mapInArrow(run, "place long, square double, vec array<double>")
    nearest = F.row_number().over(Window.partitionBy("place").orderBy("square"))
    found = found.withColumn("nth", nearest).filter(F.col("nth") <= k + 1).select("place", "vec").toArrow()
    place = found.column("place").to_numpy()
    near = np.asarray(found.column("vec").combine_chunks().flatten()).reshape(-1, size)
    other = (near != drawn[place]).any(axis=1)
    return place[other], near[other]


def _ranks(order: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Place of each cell in a visiting order; the order's length where it is not visited."""
    by_code = np.argsort(order, kind="stable")
    at = np.minimum(np.searchsorted(order, cells, sorter=by_code), len(order) - 1)
    return np.where(order[by_code[at]] == cells, by_code[at], len(order))


def fit_settings(classes: DataFrame, size: int, scale: float, k: int, hashes: int = HASHES) -> tuple[int, float, int]:
    """Tables, width and probes that find ``TARGET`` of the true neighbours with the least looking.

    Up to ``FIT_VECTORS`` vectors are drawn by hash, ``FIT_QUERIES`` of them with their true
    neighbours among all vectors (one scan). For every choice of ``TABLES`` and ``WIDTHS`` the
    probes needed follow from the places of the neighbours' cells in the visiting order, and the
    looking from the drawn vectors in the visited cells. If none suffices, widths grow by half.
    The driver holds no more than these drawn vectors.
    """
    drawn = classes.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(FIT_VECTORS).toArrow().column("vec").combine_chunks()
    drawn = _matrix(drawn, size).astype(np.float64)
    asked = drawn[:FIT_QUERIES]
    place, near = _true_neighbours(classes, asked, k) if len(drawn) > 1 else (np.zeros(0, int), asked[:0])
    if not len(place):
        return TABLES[0], WIDTHS[0] * scale, 1
    grown = 1.0
    while True:
        choices = []
        for width in WIDTHS:
            hashing = Tables(size, width * grown * scale, max(TABLES), hashes)
            needed = np.full(len(place), len(hashing.steps))
            looked = np.zeros(len(hashing.steps))
            for t in range(max(TABLES)):
                orders = hashing.probes(asked, t, len(hashing.steps))
                cells, ends = hashing.cells(drawn, t), hashing.cells(near, t)
                for i, order in enumerate(orders):
                    mine = place == i
                    needed[mine] = np.minimum(needed[mine], _ranks(order, ends[mine]))
                    looked += np.cumsum(np.bincount(_ranks(order, cells), minlength=len(order) + 1)[:-1])
                probes = int(np.sort(needed)[int(np.ceil(TARGET * len(needed))) - 1]) + 1
                if t + 1 in TABLES and probes <= len(looked):
                    choices.append((looked[probes - 1], t + 1, width * grown * scale, probes))
        if choices:
            return min(choices)[1:]
        grown *= 1.5


def _scan(size: int, k: int, tables: int):
    """Streams sorted shards, vectors before queries, and gives each query's ``k`` nearest in the
    slots of the shard that it visits (null: in all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, vectors, slots, ids = None, [], [], []
        whole = None
        for batch in batches:
            shard, is_query = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "is_query"))
            change = np.flatnonzero((shard[1:] != shard[:-1]) | (is_query[1:] != is_query[:-1])) + 1
            bounds = [0, *change.tolist(), batch.num_rows]
            out_q, out_v, out_s = [], [], []
            for begin, end in zip(bounds, bounds[1:]):
                if begin == end:
                    continue
                run_rows = batch.slice(begin, end - begin)
                if shard[begin] != held:
                    held, vectors, slots, ids, whole = shard[begin], [], [], [], None
                rows = _matrix(run_rows.column("vec"), size).astype(np.float64)
                if not is_query[begin]:
                    vectors.append(rows)
                    slots.append(run_rows.column("slot").to_numpy(zero_copy_only=False))
                    ids.append(run_rows.column("ids"))
                    continue
                if whole is None:
                    if not vectors:
                        continue
                    whole, names = np.concatenate(vectors), pa.concat_arrays(ids)
                    square = (whole * whole).sum(axis=1)
                    keys, first = np.unique(np.concatenate(slots), return_index=True)
                    edges = np.append(first, len(whole))
                for query, own, wanted in zip(rows, run_rows.column("id").to_pylist(), run_rows.column("slots")):
                    at = np.arange(len(keys))
                    if wanted.is_valid:
                        at = np.flatnonzero(np.isin(keys, np.asarray(wanted.values), assume_unique=True))
                    if not len(at):
                        continue
                    # Slots side by side are one stretch of rows.
                    breaks = np.flatnonzero(np.diff(at) > 1)
                    starts, ends = edges[at[np.append(0, breaks + 1)]], edges[at[np.append(breaks, len(at) - 1)] + 1]
                    place = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)])
                    # Rough distances choose, with room for their rounding; exact ones rank. A
                    # vector stands in a shard once a table at most.
                    rough = np.concatenate([square[a:b] - 2 * (whole[a:b] @ query) for a, b in zip(starts, ends)])
                    least = (k + 1) * tables
                    if len(rough) > least:
                        bound = np.partition(rough, least - 1)[least - 1]
                        place = place[rough <= bound + 1e-9 * (1 + abs(bound) + square.max())]
                    exact = np.sqrt(((whole[place] - query) ** 2).sum(axis=1))
                    best = sorted({(s, v) for s, n in zip(exact.tolist(), place.tolist()) for v in names[n].as_py() if v != own})[:k]
                    out_q += [own] * len(best)
                    out_s += [s for s, _ in best]
                    out_v += [v for _, v in best]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())],
                names=["query_id", "vec_id", "score"])

    return run


def _search(rows: DataFrame, asked: DataFrame, size: int, k: int, tables: int) -> DataFrame:
    """``query_id, vec_id, score`` of the candidates in every shard; ``rows`` have ``shard, slot,
    ids, vec``, ``asked`` have ``shard, id, vec, slots``."""
    none = lambda kind: F.lit(None).cast(kind)
    held = rows.select("shard", F.lit(0).alias("is_query"), "slot", none("long").alias("id"), "ids", "vec",
                       none("array<long>").alias("slots"))
    visits = asked.select("shard", F.lit(1).alias("is_query"), none("long").alias("slot"), "id",
                          none("array<long>").alias("ids"), "vec", "slots")
    return (
        held.unionByName(visits).repartition("shard").sortWithinPartitions("shard", "is_query", "slot", "id")
        .mapInArrow(_scan(size, k, tables), "query_id long, vec_id long, score double")
    )


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = 10, settings: tuple[int, float, int] | None = None,
                    hashes: int = HASHES) -> DataFrame:
    """The ``k`` nearest vectors found for every query: ``query_id, rank, vec_id, score``.

    ``vectors`` and ``queries`` have ``vec_id, embedding``; a query's own id is no candidate.
    Every vector is put into one cell of each of several hash tables; a query visits, per table,
    the cells most likely to hold neighbours, and the candidates of all tables are ranked by
    exact Euclidean distance in double precision, ties by smaller id. A query that finds fewer
    than ``k`` visits all vectors, so it returns every candidate there is. ``settings`` are the
    number of tables, the cells' width and the probes a table; without them
    :func:`fit_settings` measures what this table needs for a recall of ``TARGET``.

    Cells lie in shards of about ``SHARD_VECTORS`` rows; a cell of more than ``CELL_VECTORS`` is
    dealt into slots of many shards. A query is sent once to every shard that holds slots it
    visits, with their list, so its vector is not copied for every cell.

    Equal vectors are one entry with its ``k + 1`` smallest ids (no other id can be returned),
    so a vector that a third of all rows share costs as much as any other. Vectors that are
    null, zero or hold null or non-finite components, rows without id and vectors of another
    length than most take no part, as candidates or queries; a repeated row counts once; an
    empty table gives an empty result; other columns are not read. Components are read as
    doubles unless both tables hold floats.
    """
    floats = all(dict(df.dtypes)["embedding"] == "array<float>" for df in (vectors, queries))
    kind = "array<float>" if floats else "array<double>"

    def clean(df: DataFrame) -> DataFrame:
        v = df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("vec"))
        return v.filter(F.col("id").isNotNull() & usable(F.col("vec")))

    rank = F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))
    classes = (
        clean(vectors).withColumn("place", rank).filter(F.col("place") <= k + 1)
        .groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    )
    classes = stored(classes, "vectors")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    shapes = classes.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n"), F.avg(square).alias("norm"))
    shape = shapes.orderBy(F.desc("n"), "size").first()
    size, n, scale = (shape["size"], shape["n"], float(shape["norm"]) ** 0.5) if shape else (1, 0, 1.0)
    classes = classes.filter(F.size("vec") == size)
    asked = clean(queries).distinct().filter(F.size("vec") == size)
    tables, width, probes = settings or fit_settings(classes, size, scale, k, hashes)
    hashing = Tables(size, width, tables, hashes)
    shards = max(1, -(-n * tables // SHARD_VECTORS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"), size).astype(np.float64)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, dtype=np.int32)), pa.array(hashing.cells(x, t)), batch.column("ids"), batch.column("vec")],
                    names=["table", "cell", "ids", "vec"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"), size).astype(np.float64)
            for t in range(tables):
                cells, sizes = np.unique(hashing.cells(x, t), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cells), t, dtype=np.int32)), pa.array(cells), pa.array(sizes)],
                    names=["table", "cell", "n"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for begin in range(0, big.num_rows, 256):
                batch = big.slice(begin, 256)
                x = _matrix(batch.column("vec"), size).astype(np.float64)
                for t in range(tables):
                    found = hashing.probes(x, t, probes)
                    again = pa.array(np.repeat(np.arange(len(x)), found.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(found.size, t, dtype=np.int32)), pa.array(found.ravel()), batch.column("id").take(again)],
                        names=["table", "cell", "id"])

    cells = (
        classes.select("vec").mapInArrow(count, "table int, cell long, n long").groupBy("table", "cell")
        .agg(F.ceil(F.sum("n") / CELL_VECTORS).cast("int").alias("parts"))
    )
    slot = F.xxhash64("table", "cell", "part")
    shard = F.pmod("slot", F.lit(shards)).alias("shard")
    part = F.pmod(F.xxhash64("ids"), F.coalesce("parts", F.lit(1))).cast("int")
    rows = (
        classes.mapInArrow(place, f"table int, cell long, ids array<long>, vec {kind}")
        .join(cells.filter("parts > 1"), ["table", "cell"], "left").withColumn("part", part)
        .select("table", slot.alias("slot"), "ids", "vec").select("*", shard)
    )
    visits = (
        asked.mapInArrow(probe, "table int, cell long, id long").join(cells, ["table", "cell"])
        .select("table", "cell", "id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        .select("id", slot.alias("slot")).select("*", shard)
        .groupBy("id", "shard").agg(F.collect_set("slot").alias("slots")).join(asked, "id")
    )
    found = _search(rows, visits, size, k, tables)
    found = stored(found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), "candidates")
    enough = found.groupBy(F.col("query_id").alias("id")).count().filter(F.col("count") >= k).select("id")
    few = asked.join(enough, "id", "left_anti").select(
        "id", "vec", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(None).cast("array<long>").alias("slots"))
    rest = _search(rows.filter("table = 0"), few, size, k, 1)
    merged = found.unionByName(rest).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place_of = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return merged.withColumn("rank", place_of).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
