"""Order-dependent work on groups of any size.

A job, folder or file may hold a third of all rows, so no operator sorts a whole group in
one task:

* first-k per group: ``row_number() <= k`` directly above its window. Spark then plans a
  partial group limit before the exchange, so a task ships at most k rows of a group.
* positions or running sums over whole groups: :func:`positions` and :func:`running_total`
  total ordered buckets of the group and add each bucket's offset to the rows inside it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_PAGES = 4096
SPLITTERS = 256


def first_k(df: DataFrame, group: list, order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their 1-based ``rank``."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def page_block(page: Column) -> Column:
    return F.floor(page / BLOCK_PAGES).cast("long")


def _same(columns: list[str]) -> Column:
    """Null-safe equality of sides ``l`` and ``r``: a null key (an unfiled group) is a key like any other."""
    return reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns])


def _rows_before(sizes: DataFrame, group: list[str], blocks: list[str]) -> DataFrame:
    """``sizes(group, blocks, _rows)`` with the rows of the group's earlier blocks, for any number of blocks.

    Up to ``SPLITTERS`` blocks of each group, chosen by hash, cut it into ranges. Rows are totalled
    per range, ranges are windowed over the group and blocks only inside their range, so no
    window holds a whole group.
    """
    at = F.struct(*blocks)
    chosen = first_k(sizes.select(*group, at.alias("_at")), group, [F.xxhash64("_at"), "_at"], SPLITTERS)
    cuts = chosen.groupBy(*group).agg(F.sort_array(F.collect_list("_at")).alias("_cuts"))
    ranged = sizes.alias("l").join(cuts.alias("r"), _same(group)).select("l.*", "r._cuts").withColumn(
        "_range", F.size(F.filter("_cuts", lambda cut: cut <= at))).drop("_cuts")
    ahead = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*group, "_range").agg(F.sum("_rows").alias("_sum"))
    totals = totals.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
    inside = Window.partitionBy(*group, "_range").orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.alias("l").join(totals.alias("r"), _same([*group, "_range"])).select("l.*", "r._ahead")
        .withColumn("_before", F.col("_ahead") + F.coalesce(F.sum("_rows").over(inside), F.lit(0))).drop("_ahead", "_range")
    )


def positions(
    df: DataFrame, group: list[str], blocks: list[str], order: list[str], rank: str = "rank",
    within: tuple[int, int] | None = None, many_blocks: bool = False,
) -> DataFrame:
    """1-based position of every row in its group, as a long.

    ``blocks`` are columns that follow ``order`` (say file name, then ``page_block(page)``).
    Only counts per block are windowed over the group; rows are ranked inside their block. Where
    blocks may be as many as files (``many_blocks``), the counts are split into ranges as well.
    With ``within`` (after, last) only positions after < p <= last are wanted, and rows of other
    blocks are left out before they are ranked.
    """
    sizes = df.groupBy(*group, *blocks).agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*group).orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        _rows_before(sizes, group, blocks) if many_blocks
        else sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    )
    if within:
        offsets = offsets.filter((F.col("_before") < within[1]) & (F.col("_before") + F.col("_rows") > within[0]))
    inside = Window.partitionBy(*group, *blocks).orderBy(*order)
    ranked = (
        df.alias("l").join(offsets.alias("r"), _same([*group, *blocks])).select("l.*", "r._before")
        .withColumn(rank, (F.col("_before") + F.row_number().over(inside)).cast("long"))
        .drop("_before")
    )
    return ranked.filter((F.col(rank) > within[0]) & (F.col(rank) <= within[1])) if within else ranked


def running_total(
    df: DataFrame, group: list[str], levels: dict[str, Column], order: list[str], value: str, name: str, least: int = 1
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of each group (``order`` must be unique in it).

    ``levels`` are whole-number bucket expressions from coarse to fine that follow ``order``
    (day, then minute of the first order column). Rows are totalled once, by the finest bucket;
    only these totals are windowed over the group, and rows are summed inside their own bucket.
    Groups of fewer than ``least`` rows are left out, also by the totals.
    """
    names = list(levels)
    rows = df.withColumns(levels)
    offsets = rows.groupBy(*group, *names).agg(F.sum(value).alias("_total"), F.count("*").alias("_rows"))
    before = F.lit(0)
    for depth, own in enumerate(names):
        earlier = Window.partitionBy(*group, *names[:depth]).orderBy(own).rangeBetween(Window.unboundedPreceding, -1)
        before = before + F.coalesce(F.sum("_total").over(earlier), F.lit(0))
    offsets = offsets.withColumns({"_before": before, "_rows": F.sum("_rows").over(Window.partitionBy(*group))})
    if least > 1:
        offsets = offsets.filter(F.col("_rows") >= least)
    inside = Window.partitionBy(*group, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.alias("l").join(offsets.alias("r"), _same([*group, *names])).select("l.*", "r._before")
        .withColumn(name, (F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long"))
        .drop("_before", *names)
    )
