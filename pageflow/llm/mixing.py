"""Mixing folders to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pageflow.llm.scratch import n_words, same_key, stored
from pageflow.operators.ranking import positions

MAX_COPIES = 3
SEED = "mix"
BUCKETS = 1024


def folder_targets(sizes: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """``folder, folder_size, root_size, target`` from rows of ``folder, size``.

    Folders in code point order (null last) weigh 1, 2, 3, 1, ... and share the total; a target
    stops at ``max_copies`` times the folder's size and the excess is shared again by weight.
    The final shares have one common level: folders sorted by room = cap / weight fill up in
    that order, and the first level that no longer exceeds the next room holds for all the rest.

    Folders may be as many as sites of a crawl. Their ranks come from totals of ranges of names,
    so no window holds them all. Rooms are windowed once per different value: n different
    sizes need n(n + 1)/2 words, so a million words have at most 1,414 sizes and 4,242 rooms.
    """
    folders = sizes.groupBy("folder").agg(
        F.sum("size").alias("folder_size"), F.sum(F.col("size") * F.sqrt("size")).alias("root_size")
    )
    named = folders.select("*", F.lit(0).alias("all"), F.col("folder").isNull().alias("last"),
                           F.coalesce("folder", F.lit("")).alias("name"))
    ranked = positions(named, ["all"], ["last", "name"], ["last", "name"], rank="place", many_blocks=True)
    caps = (
        ranked.withColumn("weight", (F.col("place") - 1) % 3 + 1)
        .withColumn("cap", F.col("folder_size") * max_copies)
        .withColumn("room", F.col("cap") / F.col("weight"))
        .select("folder", "folder_size", "root_size", "weight", "cap", "room")
    )
    caps = stored(caps, "folders")
    rooms = caps.groupBy("room").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight"))
    by_room = Window.orderBy("room")
    level = F.try_divide(caps.agg(F.sum("folder_size")).scalar() - F.col("filled"), F.col("weight_left"))
    lowest = (
        rooms.withColumn("filled", F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", level).filter(F.col("level") <= F.col("room"))
        .agg(F.min_by("level", "room").alias("level"))
    )
    return caps.select("folder", "folder_size", "root_size",
                       F.least(lowest.scalar() * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def _cut(rows: DataFrame, width: float) -> DataFrame:
    """Splits rows of (folder, ..., key, from_key, before, rest) at the bucket where ``rest`` words are reached.

    Adds ``state``: 1 below the cut, -1 above it, 0 in the bucket that holds it (``before`` is
    then the words ahead of the bucket). Only totals per bucket are ordered.
    """
    bucket = F.least(F.floor((F.col("key") - F.col("from_key")) / width), F.lit(BUCKETS - 1)).cast("int")
    marked = rows.withColumn("bucket", bucket)
    sums = marked.groupBy("folder", "before", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("folder").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.col("before") + F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("before")
    m, s = marked.alias("m"), sums.alias("s")
    return (
        m.join(s, same_key(F.col("m.folder"), F.col("s.folder")) & (F.col("m.bucket") == F.col("s.bucket")))
        .select("m.*", "s.start", "s.words")
        .withColumn("state", F.when(F.col("start") + F.col("words") <= F.col("rest"), 1)
                    .when(F.col("start") >= F.col("rest"), -1).otherwise(0))
        .withColumn("before", F.col("start"))
        .withColumn("from_key", F.col("from_key") + F.col("bucket") * width)
        .drop("start", "words", "bucket")
    )


def mix_files(files: DataFrame, max_copies: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """Copies of every file in a mix whose folders come near their target numbers of words.

    ``files`` has ``file_id, folder, text``. With ratio = target / folder size, every file gets
    floor(ratio) certain copies. The rest of the target is filled by one more copy of some
    files, in Pareto order: inclusion probability p = rest * sqrt(size) / sum(size * sqrt(size))
    (at least 1: a certain copy), random number u from a hash of ``seed`` and ``file_id``, files
    ranked by (u / (1 - u)) / (p / (1 - p)) and taken from the front while that brings the
    folder's words nearer to the target. No file exceeds ``max_copies`` copies.

    Returns ``file_id, folder, size, folder_size, target, copies, taken``. The cut is found from
    word totals of 1024 buckets of the rank, then of 1024 buckets of the bucket that holds it;
    rows are ordered only inside the last one, about a millionth of a folder. Null text has size
    0 and is never taken; files without a folder form one folder; rows with equal id and size
    rank side by side; an empty table gives an empty result; other columns are not read. The
    result depends on the rows only.
    """
    sized = stored(files.select("file_id", "folder", n_words(F.col("text")).alias("size")), "sizes")
    targets = folder_targets(sized, max_copies)
    s, t = sized.alias("s"), targets.alias("t")
    rest = F.col("target") - F.col("whole") * F.col("folder_size")
    number = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("file_id").cast("string"), F.lit("")))), 1, 12), 16, 10)
    u = (number.cast("double") + 0.5) / float(1 << 48)
    chance = F.col("rest") * F.sqrt("size") / F.col("root_size")
    odds = (u / (1 - u)) / (chance / (1 - chance))
    ranked = (
        s.join(t, same_key(F.col("s.folder"), F.col("t.folder")))
        .select("s.*", "folder_size", "root_size", "target")
        .withColumn("whole", F.when(F.col("folder_size") > 0, F.floor(F.try_divide("target", "folder_size"))).otherwise(F.lit(0)))
        .withColumn("rest", rest)
        .withColumn("key", F.when((F.col("size") == 0) | (F.col("rest") <= 0), 1.0)
                    .when(chance >= 1, 0.0).otherwise(odds / (1 + odds)))
        .select("file_id", "folder", "size", "folder_size", "target", "whole", "rest", "key",
                F.lit(0.0).alias("from_key"), F.lit(0).cast("long").alias("before"))
    )
    first = stored(_cut(ranked, 1.0 / BUCKETS), "mix")
    second = _cut(first.filter("state = 0").drop("state"), 1.0 / BUCKETS / BUCKETS)
    order = Window.partitionBy("folder").orderBy("key", "file_id", "size")
    ahead = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Only the bucket with the cut is ordered; the next file is taken while half of it fits.
    last = second.filter("state = 0").withColumn(
        "state", F.when(F.col("before") + ahead + F.col("size") / 2 <= F.col("rest"), 1).otherwise(-1)
    )
    columns = ["file_id", "folder", "size", "folder_size", "target", "whole", "state"]
    parts = [first.filter("state <> 0"), second.filter("state <> 0"), last]
    done = parts[0].select(columns).unionByName(parts[1].select(columns)).unionByName(parts[2].select(columns))
    copies = (F.col("whole") + F.when((F.col("state") == 1) & (F.col("size") > 0), 1).otherwise(0)).cast("long")
    return done.select(
        "file_id", "folder", "size", "folder_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )
