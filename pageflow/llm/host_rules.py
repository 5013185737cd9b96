"""Quality rules judged by folder: shrunken failure rates with an empirical beta prior."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pageflow.llm.scratch import WORD, same_key, stored

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MAX_RATE = 0.5


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more in the list."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.uint64, count=len(words))
    codes = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    codes ^= codes >> np.uint64(29)
    keys = np.zeros(n, dtype=np.uint64)
    for i in range(window):
        keys = keys * np.uint64(0xBF58476D1CE4E5B9) + codes[i : n + i]
        keys ^= keys >> np.uint64(31)
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    change = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(change[:-1])))


def measure_texts(files: DataFrame) -> DataFrame:
    """``file_id, folder`` and the measures of every whole text (null: no words, 0 lines)."""
    spaces = "\x20\x09\x0a\x0b\x0c\x0d"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(WORD).findall
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], [], []]
            for value in batch.column("text"):
                text = value.as_py() or ""
                words, seen, repeats, lines = find(text), set(), 0, 0
                for line in text.split("\n"):
                    if line.strip(spaces):
                        lines += 1
                        repeats += line in seen
                        seen.add(line)
                symbols = sum(text.count(c) for c in SYMBOLS)
                row = (len(words), sum(map(len, words)), symbols, repeats, repeated_words(words), lines)
                for column, v in zip(out, row):
                    column.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("file_id"), batch.column("folder"), *[pa.array(c, pa.int64()) for c in out]],
                names=["file_id", "folder", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", "n_lines"],
            )

    columns = files.select("file_id", "folder", "text")
    kinds = dict(columns.dtypes)
    return columns.mapInArrow(run, f"file_id {kinds['file_id']}, folder {kinds['folder']}, {MEASURES}")


def rules() -> dict[str, Column]:
    """Failure tests over the measures; the first two are the base rules."""
    c = F.col
    return {
        "short": c("n_words") < 20,
        "repeated": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "same_lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
        "word_length": (c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 12 * c("n_words")),
    }


def folder_rates(measured: DataFrame) -> DataFrame:
    """``folder, rule, n, failed, rate``: each folder's failure rate per rule, shrunk.

    The beta prior of a rule comes from all folders by moments. Its mean is m = failures /
    texts. The variance of the folders' raw rates also holds the chance of drawing few texts, so
    the mean of m(1 - m)/n is taken off it; what is left, v, gives the strength
    s = m(1 - m)/v - 1 (0 at least) and rate = (failed + m s) / (n + s). Where nothing is left
    the folders differ by chance alone, and every rate is m.
    """
    tests = rules()
    totals = measured.groupBy("folder").agg(
        F.count("*").alias("n"), *[F.count_if(t).alias(k) for k, t in tests.items()]
    )
    long = totals.select(
        "folder", "n",
        F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("failed")) for k in tests])).alias("r"),
    ).select("folder", "n", "r.*")
    # A row per rule: the prior is a handful of sums over folders.
    prior = long.groupBy("rule").agg(
        (F.sum("failed") / F.sum("n")).alias("m"), F.var_pop(F.col("failed") / F.col("n")).alias("raw"),
        F.avg(1 / F.col("n")).alias("each"),
    ).withColumn("spread", F.col("m") * (1 - F.col("m"))).withColumn("v", F.col("raw") - F.col("spread") * F.col("each")).select(
        "rule", "m", F.when(F.col("v") > 0, F.greatest(F.try_divide("spread", "v") - 1, F.lit(0.0))).alias("s"))
    shrunk = (F.col("failed") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s"))
    return long.join(prior, "rule").select("folder", "rule", "n", "failed", F.coalesce(shrunk, "m").alias("rate"))


def judge_files(files: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """Rule measures of every file and a verdict that its folder shares.

    ``files`` has ``file_id, folder, text``. A file is kept when it passes the base rules and
    its folder's shrunken failure rate exceeds ``max_rate`` for no rule. Returns ``file_id,
    folder``, the measures, ``base_failed, folder_rate`` (the folder's worst) and ``kept``.

    Texts are read once: the measures are stored, then totalled by folder with map-side
    combine and joined back, so no text is shuffled. Null text has no words and fails; files
    without a folder form one folder; repeated rows are judged one by one; an empty table gives
    an empty result; other columns are not read.
    """
    measured = stored(measure_texts(files), "measures")
    worst = folder_rates(measured).groupBy("folder").agg(F.max("rate").alias("folder_rate"))
    tests = rules()
    m, w = measured.alias("m"), worst.alias("w")
    return (
        m.join(w, same_key(F.col("m.folder"), F.col("w.folder")), "left")
        .select("m.*", (tests["short"] | tests["repeated"]).alias("base_failed"), "folder_rate")
        .withColumn("kept", ~F.col("base_failed") & (F.col("folder_rate") <= max_rate))
    )
