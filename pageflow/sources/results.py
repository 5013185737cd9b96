"""Reading and writing page results and file summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pageflow.schemas import FILE_SUMMARY, PAGE_RESULT

_PAGE_PATH = r"results/pages/([0-9a-f]{20})/(\d+)\.json$"


def parse_page_results(documents: DataFrame) -> DataFrame:
    """``(path, value)`` JSON documents to page results; unreadable documents are dropped."""
    number = F.regexp_extract("path", _PAGE_PATH, 2).try_cast("int")
    # A generator is no expression to copy: the filter behind it does not parse a document again,
    # and documents that the path names no page for are not parsed at all.
    parsed = documents.filter(number.isNotNull()).select(
        "path", F.explode_outer(F.array(F.from_json("value", PAGE_RESULT))).alias("r")
    )
    return parsed.filter(F.col("r.angle").isNotNull()).select(
        F.regexp_extract("path", _PAGE_PATH, 1).alias("file_key"), number.alias("page"), "r.*"
    )


def read_page_results(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per page below ``path``; the page number and file key come from the path."""
    texts = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
        .option("wholetext", "true").text(path)
    )
    return parse_page_results(texts.select(F.col("_metadata.file_path").alias("path"), "value"))


def page_number(key: Column) -> Column:
    """Page keys may be numbers or their text; anything else is no page."""
    return F.when(key.cast("string").rlike(r"^\d+$"), key.cast("string").try_cast("int"))


def explode_summaries(summaries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Finished-file documents to page rows with rotation and details."""
    keys = keys or []
    return (
        summaries.filter(F.col("filename").isNotNull())
        .select(*keys, "filename", "page_rotations", F.explode("page_details").alias("key", "d"))
        .select(
            *keys, "filename", page_number(F.col("key")).alias("page"),
            F.element_at("page_rotations", F.col("key")).alias("rotation"), "d.*",
        )
        .filter(F.col("page").isNotNull())
    )


def parse_file_summaries(documents: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``value`` JSON texts to page rows; unreadable documents are dropped."""
    keys = keys or []
    parsed = documents.select(*keys, F.from_json("value", FILE_SUMMARY).alias("s")).select(*keys, "s.*")
    return explode_summaries(parsed, keys)


def read_file_summaries(spark: SparkSession, path: str, glob: str = "*.json", lines: bool = False) -> DataFrame:
    """All finished files below ``path`` as page rows; bad documents are skipped.

    One document a file, or with ``lines`` one a line (splittable, for many small summaries).
    """
    stored = (
        spark.read.schema(FILE_SUMMARY).option("mode", "DROPMALFORMED").option("multiLine", str(not lines).lower())
        .option("recursiveFileLookup", "true").option("pathGlobFilter", glob).json(path)
    )
    return explode_summaries(stored)


def write_page_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Durable parquet, range-partitioned and sorted on the page key.

    A reader of one job prunes files and row groups by min/max; a hot job spans several files
    because the range includes file name and page. The commit protocol makes it all or nothing.
    """
    keys = ["job_id", "filename", "page"]
    results.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).parquet(path)


BUCKET_ROWS = 500_000


def buckets_for(rows: int, least: int) -> int:
    """Buckets for a table of ``rows``: a task reads a whole one, so their number grows with the table."""
    return max(least, -(-rows // BUCKET_ROWS))


def write_bucketed_results(results: DataFrame, table: str, path: str, buckets: int = 200) -> int:
    """Durable parquet at ``path``, catalogued as ``table`` and bucketed by file.

    A join or sum by file reads the buckets as they are, without an exchange of the results, every
    time. A file lies in one bucket: choose this layout where the results are joined again and
    again and no file holds a large part of them, :func:`write_page_results` elsewhere. ``buckets``
    is their least number; returns how many there are.
    """
    keys = ["job_id", "filename"]
    buckets = buckets_for(results.count(), buckets)
    (
        results.repartition(buckets, *keys).write.mode("overwrite").format("parquet").option("path", path)
        .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    )
    return buckets


def read_stored_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
