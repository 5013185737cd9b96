"""File discovery, upload manifests and the storage inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pageflow import rules
from pageflow.functions.text import base_name, is_pdf
from pageflow.operators.ranking import first_k


def _any_case(ext: str) -> str:
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)


def scan_files(spark: SparkSession, path: str, ext: str = ".pdf") -> DataFrame:
    """Files below ``path`` with the extension in any case. Only the listing is read, never the bytes."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _any_case(ext))
        .load(path)
        .select("path", "modificationTime", "length")
    )


def storage_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Everything stored below ``path``: the table the availability joins read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select("path", "modificationTime", "length")
    )


def _refusal(name: Column, size: Column, max_bytes: int) -> Column:
    return (
        F.when((name == "") | name.isin(".", "..") | ~is_pdf(name), "not_pdf")
        .when(size <= 0, "empty")
        .when(size > max_bytes, "too_large")
    )


def validate_manifest(
    manifest: DataFrame,
    max_bytes: int = rules.MAX_FILE_BYTES,
    max_files: int = rules.MAX_FILES_PER_UPLOAD,
) -> DataFrame:
    """Verdict per registration: ``accepted``, ``same_file``, ``conflict``, ``over_limit`` or the refusal.

    The first valid registration of a name claims it; a repeat with the same size is that file
    again, another size conflicts; names beyond the limit are refused. Names are reduced to one
    row each before the per-upload ranking, and the ranking keeps its first ``max_files`` only,
    so neither a name nor an upload with very many registrations gathers in one task.
    """
    named = manifest.withColumn("name", base_name(F.col("filename"))).withColumn(
        "refusal", _refusal(F.col("name"), F.col("size"), max_bytes)
    )
    claims = (
        named.filter(F.col("refusal").isNull())
        .groupBy("upload_id", "name")
        .agg(F.min(F.struct("ord", "size")).alias("first"))
        .select("upload_id", "name", F.col("first.ord").alias("claim_ord"), F.col("first.size").alias("claim_size"))
    )
    kept = first_k(claims, ["upload_id"], ["claim_ord"], max_files, "claim_rank")
    verdict = (
        F.when(F.col("refusal").isNotNull(), F.col("refusal"))
        .when(F.col("claim_ord").isNull(), "over_limit")
        .when(F.col("ord") == F.col("claim_ord"), "accepted")
        .when(F.col("size") == F.col("claim_size"), "same_file")
        .otherwise("conflict")
    )
    return (
        named.join(kept, ["upload_id", "name"], "left")
        .withColumn("verdict", verdict)
        .drop("refusal", "claim_ord", "claim_size", "claim_rank")
    )


def dedupe_names(manifest: DataFrame) -> DataFrame:
    """First file of every name in an upload (exact spelling), with how many later ones it hides."""
    return (
        manifest.groupBy("upload_id", "filename")
        .agg(F.min(F.struct("ord", "size")).alias("first"), (F.count("*") - 1).alias("skipped"))
        .select("upload_id", "filename", "first.ord", "first.size", "skipped")
    )
