"""From raw documents to packed training sequences, in five stages of the ``pageflow.llm`` operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of documents:

1. ``quality``: documents that the line field rejects go;
2. ``lines``: lines that a source repeats on most of its documents are dropped from the texts;
3. ``near_copies``: one document of each group of similar ones stays;
4. ``mix``: documents are repeated or left out so that sources come near their target weights;
5. ``pack``: token pieces are packed into sequences (one row per piece).

Null ids and sources, null or empty texts, repeated rows and extra columns go through the
stages as the operators define; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageflow.llm import line_quality, mixing, packing, repeated_lines, similar_files
from pageflow.llm.queries import as_files, as_labels, table, tokenizer_path
from pageflow.llm.scratch import prepared, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with predicted quality 1; trained on the labels of documents still present."""
    prepared(spark)
    files = as_files(docs).select("file_id", "text")
    labels = as_labels(table(spark, sf_dir, "labels")).filter(~line_quality.held_out())
    chain = line_quality.train(files, labels)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    scored = line_quality.score_files(docs.select("text", row.alias("row")), chain)
    return scored.filter("predicted = 1").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their sources' repeated lines; ``n_chars`` follows the text."""
    prepared(spark)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    cleaned = repeated_lines.drop_site_lines(docs.select("source", "text", row.alias("row")), folder="source")
    changed = F.col("lines_dropped") > 0
    values = {
        "text": F.when(changed, F.col("text")).otherwise(F.col("row.text")),
        "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("row.n_chars")),
    }
    return cleaned.select(*[values.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies; documents without words stay."""
    prepared(spark)
    return similar_files.keep_one_of_each(docs, file_id="doc_id")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (not at all, or up to three times)."""
    prepared(spark)
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")),
                      F.coalesce("source", F.lit("none")), F.md5(F.coalesce("text", F.lit(""))))
    files = docs.select(key.alias("file_id"), F.col("source").alias("folder"), "text")
    # Rows equal in id, source and text are one key, taken as often as all of them together.
    copies = mixing.mix_files(files).groupBy("file_id").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    rows = docs.select(key.alias("file_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = rows.join(copies, "file_id").dropDuplicates(["file_id"])
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    prepared(spark)
    packed = packing.pack_files(as_files(docs), tokenizer_path("word_bpe_49k.json"))
    return packed.withColumnRenamed("file_id", "doc_id")


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("pack", pack)]

# The field and the tokenizer have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
