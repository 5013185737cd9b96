"""Token counts with a digest cache."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from importlib.metadata import version
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pageflow.llm.scratch import stored

CACHE = "tokenizer string, content string, n_tokens long"


def load_tokenizer(path: str) -> Callable[[list[str]], list[int]]:
    """A function giving the token count of each text, without begin, end or special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    words = Tokenizer.from_file(path)
    words.no_truncation()
    words.no_padding()
    return lambda texts: [len(e.ids) for e in words.encode_batch(texts, add_special_tokens=False)]


def tokenizer_digest(path: str) -> str:
    """Digest of the vocabulary file and of the library version that reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    made = hashlib.sha256(f"{library} {version(library)}\n".encode())
    made.update(Path(path).read_bytes())
    return made.hexdigest()


def normalised(text: Column) -> Column:
    """The content that is digested and encoded: null is the empty text. Any further folding
    (case, Unicode forms, spaces) would change counts, so there is none."""
    return F.coalesce(text, F.lit(""))


def read_cache(spark, path: str) -> DataFrame:
    """Stored counts; a cache that does not exist yet is empty."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)


def encode_misses(misses: DataFrame, tokenizer: str) -> DataFrame:
    """``content, n_tokens`` of rows ``content, text``, encoded in small batches by Python workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load_tokenizer(tokenizer)
        for batch in batches:
            texts, counts = batch.column("text"), []
            for start in range(0, len(texts), 64):
                counts += count(texts.slice(start, 64).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array(counts, pa.int64())], names=["content", "n_tokens"])

    return misses.select("content", "text").mapInArrow(run, "content string, n_tokens long")


def count_tokens(files: DataFrame, tokenizer: str, cache: str, limit: int = 4096) -> DataFrame:
    """Tokens of every file's whole text, encoding only what ``cache`` does not hold.

    ``files`` has ``file_id, text``; ``tokenizer`` is the path of a vocabulary file that every
    worker can read (``.json`` or ``.model``); ``cache`` is a Parquet folder of ``tokenizer,
    content, n_tokens`` shared by all runs. Contents and tokenizer version are digested
    (SHA-256), joined to the cache, one text of each missing digest is encoded, and the new
    counts are appended to the cache, from which the answer is read. A run that fails before
    its append leaves the cache as it was; two runs that race may store a digest twice, with
    the same count, and readers take one.

    Returns ``file_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens). Null text
    is empty: 0 bytes, 0 tokens. Rows are counted one by one, repeated ids included; an empty
    table gives an empty result; other columns are not read. Texts of any length are read whole,
    64 at a time. A digest shared by a third of all rows is reduced before the exchange, and its
    join side is one row.
    """
    spark = files.sparkSession
    key = tokenizer_digest(tokenizer)
    text = normalised(F.col("text"))
    digest = F.sha2(text, 256)
    heads = stored(files.select("file_id", digest.alias("content"), F.octet_length(text).cast("long").alias("n_bytes")),
                   "digests")
    known = read_cache(spark, cache).filter(F.col("tokenizer") == key).select("content")
    missing = heads.select("content").distinct().join(known, "content", "left_anti")
    # Copies go first: of a text that many rows share, each task sends one on.
    texts = files.select(digest.alias("content"), text.alias("text")).dropDuplicates(["content"])
    new = encode_misses(texts.join(missing, "content", "left_semi"), tokenizer)
    new.select(F.lit(key).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).filter(F.col("tokenizer") == key).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return heads.join(counts, "content").select(
        "file_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
