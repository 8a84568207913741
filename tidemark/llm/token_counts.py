"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content and the digest of the
tokenizer file. Keys that the cache holds are dropped first, by digests alone,
so a warm cache spares the texts the shuffle; the rest is reduced to one text a
key (partially before the shuffle, so a group of copies costs one row per
partition), the distinct misses are encoded, and their counts are appended to
the cache. A key that the cache has twice (of a writer that ran again) counts
once. Every document then takes its count from the cache; a
key that many documents share is split by Spark's skewed-join rule.

Normalisation only turns null into the empty text: whatever else it changed
could change a count. Empty texts have 0 tokens. Repeated rows each get a row.
Texts of any length are encoded whole, a long one by itself. An empty table
gives no rows. Columns beyond ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.llm.common import pick, run_folder, saved, ship_package, small, text_bytes
from tidemark.llm.tokens import codec, file_digest

_CACHE = "digest binary, version string, n_tokens long"


def normalised(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an absent folder is an empty cache."""
    try:
        return spark.read.schema(_CACHE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _CACHE)


def append_misses(docs: DataFrame, tokenizer_path: str, cache_path: str) -> str:
    """Count the distinct texts that the cache lacks; gives the version."""
    ship_package(docs.sparkSession)
    version = file_digest(tokenizer_path)
    stored = read_cache(docs.sparkSession, cache_path).filter(F.col("version") == version).select("digest")
    texts = pick(docs, "text").select(normalised(F.col("text")).alias("text"))
    keyed = texts.select(_digest(F.col("text")).alias("digest"), "text")
    if not stored.isEmpty():
        missing = saved(keyed.select("digest").distinct().join(stored, "digest", "left_anti"), run_folder(docs.sparkSession, "token-misses"))
        keyed = keyed.join(small(missing, missing.count()), "digest", "left_semi")
    misses = keyed.dropDuplicates(["digest"])
    counted = misses.mapInArrow(_count(tokenizer_path, version), _CACHE)
    counted.write.mode("append").parquet(cache_path)
    return version


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens. One writer at a time."""
    version = append_misses(docs, tokenizer_path, cache_path)
    counts = read_cache(docs.sparkSession, cache_path).filter(F.col("version") == version)
    counts = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    keyed = pick(docs, "doc_id", "text").select(
        "doc_id", text_bytes(F.col("text")).alias("n_bytes"), _digest(normalised(F.col("text"))).alias("digest")
    )
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _count(tokenizer_path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = codec(tokenizer_path)
        for batch in batches:
            counts = tokenizer.count(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())],
                ["digest", "version", "n_tokens"],
            )

    return run
