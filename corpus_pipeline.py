"""The corpus pipeline: documents to packed sequences in five stages.

Each stage is one operator of ``tidemark.llm`` over all that the stage before
kept. The first four return the columns of documents, the last the pieces of
the packed sequences. What the operators say of nulls, empty and long texts,
repeated rows, empty tables and further columns holds for their stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, mix, pack, simhash, toxicity
from tidemark.llm.common import documents, nested, remove_folder, run_folder, saved, ship_package, unnested


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    ship_package(spark)
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = toxicity.score_column(machine, spark)
    scored = nested(docs, "text").withColumn("score", score("text"))
    return unnested(scored.filter(F.col("score") < toxicity.PREDICT_AT), docs)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows with enough confidence."""
    ship_package(spark)
    predict = langid.predict_column(langid.train(docs), spark)
    predicted = nested(docs, "text").withColumn("p", predict("text"))
    return unnested(predicted.filter(~F.col("p.rejected")), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies."""
    return simhash.one_of_each(docs, shingle=3, radius=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mix.mixed(docs, mix.plan_mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack.sequence_pieces(pack.pack_documents(docs, path, end_id=1, length=2048))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages train models, hash and tokenise, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's result is written as Parquet and reread as the next one's
    documents; it goes when the next one's is written."""
    folder = run_folder(spark, "pipeline")
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"{folder}/{name}")
        if before is not None:
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return docs
