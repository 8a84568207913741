"""Sharding: a two-pass external shuffle.

Pass 1 scatters every record by seeded hashes: the shard is the winner of a
rendezvous of doc_id with all shards (so one more shard takes records only
into itself), and within its shard a record falls into one of several buckets
that are sized to fit a task's memory. Pass 2 shuffles each bucket by
Fisher-Yates, seeded by the bucket, and writes it. A record's slot is its
place in its bucket plus the records of the shard's buckets before.

Records of one doc_id (null included) share a shard; records that repeat a
doc_id and text as well are numbered, and the number is hashed too, so a group
of copies of any size spreads over its shard's buckets. Null texts count 1 byte. An empty
table gives no rows. All input columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ceil_div, nested, run_folder, saved, ship_package, small, text_bytes, with_copies

LAW = "key"
#: Bytes of text of a bucket.
BUCKET_BYTES = 32 << 20


def shard_of(doc_id: Column, shards: int, seed: int) -> Column:
    """The shard whose hash with ``doc_id`` is the largest."""
    entries = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), doc_id).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return F.array_max(F.array(*entries))["s"]


def shuffle_into_shards(
    docs: DataFrame, shards: int = 8, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, folder: str | None = None
) -> DataFrame:
    """Write the shuffled shards; gives their rows: shard, slot, grown_shard
    (with one more shard) and ``row``, the struct of the input's columns in
    order, beside doc_id and text."""
    ship_package(docs.sparkSession)
    folder = folder or run_folder(docs.sparkSession, "shards")
    rows = nested(docs, "doc_id", "text").withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "text"))
    total = rows.agg(F.sum(text_bytes(F.col("text")) + 1)).first()[0] or 0
    per_shard = ceil_div(total, shards * bucket_bytes)
    key = F.when(F.col("copy") > 0, F.xxhash64(F.col("key"), "copy")).otherwise(F.col("key"))
    scattered = with_copies(rows, ["key"], folder).select(
        shard_of(F.col("doc_id"), shards, seed).alias("shard"),
        shard_of(F.col("doc_id"), shards + 1, seed).alias("grown_shard"),
        key.alias("key"),
        "row",
    ).withColumn("bucket", F.col("shard") * per_shard + F.pmod("key", F.lit(per_shard)).cast("int"))
    schema = scattered.withColumn("place", F.lit(0).cast("long")).schema
    # As many partitions as buckets, whatever the session's setting.
    shuffled = scattered.repartition(shards * per_shard, "bucket").groupBy("bucket").applyInArrow(_fisher_yates(seed), schema)
    written = saved(shuffled.drop("key"), f"{folder}/rows")
    counts = written.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    names = {n: f"row.c{i}" for i, n in reversed(list(enumerate(docs.columns))) if n in ("doc_id", "text")}
    return written.join(small(offsets, shards * per_shard), "bucket").select(
        F.col(names["doc_id"]).alias("doc_id"),
        F.col(names["text"]).alias("text"),
        "shard",
        (F.col("base") + F.col("place")).alias("slot"),
        "grown_shard",
        "row",
    )


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of ``range(n)``."""
    draws = np.random.Generator(np.random.Philox(key=[seed, bucket])).integers(0, np.arange(n, 0, -1))
    order = list(range(n))
    for i in range(n - 1):
        j = i + int(draws[i])
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def _fisher_yates(seed: int):
    def run(table: pa.Table) -> pa.Table:
        # First an order that doesn't depend on the tasks' arrival.
        table = table.take(pa.array(np.argsort(table["key"].to_numpy(), kind="stable")))
        table = table.take(pa.array(fisher_yates(table.num_rows, seed, table["bucket"][0].as_py())))
        return table.append_column("place", pa.array(np.arange(table.num_rows)))

    return run
