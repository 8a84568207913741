import math

import duckdb
from pyspark.sql import functions as F

from llm.helpers import awkward, awkward_rows, empty
from tidemark.llm import mix, queries, shard


def test_shards(spark):
    docs = awkward(spark)
    rows = shard.shuffle_into_shards(docs, shards=4, bucket_bytes=3_000).collect()
    again = shard.shuffle_into_shards(docs.repartition(5), shards=4, bucket_bytes=3_000).collect()
    assert len(rows) == len(awkward_rows())
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    place = lambda found: sorted((r.doc_id or 0, r.text or "", r.shard, r.slot) for r in found)
    assert place(rows) == place(again)
    assert all(r.grown_shard in (r.shard, 4) for r in rows)
    by_id = {}
    for r in rows:
        assert by_id.setdefault(r.doc_id, r.shard) == r.shard
        assert (r.row.c0, r.row.c1) == (r.doc_id, r.text)
    assert shard.shuffle_into_shards(empty(spark)).count() == 0


def test_fisher_yates_is_a_seeded_permutation():
    a = shard.fisher_yates(500, 3, 1)
    assert sorted(a) == list(range(500)) and a.tolist() == shard.fisher_yates(500, 3, 1).tolist()
    assert a.tolist() != shard.fisher_yates(500, 3, 2).tolist() and shard.fisher_yates(0, 1, 1).tolist() == []
    firsts = [int(shard.fisher_yates(4, 3, b)[0]) for b in range(2000)]
    assert all(400 < firsts.count(i) < 600 for i in range(4))


def test_shards_are_even(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    counts = [r["count"] for r in shard.shuffle_into_shards(docs).groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) < 1.1 * min(counts)


def mixture(spark, docs):
    plan = mix.plan_mix(docs)
    return plan, mix.taken_words(plan).toPandas()


def test_mix_equals_sql(spark):
    docs = awkward(spark, clash=False)
    _, got = mixture(spark, docs)
    documents = docs.toArrow()  # noqa: F841 - read by DuckDB
    want = duckdb.sql(queries.OP3_SQL).df()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, got.fillna(-1)[[*key, "source_size", "target"]].values.tolist())) == sorted(
        map(tuple, want.fillna(-1)[[*key, "source_size", "target"]].values.tolist())
    )


def test_mix_targets_and_hot_source(spark):
    docs = spark.range(6_000).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
    )
    plan, rows = mixture(spark, docs)
    sources = plan.sources.toPandas()
    assert abs(sources.target.sum() - 1.5 * sources.source_size.sum()) < 1e-6 * sources.target.sum()
    assert (sources.target <= 2 * sources.source_size).all() and (rows.taken <= 2 * rows["size"]).all()
    assert ((rows.groupby("source_size").taken.sum() - rows.groupby("source_size").target.first()).abs() <= 25).all()
    copies = rows[rows["size"] > 0].assign(n=lambda x: x.taken // x["size"]).groupby("source_size").n.agg(["min", "max"])
    assert ((copies["max"] - copies["min"]) <= 1).all()  # nested: whole repeats, and one more below the threshold
    again = mixture(spark, docs.repartition(7))[1]
    assert rows.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert mix.mixed(docs, plan).count() >= (rows.taken > 0).sum()


def test_mixed_keeps_columns(spark):
    docs = awkward(spark)
    plan, rows = mixture(spark, docs)
    out = mix.mixed(docs, plan)
    assert out.columns == docs.columns
    words = sum(len((r[1] or "").split(" ")) for r in out.collect())
    assert math.isclose(words, rows.taken.sum(), rel_tol=0.05)
    assert mixture(spark, empty(spark))[1].empty


def hot_rows(spark, n=3_000):
    """A third of all rows are one row."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("t "), F.col("id"))).otherwise(F.repeat(F.lit("same "), 20)).alias("text"),
        F.lit("en").alias("lang"),
        F.lit("s").alias("source"),
    )


def test_no_bucket_takes_all_copies(spark):
    docs = hot_rows(spark)
    rows = shard.shuffle_into_shards(docs, shards=4, bucket_bytes=4_000).collect()
    assert sorted(r.doc_id or 0 for r in rows) == sorted(r.doc_id or 0 for r in docs.collect())
    hot = [r for r in rows if r.doc_id is None]
    assert len(hot) == 1_000 and len({r.shard for r in hot}) == 1
    (mine,) = {r.shard for r in hot}
    slots = sorted(r.slot for r in rows if r.shard == mine)
    assert slots == list(range(len(slots)))
    # Spread over the shard: its copies lie all over its slots.
    thirds = [sum(len(slots) * k // 3 <= r.slot < len(slots) * (k + 1) // 3 for r in hot) for k in range(3)]
    assert min(thirds) > 150
    again = shard.shuffle_into_shards(docs.repartition(7), shards=4, bucket_bytes=4_000).collect()
    place = lambda found: sorted((r.doc_id or 0, r.text, r.shard, r.slot) for r in found)
    assert place(rows) == place(again)


def test_mix_of_null_ids_and_copies(spark):
    """40 % of the rows have no doc_id, some rows are there many times."""
    docs = spark.range(5_000).select(
        F.when(F.col("id") % 5 > 1, F.col("id")).alias("doc_id"),
        F.concat(F.lit("w "), F.col("id") % 900, F.repeat(F.lit(" x"), (F.col("id") % 7).cast("int"))).alias("text"),
        F.concat(F.lit("s"), F.col("id") % 4).alias("source"),
    )
    docs = docs.unionByName(hot_rows(spark).select("doc_id", "text", "source").withColumn("source", F.lit("s9")))
    plan, rows = mixture(spark, docs)
    by_source = rows.groupby(["source_size", "target"]).taken.sum().reset_index()
    assert len(by_source) == 5 and ((by_source.taken - by_source.target).abs() <= 25).all(), by_source
    assert (rows.taken <= 2 * rows["size"]).all()
    again = mixture(spark, docs.repartition(9))[1]
    key = lambda x: sorted(zip(x.doc_id.fillna(-1), x["size"], x.source_size, x.taken, strict=True))
    assert key(rows) == key(again)
    documents = docs.toArrow()  # noqa: F841 - read by DuckDB
    assert key(duckdb.sql(queries.OP3_SQL).df()) == key(rows)
    words = F.size(F.split(F.trim("text"), "\\s+"))
    assert mix.mixed(docs, plan).agg(F.sum(words)).first()[0] == rows.taken.sum()
