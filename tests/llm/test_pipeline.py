import random

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from llm.helpers import components, empty
from tidemark.llm import queries, simhash

SF = "/root/testdata/sf0.01"


def kept_after(spark, n, docs=None):
    docs = docs or spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:n]:
        docs = stage(spark, docs, SF)
    return docs


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 AS score", "'x' AS row").cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for i in range(3):
        before, docs = docs, corpus_pipeline.STAGES[i][1](spark, docs, SF).cache()
        assert docs.columns == before.columns and docs.exceptAll(before).isEmpty()
        if i == 0:
            toxic = docs.join(labels.filter("toxic = 1"), "doc_id").count()
            clean = docs.join(labels.filter("toxic = 0"), "doc_id").count()
            assert toxic < 0.3 * labels.filter("toxic = 1").count() and clean > 0.97 * labels.filter("toxic = 0").count()
        if i == 1:
            assert docs.count() >= 0.99 * before.count()
        if i == 2:
            groups = queries.simhash.near_duplicates(before)
            assert docs.count() == groups.select("component_id").distinct().count()
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.distinct().exceptAll(docs.distinct()).isEmpty()


def test_pipeline_packs_every_kept_token(spark):
    pieces = corpus_pipeline.run(spark, SF).toPandas()
    assert pieces.length.sum() == pieces.groupby("sequence_id").length.sum().sum()
    full = pieces.groupby("sequence_id").length.sum().sort_index()
    assert (full.iloc[:-1] == 2048).all()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    doc = int(pieces.doc_id.iloc[0])
    text = spark.read.parquet(f"{SF}/documents.parquet").filter(f"doc_id = {doc}").first().text
    assert (pieces[pieces.doc_id == doc].doc_tokens == len(plain.encode(text, add_special_tokens=False).ids) + 1).all()


def linked_texts(n, seed):
    """Texts whose fingerprints differ, each within the radius of the first."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10_000)}" for _ in range(400)]
    found, prints = [" ".join(words)], [simhash.fingerprints(pa.array([" ".join(words)]))[0]]
    while len(found) < n:
        at = rng.randrange(len(words))
        text = " ".join([*words[:at], "other", *words[at + 1 :]])
        mark = simhash.fingerprints(pa.array([text]))[0]
        if mark not in prints and (mark ^ prints[0]).bit_count() <= simhash.RADIUS:
            found.append(text)
            prints.append(mark)
    return found


def test_one_row_of_each_near_duplicate_group_stays(spark):
    nulls, same, mixed = (linked_texts(3, seed) for seed in (1, 2, 3))
    rows = [(None, t, "x") for t in nulls for _ in range(4)]  # no id at all, copies and linked texts
    rows += [(7, t, str(k)) for t in same for k in (1, 1, 2)]  # one id, repeated rows, several texts
    rows += [(None, mixed[0], "x"), (9, mixed[1], "x"), (9, mixed[1], "x"), (8, mixed[2], "x")]
    rows += [(None, None, "x"), (None, "", "x"), (3, "", "x"), (11, "a text of its own", "x"), (11, "and one more such text", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    kept = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    prints = simhash.fingerprints(pa.array([r[1] for r in rows], pa.string()))
    group = components(prints, lambda a, b: (a ^ b).bit_count() <= simhash.RADIUS)
    assert len(kept) == len(set(group)) and set(kept) <= set(rows)
    least = {}
    for g, r in zip(group, rows, strict=True):
        least[g] = min(least.get(g, (True, 0)), (r[0] is None, r[0] or 0))
    assert sorted((d is None, d or 0) for d, _, _ in kept) == sorted(least.values())


def test_empty_documents_pass(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    got = entry.queries()[name](spark, SF)
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    place = [want.columns.index(c) for c in got.columns]
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=repr)


def test_every_operator_is_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
