"""Codecs, packing, token counts and Arrow files against the libraries."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.helpers import awkward, awkward_rows, empty
from tidemark.llm import arrow_tokens, pack, token_counts
from tidemark.llm.common import run_folder
from tidemark.llm.tokens import Codec, codec

ODD = [
    "", None, " ", "a", " a", "a ", "a  b", "a\nb", "a\n b", "a \nb", "x<|endoftext|>y z", "foo <|endoftext|> bar",
    "it's we'll don't 12 a1b2", "é e", "a ▁b c▁ d", "日本 語 テキスト", "\t\ta b\x0bc", "A B c", "😀 x😀", "a\x00b c",
    "<s> </s>", "a.\n\nb", "...!!! ---", "_a_ b_c", "ÀÉ ÿ ß.,x", "x'y 'tis a' b's", "µ ª º × ÷ a", "İstanbul ẞ ΑΣ", "<| a<b",
]


def library(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: model.encode(text or "")
    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_codec_equals_library(name, spark):
    sample = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).toArrow()["text"]
    texts = [*ODD, *[r[1] for r in awkward_rows()], *sample.to_pylist()]
    ids, counts = codec(public_tokenizers.path(name)).encode(pa.array(texts, pa.string()))
    ends, plain = np.cumsum(counts), library(name)
    for text, a, b in zip(texts, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == plain(text), repr(text)


def test_codec_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr("tidemark.llm.tokens.CACHE_ENTRIES", 3)
    monkeypatch.setattr("tidemark.llm.tokens.CACHE_WORDS", 2)
    monkeypatch.setattr("tidemark.llm.tokens.STEP_BYTES", 8)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer: Codec = type(codec(path))(path)
    texts = [r[1] for r in awkward_rows() if r[1] is None or len(r[1]) < 500]
    ids, counts = tokenizer.encode(pa.array(texts, pa.string()))
    plain = library("byte_bpe_50k.json")
    assert ids.tolist() == [i for t in texts for i in plain(t)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_round_trip(spark):
    plain = library("word_bpe_49k.json")
    docs = awkward(spark)
    sequences = pack.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=256)
    rows = sequences.collect()
    total = sum(len(plain(r[1])) + 1 for r in awkward_rows())
    assert sum(r.n_tokens for r in rows) == total and {r.sequence_id for r in rows} == set(range(-(-total // 256)))
    full = [r.n_tokens for r in rows if r.sequence_id < total // 256]
    assert full == [256] * (total // 256)
    found = {}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        n = r.n_tokens
        assert r.padded_to == len(ids) == (n if n & (n - 1) == 0 else 256) and not ids[n:].any()
        assert [p.offset for p in r.pieces] == (np.cumsum([p.length for p in r.pieces]) - [p.length for p in r.pieces]).tolist()
        for p in r.pieces:
            found.setdefault(p.doc_id, []).append((p.start, ids[p.offset : p.offset + p.length].tolist(), p.doc_tokens))
    want = {}
    for doc_id, text, *_ in awkward_rows():
        want.setdefault(doc_id, []).extend([*plain(text), 1])
    got = {d: [i for _, ids, _ in sorted(x) for i in ids] for d, x in found.items()}
    assert {d: len(x) for d, x in got.items()} == {d: len(x) for d, x in want.items()}
    assert all(got[d] == want[d] for d in want if d != 6)  # 6 is there twice: its pieces have equal starts
    pieces = pack.sequence_pieces(sequences).filter("doc_id = 4").orderBy("start").collect()
    assert [p.ids_crc32 for p in pieces] == [crc(ids) for _, ids, _ in sorted(found[4])]


def test_packing_of_nothing(spark):
    assert pack.pack_documents(empty(spark), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_padding_at_a_power_of_two(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")  # 3 ids and the end id
    (row,) = pack.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), length=2048).collect()
    assert (row.n_tokens, row.padded_to, len(row.ids)) == (4, 4, 16)


def test_token_counts_and_cache(spark, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    cache, plain = run_folder(spark, "test-cache"), library("piece_bpe_32k.model")
    docs = awkward(spark)
    rows = token_counts.count_tokens(docs.limit(9), path, cache).collect()
    first = spark.read.parquet(cache).count()
    rows = token_counts.count_tokens(docs, path, cache).collect()
    want = sorted((r[0] or 0, len((r[1] or "").encode()), len(plain(r[1]))) for r in awkward_rows())
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == want
    distinct = len({r[1] or "" for r in awkward_rows()})
    assert first < spark.read.parquet(cache).count() == distinct  # misses alone were appended
    token_counts.count_tokens(docs, path, cache).collect()
    assert spark.read.parquet(cache).count() == distinct
    assert token_counts.count_tokens(empty(spark), path, run_folder(spark, "test-cache")).count() == 0


def test_a_cache_with_repeats_and_a_warm_one(spark, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    cache = run_folder(spark, "test-cache")
    docs = awkward(spark)
    first = token_counts.count_tokens(docs, path, cache).collect()
    spark.read.parquet(cache).write.mode("append").parquet(cache + "-twice")
    spark.read.parquet(cache).write.mode("append").parquet(cache + "-twice")
    stored = spark.read.parquet(cache + "-twice").count()
    again = token_counts.count_tokens(docs, path, cache + "-twice").collect()
    order = lambda rows: sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows)
    assert order(again) == order(first) and spark.read.parquet(cache + "-twice").count() == stored


def test_equal_rows_are_split_over_shards(spark):
    """A third of all rows are one row; no shard exceeds its bound much."""
    docs = spark.range(3_000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(7).alias("doc_id"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("t "), F.col("id"))).otherwise(F.lit("the same text")).alias("text"),
    )
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = run_folder(spark, "test-arrow")
    shards = arrow_tokens.write_sequences(docs, folder, path, length=64, shard_bytes=3_000)
    assert shards.count() >= 8 and shards.agg(F.max("n_docs")).first()[0] < 800
    rows = sorted(arrow_tokens.read_documents(shards, folder).collect(), key=lambda r: r.start)
    assert len(rows) == 3_000 and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert [r.start for r in rows] == [int(x) for x in np.cumsum([0, *[r.n_tokens for r in rows]])[:-1]]


def test_arrow_files_round_trip(spark):
    path, plain = public_tokenizers.path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    folder = run_folder(spark, "test-arrow")
    shards = arrow_tokens.write_sequences(awkward(spark), folder, path, end_id=0, length=64, shard_bytes=20_000)
    assert shards.count() > 1
    rows = arrow_tokens.read_documents(shards, folder).collect()
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:i]) for i in range(len(ordered))]
    ids = [r.doc_id for r in ordered if r.doc_id is not None]
    assert ids == sorted(ids)
    want = sorted((d or 0, len(plain(t)) + 1, crc([*plain(t), 0])) for d, t, *_ in awkward_rows())
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == want
    # Any sequence of a shard, by its number: the mask ends with the shard's ids.
    shard = shards.orderBy("shard").first()
    last, mask = arrow_tokens.sequence(folder, shard.shard, shard.n_sequences - 1)
    assert len(last) == 64 and mask.sum() == shard.n_tokens - 64 * (shard.n_sequences - 1)
    empty_folder = run_folder(spark, "test-arrow")
    none = arrow_tokens.write_sequences(empty(spark), empty_folder, path)
    assert arrow_tokens.read_documents(none, empty_folder).count() == 0


def test_long_batches_keep_sequence_numbers(spark, monkeypatch):
    monkeypatch.setattr(arrow_tokens, "BATCH_ROWS", 4)
    docs = spark.createDataFrame([(i, "word " * (37 * i % 90 + 1)) for i in range(60)], "doc_id long, text string")
    folder = run_folder(spark, "test-arrow")
    path, plain = public_tokenizers.path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    task = arrow_tokens._write(folder, path, 0, 16)
    monkeypatch.setattr(arrow_tokens.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    (row,) = list(task(iter(docs.orderBy("doc_id").toArrow().to_batches(max_chunksize=7))))
    want = [i for r in docs.orderBy("doc_id").collect() for i in [*plain(r.text), 0]]
    got = [arrow_tokens.sequence(folder, 0, i) for i in range(row["n_sequences"][0].as_py())]
    assert [int(x) for ids, mask in got for x in ids[mask]] == want
