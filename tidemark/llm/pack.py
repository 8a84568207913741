"""Packing: concatenate all documents' ids and cut them into fixed windows.

Pass 1 encodes every partition and writes its ids with each document's place
in the partition. The partitions' token totals, summed over the partitions
before, give global offsets. Pass 2 cuts every stored batch at the window
borders: a window that lies whole in a batch is finished there; the two parts
of a window at a batch's edges are boundary records, which a grouping by
window (at most ``length`` ids a group) puts together.

Null and empty texts are documents of the end id alone. Repeated rows are
documents of their own. An empty table gives no sequences. Columns beyond
``doc_id`` and ``text`` are ignored. The last window alone is padded, with
``pad_id`` up to ``length``, unless its length is a power of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import binary_array, pick, remove_folder, run_folder, saved, ship_package
from tidemark.llm.tokens import codec

_TOKENS = "part int, place long, doc_id long, n_tokens long, ids binary"
_PIECE = pa.struct(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64()), ("doc_tokens", pa.int64())]
)
_WINDOW = (
    "sequence_id long, offset long, n_tokens long, ids binary,"
    " pieces array<struct<doc_id long, start long, length long, offset long, doc_tokens long>>"
)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = 2048, pad_id: int = 0, name: str = "pack"
) -> DataFrame:
    """Sequences of ``length`` ids: sequence_id, n_tokens, padded_to, ids
    (little-endian unsigned 32-bit, padded), pieces (doc_id, start and length
    in the document, offset in the sequence, doc_tokens)."""
    spark = docs.sparkSession
    ship_package(spark)
    folder = run_folder(spark, name)
    tokens = saved(
        pick(docs, "doc_id", "text").mapInArrow(_encode(tokenizer_path, end_id), _TOKENS), f"{folder}/tokens"
    )
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per input partition
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # Broadcast: 16 bytes for each input partition.
    placed = tokens.join(F.broadcast(offsets), "part").select("doc_id", (F.col("base") + F.col("place")).alias("at"), "ids")
    cut = saved(placed.mapInArrow(_cut(length), _WINDOW), f"{folder}/windows")
    remove_folder(spark, f"{folder}/tokens")
    return _finished(cut, length, pad_id)


def _finished(cut: DataFrame, length: int, pad_id: int) -> DataFrame:
    whole = cut.filter(F.col("n_tokens") == length).select("sequence_id", "n_tokens", "ids", "pieces")
    parts = (
        cut.filter(F.col("n_tokens") < length)
        .groupBy("sequence_id")
        .agg(F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids", "pieces"))).alias("parts"))
        .select(
            "sequence_id",
            "n_tokens",
            F.aggregate("parts", F.lit(b""), lambda so_far, x: F.concat(so_far, x["ids"])).alias("ids"),
            F.flatten(F.transform("parts", lambda x: x["pieces"])).alias("pieces"),
        )
    )
    n = F.col("n_tokens")
    padded_to = F.when(n.bitwiseAND(n - 1) == 0, n).otherwise(length)
    filler = F.lit(int(pad_id).to_bytes(4, "little"))
    return whole.unionByName(parts).select(
        "sequence_id",
        "n_tokens",
        padded_to.alias("padded_to"),
        F.when(n == padded_to, F.col("ids")).otherwise(F.rpad("ids", (padded_to * 4).cast("int"), filler)).alias("ids"),
        "pieces",
    )


def sequence_pieces(sequences: DataFrame) -> DataFrame:
    """One row per piece of a document, its crc32 taken from the sequence."""
    return sequences.select("sequence_id", "ids", F.explode("pieces").alias("p")).select(
        F.col("p.doc_id").alias("doc_id"),
        F.col("p.start").alias("start"),
        F.col("p.length").alias("length"),
        F.crc32(
            F.substring("ids", (F.col("p.offset") * 4 + 1).cast("int"), (F.col("p.length") * 4).cast("int"))
        ).alias("ids_crc32"),
        F.col("p.doc_tokens").alias("doc_tokens"),
        "sequence_id",
        F.col("p.offset").alias("offset"),
    )


def with_end_id(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` behind each document's ids."""
    return np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1


def _encode(tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, place = codec(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, counts = with_end_id(*tokenizer.encode(batch.column("text")), end_id)
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(counts), part, np.int32)),
                    pa.array(place + ends - counts),
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(counts),
                    binary_array(ids, counts),
                ],
                ["part", "place", "doc_id", "n_tokens", "ids"],
            )
            place += int(ends[-1]) if len(ends) else 0

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy()
            edges = np.flatnonzero(np.diff(at) < 0) + 1  # the next input partition's documents
            for a, b in zip([0, *edges], [*edges, len(at)], strict=True):
                if b > a:
                    yield _windows(batch.slice(a, b - a), length)

    return run


def _windows(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """The (parts of) windows that a run of documents covers. ``at`` grows
    along the run, but may leave gaps where a reader skips to another split."""
    at = batch.column("at").to_numpy()
    blobs = batch.column("ids")
    size = np.asarray(blobs.buffers()[1]).view(np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
    ids = np.frombuffer(blobs.buffers()[2], np.uint32)[size[0] // 4 : size[-1] // 4]
    counts = np.diff(size) // 4
    local = np.cumsum(counts) - counts
    # A piece begins at every document's start and at every window's border.
    first, last = at // length, (at + counts - 1) // length
    n = last - first + 1
    doc = np.repeat(np.arange(len(at)), n)
    window = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.maximum(window * length, at[doc])
    end = np.minimum((window + 1) * length, at[doc] + counts[doc])
    # Rows: runs of pieces of one window without a gap.
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(window) != 0) | (begin[1:] != end[:-1])
    row = np.flatnonzero(new)
    row_end = np.append(row[1:], len(doc))
    lengths = end - begin
    doc_ids = batch.column("doc_id").take(pa.array(doc))
    pieces = pa.StructArray.from_arrays(
        [
            doc_ids,
            pa.array(begin - at[doc]),
            pa.array(lengths),
            pa.array(begin - window * length),
            pa.array(counts[doc]),
        ],
        fields=list(_PIECE),
    )
    totals = np.add.reduceat(lengths, row) if len(row) else lengths
    return pa.RecordBatch.from_arrays(
        [
            pa.array(window[row]),
            pa.array(begin[row] - window[row] * length),
            pa.array(totals),
            binary_array(ids, totals),
            pa.ListArray.from_arrays(pa.array(np.append(row, row_end[-1:]).astype(np.int32)), pieces),
        ],
        ["sequence_id", "offset", "n_tokens", "ids", "pieces"],
    )
