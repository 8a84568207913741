"""Token ids in Arrow files of equal-length sequences.

Documents are dealt out by ranges of doc_id and sorted, so shard files in
name order hold all ids in ascending doc_id order. A shard is two Arrow files
(the stream format with a footer): ``ids-N.arrow`` has record batches of the
fixed-size lists ``input_ids`` (16 bits an id where the vocabulary allows, else
32) and ``mask`` (booleans), so any sequence is a zero-copy slice of a mapped
file; ``docs-N.arrow`` has each document's start in the
shard and its number of ids. Only a shard's last sequence is padded (mask 0).

Files are written by the tasks with pyarrow's file systems into the shared
folder: under a name of the attempt first, then renamed, so a repeated task
replaces its own file with equal content.

Null and empty texts are documents of the end id alone. Documents with equal
doc_id lie in the order of a hash of their texts, equal rows in any order, and a
group of them may go on in the next shard. Texts of any length are encoded whole.
An empty table gives no files and no
rows. Columns beyond ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ceil_div, pick, saved, ship_package, text_bytes
from tidemark.llm.pack import with_end_id
from tidemark.llm.tokens import codec

#: Bytes of text of a shard, and sequences of a record batch.
SHARD_BYTES = 32 << 20
BATCH_ROWS = 512

_SHARD = "shard int, n_docs long, n_tokens long, n_sequences long"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def write_sequences(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, length: int = 2048, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Write the files; gives one row per shard: shard, n_docs, n_tokens,
    n_sequences."""
    ship_package(docs.sparkSession)
    rows = pick(docs, "doc_id", "text")
    total = rows.agg(F.sum(text_bytes(F.col("text")))).first()[0] or 0
    # The last key is a row's number, so that rows equal in the others can be split too.
    order = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    ordered = rows.repartitionByRange(ceil_div(total, shard_bytes), *order).sortWithinPartitions(*order[:2])
    return saved(ordered.mapInArrow(_write(folder, tokenizer_path, end_id, length), _SHARD), f"{folder}/shards")


def read_documents(shards: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard file
    listed = shards.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    n = shards.count()
    return listed.repartition(ceil_div(n, 1), "shard").mapInArrow(
        _read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def sequence(folder: str, shard: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence, without reading the others."""
    store, base = _store(folder)
    reader = pa.ipc.open_file(_opened(store, f"{base}/ids-{shard:06d}.arrow"))
    batch = reader.get_batch(row // BATCH_ROWS)
    return tuple(_values(batch.column(c), row % BATCH_ROWS, 1) for c in ("input_ids", "mask"))


def _values(lists: pa.FixedSizeListArray, first: int, n: int) -> np.ndarray:
    size = lists.type.list_size
    return lists.values.slice((lists.offset + first) * size, n * size).to_numpy(zero_copy_only=False)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder given as a path or as a URI."""
    path = folder.removeprefix("file:")
    return fs.FileSystem.from_uri("file:///" + path.lstrip("/") if path.startswith("/") else folder)


def _opened(store: fs.FileSystem, path: str):
    return pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)


def _write(folder: str, tokenizer_path: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, base = _store(folder)
        names = {kind: (f"{base}/.{kind}-{shard:06d}-{attempt}", f"{base}/{kind}-{shard:06d}.arrow") for kind in ("ids", "docs")}
        tokenizer = codec(tokenizer_path)
        id_type = pa.uint16() if max(tokenizer.vocabulary, end_id + 1) <= 1 << 16 else pa.uint32()
        lists = pa.schema([("input_ids", pa.list_(id_type, length)), ("mask", pa.list_(pa.bool_(), length))])
        n_docs = n_tokens = n_sequences = 0
        rest = np.zeros(0, np.uint32)
        writers: list = []

        def put(ids: np.ndarray, n: int) -> None:
            """Write whole sequences, of which the first n ids are real."""
            for a in range(0, len(ids), BATCH_ROWS * length):
                part = ids[a : a + BATCH_ROWS * length]
                real = np.arange(a, a + len(part)) < n
                columns = [pa.FixedSizeListArray.from_arrays(x, length) for x in (pa.array(part, id_type), pa.array(real))]
                writers[0].write_batch(pa.RecordBatch.from_arrays(columns, schema=lists))

        sinks: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if not writers:
                store.create_dir(base, recursive=True)
                sinks += [store.open_output_stream(names[k][0]) for k in ("ids", "docs")]
                writers += [pa.ipc.new_file(s, x) for s, x in zip(sinks, (lists, _DOCS), strict=True)]
            ids, counts = with_end_id(*tokenizer.encode(batch.column("text")), end_id)
            starts = n_tokens + np.cumsum(counts) - counts
            writers[1].write_batch(
                pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(starts), pa.array(counts)], schema=_DOCS)
            )
            n_docs, n_tokens = n_docs + len(counts), n_tokens + len(ids)
            rest = np.concatenate([rest, ids])
            # Whole batches of sequences only, so that a sequence's batch follows from its number.
            full = len(rest) // (BATCH_ROWS * length) * (BATCH_ROWS * length)
            put(rest[:full], full)
            n_sequences += full // length
            rest = rest[full:]
        if not writers:
            return
        padded = np.zeros(-(-len(rest) // length) * length, np.uint32)
        padded[: len(rest)] = rest
        put(padded, len(rest))
        n_sequences += len(padded) // length
        for w in writers:
            w.close()
        for s in sinks:
            s.close()
        for part, name in names.values():
            store.move(part, name)
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), *[pa.array([x], pa.int64()) for x in (n_docs, n_tokens, n_sequences)]],
            ["shard", "n_docs", "n_tokens", "n_sequences"],
        )

    return run


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            for shard, first in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist(), strict=True):
                ids = pa.ipc.open_file(_opened(store, f"{base}/ids-{shard:06d}.arrow"))
                docs = pa.ipc.open_file(_opened(store, f"{base}/docs-{shard:06d}.arrow"))
                stream = _Ids(ids)
                for i in range(docs.num_record_batches):
                    part = docs.get_batch(i)
                    crcs = [stream.crc32(n) for n in part.column("n_tokens").to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id"),
                            pa.array(part.column("start").to_numpy() + first),
                            part.column("n_tokens"),
                            pa.array(crcs, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


class _Ids:
    """The real ids of a file, taken off in order, one record batch held."""

    def __init__(self, reader) -> None:
        self._reader, self._next, self._held, self._at = reader, 0, np.zeros(0, np.uint32), 0

    def crc32(self, n: int) -> int:
        crc = 0
        while n:
            if self._at == len(self._held):
                batch = self._reader.get_batch(self._next)
                ids, mask = (_values(batch.column(c), 0, batch.num_rows) for c in ("input_ids", "mask"))
                self._held, self._at, self._next = ids if mask[-1] else ids[mask], 0, self._next + 1
            taken = self._held[self._at : self._at + n]
            crc = zlib.crc32(np.ascontiguousarray(taken, "<u4"), crc)
            self._at, n = self._at + len(taken), n - len(taken)
        return crc
