"""Document fingerprints from closed syncmers.

A k-mer of a text's UTF-8 bytes is an anchor if the smallest hash among its
inner s-mers lies at its first or last place. Whether a k-mer is an anchor
depends on its own bytes alone, so an edit moves anchors but changes only
those that overlap it: equal passages have equal anchors at equal distances,
whatever surrounds them. ``anchors`` gives them with their positions.

A text's fingerprint takes, for each of ``BINS`` ranges of the anchors' hash,
the smallest hash there (16 bits of it; ``EMPTY`` for none). The likeness of
two fingerprints is the share of equal ranges among those that either fills,
an estimate of the Jaccard similarity of the anchor sets.

A text that is not empty but has no anchor (shorter than k bytes, say) has its
whole content as its one anchor. The empty text (and null) has none: likeness
1 to another empty text, 0 to any other. Repeated rows are documents of their
own, equal doc_id in the order of a hash of their texts, null doc_id last. An
empty table gives no rows; a single document is its own next one. Columns
beyond ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import (
    byte_slices,
    ceil_div,
    pick,
    plain_strings,
    run_folder,
    saved,
    ship_package,
    string_bytes,
    text_bytes,
)

K, S = 16, 8
BINS, EMPTY = 64, 0xFFFF
#: Bytes of text of a range of doc_id that one task edits.
RANGE_BYTES = 16 << 20

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def syncmers(raw: np.ndarray, starts: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Closed syncmers of consecutive texts: the text, the place in it and the
    hash of each. ``starts`` has the end of the last text as well."""
    none = np.zeros(0, np.int64)
    if len(raw) < k:
        return none, none, none.view(np.uint64)
    # Polynomial hash of every s-mer, by doubling.
    h, width = raw.astype(np.uint64) + np.uint64(1), 1
    pieces: list[tuple[np.ndarray, int]] = []
    left = s
    while True:
        if left & 1:
            pieces.append((h, width))
        left >>= 1
        if not left:
            break
        h, width = h[:-width] * _power(width) + h[width:], width * 2
    inner, done = pieces[-1]
    for piece, wide in reversed(pieces[:-1]):
        n = len(inner) - wide
        inner = inner[:n] * _power(wide) + piece[done : done + n]
        done += wide
    order = _mixed(inner)
    lowest, width, window = order, 1, k - s + 1
    while width * 2 <= window:
        lowest, width = np.minimum(lowest[:-width], lowest[width:]), width * 2
    if width < window:
        lowest = np.minimum(lowest[: len(order) - window + 1], lowest[window - width :])
    n = len(lowest)
    at = np.flatnonzero((order[:n] == lowest) | (order[k - s : k - s + n] == lowest))
    text = np.searchsorted(starts, at, "right") - 1
    inside = at + k <= starts[text + 1]
    at, text = at[inside], text[inside]
    whole = inner[at] * _power(k - s) + inner[at + k - s]  # its s-mers at both ends
    return text, at - starts[text], _mixed(whole)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def sketches(texts: pa.Array, bins: int = BINS) -> np.ndarray:
    """A row of 16-bit values per text."""
    texts = plain_strings(texts)
    parts = [_sketch(texts.slice(a, b - a), bins) for a, b in byte_slices(texts, 2 << 20)]
    return np.concatenate(parts) if parts else np.zeros((0, bins), np.uint16)


def _sketch(texts: pa.Array, bins: int) -> np.ndarray:
    raw, starts = string_bytes(texts)
    text, _, hashes = syncmers(raw, starts)
    lone = np.flatnonzero((np.bincount(text, minlength=len(texts)) == 0) & (np.diff(starts) > 0))
    if len(lone):
        own = [xxhash.xxh64_intdigest(raw[starts[i] : starts[i + 1]].tobytes()) for i in lone]
        text, hashes = np.concatenate([text, lone]), np.concatenate([hashes, np.array(own, np.uint64)])
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = np.full(len(texts) * bins, most)
    cell = text * bins + (((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(low, cell, hashes)
    return np.where(low == most, EMPTY, (low & np.uint64(0xFFFF)) % np.uint64(EMPTY)).astype(np.uint16).reshape(-1, bins)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, 0 to 1."""
    filled = (a != EMPTY) | (b != EMPTY)
    n = filled.sum(axis=1)
    return np.where(n == 0, 1.0, ((a == b) & filled).sum(axis=1) / np.maximum(n, 1))


def edited(text: str, following: str) -> str:
    """The last third replaced by the start of the following text."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def anchors(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """(doc_id, position, hash) of every anchor; positions in bytes."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = plain_strings(batch.column("text"))
            for a, b in byte_slices(texts, 2 << 20):
                text, at, hashes = syncmers(*string_bytes(texts.slice(a, b - a)), k, s)
                ids = batch.column("doc_id").slice(a, b - a).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([ids, pa.array(at), pa.array(hashes.view(np.int64))], ["doc_id", "position", "hash"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, position long, hash long")


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per document, its fingerprint beside those of its edited text and of
    the next document in descending doc_id.

    Ranges of doc_id are sorted and walked once. A range's last document needs
    the first of the next range: both are handed on with their texts, joined
    by the range's number and edited in a second, small step."""
    ship_package(docs.sparkSession)
    folder = run_folder(docs.sparkSession, "syncmers")
    rows = pick(docs, "doc_id", "text")
    total = rows.agg(F.sum(text_bytes(F.col("text")))).first()[0] or 0
    order = [F.col("doc_id").desc(), F.xxhash64("text").desc()]
    # The last key of the ranges is a row's number, so that equal rows can be split too.
    parted = rows.repartitionByRange(ceil_div(total, range_bytes), *order, F.monotonically_increasing_id().desc())
    ranges = parted.sortWithinPartitions(*order)
    walked = saved(ranges.mapInArrow(_walk, f"part int, kind string, text string, {_RESULT}"), f"{folder}/walked")
    edges = walked.filter("kind <> 'done'")
    firsts = edges.filter("kind = 'first'").select("part", F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    # One row per range, without texts: which range comes next, the first after the last.
    by_part = Window.orderBy("part")
    following = firsts.select(
        "part",
        F.coalesce(
            F.lead("part").over(by_part), F.first("part").over(by_part.rowsBetween(Window.unboundedPreceding, 0))
        ).alias("next"),
    )
    lasts = edges.filter("kind = 'last'").select("part", "doc_id", "text").join(following, "part")
    pairs = lasts.join(firsts.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "next_text")
    done = walked.filter("kind = 'done'").select(*_NAMES)
    result = done.unionByName(pairs.mapInArrow(_edit_pairs, _RESULT))
    return result.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def _results(doc_ids: pa.Array, texts: list[str], following: list[str], own: np.ndarray, following_own: np.ndarray) -> list[pa.Array]:
    new = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    new_sketches = sketches(pa.array(new, pa.string()))
    return [
        doc_ids.cast(pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
        _binaries(own),
        _binaries(new_sketches),
        pa.array(likeness(own, new_sketches)),
        pa.array(likeness(own, following_own)),
    ]


def _binaries(rows: np.ndarray) -> pa.Array:
    return pa.array([r.astype(">u2").tobytes() for r in rows], pa.binary())


_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()

    def edge(kind: str, doc_id, text: str) -> pa.RecordBatch:
        given = {"part": pa.array([part], pa.int32()), "kind": pa.array([kind]), "text": pa.array([text])}
        given |= {"doc_id": pa.array([doc_id], pa.int64())}
        return _batch(given, 1)

    held = None  # the last document so far: id, text, sketch
    for batch in batches:
        for a, b in byte_slices(plain_strings(batch.column("text"))):
            array = plain_strings(batch.column("text")).slice(a, b - a)
            ids, texts, own = batch.column("doc_id").slice(a, b - a).cast(pa.int64()), array.to_pylist(), sketches(array)
            if held is None:
                yield edge("first", ids[0].as_py(), texts[0])
            else:
                ids, texts = pa.concat_arrays([held[0], ids]), [held[1], *texts]
                own = np.concatenate([held[2], own])
            n = len(texts) - 1
            if n:
                done = dict(zip(_NAMES, _results(ids.slice(0, n), texts[:-1], texts[1:], own[:-1], own[1:]), strict=True))
                yield _batch(done | {"part": pa.array(np.full(n, part, np.int32)), "kind": pa.array(["done"] * n)}, n)
            held = ids.slice(n), texts[n], own[n:]
    if held is not None:
        yield edge("last", held[0][0].as_py(), held[1])


def _batch(given: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    kinds = {"n_chars": pa.int64(), "fingerprint": pa.binary(), "edited_fingerprint": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64()}
    names = ["part", "kind", "text", *_NAMES]
    return pa.RecordBatch.from_arrays([given[x] if x in given else pa.nulls(n, kinds.get(x, pa.string())) for x in names], names)


def _edit_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, following = batch.column("text"), batch.column("next_text")
        yield pa.RecordBatch.from_arrays(
            _results(batch.column("doc_id"), texts.to_pylist(), following.to_pylist(), sketches(texts), sketches(following)), _NAMES
        )
