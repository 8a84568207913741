"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has 64 bits: a bit is 1 where more than half of the text's
shingle hashes have it. Distinct fingerprints are sorted into tiles by the
population counts of their four 16-bit parts. Two fingerprints within the
radius differ by at most the radius in the sum over the parts of the
population counts' differences, so a tile meets only the tiles whose counts
differ by no more; every other pair of tiles is skipped. Within a pair of
tiles numpy compares all fingerprints exactly by exclusive-or and bit count;
the links found are returned as a spanning forest (each fingerprint with the
smallest one that it reaches there), never as all pairs. Components grow from
these links by rounds of taking the smallest label of a node's neighbours and
of its label's node, each round written to the shared folder.

Null and empty texts have fingerprint zero and link like any other. Texts of
any length are read whole, one after another. Repeated rows are documents of
their own in one component; an empty table gives no rows. Columns beyond ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import byte_slices, nested, pick, plain_strings, remove_folder, run_folder, saved, ship_package, unnested

SHINGLE, RADIUS, SEED = 3, 2, 42
PARTS = 4
#: Fingerprints in a tile at most.
TILE = 2048

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint_column(shingle: int = SHINGLE, seed: int = SEED):
    """An Arrow function from texts to fingerprints as (signed) longs."""

    @F.arrow_udf(T.LongType())
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array(fingerprints(texts, shingle, seed).view(np.int64))

    return fingerprint


def fingerprints(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    texts = plain_strings(texts)
    out = np.zeros(len(texts), np.uint64)
    for a, b in byte_slices(texts, 4 << 20):
        hashes, counts = [], []
        for text in texts.slice(a, b - a).cast(pa.binary()).to_pylist():
            words = _WORDS.findall(text.lower())
            shingles = [b" ".join(words)] * bool(words) if len(words) < shingle else map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
            mine = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)
            hashes.append(mine)
            counts.append(len(mine))
        out[a:b] = _majority(np.concatenate(hashes), np.array(counts))
    return out


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text, the bits set in over half of its hashes."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = (np.cumsum(counts) - counts)[full]
    for byte in range(8):
        bits = np.unpackbits(hashes.view(np.uint8)[byte::8, None], axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        packed = np.packbits(2 * ones > counts[full, None], axis=1, bitorder="little")[:, 0]
        out[full] |= packed.astype(np.uint64) << np.uint64(8 * byte)
    return out


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Of each group one row, with all its columns: the smallest doc_id (nulls
    last), then the smallest hash of the text, then the first as written."""
    spark = docs.sparkSession
    ship_package(spark)
    folder = run_folder(spark, "near-duplicates")
    # Written once, so that every later read has the same row numbers.
    rows = saved(
        nested(docs, "doc_id", "text").select(
            "row",
            "doc_id",
            F.xxhash64("text").alias("text_hash"),
            fingerprint_column(shingle)("text").alias("fingerprint"),
            F.monotonically_increasing_id().alias("number"),
        ),
        f"{folder}/rows",
    )
    place = F.struct(F.col("doc_id").isNull().alias("without_id"), "doc_id", "text_hash", "number")
    # Aggregated by fingerprint before the join: a hot text is one row of it.
    nearest = rows.groupBy("fingerprint").agg(F.min(place).alias("first"))
    roots = groups(rows.select("doc_id", "fingerprint"), folder, radius=radius).select("fingerprint", "root")
    first = nearest.join(roots, "fingerprint").groupBy("root").agg(F.min("first").alias("first"))
    return unnested(rows.join(first.select("first.number"), "number", "left_semi"), docs)


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, tile: int = TILE
) -> DataFrame:
    """Per document: doc_id, fingerprint (long), component_id."""
    spark = docs.sparkSession
    ship_package(spark)
    folder = run_folder(spark, "simhash")
    rows = saved(
        pick(docs, "doc_id", "text").select("doc_id", fingerprint_column(shingle, seed)("text").alias("fingerprint")),
        f"{folder}/fingerprints",
    )
    labels = saved(groups(rows, folder, radius, tile).select("fingerprint", "component_id"), f"{folder}/labels")
    return rows.join(labels, "fingerprint").select("doc_id", "fingerprint", "component_id")


def groups(rows: DataFrame, folder: str, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Per distinct fingerprint of ``rows``: fingerprint, root (a fingerprint
    that its component alone has), component_id (its smallest doc_id, null if
    all are)."""
    nodes = saved(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_doc")), f"{folder}/nodes")
    links = saved(tile_links(nodes, radius, tile), f"{folder}/links")
    roots = components(links, folder)
    # Nodes without a link are their own component and need no row here.
    linked = roots.join(nodes, roots["node"] == nodes["fingerprint"]).select("node", "root", "first_doc")
    first = linked.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    alone = nodes.join(roots, roots["node"] == nodes["fingerprint"], "left_anti").select(
        "fingerprint", F.col("fingerprint").alias("root"), F.col("first_doc").alias("component_id")
    )
    return linked.join(first, "root").select(F.col("node").alias("fingerprint"), "root", "component_id").unionByName(alone)


def tile_links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b), a above b, that connect what distances of at most
    ``radius`` connect. ``nodes``: distinct ``fingerprint``."""
    width = 64 // PARTS
    counts = [
        F.bit_count(F.shiftrightunsigned("fingerprint", width * p).bitwiseAND((1 << width) - 1)) for p in range(PARTS)
    ]
    # A tile's key has its population counts, and where a key holds many
    # fingerprints, which of its tiles this is.
    keyed = nodes.select("fingerprint", F.array(*counts).alias("counts"))
    sizes = keyed.groupBy("counts").agg(F.count(F.lit(1)).alias("n"))
    dealt = keyed.join(sizes.select("counts", F.ceil(F.col("n") / tile).alias("tiles")), "counts").withColumn(
        "part", F.pmod(F.xxhash64("fingerprint"), F.col("tiles"))
    )
    tiles = (
        dealt.groupBy("counts", "tiles", "part")
        .agg(F.collect_list("fingerprint").alias("fingerprints"))  # about ``tile`` of them
    )
    spark = nodes.sparkSession
    folder = run_folder(spark, "tiles")
    tiles = saved(tiles, f"{folder}/tiles")
    shifts = _shifts(radius)
    offers = tiles.select(
        F.col("counts").alias("own"),
        F.col("part").alias("own_part"),
        F.col("fingerprints").alias("left"),
        F.explode(F.array(*[F.array(*[F.lit(x) for x in s]) for s in shifts])).alias("shift"),
    ).withColumn("counts", F.zip_with("own", "shift", lambda a, b: a + b))
    met = offers.join(tiles.select("counts", "part", F.col("fingerprints").alias("right")), "counts").filter(
        (F.col("own") != F.col("counts")) | (F.col("own_part") <= F.col("part"))
    )
    return met.select("left", "right").mapInArrow(_compare(radius), "a long, b long").distinct()


def _shifts(radius: int) -> list[tuple[int, ...]]:
    """Differences of count vectors up to ``radius`` in sum, one of each pair
    of opposite ones."""
    found = [()]
    for _ in range(PARTS):
        found = [(*s, d) for s in found for d in range(-radius, radius + 1) if sum(map(abs, s)) + abs(d) <= radius]
    return [s for s in found if s >= tuple(-x for x in s)]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = []
            for i in range(batch.num_rows):
                left, right = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1))
                pairs.append(forest(left, right, radius))
            links = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return run


def forest(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Spanning links of the graph between (and, for one tile with itself,
    within) two tiles: at most one link per fingerprint."""
    near_left, near_right = [], []
    step = max(1, (1 << 20) // max(1, len(right)))
    for a in range(0, len(left), step):
        i, j = np.nonzero(np.bitwise_count(left[a : a + step, None] ^ right[None, :]) <= radius)
        near_left.append(i + a)
        near_right.append(j)
    x, y = left[np.concatenate(near_left)], right[np.concatenate(near_right)]
    x, y = x[x != y], y[x != y]
    if not len(x):
        return np.zeros((0, 2), np.int64)
    names, both = np.unique(np.concatenate([x, y]).view(np.int64), return_inverse=True)
    u, v = both[: len(x)], both[len(x) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    joined = np.flatnonzero(label != np.arange(len(names)))
    return np.stack([names[joined], names[label[joined]]], axis=1)


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, root) for every linked node; the root is the smallest node of
    its component. Every round halves the longest way to a root or so."""
    spark = links.sparkSession
    edges = links.select("a", "b").union(links.select("b", "a"))
    labels = saved(
        edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")),
        f"{folder}/labels-0",
    )
    turn = 0
    while True:
        turn += 1
        # The smallest label next to a node reaches the node and its root.
        offered = edges.join(labels.select(F.col("node").alias("b"), F.col("root").alias("low")), "b").join(
            labels.select(F.col("node").alias("a"), "root"), "a"
        )
        lower = offered.filter(F.col("low") < F.col("root"))
        better = (
            lower.select(F.col("a").alias("node"), "low")
            .union(lower.select(F.col("root").alias("node"), "low"))
            .groupBy("node")
            .agg(F.min("low").alias("low"))
        )
        stepped = labels.join(better, "node", "left").select("node", F.least("root", "low").alias("root"))
        jump = stepped.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = saved(stepped.join(jump, "root").select("node", F.col("next").alias("root")), f"{folder}/labels-{turn}")
        changed = new.join(labels.withColumnRenamed("root", "was"), "node").filter(F.col("root") != F.col("was"))
        if changed.isEmpty():
            return new
        if turn > 1:
            remove_folder(spark, f"{folder}/labels-{turn - 2}")
        labels = new
