"""Vector code compression: product codes learned by Lloyd rounds over cover trees.

Components become floor(scale * x). A vector is cut into ``PARTS`` consecutive
parts; a codebook per part position begins as the parts of the smallest vec_ids,
and every round assigns each part to its nearest entry and moves the entries to
the floored means of what they got.

Rows go into blocks once, and each block has one cover tree per part position:
at every level of the tree the points of a node are covered by balls of half its
radius, whose centres are points more than that radius apart. A node keeps its
points as one range, their exact radius about the centre, their count and their
sum. A round walks the trees of a block level by level: where the second nearest
entry is farther from the centre than the nearest by more than twice the radius,
the triangle inequality gives the whole subtree to the nearest one, so its count
and sum are added; only ambiguous nodes hand on their children, and only the
points of ambiguous leaves are compared one by one, in whole numbers, ties to
the lower index. Equal points are one leaf of radius 0, whatever their number.

A round returns (part, entry, count, sum) of each block, added up by Spark; the
codebooks (``PARTS`` times ``entries`` rows) are all that the driver holds. The
blocks and their trees are written to the shared folder and read again in every
round, so a lost executor costs a re-read.

Vectors that are null or hold null or non-finite components are dropped. Shorter
vectors are filled up with zeros to the longest one; where the parts can't be
equal, they differ by one component, and an empty part has code 0 and no error.
With fewer rows than entries the codebook is as long as the rows. Ties between
equal vec_ids go to the smaller vector; a null vec_id comes last. Repeated rows
each get a row. An empty table gives none. Components are whole numbers of up to
``LARGEST``; beyond that, where squared distances would leave 64 bits, the job
raises an error. Columns beyond ``vec_id``, ``embedding`` and ``label`` are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ceil_div, pick, run_folder, saved, ship_package, small

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
#: Rows of a block, points that a node may hold without being split, and
#: children that a node may have: one that needs more (points of many
#: dimensions, all about equally far apart) is a leaf.
ROWS, LEAF, FANOUT = 16384, 24, 256
#: Squared distances of vectors of up to 2048 components stay below 2**63.
LARGEST = 1 << 25
#: Distances at a time when nodes or points meet the entries.
STEP = 1 << 20

_SUMS = "part int, entry int, n long, total array<long>"


def quantised(embedding: Column, scale: float) -> Column:
    """floor(scale * x) of every component; null for vectors that are dropped."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    value = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))
    held = F.transform(
        value,
        lambda v: F.when(F.abs(v) <= LARGEST, v).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("long")),
    )
    return F.when(embedding.isNotNull() & F.coalesce(fine, F.lit(False)), held)


def part_bounds(width: int, parts: int = PARTS) -> list[int]:
    return [p * width // parts for p in range(parts + 1)]


@dataclass
class CoverTree:
    """Nodes level by level. ``order``: the points in tree order. Node i covers
    order[start[i]:end[i]]; its children are nodes child[i] to child[i + 1]."""

    order: np.ndarray
    centre: np.ndarray  # point numbers
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray

    @staticmethod
    def build(points: np.ndarray) -> CoverTree:
        x = points.astype(np.float64)
        order = np.arange(len(x))
        nodes: list[tuple[int, float, int, int]] = []
        firsts: list[int] = []
        level = [(0, len(x))] if len(x) else []
        while level:
            below: list[tuple[int, int]] = []
            n_before = len(nodes) + len(level)
            for a, b in level:
                mine = order[a:b]
                distance = np.sqrt(((x[mine] - x[mine[0]]) ** 2).sum(axis=1))
                radius = float(distance.max())
                nodes.append((int(mine[0]), radius, a, b))
                firsts.append(n_before + len(below))
                if radius > 0 and b - a > LEAF:
                    below += _covered(x, order, a, b, distance, radius / 2)
            level = below
        columns = list(zip(*nodes, strict=True)) if nodes else [[]] * 4
        kinds = (np.int64, np.float64, np.int64, np.int64)
        centre, radius, start, end = (np.array(c, t) for c, t in zip(columns, kinds, strict=True))
        return CoverTree(order, centre, radius, start, end, np.array([*firsts, len(nodes)], np.int64))


def _covered(x: np.ndarray, order: np.ndarray, a: int, b: int, distance: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Put order[a:b] into balls of radius ``reach``, each about its first point,
    which no earlier ball holds; gives the balls' ranges, none if there would be
    more than ``FANOUT``."""
    left, balls = order[a:b], []
    while len(left):
        if len(balls) == FANOUT:
            return []
        inside = distance <= reach
        balls.append(left[inside])
        left = left[~inside]
        if len(left):
            distance = np.sqrt(((x[left] - x[left[0]]) ** 2).sum(axis=1))
    order[a:b] = np.concatenate(balls)
    ends = a + np.cumsum([len(ball) for ball in balls])
    return [(int(e) - len(ball), int(e)) for e, ball in zip(ends, balls, strict=True)]


def nearest(points: np.ndarray, entries: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per point its nearest usable entry (the lower of equals), the squared
    distance, and that of the second nearest (-1 without one)."""
    best, first, second = (np.zeros(len(points), np.int64) for _ in range(3))
    at = np.flatnonzero(usable)
    for a in range(0, len(points), max(1, STEP // max(1, len(at) * max(1, points.shape[1])))):
        b = a + max(1, STEP // max(1, len(at) * max(1, points.shape[1])))
        apart = ((points[a:b, None, :] - entries[None, at, :]) ** 2).sum(axis=2)
        near = apart.argmin(axis=1)
        rows = np.arange(len(near))
        best[a:b], first[a:b] = at[near], apart[rows, near]
        if len(at) > 1:
            apart[rows, near] = np.iinfo(np.int64).max
            second[a:b] = apart.min(axis=1)
        else:
            second[a:b] = -1
    return best, first, second


def assign(tree: CoverTree, points: np.ndarray, entries: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """Which entry is nearest: as (first, past, entry) for ranges of the tree's
    order that whole subtrees take, and as points and entries for the rest."""
    # Of equal entries only the first can be a nearest one.
    usable = np.zeros(len(entries), bool)
    usable[np.unique(entries, axis=0, return_index=True)[1]] = True
    ranges: list[tuple[int, int, int]] = []
    alone: list[np.ndarray] = []
    active = np.arange(min(1, len(tree.centre)))
    while len(active):
        best, first, second = nearest(points[tree.centre[active]], entries, usable)
        gap = np.sqrt(second.clip(0).astype(np.float64)) - np.sqrt(first.astype(np.float64))
        # A little wider, since roots are rounded.
        sure = (second < 0) | (tree.radius[active] == 0) | (gap > 2 * tree.radius[active] * (1 + 1e-9) + 1e-6)
        done = active[sure]
        ranges += zip(tree.start[done].tolist(), tree.end[done].tolist(), best[sure].tolist(), strict=True)
        rest = active[~sure]
        kids = tree.child[rest + 1] - tree.child[rest]
        alone += [tree.order[tree.start[i] : tree.end[i]] for i in rest[kids == 0]]
        some = kids > 0
        active = np.repeat(tree.child[rest[some]], kids[some]) + _counting(kids[some])
    single = np.concatenate(alone) if alone else np.zeros(0, np.int64)
    return ranges, single, nearest(points[single], entries, usable)[0]


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, in a row."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def sums(tree: CoverTree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the points nearest to each entry."""
    count, total = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    ranges, single, entry = assign(tree, points, entries)
    if ranges:
        first, past, whole = np.array(ranges, np.int64).T
        before = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[tree.order], axis=0)])
        np.add.at(count, whole, past - first)
        np.add.at(total, whole, before[past] - before[first])
    np.add.at(count, entry, 1)
    np.add.at(total, entry, points[single])
    return count, total


def codes(tree: CoverTree, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of every point."""
    out = np.zeros(len(points), np.int64)
    ranges, single, entry = assign(tree, points, entries)
    for a, b, e in ranges:
        out[tree.order[a:b]] = e
    out[single] = entry
    return out


# --- blocks -------------------------------------------------------------------------


_FIELDS = list(CoverTree.__dataclass_fields__)


def _blob(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def _block_schema(kept: DataFrame) -> str:
    """vec_ids and labels as they are; vectors, and the trees by part position."""
    kind = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    tree = ",".join(f"{f}:binary" for f in _FIELDS)
    return f"ids array<{kind['vec_id']}>, labels array<{kind['label']}>, n int, vectors binary, trees array<struct<{tree}>>"


def _plant(width: int, parts: int):
    bounds = part_bounds(width, parts)
    kind = pa.list_(pa.struct([(f, pa.binary()) for f in _FIELDS]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        n = table.num_rows
        lists = [
            pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), table.column(c).combine_chunks()) for c in ("vec_id", "label")
        ]
        vectors = np.zeros((n, width), np.int64)
        column = table.column("v").combine_chunks()
        sizes = np.diff(np.asarray(column.offsets))
        vectors[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        trees = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            tree = CoverTree.build(vectors[:, a:b])
            trees.append({k: _blob(v) for k, v in vars(tree).items()})
        yield pa.RecordBatch.from_arrays(
            [*lists, pa.array([n], pa.int32()), pa.array([_blob(vectors)], pa.binary()), pa.array([trees], kind)],
            ["ids", "labels", "n", "vectors", "trees"],
        )

    return run


def _trees(block: dict, width: int, parts: int) -> tuple[np.ndarray, list[CoverTree]]:
    vectors = np.frombuffer(block["vectors"], np.int64).reshape(block["n"], width)
    trees = [CoverTree(**{k: np.frombuffer(v, np.float64 if k == "radius" else np.int64) for k, v in t.items()}) for t in block["trees"]]
    return vectors, trees


def _round(books: list[np.ndarray], width: int, parts: int):
    bounds = part_bounds(width, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                vectors, trees = _trees(block, width, parts)
                found = []
                for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    count, total = sums(trees[p], vectors[:, a:b], books[p])
                    found += [(p, int(e), int(count[e]), total[e].tolist()) for e in np.flatnonzero(count)]
                columns = list(zip(*found, strict=True))
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "entry", "n", "total"]
                )

    return run


def _encode(books: list[np.ndarray], width: int, parts: int):
    bounds = part_bounds(width, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch.select(["n", "vectors", "trees"]).to_pylist()):
                vectors, trees = _trees(block, width, parts)
                code = np.zeros((len(vectors), parts), np.uint8)
                error = np.zeros(len(vectors), np.int64)
                for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    code[:, p] = codes(trees[p], vectors[:, a:b], books[p])
                    error += ((vectors[:, a:b] - books[p][code[:, p]]) ** 2).sum(axis=1)
                hexed = code.tobytes().hex()
                step = 2 * parts
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ids").slice(i, 1).flatten(),
                        batch.column("labels").slice(i, 1).flatten(),
                        pa.array([hexed[j : j + step] for j in range(0, len(hexed), step)], pa.string()),
                        pa.array(error),
                    ],
                    ["vec_id", "label", "code", "error"],
                )

    return run


def first_books(kept: DataFrame, width: int, parts: int, entries: int) -> list[np.ndarray]:
    """By part position, the parts of the smallest vec_ids."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # entries rows
    vectors = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        vectors[i, : len(row["v"])] = row["v"]
    bounds = part_bounds(width, parts)
    return [vectors[:, a:b].copy() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def moved_books(blocks: DataFrame, books: list[np.ndarray], width: int, parts: int) -> list[np.ndarray]:
    """The codebooks after one Lloyd round."""
    partial = blocks.mapInArrow(_round(books, width, parts), _SUMS)
    by_place = partial.select("part", "entry", "n", F.posexplode_outer("total").alias("place", "x"))
    total = by_place.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = [b.copy() for b in books]
    for row in total.collect():  # a number per codebook component
        if row["place"] is not None:
            out[row["part"]][row["entry"], row["place"]] = row["x"] // row["n"]
    return out


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


@dataclass(frozen=True)
class Compressed:
    """``rows``: vec_id, label, code, error of every kept row. ``books``: the
    final codebooks by part position."""

    rows: DataFrame
    books: list[np.ndarray]


def compress(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: float = SCALE,
    rows: int = ROWS,
    folder: str | None = None,
) -> Compressed:
    """Learn the codebooks and encode every row, the results in ``folder``."""
    spark = vectors.sparkSession
    ship_package(spark)
    folder = folder or run_folder(spark, "vector-codes")
    kept = pick(vectors, "vec_id", "embedding", "label").select("vec_id", "label", quantised(F.col("embedding"), scale).alias("v"))
    kept = kept.filter(F.col("v").isNotNull())
    n, width = kept.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    # One block a partition; round robin deals equal rows to different blocks.
    dealt = kept.repartition(ceil_div(n, rows)).mapInArrow(_plant(width, parts), _block_schema(kept))
    blocks = saved(dealt, f"{folder}/blocks")
    books = first_books(kept, width, parts, entries)
    for _ in range(rounds if n else 0):
        books = moved_books(blocks, books, width, parts)
    kind = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long"
    return Compressed(saved(blocks.mapInArrow(_encode(books, width, parts), schema), f"{folder}/rows"), books)


def with_label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with the summed error of each label (nulls together)."""
    total = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    n_labels = total.count()
    return rows.join(small(total, n_labels), rows["label"].eqNullSafe(F.col("of"))).drop("of")
