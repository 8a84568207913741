"""Exact top-k search over a bit-sliced index.

Every vector component becomes floor(scale * x). The index holds blocks of
rows; in a block, each dimension has one bitmap per bit of the (shifted)
value. For a query, the rows' scores are bit slices too: the dimensions'
slices are added with carry-save adders of bitmap operations, once for every
set bit of the query's component (complemented slices where it is negative).
Neighbouring dimensions that have the same bit set add their sum instead, which
a block computes once for all queries.
Selection walks the score slices from the most significant one downward: rows
that have the bit while the others of the tied set don't are ahead; it ends
when few rows are left, whose scores are then computed exactly, ties going to
the smaller vec_id.

Queries are a set named by the caller. Areas of row blocks and groups of query
packs make tiles: every block goes to the tiles of its area, every pack to those
of its group. The task of a tile holds its packs and one block after the other.
No join is planned, so nothing is ever broadcast, however small the packs look;
the driver holds counts only. A tile gives k rows a query at most, and a window
keeps the first k of them. Pairs of rows and queries are all
compared, so the work grows with the square of the table.

Vectors that are null or hold null or non-finite components take no part.
Vectors of unequal length are compared over their common components.
Quantised components are whole numbers of less than 62 bits, scores of 64; where
one of the k doesn't fit, or a component, the job raises an error. A query never gets rows of its own vec_id;
repeated rows of another are all candidates, and of equal score and vec_id in any
order. Rows that repeat a query's vec_id are queries of their own, each with its
``k`` rows (``query_row`` tells them apart). An empty table, or one without
queries, gives no rows. Columns beyond ``vec_id`` and
``embedding`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ceil_div, pick, run_folder, saved, ship_package

ROWS, QUERIES = 49152, 256
#: Row blocks of an area, and the most query packs of a group.
AREA, GROUP = 2, 128
#: Packs that one task writes.
WRITTEN = 8
#: Most dimensions that share sums, and most bytes of a block's shared sums.
TOGETHER, SHARED_BYTES = 3, 64 << 20
#: The walk down the slices ends when this many times k rows are left.
LEFT = 4

_BLOCK = "number int, n int, dims int, width int, bits int, ids binary, slices binary, vectors binary"
_QUERY = "number int, n int, dims int, width int, ids binary, vectors binary"
_HIT = "pack long, query_row int, query_id long, vec_id long, score long"


def quantised(embedding: Column, scale: float) -> Column:
    """floor(scale * x) of every component; null for vectors that take no
    part."""
    # A cast beyond 64 bits is an error, whatever the session's rules.
    scaled = lambda x: x.cast("double") * scale
    too_large = F.raise_error(F.lit("a component does not fit into 64 bits")).cast("bigint")
    value = F.transform(embedding, lambda x: F.when(F.abs(scaled(x)) < 2.0**62, F.floor(scaled(x))).otherwise(too_large))
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(embedding.isNotNull() & F.coalesce(fine, F.lit(False)), value)


def search(
    vectors: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, rows: int = ROWS, query_rows: int = QUERIES
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score, query_row (0, or more for rows
    that repeat a query_id) for every row of ``vectors`` where ``queries`` (over
    vec_id) holds."""
    spark = vectors.sparkSession
    ship_package(spark)
    folder = run_folder(spark, "bit-slices")
    whole = _quantised(vectors, scale)
    counts = whole.agg(F.count(F.lit(1)).alias("rows"), F.count_if(queries).alias("asked")).first()
    blocks, packs = ceil_div(counts["rows"], rows), ceil_div(counts["asked"], query_rows)
    index = saved(whole.repartition(blocks).mapInArrow(_slice_block, _BLOCK), f"{folder}/index")
    tasks = ceil_div(packs, WRITTEN)
    packed = saved(whole.filter(queries).repartition(tasks).mapInArrow(_pack_queries(query_rows, tasks), _QUERY), f"{folder}/queries")
    areas, groups = tile_counts(blocks, packs, spark.sparkContext.defaultParallelism)
    of_area = F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.col("number") % areas * groups + g))
    of_group = F.explode(F.transform(F.sequence(F.lit(0), F.lit(areas - 1)), lambda a: a * groups + F.col("number") % groups))
    # Packs, which have no bits, come before blocks.
    parts = index.select("*", of_area.alias("tile")).unionByName(packed.select("*", of_group.alias("tile")), allowMissingColumns=True)
    tiles = parts.repartitionById(areas * groups, F.col("tile").cast("int")).sortWithinPartitions("tile", F.col("bits").isNotNull(), "number")
    hits = tiles.mapInArrow(_search_tiles(k), _HIT)
    order = Window.partitionBy("query_id", "pack", "query_row").orderBy(F.col("score").desc(), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    # The rows of one query_id are numbered over their k hits each.
    again = Window.partitionBy("query_id").orderBy("pack", "query_row")
    numbered = ranked.withColumn("query_row", F.dense_rank().over(again) - 1)
    return numbered.select("query_id", "rank", "vec_id", "score", "query_row")


def tile_counts(blocks: int, packs: int, tasks: int) -> tuple[int, int]:
    """Areas of row blocks and groups of query packs: several tiles for every
    task that runs at once, as long as there are packs enough."""
    areas = ceil_div(blocks, AREA)
    return areas, min(packs, max(ceil_div(packs, GROUP), ceil_div(8 * tasks, areas)))


def _quantised(vectors: DataFrame, scale: float) -> DataFrame:
    both = pick(vectors, "vec_id", "embedding").select("vec_id", quantised(F.col("embedding"), scale).alias("v"))
    return both.filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull())


def _dense(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """vec_ids in ascending order, and their vectors, shorter ones filled up
    with zeros (which add nothing to a product)."""
    ids = np.concatenate([b.column("vec_id").to_numpy() for b in batches])
    sizes = np.concatenate([np.diff(np.asarray(b.column("v").offsets)) for b in batches])
    flat = np.concatenate([b.column("v").flatten().to_numpy() for b in batches])
    out = np.zeros((len(ids), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    order = np.argsort(ids, kind="stable")
    return ids[order].astype(np.int64), out[order]


def _slice_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    ids, vectors = _dense(held)
    slices, bits = bit_slices(vectors, int(vectors.min(initial=0)))
    narrow = _narrow(vectors)
    numbers = [TaskContext.get().partitionId(), len(ids), vectors.shape[1], narrow.itemsize, bits]
    yield _row(numbers, [ids.tobytes(), slices.tobytes(), narrow.tobytes()], ["number", "n", "dims", "width", "bits", "ids", "slices", "vectors"])


def _pack_queries(query_rows: int, tasks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        ids, vectors = _dense(held)
        for i, at in enumerate(range(0, len(ids), query_rows)):
            narrow = _narrow(vectors[at : at + query_rows])
            numbers = [TaskContext.get().partitionId() + i * tasks, len(narrow), narrow.shape[1], narrow.itemsize]
            yield _row(numbers, [ids[at : at + query_rows].tobytes(), narrow.tobytes()], ["number", "n", "dims", "width", "ids", "vectors"])

    return run


def _narrow(vectors: np.ndarray) -> np.ndarray:
    """In the fewest bytes that hold every component."""
    low, high = int(vectors.min(initial=0)), int(vectors.max(initial=0))
    return vectors.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _row(numbers: list[int], blobs: list[bytes], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int32()) for x in numbers], *[pa.array([x], pa.binary()) for x in blobs]], names)


def bit_slices(vectors: np.ndarray, low: int) -> tuple[np.ndarray, int]:
    """Bitmaps by dimension and bit (least first) of ``vectors - low``, 64
    rows a word."""
    # Differences below 2**63, since components are below 2**62.
    bits = max(1, (int(vectors.max(initial=low)) - low).bit_length())
    shifted = (vectors - low).T.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if bits <= np.iinfo(t).bits), order="C")
    words = -(-vectors.shape[0] // 64)
    out = np.zeros((vectors.shape[1], bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits((shifted >> b & 1).astype(np.uint8), axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return out.view(np.uint64), bits


def add_slices(columns: list[list[np.ndarray]], table: np.ndarray | None = None) -> list[np.ndarray]:
    """Score slices, least first: ``columns[p]`` lists stacks of bitmaps of
    weight 2^p (or the places of bitmaps in ``table``), which carry-save adders
    reduce to one bitmap a weight."""
    out: list[np.ndarray] = []
    counts = [sum(map(len, c)) for c in columns]
    stack, n, p = None, 0, 0  # the bitmaps of this weight, carried ones first
    while p < len(columns) or n:
        for given in columns[p] if p < len(columns) else []:
            if stack is None:
                stack = np.empty((counts[p], (given if table is None else table).shape[1]), np.uint64)
            room = stack[n : n + len(given)]
            if table is None:
                room[:] = given
            else:
                table.take(given, axis=0, out=room, mode="clip")  # other modes fill a buffer first
            n += len(given)
        following = counts[p + 1] if p + 1 < len(columns) else 0
        carries, m = np.empty((n // 2 + following, stack.shape[1]), np.uint64) if n > 1 else None, 0
        while n > 2:
            third = n // 3
            a, b, c = stack[n - 3 * third : n - 2 * third], stack[n - 2 * third : n - third], stack[n - third : n]
            carry = np.bitwise_and(a, b, out=carries[m : m + third])
            a ^= b
            np.bitwise_and(a, c, out=b)
            carry |= b
            a ^= c
            n, m = n - 2 * third, m + third
        if n == 2:
            np.bitwise_and(stack[0], stack[1], out=carries[m])
            stack[0] ^= stack[1]
            m += 1
        out.append(stack[0] if n else None)
        stack, n, p = carries, m, p + 1
    return out


def select_top(slices: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """Rows that hold the k highest scores, and all that may tie with them:
    walks the slices from the most significant one downward."""
    ahead, tied = np.zeros_like(valid), valid.copy()
    n_ahead = 0
    for s in reversed(slices):
        if s is None:
            continue
        n_tied = int(np.bitwise_count(tied).sum())
        if n_ahead + n_tied <= LEFT * k:
            break
        set_rows = tied & s
        n_set = int(np.bitwise_count(set_rows).sum())
        if n_ahead + n_set >= k:
            tied = set_rows
        else:
            ahead |= set_rows
            n_ahead += n_set
            tied &= ~s
    rows = np.unpackbits((ahead | tied).view(np.uint8), bitorder="little")
    return np.flatnonzero(rows)


def shared_sums(slices: np.ndarray, together: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit slices of the sums of up to ``together`` neighbouring dimensions.
    Gives a table of bitmaps and, by code, the number of slices and of those
    before them; a code has a digit of base 3 for each of the dimensions: left
    out, added, or subtracted (the complement added). Each slice is in the table
    once for every group of dimensions."""
    dims, bits, words = slices.shape
    groups = -(-dims // together)
    padded = np.zeros((groups * together, bits, words), np.uint64)
    padded[:dims] = slices
    each = padded.reshape(groups, together, bits, words).transpose(1, 2, 0, 3).reshape(together, bits, groups * words)
    sums: list[list[np.ndarray]] = [[]]
    for plus in each:
        sums += [_sum(s, list(x)) for x in (plus, ~plus) for s in sums]
    counts = np.array([len(s) for s in sums])
    table = np.concatenate([x.reshape(groups, words) for s in sums for x in s])
    return table, counts, np.cumsum(counts) - counts


def _sum(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return add_slices([[np.stack([*a[p : p + 1], *b[p : p + 1]])] for p in range(max(len(a), len(b)))])


class Block:
    """Rows of the index in the order of their ids, with what a search needs
    of them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, slices: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.dims, bits, words = slices.shape
        slices_of = lambda t: sum(math.comb(t, m) * 2**m * (bits + m - 1) for m in range(1, t + 1))
        fits = [t for t in range(2, TOGETHER + 1) if -(-self.dims // t) * slices_of(t) * words * 8 <= SHARED_BYTES]
        self.together = max(fits, default=1)
        self.groups = -(-self.dims // self.together)
        self.table, self.counts, self.before = shared_sums(slices, self.together)
        #: The largest component by dimension, in absolute value.
        self.largest = np.maximum(vectors.max(axis=0, initial=0).astype(float), -vectors.min(axis=0, initial=0).astype(float))
        self.all = np.zeros(words, np.uint64)
        self.all.view(np.uint8)[: -(-len(ids) // 8)] = np.packbits(np.ones(len(ids), bool), bitorder="little")

    def partial_sums(self, query: np.ndarray) -> list[list[np.ndarray]]:
        """Places in the table, by weight, of what makes up the scores: for
        every bit of the query, the sums of the dimensions that have it."""
        padded = np.zeros(self.groups * self.together, np.int64)
        padded[: len(query)] = query
        factor = np.abs(padded)
        digits = (factor[:, None] >> np.arange(int(factor.max(initial=0)).bit_length()) & 1) << (padded < 0)[:, None]
        codes = (digits.reshape(self.groups, self.together, digits.shape[1]) * 3 ** np.arange(self.together)[:, None]).sum(axis=1)
        group, j = np.nonzero(codes)
        code = codes[group, j]
        n = self.counts[code]
        i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = (np.repeat(self.before[code], n) + i) * self.groups + np.repeat(group, n)
        weight = np.repeat(j, n) + i
        at = at[np.argsort(weight, kind="stable")]
        ends = np.cumsum(np.bincount(weight)).tolist()
        return [[at[a:b]] for a, b in zip([0, *ends], ends, strict=False)]

    def others(self, query_id: int) -> np.ndarray:
        """Bitmap of the rows that have another id."""
        if np.searchsorted(self.ids, query_id, "left") == np.searchsorted(self.ids, query_id, "right"):
            return self.all
        out = np.zeros_like(self.all)
        out.view(np.uint8)[: -(-len(self.ids) // 8)] = np.packbits(self.ids != query_id, bitorder="little")
        return out

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """vec_ids and scores of the k best rows for one query."""
        dims = min(len(query), self.dims)
        query = query[:dims]
        rows = select_top(add_slices(self.partial_sums(query), self.table), self.others(query_id), k)
        ids = self.ids[rows]
        # Slices hold sums of any size; products are of Python's whole numbers where 64 bits might not do.
        if np.abs(query).astype(float) @ self.largest[:dims] >= 2.0**62:
            exact = [sum(a * b for a, b in zip(v, query.tolist(), strict=True)) for v in self.vectors[rows, :dims].tolist()]
            best = sorted(range(len(rows)), key=lambda i: (-exact[i], ids[i]))[:k]
            if any(abs(exact[i]) >= 1 << 63 for i in best):
                raise OverflowError("a score does not fit into 64 bits")
            return ids[best], np.array([exact[i] for i in best], np.int64)
        scores = self.vectors[rows, :dims] @ query
        best = _first(ids, scores, k)
        return ids[best], scores[best]


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    # Bit complement: in the order of -scores, without its overflow.
    return np.lexsort((ids, ~scores))[:k]


class Pack:
    """Queries, with the best rows of the blocks that they have met."""

    def __init__(self, number: int, ids: np.ndarray, vectors: np.ndarray):
        self.number, self.ids, self.vectors = number, ids, vectors.astype(np.int64)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def meet(self, block: Block, k: int) -> None:
        for i, (query_id, query) in enumerate(zip(self.ids.tolist(), self.vectors, strict=True)):
            ids, scores = (np.concatenate(x) for x in zip(self.best[i], block.top(query_id, query, k), strict=True))
            first = _first(ids, scores, k)
            self.best[i] = ids[first], scores[first]

    def hits(self) -> pa.RecordBatch:
        sizes = [len(ids) for ids, _ in self.best]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(sum(sizes), self.number, np.int64)),
                pa.array(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)),
                pa.array(np.repeat(self.ids, sizes)),
                pa.array(np.concatenate([ids for ids, _ in self.best])),
                pa.array(np.concatenate([scores for _, scores in self.best])),
            ],
            ["pack", "query_row", "query_id", "vec_id", "score"],
        )


def _search_tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, packs = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: column[i] for name, column in zip(batch.schema.names, batch.columns, strict=True)}
                if tile != row["tile"].as_py():
                    yield from (pack.hits() for pack in packs)
                    tile, packs = row["tile"].as_py(), []
                n, dims = row["n"].as_py(), row["dims"].as_py()
                ids = _numbers(row["ids"], np.int64)
                vectors = _numbers(row["vectors"], f"i{row['width'].as_py()}").reshape(n, dims)
                if not row["bits"].is_valid:
                    packs.append(Pack(row["number"].as_py(), ids, vectors))
                elif packs:
                    slices = _numbers(row["slices"], np.uint64).reshape(dims, row["bits"].as_py(), -(-n // 64))
                    block = Block(ids, vectors, slices)
                    for pack in packs:
                        pack.meet(block, k)
        yield from (pack.hits() for pack in packs)

    return run


def _numbers(blob: pa.Scalar, kind: type | str) -> np.ndarray:
    """Shares the memory of the batch."""
    return np.frombuffer(blob.as_buffer(), kind)
