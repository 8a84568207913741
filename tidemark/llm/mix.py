"""Mixing sources to target weights by hash thresholds, in DataFrame operations
alone.

Sources share a budget by weight; a target stops at ``cap`` times its source's
size and the excess is reshared among the others until none is above. A source
whose target is f whole times its size plus a rest repeats every document f
times, and those below a hash threshold once more. The threshold comes from
histograms: sizes are summed by source and by the leading bits of a document's
hash; the first bucket that passes the rest is the boundary; it alone is split
by the next bits, and so on until the bucket is one hash value, which is taken
if that comes nearer to the target. Documents are then kept by comparing
their hash; nothing is sorted but the histograms.

The hash is the first 60 bits of the MD5 of doc_id and text, so reruns agree.
Rows of one source that repeat both are numbered from 0, and the number, unless
it is 0, is hashed too, so every row has a hash of its own and a group of copies
is cut as closely as other rows; which of the copies has which number makes no
difference. Numbering counts the copies by the partitions of a written table, so
no task holds a group. Null texts and empty texts have size 0 and add nothing.
The null source comes last. An empty table gives no rows. Columns beyond
``doc_id``, ``text`` and ``source`` are ignored here and kept by ``mixed``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import nested, pick, run_folder, saved, small, unnested, with_copies

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
HASH_BITS, LEVEL_BITS = 60, 12


@dataclass(frozen=True)
class MixPlan:
    """``sizes``: doc_id, source, size, h of every document. ``sources``:
    source, source_size, target, repeats, threshold; ``n_sources`` of them.
    ``folder``: of the run's tables."""

    sizes: DataFrame
    sources: DataFrame
    n_sources: int
    folder: str


def word_count(text: Column) -> Column:
    """Number of runs of anything but the space and U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def hash60(doc_id: Column, text: Column, copy: Column | None = None) -> Column:
    said = [F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))]
    if copy is not None:
        said.append(F.when(copy > 0, F.concat(F.lit("\n"), copy.cast("string"))).otherwise(F.lit("")))
    digest = F.md5(F.concat(*said).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def hashed_rows(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` (doc_id, text, source and others) with their hash ``h``, and
    without the text."""
    keyed = with_copies(rows.withColumn("h", hash60(F.col("doc_id"), F.col("text"))), ["source", "h"], folder)
    again = hash60(F.col("doc_id"), F.col("text"), F.col("copy"))
    return keyed.withColumn("h", F.when(F.col("copy") > 0, again).otherwise(F.col("h"))).drop("text", "copy")


def plan_mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, folder: str | None = None
) -> MixPlan:
    folder = folder or run_folder(docs.sparkSession, "mix")
    rows = pick(docs, "doc_id", "text", "source").withColumn("size", word_count(F.col("text")))
    sizes = saved(hashed_rows(rows, folder).select("doc_id", "source", "size", "h"), f"{folder}/sizes")
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = _numbered(by_source, F.col("source").asc_nulls_last(), f"{folder}/sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    weighed = numbered.select("source", "source_size", weight.alias("weight"))
    n_sources = weighed.count()
    level, capped = _water_level(weighed, share, cap)
    targets = weighed.select(
        "source", "source_size", F.when(capped, F.col("source_size") * cap).otherwise(F.col("weight") * level).alias("target")
    )
    repeats = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("bigint")
    split = saved(
        targets.withColumn("repeats", repeats).withColumn("rest", F.col("target") - F.col("repeats") * F.col("source_size")),
        f"{folder}/targets",
    )
    thresholds = _thresholds(sizes, split, n_sources, folder)
    sources = saved(
        split.join(thresholds, split["source"].eqNullSafe(thresholds["of"]), "left").select(
            "source", "source_size", "target", "repeats", F.coalesce("threshold", F.lit(0)).alias("threshold")
        ),
        f"{folder}/plan",
    )
    return MixPlan(sizes, sources, n_sources, folder)


def taken_words(plan: MixPlan) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    return _with_copies(plan.sizes, plan).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed(docs: DataFrame, plan: MixPlan) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    rows = hashed_rows(nested(docs, "doc_id", "text", "source"), f"{plan.folder}/again")
    copies = _with_copies(rows, plan)
    return unnested(copies.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))), docs)


def _with_copies(rows: DataFrame, plan: MixPlan) -> DataFrame:
    sources = plan.sources.withColumnRenamed("source", "of")
    copies = F.col("repeats") + (F.col("h") < F.col("threshold")).cast("bigint")
    return rows.join(small(sources, plan.n_sources), rows["source"].eqNullSafe(sources["of"])).withColumn("copies", copies)


def _numbered(df: DataFrame, order: Column, path: str) -> DataFrame:
    """``df`` with its rows numbered from 0 in ``order``: sorted ranges, and
    the number of rows in the ranges before."""
    ranged = saved(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id()), path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    bases = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return ranged.join(bases, "part").withColumn("number", F.col("base") + within - 1).drop("part", "base")


def _water_level(weighed: DataFrame, share: float, cap: float) -> tuple[float, Column]:
    """Budget per weight of the sources below their cap, and which are at it.
    Each round sends four numbers to the driver; rounds end as soon as no
    further source reaches its cap."""
    level, n_capped = 0.0, -1
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    while True:
        capped = F.col("source_size") * cap < F.col("weight") * level
        full, open_weight, n = weighed.agg(
            F.sum(F.when(capped, F.col("source_size") * cap).otherwise(0.0)),
            F.sum(F.when(capped, 0).otherwise(F.col("weight"))),
            F.count_if(capped),
        ).first()
        if n == n_capped or not open_weight:
            return level, capped
        level, n_capped = (share * total - full) / open_weight, n


def _thresholds(sizes: DataFrame, split: DataFrame, n_sources: int, folder: str) -> DataFrame:
    """Per source with words: of, threshold."""
    rows = sizes.filter(F.col("size") > 0)
    bounds = split.select(F.col("source").alias("of"), F.col("rest"), F.lit(0).cast("bigint").alias("prefix"))
    for used in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        bucket = F.shiftright("h", HASH_BITS - used)
        inside = F.shiftright("h", HASH_BITS - used + LEVEL_BITS) == F.col("prefix")
        rows = rows.join(small(bounds, n_sources), rows["source"].eqNullSafe(bounds["of"]) & inside).select(
            "source", "size", "h", "rest"
        )
        if used > LEVEL_BITS:
            rows = saved(rows, f"{folder}/boundary-{used}")  # the boundary bucket's documents alone
        histogram = rows.groupBy("source", "rest", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
        order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        running = histogram.withColumn("so_far", F.coalesce(F.sum("size").over(order), F.lit(0)))
        first = running.filter(F.col("so_far") + F.col("size") > F.col("rest")).groupBy(F.col("source").alias("of")).agg(
            F.min_by(F.struct("so_far", "size", "rest", "bucket"), "bucket").alias("b")
        )
        bounds = saved(
            first.select(
                "of",
                F.col("b.bucket").alias("prefix"),
                (F.col("b.rest") - F.col("b.so_far")).alias("rest"),
                F.col("b.size").alias("last"),
            ),
            f"{folder}/bounds-{used}",
        )
        rows = rows.drop("rest")
    nearer = F.col("last") <= F.col("rest") * 2
    return bounds.select("of", (F.col("prefix") + nearer.cast("bigint")).alias("threshold"))
