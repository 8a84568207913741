"""Helpers shared by the operators: run folders, column picking, slicing."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import tidemark
from tidemark.session import checkpoint_dir

#: Bytes of text that one vectorised step inside a task works on.
STEP_BYTES = 16 << 20


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tidemark-llm-{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, in case
    their machines don't have it on their path."""
    context = spark.sparkContext
    if any(name.startswith("tidemark-") for name in context._python_includes):
        return
    root = Path(tidemark.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="tidemark-package-"), f"tidemark-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(archive, "w") as out:  # Spark serves this driver file to the executors
        for source in sorted(root.rglob("*.py")):
            out.write(source, Path(root.name, source.relative_to(root)))
    context.addPyFile(str(archive))


def saved(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Write ``df`` as Parquet and read it back: computed once, lineage cut,
    and a lost executor costs a re-read only."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder of this run."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, under exactly these names. An exact match
    wins over one that differs in case, the first of several over the rest,
    so further columns never clash."""
    return _positional(df).select(*[F.col(f"c{_position(df, n)}").alias(n) for n in names])


def nested(df: DataFrame, *names: str) -> DataFrame:
    """The named columns plus ``row``, a struct of every input column, so
    results can be added beside any input column names."""
    plain = _positional(df)
    return plain.select(
        F.struct(*plain.columns).alias("row"), *[F.col(f"c{_position(df, n)}").alias(n) for n in names]
    )


def unnested(df: DataFrame, like: DataFrame) -> DataFrame:
    """The rows kept by ``nested``, with the columns of ``like``."""
    return df.select("row.*").toDF(*like.columns)


def _positional(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def _position(df: DataFrame, name: str) -> int:
    if name in df.columns:
        return df.columns.index(name)
    return [c.lower() for c in df.columns].index(name.lower())


def small(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """Broadcast a side of a join where its counted rows are few; beyond
    ``limit`` the join shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


def with_copies(rows: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """``rows`` with ``copy``: 0, 1, ... for rows that share all ``keys``, which
    of them has which being left open. Only such rows are written (below
    ``folder``) and numbered, by the partitions that they lie in, so no task
    holds a group of them."""
    same = [F.col(k).alias(f"of_{i}") for i, k in enumerate(keys)]
    often = saved(rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1), f"{folder}/repeated")
    n_often = often.count()
    if not n_often:
        return rows.withColumn("copy", F.lit(0).cast("long"))

    def of(left: DataFrame, right: DataFrame) -> Column:
        return reduce(Column.__and__, [left[k].eqNullSafe(right[f"of_{i}"]) for i, k in enumerate(keys)])

    alone = rows.join(small(often, n_often), of(rows, often), "left_anti").withColumn("copy", F.lit(0).cast("long"))
    held = rows.join(small(often, n_often), of(rows, often), "left_semi").withColumn("copy_part", F.spark_partition_id())
    copies = saved(held, f"{folder}/copies")
    counts = copies.groupBy(*same, F.col("copy_part").alias("of_part")).agg(F.count(F.lit(1)).alias("n"))
    names = [f"of_{i}" for i in range(len(keys))]
    earlier = Window.partitionBy(*names).orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("copy_part", *keys).orderBy("copy_part"))
    numbered = copies.withColumn("within", within - 1).join(bases, of(copies, bases) & (F.col("copy_part") == F.col("of_part")))
    return alone.unionByName(numbered.withColumn("copy", F.col("base") + F.col("within")).select(*alone.columns))


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def held_out(doc_id: Column) -> Column:
    """The quarter of rows that no classifier may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def ceil_div(a: int, b: int) -> int:
    return max(1, math.ceil(a / b))


def plain_strings(array: pa.Array) -> pa.Array:
    """Strings as one array with 32-bit offsets; null becomes empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = array.chunk(0) if array.num_chunks else pa.array([], pa.string())
    return array.fill_null("").cast(pa.string())


def byte_slices(array: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``step`` bytes of text, one row at least."""
    if not len(array):
        return
    ends = string_offsets(array)[1:]
    first = 0
    while first < len(array):
        start = ends[first - 1] if first else string_offsets(array)[0]
        last = max(first + 1, int(np.searchsorted(ends, start + step, "right")))
        yield first, last
        first = last


def string_offsets(array: pa.Array) -> np.ndarray:
    return np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, array.offset * 4)


def string_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all strings and each string's start (and the end)."""
    at = string_offsets(array).astype(np.int64)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def binary_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary per row holding ``counts[i]`` consecutive values."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    if ends[-1] > np.iinfo(np.int32).max:
        raise ValueError("a batch holds more than 2 GB of ids")
    return pa.Array.from_buffers(
        pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]
    )
