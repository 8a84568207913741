"""Versions of a folder's content behind one pointer.

Data is written to folders that nobody reads yet; a version is a small JSON file
that says which folders belong together. It is written under another name and
renamed into ``{root}/_versions`` at the end, so readers, who take the highest
version, see all of it or none, and a writer that dies leaves the last version
as it was. One writer at a time: two that publish the same number don't
overwrite each other, the second fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

_FOLDER = "_versions"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it is absent."""
    if not exists(spark, path):
        return []
    return sorted(s.getPath().getName() for s in _fs(spark, path).listStatus(_path(spark, path)))


def remove(spark: SparkSession, path: str) -> None:
    _fs(spark, path).delete(_path(spark, path), True)


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The published versions, ascending."""
    names = children(spark, f"{root}/{_FOLDER}")
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def publish(spark: SparkSession, root: str, content: dict) -> int:
    """Make ``content`` the newest version; gives its number."""
    number = max(numbers(spark, root), default=0) + 1
    hidden, final = f"{root}/{_FOLDER}/.{uuid.uuid4().hex}", f"{root}/{_FOLDER}/{number:010d}.json"
    out = _fs(spark, hidden).create(_path(spark, hidden), False)
    try:
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        out.close()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # none: never overwrite
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(_fs(spark, root).getUri(), conf).rename(_path(spark, hidden), _path(spark, final), options)
    return number


def content(spark: SparkSession, root: str, number: int | None = None) -> dict | None:
    """What a version says, the newest by default; None where none is published."""
    known = numbers(spark, root)
    if number is None and not known:
        return None
    text = spark.read.text(f"{root}/{_FOLDER}/{(known[-1] if number is None else number):010d}.json", wholetext=True)
    return json.loads(text.first()[0])


def forget(spark: SparkSession, root: str, keep: int = 1) -> list[dict]:
    """Withdraw all versions but the last ``keep``; gives those that stay."""
    known = numbers(spark, root)
    for number in known[: max(0, len(known) - keep)]:
        remove(spark, f"{root}/{_FOLDER}/{number:010d}.json")
    return [content(spark, root, n) for n in known[-keep:]]
