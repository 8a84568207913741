"""Documents with everything awkward, and plain-Python versions to test against."""

from __future__ import annotations

import random

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves, and variants in case.
CLASHING = ["size", "score", "row", "key", "bucket", "fingerprint", "h", "part", "Text", "DOC_ID"]


def awkward_rows():
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(random.randint(1, 8)))
    long = " ".join(word() for _ in range(30_000))
    shared = " ".join(word() for _ in range(60))
    rows = [
        (1, "Hello world, foo bar.\nNext line", "en", "a", 31),
        (2, None, None, None, None),
        (3, "", "en", "b", 0),
        (4, long, "en", "a", len(long)),
        (5, shared, "en", "c", len(shared)),
        (6, shared, "de", "c", len(shared)),
        (6, shared, "de", "c", len(shared)),
        (7, shared + " tail", "de", None, 0),
        (8, "one", None, "b", 3),
        (9, "  spaced   out \t text  ", "fr", "b", 0),
        (10, "12 34 ...", "en", "d", 0),
        (11, "ünïcödé 😀 日本語 x<|endoftext|>y", "de", "d", 0),
        (12, "a b\u0085c", "fr", "é", 0),
        (None, "no id at all", "en", "a", 0),
    ]
    return rows + [(20 + i, " ".join(word() for _ in range(5 + 3 * i)), "en", "abc"[i % 3], 0) for i in range(20)]


def awkward(spark, clash: bool = True):
    docs = spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)
    if clash:
        docs = docs.selectExpr("*", *[f"'{n}' AS `{n}`" for n in CLASHING])
    return docs


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components(values: np.ndarray, linked) -> list[int]:
    """Smallest index reachable, by union of every linked pair."""
    label = list(range(len(values)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(values)):
        for j in range(i + 1, len(values)):
            if linked(values[i], values[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]
