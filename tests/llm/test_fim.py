import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.helpers import awkward, awkward_rows, empty
from tidemark.llm import fim


def plain(doc_id, text):
    """The contract, unit by unit."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_transform_equals_brute_force(spark):
    rows = awkward_rows() + [(100 + i, t, None, None, 0) for i, t in enumerate(["a<P>b", "<S>", "<M", "<P", ">" * 9, "a", "ß", "aß", "\x00a"] * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs = docs.selectExpr("*", "'x' AS n", "'x' AS form", "'x' AS Text", "'x' AS output")
    got = fim.fill_in_middle(docs).withColumn("r", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    want = sorted(((r[0], *plain(r[0], r[1])) for r in rows), key=key)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == want
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add(r[1] or "")
    assert all(r.r in texts[r.doc_id] for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert fim.fill_in_middle(empty(spark)).count() == 0


def test_awkward_columns(spark):
    assert fim.fill_in_middle(awkward(spark)).count() == len(awkward_rows())


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1000])
def test_ranks(size):
    symbols = np.random.default_rng(size).integers(0, 4, size).astype(np.uint8)
    matrix = fim.WaveletMatrix(symbols)
    place = np.arange(size + 1)
    for s in range(4):
        assert matrix.rank(s, place).tolist() == [int((symbols[:i] == s).sum()) for i in place]
