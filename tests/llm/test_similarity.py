import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from llm.helpers import awkward, awkward_rows, components, empty
from tidemark.llm import simhash, syncmers, topk


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark):
    rows = sorted(awkward_rows(), key=lambda r: (r[0] is None, r[0]))
    prints = [plain_fingerprint(r[1]) for r in rows]
    label = components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    want = sorted((r[0] or 0, p, rows[c][0] or 0) for r, p, c in zip(rows, prints, label, strict=True))
    got = simhash.near_duplicates(awkward(spark)).collect()
    assert sorted((r.doc_id or 0, r.fingerprint % 2**64, r.component_id or 0) for r in got) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_tiles_lose_no_link(spark):
    random = np.random.default_rng(1)
    base = random.integers(0, 2**63, 40, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(i) for i in random.choice(64, random.integers(0, 4), replace=False)) for b in base for _ in range(12)]
    values = np.unique(np.array([*near, 0, 1, 3, 2**64 - 1], np.uint64))
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint long")
    label = components(values.tolist(), lambda a, b: (a ^ b).bit_count() <= 2)
    links = simhash.tile_links(nodes, 2, tile=5)  # several tiles a key
    from tidemark.llm.common import run_folder

    roots = {r.node: r.root for r in simhash.components(links, run_folder(spark, "test-cc")).collect()}
    groups = {}
    for v, c in zip(values.view(np.int64).tolist(), label, strict=True):
        groups.setdefault(c, []).append(v)
    assert all(len({roots.get(v, v) for v in g}) == 1 for g in groups.values())
    assert len({roots.get(v, v) for v in values.view(np.int64).tolist()}) == len(groups)


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(200)], "a long, b long")
    from tidemark.llm.common import run_folder

    rows = simhash.components(links, run_folder(spark, "test-cc")).collect()
    assert len(rows) == 201 and {r.root for r in rows} == {0}


def test_forest_of_a_large_group_is_small():
    values = np.array([(1 << i) | (1 << j) for i in range(30) for j in range(i)], np.uint64)
    links = simhash.forest(values, values, 2)
    assert len(links) == len(values) - 1


def plain_anchors(text):
    raw, mask = text.encode(), (1 << 64) - 1

    def poly(b):
        h = 0
        for c in b:
            h = (h * int(syncmers._BASE) + c + 1) & mask
        return h

    def mixed(h):
        h ^= h >> 32
        h = h * int(syncmers._MIX) & mask
        return h ^ (h >> 29)

    order = [mixed(poly(raw[i : i + 8])) for i in range(len(raw) - 7)]
    return [
        (i, mixed(poly(raw[i : i + 16])))
        for i in range(len(raw) - 15)
        if min(order[i : i + 9]) in (order[i], order[i + 8])
    ]


def test_anchors_equal_brute_force(spark):
    docs = awkward(spark).filter("n_chars < 1000 or n_chars is null")
    got = sorted((r.doc_id or 0, r.position, r.hash % 2**64) for r in syncmers.anchors(docs).collect())
    kept = [r for r in awkward_rows() if r[4] is None or r[4] < 1000]
    assert got == sorted((r[0] or 0, *x) for r in kept for x in plain_anchors(r[1] or ""))


def test_anchors_are_context_free():
    passage = "the passage that both of these documents share, word for word, in their middle"
    texts = pa.array([f"Some start. {passage} and an end", f"Another, longer start of it: {passage}; other end"])
    text, at, hashes = syncmers.syncmers(*syncmers.string_bytes(texts))
    starts = [t.as_py().index(passage) for t in texts]
    inside = [
        {(p - starts[i], h) for p, h in zip(at[text == i], hashes[text == i], strict=True) if 0 <= p - starts[i] <= len(passage) - 16}
        for i in (0, 1)
    ]
    assert inside[0] == inside[1] and len(inside[0]) > 5


def test_edits(spark):
    rows = sorted(awkward_rows(), key=lambda r: (r[0] is not None, r[0]), reverse=True)
    got = syncmers.fingerprint_edits(awkward(spark), range_bytes=2_000).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, row in enumerate(rows):
        text, following = row[1] or "", rows[(i + 1) % len(rows)][1] or ""
        new = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        r = by_id[row[0]]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        own, other, after = syncmers.sketches(pa.array([text, new, following]))
        assert r.fingerprint == own.astype(">u2").tobytes().hex() and r.edited_fingerprint == other.astype(">u2").tobytes().hex()
        assert r.near_edited == syncmers.likeness(own[None], other[None])[0]
        assert r.near_next == syncmers.likeness(own[None], after[None])[0]
    assert by_id[5].fingerprint == by_id[6].fingerprint and by_id[4].near_edited > 0.3 and by_id[4].near_next < 0.2
    assert syncmers.fingerprint_edits(empty(spark)).count() == 0
    (alone,) = syncmers.fingerprint_edits(spark.createDataFrame([(1, "just me")], "doc_id long, text string")).collect()
    assert alone.edited_sha256 == hashlib.sha256(b"just just"[:5] + b"ju").hexdigest() and alone.near_next == 1.0


def plain_top(ids, vectors, q, k):
    scores = [(-sum(a * b for a, b in zip(q[1], v, strict=False)), i) for i, v in zip(ids, vectors, strict=True) if i != q[0]]
    return [(i, -s) for s, i in sorted(scores)[:k]]


def test_top_k(spark):
    random = np.random.default_rng(2)
    rows = [(i, [float(x) for x in random.normal(0, 0.3, 8)]) for i in range(400)]
    rows += [(400 + i, [0.25] * 8) for i in range(90)]  # ties beyond k
    rows += [(20, rows[20][1]), (600, None), (601, [1.0, None] + [0.0] * 6), (602, [float("nan")] * 8), (603, [float("inf")] * 8)]
    rows += [(604, []), (605, [0.5, -0.5]), (None, [0.1] * 8), (640, [4e7] + [0.0] * 7), (641, [38 / 64] * 8), (660, [-3e8] * 8)]
    rows += [(20, [-x for x in rows[20][1]])]  # another query of the same vec_id
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS block", "3 AS VEC_ID")
    got = topk.search(data, F.col("vec_id") % 20 == 0, k=5, rows=64, query_rows=7).collect()
    whole = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ids = [i for i, _ in whole]
    vectors = [[int(np.floor(64 * x)) for x in v] for _, v in whole]
    found = {}
    for r in got:
        found.setdefault((r.query_id, r.query_row), []).append((r["rank"], r.vec_id, r.score))
    asked = [(i, v) for i, v in zip(ids, vectors, strict=True) if i % 20 == 0]
    assert {q for q, _ in found} == {i for i, _ in asked} and len(found) == len(asked)
    for i in {i for i, _ in asked}:
        want = sorted(plain_top(ids, vectors, (q, v), 5) for q, v in asked if q == i)
        assert sorted([(a, b) for _, a, b in sorted(found[key])] for key in found if key[0] == i) == want
    assert any(abs(r.score) > 2**40 for r in got)
    assert topk.search(data.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.search(spark.createDataFrame([(7, [1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).count() == 0


def test_scores_of_64_bits(spark):
    big = spark.createDataFrame([(20, [4e7, 1.0]), (1, [38 / 64, 0.0]), (2, [-4e7, 0.0])], "vec_id long, embedding array<double>")
    got = topk.search(big, F.col("vec_id") % 20 == 0, k=2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 97_280_000_000), (2, -((64 * 4 * 10**7) ** 2))]
    for far in ([1e30], [1e9, 1e9]):
        bad = spark.createDataFrame([(20, far), (40, far)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="does not fit"):
            topk.search(bad, F.col("vec_id") % 20 == 0).collect()


def test_tiles_broadcast_nothing(spark, monkeypatch):
    random = np.random.default_rng(6)
    rows = [(i, [float(x) for x in random.normal(0, 0.3, 4)]) for i in range(700)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = [[int(np.floor(64 * x)) for x in v] for _, v in rows]
    want = {(i, rank, *hit) for i in range(0, 700, 5) for rank, hit in enumerate(plain_top(range(700), vectors, (i, vectors[i]), 3), 1)}
    for shape in ((11, 20), (4, 3), (1, 1)):
        monkeypatch.setattr(topk, "tile_counts", lambda *_, shape=shape: shape)
        found = topk.search(data, F.col("vec_id") % 5 == 0, k=3, rows=64, query_rows=7)
        plan = found._jdf.queryExecution().executedPlan().toString()
        # Small as they look, the packs are taken once for every area of blocks.
        assert not re.search("Broadcast|Join", plan), plan
        assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()} == want


def test_tiles_are_bounded():
    for blocks, packs, tasks in ((1, 1, 8), (2, 11, 6), (19, 121, 6), (480, 2883, 6), (480, 2883, 400)):
        areas, groups = topk.tile_counts(blocks, packs, tasks)
        assert 1 <= areas <= blocks and 1 <= groups <= packs
        assert -(-blocks // areas) <= topk.AREA and -(-packs // groups) <= topk.GROUP
        assert areas * groups >= min(8 * tasks, areas * packs)


def test_slices_add_up():
    random = np.random.default_rng(3)
    vectors = random.integers(-9, 9, (130, 5)).astype(np.int32)
    slices, bits = topk.bit_slices(vectors, -9)
    total = topk.add_slices([[slices[:, i]] for i in range(bits)])
    back = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(int) << p for p, s in enumerate(total) if s is not None)
    assert back.tolist() == (vectors + 9).sum(axis=1).tolist()


@pytest.mark.parametrize("together", [1, 3])
def test_blocks_equal_brute_force(monkeypatch, together):
    random = np.random.default_rng(4)
    for dims in (1, 4, 7):
        for far in (1, 3, 100, 2**29):
            vectors, ids = random.integers(-far, far, (300, dims)), np.sort(random.integers(0, 200, 300))
            monkeypatch.setattr(topk, "TOGETHER", together)
            block = topk.Block(ids, topk._narrow(vectors), topk.bit_slices(vectors, int(vectors.min()))[0])
            assert block.together == together
            for i in range(20):
                query = random.integers(-far, far, dims + i % 3)
                got = block.top(int(ids[i]), query, 5)
                assert list(zip(*map(np.ndarray.tolist, got), strict=True)) == plain_top(
                    ids.tolist(), vectors.tolist(), (ids[i], query.tolist()), 5
                )
