import hashlib
import math

import numpy as np
import pytest

from tidemark.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    """The contract by plain loops over whole numbers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max((len(r[1]) for r in kept), default=0)
    whole = [[math.floor(scale * float(np.float32(x))) for x in r[1]] for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, whole[i]))
    full = [v + [0] * (width - len(v)) for v in whole]
    bounds = [p * width // parts for p in range(parts + 1)]
    code, error, books = [""] * len(kept), [0] * len(kept), []
    for p in range(parts):
        mine = [v[bounds[p] : bounds[p + 1]] for v in full]
        book = [mine[i] for i in order[:entries]]
        near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(book))  # noqa: B023, E731
        for _ in range(rounds):
            got = [near(v)[1] for v in mine]
            means = list(book)
            for e in set(got):
                own = [v for v, g in zip(mine, got) if g == e]
                means[e] = [sum(c) // len(own) for c in zip(*own)]
            book = means
        for i, v in enumerate(mine):
            d, e = near(v)
            code[i] += f"{e:02x}"
            error[i] += d
        books += [x for e in book for x in e]
    by_label = {}
    for r, e in zip(kept, error):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return [(r[0], c, e, by_label[r[2]]) for r, c, e in zip(kept, code, error)], digest


def result(spark, given, **kw):
    df = spark.createDataFrame(given, SCHEMA).repartition(3).selectExpr("*", "1 AS n", "2 AS v", "'x' AS Label", "0 AS code")
    found = vector_codes.compress(df, **kw)
    out = vector_codes.with_label_errors(found.rows).select("vec_id", "code", "error", "label_error").collect()
    return [tuple(r) for r in out], vector_codes.books_digest(found.books)


def vectors(n, dims, seed=3):
    r = np.random.default_rng(seed)
    centre = r.normal(0, 0.3, (10, dims))
    return [(int(i), [float(x) for x in centre[i % 10] + r.normal(0, 0.05, dims)], int(i % 7)) for i in r.permutation(n)]


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize(
    "rows",
    [
        vectors(300, 32),
        # Copies (a third of all rows), nulls, non-finite components, no label, repeated and absent ids.
        vectors(150, 32)
        + [(1000 + i, [0.25] * 32, None) for i in range(90)]
        + [(3, [0.5] * 32, 1), (3, [-0.5] * 32, 1), (None, [0.1] * 32, 2), (7, None, 1), (8, [None] * 32, 1)]
        + [(9, [float("nan")] + [0.0] * 31, 1), (10, [float("inf")] + [0.0] * 31, 1)],
        [(i, [0.5, -0.25] * 10 + [float(i % 3)], i % 2) for i in range(30)],  # 21 components, fewer rows than entries
        [(1, [], 1), (2, [1.5, 2.5], 1), (3, [0.5] * 16, None)],
        [(1, [], None)],
        vectors(120, 16 * 40),  # high dimensions
    ],
)
def test_equals_brute_force(spark, rows):
    want, digest = brute(rows)
    got, got_digest = result(spark, rows, rows=64)
    assert _sorted(got) == _sorted(want)
    assert got_digest == digest


def test_empty(spark):
    assert result(spark, [(1, None, 1)])[0] == []


def test_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        result(spark, [(1, [1e9] * 16, 1), (2, [0.0] * 16, 1)])


def test_subtrees_are_assigned_whole():
    """Well apart clusters: few points are compared, and the result is exact."""
    r = np.random.default_rng(1)
    centre = r.integers(-4000, 4000, (20, 4))
    points = (centre[r.integers(0, 20, 5000)] + r.integers(-20, 20, (5000, 4))).astype(np.int64)
    tree = vector_codes.CoverTree.build(points)
    ranges, single, _ = vector_codes.assign(tree, points, centre.astype(np.int64))
    assert sum(b - a for a, b, _ in ranges) > 0.95 * len(points)
    apart = ((points[:, None] - centre[None]) ** 2).sum(axis=2)
    assert (vector_codes.codes(tree, points, centre.astype(np.int64)) == apart.argmin(axis=1)).all()


def test_cover_tree_invariants():
    points = np.random.default_rng(2).integers(0, 500, (3000, 3))
    tree = vector_codes.CoverTree.build(points)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    for i in range(len(tree.centre)):
        mine = points[tree.order[tree.start[i] : tree.end[i]]]
        assert np.sqrt(((mine - points[tree.centre[i]]) ** 2).sum(axis=1)).max() <= tree.radius[i] + 1e-9
        kids = range(tree.child[i], tree.child[i + 1])
        assert all(tree.radius[k] <= tree.radius[i] / 2 + 1e-9 for k in kids)
        centres = points[tree.centre[list(kids)]]
        if len(centres) > 1:
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
            assert apart[~np.eye(len(centres), dtype=bool)].min() > tree.radius[i] / 2
