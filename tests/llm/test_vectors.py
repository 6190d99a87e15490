"""Top-k search and code compression against brute force."""

import hashlib
import math

import numpy as np
import pytest

from siftwright.llm import codes, topk, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, id long, score string, shard int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, "x", 2) for i, v, label in rows], SCHEMA)


def odd_rows():
    return [(None, [1.0, 2.0, -1.0, 0.5], None), (7, None, 1), (8, [1.0, None, 1.0, 1.0], 1), (9, [math.nan, 1, 1, 1], 1), (10, [math.inf, 1, 1, 1], 1)]


def many(seed, n, dim, spread=3.0, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.integers(-8, 9, dim) * spread / 8 + rng.random()).tolist(), int(rng.integers(0, 3)) if i % 5 else None) for i in range(n)]
    return rows + [(n + i, rows[3][1], 1) for i in range(copies)]  # a third or more of one vector


def whole(rows):
    return [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def best(rows, k, every=100):
    out = []
    kept = whole(rows)
    for at, (i, v, _) in enumerate(kept):
        if i is None or i % every:
            continue
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), math.inf if j is None else j) for n, (j, w, _) in enumerate(kept) if n != at)[:k]
        out += [(i, r + 1, None if j == math.inf else j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out, key=str)


def found(df, k=10, every=100, **how):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, lambda c: c % every == 0, k=k, **how).collect()), key=str)


@pytest.mark.parametrize("dim, copies", [(4, 0), (4, 200), (1, 0), (16, 100)])
def test_search_equals_brute_force(spark, dim, copies):
    rows = many(dim, 300, dim, copies=copies)
    rows += [rows[0], rows[0], rows[100]] + (odd_rows() if dim == 4 else [])  # repeated rows are rows of their own
    df = frame(spark, rows)
    assert found(df, every=20, shard=64, block=5, shards_per_task=2) == best(rows, 10, 20)
    assert found(df.repartition(1), every=20) == best(rows, 10, 20)


def test_search_of_few_and_none(spark):
    rows = [(0, [1, 2], 1), (100, [3, -1], 1), (5, [0.5, 0.25], None)]
    assert found(frame(spark, rows)) == best(rows, 10)
    assert found(frame(spark, [(0, [1, 2], 1)])) == []
    assert found(frame(spark, rows).limit(0)) == []
    assert found(frame(spark, rows[2:])) == []
    mixed = frame(spark, [*rows, (200, [1, 2, 3], 1), (300, [1, 1, 1], 1)])  # other lengths aren't compared
    assert {(q, v) for q, _, v, _ in found(mixed)} == {(0, 100), (0, 5), (100, 0), (100, 5), (200, 300), (300, 200)}


def test_trees_are_whole_and_tight():
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.integers(-50, 50, (500, 6)), np.tile(rng.integers(-50, 50, 6), (300, 1))])
    ids = rng.permutation(len(v)).astype(np.int64)
    tree = topk.Tree.build(np.arange(len(v)), ids, v, leaf=16)
    leaves = np.flatnonzero(tree.left < 0)
    assert sorted(x for n in leaves for x in range(tree.start[n], tree.stop[n])) == list(range(len(v)))
    for n in range(len(tree.left)):
        own = tree.vectors[tree.start[n] : tree.stop[n]]
        assert (own.min(axis=0) == tree.low[n]).all() and (own.max(axis=0) == tree.high[n]).all()
    assert {tuple(r) for r in np.column_stack([tree.rows, tree.ids, tree.vectors]).tolist()} == {tuple(r) for r in np.column_stack([np.arange(len(v)), ids, v]).tolist()}


def test_low_dimensions_prune(monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.integers(-1000, 1000, (4096, 2))
    tree = topk.Tree.build(np.arange(4096), np.arange(4096), v)
    scored = []
    monkeypatch.setattr(topk, "products", lambda a, b, f=topk.products: scored.append(a.shape[0] * b.shape[1]) or f(a, b))
    scores, ids = np.full((20, 10), topk.NONE), np.full((20, 10), topk.NO_ID)
    topk.search(tree, v[:20], np.arange(20), scores, ids, np.full(20, topk.NONE))
    assert sum(scored) < 0.25 * 20 * 4096


def test_exact_products():
    a = np.array([[2**40 + 1, 1], [3, -(2**20)]])
    b = np.array([[2**20 + 1, 5], [7, 2]])
    assert vectors.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in b.T] for r in a]
    with pytest.raises(OverflowError):
        vectors.products(np.array([[2**40]]), np.array([[2**40]]))


def lloyd(rows, parts, entries, rounds):
    kept = sorted(whole(rows), key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    squared = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, part: min((squared(part, e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for c in cut:
                own[nearest(p, c[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(x) for x in zip(*o, strict=True)] if o else e for o, e in zip(own, books[p], strict=True)]
    out, by = [], {}
    for (i, _, label), c in zip(kept, cut, strict=True):
        best = [nearest(p, c[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
        by[label] = by.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by[label], digest) for i, c, e, label in out), key=str)


def compressed(df, **how):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in codes.compress(df, **how).collect()), key=str)


@pytest.mark.parametrize("entries, copies", [(12, 0), (5, 150), (1, 0), (256, 10)])
def test_codes_equal_plain_lloyd(spark, entries, copies):
    rows = many(entries, 200, 8, copies=copies)
    rows += rows[:5]
    df = frame(spark, rows)
    assert compressed(df, entries=entries, chunk=37) == lloyd(rows, 4, entries, 4)
    assert compressed(df.repartition(3), entries=entries) == lloyd(rows, 4, entries, 4)


def test_codes_of_odd_rows_and_none(spark):
    rows = many(9, 30, 4) + odd_rows()
    assert compressed(frame(spark, rows), entries=6) == lloyd(rows, 4, 6, 4)
    assert compressed(frame(spark, rows).limit(0)) == []
    assert compressed(frame(spark, odd_rows()[1:])) == []
    with pytest.raises(ValueError, match="components"):
        codes.compress(frame(spark, [(1, [1, 2, 3], 1)]))


def test_rounds_measure_only_what_drift_has_reached(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(0, 10, (16, 8))
    rows = [(i, (centers[i % 16] + rng.normal(0, 0.3, 8)).tolist(), 0) for i in range(2000)]
    _, _, measured = codes.fit(frame(spark, rows), entries=16)
    assert measured[0] == 8000 and sum(measured[1:]) < 0.5 * 4 * 8000
    assert compressed(frame(spark, rows), entries=16) == lloyd(rows, 4, 16, 4)
