"""Codes and clusters of integer vectors against plain loops, with odd rows and ties."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from boardsift.llm import clusters, codes
from boardsift.llm import vectors as vec

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, v string, cluster string"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, y, "own", "own", "own") for i, e, y in rows], SCHEMA)


def random_rows(seed: int, n: int, dims: int, grid: float = 0.0):
    rng = random.Random(seed)

    def one():
        x = rng.gauss(0, 0.3)
        return round(x / grid) * grid if grid else x

    rows = [(i, [one() for _ in range(dims)], rng.choice([None, 1, 2])) for i in range(n)]
    # repeated rows, repeated vectors, and rows that are dropped
    rows += [rows[3], (n + 1, rows[4][1], 2), (n + 2, None, 1), (n + 3, [0.5] * (dims - 1) + [None], 1),
             (n + 4, [math.nan] + [0.5] * (dims - 1), 1), (n + 5, [math.inf] * dims, None), (None, [0.25] * dims, None),
             (n + 6, [-math.inf] + [0.0] * (dims - 1), 2), (n + 7, [], 2)]
    rng.shuffle(rows)
    return rows


def kept(rows, dims):
    out = []
    for i, e, y in rows:
        if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e):
            out.append((i, [math.floor(1024 * float(np.float32(x))) for x in e], y))
    return out


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def best(x, entries):
    return min((squared(x, e), k) for k, e in enumerate(entries))


def mean_moved(points, entries):
    groups = {}
    for p in points:
        groups.setdefault(best(p, entries)[1], []).append(p)
    return [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e
            for k, e in enumerate(entries)]


@pytest.mark.parametrize("dims,grid", [(8, 0.0), (12, 0.5), (8, 0.25)])
def test_codes_equal_plain_search(spark, dims, grid):
    """Parts of 2 (a power of two) and 3 components (padded); a grid gives ties and empty entries."""
    cfg = codes.Settings(dims=dims, entries=6)
    rows = random_rows(dims, 60, dims, grid)
    good = kept(rows, dims)
    first = sorted((i, v) for i, v, _ in good if i is not None)[:6]
    w = cfg.width
    books = []
    for p in range(4):
        entries = [v[p * w:(p + 1) * w] for _, v in first]
        for _ in range(4):
            entries = mean_moved([v[p * w:(p + 1) * w] for _, v, _ in good], entries)
        books.append(entries)
    want = []
    for i, v, y in good:
        found = [best(v[p * w:(p + 1) * w], books[p]) for p in range(4)]
        want.append((str(i), y, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    out, got = codes.encoded(frame(spark, rows), cfg)
    assert [[[int(c) for c in e] for e in book] for book in got] == books
    assert sorted(map(str, ((str(r.vec_id), r.label, r.code, r.error) for r in out.collect()))) == sorted(map(str, want))
    back = {r.vec_id: list(r.v) for r in codes.decoded(out, got).collect()}
    code = {r.vec_id: r.code for r in out.collect()}
    assert all(back[i] == [c for p in range(4) for c in books[p][int(code[i][2 * p:2 * p + 2], 16)]] for i in back)


@pytest.mark.parametrize("dims,grid,leading", [(8, 0.0, 3), (8, 0.5, 2), (5, 0.0, 8)])
def test_clusters_equal_plain_search(spark, dims, grid, leading):
    cfg = clusters.Settings(dims=dims, clusters=5, rounds=6, leading=leading)
    rows = random_rows(dims + 100, 80, dims, grid)
    good = kept(rows, dims)
    at = [v for _, v in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v, _ in good if i is not None)[:5]]
    for _ in range(6):
        at = mean_moved([v for _, v, _ in good], at)
    out, got = clusters.clustered(frame(spark, rows), cfg)
    assert [[int(c) for c in row] for row in got] == at
    want = [(str(i), *best(v, at)[::-1]) for i, v, _ in good]
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in out.collect()) == sorted(want)


@pytest.mark.parametrize("make", [lambda df: codes.encoded(df, codes.Settings(dims=8))[0],
                                  lambda df: clusters.clustered(df, clusters.Settings(dims=8))[0]])
def test_few_rows_and_none(spark, make):
    assert make(frame(spark, [])).collect() == []
    assert make(frame(spark, [(1, None, 1), (2, [0.5], 1), (None, [0.5] * 8, 1)])).collect() == []
    rows = make(frame(spark, [(1, [0.5] * 8, 1), (1, [0.5] * 8, None)])).collect()
    assert len(rows) == 2 and all(r[-1] == 0 for r in rows)


def test_large_components_stay_exact(spark):
    """Beyond 64-bit sums Python's integers decide; what no long holds is null or dropped."""
    rows = [(i, [float((-1) ** i * (2**20 + 2 * i))] * 4 + [0.125 * i] * 4, 1) for i in range(6)] + [(9, [4e9] * 8, 1)]
    good = kept(rows[:6], 8)
    out, at = clusters.clustered(frame(spark, rows), clusters.Settings(dims=8, clusters=2, rounds=3))
    where = [[int(c) for c in row] for row in at]
    want = [(i, best(v, where)[1]) for i, v, _ in good]
    assert sorted((r.vec_id, r.cluster) for r in out.collect()) == want
    entries = [v[:4] for _, v, _ in good[:3]]
    index, distance = codes.nearest(np.array([v[:4] for _, v, _ in good]), np.array(entries, dtype=object))
    assert [(int(d), int(k)) for d, k in zip(distance, index)] == [best(v[:4], entries) for _, v, _ in good]


def test_transform_keeps_distances_and_orders_by_sequency():
    rng = np.random.default_rng(5)
    for width in (1, 2, 3, 5, 8, 16):
        a, b = rng.integers(-999, 999, (2, 40, width))
        n = codes.padded(width)
        assert (((codes.walsh(a) - codes.walsh(b)) ** 2).sum(1) == n * ((a - b) ** 2).sum(1)).all()
        rows = codes.walsh(np.eye(n, dtype=np.int64)).T
        assert ((np.diff(rows, axis=1) != 0).sum(1) == np.arange(n)).all()
    assert vec.as_long(np.array([2**70, 5], dtype=object)).to_pylist() == [None, 5]
