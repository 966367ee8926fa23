"""Near-duplicate vectors against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import embedding_dups as ed

VECTORS = "vec_id long, embedding array<float>, label int"
SF = "/root/testdata/sf0.01"


def plain(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept) of each row by all pairs."""
    ok = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    n, near = len(rows), np.zeros((len(rows), len(rows)), bool)
    for size in {len(rows[i][1]) for i in ok}:
        at = [i for i in ok if len(rows[i][1]) == size]
        x = np.array([rows[i][1] for i in at], np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near[np.ix_(at, at)] = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], n).min(axis=1, initial=n))
        if (new == label).all():
            break
        label = new
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        low = min(ids, default=None)
        out.append((rows[i][0], int(near[i].sum()), low, rows[i][0] is not None and rows[i][0] == low))
    return sorted(out, key=repr)


def told(df):
    return sorted([tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in df.collect()], key=repr)


def planted(sizes, d=32, seed=5, spread=0.25):
    """Groups about random centres, cosines mostly above 0.9, and as many vectors alone; 32-bit components."""
    rng, out = np.random.default_rng(seed), []
    for size in sizes:
        c = rng.standard_normal(d)
        c /= np.linalg.norm(c)
        for _ in range(size):
            e = rng.standard_normal(d)
            out.append(c + spread * e / np.linalg.norm(e))
    out = [*out, *rng.standard_normal((sum(sizes), d))]
    ids = rng.permutation(len(out))
    return [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(ids, out)]


@pytest.mark.parametrize("window, block, rounds, sizes", [(64, 2048, 2, [2] * 60 + [3] * 20 + [40, 90]), (8, 16, 2, [2] * 60 + [5] * 10 + [150]), (4, 9, 1, [2] * 40 + [64])])
def test_links_equal_all_pairs(spark, monkeypatch, window, block, rounds, sizes):
    monkeypatch.setattr(ed, "BLOCK", block)
    monkeypatch.setattr(ed, "ROUNDS", rounds)
    rows = planted(sizes)
    df = spark.createDataFrame([(*r, 0) for r in rows], VECTORS).repartition(5)
    got, want = told(ed.near_duplicates(df, window=window)), plain(rows)
    assert sum(x[1] for x in want) > 500
    # found with a probability of 0.999 or more for each pair: the planted ones are all found here
    assert got == want


def test_borders_between_short_partitions(spark):
    """Three partitions of a window's length or less see each other's rows."""
    rows = planted([2] * 12, seed=9)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert told(ed.near_duplicates(spark.createDataFrame([(*r, 0) for r in rows], VECTORS), window=40)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_odd_vectors_repeats_and_clashing_columns(spark):
    rows = [
        (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (None, [1.0, 0.05]), (None, None),
        (9, [0.0, 1.0, 0.0]), (10, [0.0, 3.0]), (-4, [0.0, 5.0]), (11, [-1.0, 0.0]), (12, [1e-30, 0.0, 0.0]), (13, [1e30, 0.0, 0.0]), (None, [-0.1, -9.0]), (None, [-0.1, -9.0]),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], VECTORS).withColumns({c: F.lit(1) for c in ("digest", "raw", "kid", "low", "times", "n_links", "component_id", "block")})
    assert told(ed.near_duplicates(df)) == plain(rows)
    assert ed.near_duplicates(df.limit(0)).count() == 0
    wide = spark.createDataFrame([(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (3, [1.0, -1.0])], "vec_id long, embedding array<double>")
    assert told(ed.near_duplicates(wide)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_given_table_equals_all_pairs(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert told(ed.near_duplicates(df)) == plain([(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_more_passes_for_more_vectors():
    """A pair of the least cosine meets in one of the passes nearly always."""
    n, window = 4000, 16
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = rng.standard_normal((n, 64))
    e -= (e * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(1 - 0.81) * e / np.linalg.norm(e, axis=1, keepdims=True)
    both, met = np.concatenate([x, y]), np.zeros(n, bool)
    assert ed.passes(10) == 1 < ed.passes(2 * n, window) < ed.passes(10**9, window)
    for turn in range(ed.passes(2 * n, window)):
        at = np.empty(2 * n, np.int64)
        at[np.argsort(ed.keys(both, turn), kind="stable")] = np.arange(2 * n)
        met |= np.abs(at[:n] - at[n:]) <= window
    assert met.mean() >= 0.99
