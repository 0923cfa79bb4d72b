"""Nearest neighbours and vector near-dedup against all pairs."""

import numpy as np
import pytest

from tidemark.llm import ann, vector_dedup

NAN = float("nan")


def vectors(n=700, wide=16, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, wide)).astype(np.float32)
    x[50:120] = x[50] + rng.normal(size=(70, wide)).astype(np.float32) * 0.05  # a crowded cluster
    x[200:280] = x[200]  # copies
    x[300] = x[301] * np.float32(1.02)
    return [(i, [float(c) for c in v], i % 3 if i >= 300 else 0) for i, v in enumerate(x)]


ODD = [
    (9001, None, 0), (9002, [], 0), (9003, [0.0] * 16, 0), (9004, [NAN] * 16, 0), (9005, [float("inf")] + [1.0] * 15, 0),
    (9006, [None] + [1.0] * 15, 0), (9050, [1.0, 2.0], 0), (9007, vectors()[0][1], None), (None, [1.0] * 16, 0),
]
SCHEMA = "vec_id bigint, embedding array<float>, label int"


def cosine_table(rows):
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    return (x @ x.T) / np.outer(*[np.linalg.norm(x, axis=1)] * 2)


def test_nearest(spark):
    rows = vectors()
    frame = spark.createDataFrame([*rows, *ODD[:7], ODD[8]], SCHEMA)
    from pyspark.sql import functions as F

    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    s = cosine_table(rows)
    assert set(got) == {r[0] for r in rows if r[0] % 10 == 0}
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert all(f[2] == pytest.approx(s[q, f[1]], abs=1e-12) for f in found) and q not in [f[1] for f in found]
        order = sorted((-f[2], f[1]) for f in found)
        assert [f[1] for f in found] == [v for _, v in order]
        want = sorted(((-round(s[q, v], 12), v) for v in range(len(rows)) if v != q))[:5]
        hit += len({v for _, v in want} & {f[1] for f in found})
    assert hit >= 0.95 * 5 * len(got)
    assert [f[1] for f in sorted(got[250])] == [200, 201, 202, 203, 204]
    assert [f[1] for f in sorted(got[200])] == [201, 202, 203, 204, 205]


def test_nearest_of_few(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (2, [0.0, 1.0], None)], SCHEMA)
    got = [(r["rank"], r.vec_id) for r in ann.nearest(frame, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2)]
    assert ann.nearest(frame.where("false"), F.col("vec_id") == 0).count() == 0


def test_graph_search_finds_the_nearest_centroids():
    x = np.random.default_rng(8).normal(size=(4000, 12))
    index = ann.Index(x, 128, 5)
    assert len(index.centroids) == 128
    q = ann.unit(np.random.default_rng(9).normal(size=(50, 12)))
    ids, dist = index.search(q, 32)
    true = np.argsort(index.distances(q, index.centroids), axis=1)[:, :8]
    assert np.mean([len(set(a[:8]) & set(b)) / 8 for a, b in zip(ids, true, strict=True)]) > 0.95
    assert all(len(set(row[np.isfinite(d)])) == np.isfinite(d).sum() for row, d in zip(ids, dist, strict=True))


def test_near_duplicates(spark):
    rows = vectors()
    frame = spark.createDataFrame([*rows, *ODD], SCHEMA)
    got = {r.vec_id: r for r in vector_dedup.near_duplicate_vectors(frame).collect()}
    assert len(got) == len(rows) + len(ODD)
    s = cosine_table(rows)
    label = np.array([r[2] for r in rows])
    near = (s >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    part = np.arange(len(rows))
    for _ in range(len(rows)):
        new = np.minimum(part, np.where(near, part[None], len(rows)).min(1))
        if (new == part).all():
            break
        part = new
    for i in range(len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), part[i], part[i] == i)
    for i, _, _ in ODD:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, i is not None)


def test_blocks_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "MEMBERS", 16)
    rows = [(i, [float(c) for c in 10 * np.ones(8) + np.random.default_rng(i).normal(size=8)], 1) for i in range(90)]
    got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    s = cosine_table(rows)
    assert got == {i: int((s[i] >= 0.98).sum()) - 1 for i in range(90)}


def test_pairs_in_a_crowd_are_found(spark):
    """Isolated pairs at 0.982 among vectors of one direction, as the passes for evenly spread ones miss many."""
    rng = np.random.default_rng(12)
    n, wide = 6000, 64
    x = rng.normal(size=(n, wide))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:, 0] += 5.0  # cosines of about 0.96
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 200, 2):
        side = rng.normal(size=wide)
        side -= side @ x[i] * x[i]
        x[i + 1] = 0.9835 * x[i] + np.sqrt(1 - 0.9835**2) * side / np.linalg.norm(side)
    frame = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], SCHEMA)
    got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicate_vectors(frame).collect()}
    want = (x @ x.T >= 0.98).sum(1) - 1
    assert (want[:200] > 0).all()
    assert [got[i] for i in range(n)] == want.tolist()


def test_empty(spark):
    assert vector_dedup.near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
