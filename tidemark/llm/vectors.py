"""What the vector operators share: usable vectors and folding of equal ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Not null, not empty or zero, every component finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(embedding, lambda x: x != 0)
    return F.coalesce(embedding.isNotNull() & ~bad & some, F.lit(False))


def vector_key(embedding: Column) -> list[Column]:
    """A 128-bit key of a vector's components; minus zero counts as zero."""
    plain = F.transform(embedding, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))
    return [F.xxhash64(plain).alias("key_a"), F.xxhash64(F.lit(7), plain).alias("key_b")]


def usable_vectors(frame: DataFrame) -> DataFrame:
    """vec_id, label, embedding (double), key_a, key_b of the rows that take part."""
    label = F.col("label") if "label" in frame.columns else F.lit(None).cast("int")
    rows = frame.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        label.alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    return rows.withColumns({c: k for c, k in zip(("key_a", "key_b"), vector_key(F.col("embedding")), strict=True)})


def matrix(column) -> np.ndarray:
    """Rows of a pandas column of equally long lists."""
    return np.array(column.to_list(), dtype=np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length; very large or small components are scaled first."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of a with the same rows of b; the one measure that decides links."""
    return np.einsum("ij,ij->i", a, b)


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each row of a and each of b have an inner product of at least threshold, as dots() has it.

    A matrix product rounds differently, so it decides only where it is clear of the threshold.
    """
    s = a @ b.T
    near = s >= threshold
    i, j = np.nonzero(np.abs(s - threshold) < 1e-9)
    near[i, j] = dots(a[i], b[j]) >= threshold
    return near


def forest(pairs: np.ndarray) -> np.ndarray:
    """Pairs (smallest member, other) that join what the rows of pairs join: one for each member but one."""
    nodes, at = np.unique(pairs, return_inverse=True)
    u, v = at.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        np.minimum.at(new, u, root[v])
        np.minimum.at(new, v, root[u])
        np.minimum.at(new, root, new)  # what a member reaches, its root reaches
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return np.stack([nodes[root[other]], nodes[other]], 1)
