"""Embedding near-dedup by sorted projection passes.

Method. Equal vectors are folded into one first. In each pass every vector gets the concatenated signs
of BITS random projections, and vectors are ordered by (label, length, that key). Each is compared with
the next WINDOW ones in the order; pairs with a cosine of at least `threshold` are links. A block emits a
spanning forest of its links, and those of all passes are united into components. The number of passes follows from the largest label's count, as
though vectors were spread evenly. How crowded each vector's place is in each pass is then measured: a
vector within WINDOW rows of all that share its first d bits meets a pair at the threshold with the
probability that these bits agree. Vectors whose passes together leave a chance above MISS are compared
with each other exactly, block against block of about CROWD vectors; of a missed pair both are such.

All passes are one job: a range partitioning orders the keys, row numbers make blocks of BLOCK rows
that overlap by WINDOW, and each block is a task's group of bounded size. A crowded cluster has more
pairs than windows hold; so within each component found, degrees are counted exactly, block against
block of at most MEMBERS vectors, without emitting a pair. Copies count by multiplicity.

Nulls: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
label, link with nothing. Rows with a null vec_id have a null component. Vectors of different length
don't link. Repeated rows (equal vec_id) are copies like others. Extra columns are ignored. No vectors
give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import connected_components
from .vectors import dots, forest, linked, matrix, unit, usable, usable_vectors

BITS, WINDOW, BLOCK, MEMBERS = 48, 32, 4096, 1024
MISS = 1e-5
#: Crowded vectors of a block; bits by which the passes allow for uneven crowding.
CROWD, SPARE = 4096, 3


def agreement(threshold: float) -> float:
    """Probability that a projection gives two vectors at the threshold the same sign."""
    return 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi


def passes_for(n: int, threshold: float) -> int:
    """Passes for n vectors of one label, evenly spread, such that a pair at the threshold is missed with MISS."""
    p = agreement(threshold) ** (SPARE + math.log2(max(2.0, n / WINDOW)))
    return max(6, math.ceil(math.log(MISS) / math.log(max(1e-9, 1 - p))))


def lost(keys: np.ndarray, groups: np.ndarray, threshold: float) -> np.ndarray:
    """Logarithms of the chance that a row, of rows in order of (group, key), doesn't meet a pair at the threshold."""
    n = len(keys)
    shared = np.zeros(n + WINDOW)  # bits that must agree more than with the row WINDOW later; 0: none so far in the group
    if n > WINDOW:
        differ = np.frexp((keys[WINDOW:] ^ keys[:-WINDOW]).astype(np.float64))[1]
        shared[WINDOW:n] = np.where((groups[WINDOW:] == groups[:-WINDOW]).reshape(len(differ), -1).all(1), BITS - differ + 1, 0)
    depth = np.maximum(shared[:n], shared[WINDOW:])
    p = np.where(depth > BITS, 0.0, agreement(threshold) ** depth)
    return np.log1p(-np.minimum(p, 1 - 1e-12))


def projection_keys(x: np.ndarray, passes: int, seed: int) -> np.ndarray:
    """(rows, passes) integers whose bits are the signs of projections, the first the highest."""
    planes = np.random.default_rng(seed).standard_normal((x.shape[1], passes * BITS))
    bits = (x @ planes > 0).reshape(len(x), passes, BITS)
    return bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def near_duplicate_vectors(frame: DataFrame, threshold: float = 0.98, seed: int = 1) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row a row of frame (vec_id, embedding, label)."""
    spark = frame.sparkSession
    rows = usable_vectors(frame).where("label is not null").withColumn("size", F.size("embedding"))
    keys = ["label", "size", "key_a", "key_b"]
    folded = rows.groupBy(*keys).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    folded = materialize(spark, folded, "folded")
    placed = materialize(spark, rows.join(folded, keys).select("vec_id", "rep", "copies", "label", "size", "embedding"), "placed")
    distinct = placed.where("vec_id = rep").dropDuplicates(["rep", "label", "size"])
    largest = distinct.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    passes = passes_for(largest, threshold)

    def hashed(batches):
        for pdf in batches:
            for size, part in pdf.groupby("size"):
                k = projection_keys(matrix(part["embedding"]), passes, seed)
                n = len(part)
                yield pd.DataFrame(
                    {
                        "pass": np.tile(np.arange(passes), n),
                        "label": np.repeat(part["label"].to_numpy(), passes),
                        "size": size,
                        "key": k.ravel(),
                        "rep": np.repeat(part["rep"].to_numpy(), passes),
                    }
                )

    narrow = distinct.select("rep", "label", "size", "embedding").mapInPandas(hashed, "pass int, label int, size int, key bigint, rep bigint")
    order = ["pass", "label", "size", "key", "rep"]
    ordered = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    ordered = ordered.select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("within"))
    ordered = materialize(spark, ordered, "ordered")
    starts, total = [], 0
    for r in ordered.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # one row a partition
        starts.append((r["part"], total))
        total += r["n"]
    offsets = spark.createDataFrame(starts, "part bigint, offset bigint")
    numbered = ordered.join(F.broadcast(offsets), "part").withColumn("number", F.col("offset") + F.col("within"))
    block = F.floor(F.col("number") / BLOCK).cast("bigint")
    earlier = F.when((F.col("number") % BLOCK < WINDOW) & (block > 0), block - 1)
    later = F.when(F.col("number") % BLOCK >= BLOCK - WINDOW, block + 1)
    blocks = F.explode(F.array_compact(F.array(block, earlier, later))).alias("block")
    member = numbered.select("rep", "pass", "label", "size", "number", "key", blocks)
    vectors = distinct.select("rep", "label", "size", "embedding")

    def windows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("number")
        out, chances = [], []
        for size, part in pdf.groupby("size"):
            x, number = unit(matrix(part["embedding"])), part["number"].to_numpy()
            pas, label, rep = part["pass"].to_numpy(), part["label"].to_numpy(), part["rep"].to_numpy()
            for d in range(1, min(WINDOW, len(part) - 1) + 1):
                near = (number[d:] - number[:-d] <= WINDOW) & (pas[d:] == pas[:-d]) & (label[d:] == label[:-d])
                near &= dots(x[:-d], x[d:]) >= threshold
                if near.any():
                    a, b = rep[:-d][near], rep[d:][near]
                    out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
            chance = pd.DataFrame({"u": rep, "label": label, "size": size})
            chance["lost"] = lost(part["key"].to_numpy(), np.stack([pas, label], 1), threshold)
            chances.append(chance[number // BLOCK == pdf["block"].iloc[0]].groupby(["u", "label", "size"], as_index=False).sum())
        pairs = forest(np.concatenate(out)) if out else np.zeros((0, 2), np.int64)
        links = pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})
        return pd.concat([links, *chances])[["u", "v", "label", "size", "lost"]].astype({"v": "Int64", "label": "Int64", "size": "Int64"})

    met = member.join(vectors, ["rep", "label", "size"])
    seen = met.groupBy("block").applyInPandas(windows, "u bigint, v bigint, label bigint, size bigint, lost double")
    seen = materialize(spark, seen, "seen")
    links = materialize(spark, seen.where("v is not null").select("u", "v").distinct(), "links")
    parts = connected_components(spark, links)
    chances = seen.where("v is null").groupBy(F.col("u").alias("rep"), "label", "size").agg(F.sum("lost").alias("lost"))
    crowd = materialize(spark, chances.where(F.col("lost") > math.log(MISS)).select("rep", "label", "size"), "crowd")
    if not crowd.isEmpty():
        further = materialize(spark, _crowd_links(distinct.join(crowd, ["rep", "label", "size"]), parts, threshold), "further")
        if not further.isEmpty():
            parts = connected_components(spark, links.unionAll(further))
    degrees = _degrees(distinct, parts, threshold)
    out = placed.select("vec_id", "rep", "copies").join(materialize(spark, degrees, "degrees"), "rep", "left")
    out = out.select(
        "vec_id",
        (F.coalesce("around", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    alone = frame.where(
        F.col("label").isNull() | F.col("vec_id").isNull() | ~usable(F.col("embedding").cast("array<double>"))
    ).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").cast("bigint").alias("component_id"))
    out = out.unionAll(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _crowd_links(crowd: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """u, v: components of crowd's vectors that a pair at the threshold or above ties together.

    m vectors of a label make ceil(m / CROWD) blocks, each compared with each other.
    """
    spark = crowd.sparkSession
    counts = materialize(spark, crowd.groupBy("label", "size").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("blocks")), "counts")
    rows = crowd.join(counts, ["label", "size"]).join(parts, F.col("rep") == F.col("node"), "left")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "size", "embedding", "mine",
        F.coalesce("component", "rep").alias("component"),
        F.least("mine", "other").alias("i"),
        F.greatest("mine", "other").alias("j"),
    )

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        x, comp, mine = unit(matrix(pdf["embedding"])), pdf["component"].to_numpy(), pdf["mine"].to_numpy()
        left, right = np.flatnonzero(mine == pdf["i"].iloc[0]), np.flatnonzero(mine == pdf["j"].iloc[0])
        out = [np.zeros((0, 2), np.int64)]
        for at in range(0, len(left), 512):
            some = left[at : at + 512]
            a, b = np.nonzero(linked(x[some], x[right], threshold) & (comp[some][:, None] != comp[right][None]))
            out.append(np.unique(np.sort(np.stack([comp[some[a]], comp[right[b]]], 1), 1), axis=0))
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["u", "v"])

    return spread.groupBy("label", "size", "i", "j").applyInPandas(across, "u bigint, v bigint").distinct()


def _degrees(distinct: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """rep, component, around: copies of other vectors of the component at the threshold or above.

    A component of m vectors makes ceil(m / MEMBERS) blocks, each compared with each other; components
    of one block share groups of about MEMBERS vectors.
    """
    spark = distinct.sparkSession
    sizes = parts.groupBy("component").agg(F.count("*").alias("m"))
    members = parts.join(materialize(spark, sizes, "sizes"), "component")
    members = distinct.select("rep", "copies", "label", "size", "embedding").join(members, F.col("rep") == F.col("node"))
    members = members.withColumn("blocks", F.ceil(F.col("m") / MEMBERS).cast("int"))
    members = members.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    small = parts.count()
    bins = max(1, small // MEMBERS)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = members.withColumn("other", other).select(
        "rep", "component", "copies", "embedding", "label", "size", "mine",
        F.when(F.col("blocks") > 1, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(bins))).alias("group"),
        F.least("mine", "other").alias("i"),
        F.greatest("mine", "other").alias("j"),
    )

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby(["component", "label", "size"]):
            x, copies = unit(matrix(part["embedding"])), part["copies"].to_numpy()
            near = linked(x, x, threshold)
            np.fill_diagonal(near, False)
            mine, i, j = part["mine"].to_numpy(), part["i"].iloc[0], part["j"].iloc[0]
            if i != j:  # only pairs across the two blocks; those within are counted in (i, i)
                near &= mine[:, None] != mine[None]
            out.append(pd.DataFrame({"rep": part["rep"], "component": part["component"], "around": near @ copies}))
        return pd.concat(out)

    counted = spread.groupBy("group", "i", "j").applyInPandas(count, "rep bigint, component bigint, around bigint")
    return counted.groupBy("rep", "component").agg(F.sum("around").alias("around"))
