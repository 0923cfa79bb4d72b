"""Approximate nearest neighbours by balanced posting lists.

Method. A bounded sample of vectors is split in halves again and again, which gives leaves of equal
size; their means are the centroids. Every vector goes to the posting list of its nearest centroid, and
a boundary vector also to further lists whose centroid is almost as near (ratio CLOSURE) and not on the
same side as one it has already. Centroids are searched by beam search over an in-memory graph of each
centroid's nearest ones. Of the lists found, a query probes those whose distance is within a ratio of
the nearest's; the ratio is calibrated on the sample, so that TARGET of the true neighbours of sample
queries lie in probed lists. Scores are exact cosines, in double precision, of the original vectors.

Bounds. The sample (`sample` vectors at most) and the centroids (`most_lists`) are parameters; nothing
else comes to the driver but two counts for each list. Equal vectors are folded first: of a vector's
copies only the `k` + 1 smallest ids can be among a query's k nearest, so a vector that a third of all
rows share is one entry. Neighbouring lists share a bin of about BLOCK vectors; a list longer than
BLOCK is cut into blocks and a bin with more queries than QUERIES into query shares, each pair of which
is one group, so a hot list is never one task.

Nulls: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
rows without vec_id; vectors of another length than most of the sample take no part either. Repeated
rows (equal vec_id and vector) count once. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import matrix, unit, usable_vectors

DEGREE, REPLICAS, CLOSURE, TARGET = 16, 4, 1.1, 0.97
BLOCK, QUERIES = 4096, 4096


class Index:
    """Centroids, their graph and the ratio up to which lists are probed."""

    def __init__(self, sample: np.ndarray, lists: int, k: int, seed: int = 1):
        x = unit(sample)
        self.centroids = self._halve(x, lists, np.random.default_rng(seed))
        n = len(self.centroids)
        d = self.distances(self.centroids, self.centroids)
        near = np.argsort(d, axis=1, kind="stable")[:, : DEGREE + 1]
        # nearest ones, and a few random edges that keep the graph connected
        far = np.random.default_rng(seed + 1).integers(0, n, (n, 4))
        ring = (np.arange(n)[:, None] + 1) % n
        self.graph = np.concatenate([near, far, ring], 1)
        self.ratio, self.beam = 1.0, n
        self._calibrate(x, k)

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))

    @staticmethod
    def _halve(x: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
        """Means of the leaves of repeated balanced two-way splits."""
        parts = [x]
        while len(parts) < lists and max(map(len, parts)) > 1:
            parts.sort(key=len, reverse=True)
            part = parts.pop(0)
            a, b = part[rng.integers(len(part))], part[rng.integers(len(part))]
            half = len(part) // 2
            for _ in range(6):
                order = np.argsort(part @ (a - b), kind="stable")
                a, b = part[order[half:]].mean(0), part[order[:half]].mean(0)
            parts += [part[order[half:]], part[order[:half]]]
        return np.stack([p.mean(0) for p in parts])

    def _calibrate(self, x: np.ndarray, k: int) -> None:
        """Ratio and beam from the true neighbours of up to 200 vectors of the sample."""
        queries = x[:: max(1, len(x) // 200)][:200]
        best = np.argsort(-(queries @ x.T), axis=1, kind="stable")[:, 1 : k + 1]
        if not best.size:
            return
        d = self.distances(queries, self.centroids)
        home = self.distances(x, self.centroids).argmin(1)
        ratios = np.take_along_axis(d, home[best], 1) / np.maximum(d.min(1, keepdims=True), 1e-9)
        self.ratio = float(max(CLOSURE, np.quantile(ratios, TARGET)))
        probed = (d <= self.ratio * d.min(1, keepdims=True)).sum(1)
        self.beam = int(min(len(self.centroids), max(32, np.ceil(1.25 * probed.max()))))

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, beam) nearest centroids and distances by beam search over the graph, all rows at once."""
        n, total = len(x), len(self.centroids)
        beam = min(beam, total)
        seen = np.zeros((n, total), bool)
        start = np.unique(np.linspace(0, total - 1, min(total, max(beam, 8))).astype(np.int64))
        ids = np.tile(start, (n, 1))
        dist = self.distances(x, self.centroids[start])
        seen[:, start] = True
        done = np.zeros(ids.shape, bool)
        rows = np.arange(n)[:, None]
        while True:
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, done = (np.take_along_axis(v, order, 1) for v in (ids, dist, done))
            waiting = np.where(done, np.inf, dist)
            pick = np.argsort(waiting, axis=1, kind="stable")[:, : max(1, beam // 8)]
            alive = np.isfinite(np.take_along_axis(waiting, pick, 1))
            if not alive.any():
                return ids, dist
            np.put_along_axis(done, pick, True, 1)
            to = self.graph[np.take_along_axis(ids, pick, 1)].reshape(n, -1)
            fresh = ~seen[rows, to] & np.repeat(alive, self.graph.shape[1], axis=1)
            # the same centroid may come twice in a row: only its first place counts
            order = np.argsort(to, axis=1, kind="stable")
            ranked = np.take_along_axis(to, order, 1)
            twice = np.zeros(to.shape, bool)
            again = np.concatenate([np.zeros((n, 1), bool), ranked[:, 1:] == ranked[:, :-1]], 1)
            np.put_along_axis(twice, order, again, 1)
            lost = np.where(fresh & ~twice, to, -1)
            r, c = np.nonzero(lost >= 0)
            d = np.full(to.shape, np.inf)
            d[r, c] = np.sqrt(np.maximum(((x[r] - self.centroids[to[r, c]]) ** 2).sum(1), 0))
            seen[r, to[r, c]] = True
            ids = np.concatenate([ids, to], 1)
            dist = np.concatenate([dist, d], 1)
            done = np.concatenate([done, ~np.isfinite(d)], 1)

    def lists_of(self, x: np.ndarray) -> list[np.ndarray]:
        """Posting lists of each vector: the nearest, and at the boundary up to REPLICAS."""
        ids, dist = self.search(x, 32)
        out = []
        for row, d in zip(ids, dist, strict=True):
            kept = [row[0]]
            for c, dc in zip(row[1:], d[1:], strict=True):
                if len(kept) == REPLICAS or dc > CLOSURE * d[0]:
                    break
                between = np.sqrt(((self.centroids[kept] - self.centroids[c]) ** 2).sum(1))
                if (between > dc).all():
                    kept.append(c)
            out.append(np.array(kept, np.int32))
        return out

    def probes_of(self, x: np.ndarray) -> list[np.ndarray]:
        """Lists that a query looks into: those within the ratio of the nearest."""
        ids, dist = self.search(x, self.beam)
        return [row[(d <= self.ratio * d[0]) & np.isfinite(d)].astype(np.int32) for row, d in zip(ids, dist, strict=True)]


def fit(vectors: DataFrame, k: int, sample: int = 20_000, most_lists: int = 4096, per_list: int = 200) -> Index | None:
    """Index of a sample chosen by hash order (vectors: embedding, key_a); None if there is no vector."""
    n = vectors.count()
    share = min(1.0, 1.2 * sample / max(1, n))
    chosen = vectors.where(F.pmod("key_a", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))
    rows = chosen.orderBy("key_a", "key_b").select("embedding").limit(sample).collect()
    if not rows:
        return None
    sizes = pd.Series([len(r[0]) for r in rows]).mode()[0]
    x = np.array([r[0] for r in rows if len(r[0]) == sizes], np.float64)
    return Index(x, max(1, min(most_lists, n // per_list, len(x) // 8)), k)


def nearest(frame: DataFrame, is_query: Column, k: int = 5, **options) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest other rows found, by cosine, nearest first.

    frame has vec_id and embedding; is_query is a condition on vec_id.
    """
    spark = frame.sparkSession
    keys = ["key_a", "key_b"]
    rows = usable_vectors(frame.select("vec_id", "embedding")).drop("label").dropDuplicates(["vec_id", *keys])
    rows = materialize(spark, rows, "vectors")
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))
    ids = rows.select("vec_id", *keys).withColumn("n", order).where(F.col("n") <= k + 1)
    ids = ids.groupBy(*keys).agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    ids = materialize(spark, ids, "ids").withColumn("rep", F.col("ids")[0])
    reps = rows.join(ids.select("ids", F.col("rep").alias("vec_id"), *keys), ["vec_id", *keys]).select("vec_id", "ids", "embedding", *keys)
    reps = materialize(spark, reps, "reps")
    index = fit(reps, k, **options)
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if index is None:
        return spark.createDataFrame([], out)
    shipped = spark.sparkContext.broadcast(index)
    wide = index.centroids.shape[1]

    def placing(method: str):
        def run(batches):
            for pdf in batches:
                for at in range(0, len(pdf), 1024):
                    part = pdf.iloc[at : at + 1024]
                    part = part[part["embedding"].map(len) == wide]
                    if len(part):
                        yield part.assign(list=getattr(shipped.value, method)(unit(matrix(part["embedding"]))))

        return run

    postings = reps.select("vec_id", "ids", "embedding").mapInPandas(
        placing("lists_of"), "vec_id bigint, ids array<bigint>, embedding array<double>, list array<int>"
    )
    postings = materialize(spark, postings, "postings").withColumn("list", F.explode("list"))
    asked = rows.where(is_query).select(*keys).distinct().join(reps.select("vec_id", "embedding", *keys), keys)
    queries = asked.select("vec_id", "embedding").mapInPandas(
        placing("probes_of"), "vec_id bigint, embedding array<double>, list array<int>"
    )
    queries = materialize(spark, queries.withColumnsRenamed({"vec_id": "q", "embedding": "target"}), "queries")
    cuts = _cuts(postings, queries)
    listed = spark.createDataFrame(cuts[["list", "bin", "blocks", "shares"]], "list int, bin int, blocks int, shares int")
    right = postings.join(F.broadcast(listed), "list").select(  # a row for each list
        "vec_id", "ids", "embedding", "list", "bin", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
    )
    left = asked_bins(queries, cuts)
    found = left.groupBy(*GROUP).cogroup(right.groupBy(*GROUP)).applyInPandas(best_of(k), "q bigint, vec_id bigint, ids array<bigint>, score double")
    top = found.dropDuplicates(["q", "vec_id"]).withColumn(
        "n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    )
    top = top.where(F.col("n") <= k + 1).select("q", "score", F.explode("ids").alias("vec_id"))
    # ordered by score, then id; a query's own class is among the first, so k + 1 are enough
    entries = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id")))
    answers = materialize(spark, top.groupBy("q").agg(F.slice(entries, 1, k + 1).alias("found")), "answers")
    asking = rows.where(is_query).select(F.col("vec_id").alias("query_id"), *keys)
    asking = asking.join(ids.select("rep", *keys), keys).select("query_id", "rep")
    mine = F.slice(F.filter("found", lambda e: e["vec_id"] != F.col("query_id")), 1, k)
    return (
        asking.join(answers, F.col("rep") == F.col("q"))
        .select("query_id", F.posexplode(mine).alias("at", "e"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "e.vec_id", (-F.col("e.far")).alias("score"))
    )


GROUP = ["bin", "block", "share"]


def _cuts(postings: DataFrame, queries: DataFrame) -> pd.DataFrame:
    """list, bin, blocks, shares: how lists are dealt to groups. One row a list comes to the driver.

    Lists that follow one another, which are near one another, share a bin of about BLOCK vectors, so a
    query is sent to a bin, and answered by it, once. A list longer than BLOCK is a bin of several blocks.
    """
    sizes = postings.groupBy("list").agg(F.count("*").alias("n")).toPandas()
    asked = queries.select(F.explode("list").alias("list")).groupBy("list").agg(F.count("*").alias("asked")).toPandas()
    cuts = sizes.merge(asked, on="list").sort_values("list", ignore_index=True)
    cuts["blocks"] = -(-cuts["n"] // BLOCK)
    bins, room, last = [], 0, -1
    for n, blocks in zip(cuts["n"], cuts["blocks"], strict=True):
        if blocks > 1 or n > room:
            last, room = last + 1, 0 if blocks > 1 else BLOCK
        bins.append(last)
        room = max(0, room - n)
    cuts["bin"] = np.array(bins, np.int32)
    cuts["shares"] = -(-cuts.groupby("bin")["asked"].transform("max") // QUERIES)
    return cuts.astype({"list": "int32", "bin": "int32", "blocks": "int32", "shares": "int32"})


def asked_bins(queries: DataFrame, cuts: pd.DataFrame) -> DataFrame:
    """q, target, lists, GROUP: a row for each query and group of the bins of its lists."""
    dealt = queries.sparkSession.sparkContext.broadcast(cuts.set_index("list")[["bin", "blocks", "shares"]])

    def run(batches):
        for pdf in batches:
            rows = pdf[["q", "list"]].explode("list").astype({"list": np.int32}).join(dealt.value, on="list", how="inner")
            rows = rows.groupby(["q", "bin"], as_index=False).agg(lists=("list", list), blocks=("blocks", "max"), shares=("shares", "max"))
            rows["share"] = (rows["q"].to_numpy(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % rows["shares"]
            rows["block"] = rows["blocks"].map(lambda n: list(range(n)))
            rows = rows.explode("block").merge(pdf[["q", "target"]], on="q")
            yield rows[["q", "target", "lists", *GROUP]]

    return queries.mapInPandas(run, "q bigint, target array<double>, lists array<int>, bin int, block int, share int")


def best_of(k: int):
    """A group's k + 1 best of each query, over the lists that the query asks for."""

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"q": [], "vec_id": [], "ids": [], "score": []})
        if not len(a) or not len(b):
            return none
        targets, vectors = matrix(a["target"]), matrix(b["embedding"])
        q, reps = a["q"].to_numpy(), b["vec_id"].to_numpy()
        asking: dict[int, list[int]] = {}
        for row, lists in enumerate(a["lists"]):
            for x in lists:
                asking.setdefault(x, []).append(row)
        parts = []
        for x, at in b.groupby("list").indices.items():
            rows = asking.get(x)
            if rows is None:
                continue
            scores, m = cosines(targets[rows], vectors[at]), min(k + 1, len(at))
            best = np.lexsort((np.broadcast_to(reps[at], scores.shape), -scores), axis=1)[:, :m]
            parts.append(
                (np.repeat(q[rows], m), at[best.ravel()], np.take_along_axis(scores, best, 1).ravel())
            )
        if not parts:
            return none
        query, at, score = (np.concatenate(c) for c in zip(*parts, strict=True))
        # a vector of several lists comes once, by its best place
        order = np.lexsort((-score, reps[at], query))
        first = np.ones(len(order), bool)
        first[1:] = (query[order][1:] != query[order][:-1]) | (reps[at][order][1:] != reps[at][order][:-1])
        once = order[first]
        once = once[np.lexsort((reps[at[once]], -score[once], query[once]))]
        starts = np.flatnonzero(np.concatenate([[True], query[once][1:] != query[once][:-1]]))
        place = np.arange(len(once)) - np.repeat(starts, np.diff([*starts, len(once)]))
        once = once[place <= k]
        return pd.DataFrame({"q": query[once], "vec_id": reps[at[once]], "ids": b["ids"].to_numpy()[at[once]], "score": score[once]})

    return compare


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All cosines of rows of a and b, in double precision."""
    na, nb = np.abs(a).max(1, keepdims=True), np.abs(b).max(1, keepdims=True)
    a, b = a / na, b / nb
    return (a @ b.T) / (np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None])
