"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidates.

Method. A document's set is its distinct word shingles, as 64-bit hashes. One permutation serves all
bins: the top bits of a shingle's hash name the bin, and a bin's value is its least hash. Empty bins are
filled by optimal densification: bin i borrows from the first non-empty bin of its own fixed sequence of
random bins. Bands of ROWS bins give buckets, as many as the threshold needs. Equal sets are folded into one class
first. In each bucket the member that shares the most crowded buckets is the centre of a star, and only
(member, centre) pairs are candidates; those that bitmaps of the sets (below) pass are confirmed on
full sets and joined into components.

Stars alone could lose a link between two members that the centre doesn't tie together. So in buckets
whose members are still in several components, all pairs of different components are decided: one of
a pair is outside the bucket's largest component and asks for the other.
In buckets of more than CROWD members an index is asked first. In one order of all shingles, rare ones
first, two linked sets share a shingle so near the start of both that what follows can still hold their
intersection. Counts by size tell how many sets may answer a member; all of them are tested, unless they
are more than its shingles (FEW at least). Members with more, and those that ask in smaller buckets, are
compared with all of their bucket, in large ones in blocks of about MEMBERS, by bitmaps of their sets'
parities: the bits in which two differ are no more than the hashes in which they do, so no link is
passed over. What passes is confirmed on full sets, of each member the likeliest pairs with a component
first; rounds go on where members have more pairs, until all that pass are tested or within one
component. Each pair of documents that shares a bucket is thus decided; a pair at the threshold itself
shares none with a probability under 1e-6. Rows that are compared grow with the members of a bucket
times the blocks of those that the index leaves, so with the square only where sets lack rare shingles.

Skew. Buckets, classes and centres with very many members are hot keys of joins between written tables,
which AQE splits; sums are combined before they are shuffled. A Bloom filter of bounded size picks the
documents whose full sets are needed. Nothing that grows with the data goes to the driver.

Nulls: a null text or one without a word has an empty set and links with nothing. Rows with a null
doc_id have a null component and are never kept. Rows that share a doc_id count as one document: their
sets all stand for it. Extra columns are ignored. Of members of equal rank the smallest doc_id is the
centre. No documents give no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, kept, map_batches, materialize, rows_of
from .graph import connected_components
from .urls import build_filter, probe

#: Bins of a band, and a pair's chance, at the threshold itself, of sharing no bucket.
ROWS, MISS = 5, 5e-7
#: Pairs of a member with another component in a first round, and members of a block.
LIKELIEST, MEMBERS = 4, 1024
#: Members of buckets that are searched by rare shingles first, least number of answers that are all tested,
#: share of the sets (one of so many) that tells which shingles are common, and how many of these are told apart.
CROWD, FEW, SAMPLED, COMMON = 256, 64, 8, 1 << 18
MEMO = 150_000
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Word to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > MEMO:
            self.clear()
        found = self[word] = xxh3_64_intdigest(word)
        return found


def shingle_set(raw: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles: A-Z lowered, words between ASCII white space.

    With fewer than width words the whole sequence is one shingle; without words the set is empty.
    """
    words = raw.lower().split() if raw else []
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(kept("words of shingles", _Words).__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    with np.errstate(over="ignore"):
        h = np.full(len(words) - n + 1, np.uint64(n) if n < width else np.uint64(0))
        for k in range(n):
            h = h * _M[3] + (ids[k : len(words) - n + 1 + k] ^ _M[k % 3])
            h = h ^ (h >> np.uint64(29))
        h = mix64(h)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def bands_for(percent: int) -> int:
    """Bands with which a pair at the threshold shares a bucket but for a chance of MISS."""
    one = (percent / 100) ** ROWS
    return max(1, math.ceil(math.log(MISS) / math.log(max(1e-12, 1 - one))))


@lru_cache(maxsize=4)
def _bins(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """First hash of each of a power of two of bins, and the bins that each borrows from, in turn: 64 random ones, then all."""
    edges = np.arange(bins, dtype=np.uint64) << np.uint64(65 - bins.bit_length())
    random = np.random.default_rng(20240229).integers(0, bins, (bins, 64))
    return edges, np.concatenate([random, (np.arange(bins)[:, None] + np.arange(1, bins)) % bins], 1)


def signature(hashes: np.ndarray, bins: int = 128) -> np.ndarray:
    """The least hash of each bin of a non-empty sorted set, empty bins densified."""
    edges, donors = _bins(bins)
    at = np.searchsorted(hashes, edges)
    found = hashes[np.minimum(at, len(hashes) - 1)]
    full = (at < len(hashes)) & ((found >> np.uint64(65 - bins.bit_length())) == np.arange(bins, dtype=np.uint64))
    if not full.all():
        empty = np.flatnonzero(~full)
        first = full[donors[empty]].argmax(1)
        found[empty] = found[donors[empty, first]]
    return found


def bands_of(hashes: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key of each band's values and number, of a non-empty sorted set."""
    bins = 1 << (bands * ROWS - 1).bit_length()
    with np.errstate(over="ignore"):
        rows = signature(hashes, bins)[: bands * ROWS].reshape(bands, ROWS)
        h = np.arange(1, bands + 1, dtype=np.uint64) * _M[4]
        for k in range(ROWS):
            h = mix64(h * _M[3] + rows[:, k])
    return h


SKETCH = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>"


def sketch(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, a 128-bit key of the set (null if empty) and its bands."""
    number = bands_for(percent)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, a, b, bands = [], [], [], []
        for raw in rows_of(batch.column(1).cast(pa.binary())):
            h = shingle_set(raw, width)
            n.append(len(h))
            if not len(h):
                a.append(None), b.append(None), bands.append(None)
                continue
            with np.errstate(over="ignore"):
                a.append(int(mix64(h * _M[0]).sum().view(np.int64)))
                b.append(int(mix64(h ^ _M[1]).sum().view(np.int64)))
            bands.append(bands_of(h, number).view(np.int64))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
        )

    narrow = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return map_batches(narrow, run, SKETCH)


def full_sets(docs: DataFrame, ids: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_set, its full set (array of hashes) and the set's bitmap, for the documents of ids and few others."""
    made = build_filter(ids.select(F.col("doc_id").alias("key")))
    bloom = docs.sparkSession.sparkContext.broadcast(made)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        may = np.flatnonzero(probe(bloom.value, batch.column(2).to_numpy()))
        if not len(may):
            return None
        picked = batch.take(pa.array(may))
        sets = [shingle_set(raw, width) for raw in rows_of(picked.column(1).cast(pa.binary()))]
        lists = (pa.array([h.view(np.int64) for h in x], pa.list_(pa.int64())) for x in (sets, map(bitmap, sets)))
        return pa.RecordBatch.from_arrays([picked.column(0), pa.array(map(len, sets), pa.int64()), *lists], names=["doc_id", "n_set", "hashes", "bits"])

    narrow = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("doc_id").cast("bigint")).alias("h"),
    )
    return map_batches(narrow, run, "doc_id bigint, n_set bigint, hashes array<bigint>, bits array<bigint>")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept, one row a row.

    Documents are linked if 100 * intersection >= percent * union of their sets.
    """
    spark = docs.sparkSession
    sketches = materialize(spark, sketch(docs.select("doc_id", "text"), width, percent), "sketch")
    usable = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(
        spark, usable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")), "classes"
    )
    folded = usable.join(classes, ["set_a", "set_b"]).select(
        "doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")
    )
    folded = materialize(spark, folded, "folded")
    rows = folded.where("bands is not null").select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    crowded = rows.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("size"))
    crowded = materialize(spark, crowded.where("least < most").select("bucket", "size"), "buckets")
    members = rows.join(crowded, "bucket").groupBy("doc_id", "n_shingles")
    members = materialize(spark, members.agg(F.collect_set("bucket").alias("buckets"), F.sum("size").alias("weight")), "members")
    ranked = members.select(
        F.explode("buckets").alias("bucket"), "doc_id", "n_shingles", F.struct("weight", -F.col("doc_id")).alias("rank")
    )
    centre = F.max(F.struct("rank", "doc_id", "n_shingles")).alias("c")
    centres = materialize(
        spark,
        ranked.groupBy("bucket").agg(centre).select("bucket", F.col("c.doc_id").alias("centre"), F.col("c.n_shingles").alias("centre_n")),
        "centres",
    )
    similar_size = (100 * F.least("n_shingles", "centre_n")) >= (percent * F.greatest("n_shingles", "centre_n"))
    pairs = ranked.join(centres, "bucket").where((F.col("doc_id") != F.col("centre")) & similar_size)
    tested = materialize(spark, _ordered(pairs), "pairs")
    sets = materialize(spark, full_sets(docs, members.select("doc_id"), width), "sets")
    near = materialize(spark, passed(tested, sets, percent), "pairs")
    edges = materialize(spark, confirm(near, sets, percent), "links")
    tested = tested.select("a", "b")
    parts = connected_components(spark, edges)
    most, asking = LIKELIEST, None
    while True:
        placed = members.join(parts, F.col("doc_id") == F.col("node"), "left").select(
            "buckets", "doc_id", F.coalesce("component", "doc_id").alias("part")
        )
        placed = materialize(spark, placed, "placed").select(F.explode("buckets").alias("bucket"), "doc_id", "part")
        split = placed.groupBy("bucket", "part").agg(F.count("*").alias("n"))
        split = split.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "part")).alias("top"))
        # of two members the star has tested the only pair
        split = split.where("parts > 1 and n > 2").select("bucket", "n", F.col("top.part").alias("largest"))
        split = materialize(spark, split, "split")
        if split.isEmpty():
            break
        unsettled = materialize(spark, placed.join(split, "bucket"), "unsettled")
        answers = None
        if asking is None:
            outside, crowded = F.col("part") != F.col("largest"), F.col("n") > CROWD
            answers, left = by_rare_shingles(unsettled.where(crowded), sets, percent)
            asking = unsettled.where(outside & ~crowded).select("bucket", "doc_id")
            asking = asking.unionAll(unsettled.where(outside & crowded).join(left, "doc_id").select("bucket", "doc_id"))
        likely = materialize(spark, _across(unsettled, asking, sets.select("doc_id", "n_set", "bits"), percent, most), "likely")
        fresh = likely.select("a", "b")
        if answers is not None:
            fresh = fresh.unionAll(answers)
        fresh = materialize(spark, fresh.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        found = materialize(spark, confirm(fresh, sets, percent), "links")
        asking = likely.where("more").select("bucket", F.col("owner").alias("doc_id")).distinct()
        more = not asking.isEmpty()
        tested = tested.unionAll(fresh)
        if not found.isEmpty():
            edges = edges.unionAll(found)
            parts = connected_components(spark, edges)
        else:
            most *= 8
        if not more:
            break
    placed = folded.select("doc_id", "n_shingles", "rep").join(parts, F.col("rep") == F.col("node"), "left")
    placed = placed.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = sketches.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = placed.unionAll(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """docs' rows, one for each component: that of the smallest doc_id. Rows without doc_id go.

    Texts are not shuffled: a Bloom filter of bounded size passes rows that can't be of a dropped
    document; only the others go to the exact anti-join. Of rows that share a doc_id one stays.
    """
    spark = docs.sparkSession
    found = near_duplicates(docs, percent, width).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    found = materialize(spark, found, "found")
    dropped = found.where("not kept and doc_id is not null").select("doc_id")
    rows = without(docs.where("doc_id is not null"), dropped)
    if not found.where("kept and n > 1").isEmpty():
        rows = rows.dropDuplicates(["doc_id"])
    return rows


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs' rows whose doc_id isn't in ids (distinct, not null)."""
    names = docs.columns
    key = F.col("doc_id").cast("bigint")
    bloom = docs.sparkSession.sparkContext.broadcast(build_filter(ids.select(F.col("doc_id").cast("bigint").alias("key"))))

    @F.pandas_udf("boolean")
    def may_be_listed(h: pd.Series) -> pd.Series:
        return pd.Series(probe(bloom.value, h.to_numpy(np.int64)))

    bounded_batches(docs.sparkSession)
    may, listed = (prefix + "_" * max(map(len, names)) for prefix in ("may", "listed"))  # no column of docs
    marked = docs.withColumn(may, may_be_listed(F.xxhash64(key)))
    rest = marked.where(F.col(may)).join(ids.select(F.col("doc_id").cast("bigint").alias(listed)), key == F.col(listed), "left_anti")
    return marked.where(~F.col(may)).select(*names).unionAll(rest.select(*names))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Parities of a set's hashes by their low bits, two bits a hash at least, as a power of two of words."""
    words = 1 << max(2, (len(hashes) // 32).bit_length())
    odd = np.bincount((hashes & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows, words) as they would be with fewer words."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def likely_pairs(part: pd.DataFrame, percent: int, most: int) -> pd.DataFrame:
    """a, b, more, owner: pairs of different parts of two blocks (mine = i and j) whose bitmaps let them be links.

    A pair's owner is its member outside the bucket's largest part. Of a member's pairs with another part the
    `most` nearest are returned; `more` tells that there are others.
    """
    doc, comp, n, mine = (part[c].to_numpy() for c in ("doc_id", "part", "n_set", "mine"))
    outside = comp != part["largest"].to_numpy()
    i, j = part["i"].iloc[0], part["j"].iloc[0]
    words = part["bits"].map(len).to_numpy()
    levels = {}  # by number of words: bitmaps of all rows that have as many
    for w in np.unique(words):
        rows = np.flatnonzero(words >= w)
        place = np.full(len(part), -1)
        place[rows] = np.arange(len(rows))
        stacked = np.empty((len(rows), w), np.uint64)
        for have in np.unique(words[rows]):
            own = np.flatnonzero(words[rows] == have)
            stacked[own] = _folded(np.stack([np.asarray(b, np.int64) for b in part["bits"].to_numpy()[rows[own]]]).view(np.uint64), w)
        levels[w] = place, stacked
    at = np.arange(len(part))
    out = []
    for a in np.flatnonzero(mine == i):
        other = (mine == j) & (comp != comp[a]) & (100 * np.minimum(n, n[a]) >= percent * np.maximum(n, n[a]))
        if i == j:
            other &= at > a
        other = np.flatnonzero(other)
        for w in np.unique(np.minimum(words[other], words[a])):
            b = other[np.minimum(words[other], words[a]) == w]
            place, stacked = levels[w]
            differ = np.bitwise_count(stacked[place[b]] ^ stacked[place[a]]).sum(1, dtype=np.int64)
            near = (100 + percent) * differ <= (100 - percent) * (n[b] + n[a])
            if near.any():
                out.append(np.stack([np.full(near.sum(), a), b[near], 1_000_000 * differ[near] // (n[b[near]] + n[a])]))
    if not out:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "more": np.zeros(0, bool), "owner": np.zeros(0, np.int64)})
    x, y, far = np.concatenate(out, 1)
    turn = (outside[y] > outside[x]) | ((outside[y] == outside[x]) & (doc[y] > doc[x]))
    x, y = np.where(turn, y, x), np.where(turn, x, y)
    order = np.lexsort((doc[y], far, comp[y], doc[x]))
    x, y = x[order], y[order]
    first = np.concatenate([[True], (doc[x][1:] != doc[x][:-1]) | (comp[y][1:] != comp[y][:-1])])
    start = np.flatnonzero(first)
    count = np.diff(np.append(start, len(x)))
    taken = np.arange(len(x)) - np.repeat(start, count) < most
    more = np.repeat(count > most, count)
    u, v = doc[x][taken], doc[y][taken]
    return pd.DataFrame({"a": np.minimum(u, v), "b": np.maximum(u, v), "more": more[taken], "owner": u})


def _across(unsettled: DataFrame, asking: DataFrame, bitmaps: DataFrame, percent: int, most: int) -> DataFrame:
    """bucket and likely_pairs of those buckets of unsettled (bucket, doc_id, part, n, largest) that asking (bucket, doc_id) names.

    Buckets up to CROWD members share groups and are compared whole. In larger ones blocks of those that ask
    (i, from 0) meet blocks of all members (j, below 0).
    """
    spark = bitmaps.sparkSession
    asked = materialize(spark, asking.groupBy("bucket").agg(F.count("*").alias("asked")), "asking")
    rows = unsettled.join(asked, "bucket").join(asking.withColumn("asks", F.lit(True)), ["bucket", "doc_id"], "left")
    rows = materialize(spark, rows, "asked")
    bins = max(1, rows.count() // MEMBERS)
    rows = rows.select(
        "bucket", "doc_id", "part", "largest", "asks",
        F.when(F.col("n") > CROWD, F.xxhash64("bucket")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(bins))).alias("group"),
        (F.col("n") <= CROWD).alias("whole"),
        F.ceil(F.col("n") / MEMBERS).cast("int").alias("blocks"),
        F.ceil(F.col("asked") / MEMBERS).cast("int").alias("turns"),
        F.xxhash64("doc_id").alias("hash"),
    )
    rows = rows.withColumn("own", F.expr("cast(-1 - pmod(hash, blocks) as int)")).withColumn("turn", F.expr("cast(pmod(hash, turns) as int)"))
    member = "transform(sequence(0, turns - 1), k -> struct(own as mine, k as i, own as j))"
    asker = "transform(sequence(1, blocks), k -> struct(turn as mine, turn as i, -k as j))"
    places = f"if(whole, array(struct(0 as mine, 0 as i, 0 as j)), if(asks, concat({member}, {asker}), {member}))"
    spread = rows.withColumn("place", F.explode(F.expr(places))).select("bucket", "doc_id", "part", "largest", "group", "place.*")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([likely_pairs(part, percent, most).assign(bucket=bucket) for bucket, part in pdf.groupby("bucket")])

    schema = "a bigint, b bigint, more boolean, owner bigint, bucket bigint"
    return spread.join(bitmaps, "doc_id").groupBy("group", "i", "j").applyInPandas(run, schema)


def rarest(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first hashes of a set, by their counts (those not in common: 0) and themselves; sets that are linked share one."""
    n = len(hashes)
    count = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        count = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, count))[: n + (-percent * n // 100) + 1]]


def by_rare_shingles(crowded: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame | None, DataFrame]:
    """Pairs a < b that may be links, with one outside its bucket's largest part, and doc_id of those whose pairs aren't all there.

    crowded: doc_id, part and largest of the members of buckets. If the first shingle that two sets share is
    at pos (from 0) of n, they share n - pos at most, and a link shares percent / (100 + percent) of both sizes.
    The order of shingles decides how many pairs are found, not which links.
    """
    spark = sets.sparkSession
    docs = crowded.groupBy("doc_id").agg(F.min("part").alias("part"), F.max(F.col("part") != F.col("largest")).alias("asks"))
    docs = materialize(spark, docs, "crowd")
    if docs.isEmpty():
        return None, docs.select("doc_id")
    some = sets.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).join(docs, "doc_id", "left_semi")
    seen = some.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    seen, least = materialize(spark, seen, "seen"), 2
    while seen.where(F.col("c") >= least).count() > COMMON:
        least *= 2
    told = seen.where(F.col("c") >= least).toArrow().sort_by("h")
    common = spark.sparkContext.broadcast((told["h"].to_numpy(), told["c"].to_numpy()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        firsts = [rarest(np.asarray(x, np.int64), *common.value, percent) for x in rows_of(batch.column("hashes"))]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "part", "asks", "n_set")), pa.array(firsts, pa.list_(pa.int64()))],
            names=["doc_id", "part", "asks", "n_set", "firsts"],
        )

    own = sets.where("n_set > 0").join(docs, "doc_id").select("doc_id", "part", "asks", "n_set", "hashes")
    firsts = map_batches(own, run, "doc_id bigint, part bigint, asks boolean, n_set bigint, firsts array<bigint>")
    firsts = materialize(spark, firsts.select("doc_id", "part", "asks", "n_set", F.posexplode("firsts").alias("pos", "h")), "firsts")
    sizes = firsts.groupBy("h", "n_set").agg(F.count("*").alias("c")).select("h", F.col("n_set").alias("m"), "c")
    sizes = materialize(spark, sizes, "sizes")
    similar_size = 100 * F.least("n_set", "m") >= percent * F.greatest("n_set", "m")
    enough = (100 + percent) * (F.col("n_set") - F.col("pos")) >= percent * (F.col("n_set") + F.col("m"))
    others = F.col("c") > F.when(F.col("n_set") == F.col("m"), 1).otherwise(0)  # than its own
    asked = materialize(spark, firsts.where("asks").join(sizes, "h").where(similar_size & enough & others), "asked")
    many = asked.groupBy("doc_id", "n_set").agg(F.sum("c").alias("c")).where(F.col("c") > F.greatest("n_set", F.lit(FEW)))
    left = materialize(spark, many.select("doc_id").distinct(), "left")
    answer = firsts.select("h", F.col("n_set").alias("m"), F.col("doc_id").alias("to"), F.col("part").alias("other"), F.col("pos").alias("at"))
    also_enough = (100 + percent) * (F.col("m") - F.col("at")) >= percent * (F.col("n_set") + F.col("m"))
    pairs = asked.join(left, "doc_id", "left_anti").join(answer, ["h", "m"]).where(also_enough & (F.col("part") != F.col("other")))
    pairs = pairs.select(F.least("doc_id", "to").alias("a"), F.greatest("doc_id", "to").alias("b")).distinct()
    near = passed(pairs.withColumn("centre", F.col("b")), sets, percent)
    return materialize(spark, near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "answers"), left


def _ordered(pairs: DataFrame) -> DataFrame:
    """a < b of pairs (doc_id, centre), each once, and which of the two is a centre."""
    ordered = pairs.select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b"), "centre")
    return ordered.groupBy("a", "b").agg(F.max("centre").alias("centre"))


def passed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, centre) those that bitmaps let be links, as b the centre. No link is passed over."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = []
        for n, x, y in zip(*(rows_of(batch.column(c)) for c in ("n", "x", "y")), strict=True):
            x, y = (np.asarray(bits, np.int64).view(np.uint64)[None] for bits in (x, y))
            words = min(x.shape[1], y.shape[1])
            differ = int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum())
            near.append((100 + percent) * differ <= (100 - percent) * n)
        return batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("n_set").alias("n_a"), F.col("bits").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n_set").alias("n_b"), F.col("bits").alias("y"))
    one = F.when(F.col("a") == F.col("centre"), F.col("b")).otherwise(F.col("a")).alias("a")
    both = pairs.select(one, F.col("centre").alias("b")).join(left, "a").join(right, "b")
    similar_size = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    both = both.where(similar_size).select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "x", "y")
    return map_batches(both, run, "a bigint, b bigint").distinct()


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets are similar enough. Only sets of the pairs are shuffled."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y")).join(pairs.select("b").distinct(), "b", "left_semi")
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(100 * both >= percent * (F.size("x") + F.size("y") - both))
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
        .distinct()
    )
