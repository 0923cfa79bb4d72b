"""URL filters: blocked Bloom filters pass possible hits to an exact hash join.

Method. A listed entry is a host and a path prefix. A URL can only be met by an entry whose key is one
of its host's suffixes (whole labels) joined with a prefix of its path. Suffixes are tested in a blocked
Bloom filter of listed hosts; for those that pass, prefixes of the lengths that the list has are tested
in one of listed keys. All bits of a key lie in one block of 8 words of 64 bits. Keys that pass go to an
equi-join with the list, which removes false positives; the longest entry that fits wins. Rows without a
possible key need no join and aren't shuffled; their branch reads pages' columns a second time instead.

Filters are built by the executors (bit_or per block) and their size is bounded by `max_blocks`: a
longer list only raises the share of false positives, which the join then removes. The list itself is
broadcast only if Spark finds it below the session's size limit, else the join shuffles it.

Nulls: a URL that is null or has no `://` has an empty host and path and meets no entry. Each row gets a
row of its own, repeated or not; pages' columns may have any names. Entries with equal keys must agree;
block wins if they don't. Entries with a null host or path, or whose path isn't empty and doesn't begin
with a slash, fit no URL. An empty list leaves all URLs to the default; no pages give no rows.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

#: 64-bit words in a block, bits set for each key.
WORDS, BITS = 8, 8


def canonical(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL column."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(whole, pattern, 1)), F.regexp_extract(whole, pattern, 2)


def _hash(key: Column) -> Column:
    return F.xxhash64(key)


def _masks(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of each of BITS probes of hashes: the low half of a mixed hash, 9 bits for each."""
    with np.errstate(over="ignore"):
        mixed = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        again = mixed * np.uint64(0xBF58476D1CE4E5B9)
        again ^= again >> np.uint64(32)
    probes = np.stack([((mixed if k < 4 else again) >> np.uint64(9 * (k % 4))) & np.uint64(511) for k in range(BITS)], 1)
    return (probes >> np.uint64(6)).astype(np.int64), probes & np.uint64(63)


def build_filter(keys: DataFrame, max_blocks: int = 1 << 17) -> np.ndarray:
    """Blocked Bloom filter (blocks x WORDS) of the column `key`: 12 bits a key, max_blocks at most.

    The driver gets one row a non-empty block, 8 MB for the default bound.
    """
    n = keys.count()
    blocks = 1
    while blocks * WORDS * 64 < 12 * n and blocks < max_blocks:
        blocks *= 2

    def part(batches):
        made = np.zeros((blocks, WORDS), np.uint64)
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows = (h.view(np.uint64) >> np.uint64(40)).astype(np.int64) % blocks
            words, bits = _masks(h)
            np.bitwise_or.at(made, (rows[:, None], words), np.uint64(1) << bits)
        full = np.flatnonzero(made.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(full), *(pa.array(made[full, k].view(np.int64)) for k in range(WORDS))],
            names=["block", *(f"w{k}" for k in range(WORDS))],
        )

    schema = "block bigint, " + ", ".join(f"w{k} bigint" for k in range(WORDS))
    parts = keys.select(_hash(F.col("key")).alias("h")).mapInArrow(part, schema)
    merged = parts.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)))
    out = np.zeros((blocks, WORDS), np.uint64)
    for r in merged.toLocalIterator():
        out[r["block"]] = np.array(r[1:], np.int64).view(np.uint64)
    return out


def probe(made: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be of a listed key."""
    rows = (h.view(np.uint64) >> np.uint64(40)).astype(np.int64) % len(made)
    words, bits = _masks(h)
    return ((made[rows[:, None], words] >> bits) & np.uint64(1)).astype(bool).all(1)


def hashes_of(keys: list[str]) -> np.ndarray:
    """Spark's xxhash64 of each string."""
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(k.encode(), 42) for k in keys), np.uint64, len(keys)).view(np.int64)


def passing(made: np.ndarray, keys: list[str]) -> list[str]:
    """The keys that may be listed."""
    return [k for k, ok in zip(keys, probe(made, hashes_of(keys)), strict=True) if ok] if keys else []


def suffixes(host: str) -> list[str]:
    """The host and what is left of it without its first labels; none of an empty host."""
    labels = host.split(".") if host else []
    return [".".join(labels[k:]) for k in range(len(labels))]


def possible_keys(hosts: pd.Series, paths: pd.Series, listed_hosts: np.ndarray, listed_keys: np.ndarray, lengths: list[int]) -> pd.Series:
    """For each URL the keys, host suffix and path prefix, that may be listed. lengths: of listed paths, ascending."""
    made = {h: suffixes(h) for h in hosts.unique()}
    may = set(passing(listed_hosts, sorted({x for found in made.values() for x in found})))
    made = {h: [x for x in found if x in may] for h, found in made.items()}
    flat, at = [], []
    for k, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        if made[h]:
            for n in lengths[: bisect_right(lengths, len(p))]:
                flat += [x + p[:n] for x in made[h]]
            at += [k] * (len(flat) - len(at))
    out: list[list[str]] = [[] for _ in range(len(hosts))]
    if flat:
        for k in np.flatnonzero(probe(listed_keys, hashes_of(flat))):
            out[at[k]].append(flat[k])
    return pd.Series(out)


def filter_urls(pages: DataFrame, listed: DataFrame, default: str = "allow", max_blocks: int = 1 << 17) -> DataFrame:
    """pages with host, path, rule (the entry that decides, or null) and verdict (allow or block).

    pages has url; listed has host, path, verdict. Columns of pages named like a result are replaced.
    The distinct lengths of listed paths come to the driver: no more than the longest path has characters.
    """
    spark = pages.sparkSession
    host = lower_ascii(F.col("host"))
    entries = (
        listed.where("path = '' or path like '/%'")
        .where("host is not null and not host rlike '[/?#]'")
        .select(F.concat(host, "path").alias("key"), host.alias("host"), F.length("path").alias("n"), "verdict")
        .groupBy("key", "host", "n")
        .agg(F.max("verdict").alias("verdict"))  # block after allow
    )
    entries = materialize(spark, entries, "urls")
    lengths = sorted(r["n"] for r in entries.select("n").distinct().collect())
    hosts = build_filter(entries.select(F.col("host").alias("key")).distinct(), max_blocks)
    filters = spark.sparkContext.broadcast((hosts, build_filter(entries.select("key"), max_blocks)))

    @F.pandas_udf("array<string>")
    def possible(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return possible_keys(hosts, paths, *filters.value, lengths)

    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    own = [f"c{k}" for k in range(len(names))]  # pages' columns under names that nothing else here has
    host, path = canonical(F.col("url"))
    marked = pages.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)), host.alias("host"), path.alias("path"))
    marked = marked.withColumn("possible", possible("host", "path"))
    none = marked.where(F.size("possible") == 0).withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    # The rows that may be hit: one group a row, so that a host or entry with many rows is no hot group.
    hits = marked.where(F.size("possible") > 0).withColumn("row", F.monotonically_increasing_id()).withColumn("key", F.explode("possible"))
    hits = hits.drop("possible").join(entries.select("key", F.length("host").alias("n_host"), "verdict"), "key", "left")
    fits = F.struct(F.length("key"), "n_host", "key", "verdict")
    best = hits.groupBy("row").agg(
        *(F.first(c).alias(c) for c in [*own, "host", "path"]),
        F.max(F.when(F.col("verdict").isNotNull(), fits)).alias("best"),
    )
    found = best.withColumns({"rule": F.col("best.key"), "verdict": F.coalesce("best.verdict", F.lit(default))})
    out = [*(F.col(o).alias(c) for c, o in zip(names, own, strict=True)), "host", "path", "rule", "verdict"]
    return none.select(*out).unionAll(found.select(*out))
