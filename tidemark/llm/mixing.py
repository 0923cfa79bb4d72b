"""Mixing sources to target weights by iterative proportional fitting.

Method. Documents are counted into cells (source, language, topic) of tokens. The cells' weights are
raked: in turn each marginal's weighted token shares are scaled to its targets, until no scale factor
differs from 1 by more than `tolerance` (or `rounds` are done or hardly improve, which is logged). A document's weight is its cell's; with
`budget`, the share of all tokens wanted, its probability is budget * weight. Where that is above 1 for
some cells, probabilities are calibrated themselves: each is min(1, a product of factors by marginal
value), and the factors are scaled until expected tokens meet the marginals and the budget. A value
whose target is more than all its tokens is kept whole, logged, and the others share the rest in
proportion. A document is kept if a hash of doc_id, uniform in [0, 1), is below its probability.

Native: DataFrame and SQL functions only. Two passes over the documents; the first is an aggregation
with map-side combining, so a hot source costs nothing, the second a join with the cells, of which AQE
splits a hot key's partition unless the cells are small enough to be broadcast by Spark's own check.
The cells are written to the shared folder between rounds, CELLS a partition; while they are no more,
a round is one task without a join.

Defined cases: null source, lang or topic is a cell value of its own (the empty string and null count
as `<none>`); a null or empty text has 0 tokens, weight of its cell and takes part; a marginal value
without target keeps its natural share; targets of absent values go to the present ones in
proportion; repeated rows are drawn alike, as the hash is of doc_id; a null doc_id is never kept; other
columns are ignored by mix and kept by sample_mix, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MARGINS = ("source", "lang", "topic")
NONE = "<none>"
#: Cells of a partition while marginals are scaled: so many are a task's work of a moment.
CELLS = 250_000
#: Three rounds that leave more than this share of the residual each: targets contradict one another.
STALLED = 0.8
log = logging.getLogger(__name__)


def token_count(text: Column) -> Column:
    """Runs of characters other than blank and tab to carriage return."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.filter(F.split(text, r"[ \t-\r]+"), lambda x: x != ""))).cast("bigint")


def topic_of(text: Column) -> Column:
    """A coarse topic by form, as the tables have none: tables, licensed text, lists of marks, prose."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.contains(" | "), "table")
        .when(t.contains("Licen"), "licensed")
        .when(t.rlike(r"[%$&#*!]{2}"), "noise")
        .otherwise("prose")
    )


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) of 13 hexadecimal digits of a hash."""
    return F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 13), 16, 10).cast("double") / float(16**13)


def _packed(cells: DataFrame, parts: int | None = None) -> DataFrame:
    """cells in as few partitions as CELLS allows. A single one is summed and joined without a shuffle."""
    return cells.coalesce(parts or _parts(cells))


def _parts(cells: DataFrame) -> int:
    return max(1, math.ceil(cells.count() / CELLS))


def _summed(cells: DataFrame, margin: str, parts: int, **sums: Column) -> DataFrame:
    """cells with sums over the cells of their value of margin.

    In a single partition these are windows: a round's plan is one chain, where a join with the sums
    would read, three margins deep, eight times what came before it.
    """
    if parts == 1:
        return cells.withColumns({name: F.sum(c).over(Window.partitionBy(margin)) for name, c in sums.items()})
    return cells.join(cells.groupBy(margin).agg(*(F.sum(c).alias(name) for name, c in sums.items())), margin)


def _with_margins(cells: DataFrame, frames: Mapping[str, DataFrame], column: str, prefix: str) -> DataFrame:
    """cells with column of each margin's frame as prefix_margin, null where the frame lacks the value."""
    for margin in MARGINS:
        cells = cells.join(frames[margin].select(margin, F.col(column).alias(f"{prefix}_{margin}")), margin, "left")
    return cells


def tempered(cells: DataFrame, margin: str, alpha: float) -> DataFrame:
    """Targets in proportion to natural token shares to the power alpha (1: natural, 0: even)."""
    shares = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("n")).where("n > 0")
    total = shares.agg(F.sum(F.pow("n", F.lit(alpha)))).first()[0]
    return shares.select(margin, (F.pow("n", F.lit(alpha)) / F.lit(total)).alias("target"))


def target_shares(cells: DataFrame, targets: Mapping[str, DataFrame], total: float) -> dict[str, DataFrame]:
    """By margin a frame (margin, share, natural) of present values; those with a target and the others make 1."""
    spark = cells.sparkSession
    fixed = {}
    for margin in MARGINS:
        present = cells.groupBy(margin).agg((F.sum("tokens") / F.lit(total)).alias("natural")).where("natural > 0")
        joined = present.join(targets[margin], margin, "left")
        sums = joined.agg(
            F.coalesce(F.sum("target"), F.lit(0.0)).alias("targeted"),
            F.coalesce(F.sum(F.when(F.col("target").isNull(), F.col("natural"))), F.lit(0.0)).alias("rest"),
        ).first()
        scaled = joined.select(
            margin,
            F.when(F.col("target").isNull(), F.col("natural"))
            .otherwise(F.col("target") / F.lit(sums["targeted"]) * F.lit(1 - sums["rest"]))
            .alias("share"),
            "natural",
        )
        fixed[margin] = materialize(spark, scaled, f"target-{margin}")
    return fixed


def rake(
    cells: DataFrame,
    targets: Mapping[str, DataFrame],
    rounds: int = 40,
    tolerance: float = 1e-9,
) -> DataFrame:
    """cells (source, lang, topic, tokens) with `weight`: weighted shares meet the targets.

    targets: for each margin a frame (margin, target). Weights are scaled so that the mean weight of a
    token is 1.
    """
    spark = cells.sparkSession
    parts = _parts(cells)
    cells = _packed(cells, parts)
    now = cells.withColumn("weight", F.lit(1.0))
    total = cells.agg(F.sum("tokens").cast("double").alias("t")).first()["t"]
    if not total:
        return now
    now = _with_margins(now, target_shares(cells, targets, total), "share", "share")
    now = _packed(materialize(spark, now, "rake"), parts)
    worst, slow = math.inf, 0
    for _ in range(rounds):
        off = F.lit(0.0)
        for margin in MARGINS:
            now = _summed(now, margin, parts, have=F.col("tokens") * F.col("weight"))
            share = F.coalesce(f"share_{margin}", F.lit(0.0))
            factor = F.when(F.col("have") > 0, share * F.lit(total) / F.col("have")).otherwise(1.0)
            now = now.withColumn("factor", factor).withColumn("weight", F.col("weight") * F.col("factor"))
            now = now.withColumn(f"off_{margin}", F.abs(F.col("factor") - 1)).drop("factor", "have")
            off = F.greatest(off, F.col(f"off_{margin}"))
        now = now.withColumn("off", off).drop(*(f"off_{m}" for m in MARGINS))
        now = _packed(materialize(spark, now, "rake"), parts)
        before, worst = worst, now.where("tokens > 0").agg(F.max("off").alias("m")).first()["m"]
        now = now.drop("off")
        slow = slow + 1 if worst > STALLED * before else 0
        if worst <= tolerance or slow == 3:
            break
    if worst > tolerance:
        log.warning("mixing: raking leaves a scale factor off by %.2e", worst)
    return now.drop(*(f"share_{m}" for m in MARGINS))


def within_tokens(shares: DataFrame, margin: str, budget: float) -> DataFrame:
    """(margin, want): shares of all tokens that add up to budget, in proportion to share, none above natural."""
    scale = budget
    while True:
        over = F.col("share") * F.lit(scale) > F.col("natural")
        sums = shares.agg(
            F.coalesce(F.sum(F.when(over, F.col("natural"))), F.lit(0.0)).alias("whole"),
            F.coalesce(F.sum(F.when(~over, F.col("share"))), F.lit(0.0)).alias("rest"),
        ).first()
        above = (budget - sums["whole"]) / sums["rest"] if sums["rest"] > 0 else scale
        if above <= scale * (1 + 1e-12):
            break
        scale = above
    short = F.col("share") * F.lit(budget) > F.col("natural") * (1 + 1e-9)
    for r in shares.where(short).orderBy(F.desc(F.col("share") / F.col("natural"))).limit(5).collect():
        log.warning("mixing: %s %r has %.4f of all tokens, its target at the budget is %.4f", margin, r[margin], r["natural"], r["share"] * budget)
    return shares.select(margin, F.least("natural", F.col("share") * F.lit(scale)).alias("want"))


def calibrate(
    cells: DataFrame, targets: Mapping[str, DataFrame], budget: float, rounds: int = 40, tolerance: float = 1e-6
) -> DataFrame:
    """cells (source, lang, topic, tokens, weight) with `probability`, budget * weight if none is above 1.

    A round solves each marginal for its factors by a step of Newton's method: expected tokens are
    concave in a factor, so a step never passes the solution from below.
    """
    spark = cells.sparkSession
    parts = _parts(cells)
    cells = _packed(cells, parts)
    now = cells.withColumn("raw", F.lit(float(budget)) * F.col("weight"))
    p = F.least(F.lit(1.0), F.col("raw"))
    total = cells.agg(F.sum("tokens").cast("double").alias("t")).first()["t"]
    if not total or now.where("raw > 1").isEmpty():
        return now.withColumn("probability", p).drop("raw")
    share = min(1.0, float(budget))
    wanted = {
        m: materialize(spark, within_tokens(shares, m, share), f"want-{m}") for m, shares in target_shares(cells, targets, total).items()
    }
    now = _packed(materialize(spark, _with_margins(now, wanted, "want", "want"), "calibrate"), parts)
    worst, slow = math.inf, 0
    for _ in range(rounds):
        off = F.lit(0.0)
        for margin in MARGINS:
            free = F.when(F.col("raw") < 1, F.col("tokens") * F.col("raw")).otherwise(0.0)
            now = _summed(now, margin, parts, have=F.col("tokens") * p, free=free)
            want, have, free = F.col(f"want_{margin}") * F.lit(total), F.col("have"), F.col("free")
            step = F.when(free > 0, 1 + (want - have) / free)
            factor = F.coalesce(F.when(step > 0, step), F.when((have > want) & (have > 0), want / have), F.lit(1.0))
            now = now.withColumn(f"off_{margin}", F.coalesce(F.abs(want - have) / F.lit(share * total), F.lit(0.0)))
            now = now.withColumn("raw", F.col("raw") * factor).drop("have", "free")
            off = F.greatest(off, F.col(f"off_{margin}"))
        now = now.withColumn("off", off).drop(*(f"off_{m}" for m in MARGINS))
        now = _packed(materialize(spark, now, "calibrate"), parts)
        before, worst = worst, now.agg(F.max("off").alias("m")).first()["m"]
        now = now.drop("off")
        slow = slow + 1 if worst > STALLED * before else 0
        if worst <= tolerance or slow == 3:
            break
    if worst > tolerance:
        log.warning("mixing: the marginals can't all be met, one is off by %.6f of the budget", worst)
    return now.withColumn("probability", p).drop("raw", *(f"want_{m}" for m in MARGINS))


def mix(
    docs: DataFrame,
    budget: float = 0.5,
    alphas: Mapping[str, float] | None = None,
    targets: Mapping[str, DataFrame] | None = None,
    rounds: int = 40,
    tolerance: float = 1e-6,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, n_tokens, source, lang, topic, weight, probability, selected, and the columns of keep.

    targets: frames (margin, target) by margin; a margin without one gets its natural shares to the
    power in alphas (0.5 by default). docs has doc_id, text, source, lang and may have topic.
    """
    spark = docs.sparkSession
    alphas = {"source": 0.5, "lang": 0.5, "topic": 1.0} | dict(alphas or {})
    name = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(NONE))
    topic = name("topic") if "topic" in docs.columns else topic_of(F.col("text"))
    rows = docs.select(
        F.col("doc_id"),
        *(F.col(c).alias(f"kept_{c}") for c in keep),
        name("source").alias("source"),
        name("lang").alias("lang"),
        topic.alias("topic"),
        token_count(F.col("text")).alias("n_tokens"),
    )
    counted = rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    cells = _packed(materialize(spark, counted, "cells"))
    wanted = {m: (targets or {}).get(m) or tempered(cells, m, alphas[m]) for m in MARGINS}
    raked = materialize(spark, rake(cells, wanted, rounds, tolerance), "raked")
    weights = materialize(spark, calibrate(raked, wanted, budget, rounds, tolerance).select(*MARGINS, "weight", "probability"), "weights")
    return (
        rows.join(weights, list(MARGINS), "left")
        .withColumn("selected", F.coalesce(uniform(F.col("doc_id")) < F.col("probability"), F.lit(False)))
        .select(
            "doc_id", "n_tokens", *MARGINS, "weight", "probability", "selected", *(F.col(f"kept_{c}") for c in keep)
        )
    )


def sample_mix(docs: DataFrame, **options) -> DataFrame:
    """docs' own columns, of the documents that mix() selects."""
    names = docs.columns
    out = mix(docs, keep=tuple(names), **options).where("selected")
    return out.select(*(F.col(f"kept_{c}").alias(c) for c in names))
