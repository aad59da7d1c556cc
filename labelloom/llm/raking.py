"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed into cells of all dimensions; only cells are iterated on,
as written tables, so no step depends on the number of documents.  A marginal
is a grouped sum with map-side combining, and its factors are joined back, by
broadcast only if Spark measures them as small.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.hashing import row_hash
from labelloom.llm.common import materialize, text_of, unused

TOLERANCE = 1e-6   # of the total weight, for the worst category
MAX_SWEEPS = 50
MISSING = "(none)"
SPACE = r"[\x20\x09-\x0D]+"


def tempered(exponent: float) -> Callable[[DataFrame], DataFrame]:
    """Targets in proportion to the observed share to a power; 0 makes them equal."""
    return lambda observed: observed.select("category", F.pow("tokens", F.lit(exponent)).alias("target"))


def _marginals(cells: DataFrame, dimension: str, value: str) -> DataFrame:
    return cells.groupBy(F.col(dimension).alias("category")).agg(F.sum(value).alias(value))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], tolerance: float = TOLERANCE,
         max_sweeps: int = MAX_SWEEPS) -> DataFrame:
    """Cells with ``weight`` added: their tokens, scaled until the marginals meet the targets.

    ``cells`` has one row for each combination, with ``tokens``; ``targets`` maps
    each dimension to (category, target).  Targets are taken as shares among the
    categories that have tokens.  A category without target or without tokens
    gets weight 0.  Targets that contradict each other (possible with empty
    cells) end after ``max_sweeps`` at the last sweep's weights.
    """
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.withColumn("weight", F.lit(0.0))
    goals = {}
    for dimension, target in targets.items():
        have = _marginals(cells, dimension, "tokens").where("tokens > 0").join(target, "category")
        goals[dimension] = materialize(have.select(
            "category", F.col("target").cast("double").alias("target")).where("target > 0"), "raking-targets")
        whole = goals[dimension].agg(F.sum("target")).first()[0]
        goals[dimension] = goals[dimension].withColumn("target", F.col("target") / F.lit(whole))
    weighted = cells.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    for _ in range(max_sweeps):
        for dimension, goal in goals.items():
            factors = (_marginals(weighted, dimension, "weight").where("weight > 0").join(goal, "category")
                       .select(F.col("category").alias(dimension), (F.col("target") / F.col("weight")).alias("factor")))
            weighted = weighted.join(factors, dimension, "left").withColumn(
                "weight", F.col("weight") * F.coalesce("factor", F.lit(0.0))).drop("factor")
        weighted = materialize(weighted, "raking-sweep")
        if _worst(weighted, goals) <= tolerance:
            break
    return weighted.withColumn("weight", F.col("weight") * F.lit(float(total)))


def _worst(weighted: DataFrame, goals: Mapping[str, DataFrame]) -> float:
    """The largest gap between a marginal and its target."""
    gaps = [_marginals(weighted, d, "weight").join(goal, "category").agg(
        F.max(F.abs(F.col("weight") - F.col("target"))).alias("gap")) for d, goal in goals.items()]
    union = gaps[0]
    for gap in gaps[1:]:
        union = union.union(gap)
    return union.agg(F.coalesce(F.max("gap"), F.lit(0.0))).first()[0]


def calibrated(cells: DataFrame, budget: float) -> DataFrame:
    """Cells with ``probability`` added, at most 1, whose expected tokens are ``budget``.

    Probabilities are in proportion to weight / tokens.  Cells that would pass 1
    are taken whole and the rest is scaled anew, until none passes.  A budget
    beyond the tokens of all cells with weight takes these whole.
    """
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    scale = 0.0
    while True:
        whole = (ratio > 0) & (ratio * F.lit(scale) >= 1)
        full, free = cells.agg(F.coalesce(F.sum(F.when(whole, F.col("tokens"))), F.lit(0)).cast("double"),
                               F.coalesce(F.sum(F.when(~whole, F.col("weight"))), F.lit(0.0))).first()
        wanted = max(budget - full, 0.0) / free if free > 0 else scale
        if wanted <= scale * (1 + 1e-12):
            break
        scale = wanted
    return cells.withColumn("probability", F.least(F.lit(1.0), ratio * F.lit(scale)))


def topic_of(text: Column, topics: int = 8) -> Column:
    """A stand-in for a topic: a bucket of the text's longest word (the last in order of several)."""
    words = F.split(F.lower(text), SPACE)
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("size"), w.alias("word"))))
    return F.concat(F.lit("t"), F.conv(F.substring(F.md5(longest["word"]), 1, 2), 16, 10).cast("int") % topics)


def plan_mixture(docs: DataFrame, targets: Mapping[str, DataFrame | Callable[[DataFrame], DataFrame]],
                 fraction: float) -> DataFrame:
    """Cells with their inclusion ``probability``.

    ``docs`` has the dimensions as text columns and ``tokens``; ``fraction`` of
    all tokens is the budget.
    """
    dimensions = list(targets)
    cells = materialize(docs.groupBy(*dimensions).agg(F.sum("tokens").alias("tokens")), "raking-cells")
    goals = {d: t(_marginals(cells, d, "tokens").where("tokens > 0")) if callable(t) else t
             for d, t in targets.items()}
    raked = materialize(rake(cells, goals), "raking-weights")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    return materialize(calibrated(raked, fraction * total), "raking-probabilities")


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, topic, tokens) of documents; tokens are words."""
    text = text_of(text_col)
    known = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in ("source", "lang")]
    return docs.select(F.col(id_col).alias("doc_id"), *known, topic_of(text).alias("topic"),
                       F.size(F.array_remove(F.split(text, SPACE), "")).cast("long").alias("tokens"))


def _draw(id_col: str, seed: int) -> Column:
    """A number in [0, 1) made from the id."""
    return row_hash(text_of(id_col), seed) / F.lit(2.0 ** 32)


def sample_mixture(docs: DataFrame, targets, fraction: float, seed: int = 42) -> DataFrame:
    """Every document with its cell's probability and whether it is drawn.

    ``docs`` has doc_id, the dimensions of ``targets`` and tokens.  A document
    is drawn if the hash of its id lies below the probability: the same on any
    retry, independent of partitioning.  Rows that repeat an id are drawn or
    left together; a null id hashes like an empty one.  Missing dimensions form
    a category of their own; texts without words have no tokens but share their
    cell's probability (0 if the whole cell has none).  Equal draws are drawn
    alike, an empty table gives an empty result, and a column of ``docs`` that
    has the name of a new one stays; the new one gets a longer name.
    """
    probability, sampled = unused(docs, "probability", "sampled")
    cells = plan_mixture(docs, targets, fraction).select(*targets, F.col("probability").alias(probability))
    return docs.join(cells, list(targets)).select(
        *docs.columns, probability, (_draw("doc_id", seed) < F.col(probability)).alias(sampled))


def keep_mixture(docs: DataFrame, targets, fraction: float, seed: int = 42, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """The drawn rows with all their columns, and ``sampling_probability``.

    Each row is kept by its own cell, so no text is shuffled unless the cells
    are too many for a broadcast.
    """
    names = unused(docs, "_source", "_lang", "_topic")
    cells = plan_mixture(described(docs, id_col, text_col), targets, fraction)
    cells = cells.select("source", "lang", "topic", "probability").toDF(*names, *unused(docs, "sampling_probability"))
    known = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in ("source", "lang")]
    keyed = docs.withColumns(dict(zip(names, [*known, topic_of(text_of(text_col))])))
    return keyed.join(cells, names).where(_draw(id_col, seed) < F.col(cells.columns[-1])).drop(*names)
