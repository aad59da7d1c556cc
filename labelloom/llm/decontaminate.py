"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

A mask ignores some token positions, so that a seed survives substitutions in
them.  Seeds of the benchmark and of the documents are joined by hash; around
every hit the two texts are compared along the hit's diagonal: +1 for an equal
token, -1 for another, and the best run decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import materialize, text_of, unused

# "1110111" outlives a substitution of every 4th to 7th token, "11011011" of every 3rd.
MASKS = ("1110111", "11011011")
MIN_SCORE = 10
SHORT_SHARE = 0.8     # of an item's tokens, if that is less than MIN_SCORE
BLOCK = 1 << 20       # seeds of the benchmark broadcast at once: about 100 MB
BROADCAST_KEYS = 1 << 20  # keys of documents that were hit: about 50 MB
SPLIT = r"[^\p{L}\p{N}]+"


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    words = F.array_remove(F.split(F.lower(text), SPLIT), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, masks: tuple[str, ...], *keep: str) -> DataFrame:
    """(keep..., at, seed) for every mask and position of ``tokens``.

    Outer explosions, because Spark would repeat the tokens' expression in the
    filter that it makes of inner ones; null seeds join nothing.  The tokens
    end here, so that no row carries them further.
    """
    last = F.size("tokens") - min(map(len, masks))
    placed = rows.select(*keep, "tokens", F.explode_outer(
        F.when(last >= 0, F.sequence(F.lit(0), last))).alias("at"))
    seeds = [F.when(F.col("at") + len(mask) <= F.size("tokens"), F.xxhash64(
        F.lit(number), *(F.get("tokens", F.col("at") + i) for i, bit in enumerate(mask) if bit == "1")))
        for number, mask in enumerate(masks)]
    return placed.select(*keep, "at", F.explode_outer(F.array(*seeds)).alias("seed"))


def _best_run() -> Column:
    """(score, start, end): the best run of the diagonal, in tokens of the item."""
    low = F.greatest(F.lit(0), -F.col("diagonal"))
    high = F.least(F.size("item_tokens"), F.size("tokens") - F.col("diagonal"))
    nothing = F.lit(0)
    zero = F.struct(nothing.alias("run"), nothing.alias("begin"), nothing.alias("score"), nothing.alias("start"),
                    nothing.alias("end"))

    def step(state: Column, q: Column) -> Column:
        gain = F.when(F.get("item_tokens", q) == F.get("tokens", q + F.col("diagonal")), 1).otherwise(-1)
        run = F.greatest(state["run"], nothing) + gain
        begin = F.when(state["run"] > 0, state["begin"]).otherwise(q)
        better = run > state["score"]
        return F.struct(run.alias("run"), begin.alias("begin"),
                        F.when(better, run).otherwise(state["score"]).alias("score"),
                        F.when(better, begin).otherwise(state["start"]).alias("start"),
                        F.when(better, q + 1).otherwise(state["end"]).alias("end"))

    return F.aggregate(F.sequence(low, high - 1), zero, step)


def overlaps(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", bench_text: str = "text",
             masks: tuple[str, ...] = MASKS, min_score: int = MIN_SCORE, block: int = BLOCK) -> DataFrame:
    """(key, item, score, begin, end): verified overlaps of ``docs`` (key, text).

    ``begin`` and ``end`` count the item's tokens.  The benchmark's seeds are
    counted; up to ``block`` are broadcast at once, and a benchmark with more
    goes through the documents in as many passes as it has blocks.  Only the
    documents that were hit are read again to be compared.
    """
    items = materialize(
        benchmark.select(F.col(item_col).alias("item"), row_key(item_col, bench_text).alias("item_key"),
                         text_of(bench_text).alias("text")).dropDuplicates(["item_key"])
        .select("item", "item_key", token_hashes(F.col("text")).alias("item_tokens")), "decontaminate-items")
    seeds = materialize(_seeds(items.withColumnRenamed("item_tokens", "tokens"), masks, "item_key")
                        .where("seed is not null").withColumnRenamed("at", "item_at"), "decontaminate-seeds")
    passes = max(1, -(-seeds.count() // block))
    placed = _seeds(docs.select("key", token_hashes(text_of("text")).alias("tokens")), masks, "key")
    found = [placed.join(F.broadcast(seeds.where(F.pmod(F.xxhash64("seed"), F.lit(passes)) == number)), "seed")
             .select("key", "item_key", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
             for number in range(passes)]
    hits = materialize(reduce(DataFrame.union, found).distinct(), "decontaminate-hits")
    keys = hits.select("key").distinct()
    if hits.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    texts = docs.join(keys, "key", "left_semi").select("key", token_hashes(text_of("text")).alias("tokens"))
    compared = hits.join(texts, "key").join(items, "item_key").select(
        "key", "item", F.size("item_tokens").alias("length"), _best_run().alias("best"))
    needed = F.least(F.lit(min_score), F.ceil(F.lit(SHORT_SHARE) * F.col("length")))
    return compared.where(F.col("best.score") >= needed).select(
        "key", "item", F.col("best.score").alias("score"), F.col("best.start").alias("begin"),
        F.col("best.end").alias("end"))


def row_key(id_col: str, text_col: str) -> Column:
    """32 bytes for an id, null or not, with its text."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit("\0"),
                                   text_of(text_col)), 256))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 **options) -> DataFrame:
    """(key, items, score): the rows of ``docs`` that overlap with the benchmark."""
    found = overlaps(docs.select(row_key(id_col, text_col).alias("key"), text_of(text_col).alias("text")),
                     benchmark, **options)
    return found.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"),
                                    F.max("score").cast("long").alias("score"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           **options) -> DataFrame:
    """One row per row of ``docs``: (id, contaminated, n_items, items, score).

    A document is contaminated by an item if a seed hits and the best run along
    its diagonal scores at least ``min_score`` (or ``SHORT_SHARE`` of a shorter
    item's tokens).  Texts and items of fewer tokens than the shortest mask
    can't be told from chance and match nothing; so do null and empty ones.
    Null ids are kept; equal rows get equal verdicts; items that repeat an id
    and text count once; null item ids count as matches but aren't listed.
    Other columns are ignored, empty tables allowed.
    """
    found = materialize(contaminated(docs, benchmark, id_col, text_col, **options), "decontaminate-found")
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"))
    return rows.join(found, "key", "left").select(
        "doc_id", F.col("score").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("items"),
        F.coalesce("score", F.lit(0)).cast("long").alias("score"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               **options) -> DataFrame:
    """The rows that overlap with no item, with all their columns."""
    key, = unused(docs, "_row_key")
    found = materialize(contaminated(docs, benchmark, id_col, text_col, **options).select(F.col("key").alias(key)),
                        "decontaminate-keys")
    return docs.withColumn(key, row_key(id_col, text_col)).join(found, key, "left_anti").drop(key)
