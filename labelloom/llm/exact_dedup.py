"""Exact deduplication against a minimal perfect hash over past digests.

The past digests are dealt to shards by their leading bits.  Every shard is an
independent minimal perfect hash: level after level, digests that meet no other
digest in a bit array get the rank of their bit as their slot.  A slot holds
the full digest and the winner's locator, so a lookup compares all bytes and
never takes a stranger for a repeat.  Shards have about ``SHARD`` digests
whatever the input's size, and digests are evenly spread, so no task grows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import materialize, text_digest, unused

SHARD = 100_000
DIGEST = 32
GAMMA = 2.0  # bits of a level for each digest that reaches it

INDEX_SCHEMA = "shard int, levels array<binary>, digests binary, winners binary, sizes binary"
FOUND_SCHEMA = "digest binary, past_winner long, past_size long, new_winner long, new_size long"


def _words(digests: np.ndarray) -> np.ndarray:
    """Digests as rows of four 64-bit words."""
    return np.ascontiguousarray(digests).view(np.uint64).reshape(len(digests), DIGEST // 8)


def _positions(words: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The bit of each digest in the array of a level."""
    turn = np.uint64(2 * level + 1)
    x = (words[:, 1] ^ (words[:, 2] * turn)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29)) ^ (words[:, 3] * turn)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(bits)).astype(np.int64)


def build_levels(digests: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Bit arrays of the levels, and the slot of each (distinct) digest."""
    words, waiting = _words(digests), np.arange(len(digests))
    slots, levels, used = np.zeros(len(digests), dtype=np.int64), [], 0
    while len(waiting):
        bits = max(64, int(len(waiting) * GAMMA) // 64 * 64 + 64)
        at = _positions(words[waiting], len(levels), bits)
        alone = np.bincount(at, minlength=bits) == 1
        ranks = np.cumsum(alone) - 1
        settled = alone[at]
        slots[waiting[settled]] = used + ranks[at[settled]]
        used += int(alone.sum())
        levels.append(np.packbits(alone).tobytes())
        waiting = waiting[~settled]
    return levels, slots


def find_slots(levels: list[bytes], digests: np.ndarray) -> np.ndarray:
    """A slot for each digest, or -1; strangers may get a slot too."""
    words, waiting = _words(digests), np.arange(len(digests))
    slots, used = np.full(len(digests), -1, dtype=np.int64), 0
    for level, packed in enumerate(levels):
        alone = np.unpackbits(np.frombuffer(packed, dtype=np.uint8)).astype(bool)
        at = _positions(words[waiting], level, len(alone))
        settled = alone[at]
        slots[waiting[settled]] = used + (np.cumsum(alone) - 1)[at[settled]]
        used += int(alone.sum())
        waiting = waiting[~settled]
    return slots


def _matrix(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, DIGEST)


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(rows.digest)
    levels, slots = build_levels(digests)
    order = np.argsort(slots)
    # A missing winner (only null ids) is kept as the least long.
    winners = rows.winner.fillna(np.iinfo(np.int64).min).astype(np.int64).to_numpy()
    return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "levels": [levels],
                         "digests": [digests[order].tobytes()], "winners": [winners[order].tobytes()],
                         "sizes": [rows["size"].to_numpy(np.int64)[order].tobytes()]})


def _look_up(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({"digest": new.digest, "new_winner": new.winner.astype("Int64"), "new_size": new["size"],
                        "past_winner": pd.array([None] * len(new), dtype="Int64"),
                        "past_size": np.zeros(len(new), dtype=np.int64)})
    names = ["digest", "past_winner", "past_size", "new_winner", "new_size"]
    if not len(index):
        return out[names]
    entry = index.iloc[0]
    past = np.frombuffer(entry.digests, dtype=np.uint8).reshape(-1, DIGEST)
    winners, sizes = np.frombuffer(entry.winners, dtype=np.int64), np.frombuffer(entry.sizes, dtype=np.int64)
    untouched = np.ones(len(past), dtype=bool)
    if len(new):
        digests = _matrix(new.digest)
        slots = find_slots(list(entry.levels), digests)
        safe = np.where(slots >= 0, slots, 0)
        member = (slots >= 0) & (past[safe] == digests).all(axis=1)
        untouched[slots[member]] = False
        out.loc[member, "past_winner"] = winners[slots[member]]
        out.loc[member, "past_size"] = sizes[slots[member]]
    rest = pd.DataFrame({"digest": [d.tobytes() for d in past[untouched]], "past_winner": winners[untouched],
                         "past_size": sizes[untouched], "new_size": np.zeros(int(untouched.sum()), dtype=np.int64)})
    rest["new_winner"] = pd.array([None] * len(rest), dtype="Int64")
    rest["past_winner"] = rest.past_winner.astype("Int64")
    both = pd.concat([out[names], rest[names]], ignore_index=True)
    both.loc[both.past_winner == np.iinfo(np.int64).min, "past_winner"] = pd.NA
    return both


def distinct_digests(rows: DataFrame, digest: str, locator: str) -> DataFrame:
    """(digest, winner, size): equal texts met in one task are merged before the shuffle."""
    return rows.groupBy(F.col(digest).alias("digest")).agg(
        F.max(F.col(locator).cast("long")).alias("winner"), F.count(F.lit(1)).alias("size"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def build_index(past: DataFrame, shards: int) -> DataFrame:
    """The minimal perfect hash of ``distinct_digests``, one row a shard."""
    return past.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(_build_shard, INDEX_SCHEMA)


def look_up(new: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """All digests of both sides: what the past and what the new rows have of each.

    Members of the index come with its winner and size; new digests that it
    doesn't hold come alone (past size 0), as do those that didn't come again.
    """
    return new.withColumn("shard", _shard(shards)).groupBy("shard").cogroup(
        index.groupBy("shard")).applyInPandas(_look_up, FOUND_SCHEMA)


def deduplicate(docs: DataFrame, is_past: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's group of equal texts: (id, keep_id, group_size, kept, text_sha256).

    ``is_past`` says which rows are history; the rest are new.  Of equal texts
    the one with the largest id stays, whichever side it is on.

    Null text counts as empty, and empty texts form a group like others.  A row
    without id never stays if its group has an id; if it has none, all its rows
    stay and ``keep_id`` is null.  Rows that repeat both id and text are one
    document: they stay or go together, and each counts in ``group_size``.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = materialize(docs.select(F.col(id_col).alias("id"), text_digest(text_col).alias("digest"),
                                   F.coalesce(is_past, F.lit(False)).alias("is_past")), "exact-digests")
    past = materialize(distinct_digests(rows.where("is_past"), "digest", "id"), "exact-past")
    new = materialize(distinct_digests(rows.where("not is_past"), "digest", "id"), "exact-new")
    shards = max(1, -(-max(past.count(), new.count()) // SHARD))
    index = materialize(build_index(past, shards), "exact-index")
    groups = materialize(look_up(new, index, shards).select(
        "digest", F.greatest("past_winner", "new_winner").alias("keep_id"),
        (F.col("past_size") + F.col("new_size")).alias("group_size")), "exact-groups")
    # Two plain tables: Spark splits the rows of a digest that very many documents have.
    return rows.join(groups, "digest").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def keep_winners(docs: DataFrame, is_past: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Losers are dropped by id and digest, so that the texts of hot groups are
    never a join key by themselves.  Null cases are those of ``deduplicate``.
    """
    key, digest = unused(docs, "_id", "_digest")
    losers = deduplicate(docs, is_past, id_col, text_col).where("not kept").select(
        F.col("doc_id").alias(key), F.unhex("text_sha256").alias(digest)).distinct()
    marked = docs.withColumn(digest, text_digest(text_col))
    losers = losers.withColumnsRenamed({key: f"{key}_r", digest: f"{digest}_r"})
    gone = (marked[digest] == losers[f"{digest}_r"]) & marked[id_col].eqNullSafe(losers[f"{key}_r"])
    return marked.join(losers, gone, "left_anti").drop(digest)
