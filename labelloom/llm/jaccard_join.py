"""Exact Jaccard self-join of shingle sets with token-combination prefixes.

Tokens are the hashed shingles.  They are ordered by class, rare before
frequent, and by hash within a class.  A set x whose partners share at least t
of its tokens gets the shortest prefix with

    rare tokens + sum over groups of frequent tokens of (members - 1)
        >= |x| - t + 1.

Two similar sets then share a rare token of both prefixes, or two frequent
tokens of one group: so single rare tokens and pairs of frequent ones are
indexed.  Groups are residues of the hash; their number follows the set's size
(in powers of two), and sets near a border are indexed for both numbers.

A token is frequent if its cell of a counting sketch over all tokens of all
documents has more than ``FREQUENT`` entries.  Any such rule gives the same
result, so the bound on the number of frequent cells, which are broadcast, is
kept by raising the threshold and costs no link.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import materialize, text_of, unused
from labelloom.llm.components import linked
from labelloom.llm.words import mix, pieces, shingle_sets

FREQUENT = 40                 # entries in a cell of the sketch, of which 4 are to be expected by chance
MAX_FREQUENT_CELLS = 2 << 20  # broadcast: 16 MB
BUCKET_TOKENS = 1 << 18       # tokens in a group that one task takes at once
CELL_BITS = 16                # cells of a sketch bucket
CHUNK_TOKENS = 1 << 20        # tokens gathered in a task before they are sent
GROUP = 3                     # frequent tokens expected in a group
SKETCH = 16                   # 64-bit words of a set's sketch
BROADCAST_ROWS = 1 << 20      # document keys broadcast at most: about 30 MB


def set_id(tokens: np.ndarray) -> int | None:
    """A 64-bit fingerprint of a set; none of an empty one."""
    if not len(tokens):
        return None
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def parities(tokens: np.ndarray, bits: int) -> np.ndarray:
    """For each of ``bits`` cells whether an odd number of tokens fall into it.

    At most as many cells of two sets differ as tokens do.
    """
    counts = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _describe(size: int):
    """(id, text_id, text) -> (id, text_id, n, sid, sketch, parity).

    The sketch has the same number of cells for all sets, the parity 2 to 4 for
    each token.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(2)):
                sets = [(len(s), set_id(s), parities(s, 64 * SKETCH),
                         parities(s, max(64, 1 << (2 * len(s)).bit_length()))) for s in shingle_sets(piece, size)]
                rows = slice(piece.first, piece.first + piece.rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], batch.column(1)[rows], pa.array([s[0] for s in sets], pa.int64()),
                     pa.array([s[1] for s in sets], pa.int64()), pa.array([s[2] for s in sets], pa.list_(pa.int64())),
                     pa.array([s[3] for s in sets], pa.list_(pa.int64()))],
                    ["id", "text_id", "n", "sid", "sketch", "parity"])
    return run


def _tokens(size: int):
    """(text) -> (sid, tokens), without empty sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(0)):
                sets = [s for s in shingle_sets(piece, size) if len(s)]
                if sets:
                    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([set_id(s) for s in sets], pa.int64()),
                         pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))],
                        ["sid", "tokens"])
    return run


def _bucket_rows(bits: int, hashes: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Cut hash-sorted columns by the leading ``bits`` of the hash."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(hashes)]))
    for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(bucket[start]), *(c[start:end].tobytes() for c in columns)


def _cell(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(64 - bits - CELL_BITS)


def _sketch(size: int, bits: int):
    """(text) -> (bucket, cells, counts): what a task counts, bucket by bucket; no counts: all 1."""
    types = (pa.int64(), pa.binary(), pa.binary())

    def send(gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cells, counts = np.unique(_cell(np.concatenate(gathered), bits), return_counts=True)
        rows = []
        for part in (counts == 1, counts > 1):
            if part.any():
                hashes = cells[part] << np.uint64(64 - bits - CELL_BITS)
                columns = [(cells[part] & np.uint64((1 << CELL_BITS) - 1)).astype(np.uint16)]
                columns += [counts[part].astype(np.uint32)] if counts[part][0] > 1 else []
                rows += [row if len(row) == 3 else (*row, None) for row in _bucket_rows(bits, hashes, *columns)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                         ["bucket", "cells", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, total = [], 0
        for batch in batches:
            for piece in pieces(batch.column(0)):
                for s in shingle_sets(piece, size):
                    if len(s):
                        gathered.append(s)
                        total += len(s)
                if total >= CHUNK_TOKENS:
                    yield from send(gathered)
                    gathered, total = [], 0
        if total:
            yield from send(gathered)
    return run


def _frequent_cells(rows: pd.DataFrame) -> pd.DataFrame:
    totals = np.zeros(1 << CELL_BITS, dtype=np.int64)
    for cells, counts in zip(rows.cells, rows.counts):
        totals[np.frombuffer(cells, dtype=np.uint16)] += 1 if counts is None else np.frombuffer(counts, np.uint32)
    found = np.flatnonzero(totals > FREQUENT)
    return pd.DataFrame({"cell": (int(rows.bucket.iloc[0]) << CELL_BITS) + found, "entries": totals[found]})


def prefix(tokens: np.ndarray, frequent: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The rare tokens to index singly and the signatures of frequent pairs.

    ``tokens`` are sorted, ``frequent`` marks them; similar means a Jaccard
    similarity of at least num / den.
    """
    n = len(tokens)
    need = n - -(-num * n // den) + 1
    rare = tokens[~frequent][:need]
    pairs: list[np.ndarray] = []
    if len(rare) < need:
        rest, missing = tokens[frequent], need - len(rare)
        levels = range(int(math.log2(max(1, num * n / den))), int(math.log2(n * den / num)) + 1)
        for level in levels:
            groups = max(1, (1 << level) // (GROUP * 4))
            group = (rest % np.uint64(groups)).astype(np.int64)
            # The first of each group brings nothing; stop when the others suffice.
            _, first = np.unique(group, return_index=True)
            gain = np.ones(len(rest), dtype=np.int64)
            gain[first] = 0
            end = int(np.searchsorted(np.cumsum(gain), missing)) + 1
            taken, group = rest[:end], group[:end]
            order = np.argsort(group, kind="stable")
            taken, group = taken[order], group[order]
            for apart in range(1, len(taken)):
                same = np.flatnonzero(group[apart:] == group[:-apart])
                if not len(same):
                    break
                pairs.append(mix(taken[same] * np.uint64(0x9E3779B97F4A7C15)
                                 + mix(taken[same + apart] + np.uint64(level))))
    return rare, np.concatenate(pairs) if pairs else np.zeros(0, dtype=np.uint64)


def _is_frequent(tokens: np.ndarray, cells: np.ndarray, bits: int) -> np.ndarray:
    if not len(cells):
        return np.zeros(len(tokens), dtype=bool)
    own = _cell(tokens, bits)
    at = np.minimum(np.searchsorted(cells, own), len(cells) - 1)
    return cells[at] == own


def _signatures(size: int, bits: int, cells, num: int, den: int):
    """(text) -> (bucket, hashes, sids, pairs): packed rare tokens, or pairs of one set."""
    names = ["bucket", "hashes", "sids", "sid", "pairs"]
    types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    def send(hashes: list[np.ndarray], sids: list[int]) -> pa.RecordBatch:
        owner = np.repeat(np.array(sids, dtype=np.int64), [len(h) for h in hashes])
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        return batch_of([(*row, None, None) for row in _bucket_rows(bits, flat[order], flat[order], owner[order])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes, sids, total = cells.value, [], [], 0
        for batch in batches:
            for piece in pieces(batch.column(0)):
                combined = []
                for s in shingle_sets(piece, size):
                    if len(s):
                        sid = set_id(s)
                        rare, pairs = prefix(s, _is_frequent(s, known, bits), num, den)
                        if len(pairs):
                            combined.append((None, None, None, sid, pairs.view(np.int64)))
                        hashes.append(rare)
                        sids.append(sid)
                        total += len(rare)
                if combined:
                    yield batch_of(combined)
                if total >= CHUNK_TOKENS:
                    yield send(hashes, sids)
                    hashes, sids, total = [], [], 0
        if total:
            yield send(hashes, sids)
    return run


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """The rare tokens that several sets have, with those sets."""
    hashes = np.concatenate([np.frombuffer(h, dtype=np.int64) for h in rows.hashes])
    sids = np.concatenate([np.frombuffer(s, dtype=np.int64) for s in rows.sids])
    order = np.lexsort((sids, hashes))
    hashes, sids = hashes[order], sids[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (sids[1:] != sids[:-1])
    hashes, sids = hashes[new], sids[new]
    several = np.zeros(len(hashes), dtype=bool)
    several[1:] = hashes[1:] == hashes[:-1]
    several[:-1] |= several[1:]
    return pd.DataFrame({"signature": hashes[several], "sid": sids[several]})


def _frequent_broadcast(spark, cells: DataFrame):
    """All frequent cells, by a threshold high enough to keep their bound."""
    threshold = FREQUENT
    while cells.where(F.col("entries") > threshold).count() > MAX_FREQUENT_CELLS:
        threshold *= 2
    found = cells.where(F.col("entries") > threshold).select("cell").toPandas()["cell"].to_numpy()
    return spark.sparkContext.broadcast(np.sort(found).astype(np.uint64))


def shingle_index(docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """``sets`` (id, text_id, n, sid, sketch, parity) of all rows and ``index`` (signature, sid).

    Of single tokens the index holds those that at least two different sets have.
    """
    spark = docs.sparkSession
    sets = materialize(docs.mapInArrow(
        _describe(size), "id long, text_id long, n long, sid long, sketch array<long>, parity array<long>"), "jaccard-sets")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(0, math.ceil(math.log2(max(1, total) / BUCKET_TOKENS)))
    texts = docs.select("text")
    cells = materialize(
        texts.mapInArrow(_sketch(size, bits), "bucket long, cells binary, counts binary")
        .groupBy("bucket").applyInPandas(_frequent_cells, "cell long, entries long"), "jaccard-frequent")
    raw = texts.mapInArrow(_signatures(size, bits, _frequent_broadcast(spark, cells), num, den),
                           "bucket long, hashes binary, sids binary, sid long, pairs array<long>")
    single = materialize(raw.where("hashes is not null").groupBy("bucket").applyInPandas(
        _shared, "signature long, sid long"), "jaccard-single")
    pairs = materialize(raw.where("pairs is not null").select(F.explode("pairs").alias("signature"), "sid").distinct(),
                        "jaccard-pairs")
    return sets, single.union(pairs)


def folded(parity: Column, words: Column) -> Column:
    """The parities of half as many cells, if there are more than ``words``."""
    halves = F.zip_with(F.slice(parity, 1, words), F.slice(parity, words + 1, words), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(parity) > words, halves).otherwise(parity)


def _sketches_allow(one: str, other: str, num: int, den: int) -> Column:
    """Whether the sizes and sketches of two sets allow them to be similar."""
    n, m = F.col(f"{one}.n"), F.col(f"{other}.n")
    differ = sum((F.bit_count(F.col(f"{one}.sketch")[i].bitwiseXOR(F.col(f"{other}.sketch")[i]))
                  for i in range(SKETCH)), F.lit(0))
    return (den * F.least(n, m) >= num * F.greatest(n, m)) & ((den + num) * differ <= (den - num) * (n + m))


def _plausible(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that sizes and parities allow to be similar.

    Sizes of similar sets differ by less than a factor of two (num / den above
    a half), hence their cells by one doubling at most.
    """
    both = pairs
    for side in "ab":
        both = both.join(nodes.select(F.col("sid").alias(side), F.col("n").alias(f"n_{side}"),
                                      F.col("parity").alias(f"parity_{side}")), side)
    both = both.where(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))
    words = F.least(F.size("parity_a"), F.size("parity_b"))
    differ = F.zip_with(folded(F.col("parity_a"), words), folded(F.col("parity_b"), words),
                        lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    count = F.aggregate(differ, F.lit(0), lambda total, x: total + x)
    return both.where((den + num) * count <= (den - num) * (F.col("n_a") + F.col("n_b"))).select(*pairs.columns)


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Those of the plausible pairs (a, b) whose sets are similar, by their tokens.

    The texts are found by one row's key for each set: broadcast if few enough,
    else by a shuffled join.
    """
    pairs = materialize(pairs, "jaccard-candidates")
    sids = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    keys = materialize(nodes.join(sids, "sid", "left_semi").select(
        F.col("row.id").alias("id_r"), F.col("row.text_id").alias("text_id_r")).distinct(), "jaccard-keys")
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    texts = rows.join(keys, F.col("id").eqNullSafe(F.col("id_r")) & (F.col("text_id") == F.col("text_id_r")),
                      "left_semi").select("text")
    tokens = materialize(texts.mapInArrow(_tokens(size), "sid long, tokens array<long>").dropDuplicates(["sid"]),
                         "jaccard-tokens")
    both = (pairs.join(tokens.select(F.col("sid").alias("a"), F.col("tokens").alias("x")), "a")
            .join(tokens.select(F.col("sid").alias("b"), F.col("tokens").alias("y")), "b"))
    common = F.size(F.array_intersect("x", "y"))
    return both.where(den * common >= num * (F.size("x") + F.size("y") - common)).select("a", "b")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                    num: int = 3, den: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents joined by similarity links.

    Two documents link if the Jaccard similarity of their word shingles is at
    least num / den.  Equal sets are one node, so copies are never paired.
    Pairs are found and verified as ``components.linked`` tells.

    ``component_id`` is the smallest id reachable.  Null or empty texts and
    texts without words have no shingles, link with nothing and are their own
    component.  Null ids take part in links and get their component's smallest
    id, null if there is none.  Repeated rows come out as often as they went
    in.  Other columns are ignored; an empty table gives an empty result.
    """
    return _classes(docs, id_col, text_col, size, num, den).drop("text_id")


def _classes(docs: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int) -> DataFrame:
    """``similar_classes`` with each row's ``text_id``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of(text_col)).alias("text_id"),
                       text_of(text_col).alias("text"))
    sets, index = shingle_index(rows, size, num, den)
    nodes = materialize(sets.where("sid is not null").groupBy("sid").agg(
        F.min("n").alias("n"), F.min("id").alias("least_id"), F.min(F.struct("id", "text_id")).alias("row"),
        F.any_value("sketch").alias("sketch"), F.any_value("parity").alias("parity")), "jaccard-nodes")
    final = linked(index, nodes.select("sid", F.struct("n", "sketch").alias("traits")),
                   lambda one, other: _sketches_allow(one, other, num, den),
                   lambda pairs: _plausible(pairs, nodes, num, den),
                   lambda pairs: _verified(pairs, rows, nodes, size, num, den), "jaccard")
    reach = nodes.select("sid", "least_id").join(final.withColumnRenamed("node", "sid"), "sid", "left").select(
        "sid", "least_id", F.coalesce("component", "sid").alias("component"))
    reach = materialize(reach, "jaccard-reach")
    least = reach.groupBy("component").agg(F.min("least_id").alias("component_id"))
    classes = materialize(reach.join(least, "component").select("sid", "component_id"), "jaccard-classes")
    return sets.join(classes, "sid", "left").select(
        F.col("id").alias("doc_id"), "text_id", F.col("n").alias("n_shingles"),
        F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
             num: int = 3, den: int = 4) -> DataFrame:
    """The rows whose id is the smallest of their component, with all their columns.

    Rows without id stay (nothing tells them apart), unless their component has
    an id; rows that repeat a winner's id and text stay with it.  Rows of one id
    with different texts are judged one by one.
    """
    key, text_key = unused(docs, "_component_id", "_text_id")
    classes = _classes(docs, id_col, text_col, size, num, den)
    losers = classes.where("component_id is not null and (doc_id is null or doc_id <> component_id)").select(
        F.col("doc_id").alias(key), F.col("text_id").alias(text_key)).distinct()
    return docs.join(losers, F.col(id_col).eqNullSafe(F.col(key))
                     & (F.xxhash64(text_of(text_col)) == F.col(text_key)), "left_anti")
