"""Bigram language model in a log-frequency Bloom filter.

A count c is kept as its level 1 + floor(log2 c): the filter holds the n-gram
once for each level from 1 up, and a reader probes level after level until one
is missing.  The filter is cut into segments by the leading bits of the
n-gram's hash; a segment is built by one task and sized by what it holds.
All n-grams are held, whatever the corpus.  Up to ``FILTER_BYTES`` readers get
all segments by broadcast; past that the texts' distinct n-grams go to the
filter, a block of segments at a time, and their levels come back.  The bits
are the same, so the scores are.

The base score needs exact counts of words.  The ``HEAD`` most frequent words
are broadcast, and the others' counts are joined by their hashes, so what goes
through the shuffle are rare words only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import materialize, text_of
from labelloom.llm.words import Piece, mix, pieces

FILTER_BYTES = 128 << 20   # of a filter that is broadcast
CUTOFF = 1                 # least count of a bigram in the filter: all are held, at every size
SEGMENT = 1 << 17          # bigrams of a segment, if all were different
BLOCK_BITS = 5             # segments that are probed together, if not broadcast: 1 << BLOCK_BITS
PROBES, BITS = 6, 10       # probes of an entry; bits for each entry: 1 % false positives
HEAD = 1 << 17             # words whose exact counts are broadcast: 2 MB
CHUNK = 1 << 20            # tokens counted in a task before they are sent
LAMBDA = 0.7               # weight of the bigram estimate
START, END = (np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F))
_WORD = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """All tokens, an end after each text, and for each row its first token."""
    bounds = piece.word_bounds()
    first = bounds + np.arange(piece.rows + 1)
    tokens = np.full(int(first[-1]), END, dtype=np.uint64)
    tokens[np.arange(len(piece.row)) + piece.row] = piece.word_hashes()
    return tokens, first


def bigrams_of(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and hashes of the bigrams that end in each token."""
    context = np.concatenate(([START], tokens[:-1])).astype(np.uint64)
    context[first[:-1]] = START
    return context, mix(context * _WORD + mix(tokens ^ np.uint64(0xD6E8FEB86659FD93)))


def _cut(bits: int, hashes: np.ndarray, counts: np.ndarray, kind: int) -> list[tuple]:
    """(kind, segment, hashes, counts) from sorted hashes."""
    segment = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(segment)) + 1, [len(hashes)]))
    return [(kind, int(segment[a]), hashes[a:b].tobytes(), counts[a:b].tobytes())
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def _count(bits: int):
    """(text) -> partial counts of words (kind 1) and bigrams (kind 2), by segment."""
    types = (pa.int32(), pa.int64(), pa.binary(), pa.binary())

    def send(gathered: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        rows = []
        for kind in (1, 2):
            hashes, counts = np.unique(np.concatenate([g[kind - 1] for g in gathered]), return_counts=True)
            rows += _cut(bits, hashes, counts.astype(np.uint32), kind)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                          ["kind", "segment", "hashes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, total = [], 0
        for batch in batches:
            for piece in pieces(batch.column(0)):
                tokens, first = tokens_of(piece)
                starts = np.full(piece.rows, START, dtype=np.uint64)
                gathered.append((np.concatenate((tokens, starts)), bigrams_of(tokens, first)[1]))
                total += len(tokens)
                if total >= CHUNK:
                    yield send(gathered)
                    gathered, total = [], 0
        if total:
            yield send(gathered)
    return run


def _sum_segment(rows: pd.DataFrame) -> pd.DataFrame:
    """The bits of a segment, from whole counts; of words the counts, too."""
    hashes = np.concatenate([np.frombuffer(h, dtype=np.uint64) for h in rows["hashes"]])
    counts = np.concatenate([np.frombuffer(c, dtype=np.uint32) for c in rows["counts"]]).astype(np.int64)
    different, where = np.unique(hashes, return_inverse=True)
    totals = np.zeros(len(different), dtype=np.int64)
    np.add.at(totals, where, counts)
    whole = pd.DataFrame({"kind": rows["kind"].iloc[:1], "segment": rows["segment"].iloc[:1],
                          "hashes": [different.tobytes()], "counts": [totals.tobytes()]})
    bits = next(_fill(CUTOFF)(iter([whole])))["bits"].to_numpy()
    # Bigrams are read from the filter only.
    return (whole if rows["kind"].iloc[0] == 1 else whole.assign(hashes=[b""], counts=[b""])).assign(bits=bits)


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count)."""
    return np.frexp(counts.astype(np.float64))[1]


def least_count(level: np.ndarray) -> np.ndarray:
    """The least of the counts that have a level; 0 at level 0."""
    return np.where(level > 0, np.exp2(level - 1.0), 0.0)


def largest_count(level: np.ndarray) -> np.ndarray:
    """The largest of the counts that have a level; 0 at level 0."""
    return np.exp2(level.astype(np.float64)) - 1


def _places(hashes: np.ndarray, level: int, size: np.ndarray) -> Iterator[np.ndarray]:
    x = mix(hashes + np.uint64((level * 0xA24BAED4963EE407) & ((1 << 64) - 1)))
    step = mix(x) | np.uint64(1)
    for _ in range(PROBES):
        yield (x % size).astype(np.int64)
        x = x + step


def _fill(cutoff: int):
    """Packed n-grams of a segment -> its bits."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                hashes, counts = np.frombuffer(row.hashes, np.uint64), np.frombuffer(row.counts, np.int64)
                if row.kind == 2:
                    hashes, counts = hashes[counts >= cutoff], counts[counts >= cutoff]
                levels = level_of(counts)
                size = max(64, int(levels.sum()) * BITS // 8 * 8 + 8)
                bits = np.zeros(size, dtype=np.uint8)
                for level in range(1, int(levels.max(initial=0)) + 1):
                    for place in _places(hashes[levels >= level], level, np.uint64(size)):
                        bits[place] = 1
                out.append((row.kind, row.segment, np.packbits(bits).tobytes()))
            yield pd.DataFrame(out, columns=["kind", "segment", "bits"])
    return run


@dataclass
class LogFrequencyFilter:
    """Segments one after another; kind k's segment s starts at bit ``start[k - 1, s]``."""

    bits: int
    start: np.ndarray
    size: np.ndarray
    data: np.ndarray

    def levels(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        """Probe level after level; each distinct hash once."""
        different, back = np.unique(hashes, return_inverse=True)
        segment = (different >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else \
            np.zeros(len(different), np.int64)
        start, size = self.start[kind - 1][segment], self.size[kind - 1][segment]
        levels = np.zeros(len(different), dtype=np.int64)
        alive = np.flatnonzero(size > 0)
        level = 0
        while len(alive) and level < 63:
            level += 1
            found = alive
            for place in _places(different[alive], level, size[alive].astype(np.uint64)):
                # Only those found so far need their other probes.
                at = start[found] + place[np.searchsorted(alive, found)]
                found = found[(self.data[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
                if not len(found):
                    break
            levels[found] = level
            alive = found
        return levels[back]


@dataclass
class Answers:
    """Levels that the filter has told: for each kind the sorted hashes and their levels."""

    hashes: list[np.ndarray]
    told: list[np.ndarray]

    def levels(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        return self.told[kind - 1][np.searchsorted(self.hashes[kind - 1], hashes)]


@dataclass
class Model:
    """What readers get: the filter, exact counts of frequent words, and the sizes of training."""

    filter: LogFrequencyFilter | Answers | None
    head: np.ndarray
    head_counts: np.ndarray
    tokens: int
    vocabulary: int

    def log_probability(self, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 of each token's probability, given the one before.

        A mixture of the bigram's relative frequency and the word's, with one
        added to each word's count.  Counts of frequent words are exact.  Of
        other counts the filter tells the level: the least one is taken for what
        is divided and the largest one for the context it is divided by, so what
        a context gives to all words sums to 1 at most (false positives aside).
        """
        _, bigram = bigrams_of(tokens, first)
        # The context is the token before, and the start for a text's first.
        levels = self.filter.levels(1, np.concatenate(([START], tokens)).astype(np.uint64))
        exact, frequent = self._head_counts(tokens)
        word = (np.where(frequent, exact, least_count(levels[1:])) + 1) / (self.tokens + self.vocabulary + 1)
        seen = np.concatenate(([0], np.where(frequent, exact, largest_count(levels[1:]))))[:-1]
        seen[first[:-1]] = largest_count(levels[:1])[0]
        pair = np.minimum(least_count(self.filter.levels(2, bigram)) / np.maximum(seen, 1), 1.0)
        return np.log10(LAMBDA * pair + (1 - LAMBDA) * np.minimum(word, 1.0))

    def _head_counts(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's count if it is a frequent one, and whether it is."""
        if not len(self.head):
            return np.zeros(len(tokens)), np.zeros(len(tokens), dtype=bool)
        own = tokens.astype(np.uint64).view(np.int64)
        at = np.minimum(np.searchsorted(self.head, own), len(self.head) - 1)
        return self.head_counts[at], self.head[at] == own


def train(docs: DataFrame, text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> tuple[Model, DataFrame, DataFrame, int]:
    """The model, exact counts of all words as (token, count), the filter's segments, and the bits that number them.

    The model's filter is None if the segments pass ``filter_bytes``; they are
    then to be read where they are.
    """
    texts = docs.select(text_of(text_col).alias("text"))
    # Words and ends, estimated by bytes: only the number of segments depends on it.
    size = texts.agg(F.sum(F.octet_length("text") / 6 + 1)).first()[0] or 1
    bits = max(0, math.ceil(math.log2(size / SEGMENT)))
    counted = materialize(
        texts.mapInArrow(_count(bits), "kind int, segment long, hashes binary, counts binary")
        .groupBy("kind", "segment").applyInPandas(
            _sum_segment, "kind int, segment long, hashes binary, counts binary, bits binary"), "lm-counts")
    words = materialize(counted.where("kind = 1").select("hashes", "counts").mapInArrow(
        _unpack, "token long, count long"), "lm-words")
    real = words.where(F.col("token") != int(START.astype(np.int64)))
    tokens, vocabulary = real.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    head = real.orderBy(F.desc("count"), "token").limit(HEAD).toPandas().sort_values("token")

    segments = counted.select("kind", "segment", "bits")
    small = (counted.agg(F.sum(F.octet_length("bits"))).first()[0] or 0) <= filter_bytes
    return Model(_assemble(bits, segments.toPandas()) if small else None, head["token"].to_numpy(np.int64),
                 head["count"].to_numpy(np.int64), int(tokens), int(vocabulary)), real, segments, bits


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for hashes, counts in zip(*batch.columns):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(hashes.as_py(), np.int64)),
                                              pa.array(np.frombuffer(counts.as_py(), np.int64))], ["token", "count"])


def _assemble(bits: int, segments: pd.DataFrame) -> LogFrequencyFilter:
    segments = segments.sort_values(["kind", "segment"])
    start, size = (np.zeros((2, 1 << bits), dtype=np.int64) for _ in range(2))
    at = 0
    for kind, segment, data in segments.itertuples(index=False):
        start[kind - 1, segment], size[kind - 1, segment] = at, 8 * len(data)
        at += 8 * len(data)
    return LogFrequencyFilter(bits, start, size, np.frombuffer(b"".join(segments["bits"]), dtype=np.uint8))


def _rows(m: Model, ids: pa.Array, piece: Piece, tokens: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """What the model tells of a piece's rows, and the words whose counts it doesn't have."""
    logs = np.log10(m.head_counts + 1.0)
    score = np.add.reduceat(m.log_probability(tokens, first), first[:-1])
    own = tokens.view(np.int64)
    at = np.minimum(np.searchsorted(m.head, own), max(len(m.head) - 1, 0))
    frequent = m.head[at] == own if len(m.head) else np.zeros(len(own), dtype=bool)
    known = np.add.reduceat(frequent.astype(np.int64), first[:-1])
    sums = np.add.reduceat(np.where(frequent, logs[at] if len(logs) else 0.0, 0.0), first[:-1])
    rows = np.repeat(np.arange(piece.rows), np.diff(first))[~frequent]
    order = np.lexsort((own[~frequent], rows))
    rows, rest = rows[order], own[~frequent][order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (rest[1:] != rest[:-1])
    starts = np.flatnonzero(new)
    times = np.diff(np.concatenate((starts, [len(rows)])))
    offsets = pa.array(np.searchsorted(rows[starts], np.arange(piece.rows + 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [ids[piece.first:piece.first + piece.rows], pa.array(np.diff(first).astype(np.int64)),
         pa.array(known), pa.array(sums), pa.array(score),
         pa.ListArray.from_arrays(offsets, pa.array(rest[starts])),
         pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))],
        ["id", "n_tokens", "n_known", "logs", "score", "rare", "times"])


def _score(model):
    """(id, text) -> ``_rows`` by a model that has the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                yield _rows(model.value, batch.column(0), piece, *tokens_of(piece))
    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> rows of about ``CHUNK`` tokens, as lists of ids and texts."""
    def send(gathered: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = [pa.concat_arrays([g.column(i) for g in gathered]) for i in range(2)]
        ends = pa.array([0, len(columns[0])], pa.int32())
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, c) for c in columns], ["ids", "texts"])

    gathered, total = [], 0
    for batch in batches:
        for piece in pieces(batch.column(1)):
            gathered.append(batch.slice(piece.first, piece.rows))
            total += len(piece.starts) + piece.rows
            if total >= CHUNK:
                yield send(gathered)
                gathered, total = [], 0
    if total:
        yield send(gathered)


def _asked(texts: pa.Array) -> tuple[list[tuple[Piece, np.ndarray, np.ndarray]], list[np.ndarray]]:
    """The pieces of a chunk with their tokens, and the chunk's distinct words and bigrams."""
    own = [(piece, *tokens_of(piece)) for piece in pieces(texts)]
    return own, [np.unique(np.concatenate([*(t for _, t, _ in own), np.array([START])])),
                 np.unique(np.concatenate([bigrams_of(t, f)[1] for _, t, f in own]))]


def _ask(bits: int):
    """(chunk, texts) -> the chunk's distinct n-grams by block, as (block, chunk, kind, hashes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, hashes = batch.column(0)[i].as_py(), _asked(batch.column(1)[i].values)[1]
                rows = [r for kind in (1, 2) for r in _cut(bits, hashes[kind - 1], hashes[kind - 1][:0], kind)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[1] for r in rows], pa.int64()), pa.array([chunk] * len(rows), pa.int64()),
                     pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
                    ["block", "chunk", "kind", "hashes"])
    return run


def _answer(bits: int):
    """Questions and segments of a block -> (block, chunk, kind, levels), a byte for each hash."""
    def run(asked: pa.Table, segments: pa.Table) -> pa.Table:
        told = _assemble(bits, segments.select(["kind", "segment", "bits"]).to_pandas())
        kinds, packed = asked.column("kind").to_numpy(), asked.column("hashes").to_pylist()
        levels: list[bytes] = [b""] * len(packed)
        for kind in (1, 2):
            mine = np.flatnonzero(kinds == kind).tolist()
            if mine:
                ends = np.cumsum([len(packed[i]) // 8 for i in mine])
                found = told.levels(kind, np.frombuffer(b"".join(packed[i] for i in mine), np.uint64)).astype(np.uint8)
                for i, part in zip(mine, np.split(found, ends[:-1])):
                    levels[i] = part.tobytes()
        return asked.select(["block", "chunk", "kind"]).append_column("levels", pa.array(levels, pa.binary()))
    return run


def _combine(model):
    """A chunk and its answers -> ``_rows``."""
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        own, hashes = _asked(chunk.column("texts")[0].values)
        told = sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "block", "levels"))))
        levels = [np.frombuffer(b"".join(x for k, _, x in told if k == kind), np.uint8).astype(np.int64) for kind in (1, 2)]
        m = replace(model.value, filter=Answers(hashes, levels))
        ids = chunk.column("ids")[0].values
        return pa.Table.from_batches([_rows(m, ids, *piece) for piece in own])
    return run


def _score_by_blocks(rows: DataFrame, model, segments: DataFrame, bits: int, schema: str) -> DataFrame:
    """``_score`` with a filter that is too large to be broadcast."""
    kind = rows.schema["id"].dataType.simpleString()
    # A chunk's number is fixed by being written.
    chunks = materialize(rows.mapInArrow(_pack, f"ids array<{kind}>, texts array<string>")
                         .withColumn("chunk", F.monotonically_increasing_id()), "lm-chunks")
    few = max(0, bits - BLOCK_BITS)
    asked = chunks.select("chunk", "texts").mapInArrow(_ask(few), "block long, chunk long, kind int, hashes binary")
    blocks = segments.withColumn("block", F.shiftright("segment", bits - few))
    answers = asked.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(
        _answer(bits), "block long, chunk long, kind int, levels binary")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_combine(model), schema)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
          filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Score every text: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    The model learns from the rows where ``held_out`` is false or null.  Tokens
    are the lower-cased (A-Z) words and one end for each text, so a null or
    empty text has one token.  ``base_score`` sums log10((c + 1) / (N + V + 1))
    with exact counts; ``score`` is the model's log10 probability of the text.
    Without any training row counts are 0 and all scores finite.  Null ids and
    repeated rows come out as they went in; other columns are ignored.
    """
    held_out = F.coalesce(held_out, F.lit(False))
    model, words, segments, bits = train(docs.where(~held_out), text_col, filter_bytes)
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id"), held_out.alias("held_out")).alias("id"),
                       text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = (f"id {kind}, n_tokens long, n_known long, logs double, score double, "
              "rare array<long>, times array<int>")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = rows.mapInArrow(_score(shared), schema) if model.filter is not None else \
        _score_by_blocks(rows, shared, segments, bits, schema)
    # The row number is fixed by being written.
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("pair")).select(
        "row", F.col("pair.rare").alias("token"), F.col("pair.times").alias("times"))
    found = materialize(rare.join(words, "token").groupBy("row").agg(
        F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("count") + 1)).alias("more")), "lm-rare")
    whole = math.log10(model.tokens + model.vocabulary + 1)
    return scored.select("row", "id", "n_tokens", "n_known", "logs", "score").join(found, "row", "left").select(
        "id.doc_id", "id.held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * whole).alias("base_score"), "score")
