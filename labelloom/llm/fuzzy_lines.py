"""Fuzzy line deduplication with MinHash.

Distinct lines become sets of character shingles, each hashed once; the least
hash in each of ``ROWS * BANDS`` residue classes makes the signature (one
permutation hashing).  An empty class counts as a value of its own, which can
only raise the chance that similar lines agree, but a band of empty classes
says nothing and is left out.  Lines that agree in a band and whose sizes and
parities allow it are compared exactly, and verified links are joined by
distributed union-find.

Shingles are hashed by numpy for some hundred lines at once.  Within a line
their hashes have 56 bits: of two lines with k shingles together about k * k / 2**57
pairs of shingles share one.  A line's shingles must fit into a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import materialize, text_of, unused
from labelloom.llm.components import linked
from labelloom.llm.jaccard_join import folded
from labelloom.llm.words import mix

SHINGLE = 7
ROWS, BANDS = 3, 10   # finds 99.6 % of the pairs at similarity 0.75, more above
BROADCAST_ROWS = 1 << 20  # ids or band values broadcast at most: about 30 MB
LINES, CHARS = 256, 1 << 18  # lines (or one longer line) whose shingles are hashed at once
FILLER = "\ud800"  # no character of any text: lengthens lines shorter than a shingle
_HASH_BITS = np.uint64(56)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def line_id(line: Column) -> Column:
    """64 bits; among n distinct lines about n * n / 2**65 pairs share one."""
    return F.xxhash64(line)


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, line): all lines of all texts that hold more than white space."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode_outer(F.split(text_of(text_col), "\n"))
                        .alias("line_no", "line"))
    return lines.where(F.trim(F.col("line"), F.lit(" \t\r\x0b\x0c")) != "")


def _texts(column: pa.Array) -> list[str]:
    return [v.decode("utf-8", "replace") for v in column.cast(pa.binary()).to_pylist()]


def _cuts(sizes: list[int], most: int) -> Iterator[slice]:
    """Runs of at most ``most`` rows and ``CHARS`` characters, or of one longer row."""
    first = held = 0
    for i, size in enumerate(sizes):
        if i > first and (i - first == most or held + size > CHARS):
            yield slice(first, i)
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield slice(first, len(sizes))


def shingle_keys(lines: list[str], owners: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles of every line, sorted: its owner (below 256) in the first byte, then 56 bits of hash.

    A line shorter than a shingle is one.
    """
    filled = [line.ljust(size, FILLER) for line in lines]
    points = np.frombuffer("".join(filled).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(owners.astype(np.uint64) << _HASH_BITS, [len(line) for line in filled])
    last = len(points) - size + 1
    hashes = points[:last].copy()
    for i in range(1, size):
        hashes *= _MULTIPLIER
        hashes += points[i:i + last]
    hashes ^= hashes >> np.uint64(32)
    hashes *= _MULTIPLIER
    hashes >>= np.uint64(8)
    hashes |= owner[:last]
    keys = hashes[owner[:last] == owner[size - 1:]]
    keys.sort()
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _bands(owner: np.ndarray, hashes: np.ndarray, lines: int, rows: int, bands: int) -> pa.ListArray:
    """Each line's bands that have any shingle; ``hashes`` rise within a line."""
    residue = (hashes % np.uint64(rows * bands)).astype(np.int64)
    least = np.zeros(lines * rows * bands, dtype=np.uint64)  # 0: an empty class
    # Of several values for a place the last one stays, so the least one comes last.
    least[(owner * (rows * bands) + residue)[::-1]] = hashes[::-1] + np.uint64(1)
    least = least.reshape(lines, bands, rows)
    value = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (lines, bands))
    for r in range(rows):
        value = mix(value * _MULTIPLIER + least[:, :, r])
    some = least.any(axis=2)
    return _lists(value[some], some.sum(axis=1))


def _sketches(owner: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """For one to two cells a shingle (a power of two, 64 at least) whether an odd number of shingles fall into it.

    At most as many cells of two lines differ as shingles do.
    """
    cells = np.left_shift(1, np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)))
    start = np.cumsum(cells) - cells
    counts = np.bincount(start[owner] + (hashes.astype(np.int64) & (cells[owner] - 1)), minlength=int(cells.sum()))
    return _lists(np.packbits((counts & 1).astype(np.uint8)).view(np.uint64), cells // 64)


def _described(size: int, rows: int, bands: int):
    """(lid, first_doc, line) -> (lid, first_doc, n, bands, sketch)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column("line"))
            for rows_of in _cuts([len(t) for t in texts], LINES):
                part = texts[rows_of]
                keys = shingle_keys(part, np.arange(len(part)), size)
                owner = (keys >> _HASH_BITS).astype(np.int64)
                hashes = keys & np.uint64((1 << 56) - 1)
                n = np.bincount(owner, minlength=len(part))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c)[rows_of] for c in ("lid", "first_doc")), pa.array(n, pa.int64()),
                     _bands(owner, hashes, len(part), rows, bands), _sketches(owner, hashes, n)],
                    names=["lid", "first_doc", "n", "bands", "sketch"])
    return run


def describe(lines: DataFrame, size: int, rows: int, bands: int) -> DataFrame:
    """(lid, first_doc, bands, traits (n, sketch)) of distinct lines (lid, first_doc, line); ``n`` counts shingles."""
    found = lines.select("lid", "first_doc", "line").mapInArrow(
        _described(size, rows, bands),
        "lid long, first_doc long, n long, bands array<long>, sketch array<long>")
    return found.select("lid", "first_doc", "bands", F.struct("n", "sketch").alias("traits"))


def may_be_similar(one: str, other: str, num: int, den: int) -> Column:
    """Whether sizes and parities allow a similarity of num / den (above a half); never false for similar lines.

    Sizes then differ by less than a factor of two, hence cells by one doubling at most.
    """
    n, m = F.col(f"{one}.n"), F.col(f"{other}.n")
    x, y = F.col(f"{one}.sketch"), F.col(f"{other}.sketch")
    words = F.least(F.size(x), F.size(y))
    differ = F.aggregate(F.zip_with(folded(x, words), folded(y, words), lambda p, q: F.bit_count(p.bitwiseXOR(q))),
                         F.lit(0), lambda total, count: total + count)
    return (den * F.least(n, m) >= num * F.greatest(n, m)) & ((den + num) * differ <= (den - num) * (n + m))


def _similar(size: int, num: int, den: int):
    """(a, b, p, q) -> (a, b): the pairs whose lines p and q have a similarity of num / den at least."""
    half = LINES // 2
    middle = np.uint64(half) << _HASH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = _texts(batch.column("p")), _texts(batch.column("q"))
            for rows in _cuts([len(x) + len(y) for x, y in zip(p, q)], half):
                count = rows.stop - rows.start
                own = np.arange(count)
                keys = shingle_keys(p[rows] + q[rows], np.concatenate((own, half + own)), size)
                cut = int(np.searchsorted(keys, middle))
                common = np.intersect1d(keys[:cut], keys[cut:] - middle, assume_unique=True)
                n, m, both = (np.bincount((k >> _HASH_BITS).astype(np.int64), minlength=count)
                              for k in (keys[:cut], keys[cut:] - middle, common))
                found = pa.array(np.flatnonzero(den * both >= num * (n + m - both)))
                yield pa.RecordBatch.from_arrays([batch.column(c)[rows].take(found) for c in "ab"], names=["a", "b"])
    return run


def _checked(rows: DataFrame) -> DataFrame:
    """Broadcast if few enough; else Spark joins by a shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def line_classes(lines: DataFrame, size: int = SHINGLE, rows: int = ROWS, bands: int = BANDS, num: int = 3,
                 den: int = 4) -> tuple[DataFrame, DataFrame]:
    """``known`` (lid, first_doc) of distinct lines and ``classes`` (node, component) of similar ones."""
    distinct = lines.select(line_id(F.col("line")).alias("lid"), "line", "doc_id").groupBy("lid").agg(
        F.min("doc_id").alias("first_doc"), F.any_value("line").alias("line"))
    described = materialize(describe(distinct, size, rows, bands), "lines-described")
    known = described.select("lid", "first_doc")
    exploded = described.select(F.explode_outer("bands").alias("signature"), "lid")
    shared = materialize(exploded.groupBy("signature").count().where("count > 1").select("signature"), "lines-shared")
    index = exploded.join(_checked(shared), "signature").select("signature", F.col("lid").alias("sid"))

    # The texts of lines that have a signature with others; all rounds read them from here.
    wanted = materialize(index.select(F.col("sid").alias("lid")).distinct(), "lines-wanted")
    texts = materialize(
        lines.select(line_id(F.col("line")).alias("lid"), "line").join(_checked(wanted), "lid", "left_semi")
        .groupBy("lid").agg(F.any_value("line").alias("line")), "lines-texts")

    def both(pairs: DataFrame, source: DataFrame, column: str) -> DataFrame:
        """(a, b, p, q): pairs with the ``column`` of both lines."""
        ends = materialize(pairs.select(F.col("b").alias("lid")).distinct(), "lines-ends")
        values = source.select("lid", column)
        left = values.join(_checked(pairs), F.col("lid") == F.col("a")).select("a", "b", F.col(column).alias("p"))
        right = values.join(_checked(ends), "lid", "left_semi").select(F.col("lid").alias("b"), F.col(column).alias("q"))
        return left.join(right, "b").select("a", "b", "p", "q")

    def verified(pairs: DataFrame) -> DataFrame:
        """The texts are read only of lines that may be similar."""
        pairs = both(materialize(pairs, "lines-pairs"), described, "traits").where(may_be_similar("p", "q", num, den))
        pairs = materialize(pairs.select("a", "b"), "lines-candidates")
        return both(pairs, texts, "line").mapInArrow(_similar(size, num, den), "a long, b long")

    nodes = described.select(F.col("lid").alias("sid"), "traits")
    found = linked(index, nodes, lambda one, other: may_be_similar(one, other, num, den),
                   lambda pairs: pairs, verified, "lines")
    return known, materialize(found, "lines-classes")


def judge_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, line_no, keep_doc_id, kept) for every line that isn't blank.

    Lines whose sets of character shingles have a Jaccard similarity of 0.75 or
    more are linked; of each component one line stays, once: that of the
    smallest document id (of several lines of that document the one with the
    smallest hash), at its first place there.  ``keep_doc_id`` is that id.

    Blank lines are no lines here and stay in every text; so null and empty
    texts have none.  Lines shorter than a shingle are one shingle each.  Ids
    that are null rank first, as one document.  Rows that repeat an id and a
    text both keep what one of them keeps.  Other columns are ignored; an empty
    table gives an empty result.
    """
    ranked = docs.select(F.col(id_col).alias("own_id"),
                         F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
                         text_of(text_col).alias("text"))
    known, classes = line_classes(line_table(ranked, "doc_id", "text"), **options)
    member = known.join(classes.withColumnRenamed("node", "lid"), "lid", "left").select(
        "lid", "first_doc", F.coalesce("component", "lid").alias("component"))
    member = materialize(member, "lines-members")
    winner = materialize(member.groupBy("component").agg(F.min(F.struct("first_doc", "lid")).alias("w")).select(
        "component", F.col("w.first_doc").alias("keep"), F.col("w.lid").alias("keep_lid")), "lines-winners")
    verdict = materialize(member.join(winner, "component").select(
        "lid", "keep", (F.col("lid") == F.col("keep_lid")).alias("wins")), "lines-verdicts")
    # The first place of a line in its own document.
    places = ranked.select("own_id", "doc_id", F.split("text", "\n").alias("all")).select(
        "own_id", "doc_id", "all", F.posexplode_outer("all").alias("line_no", "line"))
    places = places.where(F.trim(F.col("line"), F.lit(" \t\r\x0b\x0c")) != "").select(
        "own_id", "doc_id", "line_no", line_id(F.col("line")).alias("lid"),
        (F.array_position("all", F.col("line")) == F.col("line_no") + 1).alias("is_first"))
    return places.join(verdict, "lid").select(
        F.col("own_id").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"),
        F.when(F.col("keep") > -(1 << 63), F.col("keep")).alias("keep_doc_id"),
        (F.col("wins") & F.col("is_first") & (F.col("doc_id") == F.col("keep"))).alias("kept"))


def keep_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with only the lines that stay (and blank ones); a null text stays null.

    Rows of one id get what that id keeps, so ids should not repeat with
    different texts.
    """
    key, gone = unused(docs, "_line_doc", "_line_gone")
    judged = judge_lines(docs, id_col, text_col, **options).where("not kept")
    lost = materialize(judged.groupBy(F.col("doc_id").alias(key)).agg(
        F.collect_set("line_no").alias(gone)), "lines-lost")
    joined = docs.join(lost, F.col(id_col).eqNullSafe(F.col(key)), "left")
    left = F.filter(F.split(text_col, "\n"), lambda line, i: ~F.array_contains(gone, i.cast("long")))
    return joined.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(
        F.array_join(left, "\n"))).select(*docs.columns)
