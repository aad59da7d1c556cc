"""Term weights, scaling and pooling as relational work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions.numeric import finite
from labelloom.operators.relational import exploded
from labelloom.session import materialize

CHUNK_TERMS = 1 << 21  # tokens of the rows that are pooled together
BLOCK_DIMS = 64  # dimensions of a vector that travel together
PRODUCTS = 1 << 11  # counted terms multiplied at once, which fit into a core's cache
BLOCK_SCHEMA = "term string, block int, part binary"


def term_frequency(df: DataFrame, tokens: str = "tokens", row_id: str = "id") -> DataFrame:
    """(id, term, tf), counted inside each row, so nothing is shuffled."""
    return (exploded(df, [row_id], _runs(F.col(tokens)), "_run")
            .select(row_id, F.col("_run.term").alias("term"), F.col("_run.tf").alias("tf")))


def _runs(tokens: Column) -> Column:
    """(term, tf) of an array: sorted, then the lengths of equal runs.

    Values that are used more than once are bound in lambdas.
    """
    def counted(words: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(words) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        return F.transform(F.array(starts), lambda s: F.transform(s, lambda at, n: F.struct(
            F.get(words, at).alias("term"),
            (F.coalesce(F.get(s, n + 1), F.size(words)) - at).cast("bigint").alias("tf"))))

    ordered = F.array_sort(F.filter(tokens, lambda t: t.isNotNull()))
    return F.flatten(F.flatten(F.transform(F.array(ordered), lambda words: F.when(F.size(words) > 0, counted(words)))))


def document_frequency(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(term, df), counted straight from the rows: repeats within a row are
    removed inside the row, so the only shuffle is one partial count per term
    and task, which also settles terms that occur everywhere."""
    return (exploded(df, [], F.array_distinct(tokens), "term")
            .groupBy("term").agg(F.count("*").alias("df")))


def tfidf(df: DataFrame, tokens: str = "tokens", row_id: str = "id") -> DataFrame:
    """(id, term, tf, weight) with weight = tf * ln((N + 1) / (df + 1)).

    A plain join by term: Spark broadcasts the frequencies if it measures them
    as small, and else splits the terms that occur everywhere.
    """
    n = df.agg(F.count("*")).scalar()
    idf = (document_frequency(df, tokens)
           .select("term", F.log((n + 1) / (F.col("df") + 1)).alias("_idf")))
    tf = term_frequency(df, tokens, row_id)
    return (tf.join(idf, "term")
            .select(row_id, "term", "tf", (F.col("tf") * F.col("_idf")).alias("weight")))


def standardize(df: DataFrame, values: str = "features", with_mean: bool = True,
                fit_on: DataFrame | None = None) -> DataFrame:
    """Zero mean and unit (sample) deviation per dimension of an array column.

    Statistics come from one tree aggregation of fixed-size buffers; applying
    them is a narrow map.  ``fit_on`` names the rows to learn from.
    """
    def vectors(frame: DataFrame) -> DataFrame:
        return frame.withColumn("_in", array_to_vector(F.col(values).cast("array<double>")))

    scaler = StandardScaler(inputCol="_in", outputCol="_out", withMean=with_mean, withStd=True)
    model = scaler.fit(vectors(fit_on if fit_on is not None else df))
    return (model.transform(vectors(df)).withColumn(values, vector_to_array("_out"))
            .select(df.columns))


def mean_pool(df: DataFrame, row_id: str = "id", vector: str = "vector",
              weight: str | None = None) -> DataFrame:
    """Average many vectors (array column) per id: (id, features).

    ``Summarizer`` keeps one fixed-size buffer per group and combines on the
    map side, so neither long groups nor wide vectors are exploded.
    """
    v = array_to_vector(F.col(vector).cast("array<double>"))
    mean = Summarizer.mean(v) if weight is None else Summarizer.mean(v, F.col(weight))
    return df.groupBy(row_id).agg(vector_to_array(mean).alias("features"))


def vector_blocks(word_vectors: DataFrame, block: int = BLOCK_DIMS) -> DataFrame:
    """(term, block, part) of a table (word, vector): float32 bytes of ``block`` dimensions each.

    Bytes are shuffled as they are, while an array would be taken apart and
    put together value by value on the way.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            if len(batch):
                yield split_blocks(batch.column(0), values.reshape(len(batch), -1), block)

    table = word_vectors.select(F.col("word").alias("term"), F.col("vector").cast("array<float>").alias("v"))
    return table.where("term is not null and v is not null").mapInArrow(run, BLOCK_SCHEMA)


def split_blocks(terms: pa.Array, vectors: np.ndarray, block: int) -> pa.RecordBatch:
    starts = range(0, vectors.shape[1], block)
    parts = [np.ascontiguousarray(vectors[:, at:at + block]) for at in starts]
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([terms] * len(parts)), pa.array(np.repeat(np.arange(len(parts), dtype=np.int32), len(terms))),
         pa.array([row.tobytes() for part in parts for row in part], pa.binary())], names=["term", "block", "part"])


def pooled_word_vectors(df: DataFrame, word_vectors: DataFrame, tokens: str = "tokens",
                        row_id: str = "id", unknown: str = "skip", dim: int | None = None,
                        chunk: int = CHUNK_TERMS, block: int = BLOCK_DIMS) -> DataFrame:
    """Mean of the word vectors of each row's tokens: (id, features).

    Rows are dealt to chunks of about ``chunk`` tokens.  A chunk asks for each of
    its terms once, so a vector travels once per chunk and not once per row, and
    no term is a hot key.  Vectors are cut into blocks of dimensions, and a task
    multiplies one chunk's (rows x terms) counts with one block; so neither a
    row's full width nor a chunk's whole dictionary is in one place.  The blocks
    of a row are put together once.

    ``unknown="skip"`` leaves out words without a vector (rows without any known
    word vanish); ``unknown="zero"`` counts them as zero vectors and needs ``dim``.
    Rows that share an id are pooled together.
    """
    if unknown not in ("skip", "zero"):
        raise ValueError(f"unknown must be 'skip' or 'zero', not {unknown!r}")
    if unknown == "zero" and dim is None:
        raise ValueError("unknown='zero' needs dim")
    if dim is None:
        first = word_vectors.select(F.size("vector").alias("n")).first()
        dim = first.n if first else 1
    rows = token_rows(df, tokens, row_id)
    return pooled_rows(rows, vector_blocks(word_vectors, block), dim, unknown == "zero", chunk, block).withColumnRenamed("id", row_id)


def token_rows(df: DataFrame, tokens: str = "tokens", row_id: str = "id") -> DataFrame:
    """(id, terms) of the rows with tokens, written once for all that reads them."""
    rows = df.select(F.col(row_id).alias("id"), F.filter(F.col(tokens), lambda t: t.isNotNull()).alias("terms"))
    return materialize(rows.where(F.size("terms") > 0), "token-rows")


def pooled_rows(rows: DataFrame, blocks: DataFrame, dim: int, zero: bool = False, chunk: int = CHUNK_TERMS,
                block: int = BLOCK_DIMS) -> DataFrame:
    """``pooled_word_vectors`` of ``token_rows`` and ``vector_blocks``: (id, features)."""
    total = rows.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    chunk_of = F.pmod(F.xxhash64("id"), F.lit(total // chunk + 1))
    wanted = exploded(rows.withColumn("chunk", chunk_of), ["chunk"], F.array_distinct("terms"), "term").distinct()
    vectors = wanted.join(blocks, "term").select(F.col("chunk").alias("of_chunk"), F.col("block").alias("of_block"), "term", "part")
    n_blocks = -(-dim // block)
    sides = rows.select(chunk_of.alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "id", "terms")
    kind = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("block", T.IntegerType()),
                         T.StructField("part", T.ArrayType(T.DoubleType()))])
    pooled = sides.groupBy("chunk", "block").cogroup(vectors.groupBy("of_chunk", "of_block")).applyInArrow(
        _pooled_block(zero, dim, block), kind)
    whole = pooled.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("parts"))
    return whole.select("id", F.flatten("parts.part").alias("features"))


def _pooled_block(zero: bool, dim: int, block: int):
    """Means of a chunk's rows over one block of its terms' vectors."""
    def run(rows: pa.Table, vectors: pa.Table) -> pa.Table:
        ids, b = rows.column("id").combine_chunks(), rows.column("block")[0].as_py() if len(rows) else 0
        terms, width = rows.column("terms").combine_chunks(), min(block, dim - b * block)
        # Unknown terms are the last, empty row of the table.
        table = np.zeros((len(vectors) + 1, width), dtype=np.float32)
        table[:-1] = np.frombuffer(b"".join(vectors.column("part").to_pylist()), dtype=np.float32).reshape(-1, width)
        place = pc.index_in(terms.flatten(), value_set=vectors.column("term").combine_chunks()).fill_null(len(vectors)).to_numpy()
        coded = ids.dictionary_encode("encode")
        row = np.repeat(coded.indices.to_numpy(), np.diff(terms.offsets.to_numpy()))
        # Equal (row, term) are counted first, so each vector is taken once per row.
        cell, count = np.unique(row.astype(np.int64) * len(table) + place, return_counts=True)
        row, place = cell // len(table), cell % len(table)
        weight = np.where(place < len(vectors), count, count if zero else 0)
        sums, heavy = np.zeros((len(coded.dictionary), width)), np.bincount(row, weights=weight, minlength=len(coded.dictionary))
        for at in range(0, len(row), PRODUCTS):
            here = row[at:at + PRODUCTS]
            heads = np.flatnonzero(np.diff(here, prepend=-1))
            sums[here[heads]] += np.add.reduceat(table[place[at:at + PRODUCTS]] * count[at:at + PRODUCTS, None].astype(np.float64), heads)
        known = np.flatnonzero(heavy > 0)
        means = sums[known] / heavy[known, None]
        part = pa.ListArray.from_arrays(np.arange(len(known) + 1, dtype=np.int32) * width, means.ravel())
        return pa.table([coded.dictionary.take(pa.array(known)), pa.array(np.full(len(known), b, dtype=np.int32)), part],
                        names=["id", "block", "part"])
    return run


def assemble(df: DataFrame, values: str = "features") -> DataFrame:
    """Array column to ML vector; rows with a null or NaN element are dropped."""
    return df.filter(finite(values)).withColumn(values, array_to_vector(F.col(values)))
