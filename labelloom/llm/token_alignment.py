"""Alignment of two tokenizers' tokens by products of sparse incidence matrices.

A chunk of texts gives two 0/1 matrices in compressed sparse rows (CSR), tokens
by bytes: A and B.  Row products A·Bᵀ after Gustavson are the overlap links of
the two tokenizations, with the number of shared bytes as values.  Byte offsets
at which tokens of both end cut the tokens into groups, and the product of the
two token-by-group matrices gives the links within groups.

How many documents hold a pair of ids linked is counted over the whole corpus.
A chunk keeps a documents-by-pairs matrix; of the corpus's pairs it gets back
those it has, and its documents' sums are products of its matrix with their
counts.  A pair is one row per chunk in that join, so the most frequent pair is
no hot key, and nothing is broadcast.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import materialize, text_of

CHUNK = 1 << 20  # bytes of text in a chunk; a longer text is a chunk of its own
PIECE = 1 << 18  # bytes of text tokenized at once
PRODUCTS = 1 << 20  # products of a block of rows; a longer row is a block of its own
ID = np.dtype("<u4")
WORDS = 1 << 18  # words remembered by a worker
LONG = 100  # characters of a word, beyond which it is not remembered
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
NO_TOKENS = ""  # the groups' digest of a text without tokens


class CSR(NamedTuple):
    """A sparse matrix: row i has values ``data`` in the columns ``indices``, both at indptr[i] to indptr[i + 1]."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int


def csr(lengths: np.ndarray, indices: np.ndarray, columns: int, data: np.ndarray | None = None) -> CSR:
    indptr = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return CSR(indptr, indices, np.ones(len(indices), dtype=np.int64) if data is None else data, columns)


def transpose(m: CSR) -> CSR:
    rows = np.repeat(np.arange(len(m.indptr) - 1), np.diff(m.indptr))
    order = np.argsort(m.indices, kind="stable")
    return csr(np.bincount(m.indices, minlength=m.columns), rows[order], len(m.indptr) - 1, m.data[order])


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of sizes[0] numbers, and so on."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def row_work(a: CSR, b: CSR) -> np.ndarray:
    """How many products each row of a·b takes."""
    work = np.concatenate([[0], np.cumsum(np.diff(b.indptr)[a.indices])])
    return work[a.indptr[1:]] - work[a.indptr[:-1]]


def gustavson(a: CSR, b: CSR, products: int = PRODUCTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, values) of a·b by blocks of rows, in order.

    A row of the product is the sum of the rows of ``b`` that the row of ``a``
    names, scaled by its values.  Blocks end where their products reach the
    limit, so memory doesn't grow with the matrices.
    """
    ends = np.cumsum(row_work(a, b))
    first, n = 0, len(a.indptr) - 1
    while first < n:
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + products, side="right")))
        s, e = a.indptr[first], a.indptr[last]
        named = a.indices[s:e]
        sizes = b.indptr[named + 1] - b.indptr[named]
        at = ragged(b.indptr[named], sizes)
        row = np.repeat(np.repeat(np.arange(first, last), np.diff(a.indptr[first:last + 1])), sizes)
        keys, values = row * b.columns + b.indices[at], np.repeat(a.data[s:e], sizes) * b.data[at]
        if (keys[1:] < keys[:-1]).any():
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, dtype=np.int64)
        if len(heads):
            yield keys[heads] // b.columns, keys[heads] % b.columns, np.add.reduceat(values, heads)
        first = last


def _byte_letters() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte, by its public rule.

    Printable Latin-1 bytes stand for themselves, others are 256 and up in order.
    """
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, and the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        # Spark runs a worker for each core; the library must not add threads of its own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in token)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in table]) for table in (self.a_bytes, self.b_bytes))
        # Byte-level BPE begins a new word at a single space between other characters, by its pattern, and so does
        # a model none of whose pieces has a space behind something else.
        rule = json.loads(self.a.to_str())
        letters_first = rule["pre_tokenizer"] or {}
        self.by_words = (letters_first.get("type") == "ByteLevel" and letters_first.get("use_regex", True)
                         and not rule["normalizer"]
                         and not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(len(self.b_bytes))))
        self.words: dict[str, tuple[bytes, bytes] | None] = {}
        # What the groups' text has for an id: within its group, then last of its group, for A and then for B.
        self.written = [f"{i}{end}" for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;"))
                        for end in ends for i in range(n)]

    def whole(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of space + text by A, and of text by B (which adds the space); None where bytes get lost."""
        out = []
        for ids_a, ids_b, text in zip(self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False),
                                      self.b.encode(texts, num_threads=1), texts):
            ids_a, space_text = ids_a.ids, b" " + text.encode()
            same = (b"".join([self.a_bytes[i] for i in ids_a]) == space_text
                    and b"".join([self.b_bytes[i] for i in ids_b]) == space_text)
            out.append((np.array(ids_a, dtype=ID).tobytes(), np.array(ids_b, dtype=ID).tobytes()) if same else None)
        return out

    def _learned(self, words: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """The ids of words, encoded as one text and cut at its spaces; none if that can't be done."""
        found, ends = [], np.cumsum([len(w.encode()) + 1 for w in words])
        for data, sizes in zip(self.whole([" ".join(words)])[0] or (), (self.a_sizes, self.b_sizes)):
            token_ends = np.cumsum(sizes[np.frombuffer(data, dtype=ID)])
            cuts = np.searchsorted(token_ends, ends)
            if (token_ends[cuts] != ends).any():
                return {}
            cuts = [0, *((cuts + 1) * ID.itemsize).tolist()]
            found.append([data[s:e] for s, e in zip(cuts, cuts[1:])])
        return dict(zip(words, zip(*found))) if found else {}

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids by A and by B, none for texts without any or whose bytes get lost.

        Where both tokenizers are known never to cross a single space, words are
        encoded once and remembered; they repeat far more often than texts.
        """
        words = [SINGLE_SPACE.split(t) if self.by_words else [t] for t in texts]
        if len(self.words) > WORDS:
            self.words.clear()
        new = list({w for ws in words for w in ws if w not in self.words})
        inner = [w for w in new if w and not w[0].isspace() and not w[-1].isspace()] if self.by_words else []
        self.words.update(self._learned(inner))
        outer = [w for w in new if w not in self.words]
        self.words.update(zip(outer, self.whole(outer)))
        out = [], []
        for text, ws in zip(texts, words):
            known = [self.words[w] for w in ws]
            if None in known:
                # A word that loses bytes: the whole text decides.
                known = self.whole([text])
            if not text or known == [None]:
                known = []
            for k, side in enumerate(out):
                side.append(np.frombuffer(b"".join([ids[k] for ids in known]), dtype=ID).astype(np.int64))
        for w in new:
            if len(w) > LONG:
                del self.words[w]
        return out


@lru_cache(maxsize=2)
def load(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


class Aligned:
    """The tokens, links and groups of some texts, whose bytes lie one behind the other."""

    def __init__(self, tools: Tokenizers, texts: list[str]):
        a, b, at = [], [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= PIECE):
                size, end = size + len(texts[end]), end + 1
            more = tools.encode(texts[at:end])
            a, b, at = a + more[0], b + more[1], end
        self.n_a, self.n_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (a, b))
        self.a, self.b = (np.concatenate([np.empty(0, dtype=np.int64), *side]) for side in (a, b))
        size_a, size_b = tools.a_sizes[self.a], tools.b_sizes[self.b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        total = int(size_a.sum())
        self.doc_a, self.doc_b = (np.repeat(np.arange(len(texts)), n) for n in (self.n_a, self.n_b))
        self.bytes_a, self.bytes_b = (csr(size, np.arange(total), total) for size in (size_a, size_b))
        ends = np.zeros(total + 1, dtype=bool)
        ends[end_b] = True
        self.last_a = ends[end_a]
        ends[:] = False
        ends[end_a] = True
        self.last_b = ends[end_b]
        self.group_a, self.group_b = (np.cumsum(last) - last for last in (self.last_a, self.last_b))
        self.groups = int(self.last_a.sum())
        self.n_groups = np.bincount(self.doc_a[self.last_a], minlength=len(texts))

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, shared bytes), A·Bᵀ."""
        return gustavson(self.bytes_a, transpose(self.bytes_b))

    def group_matrices(self) -> tuple[CSR, CSR]:
        """Tokens of A by groups, and groups by tokens of B."""
        a, b = (csr(np.ones(len(g), dtype=np.int64), g, self.groups) for g in (self.group_a, self.group_b))
        return a, transpose(b)

    def shared_groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, 1) of one group."""
        return gustavson(*self.group_matrices())

    def written_groups(self, tools: Tokenizers) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        n_a, n_b = len(tools.a_bytes), len(tools.b_bytes)
        per_a, per_b = (np.bincount(g, minlength=self.groups) for g in (self.group_a, self.group_b))
        # A group's tokens of A stand behind all earlier tokens, those of B behind these.
        order = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        order[np.arange(len(self.a)) + (np.cumsum(per_b) - per_b)[self.group_a]] = self.a + n_a * self.last_a
        order[np.arange(len(self.b)) + np.cumsum(per_a)[self.group_b]] = self.b + 2 * n_a + n_b * self.last_b
        ends = np.cumsum(self.n_a + self.n_b)
        return ["".join([tools.written[i] for i in order[s:e].tolist()])[:-1]
                for s, e in zip(np.concatenate([[0], ends[:-1]]), ends)]


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of about ``chunk`` bytes."""
    for batch in batches:
        texts = batch.column(1)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + chunk, side="right")) - 1)
            yield batch.column(0).slice(at, end - at), texts.slice(at, end - at).to_pylist()
            at = end


STATS = ["n_a", "n_b", "n_groups", "n_links", "n_group_links"]


def _describe(a_path: str, b_path: str, chunk: int):
    """Rows of documents with their row of the documents-by-pairs matrix, and a row of each chunk's pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, number = load(a_path, b_path), TaskContext.get().partitionId() << 32
        for ids, texts in _chunks(batches, chunk):
            got, n = Aligned(tools, texts), len(texts)
            keys, counts, n_links = [], [], np.zeros(n, dtype=np.int64)
            span = len(tools.a_bytes) * len(tools.b_bytes)
            for x, y, _ in got.overlaps():
                n_links += np.bincount(got.doc_a[x], minlength=n)
                key, times = np.unique(got.doc_a[x] * span + got.a[x] * len(tools.b_bytes) + got.b[y], return_counts=True)
                keys.append(key)
                counts.append(times)
            # Blocks of rows may cut a document: its pairs in both are one.
            none = np.empty(0, dtype=np.int64)
            key, which = np.unique(np.concatenate([none, *keys]), return_inverse=True)
            times = np.bincount(which, weights=np.concatenate([none, *counts]), minlength=len(key)).astype("<u4")
            pairs, column, held = np.unique(key % span, return_inverse=True, return_counts=True)
            rows = np.searchsorted(key // span, np.arange(n + 1))
            column = column.astype("<u4")
            group_links = np.bincount(got.doc_a, weights=row_work(*got.group_matrices()), minlength=n).astype(np.int64)
            digests = [hashlib.sha256(t.encode()).hexdigest() if t else NO_TOKENS for t in got.written_groups(tools)]
            stats = [got.n_a, got.n_b, got.n_groups, n_links, group_links]
            cut = list(zip(rows[:-1], rows[1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * n, pa.int64()), ids, *(pa.array(s, pa.int64()) for s in stats), pa.array(digests, pa.string()),
                 # Differences of sorted columns are small numbers, which compress.
                 pa.array([np.diff(column[s:e], prepend=np.uint32(0)).tobytes() for s, e in cut], pa.binary()),
                 pa.array([times[s:e].tobytes() for s, e in cut], pa.binary()),
                 pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], names=names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.nulls(1, ids.type), *(pa.nulls(1, pa.int64()) for _ in stats),
                 pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                 pa.array([pairs], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.int64()))], names=names)
            number += 1
    names = ["chunk", "doc_id", *STATS, "groups_sha256", "columns", "times", "pairs", "held"]
    return run


def _schema(docs: DataFrame, ddl: str) -> T.StructType:
    return T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(ddl)])


def _sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Products of a chunk's matrix with the counts of its pairs, which come in any order."""
    order = np.argsort(right.column("pair").to_numpy())
    count = right.column("count").to_numpy()[order]
    best = right.column("best").to_numpy()[order]
    n_best, count_sum = [], []
    for columns, times in zip(left.column("columns").to_pylist(), left.column("times").to_pylist()):
        at = np.cumsum(np.frombuffer(columns, dtype="<u4"), dtype="<u4")
        times = np.frombuffer(times, dtype="<u4").astype(np.int64)
        n_best.append(int(times[best[at]].sum()))
        count_sum.append(int((times * count[at]).sum()))
    return pa.table([left.column("doc_id"), *(left.column(s) for s in STATS), left.column("groups_sha256"),
                     pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())],
                    names=["doc_id", *STATS, "groups_sha256", "n_best", "count_sum"])


def pair_counts(pairs: DataFrame, b_ids: int) -> DataFrame:
    """(pair, count, best) from (pair, held): documents that hold a pair, and whether none of its A id has more.

    An A id has at most as many pairs as B has ids, so its window is bounded.
    """
    counts = pairs.groupBy("pair").agg(F.sum("held").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.expr(f"pair div {b_ids}")))
    return counts.withColumn("best", F.col("count") == most)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
          chunk: int = CHUNK) -> DataFrame:
    """A row per document: tokens, groups and links, and what the corpus says of its links.

    ``a_path`` is a byte-level BPE of the ``tokenizers`` library, ``b_path`` a
    ``sentencepiece`` model, both readable by every worker.  ``n_best`` counts the
    links whose pair of ids is in most documents among the pairs of its A id,
    ties included; ``count_sum`` is the sum over links of the documents that
    hold their pair.

    Null and empty texts, and those whose tokens don't give back their bytes
    have no tokens: zeros, and an empty digest.  Repeated rows are documents of
    their own and count as such, null ids too.  Texts of any length are aligned
    whole; one longer than ``chunk`` is held by one task.  Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    fields = ", ".join(f"{s} long" for s in STATS)
    kinds = _schema(rows, f"{fields}, groups_sha256 string, columns binary, times binary, pairs array<long>, held array<long>")
    described = materialize(rows.mapInArrow(_describe(a_path, b_path, chunk), T.StructType(
        [T.StructField("chunk", T.LongType()), *kinds])), "alignment-chunks")
    listed = described.where("pairs is not null").select("chunk", F.explode(F.arrays_zip("pairs", "held")).alias("p")).select(
        "chunk", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))
    counts = materialize(pair_counts(listed, load(a_path, b_path).b.get_piece_size()), "alignment-pairs")
    known = listed.select(F.col("chunk").alias("of_chunk"), "pair").join(counts, "pair")
    matrix = described.where("columns is not null").select("chunk", "doc_id", *STATS, "groups_sha256", "columns", "times")
    return matrix.groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(
        _sums, _schema(rows, f"{fields}, groups_sha256 string, n_best long, count_sum long"))


def alignment_links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
                    chunk: int = CHUNK) -> DataFrame:
    """(doc_id, a_place, b_place, a_id, b_id, overlap): all pairs of tokens of one group.

    Places count from 0 in the document; ``overlap`` is the number of shared
    bytes, 0 for pairs that only share their group.  Edge cases as in ``align``.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = load(a_path, b_path)
        for ids, texts in _chunks(batches, chunk):
            got = Aligned(tools, texts)
            first_a, first_b = np.cumsum(got.n_a) - got.n_a, np.cumsum(got.n_b) - got.n_b
            found = [np.concatenate(c) for c in zip((np.empty(0, dtype=np.int64),) * 3, *got.overlaps())]
            overlap_keys = found[0] * len(got.b) + found[1]
            for x, y, _ in got.shared_groups():
                doc, at = got.doc_a[x], np.searchsorted(overlap_keys, x * len(got.b) + y)
                safe = np.minimum(at, len(overlap_keys) - 1)
                shared = np.where(overlap_keys[safe] == x * len(got.b) + y, found[2][safe], 0)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(doc)), *(pa.array(v, pa.int64()) for v in
                                                (x - first_a[doc], y - first_b[doc], got.a[x], got.b[y], shared))],
                    names=["doc_id", "a_place", "b_place", "a_id", "b_id", "overlap"])
    return rows.mapInArrow(run, _schema(rows, "a_place long, b_place long, a_id long, b_id long, overlap long"))
