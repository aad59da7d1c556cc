"""Quality classifier: gated attention over the passages of a document.

A document is a bag of passages.  Every passage is encoded, a gated attention
network weighs the codes, and their weighted mean gives the score; only the
documents carry labels.  Passages have ``WORDS`` words; a document of more than
``PASSAGES`` such passages is cut into ``PASSAGES`` longer ones, so the whole
text counts and a bag stays bounded.

The network is fitted on at most ``SAMPLE`` labelled documents (those with the
least hashes of their ids), on the driver; everything else is done by tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import text_of, unused
from labelloom.llm.words import Piece, pieces, sequence_hash

SAMPLE = 4_000
WORDS = 64
PASSAGES = 64

_CLASSES = 10
_CLASS = np.full(256, 6, dtype=np.int64)  # other symbols
_CLASS[ord("a"):ord("z") + 1] = 0
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[np.frombuffer(b".,;:'\"?-()", dtype=np.uint8)] = 3
_CLASS[ord("!")] = 4
_CLASS[ord("|")] = 5
_CLASS[0x80:] = 7
_CLASS[[0x20, 0x09]] = 8
_CLASS[0x0A:0x0E] = 9
FEATURES = 3 * _CLASSES + 6


def _repeated(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which keys come more than once in their group; all but the first are marked."""
    order = np.lexsort((keys, group))
    again = np.zeros(len(keys), dtype=bool)
    if len(keys) > 1:
        k, g = keys[order], group[order]
        again[order[1:]] = (k[1:] == k[:-1]) & (g[1:] == g[:-1])
    return again


def encode_passages(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and for each row of the piece its first passage.

    A row without words has one passage.
    """
    bounds = piece.word_bounds()
    words = np.diff(bounds)
    size = np.maximum(WORDS, -(-words // PASSAGES))
    count = np.maximum(1, -(-words // size))
    first = np.concatenate(([0], np.cumsum(count)))
    total = int(first[-1])
    of_word = first[piece.row] + (np.arange(len(piece.row)) - bounds[piece.row]) // size[piece.row]
    # A passage begins with its first word, the first one of a row with the row.
    begins = np.zeros(total + 1, dtype=np.int64)
    lead = np.ones(len(of_word), dtype=bool)
    lead[1:] = of_word[1:] != of_word[:-1]
    begins[of_word[lead]] = piece.starts[lead]
    begins[first[:-1]] = piece.offsets[:-1]
    begins[total] = piece.offsets[-1]
    chars = np.diff(begins)

    def shares(where: np.ndarray, classes: np.ndarray, whole: np.ndarray) -> np.ndarray:
        counts = np.bincount(where * _CLASSES + classes, minlength=total * _CLASSES)
        return counts.reshape(total, _CLASSES) / np.maximum(1, whole)[:, None]

    def mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(of_word, weights=values, minlength=total) / np.maximum(1, in_passage)

    in_passage = np.bincount(of_word, minlength=total)
    hashes = piece.word_hashes()
    runs = np.zeros(len(hashes), dtype=bool)
    if len(hashes) > 2:
        within = piece.row[2:] == piece.row[:-2]
        again = _repeated(sequence_hash(hashes, 3)[within], piece.row[:-2][within])
        runs[:-2][within] = again
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (piece.row[1:] == piece.row[:-1])
    parts = [shares(np.repeat(np.arange(total), chars), _CLASS[piece.data], chars),
             shares(of_word, _CLASS[piece.data[piece.starts]], in_passage),
             shares(of_word, _CLASS[piece.data[piece.ends - 1]], in_passage),
             np.stack([mean(_repeated(hashes, of_word)), mean(runs), mean(same),
                       np.minimum(mean(piece.ends - piece.starts), 50) / 10,
                       np.log1p(np.minimum(in_passage, WORDS)) / 5, in_passage == 0], axis=1)]
    return np.concatenate(parts, axis=1).astype(np.float32), first


@dataclass
class AttentionModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, passages: np.ndarray, first: np.ndarray) -> np.ndarray:
        x = np.clip((passages - self.mean) / self.scale, -6, 6)
        return _sigmoid(_forward(self.weights, x, first)["logit"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Every bag has a passage, so the starts in ``first`` are increasing."""
    start, sizes = first[:-1], np.diff(first)
    code = np.tanh(x @ w["code"] + w["code0"])
    view, gate = np.tanh(code @ w["view"]), _sigmoid(code @ w["gate"])
    energy = (view * gate) @ w["attend"]
    energy = np.exp(energy - np.repeat(np.maximum.reduceat(energy, start), sizes))
    attention = energy / np.repeat(np.add.reduceat(energy, start), sizes)
    pooled = np.add.reduceat(attention[:, None] * code, start)
    return {"code": code, "view": view, "gate": gate, "attention": attention, "pooled": pooled,
            "logit": pooled @ w["out"] + w["out0"]}


def _gradient(w, x, first, label) -> dict[str, np.ndarray]:
    start, sizes = first[:-1], np.diff(first)
    f = _forward(w, x, first)
    error = (_sigmoid(f["logit"]) - label) / len(label)
    pooled = np.repeat(error[:, None] * w["out"], sizes, axis=0)
    through = (f["code"] * pooled).sum(axis=1)
    expected = np.repeat(np.add.reduceat(f["attention"] * through, start), sizes)
    energy = f["attention"] * (through - expected)
    gated = energy[:, None] * w["attend"]
    view = gated * f["gate"] * (1 - f["view"] ** 2)
    gate = gated * f["view"] * f["gate"] * (1 - f["gate"])
    code = (f["attention"][:, None] * pooled + view @ w["view"].T + gate @ w["gate"].T) * (1 - f["code"] ** 2)
    return {"code": x.T @ code, "code0": code.sum(axis=0), "view": f["code"].T @ view, "gate": f["code"].T @ gate,
            "attend": (f["view"] * f["gate"]).T @ energy, "out": f["pooled"].T @ error, "out0": error.sum()}


def fit_attention(passages: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = 300, rate: float = 0.02,
                  decay: float = 1e-4, width: int = 16, attention: int = 8, seed: int = 7) -> AttentionModel:
    """Minimise the log loss of the bags with Adam."""
    mean, scale = passages.mean(axis=0), passages.std(axis=0) + 1e-3
    x = np.clip((passages - mean) / scale, -6, 6)
    draw = np.random.default_rng(seed)
    shapes = {"code": (x.shape[1], width), "code0": (width,), "view": (width, attention), "gate": (width, attention),
              "attend": (attention,), "out": (width,), "out0": ()}
    w = {k: draw.normal(0, 1 / np.sqrt(s[0]), s) if k[-1] != "0" else np.zeros(s) for k, s in shapes.items()}
    slow, fast = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    for step in range(1, steps + 1):
        for k, g in _gradient(w, x, first, label).items():
            g = g + decay * w[k]
            slow[k] = 0.9 * slow[k] + 0.1 * g
            fast[k] = 0.999 * fast[k] + 0.001 * g * g
            w[k] = w[k] - rate * (slow[k] / (1 - 0.9 ** step)) / (np.sqrt(fast[k] / (1 - 0.999 ** step)) + 1e-8)
    return AttentionModel(mean, scale, w)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) -> (label, bag)."""
    for batch in batches:
        for piece in pieces(batch.column(1), lower=False):
            features, first = encode_passages(piece)
            bags = [features[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[piece.first:piece.first + piece.rows], pa.array(bags, pa.binary())], ["label", "bag"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample: int = SAMPLE) -> AttentionModel:
    """Fit on at most ``sample`` labelled documents.

    Labels other than 0 and 1, null ids and ids with both labels are left out.
    Without any usable label every score is 0.5.
    """
    chosen = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
              .where("id is not null and label in (0, 1)").groupBy("id")
              .agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
              .select("id", "label").orderBy(F.xxhash64("id"), "id").limit(sample))
    # At most ``sample`` rows of two numbers.
    rows = (docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "id")
            .select("label", "text").mapInArrow(_bags, "label int, bag binary").toPandas())
    if not len(rows):
        zero = {k: np.zeros(s) for k, s in {"code": (FEATURES, 1), "code0": (1,), "view": (1, 1), "gate": (1, 1),
                                            "attend": (1,), "out": (1,), "out0": ()}.items()}
        return AttentionModel(np.zeros(FEATURES), np.ones(FEATURES), zero)
    rows = rows.sort_values(["label", "bag"], ignore_index=True)  # the order of tasks must not matter
    bags = [np.frombuffer(b, dtype=np.float32).reshape(-1, FEATURES) for b in rows.bag]
    first = np.concatenate(([0], np.cumsum([len(b) for b in bags])))
    return fit_attention(np.concatenate(bags).astype(np.float64), first, rows.label.to_numpy(np.float64))


def _scores(model: AttentionModel, texts: pa.Array) -> np.ndarray:
    found = [model.score(*encode_passages(p)) for p in pieces(texts, lower=False)]
    return np.concatenate(found) if found else np.zeros(0)


def score(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row, null and empty texts (one empty passage) included.

    Only the text is read; null ids and repeated rows are kept as they are.
    """
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_scores(model, batch.column(1)))], [id_col, "score"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_of(text_col).alias("text" if id_col != "text" else "text_")).mapInArrow(
        run, f"`{id_col}` {kind}, score double")


def keep_good(docs: DataFrame, model: AttentionModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    extra, = unused(docs, "_scored_text")

    def run(batches):
        for batch in batches:
            keep = _scores(model, batch.column(batch.num_columns - 1)) >= threshold
            yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array(keep))
    return docs.withColumn(extra, text_of(text_col)).mapInArrow(run, docs.schema)
