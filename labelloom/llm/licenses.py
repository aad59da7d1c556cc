"""License scan: a trained paragraph classifier with template comparison.

Paragraphs (lines of a text) get hashed word unigrams and bigrams; a
multinomial logistic regression names a license family or "unknown".  It is
fitted on variants of the templates below and on at most ``SAMPLE`` paragraphs
of the corpus; its temperature and the least probability of a family are
calibrated on a held-out part of them.  A prediction counts only if the
paragraph holds enough of a template of that family.

A notice may be wrapped over adjacent lines that are not blank.  Such blocks
are compared with the templates first, and in those that hold enough of one
the least windows of lines that do are classified, too.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import text_of
from labelloom.llm.words import Piece, mix, pieces

# Usual notices of the license families.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met:", "Released under the BSD License.",
            "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 "
              "International License.", "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons "
                 "Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "CC0": ["Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived "
            "all copyright and related or neighboring rights to this work."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation",
            "SPDX-License-Identifier: GPL-3.0-or-later"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining "
            "a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
OTHERS = ["All rights reserved.", "Copyright by the authors, all rights reserved.", "Used with permission.",
          "This software is proprietary and confidential.", "Licensed under the terms of the agreement between both parties.",
          "A driving license is needed to rent a car.", "The license was granted by the city in May.",
          "See the LICENSE file for details.", "Version 2.0 of the report was released to the public in general."]
FAMILIES = [*TEMPLATES, "unknown"]
UNKNOWN = len(FAMILIES) - 1
PIECE = 4_000   # characters of a sampled paragraph at most: a longer one is several
SAMPLE = 2_000
FEATURES = 1 << 14
SHARE = 0.6           # of a template's words and bigrams that confirm it
FALSE_FAMILIES = 0.002  # of held-out unknown paragraphs may pass the calibrated probability


def paragraphs_of(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row and line number of each paragraph with words, paragraph of each word)."""
    breaks = np.concatenate(([0], np.cumsum(piece.data == 10)))
    line = breaks[piece.starts] - breaks[piece.offsets[:-1]][piece.row]
    new = np.ones(len(line), dtype=bool)
    new[1:] = (line[1:] != line[:-1]) | (piece.row[1:] != piece.row[:-1])
    return piece.row[new], line[new], np.cumsum(new) - 1


def hashed_words(piece: Piece, paragraph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and of all bigrams within a paragraph, and their paragraphs."""
    words = piece.word_hashes()
    pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    inside = paragraph[1:] == paragraph[:-1]
    hashes = np.concatenate((words, pairs[inside]))
    where = np.concatenate((paragraph, paragraph[1:][inside]))
    order = np.argsort(where, kind="stable")
    return hashes[order], where[order]


def _described(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``hashed_words`` of texts that are one paragraph each."""
    hashes, where, done = [], [], 0
    for piece in pieces(pa.array([t.replace("\n", " ") for t in texts], pa.string())):
        h, w = hashed_words(piece, piece.row)
        hashes.append(h)
        where.append(w + done)
        done += piece.rows
    return np.concatenate(hashes), np.concatenate(where)


@dataclass
class LicenseModel:
    weights: np.ndarray       # features + 1 (bias), families
    temperature: float
    least: float              # probability of a family
    templates: list[list[np.ndarray]]

    def logits(self, hashes: np.ndarray, where: np.ndarray, count: int) -> np.ndarray:
        sums = np.zeros((count, len(FAMILIES)), dtype=np.float32)
        if len(hashes):
            starts = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
            found = np.add.reduceat(self.weights[(hashes & np.uint64(FEATURES - 1)).astype(np.int64)], starts)
            sums[where[starts]] = found / np.sqrt(np.diff(np.concatenate((starts, [len(where)]))))[:, None]
        return sums + self.weights[-1]

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        x = logits / self.temperature
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def part(self, hashes: np.ndarray) -> bool:
        """Whether a line of three words at least is mostly made of a template's."""
        return len(hashes) >= 5 and any(np.isin(hashes, t).mean() >= SHARE for k in self.templates for t in k)

    def confirmed(self, family: int, hashes: np.ndarray) -> bool:
        return any(np.isin(t, hashes).mean() >= SHARE for t in self.templates[family])


def _variants(words: list[str], filler: list[str], draw: random.Random) -> Iterator[str]:
    """A template with words lost, with other words around it, and parts of it."""
    yield " ".join(words)
    for _ in range(30):
        kept = [w for w in words if draw.random() > 0.12] or words
        if len(kept) > 12 and draw.random() < 0.3:
            start = draw.randrange(len(kept) - 10)
            kept = kept[start:start + draw.randrange(10, len(kept) + 1)]
        before, after = ([draw.choice(filler) for _ in range(draw.choice((0, 0, 1, 4, 12)))] for _ in range(2))
        yield " ".join(before + kept + after)


def _fit(hashes, where, label, steps: int = 200, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Multinomial logistic regression over sparse rows, by gradient steps scaled for each weight."""
    column = (hashes & np.uint64(FEATURES - 1)).astype(np.int64)
    value = 1 / np.sqrt(np.bincount(where, minlength=len(label)))[where]
    starts = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    weights, total = np.zeros((FEATURES + 1, len(FAMILIES))), np.full((FEATURES + 1, len(FAMILIES)), 1e-6)
    goal = np.eye(len(FAMILIES))[label]
    for _ in range(steps):
        logits = np.add.reduceat(weights[column] * value[:, None], starts) + weights[-1]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - goal) / len(label)
        gradient = np.stack([np.bincount(column, weights=error[where, k] * value, minlength=FEATURES + 1)
                             for k in range(len(FAMILIES))], axis=1) + decay * weights
        gradient[-1] = error.sum(axis=0)
        total += gradient ** 2
        weights -= rate * gradient / np.sqrt(total)
    return weights.astype(np.float32)


def sampled_paragraphs(docs: DataFrame, text_col: str, sample: int) -> list[str]:
    """The ``sample`` different pieces of lines with the least hashes.

    The number of different pieces is estimated first; only pieces whose hash
    lies below the bound that it gives, half as many again as are wanted, are
    made distinct and sorted.
    """
    lines = docs.select(F.explode_outer(F.split(text_of(text_col), "\n")).alias("line")).where(F.trim("line") != "")
    at = F.sequence(F.lit(0), F.floor((F.length("line") - 1) / PIECE).cast("int"))
    pieces = lines.select("line", F.explode(at).alias("at")).select(
        F.substring("line", F.col("at") * PIECE + 1, F.lit(PIECE)).alias("line")).select(F.xxhash64("line").alias("hash"), "line")
    different = pieces.agg(F.approx_count_distinct("hash")).first()[0]
    share = 1.5 * sample / max(1, different)
    if share < 0.5:
        pieces = pieces.where(F.col("hash") < F.lit(int(share * 2 ** 64) - (1 << 63)))
    return [r.line for r in pieces.groupBy("hash").agg(F.min("line").alias("line")).orderBy("hash").limit(sample).collect()]


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, seed: int = 3) -> LicenseModel:
    """Fit on the templates' variants and ``sample`` paragraphs of the corpus.

    The paragraphs are those with the least hashes, where a paragraph longer
    than ``PIECE`` characters counts as several; ones that confirm a template or
    are a wrapped part of one are left out.  An empty corpus leaves the fixed
    other paragraphs.
    """
    chosen = sampled_paragraphs(docs, text_col, sample)
    templates = []
    for family in FAMILIES[:-1]:
        hashes, where = _described(TEMPLATES[family])
        templates.append([np.unique(hashes[where == i]) for i in range(len(TEMPLATES[family]))])
    model = LicenseModel(np.zeros((FEATURES + 1, len(FAMILIES)), np.float32), 1.0, 0.5, templates)
    hashes, where = _described(chosen + OTHERS)
    bounds = np.searchsorted(where, np.arange(len(chosen) + len(OTHERS) + 1))
    plain = [t for i, t in enumerate(chosen + OTHERS) if not any(
        model.confirmed(f, hashes[bounds[i]:bounds[i + 1]]) for f in range(UNKNOWN))
        and not (i < len(chosen) and model.part(hashes[bounds[i]:bounds[i + 1]]))]
    draw = random.Random(seed)
    filler = " ".join(plain).split() or ["text"]
    rows = [(t, UNKNOWN) for t in plain]
    rows += [(" ".join(w for w in t.split() if draw.random() > 0.1) or t, UNKNOWN) for t in OTHERS for _ in range(30)]
    rows += [(v, k) for k, family in enumerate(FAMILIES[:-1]) for t in TEMPLATES[family]
             for v in _variants(t.split(), filler, draw)]
    draw.shuffle(rows)
    cut = len(rows) * 7 // 10
    label = np.array([k for _, k in rows])
    model.weights = _fit(*_described([t for t, _ in rows[:cut]]), label[:cut])
    logits = model.logits(*_described([t for t, _ in rows[cut:]]), len(rows) - cut)
    losses = {}
    for temperature in np.geomspace(0.25, 4, 17):
        model.temperature = float(temperature)
        p = model.probabilities(logits)[np.arange(len(logits)), label[cut:]]
        losses[model.temperature] = -np.log(np.maximum(p, 1e-12)).mean()
    model.temperature = min(losses, key=losses.get)
    others = model.probabilities(logits)[label[cut:] == UNKNOWN][:, :UNKNOWN].max(axis=1, initial=0)
    model.least = float(max(0.5, np.quantile(others, 1 - FALSE_FAMILIES) if len(others) else 0.5))
    return model


def _blocks_with_notice(model: LicenseModel, words: np.ndarray, pairs: np.ndarray, block: np.ndarray) -> dict[int, list]:
    """Blocks that hold enough of a template: block -> (family, template)."""
    known = np.unique(np.concatenate([t for k in model.templates for t in k]))
    inside = block[1:] == block[:-1]
    hashes, where = np.concatenate((words, pairs[inside])), np.concatenate((block, block[1:][inside]))
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = known[at] == hashes
    hits = np.unique(where[hit] * len(known) + at[hit])
    out: dict[int, list] = {}
    for family, templates in enumerate(model.templates):
        for template in templates:
            mine = hits[np.isin(known, template)[hits % len(known)]] // len(known)
            blocks, held = np.unique(mine, return_counts=True)
            for b in blocks[held / len(template) >= SHARE].tolist():
                out.setdefault(b, []).append((family, template))
    return out


def _least_windows(lines: list[np.ndarray], joins: list[np.ndarray], template: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) of the least runs of lines that hold enough of a template.

    ``lines`` are the template's places that each line holds, ``joins`` those
    of the bigram between a line and the next.
    """
    held, last = np.zeros(len(template), dtype=np.int64), -1
    for first in range(len(lines)):
        while (held > 0).mean() < SHARE and last + 1 < len(lines):
            last += 1
            held[lines[last]] += 1
            if last > first:
                held[joins[last - 1]] += 1
        if (held > 0).mean() < SHARE:
            return
        n = held.copy()
        n[lines[first]] -= 1
        if last > first:
            n[joins[first]] -= 1
        if (n > 0).mean() < SHARE:
            yield first, last
        held = n


def _wrapped(model: LicenseModel, words: np.ndarray, pairs: np.ndarray, bounds: np.ndarray, notices: list,
             sure: set[tuple[int, int]]) -> Iterator[tuple[int, int, float]]:
    """(line of the block, family, probability) of the notices wrapped over lines of a block.

    ``bounds`` are the numbers of each line's first word and the block's end;
    ``sure`` are the (line, family) that are confirmed alone.
    """
    def hashes_of(first: int, last: int) -> np.ndarray:
        a, b = bounds[first], bounds[last + 1]
        return np.concatenate((words[a:b], pairs[a:b - 1]))

    taken = {family: {line for line, f in sure if f == family} for family, _ in notices}
    for family, template in notices:
        def places(hashes: np.ndarray) -> np.ndarray:
            return np.flatnonzero(np.isin(template, hashes))
        count = len(bounds) - 1
        lines = [places(hashes_of(i, i)) for i in range(count)]
        joins = [places(pairs[bounds[i + 1] - 1:bounds[i + 1]]) for i in range(count - 1)]
        for first, last in _least_windows(lines, joins, template):
            # The rest of the notice: lines that hold more of it.
            a, b, held = first, last, len(places(hashes_of(first, last)))
            while b + 1 < count and len(places(hashes_of(a, b + 1))) > held:
                b += 1
                held = len(places(hashes_of(a, b)))
            while a > 0 and len(places(hashes_of(a - 1, b))) > held:
                a -= 1
                held = len(places(hashes_of(a, b)))
            if first == last or not taken[family].isdisjoint(range(first, last + 1)):
                continue
            best = 0.0
            for x, y in {(first, last), (a, b)}:
                own = hashes_of(x, y)
                p = model.probabilities(model.logits(own, np.zeros(len(own), np.int64), 1))[0]
                if p[:UNKNOWN].argmax() == family and p[family] >= model.least:
                    best = max(best, float(p[family]))
            if best:
                taken[family].update(range(first, last + 1))
                yield first, family, best


def _scan(model: LicenseModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                row, line, paragraph = paragraphs_of(piece)
                hashes, where = hashed_words(piece, paragraph)
                found: list[list[dict]] = [[] for _ in range(piece.rows)]
                if len(row):
                    p = model.probabilities(model.logits(hashes, where, len(row)))
                    best = p[:, :UNKNOWN].argmax(axis=1)
                    bounds = np.searchsorted(where, np.arange(len(row) + 1))
                    sure: dict[int, set] = {}
                    for i in np.flatnonzero(p[np.arange(len(row)), best] >= model.least).tolist():
                        own = hashes[bounds[i]:bounds[i + 1]]
                        found[row[i]].append({"line_no": int(line[i]), "family": FAMILIES[best[i]],
                                              "probability": float(p[i, best[i]]),
                                              "confirmed": model.confirmed(int(best[i]), own)})
                        if found[row[i]][-1]["confirmed"]:
                            sure.setdefault(i, set()).add(int(best[i]))
                    # Blocks of adjacent lines, and the first line of each.
                    new = np.ones(len(row), dtype=bool)
                    new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1] + 1)
                    block, edges = np.cumsum(new) - 1, np.append(np.flatnonzero(new), len(row))
                    words = piece.word_hashes()
                    pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
                    starts = np.searchsorted(paragraph, np.arange(len(row) + 1))
                    for b, notices in _blocks_with_notice(model, words, pairs, block[paragraph]).items():
                        x, y = int(edges[b]), int(edges[b + 1])
                        if y - x > 1:
                            alone = {(i - x, f) for i in range(x, y) for f in sure.get(i, ())}
                            for i, family, probability in _wrapped(model, words, pairs, starts[x:y + 1], notices, alone):
                                found[row[x]].append({"line_no": int(line[x + i]), "family": FAMILIES[family],
                                                      "probability": probability, "confirmed": True})
                count = np.bincount(row, minlength=piece.rows).astype(np.int64)
                kind = pa.list_(pa.struct([("line_no", pa.int64()), ("family", pa.string()),
                                           ("probability", pa.float64()), ("confirmed", pa.bool_())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[piece.first:piece.first + piece.rows], pa.array(count), pa.array(found, kind)],
                    ["id", "n_paragraphs", "found"])
    return run


def scan(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, found) for every row.

    ``found`` lists the paragraphs that the classifier gives to a family, with
    line number, probability and whether a template confirms it, and then the
    confirmed notices that are wrapped over lines, by their first line.  Null and
    empty texts have no paragraph; null ids and repeated rows are kept as they
    are; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(
        _scan(model), f"id {kind}, n_paragraphs long, found array<struct<line_no: long, family: string, "
                      "probability: double, confirmed: boolean>>").withColumnRenamed("id", "doc_id")
