"""The operators on small tables with nulls, empty texts, repeated rows and clashing names."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelloom.llm import (bloom_lm, chat, components, decontaminate, exact_dedup, fuzzy_lines, jaccard_join, licenses,
                           mil_quality, raking, warc, words)
from labelloom.llm.common import id_crc

# Column names that the operators use inside, too.
DOCS = "doc_id long, text string, lang string, source string, digest string, key int, sid long, tokens int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "x", 1, 2, 3) for i, t in rows], DOCS)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def word_list(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingle_set(text, size=5):
    w = word_list(text)
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def grouped(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (None, "a b c d e f g"), (None, "a b c d e f g"),
         (7, "x y z x y z x y z x y z"), (7, "x y z x y z x y z x y z"), (8, "été élan " * 9), (9, "A B C D E F G")]


@pytest.fixture(scope="module")
def corpus():
    """A cluster of near copies, a passage that many share, copies, and the edge cases."""
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = list(EDGES), [draw.choice(vocabulary) for _ in range(60)]
    passage = [draw.choice(vocabulary) for _ in range(30)]
    for i in range(120):
        copy = list(base)
        for _ in range(draw.randrange(4)):
            copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
        rows.append((100 + i, " ".join(copy)))
    for i in range(80):
        own = [draw.choice(vocabulary) for _ in range(draw.choice((8, 40, 200)))]
        rows.append((300 + i, " ".join(own + passage)))
    rows += [(500 + i, rows[20 + i % 5][1]) for i in range(20)]
    return rows


def test_words_match_the_regular_expression():
    texts = [t for _, t in EDGES] + ["\x0bA\x1fB  ", "längere Wörter hier", "z" * 3000]
    for size in (10, 1 << 20):
        words.PIECE = size
        found = [p for p in words.pieces(pa.array(texts))]
        assert sum(p.rows for p in found) == len(texts)
        got = [bytes(p.data[s:e]).decode() for p in found for s, e in zip(p.starts, p.ends)]
        assert got == [w for t in texts for w in word_list(t)]
        sets = [len(s) for p in found for s in words.shingle_sets(p)]
        assert sets == [len(shingle_set(t)) for t in texts]
    hashes = np.concatenate([p.word_hashes() for p in words.pieces(pa.array(["a b a"]))])
    assert hashes[0] == hashes[2] != hashes[1]


def test_components(spark):
    draw = random.Random(1)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)] + [(500, 500 + i) for i in range(50)]
    root = grouped(600, links)
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {n: root[n] for a, b in links for n in (a, b) if a != b}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 ---------------------------------------------------------------------------------------------

def best_run(item, doc, diagonal):
    best = run = 0
    for q, w in enumerate(item):
        if 0 <= q + diagonal < len(doc):
            run = max(run, 0) + (1 if doc[q + diagonal] == w else -1)
            best = max(best, run)
    return best


def test_spaced_seeds(spark):
    draw = random.Random(2)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, [draw.choice(vocabulary) for _ in range(20)]) for i in range(6)] + [(90, ["too", "short"])]
    docs = [(1, None), (2, ""), (None, "Nothing here."), (3, "too short"), (3, "too short")]
    for i in range(40):
        text = [draw.choice(vocabulary) for _ in range(30)]
        if i % 2:
            leak = list(items[i % 6][1])
            for p in range(i % 7, 20, 4 + i % 4):
                leak[p] = "other"
            text[7:7] = leak[:20 - i % 5]
        docs.append((100 + i, " , ".join(text).upper()))
    bench = spark.createDataFrame([(i, " ".join(w), 1) for i, w in items] * 2 + [(None, None, 1)],
                                  "item_id long, text string, key int")
    expected = []
    for i, text in docs:
        doc = re.findall(r"[^\W_]+", (text or "").lower())
        scores = {}
        for n, item in items:
            for d in range(-len(item), len(doc)):
                same = [0 <= q + d < len(doc) and doc[q + d] == w for q, w in enumerate(item)]
                hit = any(all(same[q + j] for j, b in enumerate(m) if b == "1")
                          for m in decontaminate.MASKS for q in range(len(item) - len(m) + 1))
                score = best_run(item, doc, d)
                if hit and score >= min(10, math.ceil(0.8 * len(item))):
                    scores[n] = max(score, scores.get(n, 0))
        expected.append((i, bool(scores), len(scores), ",".join(map(str, sorted(scores))), max(scores.values(), default=0)))
    frame = table(spark, docs)
    assert sum(e[1] for e in expected) >= 15
    assert rows_of(decontaminate.report(frame, bench)) == sorted(expected, key=repr)
    assert rows_of(decontaminate.report(frame, bench, block=40)) == sorted(expected, key=repr)  # several passes
    clean = decontaminate.keep_clean(frame, bench)
    assert clean.columns == frame.columns and clean.count() == sum(not e[1] for e in expected)
    assert decontaminate.report(frame.limit(0), bench).count() == 0
    assert not decontaminate.report(frame, bench.limit(0)).where("contaminated").count()


# 2 ---------------------------------------------------------------------------------------------

def test_warc_round_trip(spark, tmp_path):
    long = "".join(f"<p>{i} é\r\n\r\nWARC/1.1\r\n\r\n</p>" for i in range(300)) + "\r\n"
    pages = [(1, "http://a/ b\r\n", long), (2, None, long), (3, "u", None), (4, "u", ""), (5, "u", "\r\n"),
             (5, "u", "\r\n"), (6, "u", "é" * 1000), (None, "u", "é" * 1000), (None, "u", "alone"), (None, "v", "alone")]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string")
    path = str(tmp_path / "archive")
    warc.write_archive(frame, path, chunk=64)
    chunks = warc.read_archive(spark, path).collect()
    first = {}
    for page, _, html in pages:
        payload = (html or "").encode()
        first[payload] = min((p for p in (first.get(payload), page) if p is not None), default=None)
    expected = []
    for page, _, html in pages:
        payload = (html or "").encode()
        refers = first[payload] if first[payload] is not None and first[payload] != page else None
        expected.append((None if page is None else str(page), "response" if refers is None else "revisit",
                         None if refers is None else str(refers), len(payload),
                         base64.b32encode(hashlib.sha1(payload).digest()).decode()))
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in chunks if r.last]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    text = b"".join(r.bytes for r in sorted((r for r in chunks if r.page_id == "1"), key=lambda r: r.chunk))
    assert text == long.encode()
    # Below the least size nothing is a revisit.
    warc.write_archive(frame, path + "2", min_bytes=10_000_000)
    assert not warc.read_archive(spark, path + "2").where("record_type = 'revisit'").count()
    warc.write_archive(frame.limit(0), path + "3")
    assert warc.read_archive(spark, path + "3").count() == 0


# 3 ---------------------------------------------------------------------------------------------

def test_bloom_filter_lm(spark, corpus, monkeypatch):
    monkeypatch.setattr(bloom_lm, "HEAD", 20)  # so that most counts go through the join
    frame = table(spark, corpus)
    got = bloom_lm.score(frame, id_crc("doc_id") % 7 == 2).collect()
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in corpus]
    counts = Counter(w for (_, t), h in zip(corpus, held) if not h for w in [*word_list(t), None])
    total, kinds = sum(counts.values()), len(counts)
    expected = []
    for (i, t), h in zip(corpus, held):
        w = [*word_list(t), None]
        base = sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w)
        expected.append((i, h, len(w), sum(counts[x] > 0 for x in w), total, round(base, 6)))
    assert sorted(((*r[:5], round(r[5], 6)) for r in got), key=repr) == sorted(expected, key=repr)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    seen = {r.doc_id: r.score / r.n_tokens for r in got if r.doc_id}
    copies, alone = [seen[100 + i] for i in range(120)], [seen[i] for i in (4, 8)]
    assert sum(copies) / 120 > sum(alone) / 2  # repeated texts are likelier
    small = bloom_lm.score(frame, F.lit(False), filter_bytes=100).collect()
    assert {r.train_tokens for r in small} == {sum(len(word_list(t)) + 1 for _, t in corpus)}
    assert bloom_lm.score(frame.limit(0), F.lit(False)).count() == 0
    assert {r.n_known for r in bloom_lm.score(frame, F.lit(True)).collect()} == {0}


@pytest.mark.parametrize("head", [0, 2, 100])
def test_probabilities_of_a_context_sum_to_one_at_most(spark, monkeypatch, head):
    monkeypatch.setattr(bloom_lm, "HEAD", head)
    draw = random.Random(2)
    texts = [" ".join(draw.choices("abcd", [9, 5, 2, 1], k=draw.randrange(1, 9))) for _ in range(77)]
    model = bloom_lm.train(spark.createDataFrame([(t,) for t in texts], "text string"))[0]
    outcomes = bloom_lm.tokens_of(next(words.pieces(pa.array(["a b c d"]))))[0]
    for context in (None, *outcomes[:-1]):
        given = [w for w in ([] if context is None else [context])]
        total = 0.0
        for outcome in outcomes:
            tokens = np.array([*given, outcome], dtype=np.uint64)
            total += 10 ** model.log_probability(tokens, np.array([0, len(tokens)]))[-1]
        assert 0.4 < total <= 1 + 1e-9


def test_bigram_scores_do_not_depend_on_the_broadcast_bound(spark, corpus, monkeypatch):
    monkeypatch.setattr(bloom_lm, "SEGMENT", 300)
    monkeypatch.setattr(bloom_lm, "BLOCK_BITS", 2)  # so that there are several blocks
    once = [(900, "q r s t"), (901, "q r s t"), (902, "q s r t")]
    frame = table(spark, corpus + once)
    held = F.coalesce(F.col("doc_id") > 900, F.lit(False))
    whole, blocks = (rows_of(bloom_lm.score(frame, held, filter_bytes=b)) for b in (1 << 20, 100))
    assert len(whole) == len(corpus) + 3 and whole == blocks
    seen = {r[0]: r[6] for r in whole}
    assert seen[901] > seen[902] + 1  # the words are the same, the bigrams were seen once
    assert bloom_lm.score(frame.limit(0), held, filter_bytes=0).count() == 0
    assert bloom_lm.score(frame, F.lit(True), filter_bytes=0).count() == len(corpus) + 3


def test_filter_levels_never_fall_short():
    draw = np.random.default_rng(0)
    hashes, counts = draw.integers(0, 1 << 63, 5000).astype(np.uint64), draw.integers(1, 5000, 5000)
    frame = bloom_lm._fill(1)(iter([__import__("pandas").DataFrame(
        {"kind": [1], "segment": [0], "hashes": [hashes.tobytes()], "counts": [counts.tobytes()]})]))
    built = bloom_lm._assemble(0, next(frame))
    levels, true = built.levels(1, hashes), bloom_lm.level_of(counts)
    assert (levels >= true).all() and (levels == true).mean() > 0.97
    assert (built.levels(1, draw.integers(0, 1 << 63, 5000).astype(np.uint64)) > 0).mean() < 0.03


# 4 ---------------------------------------------------------------------------------------------

def test_minimal_perfect_hash():
    digests = np.frombuffer(b"".join(hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(5000)),
                            np.uint8).reshape(-1, 32)
    levels, slots = exact_dedup.build_levels(digests)
    assert sorted(slots) == list(range(5000))
    assert (exact_dedup.find_slots(levels, digests) == slots).all()


def test_exact_dedup(spark, corpus, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD", 40)
    frame = table(spark, corpus)
    groups = defaultdict(list)
    for i, t in corpus:
        groups[t or ""].append(i)
    expected = []
    for i, t in corpus:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids, default=None)
        expected.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    for past in (F.lit(True), F.lit(None).cast("boolean"), id_crc("doc_id") % 2 == 0):
        assert rows_of(exact_dedup.deduplicate(frame, past)) == sorted(expected, key=repr)
    kept = exact_dedup.keep_winners(frame, id_crc("doc_id") % 2 == 0)
    assert kept.columns == frame.columns and kept.count() == sum(e[3] for e in expected)
    assert exact_dedup.deduplicate(frame.limit(0), F.lit(True)).count() == 0


# 5 ---------------------------------------------------------------------------------------------

def test_raking_equals_brute_force(spark):
    draw = np.random.default_rng(3)
    tokens = draw.integers(0, 50, (3, 2, 4))
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", int(tokens[i, j, k])) for i in range(3) for j in range(2)
                                   for k in range(4)], "source string, lang string, topic string, tokens long")
    share = draw.random(3) + 0.2
    targets = {"source": spark.createDataFrame([(f"s{i}", float(x)) for i, x in enumerate(share)] + [("none", 9.0)],
                                               "category string, target double")}
    targets |= {d: raking._marginals(cells, d, "tokens").selectExpr("category", "1D as target") for d in ("lang", "topic")}
    weights = tokens / tokens.sum()
    for _ in range(200):
        for axis, goal in ((0, share / share.sum()), (1, np.full(2, 0.5)), (2, np.full(4, 0.25))):
            other = tuple(a for a in range(3) if a != axis)
            shape = [1, 1, 1]
            shape[axis] = -1
            weights = weights * (goal / weights.sum(axis=other)).reshape(shape)
    raked = raking.rake(cells, targets)
    for r in raked.collect():
        assert r.weight == pytest.approx(tokens.sum() * weights[int(r.source[1]), int(r.lang[1]), int(r.topic[1])], abs=1e-2)
    for budget in (20.0, 0.6 * tokens.sum(), 10.0 * tokens.sum()):
        drawn = raking.calibrated(raked, budget).collect()
        expected = sum(r.tokens * r.probability for r in drawn)
        assert all(0 <= r.probability <= 1 for r in drawn)
        assert expected == pytest.approx(min(budget, sum(r.tokens for r in drawn if r.weight > 0)), rel=1e-6)


def test_mixture_sampling(spark, corpus):
    frame = table(spark, corpus)
    targets = {"source": raking.tempered(1.0), "lang": raking.tempered(0.0), "topic": raking.tempered(0.5)}
    drawn = raking.sample_mixture(raking.described(frame), targets, 0.5)
    assert drawn.count() == len(corpus)
    kept = raking.keep_mixture(frame, targets, 0.5)
    assert kept.columns == [*frame.columns, "sampling_probability"]
    assert kept.count() == drawn.where("sampled").count() > 0
    assert raking.keep_mixture(frame, targets, 10.0).count() >= len(corpus) - 3  # texts without words may go
    assert raking.keep_mixture(frame.limit(0), targets, 0.5).count() == 0
    clash = raking.described(frame).withColumn("probability", F.lit(7.0)).withColumn("Sampled", F.lit("x"))
    both = raking.sample_mixture(clash, targets, 0.5)
    assert {(r[5], r[6]) for r in both.collect()} == {(7.0, "x")}
    assert both.where(F.col(both.columns[-1])).count() == drawn.where("sampled").count()


# 6 ---------------------------------------------------------------------------------------------

def test_license_sample_takes_pieces_of_whole_lines(spark):
    long = "".join(chr(97 + i // 4000) for i in range(10_000))
    frame = spark.createDataFrame([(t,) for t in (long, long, "short\n\n  \nother", None, "")], "text string")
    pieces = licenses.sampled_paragraphs(frame, "text", 100)
    assert sorted(pieces) == ["a" * 4000, "b" * 4000, "c" * 2000, "other", "short"]
    many = spark.range(20_000).select(F.concat(F.lit("line "), "id").alias("text"))
    least = many.select("text").orderBy(F.xxhash64("text")).limit(50)
    assert licenses.sampled_paragraphs(many, "text", 50) == [r.text for r in least.collect()]
    assert licenses.sampled_paragraphs(frame.limit(0), "text", 100) == []


def test_license_scan(spark):
    texts = ["", None, "Plain words.\n\nMore plain words here.", "Intro\nReleased under the MIT License.\nend",
             "x\nLicensed under the Apache License, Version 2.0.", "The license was granted by the city in May."]
    texts += [f"some other paragraph number {i} about the public version of things" for i in range(50)]
    frame = table(spark, [(i if i else None, t) for i, t in enumerate(texts)] + [(3, texts[3])])
    model = licenses.fit(frame)
    got = [(r.doc_id, r.n_paragraphs, [(f.line_no, f.family) for f in r.found if f.confirmed])
           for r in licenses.scan(frame, model).collect()]
    assert len(got) == len(texts) + 1
    assert sorted((g for g in got if g[2]), key=repr) == [(3, 3, [(1, "MIT")]), (3, 3, [(1, "MIT")]), (4, 2, [(1, "Apache-2.0")])]
    assert [g[1] for g in got[:3]] == [0, 0, 2]
    assert licenses.scan(frame.limit(0), licenses.fit(frame.limit(0))).count() == 0
    for family, notices in licenses.TEMPLATES.items():
        found = licenses.scan(table(spark, [(1, n) for n in notices]), model).collect()
        assert all(f.family == family and f.confirmed for r in found for f in r.found) and all(r.found for r in found)


def test_wrapped_licenses(spark):
    bsd = ("Redistribution and use in source and binary forms, with or without\n"
           "modification, are permitted provided that the following conditions\nare met:")
    gpl = ("This program is free software: you can redistribute it and/or modify\n"
           "it under the terms of the GNU General Public License as published by\n"
           "the Free Software Foundation, either version 3 of the License, or")
    apache = ('# Licensed under the Apache License, Version 2.0 (the "License");\n'
              "# you may not use this file except in compliance with the License.")
    plain = [f"some other paragraph number {i}\nabout the public version of things\nand the terms" for i in range(50)]
    texts = [bsd, gpl, apache, "import os\n\n" + bsd + "\n\nend", "import os\nimport re\n" + gpl + "\n" + "import sys\n" * 30,
             "Released under\nthe MIT\nLicense.", "Released\n\nunder\n\nthe MIT\n\nLicense."]
    frame = table(spark, list(enumerate(texts + plain)))
    got = {r.doc_id: [(f.line_no, f.family) for f in r.found if f.confirmed]
           for r in licenses.scan(frame, licenses.fit(frame)).collect()}
    assert {i: sorted({f for _, f in g}) for i, g in got.items() if g} == {
        0: ["BSD"], 1: ["GPL"], 2: ["Apache-2.0"], 3: ["BSD"], 4: ["GPL"], 5: ["MIT"]}
    assert (got[3], got[5]) == ([(2, "BSD")], [(0, "MIT")])


# 7 ---------------------------------------------------------------------------------------------

def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "\\[\\INST]\\\\", "[ROLE x]</s>\n", "", None, "<\\/s>", "é\U0001f600"]
    talks = [(1, t, r, x) for t, (r, x) in enumerate(zip(["system", "user", "assistant", "assistant", "user", None, "to]ol"], odd))]
    talks += [(2, 0, "user", "only")] + [(3, 1, "assistant", "b"), (3, 0, "user", "a"), (3, None, "user", "first")]
    talks += [(None, 0, "assistant", "x"), (None, 0, "assistant", "x")]
    frame = spark.createDataFrame([(*t, "e") for t in talks], "conv_id long, turn long, role string, text string, example string")
    examples = chat.expand(frame)
    expected = []
    for conv in {t[0] for t in talks}:
        turns = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in talks if t[0] == conv))
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        replies = [x for *_, r, x in turns if r == "assistant"]
        mine = examples.where(F.col("conv_id").eqNullSafe(F.lit(conv))).orderBy("example").collect()
        assert [e.formatted[e.loss_start:e.loss_end] != "" for e in mine if e.loss_end] == [x != "" for x in replies if x or True][:len([e for e in mine if e.loss_end])]
        assert len(mine) == len(replies) + (turns[-1][2] != "assistant")
        assert all(b.formatted.startswith(a.formatted) for a, b in zip(mine, mine[1:]))
        expected.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len("".join(replies)),
                         hashlib.sha256("".join(replies).encode()).hexdigest(), sum(len(e.formatted) for e in mine)))
    assert rows_of(chat.read_back(examples)) == sorted(expected, key=repr)
    assert chat.read_back(chat.expand(frame.limit(0))).count() == 0


# 8 ---------------------------------------------------------------------------------------------

def test_fuzzy_lines(spark):
    draw = random.Random(4)
    letters = "abcdefghij "
    base = ["".join(draw.choice(letters) for _ in range(n)) for n in (5, 30, 90, 200) for _ in range(10)]
    docs = [(None, "same line of a null id\n\n  \nend"), (1, None), (2, ""), (3, "a\nb\na"), (3, "a\nb\na")]
    for i in range(60):
        lines = []
        for _ in range(4):
            line = list(draw.choice(base))
            if draw.random() < 0.6:
                line[draw.randrange(len(line))] = "é"
            lines.append("".join(line))
        docs.append((10 + i, "\n".join(lines)))
    size = fuzzy_lines.SHINGLE
    occurrences = [(i, n, line) for i, t in docs for n, line in enumerate((t or "").split("\n")) if line.strip()]
    distinct = sorted({o[2] for o in occurrences})
    sets = [{x[j:j + size] for j in range(max(1, len(x) - size + 1))} for x in distinct]
    links = [(a, b) for a in range(len(sets)) for b in range(a)
             if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    root = dict(zip(distinct, grouped(len(distinct), links)))
    low = {}
    for i, _, line in occurrences:
        low[root[line]] = min(low.get(root[line], 10 ** 9), -1 if i is None else i)
    frame = table(spark, docs)
    got = fuzzy_lines.judge_lines(frame).collect()
    wrong = [r for r, o in zip(sorted(got, key=lambda r: (r.doc_id or -1, r.line_no)),
                               sorted(occurrences, key=lambda o: (o[0] or -1, o[1])))
             if (-1 if r.keep_doc_id is None else r.keep_doc_id) != low[root[o[2]]]]
    assert len(got) == len(occurrences) and len(wrong) <= 0.01 * len(got)
    assert sum(r.kept for r in got) == len(low) + 2  # the repeated row keeps its two lines twice
    cleaned = fuzzy_lines.keep_lines(frame)
    assert cleaned.columns == frame.columns and cleaned.count() == len(docs)
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    assert texts[1] is None and texts[2] == "" and texts[3] == "a\nb" and texts[None] == docs[0][1]
    assert fuzzy_lines.judge_lines(frame.limit(0)).count() == 0


def test_line_traits(spark):
    draw, size = random.Random(8), fuzzy_lines.SHINGLE
    lines = ["", "ab", "ab\0", "abcdefg", "a" * 40, "\U0001f600é" * 9, "x" * 3000]
    for n in (20, 60, 200, 700):
        first = "".join(draw.choice("abcdef ") for _ in range(n))
        lines += [first] + [first[:k] + "é" + first[k + 1:] for k in range(3, n, max(1, n // 6))]
        lines += [first[:n // 2] + "".join(draw.choice("abcdef ") for _ in range(n // 2)) for _ in range(4)]
    sets = [{x[j:j + size] for j in range(max(1, len(x) - size + 1))} for x in lines]
    frame = spark.createDataFrame([(i, i, x) for i, x in enumerate(lines)], "lid long, first_doc long, line string")
    known = fuzzy_lines.describe(frame, size, 3, 10)
    assert {r.lid: r.traits.n for r in known.collect()} == {i: len(x) for i, x in enumerate(sets)}
    one, other = (known.select(F.col("lid").alias(x), F.col("traits").alias(t)) for x, t in (("a", "p"), ("b", "q")))
    allowed = {(r.a, r.b) for r in one.crossJoin(other).where(fuzzy_lines.may_be_similar("p", "q", 3, 4)).collect()}
    for a, x in enumerate(sets):
        for b, y in enumerate(sets):
            assert (a, b) in allowed or 4 * len(x & y) < 3 * len(x | y)
            assert (a, b) not in allowed or len(x) < 100 or 2 * len(x & y) >= len(x | y)
    texts = spark.createDataFrame([(a, b, x, y) for a, x in enumerate(lines) for b, y in enumerate(lines)],
                                  "a long, b long, p string, q string")
    similar = {(r.a, r.b) for r in texts.mapInArrow(fuzzy_lines._similar(size, 3, 4), "a long, b long").collect()}
    assert similar == {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets)
                       if 4 * len(x & y) >= 3 * len(x | y)}


def test_lines_of_one_template_are_not_compared_in_pairs(spark, monkeypatch):
    draw, compared = random.Random(9), []
    head = "".join(draw.choice("abcdefghij ") for _ in range(110))
    lines = [head + "".join(draw.choice("abcdefghij ") for _ in range(70)) for _ in range(200)]
    write = fuzzy_lines.materialize

    def counted(df, name, *args):
        written = write(df, name, *args)
        if name == "lines-candidates":
            compared.append(written.count())
        return written

    monkeypatch.setattr(fuzzy_lines, "materialize", counted)
    got = fuzzy_lines.judge_lines(table(spark, list(enumerate(lines)))).collect()
    assert len(got) == len(lines) and all(r.kept and r.keep_doc_id == r.doc_id for r in got)
    assert compared and sum(compared) <= len(lines)


# 9 ---------------------------------------------------------------------------------------------

def brute_classes(corpus):
    sets = [shingle_set(t) for _, t in corpus]
    links = [(a, b) for a in range(len(sets)) for b in range(a)
             if sets[a] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    root = grouped(len(sets), links)
    least = {}
    for r, (i, _) in zip(root, corpus):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [(i, len(s), least[r] if s else i) for (i, _), s, r in zip(corpus, sets, root)]


@pytest.mark.parametrize("frequent", [0, 3, 40])
def test_jaccard_join(spark, corpus, monkeypatch, frequent):
    """At threshold 0 all tokens are indexed in pairs, at 3 the passage's and the copies'."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "BUCKET_TOKENS", 1 << 10)
    frame = table(spark, corpus)
    assert rows_of(jaccard_join.similar_classes(frame)) == sorted(brute_classes(corpus), key=repr)


def test_jaccard_prefixes_share_a_signature():
    """Any two similar sets share a signature, whatever is frequent."""
    draw = np.random.default_rng(8)
    for trial in range(300):
        universe = np.sort(draw.integers(0, 1 << 63, 400).astype(np.uint64))
        frequent = set(universe[draw.random(400) < draw.choice([0.1, 0.7, 1.0])].tolist())
        base = draw.choice(universe, draw.integers(4, 120), replace=False)
        drop = draw.random(len(base)) > draw.choice([0.02, 0.1])
        other = np.unique(np.concatenate((base[drop], draw.choice(universe, draw.integers(0, 6)))))
        one, common = np.unique(base), np.intersect1d(base, other)
        if 4 * len(common) >= 3 * len(np.union1d(one, other)) and len(common) < max(len(one), len(other)):
            signatures = []
            for s in (one, other):
                mark = np.array([t in frequent for t in s.tolist()])
                rare, pairs = jaccard_join.prefix(s, mark, 3, 4)
                signatures.append({*rare.tolist(), *pairs.tolist()})
            assert signatures[0] & signatures[1]


def test_jaccard_keeps_one_of_each(spark, corpus):
    frame = table(spark, corpus)
    classes = brute_classes(corpus)
    kept = jaccard_join.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i or -1 for i, _, c in classes if i == c)
    assert jaccard_join.similar_classes(frame.limit(0)).count() == 0


def test_jaccard_judges_texts_of_one_id_one_by_one(spark):
    text, other = "one two three four five six seven", "quite another text of more than five words"
    kept = jaccard_join.keep_one(table(spark, [(1, text), (2, text), (2, other), (None, text), (None, other)]))
    assert rows_of(kept.select("doc_id", "text")) == [(1, text), (2, other)]


@pytest.mark.parametrize("earlier, cell", [(0, 1), (2, 4), (8, 50)])
def test_linked_finds_every_component(spark, monkeypatch, earlier, cell):
    """Whatever rows carry and however large cells are, and each pair is checked once if rows carry all."""
    monkeypatch.setattr(components, "EARLIER", earlier)
    monkeypatch.setattr(components, "CELL", cell)
    draw = random.Random(4)
    place = {i: draw.randrange(900) for i in range(150)}
    signatures = {i: sorted({draw.randrange(8) for _ in range(4)}) for i in place}
    index = spark.createDataFrame([(s, i) for i, all_ in signatures.items() for s in all_], "signature long, sid long")
    nodes = spark.createDataFrame(list(place.items()), "sid long, traits long")

    def near(one, other, most):
        return F.abs(F.col(one) - F.col(other)) <= most

    def verified(pairs):
        at = [nodes.select(F.col("sid").alias(s), F.col("traits").alias(f"at_{s}")) for s in "ab"]
        return pairs.join(at[0], "a").join(at[1], "b").where(near("at_a", "at_b", 5)).select("a", "b")

    found = components.linked(index, nodes, lambda one, other: near(one, other, 40), lambda pairs: pairs, verified, "test")
    links = [(a, b) for a in place for b in range(a)
             if abs(place[a] - place[b]) <= 5 and set(signatures[a]) & set(signatures[b])]
    root = grouped(len(place), links)
    touched = {i for link in links for i in link}
    assert rows_of(found) == sorted(((i, root[i]) for i in touched), key=repr)


# 10 --------------------------------------------------------------------------------------------

def test_attention_quality(spark):
    draw = random.Random(6)

    def text(good):
        out = [draw.choice("alpha beta gamma delta epsilon".split()) + draw.choice(["", "", ".", ","]) for _ in range(draw.randrange(20, 400))]
        if not good:
            at = draw.randrange(len(out))
            out[at:at + 60] = [w.upper() + "!!" for w in out[at:at + 60]] + ["BUY!!"] * 30
        return " ".join(out)
    docs = [(i, text(i % 3 > 0)) for i in range(300)]
    frame = table(spark, docs + [(900, None), (901, ""), (None, "a b"), (1, docs[1][1])])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in docs] + [(None, 1, 1), (5, None, 0), (7, 0, 0), (7, 1, 0), (2, 9, 0)],
                                   "doc_id long, quality int, toxic int")
    model = mil_quality.fit(frame, labels.where("doc_id is null or doc_id % 2 = 0"))
    scores = mil_quality.score(frame, model).collect()
    assert len(scores) == 304 and all(0 <= s.score <= 1 for s in scores)
    held = [s for s in scores if s.doc_id is not None and s.doc_id < 300 and s.doc_id % 2]
    assert sum((s.score >= 0.5) == (s.doc_id % 3 > 0) for s in held) >= 0.95 * len(held)
    kept = mil_quality.keep_good(frame, model)
    assert kept.columns == frame.columns and kept.count() == sum(s.score >= 0.5 for s in scores)
    blank = mil_quality.fit(frame, labels.limit(0))
    assert {s.score for s in mil_quality.score(frame, blank).collect()} == {0.5}
    assert mil_quality.score(frame.limit(0), blank).count() == 0


def test_attention_gradient():
    draw = np.random.default_rng(1)
    x, first, label = draw.normal(size=(9, 4)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    shapes = {"code": (4, 3), "code0": (3,), "view": (3, 2), "gate": (3, 2), "attend": (2,), "out": (3,), "out0": ()}
    w = {k: draw.normal(size=s) for k, s in shapes.items()}

    def loss(w):
        p = mil_quality._sigmoid(mil_quality._forward(w, x, first)["logit"])
        return -(label * np.log(p) + (1 - label) * np.log(1 - p)).mean()
    for k, g in mil_quality._gradient(w, x, first, label).items():
        at = tuple(0 for _ in shapes[k])
        up, down = ({**w, k: np.array(w[k], copy=True)} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert (loss(up) - loss(down)) / 2e-5 == pytest.approx(np.asarray(g)[at], abs=1e-6)


def test_passages_cover_long_texts():
    text = " ".join(f"w{i}" for i in range(64 * 200))
    piece, = words.pieces(pa.array([text, "", "one"]), lower=False)
    features, first = mil_quality.encode_passages(piece)
    assert np.diff(first).tolist() == [mil_quality.PASSAGES, 1, 1] and features.shape[1] == mil_quality.FEATURES
