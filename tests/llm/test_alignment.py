"""Token alignment against plain byte ranges, and the sparse products against dense ones."""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest

from labelloom.llm import token_alignment as ta
from labelloom.llm.queries import QUERIES, TOKENIZER_A, TOKENIZER_B

DOCS = "doc_id long, text string, chunk long, pair int, pairs int, n_a string, held int"
EDGES = [(1, None), (2, ""), (3, " "), (4, "Hello world"), (5, "Hello world"), (None, "Hello world"), (None, None),
         (7, "a ▁ b"), (8, "x <|endoftext|> <s></s> <0x0A> <unk> y"), (9, "tab\there\nnew\r\n  two  spaces  "),
         (10, "naïve café 漢字 🙂🙂 ‍́"), (11, "zero\x00byte\x0b\x0c"), (12, "a" * 5000), (13, "1234567890" * 30), (13, "!?" * 50)]


def tokens(tools, text):
    """[(id, start, end)] of both, or none."""
    whole, out = (" " + text).encode(), []
    for ids, table in ((tools.a.encode(" " + text, add_special_tokens=False).ids, tools.a_bytes),
                       (tools.b.encode(text), tools.b_bytes)):
        at, spans = 0, []
        for i in ids:
            spans.append((i, at, at + len(table[i])))
            at += len(table[i])
        if not text or b"".join(table[i] for i in ids) != whole:
            return [], []
        out.append(spans)
    return out


def expected(rows):
    tools, held, docs = ta.load(TOKENIZER_A, TOKENIZER_B), Counter(), []
    for i, text in rows:
        a, b = tokens(tools, text or "")
        links, j = [], 0
        for x, s, e in a:
            while j and b[j - 1][2] > s:
                j -= 1
            while j < len(b) and b[j][2] <= s:
                j += 1
            while j < len(b) and b[j][1] < e:
                links.append((x, b[j][0]))
                j += 1
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [([], []) for _ in cuts]
        for k, side in enumerate((a, b)):
            for x, _, e in side:
                groups[bisect_left(cuts, e)][k].append(x)
        docs.append((i, a, b, cuts, groups, links))
        held.update(set(links))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for i, a, b, cuts, groups, links in docs:
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((i, len(a), len(b), len(cuts), len(links), sum(held[k] == top[k[0]] for k in links), sum(held[k] for k in links),
                    hashlib.sha256(written.encode()).hexdigest() if a else ""))
    return out


def got(df):
    return [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()]


def same(found, wanted):
    assert sorted(found, key=repr) == sorted(wanted, key=repr)


@pytest.mark.parametrize("products", [1, 7, 10 ** 6])
def test_products_equal_dense_ones(products):
    draw = np.random.default_rng(2)
    for _ in range(20):
        n, m, k = draw.integers(1, 12, 3)
        x, y = ((draw.integers(0, 3, s) * (draw.random(s) < 0.4)).astype(np.int64) for s in ((n, m), (m, k)))
        a, b = (ta.csr((z != 0).sum(axis=1), np.nonzero(z)[1], z.shape[1], z[z != 0]) for z in (x, y))
        dense = np.zeros((n, k), dtype=np.int64)
        for rows, columns, values in ta.gustavson(a, b, products):
            dense[rows, columns] += values
        assert (dense == x @ y).all()
        t = ta.transpose(a)
        back = np.zeros((m, n), dtype=np.int64)
        back[np.repeat(np.arange(m), np.diff(t.indptr)), t.indices] = t.data
        assert (back == x.T).all()


@pytest.mark.parametrize("chunk", [1, 300, ta.CHUNK])
def test_edge_cases_and_clashing_names(spark, chunk):
    docs = spark.createDataFrame([(i, t, 1, 2, 3, "x", 4) for i, t in EDGES], DOCS).coalesce(2)
    same(got(ta.align(docs, TOKENIZER_A, TOKENIZER_B, chunk=chunk)), expected(EDGES))


def test_remembered_words_equal_whole_texts(monkeypatch):
    """Texts cut at single spaces, with all kinds of blanks, against encoding them as they are."""
    monkeypatch.setattr(ta, "WORDS", 20)
    tools, draw = ta.Tokenizers(TOKENIZER_A, TOKENIZER_B), random.Random(8)
    parts = ["a", "it's", "'s", "42", "é", "漢", "🙂", "▁", "<0x41>", "...", "\n", "\t", "\x1c", "\x85", "\u00a0", "\u3000", " ", " ", " ", " ", "ab" * 80]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(30))) for _ in range(3000)]
    assert tools.by_words
    for at in range(0, len(texts), 100):
        for text, a, b in zip(texts[at:at + 100], *tools.encode(texts[at:at + 100])):
            want = [[i for i, _, _ in side] for side in tokens(tools, text)]
            assert [a.tolist(), b.tolist()] == want, repr(text)


def test_empty_table(spark):
    assert ta.align(spark.createDataFrame([], DOCS), TOKENIZER_A, TOKENIZER_B).collect() == []


def test_query_equals_byte_ranges(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    same(got(QUERIES["op11_token_alignment"](spark, sf)), expected(rows))


def test_a_long_text_is_aligned_whole(spark):
    draw = random.Random(6)
    text = " ".join("".join(draw.choice("abcdeéß漢") for _ in range(draw.randrange(1, 9))) for _ in range(300_000))
    rows = [(1, text), (2, "short")]
    same(got(ta.align(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER_A, TOKENIZER_B)), expected(rows))


def test_links_of_groups(spark):
    """Pairs of one group, with the bytes that they share."""
    rows = [(i, t) for i, t in EDGES if t and len(t) < 500]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = Counter(map(tuple, ta.alignment_links(docs, TOKENIZER_A, TOKENIZER_B).collect()))
    tools, wanted = ta.load(TOKENIZER_A, TOKENIZER_B), Counter()
    for i, text in rows:
        a, b = tokens(tools, text)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        for x, (p, s, e) in enumerate(a):
            for y, (q, s2, e2) in enumerate(b):
                if not any(min(e, e2) <= c <= max(s, s2) for c in cuts):
                    wanted[i, x, y, p, q, max(0, min(e, e2) - max(s, s2))] += 1
    assert found == wanted
