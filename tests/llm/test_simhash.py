"""SimHash tiles against a comparison of all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from labelloom.llm import simhash_tiles
from labelloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, fingerprint string, key int, block int, a int, component long"


def expected_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows, radius=2):
    """(doc_id, hex, component) by comparing all distinct fingerprints."""
    prints = [expected_print(t) for _, t in rows]
    distinct = sorted(set(prints))
    array, group = np.array(distinct, dtype=np.uint64), list(range(len(distinct)))
    seen = [False] * len(distinct)
    for i in range(len(distinct)):
        if seen[i]:
            continue
        stack, seen[i] = [i], True
        while stack:
            at = stack.pop()
            group[at] = i
            for j in np.flatnonzero(np.bitwise_count(array ^ array[at]) <= radius):
                if not seen[j]:
                    seen[j] = True
                    stack.append(int(j))
    of = dict(zip(distinct, group))
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[of[p]] = min(i, least.get(of[p], i))
    return sorted(((i, f"{p:016x}", least.get(of[p])) for (i, _), p in zip(rows, prints)), key=repr)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [draw.choice(vocabulary) for _ in range(120)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (None, "nobody knows this"), (None, "a b c d"),
            (7, "x y z x y z"), (7, "x y z x y z"), (8, "été élan " * 9), (9, "été ÉLAN"), (10, "A\x0bB C d")]
    for i in range(150):
        copy = list(base)
        for _ in range(draw.randrange(3)):
            copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
        rows.append((1000 - i, " ".join(copy)))
    rows += [(2000 + i, " ".join(draw.choice(vocabulary) for _ in range(draw.choice((1, 2, 4, 30))))) for i in range(150)]
    return rows + [(3000 + i, rows[15][1]) for i in range(40)]


@pytest.mark.parametrize("radius,parts,tile", [(2, 4, 2048), (3, 8, 2), (0, 1, 16)])
def test_equals_all_pairs(spark, corpus, radius, parts, tile):
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3, 4) for i, t in corpus], DOCS)
    assert got(simhash_tiles.similar_classes(docs, radius=radius, parts=parts, tile=tile)) == expected(corpus, radius)


def test_empty_table_and_string_ids(spark):
    docs = spark.createDataFrame([], DOCS)
    assert simhash_tiles.similar_classes(docs).collect() == []
    named = spark.createDataFrame([("b", "x y z"), ("a", "x y z"), (None, "x y z")], "doc_id string, text string")
    assert {r.component_id for r in simhash_tiles.similar_classes(named).collect()} == {"a"}


def test_query_equals_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(QUERIES["op13_simhash_tiles"](spark, sf)) == expected(rows)


def test_a_very_long_text_is_hashed_whole():
    draw = random.Random(4)
    words = [f"w{draw.randrange(10 ** 6)}" for _ in range(70_000)]
    assert simhash_tiles.fingerprint(" ".join(words).encode()) == expected_print(" ".join(words))


def test_spark_hashes_the_same_way(spark):
    """The hash is that of Spark's function, whose seed is the same."""
    text = "the quick brown"
    mine = simhash_tiles.fingerprint(text.encode())
    assert spark.sql(f"SELECT xxhash64('{text}') AS h").first().h % 2 ** 64 == mine


def test_a_dense_group_gives_few_links(spark):
    """2,000 fingerprints close to each other: links grow with their number, not with the pairs'."""
    draw = random.Random(9)
    center, prints = draw.getrandbits(64), set()
    while len(prints) < 2000:
        prints.add(center ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)))
    signed = [(p - 2 ** 64 if p >= 2 ** 63 else p,) for p in prints]
    links = simhash_tiles.tile_links(spark.createDataFrame(signed, "fingerprint long").repartition(4), tile=128)
    assert links.count() <= 4 * len(prints) < 100 * len(prints)
