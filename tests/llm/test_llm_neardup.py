from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tillroll.llm import neardup
from tillroll.llm.bktree import BKTree
from tillroll.llm.components import connected


def print_of(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [words[i : i + k] for i in range(len(words) - k + 1)] or ([words] if words else [])
    hashes = [xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum((2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) << bit for bit in range(64))


def components(prints, ids, radius=2):
    near = [[j for j, b in enumerate(prints) if (a ^ b).bit_count() <= radius] for a in prints]
    out = [None] * len(prints)
    for start in range(len(prints)):
        if out[start] is None:
            seen, waiting = {start}, [start]
            while waiting:
                for j in near[waiting.pop()]:
                    if j not in seen:
                        seen.add(j)
                        waiting.append(j)
            least = min((ids[j] for j in seen if ids[j] is not None), default=None)
            for j in seen:
                out[j] = (least,)
    return [x[0] for x in out]


def test_fingerprints():
    for text in (None, "", "One", "one two", "A b C d e", "x " * 2000, "É é   y", "a b c a b c"):
        words = (text or "").encode().lower().split()
        assert neardup.simhash(neardup.shingle_hashes(words, 3)) == print_of(text)
    many = np.random.default_rng(1).integers(0, 1 << 63, 70_000, dtype=np.uint64)
    bits = np.unpackbits(many.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    assert neardup.simhash(many) == sum(int(2 * b > len(many)) << i for i, b in enumerate(bits))


def test_spark_hash_is_the_same(spark):
    (row,) = spark.range(1).select(F.xxhash64(F.lit("the cat sat")).alias("h")).collect()
    assert row["h"] % 2**64 == xxh64_intdigest(b"the cat sat", 42)


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_tree_finds_all_within_radius(radius):
    r = random.Random(radius)
    base = [r.getrandbits(64) for _ in range(20)]
    values = list({x ^ sum(1 << r.randrange(64) for _ in range(r.randrange(5))) & (2**64 - 1) for x in base for _ in range(15)})
    asked = [*values[::3], *(r.getrandbits(64) for _ in range(20))]
    tree = BKTree(np.array(values, np.uint64), radius)
    found = {(int(a), int(b)) for q, n in tree.search(np.array(asked, np.uint64), at_once=16) for a, b in zip(q, n)}
    assert found == {(i, j) for i, a in enumerate(asked) for j, b in enumerate(values) if (a ^ b).bit_count() <= radius}


@pytest.mark.parametrize("shard", [2, 16, 4096])
def test_groups_against_all_pairs(spark, shard):
    """Chains of fingerprints two bits apart, dense balls, blocks with many members, copies."""
    r = random.Random(shard)
    prints = [0, 0, 2**64 - 1]
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(12):  # a chain whose ends are far apart
            prints.append(x)
            x ^= 3 << r.randrange(62)
    ball = r.getrandbits(64)
    prints += [ball ^ (1 << i) for i in range(30)] + [ball] * 5
    low = r.getrandbits(21)
    prints += [low | r.getrandbits(43) << 21 for _ in range(60)]  # one block shared by unlike ones
    ids = list(range(len(prints)))
    r.shuffle(ids)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    made = neardup.grouped(spark.createDataFrame(list(zip(ids, signed)), "doc_id long, fp long"), shard=shard)
    assert {row["doc_id"]: row["component_id"] for row in made.collect()} == dict(zip(ids, components(prints, ids)))


def test_documents_against_all_pairs(middle):
    rows = neardup.near_groups(middle).collect()
    texts = {row["doc_id"]: row["text"] for row in middle.collect()}
    assert all(row["fp"] % 2**64 == print_of(texts[row["doc_id"]]) for row in rows[:60])
    expected = components([row["fp"] % 2**64 for row in rows], [row["doc_id"] for row in rows])
    assert [row["component_id"] for row in rows] == expected


def test_null_and_repeated_ids(docs):
    a, b, c = "one two three four", "five six seven eight", "nine ten eleven twelve"
    found = neardup.near_groups(docs([(None, a), (4, a), (None, b), (None, b), (7, c), (7, c), (7, a)])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in found) == [
        ("4", "4"), ("7", "4"), ("7", "7"), ("7", "7"), ("None", "4"), ("None", "None"), ("None", "None")
    ]
    kept = neardup.first_of_groups(docs([(None, a), (4, a), (None, b), (None, b), (7, c), (7, c), (7, a)])).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("4", a), ("7", c), ("None", b)]


def test_components_against_union_find(spark):
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)]
    links += [(1000 + i, 1001 + i) for i in range(150)]  # a path
    links += [(2000, 2001 + i) for i in range(300)]  # a star
    links += [(7, 7), (None, 3), (3, None)]
    least = {}

    def root(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in links:
        if None not in (a, b) and a != b:
            x, y = sorted((root(a), root(b)))
            least[y] = x
    found = connected(spark.createDataFrame(links, "a long, b long"))
    assert {row["node"]: row["root"] for row in found.collect()} == {x: root(x) for x in list(least)}
    assert found.count() == len(least)


def test_no_links(spark):
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
