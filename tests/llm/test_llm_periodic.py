"""Periodic runs against the definition, tried lag by lag."""

from __future__ import annotations

import random
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import pytest
from folders import MIDDLE

from tillroll.llm import periodic
from tillroll.llm.queries import QUERIES


def brute(words, least_length=6, least_exponent=4):
    """Every lag's maximal stretches, without those that have a smaller period."""
    found = []
    for lag in range(1, len(words) // least_exponent + 1):
        i = 0
        while i + lag < len(words):
            start = i
            while i + lag < len(words) and words[i] == words[i + lag]:
                i += 1
            length = i - start + lag
            if length >= max(least_length, least_exponent * lag):
                run = words[start : start + length]
                if not any(run[p:] == run[:-p] for p in range(1, lag)):
                    found.append((start, length, lag))
            i += 1
    return sorted(found, key=lambda run: (run[0], run[2]))


def plain(doc_id, text):
    """The row of the query, written from its contract."""
    words = [word for word in (text or "").encode().split()]
    n, h = len(words), crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    best = min(runs, key=lambda run: (-Fraction(run[1], run[2]), run[0], run[2]), default=None)
    return {
        "doc_id": doc_id,
        "n_runs": len(runs),
        "start": best and best[0],
        "length": best and best[1],
        "period": best and best[2],
        "exponent_milli": best and 1000 * best[1] // best[2],
        "runs_sha256": sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
        "collapsed_sha256": sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    }


def made_up(seed):
    rng = random.Random(seed)
    words, kinds = [], rng.choice([1, 2, 3, 6])
    size = rng.randrange(200)
    while len(words) < size:
        if rng.random() < 0.3:
            block = [rng.randrange(kinds) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 13, 17, 30]))]
            words += block * rng.randrange(1, 7) + block[: rng.randrange(len(block) + 1)]
        else:
            words.append(rng.randrange(kinds))
    return [b"%d" % word for word in words]


def test_all_runs_of_made_up_texts():
    texts = [made_up(seed) for seed in range(3000)]
    assert periodic.runs_of(texts) == [brute(words) for words in texts]
    assert max(period for runs in periodic.runs_of(texts) for _, _, period in runs) == 30


@pytest.mark.parametrize(("length", "exponent"), [(6, 5), (12, 4), (40, 7)])
def test_other_limits(length, exponent):
    texts = [made_up(seed) for seed in range(400)]
    assert periodic.runs_of(texts, length, exponent) == [brute(words, length, exponent) for words in texts]
    with pytest.raises(ValueError):
        periodic.runs_of(texts, 6, 3)


def test_a_neighbouring_text_extends_no_run():
    one = [b"a"] * 5
    assert periodic.runs_of([one, one, one + [b"a"]]) == [[], [], [(0, 6, 1)]]


def test_long_texts_of_few_words():
    one, many = [b"x"] * 100_000, [b"a", b"b", b"a", b"b", b"c"] * 40_000
    assert periodic.runs_of([one, many]) == [[(0, 100_000, 1)], [(0, 200_000, 5)]]
    assert periodic.collapsed(many, [(0, 200_000, 5)]) == many[:5]


def test_query(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    # Lags are tried one by one only in texts for which that ends soon.
    texts = {row["doc_id"]: row["text"] for row in docs.collect() if len(row["text"]) < 6000}
    found = {row["doc_id"]: row.asDict() for row in QUERIES["op13_periodic_runs"](spark, MIDDLE).collect()}
    assert len(found) == docs.count()
    for doc_id, text in texts.items():
        assert found[doc_id] == plain(doc_id, text)
    assert sum(row["n_runs"] > 0 for row in found.values()) > 40


def test_edges(docs):
    rows = [(10, None), (None, "a a a a a a"), (5, ""), (5, " \n"), (5, "a a a a a a b"), (5, "a a a a a a b")]
    found = periodic.periodic_runs(docs(rows)).collect()
    kept = sorted((str(r["doc_id"]), r["n_words"], [tuple(run) for run in r["runs"]], r["collapsed"]) for r in found)
    assert kept == [
        ("10", 0, [], ""),
        ("5", 0, [], ""),
        ("5", 0, [], ""),
        ("5", 7, [(0, 6, 1)], "a b"),
        ("5", 7, [(0, 6, 1)], "a b"),
        ("None", 6, [(0, 6, 1)], "a"),
    ]


def test_strongest_breaks_ties_by_start_then_period(spark):
    cases = [([(9, 8, 2), (30, 4, 1)], (9, 8, 2)), ([(0, 9, 2), (3, 14, 3)], (3, 14, 3)), ([], None)]
    for runs, best in cases:
        df = spark.createDataFrame([(runs,)], "runs array<struct<start: long, length: long, period: long>>")
        assert df.select(periodic.strongest().alias("best")).first()["best"] == best
