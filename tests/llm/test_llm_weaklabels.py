from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pytest

from folders import MIDDLE
from tillroll.llm import weaklabels as W


def test_em_finds_the_accuracies():
    """Votes drawn with known chances; without a label the estimate comes close to them."""
    r = np.random.default_rng(0)
    truth = r.random(40_000) < 0.2
    chances = np.array([[0.02, 0.6], [0.05, 0.8], [0.01, 0.4], [0.1, 0.7], [0.03, 0.5]])
    votes = np.where(r.random((40_000, 5)) < np.where(truth[:, None], chances[:, 1], chances[:, 0]), W.BAD, W.GOOD)
    votes[r.random(votes.shape) < 0.2] = W.NONE
    patterns, place, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, found = W.em(patterns, counts.astype(float))
    assert np.abs(found - chances).max() < 0.05
    assert ((posterior[place] > 0.5) == truth).mean() > 0.94


def test_patterns_count_every_text(small):
    patterns, counts = W.vote_patterns(small.select("text"))
    expected = Counter(W.votes(W.measure(r["text"].encode())) for r in small.collect())
    assert {tuple(p): n for p, n in zip(patterns.tolist(), counts)} == expected


def test_gradient_sums_over_all_rows(spark, small):
    patterns, counts = W.vote_patterns(small.select("text"))
    known = {tuple(p): 0.3 for p in patterns.tolist()}
    rows = W._features(small.select("text").repartition(7), known)
    weights = np.random.default_rng(0).normal(size=W.BUCKETS)
    gradient, rest, seen = W._gradient(rows, weights, 0.1)
    expected, hashed = np.zeros(W.BUCKETS), W.Hashed()
    total = 0.0
    for r in small.collect():
        buckets, values = W.features(r["text"].encode(), W.measure(r["text"].encode()), hashed)
        values = np.array(values, np.float32)
        miss = 1 / (1 + np.exp(-(weights[buckets] @ values + 0.1))) - 0.3
        np.add.at(expected, buckets, miss * values)
        total += miss
    assert seen == small.count() and rest == pytest.approx(total, abs=1e-3)
    assert np.abs(gradient - expected).max() < 1e-3


def test_accuracy_on_labels_it_never_saw(middle):
    labels = pd.read_parquet(f"{MIDDLE}/labels.parquet")
    found = W.quality(middle).toPandas().merge(labels, on="doc_id")
    assert found[found.quality == 1].kept.mean() > 0.98
    assert found[found.quality == 0].kept.mean() < 0.1
    assert ((found.weak_bad < 0.5) == (found.quality == 1)).mean() > 0.95


def test_one_sample_of_many(middle):
    scorer = W.train(middle, sample=300, steps=10)
    labels = pd.read_parquet(f"{MIDDLE}/labels.parquet")
    found = W.quality(middle, scorer=scorer).toPandas().merge(labels, on="doc_id")
    assert (found.kept == (found.quality == 1)).mean() > 0.9


def test_shape():
    assert W.shape("Ab12-é!!".encode()) == b"Aa0-a!!"
    assert W.HEURISTICS == len(W.votes(W.measure(b"some text")))


def test_score_is_that_of_the_features(small):
    weights = np.random.default_rng(1).normal(size=W.BUCKETS)
    scorer, hashed = W.Scorer(weights, -0.3), W.Hashed()
    for r in small.collect():
        raw = r["text"].encode()
        buckets, values = W.features(raw, W.measure(raw), hashed)
        chance = 1 / (1 + np.exp(-(weights[buckets] @ np.array(values) - 0.3)))
        assert scorer.bad(raw, W.measure(raw)) == pytest.approx(chance)


def test_sample_is_bounded_under_nulls_and_copies(spark):
    rows = [(None if i % 3 == 0 else "the same text" if i % 3 == 1 else f"text number {i}",) for i in range(30_000)]
    texts = spark.createDataFrame(rows, "text string")
    found = [r["text"] for r in W.distinct_sample(texts, 2000).collect()]
    assert len(found) == len(set(found)) and None not in found
    assert 1700 < len(found) < 2300
    assert len(W.distinct_sample(texts, 20_000).collect()) == 10_001


def test_the_whole_against_a_plain_version(spark, small):
    """Votes, posterior labels, hashed features and descent written out for all texts at once."""
    rows = [(r["doc_id"], r["text"]) for r in small.collect()] + [(-1, None), (-2, ""), (0, "copy"), (1, "copy")]
    measured = {text: W.measure((text or "").encode()) for _, text in rows}
    votes = {text: W.votes(m) for text, m in measured.items()}
    patterns = Counter(votes[text] for _, text in rows)
    ordered = sorted(patterns)
    posterior, _ = W.em(np.array(ordered), np.array([patterns[p] for p in ordered], float))
    label = dict(zip(ordered, posterior))
    hashed = W.Hashed()
    texts = sorted({text for _, text in rows if text})
    matrix = np.zeros((len(texts), W.BUCKETS))
    for row, text in zip(matrix, texts):
        buckets, values = W.features(text.encode(), measured[text], hashed)
        np.add.at(row, buckets, values)
    wanted = np.array([label[votes[text]] for text in texts])
    weights, bias = np.zeros(W.BUCKETS), 0.0
    squares, square = np.full(W.BUCKETS, 1e-8), 1e-8
    for _ in range(W.STEPS):
        miss = 1 / (1 + np.exp(-np.clip(matrix @ weights + bias, -30, 30))) - wanted
        gradient, rest = matrix.T @ miss / len(texts), miss.mean()
        squares, square = squares + gradient**2, square + rest**2
        weights, bias = weights - gradient / np.sqrt(squares), bias - rest / np.sqrt(square)
    found = {(r["doc_id"], r["votes"]): r for r in W.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, text in rows:
        row = found[doc_id, "".join(map(str, votes[text]))]
        assert abs(row["weak_bad"] - label[votes[text]]) < 1e-6
        if text in texts:
            score = matrix[texts.index(text)] @ weights + bias
            assert abs(row["bad"] - 1 / (1 + np.exp(-score))) < 1e-3 and row["kept"] == (row["bad"] < 0.5)
