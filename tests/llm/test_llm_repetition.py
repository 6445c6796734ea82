from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from folders import MIDDLE
from tillroll.llm import repetition as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs(words):
    """For each position the longest run that occurs elsewhere, by comparing all pairs."""
    n, out = len(words), []
    for i in range(n):
        best = 0
        for j in range(n):
            length = 0
            while i != j and max(i, j) + length < n and words[i + length] == words[j + length]:
                length += 1
            best = max(best, length)
        out.append(best)
    return out


def brute(text, limits):
    words = WORD.findall(text or "")
    found = runs(words)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    covered = {k for i, m in enumerate(found) if m >= limits.shortest_repeat for k in range(i, i + m)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    longest = max([m for m in found if m >= limits.shortest_repeat], default=0)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < limits.least_words or len(again) > limits.repeat_words * len(words)
    kept = (
        not failed
        and len(covered) <= limits.covered * len(words)
        and longest <= limits.longest * len(words)
        and symbols <= limits.symbols * len(words)
    )
    chars = sum(map(len, words))
    return [len(words), chars, symbols, len(lines) - len(set(lines)), len(again), len(covered), longest, failed, kept]


@pytest.mark.parametrize("seed", range(20))
def test_suffix_array_against_pairs(seed):
    r = random.Random(seed)
    texts = [[r.choice("abc").encode() for _ in range(r.choice([0, 1, 2, 9, 40]))] for _ in range(6)]
    codes, owner = R._numbered(texts)
    assert R.repeat_lengths(codes, owner).tolist() == sum((runs(t) for t in texts), [])


@pytest.mark.parametrize("seed", range(8))
def test_measures_against_brute_force(seed):
    r = random.Random(seed)
    limits = R.Limits(least_words=5, shortest_repeat=4)
    pool = ["a", "b", "été", "x#", "<p>", "\U0001f600", " "]
    texts = ["".join(r.choice(pool) + r.choice([" ", "\n", "\t", "\x0b", "  ", "\n \n"]) for _ in range(r.randrange(60))) for _ in range(12)]
    texts += [None, "", "\n\n", "same line\nsame line\nsame line"]
    found = pd.DataFrame(R.measured(pa.array(texts, pa.string()), limits))
    names = [part.split()[0] for part in R.COLUMNS.split(", ")]
    assert found[names].values.tolist() == [brute(text, limits) for text in texts]


def test_parts_do_not_change_results(monkeypatch):
    texts = pa.array([" ".join(random.Random(i).choices("abcdefgh", k=80)) for i in range(20)])
    whole = R.measured(texts, R.Limits())
    monkeypatch.setattr(R, "WORDS_AT_ONCE", 30)
    parts = R.measured(texts, R.Limits())
    assert all(np.array_equal(whole[k], parts[k]) for k in whole)


def test_one_run_of_a_word_and_a_repeated_half():
    assert R.repeat_spans("a b c d x a b c d", 4) == [(0, 7), (10, 17)]
    assert R.repeat_spans("z " * 30, 10) == [(0, 59)]
    assert R.repeat_spans(None) == [] and R.repeat_spans("a b a b", 3) == []
    half = " ".join(f"w{i}" for i in range(100))
    found = R.measured(pa.array([half, half + " " + half]), R.Limits())
    assert found["kept"].tolist() == [True, False]
    assert found["longest_repeat"].tolist() == [0, 100] and found["n_covered_words"].tolist() == [0, 200]


def test_labelled_documents(middle):
    labels = pd.read_parquet(f"{MIDDLE}/labels.parquet")
    found = R.quality_measures(middle).toPandas().merge(labels, on="doc_id")
    judged = found[~found.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.99
    assert judged[judged.quality == 0].kept.mean() < 0.05
