"""Runs of words that repeat with a fixed period, found online by sparse diagonal match lengths.

A word that equals the one ``lag`` words before it lies on the diagonal ``lag``; a run of period q is a stretch on the
diagonal q. Reading a text word by word, an earlier occurrence of the present word extends the match length of its
lag, and a diagonal that the next word does not extend is done and, if long enough, gives a run at once.

Two facts keep the diagonals few without losing a run. A run spans at least ``exponent`` (two or more) periods, so that
words deep inside a run of period q also have equal contexts q words before: a level of contexts of k words serves the
periods from k/2 up to k, and a word whose context does not come twice is not looked at. And in a run of smallest
period q the nearest earlier occurrence of a context of at least q words lies exactly q words back: one nearer would
make the context, and with it the run, periodic with a common divisor of both lags. So one lag a level is active at a
time, a text of one word repeated costs no more than any other, and a run that consists of shorter ones (period 4 over
a true period of 2) never shows up.

Texts are read in Arrow batches, and nothing is shuffled. The work for a text of n words is n log n at most.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.texts import WORDS_AT_ONCE, identified, kind_of, map_batches, raw_texts, slices

LEAST_LENGTH = 6  # words
LEAST_EXPONENT = 4  # periods
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
Run = tuple[int, int, int]
# What to read instead of the words of a text, given its id and words.
Rewrite = Callable[[object, list[bytes]], list[bytes]]


def _finished(last: int, matched: int, lag: int, least_length: int, least_exponent: int) -> Run | None:
    """The run of a diagonal whose last matched words end at place last, or None if it is too short."""
    length = matched + lag
    return (last + 1 - length, length, lag) if length >= max(least_length, least_exponent * lag) else None


def diagonals(
    places: list[int], contexts: list[int], width: int, shortest: int, least_length: int, least_exponent: int
) -> Iterator[Run]:
    """Runs with periods from shortest to width, as they end.

    places are those, in order, whose context of width words comes at least twice; equal contexts have equal numbers.
    """
    nearest: dict[int, int] = {}
    last, lag, matched = -2, 0, 0
    for place, context in zip(places, contexts):
        found = place - nearest.get(context, place)
        nearest[context] = place
        if found == lag and place == last + 1:
            matched += 1
        else:
            if lag and (run := _finished(last, matched, lag, least_length, least_exponent)):
                yield run
            lag, matched = (found, width) if shortest <= found <= width else (0, 0)
        last = place
    if lag and (run := _finished(last, matched, lag, least_length, least_exponent)):
        yield run


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each key, and which keys come at least twice."""
    _, numbers, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return numbers, counts[numbers] > 1


def _widened(places: np.ndarray, numbers: np.ndarray, by: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Join contexts that end by words apart to contexts of twice the width; those that come twice."""
    at = np.full(length, -1, np.int64)
    at[places] = numbers
    earlier = np.where(places >= by, at[places - by], -1)
    both = earlier >= 0
    places, keys = places[both], earlier[both] * (int(numbers.max(initial=0)) + 1) + numbers[both]
    numbers, again = _repeated(keys)
    return places[again], numbers[again]


def runs_of(
    texts: list[list[bytes]], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT
) -> list[list[Run]]:
    """The runs of each text, by start, then period.

    A run is a stretch of words with smallest period q, of at least least_length words and least_exponent times q,
    which a neighbouring word would not continue with that period.
    """
    if least_exponent < 4 or least_length < 6:
        raise ValueError("contexts of four words find runs of at least four periods and six words")
    sizes = np.array([len(words) for words in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    known = defaultdict(itertools.count().__next__)
    codes = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(texts)), np.int64, len(owner))
    found: list[list[Run]] = [[] for _ in texts]
    # Pairs of words of one text, then contexts of four, eight and so on. A pair's number tells its text too.
    places = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    kinds = len(known)
    numbers, again = _repeated((owner[places] * kinds + codes[places - 1]) * kinds + codes[places])
    places, numbers = places[again], numbers[again]
    width, shortest = 2, 1
    while len(places):
        places, numbers = _widened(places, numbers, width, len(owner))
        width *= 2
        long_enough = sizes[owner[places]] >= max(least_length, least_exponent * shortest)
        places, numbers = places[long_enough], numbers[long_enough]
        for start, length, period in diagonals(
            places.tolist(), numbers.tolist(), width, shortest, least_length, least_exponent
        ):
            text = int(owner[start])
            found[text].append((start - int(first[text]), length, period))
        shortest = width + 1
    for runs in found:
        runs.sort(key=lambda run: (run[0], run[2]))
    return found


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that lie in a run after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return list(itertools.compress(words, (np.cumsum(edges[:-1]) == 0).tolist()))


def periodic_runs(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_length: int = LEAST_LENGTH,
    least_exponent: int = LEAST_EXPONENT,
    rewrite: Rewrite | None = None,
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of docs; runs are structs of start, length and period in words.

    collapsed joins the kept words by single spaces. A null or empty text has no words, no runs and an empty collapsed
    text. Rows with equal ids or texts are each read. Texts of any length are read whole. Other columns are left out.
    An empty table gives an empty table. rewrite replaces the words of a text before they are read.
    """
    source = identified(docs, doc_id, text)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, raws = batch.column(0).to_pylist(), raw_texts(batch.column(1))
        counts, runs, kept = [], [], []
        for part in slices([len(raw) // 6 for raw in raws], WORDS_AT_ONCE):
            texts = [raw.split() for raw in raws[part]]
            if rewrite:
                texts = [rewrite(i, words) for i, words in zip(ids[part], texts)]
            found = runs_of(texts, least_length, least_exponent)
            counts += map(len, texts)
            runs += [[dict(zip(("start", "length", "period"), run)) for run in each] for each in found]
            kept += [b" ".join(collapsed(words, each)) for words, each in zip(texts, found)]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column(0),
                "n_words": pa.array(counts, pa.int64()),
                "runs": pa.array(runs, pa.list_(RUN)),
                "collapsed": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    run = "array<struct<start: long, length: long, period: long>>"
    return map_batches(source, step, f"doc_id {kind_of(source, 'doc_id')}, n_words long, runs {run}, collapsed string")


def strongest(runs: str = "runs") -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first, null without runs."""

    def better(best: Column, run: Column) -> Column:
        return F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best)

    rest = F.slice(F.col(runs), F.lit(2), F.greatest(F.size(runs) - 1, F.lit(0)))
    return F.aggregate(rest, F.get(F.col(runs), F.lit(0)), better)
