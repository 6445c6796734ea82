"""Quality rules over a suffix array of each text's words.

The words of a text are numbered, their suffixes sorted by prefix doubling, and neighbouring suffixes
compared through the ranks of each doubling. A suffix that shares its first n words with a neighbour
starts a repeated substring of n words; where the one before it does not reach as far, the repeat is
maximal to the left. Two limits decide: the share of words that the union of these spans covers, and
the longest repeat as a share of the text.

Many texts are sorted at once. A text's number is part of the first rank, so suffixes of two texts never
tie and the longest text alone sets the number of doublings. Nothing is shuffled.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tillroll.llm.texts import WORD, WORDS_AT_ONCE, code_points, identified, kind_of, map_batches, raw_texts, slices

SYMBOLS = b"#*$%&|<>"
WINDOW = 3


@dataclass(frozen=True)
class Limits:
    """Shares are of the words of a text."""

    least_words: int = 50
    repeat_words: float = 0.5  # words in three-word windows that occur again
    shortest_repeat: int = 10  # words; a shorter repeat is no repeat
    covered: float = 0.3  # words in repeated substrings
    longest: float = 0.2  # words in the longest one
    symbols: float = 0.1  # symbols for each word


COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, "
    "longest_repeat long, base_failed boolean, kept boolean"
)


def repeat_lengths(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each position the words of the longest run from there that its text holds elsewhere too.

    codes number the words, owner their texts, in order. Runs may overlap their copies.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    _, rank = np.unique(owner.astype(np.int64) * (int(codes.max()) + 1) + codes, return_inverse=True)
    # A rank is the place of the first suffix of its group, so that only tied groups need more sorting.
    sizes = np.bincount(rank)
    rank = (np.cumsum(sizes) - sizes)[rank]
    tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    levels, length = [np.append(rank, -1)], 1
    while len(tied):
        after = np.minimum(tied + length, n)
        # A suffix that ends here is followed by another text, or by nothing: unequal to any other of its group.
        following = np.where((after < n) & (owner[np.minimum(after, n - 1)] == owner[tied]), levels[-1][after], -1)
        key = rank[tied] * (n + 1) + following + 1
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        group = rank[tied]
        place = np.arange(len(tied))
        old = np.r_[True, group[1:] != group[:-1]]
        new = np.r_[True, key[1:] != key[:-1]]
        rank = rank.copy()
        first = lambda marks: np.maximum.accumulate(np.where(marks, place, 0))
        rank[tied] = group + first(new) - first(old)
        levels.append(np.append(rank, -1))
        last = np.r_[new[1:], True]
        tied = tied[~(new & last)]
        length *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    common = np.zeros(len(a), np.int64)
    alike = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[alike], b[alike]
    got = np.zeros(len(alike), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (levels[k][a] == levels[k][b]) & (a < n) & (b < n)
        step = same.astype(np.int64) << k
        got, a, b = got + step, a + step, b + step
    common[alike] = got
    longest = np.zeros(n, np.int64)
    longest[suffixes] = np.maximum(np.r_[0, common], np.r_[common, 0])
    return longest


def covered(longest: np.ndarray, least: int, width: int | None = None) -> np.ndarray:
    """Which positions lie in a repeat of least words or more, or in its first width words."""
    starts = np.flatnonzero(longest >= least)
    ends = starts + (width or longest[starts])
    edges = np.zeros(len(longest) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends, -1)
    return np.cumsum(edges[:-1]) > 0


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    numbers = defaultdict(itertools.count().__next__)
    total = sum(map(len, texts))
    codes = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(texts)), np.int64, total)
    return codes, np.repeat(np.arange(len(texts)), [len(words) for words in texts])


def _dup_lines(raw: bytes) -> int:
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def measured(column: pa.Array, limits: Limits) -> dict[str, np.ndarray]:
    """The measures and verdict of each text of one Arrow column."""
    texts = raw_texts(column)
    parts = []
    for part in slices([len(raw) // 6 for raw in texts], WORDS_AT_ONCE):
        parts.append(_measured(texts[part], limits))
    return {name: np.concatenate([part[name] for part in parts]) for name in parts[0]} if parts else {}


def _measured(raws: list[bytes], limits: Limits) -> dict[str, np.ndarray]:
    texts = [raw.split() for raw in raws]
    codes, owner = _numbered(texts)
    count = len(raws)
    longest = repeat_lengths(codes, owner)
    in_text = lambda marks: np.bincount(owner[marks], minlength=count)
    out = {"n_words": np.array([len(words) for words in texts], np.int64)}
    joined = [b"".join(words) for words in texts]
    out["word_chars"] = np.array([code_points(j) for j in joined], np.int64)
    out["n_symbols"] = np.array([len(j) - len(j.translate(None, SYMBOLS)) for j in joined], np.int64)
    out["n_dup_lines"] = np.array([_dup_lines(raw) for raw in raws], np.int64)
    out["n_repeat_words"] = in_text(covered(longest, WINDOW, WINDOW))
    out["n_covered_words"] = in_text(covered(longest, limits.shortest_repeat))
    peak = np.zeros(count, np.int64)
    np.maximum.at(peak, owner, longest)
    out["longest_repeat"] = np.where(peak >= limits.shortest_repeat, peak, 0)
    words = out["n_words"]
    out["base_failed"] = (words < limits.least_words) | (out["n_repeat_words"] > limits.repeat_words * words)
    out["kept"] = (
        ~out["base_failed"]
        & (out["n_covered_words"] <= limits.covered * words)
        & (out["longest_repeat"] <= limits.longest * words)
        & (out["n_symbols"] <= limits.symbols * words)
    )
    return out


def repeat_spans(text: str | None, shortest: int = Limits.shortest_repeat) -> list[tuple[int, int]]:
    """The union of a text's maximal repeats as code-point spans, end exclusive; none for null."""
    spots = [(m.start(), m.end()) for m in re.finditer(WORD, text or "")]
    codes, owner = _numbered([[text[a:b].encode() for a, b in spots]])
    marks = np.r_[False, covered(repeat_lengths(codes, owner), shortest), False]
    edges = np.flatnonzero(marks[1:] != marks[:-1])
    return [(spots[a][0], spots[b - 1][1]) for a, b in zip(edges[::2], edges[1::2])]


def quality_measures(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limits: Limits = Limits()
) -> DataFrame:
    """doc_id and COLUMNS for every row of docs; other columns are left out.

    A null or empty text has no words and fails. Rows with equal ids or texts are each measured. Texts of
    any length are measured whole. An empty table gives an empty table.
    """
    names = [part.split()[0] for part in COLUMNS.split(", ")]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = measured(batch.column(1), limits)
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **{name: found[name] for name in names}})

    source = identified(docs, doc_id, text)
    return map_batches(source, step, f"doc_id {kind_of(source, 'doc_id')}, {COLUMNS}")


def keep_good(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of docs whose text passes, with all their columns; the edge cases are those of quality_measures."""
    at = docs.columns.index(text)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(measured(batch.column(at), limits)["kept"]))

    return map_batches(docs, step, docs.schema)
