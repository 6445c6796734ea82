"""A quality classifier without given labels.

Overlapping heuristics each call a text good, call it bad, or abstain. How often each vote goes with a good and with a
bad text is estimated by expectation maximisation over the counts of vote patterns, of which there are at most three
to the number of heuristics. A pattern's posterior labels the texts that have it. On these soft labels, of a bounded
sample of texts, a linear scorer learns weights of hashed features: words, their shapes and bucketed measures.
The scorer decides, so that texts on which all heuristics abstain are judged by what they share with others.

Three Arrow passes over the texts (votes, sample, scores). Votes are grouped to pattern counts before anything leaves
a task, and the weights are fitted by gradients that Spark sums over the sample; the driver holds the pattern counts and
one weight vector.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from tillroll.llm.texts import as_text, identified, kind_of, map_batches, raw_texts
from tillroll.session import stored

SAMPLE = 20_000  # texts that fit the scorer, about
BUCKETS = 1 << 16
STEPS = 20
GOOD, BAD, NONE = 0, 1, 2
_SYMBOLS = b"#*$%&|<>=_~^{}[]\\"
_STOPS = frozenset(
    "the of and to in is that it for was on with as be by this from or are at "
    "de la le et les des en un une que du dans el los las y del se por con para "
    "der die und das von zu den mit ist im nicht ein eine auf dem sich".encode().split()
)
_REMEMBERED = 300_000
_ODD = re.compile(rb"[^A-Za-z0-9.,;:?!'()\"\x80-\xff-]").search


@dataclass(frozen=True)
class Measures:
    """Shares that the heuristics and the bucketed features look at."""

    words: int
    symbols: float  # for each word
    capitals: float  # words of two letters or more without a lower-case one
    distinct: float  # words
    runs: float  # words equal to the one before
    repeated_lines: float
    stops: float  # words
    stressed: float  # exclamation and question marks for each word
    odd: float  # words that hold something else than letters, digits, apostrophes, hyphens and sentence marks
    digits: float  # bytes of words


def measure(raw: bytes) -> Measures:
    words = raw.split()
    n = max(1, len(words))
    joined = b"".join(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return Measures(
        words=len(words),
        symbols=(len(joined) - len(joined.translate(None, _SYMBOLS))) / n,
        capitals=sum(len(word) > 1 and word.isupper() for word in words) / n,
        distinct=len(set(words)) / n,
        runs=sum(map(bytes.__eq__, words, words[1:])) / n,
        repeated_lines=1 - len(set(lines)) / max(1, len(lines)),
        stops=sum(map(_STOPS.__contains__, raw.lower().split())) / n,
        stressed=(joined.count(b"!") + joined.count(b"?")) / n,
        odd=sum(map(bool, map(_ODD, words))) / n,
        digits=(len(joined) - len(joined.translate(None, b"0123456789"))) / max(1, len(joined)),
    )


def _vote(value: float, good: float, bad: float) -> int:
    """Good up to the first limit, bad from the second."""
    return GOOD if value <= good else BAD if value >= bad else NONE


def votes(m: Measures) -> tuple[int, ...]:
    """One vote of each heuristic; on texts of few words those about repetition abstain."""
    long = m.words >= 30
    return (
        _vote(m.symbols, 0.02, 0.15),
        _vote(m.capitals, 0.05, 0.4),
        _vote(-m.distinct, -0.35, -0.15) if long else NONE,
        _vote(m.runs, 0.01, 0.1) if long else NONE,
        _vote(m.repeated_lines, 0.05, 0.4) if long else NONE,
        _vote(-m.stops, -0.15, -0.03) if long else NONE,
        _vote(m.stressed, 0.02, 0.3),
        _vote(m.odd, 0.03, 0.25),
        _vote(m.digits, 0.05, 0.4),
    )


HEURISTICS = len(votes(measure(b"")))


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The posterior of bad for each vote pattern, and each heuristic's chance to call a good and a bad text bad.

    Abstaining tells nothing. The start takes a text for bad the more heuristics call it so, since each of them is
    made to notice one kind of bad text. A pseudo-count keeps all chances between 0 and 1.
    """
    bad, cast = (patterns == BAD).astype(float), (patterns != NONE).astype(float)
    posterior = 1 - 0.9 * 0.35 ** bad.sum(axis=1)
    for _ in range(rounds):
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        chances = (weight @ bad + np.array([[0.01], [0.5]])) / (weight @ cast + 1)
        likely = np.log(prior)[:, None] + np.log(chances) @ bad.T + np.log(1 - chances) @ (cast - bad).T
        before, posterior = posterior, 1 / (1 + np.exp(np.clip(likely[0] - likely[1], -700, 700)))
        if np.abs(posterior - before).max() < 1e-9:
            break
    return posterior, chances.T


_LOWER, _UPPER, _DIGIT = re.compile(rb"(?:[a-z]|[\x80-\xff])+"), re.compile(rb"[A-Z]+"), re.compile(rb"[0-9]+")


def shape(word: bytes) -> bytes:
    """The word with its runs of letters and of digits shortened to one."""
    return _DIGIT.sub(b"0", _UPPER.sub(b"A", _LOWER.sub(b"a", word)))


def _bucket(kind: bytes, value: bytes) -> int:
    return xxh32_intdigest(kind + value) % BUCKETS


def bucketed(m: Measures) -> list[int]:
    """Features of the measures, each in a few steps."""
    steps = {
        b"words": np.log2(m.words + 1) // 2,
        b"symbols": min(m.symbols * 10 // 1, 10),
        b"capitals": m.capitals * 5 // 1,
        b"distinct": m.distinct * 10 // 1,
        b"runs": min(m.runs * 20 // 1, 5),
        b"lines": m.repeated_lines * 5 // 1,
        b"stops": m.stops * 20 // 1,
        b"stressed": min(m.stressed * 5 // 1, 5),
    }
    return [_bucket(b"measure:", b"%s=%d" % (name, int(step))) for name, step in steps.items()]


class Hashed(dict):
    """The two buckets of a word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= _REMEMBERED:
            self.clear()
        found = self[word] = (_bucket(b"word:", word.lower()), _bucket(b"shape:", shape(word)))
        return found


def features(raw: bytes, m: Measures, hashed: Hashed) -> tuple[list[int], list[float]]:
    """Buckets and values of a text: shares of its words and shapes, and 1 for each bucketed measure."""
    own = Counter(itertools.chain.from_iterable(map(hashed.__getitem__, raw.split())))
    marks = bucketed(m)
    return [*own, *marks], [*(count / max(1, m.words) for count in own.values()), *[1.0] * len(marks)]


class _WordWeights(dict):
    """The sum of the weights of a word's buckets, remembered for a bounded number of words."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __reduce__(self):
        return _WordWeights, (self.weights,)

    def __missing__(self, word: bytes) -> float:
        if len(self) >= _REMEMBERED:
            self.clear()
        buckets = _bucket(b"word:", word.lower()), _bucket(b"shape:", shape(word))
        found = self[word] = float(sum(self.weights[bucket] for bucket in buckets))
        return found


@dataclass
class Scorer:
    """Chance of bad, from a linear score of hashed features."""

    weights: np.ndarray
    bias: float
    patterns: dict[tuple[int, ...], float] = field(default_factory=dict)

    def __post_init__(self):
        self.words = _WordWeights(self.weights)

    def bad(self, raw: bytes, m: Measures) -> float:
        """A word's share times its weights, added up word by word, and the weights of the measures."""
        own = sum(map(self.words.__getitem__, raw.split())) / max(1, m.words)
        score = own + float(self.weights[bucketed(m)].sum()) + self.bias
        return 1 / (1 + np.exp(-max(-700.0, min(700.0, score))))


def vote_patterns(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The distinct vote patterns of the column text, and how many texts have each."""

    def count(batches):
        for batch in batches:
            found = Counter(votes(measure(raw)) for raw in raw_texts(batch.column(0)))
            patterns = pa.array([list(p) for p in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([patterns, pa.array(found.values(), pa.int64())], ["pattern", "n"])

    rows = texts.mapInArrow(count, "pattern array<int>, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    rows = rows.orderBy("pattern").collect()
    patterns = np.array([row["pattern"] for row in rows], np.int64).reshape(-1, HEURISTICS)
    return patterns, np.array([row["n"] for row in rows], float)


def _features(texts: DataFrame, posterior: dict[tuple[int, ...], float]) -> DataFrame:
    """(label, buckets, values) of each text."""
    shared = texts.sparkSession.sparkContext.broadcast((posterior, Hashed()))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, hashed = shared.value
        labels, buckets, values = [], [], []
        for raw in raw_texts(batch.column(0)):
            m = measure(raw)
            labels.append(known[votes(m)])
            found = features(raw, m, hashed)
            buckets.append(found[0])
            values.append(found[1])
        lists = {"buckets": pa.array(buckets, pa.list_(pa.int32())), "values": pa.array(values, pa.list_(pa.float32()))}
        return pa.RecordBatch.from_pydict({"label": pa.array(labels, pa.float64()), **lists})

    return map_batches(texts, step, "label double, buckets array<int>, values array<float>")


def _gradient(rows: DataFrame, weights: np.ndarray, bias: float) -> tuple[np.ndarray, float, float]:
    """Sums over all rows: the loss gradient by weight and for the bias, and the rows."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, bias))

    def part(batches):
        weights, bias = shared.value
        gradient, rest, seen = np.zeros(BUCKETS), 0.0, 0
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(1)
                buckets = lists.flatten().to_numpy()
                values = batch.column(2).flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                score = np.bincount(owner, weights[buckets] * values, batch.num_rows) + bias
                miss = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - batch.column(0).to_numpy()
                gradient += np.bincount(buckets, miss[owner] * values, BUCKETS)
                rest, seen = rest + miss.sum(), seen + batch.num_rows
        at = np.flatnonzero(gradient)
        yield pa.RecordBatch.from_pydict({"bucket": np.r_[at, -1, -2], "g": np.r_[gradient[at], rest, seen]})

    total = rows.mapInArrow(part, "bucket long, g double").groupBy("bucket").agg(F.sum("g").alias("g")).toArrow()
    sums = dict(zip(total["bucket"].to_pylist(), total["g"].to_pylist()))
    out = np.zeros(BUCKETS)
    rest, seen = sums.pop(-1, 0.0), sums.pop(-2, 0.0)
    out[list(sums)] = list(sums.values())
    return out, rest, seen


def distinct_sample(texts: DataFrame, sample: int) -> DataFrame:
    """About sample of the distinct texts, chosen by their hash; all of them if they are fewer.

    Nulls and empty texts are left out, and copies count once, so that neither fills the sample: however many rows
    hold a text, one row of it is fitted.
    """
    texts = texts.where(F.length("text") > 0).withColumn("place", F.xxhash64("text"))
    distinct = texts.agg(F.approx_count_distinct("place")).first()[0]
    if distinct > sample:
        texts = texts.where(F.pmod("place", F.lit(1 << 30)) < int(sample / distinct * (1 << 30)))
    return texts.groupBy("place").agg(F.first("text").alias("text")).select("text")


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE, steps: int = STEPS) -> Scorer:
    """Votes of all texts, then a scorer fitted on about sample distinct texts, or on all if they are fewer."""
    texts = docs.select(as_text(text).alias("text"))
    patterns, counts = vote_patterns(texts)
    if not len(patterns):
        return Scorer(np.zeros(BUCKETS), 0.0)
    posterior, _ = em(patterns, counts)
    known = {tuple(p): float(x) for p, x in zip(patterns.tolist(), posterior)}
    rows = stored(_features(distinct_sample(texts, sample), known), "labelled")
    weights, bias = np.zeros(BUCKETS), 0.0
    squares, square = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(steps):  # steps shrink with the gradients seen so far
        gradient, rest, seen = _gradient(rows, weights, bias)
        gradient, rest = gradient / max(seen, 1), rest / max(seen, 1)
        squares, square = squares + gradient**2, square + rest**2
        weights, bias = weights - gradient / np.sqrt(squares), bias - rest / np.sqrt(square)
    return Scorer(weights, bias, known)


def quality(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scorer: Scorer | None = None, limit: float = 0.5
) -> DataFrame:
    """(doc_id, votes, weak_bad, bad, kept) for each row of docs.

    votes has one digit for each heuristic (0 good, 1 bad, 2 none); weak_bad is the posterior of bad given the votes,
    bad the scorer's, kept whether that is below the limit. A null text counts as empty. Rows with equal ids or texts
    are each judged; texts are read whole; other columns are left out. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer or train(docs, text))
    source = identified(docs, doc_id, text)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for raw in raw_texts(batch.column(1)):
            m = measure(raw)
            own = votes(m)
            chance = shared.value.bad(raw, m)
            rows.append(("".join(map(str, own)), shared.value.patterns.get(own), chance, chance < limit))
        cast, weak, bad, kept = zip(*rows)
        chances = {"weak_bad": pa.array(weak, pa.float64()), "bad": pa.array(bad, pa.float64())}
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "votes": cast, **chances, "kept": kept})

    return map_batches(source, step, f"doc_id {kind_of(source, 'doc_id')}, votes string, weak_bad double, bad double, kept boolean")
