"""Language of a text by averaged subword embeddings.

The letters of a text are lowered and read as words. Each word gives its character n-grams, with marks at both ends,
hashed to buckets that have a small vector each; the mean vector of a text goes through a linear softmax. Vectors and
softmax are learned together by stochastic gradient descent in numpy, from a bounded sample of distinct labelled texts
of each language, of which a fifth is kept aside. On that fifth the scores are calibrated: one temperature makes them
probabilities, and the least score is chosen at which the accepted texts are right as often as PRECISION asks.

The sample's n-grams are counted in Spark and a single task learns from them; its work is bounded by SAMPLE texts of at
most BUCKETS counts each. Scoring reads every text once, whole; the model is 65,536 short vectors, broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from tillroll.llm.texts import as_text, kind_of, map_batches, raw_texts, slices

SAMPLE = 4_000  # texts to learn from, of all languages together
BUCKETS = 1 << 16
WIDTH = 16
SIZES = (1, 2, 3, 4)  # characters of an n-gram
STEPS = 1_500
BATCH = 32
RATE = 0.5
PRECISION = 0.98  # of accepted texts
UNKNOWN = "und"
_REMEMBERED = 200_000  # words
_LETTERS = re.compile(r"[^\W\d_]+")
_AT_ONCE = 1 << 16  # characters whose n-grams are made at a time
_STEP, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)  # odd factors of the hash


def n_grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the word, bucket) of all n-grams of the words, size by size for some of the words at a time.

    Places do not fall within one size. A word without a letter has none; a very long one comes in parts, which overlap
    so that no n-gram is lost.
    """
    parts, owners = [], []
    for place, word in enumerate(words):
        if any(map(str.isalpha, word)):
            marked = f"<{word}>"
            for start in range(0, len(marked), _AT_ONCE):
                parts.append(marked[start : start + _AT_ONCE + SIZES[-1] - 1])
                owners.append(place)
    for some in slices([len(part) for part in parts], _AT_ONCE):
        codes = np.frombuffer("".join(parts[some]).encode("utf-32-le"), np.uint32).astype(np.uint64)
        lengths = np.array([len(part) for part in parts[some]])
        part = np.repeat(np.arange(len(lengths)), lengths)
        inside = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        places = np.array(owners[some])[part]
        hashed = np.zeros(len(codes), np.uint64)
        for size in range(1, SIZES[-1] + 1):
            # The hash of an n-gram goes on from that of its first n - 1 characters.
            hashed = hashed[: len(codes) - size + 1] * _STEP + codes[size - 1 :]
            ends = np.arange(size - 1, len(codes))
            # Of a part that is followed by another one, the overlap only ends n-grams.
            whole = (part[ends] == part[ends - size + 1]) & (inside[ends - size + 1] < _AT_ONCE)
            if size in SIZES:
                mixed = (hashed + np.uint64(size)) * _MIX
                yield places[ends][whole], (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)[whole]


def words_of(raw: bytes) -> list[str]:
    return _LETTERS.findall(raw.decode().lower())


class WordSums:
    """How many n-grams the words of texts have and the sums of their vectors; words that come again are remembered."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.counts, self.sums = np.zeros(_REMEMBERED, np.int64), np.zeros((_REMEMBERED, WIDTH))

    def of(self, texts: list[list[str]], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams, sum of their vectors) of each text."""
        counts, sums = np.zeros(len(texts), np.int64), np.zeros((len(texts), WIDTH))
        for i, words in enumerate(texts):
            for start in range(0, len(words), _REMEMBERED // 2):
                some = words[start : start + _REMEMBERED // 2]
                new = [word for word in dict.fromkeys(some) if word not in self.known]
                if len(self.known) + len(new) > _REMEMBERED:
                    self.known.clear()
                    new = list(dict.fromkeys(some))
                self._learn(new, vectors)
                rows = np.fromiter(map(self.known.__getitem__, some), np.int64, len(some))
                counts[i] += self.counts[rows].sum()
                sums[i] += self.sums[rows].sum(axis=0)
        return counts, sums

    def _learn(self, words: list[str], vectors: np.ndarray) -> None:
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words))))
        self.counts[first : first + len(words)] = 0
        self.sums[first : first + len(words)] = 0
        for places, buckets in n_grams(words):
            if len(places):
                starts = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
                rows = first + places[starts]
                self.counts[rows] += np.diff(np.r_[starts, len(places)])
                self.sums[rows] += np.add.reduceat(vectors[buckets], starts, axis=0)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    vectors: np.ndarray  # (BUCKETS, WIDTH)
    weights: np.ndarray  # (WIDTH, languages)
    bias: np.ndarray
    temperature: float
    least_score: float

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        return softmax((means @ self.weights + self.bias) / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def means_of(vectors: np.ndarray, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The mean vector of each text, given as (buckets, counts)."""
    return np.array([counts @ vectors[found] / counts.sum() for found, counts in texts]).reshape(-1, vectors.shape[1])


def learned(languages: list[str], texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit the vectors and the softmax on four fifths of the texts, and calibrate on the others."""
    random = np.random.default_rng(seed)
    aside = np.arange(len(texts)) % 5 == 4
    fit = np.flatnonzero(~aside) if aside.any() else np.arange(len(texts))
    vectors = random.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    for step in range(STEPS):
        rate = RATE * (1 - step / STEPS)
        some = random.choice(fit, BATCH)
        means = means_of(vectors, [texts[i] for i in some])
        error = softmax(means @ weights + bias)
        error[np.arange(BATCH), labels[some]] -= 1
        back = error @ weights.T
        weights -= rate * (means.T @ error) / BATCH
        bias -= rate * error.mean(axis=0)
        for i, slope in zip(some, back):
            found, counts = texts[i]
            # Each bucket of a text moves by its share of the text; a text has each bucket once.
            vectors[found] -= rate * WIDTH * (counts / counts.sum())[:, None] * slope
    kept = np.flatnonzero(aside) if aside.any() else fit
    logits = means_of(vectors, [texts[i] for i in kept]) @ weights + bias
    temperature, least = calibrated(logits, labels[kept])
    return Model(languages, vectors, weights, bias, temperature, least)


def calibrated(logits: np.ndarray, labels: np.ndarray, precision: float = PRECISION) -> tuple[float, float]:
    """The temperature of greatest likelihood, and the least score to accept a text with.

    The texts above it are right with the given precision; it is 0.5 at least, and 1 if no score reaches the precision.
    The labels are smoothed by two more texts, so that a model without a fault is not taken for certain.
    """
    rows = np.arange(len(labels))
    wrong = 1 / (len(labels) + 2)
    wanted = np.full(logits.shape, wrong / max(1, logits.shape[1] - 1))
    wanted[rows, labels] = 1 - wrong
    loss = lambda t: -(wanted * np.log(np.maximum(softmax(logits / t), 1e-300))).sum()
    temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    chances = softmax(logits / temperature)
    scores, right = chances.max(axis=1), chances.argmax(axis=1) == labels
    order = np.argsort(-scores, kind="stable")
    scores, shares = scores[order], np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    # Of texts with equal scores all are accepted or none.
    enough = np.flatnonzero((shares >= precision) & np.r_[scores[1:] != scores[:-1], True])
    if not len(enough):
        return temperature, 1.0
    below = scores[enough[-1] + 1] if enough[-1] + 1 < len(scores) else 0.0
    return temperature, max(0.5, float(scores[enough[-1]] + below) / 2)


def labelled_sample(docs: DataFrame, text: str, label: str, learn_from: Column, size: int) -> DataFrame:
    """(label, text): distinct texts, of each language about as many, at most size together.

    Texts are taken by their hash. A first, generous cut by the number of distinct texts of a language keeps
    the rest out of the shuffle.
    """
    rows = docs.where(learn_from & F.col(f"`{label}`").isNotNull()).select(
        as_text(label).alias("label"), as_text(text).alias("text")
    )
    rows = rows.where(F.length("text") > 0).withColumn("place", F.xxhash64("text"))
    counts = rows.groupBy("label").agg(F.approx_count_distinct("place").alias("n")).collect()
    if not counts:
        return rows.select("label", "text")
    each = max(1, size // len(counts))
    share = {row["label"]: min(1.0, 1.5 * (each + 30) / max(1, row["n"])) for row in counts}
    highest = F.create_map(*[F.lit(x) for name, part in share.items() for x in (name, (part - 0.5) * 2.0**64)])
    first = Window.partitionBy("label").orderBy("place")
    return (
        rows.where(F.col("place") <= F.element_at(highest, F.col("label")))
        .dropDuplicates(["label", "place"])
        .withColumn("nth", F.row_number().over(first))
        .where(F.col("nth") <= each)
        .select("label", "text")
    )


def fit(docs: DataFrame, text: str = "text", label: str = "lang", learn_from: Column | None = None, size: int = SAMPLE) -> Model | None:
    """The model of a sample of the labelled rows; None if none has a label and a letter."""
    sample = labelled_sample(docs, text, label, F.lit(True) if learn_from is None else learn_from, size)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for raw in raw_texts(batch.column(1)):
            words = Counter(words_of(raw))
            times, counts = np.array(list(words.values())), np.zeros(BUCKETS, np.int64)
            for places, buckets in n_grams(list(words)):
                np.add.at(counts, buckets, times[places])
            found.append((np.flatnonzero(counts), counts[counts > 0]))
        return pa.RecordBatch.from_pydict(
            {
                "label": batch.column(0),
                "buckets": pa.array([a for a, _ in found], pa.list_(pa.int64())),
                "counts": pa.array([b for _, b in found], pa.list_(pa.int64())),
            }
        )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, texts = [], []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            for found, counts in zip(batch.column(1), batch.column(2)):
                texts.append((found.values.to_numpy(), counts.values.to_numpy().astype(np.float32)))
        if texts:
            # The order of arrival must not matter.
            order = sorted(range(len(texts)), key=lambda i: xxh32_intdigest(texts[i][0].tobytes() + texts[i][1].tobytes()))
            languages = sorted(set(labels))
            model = learned(
                languages, [texts[i] for i in order], np.array([languages.index(labels[i]) for i in order])
            )
            numbers = [model.vectors, model.weights, model.bias]
            yield pa.RecordBatch.from_pydict(
                {
                    "languages": pa.array([languages], pa.list_(pa.string())),
                    "numbers": pa.array([[a.astype(np.float32).tobytes() for a in numbers]], pa.list_(pa.binary())),
                    "temperature": [model.temperature],
                    "least_score": [model.least_score],
                }
            )

    counted = map_batches(sample, count, "label string, buckets array<long>, counts array<long>")
    made = (
        counted.where(F.size("buckets") > 0)
        .repartition(1)
        .mapInArrow(learn, "languages array<string>, numbers array<binary>, temperature double, least_score double")
        .first()
    )
    if made is None:
        return None
    vectors, weights, bias = (np.frombuffer(bytes(raw), np.float32) for raw in made["numbers"])
    return Model(
        list(made["languages"]),
        vectors.reshape(BUCKETS, WIDTH),
        weights.reshape(WIDTH, -1),
        bias,
        made["temperature"],
        made["least_score"],
    )


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, accepted) for each row of docs, from its text alone.

    lang_pred is the likeliest language and score its calibrated probability; accepted tells whether the score reaches
    the model's least one. A null or empty text, or one without a letter, is UNKNOWN with score 0 and not accepted, and
    so is every text where nothing could be learned. Rows with equal ids or texts each get a row. Texts of any
    length are read whole. Other columns are left out. An empty table gives an empty table.
    """
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), as_text(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    remembered = WordSums()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, rows = shared.value, batch.num_rows
        names, scores = [UNKNOWN] * rows, np.zeros(rows)
        if model is not None:
            counts, sums = remembered.of(list(map(words_of, raw_texts(batch.column(1)))), model.vectors)
            some = np.flatnonzero(counts)
            chances = model.probabilities(sums[some] / counts[some, None])
            scores[some] = chances.max(axis=1, initial=0)
            for i, best in zip(some, chances.argmax(axis=1)):
                names[i] = model.languages[best]
        accepted = (scores >= model.least_score) & (np.array(names) != UNKNOWN) if model else np.zeros(rows, bool)
        return pa.RecordBatch.from_pydict(
            {"doc_id": batch.column(0), "lang_pred": names, "score": scores, "accepted": accepted}
        )

    schema = f"doc_id {kind_of(source, 'doc_id')}, lang_pred string, score double, accepted boolean"
    return map_batches(source, step, schema)
