"""Language identification: held-out accuracy, the parts against plain versions, calibration."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pytest
from folders import MIDDLE, SMALL
from pyspark.sql import functions as F

from tillroll.llm import language
from tillroll.llm.queries import QUERIES


@pytest.mark.parametrize(("folder", "least"), [(SMALL, 0.97), (MIDDLE, 0.99)])
def test_held_out_accuracy(spark, folder, least):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = QUERIES["op11_language_id"](spark, folder).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(row["held_out"] == (crc32(str(row["doc_id"]).encode()) % 4 == 2) for row in rows)
    assert all(0 <= row["score"] <= 1 for row in rows)
    unseen = [row for row in rows if row["held_out"]]
    assert sum(row["lang"] == row["lang_pred"] for row in unseen) >= least * len(unseen)
    accepted = [row for row in unseen if row["accepted"]]
    assert len(accepted) >= 0.9 * len(unseen)
    assert sum(row["lang"] == row["lang_pred"] for row in accepted) >= language.PRECISION * len(accepted)


def test_held_out_rows_labels_and_other_columns_are_no_input(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.fit(docs, learn_from=~held_out)
    spoiled = docs.withColumn("lang", F.when(held_out, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("zz"))
    other = language.fit(spoiled.repartition(3), learn_from=~held_out)
    assert model.languages == other.languages
    assert np.array_equal(model.vectors, other.vectors) and model.temperature == other.temperature
    found = {r["doc_id"]: r["score"] for r in language.predict(docs, model).collect()}
    again = {r["doc_id"]: r["score"] for r in language.predict(spoiled.drop("lang"), other).collect()}
    assert found == again


def bucket_of(gram):
    value = 0
    for c in gram:
        value = (value * 0x100000001B3 + ord(c)) % 2**64
    return ((value + len(gram)) * 0x9E3779B97F4A7C15 % 2**64) >> 48


def grams(word):
    marked = f"<{word}>" if any(map(str.isalpha, word)) else ""
    return [marked[i : i + n] for n in language.SIZES for i in range(len(marked) - n + 1)]


def found_grams(words):
    return sorted((p, b) for places, buckets in language.n_grams(words) for p, b in zip(places.tolist(), buckets.tolist()))


@pytest.mark.parametrize("at_once", [3, 7, 1 << 16])
def test_n_grams_of_words(monkeypatch, at_once):
    """However many characters are read at a time, a long word included."""
    monkeypatch.setattr(language, "_AT_ONCE", at_once)
    words = ["añb", "²", "x", "中文字", "", "Ⅷ", "abcdefghij" * 5, "𝐀b"]
    assert found_grams(words) == sorted((i, bucket_of(g)) for i, word in enumerate(words) for g in grams(word))
    assert not found_grams([]) and not found_grams(["12"])


def test_sums_are_those_of_all_words(monkeypatch):
    monkeypatch.setattr(language, "_REMEMBERED", 8)
    vectors = np.random.default_rng(1).random((language.BUCKETS, language.WIDTH))
    sums = language.WordSums()
    texts = [["one", "two", "one", "²"], [f"w{i}" for i in range(50)] + ["one"], [], ["three", "one"]]
    for _ in range(2):
        counts, totals = sums.of(texts, vectors)
        for words, count, total in zip(texts, counts, totals):
            wanted = [bucket_of(g) for word in words for g in grams(word)]
            assert count == len(wanted) and np.allclose(total, vectors[wanted].sum(axis=0))


def test_a_text_without_a_letter_is_unknown(spark):
    model = language.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))
    rows = [(1, None), (2, ""), (3, "12 34 -- ²³ Ⅷ _"), (4, "\n"), (5, "the and of"), (6, "中")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert all(found[i][1:] == ("und", 0.0, False) for i in (1, 2, 3, 4))
    assert found[5]["lang_pred"] == "en" and found[6]["lang_pred"] in model.languages


def test_nothing_to_learn_from(docs):
    found = language.predict(docs([(1, "words")]), language.fit(docs([(1, "words"), (2, None)]), label="ids", learn_from=F.lit(False)))
    assert [tuple(r) for r in found.collect()] == [(1, "und", 0.0, False)]
    assert language.fit(docs([]), label="ids") is None


def test_sample_is_bounded_under_nulls_and_copies(spark):
    rows = [(i, None if i % 3 == 0 else "the same" if i % 3 == 1 else f"text {i}", "ab"[i % 2]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.labelled_sample(docs, "text", "lang", F.lit(True), 200).collect()
    assert len(sample) == 200 and len({tuple(r) for r in sample}) == 200
    assert sum(r["label"] == "a" for r in sample) == 100


def test_calibration():
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 3, 5000)
    logits = rng.normal(0, 1, (5000, 3))
    logits[np.arange(5000), labels] += 1.5
    temperature, least = language.calibrated(logits * 4, labels, 0.95)
    chances = language.softmax(logits * 4 / temperature)
    # Within each band of scores as many are right as the scores tell.
    scores, right = chances.max(axis=1), chances.argmax(axis=1) == labels
    for low in (0.4, 0.6, 0.8):
        band = (scores >= low) & (scores < low + 0.2)
        assert abs(scores[band].mean() - right[band].mean()) < 0.06
    assert 0.945 <= right[scores >= least].mean() < 0.97
    assert language.calibrated(logits, (labels + 1) % 3, 0.999)[1] == 1.0
