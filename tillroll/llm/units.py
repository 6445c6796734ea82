"""Repeated lines, paragraphs or sentences, removed but for their earliest occurrence.

A unit is a line, a paragraph between blank lines, or a sentence: text up to a full stop, question or exclamation mark
or line break. It is compared by a strong digest of its words, lowered A-Z and joined by single spaces; units of few
words are left alone. Occurrences are ranked by document id, then by the digest of the text, then by place. Each unit
that occurs more than once keeps its first occurrence.

A passage that documents share lies inside lines that differ elsewhere, and a short stock sentence is no passage. With
run_words, repeats are therefore removed only where neighbouring ones have that many words together.

One Arrow pass finds the units; only digests and places are shuffled. Digests that occur once never reach the join,
and a digest that a third of all documents hold is one row on the other side of it; the few digests with more than
a thousandth of all units meet them by broadcast, so that no task gets all their places. At the end each text meets
the places to remove in one shuffle by id.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.texts import identified, kind_of, map_batches
from tillroll.session import stored

LEAST_WORDS = 5  # of a line or paragraph
SENTENCE_WORDS = 3  # of a sentence
RUN_WORDS = 30  # of neighbouring repeated sentences
# A digest with more than this part of all units is hot, so that there are fewer hot ones than that.
HOT = 1000
_BREAKS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n(?:[\x20\x09-\x0D]*\n)+")}
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+[\x20\x09-\x0D]*|[^.!?\n]+")


def units(text: str, unit: str = "line") -> list[tuple[int, int, int]]:
    """(start, end, end with the break behind it) of each unit in code points, blank ones too."""
    if unit == "sentence":
        return [(*m.span(), m.end()) for m in _SENTENCE.finditer(text)]
    found, start = [], 0
    for m in _BREAKS[unit].finditer(text):
        found.append((start, m.start(), m.end()))
        start = m.end()
    return [*found, (start, len(text), len(text))]


def words_of(unit: str) -> list[bytes]:
    return unit.encode().lower().split()


def occurrences(docs: DataFrame, doc_id: str, text: str, unit: str, least_words: int) -> DataFrame:
    """(doc_id, own, start, stop, place, words, digest) of each unit of least_words or more.

    own is a digest of the text, place counts these units of a text, words those of the unit.
    """
    source = identified(docs, doc_id, text).select("doc_id", F.xxhash64("text").alias("own"), "text")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, found = [], []
        for i, value in enumerate(batch.column(2).to_pylist()):
            place = 0
            for start, end, stop in units(value or "", unit):
                words = words_of((value or "")[start:end])
                if len(words) >= least_words:
                    row.append(i)
                    found.append((start, stop, place, len(words), hashlib.sha256(b" ".join(words)).digest()[:16]))
                    place += 1
        take = pa.array(row, pa.int64())
        texts = {"doc_id": batch.column(0).take(take), "own": batch.column(1).take(take)}
        kinds = {"start": pa.int64(), "stop": pa.int64(), "place": pa.int64(), "words": pa.int64(), "digest": pa.binary()}
        columns = zip(*found) if found else [()] * len(kinds)
        return pa.RecordBatch.from_pydict({**texts, **{n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns)}})

    schema = f"doc_id {kind_of(source, 'doc_id')}, own long, start long, stop long, place long, words long, digest binary"
    return map_batches(source, step, schema)


def later_occurrences(found: DataFrame) -> DataFrame:
    """All occurrences but the first of each digest, given a stored table of them."""
    total = found.count()
    first = found.groupBy("digest").agg(F.min(_rank()).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stored(first, "first-places")
    # Fewer than HOT rows, whatever the input: their counts are parts of the total.
    hot = F.broadcast(first.where(F.col("n") * HOT > total).select("digest", "first"))
    others = first.where(F.col("n") * HOT <= total).select("digest", "first")
    cold = found.join(hot, "digest", "left_anti").join(others, "digest")
    return found.join(hot, "digest").unionByName(cold).where(_rank() != F.col("first")).drop("first")


def removed_spans(repeats: list[dict], run_words: int) -> list[tuple[int, int]]:
    """(start, stop) of what goes: each repeat or, with run_words, each run of neighbours that have as many."""
    spans, before = [], None
    for unit in repeats:
        if run_words and before is not None and unit["place"] == before + 1:
            spans[-1] = (spans[-1][0], unit["stop"], spans[-1][2] + unit["words"])
        else:
            spans.append((unit["start"], unit["stop"], unit["words"]))
        before = unit["place"]
    return [(start, stop) for start, stop, words in spans if words >= run_words]


def _rank() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "own", "start")


def without_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    unit: str = "line",
    least_words: int = LEAST_WORDS,
    run_words: int = 0,
) -> DataFrame:
    """(doc_id, text, removed, n_removed) for each row of docs.

    text has lost the repeated units with the breaks behind them; removed lists their places in the original
    text, code points, end exclusive, break included. With run_words, neighbouring repeats are one place, from the
    first to the last of them, and only go if they have as many words together; units of fewer than least_words are no
    neighbours and go with a run that encloses them. A null text stays null, null ids rank last. Rows with equal
    ids and texts count as one document, and are treated alike. Texts are read whole; other columns are left out.
    An empty table gives an empty table.
    """
    found = stored(occurrences(docs, doc_id, text, unit, least_words), "units")
    repeats = F.array_sort(F.collect_set(F.struct("place", "start", "stop", "words")))
    places = later_occurrences(found).groupBy("doc_id", "own").agg(repeats.alias("repeats"))
    places = places.withColumnRenamed("doc_id", "place_id").withColumnRenamed("own", "place_own")
    source = identified(docs, doc_id, text)
    same = F.col("doc_id").eqNullSafe(F.col("place_id")) & (F.xxhash64("text") == F.col("place_own"))
    joined = source.join(places, same, "left")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, lists, counts = [], [], []
        for value, repeats in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            spans, parts, end = removed_spans(repeats or [], run_words), [], 0
            for start, stop in spans:
                parts.append(value[end:start])
                end = stop
            texts.append("".join((*parts, value[end:])) if parts else value)
            lists.append(",".join(f"{start}:{stop}" for start, stop in spans))
            counts.append(len(spans))
        found = {"removed": pa.array(lists, pa.string()), "n_removed": pa.array(counts, pa.int64())}
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string()), **found})

    schema = f"doc_id {kind_of(source, 'doc_id')}, text string, removed string, n_removed long"
    return map_batches(joined.select("doc_id", "text", "repeats"), step, schema)
