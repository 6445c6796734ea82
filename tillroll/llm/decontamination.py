"""Benchmark passages in documents, by SimHash of item-sized windows.

A benchmark item of n words is looked for in every run of n words of a document (in the whole document if
that is shorter). Windows whose fingerprint is within RADIUS bits of an item's are found through a
multi-index: fingerprints are cut into blocks, and two that differ in at most RADIUS bits differ in at most
RADIUS // BLOCKS bits of some block. What it finds is verified exactly: the similarity is the sum of the
smaller over the sum of the larger counts of each five-word shingle, 0.8 or more.

A window without any shingle of an item has similarity zero with it, so that only windows around shared
shingles, of the sizes of the items that own them, are fingerprinted. This leaves out nothing: at a
similarity of 0.8 fingerprints differ in 9.7 of 64 bits on average with a deviation of 2.9, and the radius
of 23 is more than four deviations away.

The benchmark is the small side: its distinct texts are cut into blocks of a measured number of bytes, each block's
index is broadcast, and the documents pass by. Only matches are shuffled, to the items that have their text.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tillroll.llm.texts import WORD, WORDS_AT_ONCE, as_text, identified, kind_of, map_batches, raw_texts, slices
from tillroll.session import stored

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS = 8  # of 8 bits
BLOCK_BYTES = 4 << 20  # of benchmark text in one index
BLOCKS_AT_ONCE = 8  # indexes that a task holds
BITMAP_BYTES = 32 << 20  # of one search for candidates
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIXERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_FILTER_BITS = 22

_ARROW = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())

Match = tuple[int, int, int, int, float]  # item, first word, words, distance, similarity


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A mixed 64-bit hash of each run of size words."""
    runs = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for i in range(size):
        runs = runs * _FACTOR + hashes[i : i + len(runs)]
    for shift, mixer in zip((30, 27), _MIXERS):
        runs = (runs ^ (runs >> np.uint64(shift))) * mixer
    return runs ^ (runs >> np.uint64(31))


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """Row i: how many of the first i hashes have each bit."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    return sums


def window_prints(hashes: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of each run of size shingle hashes."""
    sums = _bit_sums(hashes)
    return np.packbits(2 * (sums[size:] - sums[:-size]) > size, axis=1, bitorder="little").view("<u8").ravel()


def weighted_similarity(a: list[bytes], b: list[bytes], size: int) -> float:
    """Jaccard similarity of the shingle counts of two word lists."""
    x, y = (Counter(zip(*(words[i:] for i in range(size)))) for words in (a, b))
    return (x & y).total() / max(1, (x | y).total())


def _texts(column: pa.Array) -> list[list[bytes]]:
    return [raw.lower().split() for raw in raw_texts(column)]


class _Size:
    """The items of one word count, and their fingerprints' blocks."""

    def __init__(self, words: int, items: list[tuple[int, list[bytes]]]):
        self.words, self.shingle = words, min(SHINGLE_WORDS, words)
        self.numbers = [number for number, _ in items]
        self.items = [item for _, item in items]
        grams = [shingles(word_hashes(item), self.shingle) for item in self.items]
        self.prints = np.array([window_prints(g, len(g))[0] for g in grams], np.uint64)
        self.grams = np.unique(np.concatenate(grams))
        # near[block, value]: a bit for each item whose block is close enough to value.
        values = np.arange(256, dtype=np.uint8)
        blocks = self.prints.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
        close = np.bitwise_count(blocks.T[:, None, :] ^ values[None, :, None]) <= RADIUS // BLOCKS
        self.near = np.packbits(close, axis=2, bitorder="little")

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within the radius; a bitmap of BITMAP_BYTES at a time."""
        at_once = max(1, BITMAP_BYTES // self.near.shape[2])
        parts = []
        for start in range(0, max(1, len(prints)), at_once):
            window, *others = self._candidates(prints[start : start + at_once])
            parts.append((window + start, *others))
        return tuple(np.concatenate(columns) for columns in zip(*parts))

    def _candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        blocks = prints.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
        found = self.near[0][blocks[:, 0]]
        for i in range(1, BLOCKS):
            found = found | self.near[i][blocks[:, i]]
        window, item = np.nonzero(np.unpackbits(found, axis=1, count=len(self.items), bitorder="little"))
        distance = np.bitwise_count(prints[window] ^ self.prints[item])
        close = distance <= RADIUS
        return window[close], item[close], distance[close]


class BenchmarkIndex:
    """Finds the given items; one without words matches nothing."""

    def __init__(self, ids: pa.Array, texts: pa.Array):
        self.ids = ids
        by_size = defaultdict(list)
        for number, words in enumerate(_texts(texts)):
            if words:
                by_size[len(words)].append((number, words))
        self.sizes = [_Size(words, own) for words, own in sorted(by_size.items())]
        # For each shingle length the shared shingles, each with the places of the sizes it occurs in.
        self.grams: dict[int, tuple[np.ndarray, list[list[int]], np.ndarray]] = {}
        for length in sorted({size.shingle for size in self.sizes}):
            owners = defaultdict(list)
            for place, size in enumerate(self.sizes):
                if size.shingle == length:
                    for gram in size.grams.tolist():
                        owners[gram].append(place)
            known = np.array(sorted(owners), np.uint64)
            bitmap = np.zeros(1 << _FILTER_BITS, bool)
            bitmap[known & np.uint64(len(bitmap) - 1)] = True
            self.grams[length] = known, [owners[gram] for gram in known.tolist()], bitmap

    def _hits(self, hashes: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By the position of a shared shingle's first word: the places of sizes it occurs in."""
        found: dict[int, list[int]] = defaultdict(list)
        for length, (known, owners, bitmap) in self.grams.items():
            runs = shingles(hashes, length)
            maybe = np.flatnonzero(bitmap[runs & np.uint64(len(bitmap) - 1)])
            place = np.minimum(np.searchsorted(known, runs[maybe]), len(known) - 1)
            for position, k in zip(maybe.tolist(), place.tolist()):
                if known[k] == runs[position]:
                    found[position] += owners[k]
        return found

    def matches(self, texts: list[list[bytes]]) -> list[list[Match]]:
        """The best window of each text for each item it holds."""
        hashes = word_hashes(list(itertools.chain.from_iterable(texts)))
        ends = np.cumsum([len(words) for words in texts])
        hits: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for position, places in sorted(self._hits(hashes).items()):
            text = int(np.searchsorted(ends, position, side="right"))
            for place in places:
                first = position - int(ends[text]) + len(texts[text])
                if first + self.sizes[place].shingle <= len(texts[text]):
                    hits[text][place].append(first)
        out: list[list[Match]] = [[] for _ in texts]
        for text, places in hits.items():
            own = hashes[int(ends[text]) - len(texts[text]) : int(ends[text])]
            best: dict[int, Match] = {}
            for place, firsts in places.items():
                for match in self._verified(texts[text], own, self.sizes[place], firsts):
                    kept = best.get(match[0])
                    if kept is None or (match[4], -match[1]) > (kept[4], -kept[1]):
                        best[match[0]] = match
            out[text] = [best[item] for item in sorted(best)]
        return out

    def _verified(self, words: list[bytes], hashes: np.ndarray, size: _Size, firsts: list[int]):
        """Matches among the windows that hold one of the shared shingles at firsts."""
        width = min(size.words, len(words))
        reach = width - size.shingle
        groups = np.split(np.array(firsts), np.flatnonzero(np.diff(firsts) > reach + 1) + 1)
        for group in groups:
            start = max(0, int(group[0]) - reach)
            stop = min(int(group[-1]), len(words) - width) + 1
            runs = shingles(hashes[start : stop - 1 + width], size.shingle)
            prints = window_prints(runs, width - size.shingle + 1)
            for window, item, distance in zip(*(x.tolist() for x in size.candidates(prints))):
                first = start + window
                similarity = weighted_similarity(words[first : first + width], size.items[item], size.shingle)
                if similarity >= SIMILARITY:
                    yield size.numbers[item], first, width, distance, similarity


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, text, digest); equal texts are one to the search, however many items have them."""
    items = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), as_text(text).alias("text"))
    return items.withColumn("digest", F.sha2("text", 256))


def _indexes(items: DataFrame, block_bytes: int) -> Iterator[BenchmarkIndex]:
    """An index for each block of the distinct texts of the items, a block at a time on the driver.

    A block has about block_bytes of text, as distinct texts are dealt evenly; a single longer text makes it longer.
    """
    texts = items.where(F.length("text") > 0).groupBy("digest").agg(F.first("text").alias("text"))
    texts = stored(texts, "benchmark-texts")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = math.ceil(total / block_bytes)
    for block in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("digest"), F.lit(blocks)) == block).orderBy("digest").toArrow()
        yield BenchmarkIndex(*(column.combine_chunks() for column in rows.columns))


def _found(index: BenchmarkIndex, column: pa.Array) -> list[list[Match]]:
    texts = _texts(column)
    parts = slices([len(words) for words in texts], WORDS_AT_ONCE)
    return [found for part in parts for found in index.matches(texts[part])]


def benchmark_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, item_id, start, end, distance, similarity): the best window for each item a row of docs holds.

    start and end are code points, end exclusive; of equal windows the first counts. Null and empty texts and
    items match nothing. Items of fewer than five words have one shingle, the whole item. Repeated rows of
    docs or benchmark each give rows. Documents are read whole; a single document is held in memory. Other
    columns are left out. An empty table gives an empty table.
    """
    source = identified(docs, doc_id, text)
    schema = f"doc_id {kind_of(source, 'doc_id')}, digest string, start long, end long, distance int, similarity double"
    items = _items(benchmark, item_id, item_text)
    found = source.sparkSession.createDataFrame([], schema)
    for index in _indexes(items, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def step(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            rows: list[tuple] = []
            for row, found in enumerate(_found(shared.value, batch.column(1))):
                spots = [m.span() for m in re.finditer(WORD, batch.column(1)[row].as_py())] if found else []
                for item, first, words, *measured in found:
                    rows.append((row, item, spots[first][0], spots[first + words - 1][1], *measured))
            columns = [pa.array(c, kind) for c, kind in zip(list(zip(*rows)) or [()] * 6, _ARROW)]
            ids = {"doc_id": batch.column(0).take(columns[0]), "digest": shared.value.ids.take(columns[1])}
            return pa.RecordBatch.from_pydict({**ids, **dict(zip(("start", "end", "distance", "similarity"), columns[2:]))})

        found = found.union(map_batches(source, step, schema))
    # Each match goes to all items with its text.
    matches = found.join(items.select("item_id", "digest"), "digest")
    return matches.select("doc_id", "item_id", "start", "end", "distance", "similarity")


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns; edge cases as in benchmark_matches."""
    at = docs.columns.index(text)
    shared_indexes = []
    for index in _indexes(_items(benchmark, item_id, item_text), block_bytes):
        if len(shared_indexes) == BLOCKS_AT_ONCE:
            # The rows that are left are written, so that no task ever holds more indexes than these.
            docs = stored(docs, "uncontaminated")
            while shared_indexes:
                shared_indexes.pop().unpersist()
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def step(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            return batch.filter(pa.array([not found for found in _found(shared.value, batch.column(at))]))

        shared_indexes.append(shared)
        docs = map_batches(docs, step, docs.schema)
    return docs
