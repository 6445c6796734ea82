"""Which tokens of two tokenizers end together, and how often each pair does so in the whole corpus.

Both tokenizers spell the bytes of a space and the text. Where a token of either ends at the same byte, their ids are
linked, and the byte offsets of all links cut the tokens into groups. A pair's count is its links in the whole corpus.

Counting is external. A task reads its texts once and radix-partitions its (pair, document) records by the second id;
whenever it holds RECORDS links, they are counted by document and each part is sorted by second id, first id and document (side-major) and leaves as
a zstd run, with a much smaller run of the part's pair counts beside it. Both are written as a table in the shared
folder, so that a lost executor costs no second reading of the texts and document numbers stay what they were.

The count runs of a part then meet in a k-way heap merge, FAN runs at a time until one is left, so that neither a
frequent token nor a large corpus lands in one task: what is merged is pairs, not their occurrences. As the merge is
side-major, the largest count of a second id is known when the merge leaves it. Last, the counts are sent to the runs
of their part, each run streams its documents' sums back, and these are added up by document.

A text is cut before each single space between two other characters. Neither tokenizer joins what lies on two sides
of such a cut (the first splits there by its pattern, no piece of the second has its space marker after another
character), so that a repeated unit is tokenized once and a giant text never whole.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import os
import re
import struct
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.texts import BYTES_AT_ONCE, identified, kind_of, slices
from tillroll.session import stored

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
RADIX = 32  # parts of the second ids
RECORDS = 4_000_000  # links that a task holds before it writes runs
FAN = 64  # count runs merged at once
RUNS_PER_SLOT = 64  # runs of a part that meet one copy of its counts
REMEMBERED = 150_000  # units, twice
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPAN = re.compile(r"<0x([0-9A-F]{2})>")
_LONG = 256  # characters of a unit that is read together with others
_TOGETHER = 1 << 14  # characters of units read together
_TEXTS = 1 << 18  # bytes of texts whose units are looked up together
# Fixed value: how byte-level tokenizers cut a text before they merge.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Unit(NamedTuple):
    """What both tokenizers make of one unit."""

    first: int  # tokens of the first
    second: int
    groups: str
    pairs: list[int]  # packed links
    whole: bool  # whether both give its bytes back


class Tokenizers:
    """Both tokenizers, with the bytes of each of their ids."""

    def __init__(self, byte_level: str = BYTE_LEVEL, pieces: str = PIECES):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        with open(byte_level, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ranks = {bytes(letters[c] for c in entry): i for entry, i in model["vocab"].items() if set(entry) <= set(letters)}
        if any(ranks[bytes(letters[c] for c in "".join(merge).replace(" ", ""))] != 256 + i for i, merge in enumerate(model["merges"])):
            raise ValueError("the ids do not follow the merges, so that they are no ranks")
        # The name of a special entry is ordinary text here, so it has no rank.
        ranks = {entry: i for entry, i in ranks.items() if i < 256 + len(model["merges"])}
        self.a_fast = tiktoken.Encoding("byte-level", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = {i: entry for entry, i in ranks.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("a piece goes on after a space, so that texts cannot be cut at spaces")
        self.b_bytes = dict(enumerate(map(self._spelled, names)))
        self.a_sizes, self.b_sizes = (
            np.array([len(of.get(i, b"")) for i in range(max(of) + 1)]) for of in (self.a_bytes, self.b_bytes)
        )
        self.names = list(map(str, range(max(len(self.a_sizes), len(self.b_sizes)))))
        self.known: dict[str, Unit] = {}
        self.older: dict[str, Unit] = {}

    @staticmethod
    def _spelled(piece: str) -> bytes:
        byte = _SPAN.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def units(self, parts: list[str]) -> list[Unit]:
        """The unit of each part; a space before it is understood."""
        if len(self.known) > REMEMBERED:
            # What was met since the last time stays, the rest goes.
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = [part for part in dict.fromkeys(parts) if part not in known]
        if older:
            known.update((part, older[part]) for part in new if part in older)
            new = [part for part in new if part not in known]
        # Units that neither begin nor end with a space can be read as one text, and cut again.
        plain = [part for part in new if len(part) <= _LONG and part and not part[0].isspace() and not part[-1].isspace()]
        for some in slices([len(part) for part in plain], _TOGETHER):
            known.update(zip(plain[some], self._spelled_units(plain[some])))
        for part in new:
            if part not in known:
                first = self.a.encode(" " + part, add_special_tokens=False).ids
                known[part] = self._cut(first, self.b.encode(part), [b" " + part.encode()])[0]
        return [known[part] for part in parts]

    def _spelled_units(self, parts: list[str]) -> list[Unit]:
        text = " ".join(parts)
        raws = [b" " + part.encode() for part in parts]
        return self._cut(self.a_fast.encode_ordinary(" " + text), self.b.encode(text), raws)

    def _cut(self, first: list[int], second: list[int], raws: list[bytes]) -> list[Unit]:
        """The units out of the ids of all of them, one after the other."""
        raw = b"".join(raws)
        if b"".join(map(self.a_bytes.__getitem__, first)) != raw or b"".join(map(self.b_bytes.__getitem__, second)) != raw:
            if len(raws) == 1:
                return [Unit(0, 0, "", [], False)]
            # One of them is not given back; which one shows when each is read alone.
            return [unit for one in raws for unit in self._spelled_units([one[1:].decode()])]
        a, b = np.array(first, np.int64), np.array(second, np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        cuts, at_a, at_b = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        pairs = (b[at_b] << 32 | a[at_a]).tolist()
        first_names, second_names = [self.names[i] for i in first], [self.names[i] for i in second]
        groups, i, j = [], 0, 0
        for to_i, to_j in zip((at_a + 1).tolist(), (at_b + 1).tolist()):
            if to_i - i == 1 and to_j - j == 1:
                groups.append(f"{first_names[i]}|{second_names[j]}")
            else:
                groups.append(f"{','.join(first_names[i:to_i])}|{','.join(second_names[j:to_j])}")
            i, j = to_i, to_j
        # Every unit ends at a cut: its last one.
        last = np.searchsorted(cuts, np.cumsum([len(one) for one in raws]))
        units, start, i, j = [], 0, 0, 0
        for stop, to_i, to_j in zip((last + 1).tolist(), (at_a[last] + 1).tolist(), (at_b[last] + 1).tolist()):
            units.append(Unit(to_i - i, to_j - j, ";".join(groups[start:stop]), pairs[start:stop], True))
            start, i, j = stop, to_i, to_j
        return units


@functools.cache
def tokenizers(byte_level: str, pieces: str) -> Tokenizers:
    """One pair of tokenizers for each Python worker."""
    return Tokenizers(byte_level, pieces)


def aligned(texts: list[str | None], both: Tokenizers) -> Iterator[list[Unit]]:
    """The units of each text; none if it is null or empty, or if either tokenizer does not give its bytes back."""
    parts = [_CUT.split(text) if text else [] for text in texts]
    flat, units = list(itertools.chain.from_iterable(parts)), []
    for some in slices([len(part) for part in flat], BYTES_AT_ONCE):
        units += both.units(flat[some])
    at = 0
    for own in parts:
        found = units[at : at + len(own)]
        at += len(own)
        # A unit that is not whole cannot be made up for by another one: both only ever change characters in their place.
        yield found if all(unit[-1] for unit in found) else []


_PACKED = struct.Struct("<q")


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as a zstd block."""
    return zstandard.ZstdCompressor(level=1).compress(
        _PACKED.pack(len(arrays[0])) + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    )


def _unsqueezed(block: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    count, at, out = _PACKED.unpack_from(raw)[0], _PACKED.size, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    return out


def _steps(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted keys, which squeeze better."""
    return np.diff(keys, prepend=0)


def _pair_run(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return _squeezed(_steps(keys), counts)


def _read_pairs(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = _unsqueezed(block, np.int64, np.int64)
    return np.cumsum(steps), counts


class Spill:
    """The links of the documents that a task holds, as runs of (pair, document) records once there are many."""

    def __init__(self, radix: int):
        self.radix, self.run = radix, 0
        self.links, self.ends = [], []

    @property
    def held(self) -> int:
        return len(self.links)

    def add(self, pairs: Iterable[list[int]]) -> int:
        """Take the links of a document, unit by unit; returns its number in the run."""
        self.links.extend(itertools.chain.from_iterable(pairs))
        self.ends.append(len(self.links))
        return len(self.ends) - 1

    def runs(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(part, run of records, run of pair counts) of what is held, which is then let go."""
        links, ends = np.fromiter(self.links, np.int64, len(self.links)), self.ends
        self.run += 1
        self.links, self.ends = [], []
        second, first = links >> 32, links & 0xFFFFFFFF
        documents = np.repeat(np.arange(len(ends)), np.diff([0, *ends]))
        # One number that sorts by part, second id, first id and document; a part has every radix-th second id.
        seconds, firsts = int(second.max(initial=0)) // self.radix + 1, int(first.max(initial=0)) + 1
        order = ((second % self.radix * seconds + second // self.radix) * firsts + first) * len(ends) + documents
        order.sort()
        starts = np.flatnonzero(np.r_[True, order[1:] != order[:-1]]) if len(order) else np.zeros(0, np.int64)
        times = np.diff(np.r_[starts, len(order)])
        pairs, documents = np.divmod(order[starts], len(ends))
        second, first = np.divmod(pairs, firsts)
        parts, second = np.divmod(second, seconds)
        keys = (second * self.radix + parts) << 32 | first
        edges = np.searchsorted(parts, np.arange(self.radix + 1))
        for part, (start, stop) in enumerate(zip(edges[:-1], edges[1:])):
            if start == stop:
                continue
            some, counts = keys[start:stop], times[start:stop]
            heads = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
            lengths = np.diff(np.r_[heads, len(some)])
            # The pairs are stored once each, with the number of records that follow for them.
            records = zstandard.ZstdCompressor(level=1).compress(
                _PACKED.pack(len(heads))
                + _steps(some[heads]).tobytes()
                + lengths.astype(np.int32).tobytes()
                + documents[start:stop].astype(np.int32).tobytes()
                + np.minimum(counts, 255).astype(np.uint8).tobytes()
                + counts[counts >= 255].tobytes()
            )
            yield part, records, _pair_run(some[heads], np.add.reduceat(counts, heads))


def read_records(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct pairs, records of each, documents, counts) of a run of records, in side-major order."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    pairs, at = _PACKED.unpack_from(raw)[0], _PACKED.size
    keys = np.cumsum(np.frombuffer(raw, np.int64, pairs, at))
    lengths = np.frombuffer(raw, np.int32, pairs, at + 8 * pairs)
    at, total = at + 12 * pairs, int(lengths.sum())
    documents = np.frombuffer(raw, np.int32, total, at)
    counts = np.frombuffer(raw, np.uint8, total, at + 4 * total).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, np.int64, -1, at + 5 * total)
    return keys, lengths, documents, counts


def _cursor(block: bytes) -> Iterator[tuple[int, int]]:
    keys, counts = _read_pairs(block)
    return zip(keys.tolist(), counts.tolist())


def merged(blocks: list[bytes]) -> bytes:
    """One run of pair counts out of several, by a k-way heap merge."""
    if len(blocks) == 1:
        return blocks[0]
    keys, counts = [], []
    for key, count in heapq.merge(*map(_cursor, blocks)):
        if keys and keys[-1] == key:
            counts[-1] += count
        else:
            keys.append(key)
            counts.append(count)
    return _pair_run(np.array(keys, np.int64), np.array(counts, np.int64))


def with_maxima(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, counts, whether the count is the highest of its second id) of a whole part."""
    keys, counts = _read_pairs(block)
    second = keys >> 32
    firsts = np.flatnonzero(np.r_[True, second[1:] != second[:-1]])
    highest = np.maximum.reduceat(counts, firsts)
    return keys, counts, counts == np.repeat(highest, np.diff(np.r_[firsts, len(keys)]))


def _encoded(source: DataFrame, radix: int, records: int, byte_level: str, pieces: str) -> DataFrame:
    """Rows of two kinds: a document with its own figures, or a run of a part (part is null in the first)."""
    figures = "run long, number int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    runs = "part int, records binary, counts binary"
    # The same columns as Arrow types; that of the id is the one it comes with.
    kinds = {"run": pa.int64(), "number": pa.int32()}
    kinds |= dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), pa.int64())
    kinds |= {"groups_sha256": pa.string(), "part": pa.int32(), "records": pa.binary(), "counts": pa.binary()}

    def rows(ids: pa.Array, **columns: list) -> pa.RecordBatch:
        made = {name: pa.array(columns.get(name, [None] * len(ids)), kind) for name, kind in kinds.items()}
        return pa.RecordBatch.from_pydict({"doc_id": ids, **made})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, spill = tokenizers(byte_level, pieces), Spill(radix)
        base = TaskContext.get().partitionId() << 32
        for batch in batches:
            start, found = 0, []

            def documents(stop: int) -> pa.RecordBatch:
                names = ("number", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
                columns = dict(zip(names, map(list, zip(*found))))
                return rows(batch.column(0).slice(start, stop - start), run=[base + spill.run] * len(found), **columns)

            # Some texts at a time become Python strings, or a single long one.
            sizes = [size or 0 for size in pc.binary_length(batch.column(1)).to_pylist()]
            texts = (batch.column(1)[some].to_pylist() for some in slices(sizes, _TEXTS))
            for i, units in enumerate(itertools.chain.from_iterable(aligned(some, both) for some in texts)):
                first, second, groups, pairs, _ = zip(*units) if units else ((),) * 5
                before, number, digest = spill.held, spill.add(pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()
                links = spill.held - before
                found.append((number, sum(first), sum(second), links, links, digest if units else ""))
                if spill.held >= records:
                    yield documents(i + 1)
                    start, found = i + 1, []
                    yield from closed(base, spill, batch)
            if found:
                yield documents(batch.num_rows)
        if spill.held:
            yield from closed(base, spill, batch)

    def closed(base: int, spill: Spill, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        no_id = pa.nulls(1, batch.column(0).type)
        run = base + spill.run
        for part, block, counts in spill.runs():
            yield rows(no_id, run=[run], part=[part], records=[block], counts=[counts])

    return source.mapInArrow(encode, f"doc_id {kind_of(source, 'doc_id')}, {figures}, {runs}")


def _merged_parts(runs: DataFrame, radix: int, fan: int) -> DataFrame:
    """(part, counts): one count run for each part, by rounds of merges of at most about fan runs."""
    largest = runs.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    runs = runs.select("part", F.xxhash64("run").alias("place"), "counts")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by group: a group's blocks are held together, and nothing else.
        key, blocks = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([key[0]], pa.int32()),
                    "place": pa.array([key[1]], pa.int64()),
                    "counts": pa.array([merged(blocks)], pa.binary()),
                }
            )

        for batch in batches:
            for part, place, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (part, place) != key:
                    if blocks:
                        yield out()
                    key, blocks = (part, place), []
                blocks.append(counts)
        if blocks:
            yield out()

    while True:
        groups = -(-largest // fan)
        # Each round leaves a part with one run per group; the last has a single group.
        runs = runs.select("part", F.pmod("place", F.lit(max(1, groups))).alias("place"), "counts")
        tasks = max(1, min(groups, 1 << 14)) * radix
        runs = runs.repartition(tasks, "part", "place").sortWithinPartitions("part", "place")
        runs = runs.mapInArrow(merge, "part int, place long, counts binary")
        if groups <= 1:
            return runs.select("part", "counts")
        runs = stored(runs.select("part", F.xxhash64("place").alias("place"), "counts"), "merged-counts")
        largest = groups


def token_alignment(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    byte_level: str = BYTE_LEVEL,
    pieces: str = PIECES,
    radix: int = RADIX,
    records: int = RECORDS,
    fan: int = FAN,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of docs.

    n_best counts the links whose pair is as frequent in the whole corpus as any pair of its second id, count_sum adds
    the counts of all links. groups_sha256 digests the groups, `a1,a2|b1;a3|b2,b3` in order.

    A null or empty text, or one whose bytes a tokenizer does not give back (a space marker U+2581 becomes a space),
    has no tokens: zeros, and '' for the digest. Rows with equal ids or texts each count. Texts of any length are read
    whole. Other columns are left out. An empty table gives an empty table.
    """
    source = identified(docs, doc_id, text)
    spilled = stored(_encoded(source, radix, records, byte_level, pieces), "alignment")
    documents = spilled.where("part IS NULL").drop("part", "records", "counts")
    runs = spilled.where("part IS NOT NULL")
    counts = stored(_merged_parts(runs.select("run", "part", "counts"), radix, fan), "pair-counts")

    # A part's counts go to as many slots as its runs need, so that no part is one task's work.
    most = runs.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    slots = max(1, -(-most // RUNS_PER_SLOT))
    copies = counts.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    dealt = runs.select("run", "part", "records", F.pmod(F.xxhash64("run"), F.lit(slots)).cast("int").alias("slot"))

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, block, known in zip(*(batch.column(i) for i in range(3))):
                keys, lengths, documents, times = read_records(block.as_py())
                pairs, totals, best = with_maxima(known.as_py())
                at = np.searchsorted(pairs, keys)
                total, is_best = np.repeat(totals[at], lengths), np.repeat(best[at], lengths)
                size = int(documents.max()) + 1
                sums, bests = np.zeros(size, np.int64), np.zeros(size, np.int64)
                np.add.at(sums, documents, times * total)
                np.add.at(bests, documents, times * is_best)
                some = np.flatnonzero(sums)
                yield pa.RecordBatch.from_pydict(
                    {
                        "run": pa.array(np.full(len(some), run.as_py(), np.int64)),
                        "number": pa.array(some.astype(np.int32)),
                        "n_best": pa.array(bests[some]),
                        "count_sum": pa.array(sums[some]),
                    }
                )

    shares = (
        dealt.join(copies, ["part", "slot"])
        .select("run", "records", "counts")
        .mapInArrow(contribute, "run long, number int, n_best long, count_sum long")
        .groupBy("run", "number")
        .agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    )
    return documents.join(shares, ["run", "number"], "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"),
        F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"),
        "groups_sha256",
    )
