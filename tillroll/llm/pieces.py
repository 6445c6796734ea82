"""Pieces of texts by a SentencePiece model, and their decoding.

What the scores of a model mean is a matter of its type. Those of a BPE model, as the given one, order its merges
(``MergeModel``): a text, with one space put before it, is cut into characters, and as long as neighbours make up
a piece, the pair with the highest score is joined, of equal ones the first. These are the ids of the sentencepiece
library. Those of a unigram model are log-probabilities (``PieceModel``): the text is cut into the pieces with the
largest sum; of equal sums at a position the longer last piece counts. In both a character without a piece becomes
its UTF-8 byte pieces, so that decoding gives every text back exactly. A marker U+2581 in a text is such a character,
where the library takes it for a space.

No piece goes on past a space that follows another character, so a text falls into units there. The distinct
units of a batch are segmented together: all of them merge a pair at once, or walk the trie and the lattice at once,
a position at a time.

A giant document is cut into chunks of a fixed length, wherever that falls. A chunk yields a matrix, for each state
at its start and its end the best score between them. Max-plus products of these matrices are associative, and a scan
of them gives the states of the best path at all boundaries; with these, each chunk is traced back by itself.

For the largest sum a state is how many characters the piece that crosses the boundary takes of the chunk behind it.
Where two paths through a boundary have equal scores, the one that takes fewer characters past it counts.

Merges are a path too: of all ways to cut a unit into pieces, exactly one has only pieces that their own characters
merge to and only neighbours that, merged together, stay these two; it is what merging the whole unit gives. Such a
pair weighs 0 and any other minus infinity. A state is the piece that holds the last character before the boundary.
A unit that begins inside a chunk is a place that every path goes through, so that a matrix takes a walk over the
ends of the chunk alone, or over all of it where a text has no space for so long.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import math
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tillroll.llm.texts import identified, kind_of, map_batches, slices
from tillroll.session import stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 32_768  # characters
CHARACTERS_AT_ONCE = 100_000  # of distinct units
UNKNOWN_PENALTY = 10.0
NEVER = -math.inf
LONG_UNIT = 64  # characters, from which on a unit is merged by itself
NO_RANK = 1 << 30
_UNIT = re.compile(r"(?<=[^ ]) ")


class _Children:
    """The trie's edges as a hash table of (node, character) to node, looked up for many keys at once."""

    def __init__(self, edges: dict[tuple[int, int], int]):
        self.bits = max(10, (4 * len(edges)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.nodes = np.full(1 << self.bits, -1, np.int32)
        left = np.array([node << 21 | character for node, character in edges], np.int64)
        nodes = np.array(list(edges.values()), np.int32)
        slots = self._slots(left)
        while len(left):  # each round puts one key in each free slot; the others try the next slot
            free = self.keys[slots] < 0
            _, first = np.unique(np.where(free, slots, -1), return_index=True)
            put = np.zeros(len(left), bool)
            put[first] = True
            put &= free
            self.keys[slots[put]], self.nodes[slots[put]] = left[put], nodes[put]
            left, nodes, slots = left[~put], nodes[~put], self._next(slots[~put])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, slots: np.ndarray) -> np.ndarray:
        return (slots + 1) & (len(self.keys) - 1)

    def find(self, nodes: np.ndarray, characters: np.ndarray) -> np.ndarray:
        """The child of each node by its character, -1 where there is none."""
        keys = nodes.astype(np.int64) << 21 | characters
        found = np.full(len(keys), -1, np.int32)
        at, slots = np.arange(len(keys)), self._slots(keys)
        while len(at):
            there = self.keys[slots]
            same = there == keys[at]
            found[at[same]] = self.nodes[slots[same]]
            again = ~same & (there >= 0)
            at, slots = at[again], self._next(slots[again])
        return found


class PieceModel:
    """Pieces, their scores, and the best segmentation of strings. A space in it stands for the marker U+2581."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: list[int] | None, unknown_id: int):
        self.scores = {piece: score for piece, score, _ in pieces}
        self.reach = max(map(len, self.scores), default=1)
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.byte_ids, self.unknown_id = byte_ids, unknown_id
        # A node is [children by character, score and id of the piece that ends there, if any].
        self.trie: dict[str, list] = {}
        for piece, score, number in pieces:
            below, node = self.trie, None
            for character in piece:
                node = below.setdefault(character, [{}, None, None])
                below = node[0]
            node[1:] = score, number
        self._spelling(pieces)
        self._index(pieces)

    def _spelling(self, pieces: list[tuple[str, float, int]]) -> None:
        """Where units end, and the bytes of each id."""
        self.splits = not any(" " in piece.lstrip(" ") for piece, *_ in pieces)
        self.lines = not any("\n" in piece and len(piece) > 1 for piece, *_ in pieces)
        self.raw = {number: piece.encode() for piece, _, number in pieces}
        self.raw |= {number: bytes([byte]) for byte, number in enumerate(self.byte_ids or [])}

    def _index(self, pieces: list[tuple[str, float, int]]) -> None:
        """Number the trie's nodes for walks of many strings; a node has the score and id of its piece, if any."""
        edges: dict[tuple[int, int], int] = {}
        ends = {}
        for piece, score, number in pieces:
            node = 0
            for character in map(ord, piece):
                node = edges.setdefault((node, character), len(edges) + 1)
            ends[node] = score, number
        self.children = _Children(edges)
        self.node_score = np.full(len(edges) + 1, NEVER)
        self.node_id = np.full(len(edges) + 1, -1, np.int32)
        for node, (score, number) in ends.items():
            self.node_score[node], self.node_id[node] = score, number

    @classmethod
    def load(cls, path: str = MODEL) -> PieceModel:
        """Read a SentencePiece model file on the driver."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        numbers = range(model.get_piece_size())
        special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        normal = [i for i in numbers if not any(test(i) for test in special)]
        pieces = [(model.id_to_piece(i).replace("▁", " "), model.get_score(i), i) for i in normal]
        spells = any(map(model.is_byte, numbers))
        byte_ids = [model.piece_to_id(f"<0x{byte:02X}>") for byte in range(256)] if spells else None
        return cls(pieces, byte_ids, model.unk_id())

    def edges(self, text: str, start: int) -> list[tuple[int, float, int | None]]:
        """(end, score, id) of the pieces from start; id is None for a character that has none."""
        below, found = self.trie, []
        for end in range(start, len(text)):
            node = below.get(text[end])
            if node is None:
                break
            below, score, number = node
            if score is not None:
                found.append((end + 1, score, number))
        if not found or found[0][0] != start + 1:
            found.append((start + 1, self.unknown, None))
        return found

    def _spelled(self, character: str) -> list[int]:
        return [self.byte_ids[byte] for byte in character.encode()] if self.byte_ids else [self.unknown_id]

    def path(self, text: str) -> tuple[float, tuple[int, ...]]:
        """The best score and its ids."""
        trie, unknown, reach = self.trie, self.unknown, self.reach
        best, back = [NEVER] * (len(text) + 1), [(0, None)] * (len(text) + 1)
        best[0] = 0.0
        for start in range(len(text)):
            here, below, alone = best[start], trie, True
            for end, character in enumerate(text[start : start + reach], start + 1):
                node = below.get(character)
                if node is None:
                    break
                below, score, number = node
                if score is not None:
                    if end == start + 1:
                        alone = False
                    if here + score > best[end]:
                        best[end], back[end] = here + score, (start, number)
                if not below:
                    break
            if alone and here + unknown > best[start + 1]:
                best[start + 1], back[start + 1] = here + unknown, (start, None)
        ids: list[int] = []
        end = len(text)
        while end:
            start, number = back[end]
            if number is None:
                ids += self._spelled(text[start])[::-1]
            else:
                ids.append(number)
            end = start
        return best[-1], tuple(ids[::-1])

    def segments(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each unit the best score and the number of ids, and the ids of all one after the other."""
        parts = [self._segments([])]  # for the types, where there are no units
        parts += [self._segments(units[part]) for part in slices([len(unit) for unit in units], CHARACTERS_AT_ONCE)]
        return tuple(np.concatenate(column) for column in zip(*parts))

    def _lattice(self, characters: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, length, score, id) of all pieces in units, ordered by length; left is the room behind each place.

        A character without a piece has id -1.
        """
        at, nodes = np.arange(len(characters)), np.zeros(len(characters), np.int32)
        edges, length = [], 0
        while len(at):
            nodes = self.children.find(nodes, characters[at + length])
            length += 1
            going = nodes >= 0
            whole = going & (self.node_id[np.maximum(nodes, 0)] >= 0)
            starts, scores, ids = at[whole], self.node_score[nodes[whole]], self.node_id[nodes[whole]]
            if length == 1:
                alone = at[~whole]
                starts = np.r_[starts, alone]
                scores = np.r_[scores, np.full(len(alone), self.unknown)]
                ids = np.r_[ids, np.full(len(alone), -1, np.int32)]
            edges.append((starts, np.full(len(starts), length), scores, ids))
            going &= left[at] > length
            at, nodes = at[going], nodes[going]
        return tuple(np.concatenate(column) for column in zip(*edges))

    def _segments(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(unit) for unit in units], np.int64)
        if not sizes.any():
            return np.zeros(len(units)), np.zeros(len(units), np.int64), np.zeros(0, np.int32)
        characters = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(units)), sizes)
        place = np.arange(len(characters)) - begins[owner]
        starts, lengths, scores, ids = self._lattice(characters, sizes[owner] - place)
        order = np.argsort(place[starts], kind="stable")
        starts, lengths, scores, ids = starts[order], lengths[order], scores[order], ids[order]
        bounds = np.searchsorted(place[starts], np.arange(int(sizes.max(initial=0)) + 1))
        # Places of the lattice: one more than characters in each unit. Edges from one place end at different ones.
        sources = starts + owner[starts]
        targets = sources + lengths
        best = np.full(len(characters) + len(units), NEVER)
        back = np.zeros(len(best), np.int64)
        best[begins + np.arange(len(units))] = 0.0
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            reached = best[sources[low:high]] + scores[low:high]
            better = np.flatnonzero(reached > best[targets[low:high]])
            best[targets[low:high][better]] = reached[better]
            back[targets[low:high][better]] = low + better
        return self._backtraced(units, sizes, begins, best, back, sources, ids, characters)

    def _backtraced(self, units, sizes, begins, best, back, sources, ids, characters):
        ends = begins + sizes + np.arange(len(units))
        which, at = np.flatnonzero(sizes), ends[sizes > 0]
        first = begins + np.arange(len(units))
        whose, found = [], []
        while len(which):
            edge = back[at]
            whose.append(which)
            # An unknown character stands as the complement of its code point until it is spelled.
            found.append(np.where(ids[edge] >= 0, ids[edge], ~characters[sources[edge] - which]))
            at = sources[edge]
            more = at > first[which]
            which, at = which[more], at[more]
        whose, found = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (whose, found))
        order = np.argsort(whose[::-1], kind="stable")
        whose, found = whose[::-1][order], found[::-1][order]
        if (found < 0).any():
            spelled = [[number] if number >= 0 else self._spelled(chr(~number)) for number in found.tolist()]
            whose = np.repeat(whose, [len(x) for x in spelled])
            found = np.fromiter(itertools.chain.from_iterable(spelled), np.int64, len(whose))
        return best[ends], np.bincount(whose, minlength=len(units)), found.astype(np.int32)

    def sequences(self, texts: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each list of units the score and the number of ids, and all ids; equal units are segmented once."""
        numbers: dict[str, int] = {}
        row, ends = array("q"), array("q", [0])
        for units in texts:
            row.extend([numbers.setdefault(unit, len(numbers)) for unit in units])
            ends.append(len(row))
        scores, counts, ids = self.segments(list(numbers))
        row, ends = np.array(row), np.array(ends)
        lengths = counts[row]
        total = np.r_[0, np.cumsum(lengths)]
        sums = np.r_[0.0, np.cumsum(scores[row])]
        places = np.arange(total[-1]) + np.repeat((np.cumsum(counts) - counts)[row] - total[:-1], lengths)
        return sums[ends[1:]] - sums[ends[:-1]], total[ends[1:]] - total[ends[:-1]], ids[places]

    def units(self, text: str) -> list[str]:
        """text cut before each space that follows another character, and around line feeds."""
        if not self.splits:
            return [text]
        words = text.split(" ")
        if "" in words[1:]:
            words = self._with_spaces(words)
        else:
            words = [" " + word for word in words]
            words[0] = words[0][1:]
        if not self.lines or "\n" not in text:
            return words
        out: list[str] = []
        for word in words:
            if "\n" in word:
                first, *rest = word.split("\n")
                out.append(first)
                for part in rest:
                    out += ("\n", part)
            else:
                out.append(word)
        return out

    @staticmethod
    def _with_spaces(words: list[str]) -> list[str]:
        out, spaces = [words[0]], 0
        for word in words[1:]:
            spaces += 1
            if word:
                out.append(" " * spaces + word)
                spaces = 0
        return [*out, " " * spaces]

    def encode(self, text: str) -> list[int]:
        """Ids of a text; none for an empty one."""
        return self.segment(" " + text) if text else []

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space put before it. Ids of no piece and bytes that are no UTF-8 show as U+FFFD."""
        raw = b"".join([self.raw.get(number, b"\xef\xbf\xbd") for number in ids])
        return raw.decode("utf-8", "replace").removeprefix(" ")

    # Chunks. A chunk's text goes on for up to reach - 1 characters past its end, for the piece that crosses it.

    def chunks(self, text: str, length: int) -> list[str]:
        text = " " + text
        return [text[start : start + length + self.reach - 1] for start in range(0, len(text), length)]

    def _forward(self, text: str, end: int, rows: np.ndarray) -> np.ndarray:
        """From rows of scores at the first positions, those at end and the positions behind it."""
        best = np.full((len(text) + 1 + self.reach, rows.shape[0]), NEVER)
        best[: rows.shape[1]] = rows.T
        for start in range(end):
            if best[start].max() > NEVER:
                for stop, score, _ in self.edges(text, start):
                    np.maximum(best[stop], best[start] + score, out=best[stop])
        return best[end : end + self.reach].T

    def cuts(self, text: str, length: int) -> tuple[int, int] | None:
        """The first and the last cut between units that all paths through a chunk of length characters meet."""
        places = range(self.reach, min(length, len(text))) if self.splits else ()
        cut = lambda i: text[i] == " " != text[i - 1]
        first = next(filter(cut, places), None)
        return None if first is None else (first, next(filter(cut, reversed(places))))

    def measure(self, texts: list[str], length: int) -> list[tuple[np.ndarray, str, np.ndarray, str | None, int]]:
        """Of each chunk the transfer matrix, the text before its cuts, the ids between them, the text behind, and
        where in this the chunk ends.

        The matrix has the best scores between the states at the start (rows) and at the end (columns). Between
        the cuts a path does not depend on the states. Without a cut the first text is all, and there is no other.
        """
        cuts = [self.cuts(text, length) for text in texts]
        inner = [self.units(text[slice(*cut)]) if cut else [] for text, cut in zip(texts, cuts)]
        scores, counts, ids = self.sequences(inner)
        middles = np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []
        start = np.where(np.eye(self.reach) > 0, 0.0, NEVER)
        out = []
        for text, cut, score, middle in zip(texts, cuts, scores.tolist(), middles):
            end = min(length, len(text))
            if cut is None:
                out.append((self._forward(text, end, start), text, middle, None, end))
                continue
            first, last = cut
            head = self._forward(text[:first], first, start)[:, 0] + score
            tail = self._forward(text[last:], end - last, np.zeros((1, 1)))[0]
            out.append((head[:, None] + tail[None, :], text[:first], middle, text[last:], end - last))
        return out

    def segment(self, text: str, entry: int = 0, leave: int | None = None) -> list[int]:
        """Ids of the best pieces of text between two positions."""
        return list(itertools.chain.from_iterable(self.path(unit)[1] for unit in self.units(text[entry:leave])))

    def finish(self, head: str, tail: str | None, end: int, entry: int, leave: int) -> tuple[list[int], list[int]]:
        """Ids of a measured chunk's pieces before and behind its cuts, from the state entry to the state leave."""
        if tail is None:
            return self.segment(head, entry, end + leave), []
        return self.segment(head, entry), self.segment(tail, 0, end + leave)


class MergeModel(PieceModel):
    """Pieces joined from pairs in the order of their scores, as a BPE model's are. The scores do not add up."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: list[int] | None, unknown_id: int):
        self.byte_ids, self.unknown_id = byte_ids, unknown_id
        self._spelling(pieces)
        # A symbol is a piece by its place in pieces, or behind them a character that only longer pieces have.
        names = [piece for piece, *_ in pieces]
        names += sorted(set("".join(names)) - set(names))
        number = {name: i for i, name in enumerate(names)}
        self.symbol_id = np.full(len(names), -1, np.int32)
        self.symbol_id[: len(pieces)] = [i for *_, i in pieces]
        ranks = np.unique([-score for _, score, _ in pieces], return_inverse=True)[1]
        self.rank = np.r_[ranks, np.full(len(names) - len(pieces), NO_RANK), NO_RANK]  # the last for no symbol
        single = sorted((ord(name), i) for name, i in number.items() if len(name) == 1)
        self.characters, self.character_symbols = (np.array(x, np.int64) for x in zip(*single))
        pairs = {}
        for piece, *_ in pieces:
            for cut in range(1, len(piece)):
                left, right = number.get(piece[:cut]), number.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = number[piece]
        self.pairs = _Children(pairs)
        self.number, self.reach = number, max(map(len, names), default=1)
        # What was found out about pieces and pairs of them.
        self.stays: dict[str, bool] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def _symbols(self, characters: np.ndarray) -> np.ndarray:
        """The symbol of each code point, -1 for one that no piece has."""
        at = np.minimum(np.searchsorted(self.characters, characters), len(self.characters) - 1)
        return np.where(self.characters[at] == characters, self.character_symbols[at], -1)

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that each pair makes up, -1 for none."""
        found = np.full(len(left), -1, np.int64)
        known = (left >= 0) & (right >= 0)
        found[known] = self.pairs.find(left[known], right[known])
        return found

    def _segments(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As of PieceModel, with scores of 0."""
        sizes = np.array([len(unit) for unit in units], np.int64)
        if not sizes.any():
            return np.zeros(len(units)), np.zeros(len(units), np.int64), np.zeros(0, np.int32)
        characters = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").astype(np.int64)
        symbols, owner = self._symbols(characters), np.repeat(np.arange(len(units)), sizes)
        begins, long = np.cumsum(sizes) - sizes, sizes >= LONG_UNIT
        done = []  # (place of the first character, symbol) of what stays
        for unit in np.flatnonzero(long).tolist():
            part = slice(begins[unit], begins[unit] + sizes[unit])
            places, merged = self._merged_alone(symbols[part])
            done.append((places + begins[unit], merged))
        places = np.flatnonzero(~long[owner])
        done += self._merged(places, symbols[places], owner[places])
        places, symbols = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(places)
        places, symbols = places[order], symbols[order]
        ids = np.where(symbols >= 0, self.symbol_id[symbols], -1)
        whose = owner[places]
        if (ids < 0).any():
            spelled = [
                [number] if number >= 0 else self._spelled(chr(character))
                for number, character in zip(ids.tolist(), characters[places].tolist())
            ]
            whose = np.repeat(whose, [len(x) for x in spelled])
            ids = np.fromiter(itertools.chain.from_iterable(spelled), np.int64, len(whose))
        return np.zeros(len(units)), np.bincount(whose, minlength=len(units)), ids.astype(np.int32)

    def _merged(self, places, symbols, owner) -> list[tuple[np.ndarray, np.ndarray]]:
        """Join a pair in each unit at a time, until none is left in any."""
        done = []
        following = np.r_[owner[1:] == owner[:-1], np.zeros(min(1, len(owner)), bool)]
        joined = np.full(len(symbols), -1, np.int64)  # what a symbol makes up with the next one
        at = np.flatnonzero(following)
        joined[at] = self._joined(symbols[at], symbols[at + 1])
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(self.rank[joined] << 32 | np.arange(len(joined)), first)
            going = best >> 32 < NO_RANK
            keep = np.repeat(going, np.diff(np.r_[first, len(owner)]))
            done.append((places[~keep], symbols[~keep]))
            at = best[going] & 0xFFFFFFFF
            symbols[at] = joined[at]
            keep[at + 1] = False
            moved = np.cumsum(keep)[at] - 1
            places, symbols, owner, joined = places[keep], symbols[keep], owner[keep], joined[keep]
            changed = np.unique(np.r_[moved, moved[moved > 0] - 1])
            inside = changed < len(owner) - 1
            inside[inside] = owner[changed[inside]] == owner[changed[inside] + 1]
            joined[changed] = -1
            changed = changed[inside]
            joined[changed] = self._joined(symbols[changed], symbols[changed + 1])
        return done

    def _merged_alone(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, symbol) of what stays of one unit, whose pairs wait in a heap."""
        joined = self._joined(symbols[:-1], symbols[1:])
        heap = [(rank, i, i + 1, new) for i, (rank, new) in enumerate(zip(self.rank[joined].tolist(), joined.tolist())) if new >= 0]
        heapq.heapify(heap)
        size, now = len(symbols), symbols.tolist()
        last, following, changes = list(range(-1, size - 1)), list(range(1, size + 1)), [0] * size
        heap = [(*entry, 0, 0) for entry in heap]
        cache: dict[tuple[int, int], int] = {}
        while heap:
            _, left, right, new, *then = heapq.heappop(heap)
            if [changes[left], changes[right]] != then:
                continue  # one of the two has been joined since
            now[left], changes[left], changes[right] = new, changes[left] + 1, -1
            following[left] = after = following[right]
            if after < size:
                last[after] = left
            for a, b in ((last[left], left), (left, after)):
                if a >= 0 and b < size:
                    pair = now[a], now[b]
                    if pair not in cache:
                        cache[pair] = int(self._joined(np.array([pair[0]]), np.array([pair[1]]))[0])
                    if cache[pair] >= 0:
                        heapq.heappush(heap, (int(self.rank[cache[pair]]), a, b, cache[pair], changes[a], changes[b]))
        stays = np.flatnonzero(np.array(changes) >= 0)
        return stays, np.array(now, np.int64)[stays]

    def path(self, text: str) -> tuple[float, tuple[int, ...]]:
        _, _, ids = self.segments([text])
        return 0.0, tuple(ids.tolist())

    def chunks(self, text: str, length: int) -> list[str]:
        """Parts of length characters, each with as many characters around it as a piece can reach over its ends."""
        text = " " + text
        return [text[max(0, at - self.reach) : at + length + self.reach] for at in range(0, len(text), length)]

    def solid(self, piece: str) -> bool:
        """Whether merging the piece's characters gives the piece; a single character always stays."""
        if piece not in self.stays:
            self.stays[piece] = len(piece) == 1 or self._alone(piece) == [self.number.get(piece)]
        return self.stays[piece]

    def follows(self, left: str, right: str) -> bool:
        """Whether merging the characters of both pieces gives just these two."""
        pair = left, right
        if pair not in self.fits:
            symbols = [self.number.get(left, -1), self.number.get(right, -1)]
            self.fits[pair] = -1 in symbols or self._alone(left + right) == symbols
        return self.fits[pair]

    def _alone(self, text: str) -> list[int]:
        return self._merged_alone(self._symbols(np.array(list(map(ord, text)), np.int64)))[1].tolist()

    def ends(self, text: str, start: int) -> list[int]:
        """Where the pieces end that can begin at start."""
        found = [start + 1]
        for end in range(start + 2, min(start + self.reach, len(text)) + 1):
            if text[start:end] in self.number and self.solid(text[start:end]):
                found.append(end)
        return found

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """(start, end) of the pieces that can hold the character before at, the same from both chunks that meet there."""
        starts = range(max(0, at - self.reach), at)
        return [(start, end) for start in starts for end in self.ends(text, start) if end >= at]

    def walk(self, text: str, sources: list[tuple[int, int]], stop: int) -> tuple[dict[int, dict[int, int]], dict]:
        """Follow pairs that fit from the sources to all pieces that begin before stop.

        For each end and start of a piece, the set of sources that lead to it, as bits; and for each piece one before it.
        """
        sets: dict[int, dict[int, int]] = {}
        for i, (start, end) in enumerate(sources):
            sets.setdefault(end, {})[start] = 1 << i
        before = {}
        for at in range(min(sets, default=stop), stop):
            if at not in sets:
                continue
            for end in self.ends(text, at):
                whole = 0
                for start, found in sets[at].items():
                    # A source that begins where it ends stands for the begin of a unit, which fits any piece.
                    if found & ~whole and (start == at or self.follows(text[start:at], text[at:end])):
                        whole |= found
                        before[at, end] = start, at
                if whole:
                    sets.setdefault(end, {})[at] = whole
        return sets, before

    def unit_begins(self, text: str, start: int, stop: int) -> tuple[int, int] | None:
        """The first and the last place between start and stop at which a unit begins; None without one."""
        first = 0 if start == 0 else None
        if first is None and self.splits and (found := _UNIT.search(text, start, stop)):
            first = found.start()
        if first is None:
            return None
        last = text.rfind(" ", first + 1, stop)
        while last > first and text[last - 1] == " ":
            last = text.rfind(" ", first + 1, last)
        return first, max(first, last) if self.splits else first

    def body(self, text: str, part: int, length: int) -> tuple[int, int, bool]:
        """Where a chunk begins and stops in its text, and whether it is the last one."""
        start = self.reach if part else 0
        return start, min(start + length, len(text)), start + length >= len(text)

    def matrix(self, text: str, part: int, length: int) -> np.ndarray:
        """From each state at the chunk's start to each at its stop: 0 where pieces that fit lead there, else NEVER."""
        start, stop, last = self.body(text, part, length)
        entries = self.states(text, start) if part else [(0, 0)]
        leaves = self.states(text, stop)
        begins = self.unit_begins(text, start, stop)
        if begins is None:
            sets, _ = self.walk(text, entries, stop)
            found = [sets.get(end, {}).get(begin, 0) for begin, end in leaves]
        else:
            # Every path goes through the begin of a unit: in by the head, out by the tail.
            first, final = begins
            sets, _ = self.walk(text, entries, first)
            into = functools.reduce(int.__or__, sets.get(first, {}).values(), 0)
            sets, _ = self.walk(text, [(final, final)], stop)
            found = [into if sets.get(end, {}).get(begin, 0) else 0 for begin, end in leaves]
        if last:
            found = [functools.reduce(int.__or__, found, 0)]
        return np.array([[0.0 if sources >> i & 1 else NEVER for sources in found] for i in range(len(entries))])

    def finish(self, text: str, part: int, length: int, entry: int, leave: int) -> list[int]:
        """Ids of the pieces that begin in a chunk, between the states at its ends."""
        start, stop, last = self.body(text, part, length)
        source = self.states(text, start)[entry] if part else (0, 0)
        leaves = self.states(text, stop)
        targets = leaves if last else [leaves[leave]]
        begins = self.unit_begins(text, start, stop)
        if begins is None:
            return self._traced(text, source, targets, stop)
        first, final = begins
        head = self._traced(text, source, [(at, first) for at in range(max(0, first - self.reach), first + 1)], first)
        middle = self.sequences([self.units(text[first:final])])[2].tolist()
        return head + middle + self._traced(text, (final, final), targets, stop)

    def _traced(self, text: str, source: tuple[int, int], targets: list[tuple[int, int]], stop: int) -> list[int]:
        """Ids of the pieces from behind the source to the target that it leads to."""
        sets, before = self.walk(text, [source], stop)
        reached = [target for target in targets if sets.get(target[1], {}).get(target[0])]
        if not reached:
            raise ValueError("no pieces that fit lead through a chunk")
        at, found = reached[0], []
        while at != source:
            found.append(at)
            at = before[at]
        ids = []
        for begin, end in reversed(found):
            symbol = self.number.get(text[begin:end], -1)
            known = symbol >= 0 and self.symbol_id[symbol] >= 0
            ids += [int(self.symbol_id[symbol])] if known else self._spelled(text[begin])
        return ids


def load_model(path: str = MODEL) -> PieceModel:
    """The model of a file, by its type."""
    from sentencepiece.sentencepiece_model_pb2 import ModelProto, TrainerSpec

    proto = ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    kinds = {TrainerSpec.BPE: MergeModel, TrainerSpec.UNIGRAM: PieceModel}
    if proto.trainer_spec.model_type not in kinds:
        raise ValueError("only BPE and unigram models are known")
    return kinds[proto.trainer_spec.model_type].load(path)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of two stacks of matrices."""
    return (a[:, :, :, None] + b[:, None, :, :]).max(axis=2)


def scan(matrices: np.ndarray) -> np.ndarray:
    """The products of the first 1, 2, ... matrices, in as many steps as their count has binary digits."""
    out, step = matrices.copy(), 1
    while step < len(out):
        out[step:] = product(out[:-step], out[step:])
        step *= 2
    return out


def boundary_states(matrices: np.ndarray) -> np.ndarray:
    """The states of the best path at the starts of all chunks, and 0 at the end."""
    reached = scan(matrices)[:, 0, :]
    states = np.zeros(len(matrices) + 1, np.int64)
    for i in range(len(matrices) - 1, 0, -1):
        states[i] = np.argmax(reached[i - 1] + matrices[i][:, states[i + 1]])
    return states


def _lists(rows: Iterable) -> pa.Array:
    return pa.array(rows, pa.list_(pa.int32()))


def _cut(docs: DataFrame, model, chunk: int) -> DataFrame:
    """(digest, part, text) of the chunks of each distinct text of docs (text, digest)."""

    def cut(batches):
        for batch in batches:
            for text, digest in zip(batch.column(0), batch.column(1)):
                parts = model.value.chunks(text.as_py(), chunk)
                for at in range(0, len(parts), 256):
                    some = parts[at : at + 256]
                    numbers = np.arange(at, at + len(some))
                    yield pa.RecordBatch.from_pydict({"digest": [digest.as_py()] * len(some), "part": numbers, "text": some})

    parts = docs.mapInArrow(cut, "digest string, part long, text string")
    return parts.groupBy("digest", "part").agg(F.first("text").alias("text"))  # equal texts are one


def _whole(coded: DataFrame) -> DataFrame:
    """(digest, ids) of texts whose parts have (digest, part, ids)."""
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "ids"))), lambda part: part["ids"]))
    return coded.groupBy("digest").agg(whole.alias("ids"))


def _giant_merged(docs: DataFrame, model, chunk: int) -> DataFrame:
    """(digest, ids) for each distinct text of docs (text, digest), by merges."""

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.value.matrix(text, part, chunk) for part, text in zip(*(batch.column(i).to_pylist() for i in (1, 2)))]
        return pa.RecordBatch.from_pydict(
            {
                "digest": batch.column(0),
                "part": batch.column(1),
                "text": batch.column(2),
                "entries": [len(matrix) for matrix in found],
                "matrix": [matrix.ravel() for matrix in found],
            }
        )

    def states(table):
        table = table.sort_by("part")
        found = [np.array(m).reshape(n, -1) for m, n in zip(table["matrix"].to_pylist(), table["entries"].to_pylist())]
        size = max(max(m.shape) for m in found)
        matrices = np.full((len(found), size, size), NEVER)
        for whole, matrix in zip(matrices, found):
            whole[: matrix.shape[0], : matrix.shape[1]] = matrix
        at = boundary_states(matrices)
        return pa.table({"digest": table["digest"], "part": table["part"], "entry": at[:-1], "leave": at[1:]})

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = (batch.column(i).to_pylist() for i in (2, 1, 3, 4))
        rows = [model.value.finish(text, part, chunk, entry, leave) for text, part, entry, leave in zip(*columns)]
        return pa.RecordBatch.from_pydict({"digest": batch.column(0), "part": batch.column(1), "ids": _lists(rows)})

    schema = "digest string, part long, text string, entries long, matrix array<double>"
    parts = stored(map_batches(_cut(docs, model, chunk), measure, schema), "chunks")
    of_text = parts.select("digest", "part", "entries", "matrix").groupBy("digest")
    at = of_text.applyInArrow(states, "digest string, part long, entry long, leave long")
    joined = parts.join(at, ["digest", "part"]).select("digest", "part", "text", "entry", "leave")
    return _whole(map_batches(joined, finish, "digest string, part long, ids array<int>"))


def _giant(docs: DataFrame, model, reach: int, chunk: int) -> DataFrame:
    """(digest, ids) for each distinct text of docs (text, digest), by the largest sum."""

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        matrices, heads, middles, tails, ends = zip(*model.value.measure(batch.column(2).to_pylist(), chunk))
        found = {"matrix": [m.ravel() for m in matrices], "head": heads, "middle": _lists(middles)}
        found |= {"tail": pa.array(tails, pa.string()), "end": pa.array(ends, pa.int64())}
        return pa.RecordBatch.from_pydict({"digest": batch.column(0), "part": batch.column(1), **found})

    def states(table):
        table = table.sort_by("part")
        matrices = table["matrix"].combine_chunks().flatten().to_numpy().reshape(-1, reach, reach)
        found = boundary_states(matrices)
        return pa.table({"digest": table["digest"], "part": table["part"], "entry": found[:-1], "leave": found[1:]})

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        middles, *others = batch.columns[2:]
        rows = []
        for middle, *ends in zip(middles, *(column.to_pylist() for column in others)):
            first, last = (np.array(ids, np.int32) for ids in model.value.finish(*ends))
            rows.append(np.concatenate([first, middle.values.to_numpy(), last]))
        return pa.RecordBatch.from_pydict({"digest": batch.column(0), "part": batch.column(1), "ids": _lists(rows)})

    schema = "digest string, part long, matrix array<double>, head string, middle array<int>, tail string, end long"
    parts = stored(map_batches(_cut(docs, model, chunk), measure, schema), "chunks")
    of_text = parts.select("digest", "part", "matrix").groupBy("digest")
    at = of_text.applyInArrow(states, "digest string, part long, entry long, leave long")
    joined = parts.join(at, ["digest", "part"])
    joined = joined.select("digest", "part", "middle", "head", "tail", "end", "entry", "leave")
    return _whole(map_batches(joined, finish, "digest string, part long, ids array<int>"))


def encode(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    model: PieceModel | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """(doc_id, ids, decoded_sha256) for each row of docs; the digest is that of the text the ids give back.

    A null text has null ids and no digest, an empty one no ids. Rows with equal ids or texts are each encoded.
    Texts of chunk characters or more are cut into chunks, equal ones once. Other columns are left out. An empty
    table gives an empty table.
    """
    model = model or load_model()
    merges = isinstance(model, MergeModel)
    if chunk < model.reach:
        raise ValueError(f"a chunk has at least {model.reach} characters")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = identified(docs, doc_id, text)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, texts = shared.value, batch.column(1)
        _, counts, ids = model.sequences(model.units(" " + text.as_py()) if text.as_py() else [] for text in texts)
        nulls = texts.is_null().to_numpy(zero_copy_only=False)
        ends = np.r_[0, np.cumsum(counts)].astype(np.int32)
        digests = [
            None if null else hashlib.sha256(model.decode(ids[a:b].tolist()).encode()).hexdigest()
            for a, b, null in zip(ends[:-1].tolist(), ends[1:].tolist(), nulls.tolist())
        ]
        lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.r_[nulls, False]), pa.array(ids))
        found = {"ids": lists, "decoded_sha256": pa.array(digests, pa.string())}
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **found})

    long = F.coalesce(F.length("text"), F.lit(0)) >= chunk  # with the space before it, more than one chunk
    short = map_batches(source.where(~long), step, f"doc_id {kind_of(source, 'doc_id')}, ids array<int>, decoded_sha256 string")
    giants = source.where(long).withColumn("digest", F.sha2("text", 256))
    distinct = giants.select("text", "digest")
    coded = _giant_merged(distinct, shared, chunk) if merges else _giant(distinct, shared, model.reach, chunk)
    coded = decode(coded, model=model)
    coded = giants.select("doc_id", "digest").join(coded, "digest")
    return short.union(coded.select("doc_id", "ids", F.sha2("decoded", 256).alias("decoded_sha256")))


def decode(coded: DataFrame, ids: str = "ids", name: str = "decoded", model: PieceModel | None = None) -> DataFrame:
    """coded with one more column, the text of ids; null for null."""
    model = model or load_model()
    shared = coded.sparkSession.sparkContext.broadcast(model)
    at = coded.columns.index(ids)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        decode, texts = shared.value.decode, []
        for row in batch.column(at):  # a list at a time, as its numbers are large once they are Python's
            texts.append(decode(row.values.to_pylist()) if row.is_valid else None)
        return batch.append_column(name, pa.array(texts, pa.string()))

    return map_batches(coded, step, StructType([*coded.schema, StructField(name, StringType())]))
