"""Greedy word-piece counts by a longest-match automaton.

The vocabulary is a trie over bytes. Pieces that begin a word begin with a space, the others continue one, and a
space is put before each word. From a node without a wanted child, its failure link leads to the node at which
greedy matching goes on, and its count tells how many pieces that takes off the front. Both are worked out once
for the vocabulary. A word is then counted in one pass over its bytes, without building a piece.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.texts import identified, kind_of, map_batches, raw_texts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
REMEMBERED = 500_000  # words


def load_pieces(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a vocabulary file that has one in base 64 at the start of each line."""
    with open(path, "rb") as file:
        return [base64.b64decode(line.split()[0]) for line in file if line.strip()]


class Automaton:
    """Counts greedy pieces; a word that the vocabulary cannot spell is one unknown piece."""

    def __init__(self, pieces: Iterable[bytes]):
        self.children: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                below = self.children[node].get(symbol)
                if below is None:
                    below = self.children[node][symbol] = len(self.children)
                    self.children.append({})
                    whole.append(False)
                node = below
            whole[node] = node > 0
        self.link, self.popped = [-1] * len(whole), [0] * len(whole)
        # Nodes nearer to the root first: a link always leads nearer to the root.
        waiting = deque([0])
        while waiting:
            node = waiting.popleft()
            for symbol, below in self.children[node].items():
                waiting.append(below)
                if whole[below]:
                    self.link[below], self.popped[below] = 0, 1
                    continue
                at, count = self.link[node], self.popped[node]
                while at >= 0 and symbol not in self.children[at]:
                    count += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[below], self.popped[below] = self.children[at][symbol], count
        self.known: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """The number of pieces of a word with its space, 0 if it cannot be spelled."""
        children, link, popped = self.children, self.link, self.popped
        node = total = 0
        for symbol in b" " + word:
            below = children[node].get(symbol)
            while below is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return 0
                below = children[node].get(symbol)
            node = below
        while node:
            total += popped[node]
            node = link[node]
            if node < 0:
                return 0
        return total

    def remembered(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[word] = self.count(word)
        return found


def token_counts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pieces: Iterable[bytes] | None = None
) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) for each row of docs.

    Words are lowered A-Z; a word that cannot be spelled counts as one token and is unknown. A null or empty text
    has none. Rows with equal ids or texts are each counted; texts and words of any length are read whole. Other
    columns are left out. An empty table gives an empty table.
    """
    automaton = Automaton(load_pieces() if pieces is None else pieces)
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    source = identified(docs, doc_id, text)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for raw in raw_texts(batch.column(1)):
            counts = list(map(shared.value.remembered, raw.lower().split()))
            unknown = counts.count(0)
            rows.append((len(counts), sum(counts) + unknown, unknown))
        counts = dict(zip(("n_words", "n_tokens", "n_unknown"), (pa.array(c, pa.int64()) for c in zip(*rows))))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **counts})

    return map_batches(source, step, f"doc_id {kind_of(source, 'doc_id')}, n_words long, n_tokens long, n_unknown long")
