"""Token alignment against whole texts in the libraries and plain counters."""

from __future__ import annotations

import hashlib
import json
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from folders import MIDDLE, SMALL
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

from tillroll.llm import alignment
from tillroll.llm.queries import QUERIES

PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
BYTES.encode_special_tokens = True
NAMES = {i: name for name, i in json.load(open(public_tokenizers.path("byte_bpe_50k.json")))["model"]["vocab"].items()}
LETTERS = {c: b for c, b in alignment.byte_letters().items()}


def spelled(piece):
    if len(piece) == 6 and piece.startswith("<0x"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def plain(rows):
    """The rows of the query, with whole texts tokenized at once and one counter for all pairs."""
    made, count = [], Counter()
    for doc_id, text in rows:
        a = BYTES.encode(" " + (text or ""), add_special_tokens=False).ids
        b = PIECES.encode(text or "")
        a_bytes = [bytes(LETTERS[c] for c in NAMES[i]) for i in a]
        b_bytes = [spelled(PIECES.id_to_piece(i)) for i in b]
        raw = b" " + (text or "").encode()
        if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            made.append((doc_id, 0, 0, [], ""))
            continue
        a_ends, b_ends = list(accumulate(map(len, a_bytes))), list(accumulate(map(len, b_bytes)))
        places = {end: i for i, end in enumerate(b_ends)}
        links = [(a[i], b[places[end]]) for i, end in enumerate(a_ends) if end in places]
        count.update(links)
        groups, before = [], 0
        for cut in [end for end in a_ends if end in places]:
            left = ",".join(str(i) for i, end in zip(a, a_ends) if before < end <= cut) if len(a) < 300 else None
            right = ",".join(str(i) for i, end in zip(b, b_ends) if before < end <= cut) if len(a) < 300 else None
            groups.append(f"{left}|{right}")
            before = cut
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if len(a) < 300 else None
        made.append((doc_id, len(a), len(b), links, digest))
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [
        (doc_id, n_a, n_b, len(links), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), digest)
        for doc_id, n_a, n_b, links, digest in made
    ]


def assert_equal(found, expected):
    found = sorted((tuple(row) for row in found), key=str)
    expected = sorted(expected, key=str)
    assert [row[:-1] for row in found] == [row[:-1] for row in expected]
    assert [row[-1] for row, e in zip(found, expected) if e[-1] is not None] == [e[-1] for e in expected if e[-1] is not None]


@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
def test_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert_equal(QUERIES["op12_tokenizer_alignment"](spark, folder).collect(), plain([tuple(row) for row in docs]))


ODD = [
    (1, None),
    (2, ""),
    (3, " "),
    (4, "  two  spaces and\ttabs \n\n lines \r\n"),
    (5, "a marker ▁ is no space"),
    (6, "<s> </s> <unk> <0x41> <|endoftext|> plain"),
    (7, "naïve 中文 字 \U0001f600\U0001f468‍\U0001f469 é   　x"),
    (8, "nul \x00 and \x1c \x1f  \x85 odd"),
    (8, "nul \x00 and \x1c \x1f  \x85 odd"),
    (None, "no id here"),
    (9, "don't we'll it's 'tis rock 'n roll 12 345 6,789.00"),
    (10, "x" * 3000),
    (11, " leading and trailing "),
    (12, "e\u0301 cafe\u0301s a, b.c d's x²y ²a a² aⅧ ab12cd, a_b _a a-b... a\nb.\nC a\t\u200bz \u0301a"),
    (13, "a a, a. 'a a' aa a\x00b a\u00a0b a\u3000, (a) [a], a!\n\nb a !b"),
]


@pytest.mark.parametrize("limits", [{}, {"records": 7, "fan": 2, "radix": 3}])
def test_odd_texts_and_many_runs(docs, limits):
    """Runs of a few records, merged two at a time over several rounds, give the same."""
    assert_equal(alignment.token_alignment(docs(ODD * 4).repartition(3), **limits).collect(), plain(ODD * 4))


def test_one_text_in_a_third_of_the_rows(docs, monkeypatch):
    monkeypatch.setattr(alignment, "RUNS_PER_SLOT", 2)
    rows = [(i, "the the the same" if i % 3 == 0 else f"the text {i} of others") for i in range(300)]
    found = alignment.token_alignment(docs(rows).repartition(4), records=50, fan=4).collect()
    assert_equal(found, plain(rows))


def test_giant_text_is_tokenized_in_parts(spark):
    text = "word's ends, \n\n  and   123 more...  \t tabs " * 20_000
    both = alignment.Tokenizers()
    (units,) = alignment.aligned([text], both)
    assert sum(u.first for u in units) == len(BYTES.encode(" " + text, add_special_tokens=False).ids)
    assert sum(u.second for u in units) == len(PIECES.encode(text))
    assert len(both.known) < 20


def test_remembered_units_go_when_they_do_not_come_again(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 10)
    both = alignment.Tokenizers()
    for i in range(100):
        both.units([f"unit{i}", "the"])
    assert len(both.known) + len(both.older) <= 40 and "the" in both.known | both.older


def test_records_survive_a_run():
    spill = alignment.Spill(radix=4)
    rng = np.random.default_rng(3)
    wanted = {}
    for _ in range(50):
        pairs = [int(b) << 32 | int(a) for a, b in rng.integers(0, 9, (200, 2))] + [5 << 32 | 1] * 300
        number = spill.add([pairs[:99], pairs[99:]])
        wanted |= {(number, pair): n for pair, n in Counter(pairs).items()}
    found, totals = {}, Counter()
    for part, records, counts in spill.runs():
        keys, lengths, documents, times = alignment.read_records(records)
        assert all(key >> 32 & 3 == part for key in keys.tolist()) and (np.diff(keys) > 0).all()
        found |= dict(zip(zip(documents.tolist(), np.repeat(keys, lengths).tolist()), times.tolist()))
        for pair, count, _ in zip(*alignment.with_maxima(counts)):
            totals[int(pair)] += int(count)
    assert found == wanted
    assert totals == sum((Counter({pair: n}) for (_, pair), n in wanted.items()), Counter())
