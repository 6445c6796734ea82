from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from tillroll.llm import pieces as P


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=P.MODEL)


@pytest.fixture(scope="module")
def model():
    return P.load_model()


def joined_by_hand(pieces, text):
    """Join the best pair, the first of equal ones, until none is left."""
    scores, parts = dict(pieces), list(text)
    while found := [(-scores[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in scores]:
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def by_chunks(model, text, length):
    """Ids by matrices of all chunks, the scan, and a trace of each chunk."""
    chunks = model.chunks(text, length)
    found = [model.matrix(chunk, part, length) for part, chunk in enumerate(chunks)]
    size = max(max(m.shape) for m in found)
    matrices = np.full((len(found), size, size), P.NEVER)
    for whole, matrix in zip(matrices, found):
        whole[: matrix.shape[0], : matrix.shape[1]] = matrix
    states = P.boundary_states(matrices).tolist()
    traced = [model.finish(chunk, part, length, states[part], states[part + 1]) for part, chunk in enumerate(chunks)]
    return list(itertools.chain.from_iterable(traced))


def paths(model, unit):
    """All ways to cut a unit into pieces that stay, with neighbours that fit."""
    found = {0: [()]}
    for at in range(len(unit)):
        for path in found.get(at, []):
            for end in model.ends(unit, at):
                if not path or model.follows(unit[slice(*path[-1])], unit[at:end]):
                    found.setdefault(end, []).append((*path, (at, end)))
    return found[len(unit)]


def test_units_have_one_path_and_it_is_the_merge(model, middle):
    texts = [r["text"] for r in middle.limit(60).collect()] + ["中文 naïve 😀x", "aaaaaaaaaaaaaaaa", "=====----====", "the" * 5]
    units = sorted({unit for text in texts for unit in model.units(" " + text) if len(unit) <= 20})
    assert len(units) > 3000
    for unit in units:
        (path,) = paths(model, unit)
        ids = [i for a, b in path for i in ([model.symbol_id[model.number[unit[a:b]]]] if unit[a:b] in model.number else model._spelled(unit[a:b]))]
        assert ids == model.segment(unit), unit


def test_a_giant_text_without_a_space(spark, docs, library, model):
    r = random.Random(2)
    syllables = ["the", "ing", "tion", "é", "qu", "ß", "中", "x", "aa", "1", "_", "\n"]
    text = "".join(r.choice(syllables) for _ in range(700_000))[:1_000_000]
    assert len(text) == 1_000_000 and " " not in text and len(model.chunks(text, P.CHUNK)) == 31
    (row,) = P.encode(docs([(1, text)])).collect()
    assert row["ids"] == library.encode(text)


def test_giants_go_through_the_scan(model, middle, monkeypatch):
    """Matrices of all chunks of the registered query's giant texts meet in the scan."""
    giants = [r["text"] for r in middle.collect() if len(r["text"]) >= P.CHUNK]
    assert giants
    seen = []
    monkeypatch.setattr(P, "scan", lambda matrices, scan=P.scan: seen.append(len(matrices)) or scan(matrices))
    for text in giants:
        assert by_chunks(model, text, P.CHUNK) == model.encode(text)
    assert len(seen) == len(giants) and min(seen) >= 2


@pytest.mark.parametrize("seed", range(8))
def test_merges_one_by_one(seed):
    r = random.Random(seed)
    names = sorted({r.choice(["", " "]) + "".join(r.choice("abc") for _ in range(r.randrange(1, 5))) for _ in range(30)} | {" ", "a"})
    pieces = [(name, -float(r.randrange(1, 9))) for name in names]
    model = P.MergeModel([(name, score, i) for i, (name, score) in enumerate(pieces)], list(range(100, 356)), 99)
    for _ in range(300):
        text = " " + "".join(r.choice("abcd ") for _ in range(r.choice([5, 20, 130])))
        want = [i for part in joined_by_hand(pieces, text) for i in ([names.index(part)] if part in names else [100 + ord(part)])]
        assert model.segment(text) == want


def test_ids_of_the_library(model, library):
    r = random.Random(5)
    texts = ["", " ", "the committee  of\nx", " " * 70, "a" * 400, "中文" * 90, "x  y   " * 40, "the" * 200, "é\t\r\n😀 <s> <0x0A>"]
    for _ in range(500):
        kinds = [r.randrange(128), r.randrange(97, 123), r.randrange(0x250), r.randrange(0x4E00, 0x5000), 32, 10]
        texts.append("".join(chr(r.choice([*kinds, r.randrange(97, 123)])) for _ in range(r.randrange(120))))
    for text in texts:
        assert model.encode(text) == library.encode(text), text
        assert model.decode(model.encode(text)) == text
        if text:
            for length in (model.reach, 20, 61):
                assert by_chunks(model, text, length) == library.encode(text), (text, length)
    assert model.decode(model.encode("a▁b ▁")) == "a▁b ▁"  # the library reads the marker as a space


def test_documents_get_the_ids_of_the_library(middle, library):
    texts = {r["doc_id"]: r["text"] for r in middle.collect()}
    for chunk in (P.CHUNK, 300):
        rows = P.encode(middle, chunk=chunk).collect()
        assert len(rows) == len(texts) and all(row["ids"] == library.encode(texts[row["doc_id"]]) for row in rows)
