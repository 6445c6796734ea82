from __future__ import annotations

import random

import pytest

from tillroll.llm import personal as P


def told(text):
    return {(text[a:b], kind): P.evidence(text, (a, b, kind)) for a, b, kind in P.proposals(text)}


@pytest.mark.parametrize(
    "text, inside, kind, want",
    [
        ("or (988) 555-2485 now", "(988) 555-2485", "phone", True),
        ("or +1 (988) 555-2485 now", "1 (988) 555-2485", "phone", True),
        ("or 988 555 2485 now", "988 555 2485", "phone", True),
        ("phone: 55 52 48 51", "55 52 48 51", "phone", True),
        ("or 55 52 48 51", "55 52 48 51", "phone", None),
        ("part 12345678 of", "12345678", "phone", False),
        ("on 2024-01-31 it", "2024-01-31", "phone", False),
        ("c939b6405768150e04", "6405768150", "phone", False),
        ("at 129.38.82.176 it", "129.38.82.176", "phone", False),
        ("at 129-38-82-176 it", "129-38-82-176", "ip", True),
        ("version 129.38.82.176", "129.38.82.176", "ip", False),
        ("at 1.2.3.4.5", "1.2.3.4", "ip", False),
        ("at 300-38-82-176 it", "300-38-82-176", "ip", False),
        ("in 1.2.3.4 it", "1.2.3.4", "ip", None),
        ("ann [at] mail (dot) example (dot) com", "ann [at] mail (dot) example (dot) com", "email", True),
        ("ann [at] host", "ann [at] host", "email", None),
        ("mail: ann [at] host", "ann [at] host", "email", True),
        ("pay 4111.1111.1111.1111 now", "4111.1111.1111.1111", "card", True),
        ("pay 4111 1111 1111 1112 now", "4111 1111 1111 1112", "card", False),
    ],
)
def test_evidence(text, inside, kind, want):
    assert told(text)[inside, kind] is want


def numbers(r, look):
    for _ in range(300):
        yield f"words {look.format(r.randrange(200, 999), r.randrange(200, 999), r.randrange(1000, 9999))} or visit"


@pytest.mark.parametrize("look", ["({}) {}-{}", "{}-{}-{}"])
def test_national_numbers_only(docs, look):
    """No number has a plus sign: the base finds nothing, and all are found nevertheless."""
    r = random.Random(3)
    texts = [*numbers(r, look), *(f"part {r.randrange(10**7, 10**8)} of series {r.randrange(10**4)}" for _ in range(300))]
    for some in (texts, texts[:300]):
        rows = P.personal_spans(docs(list(enumerate(some)))).collect()
        assert all((row["n_phone"], row["n_added"]) == (0, int(row["doc_id"] < 300)) for row in rows)


def test_spelled_addresses_mostly(docs):
    texts = [f"ask ann{i} [at] mail{i % 7} [dot] example [dot] com or ok" for i in range(200)]
    texts += ["ask bob@example.com or ok", *(f"rate {i}(at){i + 3} [dot] 5 each" for i in range(60))]
    rows = {r["doc_id"]: r for r in P.personal_spans(docs(list(enumerate(texts)))).collect()}
    assert all(rows[i]["n_added"] == 1 for i in range(200)) and rows[200]["n_email"] == 1
    assert not any(rows[i]["n_added"] for i in range(200, 261))
