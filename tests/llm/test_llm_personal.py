from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tillroll.llm import personal as P
from tillroll.llm.boosting import BoostedTrees


def brute(text):
    """The base as it is stated, by plain regular expressions."""
    found = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(part) <= 255 for part in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[^0-9]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            found.append((*m.span(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], P.KINDS.index(s[2])))


@pytest.mark.parametrize("alphabet", ["a.@-", "1.2 ", "12- ", "+1 (2)-", "a@b.c1+ 2.3-(é", "@@a.a", "25.6٣²"])
def test_base_against_regular_expressions(alphabet):
    r = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(45)))
        assert P.base_spans(text) == brute(text), text


def test_base_of_mixed_parts():
    r = random.Random(0)
    parts = ["a@b.c", "1.2.3.4", "4111111111111111", "4111 1111 1111 1111", "+1 (988) 555-2485", ".5.6", "256.1.1.1", "@x", "é", "001.02.3.255"]
    for _ in range(4000):
        text = "".join(r.choice(parts) + r.choice(["", ".", " ", "-"]) for _ in range(6))
        assert P.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "(" * 200_000):
        P.base_spans(text)
        P.proposals(text)


def test_trees_learn_and_scores_are_chances():
    r = np.random.default_rng(0)
    rows = r.random((3000, 4))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.5)).astype(float)
    trees = BoostedTrees().fit(rows[:2000], labels[:2000])
    chance = trees.chance(rows[2000:])
    assert ((chance > 0.5) == labels[2000:]).mean() > 0.95 and 0 <= chance.min() and chance.max() <= 1


def test_thresholds_keep_their_precision():
    r = np.random.default_rng(1)
    chance = r.random(2000)
    confirmed = r.random(2000) < chance
    kinds = np.array(["phone"] * 2000, object)
    (limit,) = P.thresholds(kinds, chance, confirmed, 0.9).values()
    assert confirmed[chance >= limit].mean() >= 0.9 and limit > 0.5
    assert P.thresholds(kinds, chance, np.zeros(2000, bool), 0.9) == {}


@pytest.fixture(scope="module")
def trained(spark):
    """Phones with a plus sign confirm what a national number looks like; part numbers are never confirmed."""
    r = random.Random(2)
    number = lambda: f"({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"
    texts = [f"words here call +1 {number()} or visit" for _ in range(300)]
    texts += [f"part {r.randrange(10**7, 10**8)} of series {r.randrange(10**4)}" for _ in range(300)]
    texts += [f"write to u{i}@mail{i % 7}.example.com today" for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return P.train(df)


def test_method_adds_and_keeps_the_base(docs, trained):
    text = "call (988) 555-2485 or +1 (988) 555-2486, part 12345678"
    (row,) = P.personal_spans(docs([(1, text)]), detector=trained).collect()
    base, every = trained.spans(text)
    assert [text[a:b] for a, b, _ in base] == ["+1 (988) 555-2486"]
    assert [text[a:b] for a, b, _ in every] == ["(988) 555-2485", "+1 (988) 555-2486"]
    assert row["spans"] == P.joined(every) and row["n_phone"] == 1 and row["n_added"] == 1
    assert row["base_sha256"] == hashlib.sha256(P.joined(base).encode()).hexdigest()
    (row,) = P.redact(docs([(1, text)]), detector=trained).collect()
    assert row["text"] == "call [PHONE] or [PHONE], part 12345678"


def test_redaction_merges_overlaps():
    assert P.redacted("ab12cd", [(2, 4, "ip"), (3, 5, "card")]) == "ab[IP]d"
    assert P.redacted("x", []) == "x"


def test_documents(middle):
    texts = {r["doc_id"]: r["text"] for r in middle.collect()}
    for row in P.personal_spans(middle).collect():
        base = brute(texts[row["doc_id"]])
        assert [row[f"n_{k}"] for k in P.KINDS] == [sum(s[2] == k for s in base) for k in P.KINDS]
        assert row["base_sha256"] == hashlib.sha256(P.joined(base).encode()).hexdigest()
        assert set(P.joined(base).split(",")) <= set(row["spans"].split(",")) or not base
        if not re.search(r"[0-9@]", texts[row["doc_id"]]):
            assert row["spans"] == ""
