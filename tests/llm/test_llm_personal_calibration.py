from __future__ import annotations

import random

from tillroll.llm import personal as P


def number(r):
    return f"({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"


def test_few_confirmed_have_a_threshold(docs):
    """Sixteen phones, among few proposals: a table of any size gets additions by the same rule."""
    r = random.Random(6)
    texts = [f"words here call +1 {number(r)} or visit" for _ in range(16)]
    texts += [f"part {r.randrange(10**7, 10**8)} of series {r.randrange(10**4)}" for _ in range(40)]
    detector = P.train(docs(list(enumerate(texts)), plain=True))
    assert "phone" in detector.thresholds
    assert detector.spans("call (988) 555-2485, part 12345678")[1] == [(5, 19, "phone")]


def test_a_crowded_kind_leaves_room_for_others(docs):
    """Cards fill a sample of 400 of 6,200 proposals; phones are still learnt, and counted over the whole table."""
    r = random.Random(7)
    texts = [" ".join(str(r.randrange(10**15, 10**16)) + ";" for _ in range(20)) for _ in range(300)]
    texts += [f"words here call +1 {number(r)} or visit" for _ in range(60)]
    texts += [f"part {r.randrange(10**7, 10**8)} of series {r.randrange(10**4)}" for _ in range(80)]
    for seed in range(2):
        random.Random(seed).shuffle(texts)
        detector = P.train(docs(list(enumerate(texts)), plain=True).repartition(1 + seed), examples=400)
        assert "phone" in detector.thresholds
        assert detector.spans("call (988) 555-2485, part 12345678")[1] == [(5, 19, "phone")]


def test_thresholds_of_counts():
    import numpy as np

    kinds, chance = np.array(["card"] * 3, object), np.array([0.9, 0.8, 0.7])
    confirmed, copies = np.array([True, False, True]), np.array([95, 5, 1_000_000])
    assert P.thresholds(kinds, chance, confirmed, 0.95, copies) == {"card": 0.7}
    assert P.thresholds(kinds, chance, confirmed, 0.95, np.array([94, 6, 1])) == {"card": 0.9}
