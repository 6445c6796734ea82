from __future__ import annotations

import random
import re

import pytest

from tillroll.llm import units as U


def brute(rows, unit, least):
    """Walk through all documents in order and keep what was not seen yet."""
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda x: (x[0] is None, x[0])):
        pattern = r"(\n)" if unit == "line" else r"(\n(?:[\x20\x09-\x0D]*\n)+)"
        parts = re.split(pattern, text)
        kept, gone, at = "", [], 0
        for k in range(0, len(parts), 2):
            whole = parts[k] + (parts[k + 1] if k + 1 < len(parts) else "")
            words = tuple(re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in parts[k])))
            if len(words) >= least and words in seen:
                gone.append(f"{at}:{at + len(whole)}")
            else:
                kept += whole
            if len(words) >= least:
                seen.add(words)
            at += len(whole)
        out[i] = (kept, ",".join(gone), len(gone))
    return out


@pytest.mark.parametrize("unit", ["line", "paragraph"])
@pytest.mark.parametrize("seed", range(3))
def test_against_one_walk(docs, unit, seed):
    r = random.Random(seed)
    lines = ["a b c", "A  b\tC", "d e f g", "é É x y", "short", "", "  ", "q r s t u v"]
    rows = [(i, "".join(r.choice(lines) + r.choice(["\n", "\n\n", "\n \n", " "]) for _ in range(r.randrange(12)))) for i in range(40)]
    found = U.without_repeats(docs(rows), unit=unit, least_words=3).collect()
    assert {x["doc_id"]: (x["text"], x["removed"], x["n_removed"]) for x in found} == brute(rows, unit, 3)


def test_offsets_point_into_the_original(docs):
    first = "one two three four five\nsix seven eight nine ten\nend"
    second = "start é\nSIX seven  eight nine ten\none two three four five"
    found = {r["doc_id"]: r for r in U.without_repeats(docs([(2, second), (1, first), (None, first)])).collect()}
    assert found[1]["text"] == first and found[1]["removed"] == ""
    assert found[2]["text"] == "start é\n"
    assert [second[int(a) : int(b)] for a, b in (s.split(":") for s in found[2]["removed"].split(","))] == [
        "SIX seven  eight nine ten\n", "one two three four five"
    ]
    assert found[None]["text"] == "end"


def test_equal_ids(docs):
    """Rows equal in id and text are one document; an id with two texts is two."""
    text = "one two three four five"
    found = U.without_repeats(docs([(1, text), (1, text), (1, text + "\nmore"), (0, "x")])).collect()
    kept = sorted(r["text"] for r in found)
    assert kept in (["more", text, text, "x"], ["", "", text + "\nmore", "x"])


def test_long_passages_stay_once(docs):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"own line number {i} here\n{passage}\nlast of {i}") for i in range(30)]
    found = U.without_repeats(docs(rows)).collect()
    assert [r["doc_id"] for r in found if passage in r["text"]] == [0]
    assert all(r["text"] == f"own line number {r['doc_id']} here\nlast of {r['doc_id']}" for r in found if r["doc_id"])


def brute_runs(rows, least, run):
    """Walk through all documents; a run of sentences that were all seen goes if it has enough words."""
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda x: (x[0] is None, x[0])):
        runs, open_run = [], None
        for m in re.finditer(r"[^.!?\n]*[.!?\n]+[\x20\x09-\x0D]*|[^.!?\n]+", text):
            words = tuple(re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in m.group())))
            if len(words) < least:
                continue
            if words not in seen:
                open_run = None
            elif open_run is None:
                open_run = [m.start(), m.end(), len(words)]
                runs.append(open_run)
            else:
                open_run[1:] = [m.end(), open_run[2] + len(words)]
            seen.add(words)
        gone = [(a, b) for a, b, n in runs if n >= run]
        kept, at = "", 0
        for a, b in gone:
            kept, at = kept + text[at:a], b
        out[i] = (kept + text[at:], ",".join(f"{a}:{b}" for a, b in gone), len(gone))
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("hot", [1000, 3])
def test_runs_of_sentences_against_one_walk(docs, monkeypatch, seed, hot):
    monkeypatch.setattr(U, "HOT", hot)
    r = random.Random(seed)
    sentences = ["a b c.", "A  b\tC.", "d e f g?!", "é É x y", "short.", "3.14 of it", "q r s t u v...", "\n", "\n\n", " "]
    rows = [(i, "".join(r.choice(sentences) + r.choice(["", " ", "\n"]) for _ in range(r.randrange(25)))) for i in range(40)]
    found = U.without_repeats(docs(rows), unit="sentence", least_words=3, run_words=9).collect()
    expected = brute_runs(rows, 3, 9)
    assert {x["doc_id"]: (x["text"], x["removed"], x["n_removed"]) for x in found} == expected
    assert sum(n for _, _, n in expected.values()) > 10


def test_a_passage_inside_lines_that_differ(docs):
    passage = " ".join(f"This is sentence number {i} of it." for i in range(8))
    rows = [(i, f"Line {i} says so first. {passage} And so ends line {i}.\nStock line of all the texts.") for i in range(20)]
    rows += [(100, "Stock line of all the texts. This is sentence number 3 of it. Another one follows here.")]
    found = {r["doc_id"]: r for r in U.without_repeats(docs(rows), unit="sentence", least_words=3, run_words=30).collect()}
    assert [i for i, r in found.items() if passage in r["text"]] == [0]
    assert all("Stock line" in r["text"] and f"line {i}" in r["text"] for i, r in found.items() if i < 100)
    assert found[100]["n_removed"] == 0 and all(found[i]["n_removed"] == 1 for i in range(1, 20))


def test_a_hot_unit_does_not_meet_in_one_task(spark, docs):
    """Its places stay where they are: the digests that are no hot ones alone are shuffled."""
    from tillroll.session import stored

    rows = [(i, f"the same line of all texts\nline {i} of its own kind\nline {i % 7} shared by some") for i in range(300)]
    found = stored(U.occurrences(docs(rows), "doc_id", "text", "line", 3), "units")
    later = U.later_occurrences(found)
    assert later.count() == 299 + 293
    plan = later._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
