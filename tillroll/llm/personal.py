"""Personal data: checked formats, and more spans by boosted trees.

The base finds email and network addresses, card and phone numbers by format and check. Generators with a high
recall propose further spans, which may overlap: digits in groups, national phone numbers, dotted or dashed
quadruples, addresses with a spelled-out at sign. Each proposal has format and context features, without the
traits by which the base decides (the plus sign, the at sign, the kind of dots). What is known of a proposal without
these traits labels it (``evidence``): checks such as Luhn's, number ranges, the grouping of digits and context words
confirm it; failed checks, words such as "part" or "version" before it and adjoining letters refute it. A proposal with
neither is no example, but gets a score as all others do. So the trees' score is the chance that a span of this look is
personal data, whether or not the base finds any. From the scores of all proposals, each kind gets the lowest threshold above
which a stated share of proposals is confirmed. Proposals apart from the base spans that reach it are added.

Two Arrow passes over the texts, one for the examples and one for the spans. Equal examples are counted in a shuffle.
The trees train on the driver on a bounded sample of the distinct ones, that has its part of each kind, confirmed or
not, whatever the others' number. All of them are then scored in tasks, and only counts by score reach the driver.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.boosting import BoostedTrees
from tillroll.llm.texts import as_text, identified, kind_of, map_batches
from tillroll.session import stored

KINDS = ("email", "ip", "card", "phone")
EXAMPLES = 20_000  # distinct examples that train the trees, at most about that many
PRECISION = 0.95
STEPS = 4096  # scores are counted by their multiples of 1 / STEPS
Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can begin only where a run of digits does, and runs cannot give back: this keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[(\[{]at[)\]}]", re.IGNORECASE)

_NUMBER = re.compile(r"(?<![0-9])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,18}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])")
_QUAD = re.compile(r"(?<![0-9])[0-9]{1,3}(?:[.,_-][0-9]{1,3}){3}(?![0-9])")
_ADDRESS = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:@| ?[(\[{]at[)\]}] ?)"
    r"[A-Za-z0-9-]{1,63}(?:(?:\.| ?[(\[{]dot[)\]}] ?)[A-Za-z0-9-]{1,63}){0,8}",
    re.IGNORECASE,
)
_HINTS = re.compile(r"(?:tel|phone|call|fax|mail|contact|card|visa|account|ip|host|server)\W{0,3}$", re.IGNORECASE)


def _emails(text: str):
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end, "email"
        at = text.find("@", max(at + 1, end))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(map(int, reversed(digits))):
        total += digit if i % 2 == 0 else digit * 2 - 9 * (digit > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Confirmed spans by start, then kind as listed in KINDS; code points, end exclusive."""
    found = list(_emails(text))
    found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if len(m[0]) >= 12 and 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda span: (span[0], KINDS.index(span[2]), span[1]))


def proposals(text: str) -> list[Span]:
    """Spans that may be personal data, several of them over the same digits."""
    found = set()
    for pattern, kind in ((_ADDRESS, "email"), (_QUAD, "ip"), (_NUMBER, ""), (_NATIONAL, "")):
        for m in pattern.finditer(text):
            found.add((*m.span(), kind or ("card" if len(_digits(m[0])) >= 12 else "phone")))
    return in_order(list(found))


_CONTEXT = {
    "email": r"e-?mail|mail|contact|contact (?:me|us) at|write to|reach (?:me|us) at",
    "ip": r"ip|ip address|host|server|ping|gateway",
    "card": r"card|card number|visa|mastercard|amex",
    "phone": r"tel|telephone|phone|phone number|call|call (?:me|us) at|fax|mobile|cell|dial|whatsapp",
}
_CONTEXT = {kind: re.compile(rf"(?<![A-Za-z])(?:{words})\W{{0,3}}$", re.IGNORECASE) for kind, words in _CONTEXT.items()}
_OTHER = re.compile(
    r"(?<![A-Za-z])(?:part|serial|series|isbn|issn|order|invoice|version|article|sku|item|token|id|key|ref|release|build"
    r"|section|chapter|lot|model)(?: (?:no\.?|nr\.?|number))?\W{0,3}$",
    re.IGNORECASE,
)
_DATE = re.compile(r"(?:19|20)[0-9]{2}[ .-]?(?:0[1-9]|1[0-2])[ .-]?(?:0[1-9]|[12][0-9]|3[01])")


def _address_evidence(inside: str, named: bool) -> bool | None:
    local, host = re.split(r"@| ?[(\[{]at[)\]}] ?", inside, maxsplit=1, flags=re.IGNORECASE)
    labels = re.split(r"\.| ?[(\[{]dot[)\]}] ?", host, flags=re.IGNORECASE)
    if len(labels) == 1:
        return named or None
    return len(labels[-1]) > 1 and labels[-1].isalpha() and any(c.isalpha() for c in local)


def _network_evidence(parts: list[str], named: bool) -> bool | None:
    if not all(part == str(int(part)) and int(part) <= 255 for part in parts):
        return False
    return named or sum(map(len, parts)) >= 9 or None  # longer parts are seldom in range by chance


def _phone_evidence(digits: str, groups: list[str], inside: str, named: bool) -> bool | None:
    if named:
        return True
    if _DATE.fullmatch(inside):
        return False
    national = groups[1:] if groups[0] == "1" else groups
    if [len(group) for group in national] == [3, 3, 4]:
        return "(" in inside or (national[0][0] > "1" and national[1][0] > "1") or None
    return None


def evidence(text: str, span: Span) -> bool | None:
    """Whether a proposal is personal data, by what the base does not decide by; None where nothing tells."""
    start, end, kind = span
    inside = text[start:end]
    before = text[max(0, start - 40) : start].rstrip("+(")
    named = bool(_CONTEXT[kind].search(before))
    if kind == "email":
        return _address_evidence(inside, named)
    if _OTHER.search(before) or text[start - 1 : start].isalnum() or text[end : end + 1].isalnum():
        return False
    groups = re.findall(r"[0-9]+", inside)
    if kind == "ip":
        more = re.compile(r"[.,_-][0-9]")  # a longer row of numbers
        return False if more.match(text, end) else _network_evidence(groups, named)
    if _QUAD.fullmatch(inside) and all(map(_small, groups)):
        return False
    digits = "".join(groups)
    if kind == "phone":
        return _phone_evidence(digits, groups, inside, named)
    return luhn(digits) and (named or "2" <= digits[0] <= "6" or None)


def _class(character: str) -> int:
    tests = (str.isspace, str.isalpha, str.isdigit, bool)
    return next((i for i, test in enumerate(tests, 1) if test(character)), 0)


def features(text: str, span: Span) -> list[float]:
    """Format of the span and what stands around it, past a plus sign."""
    start, end, kind = span
    inside = text[start:end]
    digits = _digits(inside)
    groups = re.findall(r"[0-9]+", inside) or [""]
    labels = re.split(r"[^A-Za-z0-9]+", inside)
    before = text[max(0, start - 24) : start].rstrip("+")
    return [
        *(float(kind == k) for k in KINDS),
        len(inside),
        len(digits),
        sum(c.isalpha() for c in inside),
        len(groups),
        max(map(len, groups)),
        min(map(len, groups)),
        len(set(digits)),
        float(bool(digits) and luhn(digits)),
        max(min(int(g[:9] or 0), 1000) for g in groups) if kind == "ip" else 0,
        len(labels[-1]),
        float(labels[-1].isalpha()),
        float("(" in inside),
        _class(before[-1:]),
        _class(text[end : end + 1]),
        float(bool(_HINTS.search(before))),
    ]


def _meets(span: Span, others: list[Span]) -> bool:
    return any(span[0] < end and start < span[1] for start, end, _ in others)


@dataclass
class Detector:
    """Finds spans: the base, and proposals that reach their kind's threshold."""

    trees: BoostedTrees | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """The base spans and all spans."""
        if not _ANY.search(text):
            return [], []
        base = base_spans(text)
        if not self.thresholds:
            return base, base
        free = [p for p in proposals(text) if p[2] in self.thresholds and not _meets(p, base)]
        if not free:
            return base, base
        chance = self.trees.chance(np.array([features(text, p) for p in free]))
        added: list[Span] = []
        for score, p in sorted(zip(chance.tolist(), free), key=lambda x: (-x[0], x[1])):
            if score >= self.thresholds[p[2]] and not _meets(p, added):
                added.append(p)
        return base, in_order(base + added)


def _examples(texts: DataFrame) -> DataFrame:
    """(kind, confirmed, features) of every proposal that evidence tells about in the column text."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds, confirmed, rows = [], [], []
        for text in batch.column(0).to_pylist():
            for span in proposals(text) if text and _ANY.search(text) else ():
                if (told := evidence(text, span)) is not None:
                    kinds.append(span[2])
                    confirmed.append(told)
                    rows.append(features(text, span))
        return pa.RecordBatch.from_pydict(
            {
                "kind": pa.array(kinds, pa.string()),
                "confirmed": pa.array(confirmed, pa.bool_()),
                "features": pa.array(rows, pa.list_(pa.float64())),
            }
        )

    return map_batches(texts, step, "kind string, confirmed boolean, features array<double>")


def thresholds(
    kinds: np.ndarray, chance: np.ndarray, confirmed: np.ndarray, precision: float, copies: np.ndarray | None = None
) -> dict[str, float]:
    """For each kind the lowest score from which on the confirmed share of examples is precision."""
    found = {}
    copies = np.ones(len(chance)) if copies is None else copies
    for kind in KINDS:
        own = np.flatnonzero(kinds == kind)
        own = own[np.argsort(-chance[own], kind="stable")]
        score, good = chance[own], copies[own] * confirmed[own]
        share = np.cumsum(good) / np.cumsum(copies[own])
        last = np.r_[score[1:] != score[:-1], np.ones(min(1, len(own)), bool)]  # equal scores go together
        enough = np.flatnonzero((share >= precision) & last)
        if len(enough):
            found[kind] = float(max(score[enough[-1]], 0.5))
    return found


def _fitted(table: DataFrame, examples: int) -> BoostedTrees:
    """Trees of a sample of (kind, confirmed, features, copies), chosen by a hash of the features.

    Kinds weigh by their distinct examples in the sample, and inside a kind the examples by their copies in the table.
    """
    sizes = {(r["kind"], r["confirmed"]): r["count"] for r in table.groupBy("kind", "confirmed").count().collect()}
    most = examples / len(sizes)
    share = F.lit(1.0)
    for (kind, confirmed), size in sizes.items():
        share = F.when((F.col("kind") == kind) & (F.col("confirmed") == confirmed), min(1.0, most / size)).otherwise(share)
    sample = table.withColumn("share", share).where(F.pmod(F.xxhash64("features"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    rows = sample.select("kind", "confirmed", "features", (F.col("copies") / F.col("share")).alias("weight")).toArrow()
    kinds = np.array(rows["kind"].to_pylist(), object)
    labels = np.array(rows["confirmed"].to_pylist(), float)
    points, weights = np.array(rows["features"].to_pylist()), rows["weight"].to_numpy().copy()
    for kind in KINDS:
        own = kinds == kind
        weights[own] *= own.sum() / max(weights[own].sum(), 1e-300)
    order = np.lexsort((*points.T, labels))  # the same trees whatever order the rows came in
    return BoostedTrees().fit(points[order], labels[order], weights[order])


def _counts(table: DataFrame, trees: BoostedTrees) -> DataFrame:
    """(kind, step, confirmed, copies) of (kind, confirmed, features, copies), by the step that the score reaches."""
    shared = table.sparkSession.sparkContext.broadcast(trees)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        points = np.array(batch.column(2).to_pylist())
        steps = np.floor(shared.value.chance(points) * STEPS).astype(np.int64) if len(points) else []
        found = {"kind": batch.column(0), "step": pa.array(steps, pa.int64())}
        return pa.RecordBatch.from_pydict(found | {"confirmed": batch.column(1), "copies": batch.column(3)})

    scored = map_batches(table, step, "kind string, step long, confirmed boolean, copies long")
    return scored.groupBy("kind", "step", "confirmed").agg(F.sum("copies").alias("copies"))


def train(docs: DataFrame, text: str = "text", examples: int = EXAMPLES, precision: float = PRECISION) -> Detector:
    """A detector whose trees learn from about that many distinct examples, and whose thresholds come from all.

    Where all examples are confirmed, every score is high, and where none is, low. A kind without any example has
    precision itself as its threshold, since scores are chances. Without an example of any kind only the base counts.
    """
    found = _examples(docs.select(as_text(text).alias("text"))).groupBy("kind", "confirmed", "features")
    table = stored(found.agg(F.count("*").alias("copies")), "examples")
    if table.isEmpty():
        return Detector()
    trees = _fitted(table, examples)
    rows = _counts(table, trees).toArrow().to_pydict()
    kinds, confirmed = np.array(rows["kind"], object), np.array(rows["confirmed"], bool)
    chance, copies = np.array(rows["step"]) / STEPS, np.array(rows["copies"], float)
    unseen = {kind: precision for kind in KINDS if kind not in kinds}
    return Detector(trees, unseen | thresholds(kinds, chance, confirmed, precision, copies))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def personal_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", detector: Detector | None = None
) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row of docs.

    The counts and the digest are of base spans, spans has all. A null text counts as empty. Rows with equal ids
    or texts each appear; texts are read whole; other columns are left out. An empty table gives an empty table.
    """
    detector = detector or train(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(detector)
    source = identified(docs, doc_id, text)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        bases, everything = zip(*(shared.value.spans(value or "") for value in batch.column(1).to_pylist()))
        found = {f"n_{kind}": pa.array([sum(s[2] == kind for s in b) for b in bases], pa.int64()) for kind in KINDS}
        found["base_sha256"] = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in bases])
        found["spans"] = pa.array([joined(spans) for spans in everything])
        found["n_added"] = pa.array([len(e) - len(b) for b, e in zip(bases, everything)], pa.int64())
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **found})

    schema = f"doc_id {kind_of(source, 'doc_id')}, {', '.join(f'n_{kind} long' for kind in KINDS)}, "
    return map_batches(source, step, schema + "base_sha256 string, spans string, n_added long")


def redacted(text: str, spans: list[Span]) -> str:
    """text with each run of overlapping spans replaced by the kind of its first in brackets."""
    parts, end = [], 0
    for start, stop, kind in spans:
        if start >= end:
            parts += (text[end:start], f"[{kind.upper()}]")
        end = max(end, stop)
    return "".join((*parts, text[end:]))


def redact(docs: DataFrame, text: str = "text", detector: Detector | None = None) -> DataFrame:
    """docs with personal data replaced in the text column; all columns stay, null texts stay null."""
    detector = detector or train(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(detector)
    at = docs.columns.index(text)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(at)
        texts = [None if value is None else redacted(value, shared.value.spans(value)[1]) for value in column.to_pylist()]
        return batch.set_column(at, batch.schema.names[at], pa.array(texts, column.type))

    return map_batches(docs, step, docs.schema)
