"""Personal data: base patterns, and further spans chosen by boosted trees among candidates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coastgrid.llm.boosting import BoostedTrees, boost
from coastgrid.llm.common import narrow

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Digit runs are taken whole: a start inside one would meet the same dots.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SOME = re.compile(r"[0-9@]|[\(\[]\x20?at\x20?[\)\]]", re.I)
_SOME_SQL = f"(?i){_SOME.pattern}"

#: Candidate generators: (kind, pattern), wide on purpose.  Their spans may overlap.
GENERATORS = (
    (0, re.compile(r"[\w.%+-]{1,64}\x20?(?:@|[\(\[]\x20?at\x20?[\)\]])\x20?[\w-]{1,63}(?:\x20?(?:\.|[\(\[]\x20?dot\x20?[\)\]])\x20?[\w-]{1,63}){1,8}", re.I)),
    (1, re.compile(r"(?<![\w.])[0-9]{1,3}+(?:\x20?[.,]\x20?[0-9]{1,3}+){3}(?![\w])")),
    (1, re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    (2, re.compile(r"(?<![\w])[0-9]{3,6}+(?:[\x20./_-]?[0-9]{2,6}+){2,4}(?![\w])")),
    (2, re.compile(r"(?<![0-9])[0-9]{13,19}+(?![0-9])")),
    (3, re.compile(r"(?<![\w+])(?:00|\+|\()?[0-9]{1,4}+\)?(?:[\x20./-]{1,2}\(?[0-9]{2,4}+\)?){2,4}(?![\w])")),
    (3, re.compile(r"(?<![\w])(?:00|\+)[0-9]{7,15}+(?![\w])")),
)

_SENTENCE = re.compile(r"(?<=[^\s.])\.\x20")

#: Words near a span that tell what it is, per kind; a fixed list.
HINTS = (
    re.compile(r"\b(?:e-?mail|mail|contact|correo|courriel|write)\b", re.I),
    re.compile(r"\b(?:ip|host|server|address|adresse|login|from)\b", re.I),
    re.compile(r"\b(?:card|visa|credit|karte|carte|tarjeta|payment)\b", re.I),
    re.compile(r"\b(?:phone|tel|mobile|call|fax|telefon|telefono)\b", re.I),
)
_AGAINST = re.compile(r"(?:version|password|token|key|secret|isbn|id|license|v)[\s=:\"']*$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        value = ord(d) - 48
        if n % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _number(digits: str) -> int:
    """The value of a run of digits, of which texts hold any length; a million and more counts as a million."""
    bare = digits.lstrip("0")
    return int(bare or "0") if len(bare) <= 6 else 10**6


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans, by kind and start; positions count code points.

    Linear in the text: an address is looked for around each ``@``, a run of digits read once.
    """
    found: list[Span] = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((0, start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(_number(x) <= 255 for x in m.group().split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            found.append((3, m.start(), m.end()))
    return found


def candidates(text: str) -> list[Span]:
    """Spans of all generators, distinct, by kind and start.

    An address that runs on over the end of a sentence is also proposed without the next one.
    """
    found = {(kind, m.start(), m.end()) for kind, pattern in GENERATORS for m in pattern.finditer(text)}
    for kind, start, end in list(found):
        stop = _SENTENCE.search(text, start, end) if kind == 0 else None
        if stop and GENERATORS[0][1].fullmatch(text, start, stop.start()):
            found.add((kind, start, stop.start()))
    return sorted(found)


FEATURES = 22


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, start, end = span
    inside = text[start:end]
    before, after = text[max(0, start - 40) : start], text[end : end + 40]
    digits = _digits(inside)
    groups = [len(g) for g in re.findall(r"[0-9]+", inside)]
    letters = sum(c.isalpha() for c in inside)
    tail = re.split(r"[.\x20]", inside)[-1]
    return [
        float(kind),
        float(len(inside)),
        float(len(digits)),
        float(letters),
        float(len(groups)),
        float(max(groups, default=0)),
        float(min(groups, default=0)),
        float(inside.count(".")),
        float(inside.count("@")),
        float(inside.count("-") + inside.count(" ")),
        float(inside.count("(") + inside.count("[")),
        float(inside.startswith(("+", "00"))),
        float(luhn(digits) and len(digits) >= 13),
        float(all(int(g) <= 255 for g in re.findall(r"[0-9]{1,6}", inside)) and len(groups) == 4),
        float(tail.isalpha() and 2 <= len(tail) <= 6),
        float(bool(HINTS[kind].search(before)) + bool(HINTS[kind].search(after))),
        float(bool(_AGAINST.search(before))),
        float(before[-1:].isspace() or not before),
        float(after[:1].isspace() or not after),
        float(sum(c in "ABCDEFabcdef" for c in inside) / max(1, len(inside))),
        float(inside.count(" ")),
        float(inside.count(":")),
    ]


@dataclass(frozen=True)
class PersonalDataModel:
    """Boosted trees and, per kind, the least probability of a span that is redacted."""

    trees: BoostedTrees
    thresholds: tuple[float, ...]

    def extra(self, text: str, base: list[Span]) -> list[Span]:
        """Candidates above the threshold of their kind; the likeliest of those that overlap.

        Base spans come first: what overlaps one is covered and not added, unless it holds
        all of each base span it overlaps and more.  What its format refutes is not scored.
        """
        proposed = candidates(text)
        if not proposed:
            return []
        covered, taken = _Cover(base), _Cover([])
        proposed = [c for c in proposed if covered.free(c[1], c[2]) or covered.inside(c[1], c[2])]
        proposed = [c for c in proposed if not refuted(c[0], text[c[1] : c[2]])]
        if not proposed:
            return []
        p = self.trees.probability(np.array([describe(text, c) for c in proposed]))
        chosen = []
        for n in sorted(range(len(proposed)), key=lambda n: (-p[n], proposed[n])):
            kind, start, end = proposed[n]
            if p[n] >= self.thresholds[kind] and taken.free(start, end):
                taken.add(start, end)
                chosen.append(proposed[n])
        return chosen


class _Cover:
    """Disjoint covered stretches; overlapping ones are joined when it is built."""

    def __init__(self, spans: list[Span]):
        self.blocks: dict[int, list[tuple[int, int]]] = {}
        for _, start, end in spans:
            self.add(start, end)

    def add(self, start: int, end: int) -> None:
        for block in range(start >> 8, (end >> 8) + 1):
            self.blocks.setdefault(block, []).append((start, end))

    def free(self, start: int, end: int) -> bool:
        return not any(
            a < end and start < b for block in range(start >> 8, (end >> 8) + 1) for a, b in self.blocks.get(block, ())
        )

    def inside(self, start: int, end: int) -> bool:
        """Whether all that overlaps lies inside the stretch and none of it is the whole stretch."""
        return all(start <= a and b <= end and (a, b) != (start, end) for a, b in self.holds(start, end))

    def holds(self, start: int, end: int) -> list[tuple[int, int]]:
        """What overlaps the stretch."""
        return [
            (a, b) for block in range(start >> 8, (end >> 8) + 1) for a, b in self.blocks.get(block, ()) if a < end and start < b
        ]


Example = tuple[list[float], int]  # features, label


def examples(text: str) -> Iterator[Example]:
    """What one text teaches: candidates and rewritten ones with label 1 for personal data, else 0.

    A candidate that equals a base span is positive, and so is one that goes on from a base span of its kind
    without a blank (``jürgen@firma.de`` around ``rgen@firma.de``).  One that overlaps none is negative if its
    format refutes it, and so is an address that goes on over a blank; all others, which may be data in a format
    the base patterns do not read, teach nothing.  Each positive also teaches broken copies of itself (wrong check digit, part above
    255, too few digits, no domain) as negatives, since texts alone hold few near misses, and copies in
    styles the base patterns do not read (accents, "(at)", spaced and comma IPs, IPv6, cards of 13 to 15 digits, slashes,
    national phone numbers) as positives, some for each generator.
    """
    base = base_spans(text)
    cover, exact = _Cover(base), set(base)
    for span in candidates(text):
        inside = text[span[1] : span[2]]
        if span in exact:
            yield describe(text, span), 1
            yield from ((describe(*other), 0) for other in _rewritten(text, span, _broken(span[0], inside)))
            yield from ((describe(*other), 1) for other in _rewritten(text, span, _restyled(span[0], inside)))
        elif cover.free(span[1], span[2]):
            if refuted(span[0], inside):
                yield describe(text, span), 0
        elif cover.inside(span[1], span[2]):
            own = [(a, b) for a, b in cover.holds(span[1], span[2]) if (span[0], a, b) in exact]
            blank = any(" " in text[span[1] : a] + text[b : span[2]] for a, b in own)
            if own and (span[0] == 0 or not blank):
                yield describe(text, span), int(not blank)


def _fit_rows(x: np.ndarray, label: np.ndarray, check: np.ndarray, n: np.ndarray, precision: float) -> PersonalDataModel:
    """Trees from the rows not held for the check; on the others each kind gets the least threshold, at least
    one half, that reaches ``precision``.  A row counts ``n`` times; a kind without examples is never added."""
    trees = boost(x[~check], label[~check].astype(float), n[~check].astype(float))
    p = trees.probability(x[check])
    thresholds = []
    for kind in range(len(KINDS)):
        mine = x[check][:, 0] == kind
        own = sorted(zip(p[mine], label[check][mine].tolist(), n[check][mine].tolist()), reverse=True)
        least, right, seen = 2.0, 0, 0
        for score, true, times in own:
            seen += times
            right += true * times
            if score >= 0.5 and right >= precision * seen:
                least = score
        thresholds.append(float(least))
    return PersonalDataModel(trees, tuple(thresholds))


def fit(texts: list[str], precision: float = 0.98) -> PersonalDataModel:
    """Trees from the ``examples`` of two thirds of the texts, thresholds from the others'."""
    rows = [(n % 3 == 0, *example) for n, text in enumerate(texts) for example in examples(text)]
    x = np.array([r[1] for r in rows]).reshape(-1, FEATURES)
    return _fit_rows(x, np.array([r[2] for r in rows], int), np.array([r[0] for r in rows], bool), np.ones(len(rows), int), precision)


_DATE = re.compile(r"[0-9]{1,4}([./-])[0-9]{1,2}\1[0-9]{1,4}|(?:(?:19|20)[0-9]{2}[\x20./-]*)+")


def refuted(kind: int, inside: str) -> bool:
    """Whether a candidate cannot be of its kind by its format alone."""
    digits = _digits(inside)
    if kind == 0:
        # A sentence that ends, a blank on one side of the sign only, or no name of a domain at the end.
        aside = re.search(r"\S@\x20|\x20@\S|\S\.\x20", inside)
        return bool(aside) or not re.search(r"[^\W\d_]{2,24}$", inside)
    if kind == 1 and ":" in inside:
        return inside.count(":") != 7
    if kind == 1:
        parts = [_number(x) for x in re.findall(r"[0-9]+", inside)]
        # Numbers in a list are written with a blank after the comma, or are small.
        return max(parts) > 255 or ("." in inside and "," in inside) or ", " in inside or ("," in inside and max(parts) < 32)
    if kind == 2:
        return not (13 <= len(digits) <= 19 and luhn(digits))
    return not 7 <= len(digits) <= 15 or bool(_DATE.fullmatch(inside))


def _with_check(digits: str) -> str:
    """``digits`` and the last digit that makes their sum right."""
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def _broken(kind: int, inside: str) -> list[str]:
    """Near misses of a positive."""
    if kind == 0:
        return [inside.replace("@", ".", 1), inside.split("@")[0] + "@", "x" + inside[inside.index("@") :].split(".")[0]]
    if kind == 1:
        return [re.sub(r"[0-9]+", lambda m: str(_number(m.group()) + 300), inside, count=1), inside.rpartition(".")[0], inside.replace(".", ", "), ":".join(f"{_number(x) % 60:02d}" for x in inside.split("."))]
    digits = _digits(inside)
    if kind == 2:
        wrong = [x[:-1] + str((int(x[-1]) + 1) % 10) for x in (inside, *(_with_check(digits[:n]) for n in (12, 13, 14)))]
        return [*wrong, inside[:10]]
    return [f"{digits[:1]} {digits[1:4]} {digits[4:7]}", inside[: max(3, len(inside) // 2)], f"{digits[:4]} {digits[4:6]} {digits[6:8]}", f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}"]


def _restyled(kind: int, inside: str) -> list[str]:
    """The same datum in formats the base patterns do not read."""
    if kind == 0:
        name, _, domain = inside.partition("@")
        accents, site, last = str.maketrans("aeioucn", "äéíöüçñ"), domain.partition(".")[0], domain.rpartition(".")[2]
        return [
            f"{name} (at) {domain}",
            f"{name}[at]{domain.replace('.', '[dot]')}",
            f"{name[:-1].translate(accents)}é@{domain}",
            f"{name}@{site.translate(accents)}ü.{last}",
            # Shorter ones, so that the length tells little.
            f"{name[:4]}@{domain}",
            f"{name[:4]}@{site[:5]}.{last}",
            f"{name[:3].translate(accents)}é@{site[:5]}.{last}",
            f"{name[:4]}@{site[:5].translate(accents)}ü.{last}",
            f"{name[:4]} (at) {site[:5]}.{last}",
        ]
    digits = _digits(inside)
    if kind == 1:
        a, b, c, d = (_number(x) for x in inside.split("."))
        groups = (0x2000 + a, b, c * 256 + d, a * b + 1, d, a * 256 + c, b * d, c + 1)
        own = [inside.replace(".", " . "), inside.replace(".", ". "), ":".join(f"{x:x}" for x in groups), ":".join(f"{x:04X}" for x in groups)]
        return own if refuted(1, inside.replace(".", ",")) else [*own, inside.replace(".", ",")]
    if kind == 2:
        short = [_with_check(digits[:n]) for n in (12, 13, 14)]
        amex = short[2]
        return ["/".join(digits[n : n + 4] for n in range(0, len(digits), 4)), *short, f"{amex[:4]} {amex[4:10]} {amex[10:]}", f"{amex[:4]}-{amex[4:10]}-{amex[10:]}"]
    if kind == 3:
        found = re.fullmatch(r"\+1[\x20.-]?(\(?[0-9]{3}\)?)[\x20.-]?([0-9]{3})[\x20.-]?([0-9]{4})", inside)
        own = f"0{digits[-8:]}"
        national = [f"{own[:3]} {own[3:6]} {own[6:]}", f"({own[:3]}) {own[3:6]}-{own[6:]}", f"{own[:3]}/{own[3:6]}-{own[6:]}"]
        if len(digits) >= 10:
            own = f"0{digits[-9:]}"
            national += [f"{own[:4]} {own[4:7]} {own[7:]}", " ".join(own[n : n + 2] for n in range(0, 10, 2))]
        return ["00" + inside[1:], "00" + digits, *national, *([f"{found[1]} {found[2]}-{found[3]}", f"{_digits(found[1])}-{found[2]}-{found[3]}"] if found else [])]
    return []


def _rewritten(text: str, span: Span, others: list[str]) -> Iterator[tuple[str, Span]]:
    kind, start, end = span
    before, after = text[max(0, start - 60) : start], text[end : end + 60]
    for other in others:
        yield before + other + after, (kind, len(before), len(before) + len(other))


#: Features that are shares, counted in sixteenths; all others are lengths and counts.
_SHARES = [19]


def _binned(features: list[float]) -> bytes:
    """Features for counting: lengths and counts above 24 in steps of 8 up to 96, shares in sixteenths."""
    x = np.array(features, np.float32)
    x = np.where(x > 24, np.minimum(x // 8 * 8, 96), x)
    x[_SHARES] = np.round(np.array(features, np.float32)[_SHARES] * 16) / 16
    return x.astype("<f4").tobytes()


def count_examples(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """How often the ``examples`` of all documents have the same binned features: ``check, label, features, n``.

    Every document and whole texts; a third of the ids is held for the check.  Equal examples are counted in the
    batches first, so few rows are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for check, value in zip(batch.column("check").to_pylist(), batch.column("text")):
                seen.update((check, label, _binned(features)) for features, label in examples(value.as_py()))
            columns = [pa.array([key[c] for key in seen], kind) for c, kind in enumerate((pa.bool_(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(seen.values(), pa.int64())], ["check", "label", "features", "n"])

    rows = narrow(docs, doc_id=doc_id, text=text).filter(F.col("text").rlike(_SOME_SQL))
    held = rows.select((F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("check"), "text")
    found = held.mapInArrow(run, "check boolean, label int, features binary, n long")
    return found.groupBy("check", "label", "features").agg(F.sum("n").alias("n"))


def fit_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", precision: float = 0.98) -> PersonalDataModel:
    """Fits on the examples of all documents.

    The tasks count them by binned features, and only these counts come to the driver: as many rows as there
    are different bins, whatever the number of documents.  The model depends on the rows alone.
    """
    counted = count_examples(docs, text, doc_id).toArrow().sort_by([("features", "ascending"), ("label", "ascending"), ("check", "ascending")])
    x = np.frombuffer(b"".join(counted["features"].to_pylist()), "<f4").reshape(-1, FEATURES).astype(float)
    label, check, n = (counted[c].to_numpy() for c in ("label", "check", "n"))
    return _fit_rows(x, label, check.astype(bool), n, precision)


def fit_from_sample(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_docs: int = 3000, longest_chars: int = 20_000) -> PersonalDataModel:
    """Fits on at most ``sample_docs`` documents of at most ``longest_chars`` that have a digit or an @.

    Those of the smallest hashed ids, so the model depends on the rows alone.
    """
    rows = narrow(docs, doc_id=doc_id, text=text).filter(F.col("text").rlike("[0-9@]") & (F.char_length("text") <= longest_chars))
    ids = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    # Once more, since rows may share an id.
    sample = rows.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample_docs).collect()
    sample = sorted({(r["doc_id"], r["text"]) for r in sample if r["doc_id"] is not None})
    return fit([t for _, t in sample])


def written(spans: list[Span]) -> str:
    """``kind:start:end`` by kind and start, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


@lru_cache(maxsize=2)
def _masks() -> tuple[str, ...]:
    return tuple(f"<{k}>" for k in KINDS)


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind; overlapping spans become one."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if start >= done:
            out += [text[done:start], _masks()[kind]]
        done = max(done, end)
    return "".join([*out, text[done:]])


def find_personal_data(docs: DataFrame, model: PersonalDataModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base, spans, redacted``.

    ``base`` are the base patterns' spans, which always stay and which the counts are of; ``spans`` adds those the model
    selects.  Both are written ``kind:start:end``, in code points, end exclusive.  ``redacted`` is
    the whole text with all spans replaced, null for null text.

    Null and empty texts have no spans.  Null ids and repeated rows are kept.  Texts are read whole, and
    in linear time.  Other columns of ``docs`` are not used and may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, bases, spans, texts = [[], [], [], []], [], [], []
            for value in batch.column("text"):
                whole = value.as_py()
                base, extra = [], []
                if whole and _SOME.search(whole):
                    base = base_spans(whole)
                    extra = model.extra(whole, base)
                for kind in range(len(KINDS)):
                    counts[kind].append(sum(s[0] == kind for s in base))
                bases.append(written(base))
                spans.append(written(base + extra))
                texts.append(redact(whole, base + extra) if base or extra else whole)
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), *(pa.array(c, pa.string()) for c in (bases, spans, texts))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "redacted"])

    rows = narrow(docs, doc_id=doc_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string, redacted string")


def redact_documents(docs: DataFrame, model: PersonalDataModel, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` redacted; all rows and other columns stay."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value in batch.column(place):
                whole = value.as_py()
                if whole and _SOME.search(whole):
                    base = base_spans(whole)
                    whole = redact(whole, base + model.extra(whole, base))
                texts.append(whole)
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)

