"""Personal data by weak supervision.

Strict patterns find base spans. Looser ones (addresses spelled out, numbers without a country code, defanged or IPv6
addresses, numbers that fail a check) find candidates, on which labelers vote: regular expressions, gazetteers, and what
stands around a span. Expectation-maximisation estimates from all candidates of a corpus how far each labeler can be trusted;
its probabilities train a logistic classifier of spans, which decides on every candidate that is no base span.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from .common import TEXTS, free_name, materialise, small_batches

KINDS = ("email", "ip", "card", "phone")

# Base patterns. They match what the plain ones do, leftmost first, but never try a run of characters twice, so that a long
# run costs as much as it is long.
_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Looser patterns, by the letter of their form.
_LOOSE_AT = re.compile(r" ?[\[({<]at[\])}>] ?| at (?=[A-Za-z0-9-]{1,63}(?: dot |\.[A-Za-z]))| ?@ ?")
_LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?[\[({<]dot[\])}>] ?| dot |\.)[A-Za-z0-9-]{1,63}){0,8}")
_DEFANGED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}){3}(?![0-9])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{2,39}(?![0-9A-Za-z:]))(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}")
_GROUPED = re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._/-]{1,2}[0-9]{4}){2,3}(?:[ ._/-]{1,2}[0-9]{1,3})?(?![0-9])")
_ALONE = re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")
_TIGHT = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,5}\)[ .-]?)?[0-9]{2,5}(?:[ .-][0-9]{2,5}){1,3}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9+(])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ ./-]{1,2}[0-9]{2,5}){1,4}(?![0-9])")

# Words that gazetteers and context labelers know, in the languages of the documents.
DOMAINS = frozenset("com org net edu gov mil int info biz io co dev app eu uk de fr es it us ca au at be br ch cn dk fi ie in jp mx nl no nz pl pt ru se".split())
CUES = {
    "email": frozenset("mail email e-mail mailto contact write address correo contacto escriba courriel adresse contactez kontakt schreiben".split()),
    "ip": frozenset("ip ipv4 ipv6 host server client login peer ping network servidor serveur rechner netzwerk".split()),
    "card": frozenset("card visa mastercard amex credit debit payment tarjeta carte paiement karte kreditkarte zahlung".split()),
    "phone": frozenset("phone telephone tel call mobile cell fax whatsapp llame movil móvil teléfono appelez téléphone portable telefon anrufen handy mobil".split()),
}
COUNTER_CUES = frozenset("version release isbn issn doi order invoice price total page pages chapter section figure table number no ref id sku build year date rechnung bestellung seite commande facture pedido factura página".split())

LABELERS = ("form", "check", "gazetteer", "cue", "counter_cue", "edges", "crowd")
#: Characters before a span in which context labelers look for words.
NEAR = 40
_DATE = re.compile(r"(?:19|20)[0-9]{2}[ ./-][0-9]{1,2}[ ./-][0-9]{1,2}|[0-9]{1,2}[ ./-][0-9]{1,2}[ ./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2} ?- ?(?:19|20)[0-9]{2}")
_WORDS = re.compile(r"[^\W\d_][\w-]*|\d+[.\d]*")
_NUMBER = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the strict patterns' matches that pass their checks: leftmost, not overlapping, for each kind."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start, domain = _run_start(text, at, done), _AT_DOMAIN.match(text, at)
        if start < at and domain:
            done = domain.end()
            out.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    out += [("ip", *m.span()) for m in _QUAD.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PLUS.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _run_start(text: str, end: int, least: int) -> int:
    """Where the run of characters of an address's local part that ends at ``end`` starts, not before ``least``."""
    while end > least and text[end - 1] in _LOCAL:
        end -= 1
    return end


def loose_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, form) of the looser patterns' matches, base spans among them."""
    out, done = [], 0
    for m in _LOOSE_AT.finditer(text):
        start, domain = _run_start(text, m.start(), max(done, m.start() - 64)), _LOOSE_DOMAIN.match(text, m.end())
        if start < m.start() and domain:
            form = "m" if m[0] == "@" else "s" if m[0].strip() == "@" else "b" if m[0].strip() != "at" else "w"
            out.append(("email", start, done := domain.end(), form))
    out += [("ip", *m.span(), "q" if m[0].count("[") + m[0].count("(") == 0 else "d") for m in _DEFANGED.finditer(text)]
    out += [("ip", *m.span(), "6") for m in _IPV6.finditer(text) if any(c != ":" for c in m[0])]
    for m in _DIGITS.finditer(text):  # numbers side by side are one match: those that are a card's length come alone
        if m.end() - m.start() >= 13 and (n := len(_digits(m[0]))) >= 13:
            out += [("card", *m.span(), "l")] if n <= 19 else [("card", *x.span(), "l") for x in _ALONE.finditer(text, m.start(), m.end())]
    out += [("card", *m.span(), "g") for m in _GROUPED.finditer(text)]
    for m in _PLUS.finditer(text):  # a phone number followed by another number
        n = len(_digits(m[0]))
        out += [("phone", *m.span(), "p")] if n <= 15 else [("phone", *x.span(), "t") for x in _TIGHT.finditer(text, m.start(), m.end())]
    out += [("phone", *m.span(), "n") for m in _NATIONAL.finditer(text) if 7 <= len(_digits(m[0])) <= 15]
    return out


_STRICT = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*(?:@|.*[\[({<]at[\])}>].*|.* at .* dot ).*[A-Za-z]{2,}"),
    "ip": re.compile(r"[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=.*::)[0-9A-Fa-f:]{6,}"),
    "card": re.compile(r"[0-9]{13,19}|[0-9]{4}(?:([ ._/-])[0-9]{4})(?:\1[0-9]{4}){1,2}(?:\1[0-9]{1,3})?|3[47][0-9]{2}([ -])[0-9]{6}\2[0-9]{5}"),
    "phone": re.compile(r"\+[0-9][ ().0-9-]+[0-9]|\([0-9]{2,5}\)[ ./-]{1,2}[0-9]{3,5}(?:[ ./-][0-9]{2,5})*|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}|0[0-9]{1,4}[ /-][0-9 -]{5,12}"),
}


def votes(text: str, kind: str, start: int, end: int, form: str) -> str:
    """What each labeler says of a candidate (+, - or 0), in the order of LABELERS, then its form and its number of digits in
    threes: the pattern from which everything else is learnt."""
    span, digits = text[start:end], _digits(text[start:end])
    said = ["-" if kind == "phone" and _DATE.fullmatch(span) else "+" if _STRICT[kind].fullmatch(span) else "0"]
    if kind == "card":
        said += ["+" if 13 <= len(digits) <= 19 and luhn(digits) else "-", "+" if digits[0] in "3456" else "-"]
    elif kind == "phone":
        said += ["+" if 9 <= len(digits) <= 15 else "0" if len(digits) > 6 else "-", "+" if span[0] in "+(" or span.startswith("00") else "0"]
    elif kind == "ip" and form != "6":
        parts = [int(p) for p in _NUMBER.findall(span)]
        said += ["+" if max(parts) <= 255 else "-", "-" if parts[0] == 0 or all(p < 10 for p in parts) else "+"]
    elif kind == "ip":
        said += ["+" if span.count("::") == 1 or span.count(":") == 7 and "::" not in span else "-", "-" if re.fullmatch(r"[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?", span) else "0"]
    else:
        last = re.split(r"[^A-Za-z0-9-]+", span.removesuffix("]").removesuffix(")"))
        said += ["+" if form in "mb" or "dot" in last else "-" if form == "w" or len(last) < 3 else "0", "+" if last[-1].lower() in DOMAINS and len(last) > 2 else "-"]
    before = text[max(0, start - NEAR) : start]
    near = {w.lower() for w in _WORDS.findall(before)[-4:]}
    said.append("+" if near & CUES[kind] else "0")
    said.append("-" if near & COUNTER_CUES or before.rstrip()[-1:] in ("$", "€", "£") or text[end : end + 2].strip()[:1] in ("%", "€", "$") and kind != "email" else "0")
    left, right = text[start - 1 : start], text[end : end + 1]
    said.append("-" if left.isalnum() or left in tuple("_=/#&") or right.isalnum() or right in tuple("_=/&") else "+")
    others = len(_NUMBER.findall(before)) + len(_NUMBER.findall(text[end : end + NEAR]))
    said.append("-" if others >= 6 else "0")
    return "".join(said) + form + (str(min(len(digits), 20) // 3) if kind in ("card", "phone") else "0")


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``found`` in place of ``text`` (and of a column ``found``): an array of structs of kind, start, end (code
    points, end exclusive), base, and the labelers' pattern. Null and empty texts have none; very long ones are read whole,
    once, where they lie; repeated rows are alike; an empty table gives no rows. Written to the shared folder, without the
    texts."""
    keep = [c for c in docs.columns if c != text and c.lower() != "found"]
    whole = free_name(docs, "whole")
    kind = docs.select(*keep).schema.add("found", DataType.fromDDL("array<struct<kind:string,start:int,`end`:int,base:boolean,pattern:string>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, whole):
            made = [marked(t.as_py()) for t in batch.column(whole)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(made, _FOUND)], names=[*batch.schema.names[1:], "found"])

    return materialise(docs.select(F.col(text).cast("string").alias(whole), *keep).mapInArrow(run, kind), "personal", TEXTS)


class Places:
    """Stretches of a text that spans take; spans given at first may overlap."""

    def __init__(self, spans: Iterable[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted((s, e) for _, s, e in spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def free(self, start: int, end: int) -> bool:
        k = bisect_left(self.ends, start + 1)
        return k == len(self.starts) or self.starts[k] >= end

    def add(self, start: int, end: int) -> None:
        k = bisect_left(self.ends, start + 1)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("pattern", pa.string())]))


def marked(text: str | None) -> list[dict]:
    """Base spans, and candidates that overlap none of them, each with the labelers' pattern."""
    if not text:
        return []
    out = []
    base = set(base_spans(text))
    loose = {(k, s, e): form for k, s, e, form in loose_spans(text)}
    for k, s, e in base:
        loose.setdefault((k, s, e), {"email": "m", "ip": "q", "card": "l", "phone": "p"}[k])
    taken = Places(base)
    for (k, s, e), form in sorted(loose.items()):
        if (k, s, e) in base or taken.free(s, e):
            out.append({"kind": k, "start": s, "end": e, "base": (k, s, e) in base, "pattern": votes(text, k, s, e, form)})
    return out


FORMS = "msbwqd6lgptn"
_VALUES = "+0-"


def features(pattern: str) -> np.ndarray:
    """A pattern as zeros and ones: each labeler's vote, the form, the number of digits in threes, and a constant."""
    n = len(LABELERS)
    out = np.zeros(n * 3 + len(FORMS) + 7 + 1)
    for k in range(n):
        out[3 * k + _VALUES.index(pattern[k])] = 1
    out[3 * n + FORMS.index(pattern[n])] = 1
    out[3 * n + len(FORMS) + int(pattern[n + 1])] = 1
    out[-1] = 1
    return out


@dataclass(frozen=True)
class SpanModel:
    """The classifier's weights; for each kind the shares of true candidates and each labeler's (vote, truth) probabilities."""

    weights: np.ndarray
    share: dict[str, np.ndarray]
    reliability: dict[str, np.ndarray]

    def score(self, pattern: str) -> float:
        return float(1 / (1 + np.exp(-features(pattern) @ self.weights)))


#: Beforehand: shares in which a labeler is right, abstains, is wrong, and how many candidates that belief weighs. A failed
#: check of digits or parts is hardly ever a mistake.
BELIEF = {k: (4.0, 4.0, 0.01, 200.0) if k == "check" else (4.0, 4.0, 1.0, 10.0) for k in LABELERS}


def reliabilities(said: np.ndarray, counts: np.ndarray, strict: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns (rows of 0: for, 1: abstains, 2: against) with their counts: the share of
    true candidates among loose and among ``strict`` ones, P(vote | truth) as [labeler, truth, vote], and each pattern's
    probability of being true.

    Labelers are taken as independent given the truth. BELIEF keeps the two sides from changing places, and decides where
    there are few candidates."""
    right = np.array(list(BELIEF.values()))
    right, weight = right[:, :3] / right[:, :3].sum(axis=1)[:, None], right[:, 3, None]
    wrong = np.full_like(right, 4 / 9)  # how a labeler errs for false candidates: no check is proof of truth
    wrong[:, 0] = 1 / 9
    belief = np.stack([wrong * 10, right * weight], axis=1)
    table, share, truth = belief / belief.sum(axis=2)[..., None], np.full(2, 0.5), np.full(len(said), 0.5)
    for _ in range(rounds):
        odds = np.log(share / (1 - share))[strict] + sum(np.log(table[j, 1, said[:, j]] / table[j, 0, said[:, j]]) for j in range(said.shape[1]))
        truth = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        share = (np.bincount(strict, counts * truth, 2) + 5) / (np.bincount(strict, counts, 2) + 10)
        for j in range(said.shape[1]):
            for side, mass in ((1, counts * truth), (0, counts * (1 - truth))):
                row = np.bincount(said[:, j], mass, 3) + belief[j, side]
                table[j, side] = row / row.sum()
    return share, table, truth


def train(patterns: Iterable[tuple[str, str, bool, int]], ridge: float = 0.1, rounds: int = 40) -> SpanModel:
    """A model from (kind, pattern, base, count) of all candidates: labelers' reliabilities for each kind, then a logistic
    classifier over all kinds fitted to their probabilities by Newton's method. Without candidates every span scores a half."""
    by_kind: dict[str, list[tuple[str, bool, int]]] = {}
    for kind, pattern, base, count in sorted(patterns):
        by_kind.setdefault(kind, []).append((pattern, base, count))
    share, table, x, y, w = {}, {}, [], [], []
    for kind, rows in by_kind.items():
        said = np.array([[_VALUES.index(c) for c in p[: len(LABELERS)]] for p, _, _ in rows])
        counts = np.array([c for *_, c in rows], float)
        share[kind], table[kind], truth = reliabilities(said, counts, np.array([int(b) for _, b, _ in rows]))
        x += [features(p) for p, _, _ in rows]
        y += list(truth)
        w += list(np.log1p(counts))  # a form that fills half the corpus must not drown the others
    width = len(features("0" * len(LABELERS) + FORMS[0] + "0"))
    weights = np.zeros(width)
    if x:
        x, y, w = np.array(x), np.array(y), np.array(w)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -60, 60)))
            slope = x.T @ (w * (p - y)) + ridge * weights
            weights = weights - np.linalg.solve((x.T * (w * p * (1 - p))) @ x + ridge * np.eye(width), slope)
    return SpanModel(weights, share, table)


def fit(found: DataFrame) -> SpanModel:
    """A model from all candidates of ``candidates``. A document counts once for each of its patterns, so that none outvotes the
    others; equal patterns are counted before the shuffle; the driver gets one row a
    kind and pattern, of which there are at most 3^7 votes x 12 forms x 7 sizes, whatever the corpus."""
    once = F.array_distinct(F.transform("found", lambda f: F.struct(f["kind"].alias("kind"), f["pattern"].alias("pattern"), f["base"].alias("base"))))
    counted = found.select(F.explode(once).alias("f")).groupBy("f.kind", "f.pattern", "f.base").count()
    return train((r["kind"], r["pattern"], r["base"], r["count"]) for r in counted.collect())


def chosen(found: list[dict], model: SpanModel, limit: float) -> list[dict]:
    """Base spans, and the candidates that score ``limit`` or more, leftmost and longest first, none overlapping; by kind,
    then start."""
    out = [f | {"score": 1.0} for f in found if f["base"]]
    taken = Places((f["kind"], f["start"], f["end"]) for f in out)
    for f in sorted((f for f in found if not f["base"]), key=lambda f: (f["start"], -f["end"], KINDS.index(f["kind"]))):
        if taken.free(f["start"], f["end"]) and (score := model.score(f["pattern"])) >= limit:
            taken.add(f["start"], f["end"])
            out.append(f | {"score": score})
    return sorted(out, key=lambda f: (KINDS.index(f["kind"]), f["start"], f["end"]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))
_SPANS_DDL = "array<struct<kind:string,start:int,`end`:int,base:boolean,score:double>>"


def classify(found: DataFrame, model: SpanModel, limit: float = 0.5) -> DataFrame:
    """The table of ``candidates`` with ``spans`` in place of ``found``: structs of kind, start, end, base and score."""
    keep = [c for c in found.columns if c.lower() not in ("found", "spans")]
    schema = found.select(*keep).schema.add("spans", DataType.fromDDL(_SPANS_DDL))
    shared = found.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [chosen(f, shared.value, limit) for f in batch.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(made, _SPANS)], names=[*keep, "spans"])

    return found.select(*keep, "found").mapInArrow(run, schema)


def scan(docs: DataFrame, limit: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` without their texts, with ``spans``: the personal data in each text. Base spans always stay; others need a score
    of ``limit``. One pass over the texts; reliabilities and classifier come from all candidates of ``docs``. See
    ``candidates`` for nulls, empty and long texts, repeated rows and columns; without any candidate no row has spans."""
    found = candidates(docs, text)
    return classify(found, fit(found), limit)


def redact(docs: DataFrame, model: SpanModel, limit: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in angle brackets, by a model that ``fit`` has made. Overlapping
    base spans are one place, named after the first. Null texts stay null."""
    mask = free_name(docs, "masked")
    schema = StructType([*docs.schema.fields, StructField(mask, StringType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            made = [masked(t.as_py(), shared.value, limit) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, mask])

    out = docs.mapInArrow(run, schema)
    return out.select(*[F.col(mask).alias(c) if c == text else F.col(c) for c in docs.columns])


def masked(text: str | None, model: SpanModel, limit: float = 0.5) -> str | None:
    if not text:
        return text
    out, done = [], 0
    for f in sorted(chosen(marked(text), model, limit), key=lambda f: (f["start"], -f["end"])):
        if f["start"] >= done:
            out += [text[done : f["start"]], f"<{f['kind']}>"]
        done = max(done, f["end"])
    return "".join([*out, text[done:]])
