"""Operator 4 - personal data: patterns propose spans, checksums confirm, context adjusts the score.

Base kinds (leftmost, non-overlapping within a kind): e-mail, IP address, payment card (16-19 digits,
Luhn) and phone number (+ and 8-15 digits).  The method adds two kinds that need evidence beyond a
pattern: ``iban`` (country, check digits, mod-97 equal to 1) and ``number`` (an unconfirmed digit
group of 9 to 15 digits that the words near it name: account, passport, tax, phone ...).

Every span gets a score: a prior of its kind, raised by a passed checksum and by words of its kind
within 40 characters before or 20 after, lowered by words of another meaning (version, build,
example).  Base spans stay whatever their score; added ones need ``ADDED_SCORE``.

Each text is scanned whole.  Positions are code points, ends exclusive.  Defined cases: a null text
counts as empty and has no spans; rows are treated one by one, so repeated rows and null ids need no
rule; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "number")
ADDED_SCORE = 0.6
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.5, "phone": 0.7, "iban": 0.3, "number": 0.3}
CHECKSUM_BONUS, CONTEXT_BONUS, CONTEXT_MALUS = 0.4, 0.3, 0.3
NEAR = {
    "email": re.compile(r"\b(?:e-?mail|contact|write|mailto)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server|client)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|credit|debit|payment)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|transfer|konto)\b", re.I),
    "number": re.compile(r"\b(?:account|passport|tax|ssn|social security|phone|tel|mobile|licence|license no)\b", re.I),
}
AGAINST = re.compile(r"\b(?:version|build|release|isbn|order|example)\b", re.I)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
# A match never starts inside a run of digits; saying so keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?<![0-9.+-])[0-9](?:[\x20-]?[0-9]){8,14}(?![0-9.-])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """What the e-mail pattern finds, by going from one @ to the next: a match holds exactly one."""
    spans, free, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at) if at > free else None
        if m:
            lo = at
            while lo > free and text[lo - 1] in _LOCAL_SET:
                lo -= 1
            if lo < at:
                spans.append((lo, m.end()))
                free = m.end()
        at = text.find("@", at + 1)
    return spans


def _ibans(text: str) -> list[tuple[int, int]]:
    """Spans that pass mod-97; each candidate's longest such end at a group border, as the next word may look like a group."""
    spans, at = [], 0
    while m := _IBAN.search(text, at):
        lo = m.start()
        at = lo + 4
        for hi in (m.end(), *(lo + i for i in range(len(m[0]) - 1, 0, -1) if m[0][i] == " ")):
            plain = text[lo:hi].replace(" ", "")
            if 15 <= len(plain) <= 34 and mod97(plain):
                spans.append((lo, hi))
                at = hi
                break
    return spans


def _score(text: str, kind: str, lo: int, hi: int, checked: bool) -> float:
    around = f"{text[max(0, lo - 40) : lo]} {text[hi : hi + 20]}"
    score = PRIOR[kind] + CHECKSUM_BONUS * checked
    if NEAR[kind].search(around):
        score += CONTEXT_BONUS
    if AGAINST.search(around):
        score -= CONTEXT_MALUS
    return round(min(1.0, max(0.0, score)), 3)


def _united(spans: list[tuple[str, int, int, float]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint ranges that spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for lo, hi in sorted((lo, hi) for _, lo, hi, _ in spans):
        if ends and lo <= ends[-1]:
            ends[-1] = max(ends[-1], hi)
        else:
            starts.append(lo)
            ends.append(hi)
    return starts, ends


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all personal data, by kind as listed in ``KINDS``, then start."""
    spans = []
    if "@" in text:
        spans += [("email", lo, hi, _score(text, "email", lo, hi, False)) for lo, hi in _emails(text)]
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(int(p) <= 255 if len(p) < 20 else not p.strip("0") or int(p.lstrip("0")[:4]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
            spans.append(("ip", m.start(), m.end(), _score(text, "ip", m.start(), m.end(), False)))
    cards = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            cards.append(("card", m.start(), m.end(), _score(text, "card", m.start(), m.end(), True)))
    phones = []
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            phones.append(("phone", m.start(), m.end(), _score(text, "phone", m.start(), m.end(), False)))
    spans += cards + phones
    spans += [("iban", lo, hi, _score(text, "iban", lo, hi, True)) for lo, hi in _ibans(text)]
    starts, ends = _united(spans)
    for m in _NUMBER.finditer(text):
        last = bisect_left(starts, m.end()) - 1
        if last >= 0 and ends[last] > m.start():
            continue
        score = _score(text, "number", m.start(), m.end(), False)
        if score >= ADDED_SCORE:
            spans.append(("number", m.start(), m.end(), score))
    return [s for s in spans if s[0] in BASE_KINDS or s[3] >= ADDED_SCORE]


def _joined(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{lo}:{hi}" for k, lo, hi, _ in spans)


def mask(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by ``[KIND]``; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, lo, hi, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if lo >= at:
            out += [text[at:lo], f"[{kind.upper()}]"]
        at = max(at, hi)
    return "".join(out) + text[at:]


def _detect(masked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            cols: list[list] = [[] for _ in range(8)]
            for text in texts:
                found = find_spans(text) if text else []
                base = [s for s in found if s[0] in BASE_KINDS]
                for i, kind in enumerate(BASE_KINDS):
                    cols[i].append(sum(s[0] == kind for s in base))
                cols[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                cols[5].append(_joined(found))
                cols[6].append([{"kind": k, "start": lo, "end": hi, "score": sc, "value": text[lo:hi]} for k, lo, hi, sc in found])
                cols[7].append(mask(text, found) if masked and found else None)
            span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("value", pa.string())])
            yield pa.record_batch([batch.column(0), *(pa.array(c, type=pa.int64()) for c in cols[:4]), pa.array(cols[4]), pa.array(cols[5], type=pa.string()),
                                   pa.array(cols[6], type=pa.list_(span)), pa.array(cols[7], type=pa.string())],
                                  names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found", "masked"])

    return run


_OUT = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
        "found array<struct<kind:string,start:bigint,end:bigint,score:double,value:string>>, masked string")


def detect_pii(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", masked: bool = False) -> DataFrame:
    """One row per row of ``docs``: counts, span digest, span list with scores and values.

    ``masked`` also returns the masked text of rows that have spans (null: unchanged).
    """
    ship(spark)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_detect(masked), _OUT)


def mask_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with personal data in ``text`` masked and ``n_chars`` updated.

    A single scan without a join: rows keep their place, whatever their ids.
    """
    ship(spark)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            new = []
            for text in batch.column(at).to_pylist():
                found = find_spans(text) if text else []
                new.append(mask(text, found) if found else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, type=batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
