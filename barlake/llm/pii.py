"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust a score.

The base kinds (email, ip, card, phone) are fixed by their patterns and stay whatever the score says.
The method adds further kinds, which need a score of at least ``MIN_SCORE``: iban (mod-97), national
identity numbers (by context words), secrets of any length next to a key name. Every pattern is anchored so that scanning is linear in the text.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, tune

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
MIN_SCORE = 0.6
#: Words within this many characters of a span count as its context.
NEAR = 48

# Patterns of the kinds.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}+={0,2}(?![A-Za-z0-9+/_=-])")

# Context words by kind.
CONTEXT = {
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta", "transfer"),
    "ssn": ("ssn", "social", "security", "insurance", "identity"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "key", "bearer", "credential"),
}
AGAINST = ("example of", "isbn", "order", "invoice", "version")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the check digits make the rearranged number 1 modulo 97."""
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str):
    """Leftmost non-overlapping matches of local@domain.domain, one look at each @, so linear in the text."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def _ip_ok(span: str) -> bool:
    return all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in span.split("."))


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the base kinds in their order, in code points, end exclusive."""
    emails = list(_emails(text)) if "@" in text else []
    ips = [m.span() for m in _IP.finditer(text) if _ip_ok(m.group())]
    cards = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    phones = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15] if "+" in text else []
    return [emails, ips, cards, phones]


def _score(text: str, kind: str, start: int, end: int, sure: float) -> float:
    near = text[max(0, start - NEAR) : start].lower() + " " + text[end : end + NEAR].lower()
    words = re.findall(r"[a-z_]+", near)
    line = f" {' '.join(words)} "
    return sure + 0.3 * any(w in words for w in CONTEXT[kind]) - 0.3 * any(f" {w} " in line for w in AGAINST)


def added_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the kinds that the method adds: iban, ssn, secret."""
    iban, ssn, secret = [], [], []
    m = _IBAN.search(text)
    while m:
        span, after = m.group(), m.start() + 2
        while len(span) >= 15:  # a following capitalised word, or the next number, may have been taken along
            if mod97(span):
                after = m.start() + len(span)
                if _score(text, "iban", m.start(), after, 0.7) >= MIN_SCORE:
                    iban.append((m.start(), after))
                break
            span = span.rpartition(" ")[0]
        m = _IBAN.search(text, after)
    for m in _SSN.finditer(text):
        a, b, c = m.group().split("-")
        if a not in ("000", "666") and a < "900" and b != "00" and c != "0000":
            if _score(text, "ssn", *m.span(), 0.4) >= MIN_SCORE:
                ssn.append(m.span())
    for m in _SECRET.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and _score(text, "secret", *m.span(), 0.4) >= MIN_SCORE:
            secret.append(m.span())
    return [iban, ssn, secret]


def find(text: str | None) -> tuple[list[list[tuple[int, int]]], str, str]:
    """All spans by kind, base spans written out, all spans written out. Null: empty."""
    text = text or ""
    base = base_spans(text)
    found = base + added_spans(text)
    parts = [[f"{k}:{a}:{b}" for a, b in spans] for k, spans in zip(KINDS, found)]
    return found, ",".join(x for p in parts[: len(base)] for x in p), ",".join(x for p in parts for x in p)


def redact(text: str | None, found: list[list[tuple[int, int]]]) -> str | None:
    """Each span gives way to its kind in brackets; where spans overlap, the earlier and then longer one counts."""
    if text is None:
        return None
    spans = sorted(((a, -b, k) for k, one in zip(KINDS, found) for a, b in one))
    if not spans:
        return text
    out, done = [], 0
    for a, b, kind in spans:
        if -b <= done:
            continue
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
        done = -b
    return "".join([*out, text[done:]])


def detect(docs: DataFrame) -> DataFrame:
    """docs' rows and columns with n_email, n_ip, n_card, n_phone, base_spans, spans and redacted added.

    Null text: no spans, redacted null. Repeated rows each get the same; columns that bear an added name
    are replaced.
    """
    tune(docs.sparkSession)
    added = ["n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans", "redacted"]
    docs = docs.drop(*added)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        got = [find(t) for t in texts]
        counts = [pa.array([len(g[0][k]) for g in got], pa.int64()) for k in range(4)]
        clean = pa.array([redact(t, g[0]) for t, g in zip(texts, got)], pa.string())
        arrays = [*batch.columns, *counts, pa.array([g[1] for g in got]), pa.array([g[2] for g in got]), clean]
        return pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(docs, run, f"{fields}, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string, redacted string")
