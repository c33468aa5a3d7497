"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, URL schemes and cues such as
``iban`` or ``token``. Digits anchor the numeric kinds. From each anchor a deterministic local parser
expands to the left and right, validates what it found (label structure, digit counts, Luhn, mod 97)
and returns the exact boundaries.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import map_rows

#: Base kinds in their fixed order, then the kinds that the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("url", "iban", "ssn", "secret", "account")
KINDS = BASE_KINDS + MORE_KINDS

#: Anchors of the automaton, by the parser that they start. Compared in lower case.
ANCHORS = {
    "email": ("@",),
    "phone": ("+",),
    "url": ("http://", "https://", "ftp://"),
    "iban": ("iban",),
    "ssn": ("ssn", "social security"),
    "secret": ("token", "api_key", "apikey", "api key", "secret", "password", "passwd"),
    "account": ("account number", "account no", "acct no", "routing number", "passport no", "passport number"),
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = re.compile(r"[A-Za-z0-9-]+")
DIGITS = re.compile(r"[0-9]+")
PHONE_TAIL = re.compile(r"[\x20().0-9-]*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
URL_REST = re.compile(r"[^\s<>\"'|\\^`{}]*")
#: Between a cue and its value: separators, and up to three plain words.
CUE_GAP = re.compile(r"[\s:=#.\"'-]{1,6}(?:(?:is|was|are|number|no|nr|num|code|value|set|to)[\s:=#.\"'-]{1,6}){0,3}", re.I)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
SSN = re.compile(r"[0-9]{3}[- ]?[0-9]{2}[- ]?[0-9]{4}(?![0-9])")
SECRET = re.compile(r"[A-Za-z0-9_./+=-]{16,}")
PASSWORD = re.compile(r"[^\s\"'<>,;]{8,}")
ACCOUNT = re.compile(r"[A-Z0-9](?:[ -]?[0-9]){5,19}(?![0-9])")


@functools.cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in ANCHORS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def expand_email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Local part to the left (not before ``floor``), labels to the right of the sign at ``at``."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    m = LABEL.match(text, at + 1)
    if start == at or not m:
        return None
    end = m.end()
    labels = 0
    while end < len(text) and text[end] == "." and (m := LABEL.match(text, end + 1)):
        end, labels = m.end(), labels + 1
    return (start, end) if labels else None


def expand_phone(text: str, plus: int) -> tuple[int, int] | None:
    """``+``, a digit, at least one phone character, and a last digit; None where that form is absent."""
    if plus + 1 >= len(text) or text[plus + 1] not in "0123456789":
        return None
    end = PHONE_TAIL.match(text, plus + 2).end()
    while end > plus + 2 and text[end - 1] not in "0123456789":
        end -= 1
    return (plus, end) if end >= plus + 4 else None


def n_digits(text: str) -> int:
    return sum(c in "0123456789" for c in text)


def expand_url(text: str, at: int, size: int) -> tuple[int, int] | None:
    end = URL_REST.match(text, at + size).end()
    while end > at + size and text[end - 1] in ".,;:!?)]*":
        end -= 1
    return (at, end) if end > at + size and text[at + size : end][0] not in "/?#" else None


def expand_iban(text: str, at: int, whole: bool = False) -> tuple[int, int] | None:
    """The longest form at ``at`` that passes the check digits; if ``whole``, one that ends with its word."""
    m = IBAN.match(text, at)
    while m:
        body = m[0].replace(" ", "")
        if int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1 and not (whole and text[m.end() : m.end() + 1].isalnum()):
            return m.span()
        m = IBAN.match(text, at, m.end() - 1)
    return None


def expand_password(text: str, at: int, assigned: bool) -> tuple[int, int] | None:
    """Eight characters or more; behind plain words only (not ``assigned``), not all of them letters."""
    m = PASSWORD.match(text, at)
    if not m:
        return None
    value = m[0].rstrip(".:!?)]}")
    return (at, at + len(value)) if len(value) >= 8 and (assigned or not value.replace("-", "").isalpha()) else None


def expand_cue(kind: str, text: str, end: int) -> tuple[int, int] | None:
    """The identifier that follows a cue ending at ``end``."""
    gap = CUE_GAP.match(text, end)
    if not gap:
        return None
    at = gap.end()
    if kind == "iban":
        return expand_iban(text, at)
    if kind == "ssn":
        m = SSN.match(text, at)
        return m.span() if m and m[0][:3] not in ("000", "666") and m[0][0] != "9" else None
    if kind == "secret":
        m = SECRET.match(text, at)
        if m and any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
            return m.span()
        named = text[max(0, end - 8) : end].lower().endswith(("password", "passwd"))
        return expand_password(text, at, any(c in ":=" for c in gap[0])) if named else None
    m = ACCOUNT.match(text, at)
    return m.span() if m else None


def spans_of(text: str) -> dict[str, list[tuple[int, int]]]:
    """kind -> spans (code points, end exclusive) of one text, each kind leftmost and without overlap."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    floor = dict.fromkeys(KINDS, 0)

    def add(kind: str, span: tuple[int, int] | None, valid: bool = True) -> None:
        if span and span[0] >= floor[kind]:
            floor[kind] = span[1]  # a failing match is used up too: no retry inside it
            if valid:
                out[kind].append(span)

    lowered = text.lower()
    if len(lowered) != len(text):  # a few letters change length in lower case; keep positions exact
        lowered = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    for last, (kind, size) in automaton().iter(lowered):
        at = last - size + 1
        if at < floor[kind]:
            continue
        if kind == "email":
            add(kind, expand_email(text, at, floor[kind]))
        elif kind == "phone":
            if span := expand_phone(text, at):
                add(kind, span, 9 <= n_digits(text[span[0] : span[1]]) <= 15)
        elif kind == "url":
            add(kind, expand_url(text, at, size))
        else:
            add(kind, expand_cue(kind, text, last + 1))
    # IBANs need no cue: the check digits decide
    cued = dict(out["iban"])
    out["iban"], floor["iban"] = [], 0
    for at in sorted(cued.keys() | {m.start() for m in IBAN_START.finditer(text)}):
        if at >= floor["iban"]:
            add("iban", (at, cued[at]) if at in cued else expand_iban(text, at, whole=True))
    for m in DOTTED.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]  # a part may be longer than int() reads
        add("ip", m.span(), all(len(p) <= 3 and int(p or 0) <= 255 for p in parts))
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            add("card", m.span(), 12 <= len(digits) <= 19 and luhn(digits))
    return out


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then by kind as listed."""
    rows = sorted((s, i, e) for i, k in enumerate(kinds) for s, e in spans[k])
    return ",".join(f"{kinds[i]}:{s}:{e}" for s, i, e in rows)


def masked(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with every span (overlapping ones merged, named by the first) replaced by ``<KIND>``."""
    out, at = [], 0
    for s, i, e in sorted((s, i, e) for i, k in enumerate(KINDS) for s, e in spans[k]):
        if s >= at:
            out += [text[at:s], f"<{KINDS[i].upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Find personal data in every whole text (columns doc_id, text; others are ignored).

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more (added kinds), n_spans (all): one row for each input row.
    A null text counts as empty: no spans, the hash of the empty string. Null ids and repeated rows
    pass through; an empty table gives an empty result. Spans of one kind never overlap (leftmost first);
    spans of different kinds may. Rows are judged alone: no shuffle, no hot key.
    """
    schema = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
              "n_more long, n_spans long")

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = spans_of(text.as_py())
            digest = hashlib.sha256(joined(found, BASE_KINDS).encode()).hexdigest()
            yield (doc_id, *(len(found[k]) for k in BASE_KINDS), digest, joined(found, KINDS),
                   sum(len(found[k]) for k in MORE_KINDS), sum(len(found[k]) for k in KINDS))

    return map_rows(_texts(docs), rows, schema)


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, text with every span replaced by its kind in angle brackets. Null texts become empty."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            whole = text.as_py()
            yield doc_id, masked(whole, spans_of(whole))

    return map_rows(_texts(docs), rows, "doc_id long, text string")
