"""Personal data by anchor expansion: an Aho-Corasick automaton finds cues, and a
local parser expands each into a span and checks it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from slotlake.llm import textkit as kit
from slotlake.llm.common import arrow_schema, extended

# Kinds in their listed order: the base kinds, then those that the method adds.
KINDS = ("email", "ip", "card", "phone", "iban", "account", "login")
BASE = KINDS[:4]

# The base grammars, applied from an anchor on.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
NOT_DIGIT = re.compile(r"[^0-9]")

# Cues of an account number or identifier, and what may follow them.
ACCOUNT_CUES = ("account", "acct", "iban", "ssn", "passport", "konto", "compte", "cuenta")
AFTER_CUE = re.compile(r"[\s:#=]*")
ACCOUNT = re.compile(r"(?:\s+(?:number|no|nr|id)\b)?\.?\s*[:#=]\s*([A-Z]{0,4}[0-9](?:[\x20-]?[0-9]){4,19})(?![0-9A-Za-z])", re.I)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SCHEME = "://"
USERINFO = re.compile(r"[^\s/@:]+:[^\s/@]+(?=@)")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    turned = plain[4:] + plain[:4]
    return len(plain) >= 15 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


@dataclass
class Found:
    """Spans of one text. `behind` is, for each kind, the end of what it has read."""

    text: str
    spans: list[tuple[int, int, int]]
    behind: dict[str, int]

    def add(self, kind: str, start: int, end: int) -> None:
        self.spans.append((start, KINDS.index(kind), end))


def _email(found: Found, at: int) -> None:
    """An at-sign: the local part reaches back to the last match at most."""
    text, start = found.text, at
    floor = found.behind.get("email", 0)
    local = EMAIL_LOCAL.match
    while start > floor and local(text, start - 1):
        start -= 1
    if start < at and (m := EMAIL_DOMAIN.match(text, at + 1)):
        found.add("email", start, m.end())
        found.behind["email"] = m.end()


def _digit(found: Found, at: int) -> None:
    """A digit: an address of four parts, or a card number. Either reads a run of
    digits whole, so a run that gives no match at its start gives none within."""
    text = found.text
    if at >= found.behind.get("ip", 0):
        if m := IP.match(text, at):
            parts = [x.lstrip("0") for x in m[0].split(".")]
            if all(len(x) < 4 and int(x or "0") <= 255 for x in parts):
                found.add("ip", at, m.end())
            found.behind["ip"] = m.end()
        else:
            found.behind["ip"] = DIGITS.match(text, at).end()
    if at >= found.behind.get("card", 0):
        if m := CARD.match(text, at):
            if 12 <= m.end() - at <= 40:
                digits = NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.add("card", at, m.end())
            found.behind["card"] = m.end()


def _plus(found: Found, at: int) -> None:
    if at >= found.behind.get("phone", 0) and (m := PHONE.match(found.text, at)):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            found.add("phone", at, m.end())
        found.behind["phone"] = m.end()


def _account(found: Found, end: int) -> None:
    """Behind a cue: an international account number that passes its check, or an
    identifier with a digit that a colon, equals or number sign announces."""
    m = ACCOUNT.match(found.text, end)
    start = AFTER_CUE.match(found.text, end).end()
    if (i := IBAN.match(found.text, start)) and iban_valid(i[0]):
        if start >= found.behind.get("iban", 0):
            found.add("iban", start, i.end())
            found.behind["iban"] = found.behind["account"] = i.end()
    elif m and m.start(1) >= found.behind.get("account", 0):
        found.add("account", m.start(1), m.end(1))
        found.behind["account"] = m.end(1)


def _scheme(found: Found, end: int) -> None:
    """Behind a scheme: user and password of a login."""
    if end >= found.behind.get("login", 0) and (m := USERINFO.match(found.text, end)):
        found.add("login", end, m.end())
        found.behind["login"] = m.end()


@lru_cache(1)
def _automaton():
    """Anchors with their parsers. Digits are anchors as well: two base kinds start
    at one without any cue."""
    import ahocorasick

    anchors: dict[str, tuple[Callable[[Found, int], None], int]] = {"@": (_email, 0), "+": (_plus, 0)}
    anchors |= {d: (_digit, 0) for d in "0123456789"}
    anchors[SCHEME] = (_scheme, 1)
    for cue in ACCOUNT_CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            anchors[form] = (_account, 1)
    machine = ahocorasick.Automaton()
    for text, what in anchors.items():
        machine.add_word(text, what)
    machine.make_automaton()
    return machine


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start, then kind as listed; code points,
    end exclusive. Spans of different kinds may overlap."""
    found = Found(text, [], {})
    for last, (parse, behind) in _automaton().iter(text):
        parse(found, last + behind)
    return [(KINDS[k], start, end) for start, k, end in sorted(set(found.spans))]


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document.

    Base kinds are found by the fixed grammars, leftmost and without overlap within
    a kind; the method adds account numbers, IBANs and logins where a cue announces
    them. base_sha256 covers the base spans only. A null text is empty: no spans and
    the digest of nothing. Texts are read whole; repeated rows are judged alike;
    other columns are not looked at; an empty table gives no rows.
    """
    counts = ", ".join(f"n_{kind} long" for kind in BASE)
    ddl = extended(docs.select("doc_id").schema, f"{counts}, base_sha256 string, spans string")
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in kit.blocks(batches, "text"):
            rows = []
            for text in block["text"].to_pylist():
                spans = find(text or "")
                base = [s for s in spans if s[0] in BASE]
                kinds = [s[0] for s in base]
                digest = hashlib.sha256(spans_text(base).encode()).hexdigest()
                rows.append((*[kinds.count(k) for k in BASE], digest, spans_text(spans)))
            yield kit.record(schema, block["doc_id"], *map(list, zip(*rows, strict=True)))

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def merged(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans without overlap: overlapping ones become one, named by the first."""
    out: list[list] = []
    for kind, start, end in spans:
        if out and start < out[-1][2]:
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([kind, start, end])
    return [tuple(x) for x in out]


def redacted(text: str) -> str:
    """The text with each span replaced by its kind in angle brackets."""
    parts, at = [], 0
    for kind, start, end in merged(find(text)):
        parts += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The rows and columns of `docs` with personal data replaced in the text, and
    n_chars (if there) following it. A null text stays null."""
    schema = arrow_schema(docs.schema)
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in kit.blocks(batches, "text"):
            texts = [t if t is None else redacted(t) for t in block["text"].to_pylist()]
            columns = {n: block.column(k) for k, n in enumerate(names)} | {"text": texts}
            if "n_chars" in columns:
                columns["n_chars"] = [
                    old if t is None else len(t)
                    for t, old in zip(texts, block["n_chars"].to_pylist(), strict=True)
                ]
            yield kit.record(schema, *[columns[n] for n in names])

    return docs.mapInArrow(run, docs.schema)
