"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust the score.

Kinds with their own proof (email, ip, card, phone) are always reported. The method adds IBANs (mod-97) and
national ids, and scores every span: a checksum raises a score, words before the span that speak of the kind
raise it, words that speak of something else (an order number, say) lower it. Added kinds need `min_score`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone", "iban", "national_id")
BASE_KINDS = KINDS[:4]

_AT = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Words that, within WINDOW characters before a span, raise (first) or lower (second) its score. Fixed values.
CONTEXT = {
    "email": (("mail", "contact", "write"), ()),
    "ip": (("ip", "address", "host", "server"), ("version", "release", "section")),
    "card": (("card", "visa", "credit", "payment"), ("order", "tracking", "isbn")),
    "phone": (("phone", "call", "tel", "mobile", "fax"), ("order", "isbn")),
    "iban": (("iban", "account", "bank", "konto", "cuenta", "compte"), ()),
    "national_id": (("ssn", "social", "security", "national", "identity"), ("order", "part", "isbn", "invoice")),
}
#: Scores before context, by kind. Fixed values.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "national_id": 0.35}
WINDOW = 48
MIN_SCORE = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The domain is looked for first, since '@' is rare; the local part is then the run before it."""
    last = 0
    for m in _AT.finditer(text):
        a = start = m.start()
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        if a < start:
            last = m.end()
            yield a, last


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Confirmed spans (kind, start, end) in code points, kinds as listed, then by start."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def score(text: str, kind: str, start: int) -> float:
    before = text[max(0, start - WINDOW) : start].lower()
    near = set(re.findall(r"[^\W\d_]+", before))
    good, bad = CONTEXT[kind]
    s = PRIOR[kind] + 0.25 * any(w in near for w in good) - 0.25 * any(w in near for w in bad)
    return round(min(1.0, max(0.0, s)), 4)


def added_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in _IBAN.finditer(text):
        found = m[0]
        # The pattern may have taken in words after the number: they go one by one until the checksum holds.
        while not mod97(found) and " " in found:
            found = found.rsplit(" ", 1)[0]
        if mod97(found):
            out.append(("iban", m.start(), m.start() + len(found)))
    if "-" in text:
        for m in _NATIONAL.finditer(text):
            area, group, serial = m[0].split("-")
            if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
                out.append(("national_id", m.start(), m.end()))
    return out


def find(text: str, min_score: float = MIN_SCORE) -> tuple[list[tuple[str, int, int, float]], int]:
    """All spans with scores, base kinds first, and how many of them are base spans."""
    base = [(k, a, b, score(text, k, a)) for k, a, b in base_spans(text)]
    more = [(k, a, b, s) for k, a, b in added_spans(text) if (s := score(text, k, a)) >= min_score]
    return base + more, len(base)


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """Spans of every text: (id, n_base, spans). A null or empty text has none; copies are found each by itself;
    columns besides the two named are left out. Python's regex engine works on code points, so the offsets are
    right for any script. Memory is bounded by one Arrow batch."""
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [find(t, min_score) if t else ([], 0) for t in batch.column(1).to_pylist()]
            spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in found] for found, _ in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in got], pa.int64()), pa.array(spans, pa.list_(item))], ["id", "n_base", "spans"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_base long, spans {SPANS}")


def redact(text: str, min_score: float = MIN_SCORE) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first stays."""
    out, last = [], 0
    for kind, a, b, _ in sorted(find(text, min_score)[0], key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"<{kind}>"]
            last = b
    return "".join([*out, text[last:]])


def sha256_hex(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()
