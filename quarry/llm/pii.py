"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

A span is proposed by a regular expression, confirmed by a validator (octet range, Luhn, mod-97,
digit counts, reserved number blocks) and scored; context words within 40 characters raise or
lower the score, and spans under ``min_score`` are dropped.  The four base kinds (email, ip, card,
phone) are always kept once their validator passes; the method adds iban, ssn, national phone
numbers and credentials.

All offsets are code points, end exclusive.  All scans are linear in the text length: digit runs
start only at their first digit, and e-mail addresses are grown outwards from each ``@``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "national", "secret")
BASE_KINDS = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
                     r"|(?i:password|passwd|api_?key|secret|token)\x20?[=:]\x20?\"?[A-Za-z0-9_/+-]{8,128})")
_DIGIT = re.compile(r"[0-9]")

# Words that make a kind likelier, and words that speak against personal data.
_FOR = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"), "ssn": ("ssn", "social", "security", "insurance"),
    "national": ("phone", "call", "tel", "mobile", "fax"), "secret": ("key", "login", "credential"),
}
_AGAINST = ("isbn", "order", "version", "example", "sample", "serial", "part")
_CONTEXT = 40
_WORDS = re.compile(r"[a-z]+")
# score before context: a checksum says more than a shape
_PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.5,
          "national": 0.45, "secret": 0.7}


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(ch, 36)) for ch in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        # without a match the run that ends in this @ can start nothing either
        done = max(done, at + 1)
        at = text.find("@", done)


def _ok_card(s: str) -> bool:
    d = _digits(s)
    return 12 <= len(d) <= 19 and luhn(d)


def _ok_ssn(s: str) -> bool:
    a, b, c = s.split("-")
    return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"


_DIGIT_RULES = (
    ("ip", _IP, lambda s: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))),
    ("card", _CARD, _ok_card),
    ("iban", _IBAN, mod97),
    ("ssn", _SSN, _ok_ssn),
    ("national", _NATIONAL, lambda s: True),
)


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = set(_WORDS.findall((text[max(0, start - _CONTEXT):start] + " " + text[end:end + _CONTEXT]).lower()))
    s = _PRIOR[kind]
    s += 0.25 * any(w in near for w in _FOR[kind])
    s -= 0.25 * any(w in near for w in _AGAINST)
    return round(min(1.0, max(0.0, s)), 2)


def scan(text: str, min_score: float = 0.6) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of one text, by start, then kind as listed in ``KINDS``."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    if _DIGIT.search(text):
        for kind, pattern, valid in _DIGIT_RULES:
            found += [(kind, *m.span()) for m in pattern.finditer(text) if valid(m[0])]
    if "AKIA" in text or "=" in text or ":" in text:
        found += [("secret", *m.span()) for m in _SECRET.finditer(text)]
    base = [(a, b) for k, a, b in found if k in BASE_KINDS]
    out = []
    for kind, a, b in found:
        s = _score(kind, text, a, b)
        if kind in BASE_KINDS or s >= min_score and (
                kind in ("iban", "secret") or not any(x < b and a < y for x, y in base)):
            out.append((kind, a, b, s))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda x: (x[1], rank[x[0]], x[2]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                   ("score", pa.float64()), ("value", pa.string())])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             min_score: float = 0.6) -> DataFrame:
    """One row per input row: the id and ``spans`` (kind, start, end, score, value).

    NULL and empty texts give an empty list; repeated rows are scanned each; other columns are
    ignored; an empty table gives an empty result.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for text in b.column(1).to_pylist():
                spans.append([{"kind": k, "start": s, "end": e, "score": w, "value": text[s:e]}
                              for k, s, e, w in scan(text or "", min_score)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(_SPAN))], ["id", "spans"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(work, f"id {id_type}, spans array<struct<kind:string,start:bigint,`end`:bigint,"
                               "score:double,value:string>>")
    return out.select(F.col("id").alias(id_col), "spans")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result columns of the query: base counts, the hash of the base spans, all spans as text."""
    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    is_base = lambda s: s["kind"].isin(*BASE_KINDS)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        id_col, *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(text(F.filter("spans", is_base)), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("max_score"))
