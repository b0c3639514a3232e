"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, schemes, a plus before a digit, adjacent digits (together, or apart by a
dot, blank or hyphen) and identifier cues. Parsers without retries expand each anchor to the whole address, number or
account and validate it. The base kinds come out as their patterns' leftmost non-overlapping matches would.

Defined cases: null text counts as empty; empty texts have no spans; positions count code points, whole texts are read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "ssn", "account")

# Words that announce an identifier, and what it is.
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account", "passport": "account", "routing": "account"}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUADS = re.compile(r"[0-9]+(?:\.[0-9]+)+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HOST = re.compile(r"(?:[^\s/?#@<>\"']+@)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]{1,5})?(?:[/?#][^\s<>\"']*)?")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}")
# Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
SSN = re.compile(r"([0-9]{3})[- ]([0-9]{2})[- ]([0-9]{4})(?![0-9])")
ACCOUNT = re.compile(r"[A-Z]{0,2}[0-9]{6,17}(?![A-Za-z0-9])")
GAP = re.compile(r"(?:\s|[:#=.]|is|no|number|nr){0,6}", re.I)


@lru_cache(1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    digits = "0123456789"
    a.add_word("@", ("email", 1))
    a.add_word("://", ("url", 3))
    for x in digits:
        a.add_word(f"+{x}", ("phone", 2))
        for y in digits:
            a.add_word(f"{x}.{y}", ("ip", 3))
            for gap in ("", " ", "-"):
                a.add_word(f"{x}{gap}{y}", ("card", 2 + len(gap)))
    for cue, kind in CUES.items():
        for word in {cue, cue.upper(), cue.title()}:
            a.add_word(word, (kind, len(cue)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    """Every second digit from the right counts twice, less nine beyond nine; the sum ends in zero."""
    odd = sum(map(int, digits[::-1][::2]))
    even = sum(2 * int(x) - 9 * (x > "4") for x in digits[::-1][1::2])
    return (odd + even) % 10 == 0


def iban_valid(text: str) -> bool:
    compact = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def iban_end(text: str, begin: int) -> int | None:
    """End of the valid account number that begins there: its country's number of signs, with single blanks between."""
    m = IBAN.match(text, begin)
    left = m and IBAN_LENGTHS.get(m[0][:2])
    if not left:
        return None
    left, at = left - 4, m.end()
    while left:
        at += text[at : at + 1] == " "
        c = text[at : at + 1]
        if not (c.isascii() and (c.isdigit() or c.isupper())):
            return None
        left, at = left - 1, at + 1
    return at if not text[at : at + 1].isalnum() and iban_valid(text[begin:at]) else None


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start and kind."""
    found: list[tuple[str, int, int]] = []
    after = dict.fromkeys(KINDS, 0)  # where the next match of a kind may start
    for last, (kind, n) in automaton().iter(text):
        at = last - n + 1
        if at < after[kind] and kind != "email":
            continue
        if kind == "email":
            start, least = at, after["email"]
            while start > least and text[start - 1] in LOCAL:
                start -= 1
            if least <= start < at and (m := DOMAIN.match(text, at + 1)):
                found.append(("email", start, m.end()))
                after["email"] = m.end()
        elif kind == "phone":
            if m := PHONE.match(text, at):
                after["phone"] = m.end()
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    found.append(("phone", at, m.end()))
        elif kind == "ip":
            start = at
            while start > 0 and text[start - 1] in "0123456789":
                start -= 1
            m = QUADS.match(text, start)
            after["ip"] = m.end()
            parts, here = m[0].split("."), start
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = here + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    found.append(("ip", here, end))
                here = end + 1
        elif kind == "card":
            m = DIGITS.match(text, at)
            after["card"] = m.end()
            number = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(number) <= 19 and luhn(number):
                found.append(("card", at, m.end()))
        elif kind == "url":
            start = at
            while start > after["url"] and text[start - 1] in SCHEME:
                start -= 1
            while start < at and not (text[start].isascii() and text[start].isalpha()):
                start += 1
            if start < at and (m := HOST.match(text, at + 3)):
                found.append(("url", start, m.end()))
                after["url"] = m.end()
        else:
            begin = GAP.match(text, last + 1).end()
            if kind == "iban":
                end = iban_end(text, begin)
                good = end is not None
            elif kind == "ssn":
                m = SSN.match(text, begin)
                end = m and m.end()
                good = m and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"
            else:
                m = ACCOUNT.match(text, begin)
                end = m and m.end()
                good = bool(m)
            if good and begin >= after[kind]:
                found.append((kind, begin, end))
                after[kind] = end
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(found), key=lambda s: (s[1], order[s[0]], s[2]))


def joined(found) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>), a row for each row of docs."""

    def run(batches):
        for b in batches:
            out = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t)] for t in b.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame, base: tuple[str, ...] = BASE, others: tuple[str, ...] = KINDS[len(BASE) :]) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *(F.size(of((k,))).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(said(of(base)), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
        *(F.size(of((k,))).cast("long").alias(f"n_{k}") for k in others),
    )


def masked(text: str) -> str:
    """The text with each outermost span replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, start, end in spans(text):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
    return "".join([*out, text[at:]])


def base_digest(found) -> str:
    return hashlib.sha256(joined([s for s in found if s[0] in BASE]).encode()).hexdigest()
