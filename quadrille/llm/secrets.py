"""Secrets: fixed patterns, and a randomness test battery with length-aware false-discovery control.

Candidates are runs of 20 or more key characters, parted at an `=` inside; a part that no alphabet holds gives its longest
sub-run that one does, and so on with what is left on both sides. The smallest alphabet that holds a run is its inferred
encoding. Three tests look at it as a sequence over that alphabet: chi-squared of its symbol counts against uniform, runs of
its character classes (case, digits, signs; vowels where there is one case), and lag-one serial correlation. Each gives a
deviate that is standard under uniform draws, and the sum of their squares is small for a key and large for a run with
structure. The null hypothesis is structure: the sum's logarithm is calibrated by simulation, by alphabet and length class,
over three kinds of it (words as identifiers write them, repeated blocks, sequences), and a run's p-value is the largest of
the chances that one of these looks as random. Nothing is assumed about the tests' independence. Over the corpus, a step-up
procedure with weights by length (long runs carry more evidence, short ones must show more) bounds the share of false
discoveries; it needs only counts by length class and p-value bin, at most LENGTHS x BINS rows whatever the corpus.
Findings are kind `random`, unless inside a span of the fixed patterns.

Defined cases: null text counts as empty; without candidates nothing is added; positions count code points.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .common import text_or_empty
from .pii import digest

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
PART = re.compile(r"[^=]+(?:=+\Z)?")
#: The two widest alphabets, one of which holds any part without the other's signs.
WIDE = (re.compile(r"[A-Za-z0-9+/]+=*"), re.compile(r"[A-Za-z0-9_-]+=*"))
_LOW, _UP, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings from the smallest alphabet on; runs of decimal digits alone are numbers, not keys.
ALPHABETS = {"decimal": _DIGIT, "hex": _DIGIT + _LOW[:6], "hex_upper": _DIGIT + _UP[:6], "lower": _LOW, "upper": _UP, "base32": _UP + "234567", "base36": _DIGIT + _LOW, "base36_upper": _DIGIT + _UP, "alphanumeric": _UP + _LOW + _DIGIT, "base64": _UP + _LOW + _DIGIT + "+/", "base64url": _UP + _LOW + _DIGIT + "-_"}
INDEX = {k: {c: i for i, c in enumerate(v)} for k, v in ALPHABETS.items()}
SETS = {k: frozenset(v) for k, v in ALPHABETS.items()}

#: Length classes begin here; their weights before scaling grow with the evidence a run of that length can give.
LENGTHS = (20, 28, 36, 48, 64)
BINS, PER_DECADE = 400, 20
#: Simulated runs of each structure, alphabet and length class.
DRAWS = 400
#: The logs lean to the left, so their deviations count by this much more.
WIDER = 1.2
#: Common words, of which the null's identifiers are made.
COMMON = "about account action address after again always application array before begin between block buffer build cache call case category change channel check child class client close code collection column command common component config connect content context control copy count create current customer data database date debug default delete department description detail device directory display document download during element email empty enable engine entity entry error event example exception execute export factory false field file filter final find first folder format from function general generate global group handle header hidden history home image import index info input insert instance integer interface internal item java key label language last layer length level library line link list listener local location login main manager map master member menu message method middle mobile model module month name network next node normal note null number object offset open option order output package page parameter parent password path pattern payment people person phone picture place player point position post power price print private process product profile project property provider public query question random range read record reference region release remote report request resource response result return right role root route sample scale schedule schema screen search second section security select sender server service session setting shared should simple size small social source special standard start state static status storage store string style system table target task template test text thread time title token total track transaction transfer type under unique update upload user utility valid value vector version video view visible water widget window with without world write year yellow zone".split()


def encoding(run: str) -> str | None:
    symbols = frozenset(run.rstrip("="))
    return next((k for k, s in SETS.items() if symbols <= s), None)


def parts(run: str) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a run that one alphabet holds, of the least length of a candidate or more."""
    return [x for m in PART.finditer(run) for x in _held(run, m.start(), m.end())]


def _held(run: str, start: int, end: int) -> list[tuple[int, int]]:
    if end - start < LENGTHS[0]:
        return []
    if encoding(run[start:end]) is not None:
        return [(start, end)]
    s, e = max(((m.start(), m.end()) for wide in WIDE for m in wide.finditer(run, start, end)), key=lambda x: (x[1] - x[0], -x[0]))
    return [*_held(run, start, s), *_held(run, s, e), *_held(run, e, end)]


def _below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


@lru_cache(None)
def _classes(kind: str) -> tuple[dict[str, int], float, float]:
    """Class of each symbol; chance that two uniform draws differ in class, and that two following pairs do."""
    alphabet = ALPHABETS[kind]
    several = sum(any(c in s for c in alphabet) for s in (_LOW, _UP)) > 1
    of = {c: 0 if c in _DIGIT else 1 if c not in _LOW + _UP else 2 + (c in _UP if several else c in "aeiouAEIOU") for c in alphabet}
    shares = np.bincount(list(of.values())) / len(alphabet)
    return of, float(1 - (shares**2).sum()), float((shares * (1 - shares) ** 2).sum())


def deviates(run: str, kind: str) -> tuple[float, float, float]:
    """Of symbol counts, class changes and lag-one correlation, each standard under uniform draws from the alphabet."""
    index = INDEX[kind]
    x = np.array([index[c] for c in run], float)
    n, k = len(x), len(ALPHABETS[kind])
    counts = np.bincount(x.astype(int), minlength=k)
    z_chi = (k / n * float((counts**2).sum()) - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    of, differ, both = _classes(kind)
    said = [of[c] for c in run]
    changes = sum(a != b for a, b in zip(said, said[1:]))
    spread = (n - 1) * differ * (1 - differ) + 2 * (n - 2) * (both - differ**2)
    z_runs = (changes - (n - 1) * differ) / math.sqrt(spread) if spread > 0 else 0.0
    d = x - (k - 1) / 2
    z_serial = float((d[1:] * d[:-1]).sum()) / ((k * k - 1) / 12) / math.sqrt(n - 1)
    return z_chi, z_runs, z_serial


def departure(run: str, kind: str) -> float:
    return sum(z * z for z in deviates(run, kind))


def structured(kind: str, how: str, n: int, rng: random.Random) -> str:
    """A run of n symbols of an alphabet with structure: words, a repeated block of up to 8, or a sequence."""
    alphabet = ALPHABETS[kind]
    if how == "block":
        return ("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 8))) * n)[:n]
    if how == "sequence":
        at, step = rng.randrange(len(alphabet)), rng.choice([-1, 1])
        return "".join(alphabet[(at + step * i) % len(alphabet)] for i in range(n))
    style = rng.choice([str, str.title, str.upper]) if any(c in alphabet for c in _LOW) and any(c in alphabet for c in _UP) else str.lower if _LOW[-1] in alphabet else str.upper
    gap = rng.choice(["", *(c for c in "-_/" if c in alphabet)])
    out, digits = "", any(c in alphabet for c in _DIGIT)
    while len(out) < n:
        out += (gap if out else "") + style(rng.choice(COMMON))
        if digits and rng.random() < 0.15:
            out += str(rng.randrange(1, 100)) if "0" in alphabet else rng.choice("234567")
    return "".join(c for c in out if c in alphabet)[:n]


@lru_cache(None)
def calibration() -> dict[tuple[str, int], list[tuple[float, float]]]:
    """(mean, deviation) of the log departure of each structure an alphabet allows, by alphabet and length class."""
    out = {}
    for kind, alphabet in ALPHABETS.items():
        if kind == "decimal":
            continue
        hows = ["block", "sequence"] + (["words"] if set(_LOW) <= set(alphabet) or set(_UP) <= set(alphabet) else [])
        for k, n in enumerate(LENGTHS):
            rng = random.Random(f"{kind} {n}")
            cells = []
            for how in hows:
                logs = np.log([departure(structured(kind, how, n, rng), kind) + 1e-9 for _ in range(DRAWS if how != "sequence" else 20)])
                cells.append((float(logs.mean()), max(WIDER * float(logs.std()), 0.1)))
            out[kind, k] = cells
    return out


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


def battery(run: str, known: dict | None = None) -> tuple[str | None, float]:
    """(encoding, p): p that a run with structure looks this random; known is calibration()."""
    kind = encoding(run)
    body = run.rstrip("=")
    if kind is None or kind == "decimal" or len(body) < 8:
        return kind, 1.0
    at = math.log(departure(body, kind) + 1e-9)
    cells = (known or calibration())[kind, max(length_class(len(body)), 0)]
    return kind, max(_below((at - mean) / sd) for mean, sd in cells)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def candidates(text: str, base: list[tuple[str, int, int]], known: dict | None = None) -> list[tuple[int, int, int, int]]:
    """(start, end, length class, p-value bin) of runs outside base spans."""
    out = []
    for m in RUN.finditer(text):
        for s, e in parts(m[0]):
            start, end = m.start() + s, m.start() + e
            if any(s < end and start < e for _, s, e in base):
                continue
            kind, p = battery(text[start:end], known)
            if kind is None or kind == "decimal":
                continue
            out.append((start, end, length_class(end - start), min(BINS - 1, int(-math.log10(max(p, 1e-300)) * PER_DECADE))))
    return out


def cutoffs(counts: dict[tuple[int, int], int], level: float = 0.05) -> dict[int, int]:
    """Least significant bin by length class under a weighted step-up procedure.

    A class's weight is its squared least length over the mean of that over all candidates, so weights average one. A bin
    counts with its largest p-value, so the bound holds for all in it.
    """
    total = sum(counts.values())
    if not total:
        return {}
    raw = {i: x * x for i, x in enumerate(LENGTHS)}
    mean = sum(raw[i] * n for (i, _), n in counts.items()) / total
    scaled = sorted((10 ** (-b / PER_DECADE) / (raw[i] / mean), i, b, n) for (i, b), n in counts.items())
    upto, limit = 0, 0.0
    for q, _, _, n in scaled:
        upto += n
        if q <= level * upto / total:
            limit = q
    return {i: min(b for q, j, b, _ in scaled if j == i and q <= limit) for i in raw if any(j == i and q <= limit for q, j, _, _ in scaled)}


def scan(docs: DataFrame, level: float = 0.05) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>), a row for each row of docs."""
    known = calibration()  # some hundred pairs of numbers

    def run(batches):
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        maybe = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("length", pa.int32()), ("bin", pa.int32())]))
        for b in batches:
            base = [base_spans(t) for t in b.column(1).to_pylist()]
            more = [candidates(t, s, known) for t, s in zip(b.column(1).to_pylist(), base)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in base], span),
                    pa.array([[{"start": s, "end": e, "length": n, "bin": p} for s, e, n, p in x] for x in more], maybe),
                ],
                names=["doc_id", "base", "maybe"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    schema = "doc_id long, base array<struct<kind:string,start:long,end:long>>, maybe array<struct<start:long,end:long,length:int,bin:int>>"
    found = cut(rows.mapInArrow(run, schema))
    bins = found.select(F.explode("maybe").alias("m")).groupBy("m.length", "m.bin").count().collect()  # at most LENGTHS x BINS rows
    least = cutoffs({(r["length"], r["bin"]): r["count"] for r in bins}, level)
    chosen = F.lit(False)
    keep = lambda m: chosen if not least else F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in least.items() for x in kv)), m["length"]) <= m["bin"], F.lit(False))
    found_random = F.transform(F.filter("maybe", keep), lambda m: F.struct(F.lit("random").alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    order = F.create_map(*(F.lit(x) for kv in ((k, i) for i, k in enumerate(KINDS)) for x in kv))
    ranked = F.array_sort(F.transform(F.concat("base", found_random), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("k"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.select("doc_id", F.transform(ranked, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def report(found: DataFrame) -> DataFrame:
    return digest(found, BASE, ("random",))
