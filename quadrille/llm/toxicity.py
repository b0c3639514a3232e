"""Toxicity after noisy-channel deobfuscation.

A character trigram language model is counted over every text. A word that may be disguised (symbols or digits inside,
separators between letters, doubled or repeated letters) becomes a lattice: each sign may stand for itself, for the letters
it resembles, or for nothing, and a run for one, two or all of its letters, at a channel cost. Short tokens that follow
each other become one lattice with their neighbours, in which each blank may stay or stand for nothing. Viterbi decoding
finds the likeliest restored words, whatever their length. A logistic model over restored words and their beginnings, chosen
and fitted on a bounded sample of labelled rows, scores the restored text. Only the text is an input.

Scoring decodes a word only if some path of its lattice spells the letters of a feature of the model from the word's
beginning; else no path gives a feature, so that is exact.

Defined cases: null text counts as empty and gets the model's score of no evidence; without labelled rows of both kinds
every score is the share of label 1 (0 without any); equal texts get equal scores; rows of null doc_id are scored.
"""

from __future__ import annotations

import math
import re
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .common import text_or_empty

# Signs and the letters they resemble.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y"}
SEPARATORS = frozenset(".-_*~^'`,:;/\\#%&=​")

#: Channel costs in nats: a look-alike, a dropped separator, a dropped sign, a shortened run.
LEET, GAP, DROP, SHORT = 1.0, 0.5, 6.0, 0.7

#: Language model alphabet: blank, 26 letters, any other letter.
SYMBOLS = 28
TWICE = re.compile(r"(.)\1")
WORDY = re.compile(r"\w")
TAIL = ".,;:?)]}\"'"
#: Tokens of at most SHORT_TOKEN signs may be pieces of a word; in the fit, SPELT of them in a row.
SHORT_TOKEN, SPELT = 2, 3

#: Bounds of the fit: labelled rows, and features of the model.
TRAIN_ROWS, FEATURES = 12_000, 512
PREFIXES = (5, 6, 7)


def _codes() -> np.ndarray:
    lut = np.full(256, 27, np.uint16)
    lut[: ord("a")] = 0
    for i in range(26):
        lut[ord("a") + i] = lut[ord("A") + i] = i + 1
    lut[ord("z") + 1 : 128] = 0
    return lut


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts over all texts, in an array of SYMBOLS ** 3; each task sends its own sums."""

    def run(batches):
        total, lut = np.zeros(SYMBOLS**3, np.int64), _codes()
        for b in batches:
            for t in b.column(0).cast(pa.binary()):
                raw = np.frombuffer(t.as_py(), np.uint8)
                for k in range(0, len(raw), 1 << 20):
                    c = lut[raw[max(0, k - 2) : k + (1 << 20)]].astype(np.int32)
                    c = c[(c != 27) | (np.r_[0, c[:-1]] != 27)] if len(c) else c  # the bytes of one letter count once
                    if len(c) > 2:
                        total += np.bincount(c[:-2] * SYMBOLS**2 + c[1:-1] * SYMBOLS + c[2:], minlength=SYMBOLS**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    out = np.zeros(SYMBOLS**3, np.float64)
    for r in docs.select(text_or_empty().alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]  # at most SYMBOLS ** 3 rows
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """-log p(c | a, b), interpolated with the bigram and unigram shares."""
    c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    c2, c1 = c3.sum(0), c3.sum((0, 1)) + 1
    p1 = c1 / c1.sum()
    p2 = (c2 + 20 * p1) / (c2.sum(1, keepdims=True) + 20)
    p3 = (c3 + 20 * p2[None]) / (c3.sum(2, keepdims=True) + 20)
    return -np.log(p3).ravel()


def _code(c: str) -> int:
    return 0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else 27


def _groups(said: str) -> list[tuple[str, int]]:
    """Each run of one sign, and its end."""
    out, end = [], 0
    for c, own in groupby(said):
        end += sum(1 for _ in own)
        out.append((c, end))
    return out


def _ways(c: str, n: int) -> list[tuple[str, float]]:
    """What a run of n signs c may stand for and the cost."""
    if c == " ":
        return [(" ", 0.0), ("", GAP)]
    if c.isalpha():
        ways = [(c * min(n, 2), 0.0 if n <= 2 else SHORT)]
        if n > 1:
            ways.append((c, SHORT if n == 2 else 0.0))
        return ways
    ways = [(x * min(n, 2), LEET) for x in LOOKALIKES.get(c, "")]
    if n > 1:
        ways += [(x, LEET + SHORT) for x in LOOKALIKES.get(c, "")]
    return [*ways, ("", GAP if c in SEPARATORS or n > 1 and c not in LOOKALIKES else DROP)]


def _lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of a sign, what it may stand for and the cost."""
    begin, out = 0, []
    for c, end in _groups(word):
        out.append(_ways(c, end - begin))
        begin = end
    return out


def _step(a: int, b: int, letters: str, price: float, lm: list[float]) -> tuple[int, int, float]:
    """State and cost after letters; other letters in a row are one symbol, as in the counts."""
    for c in letters:
        z = _code(c)
        if z == 27 and b == 27:
            continue
        price += lm[(a * SYMBOLS + b) * SYMBOLS + z]
        a, b = b, z
    return a, b, price


def decode(word: str, lm: list[float]) -> str:
    """The likeliest letters behind a word or a run of short tokens with one blank between them; ties go to the first found."""
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for ways in _lattice(word):
        following: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, said) in states.items():
            for letters, price in ways:
                x, y, total = _step(a, b, letters, cost + price, lm)
                old = following.get((x, y))
                if old is None or total < old[0]:
                    following[x, y] = (total, (said, letters) if letters else said)
        states = following
    said = min(((cost + lm[(a * SYMBOLS + b) * SYMBOLS], k) for k, ((a, b), (cost, _)) in enumerate(states.items())))[1]
    node, out = list(states.values())[said][1], []
    while node:
        node, letters = node
        out.append(letters)
    return "".join(reversed(out))


def core_of(word: str) -> str:
    """A word without the marks around it that stand for nothing."""
    i, j = 0, len(word)
    while i < j and not WORDY.match(word[i]) and word[i] not in LOOKALIKES:
        i += 1
    while i < j and not WORDY.match(word[j - 1]) and (word[j - 1] not in LOOKALIKES or word[max(i, j - 2) : j] == word[j - 1] * 2):
        j -= 1
    core = word[i:j]
    if core and core[-1] in "!|" and core[:-1].isalpha() and not TWICE.search(core):
        return core[:-1]  # a final mark is read as one where the letters before it are plain
    return core


def restored(word: str, lm: list[float]) -> str:
    """A white-space word in lower case as the letters it is read as."""
    core = core_of(word)
    return core if not core or core.isalpha() and not TWICE.search(core) else decode(core, lm)


def _end(said: str, at: int) -> int:
    """Where the run of one sign at a place ends."""
    end, c = at + 1, said[at]
    while end < len(said) and said[end] == c:
        end += 1
    return end


def spelt(words: list[str]) -> list[list[str]]:
    """Runs of SPELT or more short tokens, as marks around them leave them."""
    out, run = [], []
    for w in [*words, None]:
        if w is not None and len(w) <= SHORT_TOKEN:
            run.append(w)
        else:
            if len(run) >= SPELT:
                out.append(run)
            run = []
    return out


def joints(words: list[str]) -> list[list[str]]:
    """Maximal runs of short tokens, each with the token before and the one after."""
    out, last = [], -1
    for i in [i for i, w in enumerate(words) if len(w) <= SHORT_TOKEN]:
        if out and i <= last + 1:
            out[-1][1] = i + 2
        else:
            out.append([max(i - 1, 0), i + 2])
        last = i
    return [words[a:b] for a, b in out]


def features(word: str) -> list[str]:
    """A restored word and its beginnings."""
    return [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) > n)] if len(word) > 2 else []


def _held_out(crc_of: int, rest: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % crc_of == rest


def labelled(docs: DataFrame, labels: DataFrame, label: str, crc_of: int, rest: int, rows: int) -> DataFrame:
    """(text, y) of at most `rows` labelled documents outside the held-out remainder, those of least hash first."""
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~_held_out(crc_of, rest)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    chosen = ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")


class _Quick(dict):
    """Three signs -> False if no path over them and what follows begins with one of starts, remembered."""

    def __init__(self, starts: set[str]):
        super().__init__()
        self.starts, self.ones, self.twos = starts, {x[0] for x in starts}, {x[:2] for x in starts}

    def __missing__(self, signs: str) -> bool:
        a, b, c = signs[:1], signs[1:2], signs[2:3]
        maybe = True
        if a.isalpha():
            maybe = a in self.ones
            if maybe and b.isalpha() and a != b:
                maybe = a + b in self.twos
                if maybe and c.isalpha() and b != c:
                    maybe = a + b + c in self.starts
        self[signs] = maybe
        return maybe


class Model:
    """Weights by feature, a bias, and the language model."""

    def __init__(self, lm: list[float], weights: dict[str, float], bias: float, most: int = 200_000):
        self.lm, self.weights, self.bias, self.most = lm, weights, bias, most
        self.starts, self.spelt = {f[1:4] for f in weights}, {f[1:] for f in weights}
        self.parts = {f[:k] for f in self.spelt for k in range(len(f))}
        self._clear()

    def _clear(self) -> None:
        self.quick = _Quick(self.starts)
        self.seen: set[str] = set()
        self.hot: dict[str, tuple] = {}

    def may(self, said: str, at: int = 0) -> bool:
        """Whether some path of the lattice from place `at` on spells a feature's letters."""
        if not self.quick[said[at : at + 3]]:
            return False
        open_ = {""}
        while open_ and at < len(said):
            end = _end(said, at)
            ways, at = _ways(said[at], end - at), end
            grown = set()
            for x in open_:
                for letters, _ in ways:
                    y = x
                    for c in letters:
                        y += c
                        if y in self.spelt:
                            return True
                    if y in self.parts:
                        grown.add(y)
            open_ = grown
        return False

    def hits(self, word: str) -> tuple:
        """The model's features that a white-space word in lower case has."""
        core = word if word[0].isalpha() else core_of(word)
        if not core or not self.may(core):
            return ()
        return tuple(f for f in features(restored(word, self.lm)) if f in self.weights)

    def joined(self, run: list[str]) -> tuple:
        """The model's features of a run of short tokens and its neighbours, read as one."""
        said = "".join(run)
        if not said.isalpha():
            run = [x for x in (w if w.isalpha() else core_of(w) for w in run) if x]
            said = "".join(run)
        at, some, covered = 0, False, 0
        for w in run[:-1]:
            if at >= covered:
                if self.may(said, at):
                    some = True
                    break
                if said[at + 1 : at + 3] == said[at] * 2:  # places that leave three equal signs or more are alike
                    covered = _end(said, at) - 2
            at += len(w)
        if not some:
            return ()
        return tuple(f for w in decode(" ".join(run), self.lm).split(" ") for f in features(w) if f in self.weights)

    def found(self, text: str) -> set[str]:
        """The model's features in a text."""
        words = text.lower().split()
        distinct = set(words)
        if len(self.seen) > self.most:
            self._clear()
        for w in distinct.difference(self.seen):
            if x := self.hits(w):
                self.hot[w] = x
        self.seen |= distinct
        out = {f for w in distinct.intersection(self.hot) for f in self.hot[w]}
        for run in self.flagged(words):
            out.update(self.joined(run))
        return out

    def flagged(self, words: list[str]) -> list[list[str]]:
        """joints(words) but for those that three signs after each place in them rule out."""
        out, quick, last, first, flag = [], self.quick, -2, 0, False
        for i in [i for i, w in enumerate(words) if len(w) <= SHORT_TOKEN]:
            if i != last + 1:
                if flag:
                    out.append(words[first : last + 2])
                first = max(i - 1, 0)
                flag = i > 0 and quick[words[i - 1][:3]]
            if not flag and i + 1 < len(words):
                flag = quick[(words[i] + words[i + 1])[:3]]
            last = i
        return out + [words[first : last + 2]] * flag

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weights[f] for f in sorted(self.found(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(rows: list[list[int]], y: np.ndarray, width: int, decay: float = 0.0003, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent on the mean log loss with a squared penalty."""
    n = len(rows)
    x = np.zeros((n, width), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    w, b, vw, vb = np.zeros(width, np.float32), 0.0, np.zeros(width, np.float32), 0.0
    y = y.astype(np.float32)
    rate = 4 / max(1.0, float(x.sum(1).mean()) + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ (w + np.float32(0.9) * vw) + np.float32(b + 0.9 * vb))))
        g = ((p - y) / n).astype(np.float32)
        vw = (0.9 * vw - rate * (g @ x + decay * (w + 0.9 * vw))).astype(np.float32)
        vb = 0.9 * vb - rate * float(g.sum())
        w, b = w + vw, b + vb
    return w, b


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, width: int = FEATURES, least: int = 4) -> Model:
    """The language model over all docs, and weights from at most `rows` labelled rows and `width` features."""
    lm = language_model(trigram_counts(docs)).tolist()
    sample = cut(labelled(docs, labels, "toxic", 4, 2, rows))

    def run(batches):
        known: dict[str, list] = {}
        for b in batches:
            if len(known) > 50_000:
                known.clear()
            ids, said = [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                own: set[str] = set()
                words = t.lower().split()
                for w in set(words):
                    if w not in known:
                        known[w] = features(restored(w, lm))
                    own.update(known[w])
                for run in spelt(words):
                    for w in decode(" ".join(x for x in map(core_of, run) if x), lm).split(" "):
                        own.update(features(w))
                ids.append(i)
                said.append(sorted(own))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), b.column("y"), pa.array(said, pa.list_(pa.string()))], names=["doc_id", "y", "found"])

    seen = cut(sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, found array<string>"))
    total = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.count("*").alias("n")).collect() if r["y"] in (0, 1)}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    if not n0 or not n1:
        return Model(lm, {}, 30.0 if n1 else -30.0)
    by = seen.select("y", F.explode("found").alias("f")).groupBy("f").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("k1"), F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("k0"))
    p1, p0 = (F.col("k1") + 0.5) / (n1 + 1.0), (F.col("k0") + 0.5) / (n0 + 1.0)
    gain = F.col("k1") * F.log(p1 / p0)
    top = by.where((F.col("k1") >= least) & (p1 > 3 * p0)).orderBy(gain.desc(), "f").limit(width).select("f").collect()  # at most width rows
    names = sorted(r["f"] for r in top)
    if not names:
        return Model(lm, {}, math.log(n1 / n0))
    at = {f: i for i, f in enumerate(names)}
    chosen = F.array_intersect("found", F.array(*map(F.lit, names)))
    got = seen.select("y", chosen.alias("found")).collect()  # at most `rows` rows of at most `width` names
    got = sorted((r["y"], sorted(at[f] for f in r["found"])) for r in got if r["y"] in (0, 1))
    w, b = logistic([r for _, r in got], np.array([y for y, _ in got], float), len(names))
    return Model(lm, dict(zip(names, w.tolist())), b)


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with the score of each whole text."""
    lm, weights, bias = model.lm, model.weights, model.bias
    own: list[Model] = []

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not own:
            own.append(Model(lm, weights, bias))
        return pa.array([own[0].score(t) for t in texts.to_pylist()], pa.float64())

    return docs.withColumn(column, score(text_or_empty()))


def verdicts(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    held = F.coalesce(_held_out(4, 2), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
