"""Quality by histogram gradient-boosted trees over document statistics.

Statistics of each whole text (lengths, shares of character kinds, repetition of words and lines, entropy) are binned by
quantiles of the fitted rows; trees grow level by level from gradient histograms; all trees are complete and flattened
into arrays of feature, threshold and leaf value, which numpy walks for a batch of rows at once.

Defined cases: null text counts as empty, whose statistics are all zero; without labelled rows of both kinds every score
is the share of label 1 (0 without any); equal texts get equal scores; rows of null doc_id are scored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .common import text_or_empty
from .toxicity import labelled

#: Bounds of the fit.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST, L2 = 80, 4, 64, 0.15, 20, 1.0

NAMES = ("bytes", "words", "word_length", "word_length_sd", "distinct_words", "top_word", "longest_word", "lines", "line_length", "repeated_lines", "upper", "digits", "punctuation", "odd_signs", "pipes", "blanks", "beyond_ascii", "full_stops", "closed_lines", "repeats_in_row", "char_entropy", "compressed", "marked_words", "capital_words")


def _kinds() -> np.ndarray:
    """Columns: upper case, digits, punctuation, odd signs, pipes, blanks, beyond ASCII, full stops."""
    c = np.arange(256)
    char = [chr(i) for i in range(128)]
    has = lambda s: np.array([x in s for x in char] + [False] * 128)
    return np.stack([(c > 64) & (c < 91), (c > 47) & (c < 58), has(".,;:!?'\"()-"), has("#$%&*@^~_=+<>{}[]\\/"), has("|"), has(" \t\n\r"), c > 127, has(".!?")], 1).astype(float)


KINDS = _kinds()


def statistics(text: bytes) -> list[float]:
    """One value for each of NAMES."""
    n = len(text)
    if not n:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = (counts @ KINDS) / n
    p = counts[counts > 0] / n
    entropy = float(-(p * np.log2(p)).sum())
    words = text.split()
    m = len(words)
    lines = [x for x in text.split(b"\n") if x]
    if m:
        sizes = np.fromiter(map(len, words), np.int64, m)
        seen = Counter(words)
        mean, sd, longest = float(sizes.mean()), float(sizes.std()), int(sizes.max())
        distinct, top = len(seen) / m, max(seen.values()) / m
        in_row = sum(map(bytes.__eq__, words, words[1:])) / m
        marked = sum(k for w, k in seen.items() if w[-2:-1] in b"#$%&*!@" and w[-2:-1] == w[-1:]) / m
        capital = sum(k for w, k in seen.items() if w.isupper() and len(w) > 1) / m
    else:
        mean = sd = distinct = top = in_row = marked = capital = 0.0
        longest = 0
    k = len(lines)
    closed = sum(x[-1:] in b".!?\"" for x in lines) / k if k else 0.0
    repeated = 1 - len(set(lines)) / k if k else 0.0
    packed = _compressed(text)
    up, digits, punctuation, odd, pipes, blanks, beyond, stops = shares.tolist()
    return [math.log1p(n), math.log1p(m), mean, sd, distinct, top, math.log1p(longest), math.log1p(k), math.log1p(n / max(k, 1)), repeated, up, digits, punctuation, odd, pipes, blanks, beyond, stops * n / max(m, 1), closed, in_row, entropy, packed, marked, capital]


def _compressed(text: bytes) -> float:
    """Compressed share of the whole text, block by block."""
    return sum(len(zlib.compress(text[k : k + 65536], 1)) for k in range(0, len(text), 65536)) / len(text)


class Trees:
    """Complete trees of one depth as arrays: feature and threshold by inner node, value by leaf."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, base: float):
        self.feature, self.threshold, self.value, self.base = feature, threshold, value, base

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(self.feature):
            return out
        depth = int(math.log2(self.feature.shape[1] + 1))
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, least: int = LEAST) -> Trees:
    """Boost on the log loss: histograms of gradients and curvatures by node, feature and bin; best gain by node."""
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(f)], 1)
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    base = math.log(share / (1 - share))
    margin = np.full(n, base)
    inner = 2**depth - 1
    features, thresholds, values = [], [], []
    offsets = np.arange(f) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (f * bins) + offsets + binned).ravel()
            shape = (width, f, bins)
            sums = [np.bincount(cell, np.repeat(v, f), width * f * bins).reshape(shape).cumsum(2) for v in (g, h, np.ones(n))]
            (gl, hl, nl), (gt, ht, nt) = sums, (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
            gain[(nl < least) | (nt - nl < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for i in range(width):
                j, b = divmod(int(best[i]), bins)
                if gain[i, j, b] > 1e-9 and b < len(edges[j]):
                    feature[first + i], threshold[first + i] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + L2)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees from at most `rows` labelled rows, whose statistics alone go to the driver."""

    def run(batches):
        for b in batches:
            x = [statistics(t.as_py()) for t in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    sample = cut(labelled(docs, labels, "quality", 3, 1, rows).select("doc_id", "text", "y"))
    got = sorted((r["y"], list(r["x"])) for r in sample.mapInArrow(run, "y int, x array<double>").collect() if r["y"] in (0, 1))
    y = np.array([v for v, _ in got], float)
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)), 30.0 if len(y) and y[0] else -30.0)
    return grow(np.array([x for _, x in got]), y)


def scored(docs: DataFrame, trees: Trees, column: str = "score") -> DataFrame:
    """docs with the score of each whole text."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(t.as_py()) for t in texts.cast(pa.binary())]).reshape(-1, len(NAMES))
        return pa.array(trees.score(x), pa.float64())

    return docs.withColumn(column, score(text_or_empty()))


def verdicts(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
