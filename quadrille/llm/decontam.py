"""Benchmark decontamination: word-pair seeds, counted against an exact bound, then Smith-Waterman alignment.

Words are lower-cased runs of letters and digits. Seeds are all pairs of words that follow each other in an item; a text
holds a seed joined, or split by one word of its own. An alignment of at least half the best score of an item of L words
that holds c joined and s split seeds has 3c + s >= L - 3, within 2L words of the text: with m words matched, o other gaps
between them and the edits' costs, 2m - s - o >= L gives 2c + s + o + 2 >= L, and as every other gap takes a word of the
item or costs two, o <= c + 1. Texts and items below that bound cannot align, whatever the edits; the words around the
rest are aligned by Smith-Waterman, and the score as a share of the item's best possible one decides. Items of at most
three words, or a threshold under a half, to which the bound says nothing, are aligned wherever a word is shared.

The benchmark, a stated query set against all rows, is broadcast in blocks of at most `block` items, each with its own
index; the texts are read once for every `most` blocks (100,000 items) and never shuffled. Defined cases: null text counts as empty; items
without words match nothing, and rows of null item_id or null text are no items; equal items of different ids each get
their row, several texts of one id a row for the best; a document with several copies of an item gets a row for the best,
the first on ties; rows of null doc_id give rows of null doc_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, text_or_empty

WORD = re.compile(r"[^\W_]+")
#: Items of a block, and blocks of one pass over the texts.
BLOCK, TOGETHER = 5_000, 20
#: Alignment by words: equal, different, gap.
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment of item a in words b; start and end count in b.

    Row by row over the item; gaps within a row are a running maximum, so each row is a few numpy operations.
    """
    m = len(b)
    idx = np.arange(m + 1)
    prev, prev_from = np.zeros(m + 1, np.int64), idx.copy()
    best = (0, 0, 0)
    for x in a:
        diag = np.empty(m + 1, np.int64)
        diag[0], diag[1:] = 0, prev[:-1] + np.where(b == x, MATCH, MISMATCH)
        came = np.empty(m + 1, np.int64)
        came[0], came[1:] = 0, prev_from[:-1]
        up = prev + GAP
        use = up > diag
        cur, came = np.where(use, up, diag), np.where(use, prev_from, came)
        dead = cur <= 0
        cur[dead], came[dead] = 0, idx[dead]
        lifted = cur - GAP * idx  # a gap of k costs k, so the best start of a gap is a running maximum
        top = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted == top, idx, 0))
        run = top + GAP * idx
        use = run > cur
        cur, came = np.where(use, run, cur), np.where(use, came[at], came)
        j = int(cur.argmax())
        if cur[j] > best[0]:
            best = (int(cur[j]), int(came[j]), j)
        prev, prev_from = cur, came
    return best


def _index(rows: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys ascending, where each one's items begin, and the items."""
    pairs = np.array(sorted(set(rows)), np.int64).reshape(-1, 2)
    keys, first = np.unique(pairs[:, 0], return_index=True)
    return keys, np.r_[first, len(pairs)], pairs[:, 1]


def _hits(asked: np.ndarray, index: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(item, place) for each place of asked whose key an item has."""
    keys, first, items = index
    if not len(keys) or not len(asked):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    place = np.flatnonzero(keys[at] == asked)
    at = at[place]
    n = first[at + 1] - first[at]
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return items[np.repeat(first[at], n) + inside], np.repeat(place, n)


class Block:
    """A block of items with their seeds and word numbers."""

    def __init__(self, items: dict[int, list[str]], threshold: float):
        self.threshold, self.ids = threshold, {}
        self.items = {i: np.array([self.ids.setdefault(w, len(self.ids)) for w in x], np.int64) for i, x in items.items()}
        self.length = np.zeros(max(items, default=-1) + 1, np.int64)
        for i, x in self.items.items():
            self.length[i] = len(x)
        loose = {i for i, x in self.items.items() if len(x) <= 3 or threshold < 0.5}
        self.width = len(self.ids)
        self.single = _index([(w, i) for i in loose for w in self.items[i].tolist()])
        self.pairs = _index([(k, i) for i, x in self.items.items() if i not in loose for k in (x[:-1] * self.width + x[1:]).tolist()])

    def _keys(self, ids: np.ndarray, far: int) -> np.ndarray:
        a, b = ids[:-far], ids[far:]
        return np.where((a >= 0) & (b >= 0), a * self.width + b, -1)

    def _may(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the bound, and the half of the words that must match, are reached with each place of the item used once."""
        if 2 * np.isin(a, b).sum() < len(a):
            return False
        own = a[:-1] * self.width + a[1:]
        joined, split = (np.isin(own, self._keys(b, far)).sum() for far in (1, 2))
        return bool(3 * joined + split >= len(a) - 3)

    def matches(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item, score, start, end) by item; start and end count words of the text."""
        said = words(text)
        ids = np.fromiter(map(self.ids.get, said, repeat(-1)), np.int64, len(said))
        whole = {int(i): [(0, len(ids))] for i in np.unique(_hits(ids, self.single)[0])} if len(self.single[0]) else {}
        joined, split = (_hits(self._keys(ids, far), self.pairs) for far in (1, 2))
        item, place = np.concatenate([joined[0], split[0]]), np.concatenate([joined[1], split[1]])
        weight = np.repeat([3, 1], [len(joined[0]), len(split[0])])
        total = np.bincount(item, weight, minlength=len(self.length))
        for i in np.flatnonzero((total >= self.length - 3) & (total > 0)).tolist():
            own = item == i
            by = place[own].argsort(kind="stable")
            spans = _windows(place[own][by], weight[own][by], int(self.length[i]), len(ids))
            if spans := [x for x in spans if self._may(self.items[i], ids[x[0] : x[1]])]:
                whole[i] = spans
        out = []
        for i, spans in sorted(whole.items()):
            a, best = self.items[i], (0.0, 0, 0)
            for lo, hi in spans:
                score, s, e = align(a, ids[lo:hi])
                share = score / (MATCH * len(a))
                if share > best[0]:
                    best = (share, lo + s, lo + e)
            if best[0] >= self.threshold:
                out.append((i, round(best[0], 6), best[1], best[2]))
        return out


def _windows(place: np.ndarray, weight: np.ndarray, length: int, most: int) -> list[tuple[int, int]]:
    """Word ranges, overlapping ones joined, around the places from which 2 * length words reach the bound."""
    upto = np.r_[0, np.cumsum(weight)]
    reached = upto[np.searchsorted(place, place + 2 * length)] - upto[np.searchsorted(place, place)]
    out: list[tuple[int, int]] = []
    for p in place[reached >= length - 3].tolist():
        lo, hi = max(0, p - 2 * length), min(most, p + 2 * length)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[int, list[str]]]]:
    """(item_id, words) of the items, at most some `block` at a time; copies of an item count once, null ids and texts not."""
    listed = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    after = None
    while True:
        rows = (listed if after is None else listed.where((F.col("item_id") > after[0]) | (F.col("item_id") == after[0]) & (F.col("text") > after[1]))).orderBy("item_id", "text").limit(block).collect()
        if not rows:
            return
        after = (rows[-1]["item_id"], rows[-1]["text"])
        yield [(r["item_id"], words(r["text"])) for r in rows]


def _passes(benchmark: DataFrame, block: int, most: int) -> list[list[list[tuple[int, list[str]]]]]:
    """Blocks for each pass over the texts, some `most` of them; an item_id's texts stay in one pass."""
    out: list[list] = []
    for x in _blocks(benchmark, block):
        if out and (len(out[-1]) < most or out[-1][-1][-1][0] == x[0][0]):
            out[-1].append(x)
        else:
            out.append([x])
    return out


def _named(texts: list[tuple[int, list[str]]], threshold: float) -> tuple[Block, dict[int, int]]:
    return Block({k: w for k, (_, w) in enumerate(texts) if w}, threshold), {k: i for k, (i, _) in enumerate(texts)}


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, most: int = TOGETHER) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): the best alignment of each row of docs with each item that aligns."""
    schema = "doc_id long, item_id long, score double, start_word long, end_word long"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    parts = [_found(source, blocks, threshold, schema) for blocks in _passes(benchmark, block, most)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def _found(source: DataFrame, blocks: list, threshold: float, schema: str) -> DataFrame:
    shipped = source.sparkSession.sparkContext.broadcast(blocks)  # at most block * most items

    def run(batches):
        made = [_named(x, threshold) for x in shipped.value]
        for b in batches:
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                best: dict[int, tuple] = {}
                for own, names in made:
                    for item, score, s, e in own.matches(t):
                        i = names[item]
                        if i not in best or score > best[i][0]:
                            best[i] = (score, s, e)
                out += [(d, i, *x) for i, x in best.items()]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["doc_id", "item_id", "score", "start_word", "end_word"])

    return source.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, most: int = TOGETHER) -> DataFrame:
    """The rows of docs that align with no item, decided row by row, without a shuffle."""
    for blocks in _passes(benchmark, block, most):
        docs = docs.where(~_aligns(docs.sparkSession.sparkContext.broadcast(blocks), threshold)(text_or_empty()))
    return docs


def _aligns(shipped, threshold: float):
    made: list[tuple[Block, dict[int, int]]] = []

    @F.arrow_udf("boolean")
    def aligns(texts: pa.Array) -> pa.Array:
        if not made:
            release()
            made.extend(_named(x, threshold) for x in shipped.value)
        return pa.array([any(own.matches(t.as_py()) for own, _ in made) for t in texts], pa.bool_())

    return aligns
