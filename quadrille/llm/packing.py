"""Best-fit packing by minimum bin slack.

Documents become token pieces. How many pieces there are of each length, at most one number per possible length, goes
to the driver; there, for one bin after another, a bitset subset-sum search over the lengths left, largest first, finds
the fullest combination that holds the largest length left; the combination is taken out as often as it can be. The
plan says which ranks of each length go to which bins, and every piece finds its place by its rank among those of its
length. Ranks come from counts per task and length, so no length gathers in one task.

Defined cases: null and empty texts are the closing id alone (one piece of length 1); every row is packed, also with a
null or repeated doc_id; texts longer than a sequence are cut into whole sequences and a rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .common import release, text_or_empty

#: Fixed name of the vocabulary file.
VOCABULARY = "word_bpe_49k.json"


#: Fixed values of the vocabulary: its normaliser and splitter, and the splitter's pattern without its letters, which are
#: what is left between blanks. White space is spelt out, as the pattern engine's own class is ASCII alone.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
APART = r"'s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\s\x0b\x{85}\x{a0}\p{L}\p{N}]+"
#: Texts with these go to the tokenizer whole: marks that may compose, case rules of more than one letter, rare white space.
ODD = r"[\x00\x1c-\x1f\x{130}\x{250}-\x{10ffff}]"


class WordIds:
    """ids of texts as Tokenizer.encode(text, add_special_tokens=False) gives them, remembered by word.

    Below U+0250 the vocabulary's normaliser is the lower case of each letter, and its splitter never looks across white
    space; so a batch of texts is lowered and split in Arrow, each distinct part is encoded once (many at a time, parted
    by the mark that a word's last id carries), and ids are gathered by part. Other texts, texts that may hold a special
    token, and all texts if the vocabulary is another, go to the tokenizer whole. At most about `most` words are held, and
    the splits of some half a megabyte of texts.
    """

    def __init__(self, path: str, most: int = 120_000):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks fill the cores already

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        suffix = said["model"].get("end_of_word_suffix")
        steps = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.known_rules = bool(suffix) and said.get("normalizer") == NORMALISER and steps[0].get("pattern") == {"Regex": SPLITTER}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most
        if self.known_rules:
            self.plain = Tokenizer(self.tokenizer.model)  # the same model, held once, for parts, which are lowered and split already
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = said["model"]["vocab"]
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for k, i in vocabulary.items() if k.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.known = {"": 0}
        self.first, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids, self.used = np.zeros(1 << 14, np.uint32), 0

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, words: list[str]) -> None:
        for k in range(0, len(words), 1000):
            part = words[k : k + 1000]
            ids = np.asarray(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):  # a word that leaves no mark
                each = [self.whole(w) for w in part]
                ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            at, n = len(self.known), len(part)
            while at + n > len(self.first):
                self.first, self.count = np.r_[self.first, np.zeros_like(self.first)], np.r_[self.count, np.zeros_like(self.count)]
            while self.used + len(ids) > len(self.ids):
                self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
            begins = np.r_[0, ends[:-1]]
            self.first[at : at + n], self.count[at : at + n] = self.used + begins, ends - begins
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.known.update(zip(part, range(at, at + n)))

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in a row, and how many each has."""
        # trimmed, as Arrow's split reads on past white space at the end of a text, into whatever bytes follow it
        split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), APART, r" \0 ")))
        coded = split.flatten().dictionary_encode()
        n = len(coded.dictionary)  # no word holds a blank, so one string carries them all
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), coded.dictionary.cast(pa.string())), " ")[0].as_py().split(" ") if n else []
        if len(self.known) > self.most:
            self.clear()
        number = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, n)
        new = np.flatnonzero(number < 0)
        number[new] = len(self.known) + np.arange(len(new))
        self._learn([words[i] for i in new.tolist()])
        at = number[coded.indices.to_numpy()]
        count = self.count[at]
        after = np.cumsum(count)
        ids = self.ids[np.repeat(self.first[at] - after + count, count) + np.arange(after[-1] if len(after) else 0)]
        return ids, np.diff(np.r_[0, after][split.offsets.to_numpy() - split.offsets[0].as_py()])

    def batch(self, texts: pa.Array, group: int = 1 << 19) -> Iterator[np.ndarray]:
        """ids of each text; some `group` bytes of texts at a time, a text at least."""
        texts = texts.cast(pa.large_string())
        odd = np.ones(len(texts), bool)
        if self.known_rules:
            odd = pc.match_substring_regex(texts, ODD).to_numpy(False).astype(bool)
            for s in self.special:
                odd |= pc.match_substring(texts, s).to_numpy(False).astype(bool)
        upto = np.cumsum(pc.binary_length(texts).to_numpy(False).astype(np.int64))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + group, "right")))
            here = np.flatnonzero(~odd[at:end])
            ids, counts = self._plain(texts.slice(at, end - at).take(pa.array(here))) if len(here) else (None, np.zeros(0, np.int64))
            ends, k = np.cumsum(counts), 0
            for i in range(at, end):
                if odd[i]:
                    yield self.whole(texts[i].as_py())
                else:
                    yield ids[ends[k] - counts[k] : ends[k]]
                    k += 1
            at = end


_SHARED: dict[str, WordIds] = {}


def shared_ids(path: str) -> WordIds:
    """One for each Python worker, which outlives its tasks."""
    if path not in _SHARED:
        _SHARED[path] = WordIds(path)
    return _SHARED[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth): nth counts the pieces of that length in that task."""

    def run(batches):
        release()
        ids = shared_ids(path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        closing = np.array([end_id], "<u4").tobytes()
        for b in batches:
            doc, piece, start, length, crc, nth = [], [], [], [], [], []
            for d, own in zip(b.column(0).to_pylist(), ids.batch(b.column(1))):
                raw = own.astype("<u4").tobytes() + closing
                for k, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at : at + 4 * size]
                    n = len(part) // 4
                    doc.append(d)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    nth.append(int(seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(doc), pa.int32()), pa.array(nth, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )
        ids.clear()  # the vocabulary stays with the worker, the task's words and batches do not
        release()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def fullest(left: dict[int, int], size: int) -> dict[int, int]:
    """The fullest combination of lengths left (length: how many) that holds the largest and fits size.

    Each set bit of `sums` is a reachable fill; lengths come in falling order and a length's copies in powers of two, and
    the search ends early once size itself is reached. Walking the kept bitsets backwards gives the combination.
    """
    lengths = sorted(left, reverse=True)
    first = lengths[0]
    room = size - first
    mask = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        copies, take = min(left[length] - (length == first), room // length), 1
        while copies > 0 and not sums >> room & 1:
            take = min(take, copies)
            steps.append((length, take, sums))
            sums |= (sums << length * take) & mask
            copies -= take
            take *= 2
        if sums >> room & 1:
            break
    fill, out = sums.bit_length() - 1, {first: 1}
    for length, take, before in reversed(steps):
        if not before >> fill & 1:
            out[length] = out.get(length, 0) + take
            fill -= length * take
    return out


def plan(counts: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """[(times, {length: how many in each bin})] that uses up counts."""
    left = {k: v for k, v in counts.items() if v}
    out = []
    while left:
        combination = fullest(left, size)
        times = min(left[k] // v for k, v in combination.items())
        out.append((times, combination))
        for k, v in combination.items():
            left[k] -= times * v
            if not left[k]:
                del left[k]
    return out


def places(made: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length, a row for each use: first rank, first bin, copies in a bin, offset of the first copy."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    bins = 0
    for times, combination in made:
        offset = 0
        for length, copies in combination.items():
            rows.setdefault(length, []).append((used.get(length, 0), bins, copies, offset))
            used[length] = used.get(length, 0) + times * copies
            offset += length * copies
        bins += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def packed(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """pieces() with sequence_id and offset."""
    cutted = cut(pieces(docs, path, size, end_id))
    by_task = cut(cutted.groupBy("length", "task").agg(F.count("*").alias("n")))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    at = places(plan(counts, size))
    offsets = by_task.select("length", "task", before.alias("before"))
    ranked = cutted.join(offsets, ["length", "task"])

    def place(batches):
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("nth").to_numpy() + b.column("before").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                here = length == n
                rows = at[int(n)]
                use = rows[np.searchsorted(rows[:, 0], rank[here], "right") - 1]
                k = rank[here] - use[:, 0]
                sequence[here] = use[:, 1] + k // use[:, 2]
                offset[here] = use[:, 3] + k % use[:, 2] * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
