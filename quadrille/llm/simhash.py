"""SimHash near-duplicates: segment-popcount embedding, grid range join, exact check.

Two operators share the method. A fingerprint is a set of bits in segments; its embedding is the number of bits set in
each segment; the Manhattan distance of two embeddings never exceeds the number of bits that differ, so it prunes what
the grid lets through, and an exact comparison decides.

components(): 64-bit SimHash fingerprints that differ in at most two bits. The grid key holds two of four blocks (two
segments each), which differ nowhere if at most two bits differ, and the cells of the other two blocks' bit counts, of
which a probe visits every one in reach. Only distinct fingerprints are joined. Keys shared by more than `hot`
fingerprints leave the pair join: their members are linked through the at most 65 fingerprints that share a one-bit
neighbour, which is exact and linear, so no group emits all its pairs.

distinct(): texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. At that similarity 64-bit
fingerprints differ in some ten bits, beyond any grid, so the fingerprint is the shingle set itself as a bitmap over hashes:
two sets of n and m shingles are that similar exactly if at most (n + m) / 9 bits differ. The grid: classes of size (the
whole popcount, a probe visits the next class), and the content of segments, whose number in a class exceeds the bits that
may differ, so that some segment with a shingle is the same in both; where chance leaves too few segments filled for that, a
text is dealt into segments anew until it has enough, and any partner with the same lack is met there. How many segments a
partner must share is known, so texts that share fewer with all others are left out. Texts of a segment meet the one that
shares most; those outside its component are then compared in blocks with the others that share a segment with it: by their
embeddings, then by the parities of finer segments, which differ in no more places than the bits do. A block gives a spanning
forest of the components that these bounds leave together, not all their pairs. No link is lost, and only connected
components are asked for, so copies do not meet in all pairs.

Defined cases: null text counts as empty; A-Z are lower-cased, words are what white space parts, and texts of fewer words
than a shingle are one shingle of them all; a text without words has fingerprint zero and the empty set, and links to its
like; equal rows share a node; rows of null doc_id are linked too, and never name a component unless all its rows are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected
from ..storage import cut, scratch
from .common import release, text_or_empty, with_row, without

SEED = 42
CHUNK = 1 << 15


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash of the word shingles of UTF-8 text, with A-Z lower-cased; 0 without words."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    if n == 1:
        ends, starts = [len(line)], [0]
    else:
        length = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
        after = np.cumsum(length)
        starts = (after - length)[:n].tolist()
        ends = (after[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    count = np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        h = np.array([digest(line[s:e], SEED) for s, e in zip(starts[k : k + CHUNK], ends[k : k + CHUNK])], dtype=">u8")
        count += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * count > n).view(">u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed 64-bit long."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            out = np.array([fingerprint(t.as_py(), words) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp long")


def _block(i: int):
    return F.shiftrightunsigned("fp", 48 - 16 * i).bitwiseAND(F.lit(0xFFFF))


def _segments(fp: str) -> list:
    return [F.bit_count(F.shiftrightunsigned(fp, 56 - 8 * i).bitwiseAND(F.lit(0xFF))) for i in range(8)]


def _manhattan(a: str, b: str):
    total = F.lit(0)
    for x, y in zip(_segments(a), _segments(b)):
        total = total + F.abs(x - y)
    return total


def links(nodes: DataFrame, width: int = 5, hot: int = 64) -> DataFrame:
    """Edges (a, b) of nodes(fp, node) that connect all fingerprints with at most two differing bits."""
    reach = 2
    own, probe = [], []
    for k, (i, j) in enumerate(combinations(range(4), 2)):
        c, d = (x for x in range(4) if x not in (i, j))
        base = F.shiftleft(_block(i), 16).bitwiseOR(_block(j)).alias("base")
        pc, pd = F.bit_count(_block(c)), F.bit_count(_block(d))
        cell = lambda x: F.floor(x / width).cast("int")
        own.append(F.struct(F.lit(k).alias("k"), base, cell(pc).alias("c"), cell(pd).alias("d")))
        for up in (0, 1):
            for side in (0, 1):
                at = lambda x, far: cell(x + (reach if far else 0))
                low = cell(pd - reach) if side == 0 else cell(pd + reach)
                c_at = at(pc, up)
                ok = F.lit(True) if not up else c_at != cell(pc)
                ok = ok & (F.lit(True) if side == 0 else low != cell(pd - reach))
                probe.append(F.when(ok, F.struct(F.lit(k).alias("k"), base, c_at.alias("c"), low.alias("d"))))
    keyed = nodes.select("fp", "node", F.explode(F.array(*own)).alias("key")).select("fp", "node", "key.*")
    crowded = cut(keyed.groupBy("k", "base").count().where(F.col("count") > hot).select("k", "base"))
    probes = nodes.select("fp", "node", F.explode(F.array_compact(F.array(*probe))).alias("key")).select("fp", "node", "key.*")
    any_hot = not crowded.isEmpty()
    if any_hot:
        members = cut(keyed.join(crowded, ["k", "base"], "left_semi").select("fp", "node").distinct())
        keyed = keyed.join(crowded, ["k", "base"], "left_anti")
        probes = probes.join(crowded, ["k", "base"], "left_anti")
    right = probes.select(F.col("fp").alias("fp2"), F.col("node").alias("node2"), "k", "base", "c", "d")
    left = keyed.select(*(F.col(x).alias(f"_{x}") for x in ("k", "base", "c", "d")), "fp", "node")
    on = (
        (F.col("_k") == F.col("k")) & (F.col("_base") == F.col("base")) & (F.col("_c") == F.col("c")) & (F.col("_d") == F.col("d"))
        & (F.col("fp") != F.col("fp2")) & (_manhattan("fp", "fp2") <= reach) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= reach)
    )
    edges = left.join(right, on).select(F.col("node").alias("a"), F.col("node2").alias("b"))
    if any_hot:
        near = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
        mids = members.select("node", F.explode(F.concat(F.array("fp"), near)).alias("mid"))
        stars = mids.groupBy("mid").agg(F.min("node").alias("a"), F.collect_list("node").alias("all")).where(F.size("all") > 1)
        edges = edges.unionByName(stars.select("a", F.explode("all").alias("b")).where("a <> b"))
    return edges


def components(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links, itself included."""
    prints = cut(fingerprints(docs, words))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # the fingerprint itself names its node: doc_id may be null or repeat
    roots = connected(links(distinct.select("fp", F.col("fp").alias("node"))))
    if roots is None:
        named = distinct.select("fp", F.col("least").alias("component_id"))
    else:
        linked = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        linked = cut(linked)
        least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
        named = linked.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


# ---- similar texts: the shingle set as fingerprint

#: Words of a shingle; nodes of a block that are compared with those of another at once.
WORDS, BLOCK = 5, 1024
#: Similarity of at least 4/5: of n + m set bits at most one in NINTH may differ.
NINTH = 9
PARTS = 64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _FACTORS[0]
    x = (x ^ (x >> np.uint64(29))) * _FACTORS[1]
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, known: _Hashes) -> np.ndarray:
    """Hashes of the distinct shingles of WORDS words, ascending."""
    found = text.lower().split()
    if len(found) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found))] if found else [], np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = len(h) - WORDS + 1
    mixed = np.zeros(n, np.uint64)
    for i, f in enumerate(_FACTORS):
        part = h[i : i + n] * f
        mixed += part ^ (part >> np.uint64(29))
    return np.unique(mixed)


def node_of(found: np.ndarray) -> int:
    """Name of a set: equal sets are one node."""
    h = xxhash.xxh3_64_intdigest(found.tobytes())
    return h - 2**64 if h >= 2**63 else h


@lru_cache(1)
def _bounds() -> np.ndarray:
    """Least sizes of the classes, each a quarter above the one before."""
    out = [4]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return np.array(out)


def keys(found: np.ndarray) -> tuple[np.ndarray, int]:
    """(keys, need): keys of the segments of a set, in every size class where a partner of similarity 4/5 may be the larger.

    Any partner shares at least `need` of them: of the filled segments of the class where they meet, at most as many differ
    as bits do.
    """
    n, bounds = len(found), _bounds()
    if n < bounds[0]:
        return np.zeros(0, np.uint64), 1  # a set of less than four shingles is similar to itself alone
    out, need = [], n
    first, last = (int(np.searchsorted(bounds, x, "right")) - 1 for x in (n, n * 5 // 4))
    for c in range(first, last + 1):
        top = int(bounds[c + 1]) - 1
        k = (2 * top // NINTH + 1) * 17 // 16 + 2
        differ = (n + min(top, n * 5 // 4)) // NINTH
        turn = 0
        while True:
            h = _mixed(found ^ _FACTORS[2] * np.uint64(turn + 1))
            at = (h >> np.uint64(11)) % np.uint64(k)
            order = at.argsort(kind="stable")
            own = at[order]
            begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            total = np.add.reduceat(_mixed(h[order]), begin)
            place = own[begin] + np.uint64((c << 48) + (turn << 40))
            out.append(_mixed(total + _mixed(place ^ _FACTORS[3])))
            if not turn:
                need = min(need, max(1, len(begin) - differ))
            if len(begin) > differ:  # more filled segments than bits that may differ: one is the same in any partner
                break
            turn += 1
    return np.concatenate(out), need


def popcounts(found: np.ndarray) -> np.ndarray:
    """The embedding: set bits in each of PARTS segments of the bitmap, at most 255, which keeps distances a lower bound."""
    return np.minimum(np.bincount((found >> np.uint64(58)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8)


def parities(found: np.ndarray) -> np.ndarray:
    """Of each segment of a finer bitmap of 4 to 8 segments a shingle, whether it has an odd number of set bits, as bytes.

    A bit in which two sets differ turns one parity, so no more parities differ than bits. Half as many segments are the
    exclusive or of two halves.
    """
    n = max(64, 1 << (4 * len(found)).bit_length())
    odd = np.bincount((found & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def _odd(x: list[bytes], y: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many parities x[a] and y[b] differ, in the number of segments of the lesser."""
    out = np.zeros(len(a), np.int64)
    least = np.minimum(np.array([len(v) for v in x], np.int64)[a], np.array([len(v) for v in y], np.int64)[b])
    for size in np.unique(least).tolist():
        at, step = np.flatnonzero(least == size), max(1, (8 << 20) // size)
        sides = []
        for of, chosen in ((x, a[at]), (y, b[at])):
            used, place = np.unique(chosen, return_inverse=True)
            sides.append((np.stack([np.bitwise_xor.reduce(np.frombuffer(of[k], np.uint64).reshape(-1, size // 8), 0) for k in used.tolist()]), place))
        (of_x, i), (of_y, j) = sides
        for k in range(0, len(at), step):
            out[at[k : k + step]] = np.bitwise_count(of_x[i[k : k + step]] ^ of_y[j[k : k + step]]).sum(1, dtype=np.int64)
    return out


def _forest(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> list[int]:
    """Places of edges (a, b), taken in that order, that make a spanning forest."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for k, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
        x, y = root(x), root(y)
        if x != y:
            up[x] = y
            out.append(k)
    return out


#: Keys of a slot, about; bits of a key that a slice keeps besides its slot's; groups of keys that meet in all pairs at once.
SLOT, KEPT, FEW = 1 << 18, 40, 8
SIGNED = "batch long, idx int, row struct<file:long,place:long>, doc_id long, node long, size long, need int, counts binary, odd binary, slot int, met boolean, keys binary, owners binary"


def _packed(key: np.ndarray) -> bytes:
    """The low KEPT bits of each key, in a row."""
    return key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEPT // 8].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) * 8 // KEPT, 8), np.uint8)
    out[:, : KEPT // 8] = np.frombuffer(raw, np.uint8).reshape(-1, KEPT // 8)
    return out.view("<u8").ravel()


def _parts(batches: Iterator[pa.RecordBatch], text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in parts of some `most` bytes of column `text`, a row at least, so that what is made of a part is bounded."""
    for b in batches:
        upto = np.cumsum(pc.binary_length(b.column(text)).to_numpy(False).astype(np.int64))
        at = 0
        while at < len(b):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, end - at)
            at = end


def _signed(rows: DataFrame, row: str, bits: int) -> DataFrame:
    """A row for each row (batch, idx, row, doc_id, node, size, need, counts, odd), and slices of keys with their owners' idx by slot.

    Within a batch only one owner of a key goes on to meet those of other batches; all owners of such a key are in slices
    that are known to have `met`. So a key that very many texts share reaches its slot once a batch.
    """

    def run(batches):
        release()
        known, task = _Hashes(), TaskContext.get().partitionId()
        for number, b in enumerate(_parts(batches, 2)):
            batch = (task << 24) + number
            node, size, needs, counts, odd, all_keys, owners, seen = [], [], [], [], [], [], [], set()
            for i, t in enumerate(b.column(2).cast(pa.binary())):
                found = shingles(t.as_py(), known)
                name = node_of(found)
                node.append(name)
                size.append(len(found))
                counts.append(popcounts(found).tobytes())
                odd.append(parities(found).tobytes())
                own, need = keys(found)
                needs.append(need)
                if name not in seen:
                    seen.add(name)
                    own = own >> np.uint64(64 - bits - KEPT)
                    all_keys.append(own)
                    owners.append(np.full(len(own), i, "<u4"))
            n = len(node)
            empty = lambda kind: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch] * n, pa.int64()), pa.array(range(n), pa.int32()), b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(needs, pa.int32()), pa.array(counts, pa.binary()), pa.array(odd, pa.binary()), empty(pa.int32()), empty(pa.bool_()), empty(pa.binary()), empty(pa.binary())], names=names
            )
            key, owner = np.concatenate([np.zeros(0, np.uint64), *all_keys]), np.concatenate([np.zeros(0, "<u4"), *owners])
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            new = np.r_[True, key[1:] != key[:-1]][: len(key)]
            shared = ~new | np.r_[~new[1:], False][: len(key)]
            out = []
            for met, chosen in ((False, new), (True, shared)):
                k, o = key[chosen], owner[chosen]
                slot = (k >> np.uint64(KEPT)).astype(np.int64)
                begin = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]][: len(k)]).tolist()
                out += [(int(slot[x]), met, _packed(k[x:y]), o[x:y].tobytes()) for x, y in zip(begin, [*begin[1:], len(k)])]
            n = len(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch] * n, pa.int64()), empty(pa.int32()), empty(b.column(0).type), empty(pa.int64()), empty(pa.int64()), empty(pa.int64()), empty(pa.int32()), empty(pa.binary()), empty(pa.binary()), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int32(), pa.bool_(), pa.binary(), pa.binary())))], names=names
            )

    names = [c.split()[0] for c in SIGNED.split(", ")]
    read = rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return read.mapInArrow(run, SIGNED)


def _shared(signed: DataFrame) -> DataFrame:
    """(key, batch, idx) of the owners of keys that more than one batch or owner has; a slot at a time."""

    def owners_of(rows: list) -> pa.RecordBatch:
        slot = rows[0][0]
        key, batch, idx, met = [], [], [], []
        for _, number, known, raw, who in rows:
            k = _unpacked(raw)
            key.append(k)
            batch.append(np.full(len(k), number, np.int64))
            idx.append(np.frombuffer(who, "<u4"))
            met.append(np.full(len(k), known))
        key, batch, idx, met = map(np.concatenate, (key, batch, idx, met))
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        several = (~new | np.r_[~new[1:], False] | met[order]).nonzero()[0]
        at = order[several]
        full = (key[several] | np.uint64(slot << KEPT)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(full), pa.array(batch[at]), pa.array(idx[at].astype(np.int32))], names=["key", "batch", "idx"])

    def run(batches):
        held: list = []
        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(5))):
                if held and held[0][0] != r[0]:
                    yield owners_of(held)
                    held = []
                held.append(r)
        if held:
            yield owners_of(held)

    slices = signed.where("slot is not null").select("slot", "batch", "met", "keys", "owners")
    return slices.repartition("slot").sortWithinPartitions("slot").mapInArrow(run, "key long, batch long, idx int").distinct()


def _contents(rows: DataFrame, row: str, wanted: DataFrame) -> DataFrame:
    """(node, found): the shingle sets of the rows that wanted(row, node) names, as bytes."""

    def run(batches):
        release()
        known = _Hashes()
        for b in _parts(batches, 1):
            found = [shingles(t.as_py(), known).tobytes() for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["node", "found"])

    read = rows.select(F.col(row).alias("row"), text_or_empty().alias("text"))
    # written, so that its size is known before the texts are dealt out: they stay where they are while it is small
    return read.join(cut(wanted), "row").select("node", "text").mapInArrow(run, "node long, found binary")


def _near(pairs: DataFrame) -> DataFrame:
    """pairs(a, b, size_a, size_b, counts_a, counts_b, odd_a, odd_b) whose embeddings and parities are no farther apart than bits may be."""

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(len(b), PARTS).astype(np.int16) for c in (4, 5))
            size = b.column(2).to_numpy() + b.column(3).to_numpy()
            left = np.flatnonzero(NINTH * np.abs(x - y).sum(1, dtype=np.int64) <= size)
            x, y = (b.column(c).take(pa.array(left)).to_pylist() for c in (6, 7))
            every = np.arange(len(left))
            yield b.select(["a", "b"]).take(pa.array(left[NINTH * _odd(x, y, every, every) <= size[left]]))

    return pairs.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) of similarity 4/5 or more."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                keep.append(NINTH * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = lambda c: sets.select(F.col("node").alias(c), F.col("found").alias(f"found_{c}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "found_a", "found_b")
    return both.mapInArrow(run, "a long, b long")


def _enough(shared: DataFrame) -> DataFrame:
    """shared(key, node, need) but for nodes that share fewer keys than any partner would, and keys of one node."""
    enough = shared.groupBy("node").agg(F.count("*").alias("n"), F.max("need").alias("m")).where("n >= m").select("node")
    left = shared.join(enough, "node", "left_semi")
    several = left.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    return left.join(several, "key", "left_semi")


def _similar(rows: DataFrame, row: str, block: int) -> DataFrame:
    """(row, doc_id, stays, component_id): of each component the row of the least doc_id stays, null ones last."""
    with scratch() as own:
        bits = min(max(int(rows.count() * 256 // SLOT).bit_length(), 4), 15)
        signed = cut(_signed(rows, row, bits))
        listed = signed.where("idx is not null").select("batch", "idx", "row", "doc_id", "node", "size", "need", "counts", "odd")
        described = lambda wanted: listed.join(wanted, "node").groupBy("node").agg(F.min("size").alias("size"), F.min("need").alias("need"), F.min_by(F.struct("counts", "odd"), "row").alias("of"), F.min("row").alias("row")).select("node", "size", "need", "of.*", "row")
        shared = cut(_shared(signed).join(listed.select("batch", "idx", "node", "need"), ["batch", "idx"]).select("key", "node", "need").distinct())
        for _ in range(2):  # texts that share a passage alone go, then keys that this leaves to one text
            shared = cut(_enough(shared))
        labels = None
        if not shared.isEmpty():
            labels = _labels(shared.select("key", "node"), cut(described(cut(shared.select("node").distinct()))), lambda wanted: _contents(rows, row, wanted), block)
        place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row").alias("place")
        named = listed.select("row", "doc_id", "node", place)
        named = named.withColumn("root", F.col("node")) if labels is None else named.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
        first = named.groupBy("root").agg(F.min("place").alias("first"))
        return own.keep(named.join(first, "root").select("row", "doc_id", (F.col("first.row") == F.col("row")).alias("stays"), F.col("first.doc_id").alias("component_id")))


def _ranked(shared: DataFrame) -> DataFrame:
    """(key, node, n, score) of shared(key, node): n nodes have the key; a node's score is the sum of n over its keys.

    The text that copies were made from has the segments that most of them kept, so it scores highest.
    """
    counted = shared.join(shared.groupBy("key").agg(F.count("*").alias("n")), "key").select("key", "node", "n")
    return counted.join(counted.groupBy("node").agg(F.sum("n").alias("score")), "node").select("key", "node", "n", "score")


def _labels(shared: DataFrame, nodes: DataFrame, contents: Callable[[DataFrame], DataFrame], block: int) -> DataFrame | None:
    """(node, root) of the nodes that are linked, from shared(key, node); contents gives the sets of (row, node).

    At first the nodes of a key meet the one of the highest score, its hub, or all of them if they are few. Then those that
    are not in their hub's component are compared with all that share a key with the hub, in blocks: any pair of a key that
    no component holds has such a node. Only pairs within both bounds leave a block, at first those of a forest: if all of
    them are links, whatever else the bounds let through is within a component; if not, the pairs between components follow.
    """
    ranked = cut(_ranked(shared))
    many, small = ranked.where(F.col("n") > FEW), ranked.where(F.col("n") <= FEW)
    hubs = cut(many.groupBy("key").agg(F.max_by("node", F.struct("score", "node")).alias("hub")))
    either = lambda a, b: (F.least(a, b).alias("node_a"), F.greatest(a, b).alias("node_b"))
    met = small.join(small.select("key", F.col("node").alias("other")), "key").where("node < other").select(*either("node", "other"))
    members = cut(many.select("key", "node").join(hubs, "key").select("hub", "node").distinct())
    met = met.unionByName(members.where("node <> hub").select(*either("node", "hub"))).distinct()
    one = lambda c: nodes.select(*(F.col(x).alias(f"{x}_{c}") for x in ("node", "size", "counts", "odd")))
    placed = met.join(one("a"), "node_a").join(one("b"), "node_b")
    tried = cut(_near(placed.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "size_a", "size_b", "counts_a", "counts_b", "odd_a", "odd_b")))
    named = lambda ids: nodes.join(ids, "node").select("row", "node")
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    edges = cut(_verified(tried, cut(contents(named(ends(tried))))))
    labels = connected(edges)
    if members.isEmpty():
        return labels
    for whole in (False, True):
        found = cut(_apart(members, labels, nodes, block, whole))
        apart = cut(found.join(tried, ["a", "b"], "left_anti"))
        linked = 0
        if not apart.isEmpty():
            more = cut(_verified(apart, cut(contents(named(ends(apart))))))
            linked = more.count()
        if linked:
            edges = edges.unionByName(more)
            labels = connected(edges)
        if linked == found.count():
            break
        tried = tried.unionByName(apart)
    return labels


def _apart(members: DataFrame, labels: DataFrame | None, nodes: DataFrame, block: int, whole: bool) -> DataFrame:
    """(a, b) within the bounds, of members(hub, node) of one hub in different components, one of them not in the hub's.

    Of two blocks all such pairs if `whole`, else those of a spanning forest of components, the nearest first.
    """
    rooted = members if labels is None else members.join(labels, "node", "left")
    root = F.col("node") if labels is None else F.coalesce("root", "node")
    rooted = cut(rooted.select("hub", "node", root.alias("root")))
    own = rooted.where("node = hub").select("hub", F.col("root").alias("hub_root"))
    sized = rooted.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    full = rooted.join(own.join(sized, "hub"), "hub").join(nodes.select("node", "size", "counts", "odd"), "node")
    full = full.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    columns = ["hub", "node", "root", "size", "counts", "odd"]
    left = full.where("root <> hub_root").select(*columns, F.col("own").alias("i"), every.alias("j"))
    right = full.where("node <> hub").select(*(F.col(c).alias(f"{c}_y") for c in columns), every.alias("i_y"), F.col("own").alias("j_y"))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        nx, ny, rx, ry, sx, sy = (t[c].to_numpy() for c in ("node", "root", "size") for t in (x, y.rename(columns=lambda c: c.removesuffix("_y"))))
        cx, cy = (np.frombuffer(b"".join(c), np.uint8).reshape(len(c), PARTS).astype(np.int16) for c in (x.counts, y.counts_y))
        at = []
        for k in range(0, len(x), 64):
            p = slice(k, k + 64)
            far = np.abs(cx[p, None, :] - cy[None]).sum(2, dtype=np.int64)
            a, b = np.nonzero((NINTH * far <= sx[p, None] + sy[None]) & (rx[p, None] != ry[None]))
            at.append((a + k, b))
        a, b = map(np.concatenate, zip(*at))
        over = NINTH * _odd(x.odd.tolist(), y.odd_y.tolist(), a, b) - (sx[a] + sy[b])
        a, b, over = (v[over <= 0] for v in (a, b, over))
        if not whole:
            chosen = _forest(rx[a], ry[b], np.argsort(over, kind="stable"))
            a, b = a[chosen], b[chosen]
        return pd.DataFrame(np.sort(np.column_stack([nx[a], ny[b]]), 1), columns=["a", "b"])

    return left.groupBy("hub", "i", "j").cogroup(right.groupBy("hub_y", "i_y", "j_y")).applyInPandas(run, "a long, b long").distinct()


def distinct(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs with one row of each component of similar texts."""
    rows, row = with_row(docs)
    dropped = cut(_similar(rows, row, block).where("not stays").select(F.col("row").alias(row)))
    return without(rows, row, dropped).select(*docs.columns)
