"""Cases of the second round's findings."""

import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from quadrille.llm import licenses, packing, simhash

from .test_advice import brute_near, frame


def test_parities_differ_in_no_more_places_than_bits():
    rng = np.random.RandomState(5)
    sets = [np.zeros(0, np.uint64)]
    for k in range(400):
        of = sets[rng.randint(len(sets))]
        sets.append(np.unique(np.r_[of[rng.rand(len(of)) > 0.1], rng.randint(0, 2**62, int(rng.choice([1, 3, 30, 200]))).astype(np.uint64)]))
    a, b = rng.randint(0, len(sets), (2, 3000))
    odd = [simhash.parities(s).tobytes() for s in sets]
    bits = np.array([len(np.setxor1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)])
    found = simhash._odd(odd, odd, a, b)
    assert (found <= bits).all() and (found[a == b] == 0).all()
    near = (bits > 0) & (9 * bits < 2 * np.array([len(sets[x]) + len(sets[y]) for x, y in zip(a, b)]))
    assert near.sum() > 20 and (found[near] > 0.75 * bits[near]).all()


def test_unlike_texts_of_one_group_make_few_pairs(spark, monkeypatch):
    """Texts that share segments with one text, and lie under 0.8 to it and to each other."""
    rng, compared = np.random.RandomState(6), []
    base, texts = [f"w{i}" for i in rng.randint(0, 10_000, 1000)], []
    for k in range(90):
        w = list(base)
        for i in rng.choice(200, 28, replace=False) * 5:
            w[i] = f"x{rng.randint(10**9)}"
        texts.append((k, " ".join(w)))
    texts.append((200, " ".join(base)))
    apart = simhash._apart

    def counted(*given):
        compared.append(apart(*given).count())
        return apart(*given)

    monkeypatch.setattr(simhash, "_apart", counted)
    assert sorted(r["doc_id"] for r in simhash.distinct(frame(spark, texts)).collect()) == brute_near(texts) == [*range(90), 200]
    assert compared and max(compared) < 2 * len(texts)


@pytest.mark.parametrize("block", [64, 5])
def test_links_behind_pairs_that_the_bounds_let_through(spark, block):
    """Without embeddings a block's first pairs are no links; those between components follow."""
    rng, sets = np.random.RandomState(7), {}
    for group in range(6):
        first = rng.randint(0, 2**62, 200).astype(np.uint64)
        for k in range(7):
            sets[group * 10 + k] = first = np.unique(np.r_[first[8:], rng.randint(0, 2**62, 8).astype(np.uint64)])
    nodes = spark.createDataFrame([(n, len(s), bytearray(64), bytearray(8), n) for n, s in sets.items()], "node long, size long, counts binary, odd binary, row long")
    shared = nodes.selectExpr("1L as key", "node")
    contents = spark.createDataFrame([(n, bytearray(s.tobytes())) for n, s in sets.items()], "node long, found binary")
    labels = simhash._labels(shared, nodes, lambda wanted: contents.join(wanted, "node").select("node", "found"), block)
    assert {(r["node"], r["root"] // 10) for r in labels.collect()} == {(n, n // 10) for n in sets}
    assert labels.select("root").distinct().count() == 6


def test_licence_filter_takes_a_text_apart_once(spark):
    """Once in the filter, and once more for the texts that it leaves; each template and nothing else is found."""
    texts = [(k, f"Some words.\n{notice}\nMore words.") for k, notice in enumerate(licenses.TEMPLATES.values())] + [(100, "license under the version of apache software " * 9), (101, "")]
    found = licenses.matches(frame(spark, texts))
    assert 1 <= found._jdf.queryExecution().optimizedPlan().toString().count("lower(text") <= 2
    got = {(r["doc_id"], r["license"]) for r in found.where("dice = 1").collect()}
    assert got >= set(enumerate(licenses.TEMPLATES)) and max(d for d, _ in got) < 100


TOKENIZES = """
import re, sys
import numpy as np, pyarrow as pa
from quadrille.llm import packing

def status(what):
    return int(re.search(what + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024

rng = np.random.RandomState(3)
line = lambda: " ".join(f"w{i:x}" for i in rng.randint(0, 400_000, 500))
texts = pa.array([line() for _ in range(6000)])
open("/proc/self/clear_refs", "w").write("5")
before = status("VmRSS")
for _ in packing.shared_ids(packing.vocabulary_path()).batch(texts):
    pass
print("MB", status("VmHWM") - before)
"""


@pytest.mark.skipif(not Path("/proc/self/clear_refs").exists(), reason="no peak to read")
def test_packing_takes_little_memory_besides_its_batch():
    """Of 18 MB of texts with 400,000 distinct words; it took 303 before."""
    out = subprocess.run([sys.executable, "-c", TOKENIZES], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=300)
    assert int(re.search(r"MB (\d+)", out.stdout)[1]) < 130, out.stdout + out.stderr


def test_packing_leaves_no_words_in_workers(spark):
    path = packing.vocabulary_path()
    docs = frame(spark, [(k, " ".join(f"w{k}x{i}" for i in range(300))) for k in range(64)])
    assert packing.pieces(docs, path).count() == len(packing.pieces(docs, path).collect()) >= 64

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(packing.shared_ids(path).known)])], names=["n"])

    assert max(r["n"] for r in spark.range(0, 64, 1, 8).mapInArrow(held, "n long").collect()) == 1


def test_sets_leave_a_batch_in_bounded_parts():
    texts = pa.array(["a" * n for n in (10, 3 << 20, 2 << 20, 5 << 20, 0, 7)])
    b = pa.RecordBatch.from_arrays([pa.array(range(6)), texts], names=["node", "text"])
    parts = list(simhash._parts(iter([b]), 1))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == list(range(6)) and [len(p) for p in parts] == [2, 1, 1, 2]


def test_packing_does_not_read_past_a_text(monkeypatch):
    """Arrow's split looks at the bytes behind the last text, which here are no letters; a mark then got another word's ids."""
    replaced = pc.replace_substring_regex

    def dirty(*given):
        out = replaced(*given)
        said = [x.encode() for x in out.to_pylist()]
        ends = np.cumsum([0, *map(len, said)]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(out), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(said) + b"\x80" * 64)])

    monkeypatch.setattr(packing.pc, "replace_substring_regex", dirty)
    ids = packing.WordIds(packing.vocabulary_path())
    for batch in (["One. Two", "it."], ["unseen words.", "it."], ["", " "], ["a . b", "the rest of it. "]):
        assert [x.tolist() for x in ids.batch(pa.array(batch))] == [ids.whole(t).tolist() for t in batch]
