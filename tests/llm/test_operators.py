"""Each operator against a brute-force version, and the cases its docstring defines."""

import hashlib
import itertools
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quadrille.llm import chat, decontam, exact_dedup, licenses, packing, pii, quality, registry, secrets, simhash, toxicity
from quadrille.llm.common import table
from quadrille.operators.graph import connected
from quadrille.storage import cut

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept int, score string, spans string, fp string"


def frame(spark, texts):
    """documents with extra columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, None, "s", None, 7, "x", "y", "z") for i, t in texts], DOCS)


EDGE = [(1, None), (2, ""), (3, "a"), (4, " \n "), (5, "word " * 30_000), (6, "same text here"), (7, "same text here"), (7, "same text here"), (None, "no id"), (8, None), (9, "ünï çödé 漢字 " * 50)]


# ---- spans


def base_pii(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0]), s[2]))


def base_secrets(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], secrets.BASE.index(s[0]), s[2]))


PIECES = st.sampled_from(["a", "x.y", "@", ".", "1", "22", "255", "256", "0", " ", "-", "+", "(", ")", "+49 ", "4111111111111111", "4111 1111 1111 1111", "a@b.c", "1.2.3.4", "é", "\n", "://", "http", "iban ", "DE89370400440532013000", "ssn: 123-45-6789", "--", "%", "٣"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_pii_base_spans_are_those_of_the_patterns(text):
    assert [s for s in pii.spans(text) if s[0] in pii.BASE] == base_pii(text)


WORDS = st.sampled_from(["password", "PASSWD", "Secret", "token", "api_key", "apikey", "=", ":", " ", "'", '"', "abcdef0123456789", "AKIA", "AKIAABCDEFGHIJKLMN", "Zz9+/", "deadbeef", ".", "\n", "ſecret", "toKen", "é"])


@settings(max_examples=400, deadline=None)
@given(st.lists(WORDS, max_size=14).map("".join))
def test_secret_base_spans_are_those_of_the_patterns(text):
    assert sorted(secrets.base_spans(text), key=lambda s: (s[1], secrets.BASE.index(s[0]), s[2])) == base_secrets(text)


def test_pii_adds_validated_accounts_and_links():
    found = pii.spans("IBAN: DE89 3704 0044 0532 0130 00, ssn 123-45-6789, see https://x.org/a?b, acct no 12345678")
    assert [k for k, _, _ in found] == ["iban", "ssn", "url", "account"]
    assert not [s for s in pii.spans("IBAN: DE89370400440532013001 ssn 000-45-6789") if s[0] in ("iban", "ssn")]
    for after in (" Bitte zahlen", " BIC COBADEFF", ".", "", " 5"):
        text = "IBAN: DE89370400440532013000" + after
        assert ("iban", 6, 28) in pii.spans(text) and ("iban", 6, 33) in pii.spans("IBAN: DE89 3704 0044 0532 0130 00" + after)
    assert not [s for s in pii.spans("IBAN DE893704004405320130001 iban XX89370400440532013000 iban DE8937040044") if s[0] == "iban"]
    assert pii.masked("write a@b.org now") == "write <email> now"


ADDED = {
    "url": lambda t: [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]{1,5})?(?:[/?#][^\s<>\"']*)?", t)],
    "ssn": lambda t: [(m.start(1), m.end(1)) for m in re.finditer(r"(?:ssn|SSN|Ssn):? ((?!000|666|9)[0-9]{3}[- ](?!00)[0-9]{2}[- ](?!0000)[0-9]{4})(?![0-9])", t)],
    "account": lambda t: [(m.start(1), m.end(1)) for m in re.finditer(r"(?:account|Account|ACCOUNT|acct) ([A-Z]{0,2}[0-9]{6,17})(?![A-Za-z0-9])", t)],
}
ADDED_PIECES = st.sampled_from(["see ", "https://", "ftp://", "x.org", "/a?b=1", ":80", " ", "ssn ", "SSN: ", "123-45-6789", "000-12-3456", "901-45-6789", "account ", "12345678", "DE123456", "123", ", ", "acct ", "\n", "é "])


@settings(max_examples=300, deadline=None)
@given(st.lists(ADDED_PIECES, max_size=10).map("".join))
def test_pii_added_spans_are_those_of_plain_patterns(text):
    found = pii.spans(text)
    for kind, brute in ADDED.items():
        assert [(s, e) for k, s, e in found if k == kind] == brute(text), kind


@pytest.mark.parametrize("query,scan,base", [(registry.op9_pii, pii, base_pii), (registry.op1_secrets, secrets, base_secrets)])
def test_span_queries_on_whole_table(spark, query, scan, base):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    rows = query(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        expected = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(scan.__dict__.get("joined", pii.joined)(expected).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in scan.BASE] == [sum(s[0] == k for s in expected) for k in scan.BASE]
        assert set(pii.joined(expected).split(",")) - {""} <= set(r["spans"].split(","))


@pytest.mark.parametrize("scan", [pii.scan, secrets.scan])
def test_span_operators_on_edge_cases(spark, scan):
    rows = scan(frame(spark, EDGE)).collect()
    assert len(rows) == len(EDGE) and all(r["spans"] == [] for r in rows)
    assert scan(frame(spark, [])).collect() == []


def key_of(rng, kind, n):
    return "".join(rng.choice(secrets.ALPHABETS[kind]) for _ in range(n))


def test_battery_is_calibrated():
    """p-values of structured runs fall below a level about as rarely as it says; those of keys do so mostly."""
    rng = random.Random(99)
    for kind, n in (("base64", 40), ("base64url", 64), ("alphanumeric", 28), ("base36", 48), ("hex_upper", 64), ("base32", 36)):
        hows = ["block", "sequence"] + ["words"] * (kind != "hex_upper")
        null = [secrets.battery(secrets.structured(kind, how, n, rng)) for how in hows for _ in range(150)]
        p = np.array([x for k, x in null if k == kind])
        assert (p <= 0.05).mean() <= 0.08 and (p <= 0.001).mean() <= 0.01, kind
    power = {(kind, n): np.mean([secrets.battery(key_of(rng, kind, n))[1] <= 0.001 for _ in range(100)]) for kind, n in (("base64", 40), ("base64", 28), ("base64url", 64), ("alphanumeric", 40), ("base36", 64), ("hex_upper", 64))}
    assert min(power[k] for k in (("base64", 40), ("base64url", 64), ("alphanumeric", 40))) > 0.85, power
    assert power["base36", 64] > 0.5 and power["hex_upper", 64] > 0.3, power
    assert secrets.battery("12345678901234567890") == ("decimal", 1.0)
    assert all(secrets.battery(x)[1] > 0.01 for x in ("ab" * 24, "a" * 48, "the-same-old-words-of-the-same-old-story-in-the", "getCustomerNameFromTheDatabaseEntry", "ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFG"))


def test_planted_keys_are_found_and_few_others(spark):
    """False-discovery share and power over a table, each row one run."""
    rng = random.Random(5)
    rows = [(i, f"see {key_of(rng, rng.choice(['base64', 'alphanumeric', 'base64url']), rng.choice([32, 40, 64]))} ok") for i in range(80)]
    rows += [(1000 + i, f"see {secrets.structured(rng.choice(['base64', 'alphanumeric', 'base64url']), rng.choice(['words', 'words', 'block', 'sequence']), rng.choice([24, 32, 40, 64]), rng)} ok") for i in range(400)]
    found = [r["doc_id"] for r in secrets.scan(frame(spark, rows)).collect() if any(s["kind"] == "random" for s in r["spans"])]
    keys = sum(i < 1000 for i in found)
    assert keys >= 72 and len(found) - keys <= 0.1 * len(found), (keys, len(found))
    reported = {r["doc_id"]: r for r in secrets.report(secrets.scan(frame(spark, rows))).collect()}
    assert sum("random:4:" in reported[i]["spans"] and reported[i]["n_random"] == 1 for i in range(80)) == keys


def test_cutoffs_hold_the_weighted_step_up_rule():
    counts = {(0, 0): 900, (0, 60): 5, (4, 60): 5, (4, 5): 20}
    cut = secrets.cutoffs(counts)
    assert cut[4] == 60 and cut.get(0, 999) >= 60
    assert secrets.cutoffs({}) == {}


# ---- packing


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), min_size=1, max_size=8))
def test_fullest_is_fullest(left):
    made = packing.fullest(left, 40)
    first = max(left)
    assert made[first] >= 1 and all(made[k] <= left[k] for k in made)
    sums = {first}
    rest = dict(left)
    rest[first] -= 1
    for k, n in rest.items():
        sums = {s + k * c for s in sums for c in range(n + 1) if s + k * c <= 40}
    assert sum(k * n for k, n in made.items()) == max(sums)


def test_word_ids_are_those_of_the_tokenizer():
    ids = packing.WordIds(packing.vocabulary_path())
    texts = ["", "It's a TEST's, isn't it?! x1y22 ½ ²", "ÀÉ ñandú straße ß İstanbul", "a<|endoftext|>b", "漢字 Σίσυφος ΟΔΟΣ", "é café", "a\x1cb\x85c\xa0d e", "we'll 'sound ''s", "\x00﻿​ z", "퟿\U0001f600 ok"]
    for t, got in zip(texts, ids.batch(pa.array(texts))):
        assert got.tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_word_ids_of_every_letter_below_0250_and_small_groups():
    ids = packing.WordIds(packing.vocabulary_path(), most=50)
    texts = [f"a{chr(i)}b {chr(i)}{chr(i)} {chr(i)}'s" for i in range(0x260) if not 0xD800 <= i < 0xE000] + ["", "  two  ", "it's 'tis we''re 'll5", "x" * 3000]
    for t, got in zip(texts, ids.batch(pa.array(texts, pa.string()), 40)):
        assert got.tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids, ascii(t)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F), max_size=40))
def test_word_ids_below_0250(text):
    global IDS
    IDS = globals().get("IDS") or packing.WordIds(packing.vocabulary_path())
    assert next(IDS.batch(pa.array([text]))).tolist() == IDS.tokenizer.encode(text, add_special_tokens=False).ids


def check_packed(rows, ids_of, size):
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, pieces in by_doc.items():
        ids = ids_of[d]
        pieces.sort(key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(-(-len(ids) // size)))
        for p in pieces:
            part = ids[p["piece"] * size : p["piece"] * size + size]
            assert (p["start"], p["length"], p["ids_crc32"]) == (p["piece"] * size, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    for placed in by_bin.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= size
    return len(by_bin)


def test_packing_whole_table(spark):
    docs = table(spark, SF, "documents")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    ids = {r["doc_id"]: t.encode(r["text"], add_special_tokens=False).ids + [0] for r in docs.collect()}
    rows = registry.op3_packing(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(ids)
    bins = check_packed(rows, ids, 2048)
    assert bins <= -(-sum(map(len, ids.values())) // 2048) + 2


def test_packing_edge_cases(spark):
    rows = packing.packed(frame(spark, EDGE).repartition(3), packing.vocabulary_path(), 64).collect()
    ones = [r for r in rows if r["doc_id"] in (1, 2, 4, 8)]
    assert len(ones) == 4 and all(r["length"] == 1 for r in ones)
    assert sum(r["doc_id"] == 7 for r in rows) == 2 and sum(r["length"] for r in rows if r["doc_id"] == 5) == 30_001
    spots = [(r["sequence_id"], r["offset"]) for r in rows]
    assert len(set(spots)) == len(spots)
    assert packing.packed(frame(spark, []), packing.vocabulary_path()).collect() == []


# ---- SimHash


def brute_fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = list(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_fingerprints_and_components_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    fps = {d: brute_fingerprint(t) for d, t in texts.items()}
    expected = brute_components(fps)
    rows = registry.op6_simhash(spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {d: (f"{f:016x}", expected[d]) for d, f in fps.items()}


@pytest.mark.parametrize("hot", [1, 4, 10_000])
def test_links_connect_all_within_two_bits(spark, hot):
    rng = np.random.RandomState(hot)
    centre = [int(x) for x in rng.randint(0, 2**62, 6)]
    fps = set()
    for c in centre:
        for _ in range(40):
            x = c
            for b in rng.randint(0, 64, rng.randint(0, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    nodes = spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "fp long, node long")
    roots = connected(simhash.links(nodes, hot=hot))
    got = {r["node"]: r["root"] for r in roots.collect()} if roots is not None else {}
    expected = brute_components(dict(enumerate(fps)))
    mine = {i: got.get(i, i) for i in range(len(fps))}
    groups = lambda m: sorted(tuple(sorted(k for k in m if m[k] == r)) for r in set(m.values()))
    assert groups(mine) == groups(expected)


def test_simhash_edge_cases(spark):
    got = simhash.components(frame(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fp"] == by[2]["fp"] == 0 and by[8]["component_id"] == by[4]["component_id"] == by[1]["component_id"]
    assert by[7]["component_id"] == 6
    assert simhash.components(frame(spark, [])).collect() == []


# ---- exact dedup


def test_chunks_join_to_the_text(spark):
    text = "once upon a time, best friends ran across seas as all " * 400 + "漢字" * 9000
    rows = spark.createDataFrame([(text,), ("",), ("x" * 40_000,)], "t string").select("t", exact_dedup.chunks(F.col("t")).alias("c")).collect()
    assert all("".join(r["c"]) == r["t"] for r in rows) and len(rows[0]["c"]) > 5 and max(map(len, rows[2]["c"])) <= 16384


@pytest.mark.parametrize("key", [exact_dedup.chunk_key, lambda c: F.pmod(F.xxhash64(c), F.lit(2))])
def test_exact_groups_even_if_chunk_keys_collide(spark, key):
    texts = EDGE + [(i, f"text number {i % 5} " * 200) for i in range(20, 60)]
    got = exact_dedup.groups(frame(spark, texts), 16, 64, key).collect()
    groups = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(texts)
    expected = sorted((str(i), str(max((x for x in g if x is not None), default=None)), len(g)) for g in groups.values() for i in g)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in got) == expected
    assert exact_dedup.groups(frame(spark, [])).collect() == []


# ---- toxicity and quality


@pytest.fixture(scope="module")
def toxic_model(spark):
    return toxicity.fit(table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels"))


def test_decoding_restores_disguised_words(spark, toxic_model):
    model = toxic_model
    dots = "i" + "." * 18 + "d" + "." * 18 + "i.o.t"
    assert {toxicity.restored(w, model.lm) for w in ("i.d.i.o.t", "iiidiot", "idiot!!", "idiot###", dots, "idi" + "o" * 60 + "t", "iddiot")} == {"idiot"}
    assert toxicity.restored("m0r0n", model.lm) == "moron" and toxicity.restored("tr@sh", model.lm) == "trash"
    assert "idiot" in toxicity.decode("an i d i o t", model.lm).split(" ")
    scores = [r["score"] for r in toxicity.scored(frame(spark, EDGE + [(20, "You IDIOT, you m0r0n and tr@sh")]), model).orderBy("doc_id").collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[-1] == max(scores)
    assert model.score("hello id i ot friends") == model.score("hello i d i o t friends") == model.score("hello idiot friends") == model.score("hello IDdDIOT friends")
    assert model.score(f"hello {dots} friends") == model.score("hello idi ot friends") == model.score("hello idiot friends") > 0.3 > model.score("hello dear friends")


def brute_decode(word, lm):
    best = None
    for path in itertools.product(*toxicity._lattice(word)):
        a = b = 0
        cost, said = 0.0, "".join(x for x, _ in path)
        for x, price in path:
            a, b, cost = toxicity._step(a, b, x, cost + price, lm)
        cost += lm[(a * 28 + b) * 28]
        if best is None or cost < best[0] - 1e-9:
            best = (cost, {said})
        elif cost < best[0] + 1e-9:
            best[1].add(said)
    return best[1]


@settings(max_examples=150, deadline=None)
@given(word=st.lists(st.sampled_from([*"aeidots140@!.-*", "ii", "ooo", "$$", " ", "é", "日本", "t t", "#"]), min_size=1, max_size=7).map("".join))
def test_decoding_is_that_of_every_path(toxic_model, word):
    word = " ".join(word.split())
    assert toxicity.decode(word, toxic_model.lm) in brute_decode(word, toxic_model.lm)


@settings(max_examples=300, deadline=None)
@given(text=st.lists(st.sampled_from([*"idotmrnsuplae140@!.- ", "id", "iot", " i ", "st", "upid", "mor", "on", "ooo", " a ", "tt", "I", "D"]), max_size=14).map("".join))
def test_scoring_skips_only_words_without_features(toxic_model, text):
    m = toxic_model
    words, out = text.lower().split(), set()
    for w in words:
        out.update(toxicity.features(toxicity.restored(w, m.lm)))
    for run in toxicity.joints(words):
        for w in toxicity.decode(" ".join(x for x in map(toxicity.core_of, run) if x), m.lm).split(" "):
            out.update(toxicity.features(w))
    assert m.found(text) == {f for f in out if f in m.weights}


def held_out_quality(rows, labels):
    y = np.array([labels[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in labels])
    s = np.array([r["score"] for r in rows if r["held_out"] and r["doc_id"] in labels])
    order = s.argsort().argsort() + 1
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("query,label,least", [(registry.op5_toxicity, "toxic", 0.85), (registry.op7_quality, "quality", 0.95)])
def test_held_out_ranking(spark, query, label, least):
    sf = "/root/testdata/sf0.01"
    rows = query(spark, sf).collect()
    labels = {r["doc_id"]: r[label] for r in table(spark, sf, "labels").collect()}
    assert len(rows) == 1000 and held_out_quality(rows, labels) > least


def test_models_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for op in (toxicity, quality):
        rows = op.verdicts(frame(spark, EDGE), none).collect()
        assert len(rows) == len(EDGE) and all(r["score"] < 1e-6 and r["predicted"] == 0 for r in rows)
        assert op.verdicts(frame(spark, []), none).collect() == []


def test_trees_walk_as_one_row_at_a_time():
    rng = np.random.RandomState(0)
    x = rng.rand(500, 5)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.grow(x, y, trees=30, depth=3)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.95
    for row, margin in zip(x[:20], trees.margin(x[:20])):
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - len(f)]
        assert abs(total - margin) < 1e-9


# ---- decontamination


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (decontam.MATCH if a[i - 1] == b[j - 1] else decontam.MISMATCH), h[i - 1, j] + decontam.GAP, h[i, j - 1] + decontam.GAP)
    return int(h.max())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=16))
def test_alignment_scores(a, b):
    score, start, end = decontam.align(np.array(a, int), np.array(b, int))
    assert score == brute_align(a, b) and 0 <= start <= end <= len(b)
    assert brute_align(a, b[start:end]) == score


def test_edited_copies_are_found_and_others_left(spark):
    rng = np.random.RandomState(5)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: [vocabulary[i] for i in rng.randint(0, 400, n)]
    items = {i: say(30) for i in range(4)}
    edited = list(items[1])
    edited[4], edited[17] = "other", "words"
    del edited[10]
    texts = EDGE + [(100, " ".join(say(80) + items[0] + say(80))), (101, " ".join(say(9) + edited + say(40))), (102, " ".join(say(300))), (103, " ".join(items[2] + ["and"] + items[2] + items[3]))]
    bench = spark.createDataFrame([(i, " ".join(x).upper()) for i, x in items.items()] + [(9, None), (10, ""), (11, "solo")], "item_id long, text string")
    for block, most in ((2, 20), (1, 2), (100, 1)):
        got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(frame(spark, texts), bench, block=block, most=most).collect()}
        assert {r["doc_id"] for r in decontam.clean(frame(spark, texts), bench, block=block, most=most).collect()} == {i for i, _ in texts} - {100, 101, 103}
        assert set(got) == {(100, 0), (101, 1), (103, 2), (103, 3)}
        assert got[100, 0]["score"] == 1 and (got[100, 0]["start_word"], got[100, 0]["end_word"]) == (80, 110) and got[101, 1]["score"] > 0.7
    assert decontam.contaminated(frame(spark, []), bench).collect() == []
    assert decontam.contaminated(frame(spark, texts), bench.limit(0)).collect() == []


def test_decontamination_whole_table(spark):
    docs = {r["doc_id"]: decontam.words(r["text"]) for r in table(spark, SF, "documents").collect()}
    items = {r["item_id"]: decontam.words(r["text"]) for r in table(spark, SF, "benchmark").collect()}
    whole = {(d, i) for d, w in docs.items() for i, x in items.items() if f" {' '.join(x)} " in f" {' '.join(w)} "}
    assert whole <= {(r["doc_id"], r["item_id"]) for r in registry.op10_decontamination(spark, SF).collect()}


# ---- chat and licences


def test_preferences(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", None), (2, 0, None, "x"), (5, 0, "user", "a"), (4, 0, "user", "a"), (None, 0, "user", "q")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("prompt", F.lit("p"))
    got = {r["pair_id"]: r for r in chat.preferences(chat.neighbours(conv)).collect()}
    r = got[0]
    assert r["prompt_turns"] == 1 and r["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    a, b = r["chosen_mask"][0]
    assert r["chosen_completion"][a:b] == "yes<|im_end|>\n"
    a, b = r["rejected_mask"][0]
    assert len(r["rejected_mask"]) == 1 and r["rejected_completion"][a:b] == "no<|im_end|>\n"
    assert got[1]["prompt_turns"] == 0 and got[1]["rejected_completion"] == "" and got[1]["chosen_mask"] == []
    assert got[2]["prompt_turns"] == 1 and got[2]["chosen_completion"] == got[2]["rejected_completion"] == ""
    assert chat.preferences(chat.neighbours(conv.limit(0))).collect() == [] and len(got) == 3


def brute_preference(a, b):
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    said = lambda turns: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)
    out = [n, said(a[:n])]
    for side in (a, b):
        at, mask = 0, []
        for r, t in side[n:]:
            whole = len(said([(r, t)]))
            mask += [(at + 13 + len(r), at + whole)] * (r == "assistant")
            at += whole
        out += [said(side[n:]), mask]
    return tuple(out)


def test_preferences_with_repeated_null_and_very_many_turns(spark):
    rng = random.Random(4)
    talks = {k: [(t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", None, "漢"])) for t in sorted(rng.choice([None, 1, 1, 2, 3, 4]) or 0 for _ in range(rng.randrange(7)))] for k in range(60)}
    talks[100] = [(t, "assistant" if t % 2 else "user", f"turn {t % 50}") for t in range(30_000)]
    talks[101] = talks[100][:20_000] + [(20_000, "assistant", "other")]
    talks[7] = [(None, "assistant", "first"), *talks[7]]
    rows = [(k, *t) for k, ts in talks.items() for t in ts]
    rng.shuffle(rows)
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: tuple([tuple(x) for x in r[c]] if "mask" in c else r[c] for c in ("prompt_turns", "prompt", "chosen_completion", "chosen_mask", "rejected_completion", "rejected_mask")) for r in chat.preferences(chat.neighbours(conv)).collect()}
    clean = {k: [(r or "", t or "") for _, r, t in sorted(ts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))] for k, ts in talks.items()}
    expected = {k // 2: brute_preference(clean.get(k // 2 * 2, []), clean.get(k // 2 * 2 + 1, [])) for k in clean if clean[k]}
    assert got == expected


def brute_licences(texts, threshold=0.8):
    """Every window of every template's length that begins at one of its pairs."""
    out = []
    for k, (doc, text) in enumerate(texts):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        for name, notice in licenses.TEMPLATES.items():
            t = licenses.words_of(notice)
            pairs = set(zip(t, t[1:]))
            best = None
            for i in range(len(w) - 1):
                if (w[i], w[i + 1]) not in pairs:
                    continue
                own = list(zip(w[i : i + len(t)], w[i + 1 : i + len(t)]))
                m = len(pairs & set(own))
                dice = round(2 * m / (len(pairs) + sum(p not in pairs for p in own) + m), 6)
                if dice >= threshold and (best is None or dice > best[0]):
                    best = (dice, i, len(own) + 1)
            if best:
                out.append((doc, name, *best))
    return out


def wrapped(notice, width=60, mark="# "):
    return "\n".join(mark + x for x in textwrap.wrap(notice, width))


def test_licences(spark):
    mit, gpl, bsd = (licenses.TEMPLATES[k] for k in ("MIT-text", "GPL-3.0-or-later-notice", "BSD-3-Clause-text"))
    half = bsd.split()[: len(bsd.split()) // 8]
    texts = EDGE + [
        (20, "code\nReleased under the MIT License.\nmore"), (21, "This work is licensed under the GNU General Public Licence, version 3."), (22, "Released under no licence whatever it may be called"), (20, "Licensed under CC BY-NC 4.0."),
        (23, "import os\n" + wrapped(gpl) + "\n\ndef f(): pass\n"), (24, "This repo has things. Released under the MIT License. See the docs."), (25, "MIT License\n\nCopyright 2020 Someone\n\n" + wrapped(mit, 70, "") + "\n"), (26, wrapped(bsd, 40, " * ") + "\nint main;"),
        (None, " ".join(half) + " one two three"), (None, " ".join(bsd.split()[len(half) : 2 * len(half)])), (27, wrapped(licenses.TEMPLATES["ISC-text"].replace("FITNESS", "fitnes"), 33)), (28, "Released under the MIT License. " * 50), (29, "words before " * 400 + licenses.TEMPLATES["MPL-2.0"]),
    ]
    rows = [tuple(r) for r in licenses.matches(frame(spark, texts)).select("doc_id", "license", "dice", "start_word", "n_words").collect()]
    assert sorted(rows, key=str) == sorted(brute_licences(texts), key=str)
    got = {(r[0], r[1]): r[2] for r in rows}
    assert got[20, "MIT"] == 1 and got[24, "MIT"] == 1 and got[20, "CC-BY-NC-4.0"] == 1 and 0.8 <= got[21, "GPL-3.0"] < 1 and (22, "MIT") not in got
    assert got[23, "GPL-3.0-or-later-notice"] == got[23, "GPL-3.0-or-later"] == got[25, "MIT-text"] == got[26, "BSD-3-Clause-text"] == 1 and 0.9 < got[27, "ISC-text"] < 1
    assert licenses.matches(frame(spark, [])).collect() == []


def test_licence_covers_hold_for_any_needed_pairs():
    for notice in licenses.TEMPLATES.values():
        w = licenses.words_of(notice)
        pairs = set(zip(w, w[1:]))
        found = licenses.covers(notice, 0.8)
        assert found
        for words in found:
            assert sum(not set(p) & set(words) for p in pairs) < licenses.needed(len(pairs), 0.8)


# ---- queries and pipeline


def test_sql_says_the_same(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    for name, sql in registry.ORACLE_SQL.items():
        rows = registry.QUERIES[name](spark, SF)
        columns = rows.columns
        expected = con.sql(sql)
        assert sorted(expected.columns) == sorted(columns)
        assert sorted(map(str, (tuple(r[c] for c in columns) for r in rows.collect()))) == sorted(map(str, expected.select(*columns).fetchall())), name


def test_pipeline_by_stages(spark):
    """run() against a brute-force version of every stage that is not a fitted model."""
    from .test_advice import brute_near, brute_share

    docs = table(spark, SF, "documents")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [decontam.words(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = cut(stage(spark, kept, SF))
        assert kept.columns == columns
        after = {r["doc_id"]: r["text"] for r in kept.collect()}
        assert all(texts[d] == t for d, t in after.items())
        if name == "exact_dedup":
            assert sorted(after) == sorted({t: d for d, t in sorted(before.items())}.values())
        if name == "simhash":
            assert sorted(after) == brute_near(before.items())
        if name == "decontamination":
            for d, t in before.items():
                w = decontam.words(t)
                near = [x for x in items if 2 * len(set(x) & set(w)) >= len(set(x)) or len(x) <= 3]
                assert (d in after) == (not any(brute_share(x, w) >= 0.5 for x in near)), d
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(after)
