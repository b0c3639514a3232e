"""Cases that the first review found missing, against brute-force versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadrille.llm import decontam, exact_dedup, secrets, simhash
from quadrille.llm.common import table, with_row

SF = "/root/testdata/sf0.001"


def frame(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string")


def brute_near(texts):
    """doc_ids that stay: of those linked by five-word Jaccard of at least 0.8 the least."""
    sets = {}
    for d, t in texts:
        w = t.lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted({find(d) for d in sets})


def varied(rng):
    """Groups of edited copies, short texts, a shared line, and whole tables' texts."""
    say = lambda n: [f"w{i}" for i in rng.randint(0, 500, n)]
    texts, line = [(900, ""), (901, " \n"), (902, "two words"), (903, "Two  words"), (904, "a b c d e f g h"), (905, "a b c d e f g h i"), (906, "a b c d e f g")], say(12)
    for base in range(5):
        first = say(int(rng.randint(30, 150)))
        for k in range(14):
            w = list(first)
            for _ in range(int(rng.randint(0, 5))):
                w[rng.randint(len(w))] = f"x{rng.randint(10**6)}"
            texts.append((base * 20 + k, " ".join(w)))
    return texts + [(200 + k, " ".join(say(20) + line + say(20))) for k in range(30)]


@pytest.mark.parametrize("block", [1024, 3])
def test_near_copies_are_those_of_brute_force(spark, block):
    texts = varied(np.random.RandomState(8 + block))
    texts += [(300 + d, t) for d, t in table(spark, SF, "documents").select("doc_id", "text").dropDuplicates(["text"]).limit(60).collect()]
    rows = simhash.distinct(frame(spark, texts), block).collect()
    assert sorted(r["doc_id"] for r in rows) == brute_near(texts)


def test_segments_lose_no_pair():
    """Some segment is shared by any two sets of similarity 4/5, and unlike sets share few."""
    rng = np.random.RandomState(12)
    unlike = 0
    for k in range(3000):
        n = int(rng.choice([4, 5, 6, 8, 9, 10, 13, 18, 30, 60, 200, 700]))
        a = np.unique(rng.randint(0, 2**62, n).astype(np.uint64))
        most = (2 * len(a)) // 9 + 1
        drop, add = rng.randint(0, most + 1), rng.randint(0, most + 1)
        b = np.unique(np.r_[rng.permutation(a)[drop:], rng.randint(0, 2**62, add).astype(np.uint64)])
        shared = len(np.intersect1d(a, b))
        (keys_a, need_a), (keys_b, need_b) = simhash.keys(a), simhash.keys(b)
        met = len(np.intersect1d(keys_a, keys_b)) >= max(need_a, need_b)
        if 9 * shared >= 4 * (len(a) + len(b)) and (len(a) != shared or len(b) != shared):
            assert met, (n, drop, add)
        apart = np.abs(simhash.popcounts(a).astype(int) - simhash.popcounts(b)).sum()
        assert apart <= len(a) + len(b) - 2 * shared
        c = np.unique(np.r_[a[: len(a) // 3], rng.randint(0, 2**62, len(a) - len(a) // 3).astype(np.uint64)])
        unlike += len(np.intersect1d(keys_a, simhash.keys(c)[0])) >= need_a and n > 30
    assert unlike < 100


def test_near_copies_of_a_large_group(spark):
    rng = np.random.RandomState(3)
    base = [f"w{i}" for i in rng.randint(0, 10_000, 120)]
    texts = []
    for k in range(600):
        w = list(base)
        w[rng.randint(120)] = f"x{k}"
        texts.append((k, " ".join(w)))
    texts += [(1000 + k, " ".join(base[:70] + [f"y{k}_{i}" for i in range(60)])) for k in range(100)]
    got = [r["doc_id"] for r in simhash.distinct(frame(spark, texts)).collect()]
    assert sorted(got) == [0, *range(1000, 1100)]


def test_near_copies_of_copies(spark):
    """A cloud of copies of copies, some within reach of each other and not of what most share with."""
    rng = np.random.RandomState(14)
    base, texts = [f"w{i}" for i in rng.randint(0, 10_000, 90)], []
    for k in range(150):
        w = list(texts[rng.randint(len(texts))][1].split()) if texts and k % 3 else list(base)
        for _ in range(int(rng.randint(0, 4))):
            w[rng.randint(90)] = f"x{rng.randint(10**6)}"
        texts.append((k, " ".join(w)))
    assert sorted(r["doc_id"] for r in simhash.distinct(frame(spark, texts), 16).collect()) == brute_near(texts)


def rows_with_trouble(spark):
    """Null and repeated doc_ids, repeated rows, null and empty texts, clashing names."""
    long_ = " ".join(f"t{i}" for i in range(40))
    texts = [(5, "alpha beta gamma"), (5, "alpha beta gamma"), (6, "x y z one"), (6, "unique text of six"), (9, "x y z one"), (None, "three times"), (None, "three times"), (3, "three times"), (None, None), (8, ""), (None, "null id alone"), (7, long_), (7, long_ + " tail"), (None, long_ + " other")]
    made = spark.createDataFrame([(i, t, 1, 2, "r") for i, t in texts], "doc_id long, text string, _score int, _row int, n_chars string")
    return texts, made


def test_stages_drop_rows_not_ids(spark, tmp_path):
    texts, made = rows_with_trouble(spark)
    made.write.parquet(f"{tmp_path}/documents.parquet")
    for docs in (made, made.repartition(4), spark.read.parquet(f"{tmp_path}/documents.parquet")):
        kept = exact_dedup.distinct(docs)
        assert kept.columns == made.columns
        got = sorted((r["text"] or "", str(r["doc_id"])) for r in kept.collect())
        best = {}
        for i, t in texts:
            best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
        assert got == sorted((t, "None" if i < 0 else str(i)) for t, i in best.items())
        near = simhash.distinct(kept)
        assert near.columns == made.columns
        left = [(r["doc_id"], r["text"]) for r in near.collect()]
        long_ = [x for x in left if x[1] and x[1].startswith("t0 ")]
        assert len(left) == len(best) - 2 and len(long_) == 1 and long_[0][0] == 7
    for stage in (exact_dedup.distinct, simhash.distinct):
        assert stage(made.limit(0)).collect() == []


def test_rows_are_told_apart_after_joins_and_explosions(spark, tmp_path):
    frame(spark, [(1, "a b"), (2, "c d")]).write.parquet(f"{tmp_path}/d")
    read = spark.read.parquet(f"{tmp_path}/d")
    twice = read.crossJoin(spark.range(2).withColumnRenamed("id", "k"))
    for docs, n in ((read, 2), (read.where("doc_id > 1"), 1), (twice, 4), (read.select("doc_id", F.explode(F.split("text", " ")).alias("text")), 4), (read.unionByName(read), 4)):
        rows, row = with_row(docs)
        assert rows.select(row).distinct().count() == rows.count() == n
    assert sorted(r["text"] for r in exact_dedup.distinct(twice).collect()) == ["a b", "c d"]


def test_every_stage_on_rows_with_trouble(spark, tmp_path):
    texts, made = rows_with_trouble(spark)
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    kept = made
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == made.columns
        none = stage(spark, made.limit(0), str(tmp_path))
        assert none.collect() == [] and none.columns == made.columns
    left = [r["text"] for r in kept.collect()]
    assert "unique text of six" in left and "null id alone" in left and left.count("alpha beta gamma") == 1 and left.count("three times") == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
    assert len(packed) == len(left)


# ---- op10


def brute_share(item, text):
    h = np.zeros((len(item) + 1, len(text) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if item[i - 1] == text[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return round(int(h.max()) / (2 * len(item)), 6)


def test_decontamination_finds_what_brute_force_aligns():
    rng = np.random.RandomState(2)
    lost, seen = [], []
    for k in range(400):
        item = [f"w{i}" for i in rng.randint(0, 30 if k % 2 else 900, rng.randint(1, 32))]
        copy, rate = [], rng.choice([0.1, 0.2, 0.3, 0.4])
        for w in item:
            copy += rng.choice([1, 0], p=[rate, 1 - rate]) and [[f"x{rng.randint(99)}"], [], [w, "y"], [w, "y", "z"]][rng.randint(4)] or [w]
        if k % 5 == 0:  # edits at every third word, or a foreign word after every word
            copy = [f"x{i}" if i % 3 == 2 else w for i, w in enumerate(item)] if k % 2 else [x for w in item for x in (w, "y")]
        text = [f"w{i}" for i in rng.randint(0, 900, 20)] + copy + [f"w{i}" for i in rng.randint(0, 900, 20)]
        share = brute_share(item, text)
        got = decontam.Block({0: item}, 0.5).matches(" ".join(text))
        seen += [share] * (share >= 0.5)
        if [g[1] for g in got] != [share] * (share >= 0.5):
            lost.append((share, got))
    assert not lost and sum(s < 0.7 for s in seen) > 40 and sum(s >= 0.7 for s in seen) > 40


def test_decontamination_of_an_edited_copy_in_a_table(spark):
    item = [f"w{i}" for i in range(24)]
    edited = [f"x{i}" if i % 6 == 2 else w for i, w in enumerate(item)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    rows = decontam.contaminated(frame(spark, [(5, " ".join(["a"] * 9 + edited + ["b"] * 9)), (6, "nothing of it")]), bench).collect()
    assert [(r["doc_id"], r["item_id"], r["score"]) for r in rows] == [(5, 1, brute_share(item, edited))]


# ---- op1


@pytest.mark.parametrize("text,key", [
    ("aws_secret_access_key=wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"),
    ("AUTH=q8Zr3LkP0vXt7NwY2cBd5HsJ", "q8Zr3LkP0vXt7NwY2cBd5HsJ"),
    ("https://x.org/a?sig=q8Zr3LkP0vXt7NwY2cBd5HsJ==", "q8Zr3LkP0vXt7NwY2cBd5HsJ=="),
    ("my_id-x/q8Zr3LkP0vXt7NwY+cBd5HsJ_q8Zr3LkP0vXt7NwY-cBd5HsJ", "q8Zr3LkP0vXt7NwY-cBd5HsJ"),
])
def test_keys_after_an_equals_sign_or_in_mixed_runs_are_candidates(text, key):
    found = [text[s:e] for s, e, _, _ in secrets.candidates(text, [])]
    assert any(key in x for x in found) and all(secrets.encoding(x) for x in found)


def test_parts_of_a_run_do_not_overlap():
    rng = np.random.RandomState(4)
    for _ in range(300):
        run = "".join(rng.choice(list("aB3+/_-="), 90, p=[0.3, 0.3, 0.3, 0.02, 0.02, 0.02, 0.02, 0.02]))
        got = secrets.parts(run)
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:])) and all(secrets.encoding(run[s:e]) and e - s >= 20 for s, e in got)


def test_a_key_after_an_equals_sign_is_found_in_a_table(spark):
    rng = np.random.RandomState(6)
    keys = ["".join(rng.choice(list(secrets.ALPHABETS["base64"]), 64)) for _ in range(40)]
    rows = secrets.scan(frame(spark, [(i, f"AUTH={k}") for i, k in enumerate(keys)])).collect()
    assert sum((5, 69) in [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "random"] for r in rows) > 30
