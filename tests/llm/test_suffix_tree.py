"""op11 suffix tree scores against a plain version that counts every context."""

import collections
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from threadlens.llm import queries, suffix_tree
from threadlens.llm.suffix_tree import Level, Shelf, Tree, Unit, numbered, tree_scores, unpacked

SF = "/root/testdata/sf0.001"


def plain_scores(docs, tree):
    """docs: (doc_id, text, held out) -> rows like tree_scores, by dictionaries over whole texts."""
    cut = [((t or "").encode().lower().split() + [None]) for _, t, _ in docs]
    train = [w for w, (_, _, held) in zip(cut, docs) if not held]
    count = collections.Counter(x for w in train for x in w)
    n, v = sum(count.values()), len(count)
    tree = tree.at(n)
    base = lambda x: (count[x] + 1) / (n + v + 1)
    after = collections.defaultdict(collections.Counter)
    for w in train:
        for j in range(1, len(w)):
            for k in range(1, min(j, tree.depth) + 1):
                after[tuple(w[j - k : j])][w[j]] += 1
    states = {}

    def probability(history, x):
        p = base(x)
        for k in range(1, min(tree.depth, len(history)) + 1):
            s = states.get(tuple(history[-k:]))
            if s is not None:
                stored, total, lam = s
                p = max(stored.get(x, 0) - tree.discount, 0) / total + lam * p
        return p

    for context in sorted(after, key=len):
        follow = after[context]
        total = sum(follow.values())
        stored = {x: c for x, c in follow.items() if c >= tree.least_pair}
        if total < tree.least_context or not stored:
            continue
        q = {x: probability(context[1:], x) for x in stored}
        gain = sum(c * math.log(c / (total * q[x])) for x, c in stored.items())
        rest = total - sum(stored.values())
        if rest:
            gain += rest * math.log(rest / (total * max(1 - sum(q.values()), 1e-12)))
        if gain > tree.penalty * len(stored) * math.log(total):
            states[context] = stored, total, 1 - (sum(stored.values()) - tree.discount * len(stored)) / total
    out = []
    for (i, _, held), w in zip(docs, cut):
        out.append((i, held, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10(base(x)) for x in w),
                    sum(math.log10(probability(w[:j], x)) for j, x in enumerate(w))))
    return out, states


def alike(got, want):
    order = lambda x: (str(x[:5]), x[6])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9, abs_tol=1e-9)


def test_scores_match_plain_counting(spark):
    r = random.Random(6)
    phrases = [[f"w{r.randrange(60)}" for _ in range(r.randrange(2, 9))] for _ in range(25)]
    docs = []
    for i in range(300):
        words = []
        while r.random() < 0.9:
            words += r.choice(phrases) if r.random() < 0.6 else [f"w{r.randrange(200)}"]
        docs.append((i, r.choice([" ", "\n", "\t "]).join(words).upper() if i % 3 else " ".join(words), i % 7 == 2))
    docs += [(None, "w1 w2 é", False), (300, None, False), (301, "", True), (302, " \n ", False), (303, docs[4][1], True), (303, docs[4][1], True),
             (304, "w1 w2 w3 " * 3000, False)]
    df = spark.createDataFrame([(*d, 1.0, 2, "u") for d in docs], "doc_id long, text string, out boolean, score double, n_tokens int, unit string")
    for tree in (Tree(least_context=6, least_pair=2, depth=3), Tree(least_context=6, least_pair=2, depth=2, unit_bytes=500, bucket_bytes=1000), Tree(least_context=10, least_pair=4, depth=1, rise=0.1)):
        assert tree.at(17282).least_context == (14 if tree.rise == 0.1 else tree.least_context)
        want, states = plain_scores(docs, tree)
        assert {len(s) for s in states} == set(range(1, tree.depth + 1))
        alike(tree_scores(df, F.col("out"), tree).collect(), want)


def test_thresholds_are_those_of_any_corpus():
    assert Tree().at(1000) == Tree().at(2 * 10**6) == Tree().at(10**11) == Tree()


def test_pairs_need_a_frequent_shorter_one():
    unit = Unit.__new__(Unit)
    unit.tree, unit.count, unit.train = Tree(least_pair=3), np.array([9, 9, 9, 2, 9]), np.ones(5, bool)
    level = lambda place, total: Level(np.array(place), np.zeros(len(place), np.int64), np.zeros(1, np.uint64), np.ones(1, np.int64), np.array(place, np.uint64), np.array(total))
    keys, n = unit.pairs(level([1, 2, 3, 4], [0] * 4), None)
    assert keys.tolist() == [1, 2, 4] and n.tolist() == [1, 1, 1]
    keys, n = unit.pairs(level([2, 3, 4], [0] * 3), level([1, 2, 3, 4], [9, 0, 9, 3]))
    assert keys.tolist() == [4] and n.tolist() == [1]


def test_numbered_mends_hashes_alike_in_upper_bits():
    r = np.random.default_rng(5)
    some = r.integers(0, 1 << 63, 40).astype(np.uint64)
    for key in (r.choice(some, 500), r.integers(0, 50, 500).astype(np.uint64), np.sort(some), some[:1], some[:0],
                np.concatenate([r.choice(some, 300), r.choice(some ^ np.uint64(5), 300)])):
        keys, number, first = numbered(key)
        for got, want in zip((keys, first, number), np.unique(key, return_index=True, return_inverse=True)):
            assert got.tolist() == want.tolist()


def test_answers_hold_no_keys_and_units_are_written_once(spark, monkeypatch):
    tables, put = {}, Shelf.put
    monkeypatch.setattr(suffix_tree.Shelf, "put", lambda self, df, name: tables.setdefault(name, put(self, df, name)))
    r = random.Random(3)
    docs = [(i, " ".join(f"w{int(r.paretovariate(0.4)) % 700}" for _ in range(r.randrange(60))), i % 7 == 2) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, out boolean")
    tree = Tree(unit_bytes=9000, bucket_bytes=20_000)
    want, states = plain_scores(docs, tree)
    assert states
    alike(tree_scores(df, F.col("out"), tree).collect(), want)
    assert set(tables) == {"units", "words", "facts-1", "facts-2", "facts-3", "facts-4"}
    for name in set(tables) - {"units"}:
        held = [unpacked(x.blob) for x in tables[name].collect()]
        assert held and all(set(x) <= {"c", "total", "pairs", "lead"} for x in held)
        assert all(len({len(v) for v in x.values()}) == 1 for x in held)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (None, None)], "doc_id long, text string")
    got = tree_scores(df, F.lit(True)).collect()  # nothing to learn from
    assert len(got) == 3 and all(x.score == x.base_score == 0 and x.train_tokens == 0 for x in got)
    assert tree_scores(df.limit(0), F.lit(False)).collect() == []
    got = tree_scores(df, F.lit(None).cast("boolean")).collect()
    assert {(x.doc_id, x.n_tokens, x.n_known, x.train_tokens, x.held_out) for x in got} == {(1, 3, 3, 5, False), (2, 1, 1, 5, False), (None, 1, 1, 5, False)}


def test_query(spark):
    docs = [(x.doc_id, x.text, zlib.crc32(str(x.doc_id).encode()) % 7 == 2) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, states = plain_scores(docs, Tree())
    got = queries.QUERIES["op11_suffix_tree"](spark, SF).collect()
    alike(got, want)
    assert states
