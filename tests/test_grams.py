"""M5: n-grams counted by number against counts by plain Python."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa

from threadlens.operators import features as FE
from threadlens.operators import grams

ROWS = [["a", "b", "a", "b", "c"], [], None, ["b"], ["c", "a", "b", "a", "b"], ["d d", "a"]] * 3


def plain(rows, n_max):
    out = Counter()
    for toks in rows:
        out.update(" ".join(toks[i : i + n]) for n in range(1, n_max + 1) for i in range(len(toks or []) - n + 1))
    return out


def test_slices_keep_whole_rows_and_numbers_stay_exact():
    column = pa.array([["x"], *ROWS], pa.list_(pa.string())).slice(1)
    got, seen = Counter(), 0
    for row, bounds, codes, words in grams.slices(column, most=7):
        assert row == seen
        seen += len(bounds) - 1
        for n in (1, 2, 3):
            at = grams.starts(bounds, n)
            got.update(grams.spelled(at, codes, words, n).to_pylist())
    assert seen == len(ROWS) and got == plain(ROWS, 3)
    wide = [np.array([5, 5, 9, 5]), np.array([1, 1, 1, 2]), np.array([7, 7, 7, 7])]
    assert len(set(grams.numbered(wide, 1 << 31).tolist())) == 3  # beyond 62 bits


def test_top_and_counts_by_row(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ROWS)], "id int, _toks array<string>")
    want = sorted(plain(ROWS, 3).items(), key=lambda x: (-x[1], x[0]))
    for k in (3, 1000):
        assert grams.top_grams(df, "_toks", 3, k) == want[:k]
    vocab = ["a b", "b", "c a b", "a", "nowhere", "b nowhere"]
    for r in FE.term_counts(df, ["id"], vocab).collect():
        own = plain([ROWS[r.id]], 3) if ROWS[r.id] else {}
        assert dict(zip(r._ids, r._tfs)) == {i: own[t] for i, t in enumerate(vocab) if t in own} and r._ids == sorted(r._ids)


def test_rows_of_one_key_count_as_one(spark):
    rows = [(1, "uno dos"), (1, "dos tres"), (None, "uno uno"), (None, "dos"), (2, None), (3, "tres")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {(r.id, r.term): r.tfidf for r in FE.tfidf(df, ["id"], "text").collect()}
    tf = {1: Counter(uno=1, dos=2, tres=1), None: Counter(uno=2, dos=1), 3: Counter(tres=1)}
    weigh = lambda k, t: tf[k][t] * (math.log(7 / (1 + sum(t in c for c in tf.values()))) + 1)
    want = {(k, t): weigh(k, t) / math.sqrt(sum(weigh(k, u) ** 2 for u in tf[k])) for k in tf for t in tf[k]}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_vectors_have_no_column_of_python_numbers(spark):
    train = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(["uno dos", "dos tres tres", None, ""])], "id int, text string, y int")
    tr, te = FE.tfidf_vectors(train, train.where("id < 2"), "text", 2)
    a, b = ({r.id: r.features for r in d.collect()} for d in (tr, te))
    assert len(a) == 4 and b == {i: a[i] for i in (0, 1)} and a[2].numNonzeros() == 0 and a[1].size == len(plain([["uno", "dos"], ["dos", "tres", "tres"]], 2))
    assert abs(a[1].norm(2) - 1) < 1e-12
