"""M4: order-2 iterative stratification against a sequential version, row by row."""

import collections
import itertools
import random

import pytest

from threadlens.operators import splits as SP

LABELS = [f"l{i}" for i in range(7)]


def table(n, seed):
    r = random.Random(seed)
    share = [0.4, 0.25, 0.12, 0.06, 0.03, 0.015, 0.008]
    return [(i, *(int(r.random() < p * (1.8 if i % 3 == 0 else 0.6)) for p in share)) for i in range(n)]


def pairs(row):
    on = [i for i, v in enumerate(row[1:]) if v]
    return list(itertools.combinations_with_replacement(on, 2))


def sequential(rows, ratios, seed):
    """Rows one at a time: the pair with the fewest rows left first, to the fold that lacks it most, ties by rows lacking, then random."""
    r = random.Random(seed)
    left, folds = {row[0]: row for row in rows}, {}
    lacks = {p: [q * n for q in ratios] for p, n in collections.Counter(p for row in rows for p in pairs(row)).items()}
    missing = [q * len(rows) for q in ratios]

    def assign(i, p):
        best = max(range(len(ratios)), key=lambda f: (lacks[p][f] if p else 0, missing[f], r.random()))
        folds[i] = best
        missing[best] -= 1
        for other in pairs(left.pop(i)):
            lacks[other][best] -= 1

    while left:
        waiting = collections.defaultdict(list)
        for i, row in left.items():
            for p in pairs(row):
                waiting[p].append(i)
        if not waiting:
            for i in list(left):
                assign(i, None)
            break
        rarest = min(waiting, key=lambda p: (len(waiting[p]), p))
        for i in waiting[rarest]:
            assign(i, rarest)
    return folds


def worst(rows, folds, ratios):
    """Largest distance of a label pair's rows in a fold from that fold's share of them."""
    total = collections.Counter(p for row in rows for p in pairs(row))
    held = collections.Counter((p, folds[row[0]]) for row in rows for p in pairs(row))
    return max(abs(held[p, f] - q * n) for p, n in total.items() for f, q in enumerate(ratios))


@pytest.mark.parametrize("seed", range(3))
def test_no_worse_than_sequential(spark, seed):
    rows, ratios = table(2000, seed), [0.7, 0.1, 0.2]
    df = spark.createDataFrame(rows, ["id", *LABELS])
    got = {r.id: r.split for r in SP.iterative_split(df, ["id"], LABELS, 0.2, 0.1).collect()}
    assert len(got) == 2000
    assert worst(rows, got, ratios) <= worst(rows, sequential(rows, ratios, seed), ratios) + 1e-9
    size = collections.Counter(got.values())
    assert all(abs(size[f] - q * 2000) <= 2 for f, q in enumerate(ratios))


def test_rerun_is_equal_under_repartition(spark):
    df = spark.createDataFrame(table(700, 9), ["id", *LABELS])
    split = lambda d: sorted((r.id, r.split) for r in SP.iterative_split(d, ["id"], LABELS, 0.25).collect())
    first = split(df)
    assert first == split(df.repartition(13)) == split(df.orderBy("l0", "id").coalesce(1))
    assert {s for _, s in first} == {0, 1} and sum(s for _, s in first) == 175


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (None, 1), (None, 1)], "id int, l0 int")
    assert len(SP.iterative_split(df, ["id"], ["l0"], 0.5).collect()) == 4
    assert SP.iterative_split(df.limit(0), ["id"], ["l0"], 0.5).collect() == []
    with pytest.raises(ValueError, match="combinations"):
        SP.iterative_split(df, ["id"], ["l0"], 0.5, max_combinations=1)
