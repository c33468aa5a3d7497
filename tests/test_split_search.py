"""M1: the search for group sets against plain enumeration, and with many groups."""

import itertools
import random
import time

import numpy as np
import pytest

from threadlens.operators import splits as SP


def listed(sizes):
    return [(i, f"g{i}", s) for i, s in enumerate(sorted(sizes), 1)]


def plain(groups, ratio, eps, nested):
    full = float(sum(s for _, _, s in groups))
    out = set()
    for k in range(1, len(groups) + 1):
        for c in itertools.combinations(groups, k):
            total = sum(s for _, _, s in c)
            if (total - c[-1][2]) / full < ratio <= total / full <= ratio + (eps if k == 1 else nested):
                out.add((",".join(g for _, g, _ in c), total))
    return out


def search(spark, groups, ratio, eps, nested, **options):
    df = spark.createDataFrame(groups, "rank int, g string, size long")
    return SP.candidate_group_splits(df, "g", ratio, eps, nested, **options)


@pytest.mark.parametrize("seed", range(4))
def test_both_forms_match_enumeration(spark, seed):
    r = random.Random(seed)
    groups = listed([r.choice([1, 2, 3, 5, r.randrange(1, 60)]) for _ in range(r.choice([1, 2, 9, 12]))])
    for ratio, eps, nested in ((0.2, 0.01, 0.02), (0.1, 0.3, 0.0), (0.5, 0.0, 0.1)):
        want = plain(groups, ratio, eps, nested)
        for options in ({}, {"most_groups": 0}):
            rows = search(spark, groups, ratio, eps, nested, **options).collect()
            assert len(rows) == len({x.candidate for x in rows}) and {(x.candidate, x.size) for x in rows} == want
            assert all(",".join(x.members) == x.candidate for x in rows)


def test_no_groups_and_one_group(spark):
    assert search(spark, [], 0.2, 0.1, 0.1).collect() == []
    assert [x.candidate for x in search(spark, listed([5]), 1.0, 0.0, 0.0).collect()] == ["g1"]


def test_forty_five_groups(spark):
    """2**45 sets: the halves meet within a minute, and every set that a sorted two-halves count finds is there."""
    r = random.Random(9)
    groups = listed([r.randrange(100_000, 1_000_000) for _ in range(45)])
    full = sum(s for _, _, s in groups)
    ratio, nested = 0.2, 2 / full
    began = time.time()
    rows = search(spark, groups, ratio, nested, nested).collect()
    assert time.time() - began < 60
    size = {g: s for _, g, s in groups}
    for x in rows:
        total = sum(size[m] for m in x.members)
        assert total == x.size and ratio <= total / full <= ratio + nested and (total - size[x.members[-1]]) / full < ratio

    least, most = SP.share_bounds(full, ratio, nested)
    half = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
    for k, (_, _, s) in enumerate(groups):
        side = k % 2  # another cut than the search's
        half[side] = np.concatenate([half[side], half[side] + s])
        half[side] = half[side][half[side] <= most]
    a, b = np.sort(half[0]), half[1]
    pairs = np.searchsorted(a, most - b, "right") - np.searchsorted(a, least - b, "left")
    assert len(rows) == len({x.candidate for x in rows}) == int(pairs.sum()) > 1000
