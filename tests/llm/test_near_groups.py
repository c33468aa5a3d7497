"""op7: links inside a unit against all pairs, and the time of a large group."""

import random
import time

import numpy as np
from hypothesis import given, settings, strategies as st

from threadlens.llm.near_dedup import links_within


def groups(n, links):
    of = list(range(n))
    for a, b in links:
        x, y = of[a], of[b]
        of = [min(x, y) if g in (x, y) else g for g in of]
    return of


def all_pairs(sets, percent):
    s = [set(x.tolist()) for x in sets]
    return [(i, j) for i in range(len(s)) for j in range(i) if 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j])]


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from([50, 80, 85, 100]))
def test_links_connect_what_all_pairs_connect(seed, percent):
    r = random.Random(seed)
    bases = [r.sample(range(60), r.randrange(1, 30)) for _ in range(r.randrange(1, 4))]
    sets = []
    for _ in range(r.randrange(1, 25)):
        x = set(r.choice(bases))
        for _ in range(r.randrange(4)):
            x ^= {r.randrange(60)}
        if x:
            sets.append(np.array(sorted(x), np.uint64))
    if sets:
        links = links_within(np.arange(len(sets)), sets, percent)
        assert groups(len(sets), links) == groups(len(sets), all_pairs(sets, percent))
        assert len(links) == len(sets) - len(set(groups(len(sets), links)))


def test_five_thousand_near_copies_in_one_group():
    """Chains of near copies and copies of two unlike bases: linked as brute force links them, within seconds."""
    r = np.random.default_rng(2)
    base, other = (r.choice(10**6, 100, replace=False).astype(np.uint64) for _ in range(2))
    sets, kind = [], []
    for i in range(5000):
        x = np.array(base if i % 5 else other)
        x[r.choice(100, 5, replace=False)] = 10**6 + r.choice(10**9, 5)
        sets.append(np.unique(x))
        kind.append(i % 5 == 0)
    began = time.time()
    of = groups_of(len(sets), links_within(np.arange(len(sets)), sets, 80))
    assert time.time() - began < 10
    assert of[kind].min() == of[kind].max() and of[~np.array(kind)].min() == of[~np.array(kind)].max() and of[0] != of[1]
    part = sets[:400]
    assert groups(400, links_within(np.arange(400), part, 85)) == groups(400, all_pairs(part, 85))


def groups_of(n, links):
    of = np.arange(n)
    for a, b in links:
        x, y = of[a], of[b]
        of[(of == x) | (of == y)] = min(x, y)
    return of
