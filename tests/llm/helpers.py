"""Small inputs and brute-force versions for the corpus operators."""

import random

SCHEMA = "doc_id long, text string, source string, lang string, size long, score double, row string, `_hash` long, n_words int"


def rows(*pairs):
    """(doc_id, text, source) -> rows with extra columns whose names clash with the operators' own."""
    return [(i, t, s, "en", 7, 0.5, "r", 3, 1) for i, t, s in pairs]


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edge_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows, a long text, copies and near copies."""
    base = words(120, 1)
    near = base[:60] + ["changed"] + base[61:]
    long = words(30_000, 2, 50_000)
    data = rows(
        (1, " ".join(base), "a"), (2, " ".join(near), "b"), (3, " ".join(base), None), (3, " ".join(base), None),
        (4, None, "a"), (5, "", "b"), (6, " \n\t ", "c"), (None, "no id here", "c"), (None, None, None),
        (7, " ".join(long), "c"), (8, "one two", "a"), (9, "ONE two", "b"), (10, "line\nshared line\nend", "a"),
        (11, "other\nshared line\n", "b"), (12, "shared line", "c"), (13, "x y z " * 60, "a"))
    return spark.createDataFrame(data, SCHEMA)


def removed_repeats(docs, window=20):
    """doc_id -> (words, removed, kept) by brute force; docs: (doc_id, text) with distinct ids."""
    first = {}
    split = {i: (t or "").encode().split() for i, t in docs}
    for i in sorted(split):
        w = split[i]
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), (i, p))
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] != (i, p):
                gone[p : p + window] = [True] * window
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def components(docs, percent=85):
    """doc_id -> (set size, smallest linked id) by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (len(sets[i]), root(i)) for i in ids}
