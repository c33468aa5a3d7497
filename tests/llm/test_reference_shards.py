"""The broadcast form of op2: shards against plain search, bounds and edges."""

import random

import duckdb
import pytest
from helpers import SCHEMA, edge_docs, rows, words

from threadlens.llm import queries
from threadlens.llm.substring_dedup import FlatAutomaton, remove_reference_spans

SF = "/root/testdata/sf0.001"


def plain(docs, reference, window):
    known = {tuple(w[i : i + window]) for t in reference for w in [(t or "").encode().split()] for i in range(len(w) - window + 1)}
    out = []
    for i, t in docs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if tuple(w[p : p + window]) in known:
                gone[p : p + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def test_shards_match_plain_search(spark):
    r = random.Random(8)
    reference = [" ".join(words(r.randrange(0, 90), r.random(), 12)) for _ in range(40)] + [None, "", " ".join(words(700, 3, 5))]
    docs = []
    for i in range(120):
        parts = [w for _ in range(r.randrange(4)) for w in ((r.choice(reference) or "").split()[r.randrange(9) :] if r.random() < 0.5 else words(9, r.random(), 12))]
        docs.append((i, r.choice([" ", "\n "]).join(parts)))
    docs += [(None, reference[0]), (200, None), (7, docs[7][1])]
    df = spark.createDataFrame(rows(*[(i, t, "s") for i, t in docs]), SCHEMA)
    ref = spark.createDataFrame([(t,) for t in reference], "text string")
    for options in ({}, {"shard_bytes": 400, "slice_bytes": 300}):
        got = sorted(map(tuple, remove_reference_spans(df, ref, window=6, **options).collect()), key=str)
        assert got == plain(docs, reference, 6)


def test_matching_statistics_of_many_texts():
    import numpy as np

    flat = FlatAutomaton([[b"a", b"b", b"a", b"c"], [b"c", b"c"]])
    names = {w.as_py(): i for i, w in enumerate(flat.words)}
    texts = [b"a b a c c x a b".split(), b"", b"c c c".split()]
    number = np.array([names.get(w, -1) for t in texts for w in t])
    sizes = np.array([len(t) for t in texts])
    assert flat.longest(number, np.cumsum(sizes) - sizes, sizes).tolist() == [1, 2, 3, 4, 2, 0, 1, 2, 1, 2, 2]


def test_bounds_and_empty_tables(spark):
    docs = edge_docs(spark)
    with pytest.raises(ValueError, match="at most 100"):
        remove_reference_spans(docs, docs, max_bytes=100)
    none = remove_reference_spans(docs, docs.limit(0)).collect()
    assert len(none) == docs.count() and all(r.n_removed == 0 for r in none)
    assert remove_reference_spans(docs.limit(0), docs).collect() == []


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES["remove_benchmark_spans"](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL['remove_benchmark_spans']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
