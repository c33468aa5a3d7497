"""op12 part codes and op13 source divergence against plain versions."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from threadlens.llm import divergence, part_codes, queries, tokens

SF = "/root/testdata/sf0.001"


# --- op12 ---

@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=40),
       st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=6), st.integers(1, 4))
def test_walk_finds_the_nearest_entry(rows, book, wide):
    rows, book = np.array(rows, np.int64), np.array(book, np.int64)
    distinct, number = part_codes.distinct_rows(rows)
    assert distinct.tolist() == [list(x) for x in sorted(set(map(tuple, rows.tolist())))]
    assert (distinct[number] == rows).all()
    entry, distance = part_codes.nearest(distinct, book, wide)
    every = ((distinct[:, None] - book[None]) ** 2).sum(axis=2)
    assert entry.tolist() == every.argmin(axis=1).tolist() and distance.tolist() == every.min(axis=1).tolist()


def plain_codes(rows, entries, rounds=4, parts=4):
    """rows: (vec_id, comps, label) -> codes and errors, books; everything by plain loops."""
    width = len(rows[0][1]) // parts
    cut = [[tuple(c[p * width : (p + 1) * width]) for p in range(parts)] for _, c, _ in rows]
    seeds = {}
    for i, (v, c, _) in enumerate(rows):
        if v not in seeds or c < rows[seeds[v]][1]:
            seeds[v] = i
    first = [seeds[v] for v in sorted(seeds, key=lambda v: (v is None, v or 0))][:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = collections.defaultdict(list)
            for c in cut:
                got[nearest(c[p], books[p])[1]].append(c[p])
            for k, members in got.items():
                books[p][k] = tuple(sum(x) // len(members) for x in zip(*members))
    out = []
    for (v, _, label), c in zip(rows, cut):
        best = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((v, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
    by_label = collections.Counter()
    for _, _, e, label in out:
        by_label[label] += e
    text = ",".join(str(x) for book in books for e in book for x in e)
    return sorted(((*o[:3], by_label[o[3]]) for o in out), key=str), hashlib.sha256(text.encode()).hexdigest()


def test_codes_with_ties_repeats_and_nulls(spark):
    r = random.Random(3)
    data = [(i, [r.randrange(-4, 5) / 1024 for _ in range(8)], r.choice([1, 2, None]), "x", 0.0) for i in range(120)]
    data += [data[5]] * 40 + [(7, [0.0] * 8, 9, "x", 0.0), (None, [0.001] * 8, None, "x", 0.0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, code string, error double")
    whole = [(v, [int(np.floor(1024 * float(np.float32(x)))) for x in e], label) for v, e, label, *_ in data]
    for entries in (5, 256):
        codes, books = part_codes.compress(df, part_codes.Coder(entries=entries, wide=16))
        want, digest = plain_codes(whole, entries)
        assert sorted(((x.vec_id, x.code, x.error, x.label_error) for x in codes.collect()), key=str) == want
        assert part_codes.books_digest(books) == digest


def test_codes_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    bad = [(0, None, 1), (1, [1.0, None, 0.0, 0.0], 1), (2, [float("nan")] * 4, 1), (3, [float("inf")] * 4, 1)]
    df = spark.createDataFrame([*bad, (4, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (5, [], None), (6, [1e30] * 8, 1)], schema)
    codes, books = part_codes.compress(df)
    assert {x.vec_id for x in codes.collect()} == {4, 5, 6} and books.shape == (4, 3, 2)
    assert all(x.error == 0 for x in codes.collect())  # each its own entry
    codes, books = part_codes.compress(df.where("vec_id < 4"))
    assert codes.collect() == [] and books.size == 0
    codes, _ = part_codes.compress(df.where("vec_id = 5"))
    assert [(x.vec_id, x.code, x.error) for x in codes.collect()] == [(5, "00000000", 0)]


# --- op13 ---

def plain_divergences(docs, best=200):
    """docs: (text, lang, source)."""
    groups, held, uses = set(), collections.defaultdict(set), collections.Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, (text, lang, source) in enumerate(docs):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower)):
            held[lang, t].add(i)
            uses[lang, source, t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        terms = [t for (x, t), d in held.items() if x == lang and len(d) >= 3]
        mine = [s for x, s in groups if x == lang]
        n = {s: sum(uses[lang, s, t] for t in terms) for s in mine}
        share = lambda c, size: 1 + 10**9 * (c + 1) // (size + len(terms))
        f = lambda p, q: (p - q) * (p - q) // q
        for s in mine:
            p = {t: share(uses[lang, s, t], n[s]) for t in terms}
            pairs = [(o, sum(f(p[t], share(uses[lang, o, t], n[o])) for t in terms)) for o in mine if o != s]
            whole = {t: share(sum(uses[lang, o, t] for o in mine), sum(n.values())) for t in terms}
            single = [(t, f(p[t], whole[t])) for t in terms if uses[lang, s, t] and p[t] > whole[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", single, best)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(items, 1)]
    return sorted(out)


def test_divergences(spark):
    r = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqré"] + ["Ünï", "ÜNÏ", "日本"]
    docs = []
    for i in range(400):
        lang, source = r.choice(["en", "de", None]), r.choice(["s1", "s1", "s1", "s2", "é", None])
        k = r.randrange(3, len(vocabulary))
        docs.append((" ".join(r.choice([w, w.upper(), w + "!"]) for w in r.choices(vocabulary[:k], k=r.randrange(30))), lang, source))
    docs += [docs[0]] * 5 + [(None, None, "only null"), ("", "xx", "s1"), ("1 2 3", "xx", "s2"), ("rare", "yy", "s1"), ("Word " * 5000, "en", "s1")]
    df = spark.createDataFrame([(*d, 1, 2.0, "k") for d in docs], "text string, lang string, source string, value int, rank double, item string")
    want = plain_divergences(docs, best=7)
    for options in ({}, {"cells": 1, "batch_bytes": 300}):  # blocks of 64 terms, slices of a few documents
        got = divergence.divergences(df, best=7, **options).select("lang", "source", "part", "item", "value", "rank")
        assert sorted(tuple(x) for x in got.collect()) == want
    assert divergence.divergences(df.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=8, max_size=8), min_size=2, max_size=5))
def test_equal_subtrees_are_one_node(counts):
    counts = np.array(counts, np.int64)
    trees = divergence.Trees(counts)
    for k in range(len(trees.left)):
        pairs = list(zip(trees.left[k].tolist(), trees.right[k].tolist()))
        assert len(pairs) == len(set(pairs)) == len({tuple(r) for r in counts.reshape(-1, 2 << k).tolist()})
    sizes = counts.sum(axis=1) + 8
    for g in range(len(counts) - 1):
        others = np.arange(g + 1, len(counts))
        there, here = trees.price(g, others, sizes)
        for o, x, y in zip(others, there, here):
            p, q = divergence.shares(counts[g], sizes[g]), divergence.shares(counts[o], sizes[o])
            assert (x, y) == (divergence.prices(p, q).sum(), divergence.prices(q, p).sum())


def test_shares_are_exact_for_large_counts():
    for c, n in [(0, 1), (5 * 10**14, 9 * 10**14), (2**40, 2**50), (10**15, 10**15 + 1)]:
        assert int(divergence.shares(np.array([c]), n)[0]) == 1 + 10**9 * (c + 1) // n


def test_tokens_match_patterns():
    texts = ["a\x1cb c\x00d \x1f\x85e\u2003f\xa0g", "\x00", "\x1c \x1d", "A\u0130B", "", " a  B\t", "É é\x0b\x0cx", "A-b_c1d e", "日 本", "\n"]
    for table, pattern in ((tokens.WORDS, r"[^\x20\x09-\x0D]+"), (tokens.TERMS, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")):
        owner, number, distinct = tokens.tokens([t.encode() for t in texts], table)
        got = [(o, distinct[n].as_py()) for o, n in zip(owner.tolist(), number.tolist())]
        want = [(i, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)) for i, t in enumerate(texts) for w in re.findall(pattern, t)]
        assert got == want


@pytest.mark.parametrize("name", ["op12_part_trie", "op13_segment_trees"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(want, key=str)
