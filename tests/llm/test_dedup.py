"""op2 repeated spans, op7 near-duplicates, op8 boilerplate lines."""

import random

import numpy as np
from helpers import SCHEMA, components, edge_docs, removed_repeats, rows, words
from hypothesis import given, settings, strategies as st

from threadlens.llm import line_spread, near_dedup, substring_dedup
from threadlens.llm.common import WordHashes

# --- op2 ---


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14), max_size=4), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14))
def test_matching_statistics(passages, query):
    automaton = substring_dedup.SuffixAutomaton()
    for p in passages:
        automaton.add(p)
    known = {tuple(p[i:j]) for p in passages for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
    for end, got in enumerate(automaton.matching(query), 1):
        assert got == max([n for n in range(end + 1) if n == 0 or tuple(query[end - n : end]) in known])


def corpus(seed=5):
    r = random.Random(seed)
    shared = [words(n, 100 + n, 60) for n in (19, 20, 21, 35, 80)]
    docs = []
    for i in range(40):
        parts = []
        for _ in range(r.randrange(1, 5)):
            parts += words(r.randrange(0, 40), r.random(), 300)
            if r.random() < 0.7:
                parts += r.choice(shared)
        docs.append((i * 3, " ".join(parts)))
    docs += [(200, docs[4][1]), (201, docs[4][1]), (202, "a " * 70), (203, "a b " * 50), (204, "a b c " * 30), (205, None), (206, ""), (207, " ".join(shared[4]) * 2)]
    return docs


def check_repeats(spark, docs, **options):
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows(*[(i, t, "s") for i, t in docs]), SCHEMA), **options).collect()
    want = removed_repeats(docs)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want and len(got) == len(docs)


def test_repeats(spark):
    check_repeats(spark, corpus())


def test_repeats_with_hot_anchors(spark):
    """A passage in many contexts: its anchors are dealt out by single windows."""
    passage = words(30, 77)
    docs = [(i, " ".join(words(25, i) + passage + words(25, -i - 1))) for i in range(60)]
    check_repeats(spark, docs, hot=8)


def test_repeats_edges(spark):
    docs = edge_docs(spark)
    got = substring_dedup.remove_repeats(docs).collect()
    assert len(got) == docs.count()
    assert [r.n_removed for r in got if r.doc_id == 3] == [120, 120] and [r.n_removed for r in got if r.doc_id == 1] == [0]
    assert [r.n_removed for r in got if r.doc_id == 2] == [119]
    assert sorted((r.n_words, r.kept) for r in got if r.doc_id is None) == [(0, ""), (3, "no id here")]
    assert substring_dedup.remove_repeats(docs.limit(0)).collect() == []


def test_reference_spans(spark):
    passage = words(50, 3)
    reference = spark.createDataFrame([(" ".join(passage),), (None,), ("",)], "text string")
    docs = spark.createDataFrame(rows((1, " ".join(words(30, 9) + passage[5:40] + words(30, 8)), "a"), (2, " ".join(passage[:19]), "a"), (3, None, "a")), SCHEMA)
    got = {r.doc_id: r for r in substring_dedup.remove_reference_spans(docs, reference).collect()}
    assert got[1].n_removed == 35 and got[1].text.split() == words(30, 9) + words(30, 8)
    assert got[2].n_removed == 0 and got[3].n_words == 0


# --- op7 ---


def near_copies(seed=11):
    """Clusters of copies with growing numbers of edits, so that similarities lie on both sides of the limit."""
    r = random.Random(seed)
    docs, i = [], 0
    for c in range(6):
        base = words(150, 1000 + c)
        for _ in range(25):
            text = list(base)
            for _ in range(r.randrange(0, 6)):
                text[r.randrange(len(text))] = f"e{r.randrange(10**6)}"
            docs.append((i, " ".join(text)))
            i += 1
    docs += [(i, docs[0][1].upper()), (i + 1, "A b"), (i + 2, "a B"), (i + 3, "a b c"), (i + 4, None), (i + 5, "  ")]
    return docs


def test_links_within_is_exact():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 50))).astype(np.uint64) for _ in range(60)]
    found = near_dedup.links_within(np.arange(60), sets, 50)

    def groups(pairs):
        parent = list(range(60))
        for a, b in pairs:
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
        out = []
        for i in range(60):
            while parent[i] != i:
                i = parent[i]
            out.append(i)
        return out

    every = [(i, j) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 50 * len(np.union1d(sets[i], sets[j]))]
    assert groups(found) == groups(every)


def test_near_duplicates(spark):
    docs = near_copies()
    df = spark.createDataFrame(rows(*[(i, t, "s") for i, t in docs]), SCHEMA)
    want = components(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == want
    # a group that outgrows one unit is cut into parts
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, near_dedup.Tensor(unit_bytes=8_000)).collect()}
    assert got == want


def test_near_duplicates_edges(spark):
    docs = edge_docs(spark)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[3].component_id == 1 and not by_id[3].kept and by_id[9].component_id == 8
    assert by_id[4].kept and by_id[4].n_shingles == 0 and by_id[6].kept
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted(i for i, r in by_id.items() if i and r.kept)
    assert near_dedup.near_duplicates(docs.limit(0)).collect() == []


# --- op8 ---


def test_boilerplate(spark):
    r = random.Random(4)
    lines = [f"line {i}" for i in range(30)] + ["", "  "]
    docs = [(i, "\n".join(r.choices(lines, weights=range(1, 33), k=8)), r.choice([None, "a", "b", "c", "d", "e", "f"])) for i in range(60)]
    sites = {x: {s for _, t, s in docs if s is not None and x in t.split("\n")} for x in lines}
    bad = {x for x in lines if x.strip() and len(sites[x]) >= 4}
    assert 3 < len(bad) < 30
    got = {x.doc_id: x for x in line_spread.remove_boilerplate(spark.createDataFrame(rows(*docs), SCHEMA), 4).collect()}
    for i, t, _ in docs:
        split = t.split("\n")
        assert got[i].text == "\n".join(x for x in split if x not in bad)
        assert got[i].n_lines == sum(bool(x.strip()) for x in split) and got[i].n_removed == sum(x in bad for x in split)


def test_boilerplate_edges(spark):
    docs = edge_docs(spark)
    out = line_spread.remove_boilerplate(docs, 3)
    assert out.columns == docs.columns + ["n_lines", "n_removed"]
    got = out.collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[10].text == "line\nend" and by_id[11].text == "other\n" and by_id[12].text == "" and by_id[4].text is None
    assert line_spread.remove_boilerplate(docs.limit(0), 3).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b\x1cé", max_size=60), st.sampled_from([1, 3, 10, 1 << 20]))
def test_word_hashes(text, block):
    raw = text.encode()
    split, found = raw.split(), WordHashes(block).of(raw)
    assert len(found) == len(split)
    assert all((a == b) == (x == y) for a, x in zip(split, found) for b, y in zip(split, found))
    assert (found == WordHashes().of(raw)).all()
