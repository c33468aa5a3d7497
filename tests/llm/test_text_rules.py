"""op1 compression bands, op5 rule ensemble, op6 anchor expansion, op9 piece encoding."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from helpers import edge_docs, rows, SCHEMA
from hypothesis import given, settings, strategies as st

from threadlens.llm import compression, pii, rule_ensemble
from threadlens.llm.piece_bpe import Codec, PieceModel, encode_decode, merge, token_ids
from threadlens.llm.queries import piece_model

SF = "/root/testdata/sf0.001"


# --- op1 ---

def base_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = collections.Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b\x1cé #|[]", max_size=120))
def test_base_statistics(text):
    assert compression.base_statistics(text.encode()) == base_by_hand(text)


def test_compression_verdicts(spark):
    import zstandard

    noise = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=9000))
    noise = " ".join(noise[i : i + 30] for i in range(0, 9000, 30))
    prose = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").join(
        spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").limit(40).collect()]
    data = rows((1, noise, "a"), (2, "spam " * 5000, "a"), *[(100 + i, t, "a") for i, t in enumerate(prose)])
    got = {r.doc_id: r for r in compression.compression_rules(spark.createDataFrame(data, SCHEMA)).collect()}
    assert not got[1].base_failed and not got[1].kept  # incompressible
    assert got[2].base_failed and not got[2].kept
    clean = [got[100 + i] for i in range(len(prose))]
    assert all(r.kept or r.base_failed for r in clean) and sum(r.kept for r in clean) >= 30
    whole = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False).compress(noise.encode())
    assert got[1].zstd_ratio == pytest.approx(len(noise.encode()) / len(whole))


def test_compression_edges(spark):
    docs = edge_docs(spark)
    got = compression.compression_rules(docs).collect()
    assert len(got) == docs.count()
    empty = [r for r in got if r.doc_id in (4, 5)]
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in empty)
    assert compression.compression_rules(docs.limit(0)).collect() == []


# --- op5 ---

def test_tree_rules():
    text = """RandomForestClassificationModel: uid=x, numTrees=1
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 <= 2.0)
      Predict: 0.0
     Else (feature 1 > 2.0)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
"""
    got = rule_ensemble.tree_rules(text, ("x", "y"))
    assert {r.terms for r in got} == {
        (("x", True, 0.5),), (("x", True, 0.5), ("y", True, 2.0)), (("x", True, 0.5), ("y", False, 2.0)), (("x", False, 0.5),)}


def test_fitted_rules_by_hand(spark):
    """The compiled column against the fitted rules, evaluated row by row in plain Python."""
    import math

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = rule_ensemble.learn(docs, labels)
    assert len(model.weighted) > 1
    got = {r.doc_id: r.score for r in rule_ensemble.scored(docs, model).collect()}
    rows = docs.select("doc_id", rule_ensemble.statistics_of(docs["text"]).alias("s")).select("doc_id", "s.*").collect()
    assert len(rows) == len(got) == 1000
    for r in rows:
        total = model.intercept
        for weight, rule in model.weighted:
            if all(r[name] <= limit if at_most else r[name] > limit for name, at_most, limit in rule.terms):
                total += weight
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = rule_ensemble.quality_scores(docs.withColumn("score", docs.doc_id), labels).join(labels, "doc_id").collect()
    test = [r for r in got if r.held_out]
    assert len(test) > 50 and sum(r.predicted == r.quality for r in test) / len(test) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_quality_edges(spark):
    docs = edge_docs(spark)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = rule_ensemble.quality_scores(docs, none).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.5}
    kept = rule_ensemble.keep_good(docs, none, threshold=0.4)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert rule_ensemble.quality_scores(docs.limit(0), none).collect() == []


# --- op6 ---

def base_by_pattern(text):
    out = collections.defaultdict(list)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        total = sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out["phone"].append(m.span())
    return [out[k] for k in pii.BASE_KINDS]


def test_very_long_numbers(spark):
    """10,000 digits in every base kind: no part is read as a number before its length is known."""
    zeros, ones = "0" * 10_000, "1" * 10_000
    texts = [f"x {zeros}1.1.1.1 y", f"{ones}.1.1.1", f"1.1.1.{zeros}9", ones, f"+{ones}", f"+1 {zeros}", f"a@{ones}.{zeros}", f"IBAN GB82{ones}", f"ssn {ones}"]
    for t in texts:
        found = pii.spans_of(t)
        assert [found[k] for k in pii.BASE_KINDS] == base_by_pattern(t)
    df = spark.createDataFrame(rows(*[(i, t, "a") for i, t in enumerate(texts)]), SCHEMA)
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    assert got[0].n_ip == got[2].n_ip == 1 and got[1].n_ip == 0 and all(r.n_spans >= r.n_more for r in got.values())


def test_brackets_are_no_symbols():
    assert compression.base_statistics(b"a [b] c #")[2] == 1


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "-", "+", " ", "b.c", "1", "12", "255", "300", "1.2.3.4", "é", "İ", "4111 1111 1111 1111",
                                 "+1 (974) 555-3436", "x@y.z", "@@", "..", "(", "٣", "\n", "%", "+1"]), max_size=24))
def test_base_spans(parts):
    text = "".join(parts)
    found = pii.spans_of(text)
    assert [found[k] for k in pii.BASE_KINDS] == base_by_pattern(text)


def test_more_spans_and_mask():
    text = 'see https://u:p@host.example/x?y=1. IBAN: GB82 WEST 1234 5698 7654 32, SSN 123-45-6789, token = "04dbebab91ab85687d33eeaa"'
    found = pii.spans_of(text)
    cut = {k: [text[a:b] for a, b in found[k]] for k in pii.KINDS if found[k]}
    assert cut["url"] == ["https://u:p@host.example/x?y=1"] and cut["iban"] == ["GB82 WEST 1234 5698 7654 32"]
    assert cut["ssn"] == ["123-45-6789"] and cut["secret"] == ["04dbebab91ab85687d33eeaa"]
    assert "GB82" not in pii.masked(text, found) and "<IBAN>" in pii.masked(text, found)
    assert pii.spans_of("IBAN: GB83 WEST 1234 5698 7654 32")["iban"] == []  # wrong check digits


def test_pii_edges(spark):
    docs = edge_docs(spark)
    got = pii.find_personal_data(docs).collect()
    assert len(got) == docs.count()
    blank = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == blank and r.spans == "" for r in got if r.doc_id in (4, 5, 6))
    assert pii.find_personal_data(docs.limit(0)).collect() == []
    assert pii.mask_personal_data(spark.createDataFrame(rows((1, "mail a@b.cd", "x")), SCHEMA)).first().text == "mail <EMAIL>"


# --- op9 ---

def test_merge_order():
    scores = {"ab": -2.0, "bc": -1.0, "abc": -3.0, "aa": -1.0}
    assert merge(list("abc"), scores) == ["abc"] and merge(list("aaa"), scores) == ["aa", "a"] and merge([], scores) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁ab\n\t\x00éthe漢🙂"), st.characters(codec="utf-8")), max_size=60))
def test_ids_equal_the_library(text):
    model = PieceModel.__dict__.get("_test") or PieceModel(piece_model())
    PieceModel._test = model
    ids = np.frombuffer(next(iter(model.encode([text]))), "<u4").tolist()
    assert ids == model.library.encode(text, add_bos=True, add_eos=True)


def test_encode_decode(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    library = PieceModel(piece_model()).library
    got = {r.doc_id: r for r in encode_decode(docs, Codec(piece_model())).collect()}
    ids = {r.doc_id: r.ids for r in token_ids(docs, Codec(piece_model())).collect()}
    for r in docs.collect():
        want = library.encode(r.text, add_bos=True, add_eos=True)
        assert ids[r.doc_id] == want and got[r.doc_id].n_tokens == len(want)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()


def test_generations_of_segments():
    model = PieceModel(piece_model(), remember_bytes=10_000, longest=20)
    texts = [" ".join(f"word{i} thing{i % 7}" for i in range(k, k + 40)) for k in range(0, 200, 20)]
    got = [np.frombuffer(x, "<u4").tolist() for x in model.encode(texts, block=100)]
    assert got == model.library.encode(texts, add_bos=True, add_eos=True)


def test_encode_edges(spark):
    docs = edge_docs(spark)
    got = encode_decode(docs, Codec(piece_model())).collect()
    assert len(got) == docs.count()
    assert all(r.n_tokens == 2 for r in got if r.doc_id in (4, 5))
    assert encode_decode(docs.limit(0), Codec(piece_model())).collect() == []
