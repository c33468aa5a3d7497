"""Golden rows (FIXTURES §3) and golden metric values (BASELINE §3, rebuilt from their cell counts)."""

import math

import pytest
from pyspark.sql import functions as F

from threadlens.functions import text as TX
from threadlens.operators import context as X
from threadlens.operators import metrics as M
from threadlens.operators import threads as TH


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("r")).first()["r"]


def test_mask(spark):
    assert one(spark, TX.mask, "@ana http://x.y 3km jajaja :)") == "@user URL NUM km jaja jaja"


def test_split_hashtags(spark):
    got = one(spark, TX.split_hashtags, "hola #MiHashTagES #2023 x#no #año2")
    assert got == "hola hashtag Mi Hash Tag ES #2023 x#no hashtag año2"


def test_squeeze_repeats(spark):
    assert one(spark, TX.squeeze_repeats, "holaaaa") == "holaa"
    assert one(spark, TX.squeeze_repeats, "a\n\n\nb") == "a\n\n\nb"  # newlines are not squeezed


def test_preprocess_order(spark):
    # masks are applied after lower-casing, so URL / NUM stay upper case
    assert one(spark, TX.preprocess, "Hola http://x.y 12 ¿Qué?") == "hola URL NUM qué"


def test_soft_label_values(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (1, 1, 0), (1, 1, 1)], "s_a1 int, s_a2 int, s_a3 int")
    got = [r["s_soft"] for r in X.soft_label(df, "s").collect()]
    assert got == [0.0474, 0.2689, 0.7311, 0.9526]


@pytest.mark.parametrize("contexts,filled,concat", [
    (("", "h", "r"), ("h", "h", "r"), "h r"),
    (("t", "0", "r"), ("r", "r", "r"), "r"),
])
def test_fill_context(spark, contexts, filled, concat):
    df = spark.createDataFrame([("t", *contexts)], "text string, c1 string, c2 string, c3 string")
    r = X.fill_context(df, "text", ["c1", "c2", "c3"]).first()
    assert (r["c1"], r["c2"], r["c3"]) == filled
    assert r["concat_contexts"] == concat


def test_agreement(spark):
    from threadlens.operators.calibration import agreement

    df = spark.createDataFrame([(0.0474,), (0.2689,), (0.7311,), (0.9526,)], "s double")
    assert [r[0] for r in df.select(agreement(F.col("s"))).collect()] == [1.0, 0.67, 0.67, 1.0]


def test_find_root_missing_parent(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 9)], "comment_id long, reply_to long")
    got = {r["comment_id"]: r["first_comment_id"] for r in TH.find_root(df, pos=None).collect()}
    assert got == {1: "1", 2: "1", 3: "1", 4: "UNAVAILABLE"}


def test_find_root_cycle(spark):
    df = spark.createDataFrame([(5, 6), (6, 5), (7, 8), (8, 9), (9, 7), (10, 7)], "comment_id long, reply_to long")
    got = {r["comment_id"]: r["first_comment_id"] for r in TH.find_root(df, pos=None).collect()}
    assert set(got.values()) == {"UNAVAILABLE"}


def test_previous_sentences(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "comment_id long, sentence_pos int, sentence string")
    got = [r["previous_sentences"] for r in TH.previous_sentences(df).orderBy("sentence_pos").collect()]
    assert got == ["", "a", "a b"]


# BASELINE §3: (TN, FP, FN, TP) -> accuracy, F1 neg, F1 pos, AUC, MCC (4 decimals)
GOLDEN = [
    ((0, 715, 0, 357), (0.3330, 0.0000, 0.4997, 0.5000, 0.0000)),
    ((715, 0, 357, 0), (0.6670, 0.8002, 0.0000, 0.5000, 0.0000)),
    ((599, 116, 174, 183), (0.7295, 0.8051, 0.5579, 0.6752, 0.3682)),
    ((502, 213, 265, 92), (0.5541, 0.6775, 0.2779, 0.4799, -0.0420)),
    ((647, 68, 179, 178), (0.7696, 0.8397, 0.5904, 0.7017, 0.4522)),
    ((1247, 77, 299, 189), (0.7925, 0.8690, 0.5013, 0.6646, 0.4126)),
    ((968, 356, 112, 376), (0.7417, 0.8053, 0.6164, 0.7508, 0.4535)),
    ((162, 552, 97, 261), (0.3946, 0.3330, 0.4458, 0.4780, -0.0485)),
]


@pytest.mark.parametrize("cells,expected", GOLDEN)
def test_metrics1_golden(spark, cells, expected):
    tn, fp, fn, tp = cells
    rows = [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn + [(1, 1)] * tp
    df = spark.createDataFrame(rows, "stereo int, stereo_pred int").withColumn("run", F.lit("r"))
    r = M.metrics1(df, ["run"]).first()
    assert (r["TN"], r["FP"], r["FN"], r["TP"]) == cells
    got = (r["accuracy"], r["f1_neg"], r["f1_pos"], r["roc_auc"], r["mcc"])
    for g, e in zip(got, expected):
        assert math.isclose(round(g, 4), e, abs_tol=1e-9), (got, expected)


def test_gold_upper_bound_is_one(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (1, 0, 1)], "stereo int, implicit int, contextual int")
    r = M.gold_upper_bound(df.withColumn("run", F.lit(1)), ["run"], contextual=True).first()
    assert r["f1_pos"] == 1.0 and r["f1_neg"] == 1.0 and r["accuracy"] == 1.0 and r["mcc"] == 1.0
