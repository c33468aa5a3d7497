"""Boundary rows and reference quirks."""

import math

from pyspark.sql import functions as F

from threadlens.operators import calibration as CAL
from threadlens.operators import changes as C
from threadlens.operators import context as X
from threadlens.operators import hierarchical as H
from threadlens.operators import metrics as M
from threadlens.operators import splits as SP


def test_all_one_class_and_empty_cells(spark):
    df = spark.createDataFrame([(1, 1, 0.9, 0), (1, 0, 0.6, 1), (1, 1, 0.8, 1)],
                               "stereo int, stereo_pred int, softmax_confidence double, implicit int")
    r = M.task1_metrics(df.withColumn("run", F.lit(1)), ["run"]).first()
    assert (r["TN"], r["FP"]) == (0, 0)
    assert r["precision_neg"] == 0.0 and r["recall_neg"] == 0.0 and r["f1_neg"] == 0.0
    assert r["mcc"] == 0.0  # undefined -> 0
    assert r["TN_softmax_confidence"] == 0.0 and r["TN_softmax_confidence_std"] == 0.0  # empty cell -> 0
    assert r["TP_softmax_confidence_std"] > 0
    assert math.isclose(r["accuracy_explicit"], 1.0) and math.isclose(r["accuracy_implicit"], 0.5)


def test_argmax_tie_takes_first(spark):
    df = spark.createDataFrame([([1.0, 1.0],), ([0.0, 2.0],)], "z array<double>")
    rows = CAL.softmax_confidence(df, "z").collect()
    assert rows[0]["pred"] == 0 and math.isclose(rows[0]["softmax_confidence"], 0.5)
    assert rows[1]["pred"] == 1


def test_icm_absent_gold_class_is_zero_with_legacy(spark):
    # topic t2 never occurs in gold: ICM undefined (reference NaN -> 0 after fillna), F measures defined
    rows = [(1, 1, 0, 1, 1, 0, 0), (0, 0, 0, 0, 0, 0, 1), (1, 1, 1, 1, 0, 0, 0)]
    df = spark.createDataFrame(rows, "stereo int, stereo_pred int, t1 int, t1_pred int, implicit int, t2 int, t2_pred int")
    out = H.hierarchical_metrics(df.withColumn("run", F.lit(1)), ["run"], ["stereo", "t1", "t2"], legacy=True).first()
    assert out["ICM"] == 0.0
    assert 0 < out["Hierarchical-F"] <= 1 and 0 < out["Propensity-F"] <= 1


def test_no_context_counts_legacy_bases(spark):
    avg = spark.createDataFrame(
        [("m", "0_no_context", 1, 0.0), ("m", "0_no_context", 1, 1.0), ("m", "0_no_context", 0, 1.0),
         ("m", "0_no_context", 0, 0.0), ("m", "0_no_context", 0, 0.0)],
        "model string, context string, stereo int, stereo_pred double")
    fixed = C.no_context_counts(avg, 0.3).first()
    legacy = C.no_context_counts(avg, 0.3, legacy_bases=True).first()
    assert (fixed["FP"], fixed["TN"], fixed["FN"], fixed["TP"]) == (1, 2, 1, 1)
    assert (legacy["FP"], legacy["FN"]) == (1, 1)
    assert math.isclose(fixed["FP_pct"], 100 / 3) and math.isclose(legacy["FP_pct"], 100 / 3)
    assert math.isclose(fixed["FN_pct"], 50.0)


def test_mape_legacy_relation(spark):
    df = spark.createDataFrame([(i, i % 3, (i * 7) % 2, (i * 5) % 3 == 0) for i in range(30)],
                               "row_id int, group_id int, l1 int, l2 boolean").withColumn("l2", F.col("l2").cast("int"))
    sizes = SP.ordered_groups(SP.group_sizes(df, "group_id"), "group_id")
    cands = SP.candidate_group_splits(sizes, "group_id", 0.3, 0.1)
    for r in SP.score_group_splits(df, cands, "group_id", ["l1", "l2"]).collect():
        assert math.isclose(r["mape_legacy"], (2 * r["MAPE"] + 1) / 3)


def test_missing_and_equal_contexts(spark):
    df = spark.createDataFrame([(1, "a", ""), (2, "b", "0"), (3, "c", "[]"), (4, "d", "d"), (5, "e", "x")],
                               "id int, text string, ctx string")
    kept = [r["id"] for r in X.drop_missing_context(df, "ctx").collect()]
    assert sorted(kept) == [4, 5]
    kept = [r["id"] for r in X.drop_context_equal_text(df, "ctx", "text").collect()]
    assert sorted(kept) == [1, 2, 3, 5]


def test_refill_context_takes_next_farther(spark):
    df = spark.createDataFrame([("t", "t", "t", "r"), ("t", "f", "h", "r"), ("t", "t", "h", "r")],
                               "text string, c1 string, c2 string, c3 string")
    got = [r["c1"] for r in X.refill_context_equal_text(df, "c1", "text", ["c1", "c2", "c3"]).collect()]
    assert got == ["r", "f", "h"]


def test_single_seed_welch_is_null(spark):
    from threadlens.operators.seeds import welch_test

    long = spark.createDataFrame([("m", "0_no_context", "f1", 0.5), ("m", "2_ctx", "f1", 0.6)],
                                 "model string, context string, metric string, value double")
    r = {x["context"]: x for x in welch_test(long, with_pvalue=True).collect()}
    assert r["2_ctx"]["ttest"] is None and r["2_ctx"]["pvalue"] is None
