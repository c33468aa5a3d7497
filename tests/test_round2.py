"""Threads of any depth, reading of result files, calibration that tells whether it converged."""

import math
import os
import time

import pytest
from pyspark.sql import functions as F

from threadlens.functions import text as TX
from threadlens.operators import calibration as CAL
from threadlens.operators import changes as C
from threadlens.operators import hierarchical as H
from threadlens.operators import metrics as M
from threadlens.operators import seeds as S
from threadlens.operators import splits as SP
from threadlens.operators import threads as TH
from threadlens.operators.components import connected_components
from threadlens.sources import io as IO

THREAD = "comment_id long, reply_to long"


def chain(n, base):
    """A thread whose ids fall away from the root: every comment answers the one with the next larger id."""
    return [(base + i, base + min(i + 1, n - 1)) for i in range(n)]


def test_long_chains_and_cycles(spark):
    cycle = [(5000, 5001), (5001, 5002), (5002, 5000), (5003, 5002)]
    rows = chain(200, 1000) + cycle + [(7000, 6999), (8000, 8000), (8001, 8000), (8002, None)]
    df = spark.createDataFrame(rows, THREAD)
    began = time.time()
    root = {r.comment_id: r.first_comment_id for r in TH.find_root(df, pos=None).collect()}
    assert {root[1000 + i] for i in range(200)} == {"1199"}
    assert {root[i] for i in (5000, 5001, 5002, 5003, 7000)} == {TH.UNAVAILABLE} and root[8001] == "8000"
    assert time.time() - began < 60
    began = time.time()
    thread = {r.comment_id: r.thread for r in TH.thread_components(df).collect()}
    assert {thread[1000 + i] for i in range(200)} == {1000}
    assert {thread[i] for i in (5000, 5001, 5002, 5003)} == {5000}
    assert thread[7000] == 6999 and thread[8001] == 8000 and thread[8002] == 8002
    assert time.time() - began < 60


def test_components_of_no_edges(spark):
    df = spark.createDataFrame([(3, 3), (None, 4)], "a long, b long")
    assert [tuple(r) for r in connected_components(df).collect()] == [(3, 3)]
    assert connected_components(df.limit(0)).collect() == []


def test_comment_table_without_window(spark):
    df = spark.createDataFrame([(1, 2, 1, "b"), (1, 1, 1, " a "), (1, 3, 9, "c"), (2, 1, 1, None), (3, 2, 1, "z"), (3, 1, 1, None)],
                               "comment_id long, sentence_pos int, reply_to long, sentence string")
    got = {r.comment_id: (r.reply_to, r.comment) for r in TH.comment_table(df).collect()}
    assert got == {1: (9, "a  b c"), 2: (1, None), 3: (1, "z")}


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_baselines_of_two_corpora_and_headers(spark, tmp_path):
    """Files of two corpora stay apart, and a header in another order is read by name."""
    for data, header, rows in (("stereohoax", "index,stereo,stereo_pred", "1,0,1\n2,1,1\n"), ("detests", "stereo_pred,index,stereo", "1,1,0\n0,2,1\n1,3,0\n")):
        write(f"{tmp_path}/{data}/baselines/all_ones-task1.csv", f"{header}\n{rows}")
    paths = [f"file://{tmp_path}/{d}" for d in ("stereohoax", "detests")]
    runs = IO.read_predictions(spark, paths, "index long, stereo int, stereo_pred int, softmax_confidence double")
    got = {r["data"]: (r["TN"], r["FP"], r["FN"], r["TP"]) for r in M.confusion(runs, ["data", "model"]).collect()}
    assert got == {"stereohoax": (0, 1, 0, 1), "detests": (0, 2, 1, 0)}
    assert runs.select("model", "task", "softmax_confidence", "file_name").distinct().collect() == [("all_ones", 1, None, "all_ones-task1.csv")]


def test_mixed_headers_fail(spark, tmp_path):
    write(f"{tmp_path}/m/a-task1.csv", "index,stereo,stereo_pred\n1,0,1\n")
    write(f"{tmp_path}/m/b-task1.csv", "index,stereo_pred,stereo\n1,0,1\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        IO.read_predictions(spark, [f"file://{tmp_path}/m"], "index long, stereo int, stereo_pred int").collect()


def test_news_with_quotes_and_lines(spark, tmp_path):
    write(f"{tmp_path}/news.csv", 'file_id;news_title;tokenized_news_title\nA;"first; ""quoted""\nsecond line";x\nB;plain;y\n')
    got = {r.file_id: r.news_title for r in IO.read_news(spark, f"file://{tmp_path}/news.csv").collect()}
    assert got == {"A": 'first; "quoted"\nsecond line', "B": "plain"}


def test_union_keeps_null_keys(spark):
    a = spark.createDataFrame([("m", 1, 0.5)], "model string, seed int, f1 double")
    b = spark.createDataFrame([("base", None, 0.25)], "model string, seed int, mcc double")
    got = {r.model: (r.seed, r.f1, r.mcc) for r in S.union_metrics([a, b]).collect()}
    assert got == {"m": (1, 0.5, 0.0), "base": (None, 0.0, 0.25)}


def test_hard_and_soft_runs_stay_apart(spark):
    rows = [(k, "m", c, s, 1, 1, p, 0.5) for k, p in (("hard", 1), ("soft", 0)) for c in ("0_no_context", "2_x") for s in (1, 2)]
    df = spark.createDataFrame(rows, "kind string, model string, context string, seed int, id int, stereo int, stereo_pred int, softmax_confidence double")
    got = {(r.kind, r.context): r.stereo_pred for r in S.seed_average_hard(df, ["id"]).collect()}
    assert got == {("hard", "0_no_context"): 1.0, ("hard", "2_x"): 1.0, ("soft", "0_no_context"): 0.0, ("soft", "2_x"): 0.0}
    changed = df.withColumn("stereo_pred", F.when((F.col("kind") == "soft") & (F.col("context") == "2_x"), 1).otherwise(F.col("stereo_pred")))
    assert [r.kind for r in C.context_changes_from_runs(changed, ["id"], ["2_x"]).collect()] == ["soft"]


def test_temperature_says_whether_it_converged(spark):
    import random

    r = random.Random(1)
    rows = [("noisy", [0.0, r.gauss(0, 4)], r.randrange(2)) for _ in range(200)] + [("separable", [0.0, 3.0], 1)] * 20
    df = spark.createDataFrame(rows, "g string, z array<double>, y int")
    got = {x.g: x for x in CAL.fit_temperature(df, ["g"], "z", "y", max_iter=30).collect()}
    assert got["noisy"].converged and got["noisy"].nll_after <= got["noisy"].nll_before
    few = {x.g: x for x in CAL.fit_temperature(df.where("g = 'noisy'"), ["g"], "z", "y", max_iter=1).collect()}
    assert not few["noisy"].converged


def test_cleaning_is_planned_once(spark):
    df = spark.createDataFrame([("mira 😀 esto @ana http://x.y 😀",)], "text string")
    out = df.select(TX.preprocess(F.col("text"), {"😀": "cara_feliz"}).alias("t"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("http") == 1
    assert "emoji cara feliz emoji" in out.first().t


def test_icm_counts_what_gold_knows(spark):
    """A class without gold: an item that predicts it has no ICM, the others keep theirs."""
    schema = "stereo int, stereo_pred int, t1 int, t1_pred int, t2 int, t2_pred int, implicit int, run int"
    rows = [(1, 1, 1, 1, 0, 0, 0, 1), (0, 0, 0, 0, 0, 0, 0, 1), (1, 1, 0, 0, 0, 1, 0, 1)]
    df = spark.createDataFrame(rows, schema)
    with_bad = H.hierarchical_metrics(df, ["run"], ["stereo", "t1", "t2"]).first()
    t1 = false = -math.log2(1 / 3)  # IC of {TRUE, t1} and of {FALSE}, both predicted exactly
    assert with_bad["ICM"] == pytest.approx((t1 + false) / 2)
    assert with_bad["ICM_implicit"] is None


def test_order_and_batches(spark):
    df = spark.range(37).select((F.col("id") * 7 % 37).alias("g"), F.lit(1).alias("x"))
    got = SP.batch_groups(df, "g", 10).collect()
    sizes = sorted((r.batch, r.batch_size) for r in got)
    assert sorted(set(sizes)) == [(1, 10), (2, 9), (3, 9), (4, 9)] and len(got) == 37
    listed = SP.ordered_groups(SP.group_sizes(df.union(df.where("g < 3")), "g"), "g", exclude_smallest=30).orderBy("rank").collect()
    assert [r["rank"] for r in listed] == list(range(1, 8)) and [r.g for r in listed[-3:]] == [0, 1, 2]
