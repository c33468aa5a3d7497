"""Properties, boundaries and brute-force checks of the iterative / custom operators."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from threadlens.functions.stats import t_sf_two_sided
from threadlens.operators import calibration as CAL
from threadlens.operators import context as X
from threadlens.operators import metrics as M
from threadlens.operators import seeds as S
from threadlens.operators import splits as SP
from threadlens.operators import threads as TH
from threadlens.sources import adapters as A
from threadlens.sources import io as IO


def test_accuracy_is_cells(spark):
    m = M.metrics1(A.preds(spark, SF_SMALL), ["model", "context", "seed"]).collect()
    for r in m:
        n = r["TN"] + r["FP"] + r["FN"] + r["TP"]
        assert math.isclose(r["accuracy"], (r["TP"] + r["TN"]) / n)


def test_seed_average_single_seed_is_identity(spark):
    p = A.preds(spark, SF_SMALL).filter(F.col("seed") == 42)
    raw = p.select("doc_id", "model", "context", F.col("stereo_pred").cast("double").alias("raw"))
    avg = S.seed_average_hard(p, ["doc_id"]).join(raw, ["doc_id", "model", "context"])
    assert avg.count() == p.count()
    assert avg.filter(F.col("stereo_pred") != F.col("raw")).count() == 0


def test_fill_context_idempotent(spark):
    t = A.tweets(spark, SF_SMALL)
    ctx = ["txt_father", "txt_head", "rh_text"]
    once = X.fill_context(t, "text", ctx).select("tweet_id", *ctx)
    twice = X.fill_context(once.join(t.select("tweet_id", "text"), "tweet_id"), "text", ctx).select("tweet_id", *ctx)
    assert once.exceptAll(twice).count() == 0


def test_metrics_invariant_to_repartition(spark):
    p = A.preds(spark, SF_SMALL)
    a = M.task1_metrics(p, ["model", "context", "seed"], soft=True)
    b = M.task1_metrics(p.repartition(7, "doc_id"), ["model", "context", "seed"], soft=True)
    cols = a.columns
    ra = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in a.select(*cols).collect())
    rb = sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in b.select(*cols).collect())
    assert ra == rb


def test_group_split_disjoint_and_complete(spark):
    g = A.groups(spark, SF_SMALL)
    s = SP.group_disjoint_split(g, "group_id", ["l1", "l2", "l3", "l4"], 0.2, 0.125, 0.05)
    assert s.count() == g.count()
    per_group = s.groupBy("group_id").agg(F.count_distinct("split").alias("k"))
    assert per_group.filter(F.col("k") > 1).count() == 0


def _brute_candidates(sizes, ratio, eps, nested):
    """Independent enumeration: sets in listing order whose last member first reaches the ratio."""
    full = sum(sizes)
    out = set()
    n = len(sizes)
    for k in range(1, n + 1):
        for combo in itertools.combinations(range(n), k):
            before = sum(sizes[i] for i in combo[:-1]) / full
            share = sum(sizes[i] for i in combo) / full
            e = eps if k == 1 else nested
            if before < ratio <= share <= ratio + e:
                out.add(combo)
    return out


def test_candidate_group_splits_brute_force(spark):
    sizes = [3, 4, 4, 5, 7, 9, 11, 13]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "group_id int, size long")
    ranked = SP.ordered_groups(df, "group_id")
    order = [r["group_id"] for r in ranked.orderBy("rank").collect()]
    got = {tuple(order.index(g) for g in r["members"]) for r in SP.candidate_group_splits(ranked, "group_id", 0.25, 0.03).collect()}
    want = _brute_candidates([sizes[g] for g in order], 0.25, 0.03, 0.02)
    assert got == want


def test_thread_components_brute_force(spark):
    edges = [(1, 1), (2, 1), (3, 2), (4, 4), (5, 4), (6, 99), (7, 6), (8, 8)]
    df = spark.createDataFrame(edges, "comment_id long, reply_to long")
    got = {r["comment_id"]: r["thread"] for r in TH.thread_components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8}


def test_welch_pvalue_matches_commons_math(spark):
    # two-sided Student-t tail probabilities against the JVM's commons-math3 TDistribution
    cases = [(2.0, 10.0), (1.0, 5.0), (3.5, 30.0), (0.3, 2.5), (12.0, 3.7)]
    td = spark._jvm.org.apache.commons.math3.distribution.TDistribution
    want = [2 * td(df).cumulativeProbability(-t) for t, df in cases]
    got = t_sf_two_sided(np.array([c[0] for c in cases]), np.array([c[1] for c in cases]))
    assert np.allclose(got, want, rtol=1e-7, atol=1e-12)


def test_fit_temperature_matches_grid(spark):
    lg = A.logits(spark, SF_SMALL).withColumn("z", F.array("z0", "z1"))
    r = CAL.fit_temperature(lg, [], "z", "label").first()
    pdf = lg.select("z0", "z1", "label").toPandas()
    z, y = pdf[["z0", "z1"]].to_numpy(), pdf["label"].to_numpy()

    def nll(t):
        zt = z / t
        m = zt.max(1)
        return (m + np.log(np.exp(zt - m[:, None]).sum(1)) - zt[np.arange(len(y)), y]).mean()

    grid = np.exp(np.linspace(np.log(0.05), np.log(50), 4001))
    best = grid[np.argmin([nll(t) for t in grid])]
    assert abs(r["temperature"] - best) / best < 0.01
    assert r["nll_after"] <= r["nll_before"] + 1e-12


def test_parse_run_names(spark):
    names = ["stereohoax-roberta_bne-0_no_context_hard_s47_max_tokens_512-task1.csv",
             "detests-mbert-5_concat_contexts_hard_s65_max_tokens_512-task1.csv_",
             "tfidf+svc_1_gram-task1.csv", "all_ones-task1.csv"]
    df = spark.createDataFrame([(n,) for n in names], "file_name string")
    r = {x["file_name"]: x for x in IO.parse_run(df).collect()}
    a = r[names[0]]
    assert (a["data"], a["model"], a["context"], a["context_level"], a["kind"], a["seed"], a["suffix"], a["task"]) == (
        "stereohoax", "roberta_bne", "0_no_context", 0, "hard", 47, "max_tokens_512", 1)
    b = r[names[1]]
    assert (b["data"], b["model"], b["context"], b["seed"]) == ("detests", "mbert", "5_concat_contexts", 65)
    c = r[names[2]]
    assert (c["model"], c["task"], c["seed"], c["context"]) == ("tfidf+svc_1_gram", 1, None, None)


def test_title_case_like_python(spark):
    words = ["tfidf+svc_1_gram", "roberta_bne-2_txt_father", "all_ones", "a1b c'd"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(S.title_case(F.col("w"))).collect()]
    assert got == [w.title() for w in words]


def test_bootstrap_contains_point_estimate(spark):
    from threadlens.operators.resample import bootstrap_ci

    p = A.preds(spark, SF_SMALL).filter((F.col("seed") == 42) & (F.col("model") == "beto"))
    ci = bootstrap_ci(p, ["model", "context"], n=200).collect()
    point = {r["context"]: r["f1_pos"] for r in M.metrics1(p, ["model", "context"]).collect()}
    for r in ci:
        assert r["f1_pos_min"] - 1e-3 <= point[r["context"]] <= r["f1_pos_max"] + 1e-3
