"""Weight vectors against exploded replicates, partial draws and the soft form."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.operators.resample import bootstrap_ci, bootstrap_poisson


def runs(spark, n=60):
    rows = [("a" if i % 2 else "b", i, i % 3 % 2, (i * 7) % 5 % 2, 0.9 if i % 3 % 2 else 0.1, (i * 13 % 100) / 100, i % 2) for i in range(n)]
    schema = "run string, id long, stereo int, stereo_pred int, stereo_soft double, stereo_pred_soft double, implicit int"
    return rows, spark.createDataFrame(rows, schema)


def weight(i, run, k, rate):
    u = int(hashlib.md5(f"{i}|{run}|{k}|42".encode()).hexdigest()[:8], 16) / 4294967296.0
    total, term, out = 0.0, math.exp(-rate), 0
    for j in range(12):
        total += term
        term *= rate / (j + 1)
        out += u >= total
    return out


@pytest.mark.parametrize(("n", "frac"), [(1000, 1.0), (40, 0.3)])
def test_vectors_equal_replicates(spark, n, frac):
    rows, df = runs(spark)
    got = {r.run: r for r in bootstrap_poisson(df, ["run"], ["id"], n=n, frac=frac, soft=True).collect()}
    for run in ("a", "b"):
        mine = [r for r in rows if r[0] == run]
        out = {m: [] for m in ("f1_neg", "f1_pos", "cross_entropy", "MSE", "TP_MSE")}
        for k in range(1, n + 1):
            w = np.array([weight(r[1], run, k, frac) for r in mine], float)
            t, p, s, q = (np.array([r[j] for r in mine]) for j in (2, 3, 4, 5))
            wrong = w[t != p].sum()
            for name, c in (("f1_neg", 0), ("f1_pos", 1)):
                ok = w[(t == c) & (p == c)].sum()
                out[name].append(2 * ok / (2 * ok + wrong) if 2 * ok + wrong else 0.0)
            ce = -s * np.log(np.clip(q, 1e-12, 1 - 1e-12) + 1e-9)
            out["cross_entropy"].append((w * ce).sum() / w.sum() if w.sum() else 0.0)
            out["MSE"].append(math.sqrt((w * (s - q) ** 2).sum() / w.sum()) if w.sum() else 0.0)
            tp = (t == 1) & (p == 1)
            out["TP_MSE"].append(math.sqrt((w * (s - q) ** 2)[tp].sum() / w[tp].sum()) if w[tp].sum() else 0.0)
        for m, x in out.items():
            assert got[run][m] == pytest.approx(np.mean(x), abs=1e-9)
            assert got[run][m + "_min"] == pytest.approx(np.percentile(x, 2.5), abs=1e-9)
            assert got[run][m + "_max"] == pytest.approx(np.percentile(x, 97.5), abs=1e-9)


def test_an_item_stays_one_row(spark):
    _, df = runs(spark)
    plan = bootstrap_poisson(df, ["run"], ["id"], n=1000)._jdf.queryExecution().optimizedPlan().toString()
    first = plan[plan.rindex("Aggregate"):]  # from the first aggregate down to the items
    assert "Generate" not in first and plan.count("Generate") == 1


def test_smaller_draws_are_wider(spark):
    _, df = runs(spark, 400)
    width = lambda frac: {r.run: r.f1_pos_max - r.f1_pos_min for r in bootstrap_ci(df, ["run"], n=400, frac=frac).collect()}
    whole, part = width(1.0), width(0.1)
    assert all(part[r] > 2 * whole[r] for r in whole)
    assert df.select(F.count("*")).first()[0] == 400
