"""Hierarchical multi-label metrics (E10-E13): hierarchical F, propensity F and ICM.

Each item's label set is [ROOT, FALSE, TRUE(=label0), C1..Ck] built as column expressions (no
matrices). Class statistics (N, Nc) are a first aggregation per (run, subset); they are joined back
by key (a tiny broadcast table, safe under a hot run) for the per-item second pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.session import materialize_small


A_PROP, B_PROP = 0.55, 1.5
METRICS = ("ICM", "Hierarchical-F", "Propensity-F")


def _subset_tags(target: str, contextual: bool) -> Column:
    t = F.col(target) == 1
    tags = [F.lit("")]
    tags.append(F.when(t, F.when(F.col("implicit") < 0.5, F.lit("_explicit")).otherwise(F.lit("_implicit"))))
    if contextual:
        tags.append(F.when(t, F.when(F.col("contextual") < 0.5, F.lit("_no_contextual")).otherwise(F.lit("_contextual"))))
    return F.filter(F.array(*tags), lambda x: x.isNotNull())


def subsets(contextual: bool) -> list[str]:
    out = ["", "_explicit", "_implicit"]
    return out + ["_no_contextual", "_contextual"] if contextual else out


def hierarchical_metrics(df: DataFrame, by: Sequence[str], labels: Sequence[str], preds: Sequence[str] | None = None,
                         target: str | None = None, contextual: bool = False, split_subsets: bool = True,
                         alpha1: float = 2, alpha2: float = 2, beta: float = 3, legacy: bool = False) -> DataFrame:
    """E13 (with E10-E12): ICM, Hierarchical-F and Propensity-F per group, overall and (gold = 1) by
    implicit / contextual subsets, with N and Nc recomputed inside every subset. Output is wide.

    A class that the gold of a subset lacks has no information content: it counts as 0, and an item that
    predicts it has no ICM (null); means are over the items that have one. With ``legacy`` any such class
    makes the subset's ICM 0, and empty subsets are 0 too."""
    preds = list(preds or [c + "_pred" for c in labels])
    target = target or labels[0]
    by = list(by)
    tag = _subset_tags(target, contextual) if split_subsets else F.array(F.lit(""))
    x = df.select(*by, *labels, *preds, F.explode(tag).alias("_subset"))
    keys = [*by, "_subset"]
    # set members as SQL text: one JVM call per column instead of thousands of Column round trips
    y = ["1", f"(1 - CAST(`{labels[0]}` AS INT))", *[f"CAST(`{c}` AS INT)" for c in labels]]
    p = ["1", f"(1 - CAST(`{preds[0]}` AS INT))", *[f"CAST(`{c}` AS INT)" for c in preds]]
    m = len(y)
    stats = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_N"), *[F.expr(f"sum({y[k]})").alias(f"_Nc{k}") for k in range(m)])
    j = x.join(materialize_small(stats), keys)  # one row per (run, subset)
    N = "CAST(_N AS DOUBLE)"
    nc = [f"CAST(_Nc{k} AS DOUBLE)" for k in range(m)]
    C = f"((log2({N}) - 1) * {(B_PROP + 1) ** A_PROP!r})"
    s1 = [f"`{k}`" for k in keys]
    for k in range(m):
        s1 += [f"{y[k]} AS _y{k}", f"{p[k]} AS _p{k}", f"({y[k]}) * ({p[k]}) AS _h{k}",
               f"1 + {C} * exp(-{A_PROP!r} * log2({nc[k]} + {B_PROP!r})) AS _w{k}", f"CASE WHEN {nc[k]} > 0 THEN -log2({nc[k]} / {N}) ELSE 0.0 END AS _ic{k}"]
    unknown = f"least({', '.join(nc)}) = 0" if legacy else " OR ".join(f"({nc[k]} = 0 AND {p[k]} = 1)" for k in range(m))
    s1.append(f"({unknown}) AS _absent")
    st1 = j.selectExpr(*s1)

    def total(cols):
        return "(" + " + ".join(cols) + ")"

    def ic_set(s):
        term = [f"(CASE WHEN {s[k]} = 1 THEN _ic{k} ELSE 0.0 END)" for k in range(m)]
        return f"({total(term[3:])} - ({total(s[3:])} - 1) * {term[2]} + {term[1]})"

    Y = [f"_y{k}" for k in range(m)]
    P = [f"_p{k}" for k in range(m)]
    U = [f"greatest(_y{k}, _p{k})" for k in range(m)]
    st2 = st1.selectExpr(
        *[f"`{k}`" for k in keys], "_absent",
        f"{total([f'_h{k}' for k in range(m)])} AS _hs", f"{total(P)} AS _ps", f"{total(Y)} AS _ys",
        f"{total([f'_w{k} * _h{k}' for k in range(m)])} AS _wh", f"{total([f'_w{k} * _p{k}' for k in range(m)])} AS _wp",
        f"{total([f'_w{k} * _y{k}' for k in range(m)])} AS _wy",
        f"{ic_set(Y)} AS _icy", f"{ic_set(P)} AS _icp", f"{ic_set(U)} AS _icu")
    hf = F.expr("2 * (_hs / _ps) * (_hs / _ys) / ((_hs / _ps) + (_hs / _ys))")
    pf = F.expr("2 * (_wh / _wp) * (_wh / _wy) / ((_wh / _wp) + (_wh / _wy))")
    icm = F.expr(f"CASE WHEN _absent THEN CAST(NULL AS DOUBLE) ELSE {alpha1!r} * _icy + {alpha2!r} * _icp - {beta!r} * _icu END")
    j = st2
    per = j.select(*keys, icm.alias("ICM"), hf.alias("Hierarchical-F"), pf.alias("Propensity-F"))
    aggs = []
    for name in METRICS:
        aggs.append(F.avg(F.col(f"`{name}`")).alias(name))
    means = per.groupBy(*keys).agg(*aggs)
    if not split_subsets:
        return means.drop("_subset")
    names = subsets(contextual)
    wide = means.groupBy(*by).pivot("_subset", names).agg(*[F.first(F.col(f"`{n}`")).alias(n) for n in METRICS])
    out = []
    for s in names:
        for n in METRICS:
            src = f"{s}_{n}" if len(METRICS) > 1 else s
            value = F.coalesce(F.col(f"`{src}`"), F.lit(0.0)) if legacy else F.col(f"`{src}`")
            out.append(value.alias(f"{n}{s}"))
    return wide.select(*by, *out)
