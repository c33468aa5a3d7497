"""Gold join and all-runs evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.operators import hierarchical as H
from threadlens.operators import metrics as M
from threadlens.operators import seeds as S
from threadlens.session import materialize_small


class MergeError(ValueError):
    """The test table is not unique on the join keys."""


def join_gold(preds: DataFrame, test: DataFrame, keys: Sequence[str], run: Sequence[str],
              check_test: bool = True) -> tuple[DataFrame, DataFrame]:
    """Left join the test attributes not already in the run table, validated 1:1.

    Runs with a repeated key are rejected (returned as a rejects table, like the reference's skipped
    files); a test table that is not unique on the keys raises ``MergeError``. Both checks are
    aggregations on the key columns.
    """
    keys, run = list(keys), list(run)
    if check_test:
        dup = test.groupBy(*keys).count().filter(F.col("count") > 1).limit(1).count()
        if dup:
            raise MergeError("test table is not unique on " + ", ".join(keys))
    rejects = preds.groupBy(*run, *keys).count().filter(F.col("count") > 1).select(*run).distinct()
    rejects = materialize_small(rejects)
    good = preds.join(rejects, run, "left_anti")
    extra = [c for c in test.columns if c not in preds.columns or c in keys]
    return good.join(test.select(*extra), keys, "left"), rejects


def enrich_test(test: DataFrame, tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left join extra attribute tables (soft labels, implicit categories, annotators) by key;
    missing numeric attributes -> 0."""
    out = test
    added: list[str] = []
    for t in tables:
        cols = [c for c in t.columns if c not in out.columns or c in keys]
        added += [c for c in cols if c not in keys]
        out = out.join(t.select(*cols), list(keys), "left")
    numeric = [f.name for f in out.schema.fields if f.name in added and f.dataType.typeName() in
               ("integer", "long", "double", "float", "short")]
    return out.fillna(0, subset=numeric)


def evaluate_runs(preds: DataFrame, test: DataFrame, keys: Sequence[str], run: Sequence[str], task: int = 1,
                  target: str = "stereo", topics: Sequence[str] = (), contextual: bool = False,
                  kind_col: str | None = "kind") -> tuple[DataFrame, DataFrame]:
    """Every run -> J7 -> task metrics -> A11 (hard and soft runs) -> A10 (ICM_norm, tasks 2/3).

    One DataFrame program over all runs: the metrics are a single ``groupBy(run)`` per task shape.
    Returns (metrics, rejected runs).
    """
    joined, rejects = join_gold(preds, test, keys, run)
    if task == 1:
        if kind_col and kind_col in joined.columns and target + "_pred_soft" in joined.columns:
            is_soft = F.coalesce(F.col(kind_col), F.lit("hard")) == "soft"
            hard = M.task1_metrics(joined.filter(~is_soft), run, target, contextual=contextual)
            soft = M.task1_metrics(joined.filter(is_soft), run, target, soft=True, contextual=contextual)
            out = S.union_metrics([hard, soft])
        else:
            out = M.task1_metrics(joined, run, target, contextual=contextual)
        return out, rejects
    labels = [target, "implicit"] if task == 2 else [target, *topics]
    out = H.hierarchical_metrics(joined, run, labels, target=target, contextual=contextual)
    return S.min_max_norm(out, "ICM"), rejects
