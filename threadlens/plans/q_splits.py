"""Distribution, split-search and split queries on the `groups` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.config import TOPICS
from threadlens.operators import metrics as M
from threadlens.operators import splits as SP
from threadlens.plans.registry import query
from threadlens.sources import adapters as A

LABELS = ["l1", "l2", "l3", "l4"]
R1, EPS1, NESTED = 0.1, 0.002, 0.02          # candidate search shown by M1 / M2 / O1 / J12
TEST_R, VAL_R, EPS, SMALL = 0.2, 0.125, 0.01, 2  # group-disjoint split (M3)


def _f(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def search_sql(prefix: str, rows: str, ratio: float, eps: float, exclude: int = 0) -> str:
    """CTEs {prefix}_g (ranked groups), {prefix}_f (recursive frontier), {prefix}_cand (candidates)."""
    return f"""{prefix}_sz AS (SELECT group_id, count(*) AS size FROM {rows} GROUP BY group_id),
{prefix}_g0 AS (SELECT row_number() OVER (ORDER BY size, group_id) AS rank, group_id AS gid, size AS gsize FROM {prefix}_sz),
{prefix}_g AS (SELECT row_number() OVER (ORDER BY rank) AS rank, gid, gsize FROM {prefix}_g0 WHERE rank > {exclude}),
{prefix}_tot AS (SELECT CAST(sum(gsize) AS DOUBLE) AS full FROM {prefix}_g),
{prefix}_f(members, last, sz, depth) AS (
  SELECT [gid], rank, gsize, 1 FROM {prefix}_g
  UNION ALL
  SELECT list_append(f.members, g.gid), g.rank, f.sz + g.gsize, f.depth + 1
  FROM {prefix}_f f JOIN {prefix}_g g ON g.rank > f.last, {prefix}_tot t WHERE f.sz / t.full < {_f(ratio)}),
{prefix}_cand AS (SELECT array_to_string(members, ',') AS candidate, members, sz AS size, sz / t.full AS share
  FROM {prefix}_f, {prefix}_tot t
  WHERE sz / t.full >= {_f(ratio)} AND sz / t.full <= {_f(ratio)} + CASE WHEN depth = 1 THEN {_f(eps)} ELSE {_f(NESTED)} END)"""


def score_sql(prefix: str, rows: str) -> str:
    L = len(LABELS)
    sums = ", ".join(f"sum({c}) AS {c}" for c in LABELS)
    tsum = ", ".join(f"CAST(sum({c}) AS DOUBLE) AS t_{c}" for c in LABELS)
    pct = {c: f"(CAST({c} AS DOUBLE) * 100.0 / CAST(n AS DOUBLE))" for c in LABELS}
    obj = {c: f"(t_{c} * 100.0 / n_all)" for c in LABELS}
    mse = "(" + " + ".join(f"pow({pct[c]} - {obj[c]}, 2)" for c in LABELS) + f") / {L}"
    mape = "(" + " + ".join(f"abs({pct[c]} - {obj[c]}) / greatest(abs({pct[c]}), {SP.FLOAT_EPS!r})" for c in LABELS) + f") / {L}"
    return f"""{prefix}_gs AS (SELECT group_id, count(*) AS n, {sums} FROM {rows} GROUP BY group_id),
{prefix}_obj AS (SELECT CAST(sum(n) AS DOUBLE) AS n_all, {tsum} FROM {prefix}_gs),
{prefix}_per AS (SELECT c.candidate, sum(s.n) AS n, {", ".join(f"sum(s.{c}) AS {c}" for c in LABELS)}
  FROM (SELECT candidate, unnest(members) AS group_id FROM {prefix}_cand) c JOIN {prefix}_gs s USING (group_id)
  GROUP BY c.candidate),
{prefix}_score AS (SELECT candidate, {", ".join(f"{pct[c]} AS {c}" for c in LABELS)}, {mse} AS MSE, {mape} AS MAPE,
  ({mape}) * {L} / {L + 1} + 1.0 / {L + 1} AS mape_legacy FROM {prefix}_per, {prefix}_obj),
{prefix}_best AS (SELECT unnest(c.members) AS group_id FROM {prefix}_cand c
  JOIN (SELECT candidate FROM {prefix}_score ORDER BY MAPE, candidate LIMIT 1) b USING (candidate))"""


SEARCH1 = "WITH RECURSIVE " + search_sql("s1", "groups", R1, EPS1) + ",\n" + score_sql("s1", "groups")
M3_SQL = ("WITH RECURSIVE " + search_sql("t", "groups", TEST_R, EPS, SMALL) + ",\n" + score_sql("t", "groups") + """,
rest AS (SELECT * FROM groups WHERE group_id NOT IN (SELECT group_id FROM t_best)),
""" + search_sql("v", "rest", VAL_R, EPS) + ",\n" + score_sql("v", "rest") + """,
split AS (SELECT g.row_id, g.group_id, g.l1, g.l2, g.l3, g.l4,
  CASE WHEN g.group_id IN (SELECT group_id FROM t_best) THEN 'test'
       WHEN g.group_id IN (SELECT group_id FROM v_best) THEN 'val' ELSE 'train' END AS split FROM groups g)""")


def candidates(spark, d):
    g = A.groups(spark, d)
    return SP.candidate_group_splits(SP.ordered_groups(SP.group_sizes(g, "group_id"), "group_id"), "group_id",
                                     R1, EPS1, NESTED)


def scores(spark, d):
    return SP.score_group_splits(A.groups(spark, d), candidates(spark, d), "group_id", LABELS)


def m3(spark, d):
    return SP.group_disjoint_split(A.groups(spark, d), "group_id", LABELS, TEST_R, VAL_R, EPS, SMALL, NESTED)


@query("label_distribution", views=("groups",), dbl=("pct",), sql=f"""
WITH long AS (UNPIVOT (SELECT {", ".join(LABELS)} FROM groups) ON {", ".join(LABELS)} INTO NAME label VALUE value),
c AS (SELECT label, value, count(*) AS count FROM long GROUP BY label, value)
SELECT *, count / sum(count) OVER (PARTITION BY label) * 100 AS pct FROM c""")
def q_label_distribution(spark, d):
    return SP.label_distribution(A.groups(spark, d), LABELS)


@query("group_sizes", views=("groups",), sql="SELECT group_id, count(*) AS size FROM groups GROUP BY group_id")
def q_group_sizes(spark, d):
    return SP.sort_by(SP.group_sizes(A.groups(spark, d), "group_id"), ["size", "group_id"])


@query("n_groups", views=("groups",), sql="SELECT count(DISTINCT group_id) AS n_groups FROM groups")
def q_n_groups(spark, d):
    return SP.n_groups(A.groups(spark, d), "group_id")


@query("group_value_counts", views=("groups",), sql="SELECT group_id, l1, count(*) AS count FROM groups GROUP BY group_id, l1")
def q_group_value_counts(spark, d):
    return SP.group_value_counts(A.groups(spark, d), "group_id", "l1")


@query("class_weights", views=("groups",), dbl=("weight",), sql="""
WITH c AS (SELECT l1, count(*) AS n_c FROM groups GROUP BY l1)
SELECT l1, n_c, sum(n_c) OVER () / (count(*) OVER () * n_c) AS weight FROM c""")
def q_class_weights(spark, d):
    return SP.class_weights(A.groups(spark, d), "l1")


@query("candidate_group_splits", views=("groups",), dbl=("share",), sql=SEARCH1 + "\nSELECT candidate, size, share FROM s1_cand")
def q_candidate_group_splits(spark, d):
    return candidates(spark, d).drop("members")


@query("score_group_splits", views=("groups",), dbl=(*LABELS, "MSE", "MAPE", "mape_legacy"), sql=SEARCH1 + "\nSELECT * FROM s1_score")
def q_score_group_splits(spark, d):
    return scores(spark, d)


@query("rank_splits", views=("groups",), dbl=(*LABELS, "MSE", "MAPE", "mape_legacy"),
       sql=SEARCH1 + "\nSELECT * FROM s1_score ORDER BY MAPE, candidate LIMIT 5")
def q_rank_splits(spark, d):
    return SP.rank_splits(scores(spark, d), "MAPE", 5)


@query("split_by_groups", views=("groups",), sql=SEARCH1 + """
SELECT row_id, group_id FROM groups WHERE group_id IN (SELECT group_id FROM s1_best)""")
def q_split_by_groups(spark, d):
    best = SP.best_candidate_groups(scores(spark, d), candidates(spark, d), "group_id")
    return SP.split_by_groups(A.groups(spark, d), "group_id", best).select("row_id", "group_id")


@query("group_disjoint_split", views=("groups",), sql=M3_SQL + "\nSELECT row_id, group_id, split FROM split")
def q_group_disjoint_split(spark, d):
    return m3(spark, d).select("row_id", "group_id", "split")


@query("split_balance", views=("groups",), dbl=("ratio",), sql=M3_SQL + f"""
, long AS (UNPIVOT (SELECT split, {", ".join(LABELS)} FROM split) ON {", ".join(LABELS)} INTO NAME label VALUE value),
g AS (SELECT label, split, count_if(value = 1) AS n1, count_if(value = 0) AS n0 FROM long GROUP BY label, split)
SELECT *, CASE WHEN n0 > 0 THEN n1 / n0 * 100 ELSE 0.0 END AS ratio FROM g""")
def q_split_balance(spark, d):
    return SP.split_balance(m3(spark, d), LABELS, "split")


@query("group_share", views=("groups",), dbl=("pct",), sql=M3_SQL + """
, r AS (SELECT split, group_id, count(*) AS n FROM split GROUP BY ROLLUP (split, group_id))
SELECT *, n / max(CASE WHEN split IS NULL AND group_id IS NULL THEN n END) OVER () * 100 AS pct FROM r""")
def q_group_share(spark, d):
    return SP.group_share(m3(spark, d), "split", "group_id")


@query("split_group_sets", views=("groups",), sql=M3_SQL + """
SELECT DISTINCT group_id FROM groups WHERE group_id NOT IN (SELECT group_id FROM t_best)
  AND group_id NOT IN (SELECT group_id FROM v_best)""")
def q_split_group_sets(spark, d):
    s = m3(spark, d)
    return SP.split_group_sets(s, s.filter(F.col("split") == "test"), s.filter(F.col("split") == "val"), "group_id")


def _u_sql(key: str, seed: int = 42) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws('|', {key}, {seed})), 1, 8)) AS BIGINT) / 4294967296.0"


@query("stratified_split", views=("groups",), sql=f"""
WITH x AS (SELECT row_id, concat_ws('', {", ".join(f"CAST({c} AS VARCHAR)" for c in LABELS)}) AS combo, {_u_sql('row_id')} AS u FROM groups),
c AS (SELECT combo, count(*) AS cn FROM x GROUP BY combo),
y AS (SELECT x.row_id, x.u, CASE WHEN c.cn < 2 THEN 'rare' ELSE x.combo END AS combo FROM x JOIN c USING (combo)),
r AS (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY u, row_id) AS rk, count(*) OVER (PARTITION BY combo) AS n FROM y),
k AS (SELECT *, round_even(CAST(n AS DOUBLE) * {0.2!r}, 0) AS n_test FROM r)
SELECT row_id, CAST(CASE WHEN rk <= n_test THEN 2 WHEN rk <= n_test + round_even((n - n_test) * {0.1 / (1 - 0.2)!r}, 0) THEN 1
  ELSE 0 END AS INT) AS split FROM k""")
def q_stratified_split(spark, d):
    g = A.groups(spark, d)
    return SP.stratified_split(g, ["row_id"], LABELS, 0.2, 0.1).select("row_id", "split")


@query("iterative_split")
def q_iterative_split(spark, d):
    """M4: tweets split by all labels and pairs of labels (target and topics); rows-only, checked against a sequential version."""
    t = A.tweets(spark, d).select("tweet_id", "stereo", *TOPICS)
    return SP.iterative_split(t, ["tweet_id"], ["stereo", *TOPICS], 0.2, 0.1).select("tweet_id", "split")


@query("batch_groups", views=("groups",), sql=f"""
WITH s AS (SELECT group_id, count(*) AS size FROM groups GROUP BY group_id),
b AS (SELECT group_id, size, ntile(7) OVER (ORDER BY {_u_sql('group_id')}, group_id) AS batch FROM s)
SELECT *, sum(size) OVER (PARTITION BY batch) AS batch_size FROM b""")
def q_batch_groups(spark, d):
    return SP.batch_groups(A.groups(spark, d), "group_id", 4)


@query("shuffle", views=("groups",), dbl=("shuffle_key",), sql=f"SELECT row_id, {_u_sql('row_id')} AS shuffle_key FROM groups")
def q_shuffle(spark, d):
    from threadlens.functions.common import md5_uniform

    g = A.groups(spark, d).withColumn("shuffle_key", md5_uniform("row_id", F.lit(42)))
    return SP.shuffle(g, ["row_id"]).select("row_id", "shuffle_key")


@query("concat_runs", views=("preds",), sql="""
SELECT model, context, seed, count_if(stereo = 1 AND stereo_pred = 1) AS TP FROM preds GROUP BY model, context, seed""")
def q_concat_runs(spark, d):
    p = A.preds(spark, d)
    models = sorted(r["model"] for r in p.select("model").distinct().collect())  # one row per model
    parts = [p.filter(F.col("model") == m) for m in models]
    return M.confusion(SP.concat_runs(parts), ["model", "context", "seed"]).select("model", "context", "seed", "TP")
