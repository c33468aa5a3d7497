"""Remaining inventory queries: sinks written and read back (S1, S2, S5-S9), P2, E4, J11, J13, O3, F17, X1."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from threadlens.config import ANALYSIS_THRESHOLD, TOPICS
from threadlens.operators import changes as C
from threadlens.operators import context as X
from threadlens.operators import evaluate as EV
from threadlens.operators import metrics as M
from threadlens.operators import seeds as S
from threadlens.operators import splits as SP
from threadlens.plans.q_changes import CTX, changes_sql
from threadlens.plans.q_evaluation import CELLS_SQL
from threadlens.plans.q_sources import RUN_SCHEMA, save_run_files, scratch
from threadlens.plans.registry import query
from threadlens.sources import adapters as A
from threadlens.sources import io as IO

RUN = ["model", "context", "seed"]
CORPUS_SCHEMA = ("comment_id long, sentence_pos int, reply_to long, file_id string, sentence string, stereotype int, "
                 "implicit int, stereotype_a1 int, stereotype_a2 int, stereotype_a3 int")


def set_file_times(spark, folder: str, when: datetime.datetime) -> None:
    """Give all files below ``folder`` one modification time."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = store.listFiles(path, True)
    while files.hasNext():
        store.setTimes(files.next().getPath(), int(when.timestamp() * 1000), -1)


@query("read_corpus", views=("corpus",), sql="SELECT * FROM corpus")
def q_read_corpus(spark, d):
    """The sentence corpus written as CSV (multi-line texts) and read back with its declared schema."""
    path = scratch(spark, "corpus") + "/corpus.csv"
    A.corpus(spark, d).write.option("header", True).option("escape", '"').csv(path)
    return IO.read_corpus(spark, path, CORPUS_SCHEMA)


@query("read_news", views=("news",), sql="SELECT file_id, lower(news_title) AS news_title FROM news")
def q_read_news(spark, d):
    """A ';'-separated news file; the tokenized title column is selected under the common name."""
    path = scratch(spark, "news")
    n = A.news(spark, d).select("file_id", "news_title", F.lower("news_title").alias("tokenized_news_title"))
    n.write.option("header", True).option("sep", ";").option("escape", '"').option("multiLine", True).csv(path)
    return IO.read_news(spark, path, tokenized=True)


@query("write_predictions", views=("preds",), sql=f"SELECT model, context, seed, {CELLS_SQL} FROM preds GROUP BY model, context, seed")
def q_write_predictions(spark, d):
    """Runs persisted partitioned by run columns, read back and scored."""
    path = scratch(spark, "preds")
    IO.write_predictions(A.preds(spark, d), path)
    back = spark.read.parquet(path)
    return M.confusion(back, RUN)


@query("write_metrics", views=("preds",), dbl=("f1_pos", "mcc"), sql=f"""
WITH c AS (SELECT model, context, seed, {CELLS_SQL} FROM preds GROUP BY model, context, seed)
SELECT model, context, seed, ROUND(CASE WHEN 2*TP+FP+FN > 0 THEN 2.0*TP/(2*TP+FP+FN) ELSE 0 END, 3) AS f1_pos,
  ROUND(CASE WHEN (TP+FP)*(TP+FN)*(TN+FP)*(TN+FN) > 0 THEN (CAST(TP AS DOUBLE)*TN - CAST(FP AS DOUBLE)*FN)
  / sqrt(CAST(TP+FP AS DOUBLE)*(TP+FN)*(TN+FP)*(TN+FN)) ELSE 0 END, 3) AS mcc FROM c""")
def q_write_metrics(spark, d):
    """Metrics rounded to 3 decimals; two halves of the runs, the second written again with a third run of the first."""
    path = scratch(spark, "metrics")
    m = M.metrics1(A.preds(spark, d), RUN).select(*RUN, "f1_pos", "mcc")
    IO.write_metrics(m.filter(F.col("seed") < 47), path, append=False)
    IO.write_metrics(m.filter(F.col("seed") >= 47), path)
    IO.write_metrics(m.filter(F.col("seed") >= 44), path)  # runs that are there are replaced
    return IO.read_metrics(spark, path)


@query("write_splits", views=("groups",), sql="""
WITH x AS (SELECT row_id, concat_ws('', CAST(l1 AS VARCHAR), CAST(l2 AS VARCHAR), CAST(l3 AS VARCHAR), CAST(l4 AS VARCHAR)) AS combo,
  CAST(('0x' || substr(md5(concat_ws('|', row_id, 42)), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM groups),
c AS (SELECT combo, count(*) AS cn FROM x GROUP BY combo),
y AS (SELECT x.row_id, x.u, CASE WHEN c.cn < 2 THEN 'rare' ELSE x.combo END AS combo FROM x JOIN c USING (combo)),
r AS (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY u, row_id) AS rk, count(*) OVER (PARTITION BY combo) AS n FROM y)
SELECT row_id, CAST(CASE WHEN rk <= round_even(CAST(n AS DOUBLE) * 0.2, 0) THEN 1 ELSE 0 END AS INT) AS split FROM r""")
def q_write_splits(spark, d):
    """A split written as one folder per split value and read back (split from the folder name)."""
    path = scratch(spark, "splits")
    s = SP.stratified_split(A.groups(spark, d), ["row_id"], ["l1", "l2", "l3", "l4"], 0.2).select("row_id", "split")
    IO.write_splits(s, path)
    return spark.read.parquet(path).select("row_id", F.col("split").cast("int").alias("split"))


@query("write_analysis", views=("preds",), sql=f"""
WITH {changes_sql()},
long AS (UNPIVOT (SELECT model, stereo, {", ".join(f'"{c}"' for c in CTX)} FROM changes) ON {", ".join(f'"{c}"' for c in CTX)} INTO NAME context VALUE change)
SELECT model, CASE WHEN stereo = 1 THEN 'positivos' ELSE 'negativos' END AS polarity, context, change, count(*) AS n_items
FROM long WHERE change <> '' GROUP BY ALL""")
def q_write_analysis(spark, d):
    """Change rows of all contexts written per model and class, read back and counted by context and change."""
    path = scratch(spark, "analysis")
    avg = S.seed_average_hard(A.preds(spark, d), ["doc_id"])
    ch = C.context_changes(avg, ["doc_id"], CTX, ANALYSIS_THRESHOLD)
    ch = ch.withColumn("polarity", F.when(F.col("stereo") == 1, "positivos").otherwise("negativos"))
    IO.write_analysis(ch, path)
    back = spark.read.parquet(path).unpivot(["model", "polarity"], CTX, "context", "change").where("change <> ''")
    return back.groupBy("model", "polarity", "context", "change").agg(F.count(F.lit(1)).alias("n_items"))


@query("incremental_files", views=("preds",), sql=f"""
SELECT 'stereohoax' AS data, model, context, seed, {CELLS_SQL} FROM preds WHERE seed >= 47 GROUP BY model, context, seed""")
def q_incremental_files(spark, d):
    """Two batches of run files, a year apart by their file times; only those modified after the first are read."""
    root = scratch(spark, "incremental")
    p = A.preds(spark, d)
    for part, rows, year in (("a", F.col("seed") < 47, 2020), ("b", F.col("seed") >= 47, 2021)):
        save_run_files(p.filter(rows), f"{root}/{part}")
        set_file_times(spark, f"{root}/{part}", datetime.datetime(year, 1, 1, tzinfo=datetime.UTC))
    runs = IO.incremental_files(spark, [root], RUN_SCHEMA, "2020-07-01T00:00:00")
    return M.confusion(runs, ["data", *RUN])


@query("assert_no_nulls", views=("tweets",), sql="""
WITH c AS (SELECT count_if(txt_father IS NULL) AS txt_father, count_if(txt_head IS NULL) AS txt_head,
  count_if(in_reply_to_tweet_id IS NULL) AS in_reply_to_tweet_id, count_if(text IS NULL) AS text FROM tweets)
SELECT * FROM (UNPIVOT c ON txt_father, txt_head, in_reply_to_tweet_id, text INTO NAME "column" VALUE n_null) WHERE n_null > 0""")
def q_assert_no_nulls(spark, d):
    t = A.tweets(spark, d).select("txt_father", "txt_head", "in_reply_to_tweet_id", "text")
    return X.assert_no_nulls(t)


_CATS = TOPICS  # stand-in for the implicitness categories: every 0/1 topic that the items have


@query("accuracy_by_implicit_category", views=("preds", "topic_preds"), dbl=("accuracy_without", "accuracy_with"), sql=f"""
WITH j AS (SELECT p.model, p.context, p.seed, p.stereo, p.stereo_pred, {", ".join(f"t.{c}" for c in _CATS)}
  FROM preds p LEFT JOIN topic_preds t ON t.tweet_id = p.doc_id),
long AS (UNPIVOT j ON {", ".join(_CATS)} INTO NAME category VALUE value)
SELECT model, context, seed, category,
  coalesce(avg(CASE WHEN stereo = 1 AND value < 0.5 THEN CAST(stereo_pred = stereo AS DOUBLE) END), 0) AS accuracy_without,
  coalesce(avg(CASE WHEN stereo = 1 AND value >= 0.5 THEN CAST(stereo_pred = stereo AS DOUBLE) END), 0) AS accuracy_with
FROM long GROUP BY model, context, seed, category""")
def q_accuracy_by_implicit_category(spark, d):
    cats = A.topic_preds(spark, d).select(F.col("tweet_id").alias("doc_id"), *_CATS)
    j = A.preds(spark, d).join(cats, "doc_id", "left")
    return M.accuracy_by_category(j, RUN, _CATS)


@query("rejoin_gold_after_avg", views=("preds",), dbl=("stereo_pred",), sql="""
SELECT doc_id, model, context, arg_max(stereo, seed) AS stereo, avg(stereo_pred) AS stereo_pred FROM preds GROUP BY ALL""")
def q_rejoin_gold_after_avg(spark, d):
    """The gold label carried through the seed aggregation (no join back)."""
    return S.seed_average_hard(A.preds(spark, d), ["doc_id"]).select("doc_id", "model", "context", "stereo", "stereo_pred")


@query("attach_annotations", views=("tweets", "gold"), dbl=("stereo_soft",), sql="""
WITH ann AS (SELECT doc_id AS tweet_id, quality AS stereo_a1, stereo AS stereo_a2, CAST(quality * stereo AS INT) AS stereo_a3 FROM gold),
j AS (SELECT t.tweet_id, coalesce(a.stereo_a1, 0) AS stereo_a1, coalesce(a.stereo_a2, 0) AS stereo_a2, coalesce(a.stereo_a3, 0) AS stereo_a3
  FROM tweets t LEFT JOIN ann a USING (tweet_id))
SELECT *, round_even(1 / (1 + exp(CAST(3 - 2 * (stereo_a1 + stereo_a2 + stereo_a3) AS DOUBLE))), 4) AS stereo_soft FROM j""")
def q_attach_annotations(spark, d):
    """J13 (+F11): annotator votes joined by key (missing -> 0), then soft labels."""
    g = A.gold(spark, d)
    ann = g.select(F.col("doc_id").alias("tweet_id"), F.col("quality").alias("stereo_a1"), F.col("stereo").alias("stereo_a2"),
                   (F.col("quality") * F.col("stereo")).cast("int").alias("stereo_a3"))
    t = EV.enrich_test(A.tweets(spark, d).select("tweet_id"), [ann], ["tweet_id"])
    return X.soft_label(t, "stereo")


@query("sort_by_key", views=("groups",), sql="SELECT row_id, group_id FROM groups")
def q_sort_by_key(spark, d):
    """O3: rows sorted on their key columns."""
    return SP.sort_by(A.groups(spark, d).select("row_id", "group_id"), ["group_id", "row_id"])


@query("pct_change_label", views=("preds",), sql="""
WITH c AS (SELECT model, context, seed, count_if(stereo = 1 AND stereo_pred = 1) AS tp, count_if(stereo = 1) AS pos
  FROM preds GROUP BY model, context, seed)
SELECT model, context, seed, CASE WHEN tp > 0 THEN '(' || CAST(CAST(round_even(CAST(tp AS DOUBLE) / nullif(pos, 0) * 100, 0) AS BIGINT) AS VARCHAR)
  || '% ↑)' ELSE '' END AS label FROM c""")
def q_pct_change_label(spark, d):
    """F17 on per-run counts: share of the positive bucket as "(n% arrow)"."""
    c = A.preds(spark, d).groupBy(*RUN).agg(F.count_if((F.col("stereo") == 1) & (F.col("stereo_pred") == 1)).alias("tp"),
                                            F.count_if(F.col("stereo") == 1).alias("pos"))
    return c.select(*RUN, C.pct_change_label(F.col("tp"), F.col("pos"), F.lit("↑")).alias("label"))


@query("metrics_by", views=("preds",), dbl=("mean_conf", "pos_rate"), sql="""
SELECT model, context, avg(softmax_confidence) AS mean_conf, avg(stereo_pred) AS pos_rate, count(*) AS n FROM preds GROUP BY model, context""")
def q_metrics_by(spark, d):
    """Caller-supplied aggregate Columns evaluated for every group in one pass."""
    exprs = [F.avg("softmax_confidence").alias("mean_conf"), F.avg("stereo_pred").alias("pos_rate"), F.count(F.lit(1)).alias("n")]
    return M.metrics_by(A.preds(spark, d), ["model", "context"], exprs)
