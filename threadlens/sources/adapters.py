"""Adapter views over the driver's parquet tables.

They give the operators inputs shaped like the reference corpora and run files (see FIXTURES.md §2),
derived by Spark from the whole tables (no id subsets, whole texts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.config import TOPICS

# Run grid of the `preds` fixture: (model id, model), (context id, context), seeds 42..51.
PRED_MODELS = [(0, "beto"), (1, "roberta_bne"), (2, "mbert")]
PRED_CONTEXTS = [(0, "0_no_context"), (2, "2_txt_father"), (3, "3_txt_head"), (4, "4_rh_text"), (5, "5_concat_contexts")]
PRED_SEEDS = list(range(42, 52))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, spread over the cores when its scan has fewer splits than cores."""
    from threadlens.session import spread

    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _as_str(c: Column) -> Column:
    return c.cast("string")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence thread table (DETESTS-shaped): one row per (comment_id, sentence_pos)."""
    c = table(spark, sf_dir, "conversations")
    cid, turn = F.col("conv_id"), F.col("turn")
    h = cid * 13 + turn * 7
    return c.select(
        cid.alias("comment_id"),
        (turn + 1).cast("int").alias("sentence_pos"),
        F.when(cid % 17 == 5, cid + 1000000).when(cid % 5 == 0, cid).otherwise(cid - 1).alias("reply_to"),
        F.concat(F.lit("news"), _as_str(cid % 45)).alias("file_id"),
        F.col("text").alias("sentence"),
        (h % 10 < 3).cast("int").alias("stereotype"),
        ((cid + turn) % 2).cast("int").alias("implicit"),
        ((h + 1) % 10 < 3).cast("int").alias("stereotype_a1"),
        (h % 10 < 4).cast("int").alias("stereotype_a2"),
        (h % 10 < 2).cast("int").alias("stereotype_a3"),
    )


def thread_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw thread export (upper-case columns, `<comment>_<pos>` ids, padded file ids)."""
    c = table(spark, sf_dir, "conversations")
    cid, turn = F.col("conv_id"), F.col("turn")
    parent = F.when(cid % 17 == 5, cid + 1000000).when(cid % 5 == 0, cid).otherwise(cid - 1)
    return c.select(
        F.concat(F.lit(" f"), _as_str(cid % 45), F.lit(" ")).alias("FILE_ID"),
        F.col("role").alias("USER_ID"),
        F.concat(_as_str(cid), F.lit("_"), _as_str(turn + 1)).alias("COMMENT_ID"),
        F.concat(_as_str(parent), F.lit("R")).alias("THREAD"),
        F.col("text").alias("COMMENT"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News dimension: one title per file id."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.concat(F.lit("news"), _as_str(F.col("item_id"))).alias("file_id"), F.col("text").alias("news_title"))


def _tweet_labels(d: Column) -> list[Column]:
    """Tweet labels: functions of the document id only."""
    topic_mod = {t: (7 + 2 * i, 9 + i) for i, t in enumerate(TOPICS)}
    return [
        (d % 3 == 0).cast("int").alias("stereo"),
        ((d * 3) % 5 < 2).cast("int").alias("implicit"),
        (d % 4 == 1).cast("int").alias("contextual"),
        *[((d % 3 == 0) & ((d * mult) % mod < 3)).cast("int").alias(t) for t, (mult, mod) in topic_mod.items()],
    ]


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tweet table (StereoHoax-shaped) keyed by tweet_id, with father / head / hoax contexts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    parent = docs.select(F.col("doc_id").alias("p_id"), F.col("text").alias("p_text"))
    head = docs.select(F.col("doc_id").alias("h_id"), F.col("text").alias("h_text"))
    d = F.col("doc_id")
    joined = docs.join(parent, d - 1 == F.col("p_id"), "left").join(head, d - d % 6 == F.col("h_id"), "left")
    return joined.select(
        d.alias("tweet_id"),
        (d - d % 6).alias("conversation_id"),
        F.when(d % 6 == 0, F.lit(None).cast("long")).otherwise(d - 1).alias("in_reply_to_tweet_id"),
        F.col("source").alias("rh_id"),
        F.col("text"),
        F.when(d % 6 == 0, F.lit("")).when(d % 11 == 0, F.lit("[]")).when(d % 13 == 0, F.col("text"))
        .otherwise(F.col("p_text")).alias("txt_father"),
        F.when(d % 6 == 0, F.lit("0")).otherwise(F.col("h_text")).alias("txt_head"),
        F.concat(F.lit("hoax "), F.col("source")).alias("rh_text"),
        *_tweet_labels(d),
    )


def tweet_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tweet_id, stereo, text and txt_father: the rows of ``tweets``, computed once and stored, with each text moved once.

    Texts of parents that no tweet shows stay behind. Heads give no column here but repeat a tweet as often as their id
    comes, so only ids that come more than once are joined.
    """
    from threadlens.llm.common import release
    from threadlens.session import materialize_small, write_shared

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d, reply = F.col("doc_id"), F.col("doc_id") + 1
    parent = docs.select(d.alias("p_id"), F.when((reply % 6 != 0) & (reply % 11 != 0) & (reply % 13 != 0), F.col("text")).alias("p_text"))
    heads = docs.where(d % 6 == 0).groupBy(d.alias("h_id")).count().where("count > 1")
    joined = docs.join(parent, d - 1 == F.col("p_id"), "left").join(materialize_small(heads), d - d % 6 == F.col("h_id"), "left")
    father = F.when(d % 6 == 0, F.lit("")).when(d % 11 == 0, F.lit("[]")).when(d % 13 == 0, F.col("text")).otherwise(F.col("p_text"))
    stereo = _tweet_labels(d)[0]
    times = F.when(F.col("count").isNull(), F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.col("count").cast("int")))
    pairs = write_shared(joined.select(d.alias("tweet_id"), stereo, "text", father.alias("txt_father"), F.explode(times).alias("_t")).drop("_t"), "tweet-pairs")
    release(spark)
    return pairs


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prediction runs in one long table: item x model x context x seed.

    The run grid (3 models x 5 contexts x 10 seeds) is generated per label row with
    ``explode(sequence(0, 149))`` (a Generate, no join); the item side is the whole ``labels`` table.
    """
    lab = table(spark, sf_dir, "labels")
    n_ctx, n_seed = len(PRED_CONTEXTS), len(PRED_SEEDS)
    # run r in 0..149 -> (model r / 50, context (r / 10) % 5, seed 42 + r % 10): a few expressions, not 150 literals
    r = F.col("_r")
    runs = lab.select("doc_id", "toxic", F.explode(F.sequence(F.lit(0), F.lit(len(PRED_MODELS) * n_ctx * n_seed - 1))).alias("_r"))
    m_idx, c_idx = (r / (n_ctx * n_seed)).cast("int"), ((r / n_seed).cast("int") % n_ctx)
    runs = runs.select(
        "doc_id", "toxic",
        F.element_at(F.array(*[F.lit(mid) for mid, _ in PRED_MODELS]), m_idx + 1).alias("mid"),
        F.element_at(F.array(*[F.lit(name) for _, name in PRED_MODELS]), m_idx + 1).alias("model"),
        F.element_at(F.array(*[F.lit(kid) for kid, _ in PRED_CONTEXTS]), c_idx + 1).alias("kid"),
        F.element_at(F.array(*[F.lit(name) for _, name in PRED_CONTEXTS]), c_idx + 1).alias("context"),
        (F.lit(PRED_SEEDS[0]) + r % n_seed).alias("seed"),
    )
    d, tox, s, m, k = F.col("doc_id"), F.col("toxic"), F.col("seed"), F.col("mid"), F.col("kid")
    flip_rate = (F.when((d * 37 + k * 53 + m * 11) % 100 < 20, 85)
                 .when((d * 37 + k * 53 + m * 11) % 100 < 50, 30).otherwise(5))
    pred = F.when((d * 7919 + s * 104729 + m * 31337 + k * 1299709) % 100 < flip_rate, 1 - tox).otherwise(tox)
    soft = (F.when(tox == 1, F.when(d % 2 == 0, F.lit(0.9526)).otherwise(F.lit(0.7311)))
            .otherwise(F.when(d % 2 == 0, F.lit(0.0474)).otherwise(F.lit(0.2689))))
    return runs.select(
        "doc_id", "model", "context", F.col("seed").cast("int").alias("seed"),
        tox.alias("stereo"),
        ((d * 3) % 5 < 2).cast("int").alias("implicit"),
        (d % 3 == 0).cast("int").alias("contextual"),
        pred.alias("stereo_pred"),
        ((50 + (d * 31 + s * 17 + m * 7 + k * 13) % 50).cast("double") / 100).alias("softmax_confidence"),
        soft.cast("double").alias("stereo_soft"),
        (((d * 29 + s * 19 + m * 5 + k * 3) % 101).cast("double") / 100).alias("stereo_pred_soft"),
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item-level test attributes of the `preds` items (one row per doc_id)."""
    lab = table(spark, sf_dir, "labels")
    d = F.col("doc_id")
    return lab.select(
        d, F.col("toxic").alias("stereo"),
        ((d * 3) % 5 < 2).cast("int").alias("implicit"),
        (d % 3 == 0).cast("int").alias("contextual"),
        F.when(F.col("toxic") == 1, F.when(d % 2 == 0, F.lit(0.9526)).otherwise(F.lit(0.7311)))
        .otherwise(F.when(d % 2 == 0, F.lit(0.0474)).otherwise(F.lit(0.2689))).alias("stereo_soft"),
        F.col("quality"),
    )


def topic_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task-3 table: gold stereo + topics and predictions, derived from `tweets`."""
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tweet_id"), *_tweet_labels(F.col("doc_id")))
    tid = F.col("tweet_id")
    cols = [tid, F.col("stereo"), F.col("implicit"), F.col("contextual"),
            ((F.col("stereo") + (tid % 7 == 0).cast("int")) % 2).cast("int").alias("stereo_pred")]
    for i, topic in enumerate(TOPICS):
        flip = (tid % (5 + i) == 1).cast("int")
        cols += [F.col(topic), ((F.col(topic) + flip) % 2).cast("int").alias(topic + "_pred")]
    return t.select(*cols)


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a group id and 4 binary labels for group-disjoint splits."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("row_id"), F.col("c_nationkey").alias("group_id"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("l1"),
        (F.col("c_mktsegment") == "MACHINERY").cast("int").alias("l2"),
        (F.col("c_acctbal") < 0).cast("int").alias("l3"),
        (F.col("c_acctbal") > 5000).cast("int").alias("l4"),
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-class logits per item with a 0/1 label."""
    e = table(spark, sf_dir, "embeddings")
    lab = F.col("label")
    return e.select(
        "vec_id", (lab % 2).cast("int").alias("label"),
        (F.col("embedding")[0].cast("double") * 10 + (lab % 2 == 0).cast("int")).alias("z0"),
        (F.col("embedding")[1].cast("double") * 10 + (lab % 2 == 1).cast("int")).alias("z1"),
    )


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with user names, urls, numbers, laughter and hashtags appended."""
    docs = table(spark, sf_dir, "documents")
    i = _as_str(F.col("doc_id"))
    return docs.select(
        "doc_id",
        F.concat(F.col("text"), F.lit(" @ana_"), i, F.lit(" http://x.y/"), i, F.lit(" "), i, F.lit(".5km abc"), i,
                 F.lit(" ajajajaj jejeje ahahah texttd holaaaa :) ¿qué? #MiHashTag #2023")).alias("text"),
    )


def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct run file names of the `preds` runs, in the reference naming scheme."""
    p = preds(spark, sf_dir).select("model", "context", "seed").distinct()
    return p.select(F.concat(F.lit("stereohoax-"), F.col("model"), F.lit("-"), F.col("context"), F.lit("_hard_s"),
                             _as_str(F.col("seed")), F.lit("_max_tokens_512-task1.csv")).alias("file_name"))
