"""Baselines and classifiers (M6, M8-M11): every run's predictions land in one long table."""

from __future__ import annotations

import inspect
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.common import md5_uniform
from threadlens.session import write_shared


def constant_baseline(test: DataFrame, key: Sequence[str], target: str, value: int, name: str) -> DataFrame:
    """M8: predict ``value`` for every item."""
    return test.select(F.lit(name).alias("run"), *key, target, F.lit(value).cast("int").alias(target + "_pred"))


def weighted_random_baseline(train: DataFrame, test: DataFrame, key: Sequence[str], target: str, seed: int = 42,
                             name: str = "random_classifier") -> DataFrame:
    """M9: draw each prediction from the training class shares with an md5-uniform of (key, seed).

    Class shares are a tiny aggregate (one row per class) collected once; the draw is a CASE over
    the cumulative bounds (classes in ascending order, like ``np.random.choice`` on sorted values).
    """
    shares = train.groupBy(target).count().orderBy(target).collect()
    total = float(sum(r["count"] for r in shares))
    u = md5_uniform(*key, F.lit(seed))
    expr, cum = None, 0.0
    for r in shares[:-1]:
        cum += r["count"] / total
        expr = (F.when(u < cum, F.lit(r[target])) if expr is None else expr.when(u < cum, F.lit(r[target])))
    last = F.lit(shares[-1][target])
    pred = expr.otherwise(last) if expr is not None else last
    return test.select(F.lit(name).alias("run"), *key, target, pred.cast("int").alias(target + "_pred"))


def linear_svc(train: DataFrame, test: DataFrame, features: str, target: str, C: float = 1.0, tol: float = 1e-3,
               max_rounds: int = 100) -> DataFrame:
    """M6: linear SVM (hinge loss, penalty C) fitted until its duality gap is at most ``tol``; predictions on ``test``.

    Every row also has the fit's ``svc_objective`` and ``svc_gap``, so what it is worth stays with the predictions.
    """
    from threadlens.operators.svm import fit_linear, with_margin

    fit = fit_linear(train, features, target, C, tol, max_rounds)
    return (with_margin(test, features, fit, "_margin").withColumn(target + "_pred", (F.col("_margin") > 0).cast("int")).drop("_margin")
            .withColumn("svc_objective", F.lit(fit.objective)).withColumn("svc_gap", F.lit(fit.gap)))


def baseline_suite(train: DataFrame, test: DataFrame, key: Sequence[str], text: str, target: str,
                   models: Sequence[str] = ("zeros", "ones", "random", "tfidf")) -> DataFrame:
    """The chosen baselines' predictions as one long (run, key, target, pred) table."""
    from threadlens.operators.features import tfidf_vectors

    parts = []
    if "zeros" in models:
        parts.append(constant_baseline(test, key, target, 0, "all_zeros"))
    if "ones" in models:
        parts.append(constant_baseline(test, key, target, 1, "all_ones"))
    if "random" in models:
        parts.append(weighted_random_baseline(train, test, key, target))
    if "tfidf" in models:
        for n in (1, 3):
            tr, te = tfidf_vectors(train, test, text, ngrams=n)
            pred = linear_svc(tr, te, "features", target)
            parts.append(pred.select(F.lit(f"tfidf+svc_{n}_gram").alias("run"), *key, target, target + "_pred"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def batch_score(df: DataFrame, make_predict_fn: Callable, text_cols: Sequence[str], n_classes: int = 2,
                batch_size: int = 64, out: str = "logits", dtype: str = "float") -> DataFrame:
    """Batched inference of a caller-supplied model over text (or text pairs).

    ``make_predict_fn`` loads the model once per Python worker and returns a function from numpy
    batches (one array per input column) to an (n, n_classes) logit array; Arrow batches of
    ``batch_size`` rows go through ``predict_batch_udf``.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    kind = T.DoubleType() if dtype == "double" else T.FloatType()
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(kind), batch_size=batch_size, input_tensor_shapes=None)
    return df.withColumn(out, udf(*[F.col(c) for c in text_cols]))


def letter_model() -> Callable:
    """A tiny model for M11 whose logits anyone can recompute: counts of the letter a, and of characters, mod 64."""
    import numpy as np

    def predict(texts):
        return np.array([((t or "").count("a") % 64 / 8, len(t or "") % 64 / 8) for t in texts], np.float32).reshape(-1, 2)

    return predict


BAG_WORD = "[A-Za-z]+"


def fit_bag_of_words(train: DataFrame, fields: Sequence[str], target: str, max_words: int = 5000) -> DataFrame:
    """Weights of a linear bag-of-words model over several text fields: (field, word, w0, w1), to 4 decimals.

    w_k is the log share of a word among the class's words of that field, plus one, over the field's ``max_words`` most frequent words
    (ties by word); the row with an empty field holds the log class shares. Rows without a 0/1 label are left out.
    """
    rows = train.where(F.col(target).isin(0, 1))
    log = lambda a, b: F.round(F.log(a.cast("double") / b) + 1e-10, 4)
    n = [F.count_if(F.col(target) == k) for k in (0, 1)]
    total = rows.agg(*[c.alias(f"n{k}") for k, c in enumerate(n)])
    out = total.select(F.lit("").alias("field"), F.lit("").alias("word"), *[log(F.col(f"n{k}") + 1, F.col("n0") + F.col("n1") + 2).alias(f"w{k}") for k in (0, 1)])
    for field in fields:
        words = rows.select(target, F.explode(F.regexp_extract_all(field, F.lit(BAG_WORD), F.lit(0))).alias("word")).withColumn("word", F.lower("word"))
        counts = words.groupBy("word").agg(*[c.alias(f"n{k}") for k, c in enumerate(n)])
        top = write_shared(counts.orderBy((F.col("n0") + F.col("n1")).desc(), "word").limit(max_words), "top-words")  # read for its sums and for its rows
        size = top.agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.count("*").alias("v")).first()  # three numbers
        share = [log(F.col(f"n{k}") + 1, F.lit((size[f"t{k}"] or 0) + size["v"])).alias(f"w{k}") for k in (0, 1)]
        out = out.unionByName(top.select(F.lit(field).alias("field"), "word", *share))
    return out


def publish_model(weights: DataFrame, folder: str) -> str:
    """Write the weights (bounded by ``max_words`` a field) as one JSON file into ``folder`` and give it to all executors; returns its name."""
    spark, name = weights.sparkSession, f"bag-of-words-{uuid.uuid4().hex}.json"
    table: dict[str, dict[str, list[float]]] = {}
    for r in weights.collect():
        table.setdefault(r["field"], {})[r["word"]] = [r["w0"], r["w1"]]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    stream.write(json.dumps(table).encode())
    stream.close()
    spark.sparkContext.addFile(path.toString())
    return name


def bag_of_words_model(name: str, fields: Sequence[str]) -> Callable:
    """``make_predict_fn`` of a published model: logits of (text, context, ...) batches, one array for each of ``fields``.

    The file is read once per Python worker. Null texts have no words; unknown words weigh nothing.
    """

    def load() -> Callable:
        import re

        import numpy as np
        from pyspark import SparkFiles

        with open(SparkFiles.get(name)) as f:
            table = json.load(f)
        bias, words = table[""][""], re.compile(BAG_WORD)

        def predict(*texts):
            out = np.tile(np.array(bias, np.float64), (len(texts[0]), 1))
            for field, column in zip(fields, texts):
                weights = table.get(field, {})
                for i, text in enumerate(column):
                    for word in words.findall(text or ""):
                        if (w := weights.get(word.lower())) is not None:
                            out[i] += w
            return out

        # one parameter for each field, as predict_batch_udf counts them
        kind = inspect.Parameter.POSITIONAL_OR_KEYWORD
        predict.__signature__ = inspect.Signature([inspect.Parameter(f"field{i}", kind) for i in range(len(fields))])
        return predict

    return load
