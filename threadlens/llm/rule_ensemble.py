"""Quality classifier: a sparse ensemble of rules.

A random forest over text statistics supplies rules: every path from a root to a node is a conjunction of
comparisons. A logistic regression with a lasso penalty weighs them and drops most. What is left is
compiled into one Spark column expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import shared_table, ship
from threadlens.llm.compression import repeated_words

STATISTICS = ("log_bytes", "log_words", "word_length", "longest_word", "upper", "digit", "symbol", "stop_mark",
              "exclaim", "space", "newline", "wide", "distinct_words", "top_word", "dup_lines", "repeat_words")

#: Byte classes of the shares.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#$%&*<>|@^~=_\\{}[]", "stop_mark": b".,;:",
    "exclaim": b"!?", "space": b" ", "newline": b"\n", "wide": bytes(range(128, 256)),
}


def _class_matrix() -> np.ndarray:
    m = np.zeros((256, len(CLASSES)))
    for j, members in enumerate(CLASSES.values()):
        m[list(members), j] = 1
    return m


def statistics(raw: bytes, classes: np.ndarray) -> tuple[float, ...]:
    """The statistics of one text, all zero for an empty one."""
    words = raw.split()
    if not words:
        return (float(np.log1p(len(raw))),) + (0.0,) * (len(STATISTICS) - 1)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ classes / len(raw)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    n = len(words)
    return (float(np.log1p(len(raw))), float(np.log1p(n)), len(b"".join(words)) / n, float(max(map(len, words))),
            *shares.tolist(), len(counts) / n, max(counts.values()) / n, 1 - len(set(lines)) / len(lines),
            repeated_words(words) / n)


def statistics_of(text: Column) -> Column:
    """A struct of the statistics of a whole text, computed in Arrow batches; null counts as empty."""
    kind = pa.struct([(name, pa.float64()) for name in STATISTICS])

    @F.arrow_udf(", ".join(f"{name} double" for name in STATISTICS))
    def measure(raw: pa.Array) -> pa.Array:
        classes = _class_matrix()
        table = np.array([statistics(x.as_py(), classes) for x in raw]).reshape(len(raw), len(STATISTICS))
        return pa.StructArray.from_arrays([pa.array(table[:, j]) for j in range(len(STATISTICS))], fields=list(kind))

    return measure(F.coalesce(text, F.lit("")).cast("binary"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, at most or above, threshold)."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, at_most, limit in self.terms:
            out &= F.col(name) <= limit if at_most else F.col(name) > limit
        return out


def simplified(terms: list[tuple[str, bool, float]]) -> Rule:
    """Several bounds on one side of a statistic become the tightest."""
    tight: dict[tuple[str, bool], float] = {}
    for name, at_most, limit in terms:
        old = tight.get((name, at_most))
        tight[name, at_most] = limit if old is None else min(old, limit) if at_most else max(old, limit)
    return Rule(tuple(sorted((n, a, v) for (n, a), v in tight.items())))


#: A split as Spark prints it in a tree's debug string.
SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (-?[0-9.E+-]+)\)$")


def tree_rules(debug_string: str, names: tuple[str, ...]) -> set[Rule]:
    """The rules of a forest: one for each path from a root to any node below it."""
    rules: set[Rule] = set()
    path: list[tuple[int, tuple[str, bool, float]]] = []
    for line in debug_string.splitlines():
        if re.match(r"^ *Tree \d+", line):
            path = []
        elif m := SPLIT.match(line):
            depth = len(m[1])
            path = [p for p in path if p[0] < depth]
            path.append((depth, (names[int(m[3])], m[4] == "<=", float(m[5]))))
            rules.add(simplified([t for _, t in path]))
    return rules


@dataclass(frozen=True)
class RuleModel:
    """Intercept and weighted rules; ``score`` is the probability as a column expression."""

    intercept: float
    weighted: tuple[tuple[float, Rule], ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for weight, rule in self.weighted:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def fit_rules(train: DataFrame, trees: int = 16, depth: int = 3, lasso: float = 0.002, seed: int = 7) -> RuleModel:
    """Fit on ``train``: label (0/1) and the statistics. Small by contract (see ``learn``).

    With no rows, or one class only, there is nothing to tell apart: the model is the smoothed base rate.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    n, positive = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < positive < n:
        rate = (positive + 1) / (n + 2)
        return RuleModel(float(np.log(rate / (1 - rate))), ())
    assembled = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(train)
    weight = F.when(F.col("label") == 1, n / (2 * positive)).otherwise(n / (2 * (n - positive)))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=5, subsamplingRate=0.5, seed=seed,
                                    weightCol="weight").fit(assembled.withColumn("weight", weight))
    rules = sorted(tree_rules(forest.toDebugString, STATISTICS), key=lambda r: r.terms)
    if not rules:
        rate = (positive + 1) / (n + 2)
        return RuleModel(float(np.log(rate / (1 - rate))), ())
    applied = train.select("label", *[r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    applied = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(applied)
    fitted = LogisticRegression(regParam=lasso, elasticNetParam=1.0, standardization=False, maxIter=60).fit(
        applied.select("label", "features"))
    kept = [(float(w), r) for w, r in zip(fitted.coefficients.toArray(), rules) if abs(w) > 1e-9]
    return RuleModel(float(fitted.intercept), tuple(kept))


def held_out() -> Column:
    """Rows that are never learned from: crc32 of the id's text leaves 2 in four."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, **options) -> RuleModel:
    """Learn from the labelled rows of ``docs`` outside the held-out fold.

    ``max_train`` bounds the rows to learn from (those with the smallest hash of their id), so that learning
    does not grow with the corpus; the rules then score every row.
    """
    ship(docs.sparkSession)
    order = F.xxhash64("doc_id", F.lit("train"))
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    marked = marked.select(F.col("doc_id"), F.col("quality").cast("int").alias("label")).orderBy(order, "label").limit(max_train)
    # at most max_train ids and labels: bounded, so a broadcast is safe
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    train = rows.select("doc_id", "label", statistics_of(F.col("text")).alias("s")).select("doc_id", "label", "s.*")
    train = train.orderBy(order, "label", *STATISTICS).limit(max_train)
    # one partition: at most max_train short rows, for which more tasks would only cost more stages a step
    return fit_rules(shared_table(train.coalesce(1), "train"), **options)


def scored(docs: DataFrame, model: RuleModel) -> DataFrame:
    """(row, doc_id, score): every row of ``docs`` packed into ``row``, with its score."""
    ship(docs.sparkSession)
    packed = docs.select("doc_id", F.struct(*docs.columns).alias("row"), statistics_of(F.col("text")).alias("s"))
    return packed.select("row", "doc_id", "s.*").select("row", "doc_id", model.score().alias("score"))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text; others are ignored).

    Returns doc_id, held_out, score, predicted: one row for each input row. Null texts count as empty and are
    scored by their (zero) statistics. Null ids are scored and never learned from. Without usable labels the
    score is the smoothed base rate. Rows are scored alone, by one column expression; an empty table gives an
    empty result.
    """
    docs = docs.select("doc_id", "text")
    out = scored(docs, learn(docs, labels, **options))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns. Edge cases as in quality_scores."""
    return scored(docs, learn(docs, labels, **options)).where(F.col("score") >= threshold).select("row.*")
