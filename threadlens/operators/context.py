"""Context columns and model views.

Every step is a projection over the corpus (one stage); the context order is the config's
nearest -> farthest list, unrolled statically.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.config import MISSING_CONTEXT, SAME_AS_FATHER

STEREOHOAX_SAME_RULES = [
    ("txt_father", "txt_head", "txt_head", SAME_AS_FATHER),
    ("txt_father", "rh_text", "txt_father", "igual al rh_text"),
    ("txt_head", "rh_text", "txt_head", "igual al rh_text"),
]
DETESTS_SAME_RULES = [
    ("previous_comment", "first_comment", "first_comment", SAME_AS_FATHER),
    ("previous_comment", "news_title", "previous_comment", "igual al news_title"),
    ("first_comment", "news_title", "first_comment", "igual al news_title"),
]


def mark_same_context(df: DataFrame, rules: Sequence[tuple[str, str, str, str]] = STEREOHOAX_SAME_RULES) -> DataFrame:
    """In order, where column a equals column b, replace ``target`` by the marker."""
    out = df
    for a, b, target, marker in rules:
        out = out.withColumn(target, F.when(F.col(a) == F.col(b), F.lit(marker)).otherwise(F.col(target)))
    return out


def assert_no_nulls(df: DataFrame, raise_on_violation: bool = False) -> DataFrame:
    """Nulls per column in ONE aggregation -> (column, n_null) violations table (non-zero rows).

    With ``raise_on_violation`` the (tiny) table is read and a ``ValueError`` raised when not empty,
    like the reference's assertion that dropping null rows drops none.
    """
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    long = counts.unpivot([], list(df.columns), "column", "n_null").filter(F.col("n_null") > 0)
    if raise_on_violation:
        bad = long.collect()  # one row per column at most
        if bad:
            raise ValueError("null values in: " + ", ".join(f"{r['column']} ({r['n_null']})" for r in bad))
    return long


def is_missing(c: Column) -> Column:
    return c.isin(*MISSING_CONTEXT)


def add_news(df: DataFrame, news: DataFrame, key: str = "file_id") -> DataFrame:
    """Left join the news title on ``file_id``; the news side is broadcast if its bytes allow it."""
    from threadlens.session import maybe_broadcast

    return df.join(maybe_broadcast(news), key, "left")


def annotator_columns(columns: Sequence[str], label: str, suffix: str = "_a") -> list[str]:
    """Annotator vote columns of a label: exact ``<label>_a<digits>`` names (not substring matches)."""
    import re

    pat = re.compile(rf"^{re.escape(label + suffix)}\d+$")
    return [c for c in columns if pat.match(c)]


def soft_label(df: DataFrame, labels: Sequence[str] | str, n: int = 3, suffix: str = "_a") -> DataFrame:
    """``<label>_soft`` = round4(softmax([pos, n - pos])[0]) = round4(1 / (1 + exp(n - 2 pos))).

    pos = sum of the annotator votes (null votes count 0); labels without vote columns are skipped.
    """
    labels = [labels] if isinstance(labels, str) else list(labels)
    out = df
    for label in labels:
        cols = annotator_columns(df.columns, label, suffix)
        if not cols:
            continue
        pos = sum((F.coalesce(F.col(c), F.lit(0)) for c in cols[1:]), F.coalesce(F.col(cols[0]), F.lit(0)))
        neg = F.lit(n) - pos
        out = out.withColumn(label + "_soft", F.bround(1 / (1 + F.exp((neg - pos).cast("double"))), 4))
    return out


def fill_context(df: DataFrame, text: str, contexts: Sequence[str], concat_col: str = "concat_contexts",
                 keep_flags: bool = False) -> DataFrame:
    """fill missing contexts from the next farther level and build ``concat_contexts``.

    From the second-farthest to the nearest level: blank it if equal to the text; blank it if missing;
    when it differs from the (already filled) next-farther level, prepend it to the concatenation; then
    fill blanks from the next-farther level. The farthest level is never blanked. Nulls count as "".
    Static unroll over the configured levels: one projection, no shuffle. ``keep_flags`` keeps the
    per-level missing flags (``_missing_<ctx>``) for F13.
    """
    out = df.withColumn(contexts[-1], F.coalesce(F.col(contexts[-1]), F.lit("")))
    out = out.withColumn(concat_col, F.col(contexts[-1]))
    t = F.col(text)
    n = len(contexts)
    for i, cont in enumerate(list(contexts[:-1])[::-1]):
        nxt = F.col(contexts[n - 1 - i])
        c = F.coalesce(F.col(cont), F.lit(""))
        c = F.when(c == t, F.lit("")).otherwise(c)
        missing = is_missing(c)
        c = F.when(missing, F.lit("")).otherwise(c)
        flag = "_missing_" + cont
        out = out.withColumn(flag, missing).withColumn(cont, c)
        out = out.withColumn(concat_col, F.when(F.col(cont) != nxt, strip_text(F.concat(F.col(cont), F.lit(" "), F.col(concat_col))))
                             .otherwise(F.col(concat_col)))
        out = out.withColumn(cont, F.when(F.col(flag), nxt).otherwise(F.col(cont)))
        if not keep_flags:
            out = out.drop(flag)
    return out


def strip_text(c: Column) -> Column:
    from threadlens.functions.text import strip_ws

    return strip_ws(c)


def missing_context_report(filled_with_flags: DataFrame, contexts: Sequence[str]) -> DataFrame:
    """count and % of rows missing each level (measured before that level is filled)."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for cont in contexts[:-1]:
        aggs.append(F.count_if(F.col("_missing_" + cont)).alias(cont))
    g = filled_with_flags.agg(*aggs)
    long = g.unpivot(["_n"], list(contexts[:-1]), "context", "missing")
    return long.select("context", "missing", (F.col("missing") / F.col("_n") * 100).alias("pct"))


def model_view(df: DataFrame, text: str, label: str, context: str | None = None, append: bool = False) -> DataFrame:
    """P3 (+P8): project to ``text``, ``labels`` and ``parent_text`` (or the context prepended to the text)."""
    if context and append:
        return df.select(F.concat(F.col(context), F.lit(" "), F.col(text)).alias("text"), F.col(label).alias("labels"))
    if context:
        return df.select(F.col(text).alias("text"), F.col(label).alias("labels"), F.col(context).alias("parent_text"))
    return df.select(F.col(text).alias("text"), F.col(label).alias("labels"))


def drop_missing_context(df: DataFrame, context: str) -> DataFrame:
    """Drop rows whose context is missing, then rows with any null."""
    return df.filter(~is_missing(F.col(context))).dropna()


def drop_context_equal_text(df: DataFrame, context: str, text: str) -> DataFrame:
    """P5: drop rows whose context equals the text, then rows with any null."""
    return df.filter(~(F.col(text) == F.col(context)) | F.col(context).isNull() | F.col(text).isNull()).dropna()


def refill_context_equal_text(df: DataFrame, context: str, text: str, contexts: Sequence[str]) -> DataFrame:
    """While the context equals the text take the next farther level (one ``coalesce`` projection)."""
    chain = [context, *contexts[list(contexts).index(context) + 1:]] if context in contexts else [context]
    t = F.col(text)
    picked = F.coalesce(*[F.when(~(F.col(c) == t) | t.isNull() | F.col(c).isNull(), F.col(c)) for c in chain],
                        F.col(chain[-1]))
    return df.withColumn(context, picked)


def debug_context(df: DataFrame, label: str, out: str = "debug") -> DataFrame:
    """Leak the gold label as the context text (sanity check of a context pipeline)."""
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit("con estereotipo")).otherwise(F.lit("sin estereotipo")))


def append_context(df: DataFrame, context: str, text: str) -> DataFrame:
    """Text := context + " " + text."""
    return df.withColumn(text, F.concat(F.col(context), F.lit(" "), F.col(text)))


def context_spec(spec, contexts_all: Sequence[str | None]) -> list[str | None]:
    """``"all"``, ``("all", except...)`` or an explicit tuple -> list of contexts (None = no context)."""
    if spec == "all":
        return list(contexts_all)
    if isinstance(spec, tuple) and spec and spec[0] == "all":
        return [c for c in contexts_all if c not in spec[1:]]
    return list(spec)


def stack_contexts(df: DataFrame, keys: Sequence[str], text: str, label: str, contexts: Sequence[str | None]) -> DataFrame:
    """One model-view row per item x context (contexts become rows via ``explode``, not a loop)."""
    entries = [F.struct(F.lit(c if c else "0_no_context").alias("context"),
                        (F.col(c) if c else F.lit(None).cast("string")).alias("parent_text")) for c in contexts]
    return df.select(*keys, F.col(text).alias("text"), F.col(label).alias("labels"),
                     F.explode(F.array(*entries)).alias("_c")).select(*keys, "_c.context", "text", "labels",
                                                                      "_c.parent_text")
