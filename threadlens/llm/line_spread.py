"""Boilerplate lines by the number of distinct sites that they stand on.

HyperLogLog sketches of the sites are kept per line hash and merged by aggregation. Lines whose
estimate is near the threshold get an exact distinct count. Lines on enough sites are removed from
every document. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import shared_table


def line_key(line: Column) -> list[Column]:
    """128 bits of hash for a line: two 64-bit hashes with different seeds."""
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit("line"), line).alias("k2")]


def has_text(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2, source, at, k1, k2: every line with text, by place and hash, without its text."""
    t1, t2 = F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("text"), "text").alias("t2")
    lines = docs.select("doc_id", t1, t2, "source", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.where(has_text(F.col("line"))).select("doc_id", "t1", "t2", "source", "at", *line_key(F.col("line")))


def boilerplate_lines(lines: DataFrame, min_sites: int, lg_k: int = 12, margin: float = 0.2) -> DataFrame:
    """Keys (k1, k2) of the lines of a ``line_table`` that stand on ``min_sites`` or more distinct sites.

    A sketch of 2**lg_k registers has a relative error of about 1.04 / sqrt(2**lg_k) (1.6 % at 12). Estimates
    more than ``margin`` (over ten such errors) away from the threshold decide; lines in between are
    counted exactly. Null sites do not count. Sketches are made per task before the shuffle, so a line that
    a third of all documents share is one sketch for each task.
    """
    on_sites = lines.where("source IS NOT NULL").select("k1", "k2", "source")
    sketched = on_sites.groupBy("k1", "k2").agg(F.hll_sketch_agg("source", F.lit(lg_k)).alias("sketch"))
    estimate = sketched.select("k1", "k2", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = shared_table(estimate.where(F.col("sites") >= min_sites * (1 - margin)), "line-spread")
    clear = F.col("sites") > min_sites * (1 + margin)
    exact = (on_sites.join(spread.where(~clear).select("k1", "k2"), ["k1", "k2"], "left_semi")
             .groupBy("k1", "k2").agg(F.count_distinct("source").alias("sites")).where(F.col("sites") >= min_sites))
    return shared_table(spread.where(clear).select("k1", "k2").union(exact.select("k1", "k2")), "boilerplate")


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, **options) -> DataFrame:
    """Remove the lines that stand on ``min_sites`` or more distinct sites from every document.

    docs: doc_id, text, source (the site); other columns stay. Returns the columns of ``docs`` with the lines
    taken out of text, and n_lines (lines with text) and n_removed, which replace columns of those names.
    One row for each input row: a null text stays null with zero lines, a text of boilerplate alone becomes
    empty, blank lines stay where they are, every copy of a line goes. Null sources do not count as sites.
    Null ids and repeated rows are fine; an empty table gives an empty result.

    Lines are counted by their hashes, and the places to remove come back per document (id and text hash), so no
    key gathers more than one document's lines; documents are shuffled once to meet them, with their texts. A
    line on very many documents is one hot key of the join with the boilerplate keys, which AQE splits.
    """
    out = cleaned_lines(docs, min_sites, **options)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], "n_lines", "n_removed")


def cleaned_lines(docs: DataFrame, min_sites: int = 10, **options) -> DataFrame:
    """row (the columns of ``docs``, cleaned), n_lines, n_removed: see ``remove_boilerplate``."""
    lines = shared_table(line_table(docs), "lines")
    bad = boilerplate_lines(lines, min_sites, **options)
    places = (lines.join(bad, ["k1", "k2"], "left_semi").groupBy("doc_id", "t1", "t2")
              .agg(F.collect_set("at").alias("places")).withColumnRenamed("doc_id", "of")
              .withColumnRenamed("t1", "of1").withColumnRenamed("t2", "of2"))
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"),
                        F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("text"), "text").alias("t2"))
    found = whole.join(places, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("t1") == F.col("of1")) & (F.col("t2") == F.col("of2")), "left")
    split = F.split("text", "\n")
    # the lines are bound once; the places that stay are found by hash, so the cost follows the lines of a text
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "places")
    kept = F.transform(F.array(split), lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n"))[0]
    cleaned = F.when(F.col("places").isNull(), F.col("text")).otherwise(kept)
    return found.select(
        F.col("row").withField("text", cleaned).alias("row"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(split, has_text))).cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_removed"))
