"""A training-corpus pipeline over the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet into the shared
folder and rereads it as the next stage's docs. All stages but the last return the columns of documents,
with their types and in their order, whatever their names; columns that a stage does not read pass through.

Every stage takes null ids, texts and sources, empty and very long texts, repeated rows and empty tables (which
stay empty). What each does with them is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.common import read_table, release, shared_table
from threadlens.llm.line_spread import cleaned_lines
from threadlens.llm.mixing import mixed
from threadlens.llm.near_dedup import drop_near_duplicates
from threadlens.llm.piece_bpe import Codec, encode_decode
from threadlens.llm.queries import MIN_SITES, piece_model
from threadlens.llm.rule_ensemble import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go.

    Null and empty texts are scored by their statistics like any other; equal texts are kept or rejected together.
    """
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites leave every text; n_chars follows the text.

    No row goes: a null text stays null, a text of such lines alone becomes empty. A null source is no site.
    """
    cleaned = cleaned_lines(docs, MIN_SITES).select("row.*")
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 or more over five words) stays.

    It is the one with the smallest id (a null id counts as the largest). Null and wordless texts resemble nothing and stay;
    rows repeated in id and text stay once.
    """
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights; documents of wanted sources repeat, up to three times.

    Texts without words have size 0 and come as often as their source comes whole; a null source is one of its own. Rows
    equal in id and text are taken or left together.
    """
    return mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, one row for each document of the mix.

    A null text counts as empty; a null id stays null.
    """
    return encode_decode(docs, Codec(piece_model()))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", tokenise),
]

#: SQL cannot express the classifier, the near-duplicate search or the tokeniser; tests check brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; empty documents or labels give an empty or unscored result, no error."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
        release(spark)
    return docs
