"""Text cleaning as column expressions.

Python regexes are Unicode-aware, Java's are not by default: every class is spelled with explicit
Unicode properties (the sets Java's ``(?U)`` flag would use, at a fraction of its matching cost).
Everything runs as ``regexp_replace`` / ``translate`` / higher-order array functions inside one
projection (whole-stage codegen, no Python per row).
"""

from __future__ import annotations

import string
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values (must equal the reference cleaning): classes, tokens, patterns ------------------
LETTERS = "A-Za-zÑñÇçÀàÁáÈèÉéÍíÏïÒòÓóÚúÜü"  # letter class used when splitting letters from digits
PUNCTUATION = string.punctuation.replace("@", "") + "¿?¡…"  # mapped to spaces (everything but "@")
HASHTAG_TOKEN = "hashtag"
EMOJI_WRAPPER = "emoji"
KEEP_AS_IS = ("URL", "NUM", "jaja")  # mask tokens that are their own lemma
# Java's (?U) classes spelled as explicit Unicode property classes (same sets, much cheaper than the
# UNICODE_CHARACTER_CLASS flag): \w, \s (White_Space) and \d.
WORD = r"[\p{IsAlphabetic}\p{Mn}\p{Me}\p{Mc}\p{Nd}\p{Pc}\x{200C}\x{200D}]"
WS = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = "[^" + WS[1:]
DIGIT = r"\p{Nd}"
_MARK = ""  # private-use marker, never in cleaned text
# Masking steps, in order (pattern, replacement or token name) -- fixed values of the cleaning. They stand in groups behind a
# test that is cheap and true wherever one of the group matches: (text it must hold or pattern it must match, steps).
MASK_GROUPS = [
    (("@",), None, [(f"@{WORD}{{2,}}", "user")]),
    (("ttp",), None, [(f"http{NOT_WS}+", "url")]),
    ((), DIGIT, [(f"([{LETTERS}])({DIGIT}+)", "$1 $2"),
                 (f"({DIGIT}+)([{LETTERS}€])", "$1 $2"),
                 (f"({DIGIT}+\\.)?{DIGIT}+(,{DIGIT}+)?", "num")]),
    (("ja",), "ja+j", [(f"a?j+a+j{WORD}+", "laughter")]),
    (("ha",), "ha+h", [(f"a?h+a+h{WORD}+", "laughter")]),
    (("text",), None, [("text+d+", "laughter")]),
    ((")",), None, [(r"[:;]\)", "laughter")]),
]


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def mask(c: Column, user: str = "@user", url: str = "URL", num: str = "NUM", laughter: str = "jaja") -> Column:
    """user names, URLs, numbers and laughter -> tokens, in the reference order."""
    tokens = {"user": user, "url": url, "num": num, "laughter": laughter}

    def group(holds: Sequence[str], matches: str | None, steps: list) -> Callable[[Column], Column]:
        def run(text: Column) -> Column:
            tests = [text.contains(h) for h in holds] + ([text.rlike(matches)] if matches else [])
            masked = text
            for pattern, repl in steps:
                masked = F.regexp_replace(masked, pattern, tokens.get(repl, repl))
            return F.when(reduce(Column.__and__, tests), masked).otherwise(text)

        return run

    out = c
    for g in MASK_GROUPS:
        out = F.element_at(F.transform(F.array(out), group(*g)), 1)  # the lambda's variable: ``out`` is computed once
    return out


def split_hashtags(c: Column, token: str = HASHTAG_TOKEN) -> Column:
    """``#MiHashTag`` -> ``hashtag Mi Hash Tag``; tags need an ASCII letter and a non-word char before ``#``.

    Mark each tag start, split on the marks, and rewrite the leading word run of every piece
    (space before each run of capitals, stripped, prefixed by the token). No length limit on tags.
    """
    marked = F.regexp_replace(c, f"(?<!{WORD})#(?={WORD}*[a-zA-Z])", _MARK)
    pieces = F.split(marked, _MARK, -1)

    def rewrite(piece: Column, i: Column) -> Column:
        body = F.regexp_extract(piece, f"^({WORD}*)", 1)
        rest = F.substring(piece, F.length(body) + 1, 1 << 30)
        camel = strip_ws(F.regexp_replace(body, "([A-Z]+)", " $1"))
        return F.when(i == 0, piece).otherwise(F.concat(F.lit(token + " "), camel, rest))

    return F.array_join(F.transform(pieces, rewrite), "")


def drop_short_words(c: Column, n: int = 1) -> Column:
    """remove whole words of 1..n word characters."""
    return F.regexp_replace(c, rf"(?U)\b\w{{1,{n}}}\b", "")  # word boundaries need the (?U) flag


def squeeze_repeats(c: Column, k: int = 2) -> Column:
    """runs of k+ copies of one character -> k copies (Python ``.``: anything but ``\\n``)."""
    return F.regexp_replace(c, "([^\\n])" + "\\1" * (k - 1) + "+", "$1" * k)


def strip_punctuation(c: Column) -> Column:
    """ASCII punctuation except ``@``, plus ``¿?¡…``, newlines and tabs -> spaces."""
    chars = PUNCTUATION + "\n\t"
    return F.translate(c, chars, " " * len(chars))


def longest_pattern(words: Sequence[str]) -> str:
    """A regex that matches, at every place, the longest of ``words`` (not empty) that starts there.

    The words as a tree by characters: at most one branch fits, and a branch is left out only if it leads nowhere. Words
    without a longer one beside them share a character class, so a table of thousands is tried in one step.
    """
    tree: dict = {}
    for word in words:
        node = tree
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def branch(node: dict) -> str:
        code = lambda ch: f"\\x{{{ord(ch):X}}}"
        ends = [ch for ch in sorted(node) if ch and set(node[ch]) == {""}]
        more = [code(ch) + branch(node[ch]) for ch in sorted(node) if ch and set(node[ch]) != {""}]
        parts = more + (["[" + "".join(map(code, ends)) + "]"] if ends else [])
        inner = "(?:" + "|".join(parts) + ")"
        return inner + ("?" if "" in node else "")

    return branch(tree)


def demojize(c: Column, emoji_names: Mapping[str, str], wrapper: str = EMOJI_WRAPPER, buckets: int = 256) -> Column:
    """each emoji -> `` emoji <name> emoji ``, then every ``_`` -> space.

    ``emoji_names`` is the user's emoji -> name table (config-sized). The text is cut at its emoji, leftmost and longest first (a
    skin tone or joined sequence is one emoji if the table has it), and every emoji found is looked up once, in a literal map of
    ``buckets`` parts by checksum.
    """
    import json
    import zlib

    out, names = c, {k: v for k, v in emoji_names.items() if k}
    if names:
        pattern = longest_pattern(list(names))
        parts: list[dict] = [{} for _ in range(buckets)]
        for k, v in names.items():
            parts[zlib.crc32(k.encode()) % buckets][k] = f" {wrapper} {v} {wrapper} "
        table = F.from_json(F.lit(json.dumps(parts)), "array<map<string,string>>")  # folded to one literal

        def name(e: Column) -> Column:
            return F.element_at(F.get(table, (F.crc32(e.cast("binary")) % buckets).cast("int")), e)

        def named(text: Column) -> Column:
            gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
            whole = F.array_join(F.zip_with(gaps, found, lambda gap, e: F.concat(gap, F.coalesce(name(e), F.lit("")))), "")
            return F.when(text.rlike(pattern), whole).otherwise(text)

        out = F.element_at(F.transform(F.array(c), named), 1)  # the lambda's variable: ``c`` is computed once
    return F.regexp_replace(out, "_", " ")


def squeeze_spaces(c: Column) -> Column:
    """strip, then runs of 2+ whitespace -> one space."""
    return F.regexp_replace(strip_ws(c), f"{WS}{{2,}}", " ")


def preprocess(c: Column, emoji_names: Mapping[str, str] | None = None, min_len: int = 1, shorten: int = 2,
               lower: bool = True) -> Column:
    """F8: F3 -> F4 -> F2 -> lower -> F1 -> F5 -> F6 -> F7 (this order: masks stay upper-case)."""
    out = drop_short_words(c, min_len)
    out = squeeze_repeats(out, shorten)
    out = split_hashtags(out)
    if lower:
        out = F.lower(out)
    out = mask(out)
    out = strip_punctuation(out)
    out = demojize(out, emoji_names or {})
    return squeeze_spaces(out)


def spanish_stop_words() -> list[str]:
    """Spark's built-in Spanish stop-word list (313 words), read from the Spark ML jar resource
    (same list as ``StopWordsRemover.loadDefaultStopWords("spanish")``, no JVM needed)."""
    import glob
    import os
    import zipfile

    import pyspark

    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    for jar in jars:
        with zipfile.ZipFile(jar) as z:
            name = "org/apache/spark/ml/feature/stopwords/spanish.txt"
            if name in z.namelist():
                return [w for w in z.read(name).decode("utf-8").splitlines() if w]
    from pyspark.ml.feature import StopWordsRemover

    return list(StopWordsRemover.loadDefaultStopWords("spanish"))


def tokens_without_stopwords(c: Column, stop_words: Sequence[str]) -> Column:
    """F9 (surface form): whitespace tokens of preprocessed text without stop words (case-sensitive)."""
    tokens = F.filter(F.split(c, " "), lambda t: t != "")
    return F.filter(tokens, lambda t: ~t.isin(*stop_words))  # a hash set in the optimised plan


def lemmatize(df: DataFrame, key: Sequence[str], tokens_col: str, lemmas: DataFrame, out: str = "lemmas") -> DataFrame:
    """F9 (lemma form): token -> lemma via a join with a (token, lemma) table; multi-word lemmas split
    on spaces; mask tokens keep themselves. Tokens are exploded with their position, joined (the
    lemma table is broadcast if its bytes allow it) and collected back in order per document.
    """
    from threadlens.session import maybe_broadcast

    lem = maybe_broadcast(lemmas.select(F.col("token").alias("_tok"), F.col("lemma").alias("_lem")))
    exploded = df.select(*key, F.posexplode(tokens_col).alias("_pos", "_tok"))
    joined = exploded.join(lem, "_tok", "left")
    lemma = F.when(F.col("_tok").isin(*KEEP_AS_IS), F.col("_tok")).otherwise(F.coalesce("_lem", "_tok"))
    parts = joined.select(*key, "_pos", F.split(lemma, " ").alias("_parts"))
    regrouped = parts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_pos", "_parts"))).alias("_s"))
    flat = regrouped.select(*key, F.flatten(F.col("_s._parts")).alias(out))
    return df.join(flat, list(key), "left").withColumn(out, F.coalesce(F.col(out), F.array().cast("array<string>")))


def clean_corpus(df: DataFrame, text_columns: Sequence[str], pre: bool = True, mask_only: bool = False,
                 stop_words: Sequence[str] | None = None, emoji_names: Mapping[str, str] | None = None) -> DataFrame:
    """F8 (+F9 tokens when ``stop_words`` given) or F1 alone, over every text column in one projection."""
    if mask_only:
        return df.withColumns({c: mask(F.col(c)) for c in text_columns})
    if not pre:
        return df
    cleaned = {c: preprocess(F.col(c), emoji_names) for c in text_columns}
    if stop_words is not None:
        cleaned = {c: tokens_without_stopwords(e, stop_words) for c, e in cleaned.items()}
    return df.withColumns(cleaned)
