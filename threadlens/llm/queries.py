"""Queries of the corpus operators: thin callables over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.common import read_table
from threadlens.llm.compression import compression_rules
from threadlens.llm.divergence import divergences
from threadlens.llm.line_spread import remove_boilerplate
from threadlens.llm.mixing import mix_plan
from threadlens.llm.near_dedup import near_duplicates
from threadlens.llm.part_codes import books_digest, compress
from threadlens.llm.pii import find_personal_data
from threadlens.llm.piece_bpe import Codec, encode_decode
from threadlens.llm.rule_ensemble import quality_scores
from threadlens.llm.substring_dedup import digests, remove_reference_spans, remove_repeats
from threadlens.llm.suffix_tree import tree_scores
from threadlens.llm.topk import top_k
from threadlens.llm.warc import round_trip

#: Distinct sites from which on a line is boilerplate.
MIN_SITES = 10

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules(read_table(spark, sf_dir, "documents"))


@query
def op2_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(remove_repeats(read_table(spark, sf_dir, "documents")))


SQL["op2_suffix_automata"] = """
WITH cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents
), w AS (
  SELECT doc_id, generate_subscripts(words, 1) AS place, unnest(words) AS word FROM cut
), windows AS (
  SELECT *, string_agg(word, ' ') OVER next20 AS win, count(*) OVER next20 AS n FROM w
  WINDOW next20 AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), judged AS (
  SELECT doc_id, place, word, n = 20 AND row_number() OVER (PARTITION BY win, n ORDER BY doc_id, place) > 1 AS again FROM windows
), marked AS (
  SELECT doc_id, place, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM judged
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY place) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""


@query
def remove_benchmark_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 20 or more words of the benchmark texts leave the documents (the bounded-reference form of op2)."""
    cleaned = remove_reference_spans(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL["remove_benchmark_spans"] = """
WITH cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents
), w AS (
  SELECT doc_id, generate_subscripts(words, 1) AS place, unnest(words) AS word FROM cut
), windows AS (
  SELECT *, string_agg(word, ' ') OVER next20 AS win, count(*) OVER next20 AS n FROM w
  WINDOW next20 AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM benchmark
), known AS (
  SELECT DISTINCT array_to_string(words[i : i + 19], ' ') AS win FROM (SELECT words, unnest(range(1, len(words) - 18)) AS i FROM b)
), judged AS (
  SELECT doc_id, place, word, n = 20 AND known.win IS NOT NULL AS again FROM windows LEFT JOIN known ON windows.win = known.win
), marked AS (
  SELECT doc_id, place, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM judged
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY place) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""


@query
def op3_tiled_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL["op3_tiled_top_k"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scores
QUALIFY rank <= 5
"""


@query
def op4_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "pages"))


SQL["op4_warc_chain"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keeper FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keeper > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper > page_id THEN keeper END AS refers_to
FROM r
"""


@query
def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op6_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read_table(spark, sf_dir, "documents"))


@query
def op7_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op8_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_boilerplate(read_table(spark, sf_dir, "documents"), MIN_SITES)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL["op8_site_spread"] = f"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, source, generate_subscripts(lines, 1) AS place, unnest(lines) AS line FROM cut
), spread AS (
  SELECT line FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), m AS (
  SELECT l.*, regexp_matches(l.line, '[^\\x20\\x09-\\x0D]') AS has_text, spread.line IS NOT NULL AS bad
  FROM l LEFT JOIN spread ON l.line = spread.line
)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (has_text) AS n_lines, count(*) FILTER (bad) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT bad), '')) AS kept_sha256
FROM m GROUP BY r
"""


@query
def op9_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"), Codec(piece_model()))


@query
def op10_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op12_part_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(read_table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _part_trie_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds written out: distances of all parts to all entries, least first, then floored means."""
    at = ", ".join(f"({i})" for i in range(parts))
    sql = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT r, vec_id, pos, e[pos * (len(e) // {parts}) + 1 : (pos + 1) * (len(e) // {parts})] AS part
  FROM v CROSS JOIN (VALUES {at}) AS t(pos)
), c0 AS MATERIALIZED (
  SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS entry, part FROM p
  QUALIFY entry < {entries}
)"""
    for k in range(rounds + 1):
        sql += f""", a{k} AS MATERIALIZED (
  SELECT p.r, p.pos, min((list_inner_product(p.part, p.part) - 2 * list_inner_product(p.part, c.part)
                          + list_inner_product(c.part, c.part))::BIGINT * {entries} + c.entry) AS best
  FROM p JOIN c{k} AS c ON p.pos = c.pos GROUP BY p.r, p.pos
)"""
        if k < rounds:
            sql += f""", s{k} AS (
  SELECT pos, best % {entries} AS entry, generate_subscripts(part, 1) AS i, unnest(part) AS x FROM a{k} JOIN p USING (r, pos)
), m{k} AS (
  SELECT pos, entry, list(x ORDER BY i) AS part
  FROM (SELECT pos, entry, i, floor(sum(x) / count(*)) AS x FROM s{k} GROUP BY pos, entry, i) GROUP BY pos, entry
), c{k + 1} AS MATERIALIZED (
  SELECT c.pos, c.entry, coalesce(m.part, c.part) AS part FROM c{k} AS c LEFT JOIN m{k} AS m ON c.pos = m.pos AND c.entry = m.entry
)"""
    return sql + f""", coded AS (
  SELECT r, string_agg(printf('%02x', best % {entries}), '' ORDER BY pos) AS code, sum(best // {entries})::BIGINT AS error
  FROM a{rounds} GROUP BY r
), books AS (
  SELECT string_agg(x::BIGINT::VARCHAR, ',' ORDER BY pos, entry, i) AS books
  FROM (SELECT pos, entry, generate_subscripts(part, 1) AS i, unnest(part) AS x FROM c{rounds})
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(books) FROM books) AS codebooks_sha256
FROM coded JOIN v USING (r)
"""


SQL["op12_part_trie"] = _part_trie_sql()


@query
def op13_segment_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(read_table(spark, sf_dir, "documents"))


SQL["op13_segment_trees"] = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (
  SELECT r, lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term
), g AS (
  SELECT DISTINCT lang, source FROM d
), f AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n
  FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND kept.term = c.term
), p AS MATERIALIZED (
  SELECT *, (1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)))::BIGINT AS p
  FROM f
), w AS (
  SELECT lang, term, sum(n) AS n FROM f GROUP BY lang, term
), q AS (
  SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)))::BIGINT AS q FROM w
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), named AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
), terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q) * (p - q) // q AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT * FROM named UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 200
"""


@query
def op11_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return tree_scores(read_table(spark, sf_dir, "documents"), held_out)
