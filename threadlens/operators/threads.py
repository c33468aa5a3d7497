"""Reply threads.

Sentences are ordered by ``sentence_pos`` (never by file order). Root finding jumps pointers (the
logarithm of the depth in rounds), thread components contract stars; both write every round to the shared
folder, so that plans and their size estimates stay small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.functions.text import WS, strip_ws
from threadlens.operators.components import connected_components
from threadlens.session import write_shared

UNAVAILABLE = "UNAVAILABLE"


def normalise_thread_ids(df: DataFrame) -> DataFrame:
    """Export columns -> file_id, sentence_id, comment_id, sentence_pos, reply_to, user_id, sentence."""
    r = df.withColumnsRenamed({"FILE_ID": "file_id", "USER_ID": "user_id", "COMMENT_ID": "sentence_id",
                               "THREAD": "reply_to", "COMMENT": "sentence"})
    file_id = strip_ws(F.col("file_id"))
    parts = F.split(F.col("sentence_id"), "_")
    return r.select(
        file_id.alias("file_id"),
        "sentence_id",
        F.concat(file_id, parts[0]).alias("comment_id"),
        parts[1].alias("sentence_pos"),
        F.concat(file_id, F.expr("substring(reply_to, 1, length(reply_to) - 1)")).alias("reply_to"),
        "user_id",
        strip_ws(F.regexp_replace(F.col("sentence"), WS + "+", " ")).alias("sentence"),
    )


def _by_comment(comment: str, pos: str) -> Window:
    return Window.partitionBy(comment).orderBy(F.col(pos).asc())


#: Sentences of one comment that a task holds; longer comments are cut into blocks of positions.
BLOCK_ROWS = 10_000


def needs_blocks(df: DataFrame, comment: str, pos: str, block_rows: int) -> bool:
    """Whether some comment has more than ``block_rows`` sentences (and positions are numbers, so that they can be cut)."""
    if not isinstance(df.schema[pos].dataType, T.NumericType):
        return False
    return (df.groupBy(comment).count().agg(F.max("count")).first()[0] or 0) > block_rows


def block_of(pos: str, block_rows: int) -> Column:
    return F.floor(F.col(pos) / F.lit(block_rows))


def ordered_list(df: DataFrame, comment: str, pos: str, item: Column, block_rows: int) -> DataFrame:
    """(comment, _list): structs of pos and item of every comment in order.

    A long comment is sorted block by block in several tasks; what meets then are its blocks in order.
    """
    pair = F.struct(F.col(pos).alias("pos"), item.alias("item"))
    if not needs_blocks(df, comment, pos, block_rows):
        return df.groupBy(comment).agg(F.sort_array(F.collect_list(pair)).alias("_list"))
    blocks = df.groupBy(comment, block_of(pos, block_rows).alias("_blk")).agg(F.sort_array(F.collect_list(pair)).alias("_list"))
    whole = F.sort_array(F.collect_list(F.struct("_blk", "_list")))
    return blocks.groupBy(comment).agg(F.flatten(F.transform(whole, lambda b: b["_list"])).alias("_list"))


def previous_sentences(df: DataFrame, comment: str = "comment_id", pos: str = "sentence_pos",
                       sentence: str = "sentence", out: str = "previous_sentences", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All earlier sentences of the comment joined by a space, outer whitespace stripped.

    Output size is quadratic in sentences per comment by definition. Comments of more than ``block_rows`` sentences
    are scanned in blocks of positions: the text of each block, the texts of all blocks before it (one row a block), and the window
    inside the block, so a task holds one block of a comment.
    """
    text = F.coalesce(F.col(sentence), F.lit(""))
    before = (Window.unboundedPreceding, -1)
    if not needs_blocks(df, comment, pos, block_rows):
        joined = F.array_join(F.collect_list(text).over(_by_comment(comment, pos).rowsBetween(*before)), " ")
        return df.withColumn(out, strip_ws(joined))
    x = df.withColumn("_blk", block_of(pos, block_rows))
    blocks = x.groupBy(comment, "_blk").agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("pos"), text.alias("item")))).alias("_list"))
    blocks = write_shared(blocks.select(F.col(comment).alias("_c"), F.col("_blk").alias("_b"), F.array_join(F.col("_list.item"), " ").alias("_text")), "blocks")
    earlier = F.collect_list("_text").over(Window.partitionBy("_c").orderBy("_b").rowsBetween(*before))
    blocks = blocks.select("_c", "_b", F.when(F.size(earlier) > 0, F.array_join(earlier, " ")).alias("_earlier"))
    inside = F.collect_list(text).over(Window.partitionBy(comment, "_blk").orderBy(F.col(pos).asc()).rowsBetween(*before))
    x = x.withColumn("_inside", F.when(F.size(inside) > 0, F.array_join(inside, " ")))
    x = x.join(blocks, F.col(comment).eqNullSafe(F.col("_c")) & F.col("_blk").eqNullSafe(F.col("_b")))
    return x.withColumn(out, strip_ws(F.concat_ws(" ", "_earlier", "_inside"))).drop("_blk", "_c", "_b", "_earlier", "_inside")


def previous_sentence(df: DataFrame, comment: str = "comment_id", pos: str = "sentence_pos",
                      sentence: str = "sentence", out: str = "previous_sentence") -> DataFrame:
    """The sentence right before, ``""`` for the first one."""
    return df.withColumn(out, F.lag(F.col(sentence), 1, "").over(_by_comment(comment, pos)))


def last_sentence(df: DataFrame, comment: str = "comment_id", pos: str = "sentence_pos",
                  cols: Sequence[str] = ("reply_to", "sentence")) -> DataFrame:
    """The last row per comment (max position), as one aggregate per comment."""
    last = F.max_by(F.struct(*[F.col(c) for c in (pos, *cols)]), F.col(pos))
    return df.groupBy(comment).agg(last.alias("_l")).select(comment, "_l.*")


def comment_table(df: DataFrame, comment: str = "comment_id", pos: str = "sentence_pos",
                  sentence: str = "sentence", reply: str = "reply_to", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per comment: strip(previous sentences of the last sentence + " " + last sentence).

    One aggregate, of blocks for comments of more than ``block_rows`` sentences: the sentences in order are joined up to
    the last one. Missing earlier sentences count as empty, a missing last one makes the text null, as with the row-wise definition.
    """
    g = ordered_list(df, comment, pos, F.struct(F.col(sentence).alias("s"), F.col(reply).alias("r")), block_rows)
    n, last = F.size("_list"), F.element_at("_list", -1)["item"]
    earlier = F.transform(F.slice("_list", 1, n - 1), lambda x: F.coalesce(x["item"]["s"], F.lit("")))
    text = strip_ws(F.concat(strip_ws(F.array_join(earlier, " ")), F.lit(" "), last["s"]))
    return g.select(comment, last["r"].alias("reply_to"), text.alias("comment"))


def _nodes(df: DataFrame, comment: str, reply: str, pos: str | None) -> DataFrame:
    """One (id, parent) row per comment: the parent of its first row."""
    if pos and pos in df.columns:
        return df.groupBy(comment).agg(F.min_by(F.col(reply), F.col(pos)).alias("parent")).withColumnRenamed(comment, "id")
    return df.select(F.col(comment).alias("id"), F.col(reply).alias("parent")).dropDuplicates(["id"])


def find_root(df: DataFrame, comment: str = "comment_id", reply: str = "reply_to", pos: str | None = "sentence_pos",
              out: str = "first_comment_id") -> DataFrame:
    """Follow reply links to the self-replying root; missing ancestor or cycle -> ``UNAVAILABLE``.

    Pointer jumping: each round the open nodes take over the pointer of the node that they point to, so the
    distance covered doubles. A node is closed once it points to a root or to a missing ancestor. A round
    that closes no node means that all open ones lead into cycles, and ends the search. The result (string
    id) is joined back to the rows.
    """
    nodes = write_shared(_nodes(df, comment, reply, pos), "nodes")
    parents = nodes.select(F.col("id").alias("p_id"), F.col("parent").alias("p_parent"))
    found = F.col("p_id").isNotNull()
    state = nodes.join(parents, F.col("parent") == F.col("p_id"), "left").select(
        "id", F.col("parent").alias("ptr"),
        (found & (F.col("p_id") == F.col("p_parent"))).alias("rooted"), (~found).alias("lost"))
    state = write_shared(state.select("id", "ptr", F.coalesce("rooted", F.lit(False)).alias("rooted"), "lost"), "pointers")
    closed = F.col("rooted") | F.col("lost")
    before, still = None, state.where(~closed).count()
    while still and still != before:
        ahead = state.select(F.col("id").alias("a_id"), F.col("ptr").alias("a_ptr"), F.col("rooted").alias("a_rooted"), F.col("lost").alias("a_lost"))
        jumped = state.where(~closed).join(ahead, F.col("ptr") == F.col("a_id")).select(
            "id", F.col("a_ptr").alias("ptr"), F.col("a_rooted").alias("rooted"), F.col("a_lost").alias("lost"))
        state = write_shared(state.where(closed).union(jumped), "pointers")
        before, still = still, state.where(~closed).count()
    resolved = state.select(F.col("id").alias("_node"), F.when(F.col("rooted"), F.col("ptr").cast("string"))
                            .otherwise(F.lit(UNAVAILABLE)).alias("_root"))
    rows = df.join(resolved, F.col(reply) == F.col("_node"), "left")
    root = F.when(F.col(reply) == F.col(comment), F.col(comment).cast("string")).otherwise(
        F.coalesce(F.col("_root"), F.lit(UNAVAILABLE)))
    return rows.withColumn(out, root).drop("_node", "_root")


def thread_components(df: DataFrame, comment: str = "comment_id", reply: str = "reply_to", out: str = "thread") -> DataFrame:
    """Undirected connected components of the reply graph; thread id = min node id.

    Stars are contracted until nothing changes (see ``connected_components``): no cap on rounds. A comment
    without any link is its own thread.
    """
    links = df.select(F.col(comment).alias("a"), F.col(reply).alias("b")).where("b IS NOT NULL")
    parts = connected_components(links).select(F.col("node").alias("_node"), F.col("component").alias("_thread"))
    rows = df.join(parts, F.col(comment) == F.col("_node"), "left")
    return rows.withColumn(out, F.coalesce("_thread", F.col(comment))).drop("_node", "_thread")


def add_parent_text(df: DataFrame, comments: DataFrame, comment: str = "comment_id", reply: str = "reply_to",
                    out: str = "previous_comment") -> DataFrame:
    """Text of the replied-to comment; ``""`` for self replies and missing parents."""
    c = comments.select(F.col(comment).alias("_pc"), F.col("comment").alias("_ptext"))
    j = df.join(c, F.col(reply) == F.col("_pc"), "left")
    text = F.when(F.col(reply) == F.col(comment), F.lit("")).otherwise(F.coalesce(F.col("_ptext"), F.lit("")))
    return j.withColumn(out, text).drop("_pc", "_ptext")


def add_root_text(df: DataFrame, comments: DataFrame, comment: str = "comment_id", root: str = "first_comment_id",
                  out: str = "first_comment") -> DataFrame:
    """Text of the thread root; ``""`` when the row's comment is the root or the root is unknown."""
    c = comments.select(F.col(comment).cast("string").alias("_rc"), F.col("comment").alias("_rtext"))
    j = df.join(c, F.col(root) == F.col("_rc"), "left")
    text = F.when(F.col(root) == F.col(comment).cast("string"), F.lit("")).otherwise(F.coalesce(F.col("_rtext"), F.lit("")))
    return j.withColumn(out, text).drop("_rc", "_rtext")


def add_relative_labels(df: DataFrame, key: str, link: str, cols: Sequence[str], suffix: str) -> DataFrame:
    """Left self join through ``link`` (parent or root id) -> ``<col><suffix>`` label columns."""
    other = df.select(F.col(key).alias("_k"), *[F.col(c).alias(c + suffix) for c in cols])
    return df.join(other, F.col(link) == F.col("_k"), "left").drop("_k")


def add_parent_labels(df: DataFrame, cols: Sequence[str] = ("stereo", "implicit", "contextual")) -> DataFrame:
    return add_relative_labels(df, "tweet_id", "in_reply_to_tweet_id", cols, "_father")


def add_root_labels(df: DataFrame, cols: Sequence[str] = ("stereo", "implicit", "contextual")) -> DataFrame:
    return add_relative_labels(df, "tweet_id", "conversation_id", cols, "_head")


def add_comment_label_arrays(df: DataFrame, labels: Sequence[str] = ("stereotype", "implicit"),
                             comment: str = "comment_id", pos: str = "sentence_pos", reply: str = "reply_to",
                             root: str = "first_comment_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per row, the comment's labels of earlier sentences, and the parent's and root's label arrays.

    Label arrays are built once per comment (ordered by position, long comments in blocks of ``block_rows``) and joined by KEY.
    """
    listed = ordered_list(df, comment, pos, F.struct(*[F.col(c) for c in labels]), block_rows)
    arrays = listed.select(F.col(comment).alias("_c"), *[F.col("_list.item." + c).alias("_arr_" + c) for c in labels])
    own = df.join(arrays, F.col(comment) == F.col("_c"), "left")
    for c in labels:
        own = own.withColumn(f"{c}_previous_sentences", F.slice(F.col("_arr_" + c), 1, F.col(pos) - 1))
    own = own.drop("_c", *["_arr_" + c for c in labels])
    for link, suffix, cast in ((reply, "_previous_comment", None), (root, "_first_comment", "string")):
        key = F.col("_c").cast(cast) if cast else F.col("_c")
        a = arrays.select(key.alias("_k"), *[F.col("_arr_" + c).alias(c + suffix) for c in labels])
        own = own.join(a, F.col(link) == F.col("_k"), "left").drop("_k")
    return own


def context_columns(df: DataFrame, news: DataFrame | None = None) -> DataFrame:
    """Thread contexts of the sentence corpus in one plan: W1, J5, J2, J3, J4 (+ J1 when news is given)."""
    from threadlens.operators.context import add_news

    rooted = find_root(previous_sentences(df))
    comments = write_shared(comment_table(df), "comments")
    out = add_root_text(add_parent_text(rooted, comments), comments)
    return add_news(out, news) if news is not None else out


