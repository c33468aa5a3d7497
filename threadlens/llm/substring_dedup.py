"""Removal of repeated word spans by suffix automata of reference shards.

Two uses. ``remove_reference_spans`` streams documents through the automata of a bounded reference table: every
shard's automaton is built in a task of its own, and all are broadcast as arrays. ``remove_repeats`` takes the corpus itself as the reference, whose
automata would grow with it; there, a shard holds the passages of some anchors only, and instead of the
automata the passages travel, so that a passage meets just the shard that can hold its equals.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import WordHashes, map_rows, release, shared_table, text_bytes, window_hashes

#: An id that sorts after every real one, for rows without id.
LAST = (1 << 63) - 1


class SuffixAutomaton:
    """Suffix automaton over words of a shard's passages, built passage by passage.

    Each state has its longest length, its suffix link and its transitions. Passages start again at the
    root, so no match runs from one into the next.
    """

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]

    def _state(self, length: int, link: int, step: dict[bytes, int]) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """A copy of ``q`` that holds what ``p`` extends by ``word``."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: Iterable[bytes]) -> None:
        last = 0
        nexts, link, length = self.next, self.link, self.length
        for word in words:
            q = nexts[last].get(word)
            if q is not None:  # the sequence so far is known
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
                continue
            new = self._state(length[last] + 1, 0, {})
            p = last
            while p >= 0 and word not in nexts[p]:
                nexts[p][word] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][word]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
            last = new

    def matching(self, words: Iterable[bytes]) -> Iterator[int]:
        """Matching statistics: for each word, how long the longest known sequence is that ends there."""
        state = held = 0
        nexts, link, length = self.next, self.link, self.length
        for word in words:
            while state and word not in nexts[state]:
                state = link[state]
                held = length[state]
            step = nexts[state].get(word)
            if step is None:
                held = 0
            else:
                state, held = step, held + 1
            yield held


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at one of ``starts``."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return np.cumsum(steps[:-1]) > 0


# --- a bounded reference, broadcast ---------------------------------------------------------------


class FlatAutomaton:
    """A shard's automaton as arrays: transitions sorted by (state, word number), suffix links, lengths, and the words.

    ``longest`` walks many texts at once, one word of each a step, so a step is a few array operations.
    """

    def __init__(self, passages: Iterable[list[bytes]]):
        automaton, numbers = SuffixAutomaton(), {}
        for words in passages:
            automaton.add([numbers.setdefault(w, len(numbers)) for w in words])
        steps = [(s << 32 | w, t) for s, step in enumerate(automaton.next) for w, t in step.items()]
        steps.sort()
        self.key = np.array([k for k, _ in steps], np.int64)
        self.target = np.array([t for _, t in steps], np.int32)
        self.link, self.length = np.maximum(np.array(automaton.link, np.int32), 0), np.array(automaton.length, np.int32)
        self.words = pa.array(list(numbers), pa.binary())

    def nbytes(self) -> int:
        return self.key.nbytes + self.target.nbytes + self.link.nbytes + self.length.nbytes + self.words.nbytes

    def longest(self, number: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Matching statistics of all texts: ``number`` holds word numbers (-1: unknown) text by text."""
        out = np.zeros(len(number), np.int32)
        order = np.argsort(-sizes, kind="stable")
        state, held = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int32)
        alive = len(order)
        for j in range(int(sizes.max(initial=0))):
            while alive and sizes[order[alive - 1]] <= j:
                alive -= 1
            texts = order[:alive]
            word = number[starts[texts] + j]
            state[texts[word < 0]], held[texts[word < 0]] = 0, 0
            open_texts, word = texts[word >= 0], word[word >= 0]
            while len(open_texts):
                wanted = state[open_texts] << 32 | word
                at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
                known = self.key[at] == wanted
                done = open_texts[known]
                state[done] = self.target[at[known]]
                held[done] += 1
                open_texts, word = open_texts[~known], word[~known]
                root = state[open_texts] == 0
                held[open_texts[root]] = 0
                open_texts, word = open_texts[~root], word[~root]
                state[open_texts] = self.link[state[open_texts]]
                held[open_texts] = self.length[state[open_texts]]
            out[starts[texts] + j] = held[texts]
        return out


def reference_shards(reference: DataFrame, window: int, shard_bytes: int, piece_words: int = 20_000) -> DataFrame:
    """One pickled ``FlatAutomaton`` a shard. Texts are cut into pieces that share ``window`` - 1 words, so no window is cut."""
    import pickle

    size = reference.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple]:
        for raw in batch.column(0):
            words = raw.as_py().split()
            for i in range(0, max(1, len(words) - window + 1), piece_words):
                if len(words) >= window:
                    yield (b" ".join(words[i : i + piece_words + window - 1]),)

    def build(key, table):
        flat = FlatAutomaton([t.as_py().split() for t in table.column("piece")])
        return pa.table({"shard": [key[0].as_py()], "size": [flat.nbytes()], "automaton": pa.array([pickle.dumps(flat)], pa.binary())})

    cut = map_rows(reference.select(text_bytes().alias("text")), pieces, "piece binary").distinct()
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(build, "shard long, size long, automaton binary")


def remove_reference_spans(docs: DataFrame, reference: DataFrame, window: int = 20, shard_bytes: int = 1 << 20, max_bytes: int = 256 << 20,
                           slice_bytes: int = 4 << 20) -> DataFrame:
    """Remove from every text the maximal spans of ``window`` or more words that stand in ``reference``.

    docs: doc_id, text; reference: text. Returns doc_id, n_words, n_removed, text (kept words, joined by one space), one row for each
    input row. Null texts count as empty on both sides; null ids, repeated rows, ties and empty tables are fine.

    The reference is cut into shards of about ``shard_bytes`` of text; tasks build one automaton each. They are broadcast as arrays
    behind a check of their size: above ``max_bytes`` together this raises, and ``remove_repeats`` is the operator to use. A
    worker unpacks them once, and slices of documents stream past all of them.
    """
    from threadlens.llm.tokens import PLAIN_WORDS, slices, tokens

    spark = docs.sparkSession
    shards = shared_table(reference_shards(reference, window, shard_bytes), "shards")
    size = shards.agg(F.sum("size")).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"the automata of the reference have {size} bytes; at most {max_bytes} are broadcast")
    shared = spark.sparkContext.broadcast([bytes(r["automaton"]) for r in shards.select("automaton").collect()])

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        automata = unpacked_automata(shared)
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for start, end in slices([len(t) for t in texts], slice_bytes):
            owner, number, distinct = tokens(texts[start:end], PLAIN_WORDS)
            sizes = np.bincount(owner, minlength=end - start)
            starts, words = np.cumsum(sizes) - sizes, distinct.cast(pa.large_binary()).cast(pa.binary())
            found = np.zeros(len(number), bool)
            for automaton in automata:
                known = pc.fill_null(pc.index_in(words, automaton.words), -1).to_numpy().astype(np.int64)
                found |= automaton.longest(known[number], starts, sizes) >= window
            gone = covered(len(number), np.flatnonzero(found) - window + 1, window)  # spans end inside their text
            kept = words.to_pylist()
            for i, doc_id in enumerate(ids[start:end]):
                mine = slice(starts[i], starts[i] + sizes[i])
                yield doc_id, int(sizes[i]), int(gone[mine].sum()), b" ".join([kept[w] for w in number[mine][~gone[mine]].tolist()]).decode()

    return map_rows(docs.select("doc_id", text_bytes().alias("text")), rows, "doc_id long, n_words long, n_removed long, text string")


#: Automata that this worker has unpacked, as long as their broadcast is in use.
_UNPACKED: WeakKeyDictionary = WeakKeyDictionary()


def unpacked_automata(shared: Broadcast) -> list[FlatAutomaton]:
    import pickle

    if shared not in _UNPACKED:
        _UNPACKED[shared] = [pickle.loads(a) for a in shared.value]
    return _UNPACKED[shared]


# --- the corpus as its own reference --------------------------------------------------------------


class Anchors:
    """Anchors of a text: of all word grams of a window, the one with the smallest hash (the first of equals).

    Equal windows have equal anchors at the same place in the window, so a window that repeats has an anchor
    that repeats.
    """

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram
        self.hashes = WordHashes()

    def of(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word gram, place of the anchor of each window) of a text."""
        grams = window_hashes(self.hashes.of(raw), self.gram)
        reach = self.window - self.gram + 1
        if len(grams) < reach:
            return grams, np.empty(0, np.int64)
        # running minimum by doubling: the smaller of two overlapping spans, the left one of equals
        low, at, span = grams, np.arange(len(grams)), 1
        while span < reach:
            step = min(span, reach - span)
            right = low[step:] < low[: len(low) - step]
            at = np.where(right, at[step:], at[: len(at) - step])
            low = np.where(right, low[step:], low[: len(low) - step])
            span += step
        return grams, at


def anchor_table(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc_id, t1, t2 (128-bit text hash), anchors (hashes), places: one row for each document."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        find = Anchors(window, gram)
        for doc_id, t1, t2, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
            grams, at = find.of(raw.as_py())
            places = np.unique(at)
            yield doc_id, t1, t2, grams[places].astype(np.int64), places.astype(np.int32)

    return map_rows(keyed(docs), rows, "doc_id long, t1 long, t2 long, anchors array<long>, places array<int>")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (LAST for none), t1, t2, text as bytes."""
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id")
    return docs.select(doc_id, F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("text"), "text").alias("t2"), text_bytes().alias("text"))


def runs_of(words: list[bytes], at: np.ndarray, repeated: np.ndarray, window: int) -> Iterator[tuple[int, int, int]]:
    """(anchor place, first window, last window) of the runs of windows with one anchor, for repeated anchors."""
    if not len(at):
        return
    first = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1])
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    for place, a, b in zip(at[first].tolist(), first.tolist(), last.tolist()):
        if place in repeated:
            yield place, a, b


def first_windows(passages: list[tuple[tuple, list[bytes]]], window: int) -> Iterator[tuple[tuple, list[int]]]:
    """For passages in order of their first occurrence: the windows that no earlier passage has."""
    if len(passages) == 1:
        key, words = passages[0]
        yield key, list(range(len(words) - window + 1))
        return
    shard = SuffixAutomaton()
    for key, words in passages:
        new = [i - window + 1 for i, m in enumerate(shard.matching(words)) if i >= window - 1 and m < window]
        if new:
            yield key, new
            shard.add(words)


def remove_repeats(docs: DataFrame, window: int = 20, gram: int = 8, hot: int = 4096) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts earlier in the corpus.

    docs: doc_id, text (others are ignored). Earlier means a smaller doc_id, or an earlier start in the same
    document; windows are judged on the input. Returns doc_id, n_words, n_removed, kept (kept words, joined by
    one space): one row for each input row. Null texts count as empty. Rows equal in id and text are one
    document and get the same result; different texts under one id are documents of their own, in the order
    of a hash of the text; rows without id come last. An empty table gives an empty result.

    1. Equal texts fold into their first document; of the copies nothing stays (if a window fits at all).
    2. Every window has an anchor. Anchors are counted; one that stands once cannot belong to a repeat.
    3. The runs of windows around repeated anchors are the passages. Equal passages fold into their first
       occurrence by partial aggregation, then go to the shard of their anchor. An anchor with more than
       ``hot`` different passages is dealt out by single windows instead, so no shard is unbounded.
    4. In a shard, passages stream through the suffix automaton of the earlier ones; a window whose matching
       statistic is below its length is a first occurrence.
    5. A document drops its candidate windows but for those first occurrences.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    # equal texts fold into one row per task before the shuffle
    texts = anchor_table(docs, window, gram).where(F.size("anchors") > 0).groupBy("t1", "t2").agg(
        F.min("doc_id").alias("doc_id"), F.any_value("anchors").alias("anchors"), F.any_value("places").alias("places"))
    texts = shared_table(texts.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "t1", "t2", "anchors", "places"), "texts")
    release(spark)

    pairs = texts.select("rid", F.explode(F.arrays_zip("anchors", "places")).alias("p")).select("rid", F.col("p.anchors").alias("anchor"), F.col("p.places").alias("place"))
    repeated = shared_table(pairs.groupBy("anchor").count().where("count > 1").select("anchor"), "repeated-anchors")
    release(spark)
    places = pairs.join(repeated, "anchor", "left_semi").groupBy("rid").agg(F.collect_list("place").alias("repeated"))
    places = shared_table(texts.select("rid", "doc_id", "t1", "t2").join(places, "rid"), "repeated-places")
    release(spark)

    # passages, with the words of whole runs
    def passages(batch: pa.RecordBatch) -> Iterator[tuple]:
        find = Anchors(window, gram)
        for doc_id, t1, known, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
            raw = raw.as_py()
            words = raw.split()
            grams, at = find.of(raw)
            for place, a, b in runs_of(words, at, set(known), window):
                yield int(grams[place].astype(np.int64)), b" ".join(words[a : b + window]), doc_id, t1, a

    of_text = places.select(F.col("doc_id").alias("of"), F.col("t1").alias("of1"), F.col("t2").alias("of2"), "repeated")
    same = (F.col("doc_id") == F.col("of")) & (F.col("t1") == F.col("of1")) & (F.col("t2") == F.col("of2"))
    # both sides grow with the corpus, so these joins are never broadcasts: the same plan at every size
    candidates = keyed(docs).join(of_text.hint("merge"), same).select("doc_id", "t1", "repeated", "text")
    runs = map_rows(candidates, passages, "anchor long, words binary, doc_id long, t1 long, start int")
    earliest = F.min(F.struct("doc_id", "t1", "start")).alias("first")
    distinct = shared_table(runs.groupBy("anchor", "words").agg(earliest), "passages")
    release(spark)

    crowded = distinct.groupBy("anchor").count().where(F.col("count") > hot).select("anchor")
    crowded = shared_table(crowded, "crowded")
    calm = distinct.join(crowded, "anchor", "left_anti").select("anchor", F.lit(0).cast("long").alias("salt"), "words", "first")

    def windows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for anchor, words, doc_id, t1, start in zip(*(batch.column(i).to_pylist() for i in range(5))):
            split = words.split(b" ")
            for i in range(len(split) - window + 1):
                yield anchor, b" ".join(split[i : i + window]), doc_id, t1, start + i

    single = distinct.join(crowded, "anchor", "left_semi").select("anchor", "words", "first.*")
    single = map_rows(single, windows, "anchor long, words binary, doc_id long, t1 long, start int")
    single = single.groupBy("anchor", "words").agg(earliest).select("anchor", F.xxhash64("words").alias("salt"), "words", "first")
    shards = calm.union(single).select("anchor", "salt", "first.*", "words")
    shards = shards.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "doc_id", "t1", "start")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sorted rows of a partition, group by group; a group may go on in the next batch."""
        names, kinds = ["doc_id", "t1", "starts"], [pa.int64(), pa.int64(), pa.list_(pa.int32())]
        group, held = None, []

        def closed() -> list[tuple]:
            return [(k[0], k[1], [k[2] + i for i in new]) for k, new in first_windows(held, window)] if held else []

        for batch in batches:
            out: list[tuple] = []
            for anchor, salt, doc_id, t1, start, words in zip(*(c.to_pylist() for c in batch.columns)):
                if (anchor, salt) != group:
                    out += closed()
                    group, held = (anchor, salt), []
                held.append(((doc_id, t1, start), words.split(b" ")))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 3, kinds)], names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*closed())) or [[]] * 3, kinds)], names)

    firsts = shared_table(shards.mapInArrow(stream, "doc_id long, t1 long, starts array<int>"), "first-windows")
    release(spark)
    kept_windows = firsts.groupBy("doc_id", "t1").agg(F.flatten(F.collect_list("starts")).alias("firsts")).select(
        F.col("doc_id").alias("k_id"), F.col("t1").alias("k1"), "firsts")
    judged = shared_table(places.join(kept_windows, (F.col("doc_id") == F.col("k_id")) & (F.col("t1") == F.col("k1")), "left")
                          .select(F.col("doc_id").alias("of"), F.col("t1").alias("of1"), F.col("t2").alias("of2"), "repeated", "firsts"), "judged")
    copies = keyed(docs).select("doc_id", "t1", "t2").join(
        texts.select(F.col("doc_id").alias("first"), F.col("t1").alias("c1"), F.col("t2").alias("c2")), (F.col("t1") == F.col("c1")) & (F.col("t2") == F.col("c2")))
    copies = shared_table(copies.where("doc_id > first").select(F.col("doc_id").alias("of"), F.col("t1").alias("of1"), F.col("t2").alias("of2")).distinct(), "copies")
    verdicts = judged.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        find = Anchors(window, gram)
        for doc_id, copy, known, firsts, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
            raw = raw.as_py()
            words = raw.split()
            if copy:
                yield doc_id, len(words), len(words), ""
            elif not known:
                yield doc_id, len(words), 0, b" ".join(words).decode()
            else:
                _, at = find.of(raw)
                gone = np.isin(at, np.array(known, np.int64))
                gone[np.array(firsts or [], np.int64)] = False
                drop = covered(len(words), np.nonzero(gone)[0], window)
                yield doc_id, len(words), int(drop.sum()), b" ".join([w for w, d in zip(words, drop) if not d]).decode()

    out = keyed(docs).join(verdicts.hint("merge"), same, "left").select(
        F.nullif(F.col("doc_id"), F.lit(LAST)).alias("doc_id"), F.coalesce("copy", F.lit(False)).alias("copy"), "repeated", "firsts", "text")
    return map_rows(out, rows, "doc_id long, n_words long, n_removed long, kept string")


def digests(removed: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of a ``remove_repeats`` result."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
