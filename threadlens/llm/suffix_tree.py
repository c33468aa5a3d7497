"""Language-model scores from a probabilistic suffix tree over words.

A context is a run of words; its state holds the counts of the words that follow it often. A context is kept
if those counts diverge from what the shorter contexts predict by more than they cost to store. A word is
scored by the longest kept context before it, smoothed with the next shorter one, down to word frequencies.

The corpus is cut into units of bounded size. A unit counts its own words and pairs of a context and a word, and sends
them, packed, to buckets by hash; a bucket adds up equal ones over all units and answers every unit, in the order in
which it was asked. A unit finds that order again, so answers are numbers without keys. So no task sees the whole model,
and a row of a shuffle is a packed list instead of one count.
"""

from __future__ import annotations

import math
import pickle
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.common import WordHashes, mix64, release, ship, text_bytes
from threadlens.llm.tokens import WORDS, tokens
from threadlens.session import ensure_checkpoint_dir

STEP = np.uint64(0x9E3779B97F4A7C15)
END = np.uint64(0x2545F4914F6CDD1D)  # the symbol after a text's last word
MICRO, PICO = 10**6, 10**12


@dataclass(frozen=True)
class Tree:
    """Contexts of up to ``depth`` words with at least ``least_context`` occurrences and followers with ``least_pair``.

    A context is kept if its divergence from the shorter ones, in nats over all its occurrences, is above ``penalty`` * ln(occurrences) for each
    stored follower. ``discount`` is taken off every stored count; what is left goes to the shorter context. Both thresholds are the same for
    every corpus, unless ``rise`` is set: then ``least_context`` is at least ``rise`` times the square root of the training tokens, and
    ``least_pair`` rises with it. A unit holds about ``unit_bytes`` of text, a bucket what ``bucket_bytes`` of text make.
    """

    depth: int = 3
    least_context: int = 16
    least_pair: int = 2
    discount: float = 0.75
    penalty: float = 0.5
    rise: float = 0.0
    unit_bytes: int = 13 << 20
    bucket_bytes: int = 8 << 20

    def at(self, tokens: int) -> Tree:
        """The tree with what a corpus of ``tokens`` asks for."""
        least = max(self.least_context, math.ceil(self.rise * math.sqrt(tokens)))
        return replace(self, least_context=least, least_pair=max(self.least_pair, least * self.least_pair // self.least_context))


class Shelf:
    """Tables in the shared folder, by kind of row; kinds that nothing needs any more are deleted, with the shuffles behind them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        df.write.partitionBy("kind").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, rows_of: str | None = None) -> None:
        """Delete old shuffles and all rows of ``rows_of`` but those of kind 0."""
        if rows_of:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[rows_of])
            files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for part in files.listStatus(place):
                if part.isDirectory() and part.getPath().getName() != "kind=0":
                    files.delete(part.getPath(), True)
        for _ in range(2):  # Spark deletes shuffles in the background once Python's and then the driver's references are gone
            release(self.spark)
            time.sleep(0.5)


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as one compressed value; equal byte places of numbers lie together, whole numbers in as few bytes as their largest needs."""
    import zstandard

    out, press = {}, zstandard.ZstdCompressor(level=1)
    for name, x in arrays.items():
        small = x.astype(np.min_scalar_type(x.max())) if x.dtype.kind in "iu" and x.itemsize > 1 and len(x) and x.min() >= 0 else x
        planes = np.ascontiguousarray(small).view(np.uint8).reshape(len(x), small.itemsize).T if len(x) else np.empty(0, np.uint8)
        out[name] = (x.dtype.str, small.dtype.str, len(x), press.compress(planes.tobytes()))
    return pickle.dumps(out)


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    import zstandard

    out, press = {}, zstandard.ZstdDecompressor()
    for name, (kind, small, n, data) in pickle.loads(blob).items():
        planes = np.frombuffer(press.decompress(data), np.uint8)
        out[name] = np.ascontiguousarray(planes.reshape(-1, n).T).view(small).ravel().astype(kind, copy=False) if n else np.empty(0, kind)
    return out


#: What a pass over units sends: kind 0 to its own unit, others to a bucket; and what buckets send back to units.
SENT = "unit long, kind int, bucket int, blob binary"


def sent(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                    names=["unit", "kind", "bucket", "blob"])


def steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as the first one and the steps between them, which need fewer bytes."""
    return np.diff(keys, prepend=np.uint64(0))


def keys_of(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The arrays with keys instead of steps."""
    return {"key": np.cumsum(arrays["step"], dtype=np.uint64)} | {c: x for c, x in arrays.items() if c != "step"}


def ranges(key: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of sorted 64-bit keys, cut into buckets of equal ranges; empty ones are left out."""
    cuts = np.searchsorted(key, np.array([-(-(i << 64) // buckets) for i in range(buckets)], np.uint64)).tolist()
    return ((i, start, end) for i, (start, end) in enumerate(zip(cuts, [*cuts[1:], len(key)])) if end > start)


def dealt(unit: int, kind: int, buckets: int, key: np.ndarray, **columns: np.ndarray) -> Iterator[tuple]:
    """Rows of SENT: sorted 64-bit keys by bucket, with their columns."""
    for i, start, end in ranges(key, buckets):
        yield unit, kind, i, packed({"step": steps(key[start:end])} | {c: x[start:end] for c, x in columns.items()})


def ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of 64-bit hashes in order, equal ones as they came; the hashes in order), by one sort of plain numbers.

    Places fill the lower bits of what is sorted; hashes that are alike in all upper bits are few and mended afterwards.
    """
    low = np.uint64((1 << max(len(key) - 1, 1).bit_length()) - 1)
    code = np.sort(key & ~low | np.arange(len(key), dtype=np.uint64))
    order = (code & low).astype(np.int64)
    out = key[order]
    for top in np.unique(out[1:][out[1:] < out[:-1]] & ~low):
        alike = slice(np.searchsorted(code, top), np.searchsorted(code, top | low, "right"))
        order[alike] = order[alike][np.argsort(out[alike], kind="stable")]
        out[alike] = key[order[alike]]
    return order, out


def numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes in order, each entry's number among them, the first entry of each)."""
    order, key = ordered(key)
    new = np.empty(len(key), bool)
    new[:1], new[1:] = True, key[1:] != key[:-1]
    number = np.empty(len(key), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return key[new], number, order[new]


def gathered(table: pa.Table) -> tuple[list[tuple[int, int, int]], dict[str, np.ndarray]]:
    """([(unit, start, end) of its entries], all columns one after the other, keys among them)."""
    parts = [keys_of(unpacked(b.as_py())) for b in table.column("blob")]
    ends = np.cumsum([len(x["key"]) for x in parts]).tolist()
    return list(zip(table.column("unit").to_pylist(), [0, *ends], ends)), {c: np.concatenate([x[c] for x in parts]) for c in parts[0]}


def spaced(words: pa.Array) -> pa.Array:
    """Words with a space behind each."""
    empty, space = (pa.scalar(x, pa.large_binary()) for x in (b"", b" "))
    return pc.binary_join_element_wise(words.cast(pa.large_binary()), empty, space)


def joined(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(where each of some newly made values starts and the last one ends, their bytes, one after the other)."""
    _, at, data = words.buffers()
    at = np.frombuffer(at, np.int64)[: len(words) + 1]
    return at, np.frombuffer(data, np.uint8)[: at[-1]] if len(words) else np.empty(0, np.uint8)


def units(docs: DataFrame, unit_bytes: int, buckets: int) -> DataFrame:
    """Rows of SENT: one of each unit (its documents, as numbers of its own words), and its words by bucket (kind 1).

    docs: part, doc_id, held, text. A unit is a run of documents of one input partition, closed beyond ``unit_bytes``.
    """

    def closed(unit: int, waiting: list[tuple], hashes: WordHashes) -> Iterator[pa.RecordBatch]:
        owner, number, distinct = tokens([t for *_, t in waiting], WORDS)
        held = np.array([h for _, h, _ in waiting], bool)
        often = np.argsort(-np.bincount(number, minlength=len(distinct)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(often), np.int64)
        rank[often] = np.arange(len(often))
        number, words = rank[number], spaced(distinct.take(pa.array(often)))
        n = np.bincount(number[~held[owner]], minlength=len(words))
        _, letters = joined(words)
        state = {"doc": np.array([0 if d is None else d for d, *_ in waiting], np.int64), "none": np.array([d is None for d, *_ in waiting], bool),
                 "held": held, "length": np.bincount(owner, minlength=len(held)), "ids": number.astype(np.uint32), "letters": letters}
        rows = [(unit, 0, None, packed(state))]
        order, h = ordered(hashes.of(letters.tobytes()))
        at, letters = joined(words.take(pa.array(order)))
        for i, start, end in ranges(h, buckets):
            rows.append((unit, 1, i, packed({"letters": letters[at[start] : at[end]], "n": n[order[start:end]]})))
        yield from sent(rows).to_batches()
        pa.default_memory_pool().release_unused()

    def run(batches):
        waiting, size, unit, hashes = [], 0, None, WordHashes()
        for batch in batches:
            for part, doc, held, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                unit = part << 24 if unit is None else unit
                waiting.append((doc, held, text))
                size += len(text)
                if size >= unit_bytes:
                    yield from closed(unit, waiting, hashes)
                    waiting, size, unit = [], 0, unit + 1
        if waiting:
            yield from closed(unit, waiting, hashes)

    return docs.mapInArrow(run, SENT)


def word_counts(coded: DataFrame) -> DataFrame:
    """Training counts of words over all units. Rows of SENT: for every unit its words' (kind 0), and one of totals with unit -1 a bucket."""

    def run(key, table):
        parts = [unpacked(b.as_py()) for b in table.column("blob")]
        _, number, distinct = tokens([x["letters"].tobytes() for x in parts], WORDS)  # equal words, not equal hashes
        n = np.concatenate([x["n"] for x in parts])
        count = np.bincount(number, weights=n, minlength=len(distinct)).astype(np.int64)
        ends = np.cumsum([len(x["n"]) for x in parts]).tolist()
        rows = [(u, 0, key[0].as_py(), packed({"c": count[number[start:end]]})) for u, start, end in zip(table.column("unit").to_pylist(), [0, *ends], ends)]
        return sent([*rows, (-1, 0, key[0].as_py(), packed({"total": np.array([count.sum(), (count > 0).sum()])}))])

    return coded.where("kind = 1").groupBy("bucket").applyInArrow(run, SENT)


@dataclass(frozen=True)
class Level:
    """Places behind frequent contexts of one length: the context's number, hash and count, the pair's key and count; and once pairs
    are counted, of each pair one of these places."""

    place: np.ndarray
    group: np.ndarray
    contexts: np.ndarray  # by number, in order
    n: np.ndarray  # by number
    key: np.ndarray
    total: np.ndarray
    spots: np.ndarray | None = None  # by pair, in order of keys


class Unit:
    """A unit's documents and what buckets answered: counts of its words (kind 0) and of its pairs (k), sums of kept states (-k)."""

    def __init__(self, state: pa.Table, facts: pa.Table, corpus: Corpus, tree: Tree):
        self.a, self.corpus, self.tree = unpacked(state.column("blob")[0].as_py()), corpus, tree
        kind, bucket = facts.column("kind").to_numpy(), facts.column("bucket").to_numpy()
        parts: dict[int, list] = {}
        for i in np.lexsort((bucket, kind)).tolist():  # buckets are ranges of keys, so answers come in the order of keys
            parts.setdefault(int(kind[i]), []).append(unpacked(facts.column("blob")[i].as_py()))
        self.facts = {k: {c: np.concatenate([x[c] for x in p]) for c in p[0]} for k, p in parts.items()}

    def stream(self) -> None:
        """Every document's words and its end, one after the other."""
        self.h = WordHashes().of(self.a["letters"].tobytes())
        self.c = np.zeros(len(self.h), np.int64)
        if 0 in self.facts:
            self.c[ordered(self.h)[0]] = self.facts[0]["c"]
        n = self.a["length"] + 1
        self.starts = np.cumsum(n) - n
        end = np.zeros(int(n.sum()), bool)
        end[self.starts + n - 1] = True
        self.symbol, self.count = np.full(len(end), END), np.full(len(end), self.corpus.docs, np.int64)
        if len(self.a["ids"]):
            self.symbol[~end], self.count[~end] = self.h[self.a["ids"]], self.c[self.a["ids"]]
        self.end, self.train = end, np.repeat(~self.a["held"], n)
        self.p = (self.count + 1) / (self.corpus.tokens + self.corpus.distinct + 1)

    def levels(self, depth: int) -> list[Level]:
        """All places with a frequent context before them, by context length."""
        out = []
        with np.errstate(over="ignore"):
            often = np.flatnonzero(self.c >= self.tree.least_context)
            often = often[ordered(mix64(self.h[often]))[0]]
            group_of = np.full(len(self.h), -1, np.int32)
            group_of[often] = np.arange(len(often))
            before = np.flatnonzero(~self.end)
            group = group_of[self.a["ids"]] if len(before) else np.empty(0, np.int32)
            before, group = before[group >= 0], group[group >= 0]
            contexts, n = mix64(self.h[often]), self.c[often]
            for k in range(1, depth + 1):
                place = before + 1
                key = mix64(contexts[group] * STEP + self.symbol[place])
                level = Level(place, group, contexts, n, key, np.zeros(len(key), np.int64))
                before, group, contexts, n = before[:0], group[:0], contexts[:0], n[:0]
                if k in self.facts:
                    at, (keys, number, spots) = self.counted(level, out[-1] if out else None)
                    total = self.facts[k]["total"]
                    level.total[at] = total[number]
                    level = replace(level, spots=at[spots])
                    more = (total >= self.tree.least_context) & ~self.end[place[level.spots]]
                    again = more[number]
                    before, group = place[at[again]], (np.cumsum(more, dtype=np.int32) - 1)[number[again]]
                    contexts, n = keys[more], total[more]
                out.append(level)
        return out

    def predict(self, k: int, level: Level) -> None:
        """The probabilities after contexts of length k have been heard, too."""
        if -k not in self.facts:
            return
        total, pairs = (self.facts[-k][c] for c in ("total", "pairs"))
        lam = 1.0 - (total - self.tree.discount * pairs) / level.n
        kept = (pairs > 0)[level.group]
        at, total, group = level.place[kept], level.total[kept], level.group[kept]
        self.p[at] = np.where(total > 0, (total - self.tree.discount) / level.n[group], 0.0) + lam[group] * self.p[at]

    def counted(self, level: Level, shorter: Level | None) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """(places in the level, their pairs as ``numbered``) of the pairs that can be frequent enough to be stored: the word is, and so is its
        pair with the next shorter context, as that occurs wherever the longer one does."""
        can = self.count[level.place] >= self.tree.least_pair
        if shorter is not None:
            behind = np.full(len(self.count), self.tree.least_pair)
            behind[shorter.place] = shorter.total
            can &= behind[level.place] >= self.tree.least_pair
        at = np.flatnonzero(can)
        return at, numbered(level.key[at])

    def pairs(self, level: Level, shorter: Level | None) -> tuple[np.ndarray, np.ndarray]:
        """(key, training occurrences) of the pairs to be counted."""
        at, (keys, number, _) = self.counted(level, shorter)
        return keys, np.bincount(number[self.train[level.place[at]]], minlength=len(keys))

    def statistics(self, k: int, level: Level) -> tuple[np.ndarray, ...]:
        """(context, its count, stored count, stored pairs, gain, expected share) by context, of the pairs that this unit speaks for."""
        at = level.spots[self.facts[k]["lead"]] if k in self.facts else np.empty(0, np.int64)
        t, q, g = level.total[at], self.p[level.place[at]], level.group[at]
        add = lambda w: np.bincount(g, weights=w, minlength=len(level.n)).astype(np.int64)  # noqa: E731  exact: whole numbers below 2**53
        sums = add(t), add(np.ones(len(t))), add(np.rint(MICRO * t * np.log(t / (level.n[g] * q)))), add(np.rint(PICO * q))
        return level.contexts, level.n, *sums

    def scores(self) -> dict[str, np.ndarray]:
        add = lambda x: np.add.reduceat(x, self.starts)  # noqa: E731  every document has an end
        base = np.log10((self.count + 1) / (self.corpus.tokens + self.corpus.distinct + 1))
        return {"n_tokens": self.a["length"] + 1, "n_known": add((self.count > 0).astype(np.int64)), "base_score": add(base), "score": add(np.log10(self.p))}


@dataclass(frozen=True)
class Corpus:
    """Training tokens (ends included), distinct ones, documents."""

    tokens: int
    distinct: int
    docs: int


def heard(states: DataFrame, facts: DataFrame, corpus: Corpus, tree: Tree, k: int, buckets: int) -> DataFrame:
    """One pass over the units, with all answers so far: rows of SENT.

    kind k: pairs of contexts of length k, to be counted; kind -(k - 1): what this unit adds to the statistics of
    contexts of length k - 1.
    """

    def run(key, state: pa.Table, news: pa.Table) -> pa.Table:
        name = key[0].as_py()
        unit = Unit(state, news, corpus, tree)
        unit.stream()
        levels = unit.levels(min(k, tree.depth))
        for j in range(1, k - 1):
            unit.predict(j, levels[j - 1])
        rows = []
        if k <= tree.depth:
            keys, n = unit.pairs(levels[k - 1], levels[k - 2] if k > 1 else None)
            rows += dealt(name, k, buckets, keys, n=n)
        if k > 1:
            contexts, n, total, pairs, gain, share = unit.statistics(k - 1, levels[k - 2])
            rows += dealt(name, 1 - k, buckets, contexts, n=n, total=total, pairs=pairs, gain=gain, share=share)
        pa.default_memory_pool().release_unused()
        return sent(rows)

    return states.groupBy("unit").cogroup(facts.groupBy("unit")).applyInArrow(run, SENT)


def stored_pairs(table: pa.Table, kind: int, bucket: int, tree: Tree) -> pa.Table:
    """For every unit the corpus counts of its pairs, 0 of those that are not frequent enough; one unit speaks for a pair."""
    units, x = gathered(table)
    keys, same, first = numbered(x["key"])
    total = np.bincount(same, weights=x["n"], minlength=len(keys)).astype(np.int64)
    total[total < tree.least_pair] = 0
    lead = np.zeros(len(same), bool)
    lead[first[total > 0]] = True
    total = total[same]
    return sent([(u, kind, bucket, packed({"total": total[start:end], "lead": lead[start:end]})) for u, start, end in units])


def kept_states(table: pa.Table, kind: int, bucket: int, tree: Tree) -> pa.Table:
    """For every unit the stored count and pairs of its contexts, 0 of those that are not kept.

    The divergence is that of the stored followers and all others together from what shorter contexts predict.
    """
    units, x = gathered(table)
    _, same, first = numbered(x["key"])
    n = x["n"][first]
    total, pairs, gain, share = (np.bincount(same, weights=x[c]) for c in ("total", "pairs", "gain", "share"))  # whole numbers below 2**53
    rest = n - total
    gain = gain / MICRO + np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / (n * np.maximum(1 - share / PICO, 1 / PICO))), 0.0)
    kept = (pairs > 0) & (gain > tree.penalty * pairs * np.log(n))
    total, pairs = (np.where(kept, w, 0).astype(np.int64)[same] for w in (total, pairs))
    return sent([(u, kind, bucket, packed({"total": total[start:end], "pairs": pairs[start:end]})) for u, start, end in units])


def settled(found: DataFrame, tree: Tree) -> DataFrame:
    """What buckets make of all units' pairs and statistics, for the units: rows of SENT."""

    def run(key, table):
        kind, bucket = key[0].as_py(), key[1].as_py()
        return (stored_pairs if kind > 0 else kept_states)(table, kind, bucket, tree)

    return found.groupBy("kind", "bucket").applyInArrow(run, SENT)


def tree_scores(docs: DataFrame, held_out, tree: Tree = Tree()) -> DataFrame:
    """Score every text by a probabilistic suffix tree that is learnt from the rows where ``held_out`` is false.

    docs: doc_id, text (others are ignored); ``held_out``: a condition on its columns (null counts as false).
    Tokens are the words (runs of anything but ASCII white space, A-Z lower-cased) and one end a text; a null text is empty.
    Returns doc_id, held_out, n_tokens, n_known (tokens that training holds), train_tokens, base_score
    (log10, word frequencies plus one) and score (log10, the tree), one row for each input row. Equal rows are documents of their own and score
    alike; ties do not matter, as every frequent context is judged alone. Without training rows every
    score is 0; an empty table gives an empty result.

    Words are counted as themselves; contexts and pairs go by 64-bit hashes. Probabilities of all tokens after
    a context, unknown ones as one, add up to 1.

    Scale: what is shuffled is a unit's distinct words and pairs, packed, so a hot word or passage costs one entry a unit (``unit_bytes`` of
    text, one document at least). Pairs are only counted behind frequent contexts and where the word and its
    pair with the next shorter context are frequent enough, which loses none that could be stored. Units and buckets are bounded in size, their numbers grow with the
    corpus. Units are written to the shared folder once; a pass adds its answers there, about a byte for each pair or context asked for.
    """
    spark = docs.sparkSession
    ship(spark)
    shelf = Shelf(spark)
    held = F.coalesce(held_out, F.lit(False))
    size, trained = docs.agg(F.sum(F.octet_length("text")), F.count_if(~held)).first()
    buckets = max(1, -(-(size or 0) // tree.bucket_bytes))
    slim = docs.select(F.spark_partition_id().cast("long").alias("part"), F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), text_bytes().alias("text"))
    coded = shelf.put(units(slim, tree.unit_bytes, buckets), "units")
    words = shelf.put(word_counts(coded), "words")
    shelf.drop(rows_of="units")
    total = distinct = 0
    for r in words.where("unit = -1").toLocalIterator():  # two numbers a bucket
        more = unpacked(r.blob)["total"].tolist()
        total, distinct = total + more[0], distinct + more[1]
    corpus = Corpus(total + trained, distinct + (trained > 0), trained)
    tree = tree.at(corpus.tokens)

    states, facts = coded.where("kind = 0").select("unit", "blob"), words.where("unit >= 0")
    for k in range(1, tree.depth + 2):
        facts = facts.unionByName(shelf.put(settled(heard(states, facts, corpus, tree, k, buckets), tree), f"facts-{k}"))
        shelf.drop()

    def score(key, state: pa.Table, news: pa.Table) -> pa.Table:
        unit = Unit(state, news, corpus, tree)
        unit.stream()
        for k, level in enumerate(unit.levels(tree.depth), 1):
            unit.predict(k, level)
        out = unit.scores()
        return pa.table({"doc_id": pa.array(unit.a["doc"], mask=unit.a["none"]), "held_out": unit.a["held"], "n_tokens": out["n_tokens"], "n_known": out["n_known"],
                         "train_tokens": np.full(len(unit.a["doc"]), corpus.tokens), "base_score": out["base_score"], "score": out["score"]})

    return states.groupBy("unit").cogroup(facts.groupBy("unit")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
