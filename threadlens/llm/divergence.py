"""Source divergence audit with hash-consed segment trees over term ids.

Every group (a language and a source) is a segment tree over the language's kept terms, whose leaves are
its counts. Equal subtrees are one node, whoever holds them: all the stretches of terms that a group never uses are a
few nodes. Two trees are priced by walking both at once; a pair of nodes met before is not walked again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm.common import shared_table, ship
from threadlens.llm.tokens import TERMS, slices, tokens
from threadlens.session import maybe_broadcast

SCALE_STEPS = (1000, 1000, 1000)  # their product is the scale of probabilities, 10**9


def shares(counts: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / size), exactly: long division in steps that fit 64 bits."""
    whole, rest = np.divmod(counts.astype(np.int64) + 1, size)
    for step in SCALE_STEPS:
        more, rest = np.divmod(rest * step, size)
        whole = whole * step + more
    return whole + 1


def prices(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Trees:
    """Segment trees of several groups over the same terms; a level's nodes are numbered by content.

    ``left[k]`` and ``right[k]`` are the children (nodes of level k) of the nodes of level k + 1; nodes of
    level 0 are the distinct counts in ``leaves``; ``roots`` has one node of the top level for each group.
    """

    def __init__(self, counts: np.ndarray):
        self.leaves, nodes = np.unique(counts, return_inverse=True)
        nodes = nodes.reshape(counts.shape)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        while nodes.shape[1] > 1:
            most = int(nodes.max()) + 1
            pair = nodes[:, 0::2] * most + nodes[:, 1::2]
            known, inverse = np.unique(pair, return_inverse=True)  # hash-consing: equal pairs are one node
            self.left.append(known // most)
            self.right.append(known % most)
            nodes = inverse.reshape(pair.shape)
        self.roots = nodes[:, 0]

    def price(self, group: int, others: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of prices over all terms: of ``group`` against each of ``others``, and of each against it.

        ``sizes``: denominators by group. The walk goes down level by level with the distinct (denominator,
        node, node) triples, prices each pair of leaves once, and adds up on the way back.
        """
        own = np.unique(sizes[others])
        kind, a, b = np.searchsorted(own, sizes[others]), np.full(len(others), self.roots[group]), self.roots[others]
        met, path = (kind, a, b), []
        for left, right in [(None, None), *reversed(list(zip(self.left, self.right)))]:
            kind, a, b = met
            if left is not None:
                kind, a, b = np.tile(kind, 2), np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]])
            most = int(max(a.max(), b.max())) + 1
            key, seen = np.unique((kind * most + a) * most + b, return_inverse=True)  # pairs met before share one entry
            met = key // most // most, key // most % most, key % most
            path.append(seen)
        kind, a, b = met
        p, q = shares(self.leaves[a], sizes[group]), shares(self.leaves[b], own[kind])
        there, here = prices(p, q), prices(q, p)
        for seen in path[:0:-1]:
            there, here = (x[seen].reshape(2, -1).sum(axis=0) for x in (there, here))
        return there[path[0]], here[path[0]]


def numbered(names: pa.Array) -> tuple[pa.Array, np.ndarray]:
    coded = names.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def term_counts(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """(lang, term, df, sources, counts) of slices of the documents: lists of the slice's sources and their counts."""
    out = pa.schema([("lang", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for start, end in slices([len(t) for t in texts], batch_bytes):
                owner, number, distinct = tokens(texts[start:end], TERMS)
                if not len(owner):
                    continue
                (langs, lang), (sources, source) = (numbered(batch.column(i).slice(start, end - start)) for i in (0, 1))
                key, times = np.unique((lang[owner] * len(distinct) + number) * (end - start) + owner, return_counts=True)
                term, doc = np.divmod(key, end - start)  # one row for each term of a document; term carries the language
                order = np.argsort(term * len(sources) + source[doc], kind="stable")
                term, held, times = term[order], source[doc[order]], times[order]
                new = np.ones(len(term), bool)
                new[1:] = (term[1:] != term[:-1]) | (held[1:] != held[:-1])
                at = np.flatnonzero(new)
                by_source = np.add.reduceat(times, at)
                term_at, first = np.unique(term, return_index=True)
                df = np.diff(np.append(first, len(term)))
                ends = np.append(np.searchsorted(at, first), len(at)).astype(np.int32)
                arrays = [langs.take(pa.array(term_at // len(distinct))), distinct.take(pa.array(term_at % len(distinct))).cast(pa.string()), pa.array(df),
                          pa.ListArray.from_arrays(ends, sources.take(pa.array(held[at]))), pa.ListArray.from_arrays(ends, pa.array(by_source.astype(np.int64)))]
                for i in range(0, len(term_at), 16384):
                    yield pa.RecordBatch.from_arrays([x.slice(i, 16384) for x in arrays], schema=out)

    return docs.mapInArrow(run, "lang string, term string, df long, sources array<string>, counts array<long>")


def divergences(docs: DataFrame, least_docs: int = 3, best: int = 200, batch_bytes: int = 16 << 20, cells: int = 1 << 20) -> DataFrame:
    """How the sources of a language differ in their use of terms.

    docs: text, lang, source (others are ignored; nulls count as ''). Terms are runs of ASCII letters and characters beyond ASCII, only
    A-Z lower-cased. A language keeps the terms of at least ``least_docs`` of its documents. A group is an occurring (lang,
    source); with n occurrences of a term among N of kept terms, V kept, its share is p = 1 + floor(10**9 (n + 1) / (N + V)), and p against q
    is floor((p - q)**2 / q). Returns lang, source, part, item, value, rank:

    * part 'pair': every other source of the language, valued by the sum over all kept terms (0 without any);
    * part 'term': the group's terms whose share is above the language's, the ``best`` highest values.

    Ranks start from 1, values descending, then items in UTF-8 order. Repeated rows are documents of their own. Texts without terms
    still make their group; an empty table gives an empty result. A sum of counts may reach 9 * 10**15.

    Scale: tasks send one row for each term of a slice, so a hot term or source costs a row a slice; rare terms go before
    anything is joined. Kept terms are dealt by hash into blocks of at most ``cells`` counts, a block's trees live in one
    task, and the prices of blocks add up. A term list is cut to ``best`` in every block and again in every task before it meets.
    """
    ship(docs.sparkSession)
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counted = term_counts(named, batch_bytes).withColumn("docs", F.sum("df").over(Window.partitionBy("lang", "term"))).where(F.col("docs") >= least_docs)
    single = counted.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("c"))
    single = single.groupBy("lang", "term", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    kept = shared_table(single.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("uses")), "kept-terms")

    sizes = kept.select("lang", F.explode("uses").alias("u")).groupBy("lang", F.col("u.source").alias("source")).agg(F.sum("u.n").alias("n"))
    groups = named.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    groups = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups"))
    groups = groups.join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    room = F.greatest(F.lit(64), F.least(F.lit(8192), F.floor(F.lit(cells) / F.size("groups"))))
    groups = shared_table(groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / room)).cast("int")), "groups")

    dealt = kept.join(maybe_broadcast(groups.select("lang", "blocks")), "lang")
    dealt = dealt.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "term", "uses")
    about = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "groups", "v")

    def price(key, terms: pa.Table, groups: pa.Table) -> pa.Table:
        (known,), (v,) = groups.column("groups").to_pylist(), groups.column("v").to_pylist()
        lang, names = key[0].as_py(), [g["source"] for g in known]
        sizes = np.array([g["n"] for g in known], np.int64) + v
        rows = list(zip(terms.column("term").to_pylist(), terms.column("uses").to_pylist()))
        # terms in order of use, so that stretches without uses are long
        rows.sort(key=lambda r: (-sum(u["n"] for u in r[1]), r[0].encode()))
        place = {s: i for i, s in enumerate(names)}
        # filled up to a whole tree with counts of -1, whose share is 1 in every group, so they cost nothing
        counts = np.full((len(names), 1 << max(0, len(rows) - 1).bit_length()), -1, np.int64)
        counts[:, : len(rows)] = 0
        for t, (_, uses) in enumerate(rows):
            for u in uses:
                counts[place[u["source"]], t] = u["n"]
        total = np.zeros((len(names), len(names)), np.int64)
        if rows:
            trees = Trees(counts)
            for g in range(len(names) - 1):
                total[g, g + 1 :], total[g + 1 :, g] = trees.price(g, np.arange(g + 1, len(names)), sizes)
        found: list[tuple[str, str, str, int]] = []
        found += [(a, "pair", b, int(total[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i != j]
        if rows:
            all_sizes = int(sizes.sum()) - v * (len(names) - 1)
            counts = counts[:, : len(rows)]
            q = shares(counts.sum(axis=0), all_sizes)
            for g, a in enumerate(names):
                used = np.flatnonzero(counts[g])
                p = shares(counts[g, used], sizes[g])
                used, p = used[p > q[used]], p[p > q[used]]
                value = prices(p, q[used])
                if len(used) > best:
                    least = np.partition(value, len(value) - best)[len(value) - best]
                    used, value = used[value >= least], value[value >= least]
                mine = sorted(zip((-value).tolist(), [rows[t][0] for t in used]), key=lambda x: (x[0], x[1].encode()))[:best]
                found += [(a, "term", t, -x) for x, t in mine]
        return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "source": pa.array([f[0] for f in found], pa.string()),
                         "part": pa.array([f[1] for f in found], pa.string()), "item": pa.array([f[2] for f in found], pa.string()),
                         "value": pa.array([f[3] for f in found], pa.int64())})

    priced = dealt.groupBy("lang", "block").cogroup(about.groupBy("lang", "block")).applyInArrow(price, "lang string, source string, part string, item string, value long")
    priced = shared_table(priced, "prices")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = priced.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = priced.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
