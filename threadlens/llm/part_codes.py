"""Vector code compression: parts of vectors become the numbers of their nearest codebook entries.

The distinct parts of a position form a trie, one level for each dimension. A depth-first walk carries the
distances of the path so far to all codebook entries, so vectors with a common prefix share that work; a
leaf takes the nearest entry and adds its weighted components to that entry's sums.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import map_rows, shared_table, ship
from threadlens.session import maybe_broadcast


@dataclass(frozen=True)
class Coder:
    """``parts`` codebooks of at most ``entries`` entries, moved ``rounds`` times; components are floor(scale * x).

    ``wide`` bounds a step of the walk: it holds at most ``wide`` trie nodes a level.
    """

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    wide: int = 1024


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows in lexicographic order, number of each row's distinct row)."""
    order = np.lexsort(rows.T[::-1]) if rows.shape[1] else np.arange(len(rows))
    ahead = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (ahead[1:] != ahead[:-1]).any(axis=1)
    number = np.empty(len(rows), np.int64)
    number[order] = np.cumsum(new) - 1
    return ahead[new], number


def nearest(rows: np.ndarray, book: np.ndarray, wide: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each of the distinct, sorted ``rows``; ties go to the lower entry.

    A trie node is the first row with its prefix. A step of the walk takes up to ``wide`` siblings and cousins
    of one level, adds their component's distances to those of their parents, and goes on below them before
    it turns to the next nodes of the level, so the stack holds one step for each level.
    """
    n, width = rows.shape
    entry, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n or not width:
        return entry, distance
    depart = np.zeros(n, np.int64)  # the first dimension in which a row leaves the one before it
    depart[1:] = (rows[1:] != rows[:-1]).argmax(axis=1)

    def below(level: int, start: int, end: int, parents: np.ndarray, sums: np.ndarray) -> list[tuple]:
        nodes = start + np.flatnonzero(depart[start:end] <= level)
        if len(nodes) == 0 or nodes[0] != start:
            nodes = np.concatenate([[start], nodes])
        cuts = [*range(0, len(nodes), wide), len(nodes)]
        steps = [(level, nodes[a:b], int(nodes[b]) if b < len(nodes) else end, parents, sums) for a, b in zip(cuts, cuts[1:])]
        return steps[::-1]

    stack = below(0, 0, n, np.zeros(1, np.int64), np.zeros((1, len(book)), np.int64))
    while stack:
        level, nodes, end, parents, sums = stack.pop()
        parent = np.searchsorted(parents, nodes, "right") - 1
        step = rows[nodes, level][:, None] - book[None, :, level]
        sums = sums[parent] + step * step
        if level + 1 < width:
            stack += below(level + 1, int(nodes[0]), end, nodes, sums)
        else:
            entry[nodes] = best = sums.argmin(axis=1)
            distance[nodes] = sums[np.arange(len(nodes)), best]
    return entry, distance


def whole_parts(vectors: DataFrame, coder: Coder) -> tuple[DataFrame, int]:
    """((vec_id, label, comps array<int>), length of a part) of the usable vectors, stored."""
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    clean = vectors.select("vec_id", "label", "embedding").where(F.col("embedding").isNotNull()).where(finite)
    longest = clean.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // coder.parts)
    most = min(2**30, math.isqrt(2**60 // max(1, width * coder.parts)))  # no distance outgrows a long
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), x.cast("double") * coder.scale))).cast("int"))
    padded = F.concat(whole, F.array_repeat(F.lit(0), F.lit(width * coder.parts) - F.size("embedding")))
    return shared_table(clean.select("vec_id", "label", padded.alias("comps")), "vectors"), width


def first_books(whole: DataFrame, width: int, coder: Coder) -> np.ndarray:
    """The parts of the vectors with the smallest ids, as codebooks (parts, entries, width)."""
    ids = [r.vec_id for r in whole.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(coder.entries).collect()]
    known = [i for i in ids if i is not None]
    near = F.col("vec_id") <= F.lit(max(known, default=None)) if known else F.lit(False)
    if None in ids:
        near = near | F.col("vec_id").isNull()
    seeds = whole.where(near).groupBy("vec_id").agg(F.min("comps").alias("comps"))
    rows = [r.comps for r in seeds.orderBy(F.col("vec_id").asc_nulls_last()).collect()]  # at most ``entries`` rows
    return np.array(rows, np.int64).reshape(len(rows), coder.parts, width).transpose(1, 0, 2)


def entry_sums(parts: DataFrame, books: np.ndarray, coder: Coder) -> DataFrame:
    """(pos, entry, n, sums) for each task: how often its parts chose an entry, and their sums."""
    count, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((count, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            pos, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            comps = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(pos), width)
            for p in range(count):
                rows, number = distinct_rows(comps[pos == p])
                times = np.zeros(len(rows), np.int64)
                np.add.at(times, number, weight[pos == p])
                entry, _ = nearest(rows, books[p], coder.wide)
                np.add.at(n[p], entry, times)
                np.add.at(sums[p], entry, rows * times[:, None])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))],
            ["pos", "entry", "n", "sums"])

    return parts.mapInArrow(run, "pos int, entry int, n long, sums array<long>")


def moved(parts: DataFrame, books: np.ndarray, coder: Coder) -> np.ndarray:
    """Codebooks whose entries are the floored means of the parts nearest to them; unused entries stay."""
    width = books.shape[2]
    total = F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]) if width else F.array()
    found = entry_sums(parts, books, coder).groupBy("pos", "entry").agg(F.sum("n").alias("n"), total.alias("sums"))
    out = books.copy()
    for r in found.collect():  # at most parts * entries rows: the codebooks themselves
        out[r.pos, r.entry] = [s // r.n for s in r.sums]
    return out


def coded(whole: DataFrame, books: np.ndarray, coder: Coder) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    count, _, width = books.shape
    fields = {f.name: f.dataType.simpleString() for f in whole.schema}
    digits = max(2, len(f"{coder.entries - 1:x}"))

    def rows(batch: pa.RecordBatch):
        n = batch.num_rows
        comps = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, count, width)
        codes, error = np.zeros((n, count), np.int64), np.zeros(n, np.int64)
        for p in range(count):
            distinct, number = distinct_rows(comps[:, p])
            entry, distance = nearest(distinct, books[p], coder.wide)
            codes[:, p] = entry[number]
            error += distance[number]
        text = ["".join(f"{c:0{digits}x}" for c in row) for row in codes.tolist()]
        return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text, error.tolist())

    return map_rows(whole, rows, f"vec_id {fields['vec_id']}, label {fields['label']}, code string, error long")


def compress(vectors: DataFrame, coder: Coder = Coder()) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error, label_error), codebooks) of ``vectors``: vec_id, embedding, label (others are ignored).

    A component x becomes floor(scale * x); vectors are cut into ``parts`` equal parts. Entry i of a codebook
    starts as that part of the i-th smallest vec_id; ``rounds`` times every part goes to its nearest entry
    (squared Euclidean distance, ties to the lower entry) and every used entry to the floored mean of its parts.
    code: the nearest entries in the end, two hex digits each; error: the sum of their distances; label_error: the
    errors summed over equal labels (nulls together; the largest long where the sum outgrows it).

    Rows whose vector is null or holds a null or non-finite component are left out. Vectors shorter than the longest, or a
    length that ``parts`` does not divide, are filled up with zeros. Components are kept within the range in which no distance
    outgrows a long (+-2**27 at 64 dimensions). Repeated rows are all coded and all weigh; a
    repeated vec_id starts one entry, with its smallest vector; a null vec_id counts as the largest. Fewer ids
    than ``entries`` give shorter codebooks; an empty table gives an empty result and empty codebooks.

    Scale: equal parts fold into one weighted row by one aggregation, then lie in lexicographic order over range partitions, so a
    task's trie shares long prefixes. A round reads them once and sends at most parts * entries rows of sums a
    task; only the codebooks (bounded by parameters) pass through the driver.
    """
    ship(vectors.sparkSession)
    whole, width = whole_parts(vectors, coder)
    books = first_books(whole, width, coder)
    cut = F.posexplode(F.array(*[F.slice("comps", i * width + 1, width) for i in range(coder.parts)])).alias("pos", "part")
    parts = whole.select(cut).groupBy("pos", "part").agg(F.count("*").alias("weight"))
    parts = shared_table(parts.repartitionByRange("pos", "part").sortWithinPartitions("pos", "part"), "parts")
    for _ in range(coder.rounds if books.shape[1] else 0):
        books = moved(parts, books, coder)
    codes = shared_table(coded(whole, books, coder), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    labels = maybe_broadcast(shared_table(codes.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "labels"))
    return codes.join(labels, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimals by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
