"""Near-duplicate documents by MinHash with tensored banding.

A document gets two small collections of hash values, each value a band of a few minhashes. A table key
is a pair, one value of each collection, so m * m keys come from 2 * m bands: the number of minhashes is
about a square root of what independent tables need. Documents that share a key form candidate groups,
and inside a group the links are confirmed on the full shingle sets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import WordHashes, map_rows, mix64, release, shared_table, ship, text_bytes, window_hashes
from threadlens.operators.components import connected_components


@dataclass(frozen=True)
class Tensor:
    """``bands`` values in each of the two collections, ``rows`` minhashes in each value.

    Two sets of similarity s share a key with probability (1 - (1 - s**rows)**bands)**2: above 0.9998 at
    0.85 with the defaults.
    """

    width: int = 5
    bands: int = 10
    rows: int = 3
    percent: int = 85
    unit_bytes: int = 16 << 20

    def multipliers(self) -> np.ndarray:
        count = 2 * self.bands * self.rows
        return mix64(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(raw: bytes, hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a lower-cased text; the whole sequence if it is shorter."""
    words = hashes.of(raw.lower())
    if not len(words):
        return words
    if len(words) < width:
        return mix64(window_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(window_hashes(words, width))


def band_values(shingles: np.ndarray, multipliers: np.ndarray, rows: int, block: int = 8192) -> np.ndarray:
    """The values of both collections; the place of a value is part of it."""
    low = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), block):
            low = np.minimum(low, (multipliers[:, None] * shingles[None, i : i + block]).min(axis=1))
        grouped = mix64(low).reshape(-1, rows)
        value = np.arange(1, len(grouped) + 1, dtype=np.uint64)
        for k in range(rows):
            value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + grouped[:, k])
    return value


def signatures(docs: DataFrame, tensor: Tensor) -> DataFrame:
    """doc_id, t (text hash), n_shingles, set_id (128-bit digest of the set, null if empty), bands."""

    def rows(batch: pa.RecordBatch):
        import xxhash

        hashes, multipliers = WordHashes(), tensor.multipliers()
        for doc_id, t, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            s = shingle_set(raw.as_py(), hashes, tensor.width)
            if len(s):
                yield doc_id, t, len(s), xxhash.xxh3_128_digest(s.tobytes()), band_values(s, multipliers, tensor.rows).astype(np.int64)
            else:
                yield doc_id, t, 0, None, None

    slim = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), text_bytes().alias("text"))
    return map_rows(slim, rows, "doc_id long, t long, n_shingles long, set_id binary, bands array<long>")


def candidate_groups(classes: DataFrame, tensor: Tensor) -> DataFrame:
    """(id, grp): classes that are connected by shared table keys.

    A pair key can only be shared if both its values are, so values that one class has alone are dropped
    before the pairs are formed.
    """
    values = classes.select("id", F.posexplode("bands").alias("place", "value"))
    common = shared_table(values.groupBy("value").count().where("count > 1").select("value"), "common-values")
    left = values.join(common, "value", "left_semi").groupBy("id").agg(
        F.collect_list(F.when(F.col("place") < tensor.bands, F.col("value"))).alias("first"),
        F.collect_list(F.when(F.col("place") >= tensor.bands, F.col("value"))).alias("second"))
    pairs = left.select("id", F.explode("first").alias("x"), "second").select("id", "x", F.explode("second").alias("y"))
    keys = shared_table(pairs.select("id", F.xxhash64("x", "y").alias("key")), "keys")
    # a star per key: the smallest class is the centre; partial minima per task first
    centres = shared_table(keys.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("n")).where("n > 1").select("key", "centre"), "centres")
    stars = keys.join(centres, "key").where("id <> centre").select("id", "centre").distinct()
    return connected_components(stars, "id", "centre").select(F.col("node").alias("id"), F.col("component").alias("grp"))


class Forest:
    """Union-find over the documents of a unit; ``links`` are the pairs that joined two trees."""

    def __init__(self, n: int):
        self.of, self.links = np.arange(n), []

    def join(self, a: int, b: int) -> None:
        x, y = self.of[a], self.of[b]
        if x != y:
            self.of[self.of == max(x, y)] = min(x, y)
            self.links.append((a, b))


def follow_leaders(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, percent: int, forest: Forest, share: int = 16) -> None:
    """Join documents to leaders: the largest document that is still alone against all others that are.

    It goes on while a leader finds at least one in ``share`` of them; large groups of near copies are then done.
    """
    while True:
        alone = np.bincount(forest.of, minlength=len(sizes))[forest.of] == 1
        waiting = np.flatnonzero(alone)
        if len(waiting) < 2:
            return
        leader = waiting[sizes[waiting].argmax()]
        own = flat[starts[leader] : starts[leader] + sizes[leader]]
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        overlap = np.add.reduceat((own[at] == flat).astype(np.int64), starts)[waiting]
        near = waiting[100 * overlap >= percent * (sizes[waiting] + sizes[leader] - overlap)]
        for d in near[near != leader].tolist():
            forest.join(leader, d)
        if len(near) < 2 or share * len(near) < len(waiting):
            return


def links_within(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what is similar among ``sets``: a spanning forest of the similarity graph.

    Leaders come first. Then every two documents of different trees whose sizes allow the similarity are judged by their
    exact overlap if they share one of their rarest shingles: of two sets similar enough, each has to hold a common one among its
    n - ceil(n * percent / 100) + 1 rarest. Pairs within a tree are not judged, as they could not connect more.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    forest = Forest(len(sets))
    if not len(sets):
        return []
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate(sets)
    follow_leaders(flat, starts, sizes, percent, forest)
    _, number, often = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by_rarity = np.lexsort((number, often[number], owner))
    place = np.arange(len(flat)) - starts[owner]  # by_rarity keeps the owners in order
    rare = by_rarity[place < sizes[owner] + (-percent * sizes[owner] // 100) + 1]
    rare = rare[often[number[rare]] > 1]
    rare = rare[np.lexsort((sizes[owner[rare]], number[rare]))]  # postings of rare shingles, small documents first
    holder, shingle = owner[rare], number[rare]
    first = np.searchsorted(shingle, np.arange(len(often) + 1))
    mine = np.argsort(holder, kind="stable")
    bounds = np.searchsorted(holder[mine], np.arange(len(sets) + 1))
    for d in np.argsort(sizes, kind="stable").tolist():
        held = shingle[mine[bounds[d] : bounds[d + 1]]]
        if not len(held):
            continue
        others = np.unique(np.concatenate([holder[first[h] : first[h + 1]] for h in held.tolist()]))
        fits = (100 * sizes[others] >= percent * sizes[d]) & (sizes[others] <= sizes[d]) & (forest.of[others] != forest.of[d])
        for o in others[fits].tolist():
            if forest.of[o] == forest.of[d]:  # joined meanwhile
                continue
            at = np.minimum(np.searchsorted(sets[d], sets[o]), len(sets[d]) - 1)
            overlap = int((sets[d][at] == sets[o]).sum())
            if 100 * overlap >= percent * (sizes[d] + sizes[o] - overlap):
                forest.join(o, d)
    return [(int(ids[a]), int(ids[b])) for a, b in forest.links]


def confirmed_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, tensor: Tensor) -> DataFrame:
    """(a, b): links of similarity ``percent`` or more between classes, enough to connect what is linked.

    Groups are packed into units of about ``unit_bytes`` of shingle sets. A larger group is cut into parts
    by hash, and every two parts of it make a unit, so no unit outgrows a task and no pair is missed.
    """
    members = shared_table(classes.join(groups, "id").select("id", "grp", "set_id", "n_shingles", F.col("doc_id").alias("of"), F.col("t").alias("of_t")), "members")
    weight = members.groupBy("grp").agg(F.sum("n_shingles").alias("n"))
    total = weight.agg(F.sum("n")).first()[0] or 0
    bins = max(1, -(-8 * total // tensor.unit_bytes))
    parts = F.ceil(8 * F.col("n") / F.lit(tensor.unit_bytes)).cast("int")
    weight = shared_table(weight.select("grp", parts.alias("parts")), "groups")
    placed = members.join(weight, "grp").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    mates = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    placed = placed.select("id", "grp", "set_id", "of", "of_t", "parts", "part", mates.alias("mate"))
    alone = F.col("parts") == 1
    unit = [F.when(alone, F.pmod(F.xxhash64("grp"), F.lit(bins))).otherwise(F.col("grp")).alias("unit"),
            F.when(alone, 0).otherwise(F.least("part", "mate") + 1).alias("x"),
            F.when(alone, 0).otherwise(F.greatest("part", "mate") + 1).alias("y")]
    placed = shared_table(placed.select("id", "set_id", "of", "of_t", *unit), "units")
    wanted = placed.select("id", "set_id", "of", "of_t").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), text_bytes().alias("text"))
    # ``wanted`` grows with the corpus, so it is never broadcast: the same plan at every size
    texts = texts.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("t") == F.col("of_t"))).select("id", "set_id", "text")

    def full(batch: pa.RecordBatch):
        import xxhash

        hashes = WordHashes()
        for number, set_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            shingles = shingle_set(raw.as_py(), hashes, tensor.width).tobytes()
            if xxhash.xxh3_128_digest(shingles) == set_id:
                yield number, shingles

    sets = shared_table(map_rows(texts, full, "id long, shingles binary"), "sets")

    def confirm(table: pa.Table) -> pa.Table:
        first: dict[int, np.ndarray] = {}
        for number, blob in zip(table.column("id").to_pylist(), table.column("shingles")):
            if number not in first:  # repeated rows of one document
                first[number] = np.frombuffer(blob.as_py(), np.uint64)
        ids = np.array(sorted(first), np.int64)
        found = links_within(ids, [first[i] for i in ids.tolist()], tensor.percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return placed.select("unit", "x", "y", "id").join(sets, "id").groupBy("unit", "x", "y").applyInArrow(confirm, "a long, b long")


def linked(docs: DataFrame, tensor: Tensor = Tensor()) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, component_id, kept: see ``near_duplicates``."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    signed = shared_table(signatures(docs, tensor), "signatures")
    # equal sets are one class: copies count once from here on, whatever their number
    exemplar = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("e")
    classes = signed.where("set_id IS NOT NULL").groupBy("set_id").agg(
        exemplar, F.any_value("bands").alias("bands"), F.any_value("n_shingles").alias("n_shingles"))
    classes = shared_table(classes.select(F.monotonically_increasing_id().alias("id"), "set_id", "e.doc_id", "e.t", "bands", "n_shingles"), "classes")
    groups = shared_table(candidate_groups(classes, tensor), "candidate-groups")
    release(spark)
    links = shared_table(confirmed_links(docs, classes, groups, tensor), "links")
    release(spark)
    component = shared_table(connected_components(links), "components")
    known = classes.join(component, F.col("id") == F.col("node")).select("set_id", "doc_id", "component")
    smallest = known.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    alone = classes.join(component, F.col("id") == F.col("node"), "left_anti").select("set_id", F.col("doc_id").alias("smallest"))
    of_set = shared_table(known.join(smallest, "component").select("set_id", "smallest").union(alone), "smallest").withColumnRenamed("set_id", "s")
    out = signed.join(of_set, F.col("set_id") == F.col("s"), "left")
    component_id = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    return out.select("doc_id", "t", "n_shingles", component_id.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, tensor: Tensor = Tensor()) -> DataFrame:
    """Link documents whose 5-word shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    docs: doc_id, text (others are ignored). Returns doc_id, n_shingles, component_id, kept: one row for each
    input row. Words are split at ASCII white space and A-Z is lower-cased; a text with fewer than five
    words has its whole sequence as the only shingle. Null and wordless texts have no shingles, are
    linked with nothing and kept. component_id is the smallest id reachable (nulls only where there is no
    other); kept means doc_id = component_id, so repeated rows of a kept document are all kept. An empty table gives
    an empty result.

    Scale: exact copies fold into classes by partial aggregation; the tables shuffle slim (value, class)
    rows; full sets are only built for candidates and are compared in units of bounded size.
    """
    return linked(docs, tensor).drop("t")


def drop_near_duplicates(docs: DataFrame, tensor: Tensor = Tensor(bands=14, percent=80)) -> DataFrame:
    """The rows of ``docs`` that are kept, one for each document (id and text), with their columns.

    Documents of similarity 0.8 or more are linked; two of similarity 0.8 share a key with probability 0.9999. Rows repeated in
    id and text stay once; null and wordless texts are linked with nothing and stay; other columns, whatever their names, pass
    through; an empty table stays empty.
    """
    kept = linked(docs, tensor).where("kept").select(F.col("doc_id").alias("of"), F.col("t").alias("of_t")).distinct()
    packed = docs.select("doc_id", F.xxhash64("text").alias("t"), F.struct(*docs.columns).alias("row"))
    packed = packed.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("of")) & (F.col("t") == F.col("of_t")), "left_semi")
    return packed.dropDuplicates(["doc_id", "t"]).select("row.*")
