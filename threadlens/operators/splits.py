"""Label distributions and group-disjoint / stratified splits.

Row-level work is one pre-aggregation per group; the combinatorial split search runs on the small
group table, with the sets of groups as distributed rows (no driver recursion).
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlens.functions.common import md5_uniform, place_in_order
from threadlens.session import materialize_small, maybe_broadcast, write_shared

FLOAT_EPS = 2.220446049250313e-16  # numpy float64 eps, floor of the MAPE denominator


def label_distribution(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """A1: value counts of each label, as counts and % of rows (one unpivot + one aggregation)."""
    long = df.select(*[F.col(c).cast("int").alias(c) for c in labels]).unpivot([], list(labels), "label", "value")
    counts = long.groupBy("label", "value").count()
    total = F.sum("count").over(Window.partitionBy("label"))
    return counts.withColumn("pct", F.col("count") / total * 100)


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """A2: rows per group."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))


def n_groups(df: DataFrame, group: str) -> DataFrame:
    """A2: number of distinct groups."""
    return df.agg(F.count_distinct(group).alias("n_groups"))


def group_share(df: DataFrame, split: str, group: str) -> DataFrame:
    """A2: % of all rows per (split, group), with per-split and grand totals via ``rollup``."""
    r = df.rollup(split, group).agg(F.count(F.lit(1)).alias("n"))
    return r.withColumn("pct", F.col("n") / F.lit(df.count()) * 100)


def split_balance(df: DataFrame, labels: Sequence[str], split: str) -> DataFrame:
    """A3: per label and split, ``count(label=1) / count(label=0) * 100`` (odds in %, 0 when empty)."""
    long = df.select(split, *[F.col(c).cast("int").alias(c) for c in labels]).unpivot([split], list(labels), "label", "value")
    g = long.groupBy("label", split).agg(F.count_if(F.col("value") == 1).alias("n1"),
                                         F.count_if(F.col("value") == 0).alias("n0"))
    return g.withColumn("ratio", F.when(F.col("n0") > 0, F.col("n1") / F.col("n0") * 100).otherwise(F.lit(0.0)))


def group_value_counts(df: DataFrame, group: str, column: str) -> DataFrame:
    """A4: counts of the values of ``column`` inside each group."""
    return df.groupBy(group, column).count()


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """A5: balanced class weights ``n / (k * n_c)``."""
    c = df.groupBy(y).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    return c.withColumn("weight", F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c")))


def ordered_groups(sizes: DataFrame, group: str, exclude_smallest: int = 0) -> DataFrame:
    """Group listing order for the split search: ascending size, ties by id; optionally drop the smallest."""
    ranked = place_in_order(sizes, "rank", F.col("size").asc(), F.col(group).asc())
    return ranked.where(F.col("rank") > exclude_smallest).withColumn("rank", F.col("rank") - F.lit(exclude_smallest))


def share_bounds(full: int, ratio: float, eps: float) -> tuple[int, int]:
    """(least, most): the whole sizes whose share of ``full`` is at least ``ratio`` and at most ``ratio + eps``, as doubles compare."""
    least, most = int(ratio * full), int((ratio + eps) * full)
    while least > 0 and (least - 1) / full >= ratio:
        least -= 1
    while least / full < ratio:
        least += 1
    while (most + 1) / full <= ratio + eps:
        most += 1
    while most >= 0 and most / full > ratio + eps:
        most -= 1
    return least, most


def subset_sums(spark: SparkSession, sizes: Sequence[int], most: int, block: int = 8) -> DataFrame:
    """(mask, sz, last) of every subset of ``sizes`` with a sum of at most ``most``: bits of its members, sum, size of its last member.

    A block of sizes at a time: sets are exploded by the block's own subsets and those above ``most`` go at
    once, so the work follows the sets that are left, in one narrow plan that is dealt over the cores once it has rows.
    """
    out = spark.range(1).select(*[F.lit(0).cast("long").alias(c) for c in ("mask", "sz", "last")])
    for start in range(0, len(sizes), block):
        part = [int(x) for x in sizes[start : start + block]]
        sums = [sum(x for i, x in enumerate(part) if m >> i & 1) for m in range(1 << len(part))]
        lasts = [part[m.bit_length() - 1] if m else 0 for m in range(1 << len(part))]
        array = lambda xs: F.expr("array(" + ",".join(f"{x}L" for x in xs) + ")")
        grown = out.select("mask", "sz", "last", F.posexplode(array(sums)).alias("own", "more")).where(F.col("sz") + F.col("more") <= most)
        out = grown.select(F.col("mask").bitwiseOR(F.shiftleft(F.col("own").cast("long"), start)).alias("mask"), (F.col("sz") + F.col("more")).alias("sz"),
                           F.when(F.col("own") > 0, F.element_at(array(lasts), F.col("own") + 1)).otherwise(F.col("last")).alias("last"))
        if start == block:
            out = out.repartition(spark.sparkContext.defaultParallelism)
    return out


def middle(sizes: Sequence[int], most: int, bins: int = 512) -> int:
    """Where to cut ``sizes`` so that both parts have about equally many subsets of at most ``most`` (estimated on a coarse scale)."""

    def counts(xs: Sequence[int]) -> list[float]:
        held = [1.0] + [0.0] * bins
        out = [1.0]
        for x in xs:
            step = round(x * bins / max(1, most))
            held = [h + (held[i - step] if i >= step else 0.0) for i, h in enumerate(held)]
            out.append(sum(held))
        return out

    below, above = counts(sizes), counts(sizes[::-1])[::-1]
    return min(range(len(sizes) + 1), key=lambda h: max(below[h], above[h]))


def meet_in_the_middle(spark: SparkSession, sizes: Sequence[int], ids: Sequence, kind: str, least: int, most: int, most_alone: int) -> DataFrame:
    """(members, sz) of all sets that pass ``least`` with their last member and stay at most ``most`` (sets of one: ``most_alone``).

    The sets of the later part say which sums of the earlier part complete them: a short range, joined by the
    bins that it touches.
    """
    top = max(most, most_alone)
    cut = min(max(middle(sizes, top), len(sizes) - 62), 62)
    low, high = subset_sums(spark, sizes[:cut], top), subset_sums(spark, sizes[cut:], top)
    reach = sum(sizes[:cut])
    width = max(1, top - least + 1)
    start = F.greatest(F.lit(0), F.lit(least) - F.col("sz"))
    end = F.least(F.lit(top) - F.col("sz"), F.lit(least - 1) - F.col("sz") + F.col("last"))  # without the last member: below ``least``
    high = high.where(F.col("mask") != 0).select(F.col("mask").alias("upper"), F.col("sz").alias("above"), start.alias("start"), end.alias("end"))
    high = high.where((F.col("start") <= F.col("end")) & (F.col("start") <= reach))
    high = high.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    both = low.select("mask", "sz", F.floor(F.col("sz") / width).alias("bin")).join(high, "bin").where((F.col("sz") >= F.col("start")) & (F.col("sz") <= F.col("end")))
    found = both.select("mask", "upper", (F.col("sz") + F.col("above")).alias("sz")).unionByName(
        low.where((F.col("sz") >= least) & (F.col("sz") - F.col("last") < least)).select("mask", F.lit(0).cast("long").alias("upper"), "sz"))
    alone = F.bit_count("mask") + F.bit_count("upper") == 1
    found = found.where(F.col("sz") <= F.when(alone, most_alone).otherwise(most))

    def members(mask: Column, part: Sequence) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.lit(len(part) - 1)), lambda i: F.call_function("getbit", mask, i) == 1) if len(part) else F.array().cast("array<int>")
        return F.transform(at, lambda i: F.element_at(F.array(*[F.lit(x).cast(kind) for x in part]), i + 1)) if len(part) else F.array().cast(f"array<{kind}>")

    return found.select(F.concat(members(F.col("mask"), ids[:cut]), members(F.col("upper"), ids[cut:])).alias("members"), "sz")


def candidate_group_splits(groups: DataFrame, group: str, ratio: float, eps: float, nested_eps: float = 0.02, most_groups: int = 124) -> DataFrame:
    """M1: every set of groups, in listing order, whose share first reaches ``ratio`` with its last member.

    ``share(without last) < ratio <= share(all) <= ratio + e`` with ``e = eps`` for single groups and
    ``nested_eps`` deeper (the reference's recursion default). Shares are relative to the listed groups. Groups too large for
    any set are left out first. Up to ``most_groups`` of them, the search is a join of the subsets of two halves (half the
    exponent in the number of groups); beyond, sets grow by one group a round, and only those that can still arrive are kept:
    what comes later has to suffice, and the next group has to fit. The result itself may be exponential.
    """
    spark = groups.sparkSession
    g = write_shared(groups.select("rank", F.col(group).alias("gid"), F.col("size").cast("long").alias("gsize")), "groups")
    full = g.agg(F.sum("gsize")).first()[0] or 0
    if full:
        (least, most), (_, most_alone) = share_bounds(full, ratio, nested_eps), share_bounds(full, ratio, eps)
        fit = g.where(F.col("gsize") <= max(most, most_alone))
        few = fit.orderBy("rank").limit(most_groups + 1).collect()  # at most ``most_groups`` + 1 rows
        if len(few) <= most_groups:
            out = meet_in_the_middle(spark, [r.gsize for r in few], [r.gid for r in few], g.schema["gid"].dataType.simpleString(), least, most, most_alone)
        else:
            out = growing_sets(fit, least, most, most_alone)
    else:
        out = g.select(F.array("gid").alias("members"), F.col("gsize").alias("sz")).limit(0)
    return out.select(F.array_join(F.col("members").cast("array<string>"), ",").alias("candidate"), "members",
                      F.col("sz").alias("size"), (F.col("sz") / F.lit(float(full))).alias("share"))


def growing_sets(fit: DataFrame, least: int, most: int, most_alone: int) -> DataFrame:
    """(members, sz) like ``meet_in_the_middle`` for any number of groups: one join by rank a round, each round written."""
    order = Window.orderBy("rank")  # the group table only
    g = write_shared(fit.select(F.row_number().over(order).alias("rank"), "gid", "gsize", F.coalesce(F.lead("gsize").over(order), F.lit(most + 1)).alias("next"),
                                (F.sum("gsize").over(Window.partitionBy()) - F.sum("gsize").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("later")), "groups")
    n, gb = g.count(), maybe_broadcast(g)
    frontier = gb.select(F.array("gid").alias("members"), F.col("rank").alias("last"), F.col("gsize").alias("sz"), F.lit(1).alias("depth"), "next", "later")
    results = []
    while True:
        limit = F.when(F.col("depth") == 1, F.lit(most_alone)).otherwise(F.lit(most))
        frontier = write_shared(frontier, "frontier")
        results.append(frontier.where((F.col("sz") >= least) & (F.col("sz") <= limit)).select("members", "sz"))
        open_sets = frontier.where((F.col("sz") < least) & (F.col("sz") + F.col("later") >= least) & (F.col("sz") + F.col("next") <= most))
        if open_sets.isEmpty():
            break
        nxt = open_sets.select("members", "sz", "depth", F.explode(F.sequence(F.col("last") + 1, F.lit(n))).alias("rank")).join(gb, "rank")
        frontier = nxt.where(F.col("sz") + F.col("gsize") <= most).select(
            F.concat("members", F.array("gid")).alias("members"), F.col("rank").alias("last"), (F.col("sz") + F.col("gsize")).alias("sz"),
            (F.col("depth") + 1).alias("depth"), "next", "later")
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def group_label_sums(df: DataFrame, group: str, labels: Sequence[str]) -> DataFrame:
    """Per group: row count and label sums (the only pass over the rows)."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c)).alias(c) for c in labels])


def score_group_splits(df: DataFrame, candidates: DataFrame, group: str, labels: Sequence[str]) -> DataFrame:
    """M2: % of each label inside every candidate, MSE and MAPE against the whole set.

    Label sums are pre-aggregated per group once; candidates are exploded to members and joined to
    that small table. MAPE = mean |cand - objective| / max(|cand|, eps) over the labels;
    ``mape_legacy`` also averages the reference's extra MSE term, (L*MAPE + 1) / (L + 1).
    """
    sums = write_shared(group_label_sums(df, group, labels), "label-sums")
    # objective: label shares of the whole set, a handful of scalars read once on the driver
    tot = sums.agg(F.sum("_n").alias("_N"), *[F.sum(c).alias("_t_" + c) for c in labels]).first()
    members = candidates.select("candidate", F.explode("members").alias(group))
    j = members.join(maybe_broadcast(sums), group).groupBy("candidate").agg(
        F.sum("_n").alias("_n"), *[F.sum(c).alias(c) for c in labels])
    pct = {c: F.col(c) * 100.0 / F.col("_n") for c in labels}
    obj = {c: F.lit(float(tot["_t_" + c]) * 100.0 / float(tot["_N"])) for c in labels}
    L = len(labels)
    mse = sum((F.pow(pct[c] - obj[c], 2) for c in labels), F.lit(0.0)) / L
    mape = sum((F.abs(pct[c] - obj[c]) / F.greatest(F.abs(pct[c]), F.lit(FLOAT_EPS)) for c in labels), F.lit(0.0)) / L
    out = j.select("candidate", *[pct[c].alias(c) for c in labels], mse.alias("MSE"), mape.alias("MAPE"))
    return out.withColumn("mape_legacy", (F.col("MAPE") * L + 1) / (L + 1))


def rank_splits(scores: DataFrame, by: str = "MAPE", k: int = 5) -> DataFrame:
    """O1: the k best candidates by MSE or MAPE (ties by candidate id); a top-k, so ``limit`` is the feature."""
    return scores.orderBy(F.col(by).asc(), F.col("candidate").asc()).limit(k)


def split_by_groups(df: DataFrame, group: str, chosen: DataFrame, inside: bool = True) -> DataFrame:
    """Rows whose group is (or is not) among the chosen groups (semi / anti join)."""
    return df.join(chosen.select(group).distinct(), group, "left_semi" if inside else "left_anti")


def best_candidate_groups(scores: DataFrame, candidates: DataFrame, group: str, by: str = "MAPE") -> DataFrame:
    """Members of the single best candidate (lowest ``by``, ties by candidate id) as a group table."""
    best = rank_splits(scores, by, 1).select("candidate")
    return candidates.join(best, "candidate").select(F.explode("members").alias(group))


def group_disjoint_split(df: DataFrame, group: str, labels: Sequence[str], test_ratio: float = 0.2,
                         val_ratio: float = 0.125, eps: float = 0.01, exclude_smallest: int = 0,
                         nested_eps: float = 0.02) -> DataFrame:
    """M3: search test groups (optionally without the smallest groups), then val groups in the rest;
    rows get ``split`` = train / val / test. Groups never straddle splits."""
    sizes = group_sizes(df, group)
    test_groups_tbl = ordered_groups(sizes, group, exclude_smallest)
    cands = write_shared(candidate_group_splits(test_groups_tbl, group, test_ratio, eps, nested_eps), "candidates")
    test = write_shared(best_candidate_groups(score_group_splits(df, cands, group, labels), cands, group), "test-groups")
    rest = split_by_groups(df, group, test, inside=False)
    val_tbl = ordered_groups(group_sizes(rest, group), group)
    vcands = write_shared(candidate_group_splits(val_tbl, group, val_ratio, eps, nested_eps), "candidates")
    val = best_candidate_groups(score_group_splits(rest, vcands, group, labels), vcands, group)
    tagged = (test.withColumn("split", F.lit("test"))).unionByName(val.withColumn("split", F.lit("val")))
    out = df.join(tagged, group, "left")
    return out.withColumn("split", F.coalesce(F.col("split"), F.lit("train")))


def exact_rank(df: DataFrame, partition: Sequence[str], u: str, tiebreak: Sequence[str], bucket_rows: int = 100_000) -> DataFrame:
    """Exact 1-based rank of rows by ``u`` (uniform in [0,1)) within ``partition``, skew-safe.

    Partitions are split by ``floor(u * buckets)``, with as many buckets as leave about ``bucket_rows`` rows
    of the largest in each; per-bucket counts give the offsets, so no task sorts a whole hot key.
    """
    largest = df.groupBy(*partition).count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-largest // bucket_rows))
    b = F.least(F.floor(F.col(u) * buckets), F.lit(buckets - 1)).cast("int")
    x = df.withColumn("_b", b)
    counts = x.groupBy(*partition, "_b").agg(F.count(F.lit(1)).alias("_c"))
    wp = Window.partitionBy(*partition).orderBy("_b")
    offs = counts.select(*partition, "_b", F.coalesce(F.sum("_c").over(wp.rowsBetween(Window.unboundedPreceding, -1)),
                                                        F.lit(0)).alias("_off"),
                         F.sum("_c").over(Window.partitionBy(*partition)).alias("_size"))
    j = x.join(materialize_small(offs), [*partition, "_b"])
    w = Window.partitionBy(*partition, "_b").orderBy(F.col(u), *[F.col(c) for c in tiebreak])
    return j.withColumn("_rank", F.col("_off") + F.row_number().over(w)).drop("_b", "_off")


def stratified_split(df: DataFrame, key: Sequence[str], labels: Sequence[str], test_ratio: float = 0.2,
                     val_ratio: float | None = None, seed: int = 42, min_stratum: int = 2) -> DataFrame:
    """M4: stratified split on label combinations, reproducible by md5 of the key and seed.

    Code 0 = train, 1 = val, 2 = test (1 = test when there is no val). Within a stratum of n rows
    ranked by md5-uniform, the first ``round(n * test)`` go to test, the next
    ``round((n - n_test) * val / (1 - test))`` to val. Strata smaller than ``min_stratum`` are pooled.
    """
    combo = F.concat_ws("", *[F.col(c).cast("string") for c in labels])
    x = df.withColumn("_combo", combo).withColumn("_u", md5_uniform(*key, F.lit(seed)))
    size = x.groupBy("_combo").agg(F.count(F.lit(1)).alias("_cn"))
    x = x.join(materialize_small(size), "_combo").withColumn(
        "_combo", F.when(F.col("_cn") < min_stratum, F.lit("rare")).otherwise(F.col("_combo"))).drop("_cn")
    r = exact_rank(x, ["_combo"], "_u", list(key))
    n = F.col("_size")
    n_test = F.bround(n * test_ratio, 0)
    code_test = 2 if val_ratio else 1
    if val_ratio:
        n_val = F.bround((n - n_test) * (val_ratio / (1 - test_ratio)), 0)
        code = F.when(F.col("_rank") <= n_test, code_test).when(F.col("_rank") <= n_test + n_val, 1).otherwise(0)
    else:
        code = F.when(F.col("_rank") <= n_test, code_test).otherwise(0)
    return r.withColumn("split", code.cast("int")).drop("_combo", "_u", "_rank", "_size")


def fold_quotas(combos: Sequence[tuple[tuple[int, ...], int]], ratios: Sequence[float], single: int = 100_000, tries: int = 32) -> list[list[int]]:
    """How many rows of each label combination go to each fold, by order-2 iterative stratification.

    ``combos``: (labels that are 1, rows). Of up to ``tries`` deals that differ in how ties are broken (seeded, so reruns agree; fewer where
    there are many rows to deal) the one counts whose worst pair is nearest to its share.
    """
    steps = sum(min(n, max(len(ratios), single // max(1, len(combos)))) for _, n in combos)
    deals = [dealt_quotas(combos, ratios, single, seed) for seed in range(max(1, min(tries, single // max(1, steps))))]
    return min(deals, key=lambda d: d[0])[1]


def dealt_quotas(combos: Sequence[tuple[tuple[int, ...], int]], ratios: Sequence[float], single: int, seed: int, passes: int = 50) -> tuple[tuple, list[list[int]]]:
    """((worst distance of a pair from its share, sum of eighth powers), quotas) of one deal.

    Rows are dealt one by one: the label pair (or single label) with the fewest rows left comes
    first, and a row goes to the fold that lacks that pair most, then rows at all, then by chance. Of frequent
    combinations only a reserve is dealt like this (``single`` rows of all combinations together); the rest of their rows go to the
    folds by their ratios first, which moves all that a fold lacks alike. In the end the pair that is farthest from its share is
    mended by moving one of its rows, or exchanging it for another row, where that helps on the whole; at most ``passes`` times.
    """
    chance = random.Random(seed)
    reserve = max(len(ratios), single // max(1, len(combos)))
    folds = range(len(ratios))
    pairs = [[(a, b) for i, a in enumerate(on) for b in on[i:]] for on, _ in combos]
    size: dict = {}
    for mine, (_, n) in zip(pairs, combos):
        for p in mine:
            size[p] = size.get(p, 0) + n
    lacks = {p: [r * n for r in ratios] for p, n in size.items()}
    missing = [r * sum(n for _, n in combos) for r in ratios]
    quotas = []
    left, holders = [], {p: [] for p in size}
    for c, (mine, (_, n)) in enumerate(zip(pairs, combos)):
        quotas.append([int(r * max(0, n - reserve)) for r in ratios])
        left.append(n - sum(quotas[c]))
        for f in folds:
            missing[f] -= quotas[c][f]
            for p in mine:
                lacks[p][f] -= quotas[c][f]
        for p in mine:
            holders[p].append(c)

    def deal(c: int, first: tuple | None) -> None:
        f = max(folds, key=lambda f: (round(lacks[first][f], 6) if first else 0, round(missing[f], 6), chance.random()))
        quotas[c][f] += 1
        left[c] -= 1
        missing[f] -= 1
        for p in pairs[c]:
            lacks[p][f] -= 1

    while any(waiting := {p: n for p, cs in holders.items() if (n := sum(left[c] for c in cs))}):
        rarest = min(waiting, key=lambda p: (waiting[p], p))
        rows = [c for c in holders[rarest] for _ in range(left[c])]
        chance.shuffle(rows)
        for c in rows:
            deal(c, rarest)
    for c in range(len(combos)):  # rows without labels
        while left[c]:
            deal(c, None)

    def harm(moves: list[tuple[int, int, int]]) -> float:
        """What moving a row of each (combination, from, to) changes in the sum of eighth powers of what folds lack."""
        change: dict = {}
        for c, f, g in moves:
            for p in [*pairs[c], None]:  # the size of a fold counts a fourth of a pair
                change[p, f] = change.get((p, f), 0) + 1
                change[p, g] = change.get((p, g), 0) - 1
        now = {k: (missing[k[1]] / 4 if k[0] is None else lacks[k[0]][k[1]]) for k in change}
        return sum((now[k] + (d / 4 if k[0] is None else d)) ** 8 - now[k] ** 8 for k, d in change.items())

    for _ in range(passes):
        worst, fold = max(((p, f) for p in lacks for f in folds), key=lambda x: (abs(lacks[x[0]][x[1]]), x), default=(None, 0))
        if worst is None or abs(lacks[worst][fold]) <= 0.5:
            break
        lacking = lacks[worst][fold] > 0
        tries = []
        for c in holders[worst]:
            for other in folds:
                f, g = (other, fold) if lacking else (fold, other)
                if f == g or not quotas[c][f]:
                    continue
                tries.append([(c, f, g)])
                if len(combos) <= 512:  # in exchange for a row of another combination
                    tries += [[(c, f, g), (d, g, f)] for d in range(len(combos)) if quotas[d][g] and worst not in pairs[d]]
        best = min(tries, key=harm, default=None)
        if best is None or harm(best) > -1e-9:
            break
        for c, f, g in best:
            for x, step in ((f, -1), (g, 1)):
                quotas[c][x] += step
                missing[x] -= step
                for p in pairs[c]:
                    lacks[p][x] -= step
    far = [abs(x) for p in lacks for x in lacks[p]]
    return (round(max(far, default=0.0), 6), sum(x**8 for x in far)), quotas


def iterative_split(df: DataFrame, key: Sequence[str], labels: Sequence[str], test_ratio: float = 0.2, val_ratio: float | None = None,
                    seed: int = 42, max_combinations: int = 1 << 16) -> DataFrame:
    """M4: split that keeps the shares of all labels and pairs of labels (order-2 iterative stratification).

    Code 0 = train, 1 = val, 2 = test (1 = test when there is no val). Rows of one label combination are interchangeable, so
    the rounds run on the table of combinations (at most 2**labels rows, an aggregate), and rows are dealt within their combination by an
    md5 of key and seed, with ranks that no task sorts alone. A null label counts as 0. Rows equal in key
    are told apart arbitrarily; otherwise reruns agree however the rows are partitioned. More than ``max_combinations`` different
    combinations raise ``ValueError``: use ``stratified_split`` or fewer labels there.
    """
    on = F.concat(*[F.coalesce(F.col(c).cast("int"), F.lit(0)).cast("string") for c in labels])
    x = df.withColumn("_combo", on).withColumn("_u", md5_uniform(*key, F.lit(seed)))
    found = x.groupBy("_combo").count().limit(max_combinations + 1).collect()
    if len(found) > max_combinations:
        raise ValueError(f"more than {max_combinations} label combinations")
    found = sorted((r["_combo"], r["count"]) for r in found)
    ratios = [1 - test_ratio - (val_ratio or 0), val_ratio or 0, test_ratio] if val_ratio else [1 - test_ratio, test_ratio]
    combos = [(tuple(i for i, ch in enumerate(c) if ch != "0"), n) for c, n in found]
    quotas = [(c, *q) for (c, _), q in zip(found, fold_quotas(combos, ratios))]
    cells = ", ".join(f"_q{f} long" for f in range(len(ratios)))
    table = df.sparkSession.createDataFrame(quotas, f"_c string, {cells}")
    r = exact_rank(x, ["_combo"], "_u", list(key)).join(F.broadcast(table), F.col("_combo") == F.col("_c"))
    code, upto = F.lit(len(ratios) - 1), F.lit(0)
    for f in range(len(ratios) - 1):
        upto = upto + F.col(f"_q{f}")
        code = F.when((F.col("_rank") <= upto) & (F.col("_rank") > upto - F.col(f"_q{f}")), f).otherwise(code)
    return r.withColumn("split", code.cast("int")).drop("_combo", "_c", "_u", "_rank", "_size", *[f"_q{f}" for f in range(len(ratios))])


def batch_groups(df: DataFrame, group: str, batch_size: int, seed: int = 42) -> DataFrame:
    """Shuffle the groups (md5 order), cut in ceil(n / b) near-equal batches (larger first),
    return group -> batch and the row count of each batch. Runs on the group table only."""
    ordered = place_in_order(group_sizes(df, group).withColumn("_u", md5_uniform(F.col(group), F.lit(seed))), "_at", F.col("_u"), F.col(group))
    n = ordered.count()
    k = max(1, -(-n // batch_size))
    each, larger = divmod(n, k)  # the first ``larger`` batches hold one group more
    at, edge = F.col("_at") - 1, larger * (each + 1)
    b = F.when(at < edge, F.floor(at / F.lit(each + 1))).otherwise(F.lit(larger) + F.floor((at - edge) / F.lit(max(1, each))))
    b = ordered.withColumn("batch", (b + 1).cast("int"))
    return b.withColumn("batch_size", F.sum("size").over(Window.partitionBy("batch"))).drop("_u", "_at")


def shuffle(df: DataFrame, key: Sequence[str], seed: int = 42) -> DataFrame:
    """O2: reproducible random order: sort by md5-uniform of (key, seed), stable under repartitioning."""
    return df.withColumn("_u", md5_uniform(*key, F.lit(seed))).orderBy("_u", *key).drop("_u")


def sort_by(df: DataFrame, cols: Sequence[str | Column]) -> DataFrame:
    """O3: sort on keys / display columns."""
    return df.orderBy(*cols)


def concat_runs(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack per-seed / per-model tables by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def split_group_sets(all_groups: DataFrame, test: DataFrame, val: DataFrame, group: str) -> DataFrame:
    """Train groups = all - test - val (set difference by anti joins)."""
    rest = all_groups.select(group).distinct().join(test.select(group), group, "left_anti")
    return rest.join(val.select(group), group, "left_anti")
