"""Group statistics: dominance, purity, entropy, lift, agreement, tables, quantile bins."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts into which a range of values is cut at a time.
PARTS = 64


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts by value without nulls."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))


def shares(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Group counts, other aggregates, and each group's share of all rows."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"), *aggs)
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("*", (F.col("n") / F.col("total")).alias("share")).drop("total")


def purity(df: DataFrame, group: str, label: str, least: int = 0) -> DataFrame:
    """n, dominant label (ties: the least), purity, number of labels and entropy over ln(labels), per group."""
    cells = df.where(F.col(group).isNotNull() & F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("_cell"))
    # One more aggregate over cells: sums, and the dominant label as the largest (count, label reversed by order).
    order = F.struct((-F.col("_cell")).alias("c"), F.col(label).alias("l"))
    out = cells.groupBy(group).agg(
        F.sum("_cell").alias("n"),
        F.min(order).alias("top"),
        F.count("*").alias("n_labels"),
        F.sum(F.col("_cell") * F.ln("_cell")).alias("clnc"),
    )
    n = F.col("n")
    entropy = F.ln(n) - F.col("clnc") / n
    norm = F.when(F.col("n_labels") > 1, entropy / F.ln("n_labels")).otherwise(F.lit(0.0))
    return out.where(n >= least).select(
        group,
        "n",
        F.col("top.l").alias("dominant"),
        (-F.col("top.c") / n).alias("purity"),
        "n_labels",
        F.greatest(norm, F.lit(0.0)).alias("norm_entropy"),
    )


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def lift(df: DataFrame, group: str, label: str, least: int = 0) -> DataFrame:
    """How much likelier a group's dominant label is there than overall, weighted by size."""
    stats = purity(df, group, label, least)
    overall = shares(df.where(F.col(label).isNotNull()), [label]).select(F.col(label).alias("dominant"), F.col("share").alias("p"))
    return stats.join(overall, "dominant").agg(weighted_mean(F.col("purity") / F.col("p"), F.col("n")).alias("lift"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, h_a, h_b, mi (natural logarithms)."""
    cells = contingency(df, a, b)
    rows = cells.groupBy(a).agg(F.sum("n").alias("ra"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("cb"))
    total = cells.agg(F.sum("n").cast("double").alias("t"))
    h = lambda side, n: side.crossJoin(F.broadcast(total)).agg((-F.sum(F.col(n) / F.col("t") * F.ln(F.col(n) / F.col("t")))).alias("h" + n))
    joint = cells.join(rows, a).join(cols, b).crossJoin(F.broadcast(total))
    mi = joint.agg(
        F.max("t").cast("long").alias("n"),
        F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("ra") * F.col("cb")))).alias("mi"),
    )
    return mi.crossJoin(h(rows, "ra")).crossJoin(h(cols, "cb")).select("n", F.col("hra").alias("h_a"), F.col("hcb").alias("h_b"), "mi")


def expected_mutual_information(rows: list[int], cols: list[int]) -> float:
    """Of two random labellings with these class sizes (hypergeometric). Pairs of equal sizes are taken once. Of a pair's cell
    counts those within 40 deviations (and 400) of the mean are added up; the others weigh less than a double can hold. So
    arrays are as long as the root of a class, not as the class."""
    n, out = sum(rows), 0.0
    if not n:
        return out
    lg = math.lgamma
    a_sizes, a_times = np.unique(rows, return_counts=True)
    b_sizes, b_times = np.unique(cols, return_counts=True)
    for a, times_a in zip(a_sizes.tolist(), a_times.tolist()):
        for b, times_b in zip(b_sizes.tolist(), b_times.tolist()):
            mean = a * b / n
            far = 400 + 40 * math.sqrt(mean * (1 - a / n) * (n - b) / max(1, n - 1))
            low, high = max(1, a + b - n, math.floor(mean - far)), min(a, b, math.ceil(mean + far))
            if low > high:
                continue
            k = np.arange(low, high + 1, dtype=np.float64)
            # The logarithm at the least count, then from one count to the next.
            first = lg(a + 1) + lg(b + 1) + lg(n - a + 1) + lg(n - b + 1) - lg(n + 1) - lg(low + 1) - lg(a - low + 1) - lg(b - low + 1) - lg(n - a - b + low + 1)
            steps = np.log((a - k[:-1]) / (k[:-1] + 1)) + np.log((b - k[:-1]) / (n - a - b + k[:-1] + 1))
            p = np.exp(first + np.concatenate(([0.0], np.cumsum(steps))))
            out += times_a * times_b * float((k / n * np.log(n * k / (a * b)) * p).sum())
    return out


def adjusted_mutual_information(df: DataFrame, a: str, b: str, most: int = 20_000) -> float:
    """(MI - E) / (mean entropy - E). The margins are read by the driver: classes, not rows; `most` is checked."""
    cells = contingency(df, a, b)
    rows = [r.n for r in cells.groupBy(a).agg(F.sum("n").alias("n")).limit(most + 1).collect()]
    cols = [r.n for r in cells.groupBy(b).agg(F.sum("n").alias("n")).limit(most + 1).collect()]
    if max(len(rows), len(cols)) > most:
        raise ValueError(f"more than {most} classes")
    if len(rows) <= 1 and len(cols) <= 1:
        return 1.0
    t = sum(rows)
    entropy = lambda sizes: float(-(np.array(sizes) / t * np.log(np.array(sizes) / t)).sum())
    h_a, h_b = entropy(rows), entropy(cols)
    # Both entropies less that of the cells: no margin needs to be joined to its cells.
    joint = cells.agg(-F.sum(F.col("n") / F.lit(float(t)) * F.ln(F.col("n") / F.lit(float(t))))).first()[0]
    e = expected_mutual_information(rows, cols)
    below = (h_a + h_b) / 2 - e
    return (h_a + h_b - joint - e) / below if abs(below) > 1e-15 else 1.0


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ari."""
    cells = contingency(df, a, b)
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs("n").alias("pa"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs("n").alias("pb"))
    both = cells.agg(pairs("n").alias("pn"), F.sum("n").alias("n")).crossJoin(rows).crossJoin(cols)
    all_pairs = F.col("n") * (F.col("n") - 1) / 2
    chance = F.col("pa") * F.col("pb") / all_pairs
    below = (F.col("pa") + F.col("pb")) / 2 - chance
    return both.select(F.when(below == 0, F.lit(1.0)).otherwise((F.col("pn") - chance) / below).alias("ari"))


def crosstab_share(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cells in long form with their share of the row."""
    cells = contingency(df, a, b)
    return cells.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(a)))


def missing_rates(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of null or empty values by column, in one pass."""
    empty = lambda c: F.col(c).isNull() | ((F.col(c) == "") if dict(df.dtypes)[c] == "string" else F.lit(False))
    one = df.agg(*(F.avg(F.when(empty(c), 1.0).otherwise(0.0)).alias(c) for c in cols))
    return one.unpivot([], cols, "column", "missing")


def _ranked(counts: DataFrame, ranks: list[int], keep: int, values: int | None = None) -> dict[int, float]:
    """The values at some places (from 0) of the order of all values, from (v, n), one row for each value; `values` is their
    number, if it is known."""
    if (counts.limit(keep + 1).count() if values is None else values) <= keep:
        few = counts.orderBy("v").collect()
        upto, out = 0, {}
        for v, n in few:
            for r in ranks:
                if upto <= r < upto + n:
                    out[r] = v
            upto += n
        return out
    # Cut at approximate quantiles and at equal steps; only parts that hold a wanted place are looked into.
    at = [i / PARTS for i in range(1, PARTS)]
    f = counts.agg(F.percentile_approx("v", F.array(*map(F.lit, at)), 2000).alias("q"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    cuts = sorted({*f.q, *(f.lo + (f.hi - f.lo) * x for x in at)} - {f.lo})
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("v")))
    sums = dict(counts.groupBy(part.alias("part")).agg(F.sum("n").alias("n")).collect())  # 2 * PARTS rows at most
    base, out = 0, {}
    for k in range(len(cuts) + 1):
        n = sums.get(k, 0)
        inside = [r - base for r in ranks if base <= r < base + n]
        if inside:
            low = [F.col("v") >= cuts[k - 1]] if k else []
            high = [F.col("v") < cuts[k]] if k < len(cuts) else []
            found = _ranked(counts.where(reduce(Column.__and__, low + high)), inside, keep)
            out |= {r + base: v for r, v in found.items()}
        base += n
    return out


def quantiles(df: DataFrame, col: str, at: list[float], keep: int = 10_000) -> list[float]:
    """Exact quantiles with linear interpolation, without one task that holds all values: equal values are folded, and
    the range is cut into parts until those that hold a wanted place have `keep` values at most. [] without values."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count("*").alias("n"))
    total, values = counts.agg(F.sum("n"), F.count("*")).first()
    if not total:
        return []
    places = [(total - 1) * q for q in at]
    found = _ranked(counts, sorted({x for p in places for x in (math.floor(p), math.ceil(p))}), keep, values)
    return [found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) for p in places]


def largest(df: DataFrame, col: str, tie: str, size: int, keep: int = 10_000) -> DataFrame:
    """The `size` rows with the largest whole numbers in `col`, ties by `tie`. The least number among them is found from
    counts of equal numbers, so no task ranks all rows; only rows with that very number are ordered. Reads `df` several
    times: write it before."""
    if df.count() <= size:
        return df
    counts = df.groupBy((-F.col(col)).cast("double").alias("v")).agg(F.count("*").alias("n"))
    bound = -_ranked(counts, [size - 1], keep)[size - 1]
    above = df.where(F.col(col) > bound)
    return above.unionByName(df.where(F.col(col) == bound).orderBy(tie).limit(size - above.count()))


def edges(df: DataFrame, col: str, bins: int) -> list[float]:
    """Distinct linear-interpolated quantiles: bins + 1 numbers at most."""
    return sorted(set(quantiles(df, col, [i / bins for i in range(bins + 1)])))


def quantile_bin(col: Column, found: list[float]) -> Column:
    """Bins closed on the right, the first also on the left; null outside."""
    if not found:
        return F.lit(None).cast("int")
    out = F.when(col < found[0], F.lit(None).cast("int"))
    for i, hi in enumerate(found[1:]):
        out = out.when(col <= hi, F.lit(i))
    return out


def accuracy_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support by class; classes of either side."""
    t = df.groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("support"), F.count(F.when(F.col(truth) == F.col(predicted), 1)).alias("tp"))
    p = df.groupBy(F.col(predicted).alias("label")).agg(F.count("*").alias("guessed"))
    both = t.join(p, "label", "full").na.fill(0)
    precision = F.when(F.col("guessed") > 0, F.col("tp") / F.col("guessed")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    out = both.select("label", "support", "tp", precision.alias("precision"), recall.alias("recall"))
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def balanced_accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """accuracy, and balanced: the mean recall of the classes that occur in the truth."""
    r = accuracy_report(df, truth, predicted).where("support > 0")
    return r.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("recall").alias("balanced"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (k n_c)."""
    c = df.groupBy(label).agg(F.count("*").alias("c"))
    total = c.agg(F.sum("c").alias("t"), F.count("*").alias("k"))
    return c.crossJoin(F.broadcast(total)).select(label, (F.col("t") / (F.col("k") * F.col("c"))).alias("weight"))


def averages(report: DataFrame) -> DataFrame:
    """The macro and weighted rows of `accuracy_report`: means over the classes, plain and by support."""
    names = ("precision", "recall", "f1")
    macro = report.agg(F.lit("macro avg").alias("label"), F.sum("support").alias("support"), *(F.avg(c).alias(c) for c in names))
    weighted = report.agg(F.lit("weighted avg").alias("label"), F.sum("support").alias("support"), *(weighted_mean(F.col(c), F.col("support")).alias(c) for c in names))
    return macro.unionByName(weighted)


def size_figures(df: DataFrame, group: str, target: int | None = None) -> DataFrame:
    """One row over the sizes of groups: groups, mean, median, least, most, and the mean size that a corpus of `target`
    rows would have."""
    sizes = value_counts(df, group)
    middle = quantiles(sizes, "n", [0.5])
    projected = F.avg("n") * F.lit(target).cast("double") / F.sum("n") if target else F.lit(None).cast("double")
    return sizes.agg(
        F.count("*").alias("groups"),
        F.avg("n").alias("mean"),
        F.lit(middle[0] if middle else None).cast("double").alias("median"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        projected.alias("projected"),
    )


def agreement(df: DataFrame, first: str, second: str, unknown: str = "UNKNOWN") -> DataFrame:
    """One row over two labellers: rows, how many agree and disagree, the rate, and how many each left unknown."""
    same = F.col(first) == F.col(second)
    return df.agg(
        F.count("*").alias("n"),
        F.count(F.when(same, 1)).alias("agree"),
        F.count(F.when(~same, 1)).alias("disagree"),
        F.avg(same.cast("int")).alias("rate"),
        F.count(F.when(F.col(first) == unknown, 1)).alias("unknown_first"),
        F.count(F.when(F.col(second) == unknown, 1)).alias("unknown_second"),
    )


def consensus(curated: Column, other: Column, unknown: str = "UNKNOWN") -> Column:
    """struct(label, agree): the curated label always wins; the other one stands in only where there is none."""
    label = F.coalesce(F.nullif(curated, F.lit("")), F.when(other != unknown, other), F.lit(unknown))
    return F.struct(label.alias("label"), F.coalesce(curated == other, F.lit(False)).alias("agree"))


def ordered_distinct(df: DataFrame, group: str, order: str, items: str, out: str = "items") -> DataFrame:
    """(group, out): the group's arrays put end to end in an order, each item kept where it is first. The first place of each
    item is found before a group's items come together, so a group gathers its distinct items, not its rows."""
    flat = df.select(group, F.col(order).alias("_o"), F.posexplode_outer(items).alias("_i", "_x"))
    firsts = flat.groupBy(group, "_x").agg(F.min(F.when(F.col("_i").isNotNull(), F.struct("_o", "_i"))).alias("_f"))
    found = F.array_sort(F.collect_list(F.when(F.col("_f").isNotNull(), F.struct("_f", "_x"))))
    return firsts.groupBy(group).agg(F.transform(found, lambda s: s["_x"]).alias(out))


def grouping(df: DataFrame, sets: list[tuple[str, ...]], *aggs: Column) -> DataFrame:
    """Aggregates over several sets of columns at once; a column outside a row's set is null, and `level` tells the
    sets apart (a bit for each absent column, the last column's the lowest)."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.grouping_id().alias("level"), *aggs)


def reliability(df: DataFrame, signal: str, correct: str, bins: int = 10) -> DataFrame:
    """Of bins of equal mass of a signal: its mean, the share that is correct, and the size."""
    known = df.where(F.col(signal).isNotNull() & F.col(correct).isNotNull())
    binned = known.withColumn("bin", quantile_bin(F.col(signal), edges(known, signal, bins)))
    return binned.groupBy("bin").agg(F.avg(signal).alias("signal"), F.avg(F.col(correct).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def top_or_other(df: DataFrame, col: str, size: int, other: str = "other") -> DataFrame:
    """The column with all but its `size` most frequent values (ties: the least) replaced."""
    top = value_counts(df, col).orderBy(F.desc("n"), col).limit(size).select(F.col(col).alias("top_value"))
    joined = df.join(F.broadcast(top), F.col(col) == F.col("top_value"), "left")  # `size` rows
    return joined.withColumn(col, F.coalesce("top_value", F.lit(other))).drop("top_value")
