"""Comparisons of systems: paired tests, rank correlations, agreement."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.lineage import cut


def pairs(per_query: DataFrame, value: str = "value") -> DataFrame:
    """(dataset, query_id, a, b, delta): b's value less a's, for every two systems a < b on the queries of both."""
    rows = per_query.select("dataset", "query_id", "system", F.col(value).alias("v"))
    other = rows.select("dataset", "query_id", F.col("system").alias("b"), F.col("v").alias("w"))
    both = rows.withColumnRenamed("system", "a").join(other, ["dataset", "query_id"]).filter("a < b")
    return both.select("dataset", "query_id", "a", "b", (F.col("w") - F.col("v")).alias("delta"))


def paired_t(deltas: DataFrame, keys: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """(*keys, n, delta, t): null where fewer than two queries or all differences are equal."""
    rows = deltas.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("delta").alias("delta"), F.stddev_samp("delta").alias("sd"), (F.max("delta") - F.min("delta")).alias("spread")
    )
    t = F.when((F.col("n") > 1) & (F.col("spread") > 0), F.col("delta") / (F.col("sd") / F.sqrt("n")))
    return rows.select(*keys, "n", "delta", t.alias("t"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def two_sided_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def with_p(tests: DataFrame) -> DataFrame:
    """The tests with ``p``; one row a pair of systems reaches Python."""

    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else two_sided_p(float(x), float(m) - 1) for x, m in zip(t, n)], dtype="float64")

    return tests.withColumn("p", p("t", "n")).withColumn("p", F.when(F.col("t").isNotNull(), F.col("p")))


def sensitivity(deltas: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(dataset, share, pairs): share of all system pairs that a paired test tells apart."""
    tests = with_p(paired_t(deltas, ("dataset", "a", "b")))
    return tests.groupBy("dataset").agg(F.avg(F.coalesce((F.col("p") < alpha).cast("double"), F.lit(0.0))).alias("share"), F.count("*").alias("pairs"))


def sign_flips(one: DataFrame, two: DataFrame) -> DataFrame:
    """Queries where two metrics prefer different systems of a pair, with both differences."""
    keys = ["dataset", "query_id", "a", "b"]
    rows = one.join(two.withColumnRenamed("delta", "other"), keys)
    return rows.filter(F.col("delta") * F.col("other") < 0).withColumn("gap", F.abs(F.col("delta") - F.col("other")))


def average_ranks(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Rank of ``value`` within ``keys``, ties at their mean; rows without a value are left out.

    Distinct values are dealt out by ranges, each counts those before it in its range, and a range starts after the
    sums of the ranges before it: a group of any size is sorted in parts, and a value that many rows share is one row.
    """
    cells = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c_"))
    cells = cut(cells.repartitionByRange(*keys, value).withColumn("part_", F.spark_partition_id()))  # ranges are drawn once
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("c_").over(before.partitionBy("part_", *keys).orderBy(value)), F.lit(0))
    sums = cells.groupBy(*keys, "part_").agg(F.sum("c_").alias("t_"))
    starts = sums.select(*keys, "part_", F.coalesce(F.sum("t_").over(before.partitionBy(*keys).orderBy("part_")), F.lit(0)).alias("o_"))
    ranks = cells.withColumn("b_", inside).join(starts, [*keys, "part_"]).select(*keys, value, (F.col("o_") + F.col("b_") + (F.col("c_") + 1) / 2).alias(name))
    return rows.join(ranks, [*keys, value])


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks; null where either is constant. Rows with a null on either side are left out."""
    both = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(both, keys, x, "rx"), keys, y, "ry")
    sums = ranked.groupBy(*keys).agg(F.covar_pop("rx", "ry").alias("c"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"), F.count("*").alias("n"))
    return sums.select(*keys, "n", F.try_divide("c", F.col("sx") * F.col("sy")).alias("rho"))


#: A group of more distinct pairs of values is split into so many blocks of each value at most, of about so many pairs.
BLOCK, BLOCKS = 50_000, 1024


def discordant(group: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, groups: int) -> np.ndarray:
    """Weight of the pairs of each group that x and y order differently: inversions, counted bit by bit of y's rank.

    Items stand by group and x (equal x by y, so that they invert nothing). At every bit, items alike in all higher bits
    are a stretch; a one before a zero there is an inversion; then each stretch parts into its zeros and its ones.
    """
    order = np.lexsort((y, x, group))
    group, w = group[order], w[order].astype(np.int64)
    rank = np.unique(y, return_inverse=True)[1][order]
    out, stretch = np.zeros(groups, np.int64), group.astype(np.int64)
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        one = rank >> bit & 1
        upto = np.concatenate(([0], np.cumsum(w * one)))
        start = np.flatnonzero(np.diff(stretch, prepend=-1))
        base = np.repeat(upto[start], np.diff(np.append(start, len(w))))
        np.add.at(out, group, w * (1 - one) * (upto[:-1] - base))
        order = np.lexsort((one, stretch))
        stretch, rank, w, group = (stretch * 2 + one)[order], rank[order], w[order], group[order]
        stretch = np.cumsum(np.diff(stretch, prepend=stretch[:1]) != 0)
    return out


def _discordant_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        x, y, w = (lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "w"))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(discordant(of, x, y, w, batch.num_rows))], names=["unit", "d"])


def _tau_of_lists(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Tau-b of groups that are each one task's small array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, lists = batch.num_rows, batch.column(0)
            of = np.repeat(np.arange(k), lists.value_lengths().to_numpy())
            x, y, w = (lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "w"))

            def alike(*by: np.ndarray) -> np.ndarray:
                """Weight of each group's pairs that agree in ``by``."""
                order = np.lexsort((*by, of))
                new = np.ones(len(order), bool)
                new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in (*by, of)], axis=0)
                at = np.flatnonzero(new)
                n = np.add.reduceat(w[order], at) if len(at) else w[:0]
                out = np.zeros(k, np.int64)
                np.add.at(out, of[order[at]], n * (n - 1) // 2)
                return out

            all_, tied_x, tied_y, both = alike(), alike(x), alike(y), alike(x, y)
            s = all_ - 2 * discordant(of, x, y, w, k) - tied_x - tied_y + both
            spread = np.sqrt((all_ - tied_x).astype(float) * (all_ - tied_y))
            tau = pa.array(np.where(spread > 0, s / np.where(spread > 0, spread, 1), 0.0), mask=spread == 0)
            yield pa.RecordBatch.from_arrays([batch.column(1), tau], names=["unit", "tau"])

    lists = cells.groupBy(F.struct(*keys).alias("unit")).agg(F.collect_list(F.struct("x", "y", "w")).alias("items"))
    found = lists.select("items", "unit").mapInArrow(run, f"unit {lists.schema['unit'].dataType.simpleString()}, tau double")
    return found.select(*[F.col(f"unit.{c}").alias(c) for c in keys], "tau")


def kendall_tau_b(rows: DataFrame, keys: list[str], item: str, x: str, y: str, block: int = BLOCK) -> DataFrame:
    """Tau-b over the pairs of items within ``keys``; null where either side is constant. No pair is ever made.

    Ties come from counts by value, and the pairs that the two values order differently from inversions. A group of more
    than ``block`` distinct pairs of values is cut at quantiles of x and of y, the quantile values themselves being
    blocks of their own, so that a value that very many rows share is in none with others. Its inversions are those inside
    blocks of x, plus those inside blocks of y, less those inside both (counted twice), plus those between blocks, which
    are inversions of the blocks' own table of counts. Each is one task's small array, as are all groups where none is larger. Rows with a null on either side
    are left out; no rows give no rows. Groups of up to 3 * 10**9 items.
    """
    cells = rows.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    cells = cells.groupBy(*keys, "x", "y").agg(F.count("*").alias("w"))
    largest = cells.groupBy(*keys).agg(F.count("*").alias("cells")).agg(F.max("cells")).first()[0]
    if (largest or 0) <= block:
        return _tau_of_lists(cells, keys)
    cells = cut(cells)
    two = lambda w: F.shiftright(w * (w - 1), 1)
    sizes = cells.groupBy(*keys).agg(F.count("*").alias("cells"), F.sum("w").alias("n"), F.sum(two(F.col("w"))).alias("both"))
    for c in ("x", "y"):
        tied = cells.groupBy(*keys, c).agg(F.sum("w").alias("w")).groupBy(*keys).agg(F.sum(two(F.col("w"))).alias(f"tied_{c}"))
        sizes = sizes.join(tied, keys)
    sizes = cut(sizes)

    unit = F.struct(*keys, F.lit(0).alias("kind"), F.lit(None).cast("int").alias("bx"), F.lit(None).cast("int").alias("by"))
    entry = F.struct("x", "y", "w")
    few = sizes.filter(F.col("cells") <= block).select(*keys)
    lists = cells.join(few, keys, "left_semi").groupBy(unit.alias("unit")).agg(F.collect_list(entry).alias("items"))
    many = sizes.filter(F.col("cells") > block).select(*keys, F.least(F.ceil(F.col("cells") / block), F.lit(BLOCKS)).cast("int").alias("blocks"))
    sign = {0: 1, 1: 1, 2: -1, 3: 1}
    if not many.isEmpty():
        at = F.array(*[F.lit(i / BLOCKS) for i in range(1, BLOCKS)])
        large = cells.join(many, keys)
        edges = large.groupBy(*keys).agg(F.first("blocks").alias("blocks"), *[F.percentile_approx(c, at, 10 * BLOCKS).alias(f"at_{c}") for c in ("x", "y")])
        step = F.col("blocks")
        kept = lambda c: F.array_distinct(F.filter(f"at_{c}", lambda v, i: F.floor((i + 1) * step / BLOCKS) > F.floor(i * step / BLOCKS)))
        edges = edges.select(*keys, kept("x").alias("at_x"), kept("y").alias("at_y"))
        place = lambda c: (2 * F.size(F.filter(f"at_{c}", lambda v: v < F.col(c))) + F.array_contains(f"at_{c}", F.col(c)).cast("int")).cast("int")
        placed = large.join(edges, keys).select(*keys, "x", "y", "w", place("x").alias("bx"), place("y").alias("by"))
        whole = lambda kind, bx, by: F.struct(*keys, F.lit(kind).alias("kind"), bx.alias("bx"), by.alias("by"))
        none, odd_x, odd_y = F.lit(None).cast("int"), F.col("bx") % 2 == 1, F.col("by") % 2 == 1
        kinds = F.filter(F.array(F.when(~odd_x, whole(1, F.col("bx"), none)), F.when(~odd_y, whole(1, none, F.col("by"))), F.when(~odd_x & ~odd_y, whole(2, F.col("bx"), F.col("by")))), lambda u: u.isNotNull())
        inside = placed.select(F.explode(kinds).alias("unit"), entry.alias("e")).groupBy("unit").agg(F.collect_list("e").alias("items"))
        table = placed.groupBy(*keys, "bx", "by").agg(F.sum("w").alias("w"))
        between = table.select(whole(3, none, none).alias("unit"), F.struct(F.col("bx").cast("double").alias("x"), F.col("by").cast("double").alias("y"), "w").alias("e")).groupBy("unit").agg(F.collect_list("e").alias("items"))
        lists = lists.unionByName(inside).unionByName(between)
    kind = lists.schema["unit"].dataType.simpleString()
    found = lists.select("items", "unit").mapInArrow(_discordant_lists, f"unit {kind}, d long")
    signed = F.col("d") * F.element_at(F.create_map(*[F.lit(v) for kv in sign.items() for v in kv]), F.col("unit.kind"))
    sums = found.select(*[F.col(f"unit.{k}").alias(k) for k in keys], signed.alias("d")).groupBy(*keys).agg(F.sum("d").alias("d"))
    all_ = two(F.col("n"))
    s = all_ - 2 * F.col("d") - F.col("tied_x") - F.col("tied_y") + F.col("both")
    spread = F.sqrt((all_ - F.col("tied_x")).cast("double") * (all_ - F.col("tied_y")).cast("double"))
    return sizes.join(sums, keys).select(*keys, F.when(F.col("n") > 1, F.try_divide(s.cast("double"), spread)).alias("tau"))


def auc(rows: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """Mann-Whitney area: chance that a positive scores above a negative, ties half."""
    ranked = average_ranks(rows, keys, score, "r")
    sums = ranked.groupBy(*keys).agg(F.sum(F.when(F.col(positive) == 1, F.col("r"))).alias("r"), F.sum(positive).alias("p"), F.count("*").alias("n"))
    return sums.select(*keys, F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


def clustered_rate(rows: DataFrame, keys: list[str], cluster: str, hit: str) -> DataFrame:
    """(*keys, n, clusters, rate, low, high): a rate with a 95% interval from the residual sums of the clusters."""
    inner = rows.groupBy(*keys, cluster).agg(F.sum(hit).alias("s"), F.count("*").alias("m"))
    total = inner.groupBy(*keys).agg(F.sum("m").alias("n"), F.count("*").alias("clusters"), (F.sum("s") / F.sum("m")).alias("rate"))
    spread = inner.join(total, keys).groupBy(*keys, "n", "clusters", "rate").agg(F.sum(F.pow(F.col("s") - F.col("rate") * F.col("m"), 2)).alias("v"))
    half = 1.96 * F.sqrt("v") / F.col("n")
    return spread.select(*keys, "n", "clusters", "rate", (F.col("rate") - half).alias("low"), (F.col("rate") + half).alias("high"))


#: Queries of a data set that are resampled together.
LEAF = 4096


def _seeded(seed: int, place: int, *path: int) -> np.random.Generator:
    return np.random.default_rng(np.random.SeedSequence([seed, place & 0xFFFFFFFF, place >> 32 & 0xFFFFFFFF, *path]))


def resampled(per_query: DataFrame, value: str, draws: int = 1000, seed: int = 0, leaf: int = LEAF) -> DataFrame:
    """(system, dataset, draw, n, drawn, total): each data set's n values drawn n times with replacement, ``draws`` times.

    A draw's n picks are dealt down a binary tree whose leaves are stretches of the queries' hashes: at each node a
    seeded binomial gives the left side its share, by the queries that stand there; in a leaf the picks fall evenly
    on its queries. So picks are n exactly (``drawn``), no data set is gathered, and a rerun, in any order and
    partitioning, draws alike, also for two systems with the same queries. Null values are left out; repeated rows are
    queries each.
    """
    keys = ["system", "dataset"]
    rows = per_query.filter(F.col(value).isNotNull()).select(*keys, "query_id", F.col(value).cast("double").alias("v"), F.xxhash64("dataset", "query_id").alias("h"))
    rows = cut(rows)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("depth", F.greatest(F.ceil(F.log2(F.col("n") / leaf)), F.lit(0)).cast("int"))
    prefix = lambda h, bits: F.when(bits == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", h, 64 - bits))
    leaves = rows.join(sizes, keys).groupBy(*keys, "n", "depth", prefix(F.col("h"), F.col("depth")).alias("leaf")).agg(
        F.sort_array(F.collect_list(F.struct("h", "query_id", "v"))).alias("items")
    )
    leaves = cut(leaves)
    levels = F.when(F.col("depth") > 0, F.sequence(F.lit(1), F.col("depth"))).otherwise(F.array().cast("array<int>"))
    steps = leaves.select(*keys, "depth", "leaf", F.size("items").alias("m"), F.explode(levels).alias("level"))
    steps = steps.withColumn("node", F.call_function("shiftright", F.col("leaf"), F.col("depth") - F.col("level")))
    held = steps.groupBy(*keys, "level", "node").agg(F.sum("m").alias("m"))
    # of each node on a leaf's path: what stands in it, and in its sibling
    beside = held.select(*keys, "level", F.col("node").bitwiseXOR(F.lit(1).cast("long")).alias("node"), F.col("m").alias("beside"))
    paths = steps.drop("m").join(held, [*keys, "level", "node"]).join(beside, [*keys, "level", "node"], "left")
    paths = paths.groupBy(*keys, "leaf").agg(F.sort_array(F.collect_list(F.struct("level", "node", "m", F.coalesce("beside", F.lit(0).cast("long")).alias("beside")))).alias("path"))
    units = leaves.join(paths, [*keys, "leaf"], "left").select(*keys, "n", "leaf", F.xxhash64("dataset").alias("place"), F.coalesce(F.transform("items", lambda i: i["v"])).alias("values"), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = []
            picks: list[np.ndarray] = []
            for n, leaf_no, place, values, path in zip(*(batch.column(i).to_pylist() for i in range(2, 7))):
                count = np.full(draws, n)
                for p in path or []:
                    low, here = (p["m"], True) if p["node"] % 2 == 0 else (p["beside"], False)
                    left = _seeded(seed, place, p["level"], p["node"] >> 1).binomial(count, low / (p["m"] + p["beside"]))
                    count = left if here else count - left
                v, r, sums = np.array(values), _seeded(seed, place, 64, leaf_no), np.zeros(draws)
                for a in range(0, draws, 64):
                    some = count[a : a + 64]
                    total = np.concatenate(([0.0], np.cumsum(v[r.integers(0, len(v), int(some.sum()))])))
                    to = np.concatenate(([0], np.cumsum(some)))
                    sums[a : a + 64] = total[to[1:]] - total[to[:-1]]
                out.append(sums)
                picks.append(count)
            k = batch.num_rows
            if k:
                spread = [c.take(pa.array(np.repeat(np.arange(k), draws))) for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays([*spread, pa.array(np.tile(np.arange(draws, dtype=np.int32), k)), pa.array(np.concatenate(picks).astype(np.int64)), pa.array(np.concatenate(out))], names=[*keys, "n", "draw", "drawn", "total"])

    parts = units.mapInArrow(run, "system string, dataset string, n long, draw int, drawn long, total double")
    return parts.groupBy(*keys, "draw").agg(F.first("n").alias("n"), F.sum("drawn").alias("drawn"), F.sum("total").alias("total"))


def bootstrap(per_query: DataFrame, value: str, draws: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(system, low, high): percentile interval of the mean of dataset means, queries resampled n of n within datasets, see ``resampled``."""
    if draws < 1 or not 0 < level < 1:
        raise ValueError("one draw or more, and a level between 0 and 1")
    means = resampled(per_query, value, draws, seed).groupBy("system", "draw").agg(F.avg(F.col("total") / F.col("n")).alias("m"))
    tail = (1 - level) / 2
    return means.groupBy("system").agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
