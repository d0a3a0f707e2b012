"""Comparisons of policies over runs: main results, pairs, statistics, frontiers, grids."""

from __future__ import annotations

import json
import random
import statistics
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderloom.functions.scalars import improvement
from cinderloom.operators.ranks import ranked


def mean_std(value: str, name: str) -> list[Column]:
    """Mean and sample deviation, the latter 0 for one value."""
    return [F.avg(value).alias(f"{name}_mean"), F.when(F.count(value) == 1, 0.0).otherwise(F.stddev_samp(value)).alias(f"{name}_std")]


def main_results(runs: DataFrame, keys: list[str], values: list[str], seed: str = "seed") -> DataFrame:
    stats = [c for v in values for c in mean_std(v, v)]
    seeds = F.array_join(F.array_sort(F.collect_set(F.col(seed).cast("string"))), ",")
    return runs.groupBy(*keys).agg(F.count("*").alias("n_runs"), seeds.alias("seeds"), *stats)


def lexical_order(*keys: str) -> list[Column]:
    """Ordering of groups by the text of their keys, null as 'None'."""
    return [F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in keys]


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys match, keeping the left keys."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = same if on is None else on & same
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def pairwise_deltas(runs: DataFrame, keys: list[str], value: str, success_policy: str, baseline_policies: list[str], baseline_controls: list[str] = (), mode: str = "max") -> DataFrame:
    """Each baseline run against the success run of its match key (without a control; of several, the last run id)."""
    plain = (F.col("policy") == success_policy) & (F.coalesce("control", F.lit("")) == "")
    success = runs.where(plain).groupBy(*keys).agg(F.max_by(value, "run_id").alias("success_value"), F.max("run_id").alias("success_run"))
    named = F.col("policy").isin(list(baseline_policies)) | F.col("control").isin(list(baseline_controls))
    baselines = runs.where(named).select(*keys, F.col("run_id").alias("baseline_run"), F.col("policy").alias("baseline_policy"), F.col("control").alias("baseline_control"), F.col(value).alias("baseline_value"))
    delta = improvement(F.col("success_value"), F.col("baseline_value"), mode)
    return null_safe(baselines, success, keys).withColumn("delta", delta).withColumn("win", F.col("delta") > 0)


def paired_stats(delta: str = "delta") -> list[Column]:
    d = F.col(delta)
    return [
        F.count(d).alias("n"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"),
        F.avg((d > 0).cast("int")).alias("win_rate"), F.avg(d).alias("mean_delta"),
    ]


def pairwise_summary(deltas: DataFrame, keys: list[str], budget: str = "budget") -> DataFrame:
    """Statistics per budget and over all budgets (budget 'ALL'), in one pass over grouping sets."""
    rows = deltas.groupingSets([[*map(F.col, keys), F.col(budget)], [*map(F.col, keys)]], *keys, budget).agg(F.grouping(budget).alias("_all"), *paired_stats())
    scope = F.when(F.col("_all") == 1, "ALL").otherwise(F.col(budget).cast("string"))
    return rows.withColumn(budget, scope).drop("_all").withColumn("sign_test_p", sign_test_p(F.col("wins"), F.col("losses")))


def sign_test_p(wins: Column, losses: Column) -> Column:
    """Exact two-sided binomial p without ties, 1 at most; null for no decided pair.

    Binomials are carried as shares of 2^n from term to term, so that n is bounded by the
    double's exponent (about 1,000), not by factorials; beyond, in logarithms.
    """
    n, tail = (wins + losses).cast("double"), F.least(wins, losses).cast("int")
    zero = F.struct((-n * F.ln(F.lit(2.0))).alias("t"), F.lit(0.0).alias("s"))
    total = F.aggregate(F.sequence(F.lit(0), tail), zero, lambda a, k: F.struct((a["t"] + F.ln(F.greatest(n - k, F.lit(1.0))) - F.ln(k + F.lit(1.0))).alias("t"), (a["s"] + F.exp(a["t"])).alias("s")))
    return F.when(n > 0, F.least(F.lit(1.0), 2 * total["s"]))


def percentile_of(sorted_values: Column, p: float) -> Column:
    """Linear interpolation at p (n - 1) in a sorted array."""
    at = F.lit(p) * (F.size(sorted_values) - 1)
    low, part = F.floor(at).cast("int"), at - F.floor(at)
    return F.get(sorted_values, low) * (1 - part) + F.coalesce(F.get(sorted_values, low + 1), F.get(sorted_values, low)) * part


def bootstrap_exact(values: Column, confidence: float = 0.95) -> Column:
    """Percentile interval of the mean over all n^n resamples of a short array (n up to 6)."""
    n = F.size(values)
    each = F.sequence(F.lit(0), n - 1)
    means = F.transform(
        F.sequence(F.lit(0), F.pow(n, n).cast("int") - 1),
        lambda i: F.aggregate(each, F.lit(0.0), lambda a, j: a + F.get(values, F.pmod(F.floor(i / F.pow(n, j)).cast("int"), n))) / n,
    )
    ordered, alpha = F.array_sort(means), (1 - confidence) / 2
    return F.when(n == 1, F.struct(values[0].alias("low"), values[0].alias("high"))).otherwise(F.struct(percentile_of(ordered, alpha).alias("low"), percentile_of(ordered, 1 - alpha).alias("high")))


def bootstrap_sampled(rows: DataFrame, keys: list[str], value: str, order: str, resamples: int = 10_000, confidence: float = 0.95) -> DataFrame:
    """Interval from seeded resamples of groups that fit a task, drawn value by value; the values in ``order`` seed the generator. ``bootstrap_interval`` is for groups of any size."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        values = part.sort_values(order)[value].dropna().tolist()
        rng = random.Random(int(sha256(json.dumps([round(v, 12) for v in values]).encode()).hexdigest()[:16], 16))
        n = len(values)
        means = sorted(statistics.fmean(values[rng.randrange(n)] for _ in range(n)) for _ in range(resamples if n > 1 else 1))
        at = [p * (len(means) - 1) for p in ((1 - confidence) / 2, (1 + confidence) / 2)]
        low, high = (means[int(a)] + (means[min(int(a) + 1, len(means) - 1)] - means[int(a)]) * (a - int(a)) for a in at)
        return part[keys].head(1).assign(n=n, ci_low=low, ci_high=high)

    some = rows.where(F.col(value).isNotNull()).select(*keys, order, value)
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return some.groupBy(*keys).applyInPandas(one, f"{schema}, n long, ci_low double, ci_high double")


#: Values of a resampling chunk; draws that a task holds at once.
CHUNK, DRAWS = 4096, 1 << 21


def _draws(seed: int, node: str):
    """The generator of one node of a group's tree: the same in every task that passes it."""
    return np.random.default_rng(int.from_bytes(sha256(f"{seed}/{node}".encode()).digest()[:16], "big"))


def chunk_draws(seed: int, n: int, chunk: int, resamples: int, size: int = CHUNK) -> np.ndarray:
    """How many of the n draws of each resample fall on this chunk of a group of n values.

    The counts of all chunks are multinomial. They are drawn top down: a node of a binary tree over
    chunks passes a binomial part of its draws to its left half, by the share of values there. A
    chunk follows only its own path, and chunks that share a node draw the same number for it.
    """
    lo, hi, left = 0, -(-n // size), np.full(resamples, n, np.int64)
    while hi - lo > 1:
        middle = (lo + hi) // 2
        values, on_left = min(hi * size, n) - lo * size, (middle - lo) * size
        some = _draws(seed, f"{lo}-{hi}").binomial(left, on_left / values)
        if chunk < middle:
            hi, left = middle, some
        else:
            lo, left = middle, left - some
    return left


def chunk_sums(seed: int, n: int, chunk: int, values: np.ndarray, resamples: int, size: int = CHUNK) -> np.ndarray:
    """This chunk's part of the sum of each resample."""
    counts, rng, out = chunk_draws(seed, n, chunk, resamples, size), _draws(seed, f"chunk {chunk}"), np.zeros(resamples)
    ends = np.cumsum(counts)
    lo = 0
    while lo < resamples:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + DRAWS, "right")))
        some = counts[lo:hi]
        drawn = values[rng.integers(0, len(values), int(some.sum()))]
        which = np.flatnonzero(some)
        if len(which):
            out[lo + which] = np.add.reduceat(drawn, np.append(0, np.cumsum(some[which])[:-1]))
        lo = hi
    return out


def bootstrap_interval(rows: DataFrame, keys: list[str], value: str, *order: str, resamples: int = 10_000, confidence: float = 0.95, seed: int = 0, exact: int = 6, chunk: int = CHUNK) -> DataFrame:
    """Percentile interval of the mean of every group: keys, n, method (point, exact, sampled), ci_low, ci_high. Null values are left out.

    Up to ``exact`` values all resamples are listed. Larger groups are cut into chunks of ``chunk``
    values by their exact places in ``order`` (which tells rows apart); a chunk draws its share of
    every resample, and the chunks' sums add up, so no task sees a whole group and what is gathered
    of a group is one number a resample. The interval depends on the rows and the seed, not on the
    layout.
    """
    some = rows.where(F.col(value).isNotNull()).select(*keys, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(value).cast("double").alias("_v"))
    placed = ranked(some, keys, [*[f"_o{i}" for i in range(len(order))], "_v"], "_place", "_size")
    few = placed.where(F.col("_size") <= exact).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_v"))), lambda x: x["_v"]).alias("_d")).where(F.size("_d") > 0)
    listed = few.select(*keys, F.size("_d").cast("bigint").alias("n"), F.when(F.size("_d") == 1, "point").otherwise("exact").alias("method"), bootstrap_exact(F.col("_d"), confidence).alias("_ci"))
    # A group's own generator: by its keys.
    name = F.xxhash64(F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], *[F.col(k).isNull() for k in keys])
    large = placed.where(F.col("_size") > exact).select(*keys, name.alias("_g"), "_size", F.floor((F.col("_place") - 1) / chunk).cast("bigint").alias("_c"), "_place", "_v")

    def sums(table: pa.Table) -> pa.Table:
        table = table.sort_by("_place")
        g, n, c = (table.column(x)[0].as_py() for x in ("_g", "_size", "_c"))
        out = chunk_sums(g, n, c, table.column("_v").to_numpy(), resamples, chunk)
        kept = [table.column(k).combine_chunks().take(pa.array([0])) for k in keys]
        return pa.table([*kept, pa.array([n]), pa.array([out.tolist()], pa.list_(pa.float64()))], [*keys, "_size", "_s"])

    schema = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    parts = large.groupBy(*keys, "_g", "_size", "_c").applyInArrow(sums, f"{schema}_size bigint, _s array<double>")
    means = parts.select(*keys, "_size", F.posexplode("_s").alias("_r", "_x")).groupBy(*keys, "_size", "_r").agg((F.sum("_x") / F.col("_size")).alias("_m"))
    ordered = means.groupBy(*keys, "_size").agg(F.sort_array(F.collect_list("_m")).alias("_m"))
    alpha = (1 - confidence) / 2
    drawn = ordered.select(*keys, F.col("_size").alias("n"), F.lit("sampled").alias("method"), F.struct(percentile_of(F.col("_m"), alpha).alias("low"), percentile_of(F.col("_m"), 1 - alpha).alias("high")).alias("_ci"))
    return listed.unionByName(drawn).select(*keys, "n", "method", F.col("_ci.low").alias("ci_low"), F.col("_ci.high").alias("ci_high"))


def oracle_frontier(runs: DataFrame, keys: list[str], value: str, fixed: Column, mode: str = "max") -> DataFrame:
    """Each run beside the best fixed run of its group (ties: first run id) and its distance to it."""
    sign = 1 if mode == "max" else -1
    best = F.min_by(F.struct(F.col(value).alias("v"), F.col("policy").alias("p")), F.struct((-sign * F.col(value)).alias("v"), F.col("run_id").alias("r")))
    top = runs.where(fixed & F.col(value).isNotNull()).groupBy(*keys).agg(best.alias("_best"))
    joined = null_safe(runs, top, keys, "left")
    distance = -improvement(F.col(value), F.col("oracle_value"), mode)
    return joined.withColumn("oracle_value", F.col("_best.v")).withColumn("oracle_policy", F.coalesce(F.col("_best.p"), F.lit(""))).withColumn("frontier_available", F.col("_best").isNotNull()).withColumn("distance", distance).drop("_best")


def success_check(runs: DataFrame, keys: list[str], value: str, success_policy: str, baselines: list[str], min_win_rate: float = 0.67, min_delta: float = 0.0) -> DataFrame:
    """Per baseline policy: matched pairs, success runs without a match, wins beyond the least delta, and whether it passes."""
    margin = max(min_delta, 0.0)
    # The baselines are a given list of names: this multiplies the success rows by its length only.
    s = runs.where(F.col("policy") == success_policy).select(*keys, F.col("run_id").alias("s_run"), F.col(value).alias("s_value")).withColumn("baseline", F.explode(F.array(*[F.lit(b) for b in baselines])))
    b = runs.where(F.col("policy").isin(baselines)).select(*keys, F.col("policy").alias("baseline"), F.col(value).alias("b_value"))
    pairs = null_safe(s, b.withColumn("matched", F.lit(True)), [*keys, "baseline"], "left")
    delta = F.col("s_value") - F.col("b_value")
    out = pairs.groupBy("baseline").agg(F.count("matched").alias("pairs"), F.count_distinct(F.when(F.col("matched").isNull(), F.col("s_run"))).alias("missing_pairs"), F.count_if(delta > margin).alias("wins"), F.avg(delta).alias("mean_delta"))
    rate = F.try_divide("wins", "pairs")
    return out.withColumn("win_rate", rate).withColumn("passed", F.coalesce((F.col("missing_pairs") == 0) & (rate >= min_win_rate), F.lit(False)))


def grid(**axes: DataFrame) -> DataFrame:
    """Every combination of the axes' values; each axis is a short list of distinct settings."""
    out = None
    for df in axes.values():
        out = df if out is None else out.crossJoin(df)
    return out


def grid_gaps(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected combinations that are missing, and found ones that were not expected."""
    names = expected.columns
    missing = expected.subtract(found.select(*names)).withColumn("side", F.lit("missing"))
    return missing.unionByName(found.select(*names).subtract(expected).withColumn("side", F.lit("unexpected")))


def duplicate_groups(rows: DataFrame, keys: list[str], run: str = "run_id") -> DataFrame:
    """Groups of more than one run, with the first and last run id."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(run).alias("first_run"), F.max(run).alias("last_run")).where("n > 1")


def action_space_parity(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Groups and whether all their runs share one action space that is not blank."""
    blank = F.count_if(F.coalesce(F.col(name), F.lit("")) == "")
    return rows.groupBy(*keys).agg(F.count_distinct(name).alias("action_spaces"), blank.alias("blank_runs")).withColumn("parity", (F.col("action_spaces") == 1) & (F.col("blank_runs") == 0))


def matched_control(row_keys: list[str], rows: DataFrame, value: str, policies: list[str], mode: str = "max") -> DataFrame:
    """The best fixed run of each key: by value, then the policies' order, then run id."""
    sign = -1 if mode == "max" else 1
    order = F.array_position(F.array(*[F.lit(p) for p in policies]), F.col("policy"))
    w = Window.partitionBy(*row_keys).orderBy(F.asc_nulls_last(sign * F.col(value)), order, "run_id")
    return rows.where(F.col("policy").isin(policies)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
