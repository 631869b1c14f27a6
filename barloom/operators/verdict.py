"""Statistical verdict on a rule grid: next-open fills with costs, and tests against luck.

Bars are visited once to compute fills and trades. Everything after that works on sums: a rule's
moments, the correlation of the rules, per-block sums for the overfitting test, and prefix sums for
the bootstrap, where the mean of a resampled series is a sum of differences of prefix sums at the ends
of the drawn blocks. No task ever holds a series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.statistics import norm_cdf, norm_ppf
from barloom.operators.aggregates import bar_interval
from barloom.operators.backtest import Rule, strategy_grid, target
from barloom.operators.ind_trend import atr_smooth
from barloom.operators.layout import Layout, plan_layout
from barloom.operators.quantiles import key_quantiles
from barloom.operators.series import Ref, Series
from barloom.session import cut_lineage

# Fixed values of the method.
ATR_WINDOW = 14
MIN_TRADES = 30
ALPHA = 0.05
DSR_THRESHOLD = 0.95
STRESS = (1.0, 1.5, 2.0)
STRESS_CHECK = 1.5
REPLICATES = 2000
PARTICIPATION_REPLICATES = 500
EFFECTIVE_N_LEVEL = 0.9
PROBE_FRACTIONS = (0.5, 0.65, 0.75, 0.85, 0.95)
MAX_PBO_BLOCKS = 16
MIN_PBO_BLOCK_BARS = 40
EULER_GAMMA = 0.5772156649015329
TINY = 1e-12
YEAR_SECONDS = 365 * 86_400

DRAW_CHUNK = 1_000_000

NEVER, FEW, PASSED, ERROR = "NEVER_TRADES", "INSUFFICIENT_TRADES", "PASSED_GATE", "ERROR"


@dataclass(frozen=True)
class Costs:
    """Per-side costs; slippage is a multiple of the previous bar's ATR(14)."""

    fee_bps_per_side: float = 10.0
    spread_bps: float = 1.0
    slippage_k: float = 0.1


def _zero(s: Series, x: Ref) -> Ref:
    return s.row("zero", lambda v: F.coalesce(v, F.lit(0.0)), x)


def fills_wide(df: DataFrame, costs: Costs, rules: Sequence[Rule], layout: Layout, target_of: Callable[[Series, Rule], Ref] = target) -> DataFrame:
    """Bars with, per rule, position, gross return, cost and the running return of the open trade.

    What a target decides at a close is filled at the next open: the position before the open earns the
    gap, the one after it earns the move inside the bar.
    """
    sizes = df.groupBy(*layout.keys).agg(F.count(F.lit(1)).alias("_n"))
    s = Series(df.join(sizes, list(layout.keys)), layout)
    s.output("_i", s.running("count", s.row("one", lambda c: F.lit(1.0), s.close)) - 1)
    before_close = s.lag(s.close)
    s.output("_prev_close", before_close)
    s.output("_bench", _zero(s, s.close / before_close - 1))
    gap = s.store(_zero(s, s.open / before_close - 1))
    inside = s.store(s.close / s.open - 1)
    rate = s.store(costs.fee_bps_per_side / 1e4 + costs.spread_bps / 2e4 + costs.slippage_k * s.lag(atr_smooth(s, ATR_WINDOW)) / s.open)
    index = s._named["_i"]
    for k, rule in enumerate(rules):
        held = s.store(_zero(s, s.lag(target_of(s, rule))))
        earlier = s.store(_zero(s, s.lag(held)))
        gross = s.store((1 + earlier * gap) * (1 + held * inside) - 1)
        cost = s.store(s.row("cost", lambda h, e, r: F.when(h == e, 0.0).otherwise(F.abs(h - e) * r), held, earlier, rate))
        enters = s.row("enters", lambda h, e: (h == 1) & (e == 0), held, earlier)
        flat = s.row("flat", lambda h, e: (h == 0) & (e == 0), held, earlier)
        s.output(f"_h{k}", held)
        s.output(f"_e{k}", earlier)
        s.output(f"_g{k}", gross)
        s.output(f"_c{k}", cost)
        s.output(f"_a{k}", s.hold(s.row("at", lambda e, i: F.when(e, i), enters, index)))
        growths = [("x", 1 + gross)] + [(f"m{j}_", (1 + gross) * (1 - m * cost)) for j, m in enumerate(STRESS)]
        for name, factor in growths:
            factor = s.store(factor)
            step = s.row("step", lambda e, f, g: F.when(e | f, 0.0).otherwise(g), enters, flat, factor)
            begin = s.row("begin", lambda e, g: F.when(e, g).otherwise(0.0), enters, factor)
            s.output(f"_{name}{k}", s.affine(step, begin))
    return s.build()


FILL = {"position": "h", "previous": "e", "gross": "g", "cost": "c", "entry": "a", "growth_gross": "x", "growth_0": "m0_", "growth_1": "m1_", "growth_2": "m2_"}


def fills(df: DataFrame, costs: Costs = Costs(), rules: Sequence[Rule] | None = None, layout: Layout | None = None) -> DataFrame:
    """One row per bar and rule: position, previous position, gross and net return, cost, open trade."""
    layout = layout or plan_layout(df)
    chosen = list(rules or strategy_grid())
    return _long(fills_wide(df, costs, chosen, layout), chosen, layout)


def _long(wide: DataFrame, rules: Sequence[Rule], layout: Layout) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(r.id).alias("rule"), F.lit(k).alias("rule_no"), *(F.col(f"_{c}{k}").alias(n) for n, c in FILL.items())) for k, r in enumerate(rules)))
    long = wide.select(*layout.keys, layout.order, "open", "close", "_prev_close", "_bench", "_i", "_n", F.explode(cells).alias("c"))
    return long.select(*layout.keys, layout.order, "open", "close", "_prev_close", "_bench", "_i", "_n", "c.*").withColumn(
        "net", (1 + F.col("gross")) * (1 - F.col("cost")) - 1
    )


# --- windows -----------------------------------------------------------------------------------


def _sharpe(mean: Column, std: Column, varies: Column, ppy: Column) -> Column:
    return F.when(varies, F.try_divide(mean, std) * F.sqrt(ppy))


def _sharpe_spread(sharpe: Column, skew: Column, kurt: Column) -> Column:
    """Sample length times the variance of a Sharpe estimate, allowing for skew and fat tails."""
    return F.greatest(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe, F.lit(TINY))


def _moments(x: str) -> list[Column]:
    return [
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.skewness(x).alias("skew"),
        (F.kurtosis(x) + 3).alias("kurt"), (F.max(x) > F.min(x)).alias("varies"),
    ]


def window_summary(rows: DataFrame, keys: Sequence[str], order: str, ppy: DataFrame, first: Column, last: Column) -> DataFrame:
    """Figures of each rule over the bars with index in [first, last) of its series.

    Trades count when they enter inside the window; one still open at the end is marked to the last
    bar. Earlier bars only warm up the indicators.
    """
    rows = rows.join(ppy, list(keys)).withColumn("_lo", first).withColumn("_hi", last).filter((F.col("_i") >= F.col("_lo")) & (F.col("_i") < F.col("_hi")))
    mine = F.col("entry") >= F.col("_lo")
    leaves = (F.col("position") == 0) & (F.col("previous") == 1) & mine
    still = (F.col("position") == 1) & mine & (F.col("_i") == F.col("_hi") - 1)
    enters = (F.col("position") == 1) & (F.col("previous") == 0)
    base = F.when(F.col("_i") == F.col("_lo"), F.coalesce(F.col("_prev_close"), F.col("open")))
    stats = rows.groupBy(*keys, "rule_no", "rule").agg(
        *_moments("net"), F.count_if(enters).alias("trades"), F.count_if(leaves).alias("closed_trades"),
        (F.avg("position") * 100).alias("exposure_pct"), ((F.product(1 + F.col("net")) - 1) * 100).alias("net_return_pct"),
        (F.avg(F.when(leaves | still, F.col("growth_0") - 1)) * 100).alias("mean_trade_return_pct"),
        F.max_by("close", order).alias("_end"), F.max(base).alias("_base"), F.first("periods_per_year").alias("ppy"),
    )
    sharpe = F.try_divide(F.col("mean"), F.col("std"))
    error = F.sqrt(_sharpe_spread(sharpe, F.col("skew"), F.col("kurt")) / (F.col("n") - 1)) * F.sqrt("ppy")
    return stats.select(
        *keys, "rule", "trades", "closed_trades", "exposure_pct", "net_return_pct",
        _sharpe(F.col("mean"), F.col("std"), F.col("varies") & (F.col("n") >= 2), F.col("ppy")).alias("sharpe"),
        F.when(F.col("varies") & (F.col("n") >= 3), error).alias("sharpe_se"), "mean_trade_return_pct",
        ((F.col("_end") / F.col("_base") - 1) * 100).alias("buy_hold_return_pct"),
    )


def periods_per_year(df: DataFrame, requested: float | None = None, layout: Layout | None = None) -> DataFrame:
    """The annualisation factor of each series: given, or a year over its median bar spacing."""
    keys = list((layout or Layout()).keys)
    if requested is not None:
        return df.select(*keys).distinct().select(*keys, F.lit(float(requested)).alias("periods_per_year"), F.lit(False).alias("inferred"))
    spacing = bar_interval(df, layout)
    return spacing.select(*keys, F.try_divide(F.lit(float(YEAR_SECONDS)), F.col("interval_seconds")).alias("periods_per_year"), F.lit(True).alias("inferred"))


# --- gate --------------------------------------------------------------------------------------


def rule_summary(rows: DataFrame, keys: Sequence[str], min_trades: int = MIN_TRADES) -> DataFrame:
    """One row per series and rule: trade gate, moments, trades under each cost multiple."""
    leaves = (F.col("position") == 0) & (F.col("previous") == 1)
    ends = leaves | ((F.col("position") == 1) & (F.col("_i") == F.col("_n") - 1))
    enters = (F.col("position") == 1) & (F.col("previous") == 0)
    stress = []
    for j, m in enumerate(STRESS):
        net = (1 + F.col("gross")) * (1 - m * F.col("cost")) - 1
        stress += [
            F.avg(net).alias(f"mean_{j}"), F.stddev_samp(net).alias(f"std_{j}"), (F.product(1 + net) - 1).alias(f"total_{j}"),
            F.avg(F.when(ends, F.col(f"growth_{j}") - 1)).alias(f"trade_{j}"), (F.max(net) > F.min(net)).alias(f"varies_{j}"),
        ]
    traded = F.col("position") != F.col("previous")
    found = rows.groupBy(*keys, "rule_no", "rule").agg(
        *_moments("net"), *stress, F.count_if(enters).alias("trades"), F.count_if(leaves).alias("closed_trades"),
        F.avg(F.when(F.col("_i") > 0, F.col("position"))).alias("exposure"), F.avg(F.when(ends, F.col("growth_gross") - 1)).alias("trade_gross"),
        F.avg("_bench").alias("bench_mean"), F.count_if(traded & F.col("cost").isNull()).alias("_unpriced"),
    )
    status = (
        F.when(F.col("_unpriced") > 0, ERROR).when(F.col("trades") == 0, NEVER).when(~F.col("varies"), ERROR)
        .when(F.col("trades") >= min_trades, PASSED).otherwise(FEW)
    )
    reason = F.when(F.col("_unpriced") > 0, "trading cost is undefined at a fill because ATR(14) is not yet available").when(
        (F.col("trades") > 0) & ~F.col("varies"), "net returns are constant, so no statistic is defined"
    )
    return found.withColumn("status", status).withColumn("error", reason).drop("_unpriced")


# --- effective number of rules -----------------------------------------------------------------


def participation(wide: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """``k**2 / sum(corr**2)`` over the rules whose net returns vary: the effective number of rules.

    For a correlation matrix the eigenvalues sum to k and their squares to the squared entries.
    """
    net = [(1 + F.col(f"_g{k}")) * (1 - F.col(f"_c{k}")) - 1 for k in range(len(rules))]
    pairs = [(a, b) for a in range(len(net)) for b in range(a)]
    sums = wide.groupBy(*keys).agg(
        F.array(*(F.when(F.max(x) > F.min(x), F.var_pop(x)) for x in net)).alias("v"),
        F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.covar_pop(net[a], net[b]).alias("c")) for a, b in pairs)).alias("p"),
    )
    square = lambda x: F.coalesce(F.try_divide(x["c"] * x["c"], F.element_at("v", x["a"] + 1) * F.element_at("v", x["b"] + 1)), F.lit(0.0))
    k = F.size(F.filter("v", lambda v: v.isNotNull()))
    squares = F.aggregate("p", k.cast("double"), lambda acc, x: acc + 2 * square(x))
    return sums.select(*keys, k.alias("rules_used"), F.when(k < 2, k.cast("double")).otherwise(k * k / squares).alias("estimate"))


# --- bootstrap ---------------------------------------------------------------------------------


def bootstrap_seed(dataset: str, fingerprint: str) -> int:
    """Seed fixed by a dataset and its sealed research part."""
    import hashlib

    return int(hashlib.sha256((dataset + fingerprint).encode()).hexdigest()[:8], 16)


def mean_block_length(n: Column) -> Column:
    return F.greatest(F.lit(2), F.bround(F.pow(n.cast("double"), F.lit(1.0 / 3))).cast("int"))


def drawn_blocks(series: DataFrame, keys: Sequence[str], replicates: int) -> DataFrame:
    """Blocks of a stationary bootstrap: (keys, replicate, start, length) covering ``n`` rows each.

    ``series`` has ``n``, ``block`` and ``seed`` per key. A row restarts with probability 1/block, from
    a generator seeded by (seed, replicate, chunk of rows), so chunks are drawn independently and a
    retried task draws the same blocks.
    """
    keys = list(keys)
    work = series.select(
        *keys, "n", "block", "seed", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")
    ).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / DRAW_CHUNK))))
    work = work.repartition(*keys, F.pmod(F.col("replicate"), F.lit(64)), "chunk")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for row in batch.itertuples(index=False):
                rng = np.random.default_rng([int(row.seed), int(row.replicate), int(row.chunk)])
                first = int(row.chunk) * DRAW_CHUNK
                size = min(DRAW_CHUNK, int(row.n) - first)
                restart = rng.random(size) < 1.0 / row.block
                if first == 0:
                    restart[0] = True
                at = np.flatnonzero(restart)
                part = {k: getattr(row, k) for k in keys}
                part |= {"n": row.n, "replicate": row.replicate, "at": at + first, "start": rng.integers(0, row.n, size=len(at))}
                if len(at):
                    parts.append(pd.DataFrame(part))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    kinds = dict(series.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, replicate int, at long, start long"
    drawn = work.mapInPandas(draw, schema)
    following = F.lead("at").over(Window.partitionBy(*keys, "replicate").orderBy("at"))
    return drawn.withColumn("length", F.coalesce(following, F.col("n")) - F.col("at")).drop("at")


def block_ends(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signed prefix-sum positions: a block adds the sum before its end and takes off the one before its start."""
    end, n = F.col("start") + F.col("length"), F.col("n")
    wraps = end > n
    ends = F.when(
        wraps,
        F.array(F.struct(F.col("start").alias("i"), F.lit(-1).alias("sign")), F.struct(n.alias("i"), F.lit(1).alias("sign")), F.struct((end - n).alias("i"), F.lit(1).alias("sign"))),
    ).otherwise(F.array(F.struct(F.col("start").alias("i"), F.lit(-1).alias("sign")), F.struct(end.alias("i"), F.lit(1).alias("sign"))))
    return (
        blocks.select(*keys, "replicate", F.explode(ends).alias("c"))
        .groupBy(*keys, "replicate", F.col("c.i").alias("_upto"))
        .agg(F.sum("c.sign").alias("sign"))
        .filter((F.col("sign") != 0) & (F.col("_upto") > 0))
    )


def bootstrap(wide: DataFrame, rules: Sequence[Rule], layout: Layout, seeds: DataFrame, replicates: int = REPLICATES, correlated: int = PARTICIPATION_REPLICATES) -> tuple[DataFrame, DataFrame]:
    """Resampled means of every rule and the benchmark, and effective rule counts of the first replicates.

    Returns (keys, replicate, rule_no, mean) with rule_no -1 for the benchmark, and (keys, replicate, ratio).
    """
    keys, count = list(layout.keys), len(rules)
    s = Series(wide, layout)
    net = [s.row(f"net{k}", lambda g, c: (1 + g) * (1 - c) - 1, s.column(f"_g{k}"), s.column(f"_c{k}")) for k in range(count)]
    net = [s.store(_zero(s, x)) for x in net]
    pairs = [(a, b) for a in range(count) for b in range(a + 1)]
    for k, x in enumerate([*net, s.column("_bench")]):
        s.output(f"_s{k}", s.running("sum", x))
    for a, b in pairs:
        s.output(f"_q{a}_{b}", s.running("sum", net[a] * net[b]))
    sums = [f"_s{k}" for k in range(count + 1)]
    squares = [f"_q{a}_{b}" for a, b in pairs]
    prefix = s.build().select(*keys, (F.col("_i").cast("long") + 1).alias("_upto"), F.col("_n"), *sums, *squares)
    ends = block_ends(drawn_blocks(seeds, keys, replicates), keys)
    joined = ends.join(prefix, [*keys, "_upto"])
    total = lambda c: F.sum(F.col("sign") * F.col(c))
    means = joined.groupBy(*keys, "replicate").agg(*(F.try_divide(total(c), F.first("_n")).alias(c) for c in sums))
    cells = F.array(*(F.struct(F.lit(k if k < count else -1).alias("rule_no"), F.col(c).alias("mean")) for k, c in enumerate(sums)))
    means = means.select(*keys, "replicate", F.explode(cells).alias("c")).select(*keys, "replicate", "c.*")
    moments = joined.filter(F.col("replicate") < correlated).groupBy(*keys, "replicate").agg(
        F.first("_n").alias("n"), *(total(c).alias(c) for c in [*sums, *squares])
    )
    n = F.col("n")
    own = F.array(*(F.struct(F.col(f"_s{k}").alias("s"), F.col(f"_q{k}_{k}").alias("q")) for k in range(count)))
    # A rule that never moves in a replicate has no variance beyond rounding of its own squares.
    spread = lambda x: F.when(x["q"] / n - (x["s"] / n) * (x["s"] / n) > 1e-12 * x["q"] / n, x["q"] / n - (x["s"] / n) * (x["s"] / n))
    cross = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(f"_q{a}_{b}") / n - F.col(f"_s{a}") / n * (F.col(f"_s{b}") / n)).alias("c")) for a, b in pairs if a != b))
    moments = moments.select(*keys, "replicate", F.transform(own, spread).alias("v"), cross.alias("p"))
    square = lambda x: F.coalesce(F.try_divide(x["c"] * x["c"], F.element_at("v", x["a"] + 1) * F.element_at("v", x["b"] + 1)), F.lit(0.0))
    k = F.size(F.filter("v", lambda v: v.isNotNull()))
    shared = F.aggregate("p", k.cast("double"), lambda acc, x: acc + 2 * square(x))
    ratios = moments.select(*keys, "replicate", F.when(k < 2, k.cast("double")).otherwise(k * k / shared).alias("ratio"))
    return means, ratios


def stepdown(means: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Studentised statistics and stepdown p-values of "mean excess is not above zero".

    ``observed`` has (keys, rule_no, exposure, excess) of the rules under test.
    """
    keys = list(keys)
    bench = means.filter(F.col("rule_no") == -1).select(*keys, "replicate", F.col("mean").alias("_b"))
    draws = (
        means.filter(F.col("rule_no") >= 0)
        .join(observed, [*keys, "rule_no"])
        .join(bench, [*keys, "replicate"])
        .withColumn("x", F.col("mean") - F.col("exposure") * F.col("_b"))
    )
    scale = draws.groupBy(*keys, "rule_no").agg(F.stddev_samp("x").alias("sigma"), F.first("excess").alias("excess"))
    scale = scale.withColumn("statistic", F.when(F.col("sigma") > 0, F.col("excess") / F.col("sigma")).otherwise(0.0))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("statistic").desc(), "rule_no"))
    ordered = scale.filter(F.col("sigma") > 0).withColumn("place", place)
    null = draws.drop("excess").join(ordered, [*keys, "rule_no"]).withColumn("z", (F.col("x") - F.col("excess")) / F.col("sigma"))
    rest = Window.partitionBy(*keys, "replicate").orderBy(F.col("place").desc()).rowsBetween(Window.unboundedPreceding, 0)
    raw = null.withColumn("top", F.max("z").over(rest)).groupBy(*keys, "rule_no").agg(
        F.avg((F.col("top") >= F.col("statistic")).cast("double")).alias("p"), F.first("place").alias("place")
    )
    upto = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    adjusted = raw.withColumn("adjusted_p", F.max("p").over(upto)).select(*keys, "rule_no", "adjusted_p")
    return scale.join(adjusted, [*keys, "rule_no"], "left").select(*keys, "rule_no", "statistic", F.coalesce("adjusted_p", F.lit(1.0)).alias("adjusted_p"))


# --- overfitting -------------------------------------------------------------------------------


def overfitting(rows: DataFrame, passing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Probability of backtest overfitting by symmetric cross-validation over per-block sums.

    The bars are reduced to one sum and one sum of squares per rule and block; the splits only ever see
    those (at most sixteen blocks).
    """
    keys = list(keys)
    rules = passing.groupBy(*keys).agg(F.count(F.lit(1)).alias("rules"))
    n = F.col("_n")
    rows = rows.join(passing.select(*keys, "rule_no"), [*keys, "rule_no"]).withColumn(
        "blocks", F.least(F.lit(MAX_PBO_BLOCKS), 2 * F.floor(n / MIN_PBO_BLOCK_BARS)).cast("int")
    )
    size = F.floor(n / F.col("blocks"))
    skip = n - F.col("blocks") * size
    sums = (
        rows.filter((F.col("blocks") >= 4) & (F.col("_i") >= skip))
        .groupBy(*keys, "rule_no", "blocks", size.alias("size"), F.floor((F.col("_i") - skip) / size).alias("b"))
        .agg(F.sum("net").alias("s"), F.sum(F.col("net") * F.col("net")).alias("q"))
        .groupBy(*keys, "rule_no", "blocks", "size")
        .agg(F.array_sort(F.collect_list(F.struct("b", "s", "q"))).alias("p"))
        .join(rules.filter(F.col("rules") >= 2), keys)
    )
    packed = sums.groupBy(*keys).agg(
        F.first("blocks").alias("blocks"), F.first("size").alias("size"),
        F.array_sort(F.collect_list(F.struct("rule_no", F.col("p.s").alias("s"), F.col("p.q").alias("q")))).alias("r"),
    )
    half = (F.col("blocks") / 2 * F.col("size")).cast("double")
    return packed.select(
        *keys, _split_share(F.col("r.s"), F.col("r.q"), half).alias("pbo"), "blocks", F.size("r").alias("rules"),
        (F.factorial("blocks") / F.factorial((F.col("blocks") / 2).cast("int")) / F.factorial((F.col("blocks") / 2).cast("int"))).cast("long").alias("combinations"),
    )


@F.pandas_udf(T.DoubleType())
def _split_share(sums: pd.Series, squares: pd.Series, half: pd.Series) -> pd.Series:
    """Share of half/half splits whose training winner ranks in the lower test half.

    One row holds the block sums of one series (rules by at most sixteen blocks).
    """
    import itertools

    def sharpe(total, square, count):
        mean = total / count
        std = np.sqrt(np.maximum((square - count * mean * mean) / (count - 1), 0.0))
        return np.divide(mean, std, out=np.zeros_like(mean), where=std > 0)

    shares = []
    for s, q, count in zip(sums, squares, half):
        s, q = np.vstack(list(s)), np.vstack(list(q))
        rules, blocks = s.shape
        inside = np.zeros((math.comb(blocks, blocks // 2), blocks))
        for row, picked in enumerate(itertools.combinations(range(blocks), blocks // 2)):
            inside[row, list(picked)] = 1.0
        train, test = (sharpe(side @ s.T, side @ q.T, count) for side in (inside, 1.0 - inside))
        score = test[np.arange(len(test)), train.argmax(axis=1)][:, None]
        rank = ((test < score).sum(axis=1) + ((test == score).sum(axis=1) + 1) / 2) / (rules + 1)
        shares.append(float(np.mean(rank <= 0.5)))
    return pd.Series(shares)


# --- deflated Sharpe ---------------------------------------------------------------------------


def deflated_sharpe(rows: DataFrame, trials: Column, variance: Column, name: str) -> DataFrame:
    """Probability that a Sharpe ratio beats the best of ``trials`` unskilled rules.

    ``rows`` has n, mean, std, skew and kurt (raw) per rule.
    """
    count = F.greatest(trials, F.lit(1.0))
    inside = (count > 1) & (variance > 0)
    rows = rows.withColumn("_q1", norm_ppf(F.when(inside, 1 - 1 / count))).withColumn("_q2", norm_ppf(F.when(inside, 1 - 1 / (count * math.e))))
    bar = F.when(inside, F.greatest(F.lit(0.0), F.sqrt(variance) * ((1 - EULER_GAMMA) * F.col("_q1") + EULER_GAMMA * F.col("_q2")))).otherwise(0.0)
    sharpe = F.try_divide(F.col("mean"), F.col("std"))
    spread = F.sqrt(_sharpe_spread(sharpe, F.col("skew"), F.col("kurt")))
    return rows.withColumn(name, norm_cdf((sharpe - bar) * F.sqrt(F.col("n") - 1) / spread)).drop("_q1", "_q2")


# --- verdict -----------------------------------------------------------------------------------


def evidence(summary: DataFrame, adjusted: DataFrame, effective: DataFrame, ppy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tests and stress figures of the rules that passed the gate."""
    keys = list(keys)
    spread = summary.filter(F.col("varies") & (F.col("n") >= 3) & F.col("status").isin(PASSED, FEW)).groupBy(*keys).agg(
        F.coalesce(F.var_samp(F.try_divide(F.col("mean"), F.col("std"))), F.lit(0.0)).alias("sharpe_variance")
    )
    rows = summary.filter(F.col("status") == PASSED).join(adjusted, [*keys, "rule_no"]).join(spread, keys).join(effective, keys).join(ppy, keys)
    for trials, name in (("n_point", "dsr"), ("n_low", "dsr_low_n"), ("n_high", "dsr_high_n")):
        rows = deflated_sharpe(rows, F.col(trials), F.col("sharpe_variance"), name)
    year = F.sqrt("periods_per_year")
    sharpe = F.try_divide(F.col("mean"), F.col("std"))
    gross, base = F.greatest(F.lit(0.0), F.col("trade_gross")) * 1e4, (F.col("trade_gross") - F.col("trade_0")) * 1e4
    stress = {f"sharpe_x{m}": F.when(F.col(f"varies_{j}"), F.try_divide(F.col(f"mean_{j}"), F.col(f"std_{j}")) * year) for j, m in enumerate(STRESS)}
    rows = rows.withColumns({
        "sharpe": sharpe * year, "sharpe_se": F.sqrt(_sharpe_spread(sharpe, F.col("skew"), F.col("kurt")) / (F.col("n") - 1)) * year,
        "mean_trade_return_pct": F.col("trade_0") * 100, "break_even_bps": gross, "base_round_trip_bps": base, "break_even_multiple": F.when(base > 0, gross / base),
        **stress, **{f"trade_x{m}_pct": F.col(f"trade_{j}") * 100 for j, m in enumerate(STRESS)}, **{f"total_x{m}_pct": F.col(f"total_{j}") * 100 for j, m in enumerate(STRESS)},
    })
    rows = rows.withColumns({
        "check_bootstrap": F.col("adjusted_p") < ALPHA, "check_dsr": F.coalesce(F.col("dsr") >= DSR_THRESHOLD, F.lit(False)),
        "check_stress": F.coalesce((F.col(f"`trade_x{STRESS_CHECK}_pct`") > 0) & (F.col(f"`sharpe_x{STRESS_CHECK}`") > 0), F.lit(False)),
    })
    return rows.withColumn("candidate", F.col("check_bootstrap") & F.col("check_dsr") & F.col("check_stress"))


def labels(summary: DataFrame, proof: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One label per series with the rules behind it."""
    keys = list(keys)
    checks = proof.select(*keys, "rule_no", "rule", "candidate", "check_bootstrap", "check_dsr", "check_stress")
    joined = summary.select(*keys, "rule_no", "status", "trades").join(checks, [*keys, "rule_no"], "left")
    failing = lambda c: F.array_sort(F.collect_list(F.when(~F.col(c), F.col("rule"))))
    grouped = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rules"), F.count_if(F.col("status") == PASSED).alias("passed"), F.count_if(F.col("status") == NEVER).alias("never_traded"),
        F.count_if(F.col("status") == ERROR).alias("errors"), F.max("trades").alias("most_trades"),
        F.array_sort(F.collect_list(F.when(F.col("candidate"), F.col("rule")))).alias("candidates"),
        failing("check_bootstrap").alias("fail_bootstrap"), failing("check_dsr").alias("fail_dsr"), failing("check_stress").alias("fail_stress"),
    )
    return grouped.withColumn(
        "label", F.when(F.col("passed") == 0, "INSUFFICIENT_DATA").when(F.size("candidates") > 0, "CANDIDATE").otherwise("INDISTINGUISHABLE_FROM_LUCK")
    )


def effective_rules(estimate: DataFrame, ratios: DataFrame, keys: Sequence[str], trials: DataFrame | None, grid: int) -> DataFrame:
    """Effective number of rules, its 90% interval, and both scaled by the trials ever made."""
    keys, tail = list(keys), (1 - EFFECTIVE_N_LEVEL) / 2
    interval = key_quantiles(ratios, keys, "ratio", {"_low": tail, "_high": 1 - tail})
    rows = estimate.join(interval, keys, "left")
    rows = rows.join(trials, keys, "left") if trials is not None else rows.withColumn("trials", F.lit(float(grid)))
    scale = F.greatest(F.lit(1.0), F.coalesce(F.col("trials"), F.lit(grid)) / grid)
    low, high = F.least("_low", "estimate"), F.greatest("_high", "estimate")
    return rows.select(
        *keys, "rules_used", "estimate", low.alias("low"), high.alias("high"),
        (F.col("estimate") * scale).alias("n_point"), (low * scale).alias("n_low"), (high * scale).alias("n_high"),
    )


def verdict(
    df: DataFrame,
    costs: Costs = Costs(),
    min_trades: int = MIN_TRADES,
    ppy: float | None = None,
    seeds: DataFrame | None = None,
    trials: DataFrame | None = None,
    rules: Sequence[Rule] | None = None,
    layout: Layout | None = None,
    replicates: int = REPLICATES,
    correlated: int = PARTICIPATION_REPLICATES,
    target_of: Callable[[Series, Rule], Ref] = target,
) -> dict[str, DataFrame]:
    """The whole report as tables: summary, evidence, labels, effective_n, pbo, periods.

    ``target_of`` gives the target of a rule; ``rule_functions.with_functions`` makes one of plain functions.
    ``seeds`` has one ``seed`` per series (see ``bootstrap_seed``); without it the key's hash is used.
    """
    layout = layout or plan_layout(df)
    keys, chosen = list(layout.keys), list(rules or strategy_grid())
    # The fills feed four reports; they are written once to the shared checkpoint folder.
    wide = cut_lineage(fills_wide(df, costs, chosen, layout, target_of))
    rows = _long(wide, chosen, layout)
    factor = periods_per_year(df, ppy, layout)
    summary = cut_lineage(rule_summary(rows, keys, min_trades))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("block", mean_block_length(F.col("n")))
    hashed = F.pmod(F.xxhash64(*keys), F.lit(2**32)).alias("seed")
    seeded = sizes.select("*", hashed) if seeds is None else sizes.join(seeds, keys)
    means, ratios = map(cut_lineage, bootstrap(wide, chosen, layout, seeded, replicates, correlated))
    passing = summary.filter(F.col("status") == PASSED)
    observed = passing.select(*keys, "rule_no", "exposure", (F.col("mean") - F.col("exposure") * F.col("bench_mean")).alias("excess"))
    adjusted = stepdown(means, observed, keys)
    effective = effective_rules(participation(wide, chosen, keys), ratios, keys, trials, len(chosen))
    proof = evidence(summary, adjusted, effective, factor, keys)
    return {
        "summary": summary, "evidence": proof, "labels": labels(summary, proof, keys), "effective_n": effective,
        "pbo": overfitting(rows, passing, keys), "periods": factor, "fills": rows,
    }


def lookahead_probe(df: DataFrame, rules: Sequence[Rule] | None = None, target_of: Callable[[Series, Rule], Ref] = target, layout: Layout | None = None) -> DataFrame:
    """Targets that change when later bars are removed: an honest rule yields no rows.

    Each cut keeps the first share of every series and is compared with the uncut targets by key.
    """
    layout = layout or plan_layout(df)
    keys, order, chosen = list(layout.keys), layout.order, list(rules or strategy_grid())
    from barloom.operators.downsample import numbered

    # Numbered bars and their targets are stored once; each cut is one wide join on them.
    rows = cut_lineage(numbered(df, layout)[0])

    def targets_of(part: DataFrame) -> DataFrame:
        s = Series(part, layout)
        for k, rule in enumerate(chosen):
            s.output(f"_t{k}", target_of(s, rule))
        return s.build().select(*keys, order, F.array(*(F.col(f"_t{k}") for k in range(len(chosen)))).alias("_targets"))

    whole, found = cut_lineage(targets_of(rows).withColumnRenamed("_targets", "_whole")), None
    names = F.array(*(F.lit(r.id) for r in chosen))
    for share in PROBE_FRACTIONS:
        cut = targets_of(rows.filter(F.col("_i") < F.greatest(F.lit(2), F.floor(F.col("_n") * share))))
        differs = cut.join(whole, [*keys, order]).filter(~F.col("_targets").eqNullSafe(F.col("_whole")))
        moved = F.filter(F.sequence(F.lit(0), F.lit(len(chosen) - 1)), lambda k: ~F.get("_targets", k).eqNullSafe(F.get("_whole", k)))
        part = differs.select(*keys, order, F.explode(F.transform(moved, lambda k: F.get(names, k))).alias("rule"), F.lit(share).alias("cut"))
        found = part if found is None else found.unionByName(part)
    return found
