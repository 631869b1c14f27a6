"""Checked queries: rule grid, metrics, result table and its filter and sort."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import backtest as bt
from barloom.operators import filters as fl
from barloom.sources.ticks import order_bars
from oracle.checks import check, rounded, seconds, table
from oracle.research import DIGITS, REAL, RELATIVE, grid_ctes, metrics_sql, results_cte, rule_targets
from oracle.series import ORDER_BARS, Q
from oracle.series import rounded as r


def obars(spark, d):
    return order_bars(table(spark, d, "orders"))


def _targets_sql():
    q = Q(ORDER_BARS)
    cells = [f"{{'rule': '{k}', 'target': {t}, 'position': coalesce({q.lag(t)}, 0.0::DOUBLE)}}" for k, t in rule_targets(q).items()]
    return f"SELECT symbol, ts, c.rule AS rule, c.target AS target, c.position AS position FROM ({q.select(f'symbol, epoch(ts)::BIGINT AS ts, unnest([' + ', '.join(cells) + ']) AS c')})"


@check("strategy_targets", _targets_sql())
def _targets(spark, d):
    return bt.targets(obars(spark, d)).select("symbol", seconds("ts").alias("ts"), "rule", "target", "position")


@check("research_metrics", metrics_sql())
def _metrics(spark, d):
    df = bt.research(obars(spark, d))
    return df.select("symbol", "rule", "window", seconds("start").alias("start"), seconds("end").alias("end"), "bars", "trades", *(rounded(m, DIGITS).alias(m) for m in REAL))


NUMBERS = [f"{w}_{m}" for w in ("full_sample", "in_sample", "forward") for m in REAL]


@check("research_results", f"WITH {results_cte()} SELECT symbol, rule, fold_count, fold_positive, {', '.join(f'{r(c, DIGITS)} AS {c}' for c in [*NUMBERS, *RELATIVE])} FROM results")
def _results(spark, d):
    df = bt.result_table(bt.research(obars(spark, d)))
    return df.select("symbol", "rule", "fold_count", "fold_positive", *(rounded(c, DIGITS).alias(c) for c in [*NUMBERS, *RELATIVE]))


RESULT_FILTER = fl.all_of(fl.condition("full_sample_sharpe", "gt", 0), fl.condition("rule", "starts_with", text="SMA"), fl.condition("full_sample_sharpe", "rising", 2, enabled=False))


@check("research_filtered", f"WITH {results_cte()} SELECT symbol, rule, {r('full_sample_sharpe', DIGITS)} AS full_sample_sharpe FROM results WHERE full_sample_sharpe > 0 AND rule LIKE 'sma%'")
def _filtered(spark, d):
    kept, _ = fl.filter_table(bt.result_table(bt.research(obars(spark, d))), RESULT_FILTER)
    return kept.select("symbol", "rule", rounded("full_sample_sharpe", DIGITS).alias("full_sample_sharpe"))


@check("research_top12", f"WITH {results_cte()} SELECT symbol, rule, {r('forward_sharpe', DIGITS)} AS forward_sharpe FROM results ORDER BY results.forward_sharpe DESC NULLS LAST, symbol, rule LIMIT 12")
def _top(spark, d):
    return bt.best_rules(bt.result_table(bt.research(obars(spark, d)))).select("symbol", "rule", rounded("forward_sharpe", DIGITS).alias("forward_sharpe"))


@check("equity_curve", f"""WITH {grid_ctes()}, c AS (SELECT symbol, i, n, epoch(ts)::BIGINT AS ts, product(greatest(0, 1 + net)) OVER (PARTITION BY symbol ORDER BY i) AS equity FROM long WHERE rule = 'sma-5-20')
 SELECT symbol, ts, {r('equity', 8)} AS equity FROM c WHERE i % greatest(1, ceil(n / 240.0))::BIGINT = 0 OR i = n - 1""")
def _curve(spark, d):
    return bt.equity_curve(obars(spark, d), bt.strategy_grid()[0]).select("symbol", seconds("ts").alias("ts"), rounded("equity", 8).alias("equity"))


@check("out_of_sample_bars", f"""WITH {grid_ctes()} SELECT symbol, epoch(ts)::BIGINT AS ts, w AS fold FROM (SELECT DISTINCT symbol, i, ts FROM long) l JOIN win USING (symbol)
 WHERE w LIKE 'fold_%' AND i >= lo AND i < hi""")
def _oos(spark, d):
    from barloom.operators.downsample import numbered

    rows, _ = numbered(obars(spark, d))
    fold = bt.segment(F.col("_i"), F.col("_n"))
    return rows.withColumn("fold", F.concat(F.lit("fold_"), fold.cast("string"))).filter(fold > 0).select("symbol", seconds("ts").alias("ts"), "fold")


