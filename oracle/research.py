"""SQL twins of the rule grid."""

from __future__ import annotations

from barloom.operators.backtest import METRICS, RSI_LEVELS, SMA_PAIRS
from oracle.series import BY, ORDER_BARS, Q
from oracle.series import rounded as r


def rule_targets(q: Q) -> dict[str, str]:
    found = {}
    for f, s in SMA_PAIRS:
        found[f"sma-{f}-{s}"] = q.add(f"CASE WHEN {q.mean('close', f)} > {q.mean('close', s)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")
    for e, x in RSI_LEVELS:
        v = q.rsi(14)
        event = q.add(f"CASE WHEN {v} >= {x} THEN 0.0::DOUBLE WHEN {v} <= {e} THEN 1.0::DOUBLE END")
        found[f"rsi-{e}-{x}"] = q.add(f"coalesce(last_value({event} IGNORE NULLS) OVER ({BY} ROWS UNBOUNDED PRECEDING), 0.0::DOUBLE)")
    return found


def grid_ctes(source: str = ORDER_BARS, fee: float = 0.0005) -> str:
    """``long`` (symbol, rule, rn, n, ts, pos, net) and the metric tables for every window."""
    q = Q(source)
    held = {rule: q.add(f"coalesce({q.lag(t)}, 0.0)") for rule, t in rule_targets(q).items()}
    ret = q.add(f"coalesce({q.change('close')}, 0.0)")
    cells = [f"{{'rule': '{k}', 'pos': {p}, 'net': {p} * {ret} - abs({p} - coalesce({q.lag(p)}, 0.0)) * {fee}}}" for k, p in held.items()]
    cells.append(f"{{'rule': 'buy-hold', 'pos': 1.0, 'net': {ret}}}")
    n = q.add("count(*) OVER (PARTITION BY symbol)")
    body = q.select(f"symbol, ts, rn - 1 AS i, {n} AS n, unnest([{', '.join(cells)}]) AS c")
    return f"""long AS (SELECT symbol, ts, i, n, c.rule AS rule, c.pos AS pos, c.net AS net FROM ({body})),
sizes AS (SELECT symbol, any_value(n) AS n, greatest(1, floor(any_value(n) * CASE WHEN any_value(n) < 50 THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END))::INT AS s FROM long GROUP BY 1),
win AS (SELECT symbol, 'full_sample' AS w, 0 AS lo, n AS hi FROM sizes UNION ALL SELECT symbol, 'in_sample', 0, s FROM sizes UNION ALL SELECT symbol, 'forward', s, n FROM sizes
 UNION ALL SELECT symbol, 'fold_' || k, floor(s + (k - 1) * ((n - s) / 4.0::DOUBLE))::INT, floor(s + k * ((n - s) / 4.0::DOUBLE))::INT FROM sizes, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE n >= 50),
moves AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY symbol, rule ORDER BY i), 0.0) AS prev FROM long),
marks AS (SELECT *, sum(CASE WHEN pos > 0 AND prev = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, rule ORDER BY i) AS tid FROM moves),
trades AS (SELECT symbol, rule, tid, min(i) AS a, max(i) FILTER (WHERE pos = 0) AS z, product(greatest(0, 1 + net)) AS growth FROM marks
 WHERE (pos > 0 OR prev > 0) AND tid > 0 GROUP BY 1, 2, 3),
x AS (SELECT long.*, w, product(greatest(0, 1 + net)) OVER (PARTITION BY long.symbol, rule, w ORDER BY i) AS e FROM long JOIN win ON win.symbol = long.symbol AND i >= lo AND i < hi),
y AS (SELECT *, e / max(e) OVER (PARTITION BY symbol, rule, w ORDER BY i) - 1 AS dd FROM x),
g AS (SELECT symbol, rule, w, count(*) AS bars, arg_max(e, i) AS fin, avg(net) AS m, coalesce(stddev_samp(net), 0) AS sd, sqrt(avg(pow(least(net, 0), 2))) AS dn, min(dd) * 100 AS mdd,
 avg((pos > 0)::INT) * 100 AS exposure, min(ts) AS start, max(ts) AS "end" FROM y GROUP BY 1, 2, 3),
tr AS (SELECT t.symbol, t.rule, w, count(*) AS trades, count(*) FILTER (WHERE growth > 1) AS wins FROM trades t JOIN win ON win.symbol = t.symbol AND a >= lo AND z < hi WHERE z IS NOT NULL GROUP BY 1, 2, 3),
metrics AS (SELECT g.symbol, g.rule, g.w AS "window", start, "end", bars, (fin - 1) * 100 AS total_return_pct, CASE WHEN fin > 0 THEN (pow(fin, 252.0 / bars) - 1) * 100 ELSE -100 END AS cagr_pct,
 sd * sqrt(252) * 100 AS annualized_volatility_pct, CASE WHEN sd > 0 THEN m / sd * sqrt(252) END AS sharpe, CASE WHEN dn > 0 THEN m / dn * sqrt(252) END AS sortino, mdd AS max_drawdown_pct,
 CASE WHEN mdd < 0 THEN CASE WHEN fin > 0 THEN (pow(fin, 252.0 / bars) - 1) * 100 ELSE -100 END / abs(mdd) END AS calmar, coalesce(trades, 0) AS trades, wins * 100.0 / nullif(trades, 0) AS win_rate_pct, exposure AS exposure_pct
 FROM g LEFT JOIN tr ON tr.symbol = g.symbol AND tr.rule = g.rule AND tr.w = g.w WHERE g.rule <> 'buy-hold' OR g.w = 'full_sample')"""


REAL = [m for m in METRICS if m not in ("bars", "trades")]
DIGITS = 5


def metrics_sql() -> str:
    body = ", ".join(f"{r(m, DIGITS)} AS {m}" for m in REAL)
    return f'WITH {grid_ctes()} SELECT symbol, rule, "window", epoch(start)::BIGINT AS start, epoch("end")::BIGINT AS "end", bars, trades, {body} FROM metrics'


def results_cte() -> str:
    main = ("full_sample", "in_sample", "forward")
    wide = ", ".join(f"max({m}) FILTER (WHERE \"window\" = '{w}') AS {w}_{m}" for w in main for m in METRICS)
    fold = "\"window\" LIKE 'fold_%'"
    return f"""{grid_ctes()}, bench AS (SELECT symbol, total_return_pct AS b_ret, sharpe AS b_sharpe, max_drawdown_pct AS b_dd FROM metrics WHERE rule = 'buy-hold'),
 wide AS (SELECT symbol, rule, {wide}, count(*) FILTER (WHERE {fold}) AS fold_count, count(*) FILTER (WHERE {fold} AND total_return_pct > 0) AS fold_positive,
 avg(sharpe) FILTER (WHERE {fold}) AS fold_sharpe_mean, min(sharpe) FILTER (WHERE {fold}) AS fold_sharpe_min, avg(total_return_pct) FILTER (WHERE {fold}) AS fold_return_mean,
 min(total_return_pct) FILTER (WHERE {fold}) AS fold_return_min, min(max_drawdown_pct) FILTER (WHERE {fold}) AS fold_drawdown_worst FROM metrics WHERE rule <> 'buy-hold' GROUP BY 1, 2),
 results AS (SELECT wide.*, full_sample_total_return_pct - b_ret AS rel_excess_return, full_sample_sharpe - b_sharpe AS rel_sharpe_delta, full_sample_max_drawdown_pct - b_dd AS rel_drawdown_gain,
 forward_sharpe - in_sample_sharpe AS rel_forward_vs_insample, CASE WHEN in_sample_sharpe > 0 THEN forward_sharpe / in_sample_sharpe END AS rel_forward_retention,
 1 + full_sample_total_return_pct / 100 AS final_equity FROM wide LEFT JOIN bench USING (symbol))"""


RELATIVE = ("rel_excess_return", "rel_sharpe_delta", "rel_drawdown_gain", "rel_forward_vs_insample", "rel_forward_retention", "final_equity",
            "fold_sharpe_mean", "fold_sharpe_min", "fold_return_mean", "fold_return_min", "fold_drawdown_worst")
