"""Checked queries: filter operators, groups, matches, presets and the event study."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import filters as fl
from barloom.operators.event_study import event_study
from barloom.operators.presets import preset_filters, scan_presets
from barloom.plans import explorer
from barloom.sources.ticks import event_bars
from oracle.checks import check, rounded, seconds, table
from oracle.series import BY, Q

RSI, SMA = "rsi(period=14).value", "sma(period=20).value"


def bars(spark, sf_dir):
    return event_bars(table(spark, sf_dir, "events"))


def _leaf(name: str, tree: dict, build):
    """Register ``filter_<name>``: matching (symbol, ts) of a tree on the event bars."""
    q = Q()
    condition = build(q)
    sql = q.select("symbol, epoch(ts)::BIGINT AS ts", f"WHERE coalesce({condition}, FALSE)")

    @check(f"filter_{name}", sql)
    def run(spark, sf_dir):
        return fl.matches(bars(spark, sf_dir), tree).select("symbol", seconds("ts").alias("ts"))


_leaf("gt", fl.all_of(fl.condition(RSI, "gt", 60)), lambda q: f"{q.rsi()} > 60")
_leaf("gte", fl.all_of(fl.condition("close", "gte", rhs=SMA)), lambda q: f"close >= {q.mean('close', 20)}")
_leaf("lt", fl.all_of(fl.condition(RSI, "lt", 45)), lambda q: f"{q.rsi()} < 45")
_leaf("lte", fl.all_of(fl.condition("volume", "lte", 2)), lambda q: "volume <= 2")
_leaf("eq", fl.all_of(fl.condition("volume", "eq", 3)), lambda q: "abs(volume - 3) <= 1e-12 * greatest(1, abs(volume), 3)")
_leaf("neq", fl.all_of(fl.condition("open", "neq", rhs="close")), lambda q: "abs(open - close) > 1e-12 * greatest(1, abs(open), abs(close))")
_leaf("between", fl.all_of(fl.condition(RSI, "between", 55, 45)), lambda q: f"{q.rsi()} BETWEEN 45 AND 55")
_leaf("outside", fl.all_of(fl.condition(RSI, "outside", 40, 60)), lambda q: f"({q.rsi()} < 40 OR {q.rsi()} > 60)")
_leaf(
    "crosses_above", fl.all_of(fl.condition("close", "crosses_above", rhs=SMA)),
    lambda q: f"{q.lag('close')} <= {q.lag(q.mean('close', 20))} AND close > {q.mean('close', 20)}",
)
_leaf("crosses_below", fl.all_of(fl.condition(RSI, "crosses_below", 50)), lambda q: f"{q.lag(q.rsi())} >= 50 AND {q.rsi()} < 50")


def _run(q, sign, n):
    up = q.add(f"CASE WHEN close {sign} {q.lag('close')} THEN 1 END")
    return f"count({up}) {q.frame(n)} = {n}"


_leaf("rising", fl.all_of(fl.condition("close", "rising", 3)), lambda q: q.add(_run(q, ">", 3)))
_leaf("falling", fl.all_of(fl.condition("close", "falling", 2)), lambda q: q.add(_run(q, "<", 2)))


def _extreme(q, f, sign, n):
    w = f"OVER ({BY} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return q.add(f"count(close) {w} = {n} AND close {sign} {f}(close) {w}")


_leaf("new_high", fl.all_of(fl.condition("close", "new_high", 20)), lambda q: _extreme(q, "max", ">", 20))
_leaf("new_low", fl.all_of(fl.condition("close", "new_low", 20)), lambda q: _extreme(q, "min", "<", 20))
_leaf(
    "top_pct", fl.all_of(fl.condition(RSI, "top_pct", 10)),
    lambda q: q.add(f"{q.rsi()} >= quantile_cont({q.rsi()}, 0.9) OVER (PARTITION BY symbol)"),
)
_leaf(
    "bottom_pct", fl.all_of(fl.condition("close", "bottom_pct", 5)),
    lambda q: q.add("close <= quantile_cont(close, 0.05) OVER (PARTITION BY symbol)"),
)
_leaf("is_valid", fl.all_of(fl.condition(SMA, "is_valid")), lambda q: f"{q.mean('close', 20)} IS NOT NULL")
_leaf("is_missing", fl.all_of(fl.condition(RSI, "is_missing")), lambda q: f"{q.rsi()} IS NULL")
_leaf("in", fl.all_of(fl.condition("symbol", "in", text=" CLICK, view ,")), lambda q: "lower(symbol) IN ('click', 'view')")
_leaf("not_in", fl.all_of(fl.condition("symbol", "not_in", text="click,error")), lambda q: "lower(symbol) NOT IN ('click', 'error')")
_leaf("contains", fl.all_of(fl.condition("symbol", "contains", text="I")), lambda q: "contains(lower(symbol), 'i')")
_leaf("starts_with", fl.all_of(fl.condition("symbol", "starts_with", text="S")), lambda q: "starts_with(lower(symbol), 's')")

NESTED = fl.all_of(
    fl.any_of(fl.condition(RSI, "lt", 45), fl.condition("volume", "new_high", 20)),
    fl.all_of(fl.condition("close", "gt", rhs=SMA), negate=True),
    fl.condition("close", "gt", 1e9, enabled=False),
    fl.condition("", "gt", 1),
    fl.any_of(),
)


def _nested(q):
    w = f"OVER ({BY} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
    high = q.add(f"coalesce(count(volume) {w} = 20 AND volume > max(volume) {w}, FALSE)")
    return f"(coalesce({q.rsi()} < 45, FALSE) OR {high}) AND NOT coalesce(close > {q.mean('close', 20)}, FALSE)"


_leaf("groups", NESTED, _nested)


def _invalid_sql():
    issues = ["the number of bars starts at 1", "a share lies over 0 and up to 100 percent", "no number column named nope", "no text column named close"]
    return " UNION ALL ".join(f"SELECT '{issue}' AS issue, 0::BIGINT AS matched" for issue in issues)


@check("filter_invalid_conditions", _invalid_sql())
def _invalid(spark, sf_dir):
    """Each invalid condition matches nothing and is reported."""
    from functools import reduce

    from barloom.operators.series import Series

    df = bars(spark, sf_dir)
    wrong = [
        fl.condition("close", "rising", 0.5), fl.condition("close", "top_pct", 101),
        fl.condition("nope", "gt", 1), fl.condition("close", "in", text="x"),
    ]
    parts = []
    for leaf in wrong:
        s = Series(df)
        compiled = fl.compile_filter(fl.BarFields(s), fl.all_of(leaf))
        s.output("_hit", compiled.mask)
        parts.append(s.build().agg(F.lit(compiled.issues[0]).alias("issue"), F.count_if("_hit").alias("matched")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _counts_sql():
    q = Q()
    c = _nested(q)
    return q.select(f"symbol, count(*) FILTER (WHERE {c}) AS matched, count(*) AS total", "GROUP BY symbol")


@check("filter_counts", _counts_sql())
def _counts(spark, sf_dir):
    return fl.match_counts(bars(spark, sf_dir), NESTED).select("symbol", "matched", "total")


def _onset_sql():
    q = Q()
    hit = q.add(f"coalesce(close > {q.mean('close', 20)}, FALSE)")
    first = q.add(f"{hit} AND NOT coalesce(lag({hit}) OVER ({BY}), FALSE)")
    return q.select("symbol, epoch(ts)::BIGINT AS ts", f"WHERE {first}")


@check("filter_matches_onset", _onset_sql())
def _onset(spark, sf_dir):
    tree = fl.all_of(fl.condition("close", "gt", rhs=SMA))
    return fl.matches(bars(spark, sf_dir), tree, onset_only=True).select("symbol", seconds("ts").alias("ts"))


@check(
    "filter_bars_slice",
    "WITH " + Q().source.strip() + """, cut AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM bars
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20')
    SELECT symbol, epoch(ts)::BIGINT AS ts, close FROM cut WHERE n <= 50""",
)
def _slice(spark, sf_dir):
    cut = explorer.bars_slice(bars(spark, sf_dir), start="2024-01-05", end="2024-01-20", limit=50)
    return cut.select("symbol", seconds("ts").alias("ts"), "close")


def _select_sql():
    q = Q()
    return q.outputs(close="close", rsi=q.rsi(), sma=q.mean("close", 20))


@check("filter_select_columns", _select_sql())
def _select(spark, sf_dir):
    tree = fl.all_of(fl.condition(RSI, "lt", 35), fl.condition("close", "gt", rhs=SMA))
    df = fl.select_columns(bars(spark, sf_dir), tree)
    return df.select("symbol", seconds("ts").alias("ts"), rounded("close").alias("close"), rounded(df[f"`{RSI}`"]).alias("rsi"), rounded(df[f"`{SMA}`"]).alias("sma"))


PRESETS = [
    "close:new_high:20", "volume:new_low:55", "low:rising:3", "volume:top10", f"{SMA}:close>", f"{SMA}:closev",
    f"{RSI}:gt-high", f"{RSI}:x-low", f"{RSI}:between", f"{RSI}:falling", f"{RSI}:hi20", f"{RSI}:bottom10",
]


def _presets_sql():
    q = Q()
    r, m = q.rsi(), q.mean("close", 20)

    def extreme(x, f, sign, n):
        w = f"OVER ({BY} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        return q.add(f"count({x}) {w} = {n} AND {x} {sign} {f}({x}) {w}")

    def run(x, sign):
        step = q.add(f"CASE WHEN {x} {sign} {q.lag(x)} THEN 1 END")
        return q.add(f"count({step}) {q.frame(3)} = 3")

    tests = [
        extreme("close", "max", ">", 20), extreme("volume", "min", "<", 55), run("low", ">"),
        q.add("volume >= quantile_cont(volume, 0.9) OVER (PARTITION BY symbol)"),
        f"close > {m}", f"{q.lag('close')} >= {q.lag(m)} AND close < {m}",
        f"{r} > 70", f"{q.lag(r)} >= 30 AND {r} < 30",
        f"{r} BETWEEN 30 AND 70", run(r, "<"), extreme(r, "max", ">", 20),
        q.add(f"{r} <= quantile_cont({r}, 0.1) OVER (PARTITION BY symbol)"),
    ]
    cells = ", ".join(f"{{'preset_id': '{p}', 'hit': coalesce({t}, FALSE)}}" for p, t in zip(PRESETS, tests))
    body = q.select(f"symbol, ts, unnest([{cells}]) AS c")
    return (
        f"SELECT symbol, c.preset_id AS preset_id, count(*) FILTER (WHERE c.hit) AS matches, "
        f"epoch(max(ts) FILTER (WHERE c.hit))::BIGINT AS last_match FROM ({body}) GROUP BY 1, 2"
    )


@check("filter_presets", _presets_sql())
def _presets(spark, sf_dir):
    df = scan_presets(bars(spark, sf_dir), PRESETS)
    return df.select("symbol", "preset_id", "matches", seconds("last_match").alias("last_match"))


FLAGSHIP = fl.all_of(fl.condition(RSI, "lt", 45), fl.condition("close", "gt", rhs=SMA))


def study_sql(build, horizons, onset=False):
    q = Q()
    hit = q.add(f"coalesce({build(q)}, FALSE)")
    if onset:
        hit = q.add(f"{hit} AND NOT coalesce(lag({hit}) OVER ({BY}), FALSE)")
    cells = ", ".join(f"{{'h': {h}, 'r': {q.add(f'lead(close, {h}) OVER ({BY}) / close - 1')}}}" for h in horizons)
    body = q.select(f"symbol, {hit} AS hit, unnest([{cells}]) AS c")
    e = "CASE WHEN hit THEN c.r END"
    from oracle.series import rounded as r

    return f"""WITH long AS ({body}), g AS (SELECT symbol, c.h::INTEGER AS horizon, count(*) FILTER (WHERE hit) AS events, count({e}) AS n,
      avg(CASE WHEN {e} > 0 THEN 1.0 WHEN {e} <= 0 THEN 0.0 END) AS hit_rate, avg({e}) AS mean, median({e}) AS median, stddev_samp({e}) AS std,
      max({e}) AS best, min({e}) AS worst, avg(c.r) AS baseline_mean FROM long GROUP BY 1, 2)
      SELECT symbol, horizon, events, n, {r('hit_rate')} AS hit_rate, {r('mean')} AS mean, {r('median')} AS median, {r('std')} AS std,
      {r('best')} AS best, {r('worst')} AS worst, {r('baseline_mean')} AS baseline_mean, {r('mean - baseline_mean')} AS excess_mean,
      {r('CASE WHEN std > 0 THEN mean / (std / sqrt(n)) END')} AS t_stat FROM g"""


STATS = ("hit_rate", "mean", "median", "std", "best", "worst", "baseline_mean", "excess_mean", "t_stat")


def study_columns(df):
    return df.select("symbol", "horizon", "events", "n", *(rounded(c).alias(c) for c in STATS))


@check("explorer_flagship", study_sql(lambda q: f"{q.rsi()} < 45 AND close > {q.mean('close', 20)}", (1, 5, 10)))
def _flagship(spark, sf_dir):
    return study_columns(explorer.filter_study(bars(spark, sf_dir), FLAGSHIP, horizons=(1, 5, 10)))


@check("event_study", study_sql(lambda q: f"{q.rsi()} > 50", (1, 5, 10, 20, 50)))
def _study(spark, sf_dir):
    return study_columns(event_study(bars(spark, sf_dir), fl.all_of(fl.condition(RSI, "gt", 50))))


@check("event_study_onset", study_sql(lambda q: f"close > {q.mean('close', 20)}", (1, 20), onset=True))
def _study_onset(spark, sf_dir):
    tree = fl.all_of(fl.condition("close", "gt", rhs=SMA))
    return study_columns(event_study(bars(spark, sf_dir), tree, (1, 20), onset_only=True))


assert set(PRESETS) <= set(preset_filters())
