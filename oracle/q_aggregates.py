"""Checked queries: per-series reports, downsampling, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import aggregates as ag
from barloom.operators import downsample as ds
from barloom.sources.ticks import event_bars, order_bars
from oracle.checks import check, rounded, seconds, table
from oracle.series import BY, EVENT_BARS, ORDER_BARS, Q
from oracle.series import rounded as r


def ebars(spark, d):
    return event_bars(table(spark, d, "events"))


def obars(spark, d):
    return order_bars(table(spark, d, "orders"))


def cols(pairs: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"{r(x, digits)} AS {n}" for n, x in pairs.items())


def rnd(*names, digits=6):
    return [rounded(n, digits).alias(n) for n in names]


RET = f"""e AS (SELECT *, 100 * (close / lag(close) OVER ({BY}) - 1) AS ret, epoch(ts) - lag(epoch(ts)) OVER ({BY}) AS gap,
 row_number() OVER ({BY}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"""
EV, OR = f"WITH {EVENT_BARS.strip()}, {RET}", f"WITH {ORDER_BARS.strip()}, {RET}"


@check("quality_report", f"""{EV}, m AS (SELECT symbol, median(gap) AS med FROM e GROUP BY 1),
 g AS (SELECT symbol, count(*) AS gaps, max(gap)::DOUBLE AS longest FROM e JOIN m USING (symbol) WHERE gap > med * 1.5 GROUP BY 1)
 SELECT e.symbol, count(*) AS valid_rows, epoch(min(ts))::BIGINT AS start, epoch(max(ts))::BIGINT AS "end", any_value(med)::DOUBLE AS median_interval_seconds,
 coalesce(any_value(gaps), 0) AS gaps, any_value(longest) AS longest_gap_seconds FROM e JOIN m USING (symbol) LEFT JOIN g USING (symbol) GROUP BY 1""")
def _quality(spark, d):
    return ag.quality_report(ebars(spark, d)).select(
        "symbol", "valid_rows", seconds("start").alias("start"), seconds("end").alias("end"), "median_interval_seconds", "gaps", "longest_gap_seconds"
    )


@check("quality_gaps", f"""{EV}, m AS (SELECT symbol, median(gap) AS med FROM e GROUP BY 1)
 SELECT symbol, epoch(ts)::BIGINT AS after, gap::DOUBLE AS seconds FROM e JOIN m USING (symbol) WHERE gap > med * 1.5""")
def _gaps(spark, d):
    return ag.quality_gaps(ebars(spark, d)).select("symbol", seconds("after").alias("after"), "seconds")


def _market_sql():
    q = Q()
    v = {
        "sma_20": q.mean("close", 20), "ema_20": q.ema("close", 20), "rsi_14": q.rsi(14), "macd": q.add(f"{q.ema('close', 12)} - {q.ema('close', 26)}"),
        "atr_14": q.mean(q.tr(), 14), "vwap": q.add(f"{q.run('sum', q.add(f'{q.tp()} * volume'))} / nullif({q.run('sum', 'volume')}, 0)"),
        "bollinger_upper": q.add(f"{q.mean('close', 20)} + 2 * {q.std('close', 20, 0)}"), "bollinger_lower": q.add(f"{q.mean('close', 20)} - 2 * {q.std('close', 20, 0)}"),
        "support_20": q.add(f"min(low) {q.frame(20)}"), "resistance_20": q.add(f"max(high) {q.frame(20)}"),
    }
    v["macd_signal"] = q.ema(v["macd"], 9)
    first = q.add(f"first_value(close) OVER ({BY})")
    last = q.add("rn = count(*) OVER (PARTITION BY symbol)")
    extra = {
        "open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume",
        "period_return_pct": f"(close / {first} - 1) * 100", "range_pct": "(high - low) / open * 100", "atr_pct": f"{v['atr_14']} / close * 100",
    }
    labels = (
        f"CASE WHEN {v['rsi_14']} IS NULL THEN 'unavailable' WHEN {v['rsi_14']} >= 70 THEN 'overbought' WHEN {v['rsi_14']} <= 30 THEN 'oversold' ELSE 'neutral' END AS rsi_signal, "
        f"CASE WHEN {v['macd']} IS NULL OR {v['macd_signal']} IS NULL THEN 'unavailable' WHEN {v['macd']} >= {v['macd_signal']} THEN 'bullish' ELSE 'bearish' END AS macd_signal_label, "
        f"CASE WHEN {v['ema_20']} IS NULL THEN 'unavailable' WHEN close >= {v['ema_20']} THEN 'above_ema_20' ELSE 'below_ema_20' END AS ema_trend"
    )
    return q.select(f"symbol, epoch(ts)::BIGINT AS time, {cols({**extra, **v})}, {labels}", f"WHERE {last}")


MARKET = ("open", "high", "low", "close", "volume", "period_return_pct", "range_pct", "atr_pct", "sma_20", "ema_20", "rsi_14", "macd",
          "macd_signal", "atr_14", "vwap", "bollinger_upper", "bollinger_lower", "support_20", "resistance_20")


@check("market_report", _market_sql())
def _market(spark, d):
    return ag.market_report(ebars(spark, d)).select("symbol", seconds("time").alias("time"), *rnd(*MARKET), "rsi_signal", "macd_signal_label", "ema_trend")


def _enrich_sql():
    q = Q()
    m, s = q.mean("close", 20), q.std("close", 20, 0)
    line = q.add(f"{q.ema('close', 12)} - {q.ema('close', 26)}")
    return q.outputs(
        sma_20=m, ema_20=q.ema("close", 20), rsi_14=q.rsi(14), ema_12=q.ema("close", 12), ema_26=q.ema("close", 26), macd=line, macd_signal=q.ema(line, 9),
        macd_hist=q.add(f"{line} - {q.ema(line, 9)}"), atr_14=q.mean(q.tr(), 14), bb_middle=m, bb_upper=q.add(f"{m} + 2 * {s}"), bb_lower=q.add(f"{m} - 2 * {s}"),
        vwap=q.add(f"{q.run('sum', q.add(f'{q.tp()} * volume'))} / nullif({q.run('sum', 'volume')}, 0)"),
    )


ENRICHED = ("sma_20", "ema_20", "rsi_14", "ema_12", "ema_26", "macd", "macd_signal", "macd_hist", "atr_14", "bb_middle", "bb_upper", "bb_lower", "vwap")


@check("enrich", _enrich_sql())
def _enrich(spark, d):
    from barloom.operators.indicators import enrich

    return enrich(ebars(spark, d)).select("symbol", seconds("ts").alias("ts"), *rnd(*ENRICHED))


@check("bar_interval", f"{EV} SELECT symbol, count(*) AS bars, count(ret) AS returns, median(gap)::DOUBLE AS interval_seconds, median(gap) < 86400 AS intraday FROM e GROUP BY 1")
def _interval(spark, d):
    return ag.bar_interval(ebars(spark, d)).select("symbol", "bars", "returns", "interval_seconds", "intraday")


STATS = f"""x AS (SELECT symbol, ret FROM e WHERE ret IS NOT NULL),
 s AS (SELECT symbol, count(*) AS count, avg(ret) AS mean_pct, stddev_samp(ret) AS std_pct, skewness(ret) AS skew, kurtosis(ret) AS excess_kurtosis,
 min(ret) AS min_pct, max(ret) AS max_pct, avg((ret > 0)::INT) * 100 AS positive_pct, quantile_cont(ret, 0.05) AS var_95_pct,
 quantile_cont(ret, 0.005) AS low, quantile_cont(ret, 0.995) AS high FROM x GROUP BY 1)"""
DIST = ("mean_pct", "std_pct", "skew", "excess_kurtosis", "min_pct", "max_pct", "positive_pct", "var_95_pct", "cvar_95_pct", "low", "high")


@check("return_distribution", f"""{EV}, {STATS}, t AS (SELECT symbol, avg(ret) FILTER (WHERE ret <= var_95_pct) AS cvar_95_pct, count(*) FILTER (WHERE ret < low) AS below,
 count(*) FILTER (WHERE ret > high) AS above FROM x JOIN s USING (symbol) GROUP BY 1)
 SELECT symbol, count, below, above, {cols({n: n for n in DIST})} FROM s JOIN t USING (symbol)""")
def _distribution(spark, d):
    return ag.return_distribution(ebars(spark, d)).select("symbol", "count", "below", "above", *rnd(*DIST))


_EDGES = "g AS (SELECT *, unnest(range(0, 41))::INT AS bin FROM s), b AS (SELECT *, low + bin * ((high - low) / 41) AS edge_low, CASE WHEN bin = 40 THEN high ELSE low + (bin + 1) * ((high - low) / 41) END AS edge_high FROM g)"


@check("return_bins", f"""{EV}, {STATS}, {_EDGES}
 SELECT b.symbol, b.bin, {r('any_value(edge_low)')} AS edge_low, {r('any_value(edge_high)')} AS edge_high, count(x.ret) AS n
 FROM b LEFT JOIN x ON x.symbol = b.symbol AND x.ret >= b.edge_low AND (x.ret < b.edge_high OR (b.bin = 40 AND x.ret <= b.edge_high)) GROUP BY 1, 2""")
def _bins(spark, d):
    return ag.return_bins(ebars(spark, d)).select("symbol", "bin", *rnd("edge_low", "edge_high"), F.col("n").cast("long").alias("n"))


@check("return_histogram", f"""{EV}, x AS (SELECT symbol, ret FROM e WHERE ret IS NOT NULL),
 s AS (SELECT symbol, min(ret) AS low, max(ret) AS high, least(50, greatest(10, count(*) // 2))::INT AS bins FROM x GROUP BY 1),
 g AS (SELECT *, unnest(range(0, bins))::INT AS bin FROM s), b AS (SELECT *, low + bin * ((high - low) / bins) AS edge_low, CASE WHEN bin = bins - 1 THEN high ELSE low + (bin + 1) * ((high - low) / bins) END AS edge_high FROM g)
 SELECT b.symbol, b.bin, {r('any_value(edge_low)')} AS edge_low, count(x.ret) AS n FROM b LEFT JOIN x ON x.symbol = b.symbol AND x.ret >= b.edge_low
 AND (x.ret < b.edge_high OR (b.bin = b.bins - 1 AND x.ret <= b.edge_high)) GROUP BY 1, 2""")
def _histogram(spark, d):
    return ag.return_histogram(ebars(spark, d)).select("symbol", "bin", *rnd("edge_low"), F.col("n").cast("long").alias("n"))


DD = f"""{OR}, u AS (SELECT *, max(close) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS peak FROM e), w AS (SELECT *, 100 * (close / peak - 1) AS dd FROM u)"""


@check("drawdown_report", f"""{DD}, k AS (SELECT *, i - max(CASE WHEN dd >= 0 THEN i END) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS under FROM w),
 t AS (SELECT symbol, min(dd) AS dd, arg_min(ts, {{'d': dd, 't': ts}}) AS tt, arg_min(peak, {{'d': dd, 't': ts}}) AS p, arg_max(dd, ts) AS cur, max(under) AS longest FROM k GROUP BY 1)
 SELECT t.symbol, {r('any_value(t.dd)')} AS max_drawdown_pct, epoch(max(ts) FILTER (WHERE ts <= tt AND close = p))::BIGINT AS peak_time, epoch(any_value(tt))::BIGINT AS trough_time,
 epoch(min(ts) FILTER (WHERE t.dd < 0 AND ts > tt AND close >= p))::BIGINT AS recovered_time, {r('any_value(cur)')} AS current_drawdown_pct, any_value(longest)::BIGINT AS longest_underwater_bars
 FROM t JOIN k USING (symbol) GROUP BY 1""")
def _drawdown(spark, d):
    return ag.drawdown_report(obars(spark, d)).select(
        "symbol", *rnd("max_drawdown_pct"), seconds("peak_time").alias("peak_time"), seconds("trough_time").alias("trough_time"),
        seconds("recovered_time").alias("recovered_time"), *rnd("current_drawdown_pct"), "longest_underwater_bars",
    )


@check("rolling_volatility", f"""{EV} SELECT symbol, epoch(ts)::BIGINT AS ts, {r(f'CASE WHEN count(ret) OVER ({BY} ROWS 29 PRECEDING) = 30 THEN stddev_samp(ret) OVER ({BY} ROWS 29 PRECEDING) END')} AS value_pct FROM e WHERE n - 1 > 30""")
def _rolling(spark, d):
    return ag.rolling_volatility(ebars(spark, d)).select("symbol", seconds("ts").alias("ts"), *rnd("value_pct"))


@check("activity_heatmap", f"""{EV}, f AS (SELECT symbol FROM e GROUP BY 1 HAVING count(*) >= 48 AND median(gap) < 86400), g AS (SELECT symbol, unnest(range(0, 168)) AS c FROM f),
 a AS (SELECT symbol, isodow(ts) - 1 AS weekday, hour(ts) AS hour, avg(volume) AS volume, avg((high - low) * 100 / open) AS range_pct, avg(ret) AS return_pct, count(*) AS bars FROM e GROUP BY 1, 2, 3)
 SELECT g.symbol, (c // 24)::INT AS weekday, (c % 24)::INT AS hour, {cols({'volume': 'a.volume', 'range_pct': 'a.range_pct', 'return_pct': 'a.return_pct'})}, coalesce(a.bars, 0) AS bars
 FROM g LEFT JOIN a ON a.symbol = g.symbol AND a.weekday = c // 24 AND a.hour = c % 24""")
def _activity(spark, d):
    return ag.activity_heatmap(ebars(spark, d)).select("symbol", "weekday", "hour", *rnd("volume", "range_pct", "return_pct"), "bars")


@check("seasonality", f"""{EV}, f AS (SELECT symbol, count(ret) AS returns, median(gap) < 86400 AS intraday FROM e GROUP BY 1),
 g AS (SELECT symbol, 'weekday' AS block, unnest(range(0, 7))::INT AS slot FROM f WHERE returns >= 30 UNION ALL SELECT symbol, 'hour', unnest(range(0, 24))::INT FROM f WHERE returns >= 48 AND intraday),
 x AS (SELECT symbol, ret, 'weekday' AS block, isodow(ts) - 1 AS slot FROM e WHERE ret IS NOT NULL UNION ALL SELECT symbol, ret, 'hour', hour(ts) FROM e WHERE ret IS NOT NULL)
 SELECT symbol, block, slot, CASE WHEN block = 'hour' THEN lpad(slot::VARCHAR, 2, '0') ELSE ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][slot + 1] END AS label,
 {cols({'mean_return_pct': 'avg(ret)', 'hit_rate_pct': 'avg((ret > 0)::INT) * 100'})}, count(ret) AS n FROM g LEFT JOIN x USING (symbol, block, slot) GROUP BY 1, 2, 3""")
def _seasonality(spark, d):
    return ag.seasonality(ebars(spark, d)).select("symbol", "block", "slot", "label", *rnd("mean_return_pct", "hit_rate_pct"), "n")


@check("time_grid", f"""WITH {EVENT_BARS.strip()}, l AS (SELECT *, ts + INTERVAL '5 hours 30 minutes' AS k FROM bars), g AS (SELECT symbol, unnest(range(0, 288)) AS c FROM (SELECT DISTINCT symbol FROM bars))
 SELECT g.symbol, (c // 12)::INT AS hour, (c % 12 * 5)::INT AS slot, coalesce(sum(volume), 0.0) AS volume, {r('coalesce(avg((high - low) * 100 / open), 0.0)')} AS range_pct
 FROM g LEFT JOIN l ON l.symbol = g.symbol AND hour(k) = c // 12 AND minute(k) // 5 = c % 12 GROUP BY 1, 2, 3""")
def _grid(spark, d):
    return ag.time_grid(ebars(spark, d)).select("symbol", "hour", "slot", "volume", *rnd("range_pct"))


SPAN = "p AS (SELECT symbol, CASE WHEN min(low) = max(high) THEN min(low) - greatest(abs(min(low)) * 0.005, 1) ELSE min(low) END AS lo, CASE WHEN min(low) = max(high) THEN max(high) + greatest(abs(min(low)) * 0.005, 1) ELSE max(high) END AS hi FROM bars GROUP BY 1)"
BINS = f"""{SPAN}, g AS (SELECT *, unnest(range(0, 60))::INT AS bin FROM p), c AS (SELECT symbol, bin, lo + bin * ((hi - lo) / 60) AS edge_low, CASE WHEN bin = 59 THEN hi ELSE lo + (bin + 1) * ((hi - lo) / 60) END AS edge_high FROM g),
 v AS (SELECT c.symbol, c.bin, edge_low, edge_high, coalesce(sum(CASE WHEN high > low THEN greatest(least(high, edge_high) - greatest(low, edge_low), 0) * volume / (high - low)
  WHEN high >= edge_low AND (high < edge_high OR bin = 59) THEN volume ELSE 0 END), 0) AS volume FROM c JOIN bars USING (symbol) GROUP BY 1, 2, 3, 4)"""


@check("volume_profile_bins", f"WITH {ORDER_BARS.strip()}, {BINS} SELECT symbol, bin, {cols({n: n for n in ('edge_low', 'edge_high', 'volume')})} FROM v")
def _profile_bins(spark, d):
    return ag.profile_bins(obars(spark, d)).select("symbol", "bin", *rnd("edge_low", "edge_high", "volume"))


@check("volume_profile", f"""WITH RECURSIVE {ORDER_BARS.strip()}, {BINS},
 poc AS (SELECT symbol, arg_min(bin, {{'v': -volume, 'b': bin}}) AS bin, max(volume) AS covered, sum(volume) AS total FROM v GROUP BY 1),
 walk AS (SELECT symbol, bin AS lo, bin AS hi, covered, total, 0 AS step FROM poc UNION ALL
  SELECT w.symbol, CASE WHEN coalesce(u.volume, -1) >= coalesce(d.volume, -1) THEN lo ELSE lo - 1 END, CASE WHEN coalesce(u.volume, -1) >= coalesce(d.volume, -1) THEN hi + 1 ELSE hi END,
   covered + CASE WHEN coalesce(u.volume, -1) >= coalesce(d.volume, -1) THEN u.volume ELSE d.volume END, total, step + 1
  FROM walk w LEFT JOIN v u ON u.symbol = w.symbol AND u.bin = hi + 1 LEFT JOIN v d ON d.symbol = w.symbol AND d.bin = lo - 1 WHERE covered < total * 0.7 AND (lo > 0 OR hi < 59)),
 fin AS (SELECT symbol, arg_max(lo, step) AS lo, arg_max(hi, step) AS hi FROM walk GROUP BY 1)
 SELECT fin.symbol, {r('any_value(poc.total)')} AS total_volume, {r('any_value((c.edge_low + c.edge_high) / 2)')} AS poc, {r('any_value(a.edge_low)')} AS value_low, {r('any_value(b.edge_high)')} AS value_high
 FROM fin JOIN poc USING (symbol) JOIN v c ON c.symbol = fin.symbol AND c.bin = poc.bin JOIN v a ON a.symbol = fin.symbol AND a.bin = fin.lo JOIN v b ON b.symbol = fin.symbol AND b.bin = fin.hi GROUP BY 1""")
def _profile(spark, d):
    return ag.volume_profile(obars(spark, d)).select("symbol", *rnd("total_volume", "poc", "value_low", "value_high"))


@check("price_time_density", f"""WITH {EVENT_BARS.strip()}, {SPAN}, x AS (SELECT *, row_number() OVER ({BY}) - 1 AS bar, (high + low) / 2 AS mid FROM bars)
 SELECT symbol, bar, least(79, greatest(0, floor((mid - lo) / (hi - lo) * 80)))::INT AS price_bin, volume FROM x JOIN p USING (symbol)""")
def _density(spark, d):
    return ag.price_time_density(ebars(spark, d)).select("symbol", "bar", "price_bin", "volume")


LABELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@check("correlation_matrix", f"""WITH {ORDER_BARS.strip()}, k AS (SELECT ts FROM bars GROUP BY 1 HAVING count(DISTINCT symbol) = 5),
 x AS (SELECT symbol, ts, close / lag(close) OVER ({BY}) - 1 AS ret FROM bars SEMI JOIN k USING (ts)), y AS (SELECT * FROM x WHERE ret IS NOT NULL)
 SELECT a.symbol AS a, b.symbol AS b, {r('corr(a.ret, b.ret)')} AS corr, count(*) AS observations, epoch(min(ts))::BIGINT AS start, epoch(max(ts))::BIGINT AS "end"
 FROM y a JOIN y b USING (ts) GROUP BY 1, 2""")
def _correlation(spark, d):
    df = ag.correlation_matrix(obars(spark, d), LABELS)
    return df.select("a", "b", *rnd("corr"), "observations", seconds("start").alias("start"), seconds("end").alias("end"))


@check("correlation_all", f"""WITH bars AS (SELECT l_suppkey::VARCHAR AS symbol, date_trunc('quarter', l_shipdate) AS ts, arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) AS close FROM lineitem GROUP BY 1, 2),
 k AS (SELECT ts FROM bars GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars)),
 x AS (SELECT symbol, ts, close / lag(close) OVER ({BY}) - 1 AS ret FROM bars SEMI JOIN k USING (ts)), y AS (SELECT * FROM x WHERE ret IS NOT NULL)
 SELECT a.symbol AS a, b.symbol AS b, {r('corr(a.ret, b.ret)')} AS corr, count(*) AS observations, epoch(min(ts))::BIGINT AS start, epoch(max(ts))::BIGINT AS "end"
 FROM y a JOIN y b USING (ts) GROUP BY 1, 2 HAVING count(*) >= 3""")
def _correlation_all(spark, d):
    """Every supplier's quarterly series against every other."""
    bars = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("symbol"), F.date_trunc("quarter", "l_shipdate").alias("ts")).agg(
        F.max_by("l_extendedprice", F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("double").alias("close")
    )
    df = ag.correlation_matrix(bars.withColumn("timeframe", F.lit("quarter")), bars.select("symbol"))
    return df.select("a", "b", *rnd("corr"), "observations", seconds("start").alias("start"), seconds("end").alias("end"))


@check("shared_timestamps", f"WITH {ORDER_BARS.strip()} SELECT epoch(ts)::BIGINT AS ts FROM bars GROUP BY ts HAVING count(DISTINCT symbol) = 5")
def _shared(spark, d):
    return ag.shared_timestamps(obars(spark, d), LABELS).select(seconds("ts").alias("ts"))


@check("gap_statistics", f"""WITH {EVENT_BARS.strip()}, x AS (SELECT symbol, abs(open / lag(close) OVER ({BY}) - 1) * 1e4 AS gap FROM bars)
 SELECT symbol, {cols({'mean_abs': 'avg(gap)', 'p99_abs': 'quantile_cont(gap, 0.99)', 'max_abs': 'max(gap)'}, 4)} FROM x GROUP BY 1""")
def _gap_stats(spark, d):
    return ag.gap_statistics(ebars(spark, d)).select("symbol", *rnd("mean_abs", "p99_abs", "max_abs", digits=4))


@check("series_summary", f"""WITH {EVENT_BARS.strip()}, x AS (SELECT *, lag(close) OVER ({BY}) AS prev FROM bars)
 SELECT symbol, {cols({'latest': 'arg_max(close, ts)', 'change': 'arg_max(close, ts) - arg_max(prev, ts)', 'period_pct': '(arg_max(close, ts) / arg_min(close, ts) - 1) * 100',
 'low': 'min(low)', 'high': 'max(high)', 'average_volume': 'avg(volume)'})}, count(*) AS points, epoch(min(ts))::BIGINT AS start, epoch(max(ts))::BIGINT AS "end" FROM x GROUP BY 1""")
def _summary(spark, d):
    df = ag.series_summary(ebars(spark, d))
    return df.select("symbol", *rnd("latest", "change", "period_pct", "low", "high", "average_volume"), "points", seconds("start").alias("start"), seconds("end").alias("end"))


@check("extent", f"WITH {EVENT_BARS.strip()} SELECT symbol, min(close) AS min, max(close) AS max FROM bars GROUP BY 1")
def _extent(spark, d):
    return ag.extent(ebars(spark, d), "close").select("symbol", "min", "max")


@check("first_seen", "SELECT user_id, arg_min(event_type, {'t': ts, 'i': event_id}) AS event_type, min(event_id) FILTER (WHERE TRUE) AS lowest FROM events GROUP BY 1")
def _first_seen(spark, d):
    events = table(spark, d, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("k"), "event_id")
    firsts = ag.first_seen(events.select("user_id", "event_type", "k"), "user_id", "k").select("user_id", "event_type")
    return firsts.join(events.groupBy("user_id").agg(F.min("event_id").alias("lowest")), "user_id")


@check("grouped_counts", "SELECT event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1")
def _grouped(spark, d):
    return ag.grouped_counts(table(spark, d, "events"), "event_type", "event_id")


# --- downsampling ------------------------------------------------------------------------------

_DECI = """w AS (SELECT *, floor(i / (n / 198.0)) AS g FROM e), b AS (SELECT *, CASE WHEN i < floor(g * (n / 198.0)) THEN g - 1 WHEN i >= floor((g + 1) * (n / 198.0)) THEN g + 1 ELSE g END AS bk FROM w)"""


@check("decimate_min", f"""{EV}, {_DECI}, k AS (SELECT symbol, arg_min(i, {{'v': close, 'i': i}}) AS i FROM b GROUP BY symbol, bk UNION SELECT symbol, 0 FROM e UNION SELECT symbol, n - 1 FROM e)
 SELECT symbol, epoch(ts)::BIGINT AS ts, close FROM e SEMI JOIN k USING (symbol, i)""")
def _deci_min(spark, d):
    return ds.decimate(ebars(spark, d), "close", True, 200).select("symbol", seconds("ts").alias("ts"), "close")


@check("decimate_last", f"""{EV}, {_DECI}, k AS (SELECT symbol, max(i) AS i FROM b GROUP BY symbol, bk UNION SELECT symbol, 0 FROM e UNION SELECT symbol, n - 1 FROM e)
 SELECT symbol, epoch(ts)::BIGINT AS ts, close FROM e SEMI JOIN k USING (symbol, i)""")
def _deci_last(spark, d):
    return ds.decimate(ebars(spark, d), "close", False, 200).select("symbol", seconds("ts").alias("ts"), "close")


@check("every_nth", f"{EV} SELECT symbol, epoch(ts)::BIGINT AS ts, {r('close', 8)} AS close FROM e WHERE i % greatest(1, ceil(n / 240.0))::BIGINT = 0 OR i = n - 1")
def _nth(spark, d):
    return ds.every_nth(ebars(spark, d), "close").select("symbol", seconds("ts").alias("ts"), "close")


@check("bucket_candles", f"""{EV} SELECT symbol, floor(i / n::DOUBLE * 120)::BIGINT AS x, arg_min(open, i) AS open, max(high) AS high, min(low) AS low, arg_max(close, i) AS close,
 min(i) AS "from", max(i) AS "to", bool_or(volume >= 2) AS flagged FROM e GROUP BY 1, 2""")
def _candles(spark, d):
    df = ebars(spark, d).withColumn("flag", F.col("volume") >= 2)
    return ds.bucket_candles(df, 120, flag="flag").select("symbol", "x", "open", "high", "low", "close", "from", "to", "flagged")


@check("decimate_minmax", f"""{EV}, x AS (SELECT symbol, i, ts, ret, floor(i / n::DOUBLE * 50) AS c, count(*) FILTER (WHERE ret IS NULL) OVER (PARTITION BY symbol, floor(i / n::DOUBLE * 50) ORDER BY i) AS g FROM e),
 k AS (SELECT symbol, unnest([arg_min(i, {{'v': ret, 'i': i}}), arg_min(i, {{'v': -ret, 'i': i}})]) AS i FROM x WHERE ret IS NOT NULL GROUP BY symbol, c, g UNION SELECT symbol, i FROM x WHERE ret IS NULL)
 SELECT symbol, i, {r('ret')} AS ret FROM e SEMI JOIN k USING (symbol, i)""")
def _minmax(spark, d):
    rows, _ = ag.with_returns(ebars(spark, d))
    return ds.decimate_minmax(rows, "ret", 50).select("symbol", "i", *rnd("ret"))


@check("decimate_m4", f"""{EV}, z AS (SELECT *, min(epoch(ts)) OVER (PARTITION BY symbol) AS t0, max(epoch(ts)) OVER (PARTITION BY symbol) AS t1 FROM e),
 x AS (SELECT symbol, i, ret, floor((epoch(ts) - t0) / (t1 - t0) * 60) AS c, count(*) FILTER (WHERE ret IS NULL) OVER (PARTITION BY symbol ORDER BY i) AS g FROM z),
 k AS (SELECT symbol, unnest([min(i), arg_min(i, {{'v': ret, 'i': i}}), arg_min(i, {{'v': -ret, 'i': i}}), max(i)]) AS i FROM x WHERE ret IS NOT NULL GROUP BY symbol, c, g UNION SELECT symbol, i FROM x WHERE ret IS NULL)
 SELECT symbol, i, {r('ret')} AS ret FROM e SEMI JOIN k USING (symbol, i)""")
def _m4(spark, d):
    rows, _ = ag.with_returns(ebars(spark, d))
    return ds.decimate_m4(rows, "ret", 60).select("symbol", "i", *rnd("ret"))


@check("top_per_group", f"{EV} SELECT symbol, epoch(ts)::BIGINT AS ts, {r('ret')} AS ret FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ret DESC NULLS LAST, ts) AS k FROM e) WHERE k <= 20")
def _top_group(spark, d):
    rows, layout = ag.with_returns(ebars(spark, d))
    return ds.top_by(rows, "ret", 20, "ts", ["symbol"]).select("symbol", seconds("ts").alias("ts"), *rnd("ret"))


@check("top_overall", f"{EV} SELECT symbol, epoch(ts)::BIGINT AS ts, {r('ret')} AS ret FROM e ORDER BY e.ret DESC NULLS LAST, ts LIMIT 12")
def _top(spark, d):
    rows, layout = ag.with_returns(ebars(spark, d))
    return ds.top_by(rows, "ret", 12, "ts").select("symbol", seconds("ts").alias("ts"), *rnd("ret"))


@check("newest_per_key", f"WITH {EVENT_BARS.strip()} SELECT symbol, epoch(ts)::BIGINT AS ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) WHERE k <= 7")
def _newest(spark, d):
    from barloom.plans.explorer import newest

    return newest(ebars(spark, d), 7).select("symbol", seconds("ts").alias("ts"), "close")


@check("sort_text", """WITH x AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN lower(p_type) WHEN 1 THEN p_type ELSE replace(p_type, 'E', 'É') END AS name FROM part)
 SELECT p_partkey, name, row_number() OVER (ORDER BY name COLLATE NOCASE.NOACCENT, p_partkey) AS place FROM x""")
def _sorted_text(spark, d):
    """Part types in mixed case and with accents, by letters alone."""
    from barloom.operators.ranking import global_rank

    p = table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.lower("p_type")).when(F.col("p_partkey") % 3 == 1, F.col("p_type")).otherwise(F.replace("p_type", F.lit("E"), F.lit("É")))
    named = p.select("p_partkey", name.alias("name"))
    return global_rank(named, [ds.sort_key(named, "name", collation="UNICODE_CI_AI"), F.col("p_partkey")], "place").select("p_partkey", "name", "place")


@check("sort_rows", f"{EV} SELECT symbol, epoch(ts)::BIGINT AS ts, {r('ret')} AS ret, row_number() OVER (ORDER BY e.ret ASC NULLS LAST, symbol, ts) AS place FROM e")
def _sorted(spark, d):
    """Places are numbered from the global sort by adding per-partition offsets."""
    rows, layout = ag.with_returns(ebars(spark, d))
    from barloom.operators.ranking import global_rank

    ranked = global_rank(rows.select("symbol", "ts", "ret"), [F.col("ret").asc_nulls_last(), F.col("symbol"), F.col("ts")], "place")
    return ranked.select("symbol", seconds("ts").alias("ts"), *rnd("ret"), "place")




def _sections_sql():
    short = lambda have, need, what: f"{have} || ' of {need} {what}'"
    grain = "CASE WHEN iv >= 86400 THEN 'one bar in ' || round(iv)::BIGINT || ' s is too coarse' ELSE {} END"
    few = short("(n - 1)", 30, "returns")
    rows = [
        ("volume_profile", "TRUE", "NULL"), ("return_distribution", "rets >= 30", few), ("drawdown", "n >= 2", short("n", 2, "bars")), ("rolling_volatility", "n - 1 > 30", short("(n - 1)", 31, "returns")),
        ("activity", "iv < 86400 AND n >= 48", grain.format(short("n", 48, "bars"))), ("seasonality.by_weekday", "rets >= 30", few), ("seasonality.by_hour", "iv < 86400 AND rets >= 48", grain.format(short("(n - 1)", 48, "returns"))),
    ]
    parts = " UNION ALL ".join(f"SELECT symbol, '{s}' AS section, {ok} AS available, CASE WHEN NOT ({ok}) THEN {why} END AS reason FROM f" for s, ok, why in rows)
    return f"{OR}, f AS (SELECT symbol, count(*) AS n, count(ret) AS rets, median(gap) AS iv FROM e GROUP BY 1) {parts}"


@check("chart_sections", _sections_sql())
def _sections(spark, d):
    from barloom.plans.charts import chart_sections

    return chart_sections(obars(spark, d)).select("symbol", "section", "available", "reason")
