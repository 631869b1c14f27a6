"""Checked queries: sentiment, sealed holdouts, the trial ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import holdout as ho
from barloom.operators import ledger as lg
from barloom.operators import sentiment as st
from barloom.operators import verdict as vd
from barloom.operators.backtest import strategy_grid
from barloom.session import cut_lineage
from barloom.sources import payloads as pl
from barloom.sources.ticks import order_bars
from oracle.checks import check, rounded, seconds, table
from oracle.series import ORDER_BARS
from oracle.series import rounded as r


def readings(spark, d):
    """A daily index per order priority, scored from the orders of the day."""
    o = table(spark, d, "orders")
    day = F.unix_seconds(F.date_trunc("day", F.col("o_orderdate").cast("timestamp")))
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), day.alias("time")).agg(F.pmod(F.sum("o_orderkey"), F.lit(101)).cast("int").alias("score"))


READ = "rd AS (SELECT o_orderpriority AS symbol, epoch(date_trunc('day', o_orderdate))::BIGINT AS time, (sum(o_orderkey) % 101)::INT AS score FROM orders GROUP BY 1, 2), la AS (SELECT symbol, max(time) AS last FROM rd GROUP BY 1)"
BAND = "CASE WHEN score < 20 THEN 'extreme_fear' WHEN score < 40 THEN 'fear' WHEN score < 60 THEN 'neutral' WHEN score < 80 THEN 'greed' WHEN score <= 100 THEN 'extreme_greed' END"


@check("sentiment_snapshots", f"""WITH {READ}, w AS (SELECT symbol, 'yesterday' AS snapshot, last - 86400 AS time FROM la UNION ALL SELECT symbol, 'week_ago', last - 604800 FROM la UNION ALL
 SELECT symbol, 'month_ago', epoch(make_timestamp(last * 1000000) - INTERVAL 1 MONTH)::BIGINT FROM la), p AS (SELECT w.symbol, snapshot, rd.time, score FROM w LEFT JOIN rd ON rd.symbol = w.symbol AND rd.time = w.time),
 y AS (SELECT rd.* FROM rd JOIN la USING (symbol) WHERE time >= last - 365 * 86400), e AS (SELECT symbol, 'year_high' AS snapshot, arg_max(time, score * 10000000000 + time) AS time, max(score) AS score FROM y GROUP BY 1
 UNION ALL SELECT symbol, 'year_low', arg_min(time, score * 10000000000 - time), min(score) FROM y GROUP BY 1) SELECT symbol, snapshot, time, score, {BAND} AS band FROM (SELECT symbol, snapshot, time, score FROM p UNION ALL SELECT * FROM e)""")
def _snapshots(spark, d):
    return st.snapshots(readings(spark, d), ["symbol"]).select("symbol", "snapshot", "time", "score", "band")


@check("sentiment_zones", f"""WITH {READ}, y AS (SELECT symbol, {BAND} AS band FROM rd JOIN la USING (symbol) WHERE time >= last - 90 * 86400), t AS (SELECT symbol, count(*) AS t FROM y GROUP BY 1),
 g AS (SELECT symbol, t, unnest(['extreme_fear', 'fear', 'neutral', 'greed', 'extreme_greed']) AS band FROM t) SELECT g.symbol, g.band, count(y.band) AS n, {r('count(y.band) / any_value(t)::DOUBLE')} AS share FROM g LEFT JOIN y ON y.symbol = g.symbol AND y.band = g.band GROUP BY 1, 2""")
def _zones(spark, d):
    return st.zone_counts(readings(spark, d), 90, ["symbol"]).select("symbol", "band", "n", rounded("share").alias("share"))


@check("sentiment_range", f"""WITH {READ}, y AS (SELECT rd.* FROM rd JOIN la USING (symbol) WHERE time >= last - 365 * 86400) SELECT symbol, count(*) AS count, {r('avg(score)')} AS mean, max(score) AS high, arg_max(time, score * 10000000000 + time) AS high_time,
 min(score) AS low, arg_min(time, score * 10000000000 - time) AS low_time, arg_max(score, time) - arg_min(score, time) AS change FROM y GROUP BY 1""")
def _range(spark, d):
    return st.range_summary(readings(spark, d), 365, ["symbol"]).withColumn("mean", rounded("mean"))


@check("sentiment_payload", """SELECT (1000 + user_id)::BIGINT AS time, arg_max((event_id % 101)::INT, event_id) AS score FROM events WHERE event_id % 9 <> 0 GROUP BY user_id""")
def _payload(spark, d):
    row = F.format_string('{"score": %s, "timestamp": "%d", "btcPrice": "1.5"}', F.when(F.col("event_id") % 9 == 0, "101.5").otherwise((F.col("event_id") % 101).cast("string")), F.col("user_id") + 1000)
    packed = table(spark, d, "events").groupBy("user_id", F.floor(F.col("event_id") / 500).alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", row.alias("r")))), lambda x: x["r"]), ",").alias("rows"))
    payload = packed.select("page", F.concat(F.lit('{"status": {"error_code": "0"}, "data": {"dataList": ['), F.col("rows"), F.lit("]}}")).alias("payload"))
    return pl.sentiment_from_json(payload, order="page")[0].select("time", "score")


# --- holdout -----------------------------------------------------------------------------------

SEAL = "s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, floor(round(count(*) OVER (PARTITION BY symbol) * 0.8::DOUBLE, 9))::BIGINT AS rb, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"


@check("holdout_plan_seal", f"WITH {ORDER_BARS.strip()}, {SEAL} SELECT symbol, epoch(min(ts) FILTER (WHERE i = rb))::BIGINT AS holdout_start, epoch(max(ts))::BIGINT AS holdout_end, max(n) - max(rb) AS holdout_bars, max(rb) AS research_bars FROM s WHERE n >= 100 GROUP BY 1")
def _seal(spark, d):
    s = ho.plan_seal(order_bars(table(spark, d, "orders")))
    return s.select("symbol", seconds("holdout_start").alias("holdout_start"), seconds("holdout_end").alias("holdout_end"), "holdout_bars", "research_bars")


@check("holdout_research_window", f"WITH {ORDER_BARS.strip()}, {SEAL} SELECT symbol, epoch(ts)::BIGINT AS ts, close FROM s WHERE i < rb")
def _window(spark, d):
    bars = order_bars(table(spark, d, "orders"))
    return ho.research_window(bars, ho.plan_seal(bars)).select("symbol", seconds("ts").alias("ts"), "close")


@check("holdout_verify", f"WITH {ORDER_BARS.strip()} SELECT symbol, symbol <> '2-HIGH' AS intact FROM bars GROUP BY 1")
def _verify(spark, d):
    bars = order_bars(table(spark, d, "orders"))
    changed = bars.withColumn("close", F.when((F.col("symbol") == "2-HIGH") & (F.dayofmonth("ts") == 3), F.col("close") * 1.01).otherwise(F.col("close")))
    return ho.verify_seal(changed, ho.plan_seal(bars)).select("symbol", "intact")


def _holdout_sql() -> str:
    """The window from the seal on, summed as any other window."""
    from oracle.q_verdict import WINDOW_SUMMARY

    return f"SELECT symbol, rule, trades, closed_trades, net_return_pct, buy_hold_return_pct FROM ({WINDOW_SUMMARY.replace('floor(n * 0.8::DOUBLE)', 'floor(round(n * 0.8::DOUBLE, 9))')})"


@check("holdout_read", _holdout_sql())
def _read(spark, d):
    bars = order_bars(table(spark, d, "orders"))
    result = ho.read_holdout(bars, ho.plan_seal(bars), strategy_grid(), vd.periods_per_year(bars, 365.0))
    return result.select("symbol", "rule", "trades", "closed_trades", rounded("net_return_pct").alias("net_return_pct"), rounded("buy_hold_return_pct").alias("buy_hold_return_pct"))


@check("holdout_forward", f"""WITH {ORDER_BARS.strip()}, m AS (SELECT symbol, count(*) FILTER (WHERE ts > TIMESTAMP '1998-01-01') AS bars FROM bars GROUP BY 1) SELECT symbol, bars, bars = 0 AS waiting FROM m""")
def _forward(spark, d):
    bars = order_bars(table(spark, d, "orders"))
    starts = bars.select("symbol", "timeframe").distinct().withColumn("forward_start", F.lit("1998-01-01").cast("timestamp"))
    result = ho.forward_result(bars, starts, strategy_grid()[:1], vd.periods_per_year(bars, 365.0))
    return result.select("symbol", "bars", "waiting").distinct()


@check("holdout_forward_figures")
def _forward_figures(spark, d):
    """All rules with their figures, which the twin of ``holdout_forward`` doesn't have."""
    bars = order_bars(table(spark, d, "orders"))
    starts = bars.select("symbol", "timeframe").distinct().withColumn("forward_start", F.lit("1998-01-01").cast("timestamp"))
    result = ho.forward_result(bars, starts, strategy_grid(), vd.periods_per_year(bars, 365.0))
    reals = ("exposure_pct", "net_return_pct", "sharpe", "sharpe_se", "mean_trade_return_pct", "buy_hold_return_pct")
    return result.select("symbol", "bars", "waiting", "rule", "trades", "closed_trades", *(rounded(c).alias(c) for c in reals))


# --- ledger ------------------------------------------------------------------------------------


def ledger_lines(spark, d):
    """One run entry per customer as JSON lines (hashes are not chained here; the checks report that)."""
    c = table(spark, d, "customer")
    line = F.format_string(
        '{"seq": %d, "type": "run", "at": "2024-01-01T00:00:%s Z", "dataset": "%s", "prev": "p", "hash": "h", "run_id": "r%d", "status": "%s", "settings": {"costs": {}}, "trials": [{"key": "%s::a", "rule_id": "a"}, {"key": "%s::b%d", "rule_id": "b%d"}]}',
        F.col("c_custkey"), F.lpad((F.col("c_custkey") % 60).cast("string"), 2, "0"), F.col("c_mktsegment"), F.col("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, "completed").otherwise("failed"),
        F.col("c_mktsegment"), F.col("c_mktsegment"), F.col("c_custkey") % 3, F.col("c_custkey") % 3,
    )
    text = F.when(F.col("c_custkey") % 10 == 9, "{not json").otherwise(F.replace(line, F.lit(" Z"), F.lit("Z")))
    return c.select(F.col("c_custkey").cast("int").alias("line_no"), text.alias("value"))


@check("ledger_read", "SELECT c_custkey::INT AS line_no, c_custkey % 10 <> 9 AS ok, CASE WHEN c_custkey % 10 <> 9 THEN c_custkey END AS seq, CASE WHEN c_custkey % 10 = 9 THEN 'is not valid JSON' END AS shape FROM customer")
def _ledger(spark, d):
    e = lg.read_ledger(ledger_lines(spark, d))
    return e.select("line_no", "ok", "seq", F.when(F.col("problem").contains("valid"), F.col("problem")).alias("shape"))


@check("ledger_trials", """SELECT dataset, key, count(*) AS runs, min(a) AS first_seen FROM (SELECT c_mktsegment AS dataset, unnest([c_mktsegment || '::a', c_mktsegment || '::b' || (c_custkey % 3)]) AS key, '2024-01-01T00:00:' || lpad((c_custkey % 60)::VARCHAR, 2, '0') || 'Z' AS a FROM customer WHERE c_custkey % 10 <> 9) GROUP BY 1, 2""")
def _trials(spark, d):
    return lg.trials(lg.read_ledger(ledger_lines(spark, d))).select("dataset", "key", "runs", "first_seen")


@check("ledger_state", "SELECT c_mktsegment AS dataset, count(*) AS runs, count(*) FILTER (WHERE c_custkey % 2 = 0) AS completed_runs, 1 + count(DISTINCT c_custkey % 3) AS trials FROM customer WHERE c_custkey % 10 <> 9 GROUP BY 1")
def _state(spark, d):
    return lg.ledger_state(lg.read_ledger(ledger_lines(spark, d))).select("dataset", "runs", "completed_runs", "trials")


@check("ledger_view", "SELECT c_custkey AS seq, 'Run r' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN ' completed' ELSE ' failed' END AS summary FROM customer WHERE c_custkey % 10 <> 9 ORDER BY c_custkey DESC LIMIT 50")
def _view(spark, d):
    return lg.ledger_view(lg.read_ledger(ledger_lines(spark, d))).select("seq", "summary")


def chained_lines(spark, d):
    """A ledger per customer with one run per order, each entry chained to the one before it; then every fiftieth order is
    damaged in one of four ways. An order's place in its ledger is its number among the customer's orders."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    # A customer's orders are few; the chain is a fold over them.
    own = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("rows"))
    tail = lambda key, n, status: F.format_string(CHAIN_TAIL, key, n, status)
    ends = own.select("o_custkey", F.transform("rows", lambda r, i: F.struct((i + 1).alias("line_no"), r["o_orderkey"].alias("key"), r["o_orderstatus"].alias("status"), tail(r["o_orderkey"], i + 1, r["o_orderstatus"]).alias("tail"))).alias("rows"))
    last = lambda hashes: F.element_at(hashes, -1)
    hashes = F.aggregate("rows", F.array(F.lit(lg.GENESIS)), lambda done, r: F.concat(done, F.array(F.sha2(F.concat(last(done), F.lit(CHAIN_HEAD), last(done), r["tail"]), 256))))
    rows = ends.select("o_custkey", "rows", hashes.alias("hashes")).select("o_custkey", "hashes", F.explode("rows").alias("e"))
    rows = rows.select("o_custkey", "e.*", F.element_at("hashes", F.col("e.line_no")).alias("prev"), F.element_at("hashes", F.col("e.line_no") + 1).alias("hash"))
    damage = F.col("key") % 50
    text = F.concat(
        F.lit(CHAIN_HEAD), F.when(damage == 11, lg.GENESIS).otherwise(F.col("prev")),
        tail(F.col("key"), F.when(damage == 13, F.col("line_no") + 5).otherwise(F.col("line_no")), F.when(damage == 7, "X").otherwise(F.col("status"))),
    )
    whole = F.concat(F.left(text, F.length(text) - 1), F.lit(',"hash":"'), F.col("hash"), F.lit('"}'))
    return cut_lineage(rows.select("o_custkey", "line_no", F.when(damage == 17, F.left(whole, F.lit(40))).otherwise(whole).alias("value")))


CHAIN_HEAD = '{"at":"2024-01-01T00:00:00Z","dataset":"d","prev":"'
CHAIN_TAIL = '","run_id":"r%d","seq":%d,"settings":{"costs":{}},"status":"%s","trials":[],"type":"run"}'
_BODY_SQL = """'{"at":"2024-01-01T00:00:00Z","dataset":"d","prev":"' || %s || '","run_id":"r' || key || '","seq":' || %s || ',"settings":{"costs":{}},"status":"' || %s || '","trials":[],"type":"run"}'"""
CHAIN_SQL = f"""WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey AS key, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
    c AS (SELECT o_custkey, key, status, n, repeat('0', 64) AS prev, sha256(repeat('0', 64) || {_BODY_SQL % ("repeat('0', 64)", "n", "status")}) AS hash FROM o WHERE n = 1
        UNION ALL SELECT o.o_custkey, o.key, o.status, o.n, c.hash, sha256(c.hash || {_BODY_SQL.replace("key", "o.key") % ("c.hash", "o.n", "o.status")}) FROM c JOIN o ON o.o_custkey = c.o_custkey AND o.n = c.n + 1),
    kept AS (SELECT o_custkey, n, key, hash, CASE WHEN key % 50 = 11 THEN repeat('0', 64) ELSE prev END AS prev, CASE WHEN key % 50 = 13 THEN n + 5 ELSE n END AS seq, CASE WHEN key % 50 = 7 THEN 'X' ELSE status END AS status,
        row_number() OVER w AS place, coalesce(lag(hash) OVER w, repeat('0', 64)) AS previous FROM c WHERE key % 50 <> 17 WINDOW w AS (PARTITION BY o_custkey ORDER BY n)),
    found AS (SELECT o_custkey, n::INT AS line_no, TRUE AS ok, seq::BIGINT AS seq, CASE WHEN seq <> place THEN 'has sequence ' || seq || ', expected ' || place WHEN prev <> previous THEN 'does not follow the previous entry'
        WHEN hash <> sha256(previous || {_BODY_SQL % ("prev", "seq", "status")}) THEN 'does not match its hash' END AS problem FROM kept
        UNION ALL SELECT o_custkey, n::INT, FALSE, NULL, 'is not valid JSON' FROM o WHERE key % 50 = 17)"""


@check("ledger_chain", f"{CHAIN_SQL} SELECT o_custkey, line_no, ok, seq, problem FROM found")
def _chain(spark, d):
    return lg.read_ledger(chained_lines(spark, d), ("o_custkey",)).select("o_custkey", "line_no", "ok", "seq", "problem")


@check("ledger_verify", f"{CHAIN_SQL} SELECT o_custkey, count(problem) = 0 AS intact, 'line ' || min(line_no) FILTER (WHERE problem IS NOT NULL) || ' ' || arg_min(problem, line_no) FILTER (WHERE problem IS NOT NULL) AS problem FROM found GROUP BY 1")
def _verify(spark, d):
    return lg.verify_ledger(lg.read_ledger(chained_lines(spark, d), ("o_custkey",)), ("o_custkey",))
