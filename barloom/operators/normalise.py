"""Provider and broker JSON as typed tables.

Inputs are tables with a ``payload`` JSON column (and any key columns to keep). Each function parses
with a declared schema and explodes; per-symbol figures are grouped aggregates. Display limits of a
screen are not applied; ``top_by`` and ``newest`` are there for reports that want them.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.scalars import DATE, DATETIME, MISSING, moment, occ_contract, percent_value, to_number
from barloom.sources.payloads import MAPPING, RECORDS, records_by_symbol

# What the wording of a provider says about an answer. The parts of a phrase stand in this order in the text.
PLACEHOLDER_WORDING = (("premium endpoint",), ("artificial",))
KEY_WORDING = tuple((form, word) for form in ("api key", "apikey") for word in ("invalid", "missing", "required", "demo")) + (
    ("demo", "api key"), ("demo", "apikey"), ("invalid api key",), ("missing api key",), ("invalid apikey",), ("missing apikey",),
)
LIMIT_WORDING = tuple((w,) for w in ("rate limit", "limit reach", "too many requests", "per day", "per minute", "request per second", "requests per second", "call frequency", "spreading out", "bandwidth"))
PLAN_WORDING = tuple((w,) for w in ("premium", "restricted endpoint", "subscription", "upgrade", "exclusive", "special endpoint", "special parameter"))
# Error names of one provider.
KEY_NAMES = ("invalid_access_key", "missing_access_key", "inactive_access_key", "invalid_api_key", "missing_api_key", "inactive_api_key", "inactive_user")
LIMIT_NAMES = ("usage_limit", "rate_limit", "request_limit", "requests_limit", "too_many_requests")
PLAN_NAMES = ("access_restricted", "subscription")
NOTICES = ("Error Message", "Information", "Note")


def _get(record: Column, path: str) -> Column:
    return F.get_json_object(record, f"$.{path}")


def _num(record: Column, path: str) -> Column:
    return to_number(_get(record, path))


# --- N34: status first -------------------------------------------------------------------------


def _says(text: Column, phrases: Sequence[Sequence[str]]) -> Column:
    """Whether the text holds one of the phrases, in any case."""
    low, found = F.lower(text), F.lit(False)
    for phrase in phrases:
        at = F.lit(1)
        for part in phrase:
            at = F.when(at > 0, F.position(F.lit(part), low, at)).otherwise(0)
        found = found | (at > 0)
    return F.coalesce(found, F.lit(False))


def payload_status(payload: Column) -> Column:
    """ok, empty, premium_required, rate_limited, invalid_key, invalid_request or upstream_error; only ok is data.

    Every carrier of bad news in a mapping (an error message, a notice with nothing beside it, a named error, a code, a
    plain message) gives findings, each with a weight; the lightest finding is the status, and without one it is ok. A
    message beside data is data, unless it says that the data are made up.
    """
    fields = F.from_json(payload, MAPPING)
    blank = lambda v: F.coalesce(F.trim(v).isin("", "[]", "{}", "null"), F.lit(True))
    filled = lambda *besides: F.size(F.map_filter(fields, lambda k, v: ~k.isin(*besides) & ~blank(v))) > 0
    named = lambda text, names: _says(text, [(n,) for n in names])
    message, failure, cause = fields["message"], fields["Error Message"], fields["error"]
    notice = F.coalesce(fields["Information"], fields["Note"])
    alone = notice.isNotNull() & F.forall(F.map_keys(fields), lambda k: k.isin(*NOTICES))
    caused = cause.isNotNull() & ~F.trim(cause).isin("null", "false", "")
    # A code of eight digits begins with the status of the answer.
    http = F.when(message.isNotNull() & fields["code"].rlike("^[45][0-9]{7}$"), F.substring(fields["code"], 1, 3).cast("int"))
    carriers = (
        # present, what it may tell, and what it is when it tells none of it
        (failure.isNotNull(), {"invalid_key": _says(failure, KEY_WORDING), "rate_limited": _says(failure, LIMIT_WORDING), "premium_required": _says(failure, PLAN_WORDING)}, "invalid_request"),
        (alone, {"premium_required": _says(notice, PLACEHOLDER_WORDING), "rate_limited": _says(notice, LIMIT_WORDING), "invalid_key": _says(notice, KEY_WORDING)}, "upstream_error"),
        (caused, {"premium_required": named(cause, PLAN_NAMES), "rate_limited": named(cause, LIMIT_NAMES), "invalid_key": named(cause, KEY_NAMES)}, "invalid_request"),
        (http.isNotNull(), {"premium_required": _says(message, (("subscription",),)), "invalid_key": http.isin(401, 403), "rate_limited": http == 429, "upstream_error": http >= 500}, "invalid_request"),
        (_says(message, PLACEHOLDER_WORDING), {}, "premium_required"),
        (~filled("endpoint", "message"), {}, "empty"),
    )
    findings = []
    for present, tells, otherwise in carriers:
        for status, told in (*tells.items(), (otherwise, F.lit(True))):
            findings.append(F.when(present & told, F.struct(F.lit(len(findings)).alias("weight"), F.lit(status).alias("status"))))
    worst = F.array_min(F.array(*findings))["status"]
    return (
        F.when(blank(payload), "empty").when(F.try_parse_json(payload).isNull(), "upstream_error")
        .when(F.trim(payload).startswith("{"), F.coalesce(worst, F.lit("ok"))).otherwise("ok")
    )


def usable(df: DataFrame, payload: str = "payload") -> DataFrame:
    return df.filter(payload_status(F.col(payload)) == "ok")


# --- N1-N4: market data records ----------------------------------------------------------------

# Short provider keys and the columns they become.
BAR_KEYS = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v", "trades": "n", "vwap": "vw"}
QUOTE_KEYS = {"bid_price": "bp", "bid_size": "bs", "ask_price": "ap", "ask_size": "as"}
TRADE_KEYS = {"price": "p", "size": "s"}


def symbol_records(df: DataFrame, plural: str, singular: str, keep: Sequence[str] = ()) -> DataFrame:
    rows = df.select(*keep, F.explode(records_by_symbol(F.col("payload"), plural, singular)).alias("r"))
    return rows.select(*keep, "r.symbol", "r.record")


def bar_rows(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    r = F.col("record")
    return records.select(*keep, "symbol", moment(_get(r, "t")).alias("time"), *(_num(r, k).alias(n) for n, k in BAR_KEYS.items()))


def quote_rows(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    r = F.col("record")
    rows = records.select(*keep, "symbol", moment(_get(r, "t")).alias("time"), *(_num(r, k).alias(n) for n, k in QUOTE_KEYS.items()), _get(r, "bx").alias("bid_exchange"), _get(r, "ax").alias("ask_exchange"))
    both = (F.col("bid_price") != 0) & (F.col("ask_price") != 0)
    return rows.withColumn("spread", F.when(both, F.col("ask_price") - F.col("bid_price")))


def trade_rows(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    r = F.col("record")
    conditions = F.array_join(F.from_json(_get(r, "c"), RECORDS), ", ")
    return records.select(*keep, "symbol", moment(_get(r, "t")).alias("time"), *(_num(r, k).alias(n) for n, k in TRADE_KEYS.items()), _get(r, "x").alias("exchange"), conditions.alias("conditions"), _get(r, "i").alias("trade_id"))


def latest_per_symbol(rows: DataFrame, order: str = "time") -> DataFrame:
    rest = [c for c in rows.columns if c != "symbol"]
    return rows.groupBy("symbol").agg(F.max_by(F.struct(*rest), order).alias("r")).select("symbol", "r.*")


def snapshot_rows(records: DataFrame) -> DataFrame:
    """Latest trade, quote and day beside the previous close."""
    r = F.col("record")
    last = F.coalesce(_num(r, "dailyBar.c"), _num(r, "latestTrade.p"))
    before = _num(r, "prevDailyBar.c")
    change = F.when(before != 0, last - before)
    return records.select(
        "symbol", _num(r, "latestTrade.p").alias("price"), moment(_get(r, "latestTrade.t")).alias("time"), _num(r, "latestQuote.bp").alias("bid_price"), _num(r, "latestQuote.ap").alias("ask_price"),
        *(_num(r, f"dailyBar.{BAR_KEYS[n]}").alias(n) for n in ("open", "high", "low", "close", "volume")), before.alias("previous_close"),
        change.alias("change"), (F.try_divide(change, before) * 100).alias("change_percent"), _num(r, "minuteBar.c").alias("minute_close"),
    )


def day_change_ranking(snapshots: DataFrame) -> DataFrame:
    return snapshots.filter(F.col("change_percent").isNotNull()).orderBy(F.abs("change_percent").desc(), "symbol")


# --- N5-N6: options and books ------------------------------------------------------------------


def option_chain(records: DataFrame) -> DataFrame:
    """Contracts (symbol = option symbol) with their parts, price and greeks."""
    r = F.col("record")
    return records.select(
        F.col("symbol").alias("contract"), occ_contract(F.col("symbol")).alias("o"), _num(r, "latestTrade.p").alias("price"), _num(r, "latestQuote.bp").alias("bid_price"),
        _num(r, "latestQuote.ap").alias("ask_price"), _num(r, "impliedVolatility").alias("implied_volatility"), *(_num(r, f"greeks.{g}").alias(g) for g in ("delta", "gamma", "theta", "vega", "rho")),
    ).select("contract", "o.*", "price", "bid_price", "ask_price", "implied_volatility", "delta", "gamma", "theta", "vega", "rho")


def option_summary(chain: DataFrame) -> DataFrame:
    kind = F.col("type")
    return chain.groupBy("underlying").agg(
        F.count(F.lit(1)).alias("contracts"), F.count_if(kind == "call").alias("calls"), F.count_if(kind == "put").alias("puts"),
        F.count_distinct("expiration").alias("expirations"), F.min("expiration").alias("first_expiration"), F.min("strike").alias("low_strike"), F.max("strike").alias("high_strike"),
    )


def volatility_curve(chain: DataFrame) -> DataFrame:
    """Implied volatility by strike and type at each underlying's first expiration."""
    first = chain.groupBy("underlying").agg(F.min("expiration").alias("expiration"))
    return chain.join(first, ["underlying", "expiration"]).filter(F.col("implied_volatility").isNotNull()).select("underlying", "expiration", "type", "strike", "implied_volatility")


def book_levels(books: DataFrame) -> DataFrame:
    """Price levels of (symbol, record) books, best first, with cumulative size."""
    r = F.col("record")
    sides = F.array(F.struct(F.lit("bid").alias("side"), _get(r, "b").alias("levels")), F.struct(F.lit("ask").alias("side"), _get(r, "a").alias("levels")))
    rows = books.select("symbol", F.explode(sides).alias("s")).select("symbol", "s.side", F.explode(F.from_json("s.levels", "ARRAY<STRUCT<p: STRING, s: STRING>>")).alias("l"))
    rows = rows.select("symbol", "side", to_number(F.col("l.p")).alias("price"), F.coalesce(to_number(F.col("l.s")), F.lit(0.0)).alias("size")).filter(F.col("price").isNotNull())
    best = Window.partitionBy("symbol", "side").orderBy(F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price")), F.when(F.col("side") == "bid", -F.col("size")).otherwise(F.col("size")))
    return rows.withColumn("cumulative_size", F.sum("size").over(best.rowsBetween(Window.unboundedPreceding, 0)))


def book_facts(levels: DataFrame) -> DataFrame:
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    facts = levels.groupBy("symbol").agg(
        F.max(F.when(bid, F.col("price"))).alias("best_bid"), F.min(F.when(ask, F.col("price"))).alias("best_ask"),
        F.sum(F.when(bid, F.col("size"))).alias("bid_depth"), F.sum(F.when(ask, F.col("size"))).alias("ask_depth"), F.count(F.lit(1)).alias("levels"),
    )
    spread = F.col("best_ask") - F.col("best_bid")
    return facts.withColumn("spread", spread).withColumn("spread_percent", F.try_divide(spread, F.col("best_ask")) * 100)


# --- N7-N11: news, movers, actions, flat lists -------------------------------------------------


def news_rows(df: DataFrame, path: str = "news", keep: Sequence[str] = ()) -> DataFrame:
    rows = df.select(*keep, F.explode(F.from_json(_get(F.col("payload"), path), RECORDS)).alias("r"))
    r = F.col("r")
    return rows.select(*keep, _get(r, "headline").alias("headline"), _get(r, "source").alias("source"), moment(_get(r, "created_at")).alias("time"), F.from_json(_get(r, "symbols"), RECORDS).alias("symbols"))


def mention_counts(news: DataFrame) -> DataFrame:
    return news.select(F.explode("symbols").alias("symbol")).groupBy("symbol").agg(F.count(F.lit(1)).alias("mentions")).orderBy(F.col("mentions").desc(), "symbol")


def news_summary(news: DataFrame) -> DataFrame:
    return news.agg(F.count(F.lit(1)).alias("articles"), F.count_distinct("source").alias("sources"), F.max("time").alias("newest"), F.min("time").alias("oldest"))


def news_sentiment(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Count and average score per label."""
    rows = df.select(*keep, F.explode(F.from_json(_get(F.col("payload"), "feed"), RECORDS)).alias("r"))
    scored = rows.select(*keep, _get(F.col("r"), "overall_sentiment_label").alias("label"), _num(F.col("r"), "overall_sentiment_score").alias("score"))
    return scored.groupBy(*keep, "label").agg(F.count(F.lit(1)).alias("articles"), F.avg("score").alias("average_score"))


def stacked_lists(df: DataFrame, paths: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Several lists of one payload stacked with a kind label (gainers and losers, opening and closing)."""
    lists = F.array(*(F.struct(F.lit(kind).alias("kind"), F.from_json(_get(F.col("payload"), path), RECORDS).alias("rows")) for kind, path in paths.items()))
    return df.select(*keep, F.explode(lists).alias("l")).select(*keep, "l.kind", F.posexplode("l.rows").alias("position", "record"))


def keyed_lists(df: DataFrame, path: str, keep: Sequence[str] = ()) -> DataFrame:
    """``{kind: [records]}`` -> (kind, record), as corporate actions come."""
    return df.select(*keep, F.explode(F.from_json(_get(F.col("payload"), path), MAPPING)).alias("kind", "rows")).select(*keep, "kind", F.explode(F.from_json("rows", RECORDS)).alias("record"))


def flat_rows(df: DataFrame, fields: dict[str, str], path: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """A list of flat records as typed columns: ``fields`` maps a column to "name type" of the record."""
    body = F.col("payload") if path is None else _get(F.col("payload"), path)
    rows = df.select(*keep, F.explode(F.from_json(body, RECORDS)).alias("r"))
    typed = []
    for column, spec in fields.items():
        name, _, kind = spec.partition(" ")
        typed.append((_num(F.col("r"), name) if kind == "number" else moment(_get(F.col("r"), name)) if kind == "time" else _get(F.col("r"), name)).alias(column))
    return rows.select(*keep, *typed)


# --- N12-N20: statements, prices, curves -------------------------------------------------------


def statement_cells(df: DataFrame, period: str, items: Sequence[str], path: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(period, item, value) of statement records."""
    body = F.col("payload") if path is None else _get(F.col("payload"), path)
    rows = df.select(*keep, F.explode(F.from_json(body, RECORDS)).alias("r"))
    cells = F.array(*(F.struct(F.lit(i).alias("item"), _num(F.col("r"), i).alias("value")) for i in items))
    return rows.select(*keep, _get(F.col("r"), period).alias("period"), F.explode(cells).alias("c")).select(*keep, "period", "c.item", "c.value")


def statement_pivot(cells: DataFrame, periods: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Items as rows and the named periods as columns, newest first as listed."""
    return cells.groupBy(*keep, "item").pivot("period", list(periods)).agg(F.first("value"))


def statement_changes(cells: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Each value beside the prior period and the percent change."""
    prior = F.lag("value").over(Window.partitionBy(*keep, "item").orderBy("period"))
    return cells.withColumn("prior", prior).withColumn("change_pct", F.when(F.col("prior") != 0, (F.col("value") - F.col("prior")) / F.abs("prior") * 100))


def ratio_summary(cells: DataFrame, specs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Latest, change, high and low of ratios as percentages; ``specs`` lists (item, scale, phrase)."""
    name = F.regexp_replace("item", "TTM$", "")
    shown = cells.withColumn("item", name).join(specs, "item").withColumn("pct", F.col("value") * F.col("scale"))
    latest = shown.groupBy(*keep, "item", "phrase").agg(
        F.max_by("pct", "period").alias("latest"), F.max("pct").alias("high"), F.min("pct").alias("low"), (F.max_by("pct", "period") - F.min_by("pct", "period")).alias("change")
    )
    return latest


def map_cells(df: DataFrame, period: str, path: str, keep: Sequence[str] = ()) -> DataFrame:
    """Records that hold a map of amounts (segments) -> (period, item, value)."""
    rows = df.select(*keep, F.explode(F.from_json("payload", RECORDS)).alias("r"))
    return rows.select(*keep, _get(F.col("r"), period).alias("period"), F.explode(F.from_json(_get(F.col("r"), path), MAPPING)).alias("item", "_v")).select(*keep, "period", "item", to_number(F.col("_v")).alias("value"))


# Names providers use for the price roles.
PRICE_ALIASES = {
    "open": ("open", "adjOpen"), "high": ("high", "adjHigh", "dayHigh"), "low": ("low", "adjLow", "dayLow"),
    "close": ("close", "adjClose", "adj_close", "price", "last"), "volume": ("volume", "adj_volume", "adjVolume"),
}


def price_rows(df: DataFrame, path: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """OHLCV rows whatever alias a provider uses; the first present alias wins."""
    body = F.col("payload") if path is None else _get(F.col("payload"), path)
    rows = df.select(*keep, F.explode(F.from_json(body, RECORDS)).alias("r"))
    r = F.col("r")
    return rows.select(*keep, moment(F.coalesce(_get(r, "date"), _get(r, "datetime"))).alias("time"), *(F.coalesce(*(_num(r, a) for a in names)).alias(role) for role, names in PRICE_ALIASES.items()))


def latest_curve(cells: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The cells of the newest period (a yield curve by maturity)."""
    newest = cells.groupBy(*keep).agg(F.max("period").alias("period"))
    return cells.join(newest, [*keep, "period"]) if keep else cells.join(F.broadcast(newest), "period")


def earnings_surprise(df: DataFrame, keep: Sequence[str] = (), newest: int = 24) -> DataFrame:
    """Reported against estimated earnings of the newest quarters."""
    rows = flat_rows(df, {"period": "fiscalDateEnding", "reported": "reportedEPS number", "estimated": "estimatedEPS number"}, "quarterlyEarnings", keep)
    rank = F.row_number().over(Window.partitionBy(*keep).orderBy(F.col("period").desc()))
    rows = rows.withColumn("surprise", F.col("reported") - F.col("estimated")).withColumn("surprise_pct", F.when(F.col("estimated") != 0, F.col("surprise") / F.abs("estimated") * 100))
    return rows.withColumn("_k", rank).filter(F.col("_k") <= newest).drop("_k")


def weights(df: DataFrame, path: str, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """Shares as percentages (fund sectors, holdings)."""
    return flat_rows(df, {"name": name, "weight": "weight number"}, path, keep).withColumn("weight", F.col("weight") * 100)


# --- N21-N27: matrices, series, text, facts ----------------------------------------------------


def full_matrix(df: DataFrame, labels: str, rows: str, keep: Sequence[str] = ()) -> DataFrame:
    """A lower-triangular matrix as (a, b, value), filled symmetrically."""
    lower = df.select(*keep, labels, F.posexplode(rows).alias("i", "_row")).select(*keep, labels, "i", F.posexplode("_row").alias("j", "value"))
    name = lambda k: F.try_element_at(F.col(labels), k + 1)
    cells = F.array_distinct(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b"))))
    return lower.select(*keep, labels, "value", F.explode(cells).alias("c")).select(*keep, name(F.col("c.a")).alias("a"), name(F.col("c.b")).alias("b"), "value")


def aligned_series(long: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(time, name, value) -> one row per time and a column per name; gaps stay missing."""
    return long.groupBy(*keep, "time").pivot("name", list(names)).agg(F.first("value"))


def transcript_blocks(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Speaker blocks of a transcript in order, with sentiment where it is given."""
    rows = df.select(*keep, F.posexplode(F.from_json(_get(F.col("payload"), "transcript"), RECORDS)).alias("block", "r"))
    r = F.col("r")
    return rows.select(*keep, "block", _get(r, "speaker").alias("speaker"), _get(r, "content").alias("content"), _num(r, "sentiment").alias("sentiment"))


def paragraphs(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """Non-blank paragraphs of a text, whole and in order."""
    parts = F.filter(F.transform(F.split(text, r"\n+"), lambda p: F.trim(p)), lambda p: p != "")
    return df.select(*keep, F.posexplode(parts).alias("paragraph", "content"))


def company_facts(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """taxonomy x concept x unit: number of observations and the latest by end date."""
    level = df.select(*keep, F.explode(F.from_json(_get(F.col("payload"), "facts"), MAPPING)).alias("taxonomy", "_t"))
    level = level.select(*keep, "taxonomy", F.explode(F.from_json("_t", MAPPING)).alias("concept", "_c"))
    level = level.select(*keep, "taxonomy", "concept", F.explode(F.from_json(_get(F.col("_c"), "units"), MAPPING)).alias("unit", "_o"))
    seen = level.select(*keep, "taxonomy", "concept", "unit", F.explode(F.from_json("_o", RECORDS)).alias("r"))
    return seen.groupBy(*keep, "taxonomy", "concept", "unit").agg(
        F.count(F.lit(1)).alias("observations"), F.max_by(_num(F.col("r"), "val"), _get(F.col("r"), "end")).alias("latest"), F.max(_get(F.col("r"), "end")).alias("end")
    )


def rating_counts(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Analyst ratings per label."""
    rows = df.select(*keep, F.explode(F.from_json(_get(F.col("payload"), "analysts"), RECORDS)).alias("r"))
    return rows.groupBy(*keep, _get(F.col("r"), "rating").alias("rating")).agg(F.count(F.lit(1)).alias("analysts"))


def horizon_changes(df: DataFrame, horizons: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Changes by horizon as rows; percent text and plain numbers both count."""
    value = lambda h: F.coalesce(percent_value(_get(F.col("payload"), h)), _num(F.col("payload"), h))
    cells = F.array(*(F.struct(F.lit(h).alias("horizon"), value(h).alias("change_pct")) for h in horizons))
    return df.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.*")


# --- N28-N33: generic shapes and broker records ------------------------------------------------


def value_type(text: Column) -> Column:
    return (
        F.when(text.rlike(DATE), "date").when(text.rlike(DATETIME), "datetime").when(text.rlike("^https?://"), "url")
        .when(percent_value(text).isNotNull(), "percent").when(to_number(text).isNotNull(), "number").otherwise("text")
    )


def key_facts(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """A flat mapping as typed facts; missing values are left out and signed numbers get a tone."""
    rows = df.select(*keep, F.explode(F.from_json("payload", MAPPING)).alias("key", "text"))
    number = F.coalesce(percent_value(F.col("text")), to_number(F.col("text")))
    tone = F.when(F.lower("key").contains("change"), F.when(number > 0, "positive").when(number < 0, "negative"))
    present = ~F.trim("text").isin(*MISSING)
    return rows.filter(F.col("text").isNotNull() & present).select(*keep, "key", "text", value_type(F.col("text")).alias("type"), number.alias("number"), tone.alias("tone"))


#: Last words of names whose numbers are labels, not amounts.
LABEL_WORDS = ("id", "code", "symbol", "zip", "year", "quarter")


def column_types(cells: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Type of each named column from all its present values: dates, addresses and percentages need every value, numbers 90%.

    Numbers that label something stay text: a value with a leading zero, or a name that ends in one of ``LABEL_WORDS``.
    """
    text = F.col("text")
    kind = value_type(text)
    shares = cells.groupBy(*keep, "name").agg(
        *(F.avg((kind == k).cast("double")).alias(k) for k in ("date", "datetime", "url", "percent", "number")),
        F.max(text.rlike("^0[0-9]+$")).alias("_padded"),
    )
    words = F.split(F.lower(F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1_$2")), "[^a-z0-9]+")
    labels = F.element_at(words, -1).isin(*LABEL_WORDS) | F.col("_padded")
    whole = F.coalesce(*(F.when(F.col(k) == 1, F.lit(k)) for k in ("date", "datetime", "url", "percent")))
    number = F.when((F.col("number") >= 0.9) & ~F.coalesce(labels, F.lit(False)), "number")
    return shares.select(*keep, "name", F.coalesce(whole, number, F.lit("text")).alias("type"))


def json_leaves(df: DataFrame, depth: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """Any JSON as (path, value) leaves down to a depth; deeper values stay JSON text."""
    level = df.select(*keep, F.lit("$").alias("path"), F.col("payload").alias("value"))
    done = None
    for step in range(depth + 1):
        is_map, is_list = F.col("value").startswith("{"), F.col("value").startswith("[")
        leaf = level if step == depth else level.filter(~F.coalesce(is_map | is_list, F.lit(False)))
        done = leaf if done is None else done.unionByName(leaf)
        if step < depth:
            named = level.filter(is_map).select(*keep, "path", F.explode(F.from_json("value", MAPPING)).alias("k", "value")).select(*keep, F.concat_ws(".", "path", "k").alias("path"), "value")
            listed = level.filter(is_list).select(*keep, F.concat("path", F.lit("[]")).alias("path"), F.explode(F.from_json("value", RECORDS)).alias("value"))
            level = named.unionByName(listed)
    return done.filter(F.col("path") != "$")


def dedupe_series(rows: DataFrame, position: str, keep: Sequence[str] = ()) -> DataFrame:
    """The last value of each timestamp."""
    rest = [c for c in rows.columns if c not in (*keep, "time", position)]
    return rows.groupBy(*keep, "time").agg(F.max_by(F.struct(*rest), position).alias("r")).select(*keep, "time", "r.*")


def candles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complete candles, and how many rows were incomplete."""
    whole = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    return rows.filter(whole), rows.agg(F.count_if(~whole).alias("incomplete"))


# Order states that are still open, and those that can be cancelled.
OPEN_STATES = (
    "new", "partially_filled", "accepted", "pending_new", "accepted_for_bidding", "pending_cancel", "pending_replace", "held", "calculated", "stopped", "suspended",
)
CANCELABLE = tuple(state for state in OPEN_STATES if state != "pending_cancel")


LEG = T.StructType().add("r", T.StringType()).add("parent", T.StringType())


@F.pandas_udf(T.ArrayType(LEG))
def _legs(payload: pd.Series) -> pd.Series:
    """Each order of a list and each leg below it, as JSON without its own legs, beside the id of the order above."""

    def one(text):
        try:
            orders = json.loads(text or "null", parse_int=str, parse_float=str)
        except (ValueError, RecursionError):
            return []
        out, open_ = [], [(orders, None)]
        while open_:
            level, parent = open_.pop()
            for order in level if isinstance(level, list) else ():
                if isinstance(order, dict):
                    out.append({"r": json.dumps({k: v for k, v in order.items() if k != "legs"}), "parent": parent})
                    own = order.get("id")
                    open_.append((order.get("legs"), own if isinstance(own, str) else None))
        return out

    return payload.map(one)


def order_rows(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Orders and their legs, of any depth, with prices, times, and open and cancelable flags; one pass over the payloads."""
    r = F.col("l.r")
    status = F.lower(_get(r, "status"))
    return df.select(*keep, F.explode(_legs("payload")).alias("l")).select(
        *keep, _get(r, "id").alias("id"), F.col("l.parent").alias("parent"), _get(r, "client_order_id").alias("client_order_id"), _get(r, "symbol").alias("symbol"), _get(r, "side").alias("side"),
        F.coalesce(_get(r, "type"), _get(r, "order_type")).alias("type"), *(_num(r, n).alias(n) for n in ("qty", "filled_qty", "filled_avg_price", "limit_price", "stop_price", "trail_price", "trail_percent")),
        *(moment(_get(r, n)).alias(n) for n in ("submitted_at", "filled_at")), status.alias("status"), status.isin(*OPEN_STATES).alias("open"), status.isin(*CANCELABLE).alias("cancelable"),
    )


def position_rows(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Positions; ratios of the broker become percentages."""
    rows = df.select(*keep, F.explode(F.from_json("payload", RECORDS)).alias("r"))
    r = F.col("r")
    return rows.select(*keep, _get(r, "symbol").alias("symbol"), *(_num(r, n).alias(n) for n in ("qty", "avg_entry_price", "current_price", "market_value", "unrealized_pl")), (_num(r, "unrealized_plpc") * 100).alias("unrealized_pl_pct"))


def account_facts(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    p = F.col("payload")
    equity, last = _num(p, "equity"), _num(p, "last_equity")
    return df.select(*keep, equity.alias("equity"), last.alias("last_equity"), (equity - last).alias("day_change"), F.when(last != 0, (equity - last) / last * 100).alias("day_change_pct"))


def activity_rows(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    rows = df.select(*keep, F.explode(F.from_json("payload", RECORDS)).alias("r"))
    r = F.col("r")
    return rows.select(*keep, _get(r, "activity_type").alias("type"), F.coalesce(moment(_get(r, "transaction_time")), moment(_get(r, "date"))).alias("time"), _get(r, "symbol").alias("symbol"), F.coalesce(_num(r, "net_amount"), _num(r, "qty") * _num(r, "price")).alias("amount"))


def portfolio_history(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Parallel arrays of a portfolio's history as rows."""
    arrays = F.from_json("payload", "timestamp ARRAY<BIGINT>, equity ARRAY<DOUBLE>, profit_loss ARRAY<DOUBLE>")
    part = lambda n, kind: F.coalesce(F.col(f"a.{n}"), F.array().cast(f"array<{kind}>")).alias(n)
    rows = df.select(*keep, arrays.alias("a")).select(*keep, part("timestamp", "bigint"), part("equity", "double"), part("profit_loss", "double"))
    rows = rows.select(*keep, F.explode(F.arrays_zip("timestamp", "equity", "profit_loss")).alias("r"))
    return rows.select(*keep, F.col("r.timestamp").alias("time"), F.col("r.equity").alias("equity"), F.col("r.profit_loss").alias("profit_loss"))
