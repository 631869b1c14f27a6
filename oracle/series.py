"""SQL twins of the series operators: a chain of CTE layers, each adding one column."""

from __future__ import annotations

EVENT_BARS = """
event_ticks AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS bar, ts AS t, event_id, value FROM events WHERE value > 0),
bars AS (SELECT symbol, bar AS ts,
  arg_min(value, {'t': t, 'i': event_id}) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, {'t': t, 'i': event_id}) AS close, count(*)::DOUBLE AS volume
  FROM event_ticks GROUP BY symbol, bar)"""

ORDER_BARS = """
bars AS (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) AS ts,
  arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume
  FROM orders WHERE o_totalprice > 0 GROUP BY 1, 2)"""

BY = "PARTITION BY symbol ORDER BY ts"


def rounded(expression: str, digits: int = 6) -> str:
    """Rounded on both sides; a zero has no sign."""
    value = f"round({expression}, {digits})"
    return f"CASE WHEN {value} = 0 THEN 0.0 WHEN isfinite({expression}) THEN {value} END"


class Q:
    """Column layers over the bars. ``add`` returns the new column's name."""

    def __init__(self, source: str = EVENT_BARS):
        self.source = source
        self.layers: list[str] = []
        self.memo: dict[str, str] = {}

    def add(self, expression: str) -> str:
        if expression not in self.memo:
            name = f"c{len(self.layers) + 1}"
            self.memo[expression] = name
            self.layers.append(expression)
        return self.memo[expression]

    def ctes(self) -> str:
        text = self.source.strip() + ",\nb0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars)"
        for i, expression in enumerate(self.layers):
            text += f",\nb{i + 1} AS (SELECT *, {expression} AS c{i + 1} FROM b{i})"
        return text

    @property
    def last(self) -> str:
        return f"b{len(self.layers)}"

    def select(self, columns: str, tail: str = "") -> str:
        return f"WITH {self.ctes()}\nSELECT {columns} FROM {self.last} {tail}"

    def outputs(self, digits: int = 6, **columns: str) -> str:
        body = ", ".join(f"{rounded(x, digits)} AS {name}" for name, x in columns.items())
        return self.select(f"symbol, epoch(ts)::BIGINT AS ts, {body}")

    # --- helpers, in the library's terms
    def lag(self, x, k=1):
        return self.add(f"lag({x}, {k}) OVER ({BY})") if k else x

    def diff(self, x, k=1):
        return self.add(f"{x} - {self.lag(x, k)}")

    def change(self, x, k=1):
        return self.add(f"{x} / nullif({self.lag(x, k)}, 0) - 1")

    def roc(self, x, k):
        return self.add(f"100 * ({x} / nullif({self.lag(x, k)}, 0) - 1)")

    def pct(self, a, b):
        return self.add(f"100 * ({a} / nullif({b}, 0) - 1)")

    def logc(self, x, k=1):
        return self.add(f"ln(nullif({x} / {self.lag(x, k)}, 0))")

    def frame(self, n):
        return f"OVER ({BY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    def agg(self, f, x, n, arguments=None):
        w = self.frame(n)
        return self.add(f"CASE WHEN count({x}) {w} = {n} THEN {f}({arguments or x}) {w} END")

    def mean(self, x, n):
        return self.agg("avg", x, n)

    def sum(self, x, n):
        return self.agg("sum", x, n)

    def max(self, x, n):
        return self.agg("max", x, n)

    def min(self, x, n):
        return self.agg("min", x, n)

    def std(self, x, n, ddof):
        return self.agg("stddev_samp" if ddof else "stddev_pop", x, n)

    def var(self, x, n, ddof):
        return self.agg("var_samp" if ddof else "var_pop", x, n)

    def lists(self, x, first, last):
        return f"list({x}) OVER ({BY} ROWS BETWEEN {-first} PRECEDING AND {str(-last) + ' PRECEDING' if last else 'CURRENT ROW'})"

    def wma(self, x, n):
        l = self.agg("list", x, n)
        w = n * (n + 1) / 2
        return self.add(f"list_sum(list_transform({l}, lambda v, i: v * i)) / {w}")

    def ewm(self, x, alpha, warm):
        c = f"OVER ({BY} ROWS UNBOUNDED PRECEDING)"
        return self.add(
            f"CASE WHEN {x} IS NOT NULL AND count({x}) {c} >= {warm} THEN "
            f"list_reduce(list({x}) FILTER (WHERE {x} IS NOT NULL) {c}, lambda a, z: {1 - alpha!r} * a + {alpha!r} * z) END"
        )

    def ema(self, x, n):
        return self.ewm(x, 2 / (n + 1), n)

    def wilder(self, x, n):
        return self.ewm(x, 1 / n, n)

    def run(self, f, x):
        return self.add(f"{f}({x}) OVER ({BY} ROWS UNBOUNDED PRECEDING)")

    def tr(self):
        p = self.lag("close")
        return self.add(f"CASE WHEN rn = 1 THEN high - low ELSE greatest(high - low, abs(high - {p}), abs(low - {p})) END")

    def tr1(self):
        return self.add(f"CASE WHEN rn > 1 THEN {self.tr()} END")

    def tp(self):
        return self.add("(high + low + close) / 3")

    def mid(self):
        return self.add("(high + low) / 2")

    def strength(self, d, n):
        g = self.wilder(self.add(f"CASE WHEN {d} IS NOT NULL THEN greatest({d}, 0) END"), n)
        l = self.wilder(self.add(f"CASE WHEN {d} IS NOT NULL THEN greatest(-{d}, 0) END"), n)
        return self.add(
            f"CASE WHEN {g} IS NULL OR {l} IS NULL THEN NULL WHEN {l} = 0 THEN CASE WHEN {g} > 0 THEN 100.0 ELSE 50.0 END "
            f"WHEN {g} = 0 THEN 0.0 ELSE 100 - 100 / (1 + {g} / {l}) END"
        )

    def rsi(self, n=14):
        return self.strength(self.diff("close"), n)

    def clamp(self, x, lo, hi):
        return self.add(f"CASE WHEN {x} < {lo} THEN {lo} WHEN {x} > {hi} THEN {hi} ELSE {x} END")

    def stoch(self, x, hi, lo):
        return self.add(f"100 * ({x} - {lo}) / nullif({hi} - {lo}, 0)")

    def regr(self, x, n):
        slope = self.agg("regr_slope", x, n, f"{x}, rn")
        mean = self.mean(x, n)
        value = self.add(f"{mean} + {slope} * {(n - 1) / 2}")
        var = self.var(x, n, 0)
        r2 = self.add(f"CASE WHEN {var} > 1e-24 * {mean} * {mean} THEN least(1.0, {slope} * {slope} * {(n * n - 1) / 12} / {var}) END")
        return slope, value, r2

    def clv(self):
        return self.add("CASE WHEN high = low THEN 0.0 ELSE (2 * close - high - low) / (high - low) END")

    def rank(self, x, n):
        w = f"OVER ({BY} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        l = self.add(f"CASE WHEN count({x}) {w} = {n} THEN list({x}) {w} END")
        return self.add(f"100.0 * len(list_filter({l}, lambda e: e < {x})) / {n}")

    def fold(self, fields: dict[str, str], state: dict[str, str], step: dict[str, str], when: str = "TRUE"):
        """Sequential fold over the rows so far; ``step`` expressions use a.<state> and z.<field>."""
        both = {**fields, **state}
        start = ", ".join(f"'{k}': ({v})::DOUBLE" for k, v in both.items())
        item = self.add("{" + start + "}")
        parts = [f"'{k}': z.{k}" for k in fields] + [f"'{k}': ({v})::DOUBLE" for k, v in step.items()]
        c = f"OVER ({BY} ROWS UNBOUNDED PRECEDING)"
        return self.add(f"list_reduce(list({item}) FILTER (WHERE {when}) {c}, lambda a, z: {{{', '.join(parts)}}})")
