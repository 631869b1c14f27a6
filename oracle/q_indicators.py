"""Checked queries: one per indicator."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import registry
from barloom.operators.indicators import references
from barloom.operators.series import Series
from barloom.sources.ticks import event_bars
from oracle.checks import check, rounded, seconds, table
from oracle.indicators import DIGITS, LOGGED, indicator_sql


def _query(ident: str):
    def run(spark, sf_dir):
        s = Series(event_bars(table(spark, sf_dir, "events")))
        outputs = references(s, ident)
        for name, ref in outputs.items():
            s.output(f"{ident}.{name}", ref)
        df = s.build()
        return df.select("symbol", seconds("ts").alias("ts"), *(rounded(shown(df[f"`{ident}.{n}`"]), DIGITS.get(ident, 6)).alias(n) for n in outputs))

    def shown(value):
        return F.ln(value) if ident in LOGGED else value

    return run


for _name, _sql in indicator_sql().items():
    check(_name, _sql)(_query(_name.removeprefix("indicator_")))

assert len(registry.all_indicators()) == 127
