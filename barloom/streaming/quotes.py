"""Newest quote fields as a stream: one state map for each part of a symbol's fields."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.streaming.capture import quote_updates

#: Parts that the fields of one symbol are dealt to, so that a busy symbol is many groups.
PARTS = 16
CHANGES = "symbol string, field string, seq long, value string"


class NewestFields(StatefulProcessor):
    """Holds the newest value of each field of a group and passes on what replaces an older one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "field string", "seq long, value string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest, changed = {}, set()
        for row in rows:
            if row.field not in newest:
                newest[row.field] = tuple(self.held.getValue((row.field,))) if self.held.containsKey((row.field,)) else None
            if newest[row.field] is None or (row.seq, row.value) > newest[row.field]:
                newest[row.field] = row.seq, row.value
                changed.add(row.field)
                yield Row(symbol=key[0], field=row.field, seq=row.seq, value=row.value)
        for field in changed:
            self.held.updateValue((field,), newest[field])

    def close(self) -> None:
        pass


def field_changes(messages: DataFrame, parts: int = PARTS) -> DataFrame:
    """``symbol, field, seq, value``: each update of a field that is newer than all taken before.

    Updates are taken one at a time, in any order: an older one changes nothing, nor does one that comes again; of two with
    the same ``seq`` the greater value counts. A field without value, and an update without ``seq``, are left out. State
    and memory of a group are the fields of its part; no batch is held or sorted. The session needs a state store with
    column families (``spark.sql.streaming.stateStore.providerClass``: the RocksDB one).
    """
    fields = quote_updates(messages).select("symbol", "seq", F.explode("values").alias("field", "value"))
    fields = fields.where("seq IS NOT NULL AND value IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("field"), F.lit(parts)))
    return fields.groupBy("symbol", "part").transformWithState(NewestFields(), CHANGES, "Append", "None")


def current_quotes(changes: DataFrame) -> DataFrame:
    """``symbol, seq, state``: the state of each symbol by a table of changes, and the last update that is in it. Fields are
    reduced to their newest value before a symbol is put together."""
    newest = changes.groupBy("symbol", "field").agg(F.max(F.struct("seq", "value")).alias("x"))
    entries = F.array_sort(F.collect_list(F.struct("field", "x.value")))
    return newest.groupBy("symbol").agg(F.max("x.seq").alias("seq"), F.map_from_entries(entries).alias("state"))
