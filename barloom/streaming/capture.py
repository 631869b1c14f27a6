"""Streaming capture: frames to stored bars, quotes to merged state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.schema import KEYS
from barloom.sources.frames import bars_from_frames, parse_frames, quotes_from_frames
from barloom.sources.sinks import upsert_bars

MESSAGES = "symbol string, timeframe string, seq long, raw string"


def message_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Captured messages as JSON lines: (symbol, timeframe, seq, raw). A micro-batch reads at most ``files`` files, so that
    catching up after a pause is many batches and not one of everything."""
    return spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", files).json(path)


def bar_updates(messages: DataFrame) -> DataFrame:
    """Bar versions of a stream or table of messages; ``seq`` orders the versions."""
    keep = (*KEYS, "seq")
    return bars_from_frames(parse_frames(messages, keep=keep), keep).withColumnRenamed("seq", "version").drop("session", "source_index")


def capture_bars(messages: DataFrame, store: str, checkpoint: str):
    """Keep the store up to date. No watermark: a late or corrected bar is accepted however late."""

    def merge(batch: DataFrame, _: int) -> None:
        upsert_bars(batch, store)

    return (
        bar_updates(messages).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def quote_updates(messages: DataFrame) -> DataFrame:
    return quotes_from_frames(parse_frames(messages, keep=("seq",)), ("seq",))


def _merge_state(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    import json

    held = json.loads(state.get[0]) if state.exists else {}
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for row in rows.itertuples(index=False):
        held.update(json.loads(row.changes))
        out.append((key[0], row.seq, json.dumps(held, sort_keys=True)))
    state.update((json.dumps(held),))
    yield pd.DataFrame(out, columns=["symbol", "seq", "state"])


def merged_quotes(messages: DataFrame) -> DataFrame:
    """The full state of a symbol after each partial update (state: one small map per symbol)."""
    changes = quote_updates(messages).select("symbol", "seq", F.to_json("values").alias("changes"))
    return changes.groupBy("symbol").applyInPandasWithState(
        _merge_state, "symbol string, seq long, state string", "held string", "append", GroupStateTimeout.NoTimeout
    )


def append_quotes(quotes: DataFrame, path: str, checkpoint: str, form: str = "json"):
    """Append rendered quotes as files."""
    return quotes.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
