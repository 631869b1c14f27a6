"""Canonical body of a ledger line, without its hash."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


CANONICAL = json.JSONEncoder(sort_keys=True, separators=(",", ":"), allow_nan=False)


@F.pandas_udf(T.StringType())
def body_without_hash(line: pd.Series) -> pd.Series:
    def one(text):
        try:
            entry = json.loads(text)
            entry.pop("hash", None)
            return CANONICAL.encode(entry)
        except (AttributeError, TypeError, ValueError):
            return None

    return line.map(one)
