"""Tables written in the shared folder of the cluster and read again; memory that workers give back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import shared_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in a folder of its own, and read from there: later jobs start from the files."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` by their names, whatever these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def give_back() -> None:
    """Memory that this process has freed, but still holds, goes to the system: Arrow's and, where the C library can, its own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow. Workers wait for later tasks, also of other stages: what a task held is given back at its end."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
