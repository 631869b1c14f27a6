"""How a series table is cut into window partitions.

Most tables hold many series of moderate length: a window partitioned by the series key is then the
right plan and nothing here adds work. A key holding a large share of the table would put that share
into one task, so such tables are cut by time instead:

* a *cell* is a slice of time inside one key, sized to about 1/16 of a block: each key's own time range is
  cut evenly first, and a cell that a burst overfills is cut again, until none is too full or it is as
  short as a timestamp can tell;
* a *block* is a run of neighbouring cells of one key holding about ``block_rows`` rows, and is what
  a window is partitioned by;
* each block also receives the whole cells that hold the ``halo`` rows before it, so a window that
  looks back at most ``halo`` rows sees exactly what it would see on the uncut series.

Running totals and recurrences carry their state from cell to cell through a table with one row per
cell (see ``series.py``); no step collects a whole key.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.schema import KEYS, ORDER
from barloom.session import cut_lineage

BLOCK_ROWS = 2_000_000
CELLS_PER_BLOCK = 16

BLOCK, CELL, OWN, START = "_block", "_cell", "_own", "_cell_row"


@dataclass(frozen=True)
class Layout:
    """Window partitioning of one table. ``cut`` is False when whole keys are window partitions."""

    keys: tuple[str, ...] = KEYS
    order: str = ORDER
    cut: bool = False
    block_rows: int = BLOCK_ROWS
    #: Start and cell width of each key, and for each round of cutting the cells that are cut (microseconds).
    ranges: DataFrame | None = field(default=None, compare=False)
    splits: tuple[DataFrame, ...] = field(default=(), compare=False)

    @property
    def partition(self) -> tuple[str, ...]:
        return (*self.keys, BLOCK) if self.cut else self.keys

    @property
    def carry(self) -> tuple[str, ...]:
        """Columns naming the unit whose state is carried (a cell, or the whole key)."""
        return (*self.keys, CELL) if self.cut else self.keys

    def ordered(self):
        return Window.partitionBy(*self.partition).orderBy(self.order)

    def rows(self, first: int, last: int = 0):
        return self.ordered().rowsBetween(first, last)

    def running(self):
        """From the start of the carried unit to the current row."""
        unit = Window.partitionBy(*self.partition, CELL) if self.cut else Window.partitionBy(*self.keys)
        return unit.orderBy(self.order).rowsBetween(Window.unboundedPreceding, 0)


def plan_layout(
    df: DataFrame,
    keys: tuple[str, ...] = KEYS,
    order: str = ORDER,
    block_rows: int = BLOCK_ROWS,
) -> Layout:
    """Choose the layout from one small aggregation: rows and time range of each key.

    The scan behind it reads only the key and order columns, and the result is one number. Where a key must be cut,
    rows are counted by cell, once for each round of cutting.
    """
    micros = _micros(order)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(micros).alias("_lo"), F.max(micros).alias("_hi"))
    longest = counts.agg(F.max("n").alias("n")).first()
    if longest is None or longest.n is None or longest.n <= block_rows:
        return Layout(keys=keys, order=order, block_rows=block_rows)
    target = max(1, block_rows // CELLS_PER_BLOCK)
    width = F.floor((F.col("_hi") - F.col("_lo")) / F.ceil(F.col("n") / target)) + 1
    ranges = cut_lineage(counts.where("_lo IS NOT NULL").select(*keys, "_lo", width.cast("long").alias("_width")))
    layout = Layout(keys, order, True, block_rows, ranges)
    while True:
        cells = _tagged(df.select(*keys, order), layout, keep_width=True).groupBy(*keys, CELL, "_width").agg(F.count(F.lit(1)).alias("n"))
        full = cut_lineage(cells.where((F.col("n") > target) & (F.col("_width") > 1)).select(*keys, F.col(CELL).alias("_from"), F.least(F.ceil(F.col("n") / target) * 4, F.col("_width")).cast("long").alias("_parts")))
        if full.isEmpty():
            return layout
        layout = replace(layout, splits=(*layout.splits, full))


def _micros(order: str):
    return F.unix_micros(F.col(order).cast("timestamp"))


def _tagged(df: DataFrame, layout: Layout, keep_width: bool = False) -> DataFrame:
    """``df`` with the cell of each row: the first microsecond of its slice of time."""
    keys, at = list(layout.keys), _micros(layout.order)
    rows = df.join(layout.ranges, keys, "left")
    rows = rows.withColumn(CELL, F.col("_lo") + F.floor((at - F.col("_lo")) / F.col("_width")) * F.col("_width"))
    for split in layout.splits:
        rows = rows.join(split.withColumnRenamed("_from", CELL), [*keys, CELL], "left")
        narrow = F.coalesce(F.ceil(F.col("_width") / F.col("_parts")), F.col("_width")).cast("long")
        rows = rows.withColumn("_width", narrow).drop("_parts").withColumn(CELL, F.col(CELL) + F.floor((at - F.col(CELL)) / F.col("_width")) * F.col("_width"))
    return rows.drop("_lo", *(() if keep_width else ("_width",)))


def spread(df: DataFrame, layout: Layout, halo: int) -> DataFrame:
    """Add the block columns and copy the halo cells; a no-op for an uncut layout.

    Added columns: block, cell, whether the row is owned by the block (halo copies are not), and the
    number of rows of the key before the cell.
    """
    if not layout.cut:
        return df
    tagged = _tagged(df, layout)
    keys = layout.keys
    by_time = Window.partitionBy(*keys).orderBy(CELL)
    cells = (
        tagged.groupBy(*keys, CELL)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn(START, F.sum("_rows").over(by_time.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows"))
        .withColumn("_no", F.row_number().over(by_time))
        .withColumn("_home", F.floor(F.col(START) / layout.block_rows).cast("long"))
    )
    blocks = cells.groupBy(*keys, F.col("_home").alias(BLOCK)).agg(
        F.min(START).alias("_from"), F.min("_no").alias("_first_no")
    )
    # Back to the start of the cell holding the earliest row a window needs, then as far again for
    # the windows that feed a recurrence inside that cell.
    near = _cell_at(cells, blocks, F.col("_from") - halo, keys)
    far = _cell_at(cells, near, F.coalesce(F.col("_at_start"), F.lit(0)) - halo, keys)
    earliest = F.coalesce(F.col("_at_no"), F.lit(1))
    guests = far.filter(earliest < F.col("_first_no")).select(
        *keys, BLOCK, F.explode(F.sequence(earliest, F.col("_first_no") - 1)).alias("_no")
    )
    placed = cells.select(*keys, CELL, START, F.col("_home").alias(BLOCK), F.lit(True).alias(OWN)).unionByName(
        guests.join(cells, [*keys, "_no"]).select(*keys, CELL, START, BLOCK, F.lit(False).alias(OWN))
    )
    return tagged.join(placed, [*keys, CELL])


def _cell_at(cells: DataFrame, blocks: DataFrame, row, keys) -> DataFrame:
    """For each block, the cell of its key that holds row number ``row`` (NULL before the first)."""
    marks = cells.select(*keys, F.col(START).alias("_row"), F.struct(F.col(START).alias("s"), F.col("_no").alias("n")).alias("_cell_mark"))
    asks = blocks.select(*keys, row.alias("_row"), F.struct(BLOCK, "_from", "_first_no").alias("_ask"))
    so_far = Window.partitionBy(*keys).orderBy("_row").rangeBetween(Window.unboundedPreceding, 0)
    return (
        marks.unionByName(asks, allowMissingColumns=True)
        .withColumn("_found", F.last("_cell_mark", ignorenulls=True).over(so_far))
        .filter(F.col("_ask").isNotNull())
        .select(*keys, "_ask.*", F.col("_found.s").alias("_at_start"), F.col("_found.n").alias("_at_no"))
    )


def gather(df: DataFrame, layout: Layout) -> DataFrame:
    """Drop halo copies and the block columns."""
    if not layout.cut:
        return df
    return df.filter(OWN).drop(BLOCK, CELL, OWN, START)
