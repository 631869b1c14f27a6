"""Staged series columns over one bars table.

``Series`` collects column definitions and places each in the earliest pass that has its inputs, so
any number of indicators share passes, window sorts and common sub-expressions: the same (operation,
input, parameter) triple always yields one column. A pass is one ``select`` of window functions over
one window partitioning, or one Arrow pass for recurrences; the rows stay in the partition and order
the window sort gave them, so passes after the first add no shuffle.

Values follow one rule throughout: a missing input is NULL, and a window value needs every one of its
rows present.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import layout as lay
from barloom.operators.layout import Layout, gather, plan_layout, spread
from barloom.operators.quantiles import key_quantiles
from barloom.operators.scans import affine_udf, recurrence_udf, stateful_udf
from barloom.schema import FIELDS, finite

# Windows from this length on are evaluated in two halves instead of row by row.
WIDE = 256


class Ref:
    """A column to be, with the pass it becomes available in and the rows it looks back."""

    __slots__ = ("s", "key", "col", "stage", "back")

    def __init__(self, s: "Series", key: str, col: Column, stage: tuple[int, int], back: int):
        self.s, self.key, self.col, self.stage, self.back = s, key, col, stage, back

    def _op(self, symbol: str, other, fn, flip: bool = False) -> "Ref":
        pair = (other, self) if flip else (self, other)
        return self.s.row(symbol, fn, *pair)

    def __add__(self, o):
        return self._op("+", o, lambda a, b: a + b)

    def __radd__(self, o):
        return self._op("+", o, lambda a, b: a + b, True)

    def __sub__(self, o):
        return self._op("-", o, lambda a, b: a - b)

    def __rsub__(self, o):
        return self._op("-", o, lambda a, b: a - b, True)

    def __mul__(self, o):
        return self._op("*", o, lambda a, b: a * b)

    def __rmul__(self, o):
        return self._op("*", o, lambda a, b: a * b, True)

    def __truediv__(self, o):
        return self._op("/", o, lambda a, b: F.try_divide(a, b))

    def __rtruediv__(self, o):
        return self._op("/", o, lambda a, b: F.try_divide(a, b), True)

    def __neg__(self):
        return self.s.row("neg", lambda a: -a, self)

    def __gt__(self, o):
        return self._op(">", o, lambda a, b: a > b)

    def __ge__(self, o):
        return self._op(">=", o, lambda a, b: a >= b)

    def __lt__(self, o):
        return self._op("<", o, lambda a, b: a < b)

    def __le__(self, o):
        return self._op("<=", o, lambda a, b: a <= b)


class Series:
    def __init__(self, df: DataFrame, layout: Layout | None = None, block_rows: int = lay.BLOCK_ROWS):
        self.df = df
        self.layout = layout if layout is not None else plan_layout(df, block_rows=block_rows)
        self._refs: dict[str, Ref] = {}
        self._windows: dict[tuple[int, int], list[tuple[str, Column]]] = {}
        self._scans: dict[int, list[tuple]] = {}
        self._named: dict[str, Ref] = {}
        self._halo = 0
        self._count = 0
        for name in FIELDS:
            if name in df.columns:
                setattr(self, name, self.column(name))

    # --- leaves and row expressions ------------------------------------------------------------

    def column(self, name: str) -> Ref:
        return self._refs.setdefault(f"@{name}", Ref(self, f"@{name}", F.col(name), (0, 0), 0))

    def row(self, key: str, fn: Callable[..., Column], *args) -> Ref:
        """A row expression of references and constants."""
        refs = [a for a in args if isinstance(a, Ref)]
        name = f"{key}[{','.join(a.key if isinstance(a, Ref) else repr(a) for a in args)}]"
        if name in self._refs:
            return self._refs[name]
        columns = [a.col if isinstance(a, Ref) else F.lit(float(a)) for a in args]
        stage = max((r.stage for r in refs), default=(0, 0))
        ref = Ref(self, name, fn(*columns), stage, max((r.back for r in refs), default=0))
        self._refs[name] = ref
        return ref

    def when(self, condition: Ref, value, otherwise=None) -> Ref:
        """``value`` where the condition holds, else ``otherwise``; a missing condition is false."""
        if otherwise is None:
            return self.row("when", lambda c, v: F.when(c, v), condition, value)
        return self.row("whenelse", lambda c, v, o: F.when(c, v).otherwise(o), condition, value, otherwise)

    def store(self, x: Ref) -> Ref:
        """Compute a row expression once, as a column, instead of repeating it in every use."""
        return self.window("store", lambda c, l: c, x, 0)

    def abs(self, x: Ref) -> Ref:
        return self.row("abs", F.abs, x)

    def ln(self, x: Ref) -> Ref:
        return self.row("ln", lambda v: F.when(v > 0, F.log(v)), x)

    def sqrt(self, x: Ref) -> Ref:
        return self.row("sqrt", lambda v: F.when(v >= 0, F.sqrt(v)), x)

    def clamp(self, x: Ref, lo: float, hi: float) -> Ref:
        return self.row("clamp", lambda v, a, b: F.when(v < a, a).when(v > b, b).otherwise(v), x, lo, hi)

    def greatest(self, *xs: Ref) -> Ref:
        """Largest value; missing when any is missing."""
        return self.row("greatest", lambda *v: F.when(_present(v), F.greatest(*v)), *xs)

    def least(self, *xs: Ref) -> Ref:
        return self.row("least", lambda *v: F.when(_present(v), F.least(*v)), *xs)

    def pct(self, a: Ref, b: Ref) -> Ref:
        """``100 * (a / b - 1)``."""
        return 100 * (a / b - 1)

    # --- windows -------------------------------------------------------------------------------

    def window(self, key: str, build: Callable[[Column, object], Column], x: Ref, back: int) -> Ref:
        """A window column: ``build(input, layout)`` returns the windowed expression."""
        name = f"{key}[{x.key}]"
        if name not in self._refs:
            column = self._new_name()
            stage = (x.stage[0], x.stage[1] + 1)
            self._windows.setdefault(x.stage, []).append((column, build(x.col, self.layout)))
            self._add(name, column, stage, x.back + back)
        return self._refs[name]

    def lag(self, x: Ref, k: int = 1) -> Ref:
        if k == 0:
            return x
        return self.window(f"lag{k}", lambda c, l: F.lag(c, k).over(l.ordered()), x, k)

    def diff(self, x: Ref, k: int = 1) -> Ref:
        return x - self.lag(x, k)

    def change(self, x: Ref, k: int = 1) -> Ref:
        """Simple return over ``k`` rows, as a ratio."""
        return x / self.lag(x, k) - 1

    def roc(self, x: Ref, k: int) -> Ref:
        return self.pct(x, self.lag(x, k))

    def log_change(self, x: Ref, k: int = 1) -> Ref:
        return self.ln(x / self.lag(x, k))

    def _strict(self, label: str, agg: Callable[[Column], Column], x: Ref, n: int, least: int = 1) -> Ref:
        def build(c, l):
            w = l.rows(-(n - 1))
            return F.when(F.count(c).over(w) == n, agg(c).over(w)) if n >= least else F.lit(None).cast("double")

        return self.window(f"{label}{n}", build, x, n - 1)

    def sum(self, x: Ref, n: int) -> Ref:
        return self._strict("sum", F.sum, x, n) if n < WIDE else self._wide("sum", x, n)

    def mean(self, x: Ref, n: int) -> Ref:
        return self._strict("mean", F.avg, x, n) if n < WIDE else self._wide("sum", x, n) / n

    def var(self, x: Ref, n: int, ddof: int) -> Ref:
        if n >= WIDE:
            return self._wide("m2", x, n) / (n - ddof)
        return self._strict(f"var{ddof}_", F.var_samp if ddof else F.var_pop, x, n, 1 + ddof)

    def std(self, x: Ref, n: int, ddof: int) -> Ref:
        if n >= WIDE:
            return self.sqrt(self.var(x, n, ddof))
        return self._strict(f"std{ddof}_", F.stddev_samp if ddof else F.stddev_pop, x, n, 1 + ddof)

    def max(self, x: Ref, n: int) -> Ref:
        return self._strict("max", F.max, x, n) if n < WIDE else self._wide("max", x, n)

    def min(self, x: Ref, n: int) -> Ref:
        return self._strict("min", F.min, x, n) if n < WIDE else self._wide("min", x, n)

    def _wide(self, kind: str, x: Ref, n: int) -> Ref:
        """A long window in constant work per row.

        Rows are grouped by position in groups of ``n``. A window of ``n`` rows is the tail of one group
        and the head of the next, and both are running aggregates of their group.
        """
        at = self.position()
        tagged = self.store(self.row(f"grouped{n}", lambda v, p: F.struct(v.alias("v"), F.floor((p - 1) / n).alias("g")), x, at))

        def running(backwards):
            def build(c, l):
                order = F.col(l.order).desc() if backwards else F.col(l.order)
                w = Window.partitionBy(*l.partition, c["g"]).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
                v = c["v"]
                aggs = {"sum": [F.sum(v)], "max": [F.max(v)], "min": [F.min(v)], "m2": [F.var_pop(v), F.avg(v)]}[kind]
                return F.struct(F.count(v).over(w).alias("n"), *(a.over(w).alias(f"a{i}") for i, a in enumerate(aggs)))

            return build

        head = self.window(f"head_{kind}{n}", running(False), tagged, 0)
        tail = self.lag(self.window(f"tail_{kind}{n}", running(True), tagged, 0), n - 1)

        def merge(p, h, t):
            alone = p % n == 0
            merged = {
                "sum": lambda: h["a0"] + t["a0"],
                "max": lambda: F.greatest(h["a0"], t["a0"]),
                "min": lambda: F.least(h["a0"], t["a0"]),
                "m2": lambda: h["a0"] * h["n"] + t["a0"] * t["n"] + (h["a1"] - t["a1"]) * (h["a1"] - t["a1"]) * h["n"] * t["n"] / n,
            }[kind]()
            single = h["a0"] * n if kind == "m2" else h["a0"]
            return F.when(alone & (h["n"] == n), single).when(~alone & (h["n"] + t["n"] == n), merged)

        return self.row(f"wide_{kind}{n}", merge, at, head, tail)

    def position(self) -> Ref:
        """Row number of the bar inside its window partition (for regressions and arg-extremes)."""
        one = self.row("one", lambda c: F.lit(1.0), self.close)
        return self.window("rownumber", lambda c, l: F.row_number().over(l.ordered()).cast("double"), one, 0)

    def first_bar(self) -> Ref:
        """True on the first row of a key."""

        def build(c, l):
            if not l.cut:
                return F.row_number().over(l.ordered()) == 1
            in_cell = Window.partitionBy(*l.partition, lay.CELL).orderBy(l.order)
            return (F.col(lay.START) == 0) & (F.row_number().over(in_cell) == 1)

        return self.window("first", build, self.row("one", lambda c: F.lit(1.0), self.close), 0)

    def bars_since(self, x: Ref, n: int, highest: bool) -> Ref:
        """Rows since the extreme of the last ``n`` rows; the latest row wins ties."""
        at = self.position()
        pair = self.row("tag", lambda v, p: F.when(v.isNotNull(), F.struct((v if highest else -v).alias("v"), p.alias("p"))), x, at)
        last = self._strict("argext", lambda c: F.max(c), pair, n)
        return self.row("since", lambda p, best: p - best["p"], at, last)

    def regression(self, x: Ref, n: int) -> tuple[Ref, Ref, Ref]:
        """Slope, fitted value at the last row and r-squared over ``n`` rows."""
        at = self.position()
        mean, dev = self.mean(x, n), self.var(x, n, 0)
        xy = self.row("pair", lambda v, p: F.struct(v.alias("v"), p.alias("p")), x, at)

        def slope_of(c, l):
            return F.regr_slope(c["v"], c["p"]).over(l.rows(-(n - 1)))

        slope = self.window(f"slope{n}", slope_of, xy, n - 1)
        slope = self.row("needs", lambda v, m: F.when(m.isNotNull(), v), slope, mean)
        value = mean + slope * ((n - 1) / 2)
        spread_x = (n * n - 1) / 12
        r2 = self.row(
            "r2",
            lambda b, v, m: F.when(v > 1e-12 * F.abs(m) * F.abs(m) * 1e-12, F.least(F.lit(1.0), b * b * spread_x / v)),
            slope, dev, mean,
        )
        return slope, value, r2

    def wma(self, x: Ref, n: int) -> Ref:
        """Linear weights 1..n, the newest row heaviest."""
        at = self.position()
        total = self.sum(x, n)
        weighted = self.sum(x * at, n)
        return (weighted - (at - n) * total) / (n * (n + 1) / 2)

    def collected(self, x: Ref, first: int, last: int, label: str, fold: Callable[[Column], Column]) -> Ref:
        """Fold of the values of a bounded frame, for the statistics no aggregate expresses."""
        need = last - first + 1

        def build(c, l):
            w = l.rows(first, last)
            return F.when(F.count(c).over(w) == need, fold(F.collect_list(c).over(w)))

        return self.window(f"{label}{first}:{last}", build, x, -first)

    # --- whole-sample thresholds ---------------------------------------------------------------

    def threshold(self, x: Ref, probability: float, sample: Sequence[str]) -> Ref:
        """A quantile of ``x`` over all rows that share the ``sample`` columns (the whole table if none)."""
        return self._scan(f"quantile{probability!r}:{','.join(sample)}", ("quantile", probability, tuple(sample)), [x])[0]

    # --- running totals ------------------------------------------------------------------------

    def running(self, kind: str, x: Ref) -> Ref:
        """Running ``sum``, ``max``, ``product`` or ``count`` from the first row of the key.

        Missing rows are skipped and yield the total so far; wrap with ``only_where`` to blank them.
        """
        if not self.layout.cut:
            agg = {"sum": F.sum, "max": F.max, "product": F.product, "count": F.count}[kind]
            return self.window(f"running_{kind}", lambda c, l: agg(c).over(l.running()), x, 0)
        return self._scan(f"running_{kind}", ("running", kind), [x])[0]

    def hold(self, x: Ref) -> Ref:
        """Last present value up to and including the current row."""
        if not self.layout.cut:
            return self.window("hold", lambda c, l: F.last(c, ignorenulls=True).over(l.running()), x, 0)
        forget = self.row("forget", lambda v: F.when(v.isNotNull(), 0.0), x)
        return self._scan("hold", ("hold",), [forget, x])[0]

    def only_where(self, x: Ref, present: Ref) -> Ref:
        return self.row("only", lambda v, p: F.when(p.isNotNull(), v), x, present)

    # --- recurrences ---------------------------------------------------------------------------

    def ewm(self, x: Ref, alpha: float, warmup: int) -> Ref:
        """Exponential average seeded by the first value; NULL until ``warmup`` values were seen."""
        return self._scan(f"ewm{alpha!r}:{warmup}", ("ewm", alpha, warmup), [x])[0]

    def ema(self, x: Ref, span: int) -> Ref:
        return self.ewm(x, 2.0 / (span + 1), span)

    def wilder(self, x: Ref, period: int) -> Ref:
        return self.ewm(x, 1.0 / period, period)

    def affine(self, step: Ref, offset: Ref) -> Ref:
        """``y = step * y_prev + offset``; rows missing either keep the state and yield NULL."""
        return self._scan("affine", ("affine",), [step, offset])[0]

    def stateful(self, label: str, kernel: Callable, inputs: Sequence[Ref], outputs: int, state_size: int) -> list[Ref]:
        """A non-linear recurrence (see ``stateful_udf``)."""
        return self._scan(label, ("stateful", kernel, outputs, state_size), list(inputs))

    def _scan(self, label: str, spec: tuple, inputs: list[Ref]) -> list[Ref]:
        name = f"{label}[{','.join(r.key for r in inputs)}]"
        outputs = spec[2] if spec[0] == "stateful" else 1
        keys = [f"{name}#{i}" for i in range(outputs)]
        if keys[0] not in self._refs:
            depth = max(r.stage[0] for r in inputs) + 1
            names = [self._new_name() for _ in keys]
            self._scans.setdefault(depth, []).append((spec, [r.col for r in inputs], names))
            for key, column in zip(keys, names):
                self._add(key, column, (depth, 0), max(r.back for r in inputs))
        return [self._refs[key] for key in keys]

    # --- output --------------------------------------------------------------------------------

    def output(self, name: str, ref: Ref) -> None:
        self._named[name] = ref

    def build(self, keep_layout: bool = False) -> DataFrame:
        """The input table plus every named output."""
        base = self.df.columns
        df = spread(self.df, self.layout, self._halo)
        depth = max([0, *(s[0] for s in self._windows), *self._scans])
        if self._scans and not self.layout.cut:
            df = self._marked(df)
        for level in range(depth + 1):
            if level in self._scans:
                df = self._run_scans(df, self._scans[level])
            rounds = sorted(stage[1] for stage in self._windows if stage[0] == level)
            for number in rounds:
                df = df.withColumns(dict(self._windows[(level, number)]))
        outputs = [finite(ref.col).alias(name) if not name.startswith("_") else ref.col.alias(name) for name, ref in self._named.items()]
        extra = [lay.BLOCK, lay.CELL, lay.OWN, lay.START] if self.layout.cut else []
        df = df.select(*base, *outputs, *extra)
        return df if keep_layout else gather(df, self.layout)

    # --- internals -----------------------------------------------------------------------------

    def _new_name(self) -> str:
        self._count += 1
        return f"_v{self._count}"

    def _add(self, key: str, column: str, stage: tuple[int, int], back: int) -> None:
        self._refs[key] = Ref(self, key, F.col(column), stage, back)
        self._halo = max(self._halo, back)

    def _marked(self, df: DataFrame) -> DataFrame:
        """Flag unit starts; the window behind the flag sorts the partitions for an Arrow pass.

        Uncut tables are flagged once: an Arrow pass keeps rows where they are, and every later window
        sorts again. Cut tables lose their order in the carry joins, so they are flagged each time.
        """
        layout = self.layout
        if not layout.cut and "_start" in df.columns:
            return df
        unit = Window.partitionBy(*layout.partition).orderBy(layout.order)
        if layout.cut:
            flag = F.coalesce(F.lag(lay.CELL).over(unit) != F.col(lay.CELL), F.lit(True))
        else:
            flag = F.row_number().over(unit) == 1
        return df.withColumn("_start", flag)

    def _run_scans(self, df: DataFrame, scans: list[tuple]) -> DataFrame:
        base = df.columns

        def of(*kinds):
            return [scan for scan in scans if scan[0][0] in kinds]

        kept: dict[str, Column] = {}
        if of("ewm", "affine", "hold"):
            df = self._linear(df, of("ewm", "affine", "hold"), kept)
        for spec, inputs, names in of("running"):
            df = self._running_cut(df, spec[1], inputs[0], names[0], kept)
        for spec, inputs, names in of("stateful"):
            df = self._stateful(df, spec, inputs, names, kept)
        df = df.select(*(c for c in base if c in df.columns), *(column.alias(name) for name, column in kept.items()))
        for spec, inputs, names in of("quantile"):
            df = self._quantile(df, spec, inputs[0], names[0])
        return df

    def _linear(self, df: DataFrame, linear: list[tuple], kept: dict[str, Column]) -> DataFrame:
        token = self._new_name()
        arguments = [column for _, inputs, _ in linear for column in inputs]
        if not self.layout.cut:
            kinds = [spec[1:] if spec[0] == "ewm" else None for spec, _, _ in linear]
            df = self._marked(df).withColumn(token, recurrence_udf(kinds)(F.col("_start"), *arguments))
            for i, (_, _, names) in enumerate(linear):
                kept[names[0]] = F.col(f"{token}.y{i}")
            return df
        seeds = {f"_seed{i}": inputs[0] for i, (spec, inputs, _) in enumerate(linear) if spec[0] == "ewm"}
        kinds = [spec[1] if spec[0] == "ewm" else None for spec, _, _ in linear]
        df = self._marked(df).withColumn(token, affine_udf(kinds)(F.col("_start"), *arguments))
        df = self._enter_cells(df, token, linear, seeds)
        for i, (spec, inputs, names) in enumerate(linear):
            step, offset, seen = (F.col(f"{token}.{x}{i}") for x in "abn")
            entry = F.coalesce(F.col(f"{token}_entry{i}"), F.lit(0.0))
            seen = seen + F.coalesce(F.col(f"{token}_before{i}"), F.lit(0))
            present = inputs[0].isNotNull() if spec[0] == "ewm" else (inputs[0].isNotNull() & inputs[1].isNotNull())
            shown = {"ewm": lambda: present & (seen >= spec[2]), "affine": lambda: present, "hold": lambda: seen > 0}[spec[0]]()
            kept[names[0]] = F.when(shown, step * entry + offset)
        return df

    def _enter_cells(self, df: DataFrame, token: str, linear: list[tuple], seeds: dict[str, Column]) -> DataFrame:
        """Join each cell with the state at its entry: one row per cell, composed along the key."""
        layout = self.layout
        last = F.max_by(F.col(token), F.col(layout.order)).alias("last")
        firsts = [
            F.min_by(column, F.when(column.isNotNull(), F.col(layout.order))).alias(f"first{name}") for name, column in seeds.items()
        ]
        cells = df.filter(lay.OWN).groupBy(*layout.keys, lay.CELL).agg(last, *firsts)
        by_cell = Window.partitionBy(*layout.keys).orderBy(lay.CELL)
        before = by_cell.rowsBetween(Window.unboundedPreceding, -1)
        steps, offsets = [], []
        columns = {"_start": F.row_number().over(by_cell) == 1}
        for i, (spec, _, _) in enumerate(linear):
            columns[f"before{i}"] = F.coalesce(F.sum(F.col(f"last.n{i}")).over(before), F.lit(0))
        cells = cells.withColumns(columns)
        for i, (spec, _, _) in enumerate(linear):
            a, b, n = (F.col(f"last.{x}{i}") for x in "abn")
            seeding = (F.col(f"before{i}") == 0) & (n > 0)
            if spec[0] == "ewm":
                a, b = F.when(seeding, 0.0).otherwise(a), F.when(seeding, a * F.col(f"first_seed{i}") + b).otherwise(b)
            steps.append(a)
            offsets.append(b)
        arguments = [c for pair in zip(steps, offsets) for c in pair]
        cells = cells.sortWithinPartitions(*layout.keys, lay.CELL)
        cells = cells.withColumn("exit", affine_udf([None] * len(linear))(F.col("_start"), *arguments))
        entries = [*layout.keys, lay.CELL]
        for i, (spec, _, _) in enumerate(linear):
            entry = F.lag(F.col(f"exit.b{i}")).over(by_cell)
            if spec[0] == "ewm":
                entry = F.when(F.col(f"before{i}") == 0, F.col(f"first_seed{i}")).otherwise(entry)
            entries += [entry.alias(f"{token}_entry{i}"), F.col(f"before{i}").alias(f"{token}_before{i}")]
        return df.join(cells.select(*entries), [*layout.keys, lay.CELL], "left")

    def _running_cut(self, df, kind: str, x: Column, name: str, kept: dict[str, Column]) -> DataFrame:
        layout = self.layout
        agg = {"sum": F.sum, "max": F.max, "product": F.product, "count": F.count}[kind]
        merge = {"sum": F.sum, "max": F.max, "product": F.product, "count": F.sum}[kind]
        token = self._new_name()
        df = df.withColumn(token, agg(x).over(layout.running()))
        before = Window.partitionBy(*layout.keys).orderBy(lay.CELL).rowsBetween(Window.unboundedPreceding, -1)
        cells = (
            df.filter(lay.OWN)
            .groupBy(*layout.keys, lay.CELL)
            .agg(agg(x).alias("total"))
            .select(*layout.keys, lay.CELL, merge("total").over(before).alias(f"{token}_before"))
        )
        df = df.join(cells, [*layout.keys, lay.CELL], "left")
        inner, outer = F.col(token), F.col(f"{token}_before")
        both = {"sum": inner + outer, "count": inner + outer, "product": inner * outer, "max": F.greatest(inner, outer)}[kind]
        kept[name] = F.when(inner.isNull(), outer).when(outer.isNull(), inner).otherwise(both)
        return df

    def _quantile(self, df: DataFrame, spec: tuple, x: Column, name: str) -> DataFrame:
        _, probability, sample = spec
        token = self._new_name()
        measured = df.withColumn(token, x)
        owned = measured.filter(lay.OWN) if self.layout.cut else measured
        limits = key_quantiles(owned, sample, token, {name: probability}, bool(sample) and not self.layout.cut)
        # A join may reorder rows, so a later Arrow pass must find its unit starts again.
        df = df.drop("_start")
        # One row per series, left for Spark to size; or exactly one row.
        return df.join(limits, list(sample), "left") if sample else df.join(F.broadcast(limits))

    def _stateful(self, df: DataFrame, spec: tuple, inputs: list[Column], names: list[str], kept) -> DataFrame:
        _, kernel, outputs, size = spec
        udf = stateful_udf(kernel, len(inputs), [f"y{i}" for i in range(outputs)], size)
        token = self._new_name()
        if not self.layout.cut:
            cold = [F.lit(None).cast("double")] * size
            df = self._marked(df).withColumn(token, udf(F.col("_start"), *cold, *inputs))
        else:
            df = self._settle_blocks(df, udf, token, inputs, size)
        for i, name in enumerate(names):
            kept[name] = finite(F.col(f"{token}.y{i}"))
        return df

    def _settle_blocks(self, df: DataFrame, udf, token: str, inputs: list[Column], size: int) -> DataFrame:
        """Non-linear recurrences over blocks: run every block, then rerun until entries agree.

        The first run enters each block cold at its halo. Every cell then has an exit state, which is
        the entry of the next cell; the runs repeat with those entries (at the halo cells and the first
        owned cell of a block) until no block enters differently, so the result is the sequential one.
        These recurrences forget their entry quickly, so two or three runs are the usual case; the bound
        is the number of blocks of the longest key.
        """
        from barloom.session import cut_lineage

        layout, cell = self.layout, (*self.layout.keys, lay.CELL)
        unit = Window.partitionBy(*layout.partition).orderBy(layout.order)
        states = [f"_e{i}" for i in range(size)]
        cold = {name: F.lit(None).cast("double") for name in states}
        df = cut_lineage(df)
        new_cell = F.coalesce(F.lag(lay.CELL).over(unit) != F.col(lay.CELL), F.lit(True))
        first_owned = F.col(lay.OWN) & ~F.coalesce(F.lag(lay.OWN).over(unit), F.lit(False))
        run = df.withColumn("_start", F.row_number().over(unit) == 1).withColumn("_first", first_owned).withColumns(cold)
        entries = None
        while True:
            settled = cut_lineage(run.withColumn(token, udf(F.col("_start"), *(F.col(n) for n in states), *inputs)))
            exits = settled.filter(lay.OWN).groupBy(*cell).agg(F.max_by(token, layout.order).alias("exit"))
            previous = F.lag("exit").over(Window.partitionBy(*layout.keys).orderBy(lay.CELL))
            fresh = exits.select(*cell, previous.alias("was")).select(
                *cell, *(F.col(f"was.state{i}").alias(n) for i, n in enumerate(states))
            )
            fresh = cut_lineage(fresh)
            if entries is not None:
                used = settled.filter("_first").select(*cell, *(F.col(n).alias(f"{n}_was") for n in states))
                moved = F.lit(False)
                for n in states:
                    moved = moved | ~F.col(n).eqNullSafe(F.col(f"{n}_was"))
                if fresh.join(used, list(cell)).filter(moved).limit(1).count() == 0:
                    return settled.drop("_first", "_start", *states)
            entries = fresh
            enter = new_cell & (~F.col(lay.OWN) | first_owned)
            run = df.join(entries, list(cell), "left").withColumn("_start", enter).withColumn("_first", first_owned)


def _present(columns) -> Column:
    present = columns[0].isNotNull()
    for column in columns[1:]:
        present = present & column.isNotNull()
    return present
