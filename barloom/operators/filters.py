"""Compound filters: a tree of conditions compiled to one boolean column.

A tree is plain data. A condition is ``{"type": "condition", "field", "op", "value", "value2", "rhs",
"text", "enabled"}``; a group is ``{"type": "group", "mode": "and" | "or", "negate", "enabled",
"children"}``. A missing value never satisfies a condition, so every leaf is false rather than NULL;
negating a group turns those rows into matches.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field as dataclass_field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import indicators
from barloom.operators.layout import Layout
from barloom.operators.series import Ref, Series

EPSILON = 1e-12
MAX_DEPTH = 8
MAX_COUNT = 100_000


@dataclass(frozen=True)
class Operator:
    label: str
    operand: str
    text: bool = False
    ordered: bool = False
    lookahead: bool = False


OPERATORS: dict[str, Operator] = {
    "gt": Operator("over", "value"),
    "gte": Operator("at least", "value"),
    "lt": Operator("under", "value"),
    "lte": Operator("at most", "value"),
    "eq": Operator("same as", "value"),
    "neq": Operator("other than", "value"),
    "between": Operator("within limits", "range"),
    "outside": Operator("beyond limits", "range"),
    "crosses_above": Operator("turns over", "value", ordered=True),
    "crosses_below": Operator("turns under", "value", ordered=True),
    "rising": Operator("N rises in a row", "count", ordered=True),
    "falling": Operator("N falls in a row", "count", ordered=True),
    "new_high": Operator("tops the N bars before", "count", ordered=True),
    "new_low": Operator("undercuts the N bars before", "count", ordered=True),
    "top_pct": Operator("among the largest X percent", "percent", lookahead=True),
    "bottom_pct": Operator("among the smallest X percent", "percent", lookahead=True),
    "is_valid": Operator("present", "none"),
    "is_missing": Operator("absent", "none"),
    "in": Operator("any of the words", "text", text=True),
    "not_in": Operator("not one of the words", "text", text=True),
    "contains": Operator("holds the text", "text", text=True),
    "starts_with": Operator("opens with the text", "text", text=True),
}


def operators_for(kind: str, ordered: bool) -> list[str]:
    """Operator names that apply to a numeric or text field."""
    if kind == "text":
        return [name for name, op in OPERATORS.items() if op.text]
    return [name for name, op in OPERATORS.items() if not op.text and (ordered or not op.ordered)]


# --- trees -------------------------------------------------------------------------------------


def condition(field: str, op: str, value: float = 0.0, value2: float = 0.0, rhs: str | None = None, text: str = "", enabled: bool = True) -> dict:
    return {"type": "condition", "field": field, "op": op, "value": value, "value2": value2, "rhs": rhs, "text": text, "enabled": enabled}


def group(mode: str, *children: dict, negate: bool = False, enabled: bool = True) -> dict:
    return {"type": "group", "mode": mode, "negate": negate, "enabled": enabled, "children": list(children)}


def all_of(*children: dict, **options) -> dict:
    return group("and", *children, **options)


def any_of(*children: dict, **options) -> dict:
    return group("or", *children, **options)


def _leaves(node: Mapping) -> list[Mapping]:
    if node["type"] == "group":
        return [leaf for child in node["children"] for leaf in _leaves(child)]
    return [node]


def count_active(node: Mapping) -> int:
    """Enabled conditions that name a field."""
    return sum(1 for leaf in _leaves(node) if leaf["enabled"] and leaf["field"])


def uses_lookahead(node: Mapping) -> bool:
    """True when an enabled condition compares with the whole sample."""
    return any(leaf["enabled"] and leaf["field"] and OPERATORS[leaf["op"]].lookahead for leaf in _leaves(node))


def _number(raw, fallback: float) -> float:
    usable = isinstance(raw, (int, float)) and not isinstance(raw, bool) and math.isfinite(raw)
    return float(raw) if usable else fallback


def normalize_tree(raw) -> tuple[dict, int]:
    """Rebuild a tree from untrusted data; returns it with the number of nodes that were dropped."""
    dropped = 0

    def read(node, depth):
        nonlocal dropped
        if isinstance(node, Mapping) and depth <= MAX_DEPTH:
            enabled = node.get("enabled") is not False
            if node.get("type") == "group":
                children = node.get("children") if isinstance(node.get("children"), list) else []
                kept = [child for child in (read(c, depth + 1) for c in children) if child is not None]
                return group("or" if node.get("mode") == "or" else "and", *kept, negate=node.get("negate") is True, enabled=enabled)
            if node.get("type") == "condition" and isinstance(node.get("op"), str) and node["op"] in OPERATORS and isinstance(node.get("field"), str):
                rhs, text = node.get("rhs"), node.get("text")
                return condition(
                    node["field"], node["op"], _number(node.get("value"), 0.0), _number(node.get("value2"), 0.0),
                    rhs if isinstance(rhs, str) and rhs else None, text if isinstance(text, str) else "", enabled,
                )
        dropped += 1
        return None

    root = read(raw, 0)
    if root is not None and root["type"] == "group":
        return root, dropped
    return all_of(), dropped + (1 if root is not None else 0)


def _plain(value: float) -> str:
    return str(int(value)) if float(value).is_integer() else f"{value:.6g}"


def describe(node: Mapping, label=lambda field: field) -> str:
    """Readable text of a tree."""
    if node["type"] == "condition":
        spec, name = OPERATORS[node["op"]], label(node["field"])
        value = _plain(node["value"])
        tail = {
            "none": lambda: spec.label,
            "range": lambda: f"{spec.label} {_plain(min(node['value'], node['value2']))} and {_plain(max(node['value'], node['value2']))}",
            "count": lambda: spec.label.replace("N", value, 1),
            "percent": lambda: spec.label.replace("X", value, 1),
            "text": lambda: f'{spec.label} "{node["text"]}"',
            "value": lambda: f"{spec.label} {label(node['rhs']) if node['rhs'] else value}",
        }[spec.operand]()
        return f"{name} {tail}"
    parts = [
        text
        for child in node["children"]
        if child["enabled"] and (child["type"] == "group" or child["field"])
        for text in [describe(child, label)]
        if text
    ]
    if not parts:
        return ""
    joined = parts[0] if len(parts) == 1 else (" AND " if node["mode"] == "and" else " OR ").join(f"({p})" for p in parts)
    return f"NOT ({joined})" if node["negate"] else joined


# --- compilation -------------------------------------------------------------------------------


class BarFields:
    """Fields of an ordered bars table: its columns and any canonical series key."""

    ordered = True

    def __init__(self, series: Series):
        self.s = series

    def numeric(self, name: str) -> Ref | None:
        return indicators.field(self.s, name)

    def text(self, name: str) -> Ref | None:
        kinds = dict(self.s.df.dtypes)
        return self.s.column(name) if kinds.get(name) == "string" else None

    @property
    def sample(self) -> tuple[str, ...]:
        return self.s.layout.keys


class TableFields:
    """Fields of an unordered result table; conditions along a series do not apply."""

    ordered = False
    sample: tuple[str, ...] = ()
    NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")

    def __init__(self, df: DataFrame):
        self.s = Series(df, Layout())
        self.kinds = dict(df.dtypes)

    def numeric(self, name: str) -> Ref | None:
        return self.s.row("number", lambda c: c.cast("double"), self.s.column(name)) if self.kinds.get(name) in self.NUMERIC else None

    def text(self, name: str) -> Ref | None:
        return self.s.column(name) if self.kinds.get(name) == "string" else None


@dataclass
class Compiled:
    """``mask`` is None when no condition is active (everything passes)."""

    mask: Ref | None
    issues: list[str] = dataclass_field(default_factory=list)


class _Issue(Exception):
    pass


def compile_filter(fields, tree: Mapping | None) -> Compiled:
    issues: list[str] = []
    s: Series = fields.s

    def node(item) -> Ref | None:
        if not item["enabled"]:
            return None
        if item["type"] == "condition":
            if not item["field"]:
                return None
            try:
                ref = _leaf(fields, item)
            except _Issue as problem:
                issues.append(str(problem))
                return s.row("never", lambda *_: F.lit(False))
            return None if ref is None else s.row("sure", lambda c: F.coalesce(c, F.lit(False)), ref)
        masks = [m for m in map(node, item["children"]) if m is not None]
        if not masks:
            return None
        join = (lambda *c: reduce(lambda a, b: a & b, c)) if item["mode"] == "and" else (lambda *c: reduce(lambda a, b: a | b, c))
        mask = s.row(item["mode"], join, *masks) if len(masks) > 1 else masks[0]
        return s.row("not", lambda c: ~c, mask) if item["negate"] else mask

    return Compiled(node(tree) if tree else None, issues)


def _leaf(fields, c: Mapping) -> Ref | None:
    s, op = fields.s, c["op"]
    spec = OPERATORS[op]
    if spec.ordered and not fields.ordered:
        raise _Issue(f'{op} compares bars in time order; these rows have none')
    if spec.text:
        column = fields.text(c["field"])
        if column is None:
            raise _Issue(f'no text column named {c["field"]}')
        return _text_leaf(s, op, column, c["text"]) if c["text"].strip() else None
    x = fields.numeric(c["field"])
    if x is None:
        raise _Issue(f'no number column named {c["field"]}')
    if spec.operand == "none":
        return s.row(op, lambda v: v.isNotNull() if op == "is_valid" else v.isNull(), x)
    if spec.operand == "range":
        if not (math.isfinite(c["value"]) and math.isfinite(c["value2"])):
            return None
        lo, hi = sorted((c["value"], c["value2"]))
        return s.row(op, lambda v, a, b: v.between(a, b) if op == "between" else (v < a) | (v > b), x, lo, hi)
    if spec.operand == "value":
        return _compare_leaf(fields, c, x)
    if spec.operand == "count":
        if not math.isfinite(c["value"]) or not 1 <= math.floor(c["value"]) <= MAX_COUNT:
            raise _Issue("the number of bars starts at 1")
        return _count_leaf(s, op, x, math.floor(c["value"]))
    if not math.isfinite(c["value"]) or not 0 < c["value"] <= 100:
        raise _Issue("a share lies over 0 and up to 100 percent")
    top = op == "top_pct"
    limit = s.threshold(x, 1 - c["value"] / 100 if top else c["value"] / 100, fields.sample)
    return x >= limit if top else x <= limit


def _text_leaf(s: Series, op: str, column: Ref, text: str) -> Ref:
    needle = text.strip().lower()
    items = [part.strip().lower() for part in text.split(",") if part.strip()]
    build = {
        "in": lambda v: v.isin(items),
        "not_in": lambda v: ~v.isin(items),
        "contains": lambda v: v.contains(needle),
        "starts_with": lambda v: v.startswith(needle),
    }[op]
    return s.row(f"{op}:{text}", lambda v: build(F.lower(F.coalesce(v, F.lit("")))), column)


def _compare_leaf(fields, c: Mapping, x: Ref) -> Ref | None:
    s, op = fields.s, c["op"]
    if c["rhs"]:
        y = fields.numeric(c["rhs"])
        if y is None:
            raise _Issue(f'no number column named {c["rhs"]}')
    elif math.isfinite(c["value"]):
        y = s.row("const", lambda a: a, float(c["value"]))
    else:
        return None
    if op.startswith("crosses"):
        px = s.lag(x)
        py = s.lag(y) if c["rhs"] else y
        return s.row(op, (lambda a, b, p, q: (p <= q) & (a > b)) if op.endswith("above") else (lambda a, b, p, q: (p >= q) & (a < b)), x, y, px, py)
    tolerance = lambda a, b: F.lit(EPSILON) * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    build = {
        "gt": lambda a, b: a > b,
        "gte": lambda a, b: a >= b,
        "lt": lambda a, b: a < b,
        "lte": lambda a, b: a <= b,
        "eq": lambda a, b: F.abs(a - b) <= tolerance(a, b),
        "neq": lambda a, b: F.abs(a - b) > tolerance(a, b),
    }[op]
    return s.row(op, build, x, y)


def _count_leaf(s: Series, op: str, x: Ref, n: int) -> Ref:
    if op in ("rising", "falling"):
        moved = s.row(op, lambda a, b: F.when((a > b) if op == "rising" else (a < b), 1.0), x, s.lag(x))
        run = s.window(f"run{n}", lambda c, l: F.count(c).over(l.rows(-(n - 1))) == n, moved, n - 1)
        return run
    high = op == "new_high"

    def build(c, l):
        w = l.rows(-n, -1)
        return F.when(F.count(c).over(w) == n, (F.max if high else F.min)(c).over(w))

    best = s.window(f"{op}{n}", build, x, n)
    return x > best if high else x < best


# --- use ---------------------------------------------------------------------------------------


def flagged(df: DataFrame, tree: Mapping | None, layout: Layout | None = None, name: str = "matches") -> DataFrame:
    """The bars with a boolean column of rows that pass."""
    s = Series(df, layout)
    compiled = compile_filter(BarFields(s), tree)
    s.output(f"_{name}", compiled.mask if compiled.mask is not None else s.row("always", lambda *_: F.lit(True)))
    return s.build().withColumnRenamed(f"_{name}", name)


def onset(s: Series, mask: Ref) -> Ref:
    """True on the first row of each run of matches."""
    return s.row("onset", lambda m, p: m & ~F.coalesce(p, F.lit(False)), mask, s.lag(mask))


def matches(df: DataFrame, tree: Mapping | None, onset_only: bool = False, layout: Layout | None = None) -> DataFrame:
    """Matching bars, oldest first within each series."""
    s = Series(df, layout)
    mask = compile_filter(BarFields(s), tree).mask
    if mask is None:
        return df.orderBy(*s.layout.keys, s.layout.order)
    s.output("_hit", onset(s, mask) if onset_only else mask)
    return s.build().filter("_hit").drop("_hit").orderBy(*s.layout.keys, s.layout.order)


def match_counts(df: DataFrame, tree: Mapping | None, layout: Layout | None = None) -> DataFrame:
    """Matched and total rows per series."""
    keys = (layout or Layout()).keys
    return flagged(df, tree, layout).groupBy(*keys).agg(F.count_if("matches").alias("matched"), F.count(F.lit(1)).alias("total"))


def filter_table(df: DataFrame, tree: Mapping | None) -> tuple[DataFrame, list[str]]:
    """Filter an unordered result table; returns the rows that pass and the problems found."""
    fields = TableFields(df)
    compiled = compile_filter(fields, tree)
    if compiled.mask is None:
        return df, compiled.issues
    fields.s.output("_hit", compiled.mask)
    return fields.s.build().filter("_hit").drop("_hit"), compiled.issues


def select_columns(df: DataFrame, tree: Mapping | None, visible: Iterable[str] = (), layout: Layout | None = None) -> DataFrame:
    """Keys, visible columns and the series a filter refers to."""
    keys = (layout or Layout()).keys + ((layout or Layout()).order,)
    named = [name for leaf in (_leaves(tree) if tree else []) if leaf["enabled"] for name in (leaf["field"], leaf["rhs"]) if name]
    wanted = list(dict.fromkeys([*visible, *named]))
    wide = indicators.add_series(df, [w for w in wanted if w not in df.columns], layout)
    return wide.select(*keys, *(F.col(f"`{name}`") for name in wanted if name not in keys))

