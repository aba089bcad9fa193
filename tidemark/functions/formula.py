"""The formula language: a safe expression over a table's columns, compiled to a Spark column.

``[Price] * 2``, ``SI([a] > 3, [b], 0)``, ``[v] / [v].sum()``. Nothing is evaluated in Python: the syntax tree becomes a
Catalyst expression, so formulas are pushed down, pruned and compiled like any other.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import most_frequent, quantiles, running_sums, shifted, with_key


class FormulaError(ValueError):
    """The formula uses something that the language doesn't have."""



def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _floor_div(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a.cast("double"), b.cast("double"))).cast("double")


BINARY: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),  # null where the divisor is 0
    ast.FloorDiv: _floor_div,
    ast.Mod: lambda a, b: a - b * _floor_div(a, b),  # the divisor's sign
    ast.Pow: lambda a, b: F.pow(a.cast("double"), b.cast("double")),
}
COMPARE: dict[type, Callable[[Column, Column], Column]] = {
    ast.Lt: lambda a, b: _sure(a < b),
    ast.LtE: lambda a, b: _sure(a <= b),
    ast.Gt: lambda a, b: _sure(a > b),
    ast.GtE: lambda a, b: _sure(a >= b),
    ast.Eq: lambda a, b: _sure(a == b),
    ast.NotEq: lambda a, b: ~_sure(a == b),
}
#: Methods that reduce a column to one value for all rows.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp,
    "count": F.count, "nunique": F.count_distinct, "mode": lambda c: F.mode(c, True),
}
#: Of these and ``quantile``, values are selected by counts, as no aggregate may hold a whole column.
SELECTED = ("median", "mode", "quantile")
CASTS = {"int": "bigint", "float": "double", "str": "string", "bool": "boolean"}
#: Methods whose results are collections; ``dropna`` may stand before what reduces it to one value.
SEVERAL = ("unique", "value_counts", "tolist", "dropna")
#: Methods that follow the order of rows.
ORDERED = ("cumsum", "cumprod", "diff", "pct_change", "shift", "rank")


def _all_known(cs: list[Column], value: Column) -> Column:
    return F.when(reduce(lambda a, b: a | b, [c.isNull() for c in cs]), None).otherwise(value)


def _fold(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cs)


FUNCTIONS: dict[str, Callable[[list[Column]], Column]] = {
    "SI": lambda a: F.when(_sure(a[0]), a[1]).otherwise(a[2]),
    "SUMA": _fold,
    "PROMEDIO": lambda a: _fold(a) / len(a),
    "MINIMO": lambda a: a[0] if len(a) == 1 else _all_known(a, F.least(*a)),
    "MAXIMO": lambda a: a[0] if len(a) == 1 else _all_known(a, F.greatest(*a)),
    "ABS": lambda a: F.abs(a[0]),
}


def to_source(formula: str) -> str:
    """``[Name]`` to ``df['Name']``, and the signs × ÷ ^ to their operators."""
    for sign, op in (("×", "*"), ("÷", "/"), ("^", "**")):
        formula = formula.replace(sign, op)
    return re.sub(r"(?<![\w\])])\[([^\[\]'\"]+)\]", lambda m: f"df[{m[1]!r}]", formula)


def to_friendly(source: str) -> str:
    return re.sub(r"df\[\s*(['\"])(.+?)\1\s*\]", r"[\2]", source)


def columns_of(formula: str) -> list[str]:
    """The columns that a formula names, in order of appearance."""
    found = [n.slice.value for n in ast.walk(ast.parse(to_source(formula), mode="eval")) if isinstance(n, ast.Subscript) and isinstance(n.value, ast.Name) and isinstance(n.slice, ast.Constant) and isinstance(n.slice.value, str)]
    return list(dict.fromkeys(found))


@dataclass
class Compiled:
    """``value`` may use ``scalars``, whole-table aggregates, and ``steps``, (name, method, column, places) of methods that
    follow the order of rows, by the names under which the value refers to them. A step may use those before it."""

    value: Column
    scalars: dict[str, Column] = field(default_factory=dict)
    steps: list[tuple[str, str, Column, int]] = field(default_factory=list)
    #: Of ``scalars``, those that are selected and not aggregated: a column's quantile at a share, or its mode (None).
    selected: dict[str, tuple[Column, float | None]] = field(default_factory=dict)


def _scalars(df: DataFrame, made: Compiled) -> DataFrame:
    """One row with all scalars: one aggregation, one selection of all quantiles, and the counts of each mode."""
    plain = {k: c for k, c in made.scalars.items() if k not in made.selected}
    out = df.agg(F.count(F.lit(1)).alias("_rows"), *[c.alias(k) for k, c in plain.items()])
    shares = sorted({s for _, s in made.selected.values() if s is not None})
    if shares:
        picked = {k: v for k, v in made.selected.items() if v[1] is not None}
        q = quantiles(df, {k: c for k, (c, _) in picked.items()}, shares)
        out = out.join(F.broadcast(q.agg(*[F.max(F.when(F.col("column") == k, F.get("q", F.lit(shares.index(s))))).alias(k) for k, (_, s) in picked.items()])))
    for k, (c, s) in made.selected.items():
        if s is None:
            out = out.join(F.broadcast(most_frequent(df, c).withColumnRenamed("mode", k)))
    return out.drop("_rows")


class _Compiler:
    def __init__(self, columns: list[str], order: list[str]):
        self.columns, self.order, self.scalars, self.steps, self.selected = columns, order, {}, [], {}

    def visit(self, node: ast.AST):
        method = getattr(self, f"on_{type(node).__name__.lower()}", None)
        if method is None:
            raise FormulaError(f"not allowed: {type(node).__name__}")
        return method(node)

    def on_expression(self, node):
        return self.visit(node.body)

    def on_constant(self, node):
        if not isinstance(node.value, int | float | bool | str | None):
            raise FormulaError(f"not allowed: {node.value!r}")
        return F.lit(node.value)

    def on_binop(self, node):
        if type(node.op) not in BINARY:
            raise FormulaError(f"not allowed: {type(node.op).__name__}")
        return BINARY[type(node.op)](self.visit(node.left), self.visit(node.right))

    def on_unaryop(self, node):
        if isinstance(node.op, ast.USub):
            return -self.visit(node.operand)
        if isinstance(node.op, ast.UAdd):
            return self.visit(node.operand)
        if isinstance(node.op, ast.Not | ast.Invert):
            return ~_sure(self.visit(node.operand))
        raise FormulaError("not allowed: unary operator")

    def on_boolop(self, node):
        parts = [_sure(self.visit(v)) for v in node.values]
        return reduce((lambda a, b: a & b) if isinstance(node.op, ast.And) else (lambda a, b: a | b), parts)

    def on_compare(self, node):
        if any(type(o) not in COMPARE for o in node.ops):
            raise FormulaError("not allowed: comparison")
        sides = [self.visit(x) for x in (node.left, *node.comparators)]
        return reduce(lambda a, b: a & b, [COMPARE[type(o)](a, b) for o, a, b in zip(node.ops, sides, sides[1:], strict=False)])

    def on_subscript(self, node):
        if isinstance(node.value, ast.Name) and node.value.id == "df" and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
            if node.slice.value not in self.columns:
                raise FormulaError(f"no such column: {node.slice.value}")
            return F.col("`" + node.slice.value.replace("`", "``") + "`")
        # A column under a condition, as in df['a'][df['b'] > 0]: the cells where it holds.
        return F.when(_sure(self.visit(node.slice)), self.visit(node.value))

    def on_name(self, node):
        raise FormulaError(f"unknown name: {node.id}")

    def on_call(self, node):
        args = node.args
        if node.keywords and any(k.arg is None for k in node.keywords):
            raise FormulaError("not allowed: **")
        if isinstance(node.func, ast.Name):
            return self.function(node.func.id, args)
        if isinstance(node.func, ast.Attribute) and not node.func.attr.startswith("_"):
            name, of = node.func.attr, node.func.value
            if name in SEVERAL:
                raise FormulaError(f".{name}() gives several values, so it's neither a column nor one value")
            # What reduces a column passes over missing cells anyway.
            if name in AGGREGATES and isinstance(of, ast.Call) and isinstance(of.func, ast.Attribute) and of.func.attr == "dropna":
                of = of.func.value
            return self.method(name, self.visit(of), args, {k.arg: k.value for k in node.keywords})
        raise FormulaError("not allowed: call")

    def function(self, name: str, args):
        if name == "REDONDEAR":
            return F.bround(self.visit(args[0]), self.whole(args[1]) if len(args) > 1 else 0)
        if name not in FUNCTIONS:
            raise FormulaError(f"unknown function: {name}")
        return FUNCTIONS[name]([self.visit(a) for a in args])

    def whole(self, node) -> int:
        try:
            return int(ast.literal_eval(node))
        except (ValueError, TypeError) as e:
            raise FormulaError("a whole number is needed") from e

    def method(self, name: str, c: Column, args, named):
        if name in AGGREGATES or name == "quantile":
            at = f"_scalar{len(self.scalars)}"
            self.scalars[at] = F.col(at) if name in SELECTED else AGGREGATES[name](c)
            if name in SELECTED:
                self.selected[at] = (c, None if name == "mode" else self.number(args[0]) if name == "quantile" and args else 0.5)
            return F.col(at)
        if name in ("isna", "isnull"):
            return c.isNull()
        if name in ("notna", "notnull"):
            return c.isNotNull()
        if name == "fillna":
            return F.coalesce(c, self.visit(args[0]))
        if name == "abs":
            return F.abs(c)
        if name == "round":
            return F.bround(c, self.whole(args[0]) if args else 0)
        if name == "clip":
            low, high = ([*args, None, None])[:2]
            low, high = named.get("lower", low), named.get("upper", high)
            c = F.when(c < self.visit(low), self.visit(low)).otherwise(c) if low is not None else c
            return F.when(c > self.visit(high), self.visit(high)).otherwise(c) if high is not None else c
        if name == "astype":
            kind = args[0].id if isinstance(args[0], ast.Name) else getattr(args[0], "value", None)
            if kind not in CASTS:
                raise FormulaError(f"not allowed: astype({kind})")
            return c.try_cast(CASTS[kind])
        if name in ORDERED:
            return self.ordered(name, c, args)
        raise FormulaError(f"not allowed: .{name}()")

    def number(self, node) -> float:
        return float(ast.literal_eval(node))

    def ordered(self, name: str, c: Column, args):
        if not self.order:
            raise FormulaError(f".{name}() needs an order of rows")
        n = self.whole(args[0]) if args and name in ("shift", "diff", "pct_change") else 1
        at = f"_ordered{len(self.steps)}"
        self.steps.append((at, name, c, n))
        made = F.col(at)
        # The change is against the last row's own cell: nulls aren't carried forward.
        return {"diff": c - made, "pct_change": F.try_divide(c, made) - 1}.get(name, made)


def _stepped(df: DataFrame, order: list[str], at: str, name: str, c: Column, n: int) -> DataFrame:
    """Adds column ``at`` of one ordered method, by ranges of the order and never in a single task."""
    known = lambda v: F.when(c.isNotNull(), v)
    if name == "rank":
        rows = df.withColumn("_of", c)
        counts = with_key(rows.where("_of is not null").groupBy("_of").agg(F.count(F.lit(1)).alias("_n")), "_key", "_of")
        upto = running_sums(counts, "_key", {"_upto": F.col("_n")}, ["_of"])
        return rows.join(upto.select("_of", (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(at)), "_of", "left").drop("_of")
    rows = with_key(df, "_key", order[0])
    if name == "cumsum":
        out = running_sums(rows, "_key", {at: c}, order).withColumn(at, known(F.col(at)))
    elif name == "cumprod":
        sums = {"_negative": (c < 0).cast("int"), "_zero": (c == 0).cast("int"), "_log": F.when(c != 0, F.ln(F.abs(c)))}
        product = F.pow(F.lit(-1.0), F.col("_negative")) * F.exp("_log")
        out = running_sums(rows, "_key", {k: F.coalesce(v, F.lit(0)) for k, v in sums.items()}, order)
        out = out.withColumn(at, known(F.when(F.col("_zero") > 0, 0.0).otherwise(product))).drop(*sums)
    else:
        out = shifted(rows, "_key", c, at, n, order)
    return out.drop("_key")


def compile_formula(formula: str, columns: list[str], order: list[str] | None = None) -> Compiled:
    try:
        tree = ast.parse(to_source(formula).strip(), mode="eval")
    except SyntaxError as e:
        raise FormulaError(f"can't be read: {formula}") from e
    compiler = _Compiler(columns, order or [])
    return Compiled(compiler.visit(tree), compiler.scalars, compiler.steps, compiler.selected)


def calculated_column(df: DataFrame, name: str, formula: str, order: list[str] | None = None) -> DataFrame:
    """``df`` with the formula's column. All whole-table aggregates in it come from one aggregation, joined as one row."""
    made = compile_formula(formula, df.columns, order)
    if made.scalars:
        df = df.join(F.broadcast(_scalars(df, made)))  # one row
    for step in made.steps:
        df = _stepped(df, order, *step)
    return df.withColumn(name, made.value).drop(*made.scalars, *[s[0] for s in made.steps])


def calculated_value(df: DataFrame, formula: str) -> DataFrame:
    """One row, ``value``: a formula that reduces to one value, as in indicators."""
    made = compile_formula(formula, df.columns)
    if not made.scalars:
        raise FormulaError("the formula gives a value for each row, not one")
    return _scalars(df, made).select(made.value.alias("value"))
