"""Syntax trees to Columns, with NULL instead of errors for what can't be computed.

Spark's ANSI mode is left as the session has it; try_ functions give NULL for overflow,
bad casts, bad dates and division by zero either way.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.registry import AGGREGATES, FUNCTIONS, literal_value
from .parser import Among, Binary, Block, Call, Cast, If, Lit, Ref, Unary, parse_expression


class ExprError(ValueError):
    """An expression that can't be bound to its input."""


_ARITHMETIC = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide, "%": F.try_mod}
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
_CASTS = {"string": "string", "varchar": "string", "int": "int", "integer": "int", "smallint": "smallint", "tinyint": "tinyint", "bigint": "bigint", "long": "bigint", "double": "double", "float": "float", "boolean": "boolean", "bool": "boolean", "date": "date", "timestamp": "timestamp", "datetime": "timestamp"}
_SPAN = re.compile(r"\s*-?\s*(\d+)\s*([smhd])\s*(?:to\s+current)?\s*$", re.I)
_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def kind_of_type(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.NumericType):
        return "number"
    return {T.DateType: "date", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp", T.BooleanType: "boolean", T.NullType: "null"}.get(type(t), "any")


def span_seconds(text: str) -> int:
    """Seconds of a range such as -24h to current."""
    m = _SPAN.match(text)
    if not m:
        raise ExprError(f"{text!r} isn't a range such as '-24h to current'")
    return int(m[1]) * _SECONDS[m[2].lower()]


class Lowering:
    """Binds expressions to the columns of a DataFrame.

    in. means the input, out. what was assigned before, a bare name the input or else
    what was assigned. clock: stands for the current time, for repeatable results.
    """

    def __init__(self, df: DataFrame | T.StructType, clock: datetime | None = None, defaults: dict[str, str] | None = None):
        schema = df if isinstance(df, T.StructType) else df.schema
        self.columns = {f.name: f.dataType for f in schema.fields}
        self.by_lower = {}
        for name in self.columns:
            self.by_lower.setdefault(name.lower(), name)
        self.out: dict[str, tuple[Column, str]] = {}
        self.clock, self.defaults = clock, defaults or {}
        self.passed_through: list[str] = []

    # -- references

    def _input(self, path: tuple[str, ...]) -> tuple[Column, str] | None:
        name = path[0] if path[0] in self.columns else self.by_lower.get(path[0].lower())
        if name is None:
            return None
        c, t = F.col(f"`{name}`"), self.columns[name]
        for part in path[1:]:
            if not isinstance(t, T.StructType) or part not in t.names:
                raise ExprError(f"{'.'.join(path)}: {name} has no field {part}")
            c, t = c[part], t[part].dataType
        return c, kind_of_type(t)

    def _ref(self, r: Ref) -> tuple[Column, str]:
        found = None
        if r.space != "out":
            found = self._input(r.path)
        if found is None and r.space != "in" and r.path[0] in self.out:
            c, k = self.out[r.path[0]]
            for part in r.path[1:]:
                c, k = c[part], "any"
            found = c, k
        if found is None:
            what = {"in": "the input has no column", "out": "nothing was assigned yet to", "": "no column or earlier assignment"}[r.space]
            raise ExprError(f"{what} {'.'.join(r.path)}")
        return found

    # -- expressions

    def column(self, e: Any) -> Column:
        return self.typed(e)[0]

    def typed(self, e: Any) -> tuple[Column, str]:
        """The Column, and whether it is a string, number, date, timestamp, boolean, null or any."""
        if isinstance(e, Lit):
            v = e.value
            kind = "null" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"
            return F.lit(v), kind
        if isinstance(e, Ref):
            return self._ref(e)
        if isinstance(e, Unary):
            c, k = self.typed(e.x)
            return (~c, "boolean") if e.op == "not" else (F.try_subtract(F.lit(0), c), k)
        if isinstance(e, Binary):
            return self._binary(e)
        if isinstance(e, If):
            made = F
            kinds = []
            for c, v in e.branches:
                value, k = self.typed(v)
                kinds.append(k)
                made = made.when(self.column(c), value)
            value, k = self.typed(e.other)
            return made.otherwise(value), next((x for x in [*kinds, k] if x != "null"), "null")
        if isinstance(e, Among):
            x = self.column(e.x)
            return x.isin(*[self.column(i) for i in e.items]), "boolean"
        if isinstance(e, Cast):
            return self._cast(e)
        if isinstance(e, Call):
            return self._call(e)
        raise ExprError(f"cannot lower {e!r}")

    def _binary(self, e: Binary) -> tuple[Column, str]:
        a, ka = self.typed(e.left)
        b, kb = self.typed(e.right)
        if e.op in ("and", "or"):
            return (a & b if e.op == "and" else a | b), "boolean"
        if e.op == "like":
            return F.like(a, b), "boolean"
        if e.op in _COMPARE:
            if {ka, kb} == {"string", "number"}:  # a string that is no number compares as NULL
                a, b = (a.try_cast("double"), b) if ka == "string" else (a, b.try_cast("double"))
            elif ka == kb == "timestamp" and self._zoneless(e.left) != self._zoneless(e.right):
                # The column stays as it is stored, so that the comparison reaches the scan.
                a, b = (a, b.cast("timestamp_ntz")) if self._zoneless(e.left) else (a.cast("timestamp_ntz"), b)
            return _COMPARE[e.op](a, b), "boolean"
        if e.op == "+" and "string" in (ka, kb):
            return F.concat(a.cast("string"), b.cast("string")), "string"
        if ka in ("date", "timestamp") and kb == "number" and e.op in "+-":
            return (F.date_add if e.op == "+" else F.date_sub)(a, b.cast("int")), "date"
        if "string" in (ka, kb):
            a, b = (x.try_cast("double") if k == "string" else x for x, k in ((a, ka), (b, kb)))
        return _ARITHMETIC[e.op](a, b), "number"

    def _zoneless(self, e: Any) -> bool:
        if not isinstance(e, Ref) or e.space == "out" or len(e.path) > 1:
            return False
        name = e.path[0] if e.path[0] in self.columns else self.by_lower.get(e.path[0].lower(), "")
        return isinstance(self.columns.get(name), T.TimestampNTZType)

    def _cast(self, e: Cast) -> tuple[Column, str]:
        c = self.column(e.x)
        if e.type in ("decimal", "numeric"):
            p, s = (*e.args, 38, 0)[:2] if len(e.args) != 1 else (e.args[0], 0)
            if not 0 <= s <= p <= 38:
                raise ExprError(f"decimal({p},{s}) isn't a type")
            return c.try_cast(f"decimal({p},{s})"), "number"
        if e.type not in _CASTS:
            raise ExprError(f"no type {e.type}")
        t = _CASTS[e.type]
        return (c.cast(t) if t == "string" else c.try_cast(t)), {"string": "string", "date": "date", "timestamp": "timestamp", "boolean": "boolean"}.get(t, "number")

    def _call(self, e: Call) -> tuple[Column, str]:
        if e.name in ("current_timestamp", "current_datetime", "now"):
            return (F.lit(self.clock) if self.clock else F.current_timestamp()), "timestamp"
        if e.name in ("current_date", "today"):
            return (F.lit(self.clock.date()) if self.clock else F.current_date()), "date"
        if e.name.startswith("window_"):
            return self._window(e)
        f = FUNCTIONS.get(e.name)
        if f is None:
            self.passed_through.append(e.name)
            return F.call_function(e.name, *[self.column(x) for x in e.args]), "any"
        if len(e.args) < f.least or f.most is not None and len(e.args) > f.most:
            raise ExprError(f"{e.name} takes {f.least}" + (f" to {f.most}" if f.most != f.least else "") + f" arguments, not {len(e.args)}")
        args, kinds = [], []
        for i, x in enumerate(e.args):
            if i in f.literal:
                if not isinstance(x, Lit):
                    raise ExprError(f"argument {i + 1} of {e.name} must be a literal")
                args.append(literal_value(x.value))
            else:
                c, k = self.typed(x)
                args.append(c)
                kinds.append(k)
        try:
            made = f.build(*args)
        except ValueError as why:
            raise ExprError(str(why)) from None
        return made, (next((k for k in kinds if k not in ("null", "any")), "any") if f.kind == "same" else f.kind)

    def _window(self, e: Call) -> tuple[Column, str]:
        """window_fn(expr=, partition_by=, order_by=, range='-24h to current'): a range of time up to the row."""
        given = dict(e.named)
        value = given.pop("expr", e.args[0] if e.args else None)
        fn = e.name.removeprefix("window_")
        if fn not in AGGREGATES:
            raise ExprError(f"no aggregate {fn}")

        def named(key: str) -> Any:
            if key in given:
                return given.pop(key)
            return parse_expression(self.defaults[key]) if key in self.defaults else None

        part, order, span = named("partition_by"), named("order_by"), given.pop("range", None)
        span = span.value if isinstance(span, Lit) else self.defaults.get("range")
        if given:
            raise ExprError(f"{e.name} has no argument {', '.join(given)}")
        if order is None or span is None:
            raise ExprError(f"{e.name} needs order_by and range")
        w = Window.partitionBy(*([] if part is None else [self.column(part)])).orderBy(F.unix_micros(self.column(order).cast("timestamp"))).rangeBetween(-span_seconds(str(span)) * 1_000_000, 0)
        x = F.lit(1) if value is None else self.column(value)
        return AGGREGATES[fn](x).over(w), "number"


def compile_expression(text_or_tree: Any, df: DataFrame | T.StructType, **more: Any) -> Column:
    tree = parse_expression(text_or_tree) if isinstance(text_or_tree, str) else text_or_tree
    return Lowering(df, **more).column(tree)


def compile_assignments(assignments: Any, df: DataFrame, types: dict[str, T.DataType] | None = None, conform: bool = False, **more: Any) -> tuple[list[Column], Lowering]:
    """One Column for each assigned name, in order of the first assignment, and the Lowering.

    Earlier assignments are put in where out. names them, so that one projection does.
    types: of the target schema; NULL literals take them, and with conform every value.
    """
    low, types = Lowering(df, **more), types or {}
    for name, tree in assignments:
        c, kind = low.typed(tree)
        target = types.get(name)
        if target is not None and (kind == "null" or conform):
            c = c.cast(target) if kind == "null" or isinstance(target, T.StringType) else c.try_cast(target)
            kind = kind_of_type(target)
        elif kind == "null":
            c = c.cast("string")
        low.out[name] = (c, kind)
    return [c.alias(name) for name, (c, _) in low.out.items()], low


def block_columns(block: Block, df: DataFrame, **more: Any) -> list[Column]:
    return compile_assignments(block.assignments, df, **more)[0]


