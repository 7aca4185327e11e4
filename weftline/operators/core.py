"""The dataflow operators: functions from DataFrames and settings to a DataFrame.

All are lazy and declarative; which join or aggregate runs is left to the optimizer. Each
is registered under the names that graphs give to it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expr import ExprError, Lowering, compile_assignments, compile_expression, parse_expression
from ..expr.parser import Call, If, Lit, Parser, Ref
from ..functions.registry import AGGREGATES, RANKS


class OperatorError(ValueError):
    """Settings or inputs that an operator can't work with."""


REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def operator(*names: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers fn(inputs, config, context) under names; also how one adds an operator."""

    def put(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        for n in names:
            REGISTRY[n.lower()] = fn
        return fn

    return put


def names_of(text: str | list[str] | None) -> list[str]:
    """Column names of a comma-separated setting, or of a list."""
    if text is None:
        return []
    return [x.strip() for x in text.split(",") if x.strip()] if isinstance(text, str) else list(text)


def _existing(df: DataFrame, names: list[str], what: str) -> list[str]:
    have = {c.lower(): c for c in df.columns}
    missing = [n for n in names if n.lower() not in have]
    if missing:
        raise OperatorError(f"{what}: no column {', '.join(missing)} among {', '.join(df.columns)}")
    return [have[n.lower()] for n in names]


def _sorts(text: str | list[str] | None, default: str = "asc") -> list[tuple[str, bool]]:
    """(column, ascending) of `a, b desc`."""
    out = []
    for part in names_of(text):
        name, _, way = part.partition(" ")
        way = (way.strip() or default).lower()
        if way not in ("asc", "ascending", "desc", "descending"):
            raise OperatorError(f"order {way!r} is neither asc nor desc")
        out.append((name, way.startswith("asc")))
    return out


def _order(df: DataFrame, text: str | list[str] | None, default: str = "asc") -> list[Column]:
    sorts = _sorts(text, default)
    cols = _existing(df, [n for n, _ in sorts], "sort")
    return [F.col(f"`{c}`").asc() if up else F.col(f"`{c}`").desc() for c, (_, up) in zip(cols, sorts, strict=True)]


# -- rows


def reformat(df: DataFrame, assignments: Any, schema: T.StructType | None = None, conform: bool = False, **more: Any) -> DataFrame:
    """Only what is assigned, in one projection; nothing assigned passes the input on."""
    if not assignments:
        return df
    types = {f.name: f.dataType for f in schema.fields} if schema else None
    return df.select(*compile_assignments(assignments, df, types, conform, **more)[0])


def filter_rows(df: DataFrame, condition: Any = None, **more: Any) -> DataFrame:
    """Rows for which the condition is true; without one all."""
    return df if condition is None else df.filter(compile_expression(condition, df, **more))


# -- joins

JOINS = {
    "inner": "inner", "left": "left", "left_outer": "left", "right": "right", "right_outer": "right", "outer": "full", "full": "full", "full_outer": "full",
    "semi": "left_semi", "left_semi": "left_semi", "anti": "left_anti", "left_anti": "left_anti", "cross": "cross",
}


def join(left: DataFrame, right: DataFrame, key: str | list[str] | None = None, how: str = "inner", on: str | None = None, suffix: str | None = None, broadcast: str | None = None) -> DataFrame:
    """Equi-join in which the key stands once; or, with `on`, any condition over both sides.

    Names that both sides have besides the key are an error, unless suffix is added to
    those of the right. broadcast (left or right) is a hint for a side known to be small.
    """
    if how.lower() not in JOINS:
        raise OperatorError(f"join type {how!r} isn't one of {', '.join(JOINS)}")
    how = JOINS[how.lower()]
    keys = names_of(key)
    if not keys and on is None and how != "cross":
        raise OperatorError("a join needs a key")
    keys = _existing(left, keys, "join, left")
    right_keys = _existing(right, keys, "join, right")
    for mine, theirs in zip(keys, right_keys, strict=True):
        right = right.withColumnRenamed(theirs, mine) if mine != theirs else right
    clash = [] if how in ("left_semi", "left_anti") else sorted({c.lower() for c in left.columns} & {c.lower() for c in right.columns} - {k.lower() for k in keys})
    if clash and suffix is None:
        raise OperatorError(f"both sides have {', '.join(clash)}; rename them or give a suffix")
    for c in [c for c in right.columns if c.lower() in clash]:
        right = right.withColumnRenamed(c, c + (suffix or ""))
    if broadcast in ("left", "right"):
        left, right = (F.broadcast(left), right) if broadcast == "left" else (left, F.broadcast(right))
    if how == "cross":
        return left.crossJoin(right)
    if on is not None:
        both = T.StructType(left.schema.fields + right.schema.fields)
        return left.join(right, compile_expression(on, both), how)
    return left.join(right, keys, how)


#: Bytes up to which the side of a lookup is broadcast by a hint.
LOOKUP_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a result's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup(df: DataFrame, table: DataFrame, key: str | list[str], match: str = "all", sort_by: str | None = None, suffix: str | None = None, limit: int = LOOKUP_BYTES) -> DataFrame:
    """Left join to a table, which is broadcast if the optimizer holds it for `limit` bytes or less.

    match=first joins one row of each key, the first by sort_by; all may multiply rows.
    """
    if match not in ("all", "first"):
        raise OperatorError(f"match {match!r} is neither all nor first")
    if match == "first":
        table = dedup(table, key, sort_by=sort_by)
    return join(df, table, key, "left", suffix=suffix, broadcast="right" if estimated_bytes(table) <= limit else None)


# -- aggregates


def parse_aggregates(text: str) -> list[tuple[str, Any]]:
    """(alias, call) of `fn(expression) filter (where condition):alias, ...`; the alias is fn_column if it isn't given."""
    p, out = Parser(text), []
    while p.tokens[p.i].kind != "end":
        call, condition = p.expression(), None
        if p.take("filter"):
            p.need("(")
            p.need("where")
            condition = p.expression()
            p.need(")")
        alias = p.name() if p.take(":") or p.take("as") else None
        if not isinstance(call, Call):
            raise OperatorError(f"{text!r}: an aggregate must be a call")
        if condition is not None:
            args = (Lit(1),) if not call.args or call.args[0] == Lit("*") else call.args
            call = Call(call.name, (If(((condition, args[0]),), Lit(None)), *args[1:]))
        if alias is None:
            arg = call.args[0] if call.args else None
            alias = f"{call.name}_{arg.path[-1]}" if isinstance(arg, Ref) else call.name
        out.append((alias, call))
        if not p.take(",") and p.tokens[p.i].kind != "end":
            raise p.fail("expected a comma")
    return out


def aggregate_column(call: Call, df: DataFrame | Lowering) -> Column:
    low = df if isinstance(df, Lowering) else Lowering(df)
    if call.name not in AGGREGATES:
        raise OperatorError(f"{call.name} isn't an aggregate")
    if call.name == "count" and (not call.args or call.args[0] == Lit("*")):
        return F.count(F.lit(1))
    return AGGREGATES[call.name](*[low.column(a) for a in call.args])


def _with_aggregates(tree: Any, hidden: list[tuple[str, Call]]) -> Any:
    """tree with references in place of its aggregates, which are added to hidden."""
    if isinstance(tree, Call) and tree.name in AGGREGATES and not (tree.name in ("min", "max") and len(tree.args) > 1):
        name = next((n for n, c in hidden if c == tree), None)
        if name is None:
            name = f"__having_{len(hidden)}"
            hidden.append((name, tree))
        return Ref("", (name,))
    if hasattr(tree, "__dataclass_fields__"):
        return type(tree)(**{k: _with_aggregates(getattr(tree, k), hidden) for k in tree.__dataclass_fields__})
    return tuple(_with_aggregates(x, hidden) for x in tree) if isinstance(tree, tuple) else tree


def rollup(df: DataFrame, group_by: str | list[str] | None = None, aggregates: str | None = None, having: str | None = None, sets: str | None = None, pivot: str | None = None) -> DataFrame:
    """Grouped aggregates; without any the count of rows; without keys one row.

    Arguments are expressions, and having may name aggregates. sets: rollup or cube. pivot
    is `column: value, value`: a column for each of the values, or for each value and
    aggregate, named value or value_alias.
    """
    keys = _existing(df, names_of(group_by), "group by")
    wanted = parse_aggregates(aggregates) if aggregates else [("count", Call("count", (Lit("*"),)))]
    hidden = list(wanted)
    tree = _with_aggregates(parse_expression(having), hidden) if having else None
    low = Lowering(df)
    columns = [aggregate_column(c, low).alias(n) for n, c in hidden]
    if sets not in (None, "rollup", "cube"):
        raise OperatorError(f"grouping sets {sets!r} are neither rollup nor cube")
    grouped = df.rollup(*keys) if sets == "rollup" else df.cube(*keys) if sets == "cube" else df.groupBy(*keys)
    if pivot:
        name, _, values = pivot.partition(":")
        if tree is not None or not names_of(values):
            raise OperatorError("a pivot needs the values that become columns, and takes no having")
        grouped = grouped.pivot(_existing(df, [name.strip()], "pivot")[0], names_of(values))
    out = grouped.agg(*columns)
    if tree is not None:
        out = out.filter(compile_expression(tree, out)).select(*keys, *[n for n, _ in wanted])
    return out


def denormalize(df: DataFrame, group_by: str | list[str], collect: str, sort_by: str | None = None, alias: str | None = None) -> DataFrame:
    """Vectors of a column by key, in order of sort_by (ascending) if that is given."""
    keys = _existing(df, names_of(group_by), "group by")
    out = []
    for c in _existing(df, names_of(collect), "collect"):
        name = alias or f"{c}_list"
        if sort_by:
            sorts = _existing(df, names_of(sort_by), "sort")
            s = F.array_sort(F.collect_list(F.struct(*[F.col(f"`{x}`").alias(f"s{i}") for i, x in enumerate(sorts)], F.col(f"`{c}`").alias("v"))))
            out.append(F.transform(s, lambda x: x["v"]).alias(name))
        else:
            out.append(F.collect_list(f"`{c}`").alias(name))
    return df.groupBy(*keys).agg(*out)


# -- windows


def scan(df: DataFrame, key: str | list[str] | None = None, sort_by: str | list[str] | None = None, aggregates: str = "", range: str | None = None) -> DataFrame:
    """The input with running aggregates from the first row of the key to the current one.

    Ranks and neighbours (row_number, lag(x, 1), ...) go over the whole key. With a range such
    as '-24h to current' the frame is that time before the row, by the first sort column.
    """
    if not names_of(sort_by):
        raise OperatorError("a scan needs sort_by: without an order its result isn't defined")
    part = [F.col(f"`{c}`") for c in _existing(df, names_of(key), "scan")]
    base = Window.partitionBy(*part).orderBy(*_order(df, sort_by))
    low = Lowering(df)
    if range:
        from ..expr.lower import span_seconds

        first = _existing(df, [_sorts(sort_by)[0][0]], "scan")[0]
        frame = Window.partitionBy(*part).orderBy(F.unix_micros(F.col(f"`{first}`").cast("timestamp"))).rangeBetween(-span_seconds(range) * 1_000_000, 0)
    else:
        frame = base.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = {}
    for alias, call in parse_aggregates(aggregates):
        if call.name in RANKS:
            args = [a.value if isinstance(a, Lit) else low.column(a) for a in call.args]
            made[alias] = RANKS[call.name](*args).over(base)
        else:
            made[alias] = aggregate_column(call, low).over(frame)
    return df.withColumns(made)


#: What a running aggregate of a chunk and the aggregate of the chunks before it give together.
_TOGETHER: dict[str, Callable[[Column, Column], Column]] = {
    "count": lambda before, here: F.coalesce(before, F.lit(0)) + here,
    "sum": lambda before, here: F.coalesce(before + here, before, here),
    "min": lambda before, here: F.least(before, here),
    "max": lambda before, here: F.greatest(before, here),
}


def scan_chunked(df: DataFrame, key: str | list[str] | None, sort_by: str | list[str], aggregates: str, chunks: int) -> DataFrame:
    """scan() of sums, counts, minima and maxima for keys too frequent for one task.

    The first sort column, a number, date or timestamp, is cut at quantiles into chunks.
    Running aggregates are taken by key and chunk; what the chunks before add is a prefix
    over at most `chunks` rows of a key. Rows are shuffled once, by key and chunk.
    """
    keys = _existing(df, names_of(key), "scan")
    sorts = _sorts(sort_by)
    first = _existing(df, [sorts[0][0]], "scan")[0]
    calls = parse_aggregates(aggregates)
    if any(c.name not in _TOGETHER for _, c in calls):
        raise OperatorError(f"a scan in chunks takes {', '.join(_TOGETHER)} only")
    kind = df.schema[first].dataType
    place = F.col(f"`{first}`").cast("double") if isinstance(kind, T.NumericType) else F.unix_micros(F.col(f"`{first}`").cast("timestamp")).cast("double")
    cuts = df.agg(F.percentile_approx(place, [i / chunks for i in range(1, chunks)], 10_000).alias("q")).first()["q"] or []
    rank = F.lit(0)
    for q in sorted(set(cuts)):
        rank = rank + F.when(place > q, 1).otherwise(0)
    if not sorts[0][1]:  # descending: the last chunk comes first, and NULLs after it
        rank = F.when(place.isNull(), F.lit(1)).otherwise(-rank)
    else:
        rank = F.when(place.isNull(), F.lit(-1)).otherwise(rank)
    low, columns = Lowering(df), df.columns
    made = {f"__v{i}": (F.lit(1) if c.name == "count" and (not c.args or c.args[0] == Lit("*")) else low.column(c.args[0])) for i, (_, c) in enumerate(calls)}
    rows = df.withColumns({**made, "__chunk": rank})
    part = [F.col(f"`{k}`") for k in keys]
    own = Window.partitionBy(*part, "__chunk").orderBy(*_order(df, sort_by)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy(*part, "__chunk").agg(*[AGGREGATES[c.name](f"__v{i}").alias(f"__t{i}") for i, (_, c) in enumerate(calls)])
    prior = Window.partitionBy(*part).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    # Sums of counts, and sums, minima and maxima of their own kind.
    before = sums.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__chunk").alias("__c"), *[AGGREGATES["sum" if c.name == "count" else c.name](f"__t{i}").over(prior).alias(f"__b{i}") for i, (_, c) in enumerate(calls)])
    running = rows.withColumns({f"__r{i}": AGGREGATES[c.name](f"__v{i}").over(own) for i, (_, c) in enumerate(calls)})
    on = F.col("__chunk") == F.col("__c")
    for i, k in enumerate(keys):
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
    joined = running.join(before, on, "left")
    return joined.select(*[F.col(f"`{c}`") for c in columns], *[_TOGETHER[c.name](F.col(f"__b{i}"), F.col(f"__r{i}")).alias(n) for i, (n, c) in enumerate(calls)])


# -- order and duplicates


def sort(df: DataFrame, key: str | list[str] | None = None, order: str = "asc") -> DataFrame:
    """Sorted by all keys, each in its own direction (`k desc`) or in `order`."""
    return df.orderBy(*_order(df, key, order)) if names_of(key) else df


def sort_within_groups(df: DataFrame, group_by: str | list[str], sort_by: str | list[str], total: bool = False) -> DataFrame:
    """The rows of a group in one partition, sorted; total: all rows sorted by group and key."""
    groups = _existing(df, names_of(group_by), "group")
    order = [F.col(f"`{g}`").asc() for g in groups] + _order(df, sort_by)
    return df.orderBy(*order) if total else df.repartition(*[F.col(f"`{g}`") for g in groups]).sortWithinPartitions(*order)


def dedup(df: DataFrame, key: str | list[str] | None = None, which: str = "first", sort_by: str | list[str] | None = None) -> DataFrame:
    """One row of each key: the first or last by sort_by; unique: keys that occur once.

    first and last are taken by an aggregate, so that a very frequent key is folded before
    the shuffle. Without sort_by any row of the key; without a key distinct rows.
    """
    if which not in ("first", "last", "unique"):
        raise OperatorError(f"{which!r} is none of first, last, unique")
    keys = _existing(df, names_of(key), "dedup")
    if not keys:
        return df.distinct()
    if which == "unique":
        n = "__n"
        grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n), F.any_value(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("__row"))
        return grouped.where(F.col(n) == 1).select("__row.*")
    if not names_of(sort_by):
        if which == "last":
            raise OperatorError("which=last needs sort_by")
        return df.dropDuplicates(keys)
    sorts = _sorts(sort_by)
    ways = {up for _, up in sorts}
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    if len(ways) == 1 and all(_orderable(f.dataType) for f in df.schema.fields):
        by = _existing(df, [n for n, _ in sorts], "dedup")
        smallest = (which == "first") == ways.pop()
        whole = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(by)], row.alias("row"))
        return df.groupBy(*keys).agg((F.min if smallest else F.max)(whole).alias("__best")).select("__best.row.*")
    order = _order(df, [f"{n} {'asc' if up == (which == 'first') else 'desc'}" for n, up in sorts])
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def _orderable(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return all(_orderable(f.dataType) for f in t.fields)
    return _orderable(t.elementType) if isinstance(t, T.ArrayType) else not isinstance(t, T.MapType | T.VariantType)


def limit(df: DataFrame, n: int, key: str | list[str] | None = None, order: str = "asc") -> DataFrame:
    """The first n rows, by the keys if there are any (a top-k)."""
    return sort(df, key, order).limit(int(n))


def sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(fraction=float(fraction), seed=int(seed))


# -- sets and vectors


def gather(*inputs: DataFrame, ordered: bool = False) -> DataFrame:
    """The rows of all inputs, by column name; what an input lacks is NULL.

    A column must have one type in all that have it. ordered adds __src_ord, the number of
    the input.
    """
    if not inputs:
        raise OperatorError("nothing to gather")
    types: dict[str, T.DataType] = {}
    for df in inputs:
        for f in df.schema.fields:
            if types.setdefault(f.name.lower(), f.dataType) != f.dataType:
                raise OperatorError(f"{f.name} is {types[f.name.lower()].simpleString()} in one input and {f.dataType.simpleString()} in another")
    parts = [df.withColumn("__src_ord", F.lit(i)) if ordered else df for i, df in enumerate(inputs)]
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def set_operation(left: DataFrame, right: DataFrame, kind: str, distinct: bool = False) -> DataFrame:
    """union, intersect or except by column position, all rows or distinct ones."""
    if kind not in ("union", "intersect", "except"):
        raise OperatorError(f"no set operation {kind!r}")
    if kind == "union":
        out = left.union(right)
        return out.distinct() if distinct else out
    if kind == "intersect":
        return left.intersect(right) if distinct else left.intersectAll(right)
    return left.subtract(right) if distinct else left.exceptAll(right)


def normalize(df: DataFrame, array_field: str, item_alias: str | None = None, outer: bool = False, index: str | None = None, flatten: bool = False) -> DataFrame:
    """A row for each item of a vector, which takes the vector's place.

    outer keeps rows without items; index names a column for the position; flatten puts
    the fields of items that are records in place of the item.
    """
    field = _existing(df, [array_field], "normalize")[0]
    kind = df.schema[field].dataType
    if not isinstance(kind, T.ArrayType):
        raise OperatorError(f"{field} isn't a vector")
    alias = item_alias or field
    others = [F.col(f"`{c}`") for c in df.columns if c != field]
    if index:
        out = df.select(*others, (F.posexplode_outer if outer else F.posexplode)(f"`{field}`").alias(index, alias))
    else:
        out = df.select(*others, (F.explode_outer if outer else F.explode)(f"`{field}`").alias(alias))
    if flatten and isinstance(kind.elementType, T.StructType):
        inner = kind.elementType.names
        clash = sorted(set(inner) & {c for c in out.columns if c != alias})
        if clash:
            raise OperatorError(f"fields {', '.join(clash)} of {field} are columns already")
        out = out.select(*[F.col(f"`{c}`") for c in out.columns if c != alias], *[F.col(f"`{alias}`")[n].alias(n) for n in inner])
    return out


__all__ = ["ExprError", "OperatorError", "REGISTRY", "operator"]
