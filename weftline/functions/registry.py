"""Functions of the expression language, each by its Spark expression.

An entry has the least and most arguments, what kind of value comes out (same: that of
the first argument), and a builder from Columns. Arguments of which the text counts, such as
formats and units, come as literal values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import spark_format


@dataclass(frozen=True)
class Function:
    least: int
    most: int | None
    kind: str
    build: Callable[..., Column]
    literal: tuple[int, ...] = ()


FUNCTIONS: dict[str, Function] = {}


def define(names: str, least: int, most: int | None, kind: str, build: Callable[..., Column], literal: tuple[int, ...] = ()) -> None:
    for name in names.split():
        FUNCTIONS[name] = Function(least, most, kind, build, literal)


def register(name: str, build: Callable[..., Column], least: int = 0, most: int | None = None, kind: str = "any") -> None:
    """Adds a function of one's own, such as a pandas UDF, under a name."""
    FUNCTIONS[name.lower()] = Function(least, most, kind, build)


def _decimal(x: Column, p: Any = 38, s: Any = 0) -> Column:
    p, s = int(p), int(s)
    if not 0 <= s <= p <= 38:
        raise ValueError(f"decimal({p},{s}) isn't a type")
    return x.try_cast(f"decimal({p},{s})")


_UNITS = {"second": 1, "minute": 60, "hour": 3600}


def _date_diff(a: Column, b: Column, unit: str = "days") -> Column:
    """a less b, in whole units; days count midnights."""
    u = unit.lower().rstrip("s")
    if u == "day":
        return F.datediff(a, b)
    if u == "month":
        return F.months_between(a, b).cast("int")
    if u == "year":
        return (F.months_between(a, b) / 12).cast("int")
    if u in _UNITS:
        return ((F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / (1_000_000 * _UNITS[u])).cast("long")
    raise ValueError(f"no unit {unit!r}")


def _truncated(x: Column, unit: str) -> Column:
    return F.date_trunc(unit, x)


def _part(x: Column, unit: str) -> Column:
    return F.date_part(F.lit(unit), x)


define("string_length length len char_length", 1, 1, "number", F.length)
define("trim", 1, 1, "string", F.trim)
define("ltrim trim_leading", 1, 1, "string", F.ltrim)
define("rtrim trim_trailing", 1, 1, "string", F.rtrim)
define("upper to_upper", 1, 1, "string", F.upper)
define("lower to_lower", 1, 1, "string", F.lower)
define("substring substr", 2, 3, "string", lambda s, i, n=None: F.substr(s.cast("string"), i, n) if n is not None else F.substr(s.cast("string"), i))
define("concat", 1, None, "string", lambda *c: F.concat(*[x.cast("string") for x in c]))
define("replace", 3, 3, "string", F.replace)
define("is_null isnull", 1, 1, "boolean", F.isnull)
define("is_not_null isnotnull", 1, 1, "boolean", F.isnotnull)
define("coalesce coalesce_first nvl ifnull", 1, None, "same", F.coalesce)
define("nullif", 2, 2, "same", F.nullif)
define("abs abs_value", 1, 1, "number", F.abs)
define("round round_to", 1, 2, "number", lambda x, n=0: F.round(x, int(n)), (1,))
define("floor", 1, 1, "number", F.floor)
define("ceil ceiling", 1, 1, "number", F.ceil)
define("sqrt", 1, 1, "number", F.sqrt)
define("mod", 2, 2, "number", F.try_mod)
define("decimal numeric", 1, 3, "number", _decimal, (1, 2))
define("integer int", 1, 1, "number", lambda x: x.try_cast("int"))
define("bigint long", 1, 1, "number", lambda x: x.try_cast("bigint"))
define("double", 1, 1, "number", lambda x: x.try_cast("double"))
define("float", 1, 1, "number", lambda x: x.try_cast("float"))
define("string", 1, 1, "string", lambda x: x.cast("string"))
define("boolean", 1, 1, "boolean", lambda x: x.try_cast("boolean"))
define("string_to_date to_date", 1, 2, "date", lambda s, f=None: F.try_to_date(s, spark_format(f)) if f else s.try_cast("date"), (1,))
define("string_to_datetime to_timestamp", 1, 2, "timestamp", lambda s, f=None: F.try_to_timestamp(s, F.lit(spark_format(f))) if f else s.try_cast("timestamp"), (1,))
define("date_diff datediff", 2, 3, "number", _date_diff, (2,))
define("date_add date_add_days", 2, 2, "date", F.date_add)
define("date_sub", 2, 2, "date", F.date_sub)
define("date_format", 2, 2, "string", lambda x, f: F.date_format(x, spark_format(f)), (1,))
define("date_trunc", 2, 2, "timestamp", _truncated, (1,))
define("date_part", 2, 2, "number", _part, (1,))
define("year", 1, 1, "number", F.year)
define("month", 1, 1, "number", F.month)
define("day", 1, 1, "number", F.dayofmonth)
define("hour", 1, 1, "number", F.hour)
define("min", 2, None, "same", F.least)
define("max", 2, None, "same", F.greatest)
define("if", 3, 3, "same", lambda c, a, b: F.when(c, a).otherwise(b))

#: Aggregates by name: each from one Column, or from none for count(*).
AGGREGATES: dict[str, Callable[..., Column]] = {
    name: getattr(F, name)
    for name in "sum count avg mean min max first last collect_list collect_set stddev stddev_samp stddev_pop variance var_samp var_pop median mode skewness kurtosis any_value bool_and bool_or approx_count_distinct count_distinct max_by min_by bit_and bit_or bit_xor product sum_distinct every some first_value last_value corr covar_samp covar_pop".split()
    if hasattr(F, name)
} | {"countdistinct": F.count_distinct, "count_dist": F.count_distinct}

#: Functions of rank and of neighbours that windows take besides aggregates.
RANKS: dict[str, Callable[..., Column]] = {
    "row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist,
    "ntile": F.ntile, "lag": F.lag, "lead": F.lead,
}


def literal_value(x: Any) -> Any:
    return int(x) if isinstance(x, Decimal) and x == int(x) else x


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)
