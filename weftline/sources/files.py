"""Readers and writers of files."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import spark_format
from ..schema.dml import unescape
from ..schema.spec import FieldSpec, RecordSpec, SchemaError, spark_type, struct_type, with_layout
from . import mainframe

DELIMITED = {"delimited", "csv", "text", "txt"}


def read(spark: SparkSession, path: str | None, fmt: str = "parquet", schema: T.StructType | RecordSpec | None = None, delimiter: str | None = None, header: bool = False, options: Mapping[str, Any] | None = None) -> DataFrame:
    """A table of files; with a schema no data are looked at to infer one.

    Delimited text takes the delimiter (a comma if none is given) and may have header
    lines. Formats of this engine: fixed, mainframe, mixed; others are Spark's.
    """
    fmt = fmt.lower()
    record = schema if isinstance(schema, RecordSpec) else None
    if fmt in ("fixed", "fixed_width"):
        return read_fixed(spark, path, _need(record, fmt))
    if fmt in ("mainframe", "ebcdic", "cobol"):
        return mainframe.read_mainframe(spark, path, _need(record, fmt))
    corrupt = {k: (options or {}).get(k) for k in ("mode", "columnNameOfCorruptRecord")}
    if fmt == "mixed":
        return read_mixed(spark, path, _need(record, fmt), corrupt["mode"] or "permissive", corrupt["columnNameOfCorruptRecord"])
    if fmt in DELIMITED and record is not None:
        return read_delimited(spark, path, record, delimiter, header)
    reader = spark.read.options(**{k: str(v) for k, v in (options or {}).items()})
    types = struct_type(record) if record else schema
    if types is not None:
        reader = reader.schema(types)
    if fmt in DELIMITED and not (fmt == "text" and delimiter is None and types is None):
        return reader.option("sep", unescape(delimiter) if delimiter else ",").option("header", header).csv(path)
    return reader.format(fmt).load(path) if path else reader.format(fmt).load()  # tables and queues are named by options


def _need(record: RecordSpec | None, fmt: str) -> RecordSpec:
    if record is None:
        raise SchemaError(f"format {fmt} needs a record schema")
    return with_layout(record)


def parsed(c: Column, f: FieldSpec) -> Column:
    """Text as the type of a field; what doesn't fit, and its null indicator, is NULL."""
    if f.null_indicator is not None:
        c = F.nullif(c, F.lit(f.null_indicator))
    if f.type == "string":
        return c
    c = F.trim(c)
    if f.format and f.type == "date":
        return F.try_to_date(c, spark_format(f.format))
    if f.format and f.type == "datetime":
        return F.try_to_timestamp(c, F.lit(spark_format(f.format)))
    return c.try_cast(spark_type(replace(f, dims=())))


def conditioned(df: DataFrame, record: RecordSpec) -> DataFrame:
    """Fields of a branch that doesn't hold are NULL."""
    made = {}
    for f in record.fields:
        if f.condition:
            name, op, value, holds = f.condition
            c, v = F.col(f"`{name}`"), F.lit(value)
            test = {"=": c == v, "!=": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op]
            test = F.coalesce(test, F.lit(False))
            made[f.name] = F.when(test if holds else ~test, F.col(f"`{f.name}`"))
    return df.withColumns(made) if made else df


def read_delimited(spark: SparkSession, path: str, record: RecordSpec, delimiter: str | None = None, header: bool = False) -> DataFrame:
    """Delimited text, each column parsed by its field's format and null indicator."""
    fields = [f for f in record.fields if f.name != "newline"]
    if any(f.fields or f.dims for f in fields):
        raise SchemaError("records and vectors can't be read from delimited text")
    own = [f.delimiter for f in fields if f.delimiter not in (None, "\n")]
    if delimiter is None and len(set(own)) > 1:
        return read_mixed(spark, path, record)
    sep = unescape(delimiter) if delimiter else own[0] if own else ","
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    rows = spark.read.schema(text).option("sep", sep).option("header", header).csv(path)
    return conditioned(rows.select(*[parsed(F.col(f"`{f.name}`"), f).alias(f.name) for f in fields]), record)


def read_fixed(spark: SparkSession, path: str, record: RecordSpec) -> DataFrame:
    """Lines of fixed width, cut by the record's layout in one projection."""
    if record.layout != "fixed":
        raise SchemaError(f"{record.name} isn't of fixed width but {record.layout}")

    def cut(f: FieldSpec, at: Column | int) -> Column:
        n = f.length or 0
        if f.dims:
            one = n
            for d in f.dims:
                one //= d if isinstance(d, int) else 1
            base = replace(f, dims=(), length=one)
            items = [cut(_moved(base, i * one), at) for i in range(n // one)]
            return F.array(*items)
        if f.fields:
            return F.struct(*[cut(x, (at if isinstance(at, int) else 0) + (f.offset or 0)).alias(x.name) for x in f.fields])
        piece = F.substring("value", int(at) + (f.offset or 0) + 1, n)
        return parsed(F.rtrim(piece) if f.type == "string" else piece, f)

    rows = spark.read.text(path)
    return conditioned(rows.select(*[cut(f, 0).alias(f.name) for f in record.fields if f.name != "newline"]), record)


def _moved(f: FieldSpec, by: int) -> FieldSpec:
    return replace(f, offset=(f.offset or 0) + by)


def read_mixed(spark: SparkSession, path: str, record: RecordSpec, mode: str = "permissive", corrupt_column: str | None = None) -> DataFrame:
    """Lines in which some fields have a width and others each their own delimiter, by one anchored pattern.

    A line that doesn't fit is a row of NULLs, with the line itself in corrupt_column if that
    is named (permissive), or fails the job (failfast).
    """
    import re

    if mode.lower() not in ("permissive", "failfast"):
        raise SchemaError(f"mode {mode!r} is neither permissive nor failfast")

    fields = [f for f in record.fields if f.name != "newline"]
    pattern = "^"
    for i, f in enumerate(fields):
        last = i == len(fields) - 1
        if f.fields or f.dims:
            raise SchemaError(f"{f.name}: records and vectors can't be read from mixed text")
        if f.delimiter is not None and f.delimiter != "\n":
            d = re.escape(f.delimiter)
            pattern += f"((?:(?!{d}).)*)" + ("(?:" + d + ")?" if last else d)
        elif f.delimiter == "\n" or last and f.length is None:
            pattern += "(.*)"
        else:
            from ..schema.spec import width

            pattern += f"(.{{{width(f)}}})"
    pattern += "$"
    value = F.col("value")
    fits = value.rlike(pattern)
    if mode.lower() == "failfast":
        fits = F.coalesce(fits, F.lit(False)) | F.raise_error(F.concat(F.lit(f"a line doesn't fit {record.name}: "), value)).cast("boolean")
    made = []
    for i, f in enumerate(fields):
        c = F.when(fits, F.regexp_extract(value, pattern, i + 1))
        made.append(parsed(F.rtrim(c) if f.delimiter is None and f.type == "string" else c, f).alias(f.name))
    if corrupt_column:
        made.append(F.when(~fits, value).alias(corrupt_column))
    return conditioned(spark.read.text(path).select(*made), record)


MODES = {"overwrite", "append", "ignore", "error", "errorifexists"}


def write(df: DataFrame, path: str | None, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None, coalesce: int | None = None, repartition: int | None = None, delimiter: str | None = None, header: bool = False, options: Mapping[str, Any] | None = None) -> None:
    """Writes files, as many as the plan has partitions unless coalesce or repartition say so.

    Appends are coalesced and never shuffled for the number of files. Format mainframe needs
    a record as an option.
    """
    if mode not in MODES:
        raise SchemaError(f"mode {mode!r} is none of {', '.join(sorted(MODES))}")
    if repartition and mode != "append":
        df = df.repartition(repartition, *[F.col(f"`{c}`") for c in partition_by or []])
    elif coalesce or repartition:
        df = df.coalesce(coalesce or repartition or 1)
    fmt = fmt.lower()
    w = df.write.mode(mode).options(**{k: str(v) for k, v in (options or {}).items()})
    if fmt in DELIMITED:
        fmt, w = "csv", w.option("sep", unescape(delimiter) if delimiter else ",").option("header", header)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path) if path else w.format(fmt).save()


def discard(df: DataFrame) -> None:
    """Runs the plan and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


def recommend_format(record: RecordSpec) -> tuple[str, list[str]]:
    """(format, alternatives) that suit a record, by the first rule that holds."""

    def all_fields(fields):
        for f in fields:
            yield f
            yield from all_fields(f.fields)

    flat = list(all_fields(record.fields))
    leaves = [f for f in flat if not f.fields]
    if any(f.encoding in ("ebcdic", "packed") for f in flat) or record.encoding == "ebcdic":
        return "mainframe", ["parquet"]
    if record.layout == "fixed" and all(f.args or f.type in ("integer", "long", "float", "double", "boolean", "date", "datetime") for f in leaves) and any(f.args for f in leaves if f.type == "string") and not any(f.fields or f.dims for f in flat):
        return "fixed", ["parquet", "csv"]
    if any(f.fields or f.dims for f in flat):
        return "parquet", ["orc", "json"]
    if any(f.delimiter for f in leaves):
        return "csv", ["parquet"]
    if any(f.type in ("decimal", "date", "datetime") for f in leaves):
        return "parquet", ["orc"]
    if leaves and all(f.type == "string" for f in leaves):
        return "csv", ["parquet"]
    return "parquet", ["orc", "csv"]


def reader_for(spark: SparkSession, record: RecordSpec, path: str, **more: Any) -> DataFrame:
    """Reads path in the format recommended for the record."""
    return read(spark, path, recommend_format(record)[0], record, **more)
