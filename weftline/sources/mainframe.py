"""Records of fixed length in EBCDIC or ASCII, packed, zoned and binary numbers, in built-in functions only."""

from __future__ import annotations

from dataclasses import replace
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema.spec import FieldSpec, RecordSpec, SchemaError, spark_type, width

#: Latin-1 code points, and the characters of code page 37 in their place.
LATIN1 = "".join(chr(i) for i in range(1, 256))
CP037 = bytes(range(1, 256)).decode("cp037")
#: Last characters of signed digits in text: 0 to 9, positive and negative.
PLUS, MINUS, LOW_MINUS = "{ABCDEFGHI", "}JKLMNOPQR", "pqrstuvwxy"


def text_of(b: Column, encoding: str | None) -> Column:
    if encoding == "ebcdic":
        return F.translate(F.decode(b, "ISO-8859-1"), LATIN1, CP037)
    return F.decode(b, "UTF-8" if encoding != "ascii" else "ISO-8859-1")


def _scaled(n: Column, scale: int) -> Column:
    return n if not scale else F.try_divide(n, F.lit(10**scale).cast("decimal(38,0)"))


def packed(b: Column, scale: int) -> Column:
    """Packed decimal: a digit each half byte, the last one the sign; bad digits give NULL."""
    h = F.hex(b)
    digits = F.substr(h, F.lit(1), F.length(h) - 1)
    sign = F.when(F.right(h, F.lit(1)).isin("B", "D"), F.lit("-")).when(F.right(h, F.lit(1)).isin("A", "C", "E", "F"), F.lit(""))
    return _scaled(F.concat(sign, digits).try_cast("decimal(38,0)"), scale)


def unsigned(b: Column) -> Column:
    return F.conv(F.hex(b), 16, 10).cast("decimal(20,0)")


def binary_number(b: Column, n: int) -> Column:
    """Big-endian two's complement of up to eight bytes."""
    u = unsigned(b)
    return F.when(u >= F.lit(2 ** (8 * n - 1)).cast("decimal(20,0)"), u - F.lit(2 ** (8 * n)).cast("decimal(21,0)")).otherwise(u)


def zoned(b: Column, ebcdic: bool, scale: int) -> Column:
    """Digits in characters; the last one may carry the sign, in its zone or as a letter."""
    if ebcdic:
        h = F.hex(b)
        digits = F.regexp_replace(h, "(.)(.)", "$2")
        minus = F.substr(h, F.length(h) - 1, F.lit(1)).isin("B", "D")
    else:
        text = F.trim(F.decode(b, "ISO-8859-1"))
        last = F.right(text, F.lit(1))
        digits = F.concat(F.substr(text, F.lit(1), F.length(text) - 1), F.translate(last, PLUS + MINUS + LOW_MINUS, "0123456789" * 3))
        minus = F.contains(F.lit(MINUS + LOW_MINUS), last) & (last != "")
    return _scaled(F.concat(F.when(minus, F.lit("-")).otherwise(F.lit("")), digits).try_cast("decimal(38,0)"), scale)


def apart(b: Column, encoding: str | None, scale: int) -> Column:
    """Digits with a sign of its own before or after them."""
    text = F.regexp_replace(F.trim(text_of(b, encoding)), r"^(\d+)([+-])$", "$2$1")
    return _scaled(text.try_cast("decimal(38,0)"), scale)


def floating(b: Column, n: int, ebcdic: bool) -> Column:
    """A binary floating-point number of 4 or 8 bytes: hexadecimal in EBCDIC records, else IEEE 754, of which infinities and NaN are NULL."""
    part = lambda at, k: F.conv(F.hex(F.substring(b, at, k)), 16, 10).cast("long")
    sign = F.when(part(1, 1) >= 128, F.lit(-1.0)).otherwise(F.lit(1.0))
    if ebcdic:
        return sign * part(2, n - 1).cast("double") * F.pow(F.lit(16.0), (part(1, 1) % 128 - 64 - 2 * (n - 1)).cast("double"))
    top, bits, most = part(1, 2) % 32768, (7, 4)[n == 8], (255, 2047)[n == 8]
    exponent, rest = F.shiftright(top, bits), (top % (1 << bits)).cast("double") * float(256 ** (n - 2)) + part(3, n - 2).cast("double")
    fraction = rest / float(1 << bits) / float(256 ** (n - 2)) + F.when(exponent > 0, 1.0).otherwise(0.0)
    return F.when(exponent < most, sign * fraction * F.pow(F.lit(2.0), (F.greatest(exponent, F.lit(1)) - most // 2).cast("double")))


def decoded(record: Column, f: FieldSpec, at: int, encoding: str | None) -> Column:
    """The value of a field at a byte offset of a binary record."""
    if f.dims:
        one = f.length or 0
        for d in f.dims:
            if not isinstance(d, int):
                raise SchemaError(f"{f.name} has no fixed length")
            one //= d
        n = (f.length or 0) // one
        return F.array(*[decoded(record, replace(f, dims=(), length=one), at + i * one, encoding) for i in range(n)])
    own = f.encoding or encoding
    if f.fields:
        return F.struct(*[decoded(record, x, at - (f.fields[0].offset or 0) + (x.offset or 0), own).alias(x.name) for x in f.fields])
    n = f.length if f.length is not None else width(f) or 0
    b, notes = F.substring(record, at + 1, n), dict(f.annotations)
    scale = f.args[1] if f.type == "decimal" and len(f.args) > 1 else 0
    kind = spark_type(f)
    if f.type == "binary":
        return b
    if f.type == "decimal":
        if f.encoding == "packed":
            number = packed(b, scale)
        elif notes.get("usage") == "binary":
            number = _scaled((binary_number(b, n) if "signed" in notes else unsigned(b)).cast("decimal(38,0)"), scale)
        elif "sign" in notes:
            number = apart(b, own, scale)
        else:
            number = zoned(b, own == "ebcdic", scale)
        return number.try_cast(kind)
    if f.type in ("integer", "long"):
        return binary_number(b, n).try_cast(kind)
    if f.type in ("float", "double"):
        return floating(b, n, encoding == "ebcdic").cast(kind)
    text = F.rtrim(F.decode(b, "UTF-16BE") if notes.get("charset") == "UTF-16BE" else text_of(b, own))
    return text if f.type == "string" else text.try_cast(kind)


def _fixed(record: RecordSpec) -> int:
    if record.layout != "fixed" or not record.record_length:
        raise SchemaError(f"{record.name} has no fixed length")
    return record.record_length


def _padding(f: FieldSpec) -> bool:
    return bool(dict(f.annotations).get("padding"))


def read_mainframe(spark: SparkSession, path: str, record: RecordSpec) -> DataFrame:
    """Files of records of one length without separators, split between tasks at the ends of records.

    A file that ends within a record is an error.
    """
    raw = spark.sparkContext._jsc.binaryRecords(path, _fixed(record))
    jvm = spark.sparkContext._jvm
    rows = DataFrame(spark._jsparkSession.createDataset(raw.rdd(), jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)
    return rows.select(*[decoded(F.col("value"), f, f.offset or 0, record.encoding).alias(f.name) for f in record.fields if not _padding(f)])


def _digits(c: Column, f: FieldSpec) -> tuple[Column, Column]:
    """(whether a number is negative, its digits) at the field's precision and scale."""
    p, s = f.args[0], f.args[1] if len(f.args) > 1 else 0
    n = F.coalesce(c, F.lit(0)).cast(f"decimal({p},{s})")
    return n < 0, F.lpad(F.regexp_replace(F.abs(n).cast("string"), r"\.", ""), p, "0")


def encoded(c: Column, f: FieldSpec, encoding: str | None) -> Column:
    """The bytes of a scalar field; NULL is blanks or zero."""
    n, own, notes = width(f) or 0, f.encoding or encoding, dict(f.annotations)

    def text(x: Column) -> Column:
        x = F.translate(x, CP037, LATIN1) if own == "ebcdic" else x
        return F.encode(x, "ISO-8859-1" if own in ("ebcdic", "ascii") else "UTF-8")

    if f.type == "binary":
        return F.rpad(F.coalesce(c, F.lit(b"")), n, F.lit(b"\0"))
    if f.type == "decimal" and (f.encoding == "packed" or notes.get("usage") != "binary"):
        minus, digits = _digits(c, f)
        if f.encoding == "packed":
            return F.unhex(F.lpad(F.concat(digits, F.when(minus, F.lit("D")).otherwise(F.lit("C"))), 2 * n, "0"))
        if "sign" in notes:
            sign = F.when(minus, F.lit("-")).otherwise(F.lit("+"))
            return text(F.concat(sign, digits) if notes["sign"].startswith("leading") else F.concat(digits, sign))
        last = F.right(digits, F.lit(1))
        if own == "ebcdic":
            zones = F.regexp_replace(F.left(digits, F.lit(f.args[0] - 1)), "(.)", "F$1")
            return F.unhex(F.concat(zones, F.when(minus, F.lit("D")).otherwise(F.lit("C")), last))
        return text(F.concat(F.left(digits, F.lit(f.args[0] - 1)), F.when(minus, F.translate(last, "0123456789", MINUS)).otherwise(last)))
    if f.type in ("integer", "long", "decimal"):
        scale = f.args[1] if f.type == "decimal" and len(f.args) > 1 else 0
        whole = (F.coalesce(c, F.lit(0)).cast("decimal(38,0)") if not scale else F.coalesce(c, F.lit(0)).cast(f"decimal(18,{scale})") * 10**scale).cast("long")
        return F.unhex(F.right(F.lpad(F.hex(whole), 16, "0"), F.lit(2 * n)))
    if f.type in ("float", "double"):
        raise SchemaError(f"{f.name}: floating-point fields can't be written")
    shown = F.coalesce(c.cast("string"), F.lit(""))
    if notes.get("charset") == "UTF-16BE":
        return F.encode(F.rpad(shown, n // 2, " "), "UTF-16BE")
    return text(F.rpad(shown, n, " "))


def write_mainframe(df: DataFrame, path: str, record: RecordSpec) -> int:
    """Writes records of one length, a file for each task, and returns how many.

    A task writes beside its file and renames it as it ends, so that another attempt at it
    does no harm. Records within records and vectors can't be written.
    """
    _fixed(record)
    if any(f.fields or f.dims for f in record.fields):
        raise SchemaError("records and vectors can't be written")
    blank = F.lit(bytes([0x40 if record.encoding == "ebcdic" else 0x20]))
    parts = [F.repeat(blank.cast("string"), width(f) or 0).cast("binary") if _padding(f) else encoded(F.col(f"`{f.name}`"), f, record.encoding) for f in record.fields]
    rows = df.select(F.concat(*parts).alias("record"))

    local = urlsplit(path).scheme in ("", "file")
    uri = "file://" + urlsplit(path).path if local else path

    def put(batches):  # runs where this package may not be installed
        import uuid

        import pyarrow as pa
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        fs, top = FileSystem.from_uri(uri)
        fs.create_dir(top, recursive=True)
        task, n = TaskContext.get(), 0
        own, final = f"{top}/_{uuid.uuid4().hex}", f"{top}/part-{task.partitionId():05d}.dat"
        with fs.open_output_stream(own, compression=None) as f:
            for batch in batches:
                f.write(b"".join(batch.column(0).to_pylist()))
                n += batch.num_rows
        fs.move(own, final) if n else fs.delete_file(own)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return rows.mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0
