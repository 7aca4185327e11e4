"""Streams: the row-local operators, lookups and grouped aggregates over unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.core import aggregate_column, names_of, parse_aggregates
from ..schema.dml import unescape


def read_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None, watermark: str | None = None, delay: str | None = None, files_per_trigger: int | None = None, delimiter: str | None = None, header: bool = False) -> DataFrame:
    """Files that come into a folder, as a stream; rows later than delay after the watermark column's latest are dropped where state is kept."""
    r = spark.readStream.format("csv" if fmt in ("delimited", "csv") else fmt)
    if schema is not None:
        r = r.schema(schema)
    if delimiter:
        r = r.option("sep", unescape(delimiter))
    if header:
        r = r.option("header", True)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    df = r.load(path)
    if watermark:
        if isinstance(df.schema[watermark].dataType, T.TimestampNTZType):
            df = df.withColumn(watermark, F.col(watermark).cast("timestamp"))
        df = df.withWatermark(watermark, delay or "10 minutes")
    return df


def windowed_rollup(df: DataFrame, time: str, width: str, aggregates: str, group_by: str | None = None, slide: str | None = None, session: bool = False) -> DataFrame:
    """Aggregates by key and tumbling, sliding or session window, with window_start and window_end."""
    w = F.session_window(time, width) if session else F.window(time, width, slide) if slide else F.window(time, width)
    keys = names_of(group_by)
    out = df.groupBy(w.alias("__w"), *keys).agg(*[aggregate_column(c, df).alias(n) for n, c in parse_aggregates(aggregates)])
    return out.select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *[c for c in out.columns if c != "__w"])


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append", once: bool = True):
    """Writes a stream; once: all that is there now, then ends. The checkpoint makes restarts exact."""
    w = df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
    if once:
        w = w.trigger(availableNow=True)
    return w.start(path)
