"""URL filters: dated list entries become validity intervals, joined as of fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import LAST_ID, col, fresh, materialize

DAY_US = 86_400_000_000
#: A bucket of a level is this many of the level below; the topmost spans 5000 years and more.
BASE, LEVELS = 16, 5


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and a dot at the end; null if there is none."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    h = F.regexp_replace(h, r"\.+$", "")
    return F.when(h != "", h)


def suffixes(host: Column) -> Column:
    """host and its parent domains of two labels or more; a host of one label is its own."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    last = F.greatest(n - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))


def intervals(entries: DataFrame, domain_col: str = "domain", at_col: str = "at", active_col: str = "active") -> DataFrame:
    """(domain, since, until): when each domain is listed, in microseconds; until is exclusive.

    An entry says from when on its domain is listed (active true) or isn't. Of entries of
    one domain and instant, an active one wins. Null domains and instants are left out; a
    null active counts as false. The last entry's until is LAST_ID.
    """
    e = entries.select(F.lower(col(domain_col)).alias("domain"), F.unix_micros(col(at_col).cast("timestamp")).alias("since"), F.coalesce(col(active_col), F.lit(False)).alias("active"))
    e = e.where("domain IS NOT NULL AND since IS NOT NULL").groupBy("domain", "since").agg(F.max("active").alias("active"))
    # The next entry: within the day, else the first of the domain's next day with entries. So
    # the entries of one long-listed domain are dealt by day, and only its days meet.
    e = e.withColumn("day", F.expr(f"since DIV {DAY_US}"))
    days = e.groupBy("domain", "day").agg(F.min("since").alias("first"))
    days = days.select(F.col("domain").alias("nd"), F.col("day").alias("nday"), F.lead("first").over(Window.partitionBy("domain").orderBy("day")).alias("next"))
    e = e.withColumn("soon", F.lead("since").over(Window.partitionBy("domain", "day").orderBy("since")))
    e = e.where("active").join(days, (F.col("domain") == F.col("nd")) & (F.col("day") == F.col("nday")))
    return e.select("domain", "since", F.coalesce("soon", "next", F.lit(LAST_ID)).alias("until"))


def _div(x: Column, by: int) -> Column:
    """Whole numbers divided and rounded down, without a way through doubles."""
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def _at_level(buckets: Column, level: int) -> Column:
    return F.transform(buckets, lambda b: F.struct(F.lit(level).alias("level"), b.alias("bucket")))


def in_buckets(spans: DataFrame, bucket_days: int = 30) -> DataFrame:
    """spans(domain, since, until) with the buckets that make up each: level and bucket.

    A bucket of level 0 is bucket_days long and one of each further level BASE times as long.
    What lies between two buckets of a level is made of that level's, the ends of the one
    below, so that the longest interval is a few dozen rows, whatever the captures' times.
    """
    width = bucket_days * DAY_US
    first, last = _div(F.col("since"), width), _div(F.col("until") - 1, width)
    none = F.array().cast("array<bigint>")

    def run(a: Column, b: Column) -> Column:
        return F.when(a <= b, F.sequence(a, b)).otherwise(none)

    df = spans.withColumns({"f0": first, "l0": last})
    parts = []
    for level in range(LEVELS):
        f, last = F.col(f"f{level}"), F.col(f"l{level}")
        if level + 1 < LEVELS:
            df = df.withColumns({f"f{level + 1}": _div(f + (BASE - 1), BASE), f"l{level + 1}": _div(last + 1, BASE) - 1})
            up, down = F.col(f"f{level + 1}"), F.col(f"l{level + 1}")
            here = F.when(up > down, run(f, last)).otherwise(F.concat(run(f, up * BASE - 1), run((down + 1) * BASE, last)))
        else:
            here = run(f, last)
        parts.append(_at_level(here, level))
    return df.select("domain", "since", "until", F.explode(F.concat(*parts)).alias("x")).select("domain", "since", "until", "x.level", "x.bucket")


def listed(captures: DataFrame, entries: DataFrame, url_col: str = "url", at_col: str = "fetched", bucket_days: int = 30, domain_col: str = "domain", entry_at_col: str = "at", active_col: str = "active") -> DataFrame:
    """captures with listed_by: the longest domain on the list at fetch time, else null.

    A capture is under its host and each parent domain and stands in one bucket of time of
    each level; an interval is under its domain and the buckets that make it up. They meet
    by domain and bucket, so that neither a long list of one domain nor a hot host gathers in
    one task, and an outlying time costs nothing; a capture meets one interval of a domain
    at most.

    Null or hostless URLs and null fetch times are never listed. Repeated rows are kept, and
    so are columns of any name but listed_by. URLs of any length are read as a whole. No
    captures: no rows; no entries: nothing is listed.
    """
    key, its_key, found = fresh(captures, "_capture", "_its_capture", "_found")
    own = [c for c in captures.columns if c.lower() != "listed_by"]
    at = F.unix_micros(col(at_col).cast("timestamp"))
    # The verdict depends on host and instant alone, so it is found once for each of them.
    asked = captures.select(F.struct(host_of(col(url_col)).alias("host"), at.alias("at")).alias("q")).where("q.host IS NOT NULL AND q.at IS NOT NULL").distinct()
    spans = materialize(in_buckets(intervals(entries, domain_col, entry_at_col, active_col), bucket_days).select(F.col("domain").alias("d"), "since", "until", F.col("level").alias("l"), F.col("bucket").alias("b")))
    levels = sorted(r["l"] for r in spans.select("l").distinct().collect())  # LEVELS at most
    if not levels:
        return captures.select(*[col(c) for c in own], F.lit(None).cast("string").alias("listed_by"))
    stands = F.array(*[F.struct(F.lit(i).alias("level"), _div(F.col("q.at"), bucket_days * DAY_US * BASE**i).alias("bucket")) for i in levels])
    tried = asked.select("q", F.explode(suffixes(F.col("q.host"))).alias("domain"), stands.alias("stands")).select("q", "domain", F.explode("stands").alias("x"))
    met = tried.join(spans, (F.col("domain") == F.col("d")) & (F.col("x.level") == F.col("l")) & (F.col("x.bucket") == F.col("b")) & (F.col("q.at") >= F.col("since")) & (F.col("q.at") < F.col("until")))
    best = met.groupBy("q").agg(F.max(F.struct(F.length("domain").alias("n"), "domain")).alias("best")).select(F.struct(F.col("q.host").alias("h"), F.col("q.at").alias("t")).alias(its_key), F.col("best.domain").alias(found))
    rows = captures.select(*[col(c) for c in own], F.struct(host_of(col(url_col)).alias("h"), at.alias("t")).alias(key))
    return rows.join(best, F.col(key) == F.col(its_key), "left").select(*[col(c) for c in own], F.col(found).alias("listed_by"))
