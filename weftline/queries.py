"""Queries over the test tables, one or more for each operator, and their SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .expr import parse_blocks
from .importers import import_cobol, import_hive, import_xml
from .operators import core
from .plans.engine import Engine
from .plans.graph import Catalog, downstream_frame, parse_graph
from .schema.dml import parse_dml
from .schema.spec import struct_type
from .sources import files, mainframe
from .sources.shared import shared_dir
from .streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return put


def T(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def assigned(df: DataFrame, body: str, **more) -> DataFrame:
    block = next(iter(parse_blocks(f"TRANSFORM t BEGIN {body} END").values()))
    return core.reformat(df, block.assignments, **more)


def casts(df: DataFrame, **kinds: str) -> DataFrame:
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])


# -- rows


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def flagship_pricing_summary(spark, sf):
    df = core.filter_rows(T(spark, sf, "lineitem"), "l_shipdate <= string_to_datetime('1998-09-02', 'YYYY-MM-DD')")
    df = assigned(df, """out.l_returnflag = in.l_returnflag; out.l_linestatus = in.l_linestatus; out.qty = in.l_quantity; out.base = in.l_extendedprice;
        out.disc = in.l_extendedprice * (1 - in.l_discount); out.charge = out.disc * (1 + in.l_tax);""")
    out = core.rollup(df, "l_returnflag, l_linestatus", "sum(qty):sum_qty, sum(base):sum_base, sum(disc):sum_disc, sum(charge):sum_charge, count(*):n")
    return core.sort(out.select("l_returnflag", "l_linestatus", *[F.round(c, 2).alias(c) for c in ("sum_qty", "sum_base", "sum_disc", "sum_charge")], "n"), "l_returnflag, l_linestatus")


@query("SELECT o_orderkey, upper(o_orderpriority) AS priority, o_totalprice * 2 AS twice FROM orders")
def reformat_basic(spark, sf):
    out = assigned(T(spark, sf, "orders"), "out.o_orderkey = in.o_orderkey; out.priority = upper(in.o_orderpriority); out.twice = in.o_totalprice * 2;")
    return out


@query("SELECT o_orderkey, round(o_totalprice * 2, 2) AS a, round(o_totalprice * 2 + 1, 2) AS b, round((o_totalprice * 2 + 1) * 3, 2) AS c FROM orders")
def reformat_self_ref(spark, sf):
    out = assigned(T(spark, sf, "orders"), "out.o_orderkey = in.o_orderkey; out.a = in.o_totalprice * 2; out.b = out.a + 1; out.c = out.b * 3;")
    return out.select("o_orderkey", *[F.round(c, 2).alias(c) for c in "abc"])


@query("SELECT o_orderkey, CAST(NULL AS DOUBLE) AS discount, CAST(NULL AS INTEGER) AS n FROM orders")
def reformat_typed_null(spark, sf):
    schema = struct_type(parse_dml("DEFINE t BEGIN o_orderkey long; discount double; n integer; END")["t"])
    return assigned(T(spark, sf, "orders"), "out.o_orderkey = in.o_orderkey; out.discount = null; out.n = null;", schema=schema)


@query("""SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'GOLD' WHEN o_totalprice >= 100000 THEN 'SILVER' ELSE 'BRONZE' END AS tier,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS done, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END AS st FROM orders""")
def reformat_if_chain(spark, sf):
    return assigned(T(spark, sf, "orders"), """out.o_orderkey = in.o_orderkey;
        out.tier = if (in.o_totalprice >= 300000) "GOLD" else if (in.o_totalprice >= 100000) "SILVER" else "BRONZE";
        out.done = if in.o_orderstatus = "F" then 1 else 0; out.st = if(in.o_orderstatus = 'O', 'open', in.o_orderstatus);""")


@query("SELECT o_orderkey + 1 AS o_orderkey, o_orderkey AS before, o_orderkey + 1 AS after_ FROM orders")
def reformat_in_vs_out(spark, sf):
    return assigned(T(spark, sf, "orders"), "out.o_orderkey = in.o_orderkey + 1; out.before = in.o_orderkey; out.after_ = out.o_orderkey;")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 45 AND NOT l_returnflag = 'A' AND (l_discount < 0.03 OR l_tax >= 0.08)")
def filter_inline(spark, sf):
    out = core.filter_rows(T(spark, sf, "lineitem"), "l_quantity > 45 and not l_returnflag = 'A' && (l_discount < 0.03 || l_tax >= 0.08)")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 1000 AND c_mktsegment <> 'BUILDING'")
def filter_block(spark, sf):
    block = parse_blocks("FILTER f BEGIN CONDITION: in.c_acctbal > 1000.00 and in.c_mktsegment != \"BUILDING\"; END")["f"]
    return core.filter_rows(T(spark, sf, "customer"), block.condition).select("c_custkey", "c_acctbal")


@query("""WITH c AS (SELECT c_custkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer)
    SELECT c_custkey, seg FROM c WHERE NOT (seg = 'MACHINERY') OR seg IS NULL AND c_acctbal < 0""")
def filter_not_null_logic(spark, sf):
    df = T(spark, sf, "customer").select("c_custkey", "c_acctbal", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    return core.filter_rows(df, "not (seg = 'MACHINERY') or is_null(seg) and c_acctbal < 0").drop("c_acctbal")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name LIKE '%1%' AND c_acctbal BETWEEN 0 AND 5000 AND c_nationkey NOT IN (1, 2)")
def filter_in_like_between(spark, sf):
    return core.filter_rows(T(spark, sf, "customer"), "c_mktsegment in ('BUILDING', 'MACHINERY') and c_name like '%1%' and c_acctbal between 0 and 5000 and c_nationkey not in (1, 2)").select("c_custkey")


# -- joins

def _orders_customers(spark, sf):
    """Orders that aren't pending, and customers without debts: some of each have no match."""
    c = T(spark, sf, "customer", "c_custkey", "c_name", "c_acctbal").where("c_acctbal >= 0").drop("c_acctbal").withColumnRenamed("c_custkey", "o_custkey")
    o = T(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus").where("o_orderstatus <> 'P'").drop("o_orderstatus")
    return o, c


_OC = "WITH c AS (SELECT c_custkey AS o_custkey, c_name FROM customer WHERE c_acctbal >= 0), o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P') "
for _name, _how, _sql in (
    ("join_left", "left", "SELECT o.o_custkey, o_orderkey, c_name FROM o LEFT JOIN c ON o.o_custkey = c.o_custkey"),
    ("join_right", "right_outer", "SELECT c.o_custkey, o_orderkey, c_name FROM o RIGHT JOIN c ON o.o_custkey = c.o_custkey"),
    ("join_full", "full_outer", "SELECT coalesce(o.o_custkey, c.o_custkey) AS o_custkey, o_orderkey, c_name FROM o FULL JOIN c ON o.o_custkey = c.o_custkey"),
    ("join_semi", "semi", "SELECT o_custkey, o_orderkey FROM o WHERE o_custkey IN (SELECT o_custkey FROM c)"),
    ("join_anti", "anti", "SELECT o_custkey, o_orderkey FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM c)"),
):
    QUERIES[_name] = lambda spark, sf, how=_how: core.join(*_orders_customers(spark, sf), "o_custkey", how)
    ORACLE_SQL[_name] = _OC + _sql


@query("SELECT o_custkey, o_orderkey, o_totalprice, c_name, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf):
    c = T(spark, sf, "customer", "c_custkey", "c_name", "c_acctbal").withColumnRenamed("c_custkey", "o_custkey")
    return core.join(T(spark, sf, "orders", "o_custkey", "o_orderkey", "o_totalprice"), c, "o_custkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45 AND l_shipdate > o_orderdate)")
def join_exists(spark, sf):
    o = T(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_orderdate")
    return core.join(o, T(spark, sf, "lineitem", "l_orderkey", "l_quantity", "l_shipdate"), how="semi", on="l_orderkey = o_orderkey and l_quantity > 45 and l_shipdate > o_orderdate").drop("o_orderdate")


@query("SELECT s.l_partkey, s.l_suppkey, s.n, t.q FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) s JOIN (SELECT l_partkey, l_suppkey, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) t ON s.l_partkey = t.l_partkey AND s.l_suppkey = t.l_suppkey")
def join_composite(spark, sf):
    li = T(spark, sf, "lineitem")
    a = core.rollup(li, "l_partkey, l_suppkey", "count(*):n")
    b = core.rollup(core.filter_rows(li, "l_returnflag = 'R'"), "l_partkey, l_suppkey", "max(l_quantity):q")
    return core.join(a, b, "l_partkey, l_suppkey")


@query("SELECT a.r_regionkey, a.r_name, b.n_nationkey, b.n_name FROM region a CROSS JOIN nation b")
def join_cross(spark, sf):
    return core.join(T(spark, sf, "region"), T(spark, sf, "nation", "n_nationkey", "n_name"), how="cross")


@query("SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate AND l_extendedprice * 4 > o_totalprice")
def join_theta(spark, sf):
    li = T(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice")
    out = core.join(T(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_totalprice"), li, on="o_orderkey = l_orderkey and l_shipdate > o_orderdate and l_extendedprice * 4 > o_totalprice")
    return out.select("o_orderkey", "l_linenumber", "l_partkey")


@query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey <> 1")
def lookup_broadcast(spark, sf):
    n = T(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey").where("n_regionkey <> 1").drop("n_regionkey").withColumnRenamed("n_nationkey", "s_nationkey")
    return core.lookup(T(spark, sf, "supplier", "s_suppkey", "s_nationkey"), n, "s_nationkey").drop("s_nationkey")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
    SELECT c_custkey, o_orderkey FROM customer LEFT JOIN o ON c_custkey = o_custkey AND r = 1""")
def lookup_first_match(spark, sf):
    o = T(spark, sf, "orders", "o_custkey", "o_orderkey").withColumnRenamed("o_custkey", "c_custkey")
    return core.lookup(T(spark, sf, "customer", "c_custkey"), o, "c_custkey", match="first", sort_by="o_orderkey")


@query("SELECT o_orderkey, l_partkey, l_linenumber, o_totalprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 40")
def match_sorted(spark, sf):
    li = T(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity").where("l_quantity > 40").drop("l_quantity").withColumnRenamed("l_orderkey", "o_orderkey")
    return core.join(T(spark, sf, "orders", "o_orderkey", "o_totalprice"), li, "o_orderkey").select("o_orderkey", "l_partkey", "l_linenumber", "o_totalprice")


# -- aggregates


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS total, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(avg(l_discount), 6) AS mean, count(l_orderkey) AS n FROM lineitem GROUP BY 1, 2")
def rollup_multi(spark, sf):
    out = core.rollup(T(spark, sf, "lineitem"), "l_returnflag, l_linestatus", "sum(l_quantity):total, min(l_extendedprice):low, max(l_extendedprice):high, avg(l_discount):mean, count(l_orderkey):n")
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6)})


@query("SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY 1")
def rollup_default_count(spark, sf):
    return core.rollup(T(spark, sf, "orders"), "o_orderstatus")


@query("SELECT round(sum(o_totalprice), 1) AS total, count(*) AS n, max(o_orderkey) AS max_o_orderkey FROM orders")
def rollup_global(spark, sf):
    out = core.rollup(T(spark, sf, "orders"), None, "sum(o_totalprice):total, count(*):n, max(o_orderkey)")
    return out.withColumn("total", F.round("total", 1))


@query("SELECT l_shipdate_y AS y, CAST(sum(CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END) AS BIGINT) AS big, CAST(sum(l_linenumber * 2) AS BIGINT) AS twice FROM (SELECT *, CAST(year(l_shipdate) AS INTEGER) AS l_shipdate_y FROM lineitem) GROUP BY 1")
def rollup_conditional(spark, sf):
    return core.rollup(T(spark, sf, "lineitem").withColumn("y", F.year("l_shipdate")), "y", "sum(if(l_quantity >= 25, 1, 0)):big, sum(l_linenumber * 2):twice")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12 AND max(o_totalprice) > 100000")
def rollup_having(spark, sf):
    return core.rollup(T(spark, sf, "orders"), "o_custkey", "count(*):n", having="count(*) > 12 and max(o_totalprice) > 100000")


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def rollup_distinct(spark, sf):
    return core.rollup(T(spark, sf, "lineitem"), "l_returnflag", "count_distinct(l_suppkey):suppliers, countDistinct(l_partkey):parts")


@query("SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS sd, round(var_pop(c_acctbal), 2) AS vp, round(median(c_acctbal), 4) AS med, bool_or(c_acctbal < 0) AS debt FROM customer GROUP BY 1")
def rollup_stats(spark, sf):
    out = core.rollup(T(spark, sf, "customer"), "c_mktsegment", "stddev(c_acctbal):sd, var_pop(c_acctbal):vp, median(c_acctbal):med, bool_or(c_acctbal < 0):debt")
    return out.withColumns({"sd": F.round("sd", 4), "vp": F.round("vp", 2), "med": F.round("med", 4)})


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rollup_cube(spark, sf):
    return core.rollup(T(spark, sf, "lineitem"), "l_returnflag, l_linestatus", "count(*):n", sets="cube")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_sets(spark, sf):
    return core.rollup(T(spark, sf, "lineitem"), "l_returnflag, l_linestatus", "count(*):n", sets="rollup")


@query("SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS O, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS F FROM lineitem GROUP BY 1")
def rollup_pivot(spark, sf):
    out = core.rollup(T(spark, sf, "lineitem"), "l_returnflag", "sum(l_quantity):q", pivot="l_linestatus: O, F")
    return out.withColumns({c: F.round(c, 2) for c in ("O", "F")})


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_totalprice > 200000) AS dear, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS top_done, count(*) AS n FROM orders GROUP BY 1")
def rollup_filter_clause(spark, sf):
    return core.rollup(T(spark, sf, "orders"), "o_orderpriority", "count(*) filter (where o_totalprice > 200000):dear, max(o_totalprice) filter (where o_orderstatus = 'F'):top_done, count(*):n")


@query("SELECT o_custkey, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey), ',') AS keys FROM orders GROUP BY 1")
def denormalize_sorted(spark, sf):
    out = core.denormalize(T(spark, sf, "orders"), "o_custkey", "o_orderkey", sort_by="o_orderkey")
    return out.select("o_custkey", F.array_join(F.col("o_orderkey_list").cast("array<string>"), ",").alias("keys"))


# -- windows


@query("SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def scan_running_sum(spark, sf):
    out = core.scan(T(spark, sf, "events"), "user_id", "ts, event_id", "sum(value):running")
    return out.select("event_id", "user_id", F.round("running", 4).alias("running"))


@query("SELECT event_id, count(*) OVER w AS n, max(value) OVER w AS top, min(value) OVER w AS low FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def scan_multi_agg(spark, sf):
    return core.scan(T(spark, sf, "events"), "user_id, event_type", "ts, event_id", "count(*):n, max(value):top, min(value):low").select("event_id", "n", "top", "low")


@query("SELECT event_id, event_type, round(sum(value) OVER w, 3) AS running, count(*) OVER w AS n, min(value) OVER w AS low FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def scan_in_chunks(spark, sf):
    out = core.scan_chunked(T(spark, sf, "events"), "event_type", "ts, event_id", "sum(value):running, count(*):n, min(value):low", 16)
    return out.select("event_id", "event_type", F.round("running", 3).alias("running"), "n", "low")


@query("SELECT event_id, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER w AS INTEGER) AS rk, lag(event_id, 1) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def scan_ranks(spark, sf):
    return core.scan(T(spark, sf, "events"), "user_id", "ts, event_id", "row_number():rn, rank():rk, lag(event_id, 1):before").select("event_id", "rn", "rk", "before")


@query("SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS volume FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)")
def window_rolling_24h(spark, sf):
    out = assigned(T(spark, sf, "events"), """out.event_id = in.event_id;
        out.n = window_count(partition_by = user_id, order_by = ts, range = "-24h to current");
        out.volume = window_sum(expr = value, partition_by = user_id, order_by = ts, range = "-24h to current");""")
    return out.withColumn("volume", F.round("volume", 4))


# -- order and duplicates


@query("SELECT event_id, ts, value FROM events ORDER BY value DESC, event_id DESC")
def sort_desc(spark, sf):
    return core.sort(T(spark, sf, "events", "event_id", "ts", "value"), "value, event_id", "desc")


@query("SELECT user_id, event_id, value FROM events ORDER BY user_id, value")
def sort_within_groups(spark, sf):
    return core.sort_within_groups(T(spark, sf, "events", "user_id", "event_id", "value"), "user_id", "value, event_id")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 100")
def top_k(spark, sf):
    return core.limit(T(spark, sf, "events", "event_id", "value"), 100, "value desc, event_id")


for _name, _which, _order in (("dedup_first", "first", "ts, event_id"), ("dedup_last", "last", "ts DESC, event_id DESC")):
    QUERIES[_name] = lambda spark, sf, which=_which: core.dedup(T(spark, sf, "events", "user_id", "event_id", "ts", "value"), "user_id", which, "ts, event_id").select("user_id", "event_id", "value")
    ORACLE_SQL[_name] = f"SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_order}) AS r FROM events) WHERE r = 1"


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1)")
def dedup_unique(spark, sf):
    return core.dedup(T(spark, sf, "orders", "o_custkey", "o_orderkey"), "o_custkey", "unique")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def dedup_all(spark, sf):
    return core.dedup(T(spark, sf, "orders", "o_orderstatus", "o_orderpriority"))


# -- sets and vectors


@query("SELECT c_name AS name, c_acctbal AS bal, c_mktsegment AS seg FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def gather_missing_cols(spark, sf):
    c = T(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    s = T(spark, sf, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_name").alias("name"))
    return core.gather(c, s)


@query("SELECT c_name AS name, 0 AS src FROM customer UNION ALL SELECT s_name, 1 FROM supplier UNION ALL SELECT n_name, 2 FROM nation")
def concatenate(spark, sf):
    parts = [T(spark, sf, t).select(F.col(c).alias("name")) for t, c in (("customer", "c_name"), ("supplier", "s_name"), ("nation", "n_name"))]
    return core.gather(*parts, ordered=True).withColumnRenamed("__src_ord", "src")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf):
    return core.set_operation(T(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), T(spark, sf, "supplier", "s_nationkey"), "intersect", distinct=True)


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def set_except(spark, sf):
    return core.set_operation(T(spark, sf, "nation").select(F.col("n_nationkey").alias("k")), T(spark, sf, "supplier").where("s_acctbal > 9000").select("s_nationkey"), "except", distinct=True)


_FAN = """<graph name="fan"><component id="a" type="InputFile"><property name="filename" value="${DIR}/orders.parquet"/><port name="out"/></component>
<component id="b" type="Replicate"><port name="in" source="a.out"/></component>
<component id="c" type="Filter"><property name="condition" value="o_orderstatus = 'F'"/><port name="in" source="b.out"/></component>
<component id="d" type="Filter"><property name="condition" value="o_totalprice < 50000"/><port name="in" source="b.out"/></component>
<component id="e" type="Gather"><port name="in0" source="c.out"/><port name="in1" source="d.out"/></component></graph>"""


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice < 50000")
def replicate_fanout(spark, sf):
    return Engine.from_text(_FAN, params={"DIR": sf}).bind(spark)["e"].select("o_orderkey", "o_orderstatus")


@query("SELECT vec_id, label, CAST(unnest(embedding) AS FLOAT) AS x FROM embeddings")
def normalize_explode(spark, sf):
    return core.normalize(T(spark, sf, "embeddings"), "embedding", "x")


@query("SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, CAST(unnest(embedding) AS FLOAT) AS x FROM embeddings")
def normalize_posexplode(spark, sf):
    return core.normalize(T(spark, sf, "embeddings", "vec_id", "embedding"), "embedding", "x", outer=True, index="pos")


# -- functions


@query("""SELECT c_custkey, CAST(length(c_name) AS INTEGER) AS n, upper(c_mktsegment) AS u, lower(c_name) AS l, substring(c_name, 3, 5) AS s, c_name || '/' || c_mktsegment AS j,
    replace(c_name, '0', 'o') AS r, trim('  ' || c_mktsegment || ' ') AS t, ltrim('  ' || c_mktsegment) AS lt, rtrim(c_mktsegment || '  ') AS rt FROM customer""")
def fn_string(spark, sf):
    return assigned(T(spark, sf, "customer"), """out.c_custkey = in.c_custkey; out.n = string_length(in.c_name); out.u = upper(in.c_mktsegment); out.l = lower(in.c_name); out.s = substring(in.c_name, 3, 5);
        out.j = in.c_name + "/" + in.c_mktsegment; out.r = replace(in.c_name, "0", "o"); out.t = trim("  " + in.c_mktsegment + " "); out.lt = ltrim("  " + in.c_mktsegment); out.rt = rtrim(in.c_mktsegment + "  ");""")


@query("SELECT c_custkey, s IS NULL AS is_n, s IS NOT NULL AS not_n, coalesce(s, c_name) AS c, ifnull(s, 'none') AS v FROM (SELECT *, nullif(c_mktsegment, 'BUILDING') AS s FROM customer)")
def fn_null(spark, sf):
    df = T(spark, sf, "customer").withColumn("s", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return assigned(df, "out.c_custkey = in.c_custkey; out.is_n = is_null(in.s); out.not_n = is_not_null(in.s); out.c = coalesce(in.s, in.c_name); out.v = nvl(in.s, 'none');")


@query("SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, round(sqrt(abs(c_acctbal)), 6) AS q FROM customer")
def fn_numeric(spark, sf):
    return assigned(T(spark, sf, "customer"), "out.c_custkey = in.c_custkey; out.a = abs(in.c_acctbal); out.r = round(in.c_acctbal, 1); out.f = floor(in.c_acctbal); out.c = ceiling(in.c_acctbal); out.q = round(sqrt(abs(in.c_acctbal)), 6);")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS d, CAST(p_size AS VARCHAR) AS s, TRY_CAST(p_name AS INTEGER) AS bad, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS m, CAST(p_size AS BIGINT) AS b FROM part")
def fn_cast(spark, sf):
    out = assigned(T(spark, sf, "part"), "out.p_partkey = in.p_partkey; out.d = double(in.p_size); out.s = string(in.p_size); out.bad = integer(in.p_name); out.m = decimal(in.p_retailprice, 12, 2); out.b = cast(in.p_size as bigint);")
    return casts(out, m="double")


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, CAST(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS VARCHAR) AS back, CAST(NULL AS VARCHAR) AS bad FROM orders")
def fn_date_parse(spark, sf):
    df = T(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("a"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("b"))
    out = assigned(df, 'out.o_orderkey = in.o_orderkey; out.d = string_to_date(in.a, "YYYYMMDD"); out.back = date_format(string_to_datetime(in.b, "YYYY-MM-DD HH:MM:SS"), "YYYY-MM-DD HH24:MI:SS"); out.bad = to_date("99/99/9999", "DD/MM/YYYY");')
    return casts(out, d="string", bad="string")


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(hour(o_orderdate) AS INTEGER) AS h, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM orders")
def fn_date_parts(spark, sf):
    return assigned(T(spark, sf, "orders"), "out.o_orderkey = in.o_orderkey; out.y = year(in.o_orderdate); out.m = month(in.o_orderdate); out.d = day(in.o_orderdate); out.h = date_part(in.o_orderdate, 'hour'); out.days = date_diff(in.o_orderdate, to_date('1992-01-01', 'YYYY-MM-DD'), 'days');")


@query("SELECT c_custkey, ltrim(' ' || c_name) AS a, upper(c_name) AS b, coalesce(NULL, c_name) AS c, abs(c_acctbal) AS d, round(c_acctbal, 0) AS e, CAST(c_custkey % 7 AS BIGINT) AS f, CAST(CAST(DATE '2024-01-31' + CAST(c_custkey % 40 AS INTEGER) AS DATE) AS VARCHAR) AS g FROM customer")
def fn_alias_rewrites(spark, sf):
    out = assigned(T(spark, sf, "customer"), "out.c_custkey = in.c_custkey; out.a = trim_leading(' ' + in.c_name); out.b = to_upper(in.c_name); out.c = coalesce_first(null, in.c_name); out.d = abs_value(in.c_acctbal); out.e = round_to(in.c_acctbal, 0); out.f = mod(in.c_custkey, 7); out.g = date_add_days(to_date('2024-01-31', 'YYYY-MM-DD'), integer(mod(in.c_custkey, 40)));")
    return casts(out, g="string")


@query("SELECT c_custkey, least(greatest(c_acctbal, 0), 5000) AS clamped FROM customer")
def fn_minmax_scalar(spark, sf):
    return casts(assigned(T(spark, sf, "customer"), "out.c_custkey = in.c_custkey; out.clamped = min(5000, max(0, in.c_acctbal));"), clamped="double")


@query("SELECT event_id, CAST(CAST(date_trunc('day', ts) AS DATE) AS VARCHAR) AS d, strftime(ts, '%Y-%m') AS m FROM events")
def fn_date_trunc_format(spark, sf):
    schema = struct_type(parse_dml("DEFINE t BEGIN event_id long; d date; m string; END")["t"])
    return casts(assigned(T(spark, sf, "events"), "out.event_id = in.event_id; out.d = date_trunc(in.ts, 'day'); out.m = date_format(in.ts, 'YYYY-MM');", schema=schema, conform=True), d="string")


@query("SELECT c_custkey, CAST((c_custkey - 700) % 7 AS BIGINT) AS m, replace(c_name, '.', '#') AS r FROM customer")
def fn_mod_replace(spark, sf):
    return assigned(T(spark, sf, "customer"), "out.c_custkey = in.c_custkey; out.m = mod(in.c_custkey - 700, 7); out.r = replace(in.c_name, '.', '#');")


@query("SELECT c_custkey, CAST(NULL AS DOUBLE) AS zero, CAST(NULL AS INTEGER) AS over, regexp_replace(c_name, '[0-9]+', 'N') AS own FROM customer")
def fn_safe_and_passthrough(spark, sf):
    return assigned(T(spark, sf, "customer"), "out.c_custkey = in.c_custkey; out.zero = in.c_acctbal / 0; out.over = integer(99999999999); out.own = regexp_replace(in.c_name, '[0-9]+', 'N');")


@query("SELECT o_orderkey, strftime(o_orderdate, '%I:%M:%S %p') AS shown, CAST(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS VARCHAR) AS back, CAST(strftime(o_orderdate, '%d.%m.%y') AS VARCHAR) AS short FROM orders")
def fn_date_twelve_hours(spark, sf):
    return assigned(T(spark, sf, "orders", "o_orderkey", "o_orderdate"), """out.o_orderkey = in.o_orderkey; out.shown = date_format(in.o_orderdate, 'HH:MI:SS AM');
        out.back = date_format(string_to_datetime(date_format(in.o_orderdate, 'DD/MM/YYYY HH12:MI:SS PM'), 'DD/MM/YYYY HH:MI:SS PM'), 'YYYY-MM-DD HH24:MI:SS'); out.short = date_format(in.o_orderdate, 'DD.MM.YY');""")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, md5(event_type) AS digest, reverse(event_type) AS turned FROM events")
def fn_json_and_hash(spark, sf):
    return assigned(T(spark, sf, "events"), "out.event_id = in.event_id; out.k = bigint(get_json_object(in.props, '$.k')); out.digest = md5(in.event_type); out.turned = reverse(in.event_type);")


# -- files


_STORED = """<graph name="stored"><component id="x" type="InputFile"><property name="filename" value="${DIR}/orders.parquet"/></component>
<component id="kept" type="IntermediateFile"><property name="filename" value="${OUT}/between"/><property name="file_format" value="orc"/><port name="in" source="x.out"/></component>
<component id="few" type="Reformat"><property name="transform_file" value="few.xfr"/><port name="in" source="kept.out"/></component>
<component id="none" type="Trash"><port name="in" source="kept.out"/></component>
<component id="end" type="OutputFile"><property name="filename" value="${OUT}/end"/><port name="in" source="few.out"/></component></graph>"""


@query("SELECT o_orderkey, o_totalprice, o_orderpriority || '~' AS marked FROM orders")
def checkpoint_roundtrip(spark, sf):
    """A run with an intermediate file, a Trash, and a parameter in the transform."""
    out = shared_dir(spark)
    transform = "TRANSFORM few BEGIN out.o_orderkey = in.o_orderkey; out.o_totalprice = in.o_totalprice; out.marked = in.o_orderpriority + '${MARK}'; END"
    report = Engine.from_text(_STORED, transforms=transform, params={"DIR": sf.rstrip("/"), "OUT": out, "MARK": "~"}).run(spark)
    assert set(report.sinks) == {"none", "end"}
    return spark.read.parquet(f"{out}/end")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def partitioned_write_read(spark, sf):
    path = shared_dir(spark)
    files.write(T(spark, sf, "orders", "o_orderkey", "o_totalprice", "o_orderstatus"), path, partition_by=["o_orderstatus"], coalesce=2)
    return spark.read.parquet(path).where("o_orderstatus = 'F'")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def append_write_read(spark, sf):
    path, n = shared_dir(spark), T(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
    files.write(n.drop("n_regionkey"), path, "orc")
    files.write(n.where("n_regionkey = 1").drop("n_regionkey"), path, "orc", mode="append", coalesce=1)
    return files.read(spark, path, "orc")


@query("SELECT c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DOUBLE) AS c_acctbal FROM customer")
def delimited_roundtrip(spark, sf):
    record = parse_dml(r"""DEFINE customer BEGIN c_custkey long; c_name string("\001"); c_mktsegment string("\001", null("NA")); c_acctbal decimal(12,2); END""")["customer"]
    df = T(spark, sf, "customer").select("c_custkey", "c_name", F.when(F.col("c_mktsegment") == "BUILDING", "NA").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.col("c_acctbal").cast("decimal(12,2)").alias("c_acctbal"))
    path = shared_dir(spark)
    files.write(df, path, "delimited", delimiter=r"\001", header=True)
    return casts(files.read(spark, path, "delimited", record, r"\001", header=True), c_acctbal="double")


@query("SELECT c_custkey, c_name, CAST(CAST(c_acctbal AS DECIMAL(10,2)) AS DOUBLE) AS c_acctbal, CAST(CAST(DATE '2024-01-01' + CAST(c_custkey % 365 AS INTEGER) AS DATE) AS VARCHAR) AS d FROM customer")
def fixed_width_roundtrip(spark, sf):
    record = parse_dml('DEFINE c BEGIN c_custkey decimal(12,0); c_name string(30); c_acctbal decimal(14,2); d date("YYYYMMDD"); END')["c"]
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int")), "yyyyMMdd")
    lines = T(spark, sf, "customer").select(F.concat(F.lpad(F.col("c_custkey").cast("string"), 12, " "), F.rpad("c_name", 30, " "), F.lpad(F.col("c_acctbal").cast("decimal(10,2)").cast("string"), 14, " "), day).alias("value"))
    path = shared_dir(spark)
    lines.write.text(path)
    return casts(files.read(spark, path, "fixed", record), c_custkey="bigint", c_acctbal="double", d="string")


@query("SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer")
def mixed_delim_read(spark, sf):
    record = parse_dml(r"""DEFINE c BEGIN decimal("|") c_custkey; string(";") c_name; string(12) c_mktsegment; decimal("\n") c_nationkey; END""")["c"]
    lines = T(spark, sf, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit("|"), "c_name", F.lit(";"), F.rpad("c_mktsegment", 12, " "), F.col("c_nationkey").cast("string")).alias("value"))
    path = shared_dir(spark)
    lines.write.text(path)
    return casts(files.read(spark, path, "mixed", record), c_custkey="bigint", c_nationkey="int")


@query("SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(9,2)) AS DOUBLE) AS v FROM customer")
def packed_decimal_read(spark, sf):
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    b = F.unhex(F.concat(F.lpad(F.abs(cents).cast("string"), 9, "0"), F.when(cents < 0, "D").otherwise("C")))
    df = T(spark, sf, "customer").select("c_custkey", b.alias("b"))
    return df.select("c_custkey", mainframe.packed(F.col("b"), 2).cast("double").alias("v"))


_CUSTOMER_BOOK = """01 CUSTOMER-CARD.
 03 C-CUSTKEY PIC 9(12) COMP.
 03 C-NAME PIC X(24).
 03 C-NATIONKEY PIC S9(3) SIGN TRAILING SEPARATE.
 03 FILLER PIC X(2).
 03 C-ACCTBAL PIC S9(9)V99 COMP-3.
 03 CENTS PIC S9(9) COMP.
 03 ZONED PIC S9(7)V99.
 03 C-MKTSEGMENT PIC N(12)."""


@query("SELECT c_custkey, c_name, c_nationkey, CAST(CAST(c_acctbal AS DECIMAL(11,2)) AS DOUBLE) AS c_acctbal, CAST(round(c_acctbal * 100) AS BIGINT) AS cents, CAST(CAST(c_acctbal AS DECIMAL(11,2)) AS DOUBLE) AS zoned, c_mktsegment FROM customer")
def mainframe_read(spark, sf):
    """customer in EBCDIC records of a copybook, written and read again."""
    record = import_cobol(_CUSTOMER_BOOK, encoding="ebcdic")[0]
    c = T(spark, sf, "customer").withColumns({"cents": F.round(F.col("c_acctbal") * 100), "zoned": F.col("c_acctbal")})
    path = shared_dir(spark)
    mainframe.write_mainframe(c, path, record)
    out = files.read(spark, path, "mainframe", record)
    return casts(out, c_custkey="bigint", c_nationkey="int", c_acctbal="double", cents="bigint", zoned="double")


@query("SELECT n_nationkey, substring(rpad(n_name, 12, ' '), 1, 4) AS head, rtrim(substring(rpad(n_name, 12, ' '), 5, 8)) AS tail FROM nation")
def cobol_redefines_read(spark, sf):
    """The second layout of redefined fields over ASCII records."""
    whole, parts = import_cobol("01 N. 02 N-NATIONKEY PIC 9(3). 02 N-NAME PIC X(12). 02 HALVES REDEFINES N-NAME. 03 HEAD PIC X(4). 03 TAIL PIC X(8).", redefines=True, encoding="ascii")
    path = shared_dir(spark)
    mainframe.write_mainframe(T(spark, sf, "nation"), path, whole)
    out = files.read(spark, path, "mainframe", parts).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "halves.*")
    return out


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag AS flag, CASE WHEN l_returnflag = 'R' THEN CAST(round(l_quantity) AS INTEGER) END AS returned, CASE WHEN l_returnflag <> 'R' THEN l_linestatus || l_returnflag END AS status FROM lineitem")
def conditional_fields_read(spark, sf):
    """Lines of fixed width with a field whose meaning depends on another one."""
    record = parse_dml('DEFINE line BEGIN l_orderkey decimal(12,0); l_partkey decimal(12,0); l_suppkey decimal(12,0); l_linenumber decimal(3,0); flag string(1); if (flag == "R") then returned decimal(3,0); else status string(3); end; END')["line"]
    one = next(f for f in record.fields if f.name == "returned")
    assert one.offset is not None
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, " ")
    quantity = F.lpad(F.round("l_quantity").cast("int").cast("string"), 3, " ")
    both = F.concat(F.when(F.col("l_returnflag") == "R", quantity).otherwise("   "), F.rpad(F.concat("l_linestatus", "l_returnflag"), 3, " "))
    path = shared_dir(spark)
    T(spark, sf, "lineitem").select(F.concat(pad("l_orderkey", 12), pad("l_partkey", 12), pad("l_suppkey", 12), pad("l_linenumber", 3), F.col("l_returnflag"), both).alias("value")).write.text(path)
    out = files.read(spark, path, "fixed", record)
    return casts(out, l_orderkey="bigint", l_partkey="bigint", l_suppkey="bigint", l_linenumber="int", returned="int")


@query("SELECT o_orderkey, l_partkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def nested_records_read(spark, sf):
    """Orders with a vector of records, as JSON of a schema with a nested record, and flattened again."""
    record = parse_dml("DEFINE ord BEGIN head record o_orderkey long; o_orderstatus string(1); end; lines record l_partkey long; l_linenumber integer; l_quantity double; end[]; END")["ord"]
    li = T(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_linenumber", "l_quantity")).alias("lines"))
    o = T(spark, sf, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.struct("o_orderkey", "o_orderstatus").alias("head"), "lines")
    path = shared_dir(spark)
    files.write(o, path, "json")
    back = files.read(spark, path, "json", record)
    return core.normalize(back, "lines", "line", flatten=True).select(F.col("head.o_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber", "l_quantity")


@query("SELECT n_nationkey AS no, n_name AS title, n_regionkey AS part FROM nation")
def xml_read(spark, sf):
    """nation as XML, read by the schema that a sample of it gives."""
    record, mode = import_xml('<nation no="7"><title>Some Land</title><part>2</part></nation>')
    path = shared_dir(spark)
    n = T(spark, sf, "nation").select(F.col("n_nationkey").alias("_no"), F.col("n_name").alias("title"), F.col("n_regionkey").alias("part"))
    n.write.format("xml").option("rowTag", "nation").save(path)
    out = files.read(spark, path, "xml", record, options={"rowTag": "nation", "attributePrefix": ""})
    assert mode == "sample"
    return casts(out, no="int", part="int")


@query("SELECT s_suppkey, s_nationkey, CAST(CAST(s_acctbal AS DECIMAL(10,2)) AS DOUBLE) AS s_acctbal FROM supplier")
def xsd_read(spark, sf):
    """supplier as XML, read by an XSD with a restricted decimal and an attribute."""
    xsd = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="supplier"><xs:complexType><xs:all><xs:element name="s_nationkey" type="xs:int"/><xs:element name="s_acctbal" type="Money"/></xs:all>
        <xs:attribute name="s_suppkey" type="xs:long" use="required"/></xs:complexType></xs:element><xs:simpleType name="Money"><xs:restriction base="xs:decimal"><xs:totalDigits value="10"/><xs:fractionDigits value="2"/></xs:restriction></xs:simpleType></xs:schema>"""
    record, mode = import_xml(xsd)
    path = shared_dir(spark)
    s = T(spark, sf, "supplier").select(F.col("s_suppkey").alias("_s_suppkey"), "s_nationkey", F.col("s_acctbal").cast("decimal(10,2)").alias("s_acctbal"))
    s.write.format("xml").option("rowTag", "supplier").save(path)
    assert mode == "xsd"
    return casts(files.read(spark, path, "xml", record, options={"rowTag": "supplier", "attributePrefix": ""}), s_acctbal="double")


@query("SELECT p_partkey, p_name, p_size, CAST(CAST(p_retailprice AS DECIMAL(9,2)) AS DOUBLE) AS p_retailprice FROM part")
def hive_table_read(spark, sf):
    """Text of a Hive table's delimiter, in the format that is advised for the imported record."""
    table = import_hive(r"CREATE TABLE shop.parts (p_partkey BIGINT, p_name STRING, p_size INT, p_retailprice DECIMAL(9,2)) ROW FORMAT DELIMITED FIELDS TERMINATED BY '\037' STORED AS TEXTFILE")
    p = T(spark, sf, "part").select("p_partkey", "p_name", "p_size", F.col("p_retailprice").cast("decimal(9,2)").alias("p_retailprice"))
    path = shared_dir(spark)
    files.write(p, path, files.recommend_format(table.record)[0], delimiter=table.delimiter)
    return casts(files.reader_for(spark, table.record, path, delimiter=table.delimiter), p_retailprice="double")


@query("SELECT c_custkey, c_name, TRY_CAST(c_mktsegment AS INTEGER) AS c_mktsegment, CAST(NULL AS VARCHAR) AS bad FROM customer UNION ALL SELECT NULL, NULL, NULL, r_name FROM region")
def mixed_lines_that_do_not_fit(spark, sf):
    """Lines that a mixed record doesn't fit stay as rows, with the line in a column of its own."""
    record = parse_dml(r"""DEFINE c BEGIN decimal("|") c_custkey; string(";") c_name; decimal("\n") c_mktsegment; END""")["c"]
    lines = T(spark, sf, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit("|"), "c_name", F.lit(";"), "c_mktsegment").alias("value"))
    path = shared_dir(spark)
    lines.unionByName(T(spark, sf, "region").select(F.col("r_name").alias("value"))).write.text(path)
    out = files.read(spark, path, "mixed", record, options={"columnNameOfCorruptRecord": "bad"})
    return casts(out, c_custkey="bigint", c_mktsegment="int")


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    """Events as a stream of files, in tumbling windows of a day, written as they close and at the end."""
    base, events = shared_dir(spark), T(spark, sf, "events", "event_id", "ts", "event_type", "value")
    late = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("bigint").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 900 DAYS")).alias("ts"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    events.repartition(2).write.parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema

    def once():
        stream = streams.read_stream(spark, f"{base}/in", schema=schema, watermark="ts", delay="400 days")
        out = streams.windowed_rollup(stream, "ts", "1 day", "count(*):n, sum(value):total", "event_type")
        streams.write_stream(out, f"{base}/out", f"{base}/state").awaitTermination()

    once()
    late.write.mode("append").parquet(f"{base}/in")  # moves the watermark past all windows
    once()
    out = spark.read.parquet(f"{base}/out").where("event_type <> 'end'")
    return out.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("day"), "n", F.round("total", 4).alias("total"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000")
def catalog_roundtrip(spark, sf):
    """A graph saved in a catalog and run from there, with a parameter in its condition."""
    text = """<graph name="dear"><component id="a" type="InputFile"><property name="filename" value="${DIR}/orders.parquet"/></component>
        <component id="b" type="Filter"><property name="condition" value="o_totalprice > ${LEAST}"/><port name="in" source="a.out"/></component></graph>"""
    with tempfile.TemporaryDirectory() as folder:  # of the driver alone
        catalog = Catalog(folder)
        catalog.save("dear", parse_graph(text, {"DIR": sf.rstrip("/"), "LEAST": "150000"}))
        graph = catalog.load("dear")
    return Engine(graph).bind(spark)["b"].select("o_orderkey", "o_totalprice")


@query()
def sample_rows(spark, sf):
    return core.sample(T(spark, sf, "orders", "o_orderkey", "o_totalprice"), 0.3, 7)


# -- graphs


_FREIGHT = """<graph name="late_freight"><parameters><param name="FEW" value="20"/></parameters>
<component id="lines" name="Lines" type="InputFile"><property name="filename" value="-"/></component>
<component id="sent" type="Filter"><property name="condition" value="l_returnflag != 'N' or l_linestatus = 'F'"/><port name="in" source="lines.out"/></component>
<component id="line" type="Reformat"><property name="transform_file" value="line.xfr"/><port name="in" source="sent.out"/></component>
<component id="makers" name="Makers" type="LookupFile"><property name="filename" value="-"/></component>
<component id="from" type="Lookup"><property name="key" value="maker"/><port name="in" source="line.out"/><port name="in_lookup" source="makers.out"/></component>
<component id="lands" name="Lands" type="InputFile"><property name="filename" value="-"/></component>
<component id="met" type="MatchSorted"><property name="key" value="land"/><port name="in_left" source="from.out"/><port name="in_right" source="lands.out"/></component>
<component id="sums" type="Rollup"><property name="group_by" value="part, quarter"/><property name="aggregates" value="sum(net):net, count(*) filter (where winter):cold, max(weight):heaviest"/><property name="having" value="count(*) &gt; ${FEW}"/><port name="in" source="met.out"/></component>
<component id="told" type="Reformat"><property name="transform_file" value="told"/><port name="in" source="sums.out"/></component></graph>"""
_FREIGHT_XFR = """
TRANSFORM line BEGIN out.maker = in.l_suppkey; out.net = in.l_extendedprice - in.l_extendedprice * in.l_discount; out.weight = in.l_quantity * 1.5;
  out.quarter = bigint(floor((month(in.l_shipdate) + 2) / 3)); out.winter = month(in.l_shipdate) in (12, 1, 2); END
TRANSFORM told BEGIN out.label = string(in.part) + "Q" + string(in.quarter); out.net = round(in.net, 1); out.cold = in.cold; out.heaviest = in.heaviest;
  out.season = case in.quarter when 1 then "ice" when 3 then "sun" else "rain" end; END"""


@query("""WITH m AS (SELECT n_regionkey AS part, CAST(floor((month(l_shipdate) + 2) / 3.0) AS BIGINT) AS quarter, l_extendedprice * (1 - l_discount) AS net, l_quantity * 1.5 AS weight, month(l_shipdate) IN (12, 1, 2) AS winter
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_returnflag <> 'N' OR l_linestatus = 'F'),
    s AS (SELECT part, quarter, sum(net) AS net, count(*) FILTER (WHERE winter) AS cold, max(weight) AS heaviest FROM m GROUP BY 1, 2 HAVING count(*) > 20)
    SELECT part || 'Q' || quarter AS label, round(net, 1) AS net, cold, heaviest, CASE quarter WHEN 1 THEN 'ice' WHEN 3 THEN 'sun' ELSE 'rain' END AS season FROM s""")
def pipeline_late_freight(spark, sf):
    makers = T(spark, sf, "supplier").select(F.col("s_suppkey").alias("maker"), F.col("s_nationkey").alias("land"))
    lands = T(spark, sf, "nation").select(F.col("n_nationkey").alias("land"), F.col("n_regionkey").alias("part"))
    return Engine.from_text(_FREIGHT, transforms=_FREIGHT_XFR).bind(spark, {"Lines": T(spark, sf, "lineitem"), "Makers": makers, "Lands": lands})["told"]


_PULSE = """<graph name="pulse"><parameters><param name="PAUSE" value="7"/></parameters>
<component id="clicks" name="Clicks" type="InputFile"><property name="filename" value="-"/></component>
<component id="hourly" type="Reformat"><property name="transform" value="hourly"/><port name="in" source="clicks.out"/></component>
<component id="last" type="DedupSorted"><property name="key" value="who, kind, hour_"/><property name="which" value="last"/><property name="sort_by" value="at, no"/><port name="in" source="hourly.out"/></component>
<component id="pace" type="Scan"><property name="key" value="who"/><property name="sort_by" value="at, no"/><property name="aggregates" value="lag(at, 1):before, count(*):nth, max(amount):record"/><port name="in" source="last.out"/></component>
<component id="pause" type="Reformat"><property name="transform_file" value="pause"/><property name="window_partition" value="who"/><property name="window_order" value="at"/><property name="window_range" value="-36h"/><port name="in" source="pace.out"/></component>
<component id="long" type="FilterByExpression"><property name="condition" value="rest &gt;= ${PAUSE} or rest is null"/><port name="in" source="pause.out"/></component></graph>"""
_PULSE_XFR = """
TRANSFORM hourly BEGIN out.no = in.event_id; out.who = in.user_id; out.kind = lower(substring(in.event_type, 1, 3)); out.at = in.ts; out.hour_ = date_format(in.ts, "YYYYMMDDHH24"); out.amount = in.value; END
TRANSFORM pause BEGIN out.no = in.no; out.kind = in.kind; out.nth = in.nth; out.record = in.record; out.rest = date_diff(in.at, in.before, "hours"); out.recent = window_count(); END"""


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY user_id, lower(substring(event_type, 1, 3)), date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) AS r FROM events),
    p AS (SELECT event_id AS no, lower(substring(event_type, 1, 3)) AS kind, ts, user_id, lag(ts) OVER w AS before, count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS nth, max(value) OVER (w ROWS UNBOUNDED PRECEDING) AS record FROM d WHERE r = 1 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    q AS (SELECT no, kind, nth, record, CAST(floor((epoch_us(ts) - epoch_us(before)) / 3600000000.0) AS BIGINT) AS rest, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 36 HOURS PRECEDING AND CURRENT ROW) AS recent FROM p)
    SELECT * FROM q WHERE rest >= 7 OR rest IS NULL""")
def pipeline_user_pulse(spark, sf):
    return Engine.from_text(_PULSE, transforms=_PULSE_XFR).bind(spark, {"Clicks": T(spark, sf, "events")})["long"]


@query("""WITH RECURSIVE e(s, t) AS (SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || r_regionkey, 'all' FROM region),
    r(origin, reached) AS (SELECT s, t FROM e UNION SELECT r.origin, e.t FROM r JOIN e ON r.reached = e.s) SELECT origin, reached FROM r""")
def lineage_downstream(spark, sf):
    """The closure of a graph as large as the data: customer to nation, to region, to all."""
    edge = lambda t, a, p, b, q: T(spark, sf, t).select(F.concat(F.lit(p), F.col(a).cast("string")).alias("source"), (F.concat(F.lit(q), F.col(b).cast("string")) if b else F.lit(q)).alias("target"))
    edges = edge("customer", "c_custkey", "c", "c_nationkey", "n").unionByName(edge("nation", "n_nationkey", "n", "n_regionkey", "r")).unionByName(edge("region", "r_regionkey", "r", None, "all"))
    return downstream_frame(edges)


@query("SELECT * FROM (VALUES (0, 'lands'), (1, 'lines'), (2, 'makers'), (3, 'sent'), (4, 'line'), (5, 'from'), (6, 'met'), (7, 'sums'), (8, 'told')) AS v(position, node)")
def topo_order(spark, sf):
    return spark.createDataFrame(list(enumerate(parse_graph(_FREIGHT).order())), "position int, node string")


@query("""SELECT * FROM (VALUES ('c','id','bigint',false), ('c','name','string',true), ('c','bal','decimal(10,2)',true), ('c','tags','array<string>',true), ('hive','berth_no','bigint',true),
    ('hive','fee','decimal(12,3)',true), ('hive','crew','struct<item:array<string>>',true), ('hive','quay','string',true), ('cobol','gate','decimal(5,0)',true), ('cobol','toll','decimal(9,2)',true),
    ('dml','at','struct<deg:double,side:string>',true), ('dml','legs','array<struct<knots:int>>',true), ('dml','built','date',true), ('dml','log','timestamp',true), ('xsd','depth','decimal(6,1)',true), ('xsd','marks','array<int>',false)) AS v(record, field, type, nullable)""")
def schema_catalog(spark, sf):
    records = {"c": parse_dml('DEFINE c BEGIN id integer(8) NOT NULL; name string(20); bal decimal(10,2); string("|")[] tags; END')["c"]}
    records["hive"] = import_hive("CREATE TABLE h (berth_no BIGINT, fee DECIMAL(12,3), crew ARRAY<STRING>) PARTITIONED BY (quay STRING)").record
    records["cobol"] = import_cobol("01 GATES.\n 05 GATE PIC 9(5).\n 05 TOLL PIC S9(7)V99 COMP-3.")[0]
    records["dml"] = parse_dml('DEFINE ship BEGIN at record deg double; side string(1); end; legs record knots integer; end[]; built date("DDMMYYYY"); log datetime; END')["ship"]
    records["xsd"] = import_xml('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="cast"><xs:complexType><xs:sequence><xs:element name="depth" minOccurs="0"><xs:simpleType><xs:restriction base="xs:decimal"><xs:totalDigits value="6"/><xs:fractionDigits value="1"/></xs:restriction></xs:simpleType></xs:element><xs:element name="marks" type="xs:int" maxOccurs="unbounded"/></xs:sequence></xs:complexType></xs:element></xs:schema>')[0]
    rows = [(n, f.name, f.dataType.simpleString(), f.nullable) for n, r in records.items() for f in struct_type(r).fields]
    return spark.createDataFrame(rows, "record string, field string, type string, nullable boolean")
