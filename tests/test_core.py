"""Expressions, schemas, importers, graphs and the engine, on rows and values."""

import datetime as dt
from collections import Counter
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.api import Catalog, Engine, compile_expression, emit_dml, explain_dml, import_cobol, import_hive, import_xml, parse_blocks, parse_dml, parse_graph, recommend_format, register_function, struct_type, to_struct_type
from weftline.expr import ExprError, ParseError
from weftline.functions.formats import spark_format
from weftline.importers import record_bytes
from weftline.operators import core
from weftline.operators.core import OperatorError
from weftline.plans.graph import GraphError
from weftline.schema.spec import FieldSpec, RecordSpec, SchemaError, with_layout
from weftline.sources import files, mainframe
from weftline.streaming import streams


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([(1, "abc", 2.5, dt.datetime(2024, 1, 31, 7), None)], "a int, s string, d double, t timestamp, z string")


def value(df, text, **more):
    return df.select(compile_expression(text, df, **more).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("10 - 2 - 3", 5), ("7 / 2", 3.5), ("-a + 3", 2), ("s + '!'", "abc!"), ("'n=' + a + s", "n=1abc"), ("s + ' x' + s", "abc xabc"),
        ("a = 1", True), ("a == 1 && d > 2 || false", True), ("not a = 1", False), ("!(a = 1)", False), ("z = 'x'", None), ("is_null(z) and is_not_null(s)", True),
        ("if (a > 0) 'p' else 'n'", "p"), ("if a > 5 then 1 else if a > 0 then 2 else 3", 2), ("if(a > 0, 1, 2)", 1), ("case when a = 2 then 'x' else 'y' end", "y"), ("case a when 1 then 'x' end", "x"),
        ("substring(s, 2, 2)", "bc"), ("mod(-7, 3)", -1), ("a / 0", None), ("integer('zz')", None), ("decimal('12.345', 5, 2)", Decimal("12.35")), ("cast('7' as int) + 1", 8), ("bigint(a) + 1", 2),
        ("min(100, max(0, d))", 2.5), ("date_diff(t, to_date('2024-01-01', 'YYYY-MM-DD'), 'days')", 30), ("date_format(t, 'YYYY-MM')", "2024-01"), ("year(t)", 2024), ("date_part(t, 'hour')", 7),
        ("to_date('31/01/2024', 'DD/MM/YYYY')", dt.date(2024, 1, 31)), ("to_date('nonsense', 'YYYY-MM-DD')", None), ("note", None), ("a in (1, 2) and s like 'a%' and d between 2 and 3", True), ("z is null", True),
        ("2147483647 + a", None), ("'it''s'", "it's"), ('"tab\\t\\101"', "tab\tA"), ("sha1(s)", "a9993e364706816aba3e25717850c26c9cd0d89d"), ("a -- comment\n + 1 /* two */ // three", 2), ("s = 1", None),
    ],
)
def test_expression(row, text, want):
    df = row.withColumn("note", F.lit(None).cast("string"))
    assert value(df, text) == want


@pytest.mark.parametrize("text", ["1 +", "(1", "a b", "in.nothing", "out.x", "nofield", "substring(s)", "@", "window_sum(d)"])
def test_bad_expression(row, text):
    with pytest.raises((ParseError, ExprError)):
        value(row, text)


def test_clock_and_own_function(row):
    now = dt.datetime(2020, 5, 17, 1, 2, 3)
    assert value(row, "current_datetime()", clock=now) == now and value(row, "current_date()", clock=now) == now.date()
    register_function("twice", lambda c: c * 2, 1, 1, "number")
    assert value(row, "twice(a) + 1") == 3


def test_blocks(row):
    blocks = parse_blocks("TRANSFORM t BEGIN out.a = in.a + 1; out.b = out.a * 2; out.c = in.a; out.n = null; END\nFILTER f BEGIN CONDITION: a > 0; END\nx = 1;\nout.y = 2;")
    assert list(blocks) == ["t", "f", "__bare_1"]
    assert tuple(core.reformat(row, blocks["t"].assignments).first()) == (2, 4, 1, None)
    assert tuple(core.reformat(row, blocks["__bare_1"].assignments).first()) == (1, 2)
    assert core.filter_rows(row, blocks["f"].condition).count() == 1


@settings(max_examples=40, deadline=None)
@given(st.recursive(st.integers(-50, 50).map(str), lambda x: st.tuples(x, st.sampled_from("+-*"), x).map(lambda p: f"({p[0]} {p[1]} {p[2]})"), max_leaves=8))
def test_arithmetic_is_that_of_python(spark, text):
    want = eval(text)
    got = value(spark.range(1), text)
    assert got == want or got is None and abs(want) > 2**31 - 1


@pytest.mark.parametrize(("picture", "want"), [("YYYY-MM-DD HH:MM:SS", "yyyy-MM-dd HH:mm:ss"), ("YYYY-MM-DD HH24:MI:SS.mmm", "yyyy-MM-dd HH:mm:ss.SSS"), ("YYYYMMDDHHMMSS", "yyyyMMddHHmmss"), ("DD-MMM-YY", "dd-MMM-yy"), ("HH:MI:SS AM", "hh:mm:ss a"), ("DD/MM/YYYY HH:MI PM", "dd/MM/yyyy hh:mm a"), ("HH24:MI", "HH:mm"), ("YYYY-MM-DD HH:MM:SS.FF", "yyyy-MM-dd HH:mm:ss.SSS")])
def test_formats(picture, want):
    assert spark_format(picture) == want


def test_hours_of_twelve(row):
    assert value(row, "string_to_datetime('2024-03-09 01:30:00 PM', 'YYYY-MM-DD HH:MI:SS AM')") == dt.datetime(2024, 3, 9, 13, 30)
    assert value(row, "date_format(t, 'HH:MI PM')") == "07:00 AM"


# -- schemas


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('record string(";") station; decimal(";") height; string("\n") remark; end;', "struct<station:string,height:decimal(38,0),remark:string>"),
        ("DEFINE tide BEGIN gauge string(6) NOT NULL; millis integer(8); flags integer(1); level decimal(7, 3) NULL; day date; END", "struct<gauge:string,millis:bigint,flags:tinyint,level:decimal(7,3),day:date>"),
        ("record record decimal(4) deg; string(1) side; end longitude; end", "struct<longitude:struct<deg:decimal(4,0),side:string>>"), ("record group double wind; end weather; end", "struct<weather:struct<wind:double>>"),
        ('record string(";")[] crew; double[7] week; string("|")[][] board; end', "struct<crew:array<string>,week:array<double>,board:array<array<string>>>"),
        ("record record boolean ok; end[2] checks; record long hash; } [int] blocks; end", "struct<checks:array<struct<ok:boolean>>,blocks:array<struct<hash:bigint>>>"),
        ("DEFINE ship BEGIN hull record beam decimal(5, 2); end hull NOT NULL; decks record name string; end[]; END", "struct<hull:struct<beam:decimal(5,2)>,decks:array<struct<name:string>>>"),
        ("record integer stops; record string(5) port; } calls[stops]; end", "struct<stops:int,calls:array<struct<port:string>>>"),
        ("type buoy = record float lat; end; metadata type = record buoy home; buoy[int] others; end;", "struct<home:struct<lat:float>,others:array<struct<lat:float>>>"),
        ("record packed decimal(11,4) toll; ebcdic string(9) pier; binary(16) key; double x; float(8) y; end", "struct<toll:decimal(11,4),pier:string,key:binary,x:double,y:double>"),
        ('record decimal(".3") depth; decimal("999.9") draught; date("DDMMYYYY") built; datetime("DD/MM/YYYY HH24:MI") left; end', "struct<depth:decimal(38,3),draught:decimal(4,1),built:date,left:timestamp>"),
        ('#define BAR "|"\nrecord string(BAR) mast; string(${W}) sail; end', "struct<mast:string,sail:string>"), ('utf8 record string("\\002") knot; end;', "struct<knot:string>"),
        ('record integer(2) kind; if (kind == 4) then float speed; else long pings; end; end', "struct<kind:smallint,speed:float,pings:bigint>"),
    ],
)
def test_schema(text, want):
    assert to_struct_type(text, params={"W": "7"}).simpleString() == want


@pytest.mark.parametrize("text", ["record union { } u; end", "record variant v; end", 'record string("") a; end', "record string(2) a;", "record items[abc] string; end", "record string(2)[abc] a; end", "record nothing(2) a; end", "record if type == 1 then integer a; end; end", "record decimal(4,6) d; end", "record integer a; integer a; end", "record if (a == 1) if (b == 2) integer c; end; end; end"])
def test_bad_schema(text):
    with pytest.raises(SchemaError):
        parse_dml(text)


def test_layout_and_resolution():
    r = parse_dml("DEFINE lamp BEGIN code string(3) NOT NULL; lit boolean; range_ decimal(6); packed decimal(9,1) hours; since date; END")["lamp"]
    assert (r.layout, r.record_length, [f.offset for f in r.fields]) == ("fixed", 25, [0, 3, 4, 10, 15])
    assert parse_dml('record decimal(8) a; string(";") b; end')["record_1"].layout == "mixed"
    assert parse_dml('record decimal(";") a; string("\\n") b; end')["record_1"].layout == "delimited"
    several = parse_dml("DEFINE lock_up BEGIN a integer; END DEFINE lock_down BEGIN b integer; END DEFINE weir BEGIN c integer; END")
    from weftline.schema.spec import resolve

    assert resolve(several, "lock_down.dml").name == "lock_down" and resolve(several, "we.dml").name == "weir" and resolve(several, "weir_old").name == "weir"
    for name in ("lock", "lock.dml", "other"):
        with pytest.raises(SchemaError, match="may be any|no schema"):
            resolve(several, name)
    assert explain_dml("record union u; end")["ok"] is False and explain_dml("record integer a; end")["ok"]
    assert to_struct_type('record decimal(";") a; date("X") d; end', lossy=True).simpleString() == "struct<a:double,d:string>"
    assert len(parse_dml("record " + " ".join(f"double f{i};" for i in range(64)) + " end")["record_1"].fields) == 64


_scalars = st.sampled_from([("string", (20,)), ("string", ()), ("integer", (8,)), ("integer", ()), ("decimal", (10, 2)), ("double", ()), ("date", ()), ("datetime", ())])
_names = st.lists(st.sampled_from([f"f{i}" for i in range(12)]), min_size=1, max_size=5, unique=True)


@st.composite
def _fields(draw, depth=0):
    out = []
    for name in draw(_names):
        dims = draw(st.sampled_from([(), (), (None,), (3,), (2, None)]))
        common = {"dims": dims, "nullable": draw(st.booleans()), "annotations": draw(st.sampled_from([(), (("style", "element"),)]))}
        if depth < 2 and draw(st.integers(0, 4)) == 0:
            out.append(FieldSpec(name, "record", fields=draw(_fields(depth + 1)), **common))
        else:
            kind, args = draw(_scalars)
            extra = {"delimiter": draw(st.sampled_from([None, "|", "\x01", "\n", '"', "\\"])), "null_indicator": draw(st.sampled_from([None, "NA"])), "default": draw(st.sampled_from([None, "x y", 3]))} if kind == "string" else {}
            out.append(FieldSpec(name, kind, args, **extra, **common))
    return tuple(out)


@settings(max_examples=120, deadline=None)
@given(_fields())
def test_emitted_schemas_parse_back(fields):
    r = with_layout(RecordSpec("r", fields))
    assert parse_dml(emit_dml(r))["r"].fields == r.fields


def test_conditions_are_emitted():
    text = 'record\n  integer(2) kind;\n  if (kind == 4) then\n    float speed;\n  else\n    string(2) side;\n  end;\nend r;'
    r = parse_dml(text)["r"]
    assert parse_dml(emit_dml(r))["r"].fields == r.fields


# -- importers


def test_hive():
    t = import_hive("""CREATE TEMPORARY EXTERNAL TABLE harbour.moorings (berth SMALLINT, agent STRING, vessel CHAR(12) COMMENT 'as painted', fee DECIMAL(14,3), wet BOOLEAN, crew ARRAY<STRUCT<rank:TINYINT,born:DATE>>,
        papers MAP<INT,DOUBLE>, seen TIMESTAMP) COMMENT 'x' PARTITIONED BY (quay STRING) CLUSTERED BY (berth) INTO 4 BUCKETS ROW FORMAT DELIMITED FIELDS TERMINATED BY '\\073' STORED AS TEXTFILE LOCATION 'far/away' TBLPROPERTIES ('k'='v');""")
    assert struct_type(t.record).simpleString() == "struct<berth:smallint,agent:string,vessel:string,fee:decimal(14,3),wet:tinyint,crew:struct<item:array<struct<rank:tinyint,born:date>>>,papers:struct<map_entries:array<struct<key:int,value:double>>>,seen:timestamp,quay:string>"
    assert t.delimiter == ";" and t.record.field("agent").delimiter == ";" and t.record.field("vessel").args == (12,) and t.partitions == ("quay",) and t.location == "far/away"
    assert parse_dml(t.dml)["moorings"].field("fee").args == (14, 3)
    assert import_hive("CREATE TABLE t (`wind speed` FLOAT, gust FLOAT, x VARCHAR(9)) STORED AS ORC").renames == {"wind speed": "wind_speed"}
    for bad in ("CREATE TABLE t (a UNIONTYPE<float,date>)", "CREATE TABLE t AS SELECT 1", "CREATE TABLE t LIKE u", "ALTER TABLE t", "CREATE VIEW v AS SELECT 1", "CREATE TABLE t (a STRUCT<>)", "CREATE TABLE t (a INT, A INT)", "CREATE TABLE t (a DECIMAL(4,6))", "DROP TABLE t", "CREATE TABLE t (a MONEY)", "CREATE TABLE t (a VARCHAR(0))"):
        with pytest.raises(SchemaError):
            import_hive(bad)


LOCK_PASSAGE = """
000100* one row for each passage of a lock
       01  PASSAGE.
           03  LOCK-CODE          PIC A(03).
           03  PASSED-AT.
               05  DAY-NO         PIC 9(07) COMP.
               05  MINUTE-NO      PIC S9(04) BINARY.
           03  FILLER             PIC X.
           03  TOLL               PIC S9(06)V9(03) USAGE PACKED-DECIMAL.
           88  FREE-OF-TOLL VALUE ZERO.
           03  DRIFT              PIC S9(02)V9 SIGN TRAILING SEPARATE.
           03  SKIPPER            PIC N(6).
           03  BARGES             PIC S9(03) OCCURS 2 TIMES.
           03  FILLER             PIC X(02).
"""


def test_cobol():
    r = import_cobol(LOCK_PASSAGE)[0]
    assert [f.name for f in r.fields] == ["lock_code", "passed_at", "filler_1", "toll", "drift", "skipper", "barges", "filler_2"]
    assert r.field("toll").encoding == "packed" and r.notes and [f.offset for f in r.fields] == [0, 3, 9, 10, 15, 19, 31, 37]
    assert r.record_length == record_bytes(r) == 39
    vague = import_cobol("01 T. 02 N PIC 9. 02 X PIC X(4) OCCURS 0 TO 9 TIMES DEPENDING ON N.")[0]
    assert vague.field("x").depends_on == "n" and vague.layout != "fixed"
    with pytest.raises(SchemaError):
        record_bytes(vague)
    assert len(import_cobol("01 FLAG PIC X.\n01 B.\n 02 C PIC 9(3).")) == 2 and import_cobol("77 GATE-NO PIC 9(2).")[0].fields[0].name == "gate_no"
    assert import_cobol("01 R. COPY TAIL.", lambda n: "02 Z PIC X(7).")[0].fields[0].name == "z"
    both = import_cobol("01 R. 02 WHOLE PIC X(6). 02 HALVES REDEFINES WHOLE. 03 L PIC X(3). 03 M PIC 9(3). 02 E PIC X.", redefines=True)
    assert [[f.name for f in r.fields] for r in both] == [["whole", "e"], ["halves", "e"]] and both[1].name == "r__halves" and both[1].record_length == both[0].record_length == 7
    for bad in ("01 R. 02 A PIC Z(3)9.", "01 R. 02 A USAGE POINTER.", "01 R. 02 A PIC X. 02 A PIC 9.", "01 R. COPY TAIL.", "01 R. 05 A PIC X. 03 B PIC X.", "01 R. 02 A."):
        with pytest.raises(SchemaError):
            import_cobol(bad)


@pytest.mark.parametrize(("picture", "n"), [("9(4) COMP", 2), ("9(5) COMP", 4), ("S9(9) COMP-5", 4), ("9(10) BINARY", 8), ("S9(4)V99 COMP-3", 4), ("S9(5) SIGN LEADING SEPARATE", 6), ("S9(5)", 5), ("N(3)", 6), ("X(8)", 8)])
def test_lengths_of_cobol_fields(picture, n):
    r = import_cobol(f"01 R. 02 A PIC {picture}. 02 B PIC X(2).")[0]
    assert r.record_length == record_bytes(r) == n + 2 and r.field("b").offset == n
    assert import_cobol("01 R. 02 A COMP-1. 02 B COMP-2.")[0].record_length == 12


def test_xml():
    r, mode = import_xml('<log keeper="4"><weather>fog</weather><watch><bell>2.5</bell><bell>3</bell></watch><sighting sure="y">gull</sighting></log>')
    assert mode == "sample" and struct_type(r).simpleString() == "struct<keeper:decimal(38,0),weather:string,watch:struct<bell:array<decimal(38,1)>>,sighting:struct<sure:string,_value:string>>"
    xsd = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:simpleType name="Fathoms"><xs:restriction base="xs:decimal"><xs:totalDigits value="6"/><xs:fractionDigits value="1"/></xs:restriction></xs:simpleType><xs:element name="cast" type="Cast"/><xs:complexType name="Cast"><xs:sequence><xs:element name="line" type="Fathoms" minOccurs="0"/><xs:choice><xs:element name="mud" type="xs:boolean"/><xs:element name="sand" type="xs:short"/></xs:choice><xs:element name="shell" type="xs:double" maxOccurs="9"/><xs:element name="at"><xs:complexType><xs:simpleContent><xs:extension base="xs:dateTime"><xs:attribute name="zone" type="xs:token" use="required"/></xs:extension></xs:simpleContent></xs:complexType></xs:element></xs:sequence><xs:attribute name="no" type="xs:unsignedShort" use="required"/></xs:complexType></xs:schema>'
    r, mode = import_xml(xsd)
    assert mode == "xsd" and struct_type(r).simpleString() == "struct<line:decimal(6,1),mud:boolean,sand:smallint,shell:array<double>,at:struct<_value:timestamp,zone:string>,no:int>"
    assert not r.field("no").nullable and r.field("line").nullable and r.field("mud").nullable
    for bad in ("<a>", "", '<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>'):
        with pytest.raises(SchemaError):
            import_xml(bad)


# -- operators


def test_operator_errors(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y")], "k int, v string")
    for bad in (lambda: core.join(a, b, "k"), lambda: core.join(a, b, "nope"), lambda: core.join(a, b, "k", "sideways"), lambda: core.join(a, b), lambda: core.dedup(a, "k", "some"), lambda: core.dedup(a, "k", "last"), lambda: core.sort(a, "k", "up"), lambda: core.scan(a, "k", aggregates="count(*):n"), lambda: core.gather(a, b.withColumn("v", F.lit(1))), lambda: core.gather(), lambda: core.normalize(a, "v"), lambda: core.rollup(a, "k", "nothing(v):n")):
        with pytest.raises((OperatorError, ExprError)):
            bad()
    assert core.join(a, b, "k", suffix="_r").columns == ["k", "v", "v_r"]


def test_orders_and_hints(spark):
    rows = [(i % 3, (i * 37) % 11 if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, v int").repartition(4)
    got = [tuple(r) for r in core.sort(df, "v, g", "desc").collect()]
    assert got == sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]), reverse=True)
    up = [tuple(r) for r in core.sort(df, "g, v desc").collect()]
    assert [r[0] for r in up] == sorted(r[0] for r in rows) and all(up[i][1] is None or (up[i - 1][1] is not None and up[i - 1][1] >= up[i][1]) for i in range(1, 40) if up[i][0] == up[i - 1][0])
    within = [[r["v"] for r in part] for part in core.sort_within_groups(df, "g", "v").rdd.glom().map(lambda p: [x for x in p if x["g"] == 1]).collect() if part]
    assert len(within) == 1 and within[0] == sorted(within[0], key=lambda v: (v is not None, v or 0))
    other = spark.range(100_000).select(F.col("id").cast("int").alias("g"), F.col("id").alias("w"))
    plan = core.join(df, other, "g", broadcast="right")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan and core.limit(df, 2, "v desc").count() == 2 and 0 < core.sample(other, 0.1).count() < 20_000


def test_null_keys_and_vectors(spark):
    df = spark.createDataFrame([(None, 1, [1, 2]), (None, 2, None), (1, 3, []), (2, 4, [5])], "k int, v int, xs array<int>")
    assert Counter(r["v"] for r in core.dedup(df, "k", "unique").collect()) == Counter([3, 4])
    assert Counter(r["v"] for r in core.dedup(df, "k", "last", "v").collect()) == Counter([2, 3, 4])
    assert core.normalize(df, "xs").columns == ["k", "v", "xs"] and core.normalize(df, "xs").count() == 3 and core.normalize(df, "xs", "x", outer=True, index="i").count() == 5
    nested = df.select("v", F.array(F.struct(F.lit(1).alias("p"), F.lit("q").alias("q"))).alias("items"))
    assert core.normalize(nested, "items", flatten=True).columns == ["v", "p", "q"]


@pytest.mark.parametrize("order", ["t, v", "t desc, v"])
def test_scan_in_chunks_equals_scan(spark, order):
    rows = [(i % 3 if i % 11 else None, (i * 7919) % 101 if i % 13 else None, i, None if i % 5 == 0 else i % 17) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, t int, v int, x int")
    spec = "sum(x):s, count(x):c, count(*):n, min(x):lo, max(x):hi"
    assert Counter(map(tuple, core.scan_chunked(df, "k", order, spec, 7).collect())) == Counter(map(tuple, core.scan(df, "k", order, spec).collect()))


def test_plans_are_the_optimizers(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    out = core.rollup(core.filter_rows(core.reformat(li, parse_blocks("TRANSFORM t BEGIN out.q = in.l_quantity; out.k = in.l_orderkey; END")["t"].assignments), "q > 45"), "k", "sum(q):q")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity" in plan and "l_shipdate" not in plan and "Python" not in plan
    dated = core.filter_rows(li, "l_shipdate <= to_timestamp('1995-01-01', 'YYYY-MM-DD')")
    assert "LessThanOrEqual(l_shipdate" in dated._jdf.queryExecution().executedPlan().toString()


# -- graphs and engine

GAUGES = """<graph name="gauges"><parameters><param name="FLOOD" value="4.5"/></parameters>
<component id="last" type="DedupSorted"><property name="key" value="gauge, minute"/><property name="which" value="last"/><property name="sort_by" value="arrived"/><port name="in" source="src.out"/></component>
<component id="src" name="Readings" type="InputFile"><property name="filename" value="${IN}"/><property name="schema" value="reading"/><port name="out"/></component>
<component id="peak" type="Scan"><property name="key" value="gauge"/><property name="sort_by" value="minute"/><property name="aggregates" value="max(metres):so_far, row_number():nth"/><port name="in" source="metric.out"/></component>
<component id="metric" type="Reformat"><property name="transform" value="metric"/><port name="in" source="last.out"/></component>
<component id="flood" type="FilterByExpression"><property name="condition" value="so_far >= ${FLOOD}"/><port name="in" source="peak.out"/></component>
<component id="alarms" name="Alarms" type="OutputFile"><property name="filename" value="${OUT}"/><property name="partition_by" value="gauge"/><port name="in" source="flood.out"/></component>
<component id="rest" type="Trash"><port name="in" source="metric.out"/></component>
<connections><edge from="flood" to="alarms"/></connections></graph>"""
GAUGES_DML = "DEFINE reading BEGIN gauge string(4) NOT NULL; minute integer; feet decimal(6,2); arrived integer; END"
GAUGES_XFR = "TRANSFORM metric BEGIN out.gauge = in.gauge; out.minute = in.minute; out.metres = round(double(in.feet) * 0.3048, 3); out.note = if (in.feet < 0) 'below datum' else null; END"


def gauge_rows(spark, folder):
    rows = [("kew", 1, "10.00", 1), ("kew", 1, "11.00", 3), ("kew", 1, "9.00", 2), ("kew", 2, "15.50", 4), ("kew", 3, "2.00", 5), ("dee", 1, "-1.00", 6), ("dee", 2, "3.00", 7)]
    schema = struct_type(parse_dml(GAUGES_DML)["reading"])
    spark.createDataFrame([(g, m, Decimal(f), a) for g, m, f, a in rows], schema).write.parquet(str(folder))


def test_graph_with_two_sinks(spark, tmp_path):
    gauge_rows(spark, tmp_path / "in")
    e = Engine.from_text(GAUGES, GAUGES_DML, GAUGES_XFR, params={"IN": str(tmp_path / "in"), "OUT": str(tmp_path / "out")})
    assert e.validate() == []
    report = e.run(spark, parallel=2)
    assert report.persisted == ["metric"] and set(report.sinks) == {"alarms", "rest"} and report.to_frame(spark).count() > 4
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["gauge"], r["minute"], r["metres"], r["so_far"], r["nth"]) for r in got.collect()} == {("kew", 2, 4.724, 4.724, 2), ("kew", 3, 0.61, 4.724, 3)}
    assert e.run(spark, outputs={"Alarms": str(tmp_path / "other")}).sinks and spark.read.parquet(str(tmp_path / "other")).count() == 2
    assert "Window" in e.explain(spark)["alarms"]


FREIGHT = """<graph name="freight"><parameters><param name="DOP" value="3"/><param name="HEAVY" value="12"/></parameters>
<component id="boxes" type="InputFile"><property name="filename" value="${DIR}/boxes.txt"/><property name="file_format" value="mixed"/><property name="schema" value="box.dml"/></component>
<component id="piers" type="LookupFile"><property name="filename" value="${DIR}/piers.csv"/><property name="file_format" value="delimited"/><property name="delimiter" value="|"/><property name="has_header" value="true"/><property name="schema" value="pier.dml"/></component>
<component id="known" type="Filter"><property name="transform_file" value="weighed"/><port name="in" source="boxes.out"/></component>
<component id="placed" type="Lookup"><property name="key" value="pier"/><port name="in" source="known.out"/><port name="in_lookup" source="piers.out"/></component>
<component id="stored" type="IntermediateFile"><property name="filename" value="${DIR}/stored"/><port name="in" source="placed.out"/></component>
<component id="dues" type="Reformat"><property name="transform_file" value="dues"/><property name="schema" value="due"/><port name="in" source="stored.out"/></component>
<component id="by_side" type="Rollup"><property name="group_by" value="side"/><property name="aggregates" value="sum(due):dues, count(*) filter (where tonnes &gt; ${HEAVY}):heavy, max(tonnes):most"/><port name="in" source="dues.out"/></component>
<component id="rows" type="Denormalize"><property name="group_by" value="pier"/><property name="collect" value="box"/><property name="sort_by" value="box"/><port name="in" source="dues.out"/></component>
<component id="o1" type="OutputFile"><property name="filename" value="${DIR}/sides"/><port name="in" source="by_side.out"/></component>
<component id="o2" type="OutputFile"><property name="filename" value="${DIR}/rows"/><property name="mode" value="append"/><port name="in" source="rows.out"/></component></graph>"""
FREIGHT_DML = """DEFINE box BEGIN string(6) box; decimal("@") tonnes; string(";") pier; date("DDMMYYYY") landed; END
DEFINE pier BEGIN pier string("|"); side string("|"); rate decimal("|"); END
DEFINE due BEGIN box string; pier string; side string; tonnes decimal(10,1); due decimal(12,2); week integer; END"""
FREIGHT_XFR = """FILTER weighed BEGIN CONDITION: is_not_null(in.tonnes) and in.tonnes > 0; END
TRANSFORM dues BEGIN out.box = trim(in.box); out.pier = in.pier; out.side = coalesce(in.side, "?"); out.tonnes = in.tonnes; out.due = if (is_null(in.rate)) 0 else in.tonnes * in.rate;
  out.week = date_diff(in.landed, to_date("01012024", "DDMMYYYY"), "days") / 7; END"""


def test_graph_with_lookup_and_stored_file(spark, tmp_path, monkeypatch):
    (tmp_path / "boxes.txt").write_text("BX0001 20@north;15012024\nBX0002 4@south;16012024\nBX0003@north;16012024\nBX0004 13@nowhere;29022024\nBX0005 1@north;01012024\n")
    (tmp_path / "piers.csv").write_text("pier|side|rate\nnorth|left|3\nsouth|right|5\neast|right|9\n")
    writes = []
    monkeypatch.setattr(files, "write", lambda df, path, *a, _real=files.write, **k: (writes.append(path), _real(df, path, *a, **k)))
    e = Engine.from_text(FREIGHT, FREIGHT_DML, FREIGHT_XFR, params={"DIR": str(tmp_path)})
    assert e.bind(spark)["dues"].columns == ["box", "pier", "side", "tonnes", "due", "week"] and e.explain(spark) and not writes
    report = e.run(spark)
    assert report.persisted == ["dues"] and writes.count(f"{tmp_path}/stored") == 1
    sides = {tuple(r) for r in spark.read.parquet(str(tmp_path / "sides")).collect()}
    assert sides == {("left", Decimal("63.00"), 1, Decimal("20.0")), ("right", Decimal("20.00"), 0, Decimal("4.0")), ("?", Decimal("0.00"), 1, Decimal("13.0"))}
    rows = {r["pier"]: r["box_list"] for r in spark.read.parquet(str(tmp_path / "rows")).collect()}
    assert rows == {"north": ["BX0001", "BX0005"], "south": ["BX0002"], "nowhere": ["BX0004"]}
    e.run(spark)
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 6


def test_unknown_settings(spark):
    text = '<graph><component id="a" type="InputFile"><property name="filename" value="x"/></component><component id="b" type="Sort"><property name="kye" value="k"/><property name="option.x" value="1"/><port name="in" source="a.out"/></component></graph>'
    assert Engine.from_text(text).validate() == ["b: Sort has no setting 'kye'"] and Engine.from_text(text, strict=False).validate() == []
    unset = Engine.from_text('<graph><component id="a" type="InputFile"><property name="filename" value="${NOWHERE}/x"/></component></graph>')
    assert unset.validate() == [] and unset.unset() == ["a: parameter NOWHERE of 'filename' isn't set"]
    with pytest.raises(GraphError, match="NOWHERE"):
        unset.bind(spark)


def test_pivot_and_filtered_aggregates(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "x", 5), ("b", "y", 7), ("b", None, 9)], "k string, p string, v int")
    assert {tuple(r) for r in core.rollup(df, "k", "sum(v):s", pivot="p: x, y").collect()} == {("a", 6, 2), ("b", None, 7)}
    got = core.rollup(df, "k", "sum(v) filter (where p = 'x'):s, count(*) filter (where v > 4):n, max(v):m")
    assert {tuple(r) for r in got.collect()} == {("a", 6, 1, 5), ("b", None, 2, 9)}
    for bad in (lambda: core.rollup(df, "k", "sum(v):s", pivot="p"), lambda: core.rollup(df, "k", "sum(v):s", having="count(*) > 1", pivot="p: x")):
        with pytest.raises(OperatorError):
            bad()


def test_graph_services(spark, tmp_path):
    g = parse_graph('<Graph name="g"><Component id="a" type="InputFile"><Property name="filename" value="x < y & z"/></Component><components><component id="b" type="Join"><port name="l" source="a.out"/><port name="r" source="a.out"/></component></components><edges><edge from="a" to="b"/></edges></Graph>')
    assert g.nodes["a"].props["filename"] == "x < y & z" and len(g.edges) == 2 and g.order() == ["a", "b"] and g.roots() == ["a"] and g.leaves() == ["b"] and g.downstream("a") == ["b"]
    c = Catalog(tmp_path)
    c.save("one", g)
    assert c.load("one") == g and c.ids() == ["one"]
    c.delete("one")
    with pytest.raises(GraphError):
        c.load("one")
    cycle = '<graph><component id="a" type="Sort"><port name="in" source="b.out"/></component><component id="b" type="Sort"><port name="in" source="a.out"/></component></graph>'
    with pytest.raises(GraphError, match="cycle"):
        parse_graph(cycle).order()
    wrong = Engine.from_text('<graph><component id="a" type="Unheard"/><component id="b" type="Reformat"><property name="transform_file" value="none"/></component></graph>')
    assert len(wrong.validate()) == 4
    with pytest.raises(GraphError):
        wrong.bind(spark)
    program = Engine.from_text('<graph><component id="p" type="RunProgram"><property name="command" value="true"/></component></graph>')
    with pytest.raises(GraphError, match="off"):
        program.run(spark)
    program.allow_programs = True
    assert program.run(spark).sinks


# -- files


BARGE = "01 BARGE. 02 NAME PIC X(5). 02 TOLL PIC S9(5)V99 COMP-3. 02 SLOT PIC 9(4) COMP. 02 TIDE PIC S9(4)V9 COMP. 02 HOLD PIC S9(3). 02 LIST PIC S9(2)V9 SIGN LEADING SEPARATE. 02 FILLER PIC X(1). 02 OWNER PIC N(2). 02 CREW PIC X(2) OCCURS 2. 02 SPEED COMP-1. 02 WAY COMP-2."


@pytest.mark.parametrize("encoding", ["ebcdic", "ascii"])
def test_mainframe_file(spark, tmp_path, encoding):
    import struct

    record = import_cobol(BARGE, encoding=encoding)[0]
    page = "cp037" if encoding == "ebcdic" else "latin-1"
    # -118.625 as a hexadecimal number is -76.A / 16^2, so its exponent is 64 + 2.
    speed = bytes.fromhex("C276A000") if encoding == "ebcdic" else struct.pack(">f", -118.625)
    way = bytes.fromhex("4110000000000000") if encoding == "ebcdic" else struct.pack(">d", 1.0)
    minus = {"ebcdic": b"\xf1\xf2\xd3", "ascii": b"12L"}[encoding]

    def made(name, toll, slot, tide, hold, lean, owner, crew):
        return name.encode(page) + bytes.fromhex(toll) + slot.to_bytes(2, "big") + tide.to_bytes(4, "big", signed=True) + hold + lean.encode(page) + " ".encode(page) + owner.encode("utf-16-be") + crew.encode(page) + speed + way

    one, two = made("ÄBC  ", "1234567C", 258, -15, minus, "+123", "Éa", "AABB"), made("XY   ", "0000005D", 9999, 7, "007".encode(page), "-001", "  ", "CCDD")
    assert len(one) == record.record_length == record_bytes(record)
    (tmp_path / "data.bin").write_bytes((one + two) * 500)
    got = files.read(spark, str(tmp_path / "data.bin"), "mainframe", record)
    rows = Counter(tuple(map(str, r)) for r in got.collect())
    assert rows == Counter({
        ("ÄBC", "12345.67", "258", "-1.5", "-123", "12.3", "Éa", "['AA', 'BB']", "-118.625", "1.0"): 500, ("XY", "-0.05", "9999", "0.7", "7", "-0.1", "", "['CC', 'DD']", "-118.625", "1.0"): 500,
    })
    (tmp_path / "torn.bin").write_bytes(one + two[:7])
    with pytest.raises(Exception, match="EOF"):
        files.read(spark, str(tmp_path / "torn.bin"), "mainframe", record).collect()


@pytest.mark.parametrize("encoding", ["ebcdic", "ascii"])
def test_mainframe_write_and_read(spark, tmp_path, encoding):
    record = import_cobol("01 R. 02 A PIC X(6). 02 FILLER PIC X(2). 02 B PIC S9(7)V99 COMP-3. 02 C PIC S9(4) COMP. 02 D PIC 9(9)V9 COMP. 02 E PIC S9(5)V9. 02 F PIC S9(3) SIGN TRAILING SEPARATE. 02 G PIC N(4).", encoding=encoding)[0]
    schema = struct_type(tuple(f for f in record.fields if f.name != "filler_1"))
    rows = [("abc", Decimal("-12.34"), Decimal(-5), Decimal("3.5"), Decimal("-7.1"), Decimal(-12), "Ωé"), ("Z", Decimal("1234567.89"), Decimal(9999), Decimal("999999999.9"), Decimal("99999.9"), Decimal(5), ""), ("", Decimal(0), Decimal(0), Decimal(0), Decimal(0), Decimal(0), "abcd")]
    n = mainframe.write_mainframe(spark.createDataFrame(rows, schema).repartition(2), f"file://{tmp_path}/out", record)
    got = files.read(spark, f"file://{tmp_path}/out", "mainframe", record).collect()
    assert n == 3 and Counter(tuple(r) for r in got) == Counter(rows)


def test_mixed_lines_that_do_not_fit(spark, tmp_path):
    record = parse_dml(r"""DEFINE c BEGIN decimal("/") no; string(3) code; string("\n") rest; END""")["c"]
    (tmp_path / "m.txt").write_text("1/abcdef\nno number here\n2/xyz\n")
    options = {"columnNameOfCorruptRecord": "bad"}
    assert [tuple(r) for r in files.read(spark, str(tmp_path / "m.txt"), "mixed", record, options=options).collect()] == [(Decimal(1), "abc", "def", None), (None, None, None, "no number here"), (Decimal(2), "xyz", "", None)]
    assert files.read(spark, str(tmp_path / "m.txt"), "mixed", record).count() == 3
    with pytest.raises(Exception, match="doesn't fit"):
        files.read(spark, str(tmp_path / "m.txt"), "mixed", record, options={"mode": "failfast"}).collect()


def test_conditional_and_fixed(spark, tmp_path):
    record = parse_dml('DEFINE r BEGIN week integer(1); if (week >= 5) then bell decimal(3,0); else horn string(4); end; marks decimal(2,0)[3]; END')["r"]
    (tmp_path / "f.txt").write_text("5071toot010203\n2088moan 4 5xx\n")
    rows = [tuple(r) for r in files.read(spark, str(tmp_path / "f.txt"), "fixed", record).collect()]
    assert rows == [(5, Decimal(71), None, [1, 2, 3]), (2, None, "moan", [4, 5, None])]


@pytest.mark.parametrize(("text", "want"), [("record packed decimal(5) a; end", "mainframe"), ("record string(5) a; decimal(3) b; end", "fixed"), ('record string("|") a; end', "csv"), ('record record string("|") a; end r; end', "parquet"), ("record decimal(5,2) a; date d; string s; end", "parquet"), ("record string a; end", "csv")])
def test_recommended_format(text, want):
    assert recommend_format(parse_dml(text)["record_1"])[0] == want


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    s = streams.read_stream(spark, str(tmp_path / "in"), schema=schema, watermark="ts", delay="1 hour", files_per_trigger=1)
    q = streams.write_stream(core.filter_rows(s, "value > 10"), str(tmp_path / "out"), str(tmp_path / "c1"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.where("value > 10").count()
    w = streams.windowed_rollup(streams.read_stream(spark, str(tmp_path / "in"), schema=schema, watermark="ts", delay="400 days"), "ts", "1 day", "count(*):n, sum(value):v", "event_type")
    q = w.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()
    assert isinstance(w.schema["window_start"].dataType, T.TimestampType)


def test_command_line_and_script(spark, tmp_path, capsys):
    from weftline.__main__ import export_script, main

    for name, text in (("g.mp", GAUGES), ("g.dml", GAUGES_DML), ("g.xfr", GAUGES_XFR)):
        (tmp_path / name).write_text(text)
    paths = [str(tmp_path / n) for n in ("g.mp", "g.dml", "g.xfr")]
    gauge_rows(spark, tmp_path / "in")
    assert main(["validate", *paths]) == 0 and main(["order", *paths]) == 0 and main(["dml", paths[1]]) == 0
    assert main(["run", *paths, "--param", f"IN={tmp_path / 'in'}", "--param", f"OUT={tmp_path / 'o'}"]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    script = export_script(paths, str(tmp_path / "p.py"))
    compile(script, "p.py", "exec")
    (tmp_path / "t.sql").write_text("CREATE TABLE t (a INT)")
    assert main(["hive", str(tmp_path / "t.sql")]) == 0 and "integer(4) a" in capsys.readouterr().out
