"""Binds a graph to DataFrames and runs its sinks."""

from __future__ import annotations

import json
import logging
import re
import shlex
import subprocess
import time
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..expr import Block, ExprError, ParseError, parse_blocks
from ..functions.registry import FUNCTIONS
from ..operators import core
from ..operators.core import REGISTRY, OperatorError, names_of, operator
from ..schema.dml import parse_dml
from ..schema.spec import RecordSpec, SchemaError, resolve, struct_type
from ..sources import files
from .graph import Graph, GraphError, interpolate, parse_graph

log = logging.getLogger("weftline")


@dataclass
class Context:
    """What operators see besides their inputs and settings."""

    spark: SparkSession
    schemas: dict[str, RecordSpec] = field(default_factory=dict)
    blocks: dict[str, Block] = field(default_factory=dict)
    params: dict[str, str] = field(default_factory=dict)
    clock: datetime | None = None
    conform: bool = True
    allow_programs: bool = False
    notes: list[str] = field(default_factory=list)

    def block(self, name: str) -> Block:
        stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        for key in (name, stem):
            if key in self.blocks:
                return self.blocks[key]
        raise GraphError(f"no transform {name}")

    def record(self, props: Mapping[str, str]) -> RecordSpec | None:
        return resolve(self.schemas, props["schema"]) if props.get("schema") else None


@dataclass
class RunReport:
    """What was run, for each sink its seconds, and what was noticed."""

    graph: str
    order: list[str] = field(default_factory=list)
    persisted: list[str] = field(default_factory=list)
    sinks: dict[str, float] = field(default_factory=dict)
    passed_through: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    unresolved: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k, i, str(x)) for k, v in asdict(self).items() for i, x in enumerate(v.items() if isinstance(v, dict) else v if isinstance(v, list) else [v])]
        return spark.createDataFrame(rows, "kind string, position int, entry string")


def _flag(x: str | None) -> bool:
    return str(x or "").strip().lower() in ("true", "1", "yes")


def _first(props: Mapping[str, str], *names: str, default: Any = None) -> Any:
    return next((props[n] for n in names if props.get(n) not in (None, "")), default)


def _options(props: Mapping[str, str]) -> dict[str, str]:
    return {k.removeprefix("option."): v for k, v in props.items() if k.startswith("option.")}


def _read(inputs: dict[str, DataFrame], p: Mapping[str, str], c: Context) -> DataFrame:
    path = _first(p, "filename", "path")
    if path is None and not _options(p):
        raise GraphError("a source needs a filename or options")
    fmt, delimiter = _first(p, "file_format", "format", default="parquet"), p.get("delimiter")
    if _flag(p.get("stream")):
        from ..streaming.streams import read_stream

        record = c.record(p)
        return read_stream(c.spark, path, fmt, struct_type(record) if record else None, p.get("watermark"), p.get("delay"))
    return files.read(c.spark, path, fmt, c.record(p), delimiter, _flag(p.get("has_header")), _options(p))


operator("InputFile", "Input", "LookupFile")(_read)


@operator("Reformat")
def _reformat(inputs: dict[str, DataFrame], p: Mapping[str, str], c: Context) -> DataFrame:
    df = _one(inputs)
    name = p.get("transform_file") or p.get("transform")
    if not name:
        return df
    block = c.block(name)
    if block.kind != "transform":
        raise GraphError(f"{name} is a filter, not a transform")
    record = c.record(p)
    defaults = {k: p[q] for k, q in (("partition_by", "window_partition"), ("order_by", "window_order"), ("range", "window_range")) if p.get(q)}
    columns, low = core.compile_assignments(block.assignments, df, {f.name: f.dataType for f in struct_type(record)} if record else None, c.conform, clock=c.clock, defaults=defaults)
    c.notes += [x for x in low.passed_through if x not in c.notes]
    return df.select(*columns) if columns else df


@operator("Filter", "FilterByExpression")
def _filter(inputs: dict[str, DataFrame], p: Mapping[str, str], c: Context) -> DataFrame:
    condition: Any = p.get("condition") or None
    if p.get("transform_file"):  # a block comes before an inline condition
        try:
            block = c.block(p["transform_file"])
        except GraphError:
            if condition is None:
                raise
        else:
            if block.kind != "filter":
                raise GraphError(f"{p['transform_file']} is a transform, not a filter")
            condition = block.condition
    return core.filter_rows(_one(inputs), condition, clock=c.clock)


@operator("Join")
def _join(inputs: dict[str, DataFrame], p: Mapping[str, str], c: Context) -> DataFrame:
    left, right = _two(inputs, ("in_left", "in0", "left"), ("in_right", "in1", "right"))
    return core.join(left, right, _first(p, "join_key", "on", "key"), _first(p, "join_type", "how", default="inner"), p.get("condition"), p.get("suffix"), p.get("broadcast"))


@operator("Lookup")
def _lookup(inputs: dict[str, DataFrame], p: Mapping[str, str], c: Context) -> DataFrame:
    df, table = _two(inputs, ("in",), ("in_lookup", "lookup"))
    return core.lookup(df, table, _first(p, "key", "lookup_key", "join_key"), p.get("match", "all"), p.get("sort_by"), p.get("suffix"))


@operator("MatchSorted")
def _match(inputs: dict[str, DataFrame], p: Mapping[str, str], c: Context) -> DataFrame:
    left, right = _two(inputs, ("in_left", "in0"), ("in_right", "in1"))
    return core.join(left, right, _first(p, "key", "on"), "inner", suffix=p.get("suffix"))


@operator("Rollup", "Aggregate")
def _rollup(inputs: dict[str, DataFrame], p: Mapping[str, str], c: Context) -> DataFrame:
    return core.rollup(_one(inputs), _first(p, "group_by", "key"), p.get("aggregates"), p.get("having"), p.get("sets"), p.get("pivot"))


@operator("DenormalizeSorted", "Denormalize")
def _denormalize(inputs: dict[str, DataFrame], p: Mapping[str, str], c: Context) -> DataFrame:
    return core.denormalize(_one(inputs), _first(p, "group_by", "key"), p["collect"], p.get("sort_by"), p.get("alias"))


@operator("Scan")
def _scan(inputs: dict[str, DataFrame], p: Mapping[str, str], c: Context) -> DataFrame:
    if p.get("chunks"):
        return core.scan_chunked(_one(inputs), _first(p, "key", "partition_by"), p["sort_by"], p.get("aggregates", ""), int(p["chunks"]))
    return core.scan(_one(inputs), _first(p, "key", "partition_by"), p.get("sort_by"), p.get("aggregates", ""), p.get("range"))


@operator("Sort")
def _sort(inputs: dict[str, DataFrame], p: Mapping[str, str], c: Context) -> DataFrame:
    return core.sort(_one(inputs), _first(p, "key", "sort_by"), p.get("order", "asc"))


@operator("SortWithinGroups")
def _sort_groups(inputs: dict[str, DataFrame], p: Mapping[str, str], c: Context) -> DataFrame:
    return core.sort_within_groups(_one(inputs), _first(p, "group_by", "group"), _first(p, "sort_by", "key"), _flag(p.get("global")))


@operator("DedupSorted", "Dedup")
def _dedup(inputs: dict[str, DataFrame], p: Mapping[str, str], c: Context) -> DataFrame:
    return core.dedup(_one(inputs), p.get("key"), _first(p, "which", "keep", default="first"), p.get("sort_by"))


@operator("Gather")
def _gather(inputs: dict[str, DataFrame], p: Mapping[str, str], c: Context) -> DataFrame:
    return core.gather(*inputs.values())


@operator("Concatenate")
def _concatenate(inputs: dict[str, DataFrame], p: Mapping[str, str], c: Context) -> DataFrame:
    return core.gather(*inputs.values(), ordered=_flag(p.get("ordered")))


@operator("Intersect", "Except", "Union")
def _sets(inputs: dict[str, DataFrame], p: Mapping[str, str], c: Context) -> DataFrame:
    left, right = _two(inputs, ("in_left", "in0"), ("in_right", "in1"))
    return core.set_operation(left, right, p["__type"].lower(), _flag(p.get("distinct")))


@operator("Replicate")
def _replicate(inputs: dict[str, DataFrame], p: Mapping[str, str], c: Context) -> DataFrame:
    return _one(inputs)


@operator("Normalize")
def _normalize(inputs: dict[str, DataFrame], p: Mapping[str, str], c: Context) -> DataFrame:
    return core.normalize(_one(inputs), _first(p, "array_field", "explode"), p.get("item_alias"), _flag(p.get("outer")), p.get("with_index"), _flag(p.get("flatten")))


@operator("Limit", "TopK")
def _limit(inputs: dict[str, DataFrame], p: Mapping[str, str], c: Context) -> DataFrame:
    return core.limit(_one(inputs), int(p["n"]), p.get("key"), p.get("order", "asc"))


@operator("Sample")
def _sample(inputs: dict[str, DataFrame], p: Mapping[str, str], c: Context) -> DataFrame:
    return core.sample(_one(inputs), float(p["fraction"]), int(p.get("seed", 42)))


def _one(inputs: dict[str, DataFrame]) -> DataFrame:
    if len(inputs) != 1:
        raise GraphError(f"one input is needed, not {len(inputs)}")
    return next(iter(inputs.values()))


def _two(inputs: dict[str, DataFrame], first: tuple[str, ...], second: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """By port name, else in the order of the document."""
    if len(inputs) != 2:
        raise GraphError(f"two inputs are needed, not {len(inputs)}")
    a, b = (next((inputs[n] for n in names if n in inputs), None) for names in (first, second))
    if a is not None and b is None:
        b = next(v for k, v in inputs.items() if v is not a)
    if b is not None and a is None:
        a = next(v for k, v in inputs.items() if v is not b)
    if a is None or b is None:
        a, b = inputs.values()
    return a, b


SINKS = {"outputfile", "output", "trash", "runprogram"}
#: Operators that write what they pass on.
STORES = {"intermediatefile"}
_FILE = "filename path file_format format delimiter has_header"
_KEYED, _FRAME = "key group_by", "window_partition window_order window_range requires_window"
#: Settings that any operator may have, and those of each; own operators take what they like.
COMMON = set("schema description comment label".split())
SETTINGS = {
    name: COMMON | set(known.split())
    for names, known in {
        "inputfile input lookupfile": f"{_FILE} stream watermark delay is_lookup key",
        "outputfile output": f"{_FILE} mode partition_by partitionBy coalesce repartition",
        "intermediatefile": f"{_FILE} mode",
        "trash replicate": "",
        "runprogram": "command program",
        "reformat": f"transform_file transform {_FRAME}",
        "filter filterbyexpression": "condition transform_file",
        "join": "join_key on key join_type how condition suffix broadcast left_input right_input",
        "lookup": "key lookup_key join_key match sort_by suffix lookup_file",
        "matchsorted": "key on suffix",
        "rollup aggregate": f"{_KEYED} aggregates having sets pivot",
        "denormalizesorted denormalize": f"{_KEYED} collect sort_by alias",
        "scan": "key partition_by sort_by aggregates range chunks",
        "sort": "key sort_by order",
        "sortwithingroups": "group_by group sort_by key global",
        "dedupsorted dedup": "key which keep sort_by",
        "gather": "",
        "concatenate": "ordered",
        "intersect except union": "distinct",
        "normalize": "array_field explode item_alias outer with_index flatten",
        "limit topk": "n key order",
        "sample": "fraction seed",
    }.items()
    for name in names.split()
}


class Engine:
    """A graph with its schemas and transforms. bind() is lazy; run() runs the sinks.

    strict: settings that an operator doesn't know and parameters that aren't set are errors,
    else warnings of the report.
    """

    def __init__(self, graph: Graph, schemas: dict[str, RecordSpec] | None = None, blocks: dict[str, Block] | None = None, clock: datetime | None = None, conform: bool = True, allow_programs: bool = False, strict: bool = True):
        self.graph, self.schemas, self.blocks = graph, schemas or {}, blocks or {}
        self.clock, self.conform, self.allow_programs, self.strict = clock, conform, allow_programs, strict

    @classmethod
    def from_text(cls, graph: str, schemas: str = "", transforms: str = "", params: Mapping[str, str] | None = None, **more: Any) -> Engine:
        """Parameters go into all three, over those of the graph."""
        g = parse_graph(graph, params)
        return cls(g, parse_dml(schemas, g.params) if schemas.strip() else {}, parse_blocks(interpolate(transforms, g.params)) if transforms.strip() else {}, **more)

    @classmethod
    def from_files(cls, *paths: str | Path, params: Mapping[str, str] | None = None, **more: Any) -> Engine:
        """One .mp file with any .dml and .xfr files."""
        texts: dict[str, list[str]] = {".mp": [], ".dml": [], ".xfr": []}
        for p in map(Path, paths):
            if p.suffix not in texts:
                raise GraphError(f"{p.name} is no .mp, .dml or .xfr file")
            texts[p.suffix].append(p.read_text())
        if len(texts[".mp"]) != 1:
            raise GraphError(f"one graph is needed, not {len(texts['.mp'])}")
        return cls.from_text(texts[".mp"][0], "\n".join(texts[".dml"]), "\n".join(texts[".xfr"]), params, **more)

    def validate(self) -> list[str]:
        """Everything wrong that shows without data: types, inputs, order, transforms, schemas."""
        found = []
        try:
            self.graph.order()
        except GraphError as why:
            found.append(str(why))
        for n in self.graph.nodes.values():
            kind = n.type.lower()
            if kind not in REGISTRY and kind not in SINKS | STORES:
                found.append(f"{n.id}: no operator {n.type!r}")
            if self.strict:
                found += self._unknown(n)
            if kind not in ("inputfile", "input", "lookupfile", "runprogram") and not self.graph.inputs(n.id):
                found.append(f"{n.id}: {n.type} has no input")
            context = Context(None, self.schemas, self.blocks)  # type: ignore[arg-type]
            for what, key in ((context.block, "transform_file"), (lambda s: resolve(self.schemas, s), "schema")):
                if n.props.get(key) and not (key == "schema" and not self.schemas) and not (key == "transform_file" and kind == "filter" and n.props.get("condition")):
                    try:
                        what(n.props[key])
                    except (GraphError, SchemaError) as why:
                        found.append(f"{n.id}: {why}")
        return found

    def _unknown(self, node) -> list[str]:
        known = SETTINGS.get(node.type.lower())
        return [f"{node.id}: {node.type} has no setting {k!r}" for k in node.props if known is not None and k not in known and not k.startswith("option.")]

    def unset(self) -> list[str]:
        """Parameters that nodes name and nobody sets."""
        return [f"{n.id}: parameter {name} of {k!r} isn't set" for n in self.graph.nodes.values() for k, v in n.props.items() for name in re.findall(r"\$\{(\w+)\}", str(v))]

    def bind(self, spark: SparkSession, overrides: Mapping[str, DataFrame] | None = None, context: Context | None = None) -> dict[str, DataFrame]:
        """The DataFrame of each node, sinks excepted, without running anything.

        overrides: DataFrames in place of nodes, by id or name. An intermediate file passes
        its input on; only run() writes it.
        """
        return self._bound(overrides, context or self.context(spark), lambda ident, df: df)

    def _bound(self, overrides: Mapping[str, DataFrame] | None, c: Context, made: Callable[[str, DataFrame], DataFrame]) -> dict[str, DataFrame]:
        """bind() in which made(node, its DataFrame) is what the node's successors see."""
        wrong = self.validate() + (self.unset() if self.strict else [])
        if wrong:
            raise GraphError("; ".join(wrong))
        out: dict[str, DataFrame] = {}
        for ident in self.graph.order():
            node = self.graph.nodes[ident]
            given = (overrides or {}).get(ident, (overrides or {}).get(node.name))
            kind = node.type.lower()
            if given is not None:
                out[ident] = given
                continue
            if kind == "runprogram":
                continue
            inputs = self._inputs(ident, out)
            try:
                if kind in SINKS:
                    out[ident] = _one(inputs)
                    continue
                df = _one(inputs) if kind in STORES else REGISTRY[kind](inputs, {**node.props, "__type": node.type}, c)
                out[ident] = made(ident, df)
            except (ExprError, ParseError, SchemaError, OperatorError, GraphError) as why:
                raise GraphError(f"{ident} ({node.name}): {why}") from why
            except KeyError as why:
                raise GraphError(f"{ident} ({node.name}): {why} isn't set") from why
        return out

    def context(self, spark: SparkSession) -> Context:
        return Context(spark, self.schemas, self.blocks, self.graph.params, self.clock, self.conform, self.allow_programs)

    def _inputs(self, ident: str, done: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        out: dict[str, DataFrame] = {}
        for e in self.graph.inputs(ident):
            port = e.target_port
            while port in out:
                port += "_"
            if e.source in done:
                out[port] = done[e.source]
        return out

    def _checkpoint(self, props: Mapping[str, str], df: DataFrame, c: Context) -> DataFrame:
        """Written and read again: to the file that is named, else to the session's checkpoint folder."""
        path = _first(props, "filename", "path")
        if path is None:
            from pyspark.errors import PySparkException

            try:
                return df.checkpoint()
            except PySparkException as why:
                raise GraphError(f"an unnamed intermediate file needs a checkpoint folder: {why}") from why
        fmt = _first(props, "file_format", "format", default="parquet")
        files.write(df, path, fmt, props.get("mode", "overwrite"))
        return c.spark.read.schema(df.schema).format(fmt).load(path)

    def run(self, spark: SparkSession, overrides: Mapping[str, DataFrame] | None = None, outputs: Mapping[str, str] | None = None, retries: int = 0, parallel: int = 1, persist: bool = True) -> RunReport:
        """Runs every sink. outputs: paths in place of those of sinks, by id or name.

        Each node is bound once, and an intermediate file is written once. A node that feeds
        several sinks is kept in memory and on disk until all have run. How many files a sink
        writes is left to the plan unless it has coalesce or repartition; DOP is a hint for
        other engines.
        Sinks run one after another or up to `parallel` at once; a failed overwrite is
        tried again up to `retries` times, an append never is.
        """
        c = self.context(spark)
        report = RunReport(self.graph.name, self.graph.order())
        kept: list[DataFrame] = []
        sources = ("inputfile", "input", "lookupfile", "replicate")

        def made(ident: str, df: DataFrame) -> DataFrame:
            kind = self.graph.nodes[ident].type.lower()
            if kind in STORES:
                return self._checkpoint(self.graph.nodes[ident].props, df, c)
            if persist and kind not in sources and self._sinks_below(ident) > 1 and len(self.graph.successors(ident)) > 1:
                df = df.persist(StorageLevel.MEMORY_AND_DISK)
                kept.append(df)
                report.persisted.append(ident)
            return df

        bound = self._bound(overrides, c, made)
        report.passed_through = sorted(set(c.notes))
        report.warnings = [f"function {n} is Spark's own" for n in report.passed_through if n not in FUNCTIONS]
        report.warnings += [x for n in self.graph.nodes.values() for x in self._unknown(n)] + self.unset()

        def one(ident: str) -> None:
            node, began = self.graph.nodes[ident], time.monotonic()
            for attempt in range(retries + 1):
                try:
                    self._sink(node, bound.get(ident), outputs or {})
                    break
                except Exception:
                    if attempt == retries or node.props.get("mode") == "append":
                        raise
                    log.warning("sink %s failed, attempt %d", ident, attempt + 1)
            report.sinks[ident] = round(time.monotonic() - began, 3)

        sinks = [n for n in report.order if self.graph.nodes[n].type.lower() in SINKS]
        if not sinks:
            report.unresolved = self.graph.leaves()
        try:
            if parallel > 1:
                with ThreadPoolExecutor(parallel) as pool:
                    list(pool.map(one, sinks))
            else:
                for s in sinks:
                    one(s)
        finally:
            for df in kept:
                df.unpersist()
        return report

    def _sinks_below(self, ident: str) -> int:
        return sum(self.graph.nodes[n].type.lower() in SINKS for n in self.graph.downstream(ident))

    def _sink(self, node, df: DataFrame | None, outputs: Mapping[str, str]) -> None:
        p, kind = node.props, node.type.lower()
        if kind == "runprogram":
            if not self.allow_programs:
                raise GraphError(f"{node.id}: programs are off; allow_programs=True runs them")
            subprocess.run(shlex.split(_first(p, "command", "program", default="true")), check=True)
        elif kind == "trash":
            files.discard(df)
        else:
            path = outputs.get(node.id, outputs.get(node.name)) or _first(p, "filename", "path")
            if path is None and not _options(p):
                raise GraphError(f"{node.id}: a sink needs a filename or options")
            count = p.get("coalesce")
            files.write(df, path, _first(p, "file_format", "format", default="parquet"), p.get("mode", "overwrite"), names_of(_first(p, "partition_by", "partitionBy")), int(count) if count else None, int(p["repartition"]) if p.get("repartition") else None, p.get("delimiter"), _flag(p.get("has_header")), _options(p))

    def explain(self, spark: SparkSession, overrides: Mapping[str, DataFrame] | None = None) -> dict[str, str]:
        """The physical plan of each leaf."""
        bound = self.bind(spark, overrides)
        return {n: bound[n]._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) for n in self.graph.leaves() if n in bound}
