"""The library's calls in one place."""

from .expr import compile_expression, parse_blocks, parse_expression
from .functions.registry import register as register_function
from .importers import import_cobol, import_hive, import_xml
from .operators.core import (
    dedup,
    denormalize,
    filter_rows,
    gather,
    join,
    limit,
    lookup,
    normalize,
    operator,
    reformat,
    rollup,
    sample,
    scan,
    set_operation,
    sort,
    sort_within_groups,
)
from .plans.engine import Engine, RunReport
from .plans.graph import Catalog, Graph, downstream_frame, parse_graph
from .schema.dml import explain_dml, parse_dml, to_struct_type
from .schema.emit import emit_dml
from .schema.spec import RecordSpec, struct_type
from .sources.files import read, reader_for, recommend_format, write
from .streaming.streams import read_stream, windowed_rollup, write_stream

__all__ = [n for n in dir() if not n.startswith("_")]
