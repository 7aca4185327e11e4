"""The row-expression language: text to syntax tree to Column."""

from .lower import ExprError, Lowering, compile_assignments, compile_expression
from .parser import Block, ParseError, parse_blocks, parse_expression

__all__ = ["Block", "ExprError", "Lowering", "ParseError", "compile_assignments", "compile_expression", "parse_blocks", "parse_expression"]
