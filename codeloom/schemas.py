"""Schemas of the engine's relations."""

from __future__ import annotations

FILES = "path string, content string"
SYMBOLS = "path string, name string, kind string, start_byte int, end_byte int, is_definition boolean"
FILE_EDGES = "src string, dst string, kind string, strength double"
IMPORTS = "path string, statement int, form string, level int, module string, name string, alias string, line int"
CPG_NODES = (
    "node_id string, path string, name string, kind string, start_byte int, end_byte int, start_line int, end_line int, "
    "parameters array<struct<name:string,type_annotation:string,default_value:string>>, return_type string, docstring string, "
    "bases array<string>, parent_class string, statement_kind string, function_id string, defs array<string>, uses array<string>"
)
CPG_EDGES = "path string, src string, dst string, kind string, variable string, position int"
CALL_SITES = (
    "site_id string, path string, statement_id string, caller_id string, callee_name string, receiver string, "
    "positional_args array<string>, keyword_args array<struct<name:string,value:string>>, start_byte int, end_byte int, line int"
)

#: Strength of each kind of edge between files.
STRENGTH = {"Import": 2.0, "SymbolUsage": 1.0}
LANGUAGE_OF = {"py": "python", "rs": "rust", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "ts": "typescript", "tsx": "tsx", "go": "go"}
#: Languages whose files may use each other's symbols share a family.
FAMILY_OF = {"python": "python", "rust": "rust", "go": "go", "javascript": "js", "jsx": "js", "typescript": "js", "tsx": "js"}
