"""Table-valued parsing: files to symbols, imports, skeletons and graph rows, in Arrow stages.

Filters on path belong before these operators: Catalyst can't push them through a Python stage.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import js_flow, js_source, python_source
from ..schemas import CALL_SITES, CPG_EDGES, CPG_NODES, IMPORTS, SYMBOLS
from .graph import language_of

JS = ("javascript", "jsx", "typescript", "tsx")


def with_language(files: DataFrame) -> DataFrame:
    """Files of a known language, with it."""
    return files.withColumn("language", language_of(F.col("path"))).filter("language is not null")


def _rows(files: DataFrame, schema: str, make: Callable[[str, str, str], Iterator[tuple]]) -> DataFrame:
    """Rows that make(path, language, content) gives for each file."""
    names = [f.split()[0] for f in _top_fields(schema)]
    arrow = _arrow_schema(schema)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, lang, c in zip(*(batch.column(i).to_pylist() for i in range(3))) if p is not None and c is not None for r in make(p, lang, c)]
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, arrow.field(i).type) for i, c in enumerate(cols)], names=names)

    return with_language(files).select("path", "language", "content").mapInArrow(stage, schema)


def _top_fields(schema: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()]


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def symbols(files: DataFrame, partial: bool = False) -> DataFrame:
    """SYMBOLS of Python, JavaScript and TypeScript files; one with a syntax error has none, or with partial those of its sound parts."""

    def make(path: str, lang: str, content: str) -> Iterator[tuple]:
        found = python_source.symbols(python_source.Source(content, partial)) if lang == "python" else js_source.symbols(content) if lang in JS else []
        for s in found:
            yield (path, *s)

    return _rows(files, SYMBOLS, make)


def imports(files: DataFrame, partial: bool = False) -> DataFrame:
    """IMPORTS: one row an imported name; JavaScript specifiers stand in module; partial as in symbols."""

    def make(path: str, lang: str, content: str) -> Iterator[tuple]:
        if lang == "python":
            for st, form, level, module, name, alias, line in python_source.imports(python_source.Source(content, partial)):
                yield (path, st, form, level, module, name, alias, line)
        elif lang in JS:
            for st, form, module, name, alias, line in js_source.imports(content):
                yield (path, st, form, 0, module, name, alias, line)

    return _rows(files, IMPORTS, make)


def skeletons(files: DataFrame) -> DataFrame:
    """path, skeleton: of Python files; others as they are; plain signature lines where there is a syntax error."""

    @F.pandas_udf(T.StringType())
    def of(language: pd.Series, content: pd.Series) -> pd.Series:
        def one(lang: str, text: str | None) -> str | None:
            if lang != "python" or text is None:
                return text
            made = python_source.skeleton(python_source.Source(text))
            return python_source.plain_signatures(text) if made is None else made

        return pd.Series([one(a, b) for a, b in zip(language, content)], dtype=object)

    known = F.coalesce(language_of(F.col("path")), F.lit("unknown"))
    return files.select("path", of(known, F.col("content")).alias("skeleton"))


def checked(files: DataFrame) -> DataFrame:
    """path, is_valid, line, message; a file of an unknown language is valid, and so is Rust.

    Python is compiled; in JavaScript, TypeScript and Go brackets and quotes must close.
    """
    kind = T.StructType([T.StructField("is_valid", T.BooleanType()), T.StructField("line", T.IntegerType()), T.StructField("message", T.StringType())])

    @F.pandas_udf(kind)
    def check(language: pd.Series, content: pd.Series) -> pd.DataFrame:
        found = [python_source.check_syntax(c) if lang == "python" else js_source.check_syntax(c) if lang in JS or lang == "go" else (True, None, None) for lang, c in zip(language, content)]
        out = pd.DataFrame(found, columns=["is_valid", "line", "message"])
        out["line"] = out["line"].astype("Int32")
        return out

    known = F.coalesce(language_of(F.col("path")), F.lit("unknown"))
    return files.filter("content is not null").select("path", check(known, F.col("content")).alias("c")).select("path", "c.*")


def normalized_trees(files: DataFrame) -> DataFrame:
    """Flat syntax trees of Python files: path, node_no, parent_no, depth, kind, text, start_byte, end_byte."""

    def make(path: str, lang: str, content: str) -> Iterator[tuple]:
        for r in python_source.normalized(python_source.Source(content)) if lang == "python" else []:
            yield (path, *r)

    return _rows(files, "path string, node_no int, parent_no int, depth int, kind string, text string, start_byte int, end_byte int", make)


def _id(path: str, *parts) -> str:
    return hashlib.blake2b("\0".join(map(str, (path, *parts))).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _graph_of(path: str, lang: str, content: str, partial: bool = False) -> python_source.Graph:
    if lang == "python":
        return python_source.Builder(python_source.Source(content, partial), path, lambda *k: _id(path, *k)).build()
    if lang in JS:
        return _js_graph(path, content)
    return python_source.Graph()


def _js_graph(path: str, text: str) -> python_source.Graph:
    g, at = python_source.Graph(), [0]
    if not text.isascii():
        at += accumulate(len(c.encode("utf-8", "surrogatepass")) for c in text)
    bytes_to = (lambda i: i) if text.isascii() else at.__getitem__
    owners = []
    for d in js_source.definitions(text):
        if d.kind not in ("function", "class", "method", "variable"):
            continue
        if d.kind == "variable" and any(o.name_start == d.name_start for o, _ in owners):
            continue
        start, end = bytes_to(d.start), bytes_to(d.end)
        i = _id(path, d.kind, start, end, d.name)
        g.nodes.append({
            "node_id": i, "path": path, "name": d.name, "kind": d.kind, "start_byte": start, "end_byte": end, "start_line": text.count("\n", 0, d.start) + 1, "end_line": text.count("\n", 0, d.end) + 1,
            "parameters": d.parameters, "return_type": d.return_type, "docstring": d.doc, "bases": d.bases, "parent_class": d.parent, "statement_kind": None, "function_id": None, "defs": [], "uses": [],
        })
        owners.append((d, i))
        if d.kind == "method":
            for o, c in owners:
                if o.kind == "class" and o.name == d.parent:
                    g.edges.append((c, i, "AstChild", None, None))
    held = _js_statements(path, text, g, owners, bytes_to)
    for name, receiver, args, start, end in js_source.calls(text):
        inside = [(o.end - o.start, i) for o, i in owners if o.kind in ("function", "method") and o.start <= start < o.end]
        if inside:
            caller = min(inside)[1]
            own = [(y - x, i) for x, y, f, i in held if f == caller and x <= start < y]
            a, b = bytes_to(start), bytes_to(end)
            g.calls.append({
                "site_id": _id(path, "call", a, b, name), "path": path, "statement_id": min(own)[1] if own else caller, "caller_id": caller, "callee_name": name, "receiver": receiver,
                "positional_args": args, "keyword_args": [], "start_byte": a, "end_byte": b, "line": text.count("\n", 0, start) + 1,
            })
    return g


def _js_statements(path: str, text: str, g: python_source.Graph, owners: list, bytes_to: Callable[[int], int]) -> list[tuple[int, int, str, str]]:
    """Adds statements and control flow of every function; (begin, end, function, statement) in characters."""
    code = [t for t in js_source.tokens(text) if t.kind != "comment"]
    pair, begins, held = js_source._partners(code), [t.start for t in code], []
    reader = js_flow.Reader(text, code, pair)

    def row(name: str, kind: str, a: int, b: int, **more) -> str:
        i = _id(path, kind, bytes_to(a), bytes_to(b), name)
        g.nodes.append({
            "node_id": i, "path": path, "name": name, "kind": kind, "start_byte": bytes_to(a), "end_byte": bytes_to(b), "start_line": text.count("\n", 0, a) + 1, "end_line": text.count("\n", 0, max(a, b - 1)) + 1,
            "parameters": [], "return_type": None, "docstring": None, "bases": [], "parent_class": None, "statement_kind": None, "function_id": None, "defs": [], "uses": [],
        } | more)
        return i

    for d, f in owners:
        if d.kind not in ("function", "method"):
            continue
        first, last = bisect_left(begins, d.name_start), bisect_left(begins, d.end)
        # The body is the last block; an arrow function without one has an expression, which it returns.
        arrow = next((k for k in range(first, last) if code[k].text == "=>"), None) if d.kind == "function" and first + 1 < last and code[first + 1].text in ("=", ":") else None
        k = arrow + 1 if arrow is not None else next((k for k in range(first, last) if code[k].text == "{" and pair.get(k) is not None and code[pair[k]].end == d.end), None)
        if k is None or k >= last:
            continue
        if code[k].text == "{" and k in pair:
            body = reader.block(k + 1, pair[k])
        else:
            stop = last - 1 if code[last - 1].text == ";" else last
            body = [reader._made("return", k, stop, stop)]
        names = [n for p in d.parameters if (n := p["name"].lstrip(".")).isidentifier()]
        entry, exit_ = row("entry", "cfg_entry", d.start, d.end, function_id=f, defs=names), row("exit", "cfg_exit", d.start, d.end, function_id=f)

        def node(s: js_flow.Statement, f: str = f) -> str:
            a, b = code[s.first].start, code[s.last - 1].end
            i = row(f"{s.kind}: {text[a:b].split(chr(10))[0][:60]}", "statement", a, b, statement_kind=s.kind, function_id=f, defs=s.defs, uses=s.uses)
            g.edges.append((f, i, "AstChild", None, None))
            held.append((a, b, f, i))
            return i

        flow = js_flow.Flow(node, lambda a, b, kind: g.edges.append((a, b, f"ControlFlow{kind}", None, None)), exit_)
        for at, kind in flow.block(body, [(entry, "Next")], None):
            g.edges.append((at, exit_, f"ControlFlow{kind}", None, None))
    return held


def graph_rows(files: DataFrame, partial: bool = False) -> DataFrame:
    """part (nodes, edges or sites) and rows of all three relations, from one parse of each file: write it, then read its parts."""
    kinds = {"nodes": CPG_NODES, "edges": CPG_EDGES, "sites": CALL_SITES}
    names = {k: [f.split()[0] for f in _top_fields(s)] for k, s in kinds.items()}

    def make(path: str, lang: str, content: str) -> Iterator[tuple]:
        g = _graph_of(path, lang, content, partial)
        rows = {"nodes": [{k: n[k] for k in names["nodes"]} for n in g.nodes], "edges": [dict(zip(names["edges"], e)) for e in _edges_of(path, g)], "sites": [{k: c[k] for k in names["sites"]} for c in g.calls]}
        yield (path, *(rows[k] for k in kinds))

    return _rows(files, "path string, " + ", ".join(f"{k} array<struct<{', '.join(f.replace(' ', ': ', 1) for f in _top_fields(s))}>>" for k, s in kinds.items()), make)


def part_of(rows: DataFrame, part: str) -> DataFrame:
    """nodes, edges or sites of graph_rows()."""
    return rows.select(F.explode(part).alias("r")).select("r.*")


def cpg_nodes(files: DataFrame) -> DataFrame:
    """CPG_NODES: functions, methods, classes, module variables, statements, and entry and exit of functions."""
    names = [f.split()[0] for f in _top_fields(CPG_NODES)]

    def make(path: str, lang: str, content: str) -> Iterator[tuple]:
        for n in _graph_of(path, lang, content).nodes:
            yield tuple(n[k] for k in names)

    return _rows(files, CPG_NODES, make)


def _edges_of(path: str, g: python_source.Graph) -> Iterator[tuple]:
    for e in g.edges:
        yield (path, *e)
    by: dict[str, list[dict]] = {}
    for n in g.nodes:
        if n["function_id"]:
            by.setdefault(n["function_id"], []).append(n)
    owner = {n["node_id"]: f for f, own in by.items() for n in own}
    inner: dict[str, list[tuple]] = {}
    for e in g.edges:
        if e[0] in owner and owner[e[0]] == owner.get(e[1]):
            inner.setdefault(owner[e[0]], []).append(e)
    for f, own in by.items():
        for d, u, v in python_source.reaching(own, inner.get(f, [])):
            yield (path, d, u, "DataFlowReach", v, None)


def cpg_edges(files: DataFrame) -> DataFrame:
    """CPG_EDGES: children, control flow, and definitions that reach a use."""
    return _rows(files, CPG_EDGES, lambda path, lang, content: _edges_of(path, _graph_of(path, lang, content)))


def call_sites(files: DataFrame) -> DataFrame:
    """CALL_SITES of functions and methods."""
    names = [f.split()[0] for f in _top_fields(CALL_SITES)]

    def make(path: str, lang: str, content: str) -> Iterator[tuple]:
        for c in _graph_of(path, lang, content).calls:
            yield tuple(c[k] for k in names)

    return _rows(files, CALL_SITES, make)


def edited(files: DataFrame, edits: DataFrame) -> DataFrame:
    """path, content, end_line, end_column: files after edits (path, seq, start_line, start_column, end_line, end_column,
    text), each on what the one before left, with where the last one's text ends.

    Lines and columns count from 0, columns in characters; a place beyond a line or the text is its
    end, but the end of the new text counts from the place that the edit names.  Files
    without an edit give no row; edits of unknown files do nothing.
    """
    listed = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "start_line", "start_column", "end_line", "end_column", "text"))).alias("edits"))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text, steps in zip(*(batch.column(i).to_pylist() for i in range(3))):
                end = (0, 0)
                for e in steps:
                    text, end = python_source.apply_edit(text or "", (e["start_line"], e["start_column"]), (e["end_line"], e["end_column"]), e["text"] or "")
                rows.append((path, text, *end))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.int32()))], names=["path", "content", "end_line", "end_column"])

    return files.join(listed, "path").select("path", "content", "edits").mapInArrow(stage, "path string, content string, end_line int, end_column int")


def excluding(files: DataFrame, folders: tuple[str, ...]) -> DataFrame:
    """Files whose folder has none of the given names in it."""
    folder = F.concat(F.lit("/"), F.regexp_replace("path", r"[^/]*$", ""))
    for name in folders:
        files = files.filter(~F.contains(folder, F.lit(name)))
    return files


def signatures(nodes: DataFrame) -> DataFrame:
    """path, name, parameters, return_type, docstring, start_byte, end_byte of functions and methods."""
    return nodes.filter(F.col("kind").isin("function", "method")).select("path", "name", "parameters", "return_type", "docstring", "start_byte", "end_byte")


def formatted_symbols(nodes: DataFrame) -> DataFrame:
    """path, start_line, line: one formatted line for each function, method and class, with its documentation's first line."""
    params = F.transform("parameters", lambda p: F.concat(p["name"], F.when(p["type_annotation"].isNotNull(), F.concat(F.lit(": "), p["type_annotation"])).otherwise(""), F.when(p["default_value"].isNotNull(), F.concat(F.lit(" = "), p["default_value"])).otherwise("")))
    function = F.concat("kind", F.lit(" "), "name", F.lit("("), F.array_join(params, ", "), F.lit(")"), F.when(F.col("return_type").isNotNull(), F.concat(F.lit(" -> "), F.col("return_type"))).otherwise(""), F.when(F.col("parent_class").isNotNull(), F.concat(F.lit("  [in class "), F.col("parent_class"), F.lit("]"))).otherwise(""))
    class_ = F.concat(F.lit("class "), "name", F.when(F.size("bases") > 0, F.concat(F.lit("("), F.array_join("bases", ", "), F.lit(")"))).otherwise(""))
    doc = F.substring_index(F.trim(F.regexp_replace("docstring", r"^\s+", "")), "\n", 1)
    line = F.concat(F.lit("  L"), "start_line", F.lit("-"), "end_line", F.lit(": "), F.when(F.col("kind") == "class", class_).otherwise(function), F.when(F.col("docstring").isNotNull(), F.concat(F.lit("\n    "), doc)).otherwise(""))
    return nodes.filter(F.col("kind").isin("function", "method", "class")).select("path", "start_line", line.alias("line"))
