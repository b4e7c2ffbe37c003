"""What one Python source text holds: symbols, imports, skeleton, syntax, and a code property graph.

Pure functions of a text on the standard library's syntax trees; the operators beside run them in Arrow
stages.  A text with a syntax error has no tree: symbols and nodes are empty, and the flag says so.
"""

from __future__ import annotations

import ast
import io
import tokenize
from bisect import bisect_right
from dataclasses import dataclass, field

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
NO_NAMES = {"self", "cls", "True", "False", "None"}


class Source:
    """A text with its tree (None on a syntax error) and byte offsets.

    With partial, top-level blocks that hold a syntax error are blanked, one after the other, until the rest has a
    tree; error tells of the first one, offsets are those of the whole text.
    """

    def __init__(self, text: str, partial: bool = False) -> None:
        self.text = text
        self.data = text.encode("utf-8", "surrogatepass")
        starts, at = [0], 0
        for line in self.data.split(b"\n"):
            at += len(line) + 1
            starts.append(at)
        self.starts = starts
        self.error: tuple[int | None, str] | None = None
        try:
            self.tree: ast.Module | None = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            self.tree, self.error = None, (getattr(e, "lineno", None), getattr(e, "msg", None) or str(e))
            if partial and isinstance(e, SyntaxError):
                self.tree = _recovered(text, e)

    def begin(self, node: ast.AST) -> int:
        return self.starts[node.lineno - 1] + node.col_offset

    def end(self, node: ast.AST) -> int:
        return self.starts[node.end_lineno - 1] + node.end_col_offset

    def cut(self, a: int, b: int) -> str:
        return self.data[a:b].decode("utf-8", "replace")

    def of(self, node: ast.AST | None) -> str | None:
        return None if node is None else self.cut(self.begin(node), self.end(node))

    def line_of(self, at: int) -> int:
        return bisect_right(self.starts, at)


def _recovered(text: str, error: SyntaxError) -> ast.Module | None:
    lines = text.split("\n")
    heads = [i for i, x in enumerate(lines) if x[:1] not in ("", " ", "\t", "#", ")", "]", "}", "\r")]
    for _ in heads:
        at = bisect_right(heads, min(len(lines), error.lineno or len(lines)) - 1) - 1
        # A block that is blank by now has its trouble in what came before it.
        while at >= 0 and not any(lines[heads[at] : heads[at + 1] if at + 1 < len(heads) else len(lines)]):
            at -= 1
        if at < 0:
            return None
        end = heads[at + 1] if at + 1 < len(heads) else len(lines)
        lines[heads[at] : end] = [""] * (end - heads[at])
        try:
            return ast.parse("\n".join(lines))
        except SyntaxError as e:
            error = e
    return None


def check_syntax(text: str) -> tuple[bool, int | None, str | None]:
    try:
        compile(text, "<text>", "exec", dont_inherit=True)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return False, getattr(e, "lineno", None), getattr(e, "msg", None) or str(e)
    return True, None, None


# ---- symbols


def _name_after(src: Source, node: ast.AST, word: str) -> tuple[int, int]:
    """Bytes of the name that a def or class statement defines."""
    head = src.cut(src.begin(node), src.end(node))
    at = head.index(node.name, head.index(word) + len(word))
    start = src.begin(node) + len(head[:at].encode())
    return start, start + len(node.name.encode())


def symbols(src: Source) -> list[tuple[str, str, int, int, bool]]:
    """(name, kind, start, end, is_definition) by position; a name used in two ways is there twice."""
    if src.tree is None:
        return []
    out: list[tuple[str, str, int, int, bool]] = []

    def define(name: str, kind: str, span: tuple[int, int]) -> None:
        out.append((name, kind, *span, True))

    def use(node: ast.AST | None, kind: str) -> None:
        if isinstance(node, ast.Name):
            out.append((node.id, kind, src.begin(node), src.end(node), False))

    def use_root(node: ast.AST | None) -> None:
        use(node, "variable")
        if isinstance(node, ast.Attribute):
            use(node.value, "variable")

    def types_in(node: ast.AST | None) -> None:
        if isinstance(node, ast.Name):
            use(node, "type")

    for node in ast.walk(src.tree):
        if isinstance(node, FUNCTIONS):
            define(node.name, "function", _name_after(src, node, "def"))
            types_in(node.returns)
            for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, node.args.vararg, node.args.kwarg]:
                if a is not None:
                    types_in(a.annotation)
        elif isinstance(node, ast.ClassDef):
            define(node.name, "class", _name_after(src, node, "class"))
            for b in node.bases:
                use(b, "argument")
            for k in node.keywords:
                use(k.value, "argument")
        elif isinstance(node, ast.Assign):
            for t in node.targets:
                if isinstance(t, ast.Name):
                    define(t.id, "variable", (src.begin(t), src.end(t)))
            use_root(node.value)
        elif isinstance(node, ast.AnnAssign):
            if isinstance(node.target, ast.Name):
                define(node.target.id, "variable", (src.begin(node.target), src.end(node.target)))
            types_in(node.annotation)
            use_root(node.value)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            for a in node.names:
                if a.asname:
                    define(a.asname, "variable", (src.end(a) - len(a.asname.encode()), src.end(a)))
        elif isinstance(node, ast.comprehension):
            if isinstance(node.target, ast.Name):
                define(node.target.id, "variable", (src.begin(node.target), src.end(node.target)))
        elif isinstance(node, ast.Call):
            use(node.func, "call")
            if isinstance(node.func, ast.Attribute):
                out.append((node.func.attr, "method", src.end(node.func) - len(node.func.attr.encode()), src.end(node.func), False))
            for a in node.args:
                use(a, "argument")
            for k in node.keywords:
                use(k.value, "argument")
        elif isinstance(node, ast.Return):
            use_root(node.value)
        elif isinstance(node, ast.Subscript):
            use(node.value, "variable")
        if isinstance(node, ast.Attribute):
            use(node.value, "variable")
    # A usage that several rules see counts once for each kind.
    return sorted(set(out), key=lambda s: (s[2], s[3], s[1], s[4]))


# ---- imports


def imports(src: Source) -> list[tuple[int, str, int, str, str | None, str | None, int]]:
    """(statement, form, level, module, name, alias, line): one row for each imported name, in order of statements."""
    if src.tree is None:
        return []
    found = sorted((n for n in ast.walk(src.tree) if isinstance(n, (ast.Import, ast.ImportFrom))), key=lambda n: (n.lineno, n.col_offset))
    rows = []
    for i, node in enumerate(found):
        for a in node.names:
            if isinstance(node, ast.Import):
                rows.append((i, "import", 0, a.name, None, a.asname, node.lineno))
            else:
                rows.append((i, "from", node.level, node.module or "", a.name, a.asname, node.lineno))
    return rows


# ---- skeleton


def _is_docstring(node: ast.AST) -> bool:
    return isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str)


def _first_of(node: ast.AST) -> ast.AST:
    """The node, or the first of its decorators."""
    decorators = getattr(node, "decorator_list", [])
    return min(decorators, key=lambda d: (d.lineno, d.col_offset)) if decorators else node


def skeleton(src: Source) -> str | None:
    """Imports, signatures, docstrings and class headers; bodies are "..."; null on a syntax error.

    Decorators and module code are dropped; a gap becomes one line break, or two where it had more.
    """
    if src.tree is None:
        return None
    pieces: list[tuple[int, int, str | None]] = []

    def header_end(node: ast.AST) -> int:
        """Where the body begins, white space before it left out."""
        first = node.body[0]
        at = src.begin(_first_of(first))
        if getattr(first, "decorator_list", []):
            at = src.data.rfind(b"@", 0, at + 1)
        return len(src.data[:at].rstrip(b" \t\r\n\f"))

    def strip_comments(a: int, b: int) -> int:
        """The end of the header's colon: comments between it and the body fall into the gap."""
        colon = a
        try:
            depth = 0
            for t in tokenize.generate_tokens(io.StringIO(src.cut(a, b) + "\n").readline):
                if t.type == tokenize.OP:
                    depth += (t.string in "([{") - (t.string in ")]}")
                    if t.string == ":" and depth == 0:
                        lines = src.cut(a, b).split("\n")
                        return a + len(("\n".join([*lines[: t.end[0] - 1], lines[t.end[0] - 1][: t.end[1]]])).encode())
        except (tokenize.TokenError, IndentationError, SyntaxError):
            pass
        return max(colon, b)

    def indent(node: ast.AST) -> str:
        first = _first_of(node.body[0])
        begin = src.begin(first)
        before = src.cut(src.data.rfind(b"\n", 0, begin) + 1, begin)
        return before if not before.strip(" \t@") else "    "

    def function(node: ast.AST) -> None:
        end = strip_comments(src.begin(node), header_end(node))
        pieces.append((src.begin(node), end, None))
        first = node.body[0]
        if _is_docstring(first):
            pieces.append((src.begin(first), src.end(first), None))
            end = src.end(first)
        pieces.append((end, end, f"\n{indent(node).replace('@', '')}..."))

    def visit(node: ast.AST) -> None:
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            pieces.append((src.begin(node), src.end(node), None))
        elif isinstance(node, FUNCTIONS):
            function(node)
        elif isinstance(node, ast.ClassDef):
            pieces.append((src.begin(node), strip_comments(src.begin(node), header_end(node)), None))
            if _is_docstring(node.body[0]):
                pieces.append((src.begin(node.body[0]), src.end(node.body[0]), None))
            for child in node.body:
                if isinstance(child, FUNCTIONS) or (isinstance(child, ast.ClassDef) and child.decorator_list):
                    visit(child)

    for child in src.tree.body:
        visit(child)
    out, last = [], 0
    for a, b, instead in sorted(pieces, key=lambda p: p[0]):
        if a > last:
            gap = src.data[last:a]
            breaks = gap.count(b"\n")
            before = src.cut(src.data.rfind(b"\n", 0, a) + 1, a)
            out.append("\n" * min(breaks, 2) + (before if breaks and not before.strip() else ""))
        out.append(src.cut(a, b) if instead is None else instead)
        last = b
    text = "".join(out).lstrip("\n") if out else ""
    return text if not text or text.endswith("\n") else text + "\n"


def plain_signatures(text: str) -> str:
    """Lines that begin a definition, where no tree is to be had."""
    return "\n".join(x for x in text.split("\n") if x.strip().startswith(("def ", "class ", "async def ", "fn ")))


# ---- code property graph


@dataclass
class Graph:
    """Rows of one file. node: a dictionary of CPG_NODES; edge: (src, dst, kind, variable, position)."""

    nodes: list[dict] = field(default_factory=list)
    edges: list[tuple[str, str, str, str | None, int | None]] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)


_STATEMENTS = {
    ast.Assign: "assignment", ast.AnnAssign: "assignment", ast.AugAssign: "augmented_assignment", ast.Expr: "expression", ast.Return: "return", ast.If: "if", ast.For: "for", ast.AsyncFor: "for",
    ast.While: "while", ast.Try: "try", ast.With: "with", ast.AsyncWith: "with", ast.Match: "match", ast.Break: "break", ast.Continue: "continue", ast.Pass: "pass", ast.Raise: "raise",
    ast.Import: "import", ast.ImportFrom: "import", ast.Assert: "assert", ast.Delete: "delete", ast.Global: "other:global_statement", ast.Nonlocal: "other:nonlocal_statement",
    ast.FunctionDef: "other:function_definition", ast.AsyncFunctionDef: "other:function_definition", ast.ClassDef: "other:class_definition",
}
if hasattr(ast, "TryStar"):
    _STATEMENTS[ast.TryStar] = "try"


def _names(*nodes: ast.AST | None) -> list[str]:
    """Names read below the nodes, in order, once each; nested definitions and lambdas aren't entered."""
    out: dict[str, None] = {}

    def walk(n: ast.AST) -> None:
        if isinstance(n, (*FUNCTIONS, ast.ClassDef, ast.Lambda)):
            return
        if isinstance(n, ast.Name) and n.id not in NO_NAMES:
            out.setdefault(n.id)
        for c in ast.iter_child_nodes(n):
            walk(c)

    for n in nodes:
        if n is not None:
            walk(n)
    return list(out)


def _targets(node: ast.AST | None) -> list[str]:
    """Plain names that an assignment target binds; attributes and subscripts bind none."""
    if isinstance(node, ast.Name):
        return [node.id] if node.id not in NO_NAMES else []
    if isinstance(node, ast.Starred):
        return _targets(node.value)
    if isinstance(node, (ast.Tuple, ast.List)):
        return [n for e in node.elts for n in _targets(e)]
    return []


def defs_and_uses(s: ast.AST) -> tuple[list[str], list[str]]:
    """What a statement itself binds and reads; of compound ones their head counts."""
    if isinstance(s, ast.Assign):
        indirect = [t for t in s.targets if not isinstance(t, ast.Name)]
        read = [n for t in indirect for n in _names(t) if n not in _targets(t)]
        return [n for t in s.targets for n in _targets(t)], list(dict.fromkeys([*_names(s.value), *read]))
    if isinstance(s, ast.AnnAssign):
        return (_targets(s.target) if s.value is not None else []), _names(s.value)
    if isinstance(s, ast.AugAssign):
        d = _targets(s.target)
        return d, list(dict.fromkeys([*(d or _names(s.target)), *_names(s.value)]))
    if isinstance(s, (ast.For, ast.AsyncFor)):
        return _targets(s.target), _names(s.iter)
    if isinstance(s, (ast.With, ast.AsyncWith)):
        return [n for i in s.items for n in _targets(i.optional_vars)], _names(*(i.context_expr for i in s.items))
    if isinstance(s, ast.Import):
        return [a.asname or a.name.split(".")[0] for a in s.names], []
    if isinstance(s, ast.ImportFrom):
        return [a.asname or a.name for a in s.names if a.name != "*"], []
    if isinstance(s, (ast.If, ast.While)):
        return [], _names(s.test)
    if isinstance(s, (*FUNCTIONS, ast.ClassDef)):
        return [s.name], []
    return [], _names(s)


class Builder:
    """Builds the graph of one file. node_id(kind, start, end, name) must depend on nothing else but the path."""

    def __init__(self, src: Source, path: str, node_id) -> None:
        self.src, self.path, self.node_id, self.graph = src, path, node_id, Graph()

    def node(self, name: str, kind: str, start: int, end: int, **more) -> str:
        i = self.node_id(kind, start, end, name)
        row = {
            "node_id": i, "path": self.path, "name": name, "kind": kind, "start_byte": start, "end_byte": end, "start_line": self.src.line_of(start), "end_line": self.src.line_of(max(start, end - 1)),
            "parameters": [], "return_type": None, "docstring": None, "bases": [], "parent_class": None, "statement_kind": None, "function_id": None, "defs": [], "uses": [],
        }
        self.graph.nodes.append(row | more)
        return i

    def edge(self, a: str, b: str, kind: str, variable: str | None = None, position: int | None = None) -> None:
        self.graph.edges.append((a, b, kind, variable, position))

    def build(self) -> Graph:
        if self.src.tree is not None:
            for n in self.src.tree.body:
                if isinstance(n, FUNCTIONS):
                    self.function(n, None)
                elif isinstance(n, ast.ClassDef):
                    self.class_(n)
                elif isinstance(n, (ast.Assign, ast.AnnAssign)):
                    for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                        if isinstance(t, ast.Name):
                            self.node(t.id, "variable", self.src.begin(n), self.src.end(n))
        return self.graph

    def class_(self, n: ast.ClassDef) -> None:
        i = self.node(n.name, "class", self.src.begin(n), self.src.end(n), bases=[self.src.of(b) for b in n.bases], docstring=ast.get_docstring(n, clean=False))
        for c in n.body:
            if isinstance(c, FUNCTIONS):
                self.edge(i, self.function(c, n.name), "AstChild")

    def parameters(self, a: ast.arguments) -> list[dict]:
        out, plain = [], [*a.posonlyargs, *a.args]
        defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)

        def add(arg: ast.arg, default: ast.AST | None, mark: str = "") -> None:
            out.append({"name": mark + arg.arg, "type_annotation": self.src.of(arg.annotation), "default_value": self.src.of(default)})

        for arg, d in zip(plain, defaults):
            add(arg, d)
        if a.vararg:
            add(a.vararg, None, "*")
        for arg, d in zip(a.kwonlyargs, a.kw_defaults):
            add(arg, d)
        if a.kwarg:
            add(a.kwarg, None, "**")
        return out

    def function(self, n: ast.FunctionDef | ast.AsyncFunctionDef, parent: str | None) -> str:
        start, end, given = self.src.begin(n), self.src.end(n), self.parameters(n.args)
        i = self.node(n.name, "method" if parent else "function", start, end, parameters=given, return_type=self.src.of(n.returns), docstring=ast.get_docstring(n, clean=False), parent_class=parent)
        own = [p["name"].lstrip("*") for p in given]
        entry = self.node("entry", "cfg_entry", start, end, function_id=i, defs=[p for p in own if p not in NO_NAMES])
        exit_ = self.node("exit", "cfg_exit", start, end, function_id=i)
        flow = _Flow(self, i, exit_)
        for at, kind in flow.block(n.body, [(entry, "Next")], None):
            self.edge(at, exit_, "ControlFlowBack" if kind == "Back" else f"ControlFlow{kind}")
        return i

    def calls_in(self, s: ast.AST, statement: str, caller: str) -> None:
        """Call sites of a statement: one row a call, at the innermost statement that holds it."""
        inner = {id(x) for c in ast.walk(s) if c is not s and isinstance(c, ast.stmt) for x in ast.walk(c)}
        for c in ast.walk(s):
            if not isinstance(c, ast.Call) or id(c) in inner:
                continue
            if isinstance(c.func, ast.Name):
                name, receiver = c.func.id, None
            elif isinstance(c.func, ast.Attribute):
                name, receiver = c.func.attr, self.src.of(c.func.value)
            else:
                continue
            start, end = self.src.begin(c), self.src.end(c)
            self.graph.calls.append({
                "site_id": self.node_id("call", start, end, name), "path": self.path, "statement_id": statement, "caller_id": caller, "callee_name": name, "receiver": receiver,
                "positional_args": [self.src.of(a) for a in c.args if not isinstance(a, ast.Starred)], "keyword_args": [{"name": k.arg, "value": self.src.of(k.value)} for k in c.keywords if k.arg],
                "start_byte": start, "end_byte": end, "line": c.lineno,
            })


class _Flow:
    """Control flow of one function. Loose ends are (statement, kind of the edge that leaves it)."""

    def __init__(self, builder: Builder, function_id: str, exit_: str) -> None:
        self.b, self.function_id, self.exit = builder, function_id, exit_

    def link(self, ends: list[tuple[str, str]], to: str) -> None:
        for at, kind in ends:
            self.b.edge(at, to, f"ControlFlow{kind}")

    def block(self, body: list[ast.stmt], ends: list[tuple[str, str]], loop: tuple[str, list] | None) -> list[tuple[str, str]]:
        """Loose ends behind the statements; what can't be reached has no edge into it."""
        for s in body:
            ends = self.statement(s, ends, loop)
        return ends

    def statement(self, s: ast.stmt, ends: list[tuple[str, str]], loop: tuple[str, list] | None) -> list[tuple[str, str]]:
        b, src = self.b, self.b.src
        kind = _STATEMENTS.get(type(s), f"other:{type(s).__name__.lower()}")
        defs, uses = defs_and_uses(s)
        start = src.begin(s)
        first = (src.cut(start, src.end(s)).split("\n")[0])[:60]
        i = b.node(f"{kind}: {first}", "statement", start, src.end(s), statement_kind=kind, function_id=self.function_id, defs=defs, uses=uses)
        b.edge(self.function_id, i, "AstChild")
        if not isinstance(s, (*FUNCTIONS, ast.ClassDef)):
            b.calls_in(s, i, self.function_id)
        self.link(ends, i)
        if isinstance(s, (ast.Return, ast.Raise)):
            b.edge(i, self.exit, "ControlFlowNext")
            return []
        if isinstance(s, ast.Break):
            if loop:
                loop[1].append((i, "Next"))
            return []
        if isinstance(s, ast.Continue):
            if loop:
                b.edge(i, loop[0], "ControlFlowBack")
            return []
        if isinstance(s, ast.If):
            out = self.block(s.body, [(i, "True")], loop)
            return out + (self.block(s.orelse, [(i, "False")], loop) if s.orelse else [(i, "Next")])
        if isinstance(s, (ast.For, ast.AsyncFor, ast.While)):
            breaks: list[tuple[str, str]] = []
            for at, _ in self.block(s.body, [(i, "True")], (i, breaks)):
                b.edge(at, i, "ControlFlowBack")
            return (self.block(s.orelse, [(i, "False")], loop) if s.orelse else [(i, "False")]) + breaks
        if isinstance(s, ast.Try) or type(s).__name__ == "TryStar":
            out = self.block(s.orelse, self.block(s.body, [(i, "Next")], loop), loop)
            for h in s.handlers:
                out += self.block(h.body, [(i, "Exception")], loop)
            if s.finalbody:
                return self.block(s.finalbody, out if out else [(i, "Exception")], loop)
            return out
        if isinstance(s, (ast.With, ast.AsyncWith)):
            return self.block(s.body, [(i, "Next")], loop)
        if isinstance(s, ast.Match):
            out = [x for c in s.cases for x in self.block(c.body, [(i, "Next")], loop)]
            return out if s.cases else [(i, "Next")]
        return [(i, "Next")]


def reaching(nodes: list[dict], edges: list[tuple[str, str, str, str | None, int | None]]) -> list[tuple[str, str, str]]:
    """(definition, use, variable): definitions that reach each use within one function's control flow."""
    follow: dict[str, list[str]] = {}
    for a, b, kind, *_ in edges:
        if kind.startswith("ControlFlow"):
            follow.setdefault(a, []).append(b)
    by_id = {n["node_id"]: n for n in nodes}
    into: dict[str, set[tuple[str, str]]] = {i: set() for i in by_id}
    todo = list(by_id)
    while todo:
        i = todo.pop()
        n = by_id[i]
        out = {(d, v) for d, v in into[i] if v not in n["defs"]} | {(i, v) for v in n["defs"]}
        for j in follow.get(i, []):
            if j in into and not out <= into[j]:
                into[j] |= out
                todo.append(j)
    return sorted((d, i, v) for i, n in by_id.items() for d, v in into[i] if v in n["uses"])


def normalized(src: Source) -> list[tuple[int, int, int, str, str | None, int, int]]:
    """(number, parent, depth, kind, text of leaves, start, end) of the tree without wrappers of a single child."""
    if src.tree is None:
        return []
    rows: list[tuple[int, int, int, str, str | None, int, int]] = []

    def walk(n: ast.AST, parent: int, depth: int) -> None:
        children = [c for c in ast.iter_child_nodes(n) if hasattr(c, "lineno")]
        if isinstance(n, ast.Expr) and len(children) == 1:
            return walk(children[0], parent, depth)
        number = len(rows)
        if isinstance(n, ast.Module):
            rows.append((number, parent, depth, "Module", None, 0, len(src.data)))
        else:
            rows.append((number, parent, depth, type(n).__name__, None if children else src.of(n), src.begin(n), src.end(n)))
        for c in sorted(children, key=lambda c: (c.lineno, c.col_offset)):
            walk(c, number, depth + 1)
        return None

    walk(src.tree, -1, 0)
    return rows


def position_to_byte(text: str, line: int, column: int) -> int:
    """Byte offset of a 0-based line and column (characters); beyond a line's end it is that end."""
    lines = text.split("\n")
    if line >= len(lines):
        return len(text.encode())
    return len("\n".join([*lines[:line], lines[line][:column]]).encode()) if line else len(lines[0][:column].encode())


def apply_edit(text: str, start: tuple[int, int], end: tuple[int, int], new: str) -> tuple[str, tuple[int, int]]:
    """The text with start..end (line, column) replaced, and where the new text ends."""
    data = text.encode()
    a, b = position_to_byte(text, *start), position_to_byte(text, *end)
    lines = new.split("\n")
    stop = (start[0] + len(lines) - 1, len(lines[-1]) + (start[1] if len(lines) == 1 else 0))
    return (data[:a] + new.encode() + data[b:]).decode("utf-8", "replace"), stop
