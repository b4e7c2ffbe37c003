"""What a JavaScript or TypeScript text holds, by tokens: symbols, imports, functions and classes, calls.

There is no parser at hand; a tokenizer that knows strings, templates, comments and regular expressions, and
matching brackets, is enough for declarations and calls.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import accumulate

_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<template>`(?:\\.|\$\{(?:[^{}]|\{[^{}]*\})*\}|[^`\\])*`?)|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)"
    r"|(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$][\w$]*|#[A-Za-z_$][\w$]*)|(?P<op>=>|\?\.|\.\.\.|[=!]==?|&&|\|\||\?\?|[-+*/%&|^<>=!]=|\+\+|--|[^\w\s])",
    re.DOTALL,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_WORDS_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do"}
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "super", "import", "constructor", "do", "else", "with", "in", "of", "new", "class"}
_MODIFIERS = {"static", "async", "get", "set", "public", "private", "protected", "readonly", "abstract", "override", "declare"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


def tokens(text: str) -> list[Token]:
    """Tokens without white space; comments stay, for documentation."""
    out: list[Token] = []
    at, last = 0, None
    while at < len(text):
        if text[at] == "/" and (last is None or (last.kind == "op" and last.text not in (")", "]", "}")) or last.text in _WORDS_BEFORE_REGEX):
            m = _REGEX.match(text, at)
            if m:
                last = Token("regex", m[0], at, m.end())
                out.append(last)
                at = m.end()
                continue
        m = _TOKEN.match(text, at)
        if not m:
            at += 1
            continue
        kind = m.lastgroup or "op"
        if kind != "space":
            t = Token(kind, m[0], at, m.end())
            out.append(t)
            if kind != "comment":
                last = t
        at = m.end()
    return out


def _partners(ts: list[Token]) -> dict[int, int]:
    """Index of the closing bracket of each opening one; brackets without a partner are left out."""
    open_, out, pairs = [], {}, {"(": ")", "[": "]", "{": "}"}
    for i, t in enumerate(ts):
        if t.kind == "op" and t.text in pairs:
            open_.append((pairs[t.text], i))
        elif t.kind == "op" and t.text in (")", "]", "}"):
            while open_ and open_[-1][0] != t.text:
                open_.pop()
            if open_:
                out[open_.pop()[1]] = i
    return out


def check_syntax(text: str) -> tuple[bool, int | None, str | None]:
    """Brackets and quotes must close; the line is that of the first that doesn't."""
    stack, pairs = [], {"(": ")", "[": "]", "{": "}"}
    for t in tokens(text):
        line = text.count("\n", 0, t.start) + 1
        if t.kind in ("string", "template") and (len(t.text) < 2 or t.text[-1] != t.text[0]):
            return False, line, "quote is not closed"
        if t.kind == "op" and t.text in pairs:
            stack.append((pairs[t.text], line))
        elif t.kind == "op" and t.text in (")", "]", "}"):
            if not stack or stack[-1][0] != t.text:
                return False, line, f"'{t.text}' closes nothing"
            stack.pop()
    return (False, stack[-1][1], f"'{stack[-1][0]}' is missing") if stack else (True, None, None)


@dataclass
class Definition:
    name: str
    kind: str
    start: int
    end: int
    name_start: int
    parameters: list[dict]
    bases: list[str]
    parent: str | None
    doc: str | None
    return_type: str | None


def _arrow_at(code: list[Token], pair: dict[int, int], i: int) -> int | None:
    """Index of the => of an arrow function whose value begins at i."""
    if i < len(code) and code[i].text == "async":
        i += 1
    if i < len(code) and code[i].text == "<":
        while i < len(code) and code[i].text != "(":
            i += 1
    if i < len(code) and code[i].text == "(" and i in pair:
        j = pair[i] + 1
        while j < len(code) and code[j].text not in ("=>", ";", "{", "=", ","):
            j += 1
        return j if j < len(code) and code[j].text == "=>" else None
    if i + 1 < len(code) and code[i].kind == "name" and code[i + 1].text == "=>":
        return i + 1
    return None


def _parameters(text: str, code: list[Token], pair: dict[int, int], open_: int) -> list[dict]:
    out, i, end = [], open_ + 1, pair[open_]
    while i < end:
        start, depth = i, 0
        while i < end and (depth or code[i].text != ","):
            depth += (code[i].text in "([{<") - (code[i].text in (")", "]", "}", ">"))
            i += 1
        part = [t for t in code[start:i] if t.text not in _MODIFIERS]
        if part:
            rest = part[0].text == "..."
            colon = next((k for k, t in enumerate(part) if t.text == ":" and k), None)
            equal = next((k for k, t in enumerate(part) if t.text == "="), None)
            stop = min(x for x in (colon, equal, len(part)) if x is not None)
            name = text[part[0].start : part[stop - 1].end].replace(" ", "").rstrip("?") if stop else part[0].text
            note = text[part[colon + 1].start : part[(equal or len(part)) - 1].end] if colon is not None and colon + 1 < len(part) and (equal is None or colon < equal) else None
            value = text[part[equal + 1].start : part[-1].end] if equal is not None and equal + 1 < len(part) else None
            out.append({"name": name if not rest or name.startswith("...") else "..." + name, "type_annotation": note, "default_value": value})
        i += 1
    return out


def definitions(text: str) -> list[Definition]:
    """Functions, arrow constants, classes, methods, variables, interfaces, type aliases and enums."""
    everything = tokens(text)
    code = [t for t in everything if t.kind != "comment"]
    comments = {t.end: t for t in everything if t.kind == "comment"}
    pair, out = _partners(code), []
    classes: list[tuple[int, int, str]] = []

    def doc_before(start: int) -> str | None:
        at = len(text[:start].rstrip())
        c = comments.get(at)
        if c is None or not c.text.startswith("/**"):
            return None
        return "\n".join(x.strip().lstrip("*").strip() for x in c.text[3:-2].split("\n")).strip() or None

    def first_of(i: int) -> int:
        while i and code[i - 1].text in ("export", "default", "async", "const", "let", "var", "abstract", "declare"):
            i -= 1
        return i

    def block_end(i: int) -> int:
        """End of the body that begins at or behind token i."""
        while i < len(code) and code[i].text not in ("{", ";"):
            i = pair[i] + 1 if code[i].text in ("(", "[") and i in pair else i + 1
        return code[pair[i]].end if i in pair else code[min(i, len(code) - 1)].end

    def returned(i: int) -> str | None:
        if i < len(code) and code[i].text == ":":
            j = i + 1
            while j < len(code) and code[j].text not in ("{", ";", "=>"):
                j += 1
            return text[code[i + 1].start : code[j - 1].end] if j > i + 1 else None
        return None

    for i, t in enumerate(code):
        if t.kind != "name":
            continue
        after = code[i + 1] if i + 1 < len(code) else None
        begin = code[first_of(i)].start
        member = i and code[i - 1].text in (".", "?.")
        if member:
            continue
        if t.text == "function" and after:
            j = i + 2 if after.text == "*" else i + 1
            if j + 1 < len(code) and code[j].kind == "name":
                k = next((k for k in range(j, len(code)) if code[k].text == "("), None)
                if k in pair:
                    out.append(Definition(code[j].text, "function", begin, block_end(pair[k] + 1), code[j].start, _parameters(text, code, pair, k), [], None, doc_before(begin), returned(pair[k] + 1)))
        elif t.text == "class" and after and after.kind == "name" and after.text not in ("extends", "implements"):
            k = next((k for k in range(i, len(code)) if code[k].text == "{"), None)
            if k in pair:
                head = code[i + 2 : k]
                bases, keep = [], False
                for h in head:
                    keep = True if h.text in ("extends", "implements") else keep
                    if keep and h.kind == "name" and h.text not in ("extends", "implements"):
                        bases.append(h.text)
                classes.append((k, pair[k], after.text))
                out.append(Definition(after.text, "class", begin, code[pair[k]].end, after.start, [], bases, None, doc_before(begin), None))
        elif t.text in ("interface", "enum") and after and after.kind == "name":
            k = next((k for k in range(i, len(code)) if code[k].text == "{"), None)
            if k in pair:
                out.append(Definition(after.text, t.text, begin, code[pair[k]].end, after.start, [], [], None, doc_before(begin), None))
        elif t.text == "type" and after and after.kind == "name" and i + 2 < len(code) and code[i + 2].text in ("=", "<"):
            k = next((k for k in range(i, len(code)) if code[k].text == ";"), len(code) - 1)
            out.append(Definition(after.text, "type", begin, code[k].end, after.start, [], [], None, doc_before(begin), None))
        elif t.text in ("const", "let", "var") and after and after.kind == "name":
            equal = next((k for k in range(i + 2, min(i + 40, len(code))) if code[k].text in ("=", ";")), None)
            arrow = _arrow_at(code, pair, equal + 1) if equal and code[equal].text == "=" else None
            k = i + 1
            end = next((code[k].end for k in range(i, len(code)) if code[k].text == ";"), code[-1].end)
            if arrow is not None:
                open_ = next((k for k in range(equal, arrow) if code[k].text == "(" and k in pair), None)
                given = _parameters(text, code, pair, open_) if open_ is not None else [{"name": code[arrow - 1].text, "type_annotation": None, "default_value": None}]
                stop = code[pair[arrow + 1]].end if arrow + 1 in pair and code[arrow + 1].text == "{" else end
                out.append(Definition(after.text, "function", begin, stop, after.start, given, [], None, doc_before(begin), returned(pair[open_] + 1) if open_ is not None else None))
                end = stop
            out.append(Definition(after.text, "variable", begin, end, after.start, [], [], None, None, None))
            del k
    for open_, close, name in classes:
        i = open_ + 1
        while i < close:
            t = code[i]
            if t.text in ("{", "(", "[") and i in pair:
                i = pair[i] + 1
                continue
            is_head = t.kind == "name" and i + 1 < close and code[i + 1].text in ("(", "<")
            if is_head and t.text not in ("if", "for", "while", "switch", "catch", "return") and code[i - 1].text not in (".", "?.", "=", "new", "return", ":"):
                k = next((k for k in range(i + 1, close) if code[k].text == "("), None)
                j = pair.get(k, close) + 1 if k is not None else close
                stop = next((x for x in range(j, close) if code[x].text in ("{", ";")), None)
                if k in pair and stop is not None and code[stop].text == "{" and stop in pair:
                    b = i
                    while code[b - 1].text in _MODIFIERS or code[b - 1].text == "*":
                        b -= 1
                    out.append(Definition(t.text, "method", code[b].start, code[pair[stop]].end, t.start, _parameters(text, code, pair, k), [], name, doc_before(code[b].start), returned(j)))
                    i = pair[stop] + 1
                    continue
            i += 1
    return sorted(out, key=lambda d: (d.name_start, d.kind))


def calls(text: str) -> list[tuple[str, str | None, list[str], int, int]]:
    """(name, receiver, positional arguments, start, end) of calls and of new expressions, by position."""
    code = [t for t in tokens(text) if t.kind != "comment"]
    pair, out = _partners(code), []
    heads = {d.name_start for d in definitions(text) if d.kind in ("function", "method")}
    for i, t in enumerate(code):
        if t.kind != "name" or i + 1 >= len(code) or code[i + 1].text != "(" or i + 1 not in pair or t.text in _NOT_CALLS or t.start in heads:
            continue
        receiver, start = None, t.start
        if i >= 2 and code[i - 1].text in (".", "?."):
            j = i - 2
            while j >= 2 and code[j - 1].text in (".", "?.") and code[j].kind == "name":
                j -= 2
            receiver, start = text[code[j].start : code[i - 2].end], code[j].start
        end = pair[i + 1]
        args = [text[p[0] : p[1]] for p in _arguments(code, i + 1, end)]
        out.append((t.text, receiver, args, start, code[end].end))
    return out


def _arguments(code: list[Token], open_: int, close: int) -> list[tuple[int, int]]:
    out, start, depth = [], open_ + 1, 0
    for i in range(open_ + 1, close + 1):
        if i == close or (code[i].text == "," and not depth):
            if i > start and code[start].text != "...":
                out.append((code[start].start, code[i - 1].end))
            start = i + 1
        else:
            depth += (code[i].text in ("(", "[", "{")) - (code[i].text in (")", "]", "}"))
    return out


def symbols(text: str) -> list[tuple[str, str, int, int, bool]]:
    """(name, kind, start, end, is_definition) in bytes, by position."""
    ends = [0] if text.isascii() else [0, *accumulate(len(c.encode("utf-8", "surrogatepass")) for c in text)]

    def byte(i: int) -> int:
        return i if len(ends) == 1 else ends[i]

    out = [(d.name, d.kind, byte(d.name_start), byte(d.name_start + len(d.name)), True) for d in definitions(text)]
    code = [t for t in tokens(text) if t.kind != "comment"]
    new = {code[i + 1].start for i in range(len(code) - 1) if code[i].text == "new" and code[i + 1].kind == "name"}
    for i, t in enumerate(code):
        if t.start in new:
            out.append((t.text, "class", byte(t.start), byte(t.end), False))
    for name, receiver, _, start, end in calls(text):
        at = start if receiver is None else text.index(name, start + len(receiver))
        if at not in new:
            out.append((name, "call", byte(at), byte(at + len(name)), False))
    return sorted(set(out), key=lambda s: (s[2], s[3], s[1], s[4]))


def imports(text: str) -> list[tuple[int, str, str, str | None, str | None, int]]:
    """(statement, form, module, name, alias, line) of imports, re-exports and require calls."""
    code = [t for t in tokens(text) if t.kind != "comment"]
    out, n = [], 0

    def module(t: Token) -> str:
        return t.text[1:-1]

    for i, t in enumerate(code):
        line = text.count("\n", 0, t.start) + 1
        if t.text in ("import", "export") and (not i or code[i - 1].text not in (".", "?.")):
            j = i + 1
            if j < len(code) and code[j].kind == "string" and t.text == "import":
                out.append((n, "import", module(code[j]), None, None, line))
                n += 1
                continue
            while j < len(code) and code[j].text not in (";", "=", "(") and not (code[j].text == "from" and j + 1 < len(code) and code[j + 1].kind == "string") and j - i < 400:
                j += 1
            if j < len(code) and code[j].text == "from":
                for name, alias in _clause(code[i + 1 : j]) or [(None, None)]:
                    out.append((n, t.text, module(code[j + 1]), name, alias, line))
                n += 1
            elif t.text == "import" and i + 2 < len(code) and code[i + 1].text == "(" and code[i + 2].kind == "string":
                out.append((n, "import", module(code[i + 2]), None, None, line))
                n += 1
        elif t.text == "require" and i + 2 < len(code) and code[i + 1].text == "(" and code[i + 2].kind == "string":
            out.append((n, "require", module(code[i + 2]), None, None, line))
            n += 1
    return out


def _clause(part: list[Token]) -> list[tuple[str, str | None]]:
    """Imported (name, alias): default as "default", a namespace as "*"."""
    out, i = [], 0
    while i < len(part):
        t = part[i]
        if t.kind == "name" and t.text not in ("type", "as") or t.text == "*":
            name, alias = t.text, None
            if i + 2 < len(part) and part[i + 1].text == "as":
                alias, i = part[i + 2].text, i + 2
            inside = any(x.text == "{" for x in part[: part.index(t)])
            out.append((name, alias) if inside or name == "*" else ("default", name))
        i += 1
    return out
