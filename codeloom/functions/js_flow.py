"""Statements and control flow of JavaScript and TypeScript functions, from tokens.

The edges have the kinds of the Python flow.  A switch is one statement, as its cases aren't followed; nested
functions and classes are statements of their own whose insides count for nothing here.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .js_source import Token, _arrow_at

_WORDS = set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new of return super switch this throw try typeof var void while with yield async await static true false null undefined".split())
_KEEPS_ON = {"op"}
_ASSIGN = {"+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "++", "--"}


@dataclass
class Statement:
    """kind; tokens from, behind the last, and behind its head; blocks by role: body, other, handler, final."""

    kind: str
    first: int
    last: int
    head: int
    blocks: dict[str, list[Statement]] = field(default_factory=dict)
    defs: list[str] = field(default_factory=list)
    uses: list[str] = field(default_factory=list)


class Reader:
    """Reads the statements of a body. code: tokens without comments; pair: closing bracket of each opening one."""

    def __init__(self, text: str, code: list[Token], pair: dict[int, int]) -> None:
        self.text, self.code, self.pair = text, code, pair

    def block(self, i: int, end: int) -> list[Statement]:
        out = []
        while i < end:
            found, i = self.statement(i, end)
            out += found
        return out

    def _closing(self, i: int, end: int) -> int:
        return min(self.pair.get(i, end - 1), end - 1) + 1

    def _behind_parens(self, i: int, end: int) -> int:
        while i < end and self.code[i].text != "(":
            i += 1
        return self._closing(i, end) if i < end else end

    def _simple_end(self, i: int, end: int) -> int:
        """Behind the semicolon, or where a line break ends the statement."""
        code, j = self.code, i
        while j < end:
            t = code[j]
            if t.text == ";":
                return j + 1
            k = self._closing(j, end) if t.text in ("(", "[", "{") else j + 1
            if k < end and "\n" in self.text[code[k - 1].end : code[k].start]:
                before, after = code[k - 1], code[k]
                open_ended = before.kind == "op" and before.text not in (")", "]", "}", "++", "--")
                goes_on = after.kind == "op" and after.text not in ("{", "++", "--", "}") or after.kind == "template" or after.text in ("instanceof", "in", "of")
                if not open_ended and not goes_on and before.text not in ("const", "let", "var", "new", "typeof", "await"):
                    return k
            j = k
        return end

    def _made(self, kind: str, i: int, last: int, head: int, **blocks: list[Statement]) -> Statement:
        s = Statement(kind, i, last, head, blocks)
        s.defs, s.uses = self.names(i, head)
        return s

    def statement(self, i: int, end: int) -> tuple[list[Statement], int]:
        code, word = self.code, self.code[i].text
        if word == ";":
            return [], i + 1
        if word == "{":
            j = self._closing(i, end)
            return self.block(i + 1, j - 1), j
        if word == "if":
            head = self._behind_parens(i + 1, end)
            body, j = self.statement(head, end) if head < end else ([], end)
            other: list[Statement] | None = None
            if j < end and code[j].text == "else":
                other, j = self.statement(j + 1, end) if j + 1 < end else ([], end)
            return [self._made("if", i, j, head, body=body, **({} if other is None else {"other": other}))], j
        if word in ("for", "while", "with"):
            head = self._behind_parens(i + 1, end)
            body, j = self.statement(head, end) if head < end else ([], end)
            return [self._made("for" if word == "for" else word, i, j, head, body=body)], j
        if word == "do":
            body, j = self.statement(i + 1, end) if i + 1 < end else ([], end)
            j = self._behind_parens(j + 1, end) if j < end and code[j].text == "while" else j
            return [self._made("while", i, j, i + 1, body=body)], j
        if word == "try":
            body, j = self.statement(i + 1, end) if i + 1 < end else ([], end)
            blocks = {"body": body}
            if j < end and code[j].text == "catch":
                k = self._behind_parens(j + 1, end) if j + 1 < end and code[j + 1].text == "(" else j + 1
                blocks["handler"], j = self.statement(k, end) if k < end else ([], end)
            if j < end and code[j].text == "finally":
                blocks["final"], j = self.statement(j + 1, end) if j + 1 < end else ([], end)
            return [self._made("try", i, j, i + 1, **blocks)], j
        if word == "switch":
            k = self._behind_parens(i + 1, end)
            j = self._closing(k, end) if k < end and code[k].text == "{" else k
            return [self._made("switch", i, j, j)], j
        if word in ("function", "class") or (word == "async" and i + 1 < end and code[i + 1].text == "function"):
            k = i
            while k < end and code[k].text != "{":
                k = self._closing(k, end) if code[k].text == "(" else k + 1
            j = self._closing(k, end) if k < end else end
            s = Statement(f"other:{'class' if word == 'class' else 'function'}_declaration", i, j, j)
            s.defs = [t.text for t in code[i + 1 : i + 4] if t.kind == "name" and t.text not in _WORDS][:1]
            return [s], j
        j = self._simple_end(i, end)
        kind = {"return": "return", "throw": "raise", "break": "break", "continue": "continue", "import": "import"}.get(word)
        if kind is None:
            s = self._made("expression", i, j, j)
            top = {code[k].text for k in self._flat(i, j)}
            s.kind = "augmented_assignment" if top & _ASSIGN else "assignment" if "=" in top or word in ("const", "let", "var") else "expression"
            return [s], j
        return [self._made(kind, i, j, j)], j

    def _flat(self, i: int, end: int):
        """Tokens outside of brackets."""
        while i < end:
            yield i
            i = self._closing(i, end) if self.code[i].text in ("(", "[", "{") else i + 1

    def names(self, i: int, end: int) -> tuple[list[str], list[str]]:
        """What a head binds and reads, in order, once each; properties, keys and insides of functions are neither."""
        code, defs, uses = self.code, {}, {}
        declares, j, skipped = False, i, set()
        for k in range(i, end):  # arrow functions and function expressions
            a = _arrow_at(code, self.pair, k) if k not in skipped and code[k].text in ("(", "async") or (code[k].kind == "name" and k + 1 < end and code[k + 1].text == "=>") else None
            stop = None
            if a is not None and a < end:
                stop = self._closing(a + 1, end) if a + 1 < end and code[a + 1].text == "{" else self._arrow_end(a + 1, end)
            elif code[k].text == "function" and k > i and k not in skipped:
                b = k
                while b < end and code[b].text != "{":
                    b = self._closing(b, end) if code[b].text == "(" else b + 1
                stop = self._closing(b, end) if b < end else end
            if stop is not None:
                skipped.update(range(k, stop))
        while j < end:
            t = code[j]
            if j in skipped:
                j += 1
                continue
            if t.text in ("const", "let", "var"):
                declares = True
                j += 1
                # The pattern up to the sign or the word behind it binds.
                while j < end and code[j].text not in ("=", ";", "of", "in", ")"):
                    stop = self._closing(j, end) if code[j].text in ("{", "[") else j + 1
                    for k in range(j, stop):
                        key = code[k].kind == "name" and k + 1 < stop and code[k + 1].text == ":" and stop - j > 1
                        if code[k].kind == "name" and code[k].text not in _WORDS and not key:
                            defs.setdefault(code[k].text)
                    if code[j].text == ":":  # a type
                        defs.pop(code[j + 1].text, None) if j + 1 < end else None
                    j = stop
                continue
            if t.text == "," and declares and j + 1 < end and code[j + 1].kind == "name" and j + 2 < end and code[j + 2].text == "=":
                defs.setdefault(code[j + 1].text)
                j += 2
                continue
            if t.kind == "name" and t.text not in _WORDS and (not j or code[j - 1].text not in (".", "?.")):
                after, before = code[j + 1].text if j + 1 < end else "", code[j - 1].text if j > i else ""
                key = after == ":" and before in ("{", ",")
                if after == "=":
                    defs.setdefault(t.text)
                elif after in _ASSIGN or before in ("++", "--"):
                    defs.setdefault(t.text)
                    uses.setdefault(t.text)
                elif not key:
                    uses.setdefault(t.text)
            j += 1
        return list(defs), list(uses)

    def _arrow_end(self, i: int, end: int) -> int:
        """Behind the expression of an arrow function."""
        for k in self._flat(i, end):
            if self.code[k].text in (",", ";"):
                return k
        return end


class Flow:
    """Control flow of one function. node(statement) makes a statement's node; edge(a, b, kind) an edge."""

    def __init__(self, node, edge, exit_: str) -> None:
        self.node, self.edge, self.exit = node, edge, exit_

    def block(self, body: list[Statement], ends: list[tuple[str, str]], loop) -> list[tuple[str, str]]:
        for s in body:
            ends = self.statement(s, ends, loop)
        return ends

    def statement(self, s: Statement, ends: list[tuple[str, str]], loop) -> list[tuple[str, str]]:
        i = self.node(s)
        for at, kind in ends:
            self.edge(at, i, kind)
        if s.kind in ("return", "raise"):
            self.edge(i, self.exit, "Next")
            return []
        if s.kind in ("break", "continue"):
            if loop and s.kind == "break":
                loop[1].append((i, "Next"))
            elif loop:
                self.edge(i, loop[0], "Back")
            return []
        body = s.blocks.get("body", [])
        if s.kind == "if":
            out = self.block(body, [(i, "True")], loop)
            return out + (self.block(s.blocks["other"], [(i, "False")], loop) if "other" in s.blocks else [(i, "Next")])
        if s.kind in ("for", "while"):
            breaks: list[tuple[str, str]] = []
            for at, _ in self.block(body, [(i, "True")], (i, breaks)):
                self.edge(at, i, "Back")
            return [(i, "False"), *breaks]
        if s.kind == "try":
            out = self.block(body, [(i, "Next")], loop)
            if "handler" in s.blocks:
                out += self.block(s.blocks["handler"], [(i, "Exception")], loop)
            return self.block(s.blocks["final"], out or [(i, "Exception")], loop) if "final" in s.blocks else out
        return self.block(body, [(i, "Next")], loop) if body else [(i, "Next")]
