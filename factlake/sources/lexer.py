"""Source text -> the flat relation ``nodes``: a tolerant lexer with a bracket matcher.

There is no compiler here. Strings, templates, regular-expression literals and comments are told
apart, brackets are matched, and the kinds of node that the fact extractors need are recognised
from the tokens around brackets and keywords. Limits: types and JSX are read as plain tokens;
template substitutions are not entered; statements are recognised at line starts inside blocks; an
arrow body without braces ends at the first comma, semicolon or closing bracket of its level.
A file that cannot be read yields one row of kind ``Unreadable`` (see ``unreadable``).

Nodes come in pre-order (``ord``); ``parent_ord`` is the innermost node around one.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shipping import ship

SCHEMA = (
    "file string, ord int, parent_ord int, kind string, name string, start_line int, end_line int, "
    "start_off int, end_off int, text string, callee string, callee_object string, args array<string>, "
    "arg_fn_ord int, params array<string>, exported boolean, decorators array<string>, fn string, fn_prop string, "
    "var string, idents array<string>, parent_kind string, leading string"
)

_TOKEN = re.compile(
    r"""(?P<ws>\s+)|(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<str>'(?:\\.|[^'\\\n])*'?|"(?:\\.|[^"\\\n])*"?)"""
    r"""|(?P<num>\d[\w.]*)|(?P<id>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*|\#[A-Za-z_$][\w$]*)"""
    r"""|(?P<op>=>|\?\.(?!\d)|\.\.\.|===|!==|\*\*=?|&&=?|\|\|=?|\?\?=?|==|!=|<=|>=|\+\+|--|[-+*/%&|^]=|<<=?|[\s\S])"""
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, set(")]}")
_NOT_CALLED = frozenset(
    "if for while switch catch return function typeof await yield new delete void in of do else case throw with instanceof".split()
)
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do await yield".split())
_MODIFIERS = frozenset("public private protected static async readonly abstract override get set declare accessor".split())
_STATEMENTS = frozenset("if for while do switch try return throw break continue import export const let var class function".split())
#: Names that are no tainted inputs (fixed values).
STOP_NAMES = frozenset(
    "console JSON Object Array Math Date String Number Boolean Error Promise undefined null true false".split()
)


class Lexed:
    """Tokens of a text: kind, start, end; and for each bracket the index of its partner."""

    def __init__(self, text: str):
        self.text = text
        self.kinds: list[str] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.values: list[str] = []
        self.comments: list[tuple[int, int]] = []
        self._scan()
        self.partner = self._match()
        self.newlines = [i for i, c in enumerate(text) if c == "\n"]

    def line(self, off: int) -> int:
        return bisect.bisect_left(self.newlines, off) + 1

    def _scan(self) -> None:
        text, at, n = self.text, 0, len(self.text)
        while at < n:
            c = text[at]
            if c == "`":
                end = self._template(at)
                self._put("tpl", at, end)
                at = end
                continue
            if c == "/" and text[at : at + 2] not in ("//", "/*") and self._regex_may_start():
                m = _REGEX.match(text, at)
                if m:
                    self._put("re", at, m.end())
                    at = m.end()
                    continue
            m = _TOKEN.match(text, at)
            kind = m.lastgroup
            if kind == "comment":
                self.comments.append((at, m.end()))
            elif kind != "ws":
                self._put(kind, at, m.end())
            at = m.end()

    def _template(self, at: int) -> int:
        text, n, i = self.text, len(self.text), at + 1
        while i < n:
            if text[i] == "\\":
                i += 2
            elif text[i] == "`":
                return i + 1
            elif text[i] == "$" and text[i + 1 : i + 2] == "{":
                depth, i = 1, i + 2
                while i < n and depth:
                    if text[i] == "`":
                        i = self._template(i)
                        continue
                    depth += {"{": 1, "}": -1}.get(text[i], 0)
                    i += 1
            else:
                i += 1
        return n

    def _regex_may_start(self) -> bool:
        if not self.kinds:
            return True
        kind, value = self.kinds[-1], self.values[-1]
        if kind == "id":
            return value in _BEFORE_REGEX
        return kind == "op" and value not in (")", "]", "}")

    def _put(self, kind: str, a: int, b: int) -> None:
        self.kinds.append(kind)
        self.starts.append(a)
        self.ends.append(b)
        self.values.append(self.text[a:b])

    def _match(self) -> dict[int, int]:
        stack, partner = [], {}
        for i, (k, v) in enumerate(zip(self.kinds, self.values, strict=True)):
            if k != "op":
                continue
            if v in _OPEN:
                stack.append(i)
            elif v in _CLOSE:
                while stack and _OPEN[self.values[stack[-1]]] != v:
                    stack.pop()
                if stack:
                    j = stack.pop()
                    partner[i], partner[j] = j, i
        return partner


class Parser:
    """Recognises nodes around brackets and keywords."""

    def __init__(self, text: str):
        self.x = Lexed(text)
        self.nodes: list[dict] = []
        self.v, self.k, self.p = self.x.values, self.x.kinds, self.x.partner
        self.n = len(self.v)
        #: What an opening brace is: block, object, class or other.
        self.brace: dict[int, str] = {}

    def val(self, i: int) -> str:
        return self.v[i] if 0 <= i < self.n else ""

    def kind(self, i: int) -> str:
        return self.k[i] if 0 <= i < self.n else ""

    def add(self, kind: str, a: int, b: int, name: str | None = None, **more) -> dict:
        """A node over tokens a..b inclusive."""
        b = min(max(b, a), self.n - 1)
        node = {"kind": kind, "name": name, "start": self.x.starts[a], "end": self.x.ends[b], "a": a, "b": b, **more}
        self.nodes.append(node)
        return node

    def parse(self) -> list[dict]:
        self.classify_braces()
        self.declarations()
        self.functions()
        self.calls()
        self.accesses()
        self.statements()
        return self.finish()

    # -- braces --------------------------------------------------------------------------

    def classify_braces(self) -> None:
        for i in range(self.n):
            if self.k[i] == "op" and self.v[i] == "{":
                self.brace[i] = self._brace(i)

    def _brace(self, i: int) -> str:
        before, kind = self.val(i - 1), self.kind(i - 1)
        if before == "=>" or before in (")", ";", "{", "}", "else", "try", "finally", "do") or i == 0:
            return "block" if before != "{" or self.brace.get(i - 1) != "object" else "object"
        j = i - 1
        while j >= 0 and (self.k[j] == "id" or self.v[j] in (".", ",", "<", ">")):
            if self.v[j] == "class":
                return "class"
            if self.v[j] in ("interface", "enum", "namespace", "module", "type"):
                return "other"
            if self.v[j] in ("import", "export", "const", "let", "var"):
                break
            j -= 1
        if before in ("(", ",", "=", "[", "?", "return", "&&", "||", "??", "!", "...", "default", "+", "in", "of") or (before == ":" and not self._case_label(i - 1)):
            return "object"
        if before in ("import", "export", "const", "let", "var", "type"):
            return "other"
        # After a return type: ``): Promise<T> {``.
        return "block" if kind in ("id", "op") else "object"

    def _case_label(self, colon: int) -> bool:
        j = colon - 1
        while j >= 0 and self.v[j] not in (";", "{", "}", ","):
            if self.v[j] in ("case", "default"):
                return True
            if self.v[j] in ("?", ":"):
                return False
            j -= 1
        return False

    def container(self, i: int) -> int:
        """Index of the innermost bracket open before token i, or -1."""
        depth = 0
        for j in range(i - 1, -1, -1):
            if self.k[j] == "op":
                if self.v[j] in _CLOSE and j in self.p:
                    depth += 1
                elif self.v[j] in _OPEN and j in self.p:
                    if depth == 0:
                        return j
                    depth -= 1
        return -1

    def containers(self) -> list[int]:
        """For every token the innermost open bracket around it, or -1."""
        out, stack = [], [-1]
        for i in range(self.n):
            if self.k[i] == "op" and self.v[i] in _CLOSE and i in self.p and len(stack) > 1:
                stack.pop()
            out.append(stack[-1])
            if self.k[i] == "op" and self.v[i] in _OPEN and i in self.p:
                stack.append(i)
        return out

    def expression_end(self, i: int) -> int:
        """Last token of an expression that begins at token i."""
        last = i
        while i < self.n:
            v, k = self.v[i], self.k[i]
            if k == "op":
                if v in _CLOSE or v in (",", ";"):
                    return max(last, i - 1)
                if v in _OPEN and i in self.p:
                    i = self.p[i]
            nxt = i + 1
            if nxt < self.n and self.x.line(self.x.starts[nxt]) > self.x.line(self.x.ends[i] - 1):
                joins = self.v[i] in ("=", "=>", "(", ",", "&&", "||", "??", "+", "?", ":", ".", "?.", "return", "await", "==", "===") or self.v[nxt] in (
                    ".", "?.", "=>", "&&", "||", "??", "+", "?", ":", "==", "===", "=", "as"
                )
                if not joins and self.k[nxt] != "op":
                    return i
                if not joins and self.v[nxt] in ("@", "{", "}", "!", "*", "[") and self.v[i] not in ("=>",):
                    return i
            last = i
            i += 1
        return last

    # -- declarations --------------------------------------------------------------------

    def exported(self, i: int) -> bool:
        j = i - 1
        while j >= 0 and self.v[j] in ("default", "async", "declare", "abstract"):
            j -= 1
        return self.val(j) == "export"

    def declarations(self) -> None:
        where = self.containers()
        for i in range(self.n):
            v = self.v[i]
            if self.k[i] == "id" and v in ("const", "let", "var") and self.val(i - 1) not in (".", "?.") and self.val(i + 1) not in (":", ",", ")"):
                self._variables(i)
            elif self.k[i] == "id" and v == "class" and self.val(i - 1) not in (".", "?."):
                self._class(i)
            elif self.k[i] == "id" and v == "import" and where[i] == -1 and self.val(i + 1) != "(":
                end = next((j for j in range(i + 1, self.n) if self.k[j] == "str" or self.v[j] == ";"), i)
                self.add("ImportDeclaration", i, end, self.v[end].strip("'\"") if self.k[end] == "str" else None)
            elif self.k[i] == "id" and v == "export" and where[i] == -1 and self.val(i + 1) in ("default", "{", "*"):
                self._export(i)
            elif self.k[i] == "id" and v == "try" and self.val(i + 1) == "{":
                self._try(i)
            elif v == ":" and self.k[i] == "op" and where[i] >= 0 and self.brace.get(where[i]) == "object":
                key = i - 1
                if self.val(key) == "]" and key in self.p:
                    key = self.p[key]
                if key >= 1 and (self.v[key - 1] in (",", "{")) and i + 1 < self.n:
                    self.add("PropertyAssignment", key, self.expression_end(i + 1), self.v[i - 1].strip("'\"`"), value=i + 1)

    def _export(self, i: int) -> None:
        """``export default``, ``export { .. }`` and ``export *``, the latter two with their module as name if they have one."""
        if self.val(i + 1) == "default":
            self.add("ExportDeclaration", i, i + 1, "default")
            return
        end = self.p.get(i + 1, i + 1)
        if self.val(end + 1) == "as":
            end += 2
        module = self.val(end + 1) == "from" and self.kind(end + 2) == "str"
        end += 2 if module else 0
        self.add("ExportDeclaration", i, end, self.v[end].strip("'\"`") if module else None)

    def _variables(self, i: int) -> None:
        exported, at = self.exported(i), i + 1
        while at < self.n:
            start = at
            names: list[str] = []
            if self.val(at) in ("{", "[") and at in self.p:
                close = self.p[at]
                names = self._binding_names(at, close)
                name, at = ",".join(names), close + 1
            elif self.kind(at) == "id":
                name = self.v[at]
                at += 1
            else:
                return
            if self.val(at) == ":":  # a type
                at += 1
                while at < self.n and self.v[at] not in ("=", ";", ","):
                    if self.v[at] in ("of", "in", ")"):
                        break
                    at = self.p[at] + 1 if self.v[at] in _OPEN and at in self.p else at + 1
            value = None
            end = at - 1
            if self.val(at) == "=":
                value, end = at + 1, self.expression_end(at + 1)
            elif self.val(at) in ("of", "in"):
                end = at - 1
            self.add("VariableDeclaration", start, end, name, value=value, exported=exported, binding=bool(names))
            if self.val(end + 1) != ",":
                self.add("VariableStatement", i - 1 if exported else i, end + (self.val(end + 1) == ";"), exported=exported)
                return
            at = end + 2

    def _binding_names(self, a: int, b: int) -> list[str]:
        out, j = [], a + 1
        while j < b:
            if self.k[j] == "id" and self.val(j + 1) != ":" and self.val(j - 1) != "=":
                out.append(self.v[j])
            if self.val(j) == "=":
                j = self.expression_end(j + 1)
            elif self.val(j) == ":" and self.kind(j + 1) == "id":
                out.append(self.v[j + 1])
                j += 1
            j += 1
        return out

    def decorators_before(self, i: int) -> tuple[list[str], int]:
        """Decorator texts that stand right before token i, and where they begin."""
        out: list[str] = []
        j = i - 1
        while True:
            while j >= 0 and self.v[j] in _MODIFIERS | {"export", "default"}:
                j -= 1
            e = j
            if self.val(j) == ")" and j in self.p:
                j = self.p[j] - 1
            while j >= 1 and self.k[j] == "id" and self.v[j - 1] == ".":
                j -= 2
            if j >= 1 and self.k[j] == "id" and self.v[j - 1] == "@":
                out.insert(0, self.x.text[self.x.starts[j - 1] : self.x.ends[e]])
                i, j = j - 1, j - 2
            else:
                return out, i

    def _class(self, i: int) -> None:
        name = self.v[i + 1] if self.kind(i + 1) == "id" and self.val(i + 1) not in ("extends", "implements") else None
        j = i + 1
        while j < self.n and self.v[j] != "{":
            j = self.p[j] + 1 if self.v[j] in ("(", "[") and j in self.p else j + 1
        if j not in self.p:
            return
        self.brace[j] = "class"
        decorators, start = self.decorators_before(i)
        self.add("ClassDeclaration", start, self.p[j], name, exported=self.exported(i), decorators=decorators)

    def _try(self, i: int) -> None:
        end = self.p.get(i + 1, i + 1)
        catch = None
        if self.val(end + 1) == "catch":
            j = end + 2
            if self.val(j) == "(" and j in self.p:
                j = self.p[j] + 1
            if self.val(j) == "{" and j in self.p:
                catch, end = self.x.text[self.x.starts[j] : self.x.ends[self.p[j]]], self.p[j]
        if self.val(end + 1) == "finally" and end + 2 in self.p:
            end = self.p[end + 2]
        self.add("TryStatement", i, end, args=[catch] if catch is not None else [])

    # -- functions -----------------------------------------------------------------------

    def parameters(self, a: int, b: int) -> list[str]:
        out = []
        for text, s in self.split(a, b):
            j = s
            while self.val(j) in _MODIFIERS | {"..."} or (self.val(j) == "@"):
                j += 1
            out.append(self.v[j] if self.kind(j) == "id" else text)
        return out

    def split(self, a: int, b: int) -> list[tuple[str, int]]:
        """Comma-separated parts between brackets a and b: (text, first token)."""
        out, start, j = [], a + 1, a + 1
        while j <= b:
            if j == b or (self.v[j] == "," and self.k[j] == "op"):
                if j > start:
                    out.append((self.x.text[self.x.starts[start] : self.x.ends[j - 1]], start))
                start = j + 1
            elif self.v[j] in _OPEN and j in self.p and self.k[j] == "op":
                j = self.p[j]
            j += 1
        return out

    def functions(self) -> None:
        self.method_names: set[int] = set()
        where = self.containers()
        for i in range(self.n):
            v = self.v[i]
            if v == "function" and self.k[i] == "id" and self.val(i - 1) not in (".", "?."):
                self._function(i)
            elif v == "=>" and self.k[i] == "op":
                self._arrow(i)
            elif v == "(" and self.k[i] == "op" and i in self.p and where[i] >= 0 and self.brace.get(where[i]) in ("class", "object"):
                self._method(i, where[i])

    def _body(self, after: int) -> int | None:
        """The opening brace of a body that follows a parameter list, past a return type."""
        j = after
        if self.val(j) == ":":
            j += 1
            while j < self.n and self.v[j] not in ("{", ";", "=>", "}", ")"):
                j = self.p[j] + 1 if self.v[j] in ("(", "[") and j in self.p else j + 1
            if self.val(j) == "{" and j in self.p and self.val(self.p[j] + 1) == "{":  # an object type
                j = self.p[j] + 1
        return j if self.val(j) == "{" and j in self.p else None

    def _function(self, i: int) -> None:
        j = i + 1 + (self.val(i + 1) == "*")
        name = self.v[j] if self.kind(j) == "id" else None
        while j < self.n and self.v[j] != "(":
            j += 1
        if j not in self.p:
            return
        body = self._body(self.p[j] + 1)
        if body is None:
            return
        self.brace[body] = "block"
        start = i - (self.val(i - 1) == "async")
        before = self.val(start - 1)
        declared = before in ("", ";", "{", "}", "export", "default", ")", "]") or (
            start > 0 and before not in ("=", "(", ",", ":", "=>", "return", "?", "&&", "||", "??", "!", "[", "await", "new", "+") and self.k[start - 1] != "op"
        )
        if before == "{" and self.brace.get(start - 1) == "object":
            declared = False
        exported = self.exported(i)
        if declared and name:
            self.add("FunctionDeclaration", start - (self.val(start - 1) == "default") - exported if exported else start, self.p[body], name, params=self.parameters(j, self.p[j]), exported=exported)
        else:
            self.add("FunctionExpression", start, self.p[body], name, params=self.parameters(j, self.p[j]))

    def _arrow(self, i: int) -> None:
        j, params = i - 1, []
        if self.val(j) != ")" and self.kind(j) in ("id", "op"):  # maybe a return type
            q = j
            while q >= 0 and q > i - 40 and self.v[q] not in (";", "=", "{"):
                if self.v[q] == ":" and self.val(q - 1) == ")" and q - 1 in self.p:
                    j = q - 1
                    break
                q = self.p[q] - 1 if self.v[q] in _CLOSE and q in self.p and self.v[q] != ")" else q - 1
        if self.val(j) == ")" and j in self.p:
            start = self.p[j]
            params = self.parameters(start, j)
        elif self.kind(j) == "id":
            start, params = j, [self.v[j]]
        else:
            return
        if self.val(start - 1) == "async":
            start -= 1
        if self.val(i + 1) == "{" and i + 1 in self.p:
            self.brace[i + 1] = "block"
            end = self.p[i + 1]
        else:
            end = self.expression_end(i + 1)
        self.add("ArrowFunction", start, end, params=params)

    def _method(self, i: int, container: int) -> None:
        j = i - 1
        if self.val(j) == ">":  # type parameters
            while j >= 0 and self.v[j] != "<":
                j -= 1
            j -= 1
        if self.kind(j) not in ("id", "str") or self.v[j] in _NOT_CALLED:
            return
        s = j
        while self.val(s - 1) in _MODIFIERS | {"*"}:
            s -= 1
        before = self.val(s - 1)
        decorated = before == ")" and self.decorators_before(s)[0]
        if before not in ("{", "}", ";", ",") and not decorated and not (self.brace.get(container) == "class" and self.x.line(self.x.starts[s]) > self.x.line(self.x.ends[max(s - 1, 0)] - 1)):
            return
        body = self._body(self.p[i] + 1)
        if body is None:
            return
        self.brace[body] = "block"
        self.method_names.add(j)
        decorators, start = self.decorators_before(s)
        name = self.v[j].strip("'\"")
        kind = "Constructor" if name == "constructor" and self.brace.get(container) == "class" else "MethodDeclaration"
        self.add(kind, start, self.p[body], name, params=self.parameters(i, self.p[i]), decorators=decorators, in_class=self.brace.get(container) == "class")

    # -- expressions ---------------------------------------------------------------------

    def chain_start(self, j: int) -> int:
        """First token of the postfix chain that ends at token j."""
        while j >= 0:
            if self.k[j] == "op" and self.v[j] in (")", "]") and j in self.p:
                o = self.p[j]
                prev = self.kind(o - 1)
                if prev == "id" and self.val(o - 1) not in _NOT_CALLED or self.val(o - 1) in (")", "]"):
                    j = o - 1
                    continue
                j = o
            elif self.v[j] == "!" and self.k[j] == "op":
                j -= 1
                continue
            if self.val(j - 1) in (".", "?."):
                j -= 2
                continue
            return j
        return 0

    def calls(self) -> None:
        decorator_parens = set()
        for i in range(self.n):
            if self.v[i] == "@" and self.k[i] == "op" and self.kind(i + 1) == "id":
                j = i + 1
                while self.val(j + 1) == "." and self.kind(j + 2) == "id":
                    j += 2
                end = j
                if self.val(j + 1) == "(" and j + 1 in self.p:
                    end = self.p[j + 1]
                    decorator_parens.add(j + 1)
                self.add("Decorator", i, end, self.v[i + 1])
        for i in range(self.n):
            if self.v[i] != "(" or self.k[i] != "op" or i not in self.p or i in decorator_parens:
                continue
            j = i - 1
            if self.val(j) == ">":
                q = j
                while q >= 0 and q > i - 30 and self.v[q] not in ("<", ";", "{", "("):
                    q -= 1
                if self.val(q) == "<" and self.kind(q - 1) == "id" and self.x.ends[q - 1] == self.x.starts[q]:
                    j = q - 1
                else:
                    continue
            if self.val(j) == "?.":
                j -= 1
            k, v = self.kind(j), self.val(j)
            if j in self.method_names or not (k == "id" or v in (")", "]", "!")) or (k == "id" and v in _NOT_CALLED and self.val(j - 1) not in (".", "?.")):
                continue
            if k == "id" and (self.val(j - 1) == "function" or v == "async" and self.val(self.p[i] + 1) in ("=>", ":")):
                continue
            if v in (")", "]") and (j not in self.p or (v == ")" and self.val(self.p[j] - 1) in ("if", "for", "while", "switch", "catch"))):
                continue
            if v == ")" and self.val(i - 1) == ")" and self.x.line(self.x.starts[i]) > self.x.line(self.x.ends[j]):
                continue
            start = self.chain_start(j)
            new = self.val(start - 1) == "new"
            first = i
            if new and any(self.v[t] == "(" and self.p.get(t, -1) < i for t in range(start, i)):
                new = False
                start -= 1
            elif new:
                start -= 1
            callee_from = start + 1 if new else start
            callee = self.x.text[self.x.starts[callee_from] : self.x.ends[j]]
            name = self.v[j] if k == "id" else None
            dotted = self.val(j - 1) in (".", "?.") and k == "id"
            obj = self.x.text[self.x.starts[callee_from] : self.x.ends[j - 2]] if dotted and j - 2 >= callee_from else None
            parts = self.split(first, self.p[first])
            self.add(
                "NewExpression" if new else "CallExpression", start, self.p[first], name, callee=callee, callee_object=obj,
                args=[t for t, _ in parts], arg_tokens=[s for _, s in parts], ident=k == "id" and not dotted,
            )

    def accesses(self) -> None:
        for i in range(1, self.n - 1):
            if self.v[i] in (".", "?.") and self.k[i] == "op" and self.kind(i + 1) == "id":
                start = self.chain_start(i + 1)
                self.add("PropertyAccess", start, i + 1, self.v[i + 1])
            elif self.v[i] in ("=", "+=") and self.k[i] == "op":
                j = i - 1
                if self.kind(j) == "id" and self.val(j - 1) in (".", "?.") or self.val(j) == "]":
                    self.add("BinaryExpression", self.chain_start(j), self.expression_end(i + 1))

    def statements(self) -> None:
        where = self.containers()
        for b, kind in self.brace.items():
            if kind == "block" and b in self.p:
                self.add("Block", b, self.p[b])
        for i in range(self.n):
            w = where[i]
            if not (w == -1 or (self.v[w] == "{" and self.brace.get(w) == "block")):
                continue
            before = self.val(i - 1)
            fresh_line = i == 0 or self.x.line(self.x.starts[i]) > self.x.line(self.x.ends[i - 1] - 1)
            if before == "}" and not fresh_line and self.brace.get(self.p.get(i - 1, -1)) not in ("block", "class"):
                continue
            if not (i == 0 or before in (";", "{", "}") or fresh_line) or self.v[i] in ("}", ")", "]", ".", "?.", ";", "=", ",", "=>", ":", "?"):
                continue
            v = self.v[i]
            if v == "return" or v == "throw":
                self.add("ReturnStatement" if v == "return" else "ThrowStatement", i, self.expression_end(i + 1) if self.val(i + 1) not in (";", "}") else i)
            elif v in ("if", "for", "while", "switch") and self.val(i + 1) == "(" and i + 1 in self.p:
                j = self.p[i + 1] + 1
                end = self.p[j] if self.val(j) == "{" and j in self.p else self.expression_end(j)
                while v == "if" and self.val(end + 1) == "else":
                    j = end + 2
                    if self.val(j) == "if" and j + 1 in self.p:
                        j = self.p[j + 1] + 1
                    end = self.p[j] if self.val(j) == "{" and j in self.p else self.expression_end(j)
                self.add(v.capitalize() + "Statement", i, end)
            elif v not in _STATEMENTS and self.k[i] in ("id", "op", "str") and v not in ("{", "@", "async", "else", "catch", "finally", "case", "default"):
                end = self.expression_end(i)
                self.add("ExpressionStatement", i, end + (self.val(end + 1) == ";"))

    # -- assembly ------------------------------------------------------------------------

    def finish(self) -> list[dict]:
        rank = {"VariableStatement": 0, "ExpressionStatement": 0, "ReturnStatement": 0, "ClassDeclaration": 1, "FunctionDeclaration": 1, "VariableDeclaration": 2, "PropertyAssignment": 2, "MethodDeclaration": 1}
        seen, nodes = set(), []
        for n in sorted(self.nodes, key=lambda n: (n["start"], -n["end"], rank.get(n["kind"], 3))):
            key = (n["start"], n["end"], n["kind"])
            if key not in seen:
                seen.add(key)
                nodes.append(n)
        stack: list[int] = []
        for o, n in enumerate(nodes):
            while stack and nodes[stack[-1]]["end"] < n["end"] or stack and nodes[stack[-1]]["end"] <= n["start"]:
                stack.pop()
            n["ord"], n["parent"] = o, stack[-1] if stack else None
            stack.append(o)
        for n in nodes:
            n["fn"] = self._enclosing(nodes, n, False)
            n["fn_prop"] = self._enclosing(nodes, n, True)
        return nodes

    @staticmethod
    def _named(nodes: list[dict], c: dict, prop: bool) -> tuple[bool, str | None]:
        if c["kind"] in ("FunctionDeclaration", "MethodDeclaration"):
            return True, c["name"]
        if c["kind"] in ("ArrowFunction", "FunctionExpression") and c["parent"] is not None:
            up = nodes[c["parent"]]
            if up.get("value") == c["a"] and (up["kind"] == "VariableDeclaration" or prop and up["kind"] == "PropertyAssignment"):
                return True, up["name"]
        return False, None

    def _enclosing(self, nodes: list[dict], n: dict, prop: bool) -> str | None:
        at = n["parent"]
        while at is not None:
            found, name = self._named(nodes, nodes[at], prop)
            if found:
                return name
            at = nodes[at]["parent"]
        return None

    def assigned(self, nodes: list[dict], n: dict) -> str | None:
        """The variable or property that takes the value a node is part of."""
        at = n["parent"]
        while at is not None:
            c = nodes[at]
            if c["kind"] == "VariableDeclaration" or c["kind"] == "PropertyAssignment":
                return c["name"]
            if c["kind"] in ("FunctionDeclaration", "ArrowFunction", "FunctionExpression", "MethodDeclaration"):
                return None
            at = c["parent"]
        return None

    def identifiers(self, a: int, b: int) -> list[str]:
        out = dict.fromkeys(self.v[i] for i in range(a, b + 1) if self.k[i] == "id" and self.v[i] not in STOP_NAMES and self.v[i] not in _NOT_CALLED and self.v[i] not in ("const", "let", "var", "async", "this"))
        return list(out)

    def leading_comments(self, n: dict) -> str | None:
        """The comment before a node with nothing but blanks in between."""
        i = bisect.bisect_right(self.comment_ends, n["start"]) - 1
        if i < 0 or self.x.text[self.comment_ends[i] : n["start"]].strip():
            return None
        a, b = self.x.comments[i]
        return self.x.text[a:b] or None


#: Kind of the one row of a file that can't be read; its name tells the error.
UNREADABLE = "Unreadable"
#: Rows of nodes that are put out at once.
PIECE = 20_000


def nodes_of(file: str, text: str | None) -> list[dict]:
    """Rows of the relation ``nodes`` for one file; one of kind UNREADABLE if the text can't be read."""
    if not text:
        return []
    try:
        parser = Parser(text)
        nodes = parser.parse()
    except (IndexError, KeyError, RecursionError, ValueError) as error:
        return [dict.fromkeys(COLUMNS) | {"file": file, "ord": 0, "kind": UNREADABLE, "name": type(error).__name__, "start_line": 1, "end_line": 1, "start_off": 0, "end_off": 0, "exported": False}]
    rows = []
    parser.comment_ends = [b for _, b in parser.x.comments]
    functions: dict[int, list[dict]] = {}
    for m in nodes:
        if m["kind"] in ("ArrowFunction", "FunctionExpression"):
            functions.setdefault(m["a"], []).append(m)
    for n in nodes:
        up = nodes[n["parent"]] if n["parent"] is not None else None
        call = n["kind"] in ("CallExpression", "NewExpression")
        arg_fn = next(
            (m["ord"] for s in n.get("arg_tokens", []) for m in functions.get(s, ()) if m["b"] <= n["b"]), None
        ) if call else None
        sink = call or n["kind"] in ("BinaryExpression", "PropertyAccess")
        rows.append({
            "file": file, "ord": n["ord"], "parent_ord": n["parent"], "kind": n["kind"], "name": n["name"],
            "start_line": parser.x.line(n["start"]), "end_line": parser.x.line(max(n["end"] - 1, n["start"])),
            "start_off": n["start"], "end_off": n["end"], "text": text[n["start"] : n["end"]],
            "callee": n.get("callee"), "callee_object": n.get("callee_object"), "args": n.get("args"), "arg_fn_ord": arg_fn,
            "params": n.get("params"), "exported": bool(n.get("exported")), "decorators": n.get("decorators"),
            "fn": n["fn"], "fn_prop": n["fn_prop"], "var": parser.assigned(nodes, n), "idents": parser.identifiers(n["a"], n["b"]) if sink else None,
            "parent_kind": up["kind"] if up else None, "leading": parser.leading_comments(n) if call else None,
        })
    return rows


COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def lex(files: DataFrame) -> DataFrame:
    """files (file, text) -> nodes. Files are independent: there is no shuffle."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows: list[dict] = []
            for f, t in zip(pdf["file"], pdf["text"], strict=True):
                rows += nodes_of(f, t)
                if len(rows) >= PIECE:
                    yield table(rows)
                    rows = []
            yield table(rows)

    def table(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=COLUMNS)
        for c in ("parent_ord", "arg_fn_ord"):
            out[c] = out[c].astype("Int32")
        return out

    ship(files.sparkSession)
    return files.select("file", "text").mapInPandas(run, SCHEMA)


def unreadable(nodes: DataFrame) -> DataFrame:
    """file, error of the files that could not be read: none of their facts are known."""
    return nodes.filter(F.col("kind") == UNREADABLE).select("file", F.col("name").alias("error"))
