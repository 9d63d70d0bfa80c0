"""Frontends: source text to definitions, references, call sites and function metrics.

Python is read with the standard library's parser. The languages with braces are read by a scanner of tokens and
brackets: what a definition is follows from keywords, brackets and the words before them. A file with a syntax error
(Python) or with unbalanced brackets gives no rows but one parse failure. Offsets are code points; lines and columns
count from 1.
"""

from __future__ import annotations

import ast
import bisect
import io
import keyword
import re
import tokenize
from dataclasses import dataclass, field

from tessera.functions.snippets import context_snippet, snippet
from tessera.sources.languages import register

#: Kinds of nodes whose rows feed the metrics of a function.
BRANCH_WORDS = frozenset("if else while for switch case catch try finally break continue return throw yield match".split())
STATEMENT_WORDS = frozenset("return break continue throw if while for switch try let const var".split())
BINARY = frozenset("+ - * / % && || ?? == != === !== < > <= >= & | ^ << >> >>> instanceof in".split())


@dataclass
class Parsed:
    definitions: list[dict] = field(default_factory=list)
    references: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    nodes: list[dict] = field(default_factory=list)
    failure: str | None = None
    at: int | None = None  # where the first error is, if that is known
    line: int | None = None
    column: int | None = None


def failed(text: str, message: str, at: int) -> Parsed:
    return Parsed(failure=message, at=at, **dict(zip(("line", "column"), Places(text)(at), strict=True)))


@dataclass
class Scope:
    """A named or anonymous stretch of the text: kind as a definition and as a context, and where it stands."""

    kind: str
    context: str | None
    name: str | None
    start: int
    stop: int
    at: int
    params: str | None = None
    returns: str | None = None
    base: str | None = None
    implements: str | None = None
    callable: bool = False
    declares: bool = True


class Places:
    """Line and column of an offset."""

    def __init__(self, text: str):
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def __call__(self, at: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.starts, at)
        return line, at - self.starts[line - 1] + 1


class Open:
    """Of spans sorted by start, those that hold a place, for places asked for in ascending order."""

    def __init__(self, spans: list, bounds):
        self.spans, self.bounds, self.next, self.held = spans, bounds, 0, []

    def at(self, start: int, stop: int) -> list:
        """Spans that begin at start or before and end at stop or behind, in order."""
        while self.next < len(self.spans) and self.bounds(self.spans[self.next])[0] <= start:
            self.held.append(self.spans[self.next])
            self.next += 1
        self.held = [x for x in self.held if self.bounds(x)[1] > start]
        return [x for x in self.held if stop <= self.bounds(x)[1]]


def scope_bounds(s: Scope) -> tuple[int, int]:
    return s.start, s.stop


def shape(text: str, scopes: list[Scope], names: list[tuple[str, int]], calls: list[tuple[int, int, int, int]], marks: list[tuple[int, bool, bool, int]]) -> Parsed:
    """Rows from scopes, identifiers (name, offset), calls (callee start, callee end, end, start) and nodes (offset, branch,
    statement, end). One sweep over the text for each, so a long file takes time in proportion to its length and depth."""
    place, out = Places(text), Parsed()
    scopes = sorted(scopes, key=lambda s: (s.start, -s.stop))
    own = {s.at for s in scopes if s.name and s.declares}

    around = Open(scopes, scope_bounds)
    for s in scopes:
        outer = [o for o in around.at(s.start, s.stop) if (o.start, o.stop) != (s.start, s.stop)]
        if not s.name or not s.kind:
            continue
        held = [o for o in outer if o.kind in ("class", "interface") and o.name]
        line, column = place(s.start)
        out.definitions.append(
            {"kind": s.kind, "name": s.name, "container": held[-1].name if held else None, "start": s.start, "stop": s.stop, "sel_start": s.at, "sel_stop": s.at + len(s.name), "line": line, "column": column,
             "params": s.params, "returns": s.returns, "base": s.base, "implements": s.implements, "snippet": snippet(text[s.start : s.stop])}
        )
    spans = sorted(calls)
    around, calling = Open(scopes, scope_bounds), Open(spans, lambda c: (c[0], c[1]))
    for name, at in sorted(names, key=lambda x: x[1]):
        stop = at + len(name)
        scopes_here, calls_here = around.at(at, stop), calling.at(at, stop)
        if at in own:
            continue
        # The innermost call whose callee holds the name.
        call = min(calls_here, key=lambda c: (c[2] - c[3], -c[3]), default=None)
        inside = [s for s in scopes_here if s.context]
        held = [s for s in inside if s.kind in ("class", "interface", "function", "method") and s.name]
        near = inside[-1] if inside else None
        line, column = place(at)
        out.references.append(
            {"ref_kind": "call" if call else "reference", "name": name, "start": call[3] if call else at, "stop": call[2] if call else stop, "sel_start": at, "sel_stop": stop, "line": line, "column": column,
             "container": held[-1].name if held else None, "encl_name": near.name if near else None, "encl_kind": near.context if near else None, "context": context_snippet(text, at, stop)}
        )
    around = Open(scopes, scope_bounds)
    for a, b, e, first in spans:
        callable_ = [s for s in around.at(a, e) if s.callable]
        line, column = place(first)
        named = [s.name for s in callable_ if s.name]
        out.calls.append({"callee": text[a:b], "start": first, "stop": e, "line": line, "column": column, "chain": [s.name or "(anonymous)" for s in callable_], "function_name": named[-1] if named else None, "snippet": snippet(text[first:e], 120)})
    marks = sorted(marks, key=lambda m: (m[0], -m[3]))
    starts = [m[0] for m in marks]
    for s in scopes:
        if not s.callable:
            continue
        inside = [m for m in marks[bisect.bisect_left(starts, s.start) : bisect.bisect_right(starts, s.stop)] if m[3] <= s.stop and (m[0], m[3]) != (s.start, s.stop)]
        branches = Open([m for m in inside if m[1]], lambda m: (m[0], m[3]))
        key = {"name": s.name or "(anonymous)", "start": s.start, "stop": s.stop}
        # The function's own first and last line, then its branches and statements with the branches that they stand in.
        out.nodes += [key | {"is_branch": False, "is_statement": False, "depth": 0, "line": place(at)[0]} for at in (s.start, max(s.start, s.stop - 1))]
        out.nodes += [key | {"is_branch": m[1], "is_statement": m[2], "depth": sum((x[0], x[3]) != (m[0], m[3]) for x in branches.at(m[0], m[3])), "line": place(m[0])[0]} for m in inside]
    return out


def python(text: str) -> Parsed:
    try:
        tree = ast.parse(text)
        tokens = list(tokenize.generate_tokens(io.StringIO(text).readline))
    except (SyntaxError, ValueError, RecursionError, tokenize.TokenError) as e:
        message = f"{type(e).__name__}: {getattr(e, 'msg', e)}"
        place = (e.lineno, e.offset) if isinstance(e, SyntaxError) else e.args[1] if isinstance(e, tokenize.TokenError) and len(e.args) > 1 else None
        if not place or not place[0]:
            return Parsed(failure=message)
        begin = [0, *(m.end() for m in re.finditer("\n", text))]
        return failed(text, message, min(len(text), begin[min(place[0], len(begin)) - 1] + max(0, (place[1] or 1) - 1)))
    starts = [0]
    for line in re.split("(?<=\n)", text):
        starts.append(starts[-1] + len(line))
    encoded = [line.encode() for line in re.split("(?<=\n)", text)]

    def at(line: int, column: int) -> int:
        return starts[line - 1] + len(encoded[line - 1][:column].decode(errors="ignore"))

    def span(node: ast.AST) -> tuple[int, int]:
        return at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset)

    scopes, calls, marks = [], [], []
    branches = {ast.If: (1, 1), ast.For: (1, 1), ast.AsyncFor: (1, 1), ast.While: (1, 1), ast.Try: (1, 1), ast.ExceptHandler: (1, 0), ast.IfExp: (1, 0), ast.Return: (1, 1), ast.Break: (1, 1), ast.Continue: (1, 1), ast.Expr: (0, 1), ast.Assign: (0, 1), ast.AugAssign: (0, 1), ast.AnnAssign: (0, 1)}

    def walk(node: ast.AST, in_class: bool) -> None:
        inner = in_class
        if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            start, stop = span(node)
            name_at = start + re.compile(r"(?:async\s+)?(?:class|def)\s+").match(text, start).end() - start
            if isinstance(node, ast.ClassDef):
                scopes.append(Scope("class", "class", node.name, start, stop, name_at, base=", ".join(map(ast.unparse, node.bases)) or None))
                inner = True
            else:
                scopes.append(Scope("method" if in_class else "function", "function", node.name, start, stop, name_at, params=ast.unparse(node.args), returns=ast.unparse(node.returns) if node.returns else None, callable=True))
        elif isinstance(node, ast.Call):
            a, b = span(node.func)
            calls.append((a, b, span(node)[1], a))
        if type(node) in branches:
            b, s = branches[type(node)]
            start, stop = span(node)
            marks.append((start, bool(b), bool(s), stop))
            if isinstance(node, ast.If | ast.For | ast.While | ast.Try) and node.orelse and not (isinstance(node, ast.If) and isinstance(node.orelse[0], ast.If) and text[span(node.orelse[0])[0] :].startswith("elif")):
                marks.append((span(node.orelse[0])[0], True, False, stop))
            if isinstance(node, ast.Try) and node.finalbody:
                marks.append((span(node.finalbody[0])[0], True, False, stop))
        for child in ast.iter_child_nodes(node):
            walk(child, inner)

    walk(tree, False)
    names = [(t.string, starts[t.start[0] - 1] + t.start[1]) for t in tokens if t.type == tokenize.NAME and not keyword.iskeyword(t.string)]
    return shape(text, scopes, names, calls, marks)


@dataclass(frozen=True)
class Braces:
    """What sets a language with braces apart."""

    classes: frozenset[str]
    interfaces: frozenset[str] = frozenset()
    variables: frozenset[str] = frozenset()
    function: str | None = None
    typed: bool = False  # functions are a name and brackets before a block
    receivers: bool = False  # func (r T) name
    impl: bool = False
    call_index: bool = True  # calls count as calls in the index
    created: bool = False  # new is part of the call
    abstract: bool = False  # methods without a body are definitions
    declarations: bool = False  # functions that are declared only are definitions
    constants: bool = False  # the constants of an enum are definitions
    arrows: bool = False
    keywords: frozenset[str] = frozenset()


def w(text: str) -> frozenset[str]:
    return frozenset(text.split())


COMMON = w("if else for while do switch case default break continue return try catch finally throw new this super null true false void const static public private protected import package class interface enum struct in is as typeof instanceof delete async await yield let var function extends implements export from of type namespace using fn pub mut impl mod use trait match where self func go defer range map chan select fallthrough goto union typedef extern inline virtual override template typename operator sizeof unsafe ref out params readonly abstract sealed partial record final throws synchronized volatile transient native strictfp assert int char float double bool boolean byte short long string unsigned signed auto register")
TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)"
    r"|(?P<mark>=>|->|::|\?\.|\?\?|===|!==|==|!=|<=|>=|&&|\|\||<<|>>|\+\+|--|[-+*/%&|^]=|.)",
    re.S,
)
CLOSE = {")": "(", "]": "[", "}": "{"}
#: Tokens that may stand between the brackets of a function and its block: what it throws, its constraints and initialisers.
HEAD = 120
LINKS = {".", "->", "::", "?."}
#: What may stand between the names of a declaration's parameters; a call would hold values.
DECLARES = {"*", "&", "&&", ",", "::", "<", ">", "[", "]", "..."}


def braces(text: str, grammar: Braces) -> Parsed:
    tokens = [(m.lastgroup, m[0], m.start(), m.end()) for m in TOKEN.finditer(text) if m.lastgroup not in ("space", "comment")]
    pair: dict[int, int] = {}
    stack: list[int] = []
    outer: list[int] = []  # the bracket that each token stands in, -1 for none
    for i, (kind, s, at, _) in enumerate(tokens):
        outer.append(stack[-1] if stack else -1)
        if kind != "mark":
            continue
        if s in "([{":
            stack.append(i)
        elif s in CLOSE:
            if not stack or tokens[stack[-1]][1] != CLOSE[s]:
                return failed(text, f"unexpected {s}", at)
            pair[stack[-1]] = i
            pair[i] = stack.pop()
    if stack:
        return failed(text, f"{tokens[stack[-1]][1]} is not closed", tokens[stack[-1]][2])
    n = len(tokens)
    word = lambda i: tokens[i][1] if 0 <= i < n else ""
    is_name = lambda i: 0 <= i < n and tokens[i][0] == "name" and tokens[i][1] not in grammar.keywords
    scopes: list[Scope] = []
    calls: list[tuple[int, int, int, int]] = []
    marks: list[tuple[int, bool, bool, int]] = []
    defined: set[int] = set()

    def end_of(i: int) -> int:
        """The end of the statement that goes on from token i: past its block, or its semicolon, or its line."""
        while i < n:
            s = word(i)
            if s == "{":
                return pair[i]
            if s in ("(", "["):
                i = pair[i] + 1
                continue
            if s == ";" or s in CLOSE:
                return i if s == ";" else i - 1
            if i + 1 < n and grammar.arrows and "\n" in text[tokens[i][3] : tokens[i + 1][2]] and tokens[i][0] != "mark" and tokens[i + 1][0] != "mark":
                return i
            i += 1
        return n - 1

    def add(kind: str, context: str | None, i: int, first: int, last: int, declares: bool = True, **more) -> None:
        scopes.append(Scope(kind, context, word(i), tokens[first][2], tokens[min(last, n - 1)][3], tokens[i][2], declares=declares, **more))
        defined.add(i)

    class_ranges: list[tuple[int, int]] = []
    bodies: set[int] = set()  # brackets that open the body of a class or interface
    for i in range(n):
        s = word(i)
        if tokens[i][0] != "name":
            continue
        if s == "typedef" and s in grammar.variables:
            end = i + 1
            while end < n and word(end) != ";":
                end = pair[end] + 1 if word(end) in ("(", "[", "{") else end + 1
            j = end - 1
            while word(j) == "]":
                j = pair[j] - 1
            if is_name(j) and j > i:
                add("variable", None, j, i, end, declares=False)
        elif s == "delegate" and s in grammar.variables:
            j = next((k for k in range(i + 1, min(n, i + 64)) if word(k) in ("(", ";", "{")), n)
            if word(j) == "(" and is_name(j - 1):
                add("variable", None, j - 1, i, end_of(j), declares=False)
        elif s in grammar.classes | grammar.interfaces | grammar.variables and is_name(i + 1) and word(i - 1) not in LINKS and word(i + 2) not in (">", ",", ")"):  # not a parameter
            j = i + 1
            if grammar.impl and s == "impl":
                j = next((k + 1 for k in range(i, min(n, i + 12)) if word(k) == "for"), j)
            last = end_of(j)
            kind = "class" if s in grammar.classes else "interface" if s in grammar.interfaces else "variable"
            opening = next((k for k in range(j, last + 1) if word(k) == "{"), last)
            base = next((word(k + 1) for k in range(j, opening) if word(k) in ("extends", ":")), None)
            at = next((k for k in range(j, opening) if word(k) == "implements"), opening)
            given = text[tokens[at][3] : tokens[opening][2]].strip() if at < opening else ""
            add(kind, {"class": "class", "interface": "interface"}.get(kind), j, i, last, declares=kind != "variable" and not grammar.impl, base=base, implements=re.sub(r"\s+", " ", given) or None)
            if kind == "class" or s == "impl":
                class_ranges.append((i, last))
            if kind != "variable" and word(opening) == "{":
                bodies.add(opening)
                k = opening + 1
                while grammar.constants and s == "enum" and k < last:
                    while word(k) == "@" and k < last:  # annotations
                        k = pair[k + 2] + 1 if word(k + 2) == "(" else k + 2
                    if not is_name(k):
                        break
                    z = pair[k + 1] if word(k + 1) == "(" else k
                    z = pair[z + 1] if word(z + 1) == "{" else z
                    add("variable", None, k, k, z, declares=False)
                    if word(z + 1) != ",":
                        break
                    k = z + 2

    def in_class(i: int) -> bool:
        return any(a < i <= b for a, b in class_ranges)

    for i in range(n):
        s = word(i)
        if tokens[i][0] != "name":
            continue
        if s == grammar.function and s:
            j = i + 1
            if grammar.receivers and word(j) == "(":
                j = pair[j] + 1
            if word(j) == "*":
                j += 1
            k = j + 1
            if word(k) == "<":
                k = next((x for x in range(k, n) if word(x) == "("), k)
            if is_name(j) and word(k) == "(" and (not grammar.impl or word(end_of(pair[k] + 1)) == "}"):
                last = end_of(pair[k] + 1)
                method = (grammar.receivers and j > i + 1) or (grammar.impl and in_class(i))
                add("method" if method else "function", "method" if method and not grammar.impl else "function", j, i, last, params=text[tokens[k][3] : tokens[pair[k]][2]], callable=True)
            elif word(j) == "(":
                scopes.append(Scope("", None, None, tokens[i][2], tokens[min(end_of(pair[j] + 1), n - 1)][3], -1, callable=True))
        elif grammar.arrows and s in ("const", "let", "var") and is_name(i + 1):
            j = i + 2
            while j < n and word(j) not in ("=", ";") and word(j) not in CLOSE:
                j = pair[j] + 1 if word(j) in ("(", "[", "{") else j + 1
            last = end_of(j + 1) if word(j) == "=" else j
            # An arrow function goes on behind its brackets.
            value = j + 1 + (word(j + 1) == "async")
            arrow = word(value) == "function" or (word(value) == "(" and any(word(x) == "=>" for x in range(pair[value] + 1, min(n, pair[value] + 8)))) or word(value + 1) == "=>"
            add("variable" if arrow and word(j) == "=" else "", "function", i + 1, i + 1, last, callable=arrow, params=text[tokens[value][3] : tokens[pair[value]][2]] if arrow and word(value) == "(" else None)
        elif is_name(i) and word(i + 1) == "(" and i not in defined:
            after = pair[i + 1] + 1
            body = after
            while grammar.typed and body < n and word(body) not in ("{", ";", "=", ")", ",", "}") and body < after + HEAD:
                body = pair[body] + 1 if word(body) in ("(", "[") else body + 1
            if grammar.arrows and word(body) == ":" and in_class(i):
                while body < n and word(body) not in ("{", ";"):
                    body += 1
            before = tokens[i - 1] if i else ("", "", 0, 0)
            heads = before[0] == "name" and before[1] not in w("return new throw await else case in of typeof delete go defer do not co_await co_return co_yield") or before[1] in ("*", "&", ">", "]", "::")
            opens = word(body) == "{" and (heads or before[1] in ("{", "}", ";", "") and (in_class(i) or not grammar.arrows))
            if opens and (grammar.typed or (grammar.arrows and in_class(i))) and word(i - 1) not in (".", "->", "?."):
                method = in_class(i)
                add("method" if method else "function", "method" if method else "function", i, i if grammar.arrows else max(0, i - 1), pair[body], declares=grammar.arrows, params=text[tokens[i + 1][3] : tokens[pair[i + 1]][2]], callable=True)
            elif grammar.abstract and word(body) == ";" and heads and before[1] not in LINKS and outer[i] in bodies:
                method = in_class(i)
                add("method" if method else "function", "method" if method else "function", i, max(0, i - 1), body, declares=False, params=text[tokens[i + 1][3] : tokens[pair[i + 1]][2]], callable=True)
            elif grammar.declarations and word(after) == ";" and before[0] == "name" and heads and outer[i] not in bodies and all(t[0] == "name" or t[1] in DECLARES for t in tokens[i + 2 : pair[i + 1]]):
                method = in_class(i)
                add("method" if method else "function", "method" if method else "function", i, i - 1, after, declares=False, params=text[tokens[i + 1][3] : tokens[pair[i + 1]][2]])
    for i in range(n):
        s = word(i)
        if word(i + 1) == "(" and is_name(i) and i not in defined:
            first = i
            while word(first - 1) in LINKS:
                k = first - 2
                while word(k) in (")", "]"):  # what was called or looked up before
                    k = pair[k] - 1
                if not (is_name(k) or word(k) in ("this", "super", "self")):
                    first = k + 1
                    break
                first = k
            begin = first - 1 if grammar.created and word(first - 1) == "new" else first
            calls.append((tokens[first][2], tokens[i][3], tokens[pair[i + 1]][3], tokens[begin][2]))
        if s in BRANCH_WORDS or s in STATEMENT_WORDS:
            last = end_of(pair[i + 1] + 1 if word(i + 1) == "(" else i + 1)
            marks.append((tokens[i][2], s in BRANCH_WORDS, s in STATEMENT_WORDS, tokens[min(last, n - 1)][3]))
        elif s == "?" or (s in BINARY and i and (tokens[i - 1][0] in ("name", "number", "string") or word(i - 1) in CLOSE) and tokens[i - 1][1] not in grammar.keywords):
            marks.append((tokens[i][2], True, False, tokens[i][3]))
    marks += [(a, False, True, e) for a, _, e, _ in calls]
    names = [(t[1], t[2]) for i, t in enumerate(tokens) if is_name(i)]
    return shape(text, scopes, names, calls if grammar.call_index else [], marks) if grammar.call_index else unindexed(text, scopes, names, calls, marks)


def unindexed(text: str, scopes: list[Scope], names: list[tuple[str, int]], calls: list[tuple[int, int, int, int]], marks: list[tuple[int, bool, bool, int]]) -> Parsed:
    """Languages whose calls are listed, but whose references are none of them calls."""
    out = shape(text, scopes, names, [], marks)
    out.calls = shape(text, scopes, [], calls, []).calls
    return out


SCRIPT = Braces(w("class"), w("interface"), function="function", arrows=True, created=True, keywords=COMMON - w("map from of type as is string int char float double bool boolean byte short long record final native params range select ref out auto register self use mod match where go"))
GRAMMARS = {
    "javascript": SCRIPT,
    "typescript": SCRIPT,
    "tsx": SCRIPT,
    "c": Braces(w("struct enum union"), variables=w("typedef"), typed=True, keywords=COMMON - w("map string match self type record params go func fn")),
    "cpp": Braces(w("class struct enum union"), variables=w("namespace typedef"), typed=True, created=True, declarations=True, keywords=COMMON - w("map string match self type record params go func fn")),
    "csharp": Braces(w("class struct enum record"), w("interface"), variables=w("namespace delegate"), typed=True, call_index=False, abstract=True, keywords=COMMON - w("map match self type")),
    "java": Braces(w("class enum record"), w("interface"), typed=True, call_index=False, abstract=True, constants=True, keywords=COMMON - w("map match self type string")),
    "go": Braces(w("type"), function="func", receivers=True, keywords=COMMON - w("match self")),
    "rust": Braces(w("struct enum impl"), w("trait"), variables=w("mod type"), function="fn", impl=True, keywords=COMMON - w("map string range")),
}
register("python", python)
for _language, _grammar in GRAMMARS.items():
    register(_language, lambda text, grammar=_grammar: braces(text, grammar))
