"""Reads source and configuration syntax into bindings of names to literals, and propagates constants.

Understood are strings (three quotes, one, back quotes, with prefixes and escapes), comments, names, brackets and the
forms name = x, name := x, name => x, name: x, name: type = x, "name": x, place["name"] = x, f(name=x),
--name x, <name>x</name> and key="name" value="x". A value is a string, a bare word, a name, a call that only
decodes or defaults its arguments, or a concatenation of these; `a or b` has two values. Braces, and indentation after a
definition, open scopes. A name stands for what its nearest scope binds it to: the last binding before the use, else
the first after it. Bindings are followed to their literals whatever their order, until nothing new is known. A comment's inside is
read by itself and once, whatever comments stand in it. Time grows as the text does (times a logarithm), whatever stands in it: ends of strings and
comments, names, scopes and starts of lines are looked up in sorted lists. Values in more than 100 brackets or of more than 256 literals aren't read.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

#: What can stand where, but for what strings and comments hold: their ends are looked up, so text without an end costs no search.
_REST = (
    r"(?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)|(?P<op>:=|=>|->|==|!=|<=|>=|\|\||\?\?|</|/>|[=:+,;(){}\[\]<>?|])|(?P<nl>\n)|(?P<bare>[^\s\"'`,;(){}\[\]<>=:+?|]+)"
)
_QUOTED = r"(?P<string>(?<!\w)[rbfuRBFUL]{0,2}(?P<quote>\"{3}|'{3}|[\"'`]))"
_TOKEN = re.compile(rf"(?P<block>/\*|<!--)|(?P<line>(?<![^\s;{{}}(),])(?:\#|//)[^\n]*)|{_QUOTED}|{_REST}")
#: Inside a comment: what opens another one is a bare word.
_INNER = re.compile(rf"{_QUOTED}|{_REST}")
_PLAIN = re.compile(_REST)
_MARK = re.compile(r"""(\\*)("{3}|'{3}|["'\n])""")
_KINDS = ("block", "line", "string", "name", "op", "nl", "bare")
_BLOCK, _LINE, _STR, _NAME, _OP, _NL, _BARE = range(7)
_VALUE = re.compile(r"[A-Za-z0-9+/_.=~!@$%^&*-]+")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*\Z")
_OPENS = {"def", "class", "function", "func", "fn", "fun", "sub", "struct", "object", "module", "namespace", "interface"}
#: Brackets and calls around a value, and literals that make up one; deeper or longer ones aren't read.
_DEEPEST, _LONGEST = 100, 256
#: Calls whose value is that of their last argument.
_TRANSPARENT = {"str", "string", "bytes", "getenv", "get", "env", "decode", "b64decode", "atob", "encode", "from", "tostring", "secret", "default", "trim", "strip"}
#: Names that say nothing by themselves: the name around them counts.
GENERIC = {"value", "val", "default", "data", "content", "text", "stringvalue"}


@dataclass
class Binding:
    """A name with its values: each a list of parts, a literal's span or a name that stands for one."""

    name: str
    scope: int
    at: int
    values: list[list[tuple[int, int] | str]]


@dataclass
class Source:
    text: str
    inner: bool = False
    kinds: array = field(default_factory=lambda: array("b"))
    starts: array = field(default_factory=lambda: array("q"))
    ends: array = field(default_factory=lambda: array("q"))
    parents: list[int] = field(default_factory=lambda: [-1])
    labels: list[str] = field(default_factory=lambda: [""])
    comments: list[tuple[int, int]] = field(default_factory=list)
    missing: set[str] = field(default_factory=set)

    def __post_init__(self):
        self.lines = [-1, *(m.start() for m in re.finditer("\n", self.text))]
        closers = self._closers()
        at, token = 0, _INNER if self.inner else _TOKEN
        while m := token.search(self.text, at):
            kind, end = "string" if m["quote"] else m.lastgroup, m.end()
            if kind == "block":
                end = self._after("*/" if m[0] == "/*" else "-->", end)
            elif kind == "string":
                end = self._closed(end, m["quote"], closers)
                if end is None and len(m["quote"]) == 3:  # three quotes without their end: an empty string and another quote
                    end = m.end() - 1
            if end is None:  # no end: what stands here is read as plain
                start, m = m.start(), _PLAIN.match(self.text, m.start())
                if m is None:
                    at = start + 1
                    continue
                kind, end = m.lastgroup, m.end()
            if kind in ("block", "line"):
                self.comments.append((m.start(), end))
            else:
                self.kinds.append(_KINDS.index(kind))
                self.starts.append(m.start())
                self.ends.append(end)
            at = end

    def _closers(self) -> dict[str, array]:
        """Where each kind of quote could close a string, and where a line ends: not after an odd number of backslashes."""
        out = {q: array("q") for q in ('"', "'", '"' * 3, "'" * 3, "\n")}
        for m in _MARK.finditer(self.text):
            mark, at, free = m[2], m.start(2), len(m[1]) % 2 == 0
            for i in range(0 if free else 1, len(mark) if len(mark) == 3 else 0):
                out[mark[0]].append(at + i)
            if free:
                out[mark].append(at)
        return out

    def _after(self, mark: str, at: int) -> int | None:
        """The end of the next mark; once there is none, none is looked for again."""
        found = -1 if mark in self.missing else self.text.find(mark, at)
        if found < 0:
            self.missing.add(mark)
            return None
        return found + len(mark)

    def _closed(self, at: int, quote: str, closers: dict[str, array]) -> int | None:
        """The end of the string that opens before a place."""
        if quote == "`":
            return self._after(quote, at)
        places, ends = closers[quote], closers["\n"]
        i, j = bisect_left(places, at), bisect_left(ends, at)
        if i == len(places) or (len(quote) == 1 and j < len(ends) and ends[j] < places[i]):
            return None
        return places[i] + len(quote)

    def indent(self, at: int) -> int:
        """How far into its line a place is."""
        return at - self.lines[bisect_left(self.lines, at) - 1] - 1

    def word(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]] if 0 <= i < len(self.kinds) else ""

    def kind(self, i: int) -> int:
        return self.kinds[i] if 0 <= i < len(self.kinds) else _NL

    def literal(self, i: int) -> tuple[int, int]:
        """The span inside a string's quotes."""
        s, e = self.starts[i], self.ends[i]
        while self.text[s] not in "\"'`":
            s += 1
        n = 3 if self.text[s : s + 3] in ('"""', "'''") and e - s >= 6 else 1
        return s + n, e - n

    def over_lines(self, i: int) -> int:
        while i < len(self.kinds) and self.kinds[i] == _NL:
            i += 1
        return i

    def values(self, i: int, nested: bool = False, depth: int = 0) -> tuple[list[list], int]:
        """The values of the expression at token i, and the token after it; no values if it isn't one."""
        out, parts = [], []
        while True:
            i = self.over_lines(i) if nested else i
            kind, word = self.kind(i), self.word(i)
            if kind == _STR:
                parts.append(self.literal(i))
                i += 1
            elif word == "(" and depth < _DEEPEST:
                inner, i = self.values(i + 1, True, depth + 1)
                i = self.over_lines(i)
                if self.word(i) != ")" or len(inner) != 1:
                    return out, i
                parts += inner[0]
                i += 1
            elif kind == _NAME and self.word(i + 1) == "(":
                if word.rsplit(".", 1)[-1].lower() not in _TRANSPARENT or depth >= _DEEPEST:
                    return out, i
                i, last = i + 1, []
                while self.word(i) in ("(", ","):
                    last, i = self.values(i + 1, True, depth + 1)
                    i = self.over_lines(i)
                if self.word(i) != ")" or not last:
                    return out, i
                parts += last[0]
                i += 1
            elif kind in (_NAME, _BARE) or word == "+":
                m = _VALUE.match(self.text, self.starts[i])
                if not m or self.word(i + 1) == "[":
                    return out, i
                if _IDENTIFIER.match(m[0]):
                    parts.append(m[0])
                else:
                    parts.append(m.span())
                i = bisect_left(self.starts, m.end(), i)
            else:
                return out, i
            after = self.over_lines(i) if nested else i
            word = self.word(after)
            if word in ("+", ".", ".."):
                i = after + 1
            elif self.kind(after) == _STR and after > 0 and self.kind(after - 1) in (_STR, _NL) and (nested or self.kind(i) == _STR):
                i = after
            elif word in ("or", "||", "??"):
                out.append(parts)
                parts, i = [], after + 1
            else:
                out.append(parts)
                return out, i

    def bindings(self) -> Iterator[Binding]:
        stack, opened, key, line, round_ = [(0, -1)], None, "", True, 0
        i = 0
        while i < len(self.kinds):
            kind, word = self.kinds[i], self.word(i)
            if kind == _NL:
                if opened is not None and self.word(i - 1) == ":":  # a definition's body is what is indented deeper
                    stack.append((self._scope(stack[-1][0], opened[0]), opened[1]))
                    opened = None
                line = True
                i += 1
                continue
            if line and round_ == 0:
                indent = self.indent(self.starts[i])
                while len(stack) > 1 and stack[-1][1] is not None and stack[-1][1] >= indent:
                    stack.pop()
            line = False
            if kind == _NAME and word in _OPENS and self.kind(i + 1) == _NAME:
                opened = (self.word(i + 1), self.indent(self.starts[i]))
                i += 2
                continue
            if kind == _OP:
                if word == "{":
                    stack.append((self._scope(stack[-1][0], opened[0] if opened else key), None))
                    opened, key = None, ""
                elif word == "}":
                    while len(stack) > 1 and stack.pop()[1] is not None:
                        pass
                round_ = max(0, round_ + (word in "([") - (word in ")]")) if word in "()[]" else round_
                if word == "<" and self.kind(i + 1) == _NAME and self.word(i + 2) == ">" and (m := _VALUE.match(self.text, self.ends[i + 2])) and self.text[m.end() : m.end() + 2] == "</":
                    yield Binding(self.word(i + 1), stack[-1][0], self.starts[i], [[m.span()]])
                i += 1
                continue
            found = self._binding(i, stack[-1][0])
            if found is None:
                i += 1
                continue
            binding, i = found
            key = binding.name
            if binding.values:
                yield binding
            elif self.kind(i) == _NL and self.word(i - 1) == ":":  # a mapping, indented below its key
                opened = (key, self.indent(self.starts[i - 1]) - len(key))

    def _scope(self, parent: int, label: str) -> int:
        self.parents.append(parent)
        self.labels.append(label)
        return len(self.parents) - 1

    def _name(self, i: int) -> str:
        s, e = self.literal(i) if self.kinds[i] == _STR else (self.starts[i], self.ends[i])
        return self.text[s:e].strip("-")

    def _binding(self, i: int, scope: int) -> tuple[Binding, int] | None:
        at, after = i, i + 1
        if self.kinds[i] == _STR and self.word(i - 1) == "[" and self.word(after) == "]":
            after += 1
        after += self.word(after) == "?"
        op = self.word(after)
        if self.kinds[i] == _BARE and self.word(i).startswith("--") and op != "=":
            values, end = self.values(after) if self.kind(after) != _NL else ([], after)
            return Binding(self._name(at), scope, self.starts[at], values), max(end, i + 1)
        if op not in ("=", ":=", "=>", ":") or self.kinds[i] == _BARE and op == ":":
            return None
        if op == ":":
            j = after + 1
            while self.kind(j) == _NAME or self.word(j) in ("[", "]", "<", ">", "|", ",", "?"):
                j += 1
            if self.word(j) == "=" and j > after + 1 and self.text[self.starts[j] - 1].isspace() and self.kind(j + 1) != _NL:
                after = j  # what stands between is a type
        values, end = self.values(after + 1)
        if op == "=" and self._name(at) in ("key", "name", "id") and values and self.word(end) == "value" and self.word(end + 1) == "=" and self.kind(end + 2) == _STR and isinstance(values[0][0], tuple):
            s, e = values[0][0]
            return Binding(self.text[s:e], scope, self.starts[at], [[self.literal(end + 2)]]), end + 3
        return Binding(self._name(at), scope, self.starts[at], values), max(end, after + 1)


class Meanings:
    """Which binding a name stands for, wherever it is used."""

    def __init__(self, source: Source, found: list[Binding]):
        self.source, self.found = source, found
        self.places: dict[tuple[int, str], list[int]] = {}
        for i in sorted(range(len(found)), key=lambda i: found[i].at):
            self.places.setdefault((found[i].scope, found[i].name), []).append(i)
        self.ats = {k: [found[i].at for i in own] for k, own in self.places.items()}
        #: The first binding of a name in scopes of a label, and in any scope.
        self.labelled: dict[tuple[str, str], int] = {}
        self.anywhere: dict[str, int] = {}
        for scope, name in sorted(self.places):
            first = self.places[scope, name][0]
            self.labelled.setdefault((source.labels[scope], name), first)
            self.anywhere.setdefault(name, first)
        self.nearest = self._nearest()

    def _nearest(self) -> dict[tuple[int, str], int]:
        """For each scope that uses a name, the nearest one around it that binds it: a sweep over the scopes of each name, keeping those that are still open."""
        parents = self.source.parents
        last = list(range(len(parents)))
        for s in range(len(parents) - 1, 0, -1):
            last[parents[s]] = max(last[parents[s]], last[s])
        binds: dict[str, set[int]] = {}
        for scope, name in self.places:
            binds.setdefault(name, set()).add(scope)
        uses: dict[str, set[int]] = {}
        for b in self.found:
            for p in (p for parts in b.values for p in parts):
                if isinstance(p, str) and p in binds:
                    uses.setdefault(p, set()).add(b.scope)
        out = {}
        for name, scopes in uses.items():
            open_: list[int] = []
            for s in sorted(scopes | binds[name]):
                while open_ and last[open_[-1]] < s:
                    open_.pop()
                if s in binds[name]:
                    open_.append(s)
                if s in scopes and open_:
                    out[s, name] = open_[-1]
        return out

    def of(self, name: str, scope: int, at: int) -> int | None:
        near = self.nearest.get((scope, name))
        if near is not None:
            return self.places[near, name][max(bisect_left(self.ats[near, name], at) - 1, 0)]
        if "." in name:
            owner, last = name.rsplit(".", 1)
            return self.anywhere.get(last) if owner in ("self", "this") else self.labelled.get((owner.rsplit(".", 1)[-1], last))
        return None


def named_literals(text: str, inner: bool = False) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Each name with the spans of the literals that make up its value, through other names if need be."""
    source = Source(text, inner)
    found = list(source.bindings())
    for s, e in source.comments:  # a comment's bindings are by themselves
        body = text[s:e].lstrip("#/*<!-")
        for name, spans in named_literals(body, True) if ":" in body or "=" in body else ():
            yield name, [(a + e - len(body), b + e - len(body)) for a, b in spans]
    meanings = Meanings(source, found)
    known: dict[int, list[list[tuple[int, int]]] | None] = {}
    targets: dict[int, dict[str, int | None]] = {}
    for first in range(len(found)):
        todo = [first]
        while todo:  # names are followed with a stack of our own: chains may be long, cycles end
            i = todo[-1]
            if known.get(i) is not None:
                todo.pop()
                continue
            b = found[i]
            if i not in targets:
                targets[i] = {p: meanings.of(p, b.scope, b.at) for parts in b.values for p in parts if isinstance(p, str)}
            open_ = [t for t in targets[i].values() if t is not None and t not in known]
            if i not in known and open_:
                known[i] = None
                todo += open_
                continue
            known[i] = [spans for parts in b.values if (spans := _spans(parts, targets[i], known, i))]
            targets[i] = {}
            todo.pop()
    for i, b in enumerate(found):
        name = b.name
        if name.lower() in GENERIC and source.labels[b.scope]:
            name = source.labels[b.scope]
        for spans in known[i] or ():
            yield name, spans


def _spans(parts: list, targets: dict[str, int | None], known: dict, i: int) -> list[tuple[int, int]]:
    """The literals of a value's parts; none if one of them isn't known."""
    spans: list[tuple[int, int]] = []
    for p in parts:
        if isinstance(p, tuple):
            spans.append(p)
        else:
            t = targets.get(p)
            own = known.get(t) if t is not None and t != i else None
            if not own:
                return []
            spans += own[0]
        if len(spans) > _LONGEST:
            return []
    return spans
