"""Chat formatting: a compiler for a small, sandboxed template language.

Templates hold text, ``{{ expression }}``, ``{% for x in y %}``, ``{% if %}``/``elif``/``else``, ``{% set x = y %}``,
``{% generation %}`` around what a model is to learn, and ``{# remarks #}``; ``-`` at a tag's edge strips white space.
A template is parsed to a syntax tree, constants are folded, and the tree becomes nested Python closures. Names reach
only the variables passed in; ``a.b`` and ``a[b]`` only look up keys and positions, so no Python attribute is in reach.
Loops run over what a variable or a list holds, of any length; the language has no way to make a long list of its own.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHATML = (
    "{% for m in messages %}{{ '<|im_start|>' ~ m.role ~ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text ~ '<|im_end|>' }}{% endgeneration %}{{ '\\n' }}"
    "{% else %}{{ m.text ~ '<|im_end|>' ~ '\\n' }}{% endif %}{% endfor %}"
)

_TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_LEX = re.compile(r"\s*(?:(\d+\.\d+|\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|//|[-+*/%~<>()\[\].,|=]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_CONST = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}


class TemplateError(ValueError):
    pass


def _text(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def _get(box: Any, key: Any) -> Any:
    if isinstance(box, dict):
        return box.get(key)
    if isinstance(box, (list, tuple, str)) and isinstance(key, int) and -len(box) <= key < len(box):
        return box[key]
    return None


_FILTERS: dict[str, Callable] = {
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: 0 if x is None else len(x),
    "string": _text,
    "first": lambda x: _get(x, 0),
    "last": lambda x: _get(x, -1),
    "tojson": lambda x: json.dumps(x, ensure_ascii=False),
    "default": lambda x, d="": d if x is None else x,
    "join": lambda x, s="": _text(s).join(map(_text, x or [])),
    "replace": lambda x, a, b: _text(x).replace(_text(a), _text(b)),
}


def _times(a: Any, b: Any) -> Any:
    if not isinstance(a, (int, float)) or not isinstance(b, (int, float)):
        raise TemplateError("only numbers are multiplied")
    return a * b


_BINARY: dict[str, Callable] = {
    "+": operator.add, "-": operator.sub, "*": _times, "/": operator.truediv, "//": operator.floordiv, "%": operator.mod,
    "~": lambda a, b: _text(a) + _text(b), "==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt,
    "<=": operator.le, ">=": operator.ge, "in": lambda a, b: b is not None and a in b, "not in": lambda a, b: b is None or a not in b,
}


class _Parser:
    """Expressions to nodes: ('const', v), ('name', n), ('get', a, b), ('call', filter, args), (op, a, b), ('if', c, a, b), ..."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, Any]] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 20]!r}")
            number, string, name, sign = m.groups()
            if number:
                self.tokens.append(("const", float(number) if "." in number else int(number)))
            elif string:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), string[1:-1], flags=re.S)))
            else:
                self.tokens.append(("name", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "const" and self.tokens[self.at][1] in values

    def accept(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def expect(self, value: str) -> None:
        if not self.accept(value):
            raise TemplateError(f"{value!r} expected")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("name expected")

    def end(self) -> None:
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def expression(self) -> tuple:
        value = self.either()
        if self.accept("if"):
            test = self.either()
            other = self.expression() if self.accept("else") else ("const", None)
            return ("if", test, value, other)
        return value

    def either(self) -> tuple:
        node = self.both()
        while self.accept("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.accept("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.accept("not") else self.compared()

    def compared(self) -> tuple:
        node = self.joined()
        while True:
            if op := self.accept("==", "!=", "<", ">", "<=", ">=", "in"):
                node = (op, node, self.joined())
            elif self.peek("not"):
                self.at += 1
                self.expect("in")
                node = ("not in", node, self.joined())
            elif self.accept("is"):
                negative = self.accept("not")
                test = self.name()
                if test not in ("defined", "none"):
                    raise TemplateError(f"no test {test!r}")
                found = ("==", node, ("const", None))
                node = ("not", found) if (test == "defined") != bool(negative) else found
            else:
                return node

    def joined(self) -> tuple:
        node = self.summed()
        while self.accept("~"):
            node = ("~", node, self.summed())
        return node

    def summed(self) -> tuple:
        node = self.multiplied()
        while op := self.accept("+", "-"):
            node = (op, node, self.multiplied())
        return node

    def multiplied(self) -> tuple:
        node = self.signed()
        while op := self.accept("*", "/", "//", "%"):
            node = (op, node, self.signed())
        return node

    def signed(self) -> tuple:
        return ("-", ("const", 0), self.signed()) if self.accept("-") else self.filtered()

    def filtered(self) -> tuple:
        node = self.primary()
        while True:
            if self.accept("."):
                node = ("get", node, ("const", self.name()))
            elif self.accept("["):
                node = ("get", node, self.expression())
                self.expect("]")
            elif self.accept("|"):
                name, args = self.name(), [node]
                if name not in _FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                if self.accept("("):
                    while not self.accept(")"):
                        args.append(self.expression())
                        if not self.peek(")"):
                            self.expect(",")
                node = ("call", name, tuple(args))
            else:
                return node

    def primary(self) -> tuple:
        if self.accept("("):
            node = self.expression()
            self.expect(")")
            return node
        if self.accept("["):
            items = []
            while not self.accept("]"):
                items.append(self.expression())
                if not self.peek("]"):
                    self.expect(",")
            return ("list", tuple(items))
        if self.at >= len(self.tokens):
            raise TemplateError("expression expected")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "const":
            return ("const", value)
        if kind == "name":
            return ("const", _CONST[value]) if value in _CONST else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(template: str) -> list[tuple]:
    """Statements: ('text', s), ('out', e), ('for', name, e, body, other), ('if', [(test, body)...]), ('set', name, e), ('gen', body)."""
    parts = _TAG.split(template)
    for i in range(1, len(parts), 2):
        tag = parts[i]
        if tag[2] == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        if tag[-3] == "-":
            parts[i + 1] = parts[i + 1].lstrip()
    stack: list[tuple[str, Any, list]] = [("", None, [])]
    for i, part in enumerate(parts):
        body = stack[-1][2]
        if i % 2 == 0:
            if part:
                body.append(("text", part))
            continue
        if part.startswith("{#"):
            continue
        p = _Parser(part[2:-2].strip("-"))
        if part.startswith("{{"):
            body.append(("out", p.expression()))
            p.end()
            continue
        word = p.name()
        if word == "for":
            name = p.name()
            p.expect("in")
            stack.append(("for", (name, p.expression()), []))
        elif word == "if":
            stack.append(("if", [[p.expression(), None]], []))
        elif word in ("elif", "else") and stack[-1][0] == "if":
            _, tests, done = stack.pop()
            tests[-1][1] = done
            tests.append([p.expression() if word == "elif" else ("const", True), None])
            stack.append(("if", tests, []))
        elif word == "set":
            name = p.name()
            p.expect("=")
            body.append(("set", name, p.expression()))
        elif word == "generation":
            stack.append(("gen", None, []))
        elif word.startswith("end") and len(stack) > 1 and stack[-1][0] == {"endfor": "for", "endif": "if", "endgeneration": "gen"}.get(word):
            kind, head, done = stack.pop()
            if kind == "if":
                head[-1][1] = done
                stack[-1][2].append(("if", head))
            else:
                stack[-1][2].append(("for", *head, done) if kind == "for" else ("gen", done))
        else:
            raise TemplateError(f"unexpected {word!r}")
        p.end()
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]!r} is not ended")
    return stack[0][2]


def fold(node: tuple) -> tuple:
    """The expression with every part that needs no variable computed."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "call":
        args = tuple(map(fold, node[2]))
        node, parts = ("call", node[1], args), args
    elif kind == "list":
        parts = tuple(map(fold, node[1]))
        node = ("list", parts)
    else:
        parts = tuple(map(fold, node[1:]))
        node = (kind, *parts)
        if kind == "if" and parts[0][0] == "const":
            return parts[1] if parts[0][1] else parts[2]
    if all(p[0] == "const" for p in parts):
        try:
            return ("const", _expression(node)({}))
        except (TypeError, ZeroDivisionError, AttributeError):
            return node
    return node


def fold_body(body: list[tuple]) -> list[tuple]:
    """Statements with folded expressions: constant output is text, neighbouring text is joined, dead branches go."""
    out: list[tuple] = []
    for s in body:
        if s[0] == "out":
            e = fold(s[1])
            s = ("text", _text(e[1])) if e[0] == "const" else ("out", e)
        elif s[0] == "for":
            s = ("for", s[1], fold(s[2]), fold_body(s[3]))
        elif s[0] == "set":
            s = ("set", s[1], fold(s[2]))
        elif s[0] == "gen":
            s = ("gen", fold_body(s[1]))
        elif s[0] == "if":
            live = []
            for test, part in s[1]:
                test = fold(test)
                if test[0] == "const" and not test[1]:
                    continue
                live.append((test, fold_body(part)))
                if test[0] == "const":
                    break
            if not live:
                continue
            if live[0][0][0] == "const":
                for x in live[0][1]:
                    _push(out, x)
                continue
            s = ("if", live)
        _push(out, s)
    return out


def _push(out: list[tuple], s: tuple) -> None:
    if s[0] == "text" and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + s[1])
    elif s != ("text", ""):
        out.append(s)


def _expression(node: tuple) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, n=node[1]: env.get(n)
    if kind == "call":
        f, args = _FILTERS[node[1]], [_expression(a) for a in node[2]]
        return lambda env: f(*[a(env) for a in args])
    if kind == "list":
        items = [_expression(a) for a in node[1]]
        return lambda env: [a(env) for a in items]
    parts = [_expression(p) for p in node[1:]]
    if kind == "not":
        return lambda env, a=parts[0]: not a(env)
    if kind == "if":
        return lambda env, c=parts[0], a=parts[1], b=parts[2]: a(env) if c(env) else b(env)
    a, b = parts
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    if kind == "get":
        return lambda env: _get(a(env), b(env))
    op = _BINARY[kind]
    return lambda env: op(a(env), b(env))


class _Out:
    __slots__ = ("parts", "length", "spans")

    def __init__(self) -> None:
        self.parts, self.length, self.spans = [], 0, []

    def write(self, s: str) -> None:
        self.parts.append(s)
        self.length += len(s)


def _body(body: list[tuple]) -> Callable[[dict, _Out], None]:
    steps = [_statement(s) for s in body]

    def run(env: dict, out: _Out) -> None:
        for step in steps:
            step(env, out)

    return run


def _statement(s: tuple) -> Callable[[dict, _Out], None]:
    if s[0] == "text":
        return lambda env, out, t=s[1]: out.write(t)
    if s[0] == "out":
        return lambda env, out, e=_expression(s[1]): out.write(_text(e(env)))
    if s[0] == "set":

        def assign(env: dict, out: _Out, name=s[1], e=_expression(s[2])) -> None:
            env[name] = e(env)

        return assign
    if s[0] == "gen":

        def mark(env: dict, out: _Out, body=_body(s[1])) -> None:
            start = out.length
            body(env, out)
            out.spans.append((start, out.length))

        return mark
    if s[0] == "if":
        tests = [(_expression(t), _body(b)) for t, b in s[1]]

        def choose(env: dict, out: _Out) -> None:
            for test, body in tests:
                if test(env):
                    body(env, out)
                    return

        return choose

    def loop(env: dict, out: _Out, name=s[1], e=_expression(s[2]), body=_body(s[3])) -> None:
        items = e(env)
        if not isinstance(items, (list, tuple)):
            items = list(items) if isinstance(items, (str, dict)) else []
        inner = dict(env)
        for i, item in enumerate(items):
            inner[name] = item
            inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1, "length": len(items)}
            body(inner, out)

    return loop


@lru_cache(maxsize=64)
def compile_template(template: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from variables to the text and the (start, end) of its generated parts, in characters."""
    run = _body(fold_body(parse(template)))

    def render(variables: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        run(dict(variables), out)
        return "".join(out.parts), out.spans

    return render


def render(conversations: DataFrame, template: str = CHATML) -> DataFrame:
    """(conv_id, n_turns, rendered, spans) for every conversation; ``spans`` is "start:end,..." of what is generated.

    Turns come in order of (turn, role, text), nulls first; a repeated turn is rendered again. A null role or text
    is rendered as nothing. Turns without a conv_id belong to no conversation and are left out. Texts may hold
    template signs; they are data. An empty table gives no rows.
    """
    compile_template(template)
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    grouped = conversations.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(turns.alias("messages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = compile_template(template)
        for b in batches:
            messages = b.column(1).to_pylist()
            made = [make({"messages": m}) for m in messages]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(m) for m in messages], pa.int64()), pa.array([t for t, _ in made], pa.string()), pa.array([",".join(f"{s}:{e}" for s, e in x) for _, x in made], pa.string())],
                names=["conv_id", "n_turns", "rendered", "spans"],
            )

    return grouped.mapInArrow(run, "conv_id long, n_turns long, rendered string, spans string")
