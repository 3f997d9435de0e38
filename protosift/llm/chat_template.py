"""Chat formatting by compiled templates.

A template is text with ``{{ expression }}``, ``{% if %}``/``{% elif %}``/
``{% else %}``, ``{% for x in list %}``, ``{% set x = expression %}`` and
``{% generation %}``, which marks what a model is trained to produce. A dash
within a bracket trims white space beside it; ``{# #}`` is a comment. It is parsed
to a syntax tree, whose constant parts are folded, and every node becomes a
Python closure.

The language is a sandbox: values are strings, numbers, booleans, none, lists
and mappings; a dot or an index reads entries of mappings and lists and never
attributes; there are no calls but the filters and tests named here.

Texts are made safe by the filter ``escape``. It doubles backslashes and puts one
behind the first character of every control string, so that no control string
stays and ``unescape`` gives the text back.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protosift.llm.scratch import groups


class TemplateError(ValueError):
    """A template that cannot be parsed, or a value it cannot work on."""


class Missing:
    """The value of a name or entry that is not there: empty text, and false."""

    def __bool__(self):
        return False

    def __str__(self):
        return ""


MISSING = Missing()
Env = dict[str, Any]


class Output:
    """Text so far, and the spans of it that generation blocks wrote."""

    def __init__(self):
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Entry:
    of: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    """An operator, filter or test on its operands."""

    what: str
    operands: tuple


@dataclass(frozen=True)
class Choice:
    """The first branch whose condition holds. ``and``, ``or`` and the ternary too."""

    branches: tuple
    otherwise: Any


@dataclass(frozen=True)
class Print:
    value: Any


@dataclass(frozen=True)
class Block:
    nodes: tuple


@dataclass(frozen=True)
class Loop:
    name: str
    items: Any
    body: Any


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: Any


def text_of(value: Any) -> str:
    if value is None or value is MISSING:
        return ""
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, (str, int, float)):
        return str(value)
    raise TemplateError("only texts, numbers and booleans can be written")


def _entry(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key, MISSING)
    if isinstance(of, (list, tuple)) and isinstance(key, int) and -len(of) <= key < len(of):
        return of[key]
    return MISSING


def _plus(a: Any, b: Any) -> Any:
    if isinstance(a, str) or isinstance(b, str):
        return text_of(a) + text_of(b)
    return a + b


# Operators of the language by rank, weakest first.
RANKS = (("or",), ("and",), ("not",), ("==", "!=", "<", ">", "<=", ">=", "in", "not in", "is", "is not"), ("~",), ("+", "-"), ("*", "//", "%"))
OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "not in": lambda a, b: a not in b,
    "~": lambda a, b: text_of(a) + text_of(b),
    "+": _plus,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "//": lambda a, b: a // b,
    "%": lambda a, b: a % b,
    "not": lambda a: not a,
    "negate": lambda a: -a,
}
TESTS: dict[str, Callable] = {
    "defined": lambda a: a is not MISSING,
    "none": lambda a: a is None,
    "string": lambda a: isinstance(a, str),
}
FILTERS: dict[str, Callable] = {
    "trim": lambda a: text_of(a).strip(),
    "upper": lambda a: text_of(a).upper(),
    "lower": lambda a: text_of(a).lower(),
    "length": len,
    "default": lambda a, b="": b if a is MISSING or a is None else a,
    "replace": lambda a, b, c: text_of(a).replace(b, c),
}

_TAG = re.compile(r"\{([{%#])(-?)(.*?)(-?)[}%#]\}", re.DOTALL)
_WORD = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|//|[-+*%~<>=|.,()\[\]]))""", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Parses one expression, or several separated by what the caller takes."""

    def __init__(self, text: str, filters: dict[str, Callable]):
        self.filters, self.words, at = filters, [], 0
        text = text.rstrip()
        while at < len(text):
            m = _WORD.match(text, at)
            if not m:
                raise TemplateError(f"not understood: {text[at:at + 20]!r}")
            kind = next(k for k, g in zip(("string", "number", "name", "mark"), m.groups(), strict=True) if g is not None)
            self.words.append((kind, m.group(m.lastindex)))
            at = m.end()
        self.at = 0

    def peek(self, *wanted: str) -> bool:
        return self.at < len(self.words) and self.words[self.at][1] in wanted and self.words[self.at][0] in ("name", "mark")

    def take(self, *wanted: str) -> str | None:
        if self.peek(*wanted):
            self.at += 1
            return self.words[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing")

    def name(self) -> str:
        if self.at >= len(self.words) or self.words[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.words[self.at - 1][1]

    def end(self) -> None:
        if self.at < len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]!r}")

    def whole(self) -> Any:
        found = self.ternary()
        self.end()
        return found

    def ternary(self) -> Any:
        value = self.ranked(0)
        if self.take("if"):
            condition = self.ranked(0)
            return Choice(((condition, value),), self.ternary() if self.take("else") else Const(""))
        return value

    def ranked(self, rank: int) -> Any:
        if rank == len(RANKS):
            return self.filtered()
        if RANKS[rank] == ("not",):
            return Apply("not", (self.ranked(rank),)) if self.take("not") else self.ranked(rank + 1)
        left = self.ranked(rank + 1)
        while True:
            word = self.take(*RANKS[rank])
            if word is None and "not in" in RANKS[rank] and self.peek("not"):
                self.at += 1
                self.need("in")
                word = "not in"
            if word is None:
                return left
            if word == "is":
                test = Apply(f"is {'' if not self.take('not') else 'not '}{(name := self.name())}", (left,))
                if name not in TESTS:
                    raise TemplateError(f"no test {name!r}")
                left = test
                continue
            right = self.ranked(rank + 1)
            if word == "or":
                left = Apply("or", (left, right))
            elif word == "and":
                left = Apply("and", (left, right))
            else:
                left = Apply(word, (left, right))

    def filtered(self) -> Any:
        value = self.single()
        while self.take("|"):
            name, operands = self.name(), [value]
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            if self.take("("):
                while not self.take(")"):
                    operands.append(self.ternary())
                    if not self.peek(")"):
                        self.need(",")
            value = Apply(f"|{name}", tuple(operands))
        return value

    def single(self) -> Any:
        if self.take("-"):
            return Apply("negate", (self.single(),))
        if self.take("("):
            value = self.ternary()
            self.need(")")
        else:
            if self.at >= len(self.words):
                raise TemplateError("an expression is missing")
            kind, word = self.words[self.at]
            self.at += 1
            if kind == "string":
                value = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.DOTALL))
            elif kind == "number":
                value = Const(int(word))
            elif kind == "name":
                fixed = {"true": True, "false": False, "none": None}
                value = Const(fixed[word.lower()]) if word.lower() in fixed else Name(word)
            else:
                raise TemplateError(f"unexpected {word!r}")
        while True:
            if self.take("."):
                value = Entry(value, Const(self.name()))
            elif self.take("["):
                value = Entry(value, self.ternary())
                self.need("]")
            else:
                return value


def parse(source: str, filters: dict[str, Callable]) -> Block:
    """The syntax tree of a template."""
    pieces: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(source):
        kind, left, inner, right = m.groups()
        text = source[at : m.start()]
        if pieces and pieces[-1][0] == "trim":
            pieces.pop()
            text = text.lstrip()
        pieces.append(("text", text.rstrip() if left else text))
        if kind != "#":
            pieces.append((kind, inner.strip()))
        if right:
            pieces.append(("trim", ""))
        at = m.end()
    tail = source[at:]
    pieces.append(("text", tail.lstrip() if pieces and pieces[-1][0] == "trim" else tail))
    pieces = [p for p in pieces if p[0] != "trim"]
    place = 0

    def block(*ends: str) -> tuple[Block, str, str]:
        nonlocal place
        nodes: list[Any] = []
        while place < len(pieces):
            kind, inner = pieces[place]
            place += 1
            if kind == "text":
                nodes.append(Print(Const(inner)))
                continue
            if kind == "{":
                nodes.append(Print(_Expression(inner, filters).whole()))
                continue
            word, _, rest = inner.partition(" ")
            if word in ends:
                return Block(tuple(nodes)), word, rest
            if word == "if":
                branches, condition = [], rest
                while True:
                    parsed = _Expression(condition, filters).whole()
                    body, word, condition = block("elif", "else", "endif")
                    branches.append((parsed, body))
                    if word == "else":
                        otherwise, _, _ = block("endif")
                        break
                    if word == "endif":
                        otherwise = Block(())
                        break
                nodes.append(Choice(tuple(branches), otherwise))
            elif word == "for":
                parts = _Expression(rest, filters)
                name = parts.name()
                parts.need("in")
                items = parts.whole()
                nodes.append(Loop(name, items, block("endfor")[0]))
            elif word == "set":
                parts = _Expression(rest, filters)
                name = parts.name()
                parts.need("=")
                nodes.append(Assign(name, parts.whole()))
            elif word == "generation":
                nodes.append(Generation(block("endgeneration")[0]))
            else:
                raise TemplateError(f"unexpected {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return Block(tuple(nodes)), "", ""

    return block()[0]


def fold(node: Any, filters: dict[str, Callable]) -> Any:
    """The tree with constant operations carried out and constant texts joined."""
    if isinstance(node, Entry):
        node = Entry(fold(node.of, filters), fold(node.key, filters))
        if isinstance(node.of, Const) and isinstance(node.key, Const):
            return Const(_entry(node.of.value, node.key.value))
    elif isinstance(node, Apply):
        operands = tuple(fold(x, filters) for x in node.operands)
        node = Apply(node.what, operands)
        if operands and node.what in ("and", "or") and isinstance(operands[0], Const):
            return operands[1] if bool(operands[0].value) == (node.what == "and") else operands[0]
        if all(isinstance(x, Const) for x in operands):
            return Const(_function(node.what, filters)(*(x.value for x in operands)))
    elif isinstance(node, Choice):
        branches = []
        for condition, body in node.branches:
            condition = fold(condition, filters)
            if isinstance(condition, Const):
                if condition.value:
                    otherwise = fold(body, filters)
                    return Choice(tuple(branches), otherwise) if branches else otherwise
                continue
            branches.append((condition, fold(body, filters)))
        otherwise = fold(node.otherwise, filters)
        return Choice(tuple(branches), otherwise) if branches else otherwise
    elif isinstance(node, Print):
        value = fold(node.value, filters)
        return Print(Const(text_of(value.value)) if isinstance(value, Const) else value)
    elif isinstance(node, Block):
        nodes: list[Any] = []
        for x in node.nodes:
            x = fold(x, filters)
            for y in x.nodes if isinstance(x, Block) else (x,):
                constant = isinstance(y, Print) and isinstance(y.value, Const)
                if constant and not y.value.value:
                    continue
                if constant and nodes and isinstance(nodes[-1], Print) and isinstance(nodes[-1].value, Const):
                    nodes[-1] = Print(Const(nodes[-1].value.value + y.value.value))
                else:
                    nodes.append(y)
        return Block(tuple(nodes))
    elif isinstance(node, Loop):
        return Loop(node.name, fold(node.items, filters), fold(node.body, filters))
    elif isinstance(node, Assign):
        return Assign(node.name, fold(node.value, filters))
    elif isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    return node


def _function(what: str, filters: dict[str, Callable]) -> Callable:
    if what.startswith("|"):
        return filters[what[1:]]
    if what.startswith("is not "):
        test = TESTS[what[7:]]
        return lambda a: not test(a)
    if what.startswith("is "):
        return TESTS[what[3:]]
    return {"and": lambda a, b: a and b, "or": lambda a, b: a or b}.get(what) or OPERATORS[what]


def value_closure(node: Any, filters: dict[str, Callable]) -> Callable[[Env], Any]:
    """A function of the names' values."""
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name, MISSING)
    if isinstance(node, Entry):
        of, key = value_closure(node.of, filters), value_closure(node.key, filters)
        return lambda env: _entry(of(env), key(env))
    if isinstance(node, Choice):
        branches = [(value_closure(c, filters), value_closure(v, filters)) for c, v in node.branches]
        otherwise = value_closure(node.otherwise, filters)
        return lambda env: next((v for c, v in branches if c(env)), otherwise)(env)
    operands = [value_closure(x, filters) for x in node.operands]
    if node.what == "and":
        return lambda env: operands[0](env) and operands[1](env)
    if node.what == "or":
        return lambda env: operands[0](env) or operands[1](env)
    function = _function(node.what, filters)
    if len(operands) == 1:
        only = operands[0]
        return lambda env: function(only(env))
    return lambda env: function(*(x(env) for x in operands))


def writer_closure(node: Any, filters: dict[str, Callable]) -> Callable[[Env, Output], None]:
    """A function that writes what the node gives."""
    if isinstance(node, Print):
        if isinstance(node.value, Const):
            text = node.value.value
            return lambda env, out: out.write(text)
        value = value_closure(node.value, filters)
        return lambda env, out: out.write(text_of(value(env)))
    if isinstance(node, Block):
        writers = [writer_closure(x, filters) for x in node.nodes]

        def run_all(env: Env, out: Output) -> None:
            for write in writers:
                write(env, out)

        return run_all
    if isinstance(node, Choice):
        branches = [(value_closure(c, filters), writer_closure(b, filters)) for c, b in node.branches]
        otherwise = writer_closure(node.otherwise, filters)
        return lambda env, out: next((b for c, b in branches if c(env)), otherwise)(env, out)
    if isinstance(node, Assign):
        name, value = node.name, value_closure(node.value, filters)

        def assign(env: Env, out: Output) -> None:
            env[name] = value(env)

        return assign
    if isinstance(node, Generation):
        body = writer_closure(node.body, filters)

        def generate(env: Env, out: Output) -> None:
            begin = out.length
            body(env, out)
            out.spans.append((begin, out.length))

        return generate
    name, items, body = node.name, value_closure(node.items, filters), writer_closure(node.body, filters)

    def loop(env: Env, out: Output) -> None:
        values = items(env)
        if not isinstance(values, (list, tuple)):
            raise TemplateError("only a list can be looped over")
        inner = dict(env)
        for i, value in enumerate(values):
            inner[name] = value
            inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(values) - 1, "length": len(values)}
            body(inner, out)

    return loop


class Escaper:
    """Keeps control strings out of texts, reversibly."""

    def __init__(self, controls: tuple[str, ...]):
        if any(len(c) < 2 or "\\" in c for c in controls):
            raise ValueError("control strings have two characters or more and no backslash")
        found = "|".join(re.escape(c) for c in sorted(controls, key=len, reverse=True))
        self.pattern = re.compile(rf"\\|{found}" if found else r"\\")

    def escape(self, value: Any) -> str:
        return self.pattern.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text_of(value))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)


class ChatTemplate:
    """A compiled template; ``escape`` knows its control strings."""

    def __init__(self, source: str, controls: tuple[str, ...]):
        for a in controls:
            for b in controls:
                if a != b and (a in b or any(a.endswith(b[:k]) for k in range(1, len(b)))):
                    raise ValueError(f"control strings overlap: {a!r} and {b!r}")
        self.source, self.controls = source, controls
        self.escaper = Escaper(controls)
        filters = FILTERS | {"escape": self.escaper.escape}
        self.tree = fold(parse(source, filters), filters)
        self.write = writer_closure(self.tree, filters)

    def render(self, messages: list[dict], **values: Any) -> tuple[str, list[tuple[int, int]]]:
        """The formatted conversation, and the spans of its generation blocks in
        code points."""
        out = Output()
        self.write({"messages": messages} | values, out)
        return "".join(out.parts), out.spans


# A format whose turns can be read back.
TURN_CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
TURN_TEMPLATE = """{%- for m in messages -%}
<s>[INST] {{ m.role | escape }} [/INST]
{%- if m.role == 'assistant' -%}
{% generation %}{{ m.text | escape }}{% endgeneration %}
{%- else -%}
{{ m.text | escape }}
{%- endif -%}
</s>
{%- endfor -%}"""
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.DOTALL)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn in a conversation of ``TURN_TEMPLATE``."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((Escaper.unescape(m[1]), Escaper.unescape(m[2])))
        at = m.end()
    return turns


class ChatFormatter:
    """Formats conversations from a table of turns.

    Turns follow ``turn_col``, those of equal turn their role and text. Null roles
    and texts are empty. Rows with a null conversation id are one conversation. An
    empty table gives none. Columns other than the four named are not read. A
    task holds one conversation at a time.
    """

    def __init__(self, source=TURN_TEMPLATE, controls=TURN_CONTROLS, id_col="conv_id", turn_col="turn", role_col="role", text_col="text"):
        self.source, self.controls = source, tuple(controls)
        self.columns = (id_col, turn_col, role_col, text_col)
        ChatTemplate(source, self.controls)  # errors show here and not in tasks

    def format(self, turns: DataFrame) -> DataFrame:
        """(id, formatted, spans): spans (start, end) of generation, in code points."""
        source, controls = self.source, self.controls
        i, t, r, x = self.columns
        rows = turns.select(
            F.col(i).cast("long").alias("id"),
            F.col(t).cast("long").alias("turn"),
            F.coalesce(F.col(r).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(x).cast("string"), F.lit("")).alias("text"),
        )

        def run(batches):
            template = ChatTemplate(source, controls)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            for conversation in groups(batches, ("id",)):
                messages = conversation.select(["role", "text"]).to_pylist()
                formatted, spans = template.render(messages)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([conversation.column("id")[0].as_py()], pa.int64()),
                        pa.array([formatted]),
                        pa.array([[{"start": a, "end": b} for a, b in spans]], kind),
                    ],
                    names=["id", "formatted", "spans"],
                )

        ordered = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
        return ordered.mapInArrow(run, "id long, formatted string, spans array<struct<start:long,end:long>>")

    @staticmethod
    def read_back(formatted: DataFrame) -> DataFrame:
        """(id, turns, loss, formatted_chars): turns (role, text) and the text under
        the loss mask, without escapes, of what ``TURN_TEMPLATE`` formatted."""

        def run(batches):
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            for batch in batches:
                turns, losses, sizes = [], [], []
                for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    turns.append([{"role": a, "text": b} for a, b in read_turns(text)])
                    losses.append("".join(Escaper.unescape(text[s["start"] : s["end"]]) for s in spans))
                    sizes.append(len(text))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(turns, kind), pa.array(losses, pa.string()), pa.array(sizes, pa.int64())],
                    names=["id", "turns", "loss", "formatted_chars"],
                )

        schema = "id long, turns array<struct<role:string,text:string>>, loss string, formatted_chars long"
        return formatted.select("id", "formatted", "spans").mapInArrow(run, schema)
