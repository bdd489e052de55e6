"""Chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, constant parts are folded,
and the tree becomes nested Python closures. Templates see only the turns they are given and
the filters listed here: no attribute access, no calls, no imports.

    {{ expr }}                      output; ``turn.role | escape``, 'text', a + b
    {% for turn in turns %} … {% endfor %}
    {% if expr %} … {% elif expr %} … {% else %} … {% endif %}
    {% generation %} … {% endgeneration %}   what is inside is under the loss mask

Expressions know names, ``loop.index`` (from 1) and ``loop.first``, string and integer
constants, ``+``, ``==``, ``!=``, ``and``, ``or``, ``not`` and filters. Rendering is lazy: turns
may come from an iterator and pieces go out one by one, so a conversation of any length is
rendered in bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

CONTROL = ("<s>", "</s>", "[ROLE]", "[TEXT]", "[INST]", "[/INST]")
TEMPLATE = (
    "{% for turn in turns %}<s>[ROLE]{{ turn.role | escape }}"
    "{% if turn.role == 'assistant' %}[TEXT]{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% elif turn.role == 'user' %}[INST]{{ turn.text | escape }}[/INST]"
    "{% else %}[TEXT]{{ turn.text | escape }}{% endif %}</s>{% endfor %}"
)

_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Make control strings inside a text harmless; ``unescape`` restores the text exactly."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    pass


# -- parsing --------------------------------------------------------------------------------

_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKENS = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z]\w*(?:\.[A-Za-z]\w*)?)|(==|!=|[+|()]))")


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        if not (m := _TOKENS.match(source, at)):
            raise TemplateError(f"can't read {source[at:]!r}")
        text, number, name, sign = m.groups()
        out.append(("const", unescape(text[1:-1])) if text else ("const", int(number)) if number else ("name", name) if name else ("sign", sign))
        at = m.end()
    return out


class _Expression:
    """Precedence climbing over a token list; nodes are tuples."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def parse(self):
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "const" and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def either(self):
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        node = self.added()
        while sign := self.take("==", "!="):
            node = (sign, node, self.added())
        return node

    def added(self):
        node = self.filtered()
        while self.take("+"):
            node = ("+", node, self.filtered())
        return node

    def filtered(self):
        node = self.atom()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            self.at += 1
            node = ("filter", name, node)
        return node

    def atom(self):
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is open")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        if kind == "sign" or value in ("and", "or", "not"):
            raise TemplateError(f"unexpected {value!r}")
        self.at += 1
        return (kind, value)


def parse(source: str) -> list:
    """The syntax tree: a list of statements."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _PARTS.finditer(source):
        parts += [("text", source[at : m.start()])] if m.start() > at else []
        parts.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    parts += [("text", source[at:])] if at < len(source) else []
    position = 0

    def block(*ends: str):
        nonlocal position
        body = []
        while position < len(parts):
            kind, value = parts[position]
            position += 1
            if kind == "text":
                body.append(("text", ("const", value)))
            elif kind == "out":
                body.append(("text", _Expression(value).parse()))
            else:
                word = value.split(None, 1)[0] if value else ""
                if word in ends:
                    return body, value
                body.append(statement(word, value))
        if ends:
            raise TemplateError(f"{ends[0]} is missing")
        return body, ""

    def statement(word: str, value: str):
        if word == "for" and (m := re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+([A-Za-z]\w*)", value)):
            return ("for", m[1], m[2], block("endfor")[0])
        if word == "generation":
            return ("generation", block("endgeneration")[0])
        if word == "if":
            arms, test = [], value[2:]
            while True:
                body, end = block("elif", "else", "endif")
                arms.append((_Expression(test).parse(), body))
                if end.startswith("elif"):
                    test = end[4:]
                    continue
                return ("if", arms, block("endif")[0] if end == "else" else [])
        raise TemplateError(f"unknown statement {value!r}")

    return block()[0]


# -- folding --------------------------------------------------------------------------------

_OPERATORS = {"+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def fold_expression(node):
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "filter":
        inner = fold_expression(node[2])
        return ("const", FILTERS[node[1]](_text(inner[1]))) if inner[0] == "const" else ("filter", node[1], inner)
    parts = [fold_expression(x) for x in node[1:]]
    if kind == "not":
        return ("const", not parts[0][1]) if parts[0][0] == "const" else ("not", parts[0])
    if kind in _OPERATORS:
        return ("const", _OPERATORS[kind](parts[0][1], parts[1][1])) if parts[0][0] == parts[1][0] == "const" else (kind, *parts)
    if parts[0][0] == "const":  # and, or
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    return (kind, *parts)


def fold(body: list) -> list:
    """Constant expressions become constants, tests of constants choose their arm, neighbouring texts join."""
    out: list = []

    def add(node) -> None:
        if node[0] == "text" and node[1][0] == "const":
            before = out.pop()[1][1] if out and out[-1][0] == "text" and out[-1][1][0] == "const" else ""
            text = _text(before) + _text(node[1][1])
            node = ("text", ("const", text))
            if not text:
                return
        out.append(node)

    for node in body:
        if node[0] == "text":
            add(("text", fold_expression(node[1])))
        elif node[0] == "for":
            add(("for", node[1], node[2], fold(node[3])))
        elif node[0] == "generation":
            add(("generation", fold(node[1])))
        else:
            arms, rest = [], fold(node[2])
            for test, inner in node[1]:
                test = fold_expression(test)
                if test[0] == "const":
                    if test[1]:
                        rest = fold(inner)
                        break
                    continue
                arms.append((test, fold(inner)))
            if arms:
                add(("if", arms, rest))
            else:
                for inner in rest:
                    add(inner)
    return out


# -- closures -------------------------------------------------------------------------------

Pieces = Iterator[tuple[str, bool]]


def _value(node) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda scope: value
    if kind == "name":
        name, _, field = node[1].partition(".")
        if field:
            return lambda scope: (scope.get(name) or {}).get(field)
        return lambda scope: scope.get(name)
    if kind == "filter":
        change, inner = FILTERS[node[1]], _value(node[2])
        return lambda scope: change(_text(inner(scope)))
    if kind == "not":
        inner = _value(node[1])
        return lambda scope: not inner(scope)
    a, b = _value(node[1]), _value(node[2])
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    apply = _OPERATORS[kind]
    return lambda scope: apply(a(scope), b(scope))


def _closure(body: list, masked: bool) -> Callable[[dict], Pieces]:
    steps = [_step(node, masked) for node in body]

    def run(scope: dict) -> Pieces:
        for step in steps:
            yield from step(scope)

    return run


def _step(node, masked: bool) -> Callable[[dict], Pieces]:
    kind = node[0]
    if kind == "text":
        value = _value(node[1])

        def write(scope: dict) -> Pieces:
            yield _text(value(scope)), masked

        return write
    if kind == "generation":
        return _closure(node[1], True)
    if kind == "for":
        name, source, inner = node[1], node[2], _closure(node[3], masked)

        def repeat(scope: dict) -> Pieces:
            for n, item in enumerate(scope.get(source) or (), 1):
                yield from inner(scope | {name: item, "loop": {"index": n, "first": n == 1}})

        return repeat
    arms = [(_value(test), _closure(inner, masked)) for test, inner in node[1]]
    rest = _closure(node[2], masked)

    def choose(scope: dict) -> Pieces:
        for test, inner in arms:
            if test(scope):
                return inner(scope)
        return rest(scope)

    return choose


def compile_template(source: str) -> Callable[[Iterable[dict]], Pieces]:
    """A function from turns (mappings with ``role`` and ``text``) to pieces: text, and whether it is under the loss mask."""
    run = _closure(fold(parse(source)), False)
    return lambda turns: run({"turns": turns})


# -- reading back ---------------------------------------------------------------------------

_SPLIT = re.compile("(" + "|".join(re.escape(c) for c in CONTROL) + ")")


def read_back(pieces: Pieces) -> Iterator[tuple[str, str, str, int]]:
    """Turns out of formatted pieces: role, text, the text under the mask, and characters formatted."""
    role = text = masked = ""
    state, n, held = "", 0, ""
    # A control string never spans pieces that the template's constants and escaped texts make;
    # what is not yet closed by one is carried along.
    for piece, mask in pieces:
        n += len(piece)
        for part in _SPLIT.split(piece):
            if part == "<s>":
                role = text = masked = held = state = ""
            elif part == "[ROLE]":
                held = ""
            elif part in ("[TEXT]", "[INST]"):
                role, held = unescape(held), ""
            elif part == "[/INST]":
                state = "closed"
            elif part == "</s>":
                text = unescape(held)
                yield role, text, unescape(masked), n
                n = 0
            elif part and state != "closed":
                held += part
                masked += part if mask else ""


SCHEMA = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(formatted: Pieces) -> tuple[int, str, int, str, int]:
    turns, loss, n, chars, total = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
    for role, text, masked, size in read_back(formatted):
        turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        loss.update(masked.encode("utf-8", "surrogatepass"))
        n, chars, total = n + 1, chars + len(masked), total + size
    return n, turns.hexdigest(), chars, loss.hexdigest(), total


def _ordered(turns: DataFrame) -> DataFrame:
    """Rows of a conversation one after another, by turn; equal turns by role and text."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches) -> Iterator[tuple[object, Iterator[dict]]]:
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)

    for conv_id, group in groupby(rows(), key=lambda r: r[0]):
        yield conv_id, ({"role": r[1], "text": r[2]} for r in group)


def conversation_digests(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Format each conversation, read the formatted pieces back, and digest what was read.

    One row per ``conv_id``; rows with a null id form one conversation. Null role or text counts
    as empty; a null turn comes first; equal turns go by role and text; repeated rows are turns
    of their own. A conversation streams through its task turn by turn, so a very long one takes
    time but no memory (its digest is one chain by definition).
    """
    compile_template(template)  # a wrong template fails here, not in a task
    kind = turns.schema["conv_id"].dataType

    def run(batches):
        render, held = compile_template(template), []
        for conv_id, group in _conversations(batches):
            held.append((conv_id, *_digest(render(group))))
            if len(held) == 2000:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    def _batch(rows):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return _ordered(turns).mapInArrow(run, f"conv_id {kind.simpleString()}, {SCHEMA}")


def formatted_turns(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The formatted text itself, one row per piece: conv_id, piece (from 0), formatted, in_loss."""
    compile_template(template)
    kind = turns.schema["conv_id"].dataType

    def run(batches):
        render = compile_template(template)
        for conv_id, group in _conversations(batches):
            held = []
            for k, (text, masked) in enumerate(render(group)):
                held.append((conv_id, k, text, masked))
                if len(held) == 500:
                    yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "piece", "formatted", "in_loss"), r, strict=True)) for r in held], schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "piece", "formatted", "in_loss"), r, strict=True)) for r in held], schema)

    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("piece", pa.int64()), ("formatted", pa.string()), ("in_loss", pa.bool_())])
    return _ordered(turns).mapInArrow(run, f"conv_id {kind.simpleString()}, piece long, formatted string, in_loss boolean")
