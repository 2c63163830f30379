"""A compiler from a sandboxed template language to Python closures, and chat formatting.

The language has text, ``{{ expression }}``, ``{% for turn in turns %} .. {% endfor %}``,
``{% if .. %} .. {% elif .. %} .. {% else %} .. {% endif %}``, ``{% generation %} ..
{% endgeneration %}`` around what a model would have written, and ``{# comments #}``.
Expressions know names, string and whole-number literals, ``turn.role``, ``+``, ``==``, ``!=``,
``not``, ``and``, ``or``, parentheses and filters ``| escape``, ``| upper``, ``| trim``. There are
no calls, no other attributes and no access to Python, and loops run over the turns only, so a
template ends and reads nothing but what it is given.

Compiling has three steps: source to syntax tree, folding of constant parts, tree to closures.

Control strings inside a text are escaped by doubling a backslash and putting one after the
first character of every control string, so a formatted conversation has no control string
but the template's own and can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ESCAPE = "\\"
# What marks turns in the default template; none may appear inside a text.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<|", "|>")
TEMPLATE = (
    "<s>{% for turn in turns %}<|turn {{ turn.role | escape }}|>"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}[INST]{{ turn.text | escape }}[/INST]{% endif %}{% endfor %}</s>"
)


class TemplateError(ValueError):
    """A template that the language does not allow."""


# --- syntax tree -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Name:
    name: str
    field: str | None = None


@dataclass(frozen=True)
class Apply:
    """A unary operator or filter."""

    what: str
    value: object


@dataclass(frozen=True)
class Binary:
    what: str
    left: object
    right: object


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class Branch:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Loop:
    name: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


FIELDS = ("role", "text")
_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKENS = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|(\w+)|(==|!=|[+|().]))""")
_WORDS = ("and", "or", "not")


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            match = _TOKENS.match(source, at)
            if not match:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append(match.groups())
            at = match.end()
        self.at = 0

    def parsed(self):
        tree = self._chain("or", lambda: self._chain("and", self._not))
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at]}")
        return tree

    def _peek(self):
        if self.at >= len(self.tokens):
            return None
        _, _, word, sign = self.tokens[self.at]
        return sign or (word if word in _WORDS else None)

    def _take(self, *signs: str) -> str | None:
        if (sign := self._peek()) in signs:
            self.at += 1
            return sign
        return None

    def _chain(self, sign: str, part: Callable):
        tree = part()
        while self._take(sign):
            tree = Binary(sign, tree, part())
        return tree

    def _not(self):
        return Apply("not", self._not()) if self._take("not") else self._compared()

    def _compared(self):
        tree = self._chain("+", self._filtered)
        while sign := self._take("==", "!="):
            tree = Binary(sign, tree, self._chain("+", self._filtered))
        return tree

    def _filtered(self):
        tree = self._atom()
        while self._take("|"):
            name = self._word()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = Apply(name, tree)
        return tree

    def _word(self) -> str:
        if self.at >= len(self.tokens) or not (word := self.tokens[self.at][2]):
            raise TemplateError("a name is missing")
        self.at += 1
        return word

    def _atom(self):
        if self._take("("):
            tree = self._chain("or", lambda: self._chain("and", self._not))
            if not self._take(")"):
                raise TemplateError("a parenthesis is not closed")
            return tree
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        string, number, _, _ = self.tokens[self.at]
        if string:
            self.at += 1
            return Literal(re.sub(r"\\(.)", _unescaped_letter, string[1:-1], flags=re.S))
        if number:
            self.at += 1
            return Literal(int(number))
        name = self._word()
        if self._take("."):
            field = self._word()
            if field not in FIELDS:
                raise TemplateError(f"no field {field!r}")
            return Name(name, field)
        return Name(name)


def _unescaped_letter(match: re.Match) -> str:
    return {"n": "\n", "t": "\t"}.get(match[1], match[1])


def parse(source: str) -> tuple:
    """The syntax tree of a template; raises `TemplateError` for anything not allowed."""
    stack: list[tuple[str, list, list]] = [("", [], [])]

    def close(*kinds: str):
        kind, head, body = stack.pop()
        if kind not in kinds:
            raise TemplateError(f"{kinds[0]} is not open")
        return kind, head, tuple(body)

    at = 0
    for part in [*_PARTS.finditer(source), None]:
        text = source[at : part.start()] if part else source[at:]
        if text:
            stack[-1][2].append(Output(Literal(text)))
        if part is None:
            break
        at = part.end()
        if part[1] is not None:
            stack[-1][2].append(Output(_Expression(part[1]).parsed()))
        if part[2] is None:
            continue
        word, _, rest = part[2].strip().partition(" ")
        if word == "for":
            match = re.fullmatch(r"(\w+)\s+in\s+turns", rest.strip())
            if not match:
                raise TemplateError("loops run over turns only")
            stack.append(("for", [match[1]], []))
        elif word == "if":
            stack.append(("if", [_Expression(rest).parsed()], []))
        elif word == "elif":
            # The rest of the chain is the other branch of what came before.
            _, head, body = close("if")
            stack.append(("chain", [head[0], body], []))
            stack.append(("if", [_Expression(rest).parsed()], []))
        elif word == "else":
            _, head, body = close("if")
            stack.append(("else", [head[0], body], []))
        elif word == "endif":
            kind, head, body = close("if", "else")
            node = Branch(head[0], body, ()) if kind == "if" else Branch(head[0], head[1], body)
            while stack[-1][0] == "chain":
                _, (test, then), _ = stack.pop()
                node = Branch(test, then, (node,))
            stack[-1][2].append(node)
        elif word == "endfor":
            _, head, body = close("for")
            stack[-1][2].append(Loop(head[0], body))
        elif word == "generation":
            stack.append(("generation", [], []))
        elif word == "endgeneration":
            body = close("generation")[2]
            stack[-1][2].append(Generation(body))
        else:
            raise TemplateError(f"no statement {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return tuple(stack[0][2])


# --- folding ---------------------------------------------------------------------------------


def _control_pattern(controls: tuple[str, ...]) -> re.Pattern:
    """The escape itself, every character at which a control string begins, also within another,
    and one that could begin a control string with what follows the text."""
    begins = "|".join(map(re.escape, controls))
    partly = {control[:n] for control in controls for n in range(1, len(control))}
    partly = "|".join(re.escape(part) + r"\Z" for part in sorted(partly))
    return re.compile(rf"{re.escape(ESCAPE)}|(?=(?:{begins}|{partly}))(?s:.)")


_CONTROL = _control_pattern(CONTROLS)


def escaped(text: str) -> str:
    """The text with no control string in it, nor the beginning of one at its end; `unescaped`
    gives it back."""
    return _CONTROL.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0] + ESCAPE, text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


FILTERS = {"escape": escaped, "upper": str.upper, "trim": str.strip}


def _text(value) -> str:
    return "" if value is None else str(value)


OPERATORS: dict[str, Callable] = {
    "+": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
}


def _applied(what: str, value):
    return (not value) if what == "not" else FILTERS[what](_text(value))


def folded(node):
    """The tree with constant parts worked out: expressions, branches and neighbouring text."""
    if isinstance(node, tuple):
        out: list = []
        for child in node:
            child = folded(child)
            for piece in child if isinstance(child, tuple) else (child,):
                constant = isinstance(piece, Output) and isinstance(piece.value, Literal)
                if constant and out and isinstance(out[-1], Output) and isinstance(out[-1].value, Literal):
                    joined = _text(out[-1].value.value) + _text(piece.value.value)
                    out[-1] = Output(Literal(joined))
                elif not constant or _text(piece.value.value):
                    out.append(piece)
        return tuple(out)
    if isinstance(node, Output):
        return Output(folded(node.value))
    if isinstance(node, Apply):
        value = folded(node.value)
        if isinstance(value, Literal):
            return Literal(_applied(node.what, value.value))
        return Apply(node.what, value)
    if isinstance(node, Binary):
        left, right = folded(node.left), folded(node.right)
        if isinstance(left, Literal) and isinstance(right, Literal):
            return Literal(OPERATORS[node.what](left.value, right.value))
        return Binary(node.what, left, right)
    if isinstance(node, Branch):
        test, then, other = folded(node.test), folded(node.then), folded(node.other)
        if isinstance(test, Literal):
            return then if test.value else other
        return Branch(test, then, other)
    if isinstance(node, Loop):
        return Loop(node.name, folded(node.body))
    if isinstance(node, Generation):
        return Generation(folded(node.body))
    return node


# --- code ------------------------------------------------------------------------------------


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Literal):
        constant = node.value
        return lambda scope: constant
    if isinstance(node, Name):
        name, field = node.name, node.field
        if field is None:
            return lambda scope: scope.get(name)
        return lambda scope: scope[name][field]
    if isinstance(node, Apply):
        value, what = _value(node.value), node.what
        return lambda scope: _applied(what, value(scope))
    left, right, what = _value(node.left), _value(node.right), node.what
    if what == "and":
        return lambda scope: left(scope) and right(scope)
    if what == "or":
        return lambda scope: left(scope) or right(scope)
    operator = OPERATORS[what]
    return lambda scope: operator(left(scope), right(scope))


def _writer(node) -> Callable[[dict, list, list], None]:
    """A closure that appends to the output; marks go in as positions in the list of pieces."""
    if isinstance(node, tuple):
        steps = [_writer(n) for n in node]

        def block(scope, out, marks):
            for step in steps:
                step(scope, out, marks)

        return block
    if isinstance(node, Output):
        value = _value(node.value)
        return lambda scope, out, marks: out.append(_text(value(scope)))
    if isinstance(node, Branch):
        test, then, other = _value(node.test), _writer(node.then), _writer(node.other)
        return lambda scope, out, marks: (then if test(scope) else other)(scope, out, marks)
    if isinstance(node, Loop):
        name, body = node.name, _writer(node.body)

        def loop(scope, out, marks):
            for turn in scope["turns"]:
                body({**scope, name: turn}, out, marks)

        return loop
    inner = _writer(node.body)

    def generation(scope, out, marks):
        first = len(out)
        inner(scope, out, marks)
        marks.append((first, len(out)))

    return generation


def compiled(source: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from turns to the formatted text and the spans of generated text in it."""
    write = _writer(folded(parse(source)))

    def render(turns: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out: list[str] = []
        marks: list[tuple[int, int]] = []
        write({"turns": turns}, out, marks)
        ends = [0]
        for piece in out:
            ends.append(ends[-1] + len(piece))
        return "".join(out), [(ends[a], ends[b]) for a, b in marks]

    return render


@lru_cache(16)
def _cached(source: str):
    return compiled(source)


# --- reading back ----------------------------------------------------------------------------

_TURN = re.compile(r"<\|turn (.*?)\|>(?:\[INST\](.*?)\[/INST\]|(.*?)(?=<\||</s>))", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a conversation in the default template's form."""
    return [
        (unescaped(m[1]), unescaped(m[2] if m[2] is not None else m[3]))
        for m in _TURN.finditer(formatted)
    ]


# --- Spark -----------------------------------------------------------------------------------


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``conv_id, formatted, spans`` of every conversation; spans are pairs of code points.

    Turns are ordered by ``turn``, then role and text, nulls first; a null text or role is
    empty; rows that repeat are turns of their own. A conversation is one row of output, so
    its turns meet in one task; conversations are spread by their id.
    """
    compiled(template)  # fails here rather than in a task
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    whole = conversations.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(turn)).alias("turns")
    )
    schema = whole.select("conv_id").schema.add("formatted", "string")
    span = T.StructType().add("first", "integer").add("last", "integer")
    schema = schema.add("spans", T.ArrayType(span))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = _cached(template)
        spans_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for rows in batches:
            done = [render(turns) for turns in rows.column("turns").to_pylist()]
            spans = [[{"first": a, "last": b} for a, b in spans] for _, spans in done]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("conv_id"),
                    pa.array([text for text, _ in done], pa.string()),
                    pa.array(spans, spans_type),
                ],
                names=schema.names,
            )

    return whole.mapInArrow(work, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What the contract asks for, read back from the formatted text alone."""
    schema = formatted.select("conv_id").schema
    for name, kind in (
        ("n_turns", "long"),
        ("turns_sha256", "string"),
        ("loss_chars", "long"),
        ("loss_sha256", "string"),
        ("formatted_chars", "long"),
    ):
        schema = schema.add(name, kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            columns: list[list] = [[], [], [], [], []]
            texts = rows.column("formatted").to_pylist()
            for text, spans in zip(texts, rows.column("spans").to_pylist(), strict=True):
                turns = read_back(text)
                loss = "".join(unescaped(text[s["first"] : s["last"]]) for s in spans)
                said = "".join(f"{role}\n{content}\n" for role, content in turns)
                values = (
                    len(turns),
                    hashlib.sha256(said.encode()).hexdigest(),
                    len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(),
                    len(text),
                )
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("conv_id"), *arrays], names=schema.names)

    return formatted.mapInArrow(work, schema)
