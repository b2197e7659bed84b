"""Feature expressions compiled to Spark Columns.

Properties are looked up by name; a property that is missing is null. A feature passes only if the
expression is exactly true: null, errors and values that are not boolean drop it. Supported: literals,
``== != < <= > >= && || ! in``, lists, ``.matches(regex)`` (a search), ``.startsWith(t)``, ``.endsWith(t)``, ``.contains(t)`` on texts,
``size(x)`` or ``x.size()`` of a text (in characters) or a list, ``has(props.name)`` and ``props["name"]``.
Text functions of what is no text are errors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+u?)|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|&&|\|\||[<>!()\[\],.-]))""")


_WHOLE = "decimal(20,0)"


class ExpressionError(ValueError):
    """The expression cannot be compiled."""


@dataclass
class _Value:
    """A typed operand: kind is text, number, bool, null, list or any (a property, whose kind the row decides)."""

    kind: str
    text: Column | None = None
    number: Column | None = None
    #: The number where it is an integer of up to 64 bits, exactly.
    whole: Column | None = None
    truth: Column | None = None
    items: list | None = None


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise ExpressionError(f"unexpected {source[at:at + 10]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class _Compiler:
    def __init__(self, source: str, lookup) -> None:
        self.tokens, self.at, self.lookup = _tokens(source), 0, lookup

    def peek(self, *ops: str) -> bool:
        return self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in ops

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def need(self, op: str) -> None:
        kind, text = self.take()
        if kind != "op" or text != op:
            raise ExpressionError(f"expected {op!r}, found {text!r}")

    def whole(self) -> _Value:
        value = self.either()
        if self.tokens[self.at][0] != "end":
            raise ExpressionError(f"unexpected {self.tokens[self.at][1]!r}")
        return value

    def either(self) -> _Value:
        value = self.both()
        while self.peek("||"):
            self.take()
            value = _Value("bool", truth=_truth(value) | _truth(self.both()))
        return value

    def both(self) -> _Value:
        value = self.relation()
        while self.peek("&&"):
            self.take()
            value = _Value("bool", truth=_truth(value) & _truth(self.relation()))
        return value

    def relation(self) -> _Value:
        left = self.unary()
        if self.peek("==", "!=", "<", "<=", ">", ">="):
            op = self.take()[1]
            return _Value("bool", truth=_compare(op, left, self.unary()))
        if self.tokens[self.at] == ("name", "in"):
            self.take()
            right = self.unary()
            if right.kind != "list":
                raise ExpressionError("'in' needs a list")
            found = F.lit(False)
            for item in right.items:
                found = found | F.coalesce(_compare("==", left, item), F.lit(False))
            return _Value("bool", truth=found)
        return left

    def unary(self) -> _Value:
        if self.peek("!"):
            self.take()
            return _Value("bool", truth=~_truth(self.unary()))
        if self.peek("-"):
            self.take()
            value = self.unary()
            if value.kind != "number":
                raise ExpressionError("'-' needs a number")
            return _Value("number", number=-value.number, whole=None if value.whole is None else -value.whole)
        return self.postfix()

    def postfix(self) -> _Value:
        value = self.primary()
        while self.peek("."):
            self.take()
            kind, name = self.take()
            if name == "size":
                self.need("(")
                self.need(")")
                value = _size(value)
                continue
            if name in _TEXT_TESTS:
                self.need("(")
                part = self.either()
                self.need(")")
                if part.text is None or value.text is None:
                    raise ExpressionError(f"{name}() needs texts")
                value = _Value("bool", truth=F.when(_is_text(value) & _is_text(part), _TEXT_TESTS[name](value.text, part.text)))
                continue
            if name != "matches":
                raise ExpressionError(f"unknown member {name!r}")
            self.need("(")
            kind, text = self.take()
            if kind != "text":
                raise ExpressionError("matches() needs a literal pattern")
            pattern = _unquote(text)
            if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", pattern):
                raise ExpressionError("look-around and back references are not supported")
            re.compile(pattern)
            self.need(")")
            value = _Value("bool", truth=F.when(_is_text(value), value.text.rlike(pattern)))
        return value

    def primary(self) -> _Value:
        kind, text = self.take()
        if kind == "number":
            plain = text.rstrip("u")
            return _Value("number", number=F.lit(float(plain)), whole=F.lit(plain).cast(_WHOLE) if plain.isdigit() else None)
        if kind == "text":
            return _Value("text", text=F.lit(_unquote(text)))
        if kind == "op" and text == "(":
            value = self.either()
            self.need(")")
            return value
        if kind == "op" and text == "[":
            items = []
            while not self.peek("]"):
                items.append(self.either())
                if not self.peek("]"):
                    self.need(",")
            self.take()
            return _Value("list", items=items)
        if kind == "name":
            if text in ("true", "false"):
                return _Value("bool", truth=F.lit(text == "true"))
            if text == "null":
                return _Value("null")
            if text == "size" and self.peek("("):
                self.take()
                value = self.either()
                self.need(")")
                return _size(value)
            if text == "has":
                self.need("(")
                value = self.primary()
                self.need(")")
                return _Value("bool", truth=value.text.isNotNull())
            if text == "props":
                return self.property_of_props()
            return self.property(text)
        raise ExpressionError(f"unexpected {text or 'end'!r}")

    def property_of_props(self) -> _Value:
        if self.peek("["):
            self.take()
            kind, text = self.take()
            if kind != "text":
                raise ExpressionError("props[] needs a literal name")
            self.need("]")
            return self.property(_unquote(text))
        self.need(".")
        return self.property(self.take()[1])

    def property(self, name: str) -> _Value:
        # A property whose value is null is as one that is missing.
        literal = F.nullif(self.lookup(name), F.lit("null"))
        quoted = literal.startswith('"')
        return _Value(
            "any",
            text=F.when(quoted, F.from_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>")[0]).otherwise(literal),
            number=F.when(~quoted, literal.try_cast("double")),
            whole=F.when(literal.rlike(r"^-?\d{1,20}$"), literal.try_cast(_WHOLE)),
            truth=F.when(literal.isin("true", "false"), literal == "true"),
        )


def _unquote(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]) if m[1] in "nt\\\"'" else m[0], text[1:-1])


def _truth(value: _Value) -> Column:
    return F.lit(None).cast("boolean") if value.truth is None else value.truth


def _is_text(value: _Value) -> Column:
    if value.kind == "text":
        return F.lit(True)
    return F.lit(False) if value.kind != "any" else value.text.isNotNull() & value.number.isNull() & value.truth.isNull()


#: Tests of a text by another one.
_TEXT_TESTS = {"startsWith": F.startswith, "endsWith": F.endswith, "contains": F.contains}


def _size(value: _Value) -> _Value:
    """Characters of a text, or items of a list; null for other values of a property."""
    if value.kind == "list":
        n = F.lit(len(value.items))
    elif value.kind in ("text", "any"):
        n = F.when(_is_text(value), F.length(value.text))
    else:
        raise ExpressionError("size() needs a text or a list")
    return _Value("number", number=n.cast("double"), whole=n.cast(_WHOLE))


def _compare(op: str, a: _Value, b: _Value) -> Column:
    if "null" in (a.kind, b.kind):
        other = b if a.kind == "null" else a
        if op not in ("==", "!="):
            return F.lit(None).cast("boolean")
        empty = F.lit(True) if other.kind == "null" else other.text.isNull() if other.kind == "any" else F.lit(False)
        return empty if op == "==" else ~empty
    tests = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    test = tests[op]
    branches = []
    for side in ("whole", "number", "truth", "text"):
        x, y = getattr(a, side), getattr(b, side)
        if x is not None and y is not None:
            valid = x.isNotNull() & y.isNotNull()
            if side == "text":
                valid = valid & _is_text(a) & _is_text(b)
            branches.append(F.when(valid, test(x, y)))
    # Values of different kinds are unequal; they have no order.
    fallback = F.lit(op == "!=") if op in ("==", "!=") else F.lit(None).cast("boolean")
    return F.coalesce(*branches, fallback) if branches else fallback


def compile_expression(source: str, props: str | Column = "props") -> Column:
    """A boolean Column that is true where the expression is exactly true. props: map of JSON literals."""
    column = F.col(props) if isinstance(props, str) else props
    value = _Compiler(source, lambda name: F.try_element_at(column, F.lit(name))).whole()
    return F.coalesce(_truth(value), F.lit(False))
