"""The filter language: JSON arrays -> a tree -> a Boolean column that is never null.

Leaves are false where the field is missing; Not is two-valued, so Not of such
a leaf is true. Equality is strict about JSON types (1, 1.0 and "1" differ),
order compares numbers as doubles.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument
from ..functions.text import ascii_tokens, ascii_tokens_of

NAMES = {
    "eq": "eq", "=": "eq", "==": "eq",
    "ne": "ne", "!=": "ne",
    "lt": "lt", "<": "lt", "lte": "lte", "<=": "lte", "gt": "gt", ">": "gt", "gte": "gte", ">=": "gte",
    "in": "in", "notin": "not_in", "not_in": "not_in",
    "containsany": "in", "contains_any": "in",
    "containsalltokens": "tokens", "contains_all_tokens": "tokens",
    "glob": "glob", "regex": "regex",
}
GROUPS = ("and", "or", "not")
MAX_PATTERN = 512


@dataclass(frozen=True)
class Leaf:
    op: str
    field: str
    value: Any


@dataclass(frozen=True)
class Group:
    op: str
    children: tuple


def _scalar(x: Any) -> bool:
    return x is None or isinstance(x, bool | int | float | str)


def _strict(x: Any) -> tuple:
    """Python holds 1 == 1.0 == True; JSON doesn't."""
    return (type(x).__name__, x)


def _leaf(op: str, field: str, value: Any) -> Leaf:
    if not field.strip():
        raise InvalidArgument("a filter needs a field name")
    if op in ("eq", "ne", "lt", "lte", "gt", "gte"):
        if not _scalar(value):
            raise InvalidArgument(f"{op} takes a single value")
        return Leaf(op, field, value)
    if op in ("in", "not_in"):
        if not isinstance(value, list) or not value or not all(map(_scalar, value)):
            raise InvalidArgument(f"{op} takes a list of single values")
        return Leaf(op, field, tuple(x[1] for x in dict.fromkeys(map(_strict, value))))
    if op == "tokens":
        texts = [value] if isinstance(value, str) else value
        if not isinstance(texts, list) or not all(isinstance(x, str) for x in texts):
            raise InvalidArgument("contains_all_tokens takes a text or a list of texts")
        found = list(dict.fromkeys(t for x in texts for t in ascii_tokens_of(x)))
        if not found:
            raise InvalidArgument("contains_all_tokens needs a token")
        return Leaf(op, field, tuple(found))
    if not isinstance(value, str) or not value:
        raise InvalidArgument(f"{op} takes a pattern")
    if len(value.encode()) > MAX_PATTERN:
        raise InvalidArgument(f"{op} takes at most {MAX_PATTERN} bytes")
    return Leaf(op, field, (from_glob if op == "glob" else from_regex)(value))


def from_glob(pattern: str) -> str:
    return r"(?ds)\A" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) if not c.isalnum() and c.isascii() else c for c in pattern) + r"\z"


def from_regex(pattern: str) -> str:
    """The pattern for Java: $ means the end of the text only, and . all but the line feed."""
    out, i, inside = "", 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            after = pattern[i + 1 : i + 2]
            if after.isdigit() or after == "k":
                raise InvalidArgument("back-references aren't supported")
            out += pattern[i : i + 2]
            i += 2
            continue
        if not inside and re.match(r"\(\?(?:[=!>]|<[=!])", pattern[i:]):
            raise InvalidArgument("look-around isn't supported")
        inside = (inside or c == "[") and not (inside and c == "]")
        out += r"\z" if c == "$" and not inside else c
        i += 1
    try:
        re.compile(pattern)
    except re.error as e:
        raise InvalidArgument(f"not a regular expression: {e}") from e
    return "(?d)" + out


def parse(tree: Any) -> Leaf | Group:
    if not isinstance(tree, list) or not tree:
        raise InvalidArgument("a filter is a non-empty array")
    head = tree[0].strip().lower() if isinstance(tree[0], str) else None
    if head in GROUPS:
        rest = tree[1:]
        if len(rest) == 1 and isinstance(rest[0], list) and rest[0] and all(isinstance(x, list) for x in rest[0]):
            rest = rest[0]
        if not rest or head == "not" and len(rest) != 1:
            raise InvalidArgument(f"{head} needs {'one operand' if head == 'not' else 'operands'}")
        children = [parse(x) for x in rest]
        if head == "not":
            return Group("not", tuple(children))
        flat: list = []
        for c in children:
            flat += c.children if isinstance(c, Group) and c.op == head else [c]
        return flat[0] if len(flat) == 1 else Group(head, tuple(flat))
    if len(tree) != 3 or not isinstance(tree[0], str):
        raise InvalidArgument("a comparison is [field, operator, value]")
    a, b, value = tree
    if isinstance(b, str) and b.strip().lower() in NAMES:
        return _leaf(NAMES[b.strip().lower()], a, value)
    if head in NAMES and isinstance(b, str):
        return _leaf(NAMES[head], b, value)
    raise InvalidArgument(f"unknown operator in {tree[:2]}")


class Backend(Protocol):
    """How fields are read."""

    def present(self, field: str) -> Column: ...
    def equals(self, field: str, value: Any) -> Column: ...
    def compares(self, field: str, op: str, value: Any) -> Column: ...
    def any_of(self, field: str, values: tuple) -> Column: ...
    def text(self, field: str) -> Column: ...
    def tokens(self, field: str) -> Column: ...


_ORDER = {"lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b}


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


class Typed:
    """Fields are columns; null is a missing field. The types are known, so each leaf is one comparison that Parquet can push down."""

    def __init__(self, schema: T.StructType, prefix: str = ""):
        self.types = {f.name: f.dataType for f in schema}
        self.prefix = prefix

    def _col(self, field: str) -> Column:
        return F.col(f"{self.prefix}`{field.replace('`', '``')}`")

    def present(self, field: str) -> Column:
        return self._col(field).isNotNull() if field in self.types else F.lit(False)

    @staticmethod
    def _same(kind: T.DataType, value: Any) -> bool:
        if isinstance(value, bool):
            return isinstance(kind, T.BooleanType)
        if isinstance(value, int):
            return isinstance(kind, T.IntegralType)
        if isinstance(value, float):
            return isinstance(kind, T.FractionalType)
        return isinstance(value, str) and isinstance(kind, T.StringType)

    def equals(self, field: str, value: Any) -> Column:
        kind = self.types.get(field)
        return _false(self._col(field) == F.lit(value)) if kind is not None and self._same(kind, value) else F.lit(False)

    def compares(self, field: str, op: str, value: Any) -> Column:
        kind = self.types.get(field)
        number = isinstance(value, int | float) and not isinstance(value, bool)
        if kind is None or value is None or not (number and isinstance(kind, T.NumericType) or self._same(kind, value)):
            return F.lit(False)
        return _false(_ORDER[op](self._col(field), F.lit(value)))

    def any_of(self, field: str, values: tuple) -> Column:
        kind = self.types.get(field)
        if isinstance(kind, T.ArrayType):
            own = [v for v in values if self._same(kind.elementType, v)]
            return _false(F.exists(self._col(field), lambda x: _false(x.isin(*own)))) if own else F.lit(False)
        own = [v for v in values if kind is not None and self._same(kind, v)]
        return _false(self._col(field).isin(*own)) if own else F.lit(False)

    def text(self, field: str) -> Column:
        return self._col(field) if isinstance(self.types.get(field), T.StringType) else F.lit(None).cast("string")

    def tokens(self, field: str) -> Column:
        kind = self.types.get(field)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            return F.flatten(F.transform(F.array_compact(self._col(field)), ascii_tokens))
        return ascii_tokens(self.text(field))


class Variant:
    """Fields are the top-level keys of a VARIANT column."""

    def __init__(self, column: Column):
        self.v = column

    @staticmethod
    def _path(field: str) -> str:
        return f"$['{field}']" if '"' in field else f'$["{field}"]'

    def _get(self, field: str, kind: str) -> Column:
        return F.try_variant_get(self.v, self._path(field), kind)

    def _item(self, field: str) -> Column:
        return self._get(field, "variant")

    def present(self, field: str) -> Column:
        return self._item(field).isNotNull()

    @staticmethod
    def _is(item: Column, value: Any) -> Column:
        kind = F.schema_of_variant(item)
        get = lambda t: F.try_variant_get(item, "$", t)
        if value is None:
            return _false(F.is_variant_null(item))
        if isinstance(value, bool):
            return _false((kind == "BOOLEAN") & (get("boolean") == F.lit(value)))
        if isinstance(value, int):
            return _false((kind == "BIGINT") & (get("bigint") == F.lit(value)))
        if isinstance(value, float):
            return _false((kind.startswith("DECIMAL") | (kind == "DOUBLE")) & (get("double") == F.lit(value)))
        return _false((kind == "STRING") & (get("string") == F.lit(value)))

    def equals(self, field: str, value: Any) -> Column:
        return self._is(self._item(field), value)

    def compares(self, field: str, op: str, value: Any) -> Column:
        item = self._item(field)
        kind = F.schema_of_variant(item)
        if value is None:
            return _false(F.is_variant_null(item)) if op in ("lte", "gte") else F.lit(False)
        if isinstance(value, bool):
            ok, t = kind == "BOOLEAN", "boolean"
        elif isinstance(value, str):
            ok, t = kind == "STRING", "string"
        else:
            ok, t, value = (kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE"), "double", float(value)
        return _false(ok & _ORDER[op](self._get(field, t), F.lit(value)))

    def any_of(self, field: str, values: tuple) -> Column:
        def one(item: Column) -> Column:
            out = F.lit(False)
            for v in values:
                out = out | self._is(item, v)
            return out

        item = self._item(field)
        many = F.when(F.startswith(F.schema_of_variant(item), F.lit("ARRAY")), self._get(field, "array<variant>"))
        return one(item) | _false(F.exists(many, one))

    def text(self, field: str) -> Column:
        return F.when(F.schema_of_variant(self._item(field)) == "STRING", self._get(field, "string"))

    def tokens(self, field: str) -> Column:
        item = self._item(field)
        many = F.when(F.startswith(F.schema_of_variant(item), F.lit("ARRAY")), self._get(field, "array<variant>"))
        texts = F.array_compact(F.transform(many, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))))
        return F.coalesce(F.flatten(F.transform(texts, ascii_tokens)), ascii_tokens(self.text(field)))


def column(expr: Leaf | Group, backend: Backend) -> Column:
    """The tree as a column; Catalyst simplifies and pushes it."""
    if isinstance(expr, Group):
        parts = [column(c, backend) for c in expr.children]
        if expr.op == "not":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if expr.op == "and" else out | p
        return out
    f, v = expr.field, expr.value
    if expr.op == "eq":
        return backend.equals(f, v)
    if expr.op == "ne":
        return backend.present(f) & ~backend.equals(f, v)
    if expr.op in _ORDER:
        return backend.compares(f, expr.op, v)
    if expr.op == "in":
        return backend.any_of(f, v)
    if expr.op == "not_in":
        return backend.present(f) & ~backend.any_of(f, v)
    if expr.op == "tokens":
        wanted = F.array(*[F.lit(t) for t in v])
        return _false(F.size(F.array_except(wanted, backend.tokens(f))) == 0)
    return _false(backend.text(f).rlike(v))


def compile_filter(tree: Any, backend: Backend) -> Column:
    """JSON -> column; no filter holds for all rows."""
    return F.lit(True) if tree is None else column(parse(tree), backend)
