"""Prompt templates as Columns.

A template has fields ``{{ name }}`` (with dots into structs and ``| default("...")``, ``| upper``,
``| lower``, ``| trim``, ``| length``, ``| join(", ")``), conditions ``{% if name %}`` (or ``not
name``, or a comparison with a text) with ``else``, loops ``{% for x in name %}`` over arrays with
``loop.index``, and the three prompt helpers. It becomes one Column expression, so rendering runs
in the JVM beside whatever else the plan does; no row reaches Python.

Values come from the row's columns, over prompt variables, over configuration values. A name that
none of them has raises when the template is compiled (strict), or is empty (lenient). Null is
empty; a field is false if it is null, empty, zero or false.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
NAME = r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*"


class TemplateError(ValueError):
    pass


@dataclass
class Node:
    """text, field (expression), if (condition; body, other) or for (variable, name; body)."""

    kind: str
    what: Any
    body: list[Node] = field(default_factory=list)
    other: list[Node] = field(default_factory=list)


def tree_of(template: str) -> list[Node]:
    """The nodes of a template; tags that don't match raise."""
    root = Node("root", None)
    stack: list[tuple[Node, list[Node]]] = [(root, root.body)]
    at = 0
    for m in TAG.finditer(template):
        if m.start() > at:
            stack[-1][1].append(Node("text", template[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(Node("field", m[1].strip()))
        elif m[2] is not None:
            word, _, rest = m[2].strip().partition(" ")
            top = stack[-1][0]
            if word == "if":
                node = Node("if", rest.strip())
            elif word == "for" and (f := re.fullmatch(rf"([A-Za-z_]\w*)\s+in\s+({NAME})", rest.strip())):
                node = Node("for", (f[1], f[2]))
            elif word == "else" and top.kind == "if" and stack[-1][1] is top.body:
                stack[-1] = (top, top.other)
                continue
            elif word in ("endif", "endfor") and top.kind == word[3:]:
                stack.pop()
                continue
            else:
                raise TemplateError(f"unexpected tag: {m[0]}")
            stack[-1][1].append(node)
            stack.append((node, node.body))
    if len(stack) > 1:
        raise TemplateError(f"a tag is not closed: {stack[-1][0].kind} {stack[-1][0].what}")
    if at < len(template):
        root.body.append(Node("text", template[at:]))
    return root.body


@dataclass
class Value:
    """A Column with its type, which says how it reads and whether it is true."""

    column: Column
    type: T.DataType

    def text(self) -> Column:
        if isinstance(self.type, (T.ArrayType, T.StructType, T.MapType)):
            return F.coalesce(F.to_json(self.column), F.lit(""))
        return F.coalesce(self.column.cast("string"), F.lit(""))

    def truth(self) -> Column:
        if isinstance(self.type, (T.ArrayType, T.MapType)):
            said = F.size(self.column) > 0
        elif isinstance(self.type, T.BooleanType):
            said = self.column
        elif isinstance(self.type, T.NumericType):
            said = self.column != 0
        elif isinstance(self.type, T.StringType):
            said = self.column != ""
        else:
            said = self.column.isNotNull()
        return F.coalesce(said, F.lit(False))


def _constant(value: Any) -> Value:
    """A driver-side value: texts, numbers, booleans, lists of them, lists of records."""
    if isinstance(value, (list, tuple, dict)):
        schema = F.schema_of_json(F.lit(json.dumps(value)))
        kind = _type_of(value)
        return Value(F.from_json(F.lit(json.dumps(value)), kind.simpleString() if kind else schema), kind or T.StringType())
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), type(None): T.StringType()}
    return Value(F.lit(value).cast(kinds.get(type(value), T.StringType())), kinds.get(type(value), T.StringType()))


def _type_of(value: Any) -> T.DataType:
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, (list, tuple)):
        return T.ArrayType(_type_of(value[0]) if value else T.StringType())
    if isinstance(value, dict):
        return T.StructType([T.StructField(k, _type_of(v)) for k, v in value.items()])
    return T.StringType()


#: Helpers callable in a template: name to a function of Values that gives a text Column.
HELPERS: dict[str, Callable[..., Column]] = {}


def helper(name: str):
    def add(f):
        HELPERS[name] = f
        return f

    return add


def _part(item: Value | None, names: tuple[str, ...]) -> Column:
    """The first of the named fields that a struct has, as text."""
    if isinstance(item.type, T.StructType):
        for n in names:
            if n in item.type.names:
                return Value(item.column[n], item.type[n].dataType).text()
        return F.lit("")
    return item.text()


@helper("format_samples")
def _format_samples(samples: Value) -> Column:
    """A numbered list of samples with their labels."""
    kind = samples.type.elementType
    line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), _part(Value(x, kind), ("text", "student_prompt")), F.lit("\n   label: "), _part(Value(x, kind), ("label", "gold_answer")))
    return F.coalesce(F.array_join(F.transform(samples.column, line), "\n"), F.lit(""))


@helper("format_choices")
def _format_choices(choices: Value) -> Column:
    """Choices, a line each: of arrays label and text in a struct, or an array of structs of both."""
    kind = choices.type
    if isinstance(kind, T.StructType):
        lines = F.zip_with(choices.column["label"], choices.column["text"], lambda a, b: F.concat(a.cast("string"), F.lit(". "), b.cast("string")))
    else:
        lines = F.transform(choices.column, lambda x: F.concat(_part(Value(x, kind.elementType), ("label",)), F.lit(". "), _part(Value(x, kind.elementType), ("text",))))
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


@helper("class_taxonomy")
def _class_taxonomy(names: Value) -> Column:
    """Class numbers with their names, one a line."""
    return F.coalesce(F.array_join(F.transform(names.column, lambda n, i: F.concat(i.cast("string"), F.lit(": "), n.cast("string"))), "\n"), F.lit(""))


class _Compiler:
    def __init__(self, scopes: list[dict[str, Value]], strict: bool):
        self.scopes, self.strict = scopes, strict

    def value(self, dotted: str, optional: bool = False) -> Value | None:
        first, *rest = dotted.split(".")
        got = next((s[first] for s in self.scopes if first in s), None)
        for name in rest:
            if got is None:
                break
            got = Value(got.column[name], got.type[name].dataType) if isinstance(got.type, T.StructType) and name in got.type.names else Value(F.try_element_at(got.column, F.lit(name)), got.type.valueType) if isinstance(got.type, T.MapType) else None
        if got is None and self.strict and not optional:
            known = sorted({n for s in self.scopes for n in s})
            raise TemplateError(f"{dotted} is not known; there are: {', '.join(known)}")
        return got

    def expression(self, text: str) -> Column:
        head, *filters = [p.strip() for p in re.split(r"\|(?=(?:[^\"']|\"[^\"]*\"|'[^']*')*$)", text)]
        has_default = any(f.startswith("default") for f in filters)
        if m := re.fullmatch(rf"([A-Za-z_]\w*)\(\s*({NAME})\s*\)", head):
            if m[1] not in HELPERS:
                raise TemplateError(f"no helper {m[1]}")
            got = self.value(m[2], has_default)
            out, value = (F.lit("") if got is None else HELPERS[m[1]](got)), None
        elif m := re.fullmatch(r"\"([^\"]*)\"|'([^']*)'", head):
            out, value = F.lit(m[1] if m[1] is not None else m[2]), None
        elif re.fullmatch(NAME, head):
            value = self.value(head, has_default)
            out = F.lit("") if value is None else value.text()
        else:
            raise TemplateError(f"can't read the field {text!r}")
        for f in filters:
            m = re.fullmatch(r"(\w+)(?:\(\s*(?:\"([^\"]*)\"|'([^']*)'|(-?[\d.]+))\s*\))?", f)
            name, given = (m[1], next((g for g in m.groups()[1:] if g is not None), "")) if m else (f, "")
            if name == "default":
                out = F.lit(given) if value is None else F.when(value.column.isNull(), F.lit(given)).otherwise(out)
            elif name == "join" and value is not None and isinstance(value.type, T.ArrayType):
                out = F.coalesce(F.array_join(value.column.cast("array<string>"), given), F.lit(""))
            elif name == "length" and value is not None:
                out = F.coalesce(F.size(value.column) if isinstance(value.type, (T.ArrayType, T.MapType)) else F.length(value.text()), F.lit(0)).cast("string")
            elif name in ("upper", "lower", "trim"):
                out = getattr(F, name)(out)
            else:
                raise TemplateError(f"no filter {f!r} here")
        return out

    def condition(self, text: str) -> Column:
        if m := re.fullmatch(rf"({NAME})\s*(==|!=)\s*(?:\"([^\"]*)\"|'([^']*)')", text):
            got = self.value(m[1])
            same = F.coalesce((F.lit("") if got is None else got.text()) == F.lit(m[3] if m[3] is not None else m[4]), F.lit(False))
            return same if m[2] == "==" else ~same
        m = re.fullmatch(rf"(not\s+)?({NAME})", text)
        if not m:
            raise TemplateError(f"can't read the condition {text!r}")
        got = self.value(m[2])
        said = F.lit(False) if got is None else got.truth()
        return ~said if m[1] else said

    def nodes(self, nodes: list[Node]) -> Column:
        parts = [self.node(n) for n in nodes]
        return F.concat(*parts) if parts else F.lit("")

    def node(self, n: Node) -> Column:
        if n.kind == "text":
            return F.lit(n.what)
        if n.kind == "field":
            return self.expression(n.what)
        if n.kind == "if":
            return F.when(self.condition(n.what), self.nodes(n.body)).otherwise(self.nodes(n.other))
        variable, name = n.what
        got = self.value(name)
        if got is None:
            return F.lit("")
        if not isinstance(got.type, T.ArrayType):
            raise TemplateError(f"{name} is no array")
        loop = T.StructType([T.StructField("index", T.IntegerType())])

        def one(x: Column, i: Column) -> Column:
            inner = {variable: Value(x, got.type.elementType), "loop": Value(F.struct((i + 1).cast("int").alias("index")), loop)}
            return _Compiler([inner, *self.scopes], self.strict).nodes(n.body)

        return F.coalesce(F.array_join(F.transform(got.column, one), ""), F.lit(""))


def rendered(rows: DataFrame, template: str, variables: dict[str, Any] | None = None, config: dict[str, Any] | None = None, strict: bool = True) -> Column:
    """The template over the columns of rows, as a text Column of them."""
    own = {f.name: Value(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema}
    outer = [{k: _constant(v) for k, v in (d or {}).items()} for d in (variables, config)]
    return _Compiler([own, *outer], strict).nodes(tree_of(template))
