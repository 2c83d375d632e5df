"""Level rules of generalization hierarchies: each turns the previous level's value into the next one's.

Rules are Column expressions. Rule files may hold small Python lambdas; they are never evaluated, but parsed, and a
whitelist of their syntax is translated to Column expressions.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The value that stands for every value.
ANY = "*"


def _label(lo: Column, width: int) -> Column:
    return F.concat(lo.cast("string"), F.lit("~"), (lo + (width - 1)).cast("string"))


@dataclass(frozen=True)
class Bucket:
    """A number becomes the range of `width` that holds it less `shift`."""

    width: int
    shift: int = 0

    def column(self, value: Column) -> Column:
        return _label(F.floor((value.cast("double") - self.shift) / self.width).cast("long") * self.width, self.width)


@dataclass(frozen=True)
class Widen:
    """A range label becomes the wider range that holds its low end."""

    width: int

    def column(self, value: Column) -> Column:
        low = F.split(value, "~")[0].cast("long")
        return _label(F.floor(low / self.width).cast("long") * self.width, self.width)


@dataclass(frozen=True)
class DropDigit:
    """One more trailing digit becomes a star; `stars` is the number of stars afterwards."""

    stars: int

    def column(self, value: Column) -> Column:
        number = F.split(value.cast("string"), r"\*")[0].cast("long")
        return F.concat(F.floor(number / 10).cast("string"), F.lit(ANY * self.stars))


@dataclass(frozen=True)
class MapValues:
    """Listed values are replaced; others become `other`, or carry over unchanged when that is None."""

    values: dict = field(hash=False)
    other: str | None = None

    def column(self, value: Column) -> Column:
        text = value.cast("string")
        if not self.values:
            return text if self.other is None else F.lit(self.other)
        table = F.create_map(*[F.lit(str(x)) for kv in self.values.items() for x in kv])
        return F.coalesce(F.try_element_at(table, text), text if self.other is None else F.lit(self.other))


@dataclass(frozen=True)
class Threshold:
    """Numbers below `limit` become one value, the others another."""

    limit: float
    below: str
    above: str

    def column(self, value: Column) -> Column:
        return F.when(value < self.limit, self.below).otherwise(self.above)


@dataclass(frozen=True)
class Suppress:
    """Everything becomes '*'."""

    def column(self, value: Column) -> Column:
        return F.when(value.isNotNull(), ANY)


@dataclass(frozen=True)
class Expression:
    """A lambda of a rule file, translated; only arithmetic, comparisons, conditions, f-strings, int, str and split."""

    source: str

    def column(self, value: Column) -> Column:
        tree = ast.parse(self.source.strip(), mode="eval").body
        if not isinstance(tree, ast.Lambda) or len(tree.args.args) != 1:
            raise ValueError(f"a rule must be a lambda of one argument: {self.source}")
        result = _translate(tree.body, tree.args.args[0].arg, value)
        return F.when(value.isNotNull(), result if isinstance(result, Column) else F.lit(result))


_COMPARE = {ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__", ast.Eq: "__eq__", ast.NotEq: "__ne__"}
_ARITHMETIC = {ast.Add: "__add__", ast.Sub: "__sub__", ast.Mult: "__mul__"}


def _translate(node: ast.expr, name: str, x: Column):
    """A Column or a Python constant for one node."""
    go = lambda n: _translate(n, name, x)
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    match node:
        case ast.Constant(value=v):
            return v
        case ast.Name(id=i) if i == name:
            return x
        case ast.List(elts=items) | ast.Tuple(elts=items):
            return [go(i) for i in items]
        case ast.BinOp(left=a, op=ast.FloorDiv(), right=b):
            return F.floor(col(go(a)) / col(go(b))).cast("long")
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _ARITHMETIC:
            return getattr(col(go(a)), _ARITHMETIC[type(op)])(go(b))
        case ast.Compare(left=a, ops=[ast.In()], comparators=[b]):
            return col(go(a)).isin(go(b))
        case ast.Compare(left=a, ops=[ast.NotIn()], comparators=[b]):
            return ~col(go(a)).isin(go(b))
        case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _COMPARE:
            return getattr(col(go(a)), _COMPARE[type(op)])(go(b))
        case ast.IfExp(test=t, body=a, orelse=b):
            return F.when(go(t), col(go(a))).otherwise(col(go(b)))
        case ast.JoinedStr(values=parts):
            return F.concat(*[F.lit(p.value) if isinstance(p, ast.Constant) else col(go(p.value)).cast("string") for p in parts])
        case ast.Call(func=ast.Name(id="int"), args=[a]):
            return col(go(a)).cast("long")
        case ast.Call(func=ast.Name(id="str"), args=[a]):
            return col(go(a)).cast("string")
        case ast.Subscript(value=ast.Call(func=ast.Attribute(value=v, attr="split"), args=[ast.Constant(value=sep)]), slice=ast.Constant(value=i)):
            return F.split(col(go(v)), "".join(f"\\{c}" if not c.isalnum() else c for c in sep))[i]
    raise ValueError(f"this syntax is not allowed in a rule: {ast.unparse(node)}")
