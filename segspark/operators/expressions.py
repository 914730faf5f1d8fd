"""Filter expressions as text, turned into columns.

Python reads the text; of its tree only names, literals, comparisons, ``and/or/not``,
arithmetic and the five conditions on samples are taken, everything else is an error.
Nothing is evaluated, so Spark plans a filter like any other.

``COORD, CHR, POS, ID, REF, ALT, QUAL`` and ``FILTER`` are the row's, other names are tags of
INFO.  ``any("..")``, ``all("..")``, ``atleast(n, "..")`` and ``forsample(n, "..")`` hold conditions
on the tags of samples, ``crosscomp("DP[1] < DP[2]")`` one on several samples by number.  A tag
is a number where it meets a number or arithmetic, else text; a missing one fulfils
nothing."""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from segspark.operators import variants as V

_COMPARE = {
    ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b,
}
_ARITHMETIC = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide, ast.Mod: F.pmod}
_ROW = {"COORD": "key", "CHR": "chrom", "POS": "pos", "ID": "id", "REF": "ref", "QUAL": "qual"}


def _row(name: str) -> Column:
    if name in ("ALT", "FILTER"):
        return F.array_join(name.lower(), "," if name == "ALT" else ";")
    return F.col(_ROW[name]) if name in _ROW else F.try_element_at("info", F.lit(name))


def _sample(sample: Column) -> Callable[[str], Column]:
    return lambda name: sample[name.lower()] if name in ("NUM", "NAME") else V.tag(sample, name)


class _Reader:
    """Turns trees into columns; ``name`` gives the column of a name, ``item`` that of ``name[n]``."""

    def __init__(self, name: Callable[[str], Column] | None, item: Callable[[str, int], Column] | None = None, samples: bool = False):
        self.name, self.item, self.samples = name, item, samples

    def _fail(self, node: ast.AST) -> None:
        raise ValueError(f"not allowed in a filter: {ast.unparse(node)}")

    def is_number(self, node: ast.AST) -> bool:
        return isinstance(node, (ast.BinOp, ast.UnaryOp)) or isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool)

    def value(self, node: ast.AST, number: bool) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (str, int, float)):
            return F.lit(float(node.value) if number else str(node.value))
        if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
            return _ARITHMETIC[type(node.op)](self.value(node.left, True), self.value(node.right, True))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -self.value(node.operand, True)
        if isinstance(node, ast.Name) and self.name:
            found = self.name(node.id)
        elif isinstance(node, ast.Subscript) and self.item and isinstance(node.value, ast.Name) and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, int):
            found = self.item(node.value.id, node.slice.value)
        else:
            self._fail(node)
        return found.try_cast("double") if number else found.cast("string")

    def among(self, node: ast.AST, where: ast.AST) -> Column:
        if isinstance(where, (ast.Tuple, ast.List)):
            number = any(map(self.is_number, where.elts))
            return self.value(node, number).isin(*(self.value(x, number) for x in where.elts))
        return F.contains(self.value(where, False), self.value(node, False))

    def test(self, node: ast.AST) -> Column:
        if isinstance(node, ast.BoolOp):
            parts = [self.test(x) for x in node.values]
            out = parts[0]
            for x in parts[1:]:
                out = out & x if isinstance(node.op, ast.And) else out | x
            return out
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~self.test(node.operand)
        if isinstance(node, ast.Compare):
            out = F.lit(True)
            for a, op, b in zip([node.left, *node.comparators], node.ops, node.comparators):
                if isinstance(op, (ast.In, ast.NotIn)):
                    part = self.among(a, b) if isinstance(op, ast.In) else ~self.among(a, b)
                elif type(op) in _COMPARE:
                    number = self.is_number(a) or self.is_number(b) or not isinstance(op, (ast.Eq, ast.NotEq)) and not any(isinstance(x, ast.Constant) and isinstance(x.value, str) for x in (a, b))
                    part = _COMPARE[type(op)](self.value(a, number), self.value(b, number))
                else:
                    self._fail(node)
                out = out & F.coalesce(part, F.lit(False))
            return out
        if isinstance(node, ast.Call) and self.samples and isinstance(node.func, ast.Name) and not node.keywords:
            return self.on_samples(node.func.id, [x.value if isinstance(x, ast.Constant) else self._fail(x) for x in node.args])
        self._fail(node)

    def on_samples(self, kind: str, given: list) -> Column:
        if (kind, [type(x) for x in given]) not in [("any", [str]), ("all", [str]), ("atleast", [int, str]), ("forsample", [int, str]), ("crosscomp", [str])]:
            raise ValueError(f"not a condition on samples: {kind}{tuple(given)}")
        tree = _tree(given[-1])
        if kind == "crosscomp":
            return F.coalesce(_Reader(None, lambda name, n: V.field_of(n, name)).test(tree), F.lit(False))
        condition = lambda s: _Reader(_sample(s)).test(tree)
        if kind == "any":
            return V.any_sample(condition)
        if kind == "all":
            return V.all_samples(condition)
        return V.at_least(given[0], condition) if kind == "atleast" else V.for_sample(given[0], condition)


def _tree(text: str) -> ast.AST:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"not an expression: {text!r}") from e


def condition(text: str) -> Column:
    """The condition that ``text`` states of calls as :func:`sources.text.read_vcf` gives them."""
    return _Reader(_row, samples=True).test(_tree(text))
