"""Numbers: lenient casts, rates, scores and safe arithmetic."""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """A double, or null where the value reads as none."""
    return c.try_cast("double")


def percent_change(new: Column, old: Column) -> Column:
    """100 * (new / old - 1); null where either is null or old is 0."""
    return F.when(old != 0, (new / old - 1) * 100)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def growth_rate(start: Column, end: Column, years: Column) -> Column:
    """Compound annual growth; null outside its domain (start and years above 0, end not below)."""
    return F.when((start > 0) & (end >= 0) & (years > 0), F.pow(end / start, 1 / years) - 1)


def clamped(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def count_similarity(a: Column, b: Column) -> Column:
    """The smaller over the larger of two counts; two noughts are alike."""
    return F.when((a == 0) & (b == 0), 1.0).otherwise(F.least(a, b) / F.greatest(a, b))


def overlap_of_boxes(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes given by any two opposite corners."""

    def sides(box: list[Column]) -> tuple[Column, ...]:
        return F.least(box[0], box[2]), F.least(box[1], box[3]), F.greatest(box[0], box[2]), F.greatest(box[1], box[3])

    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = sides(a), sides(b)
    none = F.lit(0.0)
    shared = F.greatest(none, F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(none, F.least(ay1, by1) - F.greatest(ay0, by0))
    union = (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


#: What one unit is in yuan.
UNITS = {"元": 1.0, "万元": 1e4, "亿元": 1e8}


def in_unit(c: Column, unit: str) -> Column:
    return c / F.lit(UNITS[unit])


_BINARY = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Mod: operator.mod,
    ast.Div: lambda a, b: F.when(b != 0, a / b), ast.Pow: lambda a, b: F.pow(a, b),
}
_CALLS = {
    "abs": F.abs, "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "log": lambda x: F.when(x > 0, F.log(x)),
    "log10": lambda x: F.when(x > 0, F.log10(x)), "pow": F.pow, "round": lambda x: F.bround(x, 0),
    "min": F.least, "max": F.greatest, "cagr": growth_rate, "cagr_pct": lambda *a: growth_rate(*a) * 100,
}


def formula(text: str, columns: dict[str, Column]) -> Column:
    """A Column from arithmetic over named columns; `^` is a power. Anything else is refused."""

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return build(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in columns:
            return columns[node.id]
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
            return -build(node.operand) if isinstance(node.op, ast.USub) else build(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS and not node.keywords:
            if node.func.id == "round" and len(node.args) == 2 and isinstance(node.args[1], ast.Constant):
                return F.bround(build(node.args[0]), node.args[1].value)
            return _CALLS[node.func.id](*map(build, node.args))
        raise ValueError(f"not allowed in a formula: {ast.dump(node)[:60]}")

    return build(ast.parse(text.replace("^", "**"), mode="eval"))
