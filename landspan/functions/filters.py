"""Filter trees and ad-hoc table queries as Columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "LIKE": lambda c, v: c.like(v),
}


def predicate(tree: Mapping | None) -> Column | None:
    """FLT01: a tree of column tests and AND / OR groups as one Column.

    ``None`` or ``{}`` is no filter (``None``), as is a group without children.
    A NULL value compares as SQL NULL.  Unknown types and operators raise.
    """
    if not tree:
        return None
    kind = tree.get("type")
    if kind == "group":
        parts = [p for p in map(predicate, tree.get("children", [])) if p is not None]
        if not parts:
            return None
        both = tree.get("operator", "AND") == "AND"
        return reduce((lambda a, b: a & b) if both else (lambda a, b: a | b), parts)
    if kind != "column":
        raise ValueError(f"unknown node type: {kind}")
    column, op, value = F.col(tree["column"]), tree["op"], tree.get("value")
    if op == "IS NULL":
        return column.isNull()
    if op == "IS NOT NULL":
        return column.isNotNull()
    if op in ("IN", "NOT IN"):
        values = value if isinstance(value, list) else [value]
        known = column.isin([v for v in values if v is not None])
        if None in values:  # a NULL in the list makes a miss unknown
            known = known | F.lit(None).cast("boolean")
        return ~known if op == "NOT IN" else known
    if op not in COMPARE:
        raise ValueError(f"unknown operator: {op}")
    if value is None:
        return F.lit(None).cast("boolean")
    return COMPARE[op](column, F.lit(value) if op != "LIKE" else value)


def apply_filter(df: DataFrame, tree: Mapping | None) -> DataFrame:
    """Rows of ``df`` that pass the tree."""
    p = predicate(tree)
    return df if p is None else df.where(p)


SIMPLE = {
    "eq": lambda c, v: c == v,
    "neq": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "like": lambda c, v: c.cast("string").contains(str(v)),
}


def table_query(
    df: DataFrame,
    filters: Sequence[tuple[str, str, object]] = (),
    columns: Sequence[str] | None = None,
    order: Sequence[str] = (),
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """FLT02: simple tests joined by AND, a column list, and one page of rows."""
    for name, op, value in filters:
        if op not in SIMPLE:
            raise ValueError(f"unknown operator: {op}")
        if name not in df.columns:
            raise ValueError(f"unknown column: {name}")
        df = df.where(SIMPLE[op](F.col(name), F.lit(value) if op != "like" else value))
    if order:
        df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*columns) if columns else df


PAGE_MIN, PAGE_MAX = 1, 250


def page(
    df: DataFrame, sort: str, allowed: Sequence[str], key: str, number: int, size: int, descending: bool = False
) -> DataFrame:
    """SRT03: one page of a table by a permitted sort column; the key breaks ties."""
    if sort not in allowed:
        raise ValueError(f"cannot sort by {sort}")
    size = max(PAGE_MIN, min(PAGE_MAX, size))
    first = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return df.orderBy(first, F.asc(key)).offset((max(number, 1) - 1) * size).limit(size)
