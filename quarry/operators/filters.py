"""The JSON filter language: validation on the driver, compilation to one Column that Catalyst can push down.

A filter is a dictionary of `key: value` (equality), `key: {operator: operand}`, `$and: [...]` and `$or: [...]`.
A key names a column, or an entry of a metadata map column; array values match when an element does.

A row without the key matches `$ne` and `$nin` and nothing else. With first_only, of several conditions in one
object only the first counts, as in stores that take one condition per object; `$exists` then counts for nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

LOGICAL = ("$and", "$or")
LEAF = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$listContains", "$exists")


def validated(expr: object, keys: Iterable[str] | None = None) -> dict | None:
    """expr without what is unknown, misplaced or empty, strings in lower case; None if nothing is left."""
    known = None if keys is None else set(keys)
    out = _valid(expr, known)
    if len(out) == 1 and next(iter(out)) in LOGICAL and len(next(iter(out.values()))) == 1:
        out = next(iter(out.values()))[0]
    return out or None


def _valid(expr: object, known: set[str] | None) -> dict:
    out: dict = {}
    for key, value in expr.items() if isinstance(expr, dict) else ():
        if key in LOGICAL:
            children = [c for c in (_valid(x, known) for x in value) if c] if isinstance(value, list) else []
            if children:
                out[key] = children
        elif not key.startswith("$") and (known is None or key in known):
            leaf = {op: _lower(x) for op, x in value.items() if op in LEAF} if isinstance(value, dict) else {"$eq": _lower(value)}
            if leaf:
                out[key] = leaf
    return out


def _lower(value: object) -> object:
    if isinstance(value, str):
        return value.lower()
    return [_lower(x) for x in value] if isinstance(value, list) else value


def leaf_keys(expr: dict) -> set[str]:
    """All keys that a filter names, misplaced operators included."""
    found: set[str] = set()
    for key, value in expr.items():
        if key in LOGICAL and isinstance(value, list):
            found |= set().union(*(leaf_keys(x) for x in value if isinstance(x, dict)))
        else:
            found.add(key)
    return found


def names_only(expr: dict, keys: Iterable[str]) -> bool:
    """Whether a filter is not empty and names known keys only."""
    return bool(expr) and leaf_keys(expr) <= set(keys)


def compiled(expr: dict | None, schema: StructType, metadata: str | None = None, first_only: bool = False) -> Column:
    """The filter as a predicate for where(), plain enough to reach the scan: null counts as false; no filter is true."""
    if not expr:
        return F.lit(True)
    out = _node(expr, lambda key: _field(key, schema, metadata), first_only)
    return F.lit(True) if out is None else out


def _field(key: str, schema: StructType, metadata: str | None) -> tuple[Column, DataType]:
    if key in schema.names:
        return F.col(key), schema[key].dataType
    if metadata is None:
        raise KeyError(f"no column {key}")
    return F.try_element_at(F.col(metadata), F.lit(key)), schema[metadata].dataType.valueType


def _node(expr: dict, field: Callable, first_only: bool) -> Column | None:
    parts: list[Column] = []
    for key, value in expr.items():
        if key in LOGICAL:
            children = [c for c in (_node(x, field, first_only) for x in value) if c is not None]
            part = [reduce(and_ if key == "$and" else or_, children)] if children else []
        else:
            conditions = value if isinstance(value, dict) else {"$eq": value}
            part = [_leaf(*field(key), op, x) for op, x in conditions.items() if not (first_only and op == "$exists")]
            part = part[:1] if first_only else part
        parts += part
        if first_only and parts:
            break
    return reduce(and_, parts) if parts else None


def _leaf(c: Column, kind: DataType, op: str, operand: object) -> Column:
    if op == "$exists":
        return c.isNotNull() if operand else c.isNull()
    many = isinstance(kind, ArrayType)
    if op in ("$ne", "$nin"):
        same = _leaf(c, kind, "$eq" if op == "$ne" else "$in", operand)
        return c.isNull() | ~(F.coalesce(same, F.lit(False)) if many else same)
    element = kind.elementType if many else kind
    test = _test(op, operand, isinstance(element, StringType))
    return F.exists(c, test) if many else test(c)


def _test(op: str, operand: object, text: bool) -> Callable[[Column], Column]:
    """The test of one value. Text is compared with numbers as a number."""
    value = lambda x: F.lit(str(x).lower() if text and not isinstance(x, str) else x)
    if op in ("$eq", "$listContains"):
        return lambda x: x == value(operand)
    if op == "$in":
        return lambda x: x.isin(*[value(v) for v in operand]) if operand else F.lit(False)
    number = text and isinstance(operand, (int, float)) and not isinstance(operand, bool)
    left = (lambda x: x.try_cast("double")) if number else (lambda x: x)
    compare = {"$gt": Column.__gt__, "$gte": Column.__ge__, "$lt": Column.__lt__, "$lte": Column.__le__}[op]
    return lambda x: compare(left(x), F.lit(operand))
