"""A small filter language as a column, so that Catalyst can push it down to the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "$eq": lambda c, v: c == v if v is not None else c.isNull(),
    "$ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(*v) if v else F.lit(False),
    "$nin": lambda c, v: F.coalesce(~c.isin(*v), F.lit(True)) if v else F.lit(True),
    "$contains": lambda c, v: F.contains(c, F.lit(v)),
    "$exists": lambda c, v: c.isNotNull() if v else c.isNull(),
}


def where(rule: dict) -> Column:
    """``{"a": 1}``, ``{"a": {"$in": [...]}}``, ``{"$and": [...]}``, ``{"$or": [...]}`` and ``{"$not": {...}}`` as a condition.

    Several entries hold together.  An empty rule holds for every row, an empty
    ``$or`` for none; an unknown operator is an error.
    """
    parts = []
    for key, value in rule.items():
        if key == "$and":
            parts.append(reduce(lambda a, b: a & b, [where(v) for v in value], F.lit(True)))
        elif key == "$or":
            parts.append(reduce(lambda a, b: a | b, [where(v) for v in value], F.lit(False)))
        elif key == "$not":
            parts.append(~where(value))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        elif isinstance(value, dict):
            for name, operand in value.items():
                if name not in _COMPARE:
                    raise ValueError(f"unknown operator {name}")
                parts.append(_COMPARE[name](F.col(key), operand))
        else:
            parts.append(_COMPARE["$eq"](F.col(key), value))
    return reduce(lambda a, b: a & b, parts, F.lit(True))
