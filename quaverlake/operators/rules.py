"""Rule documents of saved lists, compiled to Columns."""

from __future__ import annotations

import functools
import json
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86400


@dataclass(frozen=True)
class Field:
    """A rule's field: its kind (num, bool, date, tags or text) and column."""

    kind: str
    column: str


def number(value) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        return 0.0


def _between(value) -> tuple[float, float]:
    if isinstance(value, (list, tuple)) and len(value) == 2:
        return number(value[0]), number(value[1])
    return 0.0, 0.0


COMPARE = {"eq": operator.eq, "ne": operator.ne, "gte": operator.ge, "lte": operator.le, "gt": operator.gt, "lt": operator.lt}
TRUE_WORDS = ("true", "1", "yes")


def condition(field: Field, op: str, value, now: int) -> Column:
    """One condition; ``now`` is in epoch seconds, so that results repeat."""
    c = F.col(field.column)
    if field.kind == "num":
        n = F.coalesce(c.cast("double"), F.lit(0.0))
        if op == "between":
            low, high = _between(value)
            return n.between(low, high)
        if op in COMPARE:
            return COMPARE[op](n, F.lit(number(value)))
    if field.kind == "bool" and op in ("is", "eq"):
        return F.coalesce(c.cast("boolean"), F.lit(False)) == F.lit(str(value).lower() in TRUE_WORDS)
    if field.kind == "date":
        at = F.coalesce(c.cast("double"), F.lit(0.0))
        edge = F.lit(now - number(value) * DAY)
        known = {
            "in_last_days": (at > 0) & (at >= edge),
            "not_in_last_days": (at <= 0) | (at < edge),
            "before_days": (at > 0) & (at < edge),
            "gte": at >= number(value),
            "lte": at <= number(value),
        }
        if op in known:
            return known[op]
    if field.kind == "tags":
        want = str(value).lower()
        found = F.exists(c, lambda t: F.contains(F.lower(t), F.lit(want)))
        known = {"contains": found, "not_contains": ~found, "is": F.exists(c, lambda t: F.lower(t) == want)}
        if op in known:
            return known[op]
    if field.kind == "text":
        t, want = F.lower(F.coalesce(c, F.lit(""))), str(value).lower()
        known = {
            "is": t == want, "is_not": t != want, "contains": t.contains(want), "not_contains": ~t.contains(want),
            "starts": t.startswith(want), "ends": t.endswith(want),
        }
        if op in known:
            return known[op]
    raise ValueError(f"no operation {op} on a field of kind {field.kind}")


def evaluate(df: DataFrame, rules: str | dict, fields: dict[str, Field], now: int, order: str = "pool_i") -> DataFrame:
    """Rows of ``df`` that the rules take, sorted and cut as they say; ties keep pool order both ways."""
    spec = json.loads(rules) if isinstance(rules, str) else rules
    for c in spec.get("conditions", []):
        if c.get("field") not in fields:
            raise ValueError(f"no field {c.get('field')}")
    conditions = [condition(fields[c["field"]], c.get("op"), c.get("value"), now) for c in spec.get("conditions", [])]
    join = operator.or_ if spec.get("match") == "any" else operator.and_
    out = df.where(functools.reduce(join, conditions)) if conditions else df
    if spec.get("sort"):
        key = F.col(fields[spec["sort"]].column)
        out = out.orderBy(F.desc_nulls_last(key) if spec.get("desc") else F.asc_nulls_first(key), order)
    else:
        out = out.orderBy(order) if spec.get("limit") else out
    return out.limit(int(spec["limit"])) if spec.get("limit") else out
