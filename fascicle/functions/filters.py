"""Metadata filters: a nested-dict language compiled to one predicate Column, and its builders.

The compiled predicate is made of plain comparisons, so it reaches Parquet scans and prunes date
partitions.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Section names that a question may filter by.
SECTIONS = (
    "news", "sport", "sports", "business", "states", "world", "editorial", "opinion", "national", "international", "delhi", "telangana", "faith", "science", "education", "investor",
)

_COMPARE = {"$eq": lambda c, v: c == F.lit(v), "$in": lambda c, v: c.isin(list(v)), "$gte": lambda c, v: c >= F.lit(v), "$lte": lambda c, v: c <= F.lit(v), "$gt": lambda c, v: c > F.lit(v), "$lt": lambda c, v: c < F.lit(v)}
_KINDS = {"string": str, "int": (int, float), "bigint": (int, float), "smallint": (int, float), "double": (int, float), "float": (int, float), "boolean": bool, "date": (str, date)}


#: Values of one IN that a Parquet scan compares one by one; more of them prune by their least and largest only.
IN_VALUES = 10


def among(c: Column, values: list) -> Column:
    """c is one of values (false for none), in parts that prune a scan value by value."""
    return reduce(lambda a, b: a | b, (c.isin(values[k : k + IN_VALUES]) for k in range(0, len(values), IN_VALUES))) if values else F.lit(False)


def compile_filter(tree: Mapping | None, df: DataFrame) -> Column:
    """Predicate on df for a filter tree; null never passes.

    {"field": value} means equality; operators in one clause are ANDed; $and and $or nest. A field
    that df lacks, or a value of another type than its column, matches nothing.
    """
    kinds = dict(df.dtypes)

    def fits(field, v) -> bool:
        if field not in kinds or v is None:
            return False
        kind = _KINDS.get(kinds[field], object)
        return isinstance(v, kind) and isinstance(v, bool) == (kinds[field] == "boolean")

    def clause(field, spec) -> Column:
        if not isinstance(spec, Mapping):
            spec = {"$eq": spec}
        out = []
        for op, v in spec.items():
            if op not in _COMPARE:
                raise ValueError(f"unknown operator {op}")
            values = [x for x in v if fits(field, x)] if op == "$in" else v
            ok = bool(values) if op == "$in" else fits(field, v)
            out.append(_COMPARE[op](F.col(field), values) if ok else F.lit(False))
        return reduce(Column.__and__, out, F.lit(True)) if out else F.lit(True)

    def build(node) -> Column:
        parts = []
        for key, v in node.items():
            if key == "$and":
                parts.append(reduce(Column.__and__, map(build, v), F.lit(True)))
            elif key == "$or":
                parts.append(reduce(Column.__or__, map(build, v), F.lit(False)))
            else:
                parts.append(clause(key, v))
        return reduce(Column.__and__, parts) if len(parts) > 1 else parts[0] if parts else F.lit(True)

    return build(tree) if tree else F.lit(True)


def iso(value) -> str | None:
    """value if it is a real YYYY-MM-DD date, else None."""
    text = str(value or "").strip()
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return None
    try:
        date.fromisoformat(text)
    except ValueError:
        return None
    return text


def as_int(day: str) -> int:
    return int(day.replace("-", ""))


def section_filter(section: str) -> dict:
    """lower, UPPER and Capital spellings; sport and sports are one section."""
    low = section.strip().lower()
    names = ["sport", "sports"] if low in ("sport", "sports") else [low]
    return {"section": {"$in": [v for n in names for v in (n, n.upper(), n.capitalize())]}}


def date_range(day: str | None = None, start: str | None = None, end: str | None = None) -> dict | None:
    """Inclusive range on dateInt, or one day."""
    if day:
        return {"date": {"$eq": day}}
    parts = [{"dateInt": {op: as_int(v)}} for op, v in (("$gte", start), ("$lte", end)) if v]
    return None if not parts else parts[0] if len(parts) == 1 else {"$and": parts}


def build_filter(filters: Mapping) -> dict | None:
    clauses = [c for c in (date_range(filters.get("date"), filters.get("dateFrom"), filters.get("dateTo")),) if c]
    if filters.get("pageNumber") is not None:
        clauses.append({"pageNumber": {"$eq": filters["pageNumber"]}})
    if filters.get("section"):
        clauses.append(section_filter(filters["section"]))
    return None if not clauses else clauses[0] if len(clauses) == 1 else {"$and": clauses}


def empty_filters() -> dict:
    return {"date": None, "dateFrom": None, "dateTo": None, "pageNumber": None, "section": None, "whole": False}


def coerce_filters(raw) -> dict:
    """A model's filter JSON made safe: real dates only, ranges in order, known sections."""
    out = empty_filters()
    if not isinstance(raw, Mapping):
        return out
    day, start, end = (iso(raw.get(k)) for k in ("date", "dateFrom", "dateTo"))
    if start and end and start > end:
        start, end = end, start
    if start and start == end:
        day, start, end = start, None, None
    if day:
        start = end = None
    try:
        page = float(raw.get("pageNumber"))
    except (TypeError, ValueError):
        page = 0.0
    section = str(raw.get("section") or "").strip().lower()
    section = ("sport" if section == "sports" else section) if section in SECTIONS else None
    return out | {"date": day, "dateFrom": start, "dateTo": end, "pageNumber": int(page) if page >= 1 and page == int(page) else None, "section": section, "whole": raw.get("whole") in (True, "true")}


def coerce_columns(c: dict[str, Column]) -> dict[str, Column]:
    """coerce_filters on string Columns of the same names, for tables of parsed questions."""
    from fascicle.functions.dates import iso_date

    day, start, end = (iso_date(F.trim(c[k])) for k in ("date", "dateFrom", "dateTo"))
    both = start.isNotNull() & end.isNotNull()
    low, high = F.when(both, F.least(start, end)).otherwise(start), F.when(both, F.greatest(start, end)).otherwise(end)
    same = both & (start == end)
    day = F.when(same, start).otherwise(day)
    page = c["pageNumber"].try_cast("double")
    section = F.lower(F.trim(c["section"]))
    section = F.when(section.isin(*SECTIONS), F.when(section == "sports", "sport").otherwise(section))
    text = lambda d: d.cast("string")
    return {
        "date": text(day), "dateFrom": F.when(day.isNull(), text(low)), "dateTo": F.when(day.isNull(), text(high)),
        "pageNumber": F.when((page >= 1) & (page == F.floor(page)), page.cast("int")), "section": section, "whole": F.coalesce(c["whole"] == "true", F.lit(False)),
    }
