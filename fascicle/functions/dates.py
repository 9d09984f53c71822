"""Dates of issues: ISO text, integers and file names. Impossible dates are null, never errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(c: Column) -> Column:
    """DateType of YYYY-MM-DD text; null for anything else."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def date_int(d: Column) -> Column:
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def base_name(path: Column) -> Column:
    """Last part of a path with either kind of slash."""
    return F.coalesce(F.element_at(F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/"), -1), F.lit(""))


# The two forms of a date at the end of a file name.
def date_from_name(path: Column) -> Column:
    """Date at the end of a file's stem: YYYY-MM-DD first, else DD-MM-YYYY."""
    stem = F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")
    iso = iso_date(F.regexp_extract(stem, r"(?:^|[^0-9])(\d{4}-\d{2}-\d{2})$", 1))
    dmy = r"(?:^|[^0-9])(\d{2})-(\d{2})-(\d{4})$"
    return F.coalesce(iso, iso_date(F.concat_ws("-", *(F.regexp_extract(stem, dmy, k) for k in (3, 2, 1)))))


def issue_name(d: Column, prefix: str = "Issue") -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.date_format(d, "dd-MM-yyyy"), F.lit(".pdf"))


def manual_path(d: Column) -> Column:
    return F.when(d.isNull(), "/api/manual").otherwise(F.concat(F.lit("/api/manual?date="), d.cast("string")))


def public_url(base: str, name: Column) -> Column:
    """base/name with name percent-encoded (a space is %20)."""
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(base.rstrip("/") + "/"), F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))))
