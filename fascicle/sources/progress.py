"""Progress of the calendar and of curation runs as small JSON documents.

A calendar has one entry a date, so a document is a few hundred entries. Saves go to a file beside
the old one that then takes its place, so a reader never sees half a document.
"""

from __future__ import annotations

import json
from datetime import date, datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from fascicle.operators.calendar import FIELDS, PROGRESS_SCHEMA
from fascicle.sources.tables import _hadoop

VERSION = 2


def save_json(spark: SparkSession, path: str, document: dict) -> dict:
    """Write a document in one step: readers see the old one or the new one."""
    (fs, new), (_, at) = _hadoop(spark, f"{path}.tmp"), _hadoop(spark, path)
    out = fs.create(new, True)
    out.write(json.dumps(document, indent=2).encode())
    out.close()
    if not fs.rename(new, at):  # a store that does not rename over a file
        fs.delete(at, False)
        if not fs.rename(new, at):
            raise OSError(f"{path} could not be replaced")
    return document


def load_json(spark: SparkSession, path: str) -> dict | None:
    """The document; None where there is none or it is no JSON object."""
    fs, at = _hadoop(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        raw = bytes(stream.readAllBytes())
    except Py4JJavaError as e:
        if "ChecksumException" in e.java_exception.getClass().getName():
            return None  # damaged on disk
        raise
    finally:
        stream.close()
    try:
        found = json.loads(raw)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def save_progress(progress: DataFrame, path: str) -> dict:
    """Save a calendar's progress with what follows from it: whether every present file is complete
    (false where none is present), the sum of vectors, and the time."""
    rows = [r.asDict() for r in progress.select(*FIELDS).orderBy("date").collect()]
    present = [r for r in rows if r["status"] != "missing"]
    files = {str(r["date"]): {k: v for k, v in r.items() if k != "date"} for r in rows}
    derived = {"complete": bool(present) and all(r["status"] == "complete" for r in present), "vectorCount": sum(r["vectorCount"] or 0 for r in rows)}
    return save_json(progress.sparkSession, path, {"version": VERSION, "files": files, **derived, "updatedAt": datetime.now(timezone.utc).isoformat()})


def load_progress(spark: SparkSession, path: str) -> DataFrame | None:
    """A calendar's saved progress; None where there is none, it cannot be read, or its version is another one."""
    found = load_json(spark, path)
    if not found or found.get("version") != VERSION or not isinstance(found.get("files"), dict):
        return None
    rows = [(date.fromisoformat(day), *(f.get(c) for c in FIELDS if c != "date")) for day, f in found["files"].items()]
    return spark.createDataFrame(rows, PROGRESS_SCHEMA)


def save_run(spark: SparkSession, path: str, **fields) -> dict:
    """Save where a curation run stands: source, totalPages, nextPage, rawCount, kept, dropped, complete."""
    return save_json(spark, path, {"updatedAt": datetime.now(timezone.utc).isoformat(), **fields})


def load_run(spark: SparkSession, path: str) -> dict | None:
    return load_json(spark, path)
