"""Structured facts from log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemill.functions.text import stripped

# Log levels and the class shown for each, and the model-run line format.
LEVEL_TYPES = {
    "DEBUG": "info",
    "INFO": "info",
    "WARNING": "warning",
    "WARN": "warning",
    "ERROR": "error",
    "CRITICAL": "error",
    "FATAL": "error",
    "SUCCESS": "success",
}
MODEL_LINE = r"(\d+) of (\d+) (OK|ERROR) creat(?:ed?|ing) (\w+) (\w+) model ([\w.]+)"
MODEL_SECONDS = r"in ([\d.]+)s"

_JSON_SHAPE = "level string, message string, timestamp string, metadata string"


def log_entry(line: Column, default_type: str = "info") -> Column:
    """Struct (type, message, timestamp, metadata): a JSON object with level and message, else the plain line."""
    text = stripped(line)
    parsed = F.from_json(text, _JSON_SHAPE, {"mode": "PERMISSIVE"})
    structured = (F.coalesce(parsed["level"], F.lit("")) != "") & (F.coalesce(parsed["message"], F.lit("")) != "")
    level = F.upper(parsed["level"])
    mapped = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LEVEL_TYPES.items() for x in kv]), level),
                        F.lit("info"))
    return F.struct(
        F.when(structured, mapped).otherwise(F.lit(default_type)).alias("type"),
        F.when(structured, parsed["message"]).otherwise(text).alias("message"),
        F.when(structured, parsed["timestamp"]).alias("timestamp"),
        F.when(structured, parsed["metadata"]).alias("metadata"),
    )


def model_run(line: Column) -> Column:
    """Struct describing one model-run line; null when the line is of another kind."""
    field = lambda n: F.regexp_extract(line, MODEL_LINE, n)
    seconds = F.coalesce(F.regexp_extract(line, MODEL_SECONDS, 1).try_cast("double"), F.lit(0.0))
    return F.when(
        line.rlike(MODEL_LINE),
        F.struct(
            F.element_at(F.split(field(6), r"\."), -1).alias("model_name"),
            field(6).alias("full_path"),
            F.lower(field(3)).alias("status"),
            field(4).alias("model_type"),
            field(5).alias("object_type"),
            seconds.alias("seconds"),
        ),
    )
