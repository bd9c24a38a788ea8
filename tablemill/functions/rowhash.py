"""Row fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemill.functions.text import named

def row_hash(columns: Sequence[str]) -> Column:
    """md5 over the columns as text, each after its length; a null contributes a lone mark. No two rows spell the same, and none
    hashes to null."""
    cells = [named(c).cast("string") for c in columns]
    spelled = [F.coalesce(F.concat(F.length(cell).cast("string"), F.lit(":"), cell), F.lit("-")) for cell in cells]
    return F.md5(F.concat(F.lit(""), *spelled))
