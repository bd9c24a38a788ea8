"""Column names: normalising, de-duplicating, resolving aliases, requiring, selecting."""

from __future__ import annotations

import logging
import re
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.text import named
from tablemill.operators.filters import compare

log = logging.getLogger(__name__)


class SkipTable(Exception):
    """The table lacks what the chain needs and is to be left out."""


def _free_names(names: Iterable[str], identity) -> list[str]:
    """Suffix repeats with ``_1``, ``_2``, ...; a suffix already taken by another column is passed over."""
    names = list(names)
    originals = {identity(n) for n in names}
    taken: set[str] = set()
    counters: dict[str, int] = {}
    out = []
    for name in names:
        candidate, base = name, identity(name)
        while identity(candidate) in taken or (candidate != name and identity(candidate) in originals):
            counters[base] = counters.get(base, 0) + 1
            candidate = f"{name}_{counters[base]}"
        taken.add(identity(candidate))
        out.append(candidate)
    return out


def normal_name(name: str | None) -> str:
    """Lower case, runs of anything but ASCII letters and digits as one ``_``; ``col`` when nothing is left."""
    return re.sub(r"[^0-9a-z]+", "_", (name or "").strip().lower()).strip("_") or "col"


def header_key(name: str | None) -> str:
    """What two headers must share to count as the same: spaces collapsed, no trailing dots, lower case."""
    return re.sub(r"\s+", " ", (name or "").strip()).rstrip(".").lower()


def normalize_headers(df: DataFrame) -> DataFrame:
    """Machine-friendly, unique column names."""
    return df.toDF(*_free_names(map(normal_name, df.columns), str.lower))


def unique_headers(names: Sequence[str]) -> list[str]:
    """Headers as read, repeats suffixed."""
    return _free_names(names, header_key)


def dedupe_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_headers(df.columns))


def rename_columns(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Rename by exact name."""
    return df.toDF(*[renames.get(c, c) for c in df.columns])


def resolve_aliases(columns: Sequence[str], spec: Sequence[Mapping[str, Any]]) -> tuple[dict[str, str], list[Any]]:
    """Output name to actual column for every entry that is present, and the aliases of required ones that are not.

    An alias is a header text or ``{"regex": pattern}``, matched whole and without regard to case.
    """
    by_key: dict[str, str] = {}
    for column in columns:
        by_key.setdefault(header_key(column), column)
    found: dict[str, str] = {}
    missing: list[Any] = []
    for entry in spec:
        aliases = entry["alias"] if isinstance(entry["alias"], list) else [entry["alias"]]
        first = aliases[0]
        fallback = first["regex"] if isinstance(first, Mapping) else str(first)
        output = str(entry.get("rename") or entry.get("as") or fallback)
        actual = next((hit for hit in (_find(by_key, alias) for alias in aliases) if hit), None)
        if actual is not None:
            found[output] = actual
        elif entry.get("required") or entry.get("optional") is False:
            missing.append(aliases)
    return found, missing


def _find(by_key: Mapping[str, str], alias: Any) -> str | None:
    if isinstance(alias, Mapping):
        pattern = re.compile(alias["regex"], re.IGNORECASE)
        return next((column for key, column in by_key.items() if pattern.fullmatch(key)), None)
    return by_key.get(header_key(str(alias)))


def pick_by_alias(df: DataFrame, spec: Sequence[Mapping[str, Any]]) -> DataFrame:
    """One column per entry that is present, under its output name; a missing required entry is an error."""
    found, missing = resolve_aliases(df.columns, spec)
    if missing:
        raise KeyError(f"required columns missing: {missing}")
    return df.select(*[named(actual).alias(output) for output, actual in found.items()])


def _targets(spec: Mapping[str, str | None] | Sequence[str] | None) -> list[tuple[list[str], str]]:
    """(alternative sources, target) pairs from ``{"a|b": "target", "c": None}`` or ``["c"]``."""
    if not spec:
        return []
    if not isinstance(spec, Mapping):
        return [([str(name)], str(name)) for name in spec]
    return [
        ([part.strip() for part in str(source).split("|")], str(target) if target not in (None, "~") else str(source))
        for source, target in spec.items()
    ]


def require_columns(
    df: DataFrame,
    required: Mapping[str, str | None] | Sequence[str] = (),
    *,
    optional: Mapping[str, str | None] | Sequence[str] | None = None,
    alias_map: Mapping[str, str] | None = None,
    include_only: bool | Sequence[str] | None = None,
    keep_extra: bool = False,
    mode: str = "error",
    normalize_source: bool = True,
) -> DataFrame:
    """Rename through aliases, check that the required columns are there, and keep the declared ones.

    Of several columns that map to one target the first in the table wins and the others are dropped. When a
    required column is missing ``mode`` decides: ``error``, ``skip_table`` (raises ``SkipTable``) or ``empty``
    (no rows, the required columns as strings).
    """
    if mode not in ("error", "skip_table", "empty"):
        raise ValueError(f"unknown mode: {mode}")
    fold = (lambda s: " ".join(str(s).lower().split())) if normalize_source else str
    wanted, extra = _targets(required), _targets(optional)
    aliases = {fold(source): target for source, target in (alias_map or {}).items()}
    if isinstance(required, Mapping):
        aliases.update({fold(s): target for sources, target in wanted for s in sources})
    if isinstance(optional, Mapping):
        aliases.update({fold(s): target for sources, target in extra for s in sources})

    chosen: dict[str, str] = {}  # output name -> table column, in table order
    for column in df.columns:
        target = aliases.get(fold(column), column)
        if target in chosen:
            log.warning("column %r dropped: %r is already taken from %r", column, target, chosen[target])
            continue
        chosen[target] = column

    needed = list(dict.fromkeys(target for _, target in wanted))
    missing = [target for target in needed if target not in chosen]
    if missing:
        if mode == "skip_table":
            raise SkipTable(f"missing columns: {missing}")
        if mode == "empty":
            names = needed if isinstance(include_only, bool) or include_only is None else list(include_only)
            return df.sparkSession.createDataFrame([], ", ".join(f"`{n}` string" for n in names))
        raise KeyError(f"required columns missing: {missing}")

    if include_only is None:
        include_only = bool(needed) and alias_map is None
    if keep_extra or include_only is False:
        keep = list(chosen)
    elif include_only is True:
        keep = needed
    else:
        keep = [c for c in include_only if c in chosen]
    if not keep_extra and include_only is not False:
        keep = list(dict.fromkeys([*keep, *(target for _, target in extra if target in chosen)]))
    return df.select(*[named(chosen[name]).alias(name) for name in keep])


# A pattern with one of these characters is a regular expression, any other is a glob.
REGEX_SIGNS = frozenset("^$\\()|[]")


def match_columns(columns: Sequence[str], pattern: str) -> list[str]:
    """Columns matching an exact name, a regular expression (anchored at its start) or a glob."""
    if pattern in columns:
        return [pattern]
    if REGEX_SIGNS & set(pattern):
        return [c for c in columns if re.match(pattern, c)]
    glob = "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in pattern)
    return [c for c in columns if re.fullmatch(glob, c)]


def select_columns(
    df: DataFrame, select: Sequence[str] | None = None, exclude: Sequence[str] | None = None
) -> DataFrame:
    """Selected minus excluded columns, in alphabetical order; the table is unchanged when nothing would be left."""
    pool = set(df.columns) if select is None else {c for p in select for c in match_columns(df.columns, p)}
    pool -= {c for p in exclude or () for c in match_columns(df.columns, p)}
    return df.select(*[named(c) for c in sorted(pool)]) if pool else df


def dynamic_select(
    df: DataFrame,
    *,
    pattern: str,
    output_name: str,
    order_by: Sequence[str],
    match_row: Mapping[str, Any] | None = None,
    condition: Mapping[str, Any] | None = None,
    keep_columns: Sequence[str] = (),
) -> DataFrame:
    """Keep the one candidate column whose value in the first matching row meets the condition.

    The first row by ``order_by`` is found by an aggregate that returns one row; without a hit the first candidate
    is taken.
    """
    candidates = match_columns(df.columns, pattern)
    if not candidates:
        raise ValueError(f"no column matches {pattern!r}")
    rows = df
    for column, value in (match_row or {}).items():
        if column in df.columns:
            rows = rows.where(named(column) == F.lit(value))
    place = F.struct(*[named(c) for c in order_by])
    first = rows.agg(F.min_by(F.struct(*[named(c) for c in candidates]), place).alias("row"))
    met = [F.coalesce(_met(F.col("row")[c], condition or {}), F.lit(False)).alias(f"m{i}") for i, c in enumerate(candidates)]
    verdict = first.select(F.col("row").isNotNull().alias("found"), *met).head()
    if not verdict["found"]:
        raise ValueError(f"no row matches {match_row!r}")
    chosen = next((c for i, c in enumerate(candidates) if verdict[f"m{i}"]), candidates[0])
    keep = [named(c) for c in keep_columns if c in df.columns]
    return df.select(*keep, named(chosen).alias(output_name))


def _met(cell: Column, condition: Mapping[str, Any]) -> Column:
    """The filters' comparison on one cell; an order is one of numbers."""
    operator = "regex" if condition.get("type") == "regex" else condition.get("operator", "==")
    value = condition.get("value")
    if value is None:
        return cell.isNull() if operator in ("==", "=") else F.lit(False)
    return compare(cell.try_cast("double") if operator in ORDERS else cell, operator, float(value) if operator in ORDERS else value)


ORDERS = (">", "<", ">=", "<=")
