"""Which files a source means."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GLOB_SIGNS = frozenset("*?[]")


def split_patterns(files: str | Sequence[str] | None) -> list[str]:
    """Patterns from a list or from text separated by ``;``, ``,`` or line breaks; quotes and BOMs are dropped."""
    if files is None:
        return []
    pieces = re.split(r"[;,\r\n]", files) if isinstance(files, str) else [str(f) for f in files]
    cleaned = [p.replace("﻿", "").replace(" ", " ").strip().strip("\"'") for p in pieces]
    return [p for p in cleaned if p]


def listing(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """Files as (path, length, modified); contents are not read. Works on every file system Spark knows."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names anything; asks the file system, not a job."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def literal(path: str) -> str:
    """The path with glob signs escaped, for readers that take globs."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def file_path(column: str = "_metadata.file_path") -> Column:
    """The path of a row's file as it is written, not as a URI spells it."""
    return F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B")))


def _any_case(name: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in name)


def _is_absolute(name: str) -> bool:
    return name.startswith("/") or "://" in name or re.match(r"^[a-z0-9]+:/", name) is not None


def source_paths(
    spark: SparkSession,
    path: str,
    files: str | Sequence[str] | None = None,
    default_glob: str = "*",
    recursive: bool = False,
) -> list[str]:
    """Paths to hand to a Spark reader: absolute names as they are, globs below ``path``, and literal names below
    ``path`` with a fallback that ignores case. Globs stay globs, so a folder of many files is one path; only a
    recursive search lists files. A named file that is not there is an error; a glob may match nothing.
    """
    base = path.rstrip("/")
    patterns = split_patterns(files)
    if not patterns:
        leaf = base.rsplit("/", 1)[-1]
        if GLOB_SIGNS & set(leaf) or "." in leaf.lstrip("."):
            return [base]
        patterns = [default_glob]
    found: list[str] = []
    for pattern in patterns:
        if _is_absolute(pattern):
            if _exists(spark, pattern):
                found.append(pattern)
            elif not GLOB_SIGNS & set(pattern):
                raise FileNotFoundError(f"no file {pattern}")
        elif GLOB_SIGNS & set(pattern):
            if recursive:
                found += [literal(r["path"]) for r in listing(spark, base, pattern, True).select("path").collect()]
            elif _exists(spark, f"{base}/{pattern}"):
                found.append(f"{base}/{pattern}")
        elif _exists(spark, f"{base}/{pattern}"):
            found.append(f"{base}/{pattern}")
        elif _exists(spark, f"{base}/{_any_case(pattern)}"):
            found.append(f"{base}/{_any_case(pattern)}")
        else:
            raise FileNotFoundError(f"no file {pattern} below {base}")
    return list(dict.fromkeys(found))


def require_paths(spark: SparkSession, path: str, files: str | Sequence[str] | None = None, default_glob: str = "*",
                  recursive: bool = False) -> list[str]:
    """``source_paths``, or an error when there is nothing to read."""
    found = source_paths(spark, path, files, default_glob, recursive)
    if not found:
        raise FileNotFoundError(f"no file below {path} for {files or default_glob!r}")
    return found


def with_file(df: DataFrame, output: str = "_file") -> DataFrame:
    """Add the file each row came from."""
    return df.select("*", file_path().alias(output))


def union_tables(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames by column name; a column some frames lack is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
