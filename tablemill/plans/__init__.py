"""Named queries over the given tables, each with the SQL that must give the same result.

Importing the package registers all of them.
"""

from tablemill.plans import (  # noqa: F401
    cleaning,
    contracts,
    merging,
    profiling,
    quality,
    sinks,
    sources,
    sql,
    streams,
    windows,
)
