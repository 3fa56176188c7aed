"""Input paths: patterns, existence, duplicates; through Hadoop's file systems, so that any store works."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import SparkSession

from ..errors import IOError_


def expand(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Files of the patterns (``*`` and ``?`` in any part of the path), sorted within a pattern.

    A pattern without any match, a missing file, and a file given twice are errors.
    """
    found: list[str] = []
    for pattern in patterns:
        path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if "*" in pattern or "?" in pattern:
            hits = sorted(s.getPath().toString() for s in fs.globStatus(path) or [] if s.isFile())
            if not hits:
                raise IOError_(f"no file matches {pattern}")
            found += hits
        elif not fs.exists(path):
            raise IOError_(f"file does not exist: {pattern}")
        else:
            found.append(fs.resolvePath(path).toString())
    twice = sorted(p for p, n in Counter(found).items() if n > 1)
    if twice:
        raise IOError_(f"file given twice: {', '.join(twice)}")
    return found
