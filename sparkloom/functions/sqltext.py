"""SQL scripts: several statements, other dialects' infix operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def split_statements(script: str) -> list[str]:
    """Statements between semicolons; those in quotes and comments don't count, blank statements are dropped."""
    out, now, i, n = [], [], 0, len(script)
    while i < n:
        c = script[i]
        if c in "'\"`":
            j = i + 1
            while j < n and (script[j] != c or script[j + 1 : j + 2] == c):
                j += 2 if script[j] == c else 1
            now.append(script[i : j + 1])
            i = j + 1
        elif script.startswith("--", i):
            j = script.find("\n", i)
            i = n if j < 0 else j
        elif script.startswith("/*", i):
            j = script.find("*/", i)
            i = n if j < 0 else j + 2
        elif c == ";":
            out.append("".join(now).strip())
            now, i = [], i + 1
        else:
            now.append(c)
            i += 1
    out.append("".join(now).strip())
    return [s for s in out if s]


def translate(sql: str) -> str:
    """Infix regular expressions (``~``, ``!~``, and ``~*``, ``!~*`` for either case), which Spark's parser lacks, as RLIKE."""
    parts = re.split(r"('(?:[^']|'')*')", sql)
    for k in range(0, len(parts), 2):
        # A pattern for either case has the flag before it, in the text that follows.
        if re.search(r"~\*\s*$", parts[k]) and k + 1 < len(parts):
            parts[k + 1] = "'(?i)" + parts[k + 1][1:]
            parts[k] = re.sub(r"~\*\s*$", "~ ", parts[k])
        parts[k] = re.sub(r"~\*\s*([\w.]+)", r"~ concat('(?i)', \1)", parts[k])
        parts[k] = re.sub(r"\s*!~\s*", " NOT RLIKE ", parts[k])
        parts[k] = re.sub(r"(?<=[\w)\"`\]])\s+~\s*(?=$|[\w(])", " RLIKE ", parts[k])
    return "".join(parts)


def run_script(spark: SparkSession, script: str) -> list[DataFrame]:
    """All statements in turn; the frames of those that give rows."""
    frames = [spark.sql(translate(s)) for s in split_statements(script)]
    return [f for f in frames if f.columns]
