"""Which paths the ignore files of a tree leave out.

An ignore file rules what lies below its folder. Its lines are patterns in order;
of all that match a path the last one decides, a deeper file before a higher one,
and a pattern with ``!`` takes the path back in. What lies in a folder that is
left out is out too, whatever is said about it.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_RULE = "negated boolean, folders_only boolean, regex string"


def rule_of(line: str) -> tuple[bool, bool, str] | None:
    """(taken back in, folders only, expression over a path below the file's folder), or None for no pattern."""
    line = line.rstrip("\r\n")
    line = re.sub(r"(?<!\\) +$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    body = line[1:] if negated else line
    folders_only = body.endswith("/")
    body = body.rstrip("/") if folders_only else body
    if not body:
        return None
    anywhere = "/" not in body
    body = body.removeprefix("/")
    out, i = "(?:.*/)?" if anywhere else "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif body[i:] == "**" and i and body[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            while body.startswith("*", i):
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := body.find("]", i + 2 + (body[i + 1 : i + 2] in ("!", "^")))) > 0:
            inner = body[i + 1 : end]
            mark = "^/" if inner[:1] in ("!", "^") else ""
            inner = inner[1:] if mark else inner
            out, i = out + "[" + mark + re.sub(r"([\[\]\\&^])", r"\\\1", inner) + "]", end + 1
        else:
            if c == "\\" and i + 1 < len(body):
                i += 1
            out, i = out + re.sub(r"([^\w/ ])", r"\\\1", body[i]), i + 1
    return negated, folders_only, f"^{out}$"


def rules(lines: DataFrame) -> DataFrame:
    """(folder, line_no, negated, folders_only, regex) of ignore files' lines (folder, line_no, line); the root is ``''``."""

    @pandas_udf(_RULE)
    def parsed(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rule_of(t) or (None, None, None) for t in text.fillna("")], columns=["negated", "folders_only", "regex"])

    return lines.select("folder", "line_no", parsed("line").alias("rule")).where("rule.regex IS NOT NULL").select("folder", "line_no", "rule.*")


def ignored(files: DataFrame, told: DataFrame) -> DataFrame:
    """(path): the files that ``told`` (the result of ``rules``) leaves out.

    Every folder above a file is judged once, however many files it has: a folder or file meets the rules of
    the folders above it by name, and the greatest (depth of the rule's folder, line) that matches decides.
    """
    split = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(split)), lambda n: F.struct(F.array_join(F.slice(split, 1, n), "/").alias("part"), (n < F.size(split)).alias("is_folder")))
    parts = files.select("path").distinct().select("path", F.inline(steps))
    one = parts.select("part", "is_folder").distinct()
    names = F.split("part", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda n: F.struct(F.when(n == 0, "").otherwise(F.array_join(F.slice(names, 1, n), "/")).alias("folder"), n.alias("depth")))
    met = one.select("part", "is_folder", F.inline(above)).join(told, "folder")
    below = F.when(F.col("folder") == "", F.col("part")).otherwise(F.substr("part", F.length("folder") + F.lit(2)))
    hit = met.where((F.col("is_folder") | ~F.col("folders_only")) & F.rlike(below, F.col("regex")))
    out = hit.groupBy("part", "is_folder").agg(F.max_by("negated", F.struct("depth", "line_no")).alias("back")).where("NOT back")
    return parts.join(out, ["part", "is_folder"], "left_semi").select("path").distinct()
