"""Symbols that documents name, held against those that are there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import code
from graphloom.plans.shared import cut

# Tokens that name no symbol, tokens that may be columns of a table, the mark of an example, least length.
NO_SYMBOLS = (
    "True", "False", "None", "true", "false", "null", "undefined",
    "int", "str", "float", "bool", "list", "dict", "set", "tuple",
    "Any", "Optional", "Union", "List", "Dict", "Set", "Tuple",
    "self", "cls", "args", "kwargs",
    "async", "await", "return", "yield", "import", "from", "class",
    "def", "if", "else", "for", "while", "with", "try", "except",
    "GET", "POST", "PUT", "DELETE", "PATCH",
    "TODO", "FIXME", "NOTE", "WARNING", "ERROR",
)
AMBIGUOUS = ("symbol", "key", "id", "name", "type", "status", "value", "data")
EXAMPLES, LEAST, SNIPPET = "<!-- examples-only -->", 3, 120
DOC_FOLDERS, MOST_DOCS = ("docs", "doc", "documentation"), 20

_IDENTIFIER = r"^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*$"
_FENCE = r"^\s*```"


def lines_of(docs: DataFrame, mark: str = EXAMPLES) -> DataFrame:
    """(path, line_number, line, fenced, example) of documents (path, text), a row per line.

    ``fenced``: between two fences, an open one reaching to the end. ``example``: of the block after a line with the
    mark: what is fenced from the next line with text on, or else up to the next blank line; a mark inside such a
    block marks nothing. The states are prefix scans over a document's own lines, in both directions.
    """
    split = F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")
    rows = docs.select("path", F.posexplode(split).alias("_i", "line")).select("path", (F.col("_i") + 1).alias("line_number"), "line")
    before = Window.partitionBy("path").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
    # backwards, since a frame that ends at the last row is summed up anew for each row
    after = Window.partitionBy("path").orderBy(F.desc("line_number")).rowsBetween(Window.unboundedPreceding, -1)
    fence, blank = F.col("line").rlike(_FENCE), ~F.col("line").rlike(r"\S")
    at = lambda what: F.min(F.when(what, F.col("line_number"))).over(after)
    scanned = cut(rows.select("*", fence.alias("_fence"), (F.coalesce(F.sum(fence.cast("int")).over(before), F.lit(0)) % 2 == 1).alias("fenced"), at(~blank).alias("_text"), at(fence).alias("_next_fence"), at(blank).alias("_next_blank")), "doc-lines")
    marks = scanned.where(F.contains("line", F.lit(mark)) & F.col("_text").isNotNull()).select("path", F.col("line_number").alias("mark"), F.col("_text").alias("line_number"))
    last = F.lit(2**31 - 1)
    ends = scanned.join(marks, ["path", "line_number"]).select("path", F.struct("mark", F.col("line_number").alias("first"), F.when(F.col("_fence"), F.coalesce("_next_fence", last)).otherwise(F.coalesce(F.col("_next_blank") - 1, last)).alias("last")).alias("block"))
    # marks of one document, in order: one that stands in the block of another before it is passed over
    blocks = ends.groupBy("path").agg(F.array_sort(F.collect_list("block")).alias("found"))
    kept = F.aggregate("found", F.expr("CAST(array() AS ARRAY<STRUCT<mark: INT, first: INT, last: INT>>)"), lambda out, b: F.when((F.size(out) == 0) | (b["mark"] > F.element_at(out, -1)["last"]), F.concat(out, F.array(b))).otherwise(out))
    told = scanned.join(blocks.select("path", kept.alias("blocks")), "path", "left")
    n = F.col("line_number")
    return told.select("path", "line_number", "line", "fenced", F.coalesce(F.exists("blocks", lambda b: n.between(b["first"], b["last"])), F.lit(False)).alias("example"))


def hint(line: Column, token: Column) -> Column:
    """Where a line says that a token is: the dotted token's prefix as a path, else the line's first ``.py`` path, else null."""
    named = F.regexp_extract(line, r"(\w[\w/.-]+\.py)\b", 1)
    prefix = F.replace(F.regexp_replace(token, r"\.[^.]*$", ""), F.lit("."), F.lit("/"))
    return F.when(F.contains(token, F.lit(".")), prefix).when(named != "", named)


def tokens(docs: DataFrame, flag: str = "skip_doc_check", fenced: bool = False, mark: str = EXAMPLES) -> DataFrame:
    """(path, line_number, line, token): what stands in backticks and may be a symbol, outside of examples.

    Documents whose header sets ``flag`` give none, and neither do fenced lines unless ``fenced`` says so.
    """
    asked = docs.where(F.contains("text", F.lit("`")) & ~code.skipped_by_front_matter(F.col("text"), flag)).select("path", "text")
    lines = lines_of(asked, mark).where("NOT example")
    lines = lines if fenced else lines.where("NOT fenced")
    each = lines.select("path", "line_number", "line", F.explode(F.regexp_extract_all("line", F.lit(r"`([^`\n]+)`"), F.lit(1))).alias("token")).withColumn("token", F.trim("token"))
    return each.where((F.length("token") >= LEAST) & ~F.col("token").isin(*NO_SYMBOLS) & F.col("token").rlike(_IDENTIFIER))


def warnings(docs: DataFrame, symbols: DataFrame, flag_unknown: bool = False, fenced: bool = False) -> DataFrame:
    """(id, path, line_number, symbol, kind, severity, snippet) of documents (path, text).

    ``symbols``: name, qualified_name, file_path of functions and classes. A symbol is ``moved_reference`` (high) if
    its line or its prefix says where it is and no symbol of that name is there, unless the line talks of tables;
    ``unknown_reference`` (medium), if asked for, is a dotted one that nothing is called. Tokens meet the index once
    with each hint that they have, not once per place.
    """
    found = cut(tokens(docs, fenced=fenced).withColumn("hint", hint(F.col("line"), F.col("token"))), "doc-tokens")
    names = symbols.select(F.explode(F.array_distinct(F.array_compact(F.array("name", "qualified_name")))).alias("token"), "file_path").distinct()
    asked = found.select("token", "hint").distinct()
    near = asked.join(names, "token").groupBy("token", "hint").agg(F.bool_or(F.contains("file_path", "hint")).alias("there"))
    near = near.select(F.col("token").alias("_token"), F.col("hint").alias("_hint"), "there", F.lit(True).alias("known"))
    judged = found.join(near, (F.col("token") == F.col("_token")) & F.col("hint").eqNullSafe(F.col("_hint")), "left")
    prose = code.is_schema_prose(F.col("line"), F.col("token"), AMBIGUOUS)
    kind = F.when(F.col("known") & F.col("hint").isNotNull() & ~F.col("there") & ~prose, "moved_reference")
    if flag_unknown:
        kind = F.when(F.col("known").isNull() & F.contains("token", F.lit(".")), "unknown_reference").otherwise(kind)
    told = judged.withColumn("kind", kind).where("kind IS NOT NULL")
    key = F.concat_ws(":", F.regexp_extract("kind", "^[a-z]+", 0), "path", F.col("line_number").cast("string"), "token")
    return told.select(F.substring(F.sha2(key, 256), 1, 24).alias("id"), "path", "line_number", F.col("token").alias("symbol"), "kind", F.when(F.col("kind") == "moved_reference", "high").otherwise("medium").alias("severity"), F.substring(F.trim("line"), 1, SNIPPET).alias("snippet")).distinct()


def doc_index(files: DataFrame, most: int = MOST_DOCS) -> DataFrame:
    """(path, title): the first line of Markdown files below the documents' folders, or their name; the first ``most`` by folder and path."""
    top = F.substring_index("path", "/", 1)
    place = F.array_position(F.lit(list(DOC_FOLDERS)), top)
    asked = files.where(top.isin(*DOC_FOLDERS) & F.endswith("path", F.lit(".md")) & F.contains("path", F.lit("/")))
    first = F.trim(F.regexp_replace(F.trim(F.regexp_extract("text", r"^[^\r\n]*", 0)), "^[# ]+", ""))
    name = F.substring_index("path", "/", -1)
    return asked.orderBy(place, "path").limit(most).select("path", F.when(F.coalesce(first, F.lit("")) != "", first).otherwise(name).alias("title"))
