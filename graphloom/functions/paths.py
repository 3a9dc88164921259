"""Column functions over repository paths: language, category, segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension to language, path fragments by category.
LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".sh": "shell", ".bash": "shell", ".html": "html", ".htm": "html", ".css": "css", ".md": "markdown", ".markdown": "markdown",
}
TEST_FRAGMENTS = ("test_", "_test", ".test.", ".spec.", "tests/", "test/", "__tests__", "/tests/", "/test/", "/test_", "/spec/", "/specs/")
UTILITY_DIRECTORIES = ("utils", "util", "utilities", "helpers", "helper", "lib", "libs", "common", "shared", "contrib", "support")
SCRIPT_PATTERN = r"(?i)(^|/)(scripts?|diagnostics?|tools?|bin|dev|debug|scratch|migrations?|fixtures?)(/|$)"
DOC_PATTERN = r"(^|/)(docs|documentation)/"
EXAMPLE_PATTERN = r"(^|/)examples/"
WEB, PYTHON = ("javascript", "typescript"), "python"


def slashed(path: Column) -> Column:
    """Back slashes to slashes, outer blanks off."""
    return F.trim(F.replace(path, F.lit("\\"), F.lit("/")))


def _any_of(text: Column, fragments) -> Column:
    out = F.lit(False)
    for f in fragments:
        out = out | F.contains(text, F.lit(f))
    return out


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language_of(path: Column) -> Column:
    """The language of a path, null for unknown extensions."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGE_BY_EXTENSION.items() for x in pair))
    return F.element_at(table, extension(path))


def language_family(language: Column) -> Column:
    return F.when(language == PYTHON, "python").when(language.isin(*WEB), "web").otherwise("other")


def is_test_path(path: Column) -> Column:
    return _any_of(F.lower(slashed(path)), TEST_FRAGMENTS)


def is_utility_path(path: Column) -> Column:
    return _any_of(F.lower(slashed(path)), [f"{d}/" for d in UTILITY_DIRECTORIES])


def is_script_path(path: Column) -> Column:
    return slashed(path).rlike(SCRIPT_PATTERN)


def has_segment(path: Column, names) -> Column:
    """Whether a directory or file segment of the path is one of ``names``."""
    return F.arrays_overlap(F.split(F.lower(slashed(path)), "/"), F.array(*map(F.lit, names)))


def classify_path(path: Column, vendored=()) -> Column:
    """test, docs, examples, scripts, vendor or production: the first that fits."""
    low = F.lower(slashed(path))
    out = F.when(is_test_path(path), "test").when(low.rlike(DOC_PATTERN), "docs").when(low.rlike(EXAMPLE_PATTERN), "examples").when(is_script_path(path), "scripts")
    return (out.when(has_segment(path, vendored), "vendor") if vendored else out).otherwise("production")


def directory_key(path: Column, depth: int) -> Column:
    """The first ``depth`` directories of a path; the empty string for a file of the root."""
    directories = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.array_join(F.slice(directories, 1, depth), "/")


def resolve_dots(path: Column) -> Column:
    """Takes ``.`` and ``..`` out of a path; climbing over the root stays at the root."""

    def step(kept: Column, part: Column) -> Column:
        return F.when(part.isin("", "."), kept).when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def prefixes(path: Column, separator: str = "/") -> Column:
    """All leading parts of a path, longest first."""
    parts = F.split(path, "[" + separator + "]")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), separator))


def suffixes(path: Column) -> Column:
    """All trailing parts of a path, longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
