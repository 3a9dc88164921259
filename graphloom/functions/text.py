"""Column functions over names, routes, signatures, texts and hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities, their scores and actions, ordered tiers.
SEVERITY_SCORE = {"critical": 100, "high": 85, "medium": 55, "low": 25}
DEAD_TIERS = ("definitely_dead", "probably_dead", "possibly_dead")
# Patterns of configuration reads and of input and output in source text.
CONFIG_READS = (
    r"""(?:cfg|config|settings|conf)\s*\[\s*["']([^"']+)["']\s*\]""",
    r"""(?:cfg|config|settings|conf)\.get\s*\(\s*["']([^"']+)["']""",
    r"""os\.(?:getenv|environ\.get|environ\[)\s*\(?["']([^"']+)["']""",
)
IO_TAGS = {
    "db_operation": r"(?i)\.execute\(|\.commit\(|\.fetchall\(|\.fetchone\(|\.cursor\(|session\.|\.query\(|\.insert\(|\.update\(|\.delete\(",
    "http_call": r"(?i)(?:requests|httpx|aiohttp|urllib\.request|urllib\.urlopen)\b|(?:self\._session|self\.session|self\.client|self\._client|self\._rest|session|client|resp|response)\s*\.\s*(?:get|post|put|patch|delete)\s*\(",
    "file_io": r"open\(|\.read\(|\.write\(|\.readlines\(|pathlib\.|shutil\.",
    "async_operation": r"\bawait\b|\basync\s+def\b|\basync\s+for\b|\basync\s+with\b",
    "websocket": r"(?i)websocket|ws_connect|\.send\(|\.recv\(",
}
#: (kind, pattern); the first group is the statement. Fixed values.
INVARIANTS = (
    ("constraint", r"(?i)(?:INV-\d+\s*:?\s*|INVARIANT\s*:?\s*|CONTRACT\s*:?\s*)(.{10,200})"),
    ("constraint", r"([^.\n]{10,180}\(INV-\d+\)[^.\n]{0,40})"),
    ("guarantee", r"(?i)(?:GUARANTEE\s*:?\s*|ENSURES\s*:?\s*|POSTCONDITION\s*:?\s*)(.{10,200})"),
    ("thread", r"(?i)((?:NOT\s+)?thread[- ]safe[^.\n]{0,120}|NOT\s+reentrant[^.\n]{0,80}|reentrant\s*:\s*\w+[^.\n]{0,60})"),
    ("constraint", r"([^.\n]{0,60}(?:Never|NEVER)\s+[a-z][^.\n]{5,120}|MUST\s+NOT\s+[A-Za-z][^.\n]{5,150}|DO\s+NOT\s+[A-Za-z][^.\n]{5,150})"),
    ("guarantee", r"(ALWAYS\s+[A-Za-z][^.\n]{5,150}|MUST\s+(?!NOT)[A-Za-z][^.\n]{5,150})"),
    ("lifecycle", r"(?i)(Must\s+be\s+(?:started|stopped|called|initialised?|initialized?)[^.\n]{5,150})"),
)
#: Words of which a match of each pattern holds one, in lower case where the pattern ignores case: a text without them is
#: not searched, since the patterns try each character anew. Fixed values.
INVARIANT_WORDS = (
    ("inv-", "invariant", "contract"),
    ("(INV-",),
    ("guarantee", "ensures", "postcondition"),
    ("thread-safe", "thread safe", "reentrant"),
    ("Never", "NEVER", "MUST", "DO"),
    ("ALWAYS", "MUST"),
    ("must",),
)
GEOMETRIC_FLOOR = 1e-4


# --- names, routes, signatures


def normalise_route(path: Column) -> Column:
    """Scheme and host off, path parameters to ``{*}``, trailing slashes off, lower case."""
    bare = F.regexp_replace(path, r"^https?://[^/]+(?=/)", "")
    plain = F.regexp_replace(bare, r"<[^>]+>|:[a-zA-Z_][a-zA-Z0-9_]*|\{[^}]+\}", "{*}")
    return F.lower(F.when(F.length(plain) > 1, F.rtrim(plain, F.lit("/"))).otherwise(plain))


def routes_equal(a: Column, b: Column) -> Column:
    return (F.length(normalise_route(a)) > 0) & (normalise_route(a) == normalise_route(b))


def unquote(literal: Column) -> Column:
    """The text of a string literal with its prefix and quotes taken off; null for anything else."""
    inner = F.regexp_extract(F.trim(literal), r"""(?s)^[rRbBuUfF]{0,2}(?:\"\"\"(.*)\"\"\"|'''(.*)'''|"([^"]*)"|'([^']*)')$""", 0)
    body = F.regexp_replace(F.regexp_replace(inner, r"^[rRbBuUfF]{0,2}", ""), r"""^(\"\"\"|'''|"|')|(\"\"\"|'''|"|')$""", "")
    return F.when(F.length(inner) > 0, body)


def camel_to_snake(name: Column) -> Column:
    split = F.regexp_replace(F.regexp_replace(name, r"([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z0-9])([A-Z])", "$1_$2")
    return F.trim(F.lower(split), F.lit("_"))


def normalise_signature(signature: Column) -> Column:
    """Return type and trailing annotation off, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(signature, r"\s*->.*$", ""), r"\s*:\s*\S+\s*$", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def last_part(dotted: Column, parts: int = 1) -> Column:
    return F.substring_index(dotted, ".", -parts)


def diagram_id(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_]", "_")


def normalise_identifier(text: Column) -> Column:
    """``()`` off; ``::``, ``#`` and - outside of paths - ``:`` become dots."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"\(\)$", ""), "::|#", ".")
    return F.when(F.contains(bare, F.lit("/")), bare).otherwise(F.replace(bare, F.lit(":"), F.lit(".")))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def tokenise(query: Column) -> Column:
    """Word tokens of two characters at least, lower case, distinct, in order of first appearance."""
    return F.array_distinct(F.filter(F.split(F.lower(query), r"\W+"), lambda t: F.length(t) >= 2))


def pathway_name(function: Column, qualified: Column) -> Column:
    """Action prefix off, class prefix in snake case before it, ``_flow`` behind."""
    base = F.trim(F.regexp_replace(F.lower(function), r"^(handle_?|on_?|do_?|run_?)", ""), F.lit("_"))
    owner = F.when(F.contains(qualified, F.lit(".")), F.concat(F.lower(F.regexp_replace(F.substring_index(qualified, ".", 1), r"(?<=[a-z0-9])([A-Z])", "_$1")), F.lit("_"))).otherwise("")
    name = F.concat(owner, base)
    return F.when(name.endswith("_flow"), name).otherwise(F.concat(name, F.lit("_flow")))


def terminal_type(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.rlike("db|database|model|repository"), "db_write").when(low.rlike("http|request|client|api"), "http_response").otherwise("return")


def first_sentence(text: Column, most: int = 200) -> Column:
    """Up to the first full stop before white space or the end."""
    return F.substring(F.regexp_extract(F.trim(text), r"(?s)^(.*?\.)(?:\s|$)|^(.*)$", 0), 1, most)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def clamp_rate(rate: Column) -> Column:
    """Between 0 and 1; what is no number counts as 1."""
    return F.coalesce(F.least(F.greatest(F.try_to_number(rate.cast("string"), F.lit("S999999.999999")).cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(1.0))


# --- extraction


def io_tags(source: Column) -> Column:
    return F.array_compact(F.array(*(F.when(source.rlike(p), F.lit(tag)) for tag, p in IO_TAGS.items())))


def config_keys(source: Column) -> Column:
    """Distinct configuration keys that the source reads, sorted."""
    found = [F.regexp_extract_all(source, F.lit(p), F.lit(1)) for p in CONFIG_READS]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def invariants(text: Column) -> Column:
    """Statements of (kind, text) by pattern; those of the same first 60 characters count once, the earlier pattern's."""
    found = [_statements(text, kind, pattern, words) for (kind, pattern), words in zip(INVARIANTS, INVARIANT_WORDS, strict=True)]
    every = F.filter(F.concat(*found), lambda s: F.length(s["text"]).between(10, 200))

    def add(kept: Column, s: Column) -> Column:
        known = F.exists(kept, lambda k: F.substring(F.lower(k["text"]), 1, 60) == F.substring(F.lower(s["text"]), 1, 60))
        return F.when(known, kept).otherwise(F.concat(kept, F.array(s)))

    return F.aggregate(every, F.array().cast("array<struct<kind:string,text:string>>"), add)


def _statements(text: Column, kind: str, pattern: str, words: tuple[str, ...]) -> Column:
    near = F.lower(text) if pattern.startswith("(?i)") else text
    told = reduce(Column.__or__, [F.contains(near, F.lit(w)) for w in words])
    found = F.when(told, F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).when(text.isNotNull(), F.array().cast("array<string>"))
    return F.transform(found, lambda t: F.struct(F.lit(kind).alias("kind"), F.trim(t).alias("text")))


def backtick_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"`([A-Za-z_][\w.]*)(?:\(\))?`"), F.lit(1))


def html_handlers(html: Column) -> Column:
    """Names of the functions that inline handlers and listener registrations call."""
    inline = F.regexp_extract_all(html, F.lit(r"""(?i)\son[a-z]+\s*=\s*["']\s*(?:return\s+)?([A-Za-z_$][\w$]*)\s*\("""), F.lit(1))
    listened = F.regexp_extract_all(html, F.lit(r"""addEventListener\(\s*["'][^"']+["']\s*,\s*([A-Za-z_$][\w$]*)"""), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(inline, listened)))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""<a\s[^>]*href="([^"]*)\""""), F.lit(1))


def script_sources(html: Column) -> Column:
    """Local script sources without query and fragment, sorted; modules, other hosts and data are left out."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<script\b[^>]*>"), F.lit(0))
    plain = F.filter(tags, lambda t: ~F.lower(t).rlike(r"type\s*=\s*[\"']module[\"']"))
    found = F.transform(plain, lambda t: F.regexp_replace(F.regexp_extract(t, r"""(?i)\ssrc\s*=\s*["']([^"']+)["']""", 1), r"[?#].*$", ""))
    return F.array_sort(F.array_distinct(F.filter(found, lambda s: (F.length(s) > 0) & ~s.rlike(r"(?i)^(https?:)?//|^data:"))))


# --- hashes, ids, severities


def sha(text: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def finding_key(kind: Column, path: Column, reason: Column, pack: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", kind, path, reason, pack)), 1, 16)


def node_id(label: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(label), *parts)


def lines_hash(text: Column, first: Column, last: Column) -> Column:
    """SHA-256 of the lines from ``first`` to ``last``, counted from 1, both included."""
    return F.sha2(F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n"), 256)


def rank_of(value: Column, ordered, default: int) -> Column:
    table = F.create_map(*(x for i, v in enumerate(ordered) for x in (F.lit(v), F.lit(i))))
    return F.coalesce(F.element_at(table, value), F.lit(default))


def severity_score(severity: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in SEVERITY_SCORE.items() for x in pair))
    return F.coalesce(F.element_at(table, severity), F.lit(SEVERITY_SCORE["low"]))


def geometric_mean(confidence: Column) -> Column:
    """An aggregate: the geometric mean with a floor for each value, 0 without values."""
    return F.coalesce(F.exp(F.avg(F.ln(F.greatest(confidence, F.lit(GEOMETRIC_FLOOR))))), F.lit(0.0))
