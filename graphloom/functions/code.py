"""Column functions over source text, expressions and symbols: what is exempt, what is an event, what is imported."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import paths

# --- symbols

# Names and paths that are never reported.
PLUGIN_CONTRACT_NAMES = ("build_plugin",)
NON_PRODUCTION = ("/tests/", "/test/", "test_", "/scripts/", "/script/")
EXCLUDED_CONFIG_KEYS = ("PATH", "HOME", "USER", "SHELL", "TERM", "LANG", "LC_ALL", "PYTHONPATH", "VIRTUAL_ENV", "PWD")


def in_plugin_module(path: Column) -> Column:
    slashed = paths.slashed(path)
    return F.endswith(slashed, F.lit("/plugin.py")) & F.contains(F.concat(F.lit("/"), slashed), F.lit("/plugins/"))


def is_plugin_function(name: Column, path: Column) -> Column:
    """A function that plugins of any kind have to define."""
    return name.isin(*PLUGIN_CONTRACT_NAMES) & in_plugin_module(path)


def is_plugin_class(name: Column, path: Column) -> Column:
    return F.endswith(name, F.lit("Plugin")) & in_plugin_module(path)


def is_hard_exempt(name: Column, path: Column, decorated: Column, is_entry: Column) -> Column:
    """Functions that are never dead: entry points, dunders, tests, examples, plugin factories, decorated ones."""
    reasons = [is_entry, name.rlike(r"^__.+__$"), name.rlike(r"^test_"), paths.is_test_path(path), F.lower(paths.slashed(path)).rlike(paths.EXAMPLE_PATTERN), is_plugin_function(name, path), decorated]
    return reduce(or_, (F.coalesce(r, F.lit(False)) for r in reasons))


def is_non_production(path: Column) -> Column:
    low = F.lower(paths.slashed(path))
    return reduce(or_, (F.contains(low, F.lit(x)) for x in NON_PRODUCTION))


def instantiated_classes(source: Column) -> Column:
    """The classes that a source builds by ``new X(``."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(source, F.lit(r"\bnew\s+([A-Za-z_$][\w$]*)\s*\("), 1)))


def may_be_live_method(qualified: Column, path: Column, instantiated: Column) -> Column:
    """A method of a script class that its own file builds."""
    return path.rlike(r"\.(js|jsx|ts|tsx)$") & F.contains(qualified, F.lit(".")) & F.array_contains(instantiated, F.substring_index(qualified, ".", 1))


def is_handler_emit(name: Column, bases: Column) -> Column:
    """``emit`` of a class whose base is the logging module's own handler: that module calls it."""
    own = lambda b: (F.trim(b) == "logging.Handler") | F.trim(b).endswith(".Handler") & F.contains(b, F.lit("logging"))
    return (name == "emit") & F.exists(bases, own)


def skips_language(entry: Column, callee: Column) -> Column:
    """Whether a step from ``entry`` to ``callee`` would cross between Python and the web."""
    a, b = (paths.language_family(paths.language_of(p)) for p in (entry, callee))
    return F.coalesce(((a == "python") & (b == "web")) | ((a == "web") & (b == "python")), F.lit(False))


def cross_language_name(name: Column) -> Column:
    """Camel case to lower snake case, so that names of two languages meet."""
    return F.btrim(F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_")), F.lit("_"))


# --- expressions

_REGISTER = r"(?i)(^|\.)(register|subscribe|add_handler|add_listener|on|bind|connect|add_callback|set_handler|set_callback|add_hook|register_handler|add_event_listener|register_route)$"
PUBLISH = ("publish", "publish_critical", "emit", "fire", "dispatch", "send_event")
SUBSCRIBE = ("subscribe", "add_listener", "add_handler", "listen", "on")


def is_registration(callee: Column) -> Column:
    return callee.rlike(_REGISTER)


def is_identifier(expr: Column) -> Column:
    return expr.rlike(r"^[A-Za-z_]\w*$")


def callback_refs(arguments: Column) -> Column:
    """Of argument expressions those that name a function: no literals, numbers, members in capitals, operators."""
    plain = F.filter(F.transform(arguments, lambda x: F.trim(x)), lambda e: (e != "") & ~e.rlike(r"^(b?['\"]|True|False|None|0x|0b)") & ~e.rlike(r"^[\d._]*\d[\d._]*$") & ~e.rlike(r"[()+\-*/=\[\]{}]"))
    return F.filter(plain, lambda e: ~(F.contains(e, F.lit(".")) & F.element_at(F.split(e, r"\."), -1).rlike(r"^[^a-z]*[A-Z][^a-z]*$")))


def is_event(expr: Column) -> Column:
    """A member in capitals, an ``Event(``, a call of a class or what is taken from one."""
    s = F.trim(expr)
    member = F.contains(s, F.lit(".")) & (F.element_at(F.split(s, r"\."), -1).rlike(r"^[^a-z]*[A-Z][^a-z]*$") | F.element_at(F.split(s, r"\."), -1).startswith("Event(") | s.rlike(r"^\p{Lu}") & F.contains(s, F.lit("(")))
    return (s != "") & (member | s.rlike(r"^[A-Z].*\(.*\)$"))


def event_type(expr: Column) -> Column:
    """What stands after ``type=``, else the last dotted part; 80 characters at most."""
    s = F.trim(expr)
    after = F.trim(F.substring_index(F.substring_index(F.substr(s, F.instr(s, "type=") + 5), ",", 1), ")", 1))
    return F.substring(F.substring_index(F.when(F.contains(s, F.lit("type=")), after).otherwise(s), ".", -1), 1, 80)


def event_confidence(expr: Column) -> Column:
    return F.when(expr.rlike(r"EventType\.|\.[^a-z.]*[A-Z][^a-z.]*$"), 0.9).otherwise(0.7)


def string_literal(expr: Column) -> Column:
    """The text of a string literal, prefixed or not; empty if it is none."""
    bare = F.regexp_replace(F.trim(expr), r"(?i)^(rf|fr|rb|br|ur|ru|r|f|u|b)(?=.)", "")
    return F.regexp_extract(bare, r"(?s)^(\"\"\"|'''|\"|')(.*)\1$", 2)


def first_string_argument(callee: Column) -> Column:
    found = F.regexp_extract(callee, r"\(\s*\"([^\"]*)\"|\(\s*'([^']*)'", 0)
    return F.regexp_replace(found, r"^\(\s*[\"']|[\"']$", "")


def call_url(arguments: Column, keywords: Column, callee: Column) -> Column:
    """The URL of a client call: its first literal, then the keywords for one, then a literal inside the callee."""
    literals = F.filter(F.transform(arguments, string_literal), lambda x: x != "")
    named = [string_literal(F.coalesce(F.element_at(keywords, k), F.lit(""))) for k in ("url", "path", "endpoint", "uri")]
    return F.coalesce(F.get(literals, F.lit(0)), *(F.nullif(x, F.lit("")) for x in named), first_string_argument(callee))


def type_names(annotation: Column) -> Column:
    """The identifiers of an annotation, sorted, each once."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(annotation, F.lit(r"[A-Za-z_]\w*"), 0)))


def _outer_parts(text: Column) -> Column:
    """Cuts at the commas that stand in no brackets: pieces are joined again while a bracket is open."""
    count = lambda x, chars: F.length(x) - F.length(F.translate(x, chars, ""))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, piece: Column) -> Column:
        joined = F.when(acc["open"].isNull(), piece).otherwise(F.concat(acc["open"], F.lit(","), piece))
        closed = count(joined, "([{") <= count(joined, ")]}")
        return F.struct(F.when(closed, F.concat(acc["done"], F.array(joined))).otherwise(acc["done"]).alias("done"), F.when(~closed, joined).alias("open"))

    return F.aggregate(F.split(text, ","), start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def parameters(signature: Column) -> Column:
    """The parameters of a signature, cut at commas outside brackets: an array of (name, type), without self."""
    inner = F.regexp_extract(signature, r"(?s)\((.*)\)", 1)
    marked = F.filter(F.transform(_outer_parts(inner), lambda x: F.trim(x)), lambda p: (p != "") & ~p.isin("self", "cls", "*", "/"))
    name = lambda p: F.regexp_extract(p, r"^\**(\w+)", 1)
    kind = lambda p: F.trim(F.regexp_extract(p, r"^\**\w+\s*:\s*(.*?)\s*(=.*)?$", 1))
    return F.transform(marked, lambda p: F.struct(name(p).alias("name"), kind(p).alias("type")))


# --- texts

# How imports are written and what says that a text talks to a database.
_IMPORTS = ((r"(?m)^\s*from\s+([a-zA-Z0-9_./]+)\s+import\b", False), (r"(?m)^\s*import\s+([a-zA-Z0-9_., ]+)$", True), (r"from\s+['\"]([^'\"]+)['\"]", False), (r"require\(['\"]([^'\"]+)['\"]\)", False))
_DATABASE = r"\bimport\s+sqlite3\b|\bfrom\s+sqlalchemy\b|\bimport\s+sqlalchemy\b|\bimport\s+psycopg2\b|\bimport\s+aiosqlite\b|\bfrom\s+motor\b|\bfrom\s+pymongo\b|\brequire\(['\"]pg['\"]\)|\brequire\(['\"]mysql2?['\"]\)|\bfrom ['\"]pg['\"]|\bfrom ['\"]mysql2?['\"]"
_SCHEMA_PROSE = (" column", " columns", " table", "insert ", "insert into", " migration", " text ", " integer", " default ", "schema.", " rows", "primary key", "foreign key")


def imported_modules(source: Column) -> Column:
    """The modules that a source imports, in the order of the forms; relative ones are left out."""
    lists = []
    for pattern, many in _IMPORTS:
        found = F.regexp_extract_all(source, F.lit(pattern), 1)
        lists.append(F.flatten(F.transform(found, lambda x: F.split(x, ","))) if many else found)
    return F.filter(F.transform(F.concat(*lists), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("."))


def is_database_bound(source: Column) -> Column:
    return source.rlike(_DATABASE)


def is_schema_prose(line: Column, token: Column, ambiguous) -> Column:
    """A token that may be a column's name, on a line that talks of tables."""
    return token.isin(*ambiguous) & reduce(or_, (F.contains(F.lower(line), F.lit(m)) for m in _SCHEMA_PROSE))


def is_excluded_key(key: Column) -> Column:
    """Keys of the environment and keys of one ASCII letter or digit."""
    return key.isin(*EXCLUDED_CONFIG_KEYS) | key.rlike(r"^[A-Za-z0-9]$")


def path_hint(line: Column, token: Column) -> Column:
    """The ``.py`` path of a line, else the dotted prefix of the token, else null."""
    named = F.regexp_extract(line, r"([\w./-]+\.py)\b", 1)
    return F.when(named != "", named).when(F.contains(token, F.lit(".")), F.substr(token, F.lit(1), F.length(token) - F.length(F.substring_index(token, ".", -1)) - 1))


def skipped_by_front_matter(text: Column, flag: str = "skip_doc_check") -> Column:
    """Whether the header of a document sets ``flag``."""
    return text.rlike(rf"(?is)^---\s*\n(?:(?!\n---).)*?\b{flag}\s*:\s*true\b")


def map_hash(values: Column) -> Column:
    """SHA-256 of a map's entries as k=v, sorted by key, joined by bars."""
    entries = F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.sha2(F.array_join(entries, "|"), 256)


def impact_warnings(callers: Column, ambiguous: Column) -> Column:
    """Tags that say how far the answer about a symbol's callers reaches."""
    return F.array_compact(
        F.array(
            F.lit("static_call_graph_only"),
            F.when(ambiguous, "ambiguous_symbol_multiple_matches_narrow_the_query"),
            F.when(~ambiguous & (callers == 0), "no_direct_static_callers_may_miss_dynamic_or_typed_edges"),
        )
    )
