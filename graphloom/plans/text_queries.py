"""Queries over names, routes, pages, texts and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import paths, text as T
from graphloom.operators import search as R
from graphloom.plans.registry import FUNCTIONS, Catalogue
from graphloom.plans.shared import cut
from graphloom.sources import projection as P

CATALOGUE = Catalogue()
query = CATALOGUE.query


# --- routes and pages

_ROUTE = r"lower(CASE WHEN length(r) > 1 THEN rtrim(r, '/') ELSE r END)"
_BARE = r"regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]+(/)', '\1'), '/[0-9]+', '/{id}', 'g'), '<[^>]+>|:[a-zA-Z_][a-zA-Z0-9_]*|\{[^}]+\}', '{*}', 'g')"


def _routes(spark, sf_dir):
    """Numbers in a path stand for parameters."""
    raw = F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]+(?=/)", ""), r"/[0-9]+", "/{id}")
    return P.table(spark, sf_dir, "pages").select("page_id", T.normalise_route(raw).alias("route"))


@query(f"SELECT page_id, {_ROUTE} AS route FROM (SELECT page_id, {_BARE} AS r FROM pages)")
def route_normalise(spark, sf_dir):
    return _routes(spark, sf_dir)


@query(f"""WITH n AS (SELECT page_id, {_ROUTE} AS route FROM (SELECT page_id, {_BARE} AS r FROM pages)), h AS (SELECT route, min(page_id) AS handler FROM n GROUP BY route)
SELECT route, page_id AS caller, handler, 0.85 AS confidence FROM n JOIN h USING (route) WHERE page_id <> handler""")
def http_route_join(spark, sf_dir):
    routes = cut(_routes(spark, sf_dir), "routes")
    handlers = routes.groupBy("route").agg(F.min("page_id").alias("handler"))
    return routes.join(handlers, "route").where("page_id <> handler").select("route", F.col("page_id").alias("caller"), "handler", F.lit(0.85).alias("confidence"))


@query("""SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS link FROM pages) GROUP BY 1, 2""")
def html_links(spark, sf_dir):
    return P.table(spark, sf_dir, "pages").select("page_id", F.explode(T.html_links(F.col("html"))).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("""SELECT page_id, len(bodies) AS n, sha256(array_to_string(bodies, '|')) AS digest FROM (SELECT page_id, regexp_extract_all(html, '(?is)<script\\b[^>]*>(.*?)</script>', 1) AS bodies FROM pages)""")
def html_script_bodies(spark, sf_dir):
    bodies = F.regexp_extract_all("html", F.lit(r"(?is)<script\b[^>]*>(.*?)</script>"), F.lit(1))
    return P.table(spark, sf_dir, "pages").select("page_id", F.size(bodies).cast("long").alias("n"), F.sha2(F.array_join(bodies, "|"), 256).alias("digest"))


#: Pages with what links and scripts of an application look like, named after their own addresses.
_APP = r"""app AS (SELECT page_id, html || '<a onclick="open_' || lang || '(1)">x</a><b onLoad=''return ' || host || '_ready ()''></b><script>el.addEventListener("click", go_' || lang || ')</script><script src="' || path || '/app.js?v=2#x"></script><script type="module" src="' || path || '"></script><script src="//' || host || '/far.js"></script>' AS html
  FROM (SELECT page_id, html, regexp_extract(url, '//([a-z]+)', 1) AS host, regexp_extract(url, '//[^/]+/([a-z]+)', 1) AS lang, regexp_extract(url, '//[^/]+(/[a-z]+/[0-9]+)', 1) AS path FROM pages))"""


@query(rf"""WITH {_APP}, found AS (SELECT page_id,
  list_sort(list_distinct(regexp_extract_all(html, '(?i)\son[a-z]+\s*=\s*["''][ \t]*(?:return\s+)?([A-Za-z_$][\w$]*)\s*\(', 1) || regexp_extract_all(html, 'addEventListener\(\s*["''][^"'']+["'']\s*,\s*([A-Za-z_$][\w$]*)', 1))) AS handlers,
  list_filter(regexp_extract_all(html, '(?i)<script\b[^>]*>'), lambda t: NOT regexp_matches(lower(t), 'type\s*=\s*["'']module')) AS tags FROM app),
named AS (SELECT page_id, handlers, list_transform(tags, lambda t: regexp_replace(regexp_extract(t, '(?i)\ssrc\s*=\s*["'']([^"'']+)["'']', 1), '[?#].*$', '')) AS scripts FROM found)
SELECT page_id, array_to_string(handlers, ',') AS handlers, array_to_string(list_sort(list_distinct(list_filter(scripts, lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(https?:)?//|^data:')))), ',') AS scripts FROM named""")
def html_handlers(spark, sf_dir):
    part = lambda pattern: F.regexp_extract("url", pattern, 1)
    host, lang, path = part("//([a-z]+)"), part("//[^/]+/([a-z]+)"), part("//[^/]+(/[a-z]+/[0-9]+)")
    parts = ["html", F.lit('<a onclick="open_'), lang, F.lit("(1)\">x</a><b onLoad='return "), host, F.lit("_ready ()'></b><script>el.addEventListener(\"click\", go_"), lang, F.lit(')</script><script src="'), path, F.lit('/app.js?v=2#x"></script><script type="module" src="'), path, F.lit('"></script><script src="//'), host, F.lit('/far.js"></script>')]
    app = P.table(spark, sf_dir, "pages").select("page_id", F.concat(*parts).alias("html"))
    return app.select("page_id", F.array_join(T.html_handlers(F.col("html")), ",").alias("handlers"), F.array_join(T.script_sources(F.col("html")), ",").alias("scripts"))


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(^|[ \n])([A-Za-z_]{9,})([ .,\n]|$)', '\1`\2`\3', 'g'), '(^|[ \n])([A-Za-z]{8})([ .,\n]|$)', '\1`\2()`\3', 'g') AS text FROM documents)
SELECT doc_id, array_to_string(regexp_extract_all(text, '`([A-Za-z_][\w.]*)(?:\(\))?`', 1), ',') AS tokens FROM d""")
def backtick_tokens(spark, sf_dir):
    """Documents with their longer words set in backticks."""
    marked = F.regexp_replace(F.regexp_replace("text", r"(^|[ \n])([A-Za-z_]{9,})([ .,\n]|$)", "$1`$2`$3"), r"(^|[ \n])([A-Za-z]{8})([ .,\n]|$)", "$1`$2()`$3")
    return P.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.backtick_tokens(marked), ",").alias("tokens"))


def _invariants(text):
    return F.array_join(F.transform(T.invariants(text), lambda s: F.concat_ws("=", s["kind"], s["text"])), "|")


@query()
def invariant_extract(spark, sf_dir):
    return P.table(spark, sf_dir, "documents").select("doc_id", _invariants(F.coalesce("text", F.lit(""))).alias("found"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)session\\.|\\.query\\(|\\.insert\\(|\\.update\\(|\\.delete\\(|\\.execute\\(|\\.commit\\(|\\.fetchall\\(|\\.fetchone\\(|\\.cursor\\(') THEN 'db_operation' END,
CASE WHEN regexp_matches(text, '(?i)(?:requests|httpx|aiohttp|urllib\\.request|urllib\\.urlopen)\\b') THEN 'http_call' END,
CASE WHEN regexp_matches(text, 'open\\(|\\.read\\(|\\.write\\(|\\.readlines\\(|pathlib\\.|shutil\\.') THEN 'file_io' END,
CASE WHEN regexp_matches(text, '\\bawait\\b') THEN 'async_operation' END, CASE WHEN regexp_matches(text, '(?i)websocket|ws_connect|\\.send\\(|\\.recv\\(') THEN 'websocket' END], lambda x: x IS NOT NULL), ',') AS tags FROM documents""")
def io_tags(spark, sf_dir):
    return P.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.io_tags(F.col("text")), ",").alias("tags"))


_KEYS = " || ".join("regexp_extract_all(text, '" + p.replace("'", "''") + "', 1)" for p in T.CONFIG_READS)


@query(f"""WITH k AS (SELECT unnest(json_keys(props)) AS key, 'events' AS source FROM events
  UNION ALL SELECT unnest(list_distinct({_KEYS})), 'documents' FROM documents)
SELECT key, count(*) AS usage_count, string_agg(DISTINCT source, ',' ORDER BY source) AS files FROM k GROUP BY key""")
def config_registry(spark, sf_dir):
    """The keys of all events' properties and those that all documents read, with the number of rows."""
    used = lambda name, keys: P.table(spark, sf_dir, name).select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n")).select("key", F.lit(name).alias("source"), "n")
    rows = used("events", F.json_object_keys("props")).unionByName(used("documents", T.config_keys(F.col("text"))))
    return rows.groupBy("key").agg(F.sum("n").alias("usage_count"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("files"))


@query("""WITH d AS (SELECT json_extract_string(props, '$.k') AS key, count(*) AS declared FROM events WHERE event_type <> 'purchase' GROUP BY 1),
r AS (SELECT CAST(doc_id % 37 AS VARCHAR) AS key, count(*) AS reads FROM labels GROUP BY 1)
SELECT coalesce(d.key, r.key) AS key, coalesce(declared, 0) AS declaration_count, coalesce(reads, 0) AS read_count FROM d FULL JOIN r ON d.key = r.key""")
def config_flow_outer(spark, sf_dir):
    declared = P.table(spark, sf_dir, "events").where("event_type <> 'purchase'").groupBy(F.get_json_object("props", "$.k").alias("key")).agg(F.count("*").alias("declaration_count"))
    reads = P.table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 37).cast("string").alias("key")).agg(F.count("*").alias("read_count"))
    return declared.join(reads, "key", "full").fillna(0, ["declaration_count", "read_count"])


# --- paths


@query("""SELECT page_id, CASE WHEN p LIKE '%test_%' OR p LIKE '%_test%' OR contains(p, '.test.') OR contains(p, '.spec.') OR contains(p, 'tests/') OR contains(p, 'test/') OR contains(p, '__tests__') OR contains(p, '/spec/') OR contains(p, '/specs/') THEN 'test'
  WHEN regexp_matches(p, '(^|/)(docs|documentation)/') THEN 'docs' WHEN regexp_matches(p, '(^|/)examples/') THEN 'examples' WHEN regexp_matches(p, '(^|/)(scripts?|diagnostics?|tools?|bin|dev|debug|scratch|migrations?|fixtures?)(/|$)') THEN 'scripts' WHEN regexp_matches(p, '(^|/)(numpy|click)/') THEN 'vendor' ELSE 'production' END AS category
FROM (SELECT page_id, lower(CASE page_id % 9 WHEN 0 THEN 'src/tests/' WHEN 1 THEN 'docs/' WHEN 2 THEN 'tools/' WHEN 3 THEN 'examples/' WHEN 4 THEN 'src/documentation/' WHEN 5 THEN 'doc/' WHEN 6 THEN 'example/' WHEN 7 THEN 'lib/NumPy/' ELSE 'src/' END || page_id || '.py') AS p FROM pages)""".replace("p LIKE '%test_%' OR p LIKE '%_test%'", "contains(p, 'test_') OR contains(p, '_test')"))
def path_classify(spark, sf_dir):
    top = F.element_at(F.array(*map(F.lit, ("src/tests/", "docs/", "tools/", "examples/", "src/documentation/", "doc/", "example/", "lib/NumPy/", "src/"))), (F.col("page_id") % 9 + 1).cast("int"))
    rows = P.table(spark, sf_dir, "pages").select("page_id", F.concat(top, F.col("page_id").cast("string"), F.lit(".py")).alias("path"))
    return rows.select("page_id", paths.classify_path(F.col("path"), vendored=("numpy", "click")).alias("category"))


_URL_PARTS = "string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/')"


def _bare_paths(spark, sf_dir):
    return P.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[?#].*$", "").alias("path"))


@query(f"SELECT page_id, array_to_string(list_slice(parts, 1, n), '/') AS prefix FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT page_id, {_URL_PARTS} AS parts FROM pages))")
def path_prefix_explode(spark, sf_dir):
    return _bare_paths(spark, sf_dir).select("page_id", F.explode(paths.prefixes(F.col("path"))).alias("prefix"))


@query(f"""WITH s AS (SELECT page_id, array_to_string(list_slice(parts, n, len(parts)), '/') AS suffix FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT page_id, {_URL_PARTS} AS parts FROM pages)))
SELECT suffix, min(page_id) AS page_id FROM (SELECT DISTINCT suffix, page_id FROM s) GROUP BY suffix HAVING count(*) = 1""")
def suffix_unique_join(spark, sf_dir):
    from graphloom.operators.resolve import unique_suffixes

    return unique_suffixes(_bare_paths(spark, sf_dir), "path", "page_id")


@query(f"""WITH p AS (SELECT page_id, n, array_to_string(list_slice(parts, 1, n), '/') AS prefix FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT page_id, {_URL_PARTS} AS parts FROM pages))),
i AS (SELECT prefix FROM p GROUP BY prefix HAVING count(*) >= 2)
SELECT page_id, max_by(prefix, n) AS prefix FROM p JOIN i USING (prefix) GROUP BY page_id""")
def longest_prefix_join(spark, sf_dir):
    from graphloom.operators.resolve import longest_prefix

    rows = cut(_bare_paths(spark, sf_dir), "paths")
    index = rows.select(F.explode(paths.prefixes(F.col("path"))).alias("prefix")).groupBy("prefix").count().where("count >= 2").select("prefix")
    return longest_prefix(rows, "path", index, "prefix").select("page_id", "prefix")


# --- names and hashes


@query(f"WITH {FUNCTIONS} SELECT 'function:' || file_path || ':' || qualified_name AS id, substr(sha256(name), 1, 16) AS short, sha256(name) AS full_hash, substr(md5(name), 1, 8) AS bucket FROM fn")
def hash_ids(spark, sf_dir):
    fn = P.functions(spark, sf_dir)
    return fn.select(T.node_id("function", F.col("file_path"), F.col("qualified_name")).alias("id"), T.sha(F.col("name"), 16).alias("short"), T.sha(F.col("name")).alias("full_hash"), F.substring(F.md5("name"), 1, 8).alias("bucket"))


@query("""SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z0-9_]', '_', 'g') AS node, 'def ' || p_name || '(self, size)' AS signature,
CASE WHEN contains(lower(p_type), 'db') OR contains(lower(p_type), 'model') THEN 'db_write' WHEN contains(lower(p_type), 'api') THEN 'http_response' ELSE 'return' END AS terminal, CAST(floor(length(p_name) / 4.0) AS BIGINT) AS tokens FROM part""")
def name_functions(spark, sf_dir):
    fn = P.functions(spark, sf_dir)
    return fn.select("id", T.diagram_id(F.lower("name")).alias("node"), T.normalise_signature(F.col("signature")).alias("signature"), T.terminal_type(F.col("module")).alias("terminal"), T.token_estimate(F.col("name")).alias("tokens"))


@query(r"""WITH n AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'handle' WHEN p_size % 3 = 1 THEN 'on_' ELSE '' END || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '') AS name, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '') || 'API' AS owner FROM part)
SELECT p_partkey AS id, trim(lower(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '_') AS snake,
  lower(regexp_replace(owner, '([a-z0-9])([A-Z])', '\1_\2', 'g')) || '_' || trim(regexp_replace(lower(name), '^(handle_?|on_?|do_?|run_?)', ''), '_') || '_flow' AS pathway FROM n""")
def pathway_names(spark, sf_dir):
    size, camel = F.col("p_size"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    name = F.concat(F.when(size % 3 == 0, "handle").when(size % 3 == 1, "on_").otherwise(""), camel)
    return P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.camel_to_snake(name).alias("snake"), T.pathway_name(name, F.concat(camel, F.lit("API.run"))).alias("pathway"))


@query("""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: length(x) >= 2) AS w FROM benchmark),
e AS (SELECT item_id, w[i] AS word, min(i) AS pos FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) GROUP BY 1, 2)
SELECT item_id, string_agg(word, ' ' ORDER BY pos) AS tokens FROM e GROUP BY item_id""")
def query_tokenise(spark, sf_dir):
    return P.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.tokenise(F.col("text")), " ").alias("tokens"))


@query("""SELECT doc_id, count(*) AS tokens, count(DISTINCT t) AS distinct_tokens FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]+')) AS t FROM documents) GROUP BY 1""")
def doc_symbol_tokens(spark, sf_dir):
    found = P.table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]+"), F.lit(0)).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens")).where("tokens > 0")


@query("""WITH c AS (SELECT conv_id, turn, unnest(range(1, len(w) + 1)) AS k, w FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), ' ') AS w FROM conversations WHERE role = 'user')),
p AS (SELECT conv_id, turn, unnest(range(1, len(w) + 1)) AS k, w FROM (SELECT conv_id, turn - 1 AS turn, string_split(coalesce(text, ''), ' ') AS w FROM conversations WHERE role = 'assistant'))
SELECT c.conv_id, c.turn, c.k - 1 AS position, c.w[c.k] AS argument, p.w[p.k] AS parameter FROM c JOIN p ON c.conv_id = p.conv_id AND c.turn = p.turn AND c.k = p.k""")
def positional_argument_bind(spark, sf_dir):
    from graphloom.operators.resolve import bind_positions

    talk = P.table(spark, sf_dir, "conversations").withColumn("words", F.split(F.coalesce("text", F.lit("")), " ", -1))
    arguments = talk.where("role = 'user'").select("conv_id", "turn", F.col("words").alias("argument"))
    parameters = talk.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("words").alias("parameter"))
    return bind_positions(arguments, parameters, ["conv_id", "turn"])


# --- search


@query("""WITH s AS (SELECT doc_id, lower(text) AS t, source FROM documents), k AS (SELECT doc_id,
  CASE WHEN contains(t, 'the') THEN 1 + 0.1 * ((length(t) - length(replace(t, 'the', ''))) / 3.0 - 1) ELSE 0 END + CASE WHEN contains(t, 'ing') THEN 1 + 0.1 * ((length(t) - length(replace(t, 'ing', ''))) / 3.0 - 1) ELSE 0 END AS score FROM s)
SELECT doc_id, round(score, 6) AS score FROM k WHERE score > 0 ORDER BY 2 DESC, 1 LIMIT 50""")
def keyword_score(spark, sf_dir):
    return R.keyword(P.table(spark, sf_dir, "documents"), "the ing", "source", F.col("text"), "doc_id", 50)


_SIM = "greatest(1 - levenshtein('{q}', lower(name)) / greatest(length(name), {n}), 1 - levenshtein('{q}', lower(name)) / greatest(length(name), {n}))"


@query(f"WITH {FUNCTIONS}, s AS (SELECT id, round({_SIM.format(q='blue widgit', n=11)}, 6) AS score FROM fn) SELECT id, score FROM s WHERE score >= 0.5 ORDER BY score DESC, id LIMIT 10")
def fuzzy_search(spark, sf_dir):
    return R.fuzzy(P.functions(spark, sf_dir), "blue widgit", "name", "qualified_name", "id")


_QUERY = [round(((i * 37) % 11 - 5) / 5, 1) for i in range(64)]
_DOT = f"list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * ({_QUERY}::DOUBLE[])[i]))"


@query(f"SELECT vec_id, round({_DOT} / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) * {sum(x * x for x in _QUERY) ** 0.5!r} + 1e-9), 6) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 10")
def cosine_search(spark, sf_dir):
    return R.semantic(P.table(spark, sf_dir, "embeddings"), _QUERY, "embedding", "vec_id")


@query(f"""WITH {FUNCTIONS}, kw AS (SELECT id, round(CASE WHEN contains(lower(name), 'red') THEN 1.5 + 0.1 * ((length(name) - length(replace(lower(name), 'red', ''))) / 3.0 - 1) ELSE 0 END, 6) AS score FROM fn WHERE contains(lower(name), 'red') ORDER BY 2 DESC, 1 LIMIT 20),
fz AS (SELECT id, round({_SIM.format(q='red', n=3)}, 6) AS score FROM fn WHERE {_SIM.format(q='red', n=3)} >= 0.2 ORDER BY 2 DESC, 1 LIMIT 20),
u AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS w FROM kw UNION ALL SELECT id, 0.8 / (60 + row_number() OVER (ORDER BY score DESC, id)) FROM fz)
SELECT id, round(sum(w), 8) AS score FROM u GROUP BY id ORDER BY 2 DESC, 1 LIMIT 10""")
def rrf_hybrid(spark, sf_dir):
    fn = P.functions(spark, sf_dir)
    lists = {"keyword": R.keyword(fn, "red", "name", F.col("name"), "id", 20), "fuzzy": R.fuzzy(fn, "red", "name", "qualified_name", "id", 20, threshold=0.2)}
    return R.fuse(lists, "id")


@query(f"""WITH {FUNCTIONS} SELECT id, qualified_name, CAST(CASE WHEN qualified_name = 'red' THEN 0 WHEN lower(qualified_name) = 'red' THEN 1 WHEN name = 'red' THEN 2 WHEN lower(name) = 'red' THEN 3 WHEN lower(qualified_name) LIKE 'red%' THEN 4 WHEN lower(name) LIKE 'red%' THEN 5 ELSE 6 END AS INTEGER) AS rank
FROM fn WHERE contains(lower(name), 'red') OR contains(lower(qualified_name), 'red') ORDER BY rank, length(qualified_name), qualified_name, id LIMIT 10""")
def match_rank_search(spark, sf_dir):
    return R.by_name(P.functions(spark, sf_dir), "red")


@query("""WITH s AS (SELECT doc_id, CASE WHEN contains(lower(text), 'the ') AND contains(lower(text), 'ing') THEN 0.6 WHEN contains(lower(text), 'the ') OR contains(lower(text), 'ing') THEN 0.4 ELSE 0 END AS score FROM documents) SELECT doc_id, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0""".replace("'the '", "'the'"))
def pathway_text_match(spark, sf_dir):
    return P.table(spark, sf_dir, "documents").select("doc_id", R.match_text("the ing", F.col("source"), F.col("text")).alias("score")).where("score > 0")


@query(f"""WITH {FUNCTIONS} SELECT 'exact_name' AS strategy, CASE WHEN count(*) OVER () = 1 THEN 'match' ELSE 'ambiguous' END AS kind, id FROM fn WHERE name = (SELECT min(p_name) FROM part)""".replace("'exact_name'", "'name'"))
def identifier_cascade(spark, sf_dir):
    fn = P.functions(spark, sf_dir)
    return R.resolve(fn, fn.agg(F.min("name")).first()[0])


# --- layers

_MODULES = ("sqlalchemy.orm", "flask", "react", "celery.task", "json", "app._private.x", "app.domain.order")
_DIRECTORIES = ("app/models/", "app/routes/", "web/pages/", "app/services/", "app/utils/", "models/", "app/")


def _layered(spark, sf_dir):
    pick = lambda values, step: F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("page_id") / step) % len(values) + 1).cast("int"))
    pages = P.table(spark, sf_dir, "pages").select("page_id", F.concat(pick(_DIRECTORIES, 1), F.col("page_id").cast("string"), F.lit(".py")).alias("path"), pick(_MODULES, 7).alias("module_path"))
    imports = pages.select(F.col("path").alias("file_path"), "module_path", F.lit(1).cast("long").alias("line_number"))
    return pages.select("path").withColumn("is_test", F.lit(False)), imports


_LAYERED = (
    f"l AS (SELECT page_id, ({list(_DIRECTORIES)!r})[page_id % 7 + 1] AS d, ({list(_MODULES)!r})[(page_id // 7) % 7 + 1] AS m FROM pages), "
    "k AS (SELECT d || page_id || '.py' AS path, m AS module_path, CASE m WHEN 'sqlalchemy.orm' THEN 'persistence' WHEN 'flask' THEN 'api' WHEN 'react' THEN 'ui' WHEN 'celery.task' THEN 'business_logic' END AS by_import, "
    "CASE d WHEN 'app/models/' THEN 'persistence' WHEN 'app/routes/' THEN 'api' WHEN 'web/pages/' THEN 'ui' WHEN 'app/services/' THEN 'business_logic' WHEN 'app/utils/' THEN 'util' END AS by_path, "
    "CASE d WHEN 'app/models/' THEN 'model' WHEN 'app/routes/' THEN 'handler' WHEN 'web/pages/' THEN 'page' WHEN 'app/services/' THEN 'service' WHEN 'app/utils/' THEN 'util' ELSE 'unknown' END AS role FROM l)"
)


@query(f"WITH {_LAYERED} SELECT path, coalesce(by_import, by_path, 'unknown') AS layer, role FROM k")
def layer_classification(spark, sf_dir):
    from graphloom.operators import layers

    return layers.classify(*_layered(spark, sf_dir)).select("path", "layer", "role")


@query(f"""WITH {_LAYERED}, f AS (SELECT *, coalesce(by_path, 'unknown') AS layer FROM k)
SELECT 'ui_to_db_shortcut' AS kind, 'high' AS severity, path, module_path FROM f WHERE layer = 'ui' AND by_import = 'persistence'
UNION ALL SELECT 'api_to_db_shortcut', 'high', path, module_path FROM f WHERE layer = 'api' AND by_import = 'persistence'
UNION ALL SELECT 'ui_domain_bypass', 'low', path, module_path FROM f WHERE layer = 'ui' AND module_path = 'app.domain.order'
UNION ALL SELECT 'private_surface_bypass', 'medium', path, module_path FROM f WHERE module_path = 'app._private.x'""")
def boundary_findings(spark, sf_dir):
    from graphloom.operators import layers

    files, imports = _layered(spark, sf_dir)
    by_path = files.withColumn("layer", F.coalesce(layers.layer_of_path(F.col("path")), F.lit("unknown")))
    return layers.boundary_findings(by_path, imports)


# --- nested values and ignore files


_SCALARS = r"""json AS MATERIALIZED (SELECT click_id, props FROM clicks WHERE json_valid(props)),
s AS (SELECT click_id, t.fullkey AS path, t.key AS key, t.type AS kind, t.atom ->> '$' AS value FROM json, json_tree(json.props) AS t WHERE t.type NOT IN ('OBJECT', 'ARRAY'))"""


def _clicks(spark, sf_dir):
    from graphloom.operators import nested

    return nested.scalars(P.table(spark, sf_dir, "clicks"), ["click_id"], F.col("props"))


@query(f"WITH {_SCALARS} SELECT click_id, path, key, value FROM s")
def json_scalars(spark, sf_dir):
    return _clicks(spark, sf_dir).select("click_id", "path", "key", "value")


@query(f"WITH {_SCALARS} SELECT regexp_replace(path, '\\[\\d+\\]', '[]', 'g') AS path, count(*) AS n, count(DISTINCT value) AS n_values, min(value) AS least, max(value) AS greatest FROM s GROUP BY 1")
def json_paths(spark, sf_dir):
    bare = F.regexp_replace("path", r"\[\d+\]", "[]")
    return _clicks(spark, sf_dir).groupBy(bare.alias("path")).agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"), F.min("value").alias("least"), F.max("value").alias("greatest"))


#: Ignore files over the paths of pages: (folder, lines).
_IGNORES = (
    ("", ("# pages of a second kind", "", "*.html", "!/m.*/**/*.html", "blog.*/de/", "/*.example.net/fr", "**/[2-4]??", "!5[0-4]?")),
    ("thther.example.org", ("en/", "!*")),
    ("blog.tiontion.example.com/en", ("*", "!8*")),
)


@query(r"""WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/$', '') AS path FROM pages),
steps AS (SELECT path, array_to_string(part[1:n], '/') AS item, n < len(part) AS folder, part[1] AS host, part[2] AS lang, part[n] AS name, n
  FROM (SELECT path, string_split(path, '/') AS part, unnest(range(1, len(string_split(path, '/')) + 1)) AS n FROM p)),
judged AS (SELECT path, CASE
  WHEN host = 'blog.tiontion.example.com' AND lang = 'en' AND n > 2 THEN NOT regexp_matches(name, '^8')
  WHEN host = 'thther.example.org' AND n > 1 THEN false
  WHEN regexp_matches(name, '^5[0-4].$') THEN false
  WHEN regexp_matches(name, '^[2-4]..$') THEN true
  WHEN n = 2 AND regexp_matches(host, '\.example\.net$') AND lang = 'fr' THEN true
  WHEN folder AND n = 2 AND regexp_matches(host, '^blog\.') AND lang = 'de' THEN true
  WHEN n > 1 AND regexp_matches(host, '^m\.') AND regexp_matches(name, '\.html$') THEN false
  ELSE regexp_matches(name, '\.html$') END AS out FROM steps)
SELECT DISTINCT path FROM judged WHERE out""".replace("\\\\", "\\"))
def ignored_paths(spark, sf_dir):
    from graphloom.operators import ignore

    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[?#].*$", ""), "/$", "")
    lines = spark.createDataFrame([(folder, i, line) for folder, body in _IGNORES for i, line in enumerate(body)], "folder string, line_no int, line string")
    return ignore.ignored(P.table(spark, sf_dir, "pages").select(bare.alias("path")), ignore.rules(lines))


#: Documents as Markdown: words of seven letters in backticks, their source as a path on every line, a fence before each line that begins with A or E, a mark before those with L.
@query(r"""WITH md AS (SELECT CAST(doc_id AS VARCHAR) AS path, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(^|[ \n])([a-z]{7})([ .,\n]|$)', '\1`\2`\3', 'g'),
    '\n', ' in ' || source || '.py' || chr(10), 'g'), '(^|\n)([AE])', '\1```' || chr(10) || '\2', 'g'), '(^|\n)(L)', '\1<!-- examples-only -->' || chr(10) || '\2', 'g') AS text FROM documents),
line AS (SELECT path, n, lines[n] AS line FROM (SELECT path, lines, unnest(range(1, len(lines) + 1)) AS n FROM (SELECT path, string_split(text, chr(10)) AS lines FROM md))),
state AS (SELECT *, regexp_matches(line, '^\s*```') AS fence, coalesce(sum(CAST(regexp_matches(line, '^\s*```') AS INT)) OVER b, 0) % 2 = 1 AS fenced,
    min(CASE WHEN regexp_matches(line, '\S') THEN n END) OVER a AS next_text, min(CASE WHEN regexp_matches(line, '^\s*```') THEN n END) OVER a AS next_fence, min(CASE WHEN NOT regexp_matches(line, '\S') THEN n END) OVER a AS next_blank
  FROM line WINDOW b AS (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY path ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
block AS (SELECT m.path, m.n AS mark, s.n AS first, CASE WHEN s.fence THEN coalesce(s.next_fence, 1000000000) ELSE coalesce(s.next_blank - 1, 1000000000) END AS last
  FROM state m JOIN state s ON s.path = m.path AND s.n = m.next_text WHERE contains(m.line, '<!-- examples-only -->')),
kept AS (SELECT path, list_reduce(list({'mark': mark, 'first': first, 'last': last} ORDER BY mark), lambda out, x: CASE WHEN x.mark > out[len(out)].last THEN list_append(out, x) ELSE out END, [{'mark': 0::BIGINT, 'first': 0::BIGINT, 'last': -1::BIGINT}]) AS blocks FROM block GROUP BY path),
token AS (SELECT path, n, line, unnest(regexp_extract_all(line, '`([^`\n]+)`', 1)) AS token, regexp_extract(line, '(\w[\w/.-]+\.py)\b', 1) AS hint FROM state LEFT JOIN kept USING (path)
  WHERE NOT fenced AND (blocks IS NULL OR len(list_filter(blocks, lambda x: n BETWEEN x.first AND x.last)) = 0)),
symbol AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{7}')) AS name, source || '.py' AS file FROM documents WHERE lang = 'en')
SELECT DISTINCT path, n AS line_number, token AS symbol, 'moved_reference' AS kind FROM token
WHERE hint <> '' AND token IN (SELECT name FROM symbol) AND NOT EXISTS (SELECT 1 FROM symbol WHERE name = token AND contains(file, hint))""")
def doc_warnings(spark, sf_dir):
    from graphloom.operators import doc_warnings as D

    docs = P.table(spark, sf_dir, "documents")
    marked = F.regexp_replace("text", r"(^|[ \n])([a-z]{7})([ .,\n]|$)", "$1`$2`$3")
    hinted = F.regexp_replace(marked, F.lit("\n"), F.concat(F.lit(" in "), "source", F.lit(".py\n")))
    fenced = F.regexp_replace(F.regexp_replace(hinted, r"(^|\n)([AE])", "$1```\n$2"), r"(^|\n)(L)", f"$1{D.EXAMPLES}\n$2")
    name = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{7}"), F.lit(0)))).alias("name")
    symbols = docs.where("lang = 'en'").select(name, F.concat("source", F.lit(".py")).alias("file_path")).distinct().withColumn("qualified_name", F.col("name"))
    found = D.warnings(cut(docs.select(F.col("doc_id").cast("string").alias("path"), fenced.alias("text")), "marked-documents"), symbols)
    return found.select("path", "line_number", "symbol", "kind")


@query(r"""SELECT url, CASE WHEN regexp_matches(path, '/route\.(ts|js)$') THEN '/' || trim(regexp_replace(regexp_replace(path, '^app/', ''), '/?route\.(ts|js)$', ''), '/') END AS route
FROM (SELECT url, 'app' || regexp_extract(url, '^https?://[^/]+(/[a-z]+/[0-9]+)', 1) || CASE WHEN contains(url, '#') THEN '/page.tsx' WHEN contains(url, '?') THEN '/route.js' ELSE '/route.ts' END AS path FROM pages)""")
def file_routes(spark, sf_dir):
    from graphloom.operators.frameworks import file_route

    kind = F.when(F.contains("url", F.lit("#")), "/page.tsx").when(F.contains("url", F.lit("?")), "/route.js").otherwise("/route.ts")
    path = F.concat(F.lit("app"), F.regexp_extract("url", "^https?://[^/]+(/[a-z]+/[0-9]+)", 1), kind)
    return P.table(spark, sf_dir, "pages").select("url", file_route(path).alias("route"))
