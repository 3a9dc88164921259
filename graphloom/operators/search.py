"""Search over functions, texts and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T

# Weight of each list and the constant of rank fusion.
WEIGHTS = {"keyword": 1.0, "fuzzy": 0.8, "semantic": 1.2, "pathway": 0.9}
RRF_K = 60


def occurrences(text: Column, term: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)


def keyword_score(terms: list[str], name: Column, text: Column) -> Column:
    """Per term that occurs: 1, 0.1 for each further occurrence, 0.5 if it is in the name."""
    out = F.lit(0.0)
    for term in terms:
        n = occurrences(text, term)
        out = out + F.when(n > 0, 1 + 0.1 * (n - 1) + F.when(F.contains(F.lower(name), F.lit(term)), 0.5).otherwise(0.0)).otherwise(0.0)
    return out


def keyword(rows: DataFrame, query: str, name: str, text: Column, key: str, limit: int | None = 10) -> DataFrame:
    """The best rows for the query's words: one scan, then a top-k."""
    terms = query.lower().split()
    scored = rows.select(key, F.round(keyword_score(terms, F.col(name), F.lower(text)), 6).alias("score")).where("score > 0")
    return _top(scored, key, limit)


def fuzzy(rows: DataFrame, query: str, name: str, qualified: str, key: str, limit: int | None = 10, threshold: float = 0.5) -> DataFrame:
    """Names by edit similarity: the better of the name and the last part of the qualified name."""
    q = F.lit(query.lower())
    best = F.greatest(T.similarity(q, F.lower(name)), T.similarity(q, F.lower(T.last_part(F.col(qualified)))))
    return _top(rows.select(key, F.round(best, 6).alias("score")).where(F.col("score") >= threshold), key, limit)


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (norm(a) * norm(b) + 1e-9)


def semantic(rows: DataFrame, query: list[float], vector: str, key: str, limit: int | None = 10) -> DataFrame:
    """Exact nearest rows by cosine; the query is a literal, so the scan needs no join."""
    return _top(rows.select(key, F.round(cosine(F.col(vector), F.array(*map(F.lit, query))), 6).alias("score")), key, limit)


def _top(scored: DataFrame, key: str, limit: int | None) -> DataFrame:
    ordered = scored.orderBy(F.desc("score"), key)
    return ordered if limit is None else ordered.limit(limit)


def fuse(lists: dict[str, DataFrame], key: str, limit: int = 10, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Rank fusion: the sum of weight / (60 + rank + 1), ranks from 0. Each list is a bounded top-k."""
    parts = None
    for name, df in lists.items():
        rank = F.row_number().over(Window.orderBy(F.desc("score"), key))  # a list of a few rows
        part = df.select(key, (F.lit(weights[name]) / (RRF_K + rank)).alias("w"))
        parts = part if parts is None else parts.unionByName(part)
    return _top(parts.groupBy(key).agg(F.round(F.sum("w"), 8).alias("score")), key, limit)


def match_rank(query: str, name: Column, qualified: Column) -> Column:
    """0 to 6: exact and then case-blind equality of the qualified and the plain name, prefixes, the rest."""
    low = query.lower()
    return (
        F.when(qualified == query, 0).when(F.lower(qualified) == low, 1).when(name == query, 2).when(F.lower(name) == low, 3)
        .when(F.startswith(F.lower(qualified), F.lit(low)), 4).when(F.startswith(F.lower(name), F.lit(low)), 5).otherwise(6)
    )


def by_name(rows: DataFrame, query: str, key: str = "id", limit: int = 10) -> DataFrame:
    low = F.lit(query.lower())
    hit = rows.where(F.contains(F.lower("name"), low) | F.contains(F.lower("qualified_name"), low))
    ranked = hit.withColumn("rank", match_rank(query, F.col("name"), F.col("qualified_name")))
    return ranked.orderBy("rank", F.length("qualified_name"), "qualified_name", key).limit(limit).select(key, "qualified_name", "rank")


def resolve(rows: DataFrame, text: str, key: str = "id") -> DataFrame:
    """(strategy, kind, key): the rows of the first kind of match that has any; several are ambiguous."""
    plain = text.strip().removesuffix("()").replace("::", ".").replace("#", ".")
    tier = (
        F.when(F.col("file_path") == text, 0).when(F.col("qualified_name") == text, 1).when(F.col("name") == text, 2)
        .when(F.col("qualified_name") == plain, 3).when(F.contains(F.lower("qualified_name"), F.lit(plain.lower())), 4)
    )
    found = rows.select(key, tier.alias("tier")).where("tier IS NOT NULL")
    first = found.join(found.agg(F.min("tier").alias("tier")), "tier")  # one row
    names = F.element_at(F.array(*map(F.lit, ("file", "qualified_name", "name", "normalised", "fuzzy"))), F.col("tier") + 1)
    n = F.count("*").over(Window.partitionBy("tier"))
    return first.select(names.alias("strategy"), F.when(F.col("tier") == 0, "file").when(n == 1, "match").otherwise("ambiguous").alias("kind"), key)


def match_text(query: str, name: Column, text: Column) -> Column:
    """1.0 for the name itself, 0.8 in the name, 0.6 for all words, 0.4 for any word in the text."""
    words = query.lower().split()
    has = [F.contains(F.lower(text), F.lit(w)) for w in words]
    every = any_ = None
    for h in has:
        every, any_ = (h, h) if every is None else (every & h, any_ | h)
    out = F.when(F.lower(name) == query.lower(), 1.0).when(F.contains(F.lower(name), F.lit(query.lower())), 0.8)
    return (out.when(every, 0.6).when(any_, 0.4) if words else out).otherwise(0.0)
