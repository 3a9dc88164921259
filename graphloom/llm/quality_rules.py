"""Quality rules whose cutoffs follow the data.

Counts of each text give ratios; each ratio gets a quantile sketch per language
and source: logarithmic bins with counts, whose relative error is bounded and
whose merge is the sum of counts. Sketches of small groups are replaced by the
merged sketch of the language, then of all rows. The thresholds are fences
around the quartiles; joined back to the rows they decide what is kept.

Defined results: a null text has no words and fails the base rule; null
languages and sources are groups of their own; a ratio over nothing is 0; a text
equal to another gets the same verdict within its group; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.store import cut, slices

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
_WORD = re.compile(r"[^\x20\x09-\x0D]")
_STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``_STATS``.

    Words are runs without ASCII white space; lines are cut at line feeds and count if they
    hold a word; a repeated word stands in a window of three words found twice or more.
    """
    if not text:
        return (0,) * len(_STATS)
    data = text.encode()
    words = data.split()
    n = len(words)
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line in seen:
            lines += 1
            dups += 1
        elif _WORD.search(line):
            lines += 1
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        once: dict[tuple, int] = {}
        covered = bytearray(n)
        for i, w in enumerate(windows):
            first = once.setdefault(w, i)
            if first != i:
                covered[first : first + 3] = covered[i : i + 3] = b"\1\1\1"
        repeated = covered.count(1)
    gone = lambda chars: len(data) - len(data.translate(None, chars))
    return (n, len(text) - gone(_BLANK), gone(_SYMBOLS), lines, dups, repeated, gone(_UPPER))


@dataclass(frozen=True)
class Rule:
    """A ratio, which sides of its fence are refused, and the slack that no fence goes below."""

    name: str
    over: str
    under: str
    upper: bool = True
    lower: bool = False
    slack: float = 0.05


RULES = (
    Rule("symbol_share", "n_symbols", "word_chars", slack=0.05),
    Rule("repeat_share", "n_repeat_words", "n_words", slack=0.2),
    Rule("dup_line_share", "n_dup_lines", "n_lines", slack=0.2),
    Rule("upper_share", "n_upper", "word_chars", slack=0.1),
    Rule("word_length", "word_chars", "n_words", lower=True, slack=1.5),
)
#: Rows from which a group stands on its own; growth of the sketch's bins; fence in quartile ranges.
LEAST, GROWTH, FENCE = 200, 1.05, 3.0
_TINY = 1e-6
#: Groups whose limits are sent to every task at most: some hundred bytes each.
BROADCAST = 20_000


def _ratio(rule: Rule) -> Column:
    return F.when(F.col(rule.under) > 0, F.col(rule.over) / F.col(rule.under)).otherwise(0.0)


def sketch(values: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, rule, bin, n): the mergeable sketch of ``value``; bin null holds the values next to zero."""
    place = F.when(F.col("value") > _TINY, F.ceil(F.log(F.col("value")) / F.log(F.lit(GROWTH))))
    return values.groupBy(*by, "rule", place.alias("bin")).agg(F.count("*").alias("n"))


def quantiles(sketched: DataFrame, by: list[str], points: dict[str, float]) -> DataFrame:
    """(``by``, rule, rows, a column per point): the quantiles that a sketch holds."""
    group = Window.partitionBy(*by, "rule")
    run = group.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("bin").isNull(), 0.0).otherwise(2.0 * F.pow(F.lit(GROWTH), F.col("bin")) / (1.0 + GROWTH))
    walked = sketched.select(*by, "rule", value.alias("value"), F.sum("n").over(run).alias("to"), F.sum("n").over(group).alias("rows"))
    picks = [F.min(F.when(F.col("to") >= F.lit(q) * F.col("rows"), F.col("value"))).alias(name) for name, q in points.items()]
    return walked.groupBy(*by, "rule").agg(F.max("rows").alias("rows"), *picks)


def thresholds(counted: DataFrame) -> DataFrame:
    """(lang, source, limits): for each group a map from rule to its lowest and highest value."""
    values = counted.select("lang", "source", F.inline(F.array(*(F.struct(F.lit(r.name).alias("rule"), _ratio(r).alias("value")) for r in RULES))))
    points = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    # a row per group, rule and bin; the wider sketches are merged from it
    fine = cut(sketch(values, ["lang", "source"]), "rule-sketches")
    merge = lambda by: quantiles(fine.groupBy(*by, "rule", "bin").agg(F.sum("n").alias("n")), by, points)
    name = lambda df, p: df.select(*[c for c in df.columns if c not in ("rows", *points)], *(F.col(c).alias(f"{p}_{c}") for c in ("rows", *points)))
    own, lang, every = name(merge(["lang", "source"]), "own"), name(merge(["lang"]), "lang"), name(merge([]), "all")
    both = own.join(lang, ["lang", "rule"]).join(every, ["rule"])
    pick = lambda c: F.when(F.col("own_rows") >= LEAST, F.col(f"own_{c}")).when(F.col("lang_rows") >= LEAST, F.col(f"lang_{c}")).otherwise(F.col(f"all_{c}"))
    slack = F.create_map(*(F.lit(x) for r in RULES for x in (r.name, r.slack)))
    reach = F.greatest((pick("q3") - pick("q1")) * FENCE, F.element_at(slack, F.col("rule")))
    # the quartile range of a group that junk has taken over says little: no fence beyond the middle value and twice its reach
    wide = F.least(reach, F.greatest(pick("q2"), F.element_at(slack, F.col("rule"))) * 2)
    limits = both.select("lang", "source", "rule", (pick("q1") - wide).alias("low"), (pick("q3") + wide).alias("high"))
    return limits.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("rule", F.struct("low", "high")))).alias("limits"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(``key``, counts, ``base_failed``, ``failed`` rules, ``kept``) for each row of ``docs``."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for part in slices(batches, "text"):
            got = list(zip(*map(measure, part.column("text").to_pylist()), strict=True))
            yield pa.record_batch([*(part.column(c) for c in ("key", "lang", "source")), *(pa.array(x, pa.int64()) for x in got)], ["key", "lang", "source", *_STATS])

    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00none"))
    rows = docs.select(F.col(key).alias("key"), name(lang).alias("lang"), name(source).alias("source"), F.col(text).cast("string").alias("text"))
    counted = cut(rows.mapInArrow(run, f"key {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in _STATS)), "rule-counts")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # thresholds come from rows that the base rule keeps; a group without any has no limits of its own and loses nothing here
    limits = cut(thresholds(counted.where(~base)), "rule-limits")
    # a row per language and source: sent to every task while they are few, and the hot source stays where it is; otherwise the optimizer decides
    few = limits.limit(BROADCAST + 1).count() <= BROADCAST
    joined = counted.join(F.broadcast(limits) if few else limits, ["lang", "source"], "left")

    def breaks(rule: Rule) -> Column:
        limit = F.col("limits")[rule.name]
        parts = [x for x in (_ratio(rule) > limit["high"] if rule.upper else None, _ratio(rule) < limit["low"] if rule.lower else None) if x is not None]
        return F.when(parts[0] if len(parts) == 1 else parts[0] | parts[1], F.lit(rule.name))

    failed = F.array_compact(F.array(*map(breaks, RULES)))
    return joined.select(F.col("key").alias(key), *_STATS, base.alias("base_failed"), failed.alias("failed"), (~base & (F.size(failed) == 0)).alias("kept"))
