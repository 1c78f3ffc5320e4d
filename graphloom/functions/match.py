"""Scoring one text against one query, and highlighting the hit."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession, functions as F

from graphloom.functions.fuzzy import reachable, similarity

MATCH = "struct<score:double,match_type:string,start:int,end:int>"


def valid_pattern(spark: SparkSession, pattern: str) -> bool:
    """Whether Spark accepts the pattern; a bad one must not fail the whole job."""
    try:
        spark.range(1).select(F.regexp_like(F.lit(""), F.lit(pattern))).collect()
        return True
    except PySparkException:
        return False


def match_text(
    text: Column,
    query: str,
    *,
    case_sensitive: bool = False,
    use_regex: bool = False,
    fuzzy: bool = False,
    fuzzy_threshold: float = 0.6,
) -> Column:
    """Best match of a query in a text as MATCH, null when there is none.

    Exact (1.0) goes before regex (0.9), contains (0.8) and fuzzy (ratio x 0.7).
    The Python ratio only sees texts that no earlier branch took and whose lengths, characters and
    runs can reach the threshold at all; ``may_be_fuzzy`` says which these are.
    """
    if not query:
        return F.lit(None).cast(MATCH)
    result = _literal(text, query, case_sensitive, use_regex)[0]
    if fuzzy:
        candidate = F.when(may_be_fuzzy(text, query, case_sensitive, use_regex, fuzzy_threshold), _seen(text, case_sensitive))
        ratio = similarity(candidate, F.lit(query if case_sensitive else query.lower()))
        result = result.when(ratio >= fuzzy_threshold, _hit(ratio * 0.7, "fuzzy"))
    return result


def may_be_fuzzy(text: Column, query: str, case_sensitive: bool = False, use_regex: bool = False, fuzzy_threshold: float = 0.6) -> Column:
    """Whether only the ratio can tell if a text matches; never null."""
    if not query:
        return F.lit(False)
    found = _literal(text, query, case_sensitive, use_regex)[1]
    near = reachable(_seen(text, case_sensitive), query if case_sensitive else query.lower(), fuzzy_threshold)
    return F.coalesce((text != "") & ~found & near, F.lit(False))


def _seen(text: Column, case_sensitive: bool) -> Column:
    return text if case_sensitive else F.lower(text)


def _hit(score, kind, start=None, end=None) -> Column:
    return F.struct(
        (score if isinstance(score, Column) else F.lit(score)).cast("double").alias("score"),
        F.lit(kind).alias("match_type"),
        (F.lit(None) if start is None else start).cast("int").alias("start"),
        (F.lit(None) if end is None else end).cast("int").alias("end"),
    )


def _literal(text: Column, query: str, case_sensitive: bool, use_regex: bool) -> tuple[Column, Column]:
    """The best match but the fuzzy one, and whether there is one."""
    wanted = query if case_sensitive else query.lower()
    seen, hit = _seen(text, case_sensitive), _hit
    usable = text.isNotNull() & (text != "")
    exact = usable & (seen == F.lit(wanted))
    found = exact
    result = F.when(exact, hit(1.0, "exact", F.lit(0), F.length(text)))
    if use_regex and valid_pattern(SparkSession.active(), query):
        pattern = query if case_sensitive else f"(?iu){query}"
        matched = usable & text.rlike(pattern)
        found = found | matched
        # What a split at the first match leaves before it gives its position. A split passes over an
        # empty match; there, the shortest prefix that the pattern can follow does.
        hit_text = F.regexp_extract(text, pattern, 0)
        prefix = F.regexp_extract(text, rf"\A((?s:.*?))(?:{pattern})", 1)
        start = F.when(hit_text == "", F.length(prefix)).otherwise(F.length(F.split(text, pattern, 2)[0]))
        result = result.when(matched, hit(0.9, "regex", start, start + F.length(hit_text)))
    contained = usable & F.contains(seen, F.lit(wanted))
    at = F.locate(wanted, seen) - 1
    result = result.when(contained, hit(0.8, "contains", at, at + len(wanted)))
    return result, found | contained


def highlight(text: Column, ranges: Column) -> Column:
    """Wrap each ``(start, end)`` range of the text in brackets, left to right."""
    if_empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("done"))
    marked = F.aggregate(
        F.array_sort(ranges),
        if_empty,
        lambda acc, r: F.struct(
            F.concat(
                acc["out"],
                F.substring(text, acc["done"] + 1, F.greatest(r["start"] - acc["done"], F.lit(0))),
                F.lit("["), F.substring(text, r["start"] + 1, r["end"] - r["start"]), F.lit("]"),
            ).alias("out"),
            r["end"].alias("done"),
        ),
    )
    return F.when(F.coalesce(F.size(ranges), F.lit(0)) <= 0, text).otherwise(
        F.concat(marked["out"], F.substring(text, marked["done"] + 1, F.length(text)))
    )
