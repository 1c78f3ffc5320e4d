"""Substring and phrase joins: by automata beside the texts or, with very many needles, as equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions import automaton
from graphloom.session import cut

GRAMS = (1, 2, 4, 8)
PHRASE = 3
_WORD = "[a-z0-9_]+"


def _grams(text: Column, n: Column | int, symbol: str = ".") -> Column:
    """Distinct runs of n symbols starting anywhere in the text, in one linear scan."""
    n = n if isinstance(n, Column) else F.lit(n)
    pattern = F.concat(F.lit(f"(?s)(?=({symbol}{{"), n.cast("string"), F.lit("}))"))
    return F.array_distinct(F.regexp_extract_all(text, pattern, F.lit(1)))


def substring_join(
    texts: DataFrame,
    text: str,
    needles: DataFrame,
    needle: str,
    text_id: Sequence[str],
    on: Sequence[str] = (),
) -> DataFrame:
    """Pairs (text row without its text, needle row) where the needle occurs in the text.

    ``on`` adds equality columns, ``text_id`` identifies a text row. Empty needles
    match nothing here. Needle columns must not clash with the text columns.

    As long as the needles fit some blocks (see automaton), texts stay where they are; beyond that
    they are looked up by their grams.
    """
    return _join(texts, text, needles, needle, text_id, on, False, gram_join)


def _join(texts, text, needles, needle, text_id, on, whole, beyond) -> DataFrame:
    needles = cut(needles)
    blocks = automaton.blocks_of(needles, needle)
    keep = [c for c in texts.columns if c != text or c in text_id]
    if blocks is None:
        return beyond(texts, text, needles, needle, text_id, on).select(*keep, *[c for c in needles.columns if c not in on])
    found = automaton.search(texts, text, blocks, needle, keep, whole)
    return found.join(needles, [needle, *on]).select(*keep, *[c for c in needles.columns if c not in on])


def gram_join(
    texts: DataFrame,
    text: str,
    needles: DataFrame,
    needle: str,
    text_id: Sequence[str],
    on: Sequence[str] = (),
) -> DataFrame:
    """substring_join for needles without bound, as a join on equality.

    Each needle is looked up by its first 1, 2, 4 or 8 characters, as many as it has,
    among the grams of the texts; needles longer than their key are then checked in full. Only lengths
    that occur are generated.
    """
    sizes = F.array(*[F.lit(n) for n in GRAMS])
    keyed = (
        needles.where(F.length(needle) > 0)
        .withColumn("_n", F.array_max(F.filter(sizes, lambda n: n <= F.length(needle))))
        .withColumn("_gram", F.substring(F.col(needle), F.lit(1), F.col("_n")))
    )
    lengths = keyed.select("_n").distinct()
    pieces = (
        texts.select(*text_id, *[c for c in on if c not in text_id], text)
        .withColumn("_n", F.explode(sizes))
        .join(lengths, "_n", "left_semi")
        .select(
            *text_id, *[c for c in on if c not in text_id], "_n",
            F.explode(_grams(F.col(text), F.col("_n"))).alias("_gram"),
        )
    )
    found = pieces.join(keyed, ["_n", "_gram", *on]).drop("_gram")
    keep = [c for c in texts.columns if c not in text_id and c not in on]
    whole = found.join(texts.select(*text_id, *keep), list(text_id))
    return whole.where(
        (F.col("_n") == F.length(needle)) | F.contains(F.col(text), F.col(needle))
    ).drop("_n")


def _leading(name: Column) -> Column:
    """Key of a name: its first words, or its first characters if it has no word."""
    words = F.regexp_extract_all(name, F.lit(_WORD), F.lit(0))
    return F.when(
        F.size(words) > 0, F.concat(F.lit("w:"), F.array_join(F.slice(words, 1, PHRASE), " "))
    ).otherwise(F.concat(F.lit("c:"), F.substring(name, 1, PHRASE)))


def _phrases(text: Column, words: Column) -> Column:
    """Every key that a name standing in the text can have; ``words`` are the text's words."""

    def runs_of(n: int) -> Column:
        return F.when(
            F.size(words) >= n,
            F.transform(
                F.sequence(F.lit(1), F.size(words) - n + 1),
                lambda i: F.concat(F.lit("w:"), F.array_join(F.slice(words, i, n), " ")),
            ),
        ).otherwise(F.array().cast("array<string>"))

    runs = [runs_of(n) for n in range(1, PHRASE + 1)]
    # A name without words holds no word character, so neither do its grams.
    grams = [
        F.transform(_grams(text, n, "[^a-z0-9_]"), lambda g: F.concat(F.lit("c:"), g)) for n in (2, PHRASE)
    ]
    return F.array_distinct(F.concat(*runs, *grams))


def phrase_join(
    texts: DataFrame,
    text: str,
    names: DataFrame,
    name: str,
    text_id: Sequence[str],
    on: Sequence[str] = (),
) -> DataFrame:
    """Pairs (text row without its text, name row) where the name stands in the text as a phrase.

    Both columns must be lower case and names at least two characters long. A name
    counts when no ASCII word character touches it on either side. ``text_id`` identifies a
    text row. Names are searched like the needles of substring_join.
    """
    return _join(texts, text, names, name, text_id, on, True, key_join)


def key_join(
    texts: DataFrame,
    text: str,
    names: DataFrame,
    name: str,
    text_id: Sequence[str],
    on: Sequence[str] = (),
) -> DataFrame:
    """phrase_join for names without bound, as a join on equality.

    The words of a name are consecutive words of the text, so the join is on up to PHRASE
    leading words; the exact rule is checked on the pairs. Only ids and keys go through the explode,
    never copies of the text.
    """
    keyed = names.withColumn("_key", _leading(F.col(name)))
    extra = [c for c in on if c not in text_id]
    # The words are a column of their own: inside the lambdas they would be split anew each time.
    split = texts.withColumn("_words", F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)))
    pieces = split.select(*text_id, *extra, F.explode(_phrases(F.col(text), F.col("_words"))).alias("_key"))
    pair = pieces.join(keyed, ["_key", *on]).drop("_key", *extra)
    pair = pair.join(texts, list(text_id))
    # Matching is literal, so regex metacharacters of a name cannot interfere.
    around = F.concat(
        F.lit(r"(?<![a-zA-Z0-9_])\Q"),
        F.regexp_replace(F.col(name), r"\\E", r"\\E\\\\E\\Q"),
        F.lit(r"\E(?![a-zA-Z0-9_])"),
    )
    return pair.where(F.regexp_like(F.col(text), around))
