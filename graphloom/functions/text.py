"""String helpers shared by the rules. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


# Unicode's White_Space, which ``(?U)\\s`` stands for.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(col: Column) -> Column:
    """Remove Unicode white space at both ends; only the ends are looked at, a pattern would search the whole text."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def lines(col: Column) -> Column:
    """Text as an array of lines."""
    return F.split(col, "\n", -1)


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def first_line(col: Column) -> Column:
    """First line of the stripped text, null when the text is null."""
    return F.substring_index(strip(col), "\n", 1)


def first_match(col: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null when nothing matches or the group is empty."""
    return blank_to_null(F.regexp_extract(col, pattern, group))


def all_matches(col: Column, pattern: str, groups: dict[str, int]) -> Column:
    """Every match as a struct of named groups.

    The text is scanned once for whole matches; groups are then read from the
    short matched strings. Patterns must not look beyond their own match.
    """
    whole = F.regexp_extract_all(col, F.lit(pattern), F.lit(0))
    return F.transform(
        whole,
        lambda m: F.struct(*[F.regexp_extract(m, pattern, g).alias(n) for n, g in groups.items()]),
    )


def numbered(items: Column) -> Column:
    """Array elements as structs ``(pos, item)`` in array order."""
    return F.transform(items, lambda item, i: F.struct(i.cast("bigint").alias("pos"), item.alias("item")))


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether any of a short fixed list of terms occurs in the text."""
    return F.rlike(text, F.lit("|".join(rf"\Q{term}\E" for term in terms)))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_stem(path: Column) -> Column:
    """Base name without its last suffix; a leading dot is part of the name."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def suffix(path: Column) -> Column:
    """Last suffix with its dot, '' when there is none."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1)


def has_component(path: Column, names: list[str]) -> Column:
    """Whether any directory component of the path is one of the names."""
    return F.arrays_overlap(
        F.slice(F.split(path, "[/\\\\]"), 1, F.greatest(F.size(F.split(path, "[/\\\\]")) - 1, F.lit(0))),
        F.array(*[F.lit(n) for n in names]),
    )
