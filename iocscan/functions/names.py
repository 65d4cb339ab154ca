"""Path parts and name similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The built-in watch-list of names.
WELL_KNOWN_NAMES = (
    "svchost.exe",
    "explorer.exe",
    "iexplore.exe",
    "lsass.exe",
    "chrome.exe",
    "csrss.exe",
    "firefox.exe",
    "winlogon.exe",
)


def basename(path: Column) -> Column:
    """Everything after the last slash."""
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Text after the last dot; ``-`` when there is none or only a leading dot."""
    found = F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1)
    return F.when(name.rlike(r"(?s)^.+\.[^.]*\z"), found).otherwise(F.lit("-"))


def one_edit_apart(left: Column, right: Column) -> Column:
    """Edit distance exactly one, over code points; equal names are no hit."""
    return (F.abs(F.length(left) - F.length(right)) <= 1) & (F.levenshtein(left, right, 1) == 1)


#: Marks of the strings in ``edit_keys``; positions are counted from 1.
WHOLE, SHORTENED = -1, -2


def edit_keys(name: Column, whole: int, shortened: int) -> Column:
    """Array of (variant, mark) by which names one edit apart can be joined.

    For each position there is the name without that character, marked with the
    position: two names that differ in one character share exactly one of these.
    The name itself and its one-character deletions (each once) carry the given
    marks, to be matched crosswise with those of the longer or shorter name.
    """
    places = F.when(F.length(name) > 0, F.sequence(F.lit(1), F.length(name))).otherwise(F.array().cast("array<int>"))

    def without(i: Column) -> Column:
        return F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name)))

    def first_of_run(i: Column) -> Column:
        return (i == 1) | (F.substring(name, i, F.lit(1)) != F.substring(name, i - 1, F.lit(1)))

    return F.concat(
        F.array(F.struct(name.alias("variant"), F.lit(whole).alias("mark"))),
        F.transform(places, lambda i: F.struct(without(i).alias("variant"), i.alias("mark"))),
        F.transform(
            F.filter(places, first_of_run),
            lambda i: F.struct(without(i).alias("variant"), F.lit(shortened).alias("mark")),
        ),
    )
