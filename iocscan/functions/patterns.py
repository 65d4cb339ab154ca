"""Regular expressions: from the linear-time dialect of the options to Java."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession, functions as F

# One step over a pattern: an escape, a (possibly nested) class, or one character.
_STEP = re.compile(r"\\p\{[^}]*\}|\\.|\[\^?\]?(?:\\.|\[:\^?\w+:\]|[^\]\\])*\]|\(\?(?:P?<\w+>|<?[=!]|[a-zA-Z-]*[:)])|.", re.S)
_POSIX = re.compile(r"\[:(\^?)(\w+):\]")
# POSIX class names and their Java equivalents.
_POSIX_JAVA = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl",
    "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct",
    "space": "Space", "upper": "Upper", "xdigit": "XDigit",
}


def name_pattern(pattern: str) -> str:
    r"""Java form of a pattern for names.

    ``$`` means the very end (Java also accepts a final line break), ``.`` stops
    only at a line feed, and ``\d \w \s`` are Unicode classes. Look-around and
    back-references do not exist in the option dialect and are refused.
    """
    multiline = re.search(r"\(\?[a-z]*m", pattern) is not None
    out = []
    for step in _STEP.findall(pattern):
        if step == "$" and not multiline:
            step = r"\z"
        elif step.startswith("\\") and step[1:2].isdigit():
            raise ValueError(f"back-references are not supported: {pattern!r}")
        elif step.startswith("(?") and re.match(r"\(\?<?[=!]", step):
            raise ValueError(f"look-around is not supported: {pattern!r}")
        elif step.startswith("(?P<"):
            step = "(?<" + step[4:]
        elif step.startswith("["):
            step = _POSIX.sub(lambda m: f"\\{'P' if m[1] else 'p'}{{{_POSIX_JAVA.get(m[2], m[2])}}}", step)
        out.append(step)
    return "(?Ud)" + "".join(out)


def checked_name_patterns(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Translate the patterns and let Spark compile them; a bad one fails at once."""
    java = [name_pattern(p) for p in patterns]
    try:
        spark.range(1).select(*[F.lit("").rlike(p) for p in java]).collect()
    except PySparkException as error:
        raise ValueError(f"invalid pattern among {patterns}") from error
    return java


def required_literal(pattern: str) -> str:
    """A string that every name matched by the pattern contains: the longest run of plain characters outside groups, the first of equally long ones.

    Empty where there is none, and for patterns with flags, alternatives outside groups, or escapes that are neither a plain character nor a class.
    """
    runs, run, depth, counted = [], "", 0, False
    for step in _STEP.findall(pattern):
        plain = ""
        if counted:  # inside {n,m}
            counted = step != "}"
            continue
        if step.startswith("(?") and not re.match(r"\(\?(:|P?<\w+>)", step):
            return ""
        if step.startswith("("):
            depth += 1
        elif step == ")":
            depth -= 1
        elif depth == 0:
            if step == "|":
                return ""
            if step in ("*", "?", "{"):
                run = run[:-1]
                counted = step == "{"
            elif step.startswith("\\"):
                if step[1:].isalnum() and step[1] not in "dDwWsSbBAz":
                    return ""
                plain = "" if step[1].isalnum() else step[1]
            elif step.startswith("[") and len(step) == 3 and step[1] not in "^\\":
                plain = step[1]
            elif len(step) == 1 and step not in ".^$+":
                plain = step
        if plain:
            run += plain
        else:
            runs.append(run)
            run = ""
    return max([*runs, run], key=len)
