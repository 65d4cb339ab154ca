"""Content rules: string definitions and conditions.

Rules are kept as two tables, ``rules(rule_id, rule_file, condition, private)``
and ``rule_strings(rule_id, string_id, kind, value, nocase, wide, ascii,
fullword)``. This module turns their rows into byte patterns and into Spark SQL
boolean expressions over *atoms*: named facts on one scan unit such as "string 3
occurs" or "number of occurrences of string 3".
"""

from __future__ import annotations

import ast
import itertools
import operator
import re
from dataclasses import dataclass, field

from re import _parser

from pyspark.sql import DataFrame, Row, SparkSession, types as T

#: From here on the width of an expression means that it has no bound.
_UNBOUNDED = 1 << 30

RULES = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("rule_file", T.StringType()),
    T.StructField("condition", T.StringType()),
    T.StructField("private", T.BooleanType()),
])
RULE_STRINGS = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("string_id", T.StringType()),
    T.StructField("kind", T.StringType()),  # text | hex | regex
    T.StructField("value", T.StringType()),
    T.StructField("nocase", T.BooleanType()),
    T.StructField("wide", T.BooleanType()),
    T.StructField("ascii", T.BooleanType()),
    T.StructField("fullword", T.BooleanType()),
])

#: A rule set is program text: it is compiled on the driver and sent to every
#: task, so many strings at a time. Larger sets are searched in several passes.
MAX_RULE_STRINGS = 200_000

# The variables that conditions may refer to.
EXTERNALS = ("filename", "filepath", "extension", "filetype", "md5", "owner")


class RuleError(ValueError):
    """A rule that cannot be used; its whole rule file is rejected."""


# --- strings -----------------------------------------------------------------


@dataclass(frozen=True)
class ByteString:
    """One string of a rule, ready to be searched in bytes.

    ``regex`` is valid in Java (on the Latin-1 view) and in Python (on bytes).
    ``literals`` is set when a plain byte search is enough. ``anchor`` is a byte
    string that every match contains, used to skip the regular expression.
    """

    index: int
    rule_id: str
    identifier: str
    regex: str
    flags: str = ""
    literals: tuple[bytes, ...] = ()
    folded: str | None = None
    anchor: bytes | None = None

    @property
    def scoped(self) -> str:
        """The regular expression as a Java group with its own flags."""
        off = "".join(f for f in "is" if f not in self.flags)
        return f"(?d{self.flags}{'-' + off if off else ''}:{self.regex})"

    @property
    def python(self) -> str:
        off = "".join(f for f in "is" if f not in self.flags)
        return f"(?{self.flags}{'-' + off if off else ''}:{self.regex})"

    @property
    def longest(self) -> int | None:
        """Bytes of the longest possible match; None if there is no bound."""
        if self.literals:
            return max(map(len, self.literals))
        widest = _parser.parse(self.python.encode("latin-1")).getwidth()[1]
        return None if widest >= _UNBOUNDED else int(widest)

    @property
    def recursive(self) -> bool:
        """Java matches a repeated group recursively and can exhaust its stack."""
        return not self.literals and re.search(r"\)[*+{]", self.regex) is not None


def byte_regex(data: bytes) -> str:
    return "".join(chr(b) if chr(b).isalnum() and b < 128 else f"\\x{b:02x}" for b in data)


_WORD_START, _WORD_END = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"
_WIDE_START, _WIDE_END = r"(?<![0-9A-Za-z]\x00)", r"(?![0-9A-Za-z]\x00)"
_DATA_END = r"(?![\x00-\xff])"


def _text_string(value: str, nocase, wide, ascii_, fullword) -> dict:
    plain = text_bytes(value)
    if not plain:
        raise RuleError("empty string")
    variants = []
    if ascii_ or not wide:
        variants.append((plain, _WORD_START, _WORD_END))
    if wide:
        variants.append((b"".join(bytes((b, 0)) for b in plain), _WIDE_START, _WIDE_END))
    regex = "|".join(
        (start if fullword else "") + byte_regex(data) + (end if fullword else "")
        for data, start, end in variants
    )
    simple = not nocase and not fullword
    is_ascii = all(b < 128 for b in plain)
    return {
        "regex": regex,
        "flags": "i" if nocase else "",
        "literals": tuple(data for data, _, _ in variants) if simple else (),
        "folded": variants[0][0].decode("latin-1").lower()
        if nocase and not fullword and is_ascii and len(variants) == 1 else None,
        "anchor": variants[0][0] if not nocase and len(variants) == 1 else None,
    }


_ESCAPE = re.compile(r"\\(x[0-9A-Fa-f]{2}|.)|[^\\]+|\\", re.S)
# Escapes in quoted text.
_ESCAPES = {"n": b"\n", "t": b"\t", "r": b"\r", '"': b'"', "\\": b"\\"}


def text_bytes(source: str) -> bytes:
    r"""Bytes of a quoted text: UTF-8, with ``\xHH`` and the usual escapes."""
    out = []
    for step in _ESCAPE.finditer(source):
        escape = step[1]
        if escape is None:
            if step[0] == "\\":
                raise RuleError("text ends in an escape")
            out.append(step[0].encode("utf-8"))
        elif len(escape) == 3:
            out.append(bytes.fromhex(escape[1:]))
        elif escape in _ESCAPES:
            out.append(_ESCAPES[escape])
        else:
            raise RuleError(f"unknown escape \\{escape}")
    return b"".join(out)


_HEX_STEP = re.compile(r"\s+|//[^\n]*|(~?)([0-9A-Fa-f?]{2})|\[\s*(\d*)\s*(-?)\s*(\d*)\s*\]|([(|)])|(.)", re.S)


def _hex_string(value: str) -> dict:
    out, runs, run, depth = [], [], b"", 0
    for step in _HEX_STEP.finditer(value):
        negated, pair, low, dash, high, group, bad = step.groups()
        if bad:
            raise RuleError(f"unexpected {bad!r} in hex string")
        literal = bool(pair) and "?" not in pair and not negated
        if literal and depth == 0:
            run += bytes.fromhex(pair)
        elif not step[0].isspace():
            runs.append(run)
            run = b""
        if pair:
            if pair == "??":
                part = "."
            elif pair[1] == "?":
                part = f"[\\x{pair[0]}0-\\x{pair[0]}f]"
            elif pair[0] == "?":
                part = "[" + "".join(f"\\x{h:x}{pair[1]}" for h in range(16)) + "]"
            else:
                part = f"\\x{pair}"
            if negated:
                part = "[^" + part.strip("[]") + "]"
            out.append(part)
        elif step[0].startswith("["):
            if not (low or dash):
                raise RuleError("empty jump in hex string")
            out.append(f".{{{low or 0},{high}}}?" if dash else f".{{{low}}}")
        elif group:
            depth += {"(": 1, ")": -1}.get(group, 0)
            if depth < 0 or (group == "|" and depth == 0):
                raise RuleError("unbalanced group in hex string")
            out.append("(?:" if group == "(" else group)
    if depth or not out:
        raise RuleError("unbalanced or empty hex string")
    runs.append(run)
    whole = run if len(run) == len(out) else None
    best = max(runs, key=len)
    return {
        "regex": "".join(out),
        "flags": "s",
        "literals": (whole,) if whole else (),
        "anchor": best or None,
    }


_REGEX_STEP = re.compile(r"\\x[0-9A-Fa-f]{2}|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?.?|[*+?]\??|\{\d*,?\d*\}\??|.", re.S)
_BYTE_BORDER = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_NO_BYTE_BORDER = r"(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"


def _regex_string(value: str, nocase, wide, ascii_, fullword) -> dict:
    """``value`` is ``/body/flags``."""
    body, _, flags = value[1:].rpartition("/")
    if wide:
        raise RuleError("wide regular expressions are not supported")
    if set(flags) - set("is"):
        raise RuleError(f"unknown regular expression flags {flags!r}")
    out, runs, run, depth = [], [], b"", 0
    for step in _REGEX_STEP.findall(body.encode("utf-8").decode("latin-1")):
        literal = None
        if step == "$":
            step = _DATA_END
        elif step == "^":
            step = r"\A"
        elif step == r"\b":
            step = _BYTE_BORDER
        elif step == r"\B":
            step = _NO_BYTE_BORDER
        elif step.startswith("(?") or re.fullmatch(r"\\[1-9pPkGQEZzAhRXuUNL]", step):
            raise RuleError(f"unsupported regular expression syntax {step!r}")
        elif re.fullmatch(r"\{,?\}\??", step):
            raise RuleError(f"empty repetition {step!r}")
        elif step.startswith("{,"):
            step = "{0" + step[1:]
        elif step.startswith("["):
            # Java reads a bracket or && inside a class as a set operation
            step = "[" + re.sub(r"(\\.)|([\[&])", lambda m: m[1] or "\\" + m[2], step[1:], flags=re.S)
        elif len(step) == 1 and step not in "()|.*+?":
            literal = step.encode("latin-1")
            step = byte_regex(literal)
        elif len(step) == 2 and step[0] == "\\" and not step[1].isalnum():
            literal = step[1].encode("latin-1")
            step = byte_regex(literal)
        elif step == "(":
            step = "(?:"
        if step == "(?:":
            depth += 1
        elif step == ")":
            depth -= 1
        if literal is not None and depth == 0:
            run += literal
        else:
            if re.match(r"[*?]|\{0?,", step) or step.startswith("{0"):
                run = run[:-1]  # the character before may be missing
            runs.append(run)
            run = b""
        out.append(step)
    runs.append(run)
    regex = "".join(out)
    try:
        re.compile(regex.encode("latin-1"))
    except re.error as error:
        raise RuleError(f"invalid regular expression {value}: {error}") from error
    if fullword:
        regex = f"{_WORD_START}(?:{regex}){_WORD_END}"
    ignore_case = nocase or "i" in flags
    top_level_choice = re.search(r"\|", regex) is not None
    anchor = max(runs, key=len) if not ignore_case and not top_level_choice else b""
    return {
        "regex": regex,
        "flags": ("i" if ignore_case else "") + ("s" if "s" in flags else ""),
        "anchor": anchor or None,
    }


def byte_string(index: int, row) -> ByteString:
    """Compile one row of ``rule_strings``."""
    options = (bool(row.nocase), bool(row.wide), bool(row.ascii), bool(row.fullword))
    if row.kind == "text":
        made = _text_string(row.value, *options)
    elif row.kind == "hex":
        made = _hex_string(row.value)
    elif row.kind == "regex":
        made = _regex_string(row.value, *options)
    else:
        raise RuleError(f"unknown kind of string {row.kind!r}")
    return ByteString(index, row.rule_id, row.string_id, **made)


# --- conditions --------------------------------------------------------------


@dataclass(frozen=True)
class Atom:
    """A fact on one unit. ``kind``: p(resent), c(ount), o(ffset), t (at), r(ange)."""

    kind: str
    string: int
    args: tuple[int, ...] = ()

    @property
    def name(self) -> str:
        return "_".join([self.kind, str(self.string), *map(str, self.args)])


@dataclass
class Rule:
    rule_id: str
    rule_file: str | None
    sql: str
    atoms: dict[str, Atom]
    needs_match: bool
    private: bool = False
    strings: list[ByteString] = field(default_factory=list)

    @property
    def any_of(self) -> list[int] | None:
        """The strings of which one is enough, if the condition says just that."""
        if re.fullmatch(r"\(?p_\d+(?: or p_\d+)*\)?", self.sql):
            return [int(n) for n in re.findall(r"\d+", self.sql)]
        return None


_NUMBER = r"(?:0x[0-9A-Fa-f]+|\d+(?:KB|MB)?)"
_CONDITION_STEP = re.compile(
    rf"""(?P<quant>\b(?P<qn>any|all|none|\d+)\s+of\s+(?P<qset>them\b|\([^)]*\)))
    |(?P<at>\$(?P<ats>\w+)\s+at\s+(?P<atn>{_NUMBER}))
    |(?P<in>\$(?P<ins>\w+)\s+in\s*\(\s*(?P<inx>{_NUMBER})\s*\.\.\s*(?P<iny>{_NUMBER}|filesize)\s*\))
    |(?P<count>\#(?P<cs>\w+)(?!\s+in\b))
    |(?P<offset>@(?P<os>\w+)(?:\s*\[\s*(?P<on>\d+)\s*\])?)
    |(?P<present>\$(?P<ps>\w+))
    |(?P<ext>\b(?P<en>{'|'.join(EXTERNALS)})\s*(?P<eo>==|!=|icontains\b|contains\b|istartswith\b|startswith\b|iendswith\b|endswith\b|iequals\b|matches\b)\s*(?P<ev>"(?:\\.|[^"\\])*"|/(?:\\.|[^/\\])+/i?))
    |(?P<num>\b{_NUMBER}\b)
    |(?P<word>[A-Za-z_]\w*)
    |(?P<op><=|>=|==|!=|[<>()+*-])
    |(?P<ws>\s+)
    |(?P<bad>.)""",
    re.X | re.S,
)


def _number(text: str) -> int:
    if text.startswith("0x"):
        return int(text, 16)
    for unit, factor in (("KB", 1024), ("MB", 1024 * 1024)):
        if text.endswith(unit):
            return int(text[:-2]) * factor
    return int(text)


def _sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _external(name: str, relation: str, value: str) -> str:
    column = f"ext_{name}"
    if relation == "matches":
        if not value.startswith("/"):
            raise RuleError("'matches' needs a regular expression")
        body, _, flags = value[1:].rpartition("/")
        return f"rlike({column}, {_sql_text('(?d' + flags + ')' + body)})"
    if not value.startswith('"'):
        raise RuleError(f"{relation!r} needs a quoted text")
    text = text_bytes(value[1:-1]).decode("utf-8", "replace")
    if relation in ("==", "!="):
        return f"({column} {relation} {_sql_text(text)})"
    if relation.startswith("i"):
        column, text, relation = f"lower({column})", text.lower(), relation[1:]
    return f"({column} == {_sql_text(text)})" if relation == "equals" else f"{relation}({column}, {_sql_text(text)})"


def condition_sql(condition: str, strings: list[ByteString], earlier: dict[str, Rule]) -> Rule:
    """Rewrite a condition into a Spark SQL boolean over atoms.

    Only the written forms are rewritten; what is left (and, or, not, brackets,
    comparisons) is the same in SQL, so Catalyst does the parsing.
    """
    by_name: dict[str, list[ByteString]] = {}
    for s in strings:
        by_name.setdefault(s.identifier, []).append(s)
    atoms: dict[str, Atom] = {}
    externals: dict[str, str] = {}

    def use(kind: str, string: ByteString, *args: int) -> str:
        atom = Atom(kind, string.index, args)
        atoms[atom.name] = atom
        return atom.name

    def one(name: str) -> ByteString:
        if "$" + name not in by_name:
            raise RuleError(f"undefined string ${name}")
        return by_name["$" + name][0]

    def members(text: str) -> list[ByteString]:
        if text == "them":
            return strings
        out = []
        for item in (x.strip() for x in text[1:-1].split(",")):
            if item.endswith("*") and item.startswith("$"):
                found = [s for s in strings if s.identifier.startswith(item[:-1])]
            else:
                found = by_name.get(item, [])
            if not found:
                raise RuleError(f"undefined string {item}")
            out += [s for s in found if s not in out]
        return out

    out = []
    for m in _CONDITION_STEP.finditer(condition):
        kind = m.lastgroup if m.lastgroup in ("num", "word", "op", "ws", "bad") else next(
            k for k in ("quant", "at", "in", "count", "offset", "present", "ext") if m[k] is not None
        )
        if kind == "quant":
            names = [use("p", s) for s in members(m["qset"])]
            if not names:
                raise RuleError("the rule has no strings")
            if m["qn"] == "any":
                out.append("(" + " or ".join(names) + ")")
            elif m["qn"] == "all":
                out.append("(" + " and ".join(names) + ")")
            elif m["qn"] == "none":
                out.append("(not (" + " or ".join(names) + "))")
            else:
                out.append("((" + " + ".join(f"int({n})" for n in names) + f") >= {m['qn']})")
        elif kind == "at":
            out.append(use("t", one(m["ats"]), _number(m["atn"])))
        elif kind == "in":
            end = (-1,) if m["iny"] == "filesize" else (_number(m["iny"]),)
            out.append(use("r", one(m["ins"]), _number(m["inx"]), *(() if end == (-1,) else end)))
        elif kind == "count":
            out.append(use("c", one(m["cs"])))
        elif kind == "offset":
            nth = int(m["on"] or 1)
            if nth < 1:
                raise RuleError("occurrences are numbered from 1")
            out.append(use("o", one(m["os"]), nth))
        elif kind == "present":
            out.append(use("p", one(m["ps"])))
        elif kind == "ext":
            name = f"e_{len(externals)}"
            externals[name] = _external(m["en"], m["eo"], m["ev"])
            out.append(f" {name} ")
        elif kind == "num":
            out.append(str(_number(m["num"])))
        elif kind == "word":
            word = m["word"]
            if word in ("and", "or", "not", "true", "false"):
                out.append(word)
            elif word == "filesize":
                out.append("filesize")
            elif word in earlier:
                other = earlier[word]
                atoms.update(other.atoms)
                name = f"e_{len(externals)}"
                externals[name] = f"({other.sql})"
                out.append(f" {name} ")
            else:
                raise RuleError(f"unsupported word {word!r} in condition")
        elif kind == "bad":
            raise RuleError(f"unsupported {m['bad']!r} in condition")
        else:
            out.append(m[0])
    text = "".join(out).strip()
    needs_match = _needs_match(text, atoms, list(externals))
    sql = re.sub(r"\be_\d+\b", lambda m: externals[m[0]], text)
    return Rule("", None, sql, atoms, needs_match)


def _needs_match(text: str, atoms: dict[str, Atom], externals: list[str]) -> bool:
    """Whether the condition is false for every unit in which no string occurs.

    The condition is tried with all atoms at "no match" and with the other facts
    at every combination of values that could matter. False when unsure.
    """
    plain = re.sub(r"\btrue\b", "True", re.sub(r"\bfalse\b", "False", text))
    try:
        tree = ast.parse(plain, mode="eval").body
    except (SyntaxError, RecursionError, MemoryError) as error:
        raise RuleError(f"cannot read condition: {getattr(error, 'msg', error)}") from error
    _checked(tree)
    sizes = [0]
    if "filesize" in text:
        simple = re.findall(r"filesize\s*(?:<=|>=|==|!=|<|>)\s*(\d+)(?!\s*[+*-])", text)
        if len(simple) != text.count("filesize"):
            return False
        sizes += [int(n) + d for n in simple for d in (-1, 0, 1)]
    if len(externals) > 8:
        return False
    nothing = {"p": False, "c": 0, "o": float("nan"), "t": False, "r": False}
    facts = {name: nothing[a.kind] for name, a in atoms.items()}
    for size in sizes:
        for values in itertools.product((False, True), repeat=len(externals)):
            if _value(tree, {**facts, **dict(zip(externals, values)), "filesize": size}):
                return False
    return True


_ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.USub: operator.neg, ast.UAdd: operator.pos, ast.Not: operator.not_}
_COMPARISONS = {
    ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}
_ALLOWED = (ast.BoolOp, ast.And, ast.Or, ast.UnaryOp, ast.BinOp, ast.Compare, ast.Name, ast.Load, ast.Constant, *_ARITHMETIC, *_COMPARISONS)


def _checked(tree: ast.AST) -> None:
    """Refuse whatever is no and, or, not, comparison, sum, difference or product of facts and numbers."""
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            if not (isinstance(node.func, ast.Name) and node.func.id == "int" and len(node.args) == 1 and not node.keywords):
                raise RuleError("unsupported call in condition")
        elif not isinstance(node, _ALLOWED) or (isinstance(node, ast.Compare) and len(node.ops) > 1):
            raise RuleError(f"unsupported {type(node).__name__} in condition")


def _value(node: ast.AST, facts: dict):
    """Value of a checked condition."""
    if isinstance(node, ast.Constant):
        return node.value
    if isinstance(node, ast.Name):
        return facts[node.id]
    if isinstance(node, ast.BoolOp):
        parts = (_value(v, facts) for v in node.values)
        return all(parts) if isinstance(node.op, ast.And) else any(parts)
    if isinstance(node, ast.UnaryOp):
        return _ARITHMETIC[type(node.op)](_value(node.operand, facts))
    if isinstance(node, ast.BinOp):
        return _ARITHMETIC[type(node.op)](_value(node.left, facts), _value(node.right, facts))
    if isinstance(node, ast.Call):
        return int(_value(node.args[0], facts))
    return _COMPARISONS[type(node.ops[0])](_value(node.left, facts), _value(node.comparators[0], facts))


# --- rule sets ---------------------------------------------------------------


class RuleSet:
    """Compiled rules, in order."""

    def __init__(self, rules: list[Rule]):
        names = [r.rule_id for r in rules]
        twice = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
        if twice:
            raise ValueError(f"duplicate rule names: {', '.join(twice)}")
        self.rules = rules
        self.strings = [s for r in rules for s in r.strings]
        self.atoms = {name: a for r in rules for name, a in r.atoms.items()}

    @property
    def needs_match(self) -> bool:
        return all(r.needs_match for r in self.rules)

    def overlap(self, least: int, unbounded: int) -> int:
        """How far pieces of content must overlap for every match to lie in one: ``unbounded`` where matches have no bound."""
        widths = [s.longest for s in self.strings]
        return unbounded if None in widths else max([least, *widths])

    @property
    def reported(self) -> list[tuple[int, Rule]]:
        return [(i, r) for i, r in enumerate(self.rules) if not r.private]

    def shards(self, most_strings: int | None = None) -> list[RuleSet]:
        """The rules in sets of at most ``most_strings`` strings, in order; a rule stays with those whose strings its condition uses.

        Only rules that belong together and have more strings than that make a larger set. Findings of the sets together are those of the whole.
        """
        most_strings = most_strings or MAX_RULE_STRINGS
        if len(self.strings) <= most_strings:
            return [self]
        owner = {s.index: i for i, r in enumerate(self.rules) for s in r.strings}
        lead = list(range(len(self.rules)))  # the first rule of each group

        def first(i: int) -> int:
            while lead[i] != i:
                lead[i] = i = lead[lead[i]]
            return i
        for i, rule in enumerate(self.rules):
            for atom in rule.atoms.values():
                a, b = first(i), first(owner[atom.string])
                lead[max(a, b)] = min(a, b)
        groups: dict[int, list[int]] = {}
        for i in range(len(self.rules)):
            groups.setdefault(first(i), []).append(i)
        parts: list[list[int]] = [[]]
        held = 0
        for group in groups.values():
            size = sum(len(self.rules[i].strings) for i in group)
            if parts[-1] and held + size > most_strings:
                parts.append([])
                held = 0
            parts[-1] += group
            held += size
        return [RuleSet([self.rules[i] for i in sorted(part)]) for part in parts]

    @classmethod
    def from_rows(cls, rules: list, strings: list) -> RuleSet:
        """Compile rows of the two tables; order of the rows is kept."""
        by_rule: dict[tuple, list] = {}
        for row in strings:
            by_rule.setdefault(row.rule_id, []).append(row)
        compiled, index = [], 0
        earlier: dict[str | None, dict[str, Rule]] = {}
        for row in rules:
            own = []
            for s in by_rule.get(row.rule_id, []):
                own.append(byte_string(index, s))
                index += 1
            named = [s.identifier for s in own if s.identifier != "$"]
            if len(set(named)) < len(named):
                raise RuleError(f"duplicate string identifier in rule {row.rule_id}")
            known = earlier.setdefault(row.rule_file, {})
            rule = condition_sql(row.condition, own, known)
            rule.rule_id, rule.rule_file, rule.private, rule.strings = (
                row.rule_id, row.rule_file, bool(row.private), own,
            )
            known[row.rule_id] = rule
            compiled.append(rule)
        return cls(compiled)

    @classmethod
    def from_tables(cls, rules: DataFrame, strings: DataFrame) -> RuleSet:
        """Compile rule tables (``RULES``, ``RULE_STRINGS``). The text of all rules is held on the driver; how many strings are searched together is ``shards``."""
        return cls.from_rows(rules.collect(), strings.collect())

    @classmethod
    def define(cls, *definitions: tuple[str, dict[str, str], str]) -> RuleSet:
        """Rules written in Python: ``(name, {"$a": "text", "$b": "/regex/"}, condition)``.

        A value written ``/…/`` is a regular expression, ``{ … }`` a hex string,
        anything else text.
        """
        rule = Row(*RULES.fieldNames())
        string = Row(*RULE_STRINGS.fieldNames())
        rules, strings = [], []
        for name, values, condition in definitions:
            rules.append(rule(name, None, condition, False))
            for identifier, value in values.items():
                is_regex = len(value) > 1 and re.fullmatch(r"/.*/[is]*", value, re.S)
                kind = "regex" if is_regex else "hex" if value.startswith("{") else "text"
                if kind == "text":
                    value = value.replace("\\", "\\\\")
                strings.append(string(
                    name, identifier, kind, value.strip("{}") if kind == "hex" else value,
                    False, False, False, False,
                ))
        return cls.from_rows(rules, strings)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        rules = [(r.rule_id, r.rule_file, r.sql, r.private) for r in self.rules]
        strings = [(s.rule_id, s.identifier, s.regex, s.flags) for s in self.strings]
        return (
            spark.createDataFrame(rules, "rule_id string, rule_file string, condition_sql string, private boolean"),
            spark.createDataFrame(strings, "rule_id string, string_id string, pattern string, flags string"),
        )
