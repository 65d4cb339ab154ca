"""Content detector: rules on scan units.

The content column never takes part in a shuffle. Two strategies give the same
atoms (facts on one unit, see ``rules``):

* *native*: every atom is a built-in expression over the content, all of them in
  one projection. Used for rule sets of moderate size.
* *arrow*: one pass of ``mapInArrow`` with a multi-string automaton and Python
  regular expressions. Used for large rule sets, for expressions that Java
  would match recursively, and for files that were read in chunks.

Conditions are Spark SQL over the atoms in both cases. Matches with their
offsets are collected afterwards, only for the units with a finding.
"""

from __future__ import annotations

import math
import re
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from iocscan.functions.content import latin1
from iocscan.operators.findings import COLUMNS, exploded, finding, positions_where
from iocscan.operators.rules import EXTERNALS, Atom, ByteString, Rule, RuleSet
from iocscan.schemas import FINDING, STRING_MATCHES, YARA

#: More strings than this are searched in one pass by the automaton. Measured:
#: a native search reads about 330 MB/s and string, the automaton about 40 MB/s
#: whatever the number of strings.
NATIVE_STRINGS = 16
#: From here on a multi-string automaton is faster than one search per string.
AUTOMATON_STRINGS = 12
#: Shorter fixed parts of expressions occur too often to be worth a place in it.
MIN_ANCHOR = 3

CARRIED = (
    "artifact_path", "found_in_file", "unit_id", "value_data", "contained_file",
    "filename", "filepath", "extension", "filetype", "md5", "owner",
)


# --- native strategy ---------------------------------------------------------


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def _present(s: ByteString) -> Column:
    content = F.col("content")
    if s.literals:
        return _any([F.contains(content, F.lit(x)) for x in s.literals])
    if s.folded is not None:
        return F.contains(F.col("_folded"), F.lit(s.folded))
    found = F.col("_latin1").rlike(s.scoped)
    return F.contains(content, F.lit(s.anchor)) & found if s.anchor else found


def _overlaps_itself(data: bytes) -> bool:
    return any(data[:n] == data[-n:] for n in range(1, len(data)))


def _byte_exact(s: ByteString) -> bool:
    """Whether occurrences can be counted with plain string functions.

    These work on the bytes of a string and find occurrences that do not overlap,
    so they are exact for a single literal that cannot overlap itself.
    """
    return len(s.literals) == 1 and not _overlaps_itself(s.literals[0])


def _needs_text(atom: Atom, s: ByteString) -> bool:
    """Whether the atom is evaluated on the Latin-1 view of the content."""
    return not s.literals or (atom.kind in "co" and not _byte_exact(s))


def _native_atom(atom: Atom, s: ByteString) -> Column:
    """One atom as an expression over ``content`` or its Latin-1 view."""
    text, pattern = F.col("_latin1"), s.scoped
    if atom.kind == "p":
        return _present(s)
    if atom.kind in "co" and _byte_exact(s):
        raw, literal = F.col("content").cast("string"), F.lit(s.literals[0]).cast("string")
        count = (
            (F.octet_length(raw) - F.octet_length(F.replace(raw, literal, F.lit("")))) / len(s.literals[0])
        ).cast("long")
        if atom.kind == "c":
            return F.when(_present(s), count).otherwise(0).cast("long")
        before = F.octet_length(F.call_function("substring_index", raw, literal, F.lit(atom.args[0])))
        enough = _present(s) if atom.args[0] == 1 else _present(s) & (count >= atom.args[0])
        return F.when(enough, before.cast("long"))
    if atom.kind == "c":
        # a zero-width match at every start position counts overlapping hits too
        return F.when(_present(s), F.regexp_count(text, F.lit(f"(?={pattern})"))).otherwise(0).cast("long")
    if atom.kind == "o":
        nth = atom.args[0]
        if nth == 1:
            return F.when(_present(s), F.regexp_instr(text, F.lit(pattern)).cast("long") - 1)
        before = F.regexp_extract(
            text, rf"(?s)\A((?:.*?(?={pattern}).){{{nth - 1}}}.*?)(?={pattern})", 1
        )
        return F.when(
            _present(s) & (F.regexp_count(text, F.lit(f"(?={pattern})")) >= nth), F.length(before).cast("long")
        )
    if atom.kind == "t":
        at = atom.args[0]
        if s.literals:
            return _any([
                F.substring(F.col("content"), at + 1, len(x)) == F.lit(x) for x in s.literals
            ])
        return text.rlike(rf"(?s)\A.{{{at}}}{pattern}")
    low, high = atom.args[0], (atom.args[1] if len(atom.args) > 1 else None)
    if s.literals:
        return _any([
            F.contains(
                F.substring(
                    F.col("content"), low + 1, 2**31 - 1 if high is None else max(high - low, -1) + len(x)
                ),
                F.lit(x),
            ) for x in s.literals
        ])
    bound = "" if high is None else high
    return text.rlike(rf"(?s)\A.{{{low},{bound}}}?{pattern}")


def uses_arrow(rules: RuleSet) -> bool:
    return (
        len(rules.strings) > NATIVE_STRINGS
        or any(s.recursive for s in rules.strings)
        or any(a.kind == "o" and a.args[0] > 16 for a in rules.atoms.values())
    )


_ATOM_NAME = re.compile(r"'(?:\\.|[^'\\])*'|\b[pcotr]_\d+(?:_\d+)*\b")


def _hit_rules(rules: RuleSet, atom_sql=None, decided: set[int] = frozenset()) -> Column:
    """Array of the positions of the rules that hold, in rule order.

    ``atom_sql`` gives the expression of an atom where it is no column. Rules in
    ``decided`` are left out.
    """
    def place(m: re.Match) -> str:
        return m[0] if m[0].startswith("'") or atom_sql is None else atom_sql(rules.atoms[m[0]])

    return positions_where([
        (i, F.expr(_ATOM_NAME.sub(place, r.sql))) for i, r in rules.reported if i not in decided
    ])


def _with_external_names(units: DataFrame, keep: list[str]) -> DataFrame:
    """The variables of conditions, with ``-`` where a unit has none."""
    have = set(units.columns)
    values = {
        f"ext_{n}": F.coalesce(F.col(n), F.lit("-")) if n in have else F.lit("-") for n in EXTERNALS
    }
    size = F.col("filesize") if "filesize" in have else F.length("content").cast("long")
    return units.select(*keep, *[c.alias(n) for n, c in values.items()], size.alias("filesize"))


def _native_hits(units: DataFrame, rules: RuleSet, keep: list[str]) -> DataFrame:
    strings = {s.index: s for s in rules.strings}
    need_text = any(_needs_text(a, strings[a.string]) for a in rules.atoms.values())
    staged = _with_external_names(units, [*dict.fromkeys([*keep, "content"])])
    columns = staged.columns
    if need_text:
        staged = staged.select("*", latin1(F.col("content")).alias("_latin1"))
        if any(s.folded is not None for s in rules.strings):
            staged = staged.select("*", F.lower("_latin1").alias("_folded"))
    atoms = [_native_atom(a, strings[a.string]).alias(n) for n, a in rules.atoms.items()]
    return staged.select(*columns, *atoms).select(*keep, _hit_rules(rules, None).alias("rules"))


# --- arrow strategy ----------------------------------------------------------


class ByteSearch:
    """All match positions of a set of strings in one byte string.

    Literals and the fixed parts of expressions are found in one pass by an
    automaton; an expression is only tried where its fixed part occurs.
    """

    def __init__(self, strings: list[ByteString]):
        self.expressions = [s for s in strings if not s.literals]
        self.literals = [(x, s.index) for s in strings for x in s.literals]
        self.compiled = {
            s.index: re.compile(b"(?=(" + s.python.encode("latin-1") + b"))") for s in self.expressions
        }
        anchors = [s for s in self.expressions if s.anchor is not None and len(s.anchor) >= MIN_ANCHOR]
        self.automaton, self.anchored = None, frozenset()
        if len(self.literals) + len(anchors) < AUTOMATON_STRINGS:
            return
        import ahocorasick

        words: dict[str, tuple[int, list[int], list[int]]] = {}
        for data, index in self.literals:
            words.setdefault(data.decode("latin-1"), (len(data), [], []))[1].append(index)
        for s in anchors:
            words.setdefault(s.anchor.decode("latin-1"), (len(s.anchor), [], []))[2].append(s.index)
        self.anchored = frozenset(s.index for s in anchors)
        self.automaton = ahocorasick.Automaton()
        for text, found in words.items():
            self.automaton.add_word(text, found)
        self.automaton.make_automaton()

    def find(self, data: bytes, deadline: float = math.inf, ends: bool = True) -> Iterator[tuple[int, int, int]]:
        """(string, start, length) of every match; overlapping ones included.

        ``ends``: whether the data ends here. The end of a piece in the middle of a file is no place for an expression
        to end at the data's end: a byte is put after it, and a match that needs that byte has to hold without it as well.
        """
        fixed: set[int] = set()
        self._check(deadline)
        if self.automaton is not None:
            for end, (length, indexes, anchors) in self.automaton.iter(data.decode("latin-1")):
                for index in indexes:
                    yield index, end - length + 1, length
                if anchors:
                    fixed.update(anchors)
        else:
            for literal, index in self.literals:
                self._check(deadline)
                at = data.find(literal)
                while at >= 0:
                    yield index, at, len(literal)
                    at = data.find(literal, at + 1)
        for s in self.expressions:
            if s.index in self.anchored:
                if s.index not in fixed:
                    continue
            elif s.anchor is not None and s.anchor not in data:
                continue
            self._check(deadline)
            for m in self.compiled[s.index].finditer(data if ends else data + b"\0"):
                if m.end(1) > len(data):
                    m = self.compiled[s.index].match(data, m.start(1))
                    if m is None:
                        continue
                yield s.index, m.start(1), m.end(1) - m.start(1)

    @staticmethod
    def _check(deadline: float) -> None:
        if time.monotonic() > deadline:
            raise TimeoutError("scan of the unit took too long")


def _tally(search: ByteSearch, atoms: dict[int, list[Atom]], data: bytes, deadline: float, seen: set[int],
           base: int = 0, lead: int = 0, own: int | None = None, ends: bool = True) -> dict[str, list[int]]:
    """Values of the atoms that are not at rest: counts, positions, flags.

    The strings that occur are added to ``seen``.

    For a chunk, ``base`` is the position of its first byte in the file, and only
    matches that start in the ``own`` bytes after ``lead`` belong to it.
    """
    out: dict[str, list[int]] = {}
    places: dict[str, list[int]] = {}
    end = len(data) if own is None else lead + own
    for index, start, _ in search.find(data, deadline, ends):
        if not lead <= start < end:
            continue
        seen.add(index)
        position = base + start
        for atom in atoms.get(index, ()):
            name = atom.name
            if atom.kind == "p":
                out[name] = [1]
            elif atom.kind == "c":
                out.setdefault(name, [0])[0] += 1
            elif atom.kind == "t":
                if position == atom.args[0]:
                    out[name] = [1]
            elif atom.kind == "r":
                if atom.args[0] <= position and (len(atom.args) == 1 or position <= atom.args[1]):
                    out[name] = [1]
            else:
                kept = places.setdefault(name, [])
                kept.append(position)
                if len(kept) > 4 * atom.args[0]:
                    kept[:] = sorted(set(kept))[: atom.args[0]]
    for name, kept in places.items():
        nth = int(name.rsplit("_", 1)[1])
        out[name] = sorted(set(kept))[:nth]
    return out


def _decided_by_search(rules: RuleSet) -> dict[int, list[int]]:
    """Rules that hold as soon as one string occurs, by string."""
    out: dict[int, list[int]] = {}
    for i, r in rules.reported:
        for string in r.any_of or ():
            out.setdefault(string, []).append(i)
    return out


_ATOMS = T.MapType(T.StringType(), T.ArrayType(T.LongType()))


def _arrow_atoms(units: DataFrame, rules: RuleSet, keep: list[str], deadline_s: float | None, chunked: bool) -> DataFrame:
    """``keep`` columns, ``_atoms`` (name to values), ``_decided`` and ``error``.

    ``_decided`` has the rules for which one occurrence is enough, so that their
    conditions need no evaluation (not for chunks). Units in which nothing occurs are left out when no rule can hold for them.
    The rule set travels inside the function; its size is bounded by ``RuleSet``.
    """
    strings = rules.strings
    by_string: dict[int, list[Atom]] = {}
    for atom in rules.atoms.values():
        by_string.setdefault(atom.string, []).append(atom)
    skip_empty = rules.needs_match
    decides = {} if chunked else _decided_by_search(rules)
    if decides:
        # their atoms are not needed for anything else
        used = {a for i, r in enumerate(rules.rules) if r.any_of is None or r.private for a in r.atoms}
        by_string = {s: [a for a in atoms if a.name in used] for s, atoms in by_string.items()}
    staged = _with_external_names(units, [*dict.fromkeys([
        *keep, "content", *(["chunk_start", "chunk_lead", "chunk_length"] if chunked else [])
    ])])
    carried = [*keep, *[f"ext_{n}" for n in EXTERNALS], "filesize"]
    schema = T.StructType(
        [staged.schema[c] for c in carried]
        + [T.StructField("_atoms", _ATOMS), T.StructField("_decided", T.ArrayType(T.IntegerType())), T.StructField("error", T.StringType())]
    )
    arrow = to_arrow_schema(schema)

    def search(batches):
        finder = ByteSearch(strings)
        for batch in batches:
            rows, atoms, decided, errors = [], [], [], []
            content = batch.column("content")
            for i in range(batch.num_rows):
                data = content[i].as_py()
                if data is None:
                    continue
                place = {}
                if chunked:
                    start, lead = batch.column("chunk_start")[i].as_py(), batch.column("chunk_lead")[i].as_py()
                    place = {
                        "base": start - lead, "lead": lead, "own": batch.column("chunk_length")[i].as_py(),
                        "ends": start - lead + len(data) >= batch.column("filesize")[i].as_py()}
                seen: set[int] = set()
                try:
                    found = _tally(finder, by_string, data, math.inf if deadline_s is None else time.monotonic() + deadline_s, seen=seen, **place)
                    error = None
                except TimeoutError as late:
                    found, error = {}, str(late)
                    seen.clear()
                if found or seen or error or not skip_empty:
                    rows.append(i)
                    atoms.append(list(found.items()))
                    decided.append(sorted({r for s in seen for r in decides.get(s, ())}))
                    errors.append(error)
            if rows:
                taken = batch.select(carried).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[taken.column(c).cast(arrow.field(c).type) for c in carried],
                        pa.array(atoms, arrow.field("_atoms").type),
                        pa.array(decided, arrow.field("_decided").type),
                        pa.array(errors, pa.string()),
                    ],
                    schema=arrow,
                )

    return staged.mapInArrow(search, schema)


def _atom_from_map(atom: Atom) -> str:
    value = f"_atoms['{atom.name}']"
    if atom.kind == "c":
        return f"coalesce({value}[0], 0L)"
    if atom.kind == "o":
        return f"get({value}, {atom.args[0] - 1})"
    return f"({value} is not null)"


def _merged_chunks(rows: DataFrame, rules: RuleSet, keep: list[str]) -> DataFrame:
    """Atoms of a file from the atoms of its chunks.

    Only facts are shuffled, never content, and at most one value list per atom
    and chunk; counts and flags are combined before the shuffle.
    """
    file_columns = [c for c in dict.fromkeys([*keep, *[f"ext_{n}" for n in EXTERNALS], "filesize"])]
    facts = rows.select(
        *file_columns, "error", F.explode_outer("_atoms").alias("name", "values")
    )
    position = F.col("name").startswith("o_")
    per_atom = facts.groupBy(*file_columns, "name").agg(
        F.sum(F.when(~position, F.col("values")[0])).alias("total"),
        F.collect_list(F.when(position, F.col("values"))).alias("places"),
        F.max("error").alias("error"),
    )
    values = F.when(position, F.array_sort(F.flatten("places"))).otherwise(F.array("total"))
    return per_atom.groupBy(*file_columns).agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", values.alias("values"))))
        ).alias("_atoms"),
        F.max("error").alias("error"),
    )


# --- verdicts and findings ---------------------------------------------------


def unit_hits(
    units: DataFrame,
    rules: RuleSet,
    keep: list[str] | None = None,
    deadline_s: float | None = None,
    arrow: bool | None = None,
) -> DataFrame:
    """``keep`` columns of each unit, ``rules`` (positions of the rules that hold) and ``error``.

    A unit in error has no rules. With a deadline, which built-in expressions cannot keep, the Arrow strategy is taken.
    """
    keep = [c for c in CARRIED if c in units.columns] if keep is None else keep
    chunked = "chunk_start" in units.columns
    if not (uses_arrow(rules) or chunked or deadline_s is not None if arrow is None else arrow):
        return _native_hits(units, rules, keep).withColumn("error", F.lit(None).cast("string"))
    rows = _arrow_atoms(units, rules, keep, deadline_s, chunked)
    if chunked:
        rows = _merged_chunks(rows, rules, keep)
        return rows.select(*keep, _unless_error(_hit_rules(rules, _atom_from_map)).alias("rules"), "error")
    decided = {i for i, r in rules.reported if r.any_of is not None}
    hits = F.concat("_decided", _hit_rules(rules, _atom_from_map, decided))
    return rows.select(*keep, _unless_error(F.array_sort(hits)).alias("rules"), "error")


def _unless_error(hits: Column) -> Column:
    """No verdict on a unit that was not searched to its end."""
    return F.when(F.col("error").isNull(), hits).otherwise(F.array().cast("array<int>"))


def rule_name(rules: RuleSet, position: Column) -> Column:
    return F.lit([r.rule_id for r in rules.rules])[position]


def rule_outcomes(units: DataFrame, rules: RuleSet, deadline_s: float | None = None) -> DataFrame:
    """Findings as in ``rule_findings``, and one row with a ``message`` for each unit that was not searched to its end."""
    hits = unit_hits(units, rules, deadline_s=deadline_s)
    kept = ["artifact_path", "found_in_file", "value_data", "contained_file", "error"]
    numbers = F.when(F.col("error").isNull(), F.col("rules")).otherwise(F.array(F.lit(-1)))
    return exploded(hits, numbers, "rule", *kept).select(
        finding(
            YARA, rule_name(rules, F.greatest("rule", F.lit(0))), F.col("artifact_path"), F.col("found_in_file"),
            F.col("value_data"), F.col("contained_file"),
        ).alias("f"), F.col("error").alias("message")
    ).select("f.*", "message")


def rule_findings(units: DataFrame, rules: RuleSet, deadline_s: float | None = None, arrow: bool | None = None) -> DataFrame:
    """One finding per unit and rule, without the matches."""
    hits = unit_hits(units, rules, deadline_s=deadline_s, arrow=arrow)
    kept = ["artifact_path", "found_in_file", "value_data", "contained_file"]
    return exploded(hits, F.col("rules"), "rule", *kept).select(
        finding(
            YARA, rule_name(rules, F.col("rule")), F.col("artifact_path"), F.col("found_in_file"),
            F.col("value_data"), F.col("contained_file"),
        ).alias("f")
    ).select("f.*")


def rule_findings_with_matches(
    units: DataFrame, rules: RuleSet, deadline_s: float | None = None, arrow: bool | None = None
) -> DataFrame:
    """One finding per unit and rule with all strings of the rule and their matches.

    A string without a match is kept with an empty list. The content goes to
    Python only for units on which a rule holds.
    """
    keep = [c for c in CARRIED if c in units.columns]
    hits = unit_hits(units, rules, keep=[*keep, "content"], deadline_s=deadline_s, arrow=arrow)
    # the same trick as in ``exploded``, to evaluate the rules once
    kept = [c for c in hits.columns if c != "rules"]
    held = exploded(hits, F.array("rules"), "rules", *kept).where(F.size("rules") > 0)
    return collect_matches(held, rules)


def _match_lists(search: ByteSearch, rule: Rule, data: bytes, base: int = 0, lead: int = 0,
                 own: int | None = None, ends: bool = True) -> list[dict]:
    """All strings of a rule with their matches in order; see ``_tally`` for chunks."""
    end = len(data) if own is None else lead + own
    found: dict[int, set] = {s.index: set() for s in rule.strings}
    for index, start, length in search.find(data, ends=ends):
        if lead <= start < end:
            found[index].add((start, length))
    return [
        {"identifier": s.identifier, "matches": [
            {"offset": base + start, "data": data[start:start + length]}
            for start, length in sorted(found[s.index])
        ]} for s in rule.strings
    ]


def collect_matches(hits: DataFrame, rules: RuleSet) -> DataFrame:
    """Findings with matches from units (with content) and the rules that hold."""
    arrow = to_arrow_schema(FINDING)
    all_rules = rules.rules

    def collect(batches):
        searches: dict[int, ByteSearch] = {}
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in
                       ("artifact_path", "found_in_file", "value_data", "contained_file", "rules")}
            content = batch.column("content")
            out: dict[str, list] = {c: [] for c in COLUMNS}
            for i in range(batch.num_rows):
                data = content[i].as_py()
                for position in columns["rules"][i]:
                    rule = all_rules[position]
                    if position not in searches:
                        searches[position] = ByteSearch(rule.strings)
                    out["scanner"].append(YARA)
                    out["rule_name"].append(rule.rule_id)
                    for c in ("artifact_path", "found_in_file", "value_data", "contained_file"):
                        out[c].append(columns[c][i])
                    out["part"].append(0)
                    out["strings"].append(_match_lists(searches[position], rule, data))
            if out["scanner"]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[c], arrow.field(c).type) for c in COLUMNS], schema=arrow
                )

    return hits.select(
        "artifact_path", "found_in_file", "value_data", "contained_file", "rules", "content"
    ).mapInArrow(collect, FINDING).withColumn("part", F.lit(0).cast("long"))  # known to the plan


#: Copies of the verdicts of large files, so that the pieces of one file are
#: joined to them in several tasks.
CHUNK_SALTS = 16


def chunked_findings_with_matches(pieces: DataFrame, rules: RuleSet, deadline_s: float | None = None) -> DataFrame:
    """Findings with matches for files that were read in pieces.

    The list of all matches in a huge file is never built: part 1 of a finding
    has the strings without any match, and every piece with matches adds a part 2 (see ``schemas.FINDING``).
    """
    keep = [c for c in CARRIED if c in pieces.columns]
    seen = RuleSet(rules.rules)
    for s in rules.strings:
        presence = Atom("p", s.index)
        seen.atoms[presence.name] = presence
    merged = _merged_chunks(_arrow_atoms(pieces, seen, keep, deadline_s, True), seen, keep)
    verdicts = (
        merged.select(*keep, _unless_error(_hit_rules(seen, _atom_from_map)).alias("rules"), "_atoms")
        .select("*", F.explode_outer("rules").alias("rule")).where(F.col("rule").isNotNull())
    )
    none = F.array().cast("array<struct<offset:bigint,data:binary>>")
    absent = F.array(*[
        F.array_compact(F.array(*[
            F.when(
                F.col("_atoms")[f"p_{s.index}"].isNull(),
                F.struct(F.lit(s.identifier).alias("identifier"), none.alias("matches")),
            ) for s in r.strings
        ])) if r.strings else F.array().cast(STRING_MATCHES)
        for r in rules.rules
    ])[F.col("rule")]
    absent = F.when((F.size(absent) > 0) | F.lit([not r.strings for r in rules.rules])[F.col("rule")], absent)
    first = verdicts.select(
        finding(
            YARA, rule_name(rules, F.col("rule")), F.col("artifact_path"), F.col("found_in_file"),
            F.col("value_data"), F.col("contained_file"), F.lit(1), absent,
        ).alias("f")
    ).select("f.*")
    all_rules = [(i, r) for i, r in rules.reported if r.strings]
    schema = T.StructType([
        T.StructField("found_in_file", T.StringType()), T.StructField("rule", T.IntegerType()),
        T.StructField("place", T.LongType()), T.StructField("strings", STRING_MATCHES),
    ])
    arrow = to_arrow_schema(schema)

    def collect(batches):
        searches = [(i, r, ByteSearch(r.strings)) for i, r in all_rules]
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                place = {
                    "base": row["chunk_start"] - row["chunk_lead"], "lead": row["chunk_lead"],
                    "own": row["chunk_length"],
                    "ends": row["chunk_start"] - row["chunk_lead"] + len(row["content"]) >= row["filesize"],
                }
                for i, rule, search in searches:
                    lists = _match_lists(search, rule, row["content"], **place)
                    if any(x["matches"] for x in lists):
                        out.append({
                            "found_in_file": row["found_in_file"], "rule": i,
                            "place": row["chunk_start"], "strings": lists,
                        })
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    matches = pieces.select(
        "found_in_file", "chunk_start", "chunk_lead", "chunk_length", "filesize", "content"
    ).mapInArrow(collect, schema).withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(CHUNK_SALTS)).cast("int"))
    salted = verdicts.select(
        "artifact_path", "found_in_file", "value_data", "contained_file", "rule",
        F.explode(F.sequence(F.lit(0), F.lit(CHUNK_SALTS - 1))).alias("salt"),
    )
    further = matches.join(salted, ["found_in_file", "rule", "salt"]).select(
        finding(
            YARA, rule_name(rules, F.col("rule")), F.col("artifact_path"), F.col("found_in_file"),
            F.col("value_data"), F.col("contained_file"), F.lit(2), F.col("strings"),
        ).alias("f")
    ).select("f.*")
    return first.unionByName(further)


def may_match(rules: RuleSet, text: Column) -> Column | None:
    """A cheap test on a larger text that all units with a finding are taken from.

    Every rule must need a match and every string must have a fixed part. Texts
    with a backslash always pass, as an escape may hide the fixed part.
    """
    used = {a.string for a in rules.atoms.values()}
    strings = [s for s in rules.strings if s.index in used]
    if not rules.needs_match or not all(s.literals or s.anchor or s.folded for s in strings):
        return None
    tests = [F.contains(text, F.lit("\\"))]
    for s in strings:
        if s.folded is not None:
            tests.append(F.contains(F.lower(text), F.lit(s.folded)))
        else:
            tests += [F.contains(text.cast("binary"), F.lit(x)) for x in s.literals or (s.anchor,)]
    return _any(tests)


def string_matches(findings: DataFrame) -> DataFrame:
    """The matches of findings as flat rows."""
    return (
        findings.select("rule_name", "artifact_path", "found_in_file", "value_data", F.explode("strings").alias("s"))
        .select("*", F.explode("s.matches").alias("m"))
        .select(
            "rule_name", "artifact_path", "found_in_file", "value_data",
            F.col("s.identifier").alias("string_id"), F.col("m.offset").alias("offset"), F.col("m.data").alias("data"),
        )
    )
