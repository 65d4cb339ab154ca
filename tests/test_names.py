import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from iocscan.api import one_pass, scan
from iocscan.functions.names import WELL_KNOWN_NAMES, basename, extension
from iocscan.functions.patterns import name_pattern, required_literal
from iocscan.operators import names
from iocscan.sources.iocs import filename_patterns, pattern_table


def artifacts(spark, *paths):
    return spark.createDataFrame([(p, p.rsplit("/", 1)[-1], bytearray(b"")) for p in paths],
                                 "path string, basename string, content binary")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(spark, *given):
    found = one_pass(artifacts(spark, *given), watched=WELL_KNOWN_NAMES)
    return {(r.found_in_file, r.rule_name) for r in found.collect()}


def test_equal_names_are_no_hit(spark):
    assert near(spark, "/x/explorer.exe", "/x/svchost.exe") == set()


def test_one_edit(spark):
    assert near(spark, "/x/expl0rer.exe", "/x/explor3r.exe", "/x/3xplorer.exe") == {
        ("/x/expl0rer.exe", "explorer.exe"), ("/x/explor3r.exe", "explorer.exe"), ("/x/3xplorer.exe", "explorer.exe"),
    }


def test_two_edits_case_and_transposition_are_no_hits(spark):
    assert near(spark, "/3xpl0rer.exe", "/expl0r3r.exe", "/vschost.exe", "/LSASS.EXE") == set()


def test_one_name_can_hit_twice(spark):
    assert {k for _, k in near(spark, "/explore.exe")} == {"explorer.exe", "iexplore.exe"}


def test_edits_are_counted_in_characters(spark):
    assert near(spark, "/lsäss.exe") == {("/lsäss.exe", "lsass.exe")}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    left=st.sets(st.text(alphabet="aé𝄞b", max_size=5), min_size=1, max_size=40),
    right=st.sets(st.text(alphabet="aé𝄞b", max_size=5), min_size=1, max_size=40),
)
def test_deletion_join_equals_brute_force(spark, left, right):
    a = spark.createDataFrame([(x,) for x in left], "basename string")
    b = spark.createDataFrame([(x,) for x in right], "known string")
    pairs = [(r.basename, r.known) for r in names.near_miss_pairs(a, b, broadcast=False).collect()]
    assert sorted(pairs) == sorted((x, y) for x in left for y in right if edits(x, y) == 1)


def test_large_watch_list_gives_the_same(spark, monkeypatch):
    rows = artifacts(spark, *[f"/{i}/expl0rer.exe" for i in range(50)], "/y/explore.exe", "/z/none.txt")
    known = spark.createDataFrame([(n,) for n in WELL_KNOWN_NAMES], "known string")
    small = {(r.found_in_file, r.rule_name) for r in one_pass(rows, watched=WELL_KNOWN_NAMES).collect()}
    for limit in (1000, 0):
        monkeypatch.setattr(names, "BROADCAST_NAMES", limit)
        found = names.near_misses(rows, known).collect()
        assert {(r.found_in_file, r.rule_name) for r in found} == small and len(found) == len(small)


def test_parts_of_paths(spark):
    given = ["/a/b.txt", "/a/.bashrc", "/a/x.tar.gz", "/a/none", "name.", "a b.c"]
    rows = spark.createDataFrame([(p,) for p in given], "p string").select(
        basename(F.col("p")).alias("b"), extension(basename(F.col("p"))).alias("e")
    ).collect()
    assert [(r.b, r.e) for r in rows] == [
        ("b.txt", "txt"), (".bashrc", "-"), ("x.tar.gz", "gz"), ("none", "-"), ("name.", ""), ("a b.c", "c"),
    ]


@pytest.mark.parametrize("pattern, text, hit", [
    ("^a$", "a", True), ("^a$", "a\n", False), (r"^\d$", "٣", True), ("^.$", "\r", True), ("^.$", "\n", False),
    ("a|b", "xxb", True), (r"\$", "a$", True), ("[$]", "a$", True), ("(?:$)", "", True), ("^[[:alpha:]]+$", "abc", True),
    ("^[[:alpha:]]+$", "ab1", False), ("(?i)ABC", "xabcx", True), ("(?P<n>a)b", "ab", True), (r"\w", "é", True),
])
def test_pattern_dialect(spark, pattern, text, hit):
    row = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(name_pattern(pattern)).alias("hit")).first()
    assert row.hit is hit


@pytest.mark.parametrize("pattern", [r"(a)\1", "(?=a)", "(?<!a)b", "(", "a**("])
def test_bad_patterns_fail_at_once(spark, pattern):
    with pytest.raises(ValueError):
        filename_patterns(spark, [pattern])


def test_same_pattern_twice_gives_two_findings(spark):
    found = scan(artifacts(spark, "/x/a.txt"), filename_patterns=["txt", "txt"]).findings
    assert found.count() == 2


def test_exclusion_is_on_the_name_only(spark):
    found = scan(artifacts(spark, "/tmp/a", "/b/tmp", "/b/c"), filename_patterns=[""], exclude="tmp").findings
    assert {r.found_in_file for r in found.collect()} == {"/tmp/a", "/b/c"}


@pytest.mark.parametrize("pattern, literal", [
    ("^expl", "expl"), ("[.]txt$", ".txt"), (r"a\.exe", "a.exe"), ("abc?de", "ab"), ("ab+cd", "ab"), ("abc{0,2}xy", "ab"), ("a|bcd", ""),
    ("(abc|d)efg", "efg"), ("((x)yz)*qrs", "qrs"), ("(?i)abc", ""), ("(?:abc)?de", "de"), (r"\x41bc", ""), (r"\d\dabc", "abc"), (r"\Qa.b\E", ""),
    ("[ab]cde", "cde"), ("[^a]bc", "bc"), ("", ""), ("(?P<n>abc)d", "d"), (r"\p{L}abc", "abc"), ("abc*?de", "ab"), ("𝄞é漢+", "𝄞é漢"),
])
def test_required_literals(pattern, literal):
    assert required_literal(pattern) == literal


_NAMES = ["doc_12.txt", "doc_1.txt", "aaa.exe", "a", "", "é𝄞x.txt", "svchost.exe", "x.exe", "abcabc", "line\nfeed.txt"]
_PATTERNS = [
    "^doc_1", "[.]txt$", "a.a", "", "abc(abc)?$", "x$", "^$", "exe", "exe", "nowhere", "é𝄞x", "(?i)EXE", "a|host", "d?oc_1{1}2", r"\.exe$", "(c|x)\\.e+xe"]


def test_pattern_tables_equal_single_expressions(spark, monkeypatch):
    rows = artifacts(spark, *[f"/d{i % 3}/{n}" for i, n in enumerate(_NAMES * 3)])
    single = sorted((r.found_in_file, r.rule_name) for r in one_pass(rows, patterns=filename_patterns(spark, _PATTERNS)).collect())
    assert len(single) > 30
    for limit in (20_000, 0):
        monkeypatch.setattr(names, "BROADCAST_PATTERNS", limit)
        found = names.pattern_findings(rows, pattern_table(spark, _PATTERNS)).collect()
        assert sorted((r.found_in_file, r.rule_name) for r in found) == single
    monkeypatch.setattr(names, "INLINE_PATTERNS", 3)
    assert sorted((r.found_in_file, r.rule_name) for r in scan(rows, filename_patterns=_PATTERNS).findings.collect()) == single


def test_pattern_tables_with_odd_rows(spark):
    table = spark.createDataFrame([("txt",), (None,)], "pattern string")
    rows = spark.createDataFrame([("/a.txt", "a.txt", 1), ("/none", None, 2)], "path string, basename string, pattern int")
    assert [r.found_in_file for r in names.pattern_findings(rows, pattern_table(spark, table)).collect()] == ["/a.txt"]
    assert names.pattern_findings(rows, pattern_table(spark, table.limit(0))).collect() == []
    with pytest.raises(Exception):
        names.pattern_findings(rows, pattern_table(spark, ["fine", "a**("])).collect()
