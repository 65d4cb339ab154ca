import hashlib

from pyspark.sql import functions as F

from iocscan.llm import fingerprints as fp

from .helpers import edited, empty, odd_rows, sentence, table


def shingles(text):
    w = [x for x in (text or "").lower().split() if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_estimates(spark):
    base = sentence(1, 900)
    rows = [(1, base, edited(base, 2, 30)), (2, base, base), (3, base, base + " " + sentence(5, 900)), (4, "", None), (5, "a b", "c d"), (6, "", "x")]
    df = spark.createDataFrame(rows, "n long, text string, other string")
    df = fp.fingerprints(fp.fingerprints(df), "other", name="second")
    got = df.select(
        "n", fp.resemblance(F.col("sketch"), F.col("second")).alias("r"), fp.containment(F.col("sketch"), F.col("second")).alias("c"),
        fp.distinct_shingles(F.col("second")).alias("d"), (fp.from_text(fp.as_text(F.col("sketch"))) == F.col("sketch")).alias("same")).collect()
    for r, (_, x, y) in zip(sorted(got), rows, strict=True):
        a, b = shingles(x), shingles(y)
        union = len(a | b)
        assert abs(r.r - (len(a & b) / union if union else 1.0)) < 0.15
        assert abs(r.c - (len(a & b) / len(a) if a else 1.0)) < 0.3
        assert abs(r.d - len(b)) <= 0.35 * len(b)
        assert r.same


def test_parts_merge_into_the_whole(spark):
    rows = [(g, sentence(1000 * g + i, 60)) for g in (1, 2) for i in range(40)] + [(3, None), (None, "a b c d e f")]
    parts = fp.fingerprints(spark.createDataFrame(rows, "g long, text string"))
    merged = {r.group: r.sketch for r in fp.merge_parts(parts, "g").collect()}
    single = {}
    for r in parts.collect():
        single.setdefault(r.g, set()).update(r.sketch)
    assert merged == {g: sorted(hashes)[:fp.K] for g, hashes in single.items()}


def test_odd_rows_keep_their_columns(spark):
    df = table(spark, odd_rows())
    found = fp.fingerprints(df)
    assert found.columns == [*df.columns, "sketch"]
    by_text = {}
    for r in found.select("text", "sketch").collect():
        assert by_text.setdefault(r.text or "", r.sketch) == r.sketch
        assert len(r.sketch) == min(fp.K, len(shingles(r.text))) or len(r.sketch) == fp.K
    assert fp.fingerprints(empty(spark)).collect() == []


def test_next_row(spark):
    rows = [(i * i, f"t{i}") for i in range(60)] + [(-9, "low"), (10 ** 12, "far")]
    for each in (5, 1000):
        got = {r.id: r.next.text for r in fp.with_next(spark.createDataFrame(rows, "id long, text string"), ["text"], rows_each=each).collect()}
        order = sorted(rows, reverse=True)
        assert got == {a[0]: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True)}
    one = fp.with_next(spark.createDataFrame([(4, "only")], "id long, text string"), ["text"]).collect()
    assert one[0].next.text == "only"
    assert fp.with_next(empty(spark, "id long, text string"), ["text"]).collect() == []


def test_query_edits(spark):
    from iocscan.llm.queries import QUERIES
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    rows = QUERIES["op4_document_fingerprints"](spark, folder)
    assert not [n for n in rows._jdf.queryExecution().toString().split() if "Python" in n or "Pandas" in n or "Arrow" in n]
    for r in rows.collect():
        text, after = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        third = len(text) // 3
        changed = text[:len(text) - third] + after[:third]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        for near, other in ((r.near_edited, changed), (r.near_next, after)):
            a, b = shingles(text), shingles(other)
            assert 0 <= near <= 1 and abs(near - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.2
