import re

from iocscan.llm import decontaminate
from iocscan.llm.decontaminate import contaminated_spans

from .helpers import LOWER, empty, odd_rows, sentence, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        width = min(size, len(w))
        for i in range(len(w) - width + 1) if width else ():
            windows.setdefault(tuple(w[i:i + width]), set()).add(str(item) if item is not None else "")
    out = []
    for doc, text in docs:
        w, hit, named = WORD.findall((text or "").translate(LOWER)), set(), set()
        for width in {len(x) for x in windows}:
            for i in range(len(w) - width + 1):
                if tuple(w[i:i + width]) in windows:
                    hit.update(range(i, i + width))
                    named |= windows[tuple(w[i:i + width])]
        out.append((doc, len(w), tuple(sorted(hit)), tuple(sorted(named))))
    return sorted(out, key=str)


def flat(rows):
    return sorted(((
        r.id, r.n_words, tuple(p for s in r.spans for p in range(s.start, s.start + s.length)), tuple(r["items"])) for r in rows), key=str)


def inputs():
    rows = odd_rows()
    passage = " ".join(sentence(1, 300).split()[100:140])
    rows += [(300, f"before, {passage.upper()}; after"), (301, "ends with Three-Short words"), (302, "three short words three SHORT words")]
    items = [
        (1, passage), (2, passage), (2, sentence(77, 25)), (3, "three short words"), (4, None), (5, ""), (6, "?!"), (None, "One two"),
        (7, " ".join(sentence(3, 40_000, 5_000).split()[39_000:39_030])), (8, "ünïcode i̇stanbul"), (9, sentence(78, 12))]
    return rows, items


def test_same_as_brute_force(spark):
    rows, items = inputs()
    found = contaminated_spans(table(spark, rows), table(spark, items, "item_id long, text string"))
    assert flat(found.collect()) == brute(rows, items)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 25)
    rows, items = inputs()
    rows = [r for r in rows if len(r[1] or "") < 10_000]
    found = contaminated_spans(table(spark, rows), table(spark, items, "item_id long, text string"))
    assert flat(found.collect()) == brute(rows, items)


def test_empty_tables(spark):
    items = table(spark, [(1, "some words")], "item_id long, text string")
    assert contaminated_spans(empty(spark), items).collect() == []
    rows = contaminated_spans(table(spark, [(1, "some words"), (2, None)]), empty(spark, "item_id long, text string")).collect()
    assert [(r.id, r.n_words, r.spans, r["items"]) for r in rows] == [(1, 2, [], []), (2, 0, [], [])]
