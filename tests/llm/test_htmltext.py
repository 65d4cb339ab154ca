import html as escape
import re

import pytest

from iocscan.llm.htmltext import content_lines, extract_main_text, main_text

from .helpers import empty, table

LONG = "This paragraph has a good deal of text in it, so that it counts as content of the page."
CASES = {
    "plain": (f"<html><body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{LONG}<p>Short.</article><footer>c</footer>",
              f"Title\n\n{LONG}\n\nShort."),
    "references": ("<article><p>a &amp; b &lt;c&gt; &eacute;&#233;&#xe9; &nbsp; d</p></article>", "a & b <c> ééé d"),
    "white space": ("<article><p>one\n  two\t<b>three</b><br>four</p></article>", "one two three four"),
    "scripts": (f"<article><script>if (a<b) '</p>'</script><style>p{{}}</style><p>{LONG}</p><noscript>no</noscript></article>", LONG),
    "boxes": (
        f"<main><div class='cookie-notice'>We use cookies</div><div id=sidebar><p>{LONG}</p></div><p>{LONG}</p><form><p>Your name</p></form>"
        f"<section class='comments'><p>{LONG} {LONG}</p></section><aside>more</aside></main>", LONG),
    "no article": (
        f"<body><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><div><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div>"
        "<div><a href=3>Imprint</a></div></body>", f"{LONG}\n\nYes.\n\n{LONG}"),
    "only text": ("just text", "just text"),
    "unclosed": (f"<article><p><b>{LONG}<br><p>Next<p>Last</article><footer>x</footer>", f"{LONG}\n\nNext\n\nLast"),
    "cut off": (f"<article><p>{LONG}</p><p>and the en", f"{LONG}\n\nand the en"),
    "only a menu": ("<nav><a href=1>One</a></nav>", ""),
    "comment": (f"<article><!-- <p>no</p> --><p>{LONG}</p></article>", LONG),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    page, text = CASES[name]
    assert main_text(page) == text


def test_ratio_clusters():
    lines = [("x" * n, tags, 0, ()) for n, tags in ((5, 4), (6, 5), (300, 1), (280, 2), (310, 1), (4, 6), (5, 9), (6, 8), (5, 5))]
    assert content_lines(lines) == [False, True, True, True, True, True, False, False, False]


def test_given_pages(spark):
    """The articles of the given pages, cut out by their marks."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r.id: r.text for r in extract_main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(escape.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert found[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_odd_rows(spark):
    deep = "<div>" * 2000 + f"<p>{LONG}</p>" + "</div>" * 2000
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "v", "<article><p>x</p></article>"), (3, "w", deep),
            (4, "z", "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"), (5, "q", "<<<>>> &#xFFFFFFF; <p"), (6, "r", "\x00<p>�</p>")]
    found = extract_main_text(table(spark, rows, "page_id long, url string, html string")).collect()
    assert [(r.id, r.url) for r in found] == [r[:2] for r in rows]
    texts = [r.text for r in found]
    assert texts[:5] == ["", "", "", "x", LONG] and texts[5].count(LONG) == 20_000
    assert extract_main_text(empty(spark, "page_id long, url string, html string")).collect() == []


BODY = "".join(f"<p>{LONG} {LONG}</p>" for _ in range(20))
BODY_TEXT = "\n\n".join([f"{LONG} {LONG}"] * 20)


@pytest.mark.parametrize(("page", "text"), [
    (f"<article><h1>Title</h1><p>Lead.</p><div class='entry-content'>{BODY}</div></article>", f"Title\n\nLead.\n\n{BODY_TEXT}"),
    (f"<main><h1>Title</h1><article>{BODY}</article><p>End.</p></main>", f"Title\n\n{BODY_TEXT}\n\nEnd."),
    (f"<main><article><h1>Title</h1>{BODY}</article><article><p>Another.</p></article></main>", f"Title\n\n{BODY_TEXT}"),
    (f"<body><ul><li><a href=1>One</a></li></ul><div><h1>Title</h1><p>Lead.</p><div>{BODY}</div><p>End.</p></div><div><a href=3>Imprint</a></div></body>",
     f"Title\n\nLead.\n\n{BODY_TEXT}\n\nEnd."),
    (f"<body><div><h1>Title</h1><p>Lead.</p>{BODY}<p>End.</p></div></body>", f"Title\n\nLead.\n\n{BODY_TEXT}\n\nEnd."),
])
def test_titles_and_leads_stay(page, text):
    assert main_text(page) == text
