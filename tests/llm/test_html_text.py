import random

import numpy as np
import pytest

from timeloom.llm.common import table
from timeloom.llm.html_text import WINDOW, extract_pages, main_text, passages

P = "A paragraph that is long enough to be the text of an article, with words and more words."


@pytest.mark.parametrize("html, want", [
    ("", ""), ("no markup at all, just some text", "no markup at all, just some text"), ("<", "<"), ("<p>&lt;b&gt; &amp;amp; &#233;&nbsp;x</p>", "<b> &amp; é x"),
    (f"<body><nav><a href=x>menu</a></nav><article><h1>T</h1><p>{P}<br>more</p><p>Of.</p></article><footer>&copy; f</footer>", f"T\n{P} more\nOf."),
    ('<script>var t="</p>";<b></script><article><p>a<script>x</script>b</p></article>', "ab"),
    ("<article><header><h1>Head</h1></header><p>x</p><aside>side</aside><div class='comments'><p>nice</p></div><p>y</p></article>", "Head\nx\ny"),
    ("<article><p>a  \n b</p><!-- no --><form>f<input></form><div class=ad>ad</div><p>c</article>", "a b\nc"),
    (f"<div class=sidebar>{P}</div><div class='cookie-notice'>{P}</div><div id=content><p>{P}</p><p>Short.</p><p>{P}</p></div><div class=footer>{P}</div>", f"{P}\nShort.\n{P}"),
    ("<article class=post><div class='entry-header'><h1>Head</h1></div><div class='side-by-side'><p>x</p></div><article class='comment'><p>nice</p></article></article>", "Head\nx"),
    ("<embed src=a><article><p>a</p><embed src='b'><p>b<EMBED src=c/>c</p></article>", "a\nbc"), (f"<p>{P}</p><embed src=a type='x/y'><p>{P}</p>", f"{P}\n{P}"),
    (f"<form action=x><div id=content><p>{P}</p><p>{P}</p></div><input></form>", f"{P}\n{P}"), (f"<form><article><p>{P}</p></article></form>", P),
    (f"<article><p>{P}</p><section id='related-work'><p>r</p></section><section id=search-trees><p>s</p></section><div id=related><p>no</p></div><div class='related-posts'>no</div></article>", f"{P}\nr\ns"),
    # a passage outside teasers is found by its own distribution, a notice isn't
    (f"<article><p>Teaser.</p></article>" + "<div><p>x</p></div>" * 1 + f"<div>{''.join(f'<p>{P} {P} {P}</p>' for _ in range(4))}</div>", "\n".join(["Teaser.", *[f"{P} {P} {P}"] * 4])),
    (f"<p>We use cakes here. {P}</p><article><p>{P}</p><p>Of.</p></article><p>{P}</p>", f"{P}\nOf."),
    ("<nav>only menus</nav>", ""), ("<article><p>one<p>two<li>three</article>", "one\ntwo\nthree"),
])
def test_pages(html, want):
    assert main_text(html) == want


def slow_passages(sizes, level):
    """By the definition, line by line: the surge before a line, and no dive between."""
    n = len(sizes)
    window = lambda k: sum(sizes[k : k + WINDOW])
    return [sizes[k] > 0 and any(window(s) >= level and all(window(i) > 0 for i in range(s, k + 1)) for s in range(k + 1)) for k in range(n)]


def test_surge_and_dive_equal_brute_force():
    r = random.Random(6)
    for _ in range(300):
        sizes = [r.choice([0, 0, 0, 1, 20, 50, 100]) for _ in range(r.randrange(1, 25))]
        for level in (1, 60, 120):
            assert passages(np.array(sizes), level).tolist() == slow_passages(sizes, level)


def test_windows_decide_on_pages_without_article(spark):
    """The pages of the table with the article element's tags taken out: the
    distribution alone finds nearly the same text."""
    rows = [r["html"] for r in table(spark, "/root/testdata/sf0.01", "pages").collect() if r["html"]]
    same = 0
    for html in rows:
        bare = html.replace("<article>", "<div>").replace("</article>", "</div>")
        a, b = main_text(html), main_text(bare)
        same += a == b
        assert set(b.split("\n")) <= set(a.split("\n"))
    assert same >= 0.9 * len(rows)


def test_long_page():
    body = "".join(f"<p>{P} {k}</p>" for k in range(20_000))
    assert main_text(f"<article>{body}</article>").count("\n") == 19_999


def test_table(spark):
    rows = [(1, "u", None), (2, None, "<article><p>x</p></article>"), (2, None, "<article><p>x</p></article>"), (None, "u", "")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as text")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, "", 0), (2, "x", 1), (2, "x", 1)]
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
