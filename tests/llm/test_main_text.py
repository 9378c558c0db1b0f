"""Main text of pages: given tables read plainly, pages of other makes, path scores by loops."""

import os
import re
from html import unescape

import numpy as np
import pytest

from doclake.llm import main_text as mt
from doclake.llm.common import table
from doclake.llm.queries import QUERIES
from tests import oracle

SF = f"{oracle.DATA}/sf0.001"
P1 = "The first paragraph has a number of words, and some marks; it goes on for a while."
P2 = "A second one follows. It is about as long as the first, and it ends here, at last."
MENU = "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "Sport", "About")) + "</ul>"


def text(html):
    return "\n\n".join(mt.main_blocks(html))


PAGES = {
    "article": (f"<body><nav>{MENU}</nav><article><h1>Title</h1><p>{P1}</p><p>{P2}</p></article><footer>x. y.</footer>", ["Title", P1, P2]),
    "plain boxes": (f"<body><div class=top>{MENU}</div><div class=text><h2>Title</h2><p>{P1}</p><p>Short.</p><p>{P2}</p></div><div class=legal>All rights</div>", ["Title", P1, "Short.", P2]),
    "list and table": (f"<main><p>{P1}</p><ul><li>one<li>two, with <a href=x>a link</a></ul><table><tr><td>a<td>b</table><p>{P2}</main>", [P1, "one", "two, with a link", "a", "b", P2]),
    "left open": (f"<html><head><title>t</title><script>if (a</p>b) '<p>no'</script><body><article><p><b>{P1}<br><p>{P2}", [P1, P2]),
    "head left open": (f"<html><head><title>t</title><style>p{{}}</style><p>{P1}<p>{P2}", [P1, P2]),
    "references": ("<article><p>a &amp; b &lt;c&gt; &#233;&#x41; &nbsp; &quot;d&quot; &amp;amp; e &copy 5&euro;, x &unknown; y.</p></article>", ['a & b <c> éA "d" &amp; e © 5€, x &unknown; y.']),
    "white space": ("<article><p>\n a\t b<br>c<br/>\r\n d <i>e</i><b>f</b> </p><p> \n </p></article>", ["a b c d ef"]),
    "beside it": (
        f"<body><header><h1>Site</h1><p>{P1}</p></header><div class='cookie-notice'><p>{P2} Accept, please, all of it.</p></div>"
        f"<article><h1>Title</h1><p>{P1}</p><aside><p>{P2}</p></aside><form><label>Mail, please.</label><button>Go</button></form>"
        f"<div class='AdBox'>{P2}</div><p>{P2}<span class=ad> Buy this!</span></p><!-- {P1} --></article>"
        f"<section id='comments'><article class='comment'><p>{P1} {P1} {P1}</p></article></section><div id=sidebar-left>{P2}</div>",
        ["Title", P1, P2],
    ),
    "replies longer than the article": (f"<div class=post><p>{P1}</div><div class=comment-list>" + f"<p>{P2} {P2}</p>" * 9 + "</div>", [P1]),
    "boxed article": (f"<body class='has-sidebar'><div class='page widget-area'><article><h1>T</h1><p>{P1}</article></div><div class=widget>{P2}", ["T", P1]),
    "named box, no heading": (f"<div class=overlay><article><p>{P1}</article></div>", [P1]),
    "related": (f"<main><article><h1>T</h1><p>{P1}</p></article></main><div class=related><article><p>{P2}</p></article></div>", ["T", P1]),
    "heading of the article": (f"<article><header class=entry-header><h1>T</h1></header><p>{P1}</p><footer>tags, more tags.</footer></article>", ["T", P1]),
    "menu inside": (f"<div><div>{MENU}</div><p>{P1}</p><p>{P2}</p></div>", [P1, P2]),
    "one word": ("<nav><a href=x>Home</a></nav><article><h1>No</h1><p>The.</p></article><div class=ad>Much longer, this one, by far, than all.</div>", ["No", "The."]),
    "hidden": (f"<article><p>{P1}</p><p hidden>{P2}</p><p style='display: none'>{P2}</p><div role=alert>{P2}</div></article>", [P1]),
    "links in text": (f"<article><p>{P1} <a href=x>{P2}</a></p></article>", [f"{P1} {P2}"]),
    "block in link": (f"<article><a href=x><p>{P1}</p></a><p>{P2}</p></article>", [P1, P2]),
    "no markup": (P1, [P1]),
    "nothing": ("<nav>a</nav><div class=cookie>b, c.</div>", []),
    "broken": ("<article><p>a < b <3 & c > d </i></div></p>e</article", ["a < b <3 & c > d", "e"]),
    "empty": ("", []),
    "null": (None, []),
    "links only": (MENU, []),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    html, want = PAGES[name]
    assert mt.main_blocks(html) == want


def test_deep_and_long():
    assert text("<div>" * 30_000 + P1) == P1
    assert text("<article>" + f"<p>{P1}" * 20_000) == "\n\n".join([P1] * 20_000)
    assert text("<article><p>" + "<b>" * 20_000 + P1) == P1
    assert text("</div></p></b>" * 20_000 + P1) == P1
    assert text("<article><p>" + "word, " * 300_000) == " ".join(["word,"] * 300_000)


def test_path_scores_by_loops():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 40):
        lengths, paths = rng.integers(1, 300, n).astype(float), rng.integers(0, 5, n)
        linked, marks = np.floor(lengths * rng.random(n)), rng.integers(0, 9, n).astype(float)
        mean = lambda x, p: sum(x[i] for i in range(n) if paths[i] == p) / sum(paths == p)
        text_, dots = ([mean(x, p) for p in paths] for x in (lengths - linked, marks))

        def smooth(x, i):
            return 0.25 * x[max(0, i - 1)] + 0.5 * x[i] + 0.25 * x[min(n - 1, i + 1)]

        own = [t * (1 + d) for t, d in zip(text_, dots)]
        fused = [(own[i] * smooth(text_, i) * (1 + smooth(dots, i))) ** 0.5 for i in range(n)]
        assert np.allclose(mt.path_scores(lengths, linked, marks, paths), [mean(fused, p) for p in paths])


def test_extract(spark):
    rows = [(i, name, html, "x") for i, (name, (html, _)) in enumerate(PAGES.items())]
    rows += [rows[0], (None, None, PAGES["article"][0], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = mt.extract(pages.selectExpr("*", "1 AS n_chars"))
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    want = [(i, name, "\n\n".join(PAGES[name][1])) for i, name, _, _ in rows[:-1]]
    want.append((None, None, "\n\n".join(PAGES["article"][1])))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str((*w, len(w[2]))) for w in want)
    assert mt.extract(pages.where("false")).count() == 0


def test_query_against_plain_reading(spark):
    """All pages of the test tables have one make: what stands in their article is the text."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    got = {r.page_id: r.text for r in QUERIES["op11_main_text"](spark, SF).collect()}
    pages = table(spark, SF, "pages").collect()
    for page in pages:
        body = re.split("</article>|<footer>", page.html.split("<article>")[1])[0].replace("<b>", "")
        blocks = [" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert got.pop(page.page_id) == "\n\n".join(b for b in blocks if b)
    assert not got
