"""Pages of many shapes, made of parts whose place in the article is known: the text is the article's blocks, no more and no less."""

import itertools
import random

import pytest

from lodestrata.llm import html_extract

P = ["The first paragraph of the article goes on for a while, with commas, and says what it is about.", "A second one, with some more words in it, follows the first and is as long as that.", "The third paragraph ends the article; it has its own words, too, and a full stop at its end."]
NOISE = {
    "nav": "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News, sport, weather</a></li></ul></nav>",
    "menu": "<div class='main-menu'><a href=/a>One</a> <a href=/b>Two</a></div>",
    "aside": "<aside><p>Read this as well, it is long enough, really, to be a paragraph of its own kind.</p></aside>",
    "sidebar": "<div id=sidebar><p>The sidebar has a text, with commas, that is as long as a paragraph of it.</p></div>",
    "cookie": "<div class='cookie-notice'><p>We use cookies, and we tell you so here, at some length, as one must do.</p></div>",
    "advert": "<div class=ad>Buy this thing, today, for less than ever before, and get another thing.</div>",
    "form": "<form><p>Your name, your address and your message, please, in full, before you go on.</p><input></form>",
    "script": "<script>var p = '<p>not, a, text</p>'; if (a < b) { c(); }</script>",
    "style": "<style>p > a { color: red }</style>",
    "comments": "<section id=comments><article class=comment><p>Nice post, thanks, I have read all of it and liked it.</p></article></section>",
    "footer": "<footer><p>&copy; 2024 Somebody, all rights reserved, and so on, as in every footer of the kind.</p></footer>",
    "hidden": "<div style='display:none'><p>Hidden, but long enough to be taken for a paragraph by its words.</p></div>",
}
BEFORE, AFTER = ("nav", "menu", "cookie", "script", "style"), ("aside", "sidebar", "advert", "form", "comments", "footer", "hidden")
WRAPS = {
    "article": "<article>{}</article>", "main": "<main>{}</main>", "div": "<div class=post-content>{}</div>", "plain div": "<div><div>{}</div></div>", "nested": "<div id=page><div class=layout><article>{}</article></div></div>", "section": "<section class='story'>{}</section>",
}


def _body(inner):
    return [
        ("".join(f"<p>{p}</p>" for p in inner), inner),
        ("".join(f"<p>{p}" for p in inner), inner),
        (f"<h1>A title</h1><p>{inner[0]}</p><h2>Part</h2><p>{inner[1]}</p><ul><li>item one<li>item two</ul><p>{inner[2]}</p>", ["A title", inner[0], "Part", inner[1], "item one", "item two", inner[2]]),
        (f"<p>{inner[0]}<br>and <b>bold</b>   words &amp; signs</p><blockquote><p>{inner[1]}</p></blockquote><table><tr><td>cell a<td>cell b</table><p>{inner[2]}</p>", [inner[0] + " and bold words & signs", inner[1], "cell a", "cell b", inner[2]]),
    ]


@pytest.mark.parametrize("wrap", WRAPS)
def test_article_among_noise(wrap):
    rng = random.Random(wrap)
    for (body, want), n in itertools.product(_body(P), range(12)):
        before, after = rng.sample(BEFORE, n % 4), rng.sample(AFTER, n % 5)
        page = f"<!DOCTYPE html><html><head><title>x</title></head><body>{''.join(NOISE[k] for k in before)}{WRAPS[wrap].format(body)}{''.join(NOISE[k] for k in after)}</body></html>"
        assert html_extract.extract(page) == "\n\n".join(want), (before, after)


def test_unclosed():
    article = f"<article><p>{P[0]}</p><p>{P[1]}</p></article>"
    for tag in ("svg", "math", "object", "template", "noscript"):
        assert html_extract.extract(f"<body><{tag}>{article}</body>") == "\n\n".join(P[:2])
        assert html_extract.extract(f"<body><{tag}><p>gone, gone, gone and gone for good it is</p></{tag}>{article}</body>") == "\n\n".join(P[:2])
    assert html_extract.extract(f"<body>{article}<script>never closed <p>{P[2]}</p>") == "\n\n".join(P[:2])
    assert html_extract.extract("<svg>" * 3000 + article) == "\n\n".join(P[:2])


def test_ties_and_long_pages():
    same = f"<div><p>{P[0]}</p></div>"
    page = f"<body><section>{same}</section><section>{same}</section></body>"
    assert html_extract.extract(page) == html_extract.extract(page)
    long = "<body><article>" + "".join(f"<p>{P[i % 3]} {i}</p>" for i in range(5000)) + "</article></body>"
    assert html_extract.extract(long).count("\n\n") == 4999
    assert html_extract.extract("<div>" * 3000 + f"<p>{P[0]}</p>") == P[0]
