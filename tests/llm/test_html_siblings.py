"""Siblings of an article or main element are kept by the rule of any other container."""

from lodestrata.llm import html_extract

LEAD = "A long lead that stands before the article, with commas, and which says what the article is about."
BODY = "The article itself, which goes on, and on, until it is long enough to be told from the rest of the page. " * 4


def test_title_and_lead():
    article = f"<article><p>{BODY}</p><p>{BODY}</p></article>"
    body = "\n\n".join([BODY.strip()] * 2)
    for tag in ("main", "div"):
        page = f"<body><{tag}><h1>Title</h1><p>{LEAD}</p><p><a href=x>Links, only links, and nothing else.</a></p><p>Short</p>{article}</{tag}></body>"
        assert html_extract.extract(page) == f"Title\n\n{LEAD}\n\n{body}"
    page = f"<body><h1>Title</h1><main><p>{BODY}</p><p>{BODY}</p></main><p>{LEAD}</p></body>"
    assert html_extract.extract(page) == f"Title\n\n{body}\n\n{LEAD}"


def test_peers():
    page = f"<body><article><p>{BODY}</p></article><article><p>{LEAD}</p></article><div>x</div></body>"
    assert html_extract.extract(page) == f"{BODY.strip()}\n\n{LEAD}"
