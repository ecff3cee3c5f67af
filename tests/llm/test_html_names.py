"""Names of elements that speak against their text, and pages where they are wrong."""

from lodestrata.llm import html_extract

A = "A first long paragraph of the article, which goes on, and on, until it is long enough. "
B = "Another long paragraph of the article, with commas, with words, and with an end. "
C = "Nice post, thanks a lot for it, really. "


def test_wrappers_of_articles():
    for names in ("layout has-sidebar", "page no-comments", "layout--has-sidebar", "sidebar", "widget", "elementor-widget elementor-widget-text-editor"):
        assert html_extract.extract(f"<body><div class='{names}'><article><p>{A}</p><p>{B}</p></article></div><div class=ad>{C}</div></body>") == f"{A.strip()}\n\n{B.strip()}"
        assert html_extract.extract(f"<body><div class='{names}'><p>{A}</p><p>{B}</p></div></body>") == f"{A.strip()}\n\n{B.strip()}"


def test_text_in_many_widgets():
    page = "<body><h1>Title</h1><div class=box>" + "".join(f"<div class='elementor-widget'><p>{t}</p></div>" for t in (A, B, A)) + "</div></body>"
    assert [t in html_extract.extract(page) for t in (A.strip(), B.strip())] == [True, True]
    assert html_extract.extract("<body><div class=menu>Only</div><div class=ads>a few</div><div class=share>words</div></body>") == "Only\n\na few\n\nwords"


def test_still_dropped():
    article, comments = f"<article><p>{A * 3}</p><p>{B * 2}</p></article>", f"<div id=comments>{''.join(f'<article class=comment-body><p>{C}</p></article>' for _ in range(25))}</div>"
    for page in (f"<body>{article}{comments}</body>", f"<body><main>{article}{comments}</main></body>", f"<body><div class=no-sidebar>{article}<div class='related has-image'><article><p>{C}</p></article></div></div>{comments}</body>"):
        text = html_extract.extract(page)
        assert A.strip() in text and B.strip() in text and C.strip() not in text
