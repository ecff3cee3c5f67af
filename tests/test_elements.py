"""Elements of HTML pages against pages whose elements are known."""

import html
import re

import duckdb
import pyarrow.parquet as pq

from lodestrata import catalogue
from lodestrata.operators import elements as E

H, I, P = E.HEADER, E.ITEM, E.TEXT


def test_whole_text():
    assert E.html_texts("<h2 class='a>b' id=x>One <i>two</i></h2><p><b>Bo</b>ld<br>line &amp; more<p title=\"x\">Next</p>out<h6>Six</h6>") == [(H, "One two"), (P, "Bold line & more"), (P, "Next"), (H, "Six")]
    assert E.html_texts("<ul><li><a href=/x>Link</a><li><div>In</div> a div<ul><li>Inner</ul>tail<li><p>Par</p>rest</ul>out") == [(I, "Link"), (I, "In a div tail"), (I, "Inner"), (I, "rest"), (P, "Par")]
    assert E.html_texts("<p>a<script>'</p><p>no'</script>b<!-- <p>no --></P ><style>p{}</style><pre>no</pre><link><picture>no") == [(P, "ab")]
    assert E.html_texts("<p>a < b</p><p a='1\"2'>c</p><p>") == [(P, "a < b"), (P, "c"), (P, "")]
    assert E.html_texts("<table><tr><td><p>a<td>no<tr><td><li>b<td>no</table><p>c") == [(P, "a"), (I, "b"), (P, "c")]
    assert E.html_texts("<h1>x<h2>y</h1>no") == [(H, "x"), (H, "y")]
    assert E.html_texts(None) == E.html_texts("") == E.html_texts("plain") == []
    assert E.html_texts("<p>" * 3000 + "deep")[-1] == (P, "deep")


def test_given_pages(spark):
    """On these pages no element is nested but in a list: each ends at its end tag or where the next element begins."""
    path, want = "/root/testdata/sf0.001/pages.parquet", set()
    for r in pq.read_table(path).to_pylist():
        page = re.sub(r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "", r["html"])
        for i, m in enumerate(re.finditer(r"(?is)<(h1|li|p)>(.*?)(?=</?(?:h1|li|p|ul|div|article|nav|footer|body)\b)", page)):
            text = " ".join(html.unescape(re.sub(r"<[^>]*>", lambda t: " " if t[0] == "<br>" else "", m[2])).split())
            if text:
                want.add((r["page_id"], i, {"h1": H, "li": I, "p": P}[m[1]], text))
    found = E.from_html(spark.read.parquet(path)).collect()
    assert len(found) == len(want) and {(r.doc_id, r.idx, r.type, r.text) for r in found} == want
    assert any(t == I for _, _, t, _ in want)
    nulls = spark.createDataFrame([(1, None), (2, ""), (3, "<li><b>x</b>")], "page_id long, html string")
    assert [tuple(r) for r in E.from_html(nulls).collect()] == [(3, 0, I, "x")]


def test_references_without_semicolon(spark, tmp_path):
    """The operator reads them as HTML does; the queries leave them, as their SQL does."""
    page = "<h1>A &amp;&amp;&amp</h1><p>&copy; 1 &copy 2 &quot;b&quot</p><li>&middot;&bogus; &#65;&#65"
    assert E.html_texts(page) == [(H, "A &&&"), (P, '© 1 © 2 "b"'), (I, "·&bogus; AA")]
    assert E.html_texts(page, False) == [(H, "A &&&amp"), (P, '© 1 &copy 2 "b&quot'), (I, "·&bogus; A&#65")]
    spark.createDataFrame([(1, page.split("<li>")[0]), (2, "<p>x &amp</p>"), (3, None)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("html_elements", "element_type_counts"):
        found = catalogue.queries()[name](spark, str(tmp_path))
        want = db.sql(catalogue.oracle_sql()[name])
        assert {tuple(r) for r in found.select(want.columns).collect()} == set(want.fetchall()) and found.count() > 0
