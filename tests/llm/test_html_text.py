import pytest

from episodica.llm.html_text import extract, to_text

CASES = [
    (None, ""),
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<title>no</title><body><p>One<p>Two <b>bold</b>", "One\n\nTwo bold"),
    ("<div>a</div><div>b</div>c<br>d", "a\nb\nc\nd"),
    ("<script>var t='</p>';x(0)</script><style>p{}</style>seen<!-- not --><template>t</template>", "seen"),
    ('<p hidden>x</p><p style="color:red; display : none">y</p><p style="visibility:hidden">z</p><p>w</p>', "w"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>after", "- a\n- b\n  3. c\n  4. d\n\nafter"),
    ("<ol><li value=7>x</li><li>y</li></ol>", "7. x\n8. y"),
    ("<table><caption>T</caption><tr><th>name<th>n<tr><td>long one<td>1</table>", "T\nname      n\nlong one  1"),
    ("<table><tr><td colspan=2>wide cell over both</td></tr><tr><td>a</td><td>b</td></tr></table>", "wide cell over both\na  b"),
    ("<pre>  a\n    b\n</pre>c", "  a\n    b\n\nc"),
    ("<p>a <i>b <b>c</i> d</b></p>e", "a b c d\n\ne"),
    ("a < b and <3", "a < b and <3"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
    ("<nav><ul><li><a href='/x'>x</a></li></ul></nav><article><h1>T</h1>text</article>", "- x\n\nT\n\ntext"),
    ("<p>unclosed <a href='", "unclosed"),
    ("<select><option>a<option>b</select>", "a\nb"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_text(html, text):
    assert to_text(html) == text


def test_depth_and_width_are_bounded():
    assert to_text("<div>" * 50_000 + "deep" + "</div>" * 50_000) == "deep"
    big = "<table>" + "<tr><td>x<td>y" * 2000 + f"<tr><td>{'w' * 9000}<td>z</table>"
    assert len(to_text(big)) < 400_000


def test_table_of_pages(spark):
    rows = [(1, "u", "<p>a", "t"), (1, "u", "<p>a", "t"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract(pages, ["page_id"]).collect()), key=str)
    assert got == [(1, "a"), (1, "a"), (None, "")]
    assert extract(pages.limit(0), ["page_id"]).isEmpty()
