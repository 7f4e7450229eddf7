import pytest

from episodica.llm.html_text import to_text

CASES = [
    ("<table><tr>Total<td>5</td></tr></table>", "Total\n5"),
    ("<table><tbody><p>note</p><tr><td>1</td></tr></tbody></table>", "note\n1"),
    ("<table><thead>head<tbody>body<tfoot>foot<tr><td>1</table>", "head body foot\n1"),
    ("<table><form>Name: <tr><td>a</td><td>b</td></tr></form></table>", "Name:\na  b"),
    ("<table><form><td>a<td>b</form></table>", "a  b"),
    ("<table><tr><form><td>a</td><td>b</td></form></tr></table>", "a  b"),
    ("<table><tr><b>x</b><td>y</td></tr><caption>c</caption></table>", "x\nc\ny"),
    ("<table><colgroup>g<col></colgroup><tr><td>1</table>", "g\n1"),
    ("<table><tr hidden>seen<td>not</td></tr><tr><td>1</table>", "seen\n1"),
    ("<table><tr><script>no()</script><p hidden>no</p><td>1</td></tr></table>", "1"),
    ("<table> <tbody> <tr> <td>a</td> <td>b</td> </tr> </tbody> </table>", "a  b"),
    ("a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b", "a x=2 b"),
    ("<math><semantics><mi>x</mi><annotation encoding='t'>\\x</annotation><annotation-xml>no</annotation-xml></semantics></math>", "x"),
    ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><path d='m'/><g><text>one</text><text>two</text></g></svg>after", "one two after"),
    ("<svg><desc/><title/><text>seen</text></svg><p>p", "seen\n\np"),
    ("<svg><style>no{}</style><script>no</script><foreignObject><p>in</p></foreignObject></svg>", "in"),
    ("<details>loose<summary>More</summary><p>folded</p></details>after", "More\nafter"),
    ("<details open><summary>More</summary><p>seen</p></details>", "More\n\nseen"),
    ("<details><p>folded</p></details>a", "a"),
    ("a<input type=submit value='Send it'>b <input type=BUTTON value=Go><input type=reset value=Back hidden><input value=typed><input type=checkbox value=on>", "a Send it b Go"),
    ("<desc>shown</desc> <annotation>too</annotation>", "shown too"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_visible(html, text):
    assert to_text(html) == text
