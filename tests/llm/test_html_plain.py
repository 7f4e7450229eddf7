"""Generated pages against a plain renderer that paints from the tree the page was written from."""

import random

import pytest

from episodica.llm.html_text import to_text

WORDS = "ab cde fgh ijkl mn opq rs tuvw xyz".split()


def text(rng, n=3):
    return " ".join(rng.choices(WORDS, k=rng.randint(1, n)))


def table(rng):
    """Rows of (text lines, columns spanned, rows spanned)."""
    return [[([text(rng) for _ in range(rng.choice([1, 1, 1, 2]))], rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3])) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 5))]


def tree(rng, depth=0):
    kinds = ["p", "lines", "breaks", "pre", "table", "unseen", "list"] + ["div"] * (depth < 3)
    kind = rng.choice(kinds)
    if kind == "div":
        return kind, [tree(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    if kind == "list":
        return kind, (rng.choice(["ul", "ol"]), [(text(rng), [text(rng) for _ in range(rng.randint(1, 3))] if rng.random() < 0.3 else None) for _ in range(rng.randint(1, 4))])
    if kind == "table":
        return kind, table(rng)
    if kind == "pre":
        return kind, [text(rng)] + [" " * rng.randint(0, 3) + text(rng) if rng.random() < 0.7 else "" for _ in range(rng.randint(0, 3))] + [text(rng)]
    if kind == "breaks":
        return kind, (text(rng), rng.randint(1, 3), text(rng))
    return kind, text(rng)


def cell(lines, columns, rows):
    spans = (f" colspan={columns}" if columns > 1 else "") + (f" rowspan={rows}" if rows > 1 else "")
    return f"<td{spans}>" + "<br>".join(lines)


def html(node):
    kind, held = node
    if kind == "div":
        return "<div>" + "".join(map(html, held)) + "</div>"
    if kind == "list":
        return f"<{held[0]}>" + "".join(f"<li>{t}" + ("" if own is None else "<ul>" + "".join(f"<li>{x}" for x in own) + "</ul>") for t, own in held[1]) + f"</{held[0]}>"
    if kind == "table":
        return "<table>" + "".join("<tr>" + "".join(cell(*c) for c in row) for row in held) + "</table>"
    if kind == "pre":
        return "<pre>" + "\n".join(held) + "</pre>"
    if kind == "breaks":
        return f"<div>{held[0]}" + "<br>" * held[1] + f"{held[2]}</div>"
    return {"p": f"<p>{held}</p>", "lines": f"<div>{held}</div>", "unseen": f"<div style='visibility:hidden'>{held} <script>x</script><b hidden>y</b></div>"}[kind]


def painted(rows):
    """A table on a canvas of single cells."""
    grid, cells = {}, []
    for r, row in enumerate(rows):
        c = 0
        for lines, columns, high in row:
            while (r, c) in grid:
                c += 1
            for i in range(min(high, len(rows) - r)):
                for j in range(columns):
                    grid.setdefault((r + i, c + j), True)
            cells.append((r, c, c + columns, lines))
            c += columns
    edges = sorted({0} | {x for _, a, b, _ in cells for x in (a, b)})
    width = {a: 0 for a in edges[:-1]}
    for _, a, b, lines in sorted(cells, key=lambda x: (edges.index(x[2]) - edges.index(x[1]), x[1], x[2], max(map(len, x[3])))):
        own = [x for x in edges[:-1] if a <= x < b]
        width[own[-1]] += max(0, max(map(len, lines)) - sum(width[x] for x in own) - 2 * (len(own) - 1))
    left, at = {}, 0
    for a in edges[:-1]:
        left[a], at = at, at + width[a] + 2
    out = []
    for r in range(len(rows)):
        mine = [x for x in cells if x[0] == r]
        canvas = [[" "] * 2000 for _ in range(max(len(x[3]) for x in mine))]
        for _, a, _, lines in mine:
            for k, line in enumerate(lines):
                canvas[k][left[a] : left[a] + len(line)] = line
        out += ["".join(x).rstrip() for x in canvas]
    return out


def blocks(node):
    """(lines, whether a margin surrounds them)."""
    kind, held = node
    if kind == "div":
        return [x for child in held for x in blocks(child)]
    if kind == "list":
        out = []
        for k, (t, own) in enumerate(held[1]):
            mark = f"{k + 1}. " if held[0] == "ol" else "- "
            out += [mark + t] + [" " * len(mark) + "- " + x for x in own or ()]
        return [(out, True)]
    if kind == "table":
        return [(painted(held), True)]
    if kind == "pre":
        return [(held, True)]
    if kind == "breaks":
        return [([held[0]] + [""] * (held[1] - 1) + [held[2]], False)]
    return [([], False)] if kind == "unseen" else [([held], kind == "p")]


def plain(nodes):
    out, gap = [], False
    for lines, margin in (x for node in nodes for x in blocks(node)):
        gap |= margin
        if lines:
            out += ([""] if gap and out else []) + lines
            gap = margin
    return "\n".join(out)


@pytest.mark.parametrize("seed", range(400))
def test_generated_pages(seed):
    rng = random.Random(seed)
    page = [tree(rng) for _ in range(rng.randint(1, 5))]
    assert to_text("".join(map(html, page))) == plain(page), "".join(map(html, page))


CASES = [
    ("a<!-->shown<!--->too", "ashowntoo"),
    ("a<!-- > -->b", "ab"),
    ("<div style='visibility:hidden'>no <b style='visibility:visible'>yes</b> no</div>", "yes"),
    ("<p style='display:none; display:block'>yes</p>", "yes"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("a<br><br>b<br>", "a\n\nb"),
    ("<table><tr><td><p>a<p>b<td>c</table>", "a  c\n\nb"),
    ("<table><tr><td><pre>a\n\nb</pre><td>c</table>", "a  c\n\nb"),
    ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a  b  c\nd     e\nf     g"),
    ("<table><tfoot><tr><td>foot</tfoot><tr><td>body<thead><tr><td>head</table>", "head\nbody\nfoot"),
    ("<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>yes</table>", "  yes"),
]


@pytest.mark.parametrize("page,expected", CASES)
def test_cases(page, expected):
    assert to_text(page) == expected


def test_wide_and_many_columns_keep_all_text_apart():
    cells = [f"c{k:03d}" for k in range(70)]
    page = "<table><tr>" + "".join(f"<td>{c}" for c in cells) + "</table>"
    assert to_text(page).split("  ") == cells
    long = " ".join(f"word{k}" for k in range(200))
    lines = to_text(f"<table><tr><td>{long}<td>x<td>y<tr><td>a<td>b<td>c</table>").split("\n")
    assert " ".join(line[:60].strip() for line in lines[:-1]).split() == long.split() and lines[0].endswith("  x  y") and lines[-1].split() == ["a", "b", "c"]
    assert lines[-1].index("b") == lines[0].rindex("x")
    word = "w" * 500
    assert to_text(f"<table><tr><td>{word}<td>x<tr><td>a<td>b</table>") == word + "  x\n" + "a".ljust(62) + "b"


def test_deep_nesting_of_tables():
    assert to_text("<table><tr><td>" * 3000 + "deep") == "deep"
