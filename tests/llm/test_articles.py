"""Articles inside or beside elements whose names or tags look like something else."""

import random
import time

import pytest

from tandem.llm import html_extract

LONG = "Some long paragraph, with commas, and more than a hundred characters so that it scores well here, does it not, number {}?"
PARAGRAPHS = [LONG.format(i) for i in range(4)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
WANT = "\n\n".join(PARAGRAPHS)
MENU = "<ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul>"


@pytest.mark.parametrize("name", ["content with-sidebar", "has-comments", "no-header", "post-legal", "notice", "widget"])
def test_names_do_not_take_the_article(name):
    assert html_extract.extract(f"<body>{MENU}<div class='{name}'>{BODY}</div><div class=sidebar><p>bad, bad</p></div></body>") == WANT


def test_headers_and_forms():
    for name in ("entry-header", "header"):
        assert html_extract.extract(f"<body><article><header class='{name}'><h1>Title</h1></header>{BODY}</article></body>") == f"Title\n\n{WANT}"
    assert html_extract.extract(f"<body><header><h1>Site</h1></header><div class=post><header><h1>Title</h1></header>{BODY}</div></body>") == f"Title\n\n{WANT}"
    form = f"<body><form action=x>{MENU}<div>{BODY}</div><input name=q><select><option>no</select><button>no</button></form></body>"
    assert html_extract.extract(form) == WANT
    assert html_extract.extract(f"<body><div>{BODY}</div><form><p>Your mail, please, and your name</p><input></form></body>") == WANT


def test_small_and_linked_parts_are_left_out():
    page = f"<body><div>{BODY}<p>so <span class=ad>buy</span> on</p><div class='related-posts'><p><a href=x>More, and more of the same</a></p></div></div><div id=comments><p>nice, post</p></div></body>"
    assert html_extract.extract(page) == f"{WANT}\n\nso on"
    assert html_extract.extract(f"<div class=comments><p>{PARAGRAPHS[0]}</p></div><p>Short</p>").startswith(PARAGRAPHS[0])
    for broken in ("<div class=ad>" * 5000, "<form>" * 5000 + "x", "<div class=no-header>" * 5000 + "<p>x"):
        html_extract.extract(broken)


def test_short_siblings_and_lists_of_references_stay():
    page = f"<body><div>{MENU}</div><div><section>{BODY}</section><section><p>Short text.</p></section></div></body>"
    assert html_extract.extract(page) == f"{WANT}\n\nShort text."
    parts = "<p>Short.</p><pre>code = 1</pre><blockquote>said so</blockquote><ul><li>first</li><li>second</li></ul><table><tr><td>cell</td></tr></table>"
    page = f"<body><div><div>{BODY}</div>{parts}<div>{BODY}</div></div></body>"
    assert html_extract.extract(page) == f"{WANT}\n\nShort.\n\ncode = 1\n\nsaid so\n\nfirst\n\nsecond\n\ncell\n\n{WANT}"
    references = "<h2>References</h2><ol><li><a href=a>First work</a></li><li><a href=b>Second work</a></li><li><a href=c>Third work</a></li></ol>"
    for tag in ("article", "div"):
        page = f"<body><div>{MENU}</div><{tag}>{BODY}{references}</{tag}></body>"
        assert html_extract.extract(page) == f"{WANT}\n\nReferences\n\nFirst work\n\nSecond work\n\nThird work"


def test_fieldsets_dialogs_labels_and_formulas():
    for tag in ("fieldset", "dialog"):
        assert html_extract.extract(f"<body>{MENU}<{tag}>{BODY}</{tag}></body>") == WANT
        assert html_extract.extract(f"<body><div>{BODY}</div><{tag}><p>Your mail, please</p></{tag}></body>") == WANT
    page = f"<article>{BODY}<p>Here <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and a <label>marked</label> word, where it holds.</p></article>"
    assert html_extract.extract(page) == f"{WANT}\n\nHere x=2 and a marked word, where it holds."
    assert html_extract.extract(f"<form><div>{BODY}<p>So <label>Name</label> it is.</p></div></form>") == f"{WANT}\n\nSo it is."


@pytest.mark.parametrize("inner", [f"<div>{MENU}</div><div><section>{BODY}</section><section><p>Short text.</p></section></div>", f"<div>{BODY}</div><p>Tail.</p>"])
def test_depth_changes_nothing(inner):
    """The same page under any number of wrappers, around all of it or between its parts."""
    plain = html_extract.extract(f"<body>{inner}</body>")
    assert WANT in plain
    for depth in (5, 90, 110, 400):
        assert html_extract.extract(f"<body>{'<div>' * depth}{inner}{'</div>' * depth}</body>") == plain
    deep = f"<body><div>{'<div>' * 150}<section>{BODY}</section>{'</div>' * 150}<section><p>Short text.</p></section></div></body>"
    assert html_extract.extract(deep) == f"{WANT}\n\nShort text."


def test_very_deep_pages_take_no_square_time():
    begin = time.perf_counter()
    html_extract.extract("<div><p>Some text, here.</p>" * 20_000)
    assert time.perf_counter() - begin < 60


def plain_points(page):
    """Points of every element by walking up from each block, without limits or sums."""
    blocks, _ = html_extract._parse(page)
    points, text = {}, {}
    for node, words, linked in blocks:
        own = (1 + words.count(",") + min(len(words) // 100, 3)) * (1 - linked / len(words))
        own = 0.0 if node.tag in html_extract.HEADINGS else own * (html_extract.DOUBT_SHARE if node.weak else 1)
        up, level = (node.parent if node.tag in ("p", "li", "h1", "td") else node), 0
        while up is not None:
            if up.tag:
                points[up.number] = points.get(up.number, 0) + own / (1 if level == 0 else 2 * min(level, 100))
                text[up.number] = text.get(up.number, 0) + len(words)
            up, level = up.parent, level + 1
    return points, text


@pytest.mark.parametrize("seed", range(20))
def test_points_against_plain_walks(seed, monkeypatch):
    rng = random.Random(seed)
    page, open_tags = "<body>", []
    for _ in range(300):
        turn = rng.random()
        if turn < 0.5:
            page += f"<{(open_tags.append(rng.choice(['div', 'section'])) or open_tags[-1])}>"
        elif turn < 0.65 and open_tags:
            page += f"</{open_tags.pop()}>"
        else:
            page += rng.choice([f"<p>{LONG.format(seed)}</p>", "<p>short, one</p>", "bare text", "<h1>Head</h1>", "<p><a href=x>link</a> and more</p>"])
    seen, real = [], html_extract._scored
    monkeypatch.setattr(html_extract, "_scored", lambda given: seen.append(real(given)) or seen[-1])
    html_extract._best(html_extract._parse(page)[0])
    points, text = plain_points(page)
    got = {n.number: n for n in seen[0].values()}
    assert set(got) == set(points)
    assert all(got[k].points == pytest.approx(points[k]) and got[k].text == text[k] for k in points)
