"""Main text of literal layouts, and of composed layouts whose names the labeller has never seen."""

import random

import numpy as np
import pytest

from quillspark.llm import html_blocks

P = ["The council met on Monday to talk about the new bridge over the river, and most of the members were in favour of it.","It will be built of stone, as the old one was, and it is to be ready in four years.","“We have waited long enough,” said the mayor.","Not everyone agrees. Those who live on the far bank fear the noise of the works, and some have asked for a tunnel in its place.","A second meeting is planned for June.","The costs are said to be about nine million, of which the county pays one half."]
ART = "".join(f"<p>{x}</p>" for x in P); H1 = "<h1>A new bridge for the town</h1>"
W = "A new bridge for the town\n"+"\n".join(P); B="\n".join(P)
NAV = "<nav><ul>"+"".join(f"<li><a href=/{x}>{x}</a></li>" for x in ("Home","News","Sport","Weather","Contact"))+"</ul></nav>"
FOOT = "<footer>© 2024 The Daily Post. All rights reserved.</footer>"
SIDE = "<div class=sidebar><h3>Most read</h3><ul><li><a href=1>Rain again today</a></li><li><a href=2>Team wins at last</a></li><li><a href=3>Bakery to close</a></li></ul></div>"
COM = "<section id=comments><h3>Comments</h3>"+"".join(f"<div class=comment><p>{n}</p><p>{t}</p></div>" for n,t in (("Ann","I think this is a very good idea and it should have been done years ago."),("Bob","Too much money for a bridge nobody needs, if you ask me.")))+"</section>"
COOK = "<div class='cookie-notice'>We use cookies to make this site better. <button>Accept</button></div>"
NEWS = "<form class=newsletter><label>Sign up for our letter</label><input name=m><button>Send</button></form>"
AD = "<div class=ad>Buy our new shoes today and save a lot of money.</div>"
LAYOUTS = [

("sidebar in body class",f"<body class='single has-sidebar'>{NAV}<div class='content'>{H1}{ART}</div>{SIDE}{FOOT}</body>",W),
("with-sidebar on main",f"<body>{NAV}<div class='main-content with-sidebar'>{H1}{ART}</div>{SIDE}{FOOT}</body>",W),
("form around page",f"<body><form id='aspnetForm'>{NAV}<div id=page>{H1}{ART}</div>{SIDE}{FOOT}</form></body>",W),
("only with-sidebar",f"<body><div class='main-content with-sidebar'>{H1}{ART}</div></body>",W),
("plain article",f"<html><body>{NAV}<article>{H1}{ART}</article>{FOOT}</body></html>",W),
("no container",f"<html><body>{H1}{ART}</body></html>",W),
("nav and body",f"<html><body>{NAV}{H1}{ART}{FOOT}</body></html>",W),
("comments",f"<body>{NAV}<article>{H1}{ART}</article>{COM}{FOOT}</body>",W),
("comments in article",f"<body>{NAV}<main><article>{H1}{ART}{COM}</article></main>{FOOT}</body>",W),
("cookie",f"<body>{COOK}{NAV}<main>{H1}{ART}</main>{FOOT}</body>",W),
("newsletter inside",f"<body>{NAV}<article>{H1}{''.join('<p>'+x+'</p>' for x in P[:3])}{NEWS}{''.join('<p>'+x+'</p>' for x in P[3:])}</article>{FOOT}</body>",W),
("ad inside",f"<body>{NAV}<article>{H1}{''.join('<p>'+x+'</p>' for x in P[:3])}{AD}{''.join('<p>'+x+'</p>' for x in P[3:])}</article>{FOOT}</body>",W),
("table layout",f"<body><table><tr><td class=menu><a href=1>Home</a><br><a href=2>News</a></td><td>{H1}{ART}</td></tr></table></body>",W),
("comments-open class",f"<body class='post-template comments-open no-nav'>{NAV}<div class=wrapper><div class=post>{H1}{ART}</div>{SIDE}</div>{FOOT}</body>",W),
("stray quote",f"<body>{NAV}<article>{H1}<p><a title=\"5\" screen\">{P[0]}</a></p>{''.join('<p>'+x+'</p>' for x in P[1:])}</article>{FOOT}</body>",W),
("odd names",f"<body>{NAV}<div class=zq1><div class=k9>{H1}{ART}</div><div class=k7>{SIDE}</div></div>{FOOT}</body>",W),
("aside first",f"<body><aside class=widget-area><h3>About</h3><p>We write about the town since 1920.</p></aside><div id=main>{H1}{ART}</div>{FOOT}</body>",W),
("wrapper header",f"<body><div class='page-header-fixed'><header><div class=logo>The Daily Post</div>{NAV}</header><main>{H1}{ART}</main></div>{FOOT}</body>",W),
("share and related",f"<body>{NAV}<article>{H1}{ART}<div class=share><a href=1>Tweet</a><br><a href=2>Mail</a></div><section class=related><h3>Related</h3><ul><li><a href=3>The old bridge</a></li><li><a href=4>Floods of 1990</a></li></ul></section></article>{FOOT}</body>",W),
("notice and modal",f"<body><div class=modal><p>Please log in to read on.</p><button>Log in</button></div>{NAV}<div role=main>{H1}{ART}</div>{FOOT}</body>",W),
("list in article",f"<body>{NAV}<article>{H1}{ART}<ul><li>One bridge of stone.</li><li>One tunnel under the river.</li></ul></article>{FOOT}</body>",W+"\nOne bridge of stone.\nOne tunnel under the river."),
("many comments",f"<body>{NAV}<article>{H1}{ART}</article><div id=comments>{COM*6}</div>{FOOT}</body>",W),
("nav only",f"<body>{NAV}</body>",""),
("two headings",f"<body>{NAV}<div class=entry>{H1}{ART}<h2>What comes next</h2><p>{P[0]}</p></div>{SIDE}{FOOT}</body>",W+"\nWhat comes next\n"+P[0]),
]

# articles set by line breaks, as bare divs, as lists, sections and tables
ITEMS = ["A warm coat", "Two pairs of strong shoes", "A knife", "Matches in a tin", "Rope of ten metres", "A map of the hills", "Dry socks", "Bread and cheese for a day", "A lamp", "A tent for two"]
T = "A new bridge for the town\n"
MENU, FOOTER = "<div class=menu><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a></div>", "<div class=footer>© 2024 The Daily Post. All rights reserved.</div>"
divs, items = "".join(f"<div>{x}</div>" for x in P), "".join(f"<li>{i}</li>" for i in ITEMS)
PLAIN = [
    ("line breaks", f"<html><body>{MENU}<div class=text>{P[0]}<br><br>{P[1]}<br><br>{P[3]}</div>{FOOTER}</body></html>", f"{P[0]} {P[1]} {P[3]}"),
    ("line breaks, odd name", f"<body>{NAV}<div id=x>{'<br>'.join(P)}</div>{FOOT}</body>", " ".join(P)),
    ("line breaks in a cell", f"<body><table><tr><td class=menu><a href=1>Home</a><br><a href=2>News</a></td><td>{'<br><br>'.join(P)}</td></tr></table></body>", " ".join(P)),
    ("line breaks alone", "<br>".join(P), " ".join(P)),
    ("line breaks and a heading", f"<body>{NAV}<div class=content>{H1}{'<br><br>'.join(P)}</div>{SIDE}{FOOT}</body>", T + " ".join(P)),
    ("bare divs", f"<div><div><div><div>{T.strip()}</div>{divs}</div></div></div>", W),
    ("bare divs after a menu", f"<body>{NAV}<div><div>{divs}</div></div>{FOOT}</body>", B),
    ("bare divs and a heading", f"<body>{NAV}<div>{H1}{divs}</div>{SIDE}{FOOTER}</body>", W),
    ("items", f"<body>{NAV}<article><h1>Twelve things to pack</h1><ul>{items}</ul></article>{FOOT}</body>", "\n".join(["Twelve things to pack", *ITEMS])),
    ("items after a paragraph", f"<body>{NAV}<main><h1>Twelve things to pack</h1><p>{P[0]}</p><ol>{items}</ol></main>{SIDE}{FOOT}</body>", "\n".join(["Twelve things to pack", P[0], *ITEMS])),
    ("sections", f"<body>{NAV}<main>{H1}{''.join(f'<section><p>{x}</p></section>' for x in P)}</main>{FOOT}</body>", W),
    ("sections alone", f"<main>{H1}{''.join(f'<section><p>{x}</p></section>' for x in P)}</main>", W),
    ("sections with headings", f"<body>{NAV}<article>{H1}{''.join(f'<section><h2>Part {i}</h2><p>{x}</p></section>' for i, x in enumerate(P))}</article>{FOOT}</body>", T + "\n".join(f"Part {i}\n{x}" for i, x in enumerate(P))),
    ("table", f"<body>{NAV}<article>{H1}<p>{P[0]}</p><table><tr><th>Year</th><th>Cost</th></tr><tr><td>2024</td><td>Two million</td></tr></table><p>{P[3]}</p></article>{FOOT}</body>", f"{T}{P[0]}\nYear\nCost\n2024\nTwo million\n{P[3]}"),
    ("one paragraph", f"<body>{NAV}<div class=content><p>{P[3]}</p></div>{FOOT}</body>", P[3]),
    ("terms", f"<body>{NAV}<article>{H1}<dl>{''.join(f'<dt>Word {i}</dt><dd>{x}</dd>' for i, x in enumerate(P))}</dl></article>{FOOT}</body>", T + "\n".join(f"Word {i}\n{x}" for i, x in enumerate(P))),
    ("no article", f"<body>{NAV}{FOOT}</body>", ""),
]

SF = "/root/testdata/sf0.001"
PAGE = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def model(spark):
    return html_blocks.fit(spark.read.parquet(f"{SF}/pages.parquet"))


@pytest.mark.parametrize("layouts", [LAYOUTS, PLAIN])
def test_ordinary_layouts(model, layouts):
    got = html_blocks.texts_of([page for _, page, _ in layouts], model)
    assert [(name, text) for (name, _, _), text in zip(layouts, got)] == [(name, want) for name, _, want in layouts]


def test_doubtful_pages_give_their_likeliest_run():
    blocks = [html_blocks.Block((), t, 0) for t in "abcde"]
    assert html_blocks._kept(blocks, np.array([0.05, 0.25, 0.4, 0.1, 0.3])) == "b\nc"
    assert html_blocks._kept(blocks, np.array([0.05, 0.09, 0.01, 0.1, 0.0])) == ""


def _plain(weights, x):
    """Probabilities by the formulas of an LSTM, block by block."""
    n, sigmoid = weights["u"].shape[1], lambda z: 1 / (1 + np.exp(-z))
    states = []
    for d, order in ((0, range(len(x))), (1, range(len(x) - 1, -1, -1))):
        h, c, found = np.zeros(n), np.zeros(n), {}
        for t in order:
            z = x[t] @ weights["w"][d] + h @ weights["u"][d] + weights["b"][d, 0]
            c = sigmoid(z[n : 2 * n]) * c + sigmoid(z[:n]) * np.tanh(z[3 * n :])
            h = found[t] = sigmoid(z[2 * n : 3 * n]) * np.tanh(c)
        states.append(found)
    return np.array([sigmoid(np.concatenate((states[0][t], states[1][t])) @ weights["out"] + weights["bias"][0]) for t in range(len(x))])


def test_labeller_equals_a_plain_loop():
    """Probabilities, and gradients by differences of the loss, of two pages of unlike length."""
    rng = np.random.default_rng(5)
    labeller = html_blocks.Labeller(3, hidden=4)
    pages = [rng.normal(0, 1, (n, html_blocks.INPUTS)).astype(np.float32) for n in (7, 4)]
    labels = [rng.integers(0, 2, len(x)).astype(np.float32) for x in pages]
    weights = {k: w.astype(np.float64) for k, w in labeller.weights.items()}
    for x, found in zip(pages, labeller.probabilities(pages)):
        assert np.allclose(found, _plain(weights, x), atol=1e-5)

    def loss():
        return -np.concatenate([np.log(np.where(y > 0, p, 1 - p)) for y, p in ((y, _plain(weights, x)) for x, y in zip(pages, labels))]).mean()

    adam: dict = {}
    labeller.step(pages, labels, adam, 0.01)
    for k, w in weights.items():
        for at in rng.choice(w.size, min(w.size, 12), replace=False):
            kept, differences = w.flat[at], []
            for change in (1e-5, -1e-5):
                w.flat[at] = kept + change
                differences.append(loss())
            w.flat[at] = kept
            assert np.isclose(np.asarray(adam[k][0]).flat[at] / 0.1, (differences[0] - differences[1]) / 2e-5, atol=2e-5, rtol=1e-3), k


def test_names_never_seen(model, monkeypatch):
    """Blocks of composed layouts with other names for everything: what is left are tags, texts, places and shares."""

    def unseen(kind):
        tag, rng = kind.split(".")[0].split("#")[0], random.Random(kind)
        return f"{tag if tag in ('div', 'section', 'p', 'ul', 'td') else 'div'}.{''.join(rng.choice('qwzxyjk') for _ in range(6))}"

    monkeypatch.setattr(html_blocks, "_AROUND", {k: [unseen(x) for x in v] for k, v in html_blocks._AROUND.items()})
    monkeypatch.setattr(html_blocks, "_MAIN", [unseen(x) for x in html_blocks._MAIN])
    rng, right, blocks = random.Random(9), 0, 0
    for _ in range(150):
        page = html_blocks.composed(P, rng)
        if page.blocks:
            kept = model.probabilities([html_blocks.vectors_of(page.blocks, page.elements)])[0] > 0.5
            right, blocks = right + int((kept == np.array(page.labels)).sum()), blocks + len(kept)
    assert right >= 0.9 * blocks


def test_given_pages_keep_their_articles(spark, model):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    for page, got in zip(pages, html_blocks.texts_of(pages, model)):
        blocks, elements = html_blocks.blocks_of(page)
        assert got == "\n".join(b.text for b in blocks if any(elements[e][0] == "article" for e in b.path))


def test_long_pages_in_pieces(model):
    rng = random.Random(3)
    page = html_blocks.composed(P * 4, rng)
    while len(page.blocks) < 40:
        page = html_blocks.composed(P * 4, rng)
    x = html_blocks.vectors_of(page.blocks, page.elements)
    assert np.allclose(model.probabilities([x])[0], model.probabilities_of_long(x, 7), atol=1e-4)


def test_rows_of_any_kind(spark, model):
    page = "<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>Head</h1><p>One &amp;\n two.<p>Three<script>x<y</script> four.</article><footer>c</footer></body></html>"
    rows = [(1, "u", page), (2, "u", None), (2, "u", None), (None, None, ""), (5, "u", "<p"), (6, "u", "<script>alone"), (7, "u", "<p>" + "word " * 60_000 + "</p>"), (8, "u", "".join(f"<p>Line {i} of the text.</p>" for i in range(6000)))]
    df = spark.createDataFrame(rows, PAGE)
    got = html_blocks.extract(df.selectExpr("*", "'clash' AS text", "'clash' AS n_chars", "'kept' AS path"), model)
    assert got.columns == ["page_id", "url", "path", "text", "n_chars"]
    found = {r.page_id: r for r in got.collect()}
    assert found[1].text == "Head\nOne & two.\nThree four." and (found[2].text, found[2].n_chars) == ("", 0) and found[5].text == found[6].text == found[None].text == ""
    assert found[7].n_chars == 299_999 and found[8].text.count("\n") == 5999
    empty = spark.createDataFrame([], PAGE)
    assert html_blocks.extract(empty, html_blocks.fit(empty)).count() == 0
