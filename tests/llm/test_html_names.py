"""Names of wrappers speak against content, but don't veto it; optional end tags don't end the page."""

import pytest

from tapestride.llm import html_main

P = [f"Sentence number {k} of the article tells the reader something about its subject, at some length." for k in range(4)]
BODY = "".join(f"<p>{p}</p>" for p in P)
REST = '<nav><a href=x>Home</a></nav>{}<div class="ad"><p>Buy this now, please, it is good.</p></div><footer>us</footer>'


@pytest.mark.parametrize(
    "page",
    [
        f'<article class="post has-sidebar">{BODY}</article>',
        f'<article class="post sidebar">{BODY}</article>',
        f'<div id="content" class="share-enabled">{BODY}</div>',
        f'<div class="widget">{BODY}</div>',
        f"<form action=x>{BODY}</form>",
    ],
)
def test_wrappers_are_no_veto(page):
    assert html_main.main_blocks(f"<body>{REST.format(page)}</body>") == P


def test_form_around_the_whole_body():
    assert html_main.main_blocks(f"<body><form>{REST.format(BODY)}</form></body>") == P


def test_chrome_beside_content_stays_out():
    page = f'<article>{BODY}<form><p>Your name, please, and your address.</p></form><div class="comments"><p>I, a reader, think that this is a comment.</p></div></article>'
    assert html_main.main_blocks(page) == P


@pytest.mark.parametrize("odd", ["<datalist id=d><option value=x></datalist>", "<datalist><option>one<option>two</datalist>", "<select><option>one", "<svg><path d=x>"])
def test_open_elements_dont_end_the_page(odd):
    assert html_main.main_blocks(f"<article>{P[0]}{odd}{BODY}</article>")[-4:] == P


def test_mathematics_is_text():
    assert html_main.main_blocks(f"<article><p>{P[0]} <math><mi>a</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> holds.</article>") == [f"{P[0]} a=2 holds."]


def test_last_option_of_a_page():
    assert html_main.main_blocks(f"<article>{BODY}</article><datalist><option>one") == P


def own_signs(page):
    return [b.text for b in html_main.blocks_of(page) if html_main.log_odds(b) > 0]


LONG = "A long paragraph of the story that says one thing after another, and then ends as it should."


def test_neighbours_overrule_a_blocks_own_sign():
    """No element marks the article: its list and short lines are content against their own sign, a sentence among links isn't."""
    page = f"<body><div class=story><p>{LONG}</p><ul><li>first point</li><li>second point</li></ul><p>{LONG}</p><div>and so on</div><p>{LONG}</p></div></body>"
    blocks = [LONG, "first point", "second point", LONG, "and so on", LONG]
    assert html_main.main_blocks(page) == blocks
    assert own_signs(page) == [LONG, LONG, LONG]
    links = "".join(f"<li><a href=/{k}>Another page of this site, number {k}</a></li>" for k in range(4))
    page = f"<body><div><p>{LONG}</p><p>{LONG}</p></div><div><ul>{links}<li>More of these pages are to come soon.</li>{links}</ul></div></body>"
    assert html_main.main_blocks(page) == [LONG, LONG]
    assert own_signs(page) == [LONG, LONG, "More of these pages are to come soon."]


def test_all_costs_are_finite_and_all_neighbours_joined(monkeypatch):
    seen = {}
    real = html_main.min_cut
    monkeypatch.setattr(html_main, "min_cut", lambda source, sink, edges: seen.update(s=source, t=sink, e=edges) or real(source, sink, edges))
    html_main.main_blocks(f"<body><nav><ul><li><a href=x>Home</a></li></ul></nav><header><p>Site</p></header><article><header><h1>Title</h1><p>What it is about.</p></header><p>{LONG}</p></article><footer>end</footer></body>")
    assert len(seen["e"]) == len(seen["s"]) - 1 and all(0 < x < 100 for _, _, x in seen["e"])
    assert max(seen["s"] + seen["t"]) < 100


def test_headers_and_rows(spark):
    rows = [(1, "u", f"<header><p>Site of ours.</p></header><article><header><h1>Title</h1><p>What it is about.</p></header><p>{LONG}</p></article>")] * 2 + [(None, None, f"<article><p>{LONG}</p></article>"), (2, "u", "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>")]
    got = html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = sorted(((x.page_id, x.n_chars) for x in got), key=repr)
    head = len(f"Title\n\nWhat it is about.\n\n{LONG}")
    assert texts == sorted([(1, head), (1, head), (None, len(LONG)), (2, 20_000 * (len(LONG) + 2) - 2)], key=repr)
