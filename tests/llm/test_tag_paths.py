"""Main texts of web pages against hand-made pages and the plan of the given ones."""

import re
from html import unescape

from dispatchlens.llm import tag_paths as H

from ..conftest import SF_SMALL

PROSE = "A long sentence, with a comma, that says something about the subject of the page. "


def test_boilerplate_goes_and_blocks_stay():
    page = f"""<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies. Really, we do.</div><main><article><header><h1>Head &amp; tail</h1></header>
    <p>{PROSE}<p>Short.<ul><li>one<li>two <b>bold</b></ul><div class="ad">Buy now!</div><aside>Other</aside><form><p>Name</p></form>
    <blockquote>a&nbsp;quote</blockquote><script>var x="<p>no</p>";</script><!-- <p>no</p> -->
    <table><tr><td>1<td>2</table></article><section id="comments"><p>{PROSE}</p></section></main>
    <footer>&copy; me</footer></body></html>"""
    assert H.main_text(page) == "\n\n".join(["Head & tail", PROSE.strip(), "Short.", "one", "two bold", "a quote", "1", "2"])


def test_ratios_choose_without_landmarks():
    links = "".join(f'<li><a href="/{k}">link {k}</a></li>' for k in range(20))
    page = f"<body><div><ul>{links}</ul></div><div id=x><h2>Title</h2>" + f"<p>{PROSE}</p>" * 5 + "<p>End</p></div><div><span>Log in</span></div>"
    assert H.main_text(page) == "\n\n".join(["Title", *[PROSE.strip()] * 5, "End"])


def test_a_hidden_block_hides_itself_only():
    hidden = ["<p style='display:none'>", "<p hidden>", "<p aria-hidden=true>", "<p class=x id=newsletter>"]
    for tag in hidden:
        plain = "<p class=x>" if "class" in tag else "<p>"
        body = f"{plain}{PROSE}</p>{tag}Not shown.</p>{plain}{PROSE}</p>{plain}{PROSE}</p>"
        aside = f"<div><p>{PROSE * 3}</p></div>"
        assert H.main_text(f"<body>{aside}<article><h1>Head</h1>{body}</article></body>") == "\n\n".join(["Head", *[PROSE.strip()] * 3])
        assert H.main_text(f"<body>{aside}<article>{body}</article></body>") == "\n\n".join([PROSE.strip()] * 3)


def test_names_do_not_drop_the_article():
    inner = f"<h1>Head</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p><div class=ad>Buy now!</div>"
    whole = "\n\n".join(["Head", PROSE.strip(), "Short.", PROSE.strip()])
    rest = f"<div class=sidebar><p>{PROSE * 4}</p></div><div id=comments><p>{PROSE * 5}</p></div><footer>me</footer>"
    article = f"<article>{inner}</article>"
    for main in (f"<div class='has-sidebar'>{article}</div>", f"<main class='content with-sidebar'>{inner}</main>",
                 f"<main class='content with-sidebar'>{article}</main>", f"<div class='no-sidebar'><div>{article}</div></div>",
                 f"<article class='post popular'>{inner}</article>", f"<div id='search-result'>{article}</div>",
                 f"<section class='legal-text'>{article}</section>", f"<main><section class='legal-text'>{inner}</section></main>",
                 f"<div class='has-sidebar'>{article}{rest}</div>"):
        assert H.main_text(f"<body><nav>Home</nav>{main}{rest}</body>") == whole, main
    assert H.main_text(f"<body><nav>Home</nav><div class='has-sidebar'>{inner}</div><footer>me</footer></body>") == whole
    three = "".join(f"<article class='post popular'><p>{PROSE}{k}</p></article>" for k in range(3))
    assert H.main_text(f"<body>{three}</body>") == "\n\n".join(f"{PROSE}{k}" for k in range(3))
    three = "".join(f"<div class='search-result'><article><p>{PROSE}{k}</p></article></div>" for k in range(3))
    assert H.main_text(f"<body>{three}</body>") == "\n\n".join(f"{PROSE}{k}" for k in range(3))


def test_odd_pages():
    assert [H.main_text(x) for x in (None, "", "<", "<p>", "a < b", "<b>x</b>")] == ["", "", "<", "", "a < b", "x"]
    assert H.main_text("<article><p>x<br>y</article><footer>z") == "x y"
    assert H.main_text("<article>" + "<div>" * 3000 + "deep") == "deep"
    assert len(H.main_text("<article><p>" + "word " * 200_000)) == 999_999


def article(html):
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    found = [" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in found if b)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = {r.page_id: r for r in H.extracted(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == article(r.html)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    odd = spark.createDataFrame([(1, None, None, "x"), (1, "u", "<p>t", "y")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, H.extracted(odd).collect()), key=str) == [(1, "u", "t", 1), (1, None, "", 0)]
    assert H.extracted(odd.limit(0)).collect() == []


def test_the_article_keeps_links_names_and_formulas():
    links = "".join(f'<li><a href="/{k}">Source {k}</a></li>' for k in range(12))
    inner = (f"<h1>Head</h1><p>{PROSE}</p><h2 class=legal>Legal matters</h2><p>{PROSE}</p><div class='search-theory'>Search.</div>"
             f"<p>If <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds, so it is.</p>"
             f"<div><a href=/a>whole block is a link</a></div><ul>{links}</ul><p class=legal>{PROSE * 2}</p><p class=ad>Buy.</p>")
    whole = ["Head", PROSE.strip(), "Legal matters", PROSE.strip(), "Search.", "If x=1 holds, so it is.", "whole block is a link",
             *[f"Source {k}" for k in range(12)], (PROSE * 2).strip()]
    for name in ("article", "main"):
        assert H.main_text(f"<body><nav>Home</nav><{name}>{inner}</{name}><footer>me</footer></body>") == "\n\n".join(whole)


def test_comments_go_however_long():
    for name in ("comments", "reader-comments", "comment-list"):
        comments = f"<section class={name}>" + f"<article><p>{PROSE * 9}</p></article><p>{PROSE * 9}</p>" * 3 + "</section>"
        for page in (f"<main><h1>Head</h1><p>{PROSE}</p>{comments}</main>", f"<main><article><h1>Head</h1><p>{PROSE}</p></article>{comments}</main>",
                     f"<article><h1>Head</h1><p>{PROSE}</p>{comments}</article>", f"<div><h1>Head</h1><p>{PROSE}</p>{comments}</div>"):
            assert H.main_text(f"<body>{page}</body>") == f"Head\n\n{PROSE.strip()}"
    assert H.main_text(f"<article class='post comments-open'><p>{PROSE}</p></article>") == PROSE.strip()


def test_the_threshold_decides(monkeypatch):
    plain = f"<body><div><h2>Head</h2><p>{PROSE * 3}</p></div><section><p>Some words.</p></section></body>"
    marked = f"<body><article><p>{PROSE * 3}</p></article><article class=teaser><p>Some words.</p></article></body>"
    for page, most in ((plain, f"Head\n\n{(PROSE * 3).strip()}"), (marked, (PROSE * 3).strip())):
        monkeypatch.setattr(H, "THRESHOLD", 1.0)
        assert H.main_text(page).endswith("page.") and "Some words." not in H.main_text(page)
        monkeypatch.setattr(H, "THRESHOLD", 0.0)
        assert H.main_text(page) == f"{most}\n\nSome words."
        monkeypatch.setattr(H, "THRESHOLD", 1e9)
        assert H.main_text(page) == ""


def test_ratios_match_brute_force():
    page = (f"<body><div><p>One, two.</p><p>Three <a href=/>four</a>!</p></div><ul><li><a href=/>x y</a></li></ul><p class=legal>{PROSE}</p>"
            f"<div><p>{PROSE}</p></div><nav>Home</nav></body>")
    blocks = H.blocks_of(page)
    never = H.has(blocks, H.BY_KIND)
    which, ratio, links = H.path_ratios(blocks, never)
    table: dict = {}
    for b, w, no in zip(blocks, which.tolist(), never.tolist(), strict=True):
        marks = sum(b.text.count(c) for c in ".,;:!?")
        table.setdefault(w, []).append((0 if no else len(b.text) - b.links, 0 if no else marks, b.links / len(b.text)))
    assert list(table) == list(range(len(ratio))) and len(ratio) == 4  # both div/p are one path
    mean = [[sum(r[c] for r in table[w]) / len(table[w]) for w in table] for c in (0, 1)]
    for w in table:
        near = [max(0, w - 1), w, min(len(table) - 1, w + 1)]
        length, points = (0.25 * m[near[0]] + 0.5 * m[near[1]] + 0.25 * m[near[2]] for m in mean)
        expected = (mean[0][w] * length * (1 + points)) ** 0.5 * (0.5 if PROSE.strip() == blocks[which.tolist().index(w)].text else 1)
        assert abs(ratio[w] - expected) < 1e-9
    assert links[1] == 1.0
