"""Main text of pages: hand-made pages, a plain second version of the scoring, and what is lost without the ratios."""

import math

import numpy as np
import pytest

from tessera.llm import html

LONG = [f"Paragraph number {k} tells at some length, with commas and a point, what happened on day {k} of the long journey." for k in range(8)]
P = "".join(f"<p>{x}</p>" for x in LONG[:3])
T = "\n".join(LONG[:3])
NAV = "<div><ul>" + "".join(f"<li><a href='/{k}'>Topic {k}</a></li>" for k in range(9)) + "</ul></div>"
CASES = {
    "article": (f"<article><h1>Head</h1>{P}</article>", f"Head\n{T}"),
    "main": (f"<div>x</div><main>{P}</main>", T),
    "role": (f"<div role='main'><p>Short.</p>{P}</div><p>other</p>", f"Short.\n{T}"),
    "links_outside": (f"{NAV}<div>{P}</div>{NAV}", T),
    "links_in_article": (f"<article>{P}{NAV}</article>", T),
    "one_link_paragraph": (f"<article>{P}<p><a href='x'>See the source</a></p>{P}</article>", f"{T}\nSee the source\n{T}"),
    "nav": (f"<nav><p>{LONG[4]}</p></nav>{P}", T),
    "footer": (f"{P}<footer><p>{LONG[4]}</p></footer>", T),
    "aside": (f"<article>{P}<aside><p>Side remark of some length.</p></aside>{P}</article>", f"{T}\n{T}"),
    "ad_in_article": (f"<article>{P}<div class='ad'>Buy this wonderful thing now.</div>{P}</article>", f"{T}\n{T}"),
    "ad_words": (f"<article>{P}<div class='top adSlot-3'>Buy this wonderful thing now.</div>{P}</article>", f"{T}\n{T}"),
    "comments": (f"<article>{P}<div class='comments'><p>I do not agree with this.</p><p>Me neither.</p></div></article>", T),
    "comments_outside": (f"<article>{P}</article><section id='comments'><p>{LONG[5]}</p></section>", T),
    "discussion_section": (f"<article>{P}<section id='discussion'><h2 id='social-structure'>Discussion</h2>{P}</section></article>", f"{T}\nDiscussion\n{T}"),
    "related_heading": (f"<article><h2 id='related-work'>Related work</h2>{P}</article>", f"Related work\n{T}"),
    "cookie": (f"<div id='cookie-notice'><p>{LONG[6]}</p></div><div>{P}</div>", T),
    "form": (f"<article>{P}<form><p>Your mail</p><input value='a'><button>Send</button></form></article>", T),
    "script": (f"<article>{P}<script>var x = '<p>no</p>';</script><style>p {{ margin: 0 }}</style></article>", T),
    "hidden": (f"<article><p hidden>{LONG[5]}</p>{P}<p style='display: none'>{LONG[6]}</p></article>", T),
    "article_header": (f"<article><header><h1>Head</h1><p>by somebody</p></header>{P}</article>", f"Head\n{T}"),
    "page_header": (f"<header><h1>Site</h1><p>{LONG[5]}</p></header><div>{P}</div>", T),
    "unclosed": ("<article><p>" + "<p>".join(LONG[:3]), T),
    "unclosed_ad": (f"<div class='ad'>buy<article>{P}</article>", T),
    "stray_ends": (f"</div></p></article><article></b>{P}</i></article></div>", T),
    "nested_broken": (f"<article><div><b>{P}</div></b></article>", T),
    "deep": ("<article>" + "<div>" * 3000 + P + "</div>" * 3000 + "</article>", T),
    "references": ("<article><p>A &amp; B &lt;here&gt; &#8364;&nbsp;5 &copy; text</p></article>", "A & B <here> € 5 © text"),
    "white_space": ("<article><p>  one\n\ttwo&nbsp; three<br>four </p></article>", "one two three four"),
    "table": (f"<article>{P}<table><tr><td>one value</td><td>other value</td></tr></table>{P}</article>", f"{T}\none value\nother value\n{T}"),
    "list": ("<article><ul>" + "".join(f"<li>{x}</li>" for x in LONG) + "</ul></article>", "\n".join(LONG)),
    "comment": (f"<article><!-- <p>no</p> -->{P}<!-- unclosed <p>no</p></article>", T),
    "repeated": (f"<article>{P}{P}{P}</article>", f"{T}\n{T}\n{T}"),
    "short_end": (f"<div>{P}<p>The end.</p></div>{NAV}", f"{T}\nThe end."),
    "long": ("<article>" + "".join(f"<p>{LONG[k % 8]} {k}</p>" for k in range(3000)) + "</article>", "\n".join(f"{LONG[k % 8]} {k}" for k in range(3000))),
    "one_long_line": (f"<article><p>{'word ' * 60000}</p></article>", ("word " * 60000).strip()),
    "across_pieces": ("<article><p>" + "x" * 65500 + "&amp;&amp;&amp;&amp;&amp;&amp;&amp;&amp;&amp;&amp;</p></article>", "x" * 65500 + "&" * 10),
    "no_text": ("<html><head><title>t</title></head><body><nav>menu</nav></body></html>", ""),
    "plain": ("just text", "just text"),
}


@pytest.mark.parametrize("name", CASES)
def test_page(name):
    page, want = CASES[name]
    assert html.main_text(page) == want


def lines_of(page):
    parser = html.Lines()
    parser.feed(page)
    if not parser.rawdata.startswith("<"):
        parser.close()
    parser.flush()
    return parser.lines


def plain_scores(lines):
    out = []
    for i, x in enumerate(lines):
        mine = [y for y in lines if y.zone == x.zone]
        at = [k for k, y in enumerate(lines) if y.zone == x.zone].index(i)
        total = weight = 0.0
        for k, y in enumerate(mine):
            if abs(k - at) <= html.RADIUS:
                w = math.exp(-0.5 * ((k - at) / html.SIGMA) ** 2)
                total += w * (len(y.text) - y.linked) / max(1, y.tags)
                weight += w
        out.append(math.log(1 + total / weight * x.weight))
    return out


def plain_parted(x):
    """By trying all thresholds and adding up squares."""
    spread = lambda g: sum((v - sum(g) / len(g)) ** 2 for v in g)
    cuts = sorted(set(x))[1:]
    if not cuts:
        return [True] * len(x)
    best = min(cuts, key=lambda c: spread([v for v in x if v < c]) + spread([v for v in x if v >= c]))
    low, high = [v for v in x if v < best], [v for v in x if v >= best]
    return [v >= best for v in x] if sum(high) / len(high) - sum(low) / len(low) >= html.APART else [True] * len(x)


def plain_text(page):
    lines = lines_of(page)
    if not lines:
        return ""
    score = plain_scores(lines)
    held, middle = 0, None
    mass = [len(x.text) * min(1.0, x.weight) for x in lines]
    for k in sorted(range(len(lines)), key=lambda k: -score[k]):
        held += mass[k]
        if middle is None and 2 * held >= sum(mass):
            middle = score[k]
    high = [p or s >= middle - html.NEAR or (x.weight == html.RAISED and s >= math.log(1 + html.ENOUGH * html.RAISED)) for p, s, x in zip(plain_parted(score), score, lines)]
    high = [h and (x.content or x.weight > html.LOWERED or s >= math.log(1 + html.LEAST)) for h, x, s in zip(high, lines, score)]
    size = lambda inside: sum(m for x, h, m in zip(lines, high, mass) if h and x.content == inside)
    if size(True) >= size(False):
        high = [h and x.content for h, x in zip(high, lines)]
    links = [2 * x.linked > len(x.text) for x in lines]
    firm = [h and not k for h, k in zip(high, links)]
    firm = firm if any(firm) else high
    at = [k for k, f in enumerate(firm) if f]
    out = list(firm)
    for i, j in zip(at[:-1], at[1:]):
        for k in range(i + 1, j):
            if lines[i].content == lines[j].content and (high[k] or (not links[k] and lines[k].weight in (1.0, html.RAISED))):
                out[k] = lines[k].content or not all(lines[n].content for n in at)
    return "\n".join(x.text for x, k in zip(lines, out) if k)


def test_equals_a_plain_version():
    for name, (page, _) in CASES.items():
        if name not in ("long",):
            assert html.main_text(page) == plain_text(page), name


def test_ratios_decide_where_nothing_is_marked(monkeypatch):
    """With every ratio alike, the menus of pages without article elements come back, and link lists in articles as well."""
    soup = {n: CASES[n] for n in ("links_outside", "links_in_article", "short_end")}
    monkeypatch.setattr(html, "scores", lambda lines: np.full(len(lines), 5.0))
    monkeypatch.setattr(html, "selected", lambda lines, score: score > 0)
    for page, want in soup.values():
        got = html.main_text(page)
        assert got != want and "Topic 3" in got


def test_on_the_table_the_scores_decide(spark, monkeypatch):
    """Nothing but scripts and the like is left out beforehand: on every page lines are dropped by their scores, no text of an article is lost, and without the weights of article and main nearly all pages come out alike."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    dropped = alike = 0
    for page in pages:
        lines = lines_of(page)
        got = html.main_text(page)
        keep = html.selected(lines, html.scores(lines))
        dropped += not keep.all()
        assert got.split("\n") == [x.text for x in lines if x.content and x.weight == html.RAISED]
        bare = [x._replace(weight=x.weight / (html.RAISED if x.content else 1.0), content=False, zone=x.zone // 2) for x in lines]
        alike += (html.selected(bare, html.scores(bare)) == keep).all()
    assert dropped == len(pages) and alike >= 0.98 * len(pages)
    monkeypatch.setattr(html, "selected", lambda lines, score: score > -1)
    assert all(html.main_text(p) != "\n".join(x.text for x in lines_of(p) if x.content and x.weight == html.RAISED) for p in pages)


def test_rows(spark):
    schema = "page_id long, text string, n_chars string, html string"
    rows = [(1, "a", "b", CASES["article"][0]), (1, "a", "b", CASES["article"][0]), (2, None, None, None), (None, "x", "y", "")]
    out = html.extracted(spark.createDataFrame(rows, schema), keep=("page_id", "text", "n_chars"))
    assert out.columns == ["page_id", "text", "n_chars"]
    want = CASES["article"][1]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, want, len(want)), (1, want, len(want)), (2, "", 0), (None, "", 0)], key=repr)
    assert html.extracted(spark.createDataFrame([], schema), keep=("page_id",)).count() == 0
