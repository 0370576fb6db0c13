import math
import random
import re
import time

import pytest

from plumbline.llm import html
from plumbline.llm.html import extract, main_text

NOISE = [
    "<nav><a href=/a>Home</a> <a href=/b>News</a></nav>",
    "<header><h1>The Daily Site</h1></header>",
    '<div class="cookie-banner">We use cookies to make this site better for all of us.</div>',
    '<div id="sidebar"><p>Popular posts of the week, and more of them.</p></div>',
    "<form><label>Mail</label><input><button>Send</button></form>",
    '<script>var t = "</p><p>not text</p>";</script><style>p{color:red}</style>',
    '<section class="comments"><article class="comment"><p>First! What a fine long text this is, dear writer.</p></article></section>',
    '<div class="ad">Buy shoes now and never pay again for walking.</div>',
    "<footer>&copy; 2020 The Daily Site, all rights</footer>",
    "<!-- a <b>comment</b> -->",
    '<p hidden>never shown</p><div style="display: none">nor this</div>',
    '<div role="navigation">Up | Down</div>',
]
ARTICLE = "<h1>A   title</h1>\n<p>First &amp; <b>bold</b> wor<i>ds</i>&nbsp;here, with some length to it.</p><p>Second<br>line a &lt; b and more of it.</p>"
TEXT = "A title First & bold words here, with some length to it. Second line a < b and more of it."


@pytest.mark.parametrize("noise", NOISE)
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div class='post'>{}</div>", "<main><div>{}</div></main>"])
def test_noise_goes(noise, wrap):
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body>{noise}{wrap.format(ARTICLE)}{noise}</body></html>"
    assert main_text(page) == TEXT


def test_all_noise_at_once_and_inside():
    every = "".join(NOISE)
    assert main_text(f"<html><body>{every}<article>{ARTICLE}{NOISE[7]}</article>{every}</body></html>") == TEXT


def test_broken_pages():
    assert main_text(f"<html><head><title>x</title><body><article>{ARTICLE}<p>cut o") == TEXT + " cut o"
    assert main_text(f"<body><article>{ARTICLE}<p>cut <a hre") == TEXT + " cut"
    assert main_text("<p><b>One sentence.<br><p>Another one.</p>") == "One sentence. Another one."
    assert main_text("plain") == "plain" and main_text("") == "" and main_text(None) == "" and main_text("<nav>x</nav>") == ""


LONG = "<p>A paragraph of the article that goes on for a while, with commas and words.</p><p>Another one of the same kind, which is as long as the first.</p><p>And a third, so that there is some text to weigh up.</p>"
LONG_TEXT = "A paragraph of the article that goes on for a while, with commas and words. Another one of the same kind, which is as long as the first. And a third, so that there is some text to weigh up."


@pytest.mark.parametrize("name", ["class='with-sidebar'", "class='share-page'", "id='noticeBoardArticle'", "class='ad-free side-by-side'", "role='main' class='no-comments'"])
@pytest.mark.parametrize("tag", ["div", "section", "form"])
def test_names_of_wrappers_delete_no_article(name, tag):
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(8))
    assert main_text(f"<body><ul>{links}</ul><{tag} {name}>{LONG}</{tag}><ul>{links}</ul></body>") == LONG_TEXT


def test_density_chooses_without_names():
    links = "".join(f"<li><a href=/{i}>A link of some length {i}</a></li>" for i in range(20))
    page = f"<body><div><ul>{links}</ul></div><div><div>{LONG}</div></div><div><ul>{links}</ul><p>Made by us.</p></div></body>"
    assert main_text(page) == LONG_TEXT


def test_comments_longer_than_the_article_go():
    comments = "".join(f"<div><p>Comment {i}: I liked it, and have much to say about it, more than the writer.</p></div>" for i in range(30))
    assert main_text(f"<body><div>{LONG}</div><section id='comments'>{comments}</section></body>") == LONG_TEXT
    assert main_text(f"<body><article>{LONG}<div class='comment-list'>{comments}</div></article></body>") == LONG_TEXT


def test_direct_text_beside_the_heart_stays():
    page = f"<body><div>Text that stands in the node itself and is long enough to be part of it.<br>More.<blockquote>{LONG}</blockquote>And some text after the quotation, long enough as well.</div></body>"
    assert main_text(page) == f"Text that stands in the node itself and is long enough to be part of it. More. {LONG_TEXT} And some text after the quotation, long enough as well."


def test_unclosed_raw_elements_swallow_the_rest():
    for tag in ("script", "title", "textarea"):
        assert main_text(f"<body><article>{ARTICLE}</article><{tag}> x <p>gone</p>") == TEXT


def _plain_density(node, share):
    """The measures of a node by their definition, from its whole subtree each time."""

    def walk(n):
        yield n
        for p in n.parts:
            if isinstance(p, html.Node):
                yield from walk(p)

    def signs(n):
        return sum(len("".join(p.split())) for m in walk(n) for p in m.parts if isinstance(p, str))

    def linked(n, inside=False):
        inside = inside or n.tag == "a"
        return sum(len("".join(p.split())) if isinstance(p, str) and inside else linked(p, inside) if not isinstance(p, str) else 0 for p in n.parts)

    chars, tags, links, link_chars = signs(node), sum(1 for _ in walk(node)) - 1, sum(m.tag == "a" for m in walk(node)) - (node.tag == "a"), linked(node)
    if not chars:
        return 0.0
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    ratio = chars / max(1, link_chars) * max(1, tags) / max(1, links)
    return chars / max(1, tags) * math.log(max(ratio, 1.0)) / math.log(1 + base)


def test_densities_by_definition():
    rng = random.Random(5)
    for _ in range(40):
        page = "".join(rng.choice(["<div>", "</div>", "<p>", "<a href=x>", "</a>", "<ul><li>", "</ul>", "some words ", "x", "<b>", "</b>", "<section class=share>", "</section>"]) for _ in range(60))
        nodes = html._count(html.parse(page))
        html._believe_names(nodes)
        html._measure(nodes)
        share = nodes[0].link_chars / nodes[0].chars if nodes[0].chars else 0.0
        for node in nodes:
            assert math.isclose(node.density, _plain_density(node, share), abs_tol=1e-9)
            children = [p for p in node.parts if isinstance(p, html.Node)]
            assert math.isclose(node.total, sum(c.density * (html.PENALTY if c.noise else 1) for c in children if c.tag not in html.INLINE), abs_tol=1e-9)


def _renamed(page):
    """The page without classes, ids and roles, its article as a div."""
    page = re.sub(r"""\s(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", page)
    return re.sub(r"<(/?)(article|main)\b", r"<\1div", page, flags=re.I)


def _nameless(page):
    """Nor does any other element say what it is."""
    return re.sub(r"<(/?)(nav|footer|header|aside|section|menu|form|dialog)\b", r"<\1div", _renamed(page), flags=re.I)


def test_density_decides_on_whole_pages(spark, monkeypatch):
    """What the pages' texts are with all names is what density alone finds without them; a constant in its place does not."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    texts = [main_text(p) for p in pages]
    share = lambda change: sum(main_text(change(p)) == t for p, t in zip(pages, texts, strict=True)) / len(pages)
    assert share(lambda p: re.sub(r"<(/?)(article|main)\b", r"<\1div", p, flags=re.I)) == 1
    renamed = share(_renamed)
    assert renamed >= 0.95 and share(_nameless) >= 0.9
    monkeypatch.setattr(html, "_density", lambda chars, tags, link_chars, link_tags, share: float(chars > 0))
    assert share(_renamed) < renamed and share(_nameless) < 0.7


def test_sections_of_one_article_stay_together():
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(8))
    page = f"<body><div><ul>{links}</ul></div><div><div>{LONG}</div><div>{LONG}</div></div><div>A short line that isn't any part of it.</div></body>"
    assert main_text(page) == f"{LONG_TEXT} {LONG_TEXT}"


@pytest.mark.parametrize("piece", [("<b>", "</i>"), ("<div><a>", "</a>"), ("<p><i><b>", "<hr></i>"), ("<ul><li>", "<li>"), ("<b><div>", "</b>")])
def test_deep_pages_take_linear_time(piece):
    def seconds(n):
        began = time.perf_counter()
        main_text(piece[0] * n + "text " + piece[1] * n)
        return time.perf_counter() - began

    seconds(2000)
    assert seconds(16_000) < 24 * max(seconds(2000), 0.02)  # 8 times as long a page; a square would be 64 times


def test_ties_go_to_the_first():
    block = "<div><p>Ten letters and some more of them.</p><p>Ten letters and some more of them.</p></div>"
    assert main_text(f"<body>{block}<hr>{block}</body>").startswith("Ten letters")


def test_table(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>"), (2, None, None), (None, "v", ""), (1, "u", f"<article>{ARTICLE}</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url as text", "page_id as n_chars")
    got = sorted(map(tuple, extract(df).collect()), key=str)
    assert got == sorted([(1, "u", TEXT, len(TEXT)), (2, None, "", 0), (None, "v", "", 0), (1, "u", TEXT, len(TEXT))], key=str)
    assert extract(df.limit(0)).count() == 0
