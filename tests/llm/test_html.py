import html
import re
import time

import pytest

from signalbase.llm.html import Page, extract_text, main_text

BODY = "This is the first paragraph of a story, and it is long enough to be one. It has two sentences."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, which is a long sentence, indeed. Please agree, or do not.</p></div>
<div id="wrap"><div class='sidebar widget'><p>Sidebar text, of some length, with commas, and more commas.</p></div>
<div class="post"><h1>A  title</h1><p>{BODY}<p>Short.<p>An <b>in</b>line<br>break &amp; &lt;tag&gt; &copy<ul><li>item one<li>item two</ul>
<div class="advert">Buy, now. Buy more, today.</div><script>var x = "<p>no</p>";</script><!-- <p>no</p> --><form>Name <input><button>Go</button></form>
<p>{BODY}</p></div>
<div id="comments"><p>First reader comment, quite long, and full of opinion. Indeed it goes on, and on, for a while.</p></div></div>
<footer><p>Imprint, privacy, and so on.</p></footer></body></html>"""


def test_article_alone():
    assert main_text(PAGE) == f"A title {BODY} Short. An inline break & <tag> © item one item two {BODY}"


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<p></p>", ""), ("plain text", "plain text"), ("<p>a<p>b", "a b"), ("<<>>&", "<<>>&"), ("<article><p>x", "x"), ("<div><script>never closed", ""), ("<table><tr><td>a<td>b</table>", "a b"), ("&#65;&#x42;&nbsp;c", "AB c")])
def test_edges(page, text):
    assert main_text(page) == text


FRAMES = [
    '<div class="page has-sidebar no-comments">{}<div class=sidebar>menu of things, long</div></div>',
    '<div class="related layout"><main>{}</main></div>',
    '<div id="page-header-wrap search"><article class="post">{}</article></div>',
    "<body class=sidebar><div role=main>{}</div><section id=comments><article class='comment-body comment'><p>A reader says, at great length, that this is, indeed, so.</p></article></section>",
]


@pytest.mark.parametrize("frame", FRAMES)
def test_frames_of_the_article_stay(frame):
    assert main_text(frame.format(f"<h1>Head</h1><p>{BODY}</p><p>End.</p>")) == f"Head {BODY} End."


def test_long_pages_take_linear_time():
    assert len(main_text("<p>" + "word, " * 300_000)) > 1_000_000
    assert main_text("<" * 200_000) and main_text("<div>" * 3000 + "x") == "x"


def test_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in extract_text(pages).collect()}
    for r in pages.collect():
        inner = r["html"][r["html"].index("<article>") : r["html"].rindex("</article>")]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"<(?:/?(?:p|h1|article)|br)>", inner))
        assert got[r["page_id"]]["text"] == " ".join(b for b in blocks if b) and got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_columns(spark):
    frame = spark.createDataFrame([(None, None, "u", "t"), (1, "<p>x", None, "t"), (1, "<p>x", None, "t")], "page_id long, html string, url string, text string")
    rows = extract_text(frame).collect()
    assert sorted((r["text"], r["n_chars"]) for r in rows) == [("", 0), ("x", 1), ("x", 1)] and extract_text(frame.filter("false")).count() == 0


WHOLE = [
    f"<article><h1>Head</h1><p>Short.</p><blockquote><p>{BODY} {BODY}</p></blockquote><p>{BODY}</p></article>",
    f"<article><section><p>{BODY} {BODY}</p></section><section><p>{BODY}</p><p>Short.</p></section></article>",
    f"<div id=a><div><p>{BODY} {BODY}</p></div><div><p>{BODY}</p></div></div>",
    f"<article><p>{BODY}</p><ul><li>{BODY}<li>{BODY}<li>{BODY}</ul><p>Short.</p></article>",
    f"<article><p>{BODY}</p><table><tr><td>{BODY}<td>{BODY}</table><p>Short.</p></article>",
    f"<main><h1>Head</h1><div class=body><p>{BODY}</p><p>{BODY}</p></div></main>",
    f"<div><h1>Head</h1><div class=body><p>{BODY}</p><p>{BODY}</p></div></div>",
]


@pytest.mark.parametrize("page", WHOLE)
def test_no_part_of_an_article_is_lost(page):
    assert main_text(f"<body>{page}</body>") == " ".join(re.sub("<[^>]*>", " ", page).split())


WRAPPED = [
    "<form action=/><div id=main>{}</div><input></form>",
    '<form class="page" method=post><h1>Head</h1>{}</form>',
    "<article class='post tag-news'>{}</article><form>Name <button>Go</button></form>",
    "<div class='post tag-x'>{}</div><div class=tag-list>one, two, three</div>",
    "<div class='post discussion-politics'>{}</div><div class=related-posts><p>Other things, elsewhere.</p></div>",
    "<div class='post search'>{}</div><div class=comments><p>A reader says, at great length, that this is, indeed, so.</p></div>",
]


@pytest.mark.parametrize("frame", WRAPPED)
def test_forms_and_doubtful_names_around_an_article_stay(frame):
    head = "Head " if "<h1>" in frame else ""
    assert main_text("<body>" + frame.format(f"<h2>Title</h2><p>{BODY}</p><p>{BODY}</p>") + "</body>") == f"{head}Title {BODY} {BODY}"


def test_small_forms_and_doubtful_names_are_left_out():
    page = f"<body><div class=post><p>{BODY}</p><p>{BODY}</p><form><p>Write, to us, now.</p></form><div class='share-buttons'>Share, this, now.</div><div class=tags>a, b, c</div></div></body>"
    assert main_text(page) == f"{BODY} {BODY}"


SHAPES = ["<a " * 200_000, "<div>x" * 20_000, '<a "' * 100_000 + ">", "<script " * 100_000, "<b>" * 50_000 + "<p>x</p>" * 50_000, "<p><td>" + "<div>" * 20_000 + "</p>" * 50_000, "<!" * 200_000, "<a b='>" * 100_000]


@pytest.mark.parametrize("page", SHAPES, ids=range(len(SHAPES)))
def test_odd_pages_take_linear_time(page):
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 10


def test_paths_below_the_threshold_are_left_out_whatever_their_names():
    links = "".join(f"<li><a>Word {k}</a>" for k in range(12))
    teasers = "".join(f"<div class=q><span>Other {k}</span></div>" for k in range(6))
    page = f"<body><div class=x1><ul>{links}</ul></div><div class=z><h1>Head of it</h1><p>{BODY} {BODY}</p><h2>Part</h2><p>{BODY} {BODY}</p><p>Short.</p><p>{BODY}</p></div><div class=y>{teasers}</div></body>"
    assert main_text(page) == f"Head of it {BODY} {BODY} Part {BODY} {BODY} Short. {BODY}"
    assert "Word 3" in main_text(page, 0.0) and "Other 5" in main_text(page, 0.0)


def test_the_threshold_decides_on_generated_pages(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    assert all(main_text(p) != main_text(p, 0.0) for p in pages)


def test_a_page_without_an_article_is_empty():
    assert main_text("<body><nav><a>Home</a></nav><footer><p>Imprint, privacy, and so on.</p></footer></body>") == ""


@pytest.mark.parametrize("page", ["<div class=ad>x", "<div class=ad><h1>x", "<li class=share>x", "<main><form>x", "<table><tr><td>x"])
def test_deeply_nested_elements_take_linear_time(page):
    began = time.process_time()
    main_text(page * 50_000)
    assert time.process_time() - began < 20


def test_items_and_cells_end_each_other_across_blocks():
    page = "<article><h1>Head line</h1><ul><li><div>One, two.<li><p>Three, four.<ul><li>Five, six.</ul><li>Seven.</ul><table><tr><th>Head, of it.<tr><td>A cell, left.<td>A cell, right.</table></article>"
    assert main_text(page) == "Head line One, two. Three, four. Five, six. Seven. Head, of it. A cell, left. A cell, right."
    parsed = Page(page)
    depth = lambda k: 0 if k <= 0 else 1 + depth(parsed.paths[k][0])
    at = {text: depth(path) for path, text, _ in parsed.nodes}
    assert at["Seven."] == 3 and at["Five, six."] == 5 and at["A cell, right."] == 4
