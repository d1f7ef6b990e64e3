"""Page operators: extraction on written pages, URL rules against a direct reading."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hourline.llm import html_text, url_filter
from hourline.llm.html_text import main_text
from hourline.llm.queries import RULES

LONG = "this sentence has quite a few words in it so that it counts as text"


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        ("plain words without markup", "plain words without markup"),
        ("<p>Hello <b>w</b>orld&nbsp;x &amp; &#x41;&copy</p>", "Hello world x & A©"),
        ("<p>a < b and c > d", "a < b and c > d"),
        ("<article><h1>T</h1><p>A.<p>B<br>C<div>D</div></article><footer>no</footer>", "T A. B C D"),
        ("<nav>x</nav><article>one<nav>no</nav><aside>no</aside><form>no<input name=q>no</form>two</article>", "one two"),
        ("<article>x<script>var a='</article>';</script><style>p{}</style><!-- <p>no</p> -->y</article>", "xy"),
        ("<article>cut off here <a href='x", "cut off here"),
        ("<article>never closed<p>more", "never closed more"),
        ("<article>a<div class='ad'>no<div>no</div>no</div>b<div class=\"share social\">no</div>c</article>", "a b c"),
        (f"<body class='has-sidebar'><div id=top><a href=/>Home</a> <a href=/x>More</a></div><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div></body>", f"{LONG} Short. {LONG}"),
        (f"<main><article><p>{LONG}</p></article><section id='comments'><article class='comment'><p>{LONG}</p></article></section></main>", LONG),
        (f"<div class='cookie-notice'>{LONG}</div><main><h2>Title</h2><p>One.</p></main><div role=contentinfo>{LONG}</div>", "Title One."),
        ("<article><p>x</p><p hidden>no</p><p style='display:none'>no</p></article>", "x"),
        ("<ARTICLE><P>Upper</P></ARTICLE><FOOTER>no</FOOTER>", "Upper"),
        ("<article><p>a</p></div></span></table><p>b</p></article>", "a b"),
        ("<article><textarea>no</textarea><button>no</button><p title='a > b'>yes</p></article>", "yes"),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


BODY = "".join(f"<p>{LONG} {i}</p>" for i in range(6))
TEXT = " ".join(f"{LONG} {i}" for i in range(6))


@pytest.mark.parametrize(
    "page,text",
    [
        ("<body>" + "".join(f"<div class='elementor-widget elementor-widget-text'><div class=elementor-widget-container><p>{LONG} {i}</p></div></div>" for i in range(6)) + "</body>", TEXT),
        (f"<div class=layout-sidebar-right>{BODY}</div><div class=sidebar><p>{LONG}</p></div>", TEXT),
        (f"<section id=discussion>{BODY}</section><div class=footer>no</div>", TEXT),
        (f"<article><p class=share-price>Up</p><div class=popular-science>{BODY}</div><div class=share>no</div></article>", f"Up {TEXT}"),
        (f"<body><form action=/><div>{BODY}</div><div class=menu>no</div></form></body>", TEXT),
        (f"<form><article>{BODY}</article><div class='comments'><p>{LONG}</p></div></form>", TEXT),
        (f"<div class=widget><article>{BODY}</article></div><aside><article>card</article></aside>", TEXT),
        (f"<article><p>x</p><div hidden class=widget>{BODY}</div></article>", "x"),
    ],
)
def test_names_and_tags_lose_no_article(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        # a teaser's mark doesn't take the body's place
        (f"<div class=story>{BODY}</div><article class=card>Other story short blurb here</article>", f"{TEXT} Other story short blurb here"),
        (f"<div class=story>{BODY}</div><div class=related><article>Other story</article></div>", TEXT),
        # a short paragraph between two adverts on an unmarked page
        (f"<div>{BODY}<div class=ad>no</div><p>Five words are here too.</p><div class=ad>no</div>{BODY}</div>", f"{TEXT} Five words are here too. {TEXT}"),
        # text without spaces
        ("<div><a href=/>首页</a></div><div><p>" + "这是一段没有空格的正文" * 5 + "</p></div><div class=footer>版权</div>", "这是一段没有空格的正文" * 5),
    ],
)
def test_distribution_decides_where_marks_do_not(page, text):
    assert main_text(page) == text


def test_end_tags_cost_the_same_however_many_are_open():
    import time

    def seconds(n):
        page = "<article>" + "<div>" * n + "</b>" * n + "text</article>"
        start = time.process_time()
        assert main_text(page) == "text"
        return time.process_time() - start

    assert seconds(16_000) < 12 * seconds(4_000) + 0.2


def test_nothing_of_a_long_article_is_cut():
    blocks = [f"{LONG} {i}" if i % 3 else f"s{i}." for i in range(5000)]
    page = "<header>no</header><article>" + "".join(f"<p>\n {b}  </p>" for b in blocks) + "</article>"
    assert main_text(page) == " ".join(blocks)


@given(st.text("<>/!-=\"'pab &;#x", max_size=60))
@settings(max_examples=400, deadline=None)
def test_any_markup_is_read(page):
    text = main_text(page)
    assert text == " ".join(text.split())


def test_extract(spark):
    rows = [(1, "u", "<article>a b</article>", "t"), (None, None, None, None), (1, "u", "<article>a b</article>", "t"), (2, "v", "", "t")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING, text STRING"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, "u", "a b", 3), (None, None, "", 0), (1, "u", "a b", 3), (2, "v", "", 0)], key=str)
    assert html_text.extract(spark.createDataFrame([], "page_id BIGINT, url STRING, html STRING")).count() == 0


URLS = [
    None, "", "no scheme", "http://a.example.net/en/x?y", "http://EXAMPLE.net/en/", "http://example.net/en", "http://example.net/enx/", "http://x.net", "http://x.net/", "http://xnet/", "http://net/a",
    "https://b.example.com/de/1#z", "https://example.com/fr/", "https://o.org/fr/a/b", "https://o.org/de/", "ftp://org/fr/", "http://badexample.com/de/", "http://?q://net/", "://net/x", "a://b://net/",
    "http://example.net?x/en/", "http://example.net#/en/", "http://w.example.net:80/en/", "http:///en/", "http://.net/", "http://" + "a." * 200 + "net/" + "p" * 5000, "http://x.net/\nb",
]


def direct(url, rules):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    n = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


MORE = [*RULES, ("block", "o.org", "/fr/a"), ("allow", "o.org", "/fr/a/b"), ("block", "b.example.com", "/")]


@pytest.mark.parametrize("rules", [RULES, [], [("block", "net", "/")], [("allow", "org", "/fr/")], MORE])
def test_judge(spark, rules):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id BIGINT, url STRING, keys STRING, host STRING")
    out = url_filter.judge(df.repartition(3), rules)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    for r in out.collect():
        assert (r.host, r.path, r.rule, r.verdict) == direct(URLS[r.page_id], rules), URLS[r.page_id]
    assert url_filter.judge(df.limit(0), rules).count() == 0


def test_judge_keeps_repeats_and_null_ids(spark):
    df = spark.createDataFrame([(None, "http://x.net/"), (1, "http://x.net/"), (1, "http://x.net/")], "page_id BIGINT, url STRING")
    assert sorted((r.page_id is None, r.rule) for r in url_filter.judge(df, RULES).collect()) == [(False, "net/"), (False, "net/"), (True, "net/")]


@pytest.mark.parametrize("n_listed,n_all", [(0, 50), (1, 1), (1, 2000), (400, 20000), (3000, 4000)])
def test_cascade_is_exact_for_the_universe(spark, n_listed, n_all):
    r = random.Random(n_all)
    keys = [f"host{r.random()}.net/{i}" for i in range(n_all)]
    universe = spark.createDataFrame([(k,) for k in keys], "key STRING")
    listed = universe.limit(0) if not n_listed else spark.createDataFrame([(k,) for k in keys[:n_listed]], "key STRING")
    cascade = url_filter.build_cascade(listed, universe)
    hashes = np.array([x[0] for x in universe.select(url_filter.key_hashes(universe.key)).collect()], dtype=np.int64).view(np.uint64)
    assert cascade.member(hashes).tolist() == [i < n_listed for i in range(n_all)]
    assert n_listed < 400 or cascade.n_bytes < n_listed * 8


def test_cascade_refuses_a_list_beyond_its_limit(spark):
    with pytest.raises(ValueError):
        url_filter.build_cascade(spark.range(100).selectExpr("CAST(id AS STRING) AS key"), spark.range(10).selectExpr("CAST(id AS STRING) AS key"), max_bytes=64)
