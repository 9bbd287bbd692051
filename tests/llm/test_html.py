import html as H
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm.html import extract, main_text, op10_main_text, smoothed, threshold

LONG = "This is a sentence of the article that is long enough to count. " * 4
CASES = [
    (None, ""),
    ("", ""),
    ("just text &amp; more", "just text & more"),
    ("<p>a</p>", "a"),
    ("<nav>menu</nav>", ""),
    (f"<body><header>Site</header><nav><a href=x>home</a></nav><main><h1>T</h1><p>{LONG}</p><p>x</p></main><footer>f</footer></body>", f"T\n{LONG.strip()}\nx"),
    (f"<div id=menu><ul><li><a href=1>one</a><li><a href=2>two</a></ul></div><div class=content><h2>T</h2><p>{LONG}<p>short<p>{LONG}</div><div class='comment-list'><p>{LONG}</p></div>", f"T\n{LONG.strip()}\nshort\n{LONG.strip()}"),
    (f"<article><h1>A&nbsp;b</h1><p>x <b>y</b>z<br>w</p><aside>{LONG}</aside><section class=comments><article><p>{LONG}</p></article></section></article>", "A b\nx yz w"),
    (f"<article><p><b>open {LONG}<br><p>next<div class='ad'>buy</div></article><footer>{LONG}</footer>", f"open {LONG.strip()}\nnext"),
    ("<script>if (a < b) document.write('<p>no</p>')</script><style>p{}</style><p>yes<!-- <p>no</p> --></p>", "yes"),
    (f"<div class=cookie-notice><p>{LONG}</p></div><article><header><h1>T</h1></header><p>{LONG}</p><form>mail <input></form></article>", f"T\n{LONG.strip()}"),
    ("<p>a &lt;b&gt; &#65;&#x42; &eacute; 1 < 2</p>", "a <b> AB é 1 < 2"),
    ("<table><tr><td>a<td>b</table>", "a\nb"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_pages(page, text):
    assert extract(page) == text


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-ads", "with-comments"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_wrappers_named_like_boilerplate(name, tag):
    page = f"<body><nav><a href=x>home</a></nav><div class='{name}'><{tag}><h1>T</h1><p>{LONG}</p><p>{LONG}</p></{tag}><div class=sidebar><a href=y>more</a></div></div></body>"
    assert extract(page) == f"T\n{LONG.strip()}\n{LONG.strip()}"


@pytest.mark.parametrize("name", ["id='related-work'", "class='social-history'", "class='no-ads'", "id=promotion-of-science"])
def test_sections_named_like_boilerplate(name):
    page = f"<article><h1>T</h1><p>{LONG}</p><section {name}><p>{LONG}</p></section><p>{LONG}</p></article>"
    assert extract(page) == "\n".join(["T", *[LONG.strip()] * 3])


@pytest.mark.parametrize("name", ["class=ad", "class='social-links'", "class='user-comments'", "id=comment-list-2", "class='related posts'", "class='cookie-bar'", "class='related-stories'"])
def test_boilerplate_in_an_article(name):
    page = f"<article><h1>T</h1><p>{LONG}</p><div {name}><p>Some words</p><p>More here</p></div><p>{LONG}</p></article>"
    assert extract(page) == "\n".join(["T", *[LONG.strip()] * 2])


def test_long_comments_never_stand_for_the_article():
    page = f"<div class=page><h1>T</h1><p>{LONG}</p><div class=comments><article><p>{LONG * 9}</p></article></div></div>"
    assert extract(page) == f"T\n{LONG.strip()}"


def test_malformed_markup_is_read():
    assert extract(f"<![foo[x]]><p>{LONG}</p><![CDATA[ y ]]><p>z</p><![if !IE]>") == f"{LONG.strip()}\nz"
    assert extract("<p>a</p><!") == "a"


def test_deep_nesting_takes_memory_by_length():
    import time
    import tracemalloc

    page = "<div>x" * 20_000
    start = time.monotonic()
    tracemalloc.start()
    # The innermost element around nine tenths of the text is the region.
    assert extract(page).count("x") == 18_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20 and time.monotonic() - start < 20


pieces = st.one_of(
    st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<div class=ad>", "<article>", "</article>", "<a href=x>", "</a>", "<li>", "<br>", "<b>", "</b>", "<!--", "-->", "<![", "<!", "</", "<", ">", "&amp;", "&", "<script>", "</script>", "<?x", "<td>", "<table>", "</table>", "]]>", "<svg><title>", "<textarea>"]),
    st.text("ab <&;>![]-/\n\u3000é", max_size=8),
)


@settings(max_examples=400, deadline=None)
@given(st.lists(pieces, max_size=25))
def test_any_markup_gives_a_text(parts):
    text = extract("".join(parts))
    assert text == "\n".join(" ".join(x.split()) for x in text.split("\n")) and not (text and any(not x for x in text.split("\n")))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["p", "h2", "li", "blockquote", "div"]), st.text("abc d&<é", max_size=60), st.booleans()), max_size=12))
def test_articles_against_their_blocks(blocks):
    """What a page says of its parts beside what comes out: every block of the article, nothing from outside."""
    inside = "".join(f"<{t}>{'<b>' if b else ''}{H.escape(x)}{'</b>' if b else ''}</{t}>" for t, x, b in blocks)
    page = f"<html><head><title>no</title></head><body><header>no</header><nav><a href=1>no</a></nav><article><h1>{LONG}</h1>{inside}</article><aside>no</aside><footer>no</footer><script>no</script></body></html>"
    assert extract(page) == "\n".join([LONG.strip(), *[w for _, x, _ in blocks if (w := " ".join(x.split()))]])


def test_smoothing_and_threshold():
    assert smoothed([5.0] * 4) == pytest.approx([5.0] * 4)
    assert smoothed([0, 0, 9, 0, 0])[2] < 9
    assert 2 < threshold([1, 2, 1, 90, 80, 100]) < 80
    assert threshold([3.0]) == pytest.approx(3)


def test_given_pages_against_their_pattern(spark):
    """The given pages hold one article of h1 and p elements; read it with patterns instead."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pydict()
    got = {r.page_id: r for r in op10_main_text(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(t["page_id"])
    for i, page in zip(t["page_id"], t["html"], strict=True):
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        lines = [" ".join(H.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(x for x in lines if x)
        assert (got[i].text, got[i].n_chars) == (want, len(want))


def test_rows(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (1, "u", "<p>" + "long " * 200_000, "t"), (None, "u", "<p>x", "t")], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in main_text(df).collect()) == [0, 1, 999_999]
    assert main_text(df.limit(0)).count() == 0
