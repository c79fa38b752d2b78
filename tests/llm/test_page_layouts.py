"""Nested and mixed layouts on one host: no heading, lead or block of an article is lost."""

from thermoscope.llm import html_paths

from .conftest import table

FLAT = "<body><article><section><p>{}</p></section></article></body>"
LEAD = "<body><nav>Menu</nav><article><h1>Head</h1><p>lead</p><div class=body><div class=in>{}</div></div>" \
       "<blockquote>quote</blockquote></article><footer>x</footer></body>"


def texts(spark, pages):
    df = spark.createDataFrame([(k, "http://h.example/x", x) for k, x in enumerate(pages)],
                               "page_id long, url string, html string")
    return {i: r["text"] for i, r in table(html_paths.main_text(df), "page_id").items()}


def test_page_with_one_small_section_keeps_its_paragraphs(spark):
    own = "<body><article><p>{}</p><section><p>small part</p></section></article></body>".format("para " * 50)
    got = texts(spark, [FLAT.format("word " * 30)] * 9 + [own])
    assert got[0] == ("word " * 30).strip() and got[9] == "para " * 50 + "small part"


def test_heading_lead_and_siblings_of_the_dominant_block(spark):
    got = texts(spark, [LEAD.format("word " * 40)] * 5)
    assert set(got.values()) == {"Head lead " + "word " * 40 + "quote"}
    got = texts(spark, ["<body><h1>Head</h1><p>lead</p><div class=in>{}</div></body>".format("word " * 40)] * 3)
    assert set(got.values()) == {"Head lead " + ("word " * 40).strip()}


def test_second_layout_of_a_host_is_followed(spark):
    """Pages of a rarer layout with a teaser on the host's usual path keep their story."""
    other = "<body><div class=story><p>{}</p></div><article><div class=in>teaser</div></article></body>"
    usual = "<body><article><div class=in>{}</div></article></body>"
    got = texts(spark, [usual.format("word " * 30)] * 9 + [other.format("story " * 60)] * 2)
    assert got[0] == ("word " * 30).strip()
    assert got[9] == got[10] and got[9].startswith("story " * 60)


def test_more_layouts_than_listed_paths(spark):
    pages = [f"<body><div class={c * 3}><p>{c * 4} {'word ' * 30}</p></div><article>teaser {k}</article></body>"
             for c in "abcdefghijkl" for k in range(2)] + ["<body><article>{}</article></body>".format("top " * 20)] * 5
    got = texts(spark, pages)
    assert all(got[k].startswith("abcdefghijkl"[k // 2] * 4) for k in range(24))
