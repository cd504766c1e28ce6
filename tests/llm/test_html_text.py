from quotelens.llm import html_text
from quotelens.llm.html_text import main_text

PROSE = "It was in the year that the house by the river was built, and it is still there for all of us to see and to enjoy."


def test_article_without_the_rest():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
    <header>Site</header><nav><ul><li><a href=a>One</a></li></ul></nav><div class="ad">{PROSE}</div>
    <article><header><h1>Title &amp; more</h1></header><p>{PROSE}<p>Short<br>one&nbsp; &lt;b&gt;.</p>
    <aside>{PROSE}</aside><ul><li>first</li><li>second</li></ul><section id="comments"><p>{PROSE}</p></section></article>
    <form><label>Name</label></form><footer>{PROSE}</footer><!-- {PROSE} --></body></html>"""
    assert main_text(page) == f"Title & more\n\n{PROSE}\n\nShort one <b>.\n\nfirst\n\nsecond"


def test_page_without_article_is_told_by_its_words():
    page = f"""<body><div class="menu"><a href=x>Home</a></div><div><h2>The house</h2><p>{PROSE}</p><p>Short one.</p><p>{PROSE} {PROSE}</p>
    </div><div class="cookie-notice">{PROSE}</div><p><a href=x>Read more about it</a></p><p>Copyright 2020</p><div>alpha beta gamma delta
    epsilon zeta eta theta iota kappa lambda</div></body>"""
    assert main_text(page) == f"The house\n\n{PROSE}\n\nShort one.\n\n{PROSE} {PROSE}"


def test_broken_markup_is_read_as_far_as_it_goes():
    assert main_text(None) == main_text("") == main_text("<html>") == ""
    assert main_text(f"<article><p><b>{PROSE}<br><p>Next & last &am") == f"{PROSE}\n\nNext & last &am"
    assert main_text(f"<article><p>{PROSE}<script>never closed {PROSE}") == PROSE
    assert main_text(f"<article><p>{PROSE}</p><!-- never closed {PROSE}") == PROSE
    assert main_text(f"<article><p>{PROSE} 3 < 4 and <a href='x") .startswith(PROSE)
    assert main_text("<article>" + "<div>" * 3000 + PROSE) == PROSE


def test_rows_and_edge_cases(spark):
    rows = [(1, "u", f"<article><p>{PROSE}</p></article>", "clash"), (1, "u", f"<article><p>{PROSE}</p></article>", "clash"),
            (None, None, None, "clash"), (2, "v", "", None), (3, "w", "<article><p>" + "the word " * 100_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert [(r["page_id"], r["n_chars"]) for r in got] == [(1, len(PROSE)), (1, len(PROSE)), (None, 0), (2, 0), (3, 899_999)]
    assert html_text.extract(df.limit(0)).count() == 0
