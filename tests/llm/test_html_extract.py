from corpusmill.llm.html_extract import extract, main_text, smoothed

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor "


def test_one_line_page():
    html = (
        '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home page</a></li></ul></nav>'
        f'<!-- ad --><div class="ad">Buy this now.</div><article><h1>A title</h1><p><b>First &amp; {WORDS}.<br><p>Short.</p><p>{WORDS * 5}</p></article>'
        "<footer>&copy; someone</footer></body></html>"
    )
    assert main_text(html) == "\n\n".join(["A title", f"First & {WORDS.strip()} .", "Short.", (WORDS * 5).strip()])


def test_parts_beside_the_article_go():
    para = f"<p>{WORDS * 6}</p>\n"
    html = f"""<body><header><h1>Site</h1><nav><a href=a>a</a> <a href=b>b</a></nav></header>
    <div id="cookie-notice">We use cookies.</div><main><div class="content"><header><h1>Title</h1></header>{para}<h2>Part</h2>{para}<ul><li>one<li>two</ul>
    <form><label>Mail</label><input></form><aside>More to read</aside><div class="advert">Ad</div></div>
    <section class="comments"><p>Nice! {WORDS * 3}</p></section></main><div class="sidebar">{"<p>Link text</p>" * 5}</div><footer>Imprint</footer></body>"""
    body = (WORDS * 6).strip()
    assert main_text(html) == "\n\n".join(["Title", body, "Part", body, "one", "two"])


def test_plain_containers_without_names():
    links = "".join(f'<li><a href="{i}">Menu {i}</a></li>' for i in range(8))
    html = f"<body><div><ul>{links}</ul></div><div><p>{WORDS * 8}</p><p>Ok.</p><p>{WORDS * 8}</p></div><div><a href=x>About</a> <a href=y>Terms</a></div></body>"
    assert main_text(html) == "\n\n".join([(WORDS * 8).strip(), "Ok.", (WORDS * 8).strip()])


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<html><body></body></html>") == main_text("<script>x") == ""
    assert main_text("just text &lt;b&gt;\n two") == "just text <b> two"
    assert main_text("<article><p>cut off at <b>the") == "cut off at the"
    deep = "<div>" * 5000 + "word" + "</div>" * 5000
    assert main_text(deep) == "word"
    assert len(main_text("<p>" + "é " * 400_000 + "</p>")) == 799_999


def test_smoothing_keeps_a_constant():
    assert all(abs(x - 4) < 1e-12 for x in smoothed([4.0] * 9)) and smoothed([]) == []


def test_table(spark):
    rows = [(1, "u", "<p>a  b</p>", 5), (1, "u", "<p>a  b</p>", 5), (None, None, None, 5)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "u", "a b", 3), (1, "u", "a b", 3), (None, None, "", 0)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


W = "word " * 60


def test_malformed_and_large_pages_end_soon():
    import time

    assert main_text("x<![foo[y]]>z<![ 1>q") == "xzq"
    assert main_text(f"<p>{W}<!-- never ends {W}") == W.strip()
    began = time.time()
    assert main_text("<a " * 350_000) == "" and main_text("<!--" * 250_000) == "" and main_text("<b <i " * 170_000) == ""
    assert len(main_text("<div><p>hello there</p>" * 20_000).split("\n\n")) >= 19_600
    main_text("<div>" * 50_000 + "</section>" * 50_000)
    assert time.time() - began < 20


def test_names_do_not_remove_parts_of_an_article():
    html = (
        f'<article><p class="notice-period">{W}</p><section id="form-of-government"><p>{W}</p></section><div class="article-header"><h1>T</h1></div>'
        f'<p class="form">f</p><ul class="menu-of-the-day"><li>soup</ul><p>{W}</p><div class="site-comments"><p>{W * 9}</p></div></article>'
    )
    assert main_text(html).split("\n\n") == [W.strip(), W.strip(), "T", "f", "soup", W.strip()]


def test_wrappers_with_telling_names_and_open_heads():
    assert main_text(f'<html><head><title>t</title><body><form><div class="content has-sidebar"><p>{W}</p><p>{W}</p></div></form>') == f"{W.strip()}\n\n{W.strip()}"
    assert main_text(f'<div class="sidebar"><p>{W}</p><p>{W}</p></div><div><p>short one</p></div>').startswith("word")


def test_menus_and_notices_in_the_same_container_go():
    links = "".join(f"<li><a href=x>Menu {i}</a>" for i in range(5))
    html = f"<div><ul>{links}</ul><p>{W}</p><p>Ok.</p><p>{W}</p><p>We use cookies.</p><div>Copyright me</div></div>"
    assert main_text(html).split("\n\n") == [W.strip(), "Ok.", W.strip()]
