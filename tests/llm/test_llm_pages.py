import pytest

from driftline.llm.pages import digest, extract, main_text, parse

CASES = [
    ("<html><body><nav><a>Menu</a></nav><article><h1>T &amp; x</h1><p>One\n <b>two</b><br>three<p>Four</article><footer>f</footer>", "T & x\nOne two three\nFour"),
    ("<div class='cookie-notice'>c</div><div>Body <i>te</i>xt</div><script>var t='</p>';</script><p>more", "Body text\nmore"),
    ("<main><header><h1>Head</h1></header><p>a</p><section id=comments><p>no</p></section></main><aside>x</aside>", "Head\na"),
    ("<p>a<!-- x > y --><ul><li>1<li>2</ul>", "a\n1\n2"),
    ("<p>open <a title=\"q>1\">in</a> <a title=\"broken>out</a> z", "open in out z"),
    ("", ""), ("   ", ""), ("plain &lt;text&gt; &nbsp;here", "plain <text> here"), ("<style>p{}</style><form><input>q</form>", ""),
    ("<p>unclosed comment <!-- gone", "unclosed comment"), ("<div hidden>h</div><div role=navigation>r</div><p>k</p>", "k"),
    ("<table><tr><td>a<td>b</table>", "a\nb"), ("<article><p>a</p></article><p>outside</p><article class=comment>no</article>", "a"),
    ("<p>5 < 6 and 7 > 3</p>", "5 < 6 and 7 > 3"),
]


@pytest.mark.parametrize(("source", "text"), CASES)
def test_cases(source, text):
    assert main_text(source) == text


def test_very_deep_and_very_long_pages():
    assert main_text("<div>" * 20000 + "x") == "x"
    assert len(main_text("<p>word</p>" * 20000).split("\n")) == 20000
    assert main_text('<a "' * 5000) is not None


def test_equal_subtrees_have_equal_hashes():
    a, b = digest(parse("<p>x <b>y</b></p><p class=k>x  <b>y</b></p>")), digest(parse("<div><p>x <b>y</b></p></div>"))
    assert len(a) == 2 and a < b


def test_site_templates_go_and_copies_do_not_make_one(spark):
    bar = "<div><span>Our site</span> welcomes you</div>"
    rows = [(k, f"http://A.com/{k}?q", f"<body>{bar}<div>story number {k}</div></body>") for k in range(12)]
    rows += [(100 + k, "https://a.com/copy", "<body><div>one story copied around</div></body>") for k in range(30)]
    rows += [(200, "http://b.com/", f"<body>{bar}</body>"), (201, None, None), (202, "nourl", ""), (None, "http://a.com/", f"{bar}x")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, main_text string, n int").repartition(3)
    got = {r.page_id: r.main_text for r in extract(df).collect()}
    assert all(got[k] == f"story number {k}" for k in range(12))
    assert all(got[100 + k] == "one story copied around" for k in range(30))
    assert got[200] == "Our site welcomes you" and got[201] == got[202] == "" and got[None] == "x"
    assert extract(df).count() == len(rows) and extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["post-12 post type-post hentry category-x tag-news", "content with-sidebar", "no-sidebar", "post has-comments", "comments-closed", "menu-open", "hidden-xs", "page sidebar"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_layout_classes_are_no_reason_to_drop(tag, name):
    inner = "<article><p>whole text</p></article>" if tag == "div" and name == "page sidebar" else "<p>whole text</p>"
    assert main_text(f"<body><{tag} class='{name}'>{inner}<div class='sidebar-left'>s</div></{tag}></body>") == "whole text"


def test_elements_of_an_article_stay_and_its_surroundings_go():
    source = ("<form id=aspnet><article><h1>T</h1><p>let <math><mi>x</mi></math> be <label>one</label></p><fieldset>set</fieldset></article></form>"
              "<div class='widget_area'>w</div><ol class='comment-list'><li><article class='comment-body'>c</article></li></ol>")
    assert main_text(source) == "T\nlet x be one\nset"
    outside = ["site-footer", "nav-links", "main-menu", "sidebar__inner", "cookie-notice", "x related-posts", "share-buttons", "ads", "post-comments", "NavBar"]
    assert [main_text(f"<div class='{c}'>go</div><p>stay") for c in outside] == ["stay"] * len(outside)


def test_templates_of_sections_go(spark):
    """Three layouts on one host: each section's menu and notice stand on a third of the pages; all go, sentences and headings stay."""
    rows = []
    for k in range(60):
        part = ("news", "shop", "help")[k % 3]
        own = f"<h2>References in {part}</h2><p>story <em>not</em> number {k} is told <b>here in {part} and only here today</b></p><table><tr><td>1</td><td>yes</td></tr></table>"
        rows.append((k, f"http://a.com/{k}", f"<body><div><ul><li>{part} home<li>{part} list</ul></div><div>{own}</div><p>All the pages of {part} are kept by the same people</p></body>"))
    rows += [(100 + k, f"http://b.com/{k}", f"<article><p>The same long sentence that an author may quote often</p><p>{k}</p></article>" if k % 3 == 0 else f"<p>page {k}</p>") for k in range(60)]
    got = {r.page_id: r.main_text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    left = sum(("home" in got[k]) + ("same people" in got[k]) for k in range(60))
    assert left == 0
    for k in range(60):
        part = ("news", "shop", "help")[k % 3]
        assert got[k].startswith(f"References in {part}\nstory")
        assert f"number {k} is told here in {part} and only here today" in got[k]
    assert all(got[100 + k] == f"The same long sentence that an author may quote often\n{k}" for k in range(0, 60, 3))
