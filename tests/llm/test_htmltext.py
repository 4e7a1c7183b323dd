import html
import random
import re

from plumbline.llm import htmltext as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head><body class="has-sidebar"><div id="cookie-notice">We use cookies</div>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><!-- <article>no</article> --><div class="ad-slot">Buy</div>
{open}<h1>Title {i}</h1><p>One&nbsp;<b>bo</b>ld &amp; &lt;tag&gt; é{i}<br>two<p>Three   <a href="x>y">link</a> text{i}.<form><input><label>Mail</label></form><aside>see also</aside><p>Four &copy; {i}{more}</p><div class="comments"><p>reader says</p></div>{close}
<div class="sidebar"><p>side</p></div><footer>foot</footer></body></html>"""


def want(i, more=""):
    return f"Title {i} One bold & <tag> é{i} two Three link text{i}. Four © {i}{more}"


def texts(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    return {r.page_id: (r.url, r.text, r.n_chars) for r in h.extracted(df).collect()}


def test_articles(spark):
    opens = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<div class="x7">', "</div>")]
    rows = [(k * 100 + i, f"https://H{k}.example.org/{i}?x", PAGE.format(open=a, close=b, i=i, more=" more" * (i % 3))) for k, (a, b) in enumerate(opens) for i in range(12)]
    rows += [(900, None, None), (901, "no url", "just <b>te</b>xt &am"), (902, "https://h0.example.org/cut", PAGE.format(open="<article>", close="</article>", i=5, more="").partition("<footer>")[0][:-9]), (903, "https://h9.example.org/", "<article><p>a</p>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<article class='comment'>c</article></article>")]
    got = texts(spark, rows)
    assert len(got) == len(rows)
    for k in range(4):
        for i in range(12):
            assert got[k * 100 + i][1] == want(i, " more" * (i % 3)), (k, i)
    assert got[900] == (None, "", 0) and got[901][1] == "just text &am" and got[902][1] == want(5) and got[903][1] == "a deep"
    assert got[3][2] == len(got[3][1])
    assert h.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_alignment():
    pages = ["<body><h1>a</h1><p>x</p><p>y</p><ul><li>1</li></ul></body>", "<body><h1>b</h1><p>x</p><h2>s</h2><p>q</p><h2>t</h2><p>q</p></body>", "<body><p>z</p></body>"]
    w = None
    for p in pages:
        own = h.wrapper_of(h.parse(p))
        w = h.merged(w, own) if w else own
    assert h.pattern(w["k"][0]) == "<body><h1>#text</h1>? (<p>#text</p> <h2>#text</h2>)* <p>#text</p>+ <ul><li>#text</li></ul>?</body>"
    a, b, c = (h.wrapper_of(h.parse(p)) for p in pages)
    assert h.decided(h.merged(h.merged(a, b), c)) == h.decided(h.merged(a, h.merged(b, c)))


def test_given_pages_equal_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in h.extracted(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br)>", inner)
        assert got[r.page_id] == " ".join(" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in blocks if b.strip())


def test_text_after_a_deep_nest():
    deep = "<div>" * 100 + "innermost words <nav>menu words</nav> more" + "</div>" * 100
    source = f"<html><body><div class='page'><article><p>before it</p>{deep}<p>after the nest</p></article><p>outside of it</p></div></body></html>"
    flags = h.decided(h.wrapper_of(h.parse(source)))
    assert h.main_text(source, flags) == "before it innermost words more after the nest"


def test_layouts_of_one_host(spark):
    opens = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<div class="x7">', "</div>")]
    for host in ("https://mixed.example.org/", "no url "):
        rows = [(k * 100 + i, f"{host}{i}", PAGE.format(open=a, close=b, i=i, more="")) for k, (a, b) in enumerate(opens) for i in range(3)]
        got = texts(spark, rows)
        assert [got[r[0]][1] for r in rows] == [want(i) for _ in opens for i in range(3)]


def test_template_text_that_no_class_marks(spark):
    """Texts on all pages of a host are its template's, wherever they stand; texts on some are not. Copies of a page count once."""
    rows = [(i, f"https://plain.example.org/{i}", f"<body><p>Welcome to our site</p><p>Varying text number {i}.</p>{'<p>on some</p>' * (i % 2)}<p>Call us at once</p></body>") for i in range(6)]
    rows += [(10 + i, f"https://copies.example.org/{i}", "<body><p>The same page each time</p></body>") for i in range(9)]
    rows += [(20 + i, f"https://long.example.org/{i}", f"<body><div>{'a constant that is far longer than what varies ' * 9}</div><div><p>Short {i}</p></div></body>") for i in range(7)]
    got = texts(spark, rows)
    assert [got[i][1] for i in range(6)] == [f"Varying text number {i}." + " on some" * (i % 2) for i in range(6)]
    assert {got[10 + i][1] for i in range(9)} == {"The same page each time"} and [got[20 + i][1] for i in range(7)] == [f"Short {i}" for i in range(7)]


def test_marks_that_leave_it_open(spark):
    inner = '<div class="social-history">The social history of Rome {i}</div><div class="alert">Take care {i}</div><div class="notice-board-history">Boards {i}</div><div class="share-buttons">Share it {i}</div><div class="related-reading"><a href="/x">Another piece {i}</a></div>'
    rows = [(i, f"https://open.example.org/{i}", f"<body><article><p>Head {i}</p>{inner.format(i=i)}<p>End {i}</p></article></body>") for i in range(6)]
    got = texts(spark, rows)
    assert [got[i][1] for i in range(6)] == [f"Head {i} The social history of Rome {i} Take care {i} Boards {i} End {i}" for i in range(6)]


def test_place_in_the_wrapper_decides():
    """Two elements of one symbol, apart: the wrapper's order tells which is the article."""
    pages = [f"<body><div>Menu {'x' * (i % 3)}</div><h2>Title {i}</h2><div>{f'Long text of page {i}. ' * 20}</div></body>" for i in range(6)]
    w = None
    for x in pages:
        own = h.wrapper_of(h.parse(x))
        w = h.merged(w, own) if w else own
    assert h.pattern(w["k"][0]) == "<body><div>#text</div> <h2>#text</h2> <div>#text</div></body>"
    assert h.main_text(pages[4], h.decided(w)) == ("Long text of page 4. " * 20).strip()
    assert h.main_text(pages[4].replace("<h2>", "<h3>new</h3><h2>"), h.decided(w)) == ("Long text of page 4. " * 20).strip()


def test_constants_equal_plain_counting(spark):
    rng = random.Random(2)
    rows = [(i, f"https://h{i % 3}.example.org/", "".join(f"<p>t{k}</p>" for k in range(12) if rng.random() < (1.0, 0.95, 0.88, 0.5)[k % 4])) for i in range(120)]
    got = {r.host: set(r.constants) for r in h.template_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(3):
        pages = {tuple(re.findall(r"t\d+", x)) for i, _, x in rows if i % 3 == k}
        assert got.get(f"h{k}.example.org", set()) == {h.name_of(t) for t in {t for x in pages for t in x} if sum(t in x for x in pages) >= max(5, 0.9 * len(pages))}


def test_article_text_that_repeats_over_a_host_stays(spark):
    """Headings, by-lines and table heads of articles, as few or as many pages of them as there are."""
    dish = "<body><article><h1>Dish {i}</h1><h2>Ingredients</h2><p>Take {i} eggs.</p><h2>Method</h2><p>Beat {i} times.</p><p>By Ann Smith</p></article><p>Call us</p></body>"
    goods = "<body><p>Our shop</p><div class='content'><table><tr><th>Price</th><th>Colour</th></tr><tr><td>{i}</td><td>red</td></tr></table><div class='x'>Ask for it</div></div></body>"
    same = "<body><p>Page {i}</p><main><p>Closed on Monday</p></main></body>"
    teaser = "<body><article class='teaser'>Teaser {i}</article><main><h1>Real {i}</h1><p>The text that the page is about, number {i}.</p></main></body>"
    rows, wanted = [], {}
    for n in (1, 4, 5, 50):
        for k, (form, text) in enumerate([(dish, "Dish {i} Ingredients Take {i} eggs. Method Beat {i} times. By Ann Smith"), (goods, "Price Colour {i} red Ask for it"), (same, "Closed on Monday"), (teaser, "Real {i} The text that the page is about, number {i}.")]):
            for i in range(n):
                page = n * 1000 + k * 100 + i
                rows.append((page, f"https://n{n}k{k}.example.org/{i}", form.format(i=i)))
                wanted[page] = text.format(i=i)
    got = texts(spark, rows)
    assert {k: v[1] for k, v in got.items()} == wanted


def test_articles_and_furniture_at_any_depth():
    for depth in (3, 10, 58, 59, 60, 61, 70, 500):
        for inner, text in [
            ("<article>Body</article><div>junk of the page</div>", "Body"), ("<main>Body <nav>menu</nav></main><div>junk</div>", "Body"), ("<div class='post-content'>Body<div class='ad-slot'>Buy</div> and more</div><p>junk</p>", "Body and more"),
            ("<main><p>One</p><article>Body text of it</article></main><p>x</p>", "Body text of it"), ("<nav>menu</nav><article><div><aside>see</aside>Body</div></article>", "Body"), ("<article>" * 90 + "<content>Body" + "</article>" * 90, "Body"),
        ]:
            source = "<html><body>" + "<div>" * depth + inner + "</div>" * depth + "</body></html>"
            assert h.main_text(source, h.decided(h.wrapper_of(h.parse(source)))) == text, (depth, inner)


def test_an_anchor_is_a_constant_only_at_its_place(spark):
    """On pages without marks: what all pages say at one place goes, what they say here and there stays."""
    rows, places = [], ["section", "blockquote", "figure"]
    for i in range(40):
        body = "".join(f"<{x}><p>Words {i} of {x}</p>{'<h2>In short</h2>' * (i % 3 == k)}<p>More {i}</p></{x}>" for k, x in enumerate(places))
        rows.append((i, f"https://places.example.org/{i}", f"<body><h6>Welcome</h6>{body}<h6>Call us</h6></body>"))
    got = texts(spark, rows)
    for i in range(40):
        assert got[i][1] == " ".join(f"Words {i} of {x} {'In short ' * (i % 3 == k)}More {i}" for k, x in enumerate(places)), i


def grammar(w):
    """A wrapper as a regular expression over plain tags."""
    inner = "".join(map(grammar, w["k"]))
    body = "#" if w["l"] == "#" else inner if w["l"][0] == "(" else f"<{w['l']}>{inner}</{w['l']}>"
    return f"(?:{body}){w['q'].replace('1', '')}"


def stream(e):
    return f"<{e.symbol}>" + "".join("#" if isinstance(x, list) else stream(x) for x in h.pieces(e) if x is not h.BREAK) + f"</{e.symbol}>"


def test_wrappers_accept_all_their_pages():
    """Against matching by brute force: whatever the order of merging, each page is a word of the wrapper's expression."""
    rng = random.Random(5)

    def body(depth):
        return "".join(f"<{t}>{body(depth - 1) if t == 'div' and depth else 'x'}</{t}>" for t in rng.choices(["div", "h2", "p", "ul"], k=rng.randrange(5)))

    for _ in range(150):
        pages = [h.parse(f"<body>{body(2)}</body>") for _ in range(rng.randrange(1, 7))]
        own = [h.wrapper_of(p) for p in pages]
        while len(own) > 1:
            a, b = own.pop(rng.randrange(len(own))), own.pop(rng.randrange(len(own)))
            own.append(h.merged(a, b))
        expression = re.compile(grammar(own[0]))
        assert all(expression.fullmatch(stream(p)) for p in pages)
