"""Main text: parser edges and template removal against a plain count."""

from tidemark.llm.html_main import main_text, parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></ul></nav><!-- ad --><div class="top ad-box">Buy</div>
<article><h1>Head &amp; more</h1><p><b>First  line<br>here<p>Second &lt;x&gt;</p><aside>side</aside><form>field</form>
<div id="comments"><p>me too</p></div></article><footer>foot</footer></body></html>"""


def texts(html):
    return [t for t, _, _ in parse(html)[0]]


def test_named_parts_go():
    assert texts(PAGE) == ["Head & more", "First line here", "Second <x>"]


def test_malformed_pages():
    assert texts(None) == texts("") == texts("<p></p>") == []
    assert texts("plain") == ["plain"] and texts("<p>a<p>b<div>c") == ["a", "b", "c"]
    assert texts('<p title="x>one</p><p>two</p>') == ["one", "two"]
    assert texts("<script>never closed <p>x") == [] and texts("a<!-- open") == ["a"] and texts("a < b") == ["a < b"]
    assert texts("<a " + " ".join(f'x{i}="v"' for i in range(200_000)) + ">hi</a>") == ["hi"]
    assert texts("<p>" + "word " * 300_000) == [("word " * 300_000).strip()]
    assert texts("<b>" * 50_000 + "deep")[0] == "deep"


def test_templates_of_a_host(spark):
    def page(i, extra=""):
        return f"<body><div><div>Welcome to our pages</div><div>text {i} of its own</div>{extra}</div></body>"

    rows = [(i, "http://Host.example/p", page(i), i) for i in range(8)] + [
        (20, "http://other.example:80/p", page(20), 0), (21, None, page(21), 0), (22, "nonsense", None, 0), (23, "http://host.example/q", "", 0),
        (None, "https://u@host.example/r", "<article><p>Welcome to our pages</p><p>Welcome to our pages</p></article>rest", 0), (20, "http://other.example:80/p", page(20), 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {}
    for r in main_text(pages).collect():
        got.setdefault(r.page_id, []).append(r)
        assert r.n_chars == len(r.text)
    assert all(got[i][0].text == f"text {i} of its own" for i in range(8))
    assert [r.text for r in got[20]] == ["Welcome to our pages\ntext 20 of its own"] * 2
    assert got[22][0].text == got[23][0].text == "" and got[21][0].text.startswith("Welcome")
    assert got[None][0].text == "Welcome to our pages\nWelcome to our pages"
    assert main_text(pages.limit(0)).count() == 0


def test_names_do_not_drop_the_text():
    body = "<h1>Head</h1><p>Some long text of this page that is the reason to read it.</p>"
    for page in (f'<div class="content has-sidebar"><article>{body}</article></div>', f'<div class="elementor-widget-text">{body}</div>',
                 f'<div id="search-results">{body}</div>', f'<form id="aspnetForm"><nav>a b</nav>{body}</form>',
                 "".join(f'<div class="widget">{part}</div>' for part in ("<p>one part of it</p>", "<p>another part</p>", "<p>third part here</p>"))):
        got = texts(f"<html><head><title>t</title><body>{page}<footer>foot</footer></body></html>")
        assert got in (["Head", "Some long text of this page that is the reason to read it."], ["one part of it", "another part", "third part here"])
    assert texts('<div class="widget">all there is</div>') == ["all there is"]


def test_recurring_parts_of_articles(spark):
    """Containers that recur go, inside articles too; an article's own paragraphs and headings stay however often they stand."""
    def page(i):
        return (f"<article><h1>Story {i}</h1><h2>Les.</h2><p>What happened on day {i} at length and in full.</p><p>Released under the MIT License.</p>"
                "<div><p>Sign up here.</p><span>now</span></div></article>")

    copies = "<article><p>One text that stands at many addresses.</p></article>"
    near = "<article><p>Near copies share this long paragraph with each other.</p><p>seen {} times</p></article>"
    rows = [(i, f"http://a/{i}", page(i)) for i in range(8)] + [(100 + i, f"http://a/c{i}", copies) for i in range(8)]
    rows += [(200 + i, f"http://a/n{i}", near.format(i)) for i in range(8)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i}\nLes.\nWhat happened on day {i} at length and in full.\nReleased under the MIT License." for i in range(8))
    assert all(got[100 + i] == "One text that stands at many addresses." for i in range(8))
    assert all(got[200 + i] == f"Near copies share this long paragraph with each other.\nseen {i} times" for i in range(8))


def test_deep_pages_take_linear_time():
    """60,000 elements that are never closed: one node each, and seconds at most."""
    import time

    for tag in ("<div>x y", "<span>x", "<ul><li>x", "<p>a<b>b", "<table><tr><td>x"):
        started = time.time()
        blocks, nodes = parse(tag * 60_000)
        assert blocks and len(nodes) <= 240_000
        assert time.time() - started < 10


def test_templates_equal_a_plain_count(spark, sf_dir):
    """Subtrees counted by plain Python over the given pages: the same templates, and the same texts."""
    from urllib.parse import urlsplit

    from tidemark.llm.html_main import left_text, page_blocks, recurring_subtrees
    from tidemark.session import table

    pages = table(spark, sf_dir, "pages")
    rows = pages.collect()
    parsed = {r.page_id: parse(r.html) for r in rows}
    hosts, seen = {}, {}
    for r in rows:
        host = (urlsplit(r.url).hostname or "") if r.url else ""
        blocks, nodes = parsed[r.page_id]
        key = (host, tuple(blocks), tuple(nodes))
        if key not in seen:
            seen[key] = True
            count, own = hosts.setdefault(host, [0, {}])
            hosts[host][0] += 1
            for d in {d for d, _, counted in nodes if counted}:
                own[d] = own.get(d, 0) + 1
    want = {(h, d) for h, (n, own) in hosts.items() for d, c in own.items() if c >= 2 and c >= 0.01 * n}
    found = recurring_subtrees(page_blocks(pages), min_pages=2)
    assert {(r.host, r.subtree) for r in found.collect()} == want
    got = {r.page_id: r.text for r in main_text(pages, min_pages=2).collect()}
    for r in rows:
        host = (urlsplit(r.url).hostname or "") if r.url else ""
        blocks, nodes = parsed[r.page_id]
        as_rows = [{"text": t, "article": a, "node": n} for t, a, n in blocks], [{"digest": d, "parent": p, "counted": c} for d, p, c in nodes]
        assert got[r.page_id] == left_text(*as_rows, {d for h, d in want if h == host})
