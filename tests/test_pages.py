from sparkloom.kernel.html import article, group_edits, groups, public_link, render, rewrite_css, undo

PAGE = """<html><head><title>AI doom &amp; more</title><style>p{}</style></head><body><nav><a href="/x">kill switch</a></nav><article><h1>An Existential Risk For All</h1>
<p>The <b>model</b> is <i>misaligned</i>.<p>He said <q>rogue AI</q> once. <code>rogue AI</code> rogue AI<script>rogue AI</script><div hidden>rogue AI</div>
<ul><li>doomers<li>plain</ul><blockquote>doomers</blockquote><img src="/a.png" onerror="x"><a href="javascript:x">y</a></article></body></html>"""


def test_groups_and_edits():
    found = [(g.text.strip(), [(e.original, e.text) for e in group_edits(g)]) for g in groups(PAGE)]
    assert ("The model is misaligned.", [("is misaligned", "has a bug")]) in found
    assert ("An Existential Risk For All", [("An Existential Risk", "A Product Risk")]) in found
    assert ("doomers", [("doomers", "worriers")]) in found and sum(t == "doomers" for t, _ in found) == 1
    prose = next(x for x in found if x[0].startswith("He said"))
    assert prose[1] == [("rogue AI", "malfunctioning AI")]
    assert not any("script" in t for t, _ in found)


def test_render_and_undo():
    html, title, changed = render(PAGE, "https://e.com/p/")
    assert title == "AI bugs & more" and changed == 5
    assert "onerror" not in html and "javascript:" not in html and "<script" not in html and 'src="https://e.com/a.png"' in html
    assert html.count("data-was") == changed
    back = undo(html)
    assert "data-was" not in back and "is misaligned" in back


def test_hostile_nesting():
    import time

    start = time.time()
    render("<b>" * 15_000 + "rogue AI", "http://e.com")
    render("<picture>" + "<img src=a>" * 10_000 + "</picture>", "http://e.com")
    assert time.time() - start < 5


def test_article_links_and_css():
    blocks = article(PAGE)
    assert ("quote", "doomers") in blocks and ("heading", "An Existential Risk For All") in blocks and ("item", "plain") in blocks
    assert not any("kill switch" in t for _, t in blocks)
    assert public_link("/a", "http://e.com/b") == "http://e.com/a" and public_link("ftp://x/y", "http://e.com") is None and public_link("http://u:p@e.com", "http://e.com") is None
    assert rewrite_css("a{background:url( '/x.png' )} b{fill:url(#g)}", "http://e.com") == 'a{background:url("http://e.com/x.png")} b{fill:url(#g)}'


def test_images_of_sets():
    from sparkloom.kernel.resources import best_candidate, candidates, image_source, resource_url

    assert list(candidates("a.jpg 1x, b,c.jpg 2x,d.jpg")) == [("a.jpg", "1x"), ("b,c.jpg", "2x"), ("d.jpg", "")]
    assert best_candidate("s.jpg 320w, m.jpg 800w, l.jpg 2000w") == "m.jpg"
    assert best_candidate("l.jpg 2000w, xl.jpg 4000w") == "l.jpg"
    assert best_candidate("b.jpg 2x", "own.jpg") == "own.jpg" and best_candidate("a.jpg, b.jpg 2x", "own.jpg") == "a.jpg"
    assert best_candidate("x.jpg 5q") is None and best_candidate("") is None
    assert image_source({"src": "data:image/gif;base64,AA", "data-src": "late.jpg"}) == "late.jpg"
    assert image_source({"src": "a.jpg", "data-src": "late.jpg"}) == "a.jpg" and image_source({"src": "a.jpg"}, "p.jpg") == "p.jpg"
    assert image_source({"srcset": "data:x 1x", "data-srcset": "l.jpg 1x"}) == "l.jpg"
    assert resource_url("#a", "http://e.com") == "#a" and resource_url("javascript:1", "http://e.com") == "" and resource_url("http://u:p@e.com/", "http://e.com") == ""
    assert resource_url("/a b.png?x=1", "https://e.com/p") == "/api/image?asset=1&url=https%3A%2F%2Fe.com%2Fa%20b.png%3Fx%3D1"


def test_renderings_choose_images_and_leave_popups_out():
    from sparkloom.kernel.html import proxied_css, render

    page = '<body><div role="dialog"><p>Sign up</p></div><dialog><article>story</article></dialog><div x-cloak><p>%s</p></div><picture><source media="print" srcset="no.jpg"><source srcset="yes.jpg"><img src="own.jpg"></picture><main>x</main></body>' % ("long text " * 50)
    out = render(page, "https://e.com/")[0]
    assert "Sign up" not in out and "story" in out and "long text" in out
    assert 'src="https://e.com/yes.jpg"' in out and "no.jpg" not in out and "<source" not in out
    assert proxied_css("@import 'a.css'; p{background:url(b.png)}</style>", "https://e.com/") == '@import "/api/image?asset=1&url=https%3A%2F%2Fe.com%2Fa.css"; p{background:url("/api/image?asset=1&url=https%3A%2F%2Fe.com%2Fb.png")}\\3c /style>'


def test_nested_popups_and_many_images_take_little_time():
    import time

    from sparkloom.kernel.html import render

    start = time.time()
    render("<dialog>" * 5000 + "x" + "</dialog>" * 5000 + "<p>" + "y" * 100 + "</p>", "https://e.com/")
    render("<picture>" + '<source srcset="a.jpg"><img src="b.jpg">' * 10_000 + "</picture>", "https://e.com/")
    render("<b>" * 15_000 + "rogue AI" + "</b>" * 15_000, "https://e.com/")
    assert time.time() - start < 5
