"""HTML extraction, and the pipeline against its stages by brute force."""

import html
import json
import re

import corpus_pipeline
from lodestone.llm import html_extract, jaccard_join, quality_rules, secrets
from lodestone.llm.html_extract import Page, expression, merge_wrappers, tidy, wrapper_rule


def plain_article(source):
    inside = re.search("<article>(.*?)</article>", source, re.S)[1]
    spaced = re.sub(r"<(/?)(\w+)[^>]*>", lambda m: "" if m[2] == "b" else " ", inside)
    return " ".join(html.unescape(spaced).split())


def test_pages_equal_a_plain_reading(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract_pages(pages).collect()}
    for r in pages.collect():
        want = plain_article(r.html)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_boilerplate_and_broken_html():
    page = """<html><head><title>no</title></head><body><header><h1>Site</h1></header><div class="top-nav">Home</div><div role="search">s</div>
      <main><header><h2>Title</h2></header><p>one &amp; two<br>three&nbsp;&lt;b&gt;<p>fo<b>ur</b>th <!-- x > y --> <script>if (a < b) "</p>"</script>
      <div class="ad-slot">buy</div><aside>side</aside><table><tr><td>c1<td>c2</table><form>f<input></form><section id="comments"><p>nope</section><ul><li>i1<li>i2</ul></main><footer>foot</footer>"""
    assert Page(page).main_text(None) == "Title one & two three <b> fourth c1 c2 i1 i2"
    for odd in (None, "", "just text", "<", "<p", "<!-- open", "<script>x", "</div></p>", "<article>", "<p class='a", "<div>" * 3000 + "deep"):
        Page(odd).main_text(None)
        expression(tidy(Page(odd).root))
    assert Page("just &eacute; text").main_text(None) == "just é text"
    assert Page("<div>" * 3000 + "deep").main_text(None) == "deep"


def test_wrapper_is_union_free_and_finds_the_region():
    def page(i, extra):
        items = "".join(f"<p>text {i} {k} {'x' * 50 * (i + k)}</p>" for k in range(1 + i % 3))
        return f"<body><div class=logo>Brand</div><div class=box>{extra}<div class=body>{items}</div></div><div class=legal>All rights</div></body>"

    trees = [tidy(Page(page(i, "<h4>note</h4>" if i % 2 else "")).root).pack() for i in range(8)]
    wrapper = merge_wrappers(trees)
    assert expression(wrapper) == '<#page><body><div.logo>"</><div.box>(<h4>"</>)?<div.body>(<p>#</>)+</></><div.legal>"</></></>'
    rule = wrapper_rule(wrapper)
    assert rule["main"] == ["body", "div.box", "div.body"]
    assert Page(page(1, "")).main_text(rule).startswith("text 1 0") and "rights" not in Page(page(1, "")).main_text(rule)
    a, b = merge_wrappers(trees[:4]), merge_wrappers(trees[4:])
    assert expression(merge_wrappers([a.pack(), b.pack()])) == expression(wrapper)


def test_class_names_take_no_text_that_they_might_not_mean():
    kept = '<article><p>Study of <div class="social science">social groups</div> and <div class="share-price">share prices</div><div class="notice-of-law">kept?</div> end'
    assert Page(kept).main_text(None) == "Study of social groups and share prices kept? end"
    gone = '<article><p>a<div class="share-buttons">x</div><div class="ad">x</div><div id="acme-sidebar">x</div><div class="cookie-xyz">x</div><section class="comments-area">x</section> b'
    assert Page(gone).main_text(None) == "a b"


def test_a_spoilt_wrapper_changes_texts(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    spoilt = {"main": ["html", "body", "footer"], "semantic": False, "fixed": ["#page", "", []]}
    nav = {"main": ["html", "body"], "semantic": False, "fixed": ["#page", "", []]}
    assert all(Page(p.html).main_text(spoilt) == plain_article(p.html) for p in pages)  # a region that they lack
    stories = [f"<body><div class=text><h1>{w}</h1><p>{w * 70}</p></div><div class=legal>All rights {w}</div></body>" for w in "abcdefgh"]
    assert all("All rights" not in Page(p).main_text(rule_of(stories)) and "All rights" in Page(p).main_text(nav) for p in stories)


def rule_of(sources):
    return wrapper_rule(merge_wrappers([tidy(Page(s).root).pack() for s in sources]))


def test_copies_lose_no_text():
    for copy in ("<body><p>text</p></body>", "<body><h1>Head</h1><div class=box><p>one</p><h2>two</h2></div></body>"):
        assert Page(copy).main_text(rule_of([copy] * 8)) == Page(copy).main_text(None)
    copies = [f"<body><div><h3>Head</h3><p>{'long ' * 40}</p><p>number {i}</p></div></body>" for i in range(8)]
    others = [f"<body><div><h1>{w}</h1><p>{w * 90}</p></div></body>" for w in "abcdefgh"]
    assert "Head" in Page(copies[0]).main_text(rule_of(copies + others))


def test_fixed_texts_are_known_by_their_place():
    pages = [f"<body><div><p>By us</p><h2>{w} title</h2><p>{w * 60}</p></div></body>" for w in "abcdefgh"]
    rule = rule_of(pages)
    assert [Page(p).main_text(rule) for p in pages] == [f"{w} title {w * 60}" for w in "abcdefgh"]
    assert Page("<body><div><p>Other</p><h2>t</h2><p>By us</p></div></body>").main_text(rule) == "Other t By us"


def test_the_wrapper_decides_for_pages_with_semantic_elements(spark, small):
    stories = [f"<html><body><article><h1>{w} head</h1><div>Written for you</div><p>{w * 70}</p></article><div>also {w}</div></body></html>" for w in "abcdefgh"]
    rule = rule_of(stories)
    assert rule["main"] == ["html", "body", "article"]
    assert [Page(p).main_text(rule) for p in stories] == [f"{w} head {w * 70}" for w in "abcdefgh"]
    teasers = [f"<body><article>Read our offer</article><div class=text><h1>{w}</h1><p>{w * 70}</p></div></body>" for w in "abcdefgh"]
    rule = rule_of(teasers)
    assert rule["main"] == ["body", "div.text"]
    assert [Page(p).main_text(rule) for p in teasers] == [f"{w} {w * 70}" for w in "abcdefgh"]
    for w in html_extract.wrappers(spark.read.parquet(f"{small}/pages.parquet")).collect():
        assert wrapper_rule(html_extract.Node.unpack(json.loads(w.tree)))["main"] == ["html", "body", "article"]


def test_no_page_is_left_out_of_a_large_wrapper(monkeypatch):
    monkeypatch.setattr(html_extract, "MAX_NODES", 24)
    long = [f"<body><div><h5>Our notice</h5><p>{w * 50}</p>{''.join(f'<h{k % 2 + 2}>{w}{k}</h{k % 2 + 2}>' for k in range(16))}</div></body>" for w in "abc"]
    other = [f"<body><div><h5>Our notice</h5><p>{w * 50}</p>{f'<u{w}>{w}</u{w}>' * 12}</div></body>" for w in "defghijk"]
    trees = [tidy(Page(p).root).pack() for p in long + other]
    wrapper = merge_wrappers(trees)
    assert wrapper.pages == len(trees) and wrapper.size() <= 24
    chars = lambda n: n.chars + sum(map(chars, n.kids))
    assert chars(wrapper) == sum(chars(html_extract.Node.unpack(t)) for t in trees)
    assert merge_wrappers(trees[::-1]).pack() == wrapper.pack()
    rule = wrapper_rule(wrapper)
    for p in long + other:
        assert Page(p).main_text(rule) == Page(p).main_text(None).replace("Our notice ", "")


def test_pages_edge_cases(spark):
    rows = [(1, None, None, 1), (2, "https://a.b/", "", 2), (2, "https://a.b/", "", 2), (None, "x", "<p>hi</p>", 3), (4, "https://a.b/", "<p>one</p>two", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = sorted(((r.page_id or 0), r.url or "", r.text, r.n_chars) for r in html_extract.extract_pages(df).collect())
    assert got == [(0, "x", "hi", 2), (1, "", "", 0), (2, "https://a.b/", "", 0), (2, "https://a.b/", "", 0), (4, "https://a.b/", "one two", 7)]
    assert html_extract.extract_pages(df.limit(0)).collect() == []


def test_pipeline(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "secret_scans", "best_fit_packing"]
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, tiny)
        assert left.columns == docs.columns
        left = spark.createDataFrame(left.collect(), left.schema)
    packed = {r.doc_id for r in corpus_pipeline.run(spark, tiny).collect()}
    good = {r.doc_id for r in quality_rules.quality_report(docs).where("kept").collect()}
    one = {r.doc_id for r in jaccard_join.near_copies(docs.where(docs.doc_id.isin(list(good)))).where("kept").collect()}
    assert packed == one == {r.doc_id for r in left.collect()}
    assert not any(secrets.base_spans(r.text) for r in left.collect())
