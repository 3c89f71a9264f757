import html
import re
import time
import tracemalloc

from hypothesis import given, settings
from hypothesis import strategies as st

from helmwatch.llm import html_extract as h


def brute(page):
    """The article of a generated page, by its literal tags."""
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"<(?:p|/p|br|h1|/h1)>", body))
    return "\n".join(b for b in blocks if b)


def test_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").limit(800)
    want = {r["page_id"]: brute(r["html"]) for r in pages.collect()}
    got = h.extract_pages(pages).collect()
    assert len(got) == len(want)
    assert all(r["text"] == want[r["page_id"]] for r in got)


def test_boilerplate_by_name_and_mark():
    page = (
        "<html><body><header>top</header><nav>menu</nav><main><h1>Title</h1><p>One &lt;two&gt;\n three<p>Four <i>five</i>"
        '<aside>side</aside><div class="comment-list">said</div><form>name</form><script>x="</p>"</script><!-- <p>no -->'
        '<div class=ad>buy</div><ul><li>a<li>b</ul></main><div id="cookie notice">ok?</div><footer>end</footer>'
    )
    assert h.extract(page) == "Title\nOne <two> three\nFour five\na\nb"


def test_wrapper_drops_constant_nodes_of_pages_without_articles(spark):
    page = '<body><div class="x">Welcome to our site</div><div class="y"><p>{}</p></div><div class="z"><a href="/">home</a> <a href="/b">more {}</a></div></body>'
    rows = [(i, "http://h.example/%d" % i, page.format(f"text number {i}", i)) for i in range(6)]
    rows += [(10, None, None), (11, None, ""), (11, "//other", "plain < text"), (12, "http://H.example:80/x", page.format("upper", 1))]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", h.F.lit("clash"))
    got = {(r["page_id"], r["url"]): r["text"] for r in h.extract_pages(table).collect()}
    assert got[0, "http://h.example/0"] == "text number 0" and got[12, "http://H.example:80/x"] == "upper"
    assert got[10, None] == "" and got[11, "//other"] == "plain < text"
    assert h.extract_pages(table.where("false")).count() == 0


def test_constant_lists_of_like_elements_are_template(spark):
    """A notice of two paragraphs, the same on all pages, goes without article or telling name; removing the wrapper
    brings it back."""
    page = '<body><div class="k"><p>All rights are ours.</p><p>Do not copy.</p></div><div class="y"><p>{0}</p><p>and more of {0}</p></div></body>'
    rows = [(i, "http://h.example/%d" % i, page.format(f"text {i}")) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in h.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text {i}\nand more of text {i}" for i in range(8)}
    assert h.extract(rows[0][2]).startswith("All rights are ours.")


def test_headers_inside_articles_go():
    assert h.extract("<article><header><h1>Title</h1></header><p>Body</p></article>") == "Body"


def test_text_outside_articles_stays():
    assert h.extract("<div><p>The long main text.</p></div><article><p>teaser</p></article>") == "The long main text.\nteaser"


def test_formulas_objects_and_void_elements_stay_in_their_block():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be a long<wbr>word<img src=a> here.<select><option>no</select><object>shown</object></p></article>"
    assert h.extract(page) == "Let x=1 be a longword here.shown"


def test_quotes_count_only_as_values():
    assert h.extract("<p it's>one</p><p title='a > b'>two</p><p title=\"open>three</p>") == "one\ntwo\nthree"


def rules_of(pages):
    whole = h.page_tree(pages[0])
    for p in pages[1:]:
        whole = h.merge(whole, h.page_tree(p))
    return frozenset(h.wrapper_rules(whole))


def test_wrapper_decides_on_generated_pages_without_names(spark):
    """With the list of names off, what the wrapper learns changes every page: its link list goes, the article stays."""
    rows = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("url like '%//blog.tionsh.example.net/%'").collect()]
    assert len(rows) >= 10
    rules = rules_of(rows)
    for page in rows:
        menu = [html.unescape(x) for x in re.findall(r'<a href="[^"]*">([^<]*)</a>', page)]
        plain, cut = (h.extract(page, r, named=False).split("\n") for r in (frozenset(), rules))
        assert plain[: len(menu)] == menu and cut == plain[len(menu) :]
        assert brute(page) in "\n".join(cut)


def test_equal_pages_of_a_host_keep_their_text():
    page = '<body><div class="a"><p>the same text</p></div><div class="b">on every page</div></body>'
    assert h.extract(page, rules_of([page] * 20)) == "the same text\non every page"


def test_few_copies_among_many_pages_keep_their_text():
    pages = [f'<body><div class="x{chr(97 + i)}">text {i}</div></body>' for i in range(20)] + ['<body><div class="copy">said thrice</div></body>'] * 3
    rules = rules_of(pages)
    assert [h.extract(p, rules) for p in pages] == [f"text {i}" for i in range(20)] + ["said thrice"] * 3


def test_long_menus_do_not_take_short_texts_with_them():
    pages = ["<body><div class=m>" + "".join(f"<a href=/{k}>entry number {k}</a> " for k in range(50)) + f"</div><div class=t>text {i}</div></body>" for i in range(5)]
    rules = rules_of(pages)
    assert [h.extract(p, rules) for p in pages] == [f"text {i}" for i in range(5)]


def test_limits_are_parameters(spark):
    page = "<body><div class=k>Our motto.</div><div class=t>text {}</div></body>"
    table = spark.createDataFrame([(i, "http://a/", page.format(i)) for i in range(2)], "page_id long, url string, html string")
    assert {r["text"] for r in h.extract_pages(table).collect()} == {"Our motto.\ntext 0", "Our motto.\ntext 1"}
    assert {r["text"] for r in h.extract_pages(table, limits=h.Limits(min_pages=2)).collect()} == {"text 0", "text 1"}


def test_many_mixed_pages_of_a_host_merge_fast():
    began, whole = time.perf_counter(), None
    for i in range(300):
        tree = h.page_tree("<body>" + "".join(f'<div class="b{chr(97 + i % 26)}{"x" * (i // 26)}{"abcdefghij"[k]}"><p>text {i} {k}</p></div>' for k in range(10)) + "</body>")
        whole = tree if whole is None else h.merge(whole, tree)
    assert time.perf_counter() - began < 15 and whole[h.PAGES] == 300


def tree(keys):
    return [1, 0, 0, 0, {k: [1, 1, 0, 1, {}] for k in keys}]


def counts(node):
    return [(k, c[h.PAGES]) for k, c in node[h.CHILDREN].items()]


def test_matching_aligns_in_order():
    assert counts(h.merge(tree("pqr"), tree("pxr"))) == [("p", 2), ("q", 1), ("x", 1), ("r", 2)]
    # q and r stand in order on both sides, p does not: one slot, but one page's support.
    assert counts(h.merge(tree("pqr"), tree("qrp"))) == [("p", 1), ("q", 2), ("r", 2)]


def largest_top(a, b):
    """Simple tree matching by its definition: a table over all pairs of children."""
    xs, ys = list(a[h.CHILDREN].items()), list(b[h.CHILDREN].items())
    table = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, (k, x) in enumerate(xs, 1):
        for j, (m, y) in enumerate(ys, 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + (largest_top(x, y) if k == m else 0))
    return 1 + table[-1][-1]


TREES = st.recursive(st.just({}), lambda below: st.dictionaries(st.sampled_from("abcdef"), below, max_size=6), max_leaves=25)


def as_node(children):
    return [1, 0, 0, 0, {k: as_node(c) for k, c in children.items()}]


@settings(max_examples=200, deadline=None)
@given(TREES, TREES, st.randoms())
def test_matching_is_the_largest_common_top(a, b, random):
    b = dict(random.sample(list(b.items()), len(b)))
    assert h.match(as_node(a), as_node(b), {}) == largest_top(as_node(a), as_node(b))


def test_deep_and_long_pages():
    deep = h.page_tree("<div>" * 3000 + "x")
    assert h.merge(deep, deep)[h.PAGES] == 2 and h.wrapper_rules(deep) == []
    assert h.extract("<div>" * 3000 + "x") == "x"
    assert h.extract("<p>" + "word " * 200_000).count("word") == 200_000


def test_hard_pages_take_linear_time_and_memory():
    pages = {
        "deep": "<div>" * 100_000 + "x",
        "raw elements left open": "<title>" * 20_000 + "x",
        "tags left open": "<a " * 20_000 + '"',
        "closed but never opened": "<div>" * 50_000 + "</i>" * 50_000 + "x",
        "siblings that all differ": "".join(f'<div class="{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}">x</div>' for i in range(3000)),
    }
    for name, page in pages.items():
        began = time.perf_counter()
        tracemalloc.start()
        h.merge(h.page_tree(page), h.page_tree(page))
        assert h.extract(page, frozenset(["-"])).endswith("" if name == "tags left open" else "x")
        assert tracemalloc.get_traced_memory()[1] < 200 << 20, name
        tracemalloc.stop()
        assert time.perf_counter() - began < 30, name
