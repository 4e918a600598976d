import random

from pyspark.sql import functions as F

from lienwise.llm import wrapper

from .conftest import prose

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a = "</p><p>no";</script></head>
<body><header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav><!-- <p>hidden</p> --><div class="ad big">Buy</div>
<main><h1>Head&eacute;r  &lt;b&gt;</h1><p>One <b>bold</b>
two<br>three<p>Unclosed <i>tag<div class="comments"><p>reader says</div><form><input>Send</form><aside>side</aside>{body}</main><footer>&copy;</footer></body>"""


def blocks(page):
    found = wrapper.parse(page)[1]
    only = any(inside and not declared for _, declared, inside, _ in found)
    return [text for _, declared, inside, text in found if not declared and (inside or not only)]


def test_article_blocks():
    assert blocks(PAGE.replace("{body}", "<ul><li>a<li>b</ul><pre> x  y </pre>")) == ["Headér <b>", "One bold two three", "Unclosed tag", "a", "b", "x y"]


def test_odd_pages():
    assert blocks("") == [] and blocks("plain & simple") == ["plain & simple"]
    assert blocks("<p>a</p></div></p>b<unclosed") == ["a", "b<unclosed"] or blocks("<p>a</p></div></p>b<unclosed")[0] == "a"
    assert blocks("<div>x < y <p hidden>no</p><p style='display: none'>no</p>&#120;&nbsp;z</div>") == ["x < y", "x z"]
    assert blocks("<article class=comment><p>no</p></article><article><header><h1>Title</h1></header><p>yes</p></article>") == ["Title", "yes"]
    assert blocks("<script>never closed <p>x</p>") == []
    assert len(blocks("<div>" * 3000 + "deep" + "</div>" * 3000)) == 1


def test_alignment_by_simple_tree_matching():
    a = wrapper.parse("<body><div class=x><p>1</p></div><section><p>2</p></section></body>")[0]
    b = wrapper.parse("<body><section><p>2</p></section><div class=x><h2>t</h2><p>1</p></div><section><p>3</p></section></body>")[0]
    pairs = wrapper.align(a, b)
    labels = lambda s: ["#", *(x.partition(":")[2] for x in s.split(" "))]
    assert all(j < 0 or labels(a)[i] == labels(b)[j] for i, j in enumerate(pairs))
    assert sum(j >= 0 for j in pairs) == 6


def test_names_are_read_attribute_by_attribute():
    for marks in ('class="article-header"', 'class="entry-header"', 'id="search-for-life"', 'class="film reviews"', 'title="the hidden truth"', 'data-id="login-search"', 'data-note="display:none"'):
        assert blocks(f"<article><div {marks}><h1>Headline</h1></div><p>Text</p></article>") == ["Headline", "Text"], marks
    for marks in ("class=ad-slot", 'class="x comments-area"', "id=site-sidebar", "role=navigation", "hidden", "aria-hidden=true", "style='color:red;display: none'"):
        assert blocks(f"<body><div {marks}><p>no</p></div><p>Text</p></body>") == ["Text"], marks


def test_names_that_are_not_whole_and_articles_of_any_name():
    for page in (
        '<body><div class="content has-sidebar"><p>Text</p></div></body>',
        '<div class="no-sidebar"><p>Text</p></div>',
        '<article class="post related"><p>Text</p></article>',
        '<article id="ad-hoc"><p>Text</p></article>',
        '<div class="menu"><article><p>Text</p></article><p>no</p></div>',
        '<div class="menu"><div class="menu-list"><article class="comment-free"><p>Text</p></article></div></div>',
        '<main class="menu"><p>Text</p></main>',
    ):
        assert blocks(page) == ["Text"], page
    assert blocks('<article><p class="share-price">Up</p><p>Text</p></article>') == ["Up", "Text"]
    for marks in ("user-comments-list", "commentlist", "replies", "site-footer", "footer-links", "header", "site-header", "sidebar_left", "ad ad-slot-top"):
        assert blocks(f'<div class="{marks}"><p>no</p></div><p>Text</p>') == ["Text"], marks
    assert [d for _, d, _, _ in wrapper.parse('<section id="menu"><p>a</p></section><div class="ads">b</div><p>c</p>')[1]] == [wrapper.DOUBTFUL, wrapper.SURE, wrapper.FREE]


def test_the_wrapper_judges_doubtful_names(spark):
    """A slot that varies is content under a doubtful name, a constant one is not, and a page alone keeps what else would leave nothing."""
    page = "<body><div class=menu><p>{}</p></div><section class=notice><p>{}</p></section><div class=x><p>{}</p></div></body>"
    rows = [(i, f"http://a.example/{i}", page.format("Home and more", prose(i, 15), prose(50 + i, 15))) for i in range(8)]
    rows += [(100, "http://b.example/", page.format("Home", "Notice", "Text")), (101, "http://c.example/", "<section id=menu><p>Soup</p><p>Cake</p></section>"), (102, "http://d.example/", "<div class=ads><p>Buy</p></div>")]
    rows += [(200 + i, f"http://e.example/{i}", f"<body><div class=menu><p>{prose(i, 15)}</p></div><div class=footer>Same</div></body>") for i in range(5)]
    got = texts(wrapper.extract(pages(spark, rows)))
    assert all(got[i] == prose(i, 15) + "\n" + prose(50 + i, 15) for i in range(8))
    assert (got[100], got[101], got[102]) == ("Text", "Soup\nCake", "")
    assert all(got[200 + i] == prose(i, 15) for i in range(5))


def test_markup_that_declares_nothing_is_judged_by_the_wrapper(spark):
    """Pages with their tags made opaque (adverts, which vary, keep their name): where a host is large enough for its many menus to come back, the wrapper alone finds what the tags said, and nothing else does."""
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    told = wrapper.extract(df).select("page_id", F.col("text").alias("told"))
    mute = df.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<(article|nav|footer|aside|header|main)\\b", "<div class=k$1x"), "</(article|nav|footer|aside|header|main)>", "</div>"))
    by_wrapper = wrapper.extract(mute).select("page_id", F.col("text").alias("found"))
    by_none = wrapper.extract(mute, share=2.0).select("page_id", F.col("text").alias("all"))
    same = F.col("told") == F.col("found")
    large = df.groupBy(F.regexp_extract("url", "//([^/]*)", 1).alias("host")).agg(F.count("*").alias("n"), F.collect_list("page_id").alias("ids")).where("n >= 120").select(F.explode("ids").alias("page_id"))
    got = told.join(by_wrapper, "page_id").join(by_none, "page_id").join(large, "page_id").agg(F.count("*"), F.avg(same.cast("int")), F.avg((F.col("told") == F.col("all")).cast("int"))).first()
    assert got[0] > 400 and got[1] > 0.99 and got[2] < 0.01


def test_alignment_of_deep_and_wide_trees():
    deep = wrapper.parse("<div>" * 4000 + "x")[0]
    other = wrapper.parse("<div>" * 3999 + "<p>x")[0]
    pairs = wrapper.align(deep, other)
    assert pairs[:4000] == list(range(4000)) and pairs[4000] == -1
    for n in (300, 1500):
        wide = wrapper.parse("<body>" + "<p>a</p><ul><li>b</li></ul>" * n)[0]
        less = wrapper.parse("<body>" + "<p>a</p><ul><li>b</li></ul>" * (n - 10))[0]
        assert sum(j >= 0 for j in wrapper.align(wide, less)) == len(less.split(" ")) + 1


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, host string").repartition(3)


def texts(df):
    return {r["page_id"]: r["text"] for r in df.collect()}


def test_constant_nodes_are_template_at_any_size_of_host(spark):
    page = "<body><div><p>Read on</p></div><section class=x><p>{}</p><p>{}</p></section><div class=foot>{}</div></body>"
    rows = [(100 * n + i, f"http://h{n}.example/{i}", page.format(prose(100 * n + i, 12), "Read on" if i == 2 else prose(i, 9), ("One of two notices", "Two of two notices")[i % 2] if n == 12 else "Same")) for n in (4, 7, 12) for i in range(n)]
    got = wrapper.extract(pages(spark, rows))
    for i, text in texts(got).items():
        n, k = divmod(i, 100)
        assert text == prose(i, 12) + "\n" + ("Read on" if k == 2 else prose(k, 9)), i
    assert {(r["n_template"], r["n_declared"]) for r in got.collect()} == {(2, 0)}


def test_copies_of_an_article_are_one_content(spark):
    base = [prose(7, 60).split(), prose(8, 60).split()]
    rows = []
    for i in range(30):  # near copies, and other articles of the host
        first, second = (list(x) for x in base) if i % 2 else (prose(50 + i, 60).split(), prose(90 + i, 60).split())
        first[i] = second[59 - i] = f"edit{i}"
        rows.append((i, f"http://n.example/{i}", f"<body><ul><li>Menu one</li><li>Menu two</li></ul><div class=t><h1>{' '.join(second[:6])}</h1><p>{' '.join(first)}</p><p>{' '.join(second)}</p></div></body>"))
    for i, text in texts(wrapper.extract(pages(spark, rows))).items():
        assert text.count("\n") == 2 and "Menu" not in text and f"edit{i}" in text


def test_deep_pages(spark):
    rows = [(i, "http://d.example/", "<div>" * (1500 + i % 3) + f"<p>{prose(i, 10)}") for i in range(6)]
    assert texts(wrapper.extract(pages(spark, rows))) == {i: prose(i, 10) for i in range(6)}


def test_the_wrapper_removes_most_of_what_goes_where_hosts_have_pages_to_compare(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = wrapper.extract(df).groupBy(F.col("url").contains("blog.tionsh.example.com").alias("large")).agg(F.sum("n_template").alias("t"), F.sum("n_declared").alias("d")).collect()
    count = {r["large"]: (r["t"], r["d"]) for r in got}
    assert count[True][0] > 0.8 * sum(count[True]) and count[False][0] > 1000


def test_template_goes_and_content_stays(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div><p>Welcome to the site</p></div><div class=x><p>{prose(i, 12)}</p><p>Same line</p></div></body>" if i % 4 else f"<body><div><p>Welcome to the site</p></div><div class=x><p>{prose(i, 12)}</p></div></body>", "k") for i in range(1, 21)]
    rows += [(100 + i, "http://copies.example/x", "<body><p>Welcome</p><p>The same page</p></body>", "k") for i in range(20)]
    rows += [(200, None, None, "k"), (201, "nonsense", "<p>q</p>", None), (202, "http://h.example/5", "", "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    got = {r["page_id"]: r for r in wrapper.extract(df).collect()}
    assert len(got) == len(rows)
    for i in range(1, 20):
        assert got[i]["text"] == prose(i, 12) or got[i]["text"] == prose(i, 12) + "\nSame line", i
    assert got[101]["text"] == "Welcome\nThe same page"
    assert (got[200]["text"], got[200]["n_chars"], got[202]["text"]) == ("", 0, "") and got[201]["text"] == "q"
    assert wrapper.extract(df.limit(0)).collect() == []


def test_long_lists_are_matched_as_exactly_as_short_ones(monkeypatch):
    rng = random.Random(3)
    lists = [" ".join(f"0:{rng.choice('abcde')}" for _ in range(n)) for n in (2300, 2200)]
    best = [[0] * 2201]
    for x in lists[0].split(" "):  # the length of the longest common subsequence
        row = [0]
        for j, y in enumerate(lists[1].split(" ")):
            row.append(best[-1][j] + 1 if x == y else max(best[-1][j + 1], row[-1]))
        best.append(row)
    assert sum(j >= 0 for j in wrapper.align(*lists)) == best[-1][-1] + 1
    for _ in range(100):
        trees = [" ".join(f"{rng.randrange(max(0, i - 5), i)}:{rng.choice('ab')}" for i in range(1, 25)) for _ in range(2)]
        whole = wrapper.align(*trees)
        with monkeypatch.context() as m:
            m.setattr(wrapper, "CELLS", 3)
            assert wrapper.align(*trees) == whole
