from pyspark.sql import functions as F

from tidewatch.llm.html_extraction import _counted, _host, article, blocks, main_text, occurrences, parsed, read

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy {0}</div>
<article><h1>Title  {0}</h1><p><b>First &amp; {0}<br>line<p>a &lt;b&gt;&nbsp;c</p><div class="comments"><p>Nice!</p></div>
<aside>Side {0}</aside><form><p>Mail</p></form><p>All rights reserved by us</p></article><footer>&copy; Site {0}</footer></body></html>"""


def text_of(page, **options):
    return "\n\n".join(article(blocks(page), options.get("root")))


def test_blocks_of_a_page():
    assert text_of(PAGE.format("x")) == "Title x\n\nFirst & x line\n\na <b> c\n\nAll rights reserved by us"


def test_broken_markup():
    assert text_of("<article><p>one<p>two</article><p>after") == "one\n\ntwo"
    assert text_of("<p>a < b and c</p><p>cut <a href=\"x") == "a < b and c\n\ncut"
    assert text_of("plain text  only") == "plain text only"
    assert text_of("<script>never closed <p>x</p>") == "" and text_of(None) == "" and text_of("<p></p>") == ""
    assert text_of("<main><ul><li>a<li>b</ul></main>") == "a\n\nb"
    assert text_of('<div class="sidebar"><p>s</p></div><div><p>long text of it</p><p>more</p></div>') == "long text of it\n\nmore"


def test_no_article_text_is_dropped(spark):
    pages = [(k, f"http://a.org/{k}", PAGE.format(f"w{k}")) for k in range(6)] + [(9, "http://b.org/", PAGE.format("z"))]
    rows = {r.page_id: r for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k in (0, 1, 5, 9):
        w = f"w{k}" if k < 9 else "z"
        assert rows[k].text == f"Title {w}\n\nFirst & {w} line\n\na <b> c\n\nAll rights reserved by us"


def test_recurring_paragraphs_stay_at_any_number_of_pages(spark):
    recipe = "<p>Serves four people</p><p>Preheat the oven to 200 degrees</p><p>Own words of number {0}</p>"
    for n in (1, 2, 4, 8):
        for page in (f"<main>{recipe}</main>", f"<body><div class=post>{recipe}</div></body>"):
            got = texts(spark, ((k, f"http://r.org/{k}", page.format(k)) for k in range(n)))
            assert got == {k: f"Serves four people\n\nPreheat the oven to 200 degrees\n\nOwn words of number {k}" for k in range(n)}, (n, page)


def test_a_menu_without_a_name_goes_from_two_pages_on(spark):
    page = "<body><div class=top><p>Home News</p></div><div class=x><p>{0}</p><p>more {1}</p></div></body>"
    for n in (2, 4, 8):
        got = texts(spark, ((k, f"http://m.org/{k}", page.format(f"word{k} " * 30, k)) for k in range(n)))
        assert got == {k: " ".join([f"word{k}"] * 30) + f"\n\nmore {k}" for k in range(n)}, n


def test_occurrence_vectors_against_brute_force(spark):
    """Tokens share their sums exactly where they share their vectors over the pages of a host."""
    pages = [(k, f"http://h{k % 3}.org/{k}", PAGE.format(f"w{k % 4}") + "<p>x</p>" * (k % 5)) for k in range(30)]
    rows = spark.createDataFrame(pages, "id long, url string, html string").select(
        "*", _host("url").alias("host"), F.xxhash64("id").alias("key"))
    known = read(rows).withColumn("times", F.lit(1))
    counts = {k: (f"h{k % 3}.org", _counted(*parsed(html))[0]) for k, _, html in pages}
    tokens = sorted({(h, *(t if isinstance(t, tuple) else (t, None))) for h, c in counts.values() for t in c}, key=str)
    found = occurrences(known, spark.createDataFrame(tokens, "host string, path string, word string")).collect()
    by_vector, by_sums = {}, {}
    for r in found:
        token = r.path if r.word is None else (r.path, r.word)
        vector = (r.host, *(c[token] for h, c in counts.values() if h == r.host))
        assert r.total == sum(vector[1:]) and r.pages == sum(1 for n in vector[1:] if n)
        by_vector.setdefault(vector, set()).add(token)
        by_sums.setdefault((r.host, r.total, r.a, r.b), set()).add(token)
    assert len(found) == len(tokens) and sorted(map(sorted_tokens, by_vector.values())) == sorted(map(sorted_tokens, by_sums.values()))


def sorted_tokens(tokens):
    return sorted(map(str, tokens))


def test_root_of_a_host_without_article(spark):
    page = "<body><div><p>Menu {0}</p></div><section><p>{1}</p><p>{2}</p></section></body>"
    pages = [(k, "http://c.org/x", page.format(k, f"body {k} " * 20, f"more {k * 7}")) for k in range(6)]
    rows = main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all(r.text.startswith(f"body {r.page_id} body") and "Menu" not in r.text for r in rows)


def test_odd_pages(spark):
    rows = [(1, None, None), (None, "http://a", ""), (2, "not a url", "<p>x</p>"), (2, "not a url", "<p>x</p>"),
            (3, "//H.org:80/p", "<article>" + "<p>word word</p>" * 20_000 + "</article>")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, host string")
    got = sorted(((r.page_id, r.text[:9], r.n_chars) for r in main_text(df).collect()), key=str)
    assert got == sorted([(1, "", 0), (None, "", 0), (2, "x", 1), (2, "x", 1), (3, "word word", 20_000 * 11 - 2)], key=str)
    assert main_text(df.limit(0)).count() == 0 and main_text(df).columns == ["page_id", "url", "text", "n_chars"]


def test_names_and_hidden_are_compared_whole():
    for attributes in ('class="overflow-hidden"', 'aria-hidden="false"', 'class="content no-sidebar"', 'class="post has-comments"',
                       'id="share-price"', 'data-class="menu"', 'title="class=x hidden"'):
        assert text_of(f"<body class='overflow-x-hidden'><div {attributes}><p>text of it</p></div></body>") == "text of it", attributes
        assert text_of(f"<main {attributes}><p>text of it</p></main>") == "text of it", attributes
    for attributes in ("hidden", 'hidden=""', 'style="color:red; display: none"', 'class="x sidebar"', "id=comments-list", 'class="site-footer"'):
        assert text_of(f"<main><p>text of it</p><div {attributes}><p>not this</p></div></main>") == "text of it", attributes


def test_hosts_of_one_layout_keep_their_own_words(spark):
    page = "<body><div class=a><p>{1} {0}</p></div><div class=b><p>same {2} end</p></div></body>"
    # Hosts have as many constant words and the same first ones; the other host's last is text here.
    pages = [(k, f"http://h{h}.org/{k}", page.format(f"n{k}", "Read", f"w{h}")) for h in range(12) for k in range(6)]
    rows = main_text(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)).collect()
    assert [r.text for r in rows if r.text.split("\n")[0] != f"Read n{r.page_id}" or "same" in r.text] == []


def texts(spark, pages):
    rows = main_text(spark.createDataFrame(list(pages), "page_id long, url string, html string")).collect()
    return {r.page_id: r.text for r in rows}


def test_root_is_the_common_ancestor_of_the_slots(spark):
    page = ("<body><div class=top><p>Home of all</p></div><div class=post><h1>T{0}</h1><div class=entry><p>body {1}</p>"
            "<p>more {0}</p></div></div><div class=low><article class=teaser><p>see {0}</p></article></div></body>")
    got = texts(spark, ((k, f"http://d.org/{k}", page.format(k, f"w{k} " * 60)) for k in range(6)))
    assert all(t == f"T{k}\n\nbody " + " ".join([f"w{k}"] * 60) + f"\n\nmore {k}" for k, t in got.items())
    assert text_of(page.replace("article", "div").format(1, "w " * 60)).startswith("T1\n\nbody w")


def test_most_text_overrides_a_name(spark):
    page = "<body><div class=menu><p>go {0}</p></div><div class=widget><h2>T{0}</h2><p>{1}</p><div class=share><p>to {0}</p></div></div></body>"
    got = texts(spark, ((k, f"http://e.org/{k}", page.format(k, f"word{k} " * 40)) for k in range(6)))
    assert all(t == f"T{k}\n\n" + " ".join([f"word{k}"] * 40) for k, t in got.items())


def test_copies_of_a_page_make_no_template(spark):
    text = "<nav><p>{0}</p></nav><article><h1>One title</h1><p>the same text of it</p><p>and more of it</p></article>"
    whole = "One title\n\nthe same text of it\n\nand more of it"
    # Repeated rows, equal html at other urls, and variants around one article.
    pages = [(1, "http://f.org/a", text.format(0))] * 4 + [(k, f"http://f.org/a?utm={k}", text.format(k % 5)) for k in range(2, 40)]
    pages += [(k, f"http://f.org/{k}", f"<article><h1>Other {k}</h1><p>its text {k * 7}</p></article>") for k in range(50, 53)]
    got = texts(spark, pages)
    assert {t for k, t in got.items() if k < 50} == {whole} and got[51] == "Other 51\n\nits text 357"


def test_pages_are_moved_as_packed_bags(spark):
    import json
    from tidewatch.llm.html_extraction import _bag, _packed, _pages, _tokens
    html = "<html><body><div class='x'><p>one two &eacute; one</p>three<p>" + "four five one " * 200 + "</p></div></body></html>"
    page = parsed(html)
    found = read(spark.createDataFrame([(1, "u", "h", 7, html)], "id long, url string, host string, key long, html string"))
    assert found.columns == ["id", "url", "host", "key", "content", "page"]
    (back,) = _pages(found.select("page").toArrow().to_batches()[0])
    assert [list(f) for f in page] == back
    bag = _bag(*page)
    assert len(_packed(bag)) < len(_packed(page)) < len(json.dumps(page))
    words = [w for t in page[4] for w in t.split()]
    tokens, beneath, own = _tokens(*bag)
    assert sum(n for t, n in tokens.items() if isinstance(t, tuple)) == len(words)
    assert beneath[""] == sum(own.values()) == sum(len(t) + 1 for t in page[4])


def test_frequent_tokens_of_a_chunk_against_brute_force(spark):
    """Words that cannot become frequent are let go, so a chunk of long pages is not cut into smaller ones."""
    from tidewatch.llm.html_extraction import CHUNK, KEYS_KEPT, _Chunk, _distinct, frequent
    least, own = 0.9, 2 * KEYS_KEPT // CHUNK
    # Word s of a paragraph is missing from s pages: the first, the last or some between.
    pages = [(k, "http://h.org/", 7, 1 + k % 3, "<p>" + " ".join(
        [f"a{s}" for s in range(25) if k >= s] + [f"z{s}" for s in range(25) if k < CHUNK - s]
        + [f"m{s}" for s in range(25) if k * 37 % CHUNK >= s] + ["late"] * (k > CHUNK - 20)
        + [f"n{k}x{i}" for i in range(own)]) + "</p>" + f"<div class=c{k % 11 == 0}><i>x</i></div>") for k in range(CHUNK)]
    whole = sum(1 / times for *_, times, _ in pages)
    weights, chunk = {}, _Chunk()
    for *_, times, page in pages:
        for token in _counted(*parsed(page))[0]:
            weights[token] = weights.get(token, 0.0) + 1 / times
        chunk.add(_distinct(*parsed(page)), times)
    expected = {t if isinstance(t, tuple) else (t, None) for t, w in weights.items() if w >= least * whole - 1e-6}
    assert 10 < len(expected) < 60 and ("p", "late") not in expected and ("p", "a3") in expected
    assert set(chunk.frequent()) == expected and chunk.held < KEYS_KEPT / 10
    rows = spark.createDataFrame(pages, "id long, url string, key long, times long, html string").withColumn("host", F.lit("h.org"))
    known = read(rows.coalesce(1)).withColumn("times", 1 + F.col("id") % 3)
    assert {(r.path, r.word) for r in frequent(known).collect()} == expected
