import random

import pyarrow as pa

from cohortry.llm.html_text import aligned, extract, main_text, text_lines


def text(page, neighbour=None):
    return main_text(text_lines(page), neighbour)


def test_article_without_its_surroundings():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/x">menu</a></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy</div>
    <article><h1>Head &amp; more</h1><p><b>One   two<br>three<p>caf&eacute; &#8364;&nbsp;5 &lt;p&gt;</p>
    <div class="notice">cookies</div><form><p>mail</p></form><ul><li>a<li>b</ul>
    <table><tr><td>x</td><td>y</td></tr></table><section class="comments"><p>first!</p></section></article>
    <aside><p>side</p></aside><footer>&copy; foot</footer></body></html>"""
    assert text(page) == "Head & more\nOne two three\ncafé € 5 <p>\na\nb\nx y"


def test_classes_that_only_contain_a_template_word_stay():
    kept = ["share-price", "search-results", "related_work note", "ad1hoc-study", "menu-engineering"]
    gone = ["ad", "ad-slot", "ad-300x250", "ads top", "cookie-notice", "site-nav", "page__sidebar", "share-buttons", "related-posts",
            "comment-list", "article-comments", "nav-bar", "newsletter-box", "post-footer"]
    page = "<body><article>" + "".join(f'<p class="{c}">text {k}</p>' for k, c in enumerate(kept + gone)) + "</article></body>"
    assert text(page).split("\n") == [f"text {k}" for k in range(len(kept))]


def test_odd_markup():
    assert text("") == "" and text("just text & more &amp") == "just text & more &"
    assert text("<p>a<p>b</p><script>never ends <p>c") == "a\nb"
    assert text("<article><p title='a > b'>kept</p><!-- open <p>gone") == "kept"
    assert text("<ARTICLE><P>Upper</P></ARTICLE><p>out</p>") == "Upper"
    assert len(text("<article>" + "<p>line</p>" * 20_000)) == 5 * 20_000 - 1


def test_shared_lines_go_where_no_article_is_marked():
    page = "<body><p>Welcome to our site</p><p>Story one</p><p>More of it</p><p>All rights reserved</p></body>"
    other = ["Welcome to our site", "Story two", "All rights reserved"]
    assert text(page, other) == "Story one\nMore of it"
    assert text(page, [s for s, _ in text_lines(page)]) == "Welcome to our site\nStory one\nMore of it\nAll rights reserved"
    assert text(f"<main>{page}</main>", other).startswith("Welcome")


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        kept = aligned(a, b)
        rest = iter(b)
        assert len(kept) == table[-1][-1] and all(any(y == a[i] for y in rest) for i in sorted(kept))


def test_pairs_within_hosts(spark):
    page = lambda *lines: "<body>" + "".join(f"<p>{s}</p>" for s in lines) + "</body>"
    rows = [(k, f"https://one.example.org/news/{k:03d}", page("Top", f"own {k}", f"second {k}", "End")) for k in range(60)]
    rows += [(100, "https://alone.example.org/a", page("Top", "single", "End")), (101, None, page("Top", "none", "End")),
             (102, "https://two.example.org/x", None), (103, "https://two.example.org/y?q=1", ""), (104, "not a url", page("Top")),
             (None, "https://one.example.org/news/000", page("Top", "own 0", "second 0", "End"))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("host", "path", "text", "lines", "content", "before"):
        frame = frame.selectExpr("*", f"1 AS `{name}`")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extract(frame.repartition(7)).collect()}
    assert len(got) == len(rows)
    for k in range(1, 60):
        assert got[k][1] == f"own {k}\nsecond {k}"
    assert got[100][1] == "Top\nsingle\nEnd" and got[101][1] == "Top\nnone\nEnd" and got[104][1] == "Top"
    assert got[102][1:] == ("", 0) and got[103][1:] == ("", 0)
    assert all(n == len(t) for _, t, n in got.values())
    assert extract(frame.where("false")).collect() == []


def test_pages_of_the_given_tables(spark):
    """The articles hold the documents' lines."""
    import html
    import re

    from cohortry.llm.queries import QUERIES

    directory = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{directory}/pages.parquet").collect()}
    rows = QUERIES["op3_page_differencing"](spark, directory).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*?)</article>", pages[r.page_id], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_a_short_article_among_many_shared_lines():
    """Thirty menu and footer lines and one to three own lines: the own ones are the text, whatever the share."""
    menu = [f"Menu entry {k}" for k in range(30)]
    for n in (1, 2, 3):
        own, other = [f"Own line {k} of the story" for k in range(n)], [f"Another line {k}" for k in range(n)]
        page = "".join(f"<div>{s}</div>" for s in [*menu[:20], *own, *menu[20:]])
        assert text(page, [*menu[:20], *other, *menu[20:]]) == "\n".join(own)
        counter = page + "<div>1 234</div>"
        beside = [s for s, _ in text_lines(page)]
        assert main_text(text_lines(counter), beside, [*menu[:20], *other, *menu[20:]]) == "\n".join([*own, "1 234"])


def test_copies_look_past_each_other(spark):
    """Runs of copies, also over the ends of ranges, are compared with the nearest pages that differ."""
    menu = "".join(f"<div>Menu entry {k}</div>" for k in range(30))
    rows = [(k, f"https://one.example.org/a/{k:03d}", f"<body>{menu}<div>Story of {k // 40}</div></body>") for k in range(120)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.page_id: r.text for r in extract(frame.repartition(5)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {k: f"Story of {k // 40}" for k in range(120)}


def test_marked_pages_are_paired_and_aligned(spark, monkeypatch):
    """Differencing meets every page; the mark restores shared lines of the article and deletes what is left outside it."""
    from cohortry.llm import html_text

    page = "<body><p>Top</p><p>Date {k}</p><article><p>Same for all</p><p>Own {k}</p></article><p>End</p></body>"
    lines = text_lines(page.format(k=1))
    other = [s for s, _ in text_lines(page.format(k=2))]
    kinds, texts = [kind for _, kind in lines], [s for s, _ in lines]
    assert [texts[i] for i in html_text.own_lines(kinds, texts, [other], set())] == ["Date 1", "Own 1"]
    assert main_text(lines, other) == "Same for all\nOwn 1"
    rows = [(k, f"https://one.example.org/{k}", page.format(k=k)) for k in range(3)]
    source = [dict(zip(("page_id", "url", "html"), r)) | {"host": "one.example.org", "path": f"/{r[0]}", "content": r[0]} for r in rows]
    made = list(html_text._line_rows(iter([pa.RecordBatch.from_pylist(source)])))
    seen = []
    monkeypatch.setattr(html_text, "aligned", lambda a, b: seen.append(len(a)) or aligned(a, b))
    monkeypatch.setattr(html_text.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    out = [r for b in html_text._pair(iter(made)) for r in b.to_pylist()]
    assert [r["text"] for r in out if r["state"] == html_text.DONE] == ["Same for all\nOwn 1"] and seen == [5]
    assert {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {
        k: f"Same for all\nOwn {k}" for k in range(3)}


def test_differencing_picks_the_marked_elements():
    """Marked boxes that the neighbour has too are template text; the article's own shared lines are restored."""
    page = ("<body><p>Date {k}</p><main><h2>News</h2><article><h1>Head {k}</h1><p>Quoted</p><p>Story {k}</p></article><article><p>Read this</p>"
            "<p>Win a car</p></article><p>Most read</p></main><article><p>About us</p></article></body>")
    lines = text_lines(page.format(k=1))
    other, copy = ([s for s, _ in text_lines(page.format(k=k))] for k in (2, 1))
    assert main_text(lines, other) == main_text(lines, copy, other) == "Head 1\nQuoted\nStory 1"
    # no neighbour, or only copies: nothing tells which marked element is template text
    assert main_text(lines) == main_text(lines, copy, copy) == "News\nHead 1\nQuoted\nStory 1\nRead this\nWin a car\nMost read\nAbout us"


def test_a_near_copy_tells_nothing_about_marked_elements():
    parts = ["<article>" + "".join(f"<p>Part {k} line {n}</p>" for n in range(9)) + "</article>" for k in (1, 2)]
    page, box = "".join(parts), "<article><p>Box</p></article>"
    near = [s.replace("Part 1 line 4", "Part 1 line four") for s, _ in text_lines(page + box)]
    whole = text(page)
    assert main_text(text_lines(page + box), near) == whole + "\nBox"
    assert main_text(text_lines(page + box), near, ["Other", "Box"]) == whole
    assert main_text(text_lines(page + box), ["Other", "Box"], near) == whole


def test_marked_boxes_of_a_host_are_deleted(spark):
    page = "<article><p>Story {k}</p><p>Same for all</p></article><article class='card'><h3>Card</h3><p>Offer</p></article>"
    rows = [(k, f"https://one.example.org/{k:02d}", page.format(k=k // 2)) for k in range(40)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {r.page_id: r.text for r in extract(frame).collect()} == {k: f"Story {k // 2}\nSame for all" for k in range(40)}
