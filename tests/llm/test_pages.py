import random

from pyspark.sql import functions as F

from synthaudit.llm.pages import common_lines, extract_text, main_text, page_lines


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(800):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        got = common_lines(a, b)
        assert len(got) == lcs(a, b)
        it = iter(b)
        assert all(a[k] in it for k in sorted(got))


ARTICLE = ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li>N</ul></nav>"
           "<div class='ad'>Buy &amp; buy</div><article><h1>Head &lt;1&gt;</h1><p><b>one\n  two&nbsp;three<br>four<p>five</p>"
           "<aside>side</aside><form><input>f</form><div class='cookie-notice'>c</div><p>six<!-- no --></p>"
           "<section id=comments><p>reader</p></section></article><footer>f</footer></body></html>")


def test_marked_article():
    lines = page_lines(ARTICLE)
    assert main_text(lines, None) == "Head <1>\none two three four\nfive\nsix"
    assert main_text(lines, lines) == main_text(lines, None)         # a copy next to it takes nothing away
    assert main_text(page_lines(None), None) == main_text(page_lines(""), None) == ""


def frame(body):
    return f"<body><p>Welcome to the site</p><div>{body}</div><p>All rights reserved</p></body>"


def test_difference_against_neighbour(spark):
    rows = [(1, "http://a.example/x/1", frame("<p>first text</p>")), (2, "http://a.example/x/2", frame("<p>second text</p>")),
            (3, "http://b.example/x/1", frame("<p>alone</p>")), (4, None, None), (5, "http://c.example/", "no markup  at\nall"),
            (6, "http://a.example/x/3?q#f", ARTICLE), (7, "https://d.example/1", frame("copy")),
            (8, "https://d.example/2", frame("copy")), (8, "https://d.example/2", frame("copy"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("own")).coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = sorted((r.page_id, r.text) for r in extract_text(df).collect())
        assert extract_text(df.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    both = "Welcome to the site\n{}\nAll rights reserved"
    assert got == [(1, "first text"), (2, "second text"), (3, both.format("alone")), (4, ""), (5, "no markup at all"),
                   (6, "Head <1>\none two three four\nfive\nsix"), (7, both.format("copy")), (8, both.format("copy")),
                   (8, both.format("copy"))]


def test_whole_table(spark, sf):
    from synthaudit.llm.queries import QUERIES

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = QUERIES["op9_html"](spark, sf)
    assert got.count() == pages.count()
    import re

    html = {r.page_id: r.html for r in pages.collect()}
    for r in got.collect():
        body = re.search("<article>(.*)</article>", html[r.page_id] or "", re.S)
        want = " ".join(re.sub("<[^>]*>", " ", body[1]).split()) if body else ""
        assert " ".join(r.text.split()) == __import__("html").unescape(want) or "&" in want
        assert r.n_chars == len(r.text)
