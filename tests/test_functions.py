from pyspark.sql import functions as F

from leafmill.functions import dates as D
from leafmill.functions import furniture as N
from leafmill.functions import geometry as G
from leafmill.functions import images as I
from leafmill.functions import text as T
from leafmill.functions import urls as U


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make("x").alias("y")).first().y


def test_text(spark):
    assert one(spark, " a\t\n b ", T.collapse) == "a b"
    assert one(spark, "日本語x y", T.count_words) == 4
    assert one(spark, "a b c", lambda c: T.ngrams(T.tokens(c), 2)) == ["a\u0001b", "b\u0001c"]
    assert one(spark, "a", lambda c: T.ngrams(T.tokens(c), 4)) == ["a"]
    assert one(spark, "", lambda c: T.ngrams(T.tokens(c), 4)) == []
    assert one(spark, "x​  y\r\n\n z", T.normalize_lines) == "x y\nz"
    assert one(spark, "“Ａ”… b", T.match_key) == '"a"...b'
    assert one(spark, " Py3 ", T.canonical_language) == "python"
    assert one(spark, "plain", T.canonical_language) is None
    assert one(spark, "שלום a", T.direction) == "rtl"
    assert one(spark, "😀a", T.utf16_length) == 3
    assert one(spark, "/x/my_book.v2.epub", T.title_from_file_name) == "my book.v2"
    assert one(spark, "aaa bbb ccc ddd", lambda c: T.clip_at_word(c, 12)) == "aaa bbb…"
    assert one(spark, "abcd", lambda c: T.edit_accuracy(c, F.lit("abxd"))) == 0.75


def test_titles(spark):
    m = lambda a, b: tuple(one(spark, a, lambda c: T.title_match(c, F.lit(b))))
    assert m("A title", "a  Title") == (True, True)
    assert m("A title of some length", "A title of some length - Site") == (False, True)
    assert m("A title", "something else here") == (False, False)
    assert m("A title", "") == (False, False)


def test_urls(spark):
    u = "https://User:p@WWW.Ex.com:443/a//?utm_x=1&b=2&ref=3#f"
    assert one(spark, u, U.host_of) == "ex.com"
    assert one(spark, u, U.canonical_url) == "https://User:p@WWW.Ex.com:443/a//?b=2"
    assert one(spark, u, U.article_url_key) == "ex.com/a?b=2&ref=3"
    assert len(one(spark, u, U.article_id)) == 32
    for good, url in ((True, "https://a.example.org/x"), (False, u), (False, "http://10.0.0.1/"), (False, "https://x.local/"), (False, "ftp://a.b.org/"), (False, "https://a.b.org:8080/")):
        assert one(spark, url, U.is_public_article) is good, url
    assert one(spark, "see (https://a.org/x_(y)).", U.find_url) == "https://a.org/x_(y)"
    assert one(spark, "https://youtu.be/abcdefgh", U.media_provider).provider == "youtube"
    html = '<head><title>a</title><meta property="og:title" content="OG  t"><link rel="icon" href="/i.png"></head><title>no</title>'
    assert tuple(one(spark, html, lambda c: U.link_metadata(c, F.lit("https://x.org/a/b")))) == ("OG t", "", "https://x.org/i.png")


def test_dates(spark):
    for text, want in (("2024-03-01", "2024-03-01"), ("2024-03-01 10:02+0200", "2024-03-01T10:02:00+02:00"), ("20240301", "2024-03-01"), ("Posted March 3rd, 2024", "2024-03-03"), ("3 Sept. 2024", "2024-09-03"), ("soon", None)):
        assert one(spark, text, D.normalize_date) == want, text
    assert one(spark, "2024-02-28T10:00:00.123456Z", D.iso_micros) == 1709114400123456
    assert one(spark, "2024-02-30T10:00:00Z", D.iso_micros) is None
    assert one(spark, "Updated: March 3, 2024 at 10:00", D.is_date_line) is True
    assert one(spark, "1000", lambda c: D.retry_delay_ms(F.col(c).cast("long"), F.lit(20))) == 900_000


def test_geometry(spark):
    a, b = (G.rect(*[F.lit(float(x)) for x in v]) for v in ((0, 0, 2, 2), (1, 1, 3, 3)))
    row = spark.range(1).select(G.overlap(a, b).alias("o"), G.intersects(a, b).alias("i"), G.contains(a, b).alias("c"), G.position_of(F.lit(3.25), F.lit(10)).alias("p"), G.round_half_up(F.lit(-0.5), 0).alias("r")).first()
    assert (row.o, row.i, row.c, tuple(row.p), row.r) == (1.0, True, False, (3, 0.25, 0.325), 0.0)


def test_images(spark):
    found = lambda x: [tuple(c) for c in one(spark, x, lambda c: I.candidates(F.col(c)))]
    assert found("/a,b.jpg 2x,/c.jpg 300w 200h, /d.jpg,") == [("/a,b.jpg", 0, 2.0), ("/c.jpg", 300, 1.0), ("/d.jpg", 0, 1.0)]
    assert found(None) == found("") == found(" , ,") == found("ftp://x/y.png 2x") == []
    best = lambda x: (one(spark, x, lambda c: I.best(I.candidates(F.col(c)))) or {"url": None})["url"]
    assert best("/a 400w, /b 1600w, /c 1600w, /d 4000w") == "/b"
    assert (best("/a 3000w, /b 2000w"), best("/a 3x, /b 4x"), best("/a, /b 2x, /c 3x"), best(None)) == ("/b", "/a", "/b", None)
    size = lambda v: one(spark, v, lambda c: I.dimension(F.create_map(F.lit("width"), F.col(c)), "width"))
    assert [size(v) for v in (" 12.5px ", "20000", "0", "50%", "9" * 30, None)] == [12, None, None, None, None, None]


def test_furniture(spark):
    names = lambda x: one(spark, x, lambda c: N.author_names(F.array(F.col(c))))
    assert names("By Jo Doe, Ann Able and JO DOE |") == ["Jo Doe", "Ann Able"]
    assert names("Von: Max Rand und Ida Land") == ["Max Rand", "Ida Land"]
    assert names(None) in (None, []) and names("") == [] and names("x@z.org, a b c d e f g h i") == []
    assert one(spark, "Read more: this", lambda c: N.is_pointer(F.col(c), F.lit(0.0))) is True
    assert one(spark, "", lambda c: N.is_pointer(F.col(c), F.lit(1.0))) is False
    assert one(spark, "Subscribe now", lambda c: N.is_pitch(F.col(c))) is True
    assert one(spark, "a.b@example.org", lambda c: N.is_contact(F.col(c))) is True


def test_picture_sources_and_chrome(spark):
    from leafmill.operators import articles as A
    from leafmill.sources.pages import page_nodes

    html = """<body><article><p>Some text that stands here.</p><picture><source type="image/avif" srcset="/x.avif 800w"><source srcset="/s-700.jpg 700w, /s-900.jpg 900w"><img src="/s.jpg"></picture>
    <img src="/logo.png" class="site-logo"><img src="/t.gif" width="1" height="1"><p>In line <img src="/e.png" width="16"> here</p></article></body>"""
    pages = spark.createDataFrame([(1, "https://a.org/p/", html)], "page_id long, url string, html string")
    got = A.inlines(page_nodes(pages), pages).where("type = 'image'").orderBy("node").select("src", "small").collect()
    assert [tuple(r) for r in got] == [("https://a.org/s-900.jpg", False), ("https://a.org/e.png", True)]


def test_author_names_are_worked_out_once(spark):
    spelled = str(N.author_names(F.col("x")))
    assert spelled.count("and|und|et|y") == 1 and spelled.count("http://") == 1
