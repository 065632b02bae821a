import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.operators import articles as A
from leafmill.operators import books as B
from leafmill.operators import catalogs as C
from leafmill.operators import changelog as L
from leafmill.operators import matching as M
from leafmill.operators import scoring as S
from leafmill.sources.pages import charset_of, page_nodes

PAGE = """<html lang=en><head><title>A title - Site</title><meta property="og:site_name" content="Site"><meta name=author content="By Jo Doe">
<script type="application/ld+json">{"datePublished": "2024-03-01T10:00:00Z"}</script></head><body><nav><a href=/x>menu</a></nav><article><h1>A title</h1><p>March 3, 2024</p>
<p>Some <b>bold</b> and <i>italic</i> words, with a <a href="../y?utm_source=a">link</a>, of enough length to count as content.<p>Second paragraph, never closed, which is
also long enough to be counted.<ul><li>one<li>two <code>x_y</code></ul><pre class="language-py">def f():
    return 1
</pre><blockquote>A quote that says something.</blockquote><table><tr><th>h<td>1<tr><td>a<td>b</table></article><footer>foot</footer></body></html>"""


def test_article(spark):
    pages = spark.createDataFrame([(1, "https://a.org/b/c/d", PAGE), (2, "https://a.org/", "<p>short"), (3, "https://a.org/", None)], "page_id long, url string, html string")
    rows, blocks = A.articles(pages)
    rows = rows.collect()
    assert [r.page_id for r in rows] == [1]
    r = rows[0]
    assert (r.title, r.byline, r.site_name, r.published_at, r.language) == ("A title", "Jo Doe", "Site", "2024-03-01T10:00:00Z", "en")
    assert "menu" not in r.text and "foot" not in r.text and "A title" not in r.text and "March 3" not in r.text
    assert "**bold** and *italic*" in r.markdown and "[link](https://a.org/b/y?utm_source=a)" in r.markdown
    assert "```python\ndef f():\n    return 1\n```" in r.markdown and "- one\n\n- two `x_y`" in r.markdown and "> A quote" in r.markdown
    got = [(b.row_no, b.col_no, b.text) for b in A.tables(blocks).orderBy("row_no", "col_no").collect()]
    assert got == [(0, 0, "h"), (0, 1, "1"), (1, 0, "a"), (1, 1, "b")]
    assert A.links(pages).first().host == "a.org"


def test_nodes_of_broken_pages(spark):
    pages = spark.createDataFrame([(1, "<p>a<p>b</div><script>x<p></script><br>c</p>")], "page_id long, html string")
    got = [(r.tag, r.text, r.parent) for r in page_nodes(pages).orderBy("node").collect()]
    assert got == [("p", None, -1), ("#text", "a", 0), ("p", None, -1), ("#text", "b", 2), ("br", None, 2), ("#text", "c", 2)]


def test_charsets():
    assert charset_of(b"\xef\xbb\xbfx", None) == "utf-8-sig"
    assert charset_of(b"<meta charset=iso-8859-1>", None) == "windows-1252"
    assert charset_of(b"x", "text/html; charset=utf-16") == "utf-8"


def log(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("turn", F.struct("seq")).drop("seq")


def test_articles_merge(spark):
    rows = [
        ("x", 1, 10, "c1", "t10", "article", False, "u1", "one", None), ("x", 2, 12, "c2", "t12", "articleProgress", None, None, None, "p1"), ("x", 3, 11, "c3", "t11", "article", False, "u2", "two", None),
        ("x", 4, 13, "c4", "t13", "article", True, None, None, None), ("x", 5, 20, "c5", "t20", "articleProgress", None, None, None, "p2"), ("x", 6, 12, "c6", "t12", "article", False, "u3", "stale", None),
        ("y", 7, 1, "c7", "t1", "articleProgress", None, None, None, "p"), ("z", 8, 1, "c8", "t1", "article", True, None, None, None), ("z", 9, 2, "c9", "t2", "article", False, "u", "back", None),
    ]
    changes = log(spark, rows, "id string, seq int, updated_us long, change_id string, updated_at string, kind string, deleted boolean, url string, title string, position string")
    out = {r.id: r for r in L.merge_articles(changes).collect()}
    turns = sorted((r.id, r.turn.seq) for r in L.accepted_articles(changes).collect())
    assert set(out) == {"x", "z"}
    assert (out["x"].title, out["x"].deleted_at, out["x"].position) == ("two", "t13", "p1")
    assert turns == [("x", 1), ("x", 2), ("x", 3), ("x", 4), ("z", 8), ("z", 9)] and out["x"].turn.seq == 4
    assert (out["z"].title, out["z"].deleted_at) == ("back", None)


def test_highlights_and_categories(spark):
    h = [("h", 1, 5, "a", "t5", "b1", "s", "first", "red", None, "t0", False), ("h", 2, 6, "b", "t6", "b2", "s", "moved", "red", None, "t9", False), ("h", 3, 5, "b", "t5", "b1", "s", "tie", "red", None, "t9", True)]
    schema = "id string, seq int, updated_us long, change_id string, updated_at string, book_id string, sha256 string, text string, color string, note string, created_at string, deleted boolean"
    highlights = log(spark, h, schema)
    state = L.merge_highlights(highlights)
    r = state.first()
    assert (r.text, r.created_at, r.deleted_at, r.book_id) == ("tie", "t0", "t5", "b1")
    c = [("c", 4, 5, "a", "t5", " n ", "red", "t1", False), ("c", 5, 1, "b", "t1", None, None, None, True), ("c", 6, 9, "c", "t9", "later", "red", "t1", False)]
    changes = log(spark, c, "id string, seq int, updated_us long, change_id string, updated_at string, name string, color string, created_at string, deleted boolean")
    cats = L.merge_categories(changes)
    r = cats.first()
    assert (r.name, r.deleted_at) == ("n", "t1")
    first, second = L.with_revisions((state, L.accepted_highlights(highlights)), (cats, L.accepted_categories(changes)))
    assert (first.first().rev, second.first().rev) == (2, 4)


def test_change_validation(spark):
    sha = "a" * 64
    rows = [
        ("c1", "b", sha, "session", "2024-01-01T00:00:00Z", '{"readingMilliseconds": 5}', None), ("c2", "b", sha, "session", "2024-01-01T00:00:00Z", '{"readingMilliseconds": -5}', "payload of kind"),
        ("c3", "b", sha, "session", "2024-01-01T00:20:00Z", '{"readingMilliseconds": 5}', "updated at"), ("c4", "b", "x", "session", "2024-01-01T00:00:00Z", '{"readingMilliseconds": 5}', "edition"),
        ("c5", "b", sha, "what", "2024-01-01T00:00:00Z", "{}", "kind"), ("c6", "b", sha, "library", "2024-01-01T00:00:00Z", '{"present": false, "addedAt": null}', None), ("c7", "b", sha, "library", "2024-01-01T00:00:00Z", '{"present": true, "addedAt": null}', "payload of kind"),
        ("c8", "b", sha, "progress", "2024-01-01T00:00:00Z", '{"href": "a", "progression": 0.5, "x": 1}', "payload of kind"), ("c9", "b", sha, "progress", "2024-01-01T00:00:00Z", '{"href": "a", "progression": 0.5}', None),
        ("c10", "b", sha, "progress", "2024-01-01T00:00:00Z", "no json", "payload"), (None, "b", sha, "progress", "2024-01-01T00:00:00Z", "{}", "change id"),
        ("c11", "categories", "0" * 64, "categoryItem", "2024-01-01T00:00:00Z", '{"categoryId": null, "itemType": "book", "itemId": "a-b"}', None),
        ("c12", "articles", "0" * 64, "articleProgress", "2024-01-01T00:00:00Z", '{"articleId": "%s", "position": {"block": 1, "offset": 0.5, "percent": 1}}' % ("0" * 32), None),
    ]
    df = spark.createDataFrame(rows, "change_id string, book_id string, sha256 string, kind string, updated_at string, payload string, want string")
    bad = [(r.change_id, r.want, r.problem) for r in L.validate(df, 1704067500_000000).collect() if r.want != r.problem]
    assert not bad


def test_batches_and_pulls(spark):
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate([5, 5, 5, 20, 1])], "k string, i int, s long")
    got = [r.batch for r in L.pack_batches(df, "k", "i", "s", max_rows=2, max_bytes=12).orderBy("i").collect()]
    assert got == [0, 0, 1, 2, 3]
    state = spark.createDataFrame([(i,) for i in range(1, 8)], "rev int")
    seen, cursor, more = [], 0, True
    while more:
        page = L.pull_since(state, cursor, 3).collect()
        seen += [r.rev for r in page]
        cursor, more = page[0].cursor, page[0].more
    assert seen == list(range(1, 8))


def test_scores(spark):
    truth = spark.createDataFrame([("a", "w1 w2 w3 w4 w5"), ("b", ""), ("c", "x y"), ("d", "k k k k k")], "id string, text string")
    out = spark.createDataFrame([("a", "w1 w2 w3 w4 w9"), ("b", ""), ("c", "x y"), ("d", "")], "id string, text string")
    got = {r.id: (r.tp, r.fp, r.fn, r.exact) for r in S.shingle_match(out, truth).collect()}
    third = 1 / 3
    assert got["b"] == (0, 0, 0, True) and got["c"] == (1, 0, 0, True) and got["d"] == (0, 0, 1, False)
    assert all(abs(x - third) < 1e-12 for x in got["a"][:3])
    m = S.shingle_match(out, truth).withColumn("engine", F.lit("e"))
    ci = S.bootstrap_scores(m, "engine", 200).first()
    f1 = S.macro_scores(m, "engine").first().f1
    assert ci.low <= f1 <= ci.high
    rows, draw = sorted((r.id, r.tp, r.fp, r.fn, r.exact) for r in m.collect()), S.mulberry32(1)
    samples = []
    for _ in range(200):
        picked = [rows[int(next(draw) * len(rows))] for _ in rows]
        mean = lambda xs: sum(xs) / len(xs) if xs else 0.0
        p = mean([tp / (tp + fp) for _, tp, fp, _, _ in picked if tp + fp > 0])
        r = mean([tp / (tp + fn) for _, tp, _, fn, _ in picked if tp + fn > 0])
        samples.append((2 * p * r / (p + r) if p + r else 0.0, p, r, mean([float(e) for *_, e in picked])))
    ranked = sorted(x[0] for x in samples)
    assert abs(ci.low - ranked[5]) < 1e-12 and abs(ci.high - ranked[194]) < 1e-12  # of 200: ranks 5 and 195 from 1
    for k, name in enumerate(("f1_std", "precision_std", "recall_std", "accuracy_std")):
        xs = [x[k] for x in samples]
        assert abs(ci[name] - (sum((x - mean(xs)) ** 2 for x in xs) / 199) ** 0.5) < 1e-9


def test_mulberry32_draws_in_unit_interval_and_repeats():
    a, b = S.mulberry32(1), S.mulberry32(1)
    x = [next(a) for _ in range(5)]
    assert x == [next(b) for _ in range(5)] and all(0 <= v < 1 for v in x) and abs(x[0] - 0.6270739405881613) < 1e-12


def test_catalogs(spark):
    q = C.ListQuery(q="A", limit=2)
    assert q.at(C.ListQuery(q="a ", limit=2, offset=4).cursor()).offset == 4
    try:
        q.at(C.ListQuery(q="b", limit=2, offset=4).cursor())
        raise AssertionError("cursor of another query")
    except ValueError:
        pass


def epub(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), text)
    return out.getvalue()


def test_books(spark):
    opf = '<package xmlns="x" xmlns:dc="y"><metadata><dc:title>T</dc:title><dc:creator>C</dc:creator></metadata><manifest><item id="a" href="a.xhtml"/><item id="i" href="c.jpg" properties="cover-image"/></manifest><spine><itemref idref="a"/></spine></package>'
    box = '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>'
    good = epub(mimetype="application/epub+zip", **{"META-INF__container_DOT_xml": box, "O__p_DOT_opf": opf, "O__a_DOT_xhtml": "<p>x"})
    poor = epub(mimetype="application/epub+zip", **{"META-INF__container_DOT_xml": box, "O__p_DOT_opf": opf})
    files = spark.createDataFrame([("good", good), ("poor", poor), ("no", b"PKxx"), ("pdf", b"%PDF-1.7")], "path string, content binary")
    got = {r.path: r for r in B.epub_inspect(files).collect()}
    assert (got["good"].status, got["good"].title, got["good"].creators, got["good"].cover) == ("ok", "T", ["C"], "O/c.jpg")
    assert (got["poor"].status, got["no"].status) == ("incomplete", "invalid")
    assert [r.k for r in files.select(B.source_kind("content").alias("k")).collect()] == ["zip", "zip", "zip", "pdf"]


def test_natural_order_and_spreads(spark):
    names = ["p10.jpg", "p2.jpg", "p02.jpg", "a/.x.jpg", "P1.JPG", "x.txt"]
    df = spark.createDataFrame([("b", n) for n in names], "path string, name string")
    assert [r.name for r in B.comic_pages(df).orderBy("page").collect()] == ["P1.JPG", "p2.jpg", "p02.jpg", "p10.jpg"]
    pages = spark.createDataFrame([("b", i, i == 3) for i in range(6)], "path string, page int, wide boolean")
    assert [r.pages for r in B.comic_spreads(pages).orderBy("spread").collect()] == [[0], [1, 2], [3], [4, 5]]


def test_search_and_anchors(spark):
    texts = spark.createDataFrame([("k", "One two. Two three, two.")], "key string, text string")
    assert [r.start for r in B.find_in_texts(texts, "TWO", ["key"]).orderBy("start").collect()] == [4, 9, 20]
    quotes = spark.createDataFrame([(1, "k", "two", "three, ", 0.0), (2, "k", "TWO THREE", "", 0.0), (3, "k", "none", "", 0.0)], "quote_id int, key string, quote string, before string, hint double")
    assert {(r.quote_id, r.start, r.end, r.how) for r in B.anchor_quotes(quotes, texts, "key").collect()} == {(1, 20, 23, "exact"), (2, 9, 18, "lower")}


def test_counter_f1_reads_whole_texts(spark, tmp_path):
    from leafmill.plans.catalogue import QUERIES

    same = " ".join(["word"] * 120)  # 599 characters; what differs stands behind them
    texts = [(1, f"{same} {same}"), (2, f"{same} {'x' * 2000}")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.f1 for r in QUERIES["counter_f1_texts"](spark, str(tmp_path)).collect()}
    assert got == {1: round(240 / 360, 6), 2: round(240 / 242, 6)}


def test_histories_of_a_hot_key_are_no_single_row(spark, monkeypatch):
    """Against plain folds; a third of the rows and more is one key's, and no function gathers a key's rows."""
    rng = random.Random(7)
    rows = [(rng.choice("aaabc"), i, rng.choice([None, 0, 1, 5, 9, 13, 30])) for i in range(900)]
    rows += [("d", i, 1) for i in range(5)] + [("e", i, None) for i in range(300)]
    frame = spark.createDataFrame(rows, "k string, i int, s long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges of one key
    with monkeypatch.context() as m:
        m.setattr(F, "collect_list", None)
        for max_rows, max_bytes in ((3, 20), (100, 240), (1000, 10**9), (1, 1)):
            got = {(r.k, r.i): r.batch for r in L.pack_batches(frame, "k", "i", "s", max_rows, max_bytes).collect()}
            assert len(got) == len(rows)
            state = {}
            for k, i, s in sorted(rows, key=lambda r: r[:2]):
                batch, n, held = state.get(k, (0, 0, 0))
                full = n > 0 and (n >= max_rows or (held is not None and s is not None and held + s > max_bytes))
                held = None if s is None or not full and held is None else s if full else held + s
                state[k] = (batch + full, 1 if full else n + 1, held)
                assert got[k, i] == batch + full

        log_rows = [(rng.choice("aaabc"), i, rng.randint(0, 40), rng.choice("xy"), f"t{i}", f" n{i} ", "red", f"c{i}", rng.random() < 0.01) for i in range(300)] + [("z", 301, 1, "x", "t", None, None, None, True)]
        cats = log(spark, log_rows, "id string, seq int, updated_us long, change_id string, updated_at string, name string, color string, created_at string, deleted boolean")
        got = {r.id: (r.name, r.color, r.created_at, r.updated_at, r.deleted_at, r.change_id) for r in L.merge_categories(cats).collect()}
        turns = sorted((r.id, r.turn.seq) for r in L.accepted_categories(cats).collect())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, accepted = {}, []
    for k, seq, us, change, at, name, color, made, deleted in log_rows:
        r = want.get(k)
        if r is None or not r[4] and (deleted or (us, change) > r[6]):
            accepted.append((k, seq))
            want[k] = (r[0] if r else "", r[1] if r else "", r[2] if r else at, at, at, change, None) if deleted else (name.strip(), color, r[2] if r else made, at, None, change, (us, change))
    assert got == {k: v[:6] for k, v in want.items()} and turns == sorted(accepted)


def test_merges_of_a_hot_key_against_folds(spark, monkeypatch):
    """200,000 changes, a third of them one key's: highlights and articles by plain folds; nothing gathers a key's rows."""
    rng = random.Random(11)
    ids = ["hot" if rng.random() < 0.34 else f"k{rng.randrange(400)}" for _ in range(200_000)]
    rows = [(k, i, rng.randint(0, 500_000), rng.choice("xy"), f"t{i}", rng.choice(["article"] * 2 + ["articleProgress"] * 3), rng.random() < 0.2, f"u{i}", "t", f"p{i}", rng.choice("abb"), "s", f"c{i}") for i, k in enumerate(ids)]
    schema = "id string, seq int, updated_us long, change_id string, updated_at string, kind string, deleted boolean, url string, title string, position string, book_id string, sha256 string, created_at string"
    changes = log(spark, rows, schema).withColumns({"text": F.col("url"), "color": F.lit("red"), "note": F.lit(None).cast("string")}).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    with monkeypatch.context() as m:
        for gather in ("collect_list", "collect_set"):
            m.setattr(F, gather, None)
        articles = {r.id: (r.url, r.change_id, r.deleted_at, r.position, r.turn.seq) for r in L.merge_articles(changes).collect()}
        article_turns = sorted(r.turn.seq for r in L.accepted_articles(changes).collect())
        highlights = {r.id: (r.text, r.created_at, r.deleted_at, r.turn.seq) for r in L.merge_highlights(changes).collect()}
        highlight_turns = sorted(r.turn.seq for r in L.accepted_highlights(changes).collect())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, turns, notes, note_turns = {}, [], {}, []
    for k, i, us, change, at, kind, dead, url, _, position, book, _, made in rows:
        r = want.get(k)
        if kind == "article" and (r is None or (us, change) > r["clock"]):
            alive = r is not None and not r["dead"]
            place = (r["place"] if r else None) if dead or alive else None
            want[k] = {"clock": (us, change), "dead": dead, "at": at, "url": (r["url"] if r else "") if dead else url, "place": place, "turn": i}
            turns.append(i)
        elif kind != "article" and r is not None and not r["dead"] and (r["place"] is None or (us, change) > r["place"][0]):
            r["place"], r["turn"] = ((us, change), position), i
            turns.append(i)
        n = notes.get(k)
        if n is None or book == n[0] and (us, change) > n[1]:
            notes[k] = (book, (us, change), url, n[3] if n else made, at if dead else None, i)
            note_turns.append(i)
    assert articles == {k: (r["url"], r["clock"][1], r["at"] if r["dead"] else None, r["place"] and r["place"][1], r["turn"]) for k, r in want.items()}
    assert highlights == {k: n[2:] for k, n in notes.items()}
    assert article_turns == turns and highlight_turns == note_turns and ids.count("hot") > 66_000


def test_segments_of_few_large_files_are_dealt_out(spark):
    files = spark.createDataFrame([(1, 3 << 45), (2, 5), (3, 0), (4, None)], "id long, size long").coalesce(1)
    out = B.plan_segments(files, "size")
    assert out.rdd.getNumPartitions() > 1
    sums = {r.id: r for r in out.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bytes"), F.countDistinct("fetch").alias("places")).collect()}
    assert {k: r.bytes for k, r in sums.items()} == {1: 3 << 45, 2: 5} and all(r.n == r.places for r in sums.values())
    assert max(r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < sums[1].n / 2


def test_segments_of_many_files_take_little_room(spark, tmp_path):
    """Four million ranges of 1,000 large files: a task holds the same places of many files, so their numbers repeat."""
    files = spark.range(1000).select("id", (F.lit(1 << 36) + F.col("id") * 300_007).alias("size"))
    B.plan_segments(files, "size").select("id", "fetch", "start", "end").write.parquet(f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    sums = back.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bytes"), F.countDistinct("fetch").alias("places"), F.max("fetch").alias("last"))
    assert sums.join(files, "id").where("bytes = size and n = places and last = n - 1").count() == 1000
    held = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert held < 1.0 * back.count()


def test_cell_scores_hold_every_order_and_every_book(spark, tmp_path):
    """More orders mean more pages, and the lines of a book's orders are scored together as well."""
    from leafmill.plans.rules import cell_scores

    line = lambda o, n, flag: (o, n, 1.0, 0.02, flag)
    lines = [line(o, 1, "R") for o in range(1200)] + [line(7, 2, "A"), line(507, 3, "N")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_tax double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = {(r.level, r.page, r.p_table, r.r_table): r.f1 for r in cell_scores(spark, str(tmp_path)).collect()}
    assert {k[1] for k in rows if k[0] == "order"} == set(range(1200)) and {k[1] for k in rows if k[0] == "book"} == set(range(500))
    assert rows["order", 7, 1, 1] == rows["order", 7, 2, 1] == 1.0 and ("order", 7, 2, 3) not in rows
    assert (rows["book", 7, 1, 1], rows["book", 7, 2, 3], rows["book", 7, 2, 1]) == (1.0, 1.0, 0.5)


def test_boxes_meet_by_grid_as_by_comparing_all(spark):
    rng = random.Random(4)
    rows = lambda n: [(i % 3, i, float(rng.randrange(40)), float(rng.randrange(30)), rng.choice([0.0, 2.0, 6.0, 6.0, 6.0, 900.0]), rng.choice([1.0, 4.0, 300.0])) for i in range(n)]
    a, b = rows(150), [*rows(200), (0, 900, 5.0, 5.0, 6.0, 4.0), (0, 901, 5.0, 5.0, 6.0, 4.0)]
    df = lambda x, name: spark.createDataFrame(x, f"page int, {name} long, x double, y double, w double, h double").select("page", name, G.rect(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("box"))
    side = lambda p, q, r, s: min(p + q, r + s) - max(p, r)
    meets = lambda p, q: p[0] == q[0] and p[2] < q[2] + q[4] and q[2] < p[2] + p[4] and p[3] < q[3] + q[5] and q[3] < p[3] + p[5]
    area = lambda p, q: side(p[2], p[4], q[2], q[4]) * side(p[3], p[5], q[3], q[5])
    want = {(p[0], p[1]): max((area(p, q), -q[1]) for q in b if meets(p, q)) for p in a if any(meets(p, q) for q in b)}
    got = M.largest_overlap(df(a, "region"), df(b, "block"), ["page"])
    assert {(r.page, r.region): (r.area, -r.block) for r in got.collect()} == want
    spans = df(b, "seq").withColumn("text", F.col("seq").cast("string"))
    # a link of two rectangles has the texts of both
    links = df([*a, (0, 7000, 1.0, 1.0, 6.0, 4.0), (0, 7000, 3.0, 2.0, 6.0, 4.0)], "link").withColumn("uri", F.lit("u"))
    pairs = {}
    for p in [*a, (0, 7000, 1.0, 1.0, 6.0, 4.0), (0, 7000, 3.0, 2.0, 6.0, 4.0)]:
        pairs.setdefault((p[0], p[1]), []).extend(q[1] for q in b if meets(p, q))
    assert {(r.page, r.link): r.text for r in M.link_spans(links, spans, ["page"]).collect()} == {k: " ".join(map(str, sorted(v))) for k, v in pairs.items() if v}


def test_texts_of_links_are_not_moved(spark):
    """A page of 600 links over 500 spans each: what tasks exchange is near the input, not the 300,000 words of the texts."""

    def written() -> int:
        list_, jvm = spark.sparkContext._jvm.java.util.ArrayList, spark.sparkContext._jvm
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(list_(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), list_())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    box = lambda w: G.rect(F.col("id") * 0.0, F.lit(0.0), F.lit(2.0) + w, F.lit(3.0))
    links = spark.range(600).select(F.lit(1).alias("page"), F.col("id").alias("link"), F.lit("u").alias("uri"), box(F.col("id") / 600).alias("box"))
    spans = spark.range(500).select(F.lit(1).alias("page"), F.col("id").alias("seq"), F.md5(F.col("id").cast("string")).alias("text"), box(F.col("id") / 500).alias("box"))
    before = written()
    rows = M.link_spans(links, spans, ["page"]).select("link", F.size(F.split("text", " ")).alias("n")).collect()
    assert len(rows) == 600 and {r.n for r in rows} == {500}
    assert 0 < written() - before < 500_000


def test_equal_boxes_are_compared_once(spark):
    """A page of 30,000 equal regions and as many equal blocks: 900 million pairs if each is compared."""
    side = lambda name: spark.range(30_000).select(F.lit(1).alias("page"), F.col("id").alias(name), G.rect(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(3.0)).alias("box"))
    pairs = M.meeting_boxes(side("region").select("page", F.col("box").alias("a")).distinct(), side("block").select("page", F.col("box").alias("b")).distinct(), ["page"])
    assert pairs.count() == 1
    assert M.largest_overlap(side("region"), side("block"), ["page"]).select(F.count("*"), F.max("block"), F.max("area")).first() == (30_000, 0, 6.0)


@pytest.mark.parametrize("name", ["shingle_scores_by_lang", "counter_f1", "counter_f1_texts"])
def test_words_are_counted_where_rows_of_a_key_meet(spark, tmp_path, monkeypatch, name):
    """As SQL on shared, null and empty ids and texts; the number of tasks grows with the texts."""
    import duckdb
    from leafmill.plans.catalogue import ORACLES, QUERIES
    from tests.conftest import rows_of

    words = lambda seed, n: " ".join(random.Random(seed).choices(["a", "bc", "d_e", "ü1", "f"], k=n))
    texts = [(i, words(i, i % 90), "en" if i % 3 else "de") for i in range(300)]
    texts += [(7, words(1, 50), "en"), (7, words(2, 9), None), (8, "", "de"), (None, words(3, 40), "de"), (None, words(4, 40), "de"), (900, None, "en"), (901, "", "en"), (902, "..", "en")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(S, "TASK_BYTES", 1000)
    df = QUERIES[name](spark, str(tmp_path))
    placed = S.shared_counts(spark.read.parquet(f"{tmp_path}/documents.parquet"), "doc_id", F.col("text"), F.col("text"), [])
    assert placed.rdd.getNumPartitions() > 20
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = df.toArrow(), con.sql(ORACLES[name]).to_arrow_table()
    assert rows_of(got, sorted(got.column_names)) == rows_of(want, sorted(want.column_names))
