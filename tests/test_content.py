"""Content passes: data tables and clutter against plain recursions over random pages, attempts on made pages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leafmill.operators import articles as A
from leafmill.operators import content as C
from leafmill.operators import grids as G
from leafmill.session import cut
from leafmill.sources.pages import page_nodes


def random_page(r: random.Random) -> str:
    words = ["some", "words, that", "go on.", "and on", "advertisement", "x", "a longer run of words that fills a paragraph, with commas, and ends. "]
    names = ["", "", "", ' class="sidebar"', ' class="post-content"', ' class="note"', ' id="references"', ' class="share x"', ' class="plain"']

    def inner(depth: int) -> str:
        out = []
        for _ in range(r.randrange(1, 5)):
            kind = r.choice(["text", "p", "a", "here", "img", "h2", "pre", "ul", "ol", "div", "section", "div", "table", "figure", "span", "blockquote", "iframe"])
            text = " ".join(r.choice(words) for _ in range(r.randrange(0, 6)))
            if kind == "text" or depth > 5:
                out.append(text)
            elif kind == "p":
                out.append(f"<p>{text}<a href='/x'>{r.choice(words)}</a></p>")
            elif kind in ("a", "here"):
                out.append(f"<a href='{'#n' if kind == 'here' else '/y'}'>{text}</a>")
            elif kind == "img":
                out.append("<img src='/i.png'>")
            elif kind == "iframe":
                out.append(f"<iframe src='https://www.{r.choice(['youtube.com/embed/x', 'ads.example.org/y'])}'></iframe>")
            elif kind in ("h2", "pre", "span", "blockquote"):
                out.append(f"<{kind}>{text}</{kind}>")
            elif kind in ("ul", "ol"):
                out.append(f"<{kind}>" + "".join(f"<li>{r.choice([text, '<a href=/z>' + text + '</a>', inner(depth + 2)])}</li>" for _ in range(r.randrange(1, 5))) + f"</{kind}>")
            elif kind == "table":
                head = r.choice(["", "<caption>c</caption>", "<thead><tr><th>h</th></tr></thead>"])
                rows = "".join("<tr>" + "".join(f"<td colspan={r.randrange(0, 3)}>{inner(depth + 3) if r.random() < 0.2 else text}</td>" for _ in range(r.randrange(1, 4))) + "</tr>" for _ in range(r.randrange(1, 7)))
                out.append(f"<table{r.choice(['', '', ' role=presentation', ' summary=s'])}>{head}{rows}</table>")
            elif kind == "figure":
                out.append(f"<figure><img src='/f.png'><figcaption>{text}<a href='/c'>credit</a></figcaption></figure>")
            else:
                out.append(f"<{kind}{r.choice(names)}>{inner(depth + 1)}</{kind}>")
        return "".join(out)

    return f"<body>{inner(0)}</body>"


class Plain:
    """The rules by recursion over one page's nodes."""

    def __init__(self, rows):
        self.rows = {r.node: r for r in rows}
        self.kids = {}
        for r in sorted(rows, key=lambda r: r.node):
            self.kids.setdefault(r.parent, []).append(r.node)
        self.tables = {n: self.data_table(n) for n, r in self.rows.items() if r.tag == "table"}
        self.out = {}

    def names(self, r):
        return " ".join(x for x in (r.attrs.get("class", ""), r.attrs.get("id", "")) if x).lower()

    def named(self, r, names):
        return any(re.search(rf"(?:^|[\s_-]){n}(?:$|[\s_-])", self.names(r)) for n in names)

    def data_table(self, node):
        t = self.rows[node]
        if t.attrs.get("role") == "presentation" or t.attrs.get("datatable") == "0":
            return (None, None, False)
        found = {"rows": 0, "columns": 0, "header": False, "nested": False}

        def walk(n):
            for k in self.kids.get(n, []):
                r = self.rows[k]
                if r.tag == "table":
                    found["nested"] = True
                    continue
                found["header"] |= r.tag in ("col", "colgroup", "tfoot", "thead", "th") or (r.tag == "caption" and k in self.kids)
                if r.tag == "tr":
                    found["rows"] += 1
                    spans = [int(self.rows[c].attrs.get("colspan", "1") or 1) for c in self.kids.get(k, []) if self.rows[c].tag in ("td", "th")]
                    found["columns"] = max(found["columns"], sum(s if s > 0 else 1 for s in spans))
                walk(k)

        walk(node)
        rows, columns = found["rows"], found["columns"]
        if t.attrs.get("summary") or found["header"]:
            return rows, columns, True
        if found["nested"] or rows == 1 or columns == 1:
            return rows, columns, False
        return rows, columns, rows >= 10 or columns > 4 or rows * columns > 10

    def weight(self, r):
        score = 0
        for x in (r.attrs.get("class", "").lower(), r.attrs.get("id", "").lower()):
            score += 25 * any(p in x for p in C.POSITIVE) - 25 * (any(n in x for n in C.NEGATIVE) or "hid" in x.split(" "))
        return score + 30 * any(c in C.CONTENT_BOXES for c in r.attrs.get("class", "").lower().split())

    def visit(self, node, safe, in_figure):
        r = self.rows.get(node)
        tag = r.tag if r else ""
        c = dict.fromkeys(C._COUNTS, 0.0) | {"said": ""}
        notes = bool(r) and (self.named(r, C.NOTE_LISTS))
        shield = notes or (tag == "table" and self.tables[node][2])
        below = safe or tag in C.CODE or shield
        for k in self.kids.get(node, []):
            x = self.rows[k]
            if x.tag == "#text":
                n = len(re.sub("[\t\n\f\r ]+", " ", x.text).strip(" "))
                c["text"] += n
                c["commas"] += x.text.count(",")
                c["ends"] += len(re.findall(r"[.!?。！？][\"'”’)\]]*(?:\s|$)", x.text))
                c["said"] += x.text
                continue
            d = self.visit(k, below, in_figure or tag == "figure")
            if self.out.get(k, (None, False))[1]:
                continue
            href = x.attrs.get("href", "")
            frame = x.tag == "iframe" and "youtube" in x.attrs.get("src", "")
            c["text"] += d["text"]
            c["link"] += d["text"] * (0.3 if href.startswith("#") and len(href) > 1 else 1) if x.tag == "a" else d["link"]
            for name in ("commas", "ends", "said"):
                c[name] += d[name]
            for name in ("p", "img", "li", "input"):
                c[name] += d[name] + (x.tag == name)
            c["shielded"] += d["shielded"] + (x.tag in C.PLAYERS or frame or (x.tag == "table" and self.tables[k][2]))
            c["embeds"] += d["embeds"] + (x.tag in C.EMBEDDED and not frame)
            c["heading_text"] += d["text"] if x.tag in C.HEADINGS else d["heading_text"]
            c["list_text"] += d["text"] if x.tag in ("ul", "ol") else d["list_text"]
            c["inner_text"] += d["text"] if x.tag in C.TEXT_TAGS + C.TEXT_BOXES else d["inner_text"]
            figure = x.tag == "figure" and d["img"] > 0
            c["figures"] += 1 if figure else d["figures"]
            c["figure_text"] += d["text"] if figure else d["figure_text"]
            c["figure_link"] += d["link"] if figure else d["figure_link"]
        if r and tag in C.CONDITIONAL:
            self.out[node] = (c, not (safe or shield) and self.goes(r, c, in_figure))
        return c

    def goes(self, r, c, in_figure):
        listed = r.tag in ("ul", "ol")
        if c["shielded"] > 0 or (c["figures"] > 0 and c["text"] - c["figure_text"] < 25 and c["figure_link"] <= c["figure_text"] * 0.5 and not c["input"]):
            return False
        share = lambda a: c[a] / c["text"] if c["text"] else 0.0
        is_list = listed or share("list_text") > 0.9
        weight = self.weight(r)
        if weight < 0:
            return True
        if c["p"] > 0 and len(self.names(r)) > 1 and c["link"] <= c["text"] * 0.6 and not c["input"] and self.named(r, C.CALLOUTS):
            return False
        if not listed and c["heading_text"] > 0 and c["li"] >= 2 and c["text"] - c["list_text"] <= c["heading_text"] + 30 and c["link"] >= (c["text"] - c["heading_text"]) * 0.7:
            return True
        if c["commas"] >= 10 or (c["heading_text"] > 0 and c["text"] - c["link"] <= c["heading_text"] * 1.2):
            return False
        said = c["said"].strip(" ").lower()
        if c["text"] < 40 and (said in C.ADS or re.sub(r"(…|\.\.\.)$", "", said) in C.LOADING):
            return True
        density, heading, n = min(1, share("link")), share("heading_text"), c["text"]
        bad = not in_figure and c["img"] > 1 and c["p"] / c["img"] < 0.5
        bad |= not is_list and c["li"] - 100 > c["p"] or c["input"] > c["p"] // 3
        bad |= not is_list and not in_figure and heading < 0.9 and n < 25 and (c["img"] == 0 or c["img"] > 2) and density > 0
        bad |= not is_list and weight < 25 and density > 0.2 and not (density <= 0.3 and c["p"] > 0 and c["heading_text"] > 0 and n - c["heading_text"] >= 150 and c["ends"] >= 2)
        bad |= weight >= 25 and density > 0.5
        bad |= is_list and not listed and c["li"] >= 3 and density > 0.6 and n / c["li"] < 120 and heading < 0.5
        bad |= (c["embeds"] == 1 and n < 75) or c["embeds"] > 1 or (c["img"] == 0 and share("inner_text") == 0 and n == 0)
        if is_list and bad:
            elements = lambda k: sum(self.rows[x].tag != "#text" for x in self.kids.get(k, []))
            if not any(self.rows[k].tag != "#text" and elements(k) > 1 for k in self.kids.get(r.node, [])) and c["li"] == c["img"]:
                return False
        return bool(bad)


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(5)
    return cut(page_nodes(spark.createDataFrame([(i, random_page(r)) for i in range(300)], "page_id long, html string")))


def by_page(nodes):
    out = {}
    for r in nodes.collect():
        out.setdefault(r.page_id, []).append(r)
    return {k: Plain(v) for k, v in out.items()}


def test_data_tables(pages):
    got = {(r.page_id, r.node): (r.rows, r.columns, r.data) for r in C.data_tables(pages).collect()}
    want = {(k, n): t for k, p in by_page(pages).items() for n, t in p.tables.items()}
    assert got.keys() == want.keys() and {t[2] for t in want.values()} == {True, False}
    assert all(got[k][2] == t[2] and t[0] in (None, got[k][0]) for k, t in want.items())


def test_clutter_against_a_recursion(pages):
    rows = C.clutter(pages).collect()
    got = {(r.page_id, r.node): r for r in rows}
    want = {}
    for k, p in by_page(pages).items():
        p.visit(-1, False, False)
        want |= {(k, n): v for n, v in p.out.items()}
    assert got.keys() == want.keys() and len(got) == len(rows) > 900
    assert {g.goes for g in rows} == {True, False}
    # a figure counts as pictured by its images before any of them went, so that a removed one may tell them apart
    names = [c for c in C._COUNTS if not c.startswith("figure")]
    wrong = [(k, c, got[k][c], v[c]) for k, (v, _) in want.items() for c in names if abs(got[k][c] - v[c]) > 1e-6]
    assert not wrong, wrong[:5]
    different = [k for k, (_, goes) in want.items() if got[k].goes != goes]
    assert not different, different[:5]


def test_attempts(spark):
    long = "<p>" + "A sentence of the article, with commas, that goes on for a while. " * 6 + "</p>"
    page = [
        (1, f"<body><nav><ul><li><a href=/a>a</a></li></ul></nav><article>{long * 3}</article></body>"),
        (2, f"<body><div class='sidebar'>{long * 3}</div><p>Short text of twenty-five characters or more.</p></body>"),
        (3, "<body><article><p>Only a few words stand here, and no attempt finds more.</p></article></body>"),
        (4, f"<body><div>{long}<div class='related'><ul>" + "<li><a href=/x>Another story to read</a></li>" * 4 + f"</ul></div>{long * 2}</div></body>"),
        (5, "<body></body>"),
    ]
    nodes, chosen = A.content_attempts(cut(page_nodes(spark.createDataFrame(page, "page_id long, html string"))))
    got = {r.page_id: (r.attempt, r.chars) for r in chosen.collect()}
    assert got[1][0] == 0 and got[1][1] > 1000 and got[2][0] > 0 and got[2][1] > 1000 and got[3][0] == 0 and got[4][0] == 0
    text = {r.page_id: r.t for r in nodes.where("tag = '#text'").groupBy("page_id").agg(F.concat_ws("|", F.collect_list("text")).alias("t")).collect()}
    assert "Another story" not in text[4] and "Only a few" in text[3] and set(text) == {1, 2, 3, 4}


def test_climb_and_siblings(spark):
    para = "<p>" + "Words of a part, with a comma, and more of them to come. " * 5 + "</p>"
    page = [(1, f"<body><main><div class='part'>{para * 3}</div><div class='part'><span>{'Prose of the same kind without a paragraph. ' * 3}</span></div><p>{'A loose paragraph of prose that is long enough to be content by itself, it is. ' * 2}</p><div>x</div></main></body>")]
    nodes = A.content_nodes(cut(page_nodes(spark.createDataFrame(page, "page_id long, html string"))))
    text = " ".join(r.text for r in nodes.where("tag = '#text'").collect())
    assert "Prose of the same kind" in text and "A loose paragraph" in text


def test_grid_of_spans(spark):
    html = """<table><thead><tr><th rowspan=2>a</th><th colspan=2 align=center>b</th></tr><tr><th>c</th><th>d|e</th></tr></thead>
    <tr></tr><tr><td>1</td><td rowspan=9>2</td><td style="text-align: right">3</td></tr><tr><td> </td><td></td></tr><tr><td colspan=500>4</td></tr></table>
    <table><tr><td>layout</td></tr></table>"""
    cells = G.place_cells(G.page_cells(cut(page_nodes(spark.createDataFrame([(1, html)], "page_id long, html string")))), "page_id", "table")
    got = [(r.row, r.col, r.colspan, r.rowspan, r.header, r.text) for r in cells.orderBy("row", "at").collect()]
    assert got[:5] == [(0, 0, 1, 2, True, "a"), (0, 1, 2, 1, True, "b"), (1, 1, 1, 1, True, "c"), (1, 2, 1, 1, True, "d|e"), (2, 0, 1, 1, False, "1")]
    assert got[5:] == [(2, 1, 1, 2, False, "2"), (2, 2, 1, 1, False, "3"), (3, 0, 100, 1, False, "4")]
    r = G.header_rows(cells, "page_id", "table").collect()
    assert [(x.rows, x.columns, x.header_rows) for x in r] == [(4, 100, 2)]
    lines = G.markdown_tables(cells.where("row < 3"), "page_id", "table").first().markdown.split("\n")
    assert lines == ["| a | b |  |", "| --- | :-: | --- |", "|  | c | d\\|e |", "| 1 | 2 | 3 |"]


def test_more_cells_are_more_tasks_of_tables(spark, monkeypatch):
    """A task holds so many rows at most, with the tables as before."""
    from leafmill.plans import catalogue
    from tests.conftest import SF, rows_of

    whole = {name: catalogue.QUERIES[name](spark, SF).toArrow() for name in ("table_cells", "table_markdown")}
    for module in (catalogue, G):
        monkeypatch.setattr(module, "TASK_ROWS", 200)
    for name, want in whole.items():
        df = catalogue.QUERIES[name](spark, SF)
        assert df.rdd.getNumPartitions() >= 25
        assert rows_of(df.toArrow(), sorted(want.column_names)) == rows_of(want, sorted(want.column_names))


def test_texts_of_pages_are_read_once(spark):
    """Words of a line are cut once, lengths come before the rows of ancestors, and ends are trimmed as the pattern says."""
    from leafmill.functions import furniture as N
    from leafmill.functions import text as T
    from leafmill.operators import articles as A
    from leafmill.sources.pages import NODE_SCHEMA

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    lines = spark.createDataFrame([("get our free app",), ("Get the app now",), ("we get there",), ("",), (None,)], "text string").repartition(1)
    assert plan(lines.select(N.is_pitch(F.col("text")).alias("p"))).count("regexp_extract_all(") == 1
    assert [r[0] for r in lines.select(N.is_pitch(F.col("text"))).collect()] == [True, True, False, False, False]
    below = plan(A.subtree_text(spark.createDataFrame([], NODE_SCHEMA).repartition(1))).split("Generate", 1)
    assert "regexp_replace" not in below[0] and "regexp_replace" in below[1]
    odd = spark.createDataFrame([(a + "x　y" + b,) for a in ("", "﻿\n ", "​") for b in ("", " \x0b", " .")] + [(" \t",), ("",), (None,)], "s string")
    assert odd.where(~T.trim_space("s").eqNullSafe(F.regexp_replace("s", f"^[{T.SPACE}]+|[{T.SPACE}]+$", ""))).count() == 0
