"""Which elements of a page are its article: data tables, clutter that goes by its counts, and attempts with fewer rules.

Everything is computed over the node table. What an element counts is what stands
in its own region (down to the next elements that may go themselves), one grouped
sum for all of them, and what its kept inner elements hand up. Decisions run from
the innermost level to the outermost, over these few elements only: a level is a
join and a grouped sum, however many pages there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.session import cut

# Elements that may go, what they are counted by, and names in class and id.
CONDITIONAL = "form fieldset table ul ol div section aside header dl".split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
TEXT_TAGS, TEXT_BOXES = "span li td blockquote img p pre".split(), "dl div ol table ul".split()
PLAYERS, EMBEDDED, CODE = "pre math math-tex video audio".split(), "object embed iframe".split(), "pre code".split()
POSITIVE = "article body content entry hentry h-entry main page pagination post text blog story prose markdown rich-text richtext".split()
NEGATIVE = (
    "-ad- hidden banner combx comment com- contact footer gdpr masthead media meta outbrain promo related scroll share shoutbox sidebar skyscraper sponsor shopping tags widget newsletter "
    "subscribe taboola recirc byline author-bio toolbar breadcrumb disclaimer caption-credit"
).split()
CALLOUTS = "note tip warning caution important admonition callout alert info danger notice hint notecard".split()
NOTE_LISTS = "footnotes footnote-list footnotes-list endnotes references reflist refs footnote-definitions notes-list fn-list".split()
CLUTTER = (
    "mw-editsection editsection edit-section mw-jump-link catlinks printfooter navbox vertical-navbox ambox hatnote noprint share sharing social social-links sharedaddy share-buttons newsletter subscribe "
    "subscription signup sign-up optin opt-in related related-posts related-articles recommended recommendations more-stories read-more readmore read-next also-read further-reading-promo promo promoted "
    "sponsored advert advertisement ad-container ad-slot ad-unit ad-wrapper adsbygoogle dfp gpt-ad comments comment-list commentlist disqus breadcrumb breadcrumbs pagination post-tags entry-tags tag-list "
    "tags-list article-tags toc table-of-contents tableofcontents cookie consent gdpr regwall inline-cta cta author-bio about-author author-box authorbox post-author-bio byline dateline print skip-link "
    "toolbar nav navigation navbar sticky floating modal popup overlay outbrain taboola jp-relatedposts wp-block-buttons follow-us listen audio-player article-audio podcast-player rating reactions clap kudos"
).split()
CONTENT_BOXES = "article-body articlebody entry-content post-content story-body main-content article-content post-body".split()
ADS = ["ad", "advertising", "advertisement", "pub", "publicité", "werb", "werbung", "广告", "реклама", "anuncio"]
LOADING = ["loading", "正在加载", "загрузка", "chargement", "cargando"]
WEIGHT, HINT = 25, 30

#: What is added up for an element: name and kind.
_COUNTS = ["text", "link", "commas", "p", "img", "li", "input", "shielded", "embeds", "heading_text", "list_text", "inner_text", "figures", "figure_text", "figure_link", "ends"]


def _attr(name: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def _names() -> Column:
    return F.lower(F.concat_ws(" ", F.nullif(_attr("class"), F.lit("")), F.nullif(_attr("id"), F.lit(""))))


def _any_name(x: Column, names: list[str]) -> Column:
    """Whether a class or id is, or has as a part between blanks, dashes or underscores, one of the names."""
    return x.rlike(rf"(?:^|[\s_-])(?:{'|'.join(names)})(?:$|[\s_-])")


def _has(tags: Column, names: list[str]) -> Column:
    return F.arrays_overlap(tags, F.array(*map(F.lit, names)))


def _nearest(names: list[str]) -> Column:
    """The nearest ancestor of one of the names: its place in the path, from 1; null if there is none."""
    return F.array_max(F.transform("tags", lambda t, i: F.when(t.isin(names), i + 1)))


def class_weight() -> Column:
    """What class and id say for and against an element; the names of content boxes say it twice."""

    def side(x: Column) -> Column:
        hid = F.array_contains(F.split(x, " "), "hid")
        return F.when(x.rlike("|".join(POSITIVE)), WEIGHT).otherwise(0) - F.when(x.rlike("|".join(NEGATIVE)) | hid, WEIGHT).otherwise(0)

    cls = F.lower(_attr("class"))
    hint = F.arrays_overlap(F.split(cls, r"\s+"), F.array(*map(F.lit, CONTENT_BOXES))) | (F.lower(_attr("itemprop")) == "articlebody")
    return side(cls) + side(F.lower(_attr("id"))) + F.when(hint, HINT).otherwise(0)


def data_tables(nodes: DataFrame) -> DataFrame:
    """(page_id, node, rows, columns, data): every table, and whether it holds data rather than layout.

    A summary, a caption with something in it or parts of a header say so; else
    tables in tables and single rows or columns are layout, and ten rows, five
    columns or more than ten cells are data. Cells of an inner table are its own.
    """
    own = F.get("path", _nearest(["table"]) - 1)
    inside = nodes.where(F.array_contains("tags", "table")).select("page_id", own.alias("table"), "node", "parent", "tag", "attrs", F.element_at("tags", -1).alias("above"))
    span = F.greatest(F.coalesce(F.try_element_at("attrs", F.lit("colspan")).try_cast("int"), F.lit(1)), F.lit(0))
    cell = F.col("tag").isin("td", "th")
    row = F.when(F.col("tag") == "tr", F.col("node")).when(cell & (F.col("above") == "tr"), F.col("parent"))
    by_row = inside.groupBy("page_id", "table", row.alias("row")).agg(
        F.count_if(F.col("tag") == "tr").alias("rows"), F.sum(F.when(cell & (F.col("above") == "tr"), F.when(span > 0, span).otherwise(1))).alias("columns"),
        F.bool_or(F.col("tag").isin("col", "colgroup", "tfoot", "thead", "th") | (F.col("above") == "caption")).alias("header"), F.bool_or(F.col("tag") == "table").alias("nested"),
    )
    counts = by_row.groupBy("page_id", "table").agg(F.sum("rows").alias("rows"), F.max(F.when(F.col("row").isNotNull(), F.col("columns"))).alias("columns"), F.bool_or("header").alias("header"), F.bool_or("nested").alias("nested"))
    df = nodes.where("tag = 'table'").select("page_id", "node", "attrs").join(counts.withColumnRenamed("table", "node"), ["page_id", "node"], "left")
    rows, columns = F.coalesce("rows", F.lit(0)), F.coalesce("columns", F.lit(0))
    told = F.when((_attr("role") == "presentation") | (_attr("datatable") == "0"), False).when(_attr("summary") != "", True).when(F.coalesce("header", F.lit(False)), True).when(F.coalesce("nested", F.lit(False)), False)
    told = told.when((rows == 1) | (columns == 1), False).otherwise((rows >= 10) | (columns > 4) | (rows * columns > 10))
    return df.select("page_id", "node", rows.alias("rows"), columns.alias("columns"), told.alias("data"))


def is_note_list() -> Column:
    """Lists of footnotes, which are full of links by nature."""
    return (_attr("role") == "doc-endnotes") | F.map_contains_key("attrs", F.lit("data-footnotes")) | _any_name(_names(), NOTE_LISTS)


def _marked(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the nearest element above that may go (``owner``, -1: none), the tags ``between``, and what stands above: shields, links, figures."""
    tables = data_tables(nodes).where("data").select("page_id", F.col("node").alias("shield"))
    notes = nodes.where((F.col("tag") != "#text") & is_note_list()).select("page_id", F.col("node").alias("shield"))
    shields = tables.unionByName(notes).groupBy("page_id").agg(F.collect_set("shield").alias("shields"))  # of one page, as all that follows
    href = _attr("href")
    side = nodes.where(F.col("tag").isin("a", "img")).groupBy("page_id").agg(
        F.collect_set(F.when((F.col("tag") == "a") & (F.length(href) > 1) & href.startswith("#"), F.col("node"))).alias("here"),
        F.collect_set(F.when((F.col("tag") == "img") & F.array_contains("tags", "figure"), F.get("path", F.array_position("tags", "figure").cast("int") - 1))).alias("pictured"),
    )
    none = F.array().cast("array<int>")
    at = F.coalesce(_nearest(CONDITIONAL), F.lit(0))
    df = nodes.join(shields, "page_id", "left").join(side, "page_id", "left")
    df = df.select("page_id", "node", "parent", "path", "tags", "tag", "attrs", "text", *[F.coalesce(c, none).alias(c) for c in ("shields", "here", "pictured")], at.alias("at"))
    between = F.slice("tags", F.col("at") + 1, F.greatest(F.size("tags") - F.col("at"), F.lit(0)))
    above = F.slice("path", F.col("at") + 1, F.greatest(F.size("path") - F.col("at"), F.lit(0)))
    return df.select(
        "page_id", "node", "parent", "path", "tags", "tag", "attrs", "text", F.when(F.col("at") > 0, F.get("path", F.col("at") - 1)).otherwise(-1).alias("owner"),
        F.when(_has(between, ["a"]), F.when(F.arrays_overlap(above, "here"), 0.3).otherwise(1.0)).otherwise(0.0).alias("linked"),
        _has(between, HEADINGS).alias("headed"), _has(between, TEXT_TAGS).alias("inner"), F.arrays_overlap(above, "pictured").alias("shown"),
        (_has(F.col("tags"), CODE) | F.arrays_overlap("path", "shields")).alias("shielded_above"), F.array_contains("shields", F.col("node")).alias("shield"), F.array_contains("pictured", F.col("node")).alias("picture"),
    )


def _regions(marked: DataFrame) -> DataFrame:
    """(page_id, owner, counts..., words): sums over what stands below an element and below no inner one that may go."""
    text, tag = F.col("tag") == "#text", F.col("tag")
    n, commas, ends = F.col("n"), F.col("n_commas"), F.col("n_ends")  # columns of their own: each text is read once, not once for each sum
    marked = marked.withColumns({
        "n": F.when(text, T.visible_length("text")).otherwise(0).cast("double"), "n_commas": F.when(text, T.comma_count("text")),
        "n_ends": F.when(text, F.regexp_count("text", F.lit("[.!?。！？][\"'”’)\\]]*(?:\\s|$)"))),
    })
    one = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("double")
    total = lambda what, test=None: F.sum(what if test is None else F.when(test, what).otherwise(0)).cast("double")
    frame = _is_content_frame()
    return marked.groupBy("page_id", "owner").agg(
        total(n).alias("text"), total(n * F.col("linked")).alias("link"), total(commas, text).alias("commas"), one(tag == "p").alias("p"), one(tag == "img").alias("img"), one(tag == "li").alias("li"),
        one((tag == "input") & (F.lower(_attr("type")) != "checkbox")).alias("input"), one(tag.isin(PLAYERS) | frame).alias("shielded"), one(tag.isin(EMBEDDED) & ~frame).alias("embeds"),
        total(n, F.col("headed")).alias("heading_text"), F.lit(0.0).alias("list_text"), total(n, F.col("inner")).alias("inner_text"), one((tag == "figure") & F.col("picture") & ~F.col("shown")).alias("figures"),
        total(n, F.col("shown")).alias("figure_text"), total(n * F.col("linked"), F.col("shown")).alias("figure_link"), total(ends, text).alias("ends"),
        F.array_sort(F.collect_list(F.when(text, F.struct("node", "text")))).alias("words"),
    )


def _is_content_frame() -> Column:
    """Frames that hold a player of their own or of a known provider."""
    src = F.coalesce(F.nullif(_attr("data-src"), F.lit("")), _attr("src"))
    host = F.regexp_extract(src, r"^(?:https?:)?//(?:www\.)?([^/?#]+)", 1)
    known = ["youtube.com", "youtube-nocookie.com", "player.vimeo.com", "dailymotion.com", "loom.com", "fast.wistia.net", "embed.ted.com", "player.twitch.tv", "open.spotify.com", "w.soundcloud.com"]
    return (F.col("tag") == "iframe") & host.isin(known)


def _goes() -> Column:
    """Whether an element goes, by its counts; the order of the rules matters."""
    c = F.col
    weight = c("weight")
    tag = c("tag")
    share = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(0.0)
    is_list = tag.isin("ul", "ol") | ((c("text") > 0) & (c("list_text") / c("text") > 0.9))
    listed = tag.isin("ul", "ol")
    links = F.least(share("link", "text"), F.lit(1.0))
    heading, inner = share("heading_text", "text"), share("inner_text", "text")
    said = F.lower(F.trim("said"))
    bad = (
        (~c("in_figure") & (c("img") > 1) & (c("p") / c("img") < 0.5))
        | (~is_list & (c("li") - 100 > c("p")))
        | (c("input") > F.floor(c("p") / 3))
        | (~is_list & ~c("in_figure") & (heading < 0.9) & (c("text") < 25) & ((c("img") == 0) | (c("img") > 2)) & (links > 0))
        | (~is_list & (weight < 25) & (links > 0.2) & ~((links <= 0.3) & (c("p") > 0) & (c("heading_text") > 0) & (c("text") - c("heading_text") >= 150) & (c("ends") >= 2)))
        | ((weight >= 25) & (links > 0.5))
        | (is_list & ~listed & (c("li") >= 3) & (links > 0.6) & (c("text") / c("li") < 120) & (heading < 0.5))
        | ((c("embeds") == 1) & (c("text") < 75)) | (c("embeds") > 1)
        | ((c("img") == 0) & (inner == 0) & (c("text") == 0))
    )
    gallery = is_list & ~c("rich_child") & (c("li") == c("img"))
    return (
        F.when(c("shield") | c("shielded_above") | (c("shielded") > 0), False)
        .when((c("figures") > 0) & (c("text") - c("figure_text") < 25) & (c("figure_link") <= c("figure_text") * 0.5) & (c("input") == 0), False)
        .when(weight < 0, True)
        .when((c("p") > 0) & (c("link") <= c("text") * 0.6) & (c("input") == 0) & c("callout"), False)
        .when(~listed & (c("heading_text") > 0) & (c("li") >= 2) & (c("text") - c("list_text") <= c("heading_text") + 30) & (c("link") >= (c("text") - c("heading_text")) * 0.7), True)
        .when(c("commas") >= 10, False)
        .when((c("heading_text") > 0) & (c("text") - c("link") <= c("heading_text") * 1.2), False)
        .when((c("text") < 40) & (said.isin(ADS) | F.regexp_replace(said, r"(?:…|\.\.\.)$", "").isin(LOADING)), True)
        .when(gallery, False)
        .otherwise(bad)
    )


def clutter(nodes: DataFrame, weigh: Column | None = None) -> DataFrame:
    """(page_id, node, tag, counts..., goes) of every element that may go by what it holds, counted without inner ones that went.

    ``nodes``: the nodes below content roots; a root's parents are not among
    them. ``weigh``: whether class and id count for and against. Levels run from the innermost outwards;
    elements without an answer yet are never read again.
    """
    if nodes.where(F.col("tag").isin(CONDITIONAL)).isEmpty():
        return nodes.limit(0).select("page_id", "node", "tag", *[F.lit(0.0).alias(c) for c in _COUNTS], F.lit(False).alias("goes"))
    marked = cut(_marked(nodes))
    regions = _regions(marked).withColumnRenamed("owner", "node")
    kids = marked.where("tag <> '#text'").groupBy("page_id", F.col("parent").alias("child")).agg(F.count(F.lit(1)).alias("kids")).where("kids > 1")
    rich = marked.where("tag <> '#text'").select("page_id", F.col("node").alias("child"), F.col("parent").alias("node")).join(kids, ["page_id", "child"]).select("page_id", "node").distinct().withColumn("rich_child", F.lit(True))
    names = _names()
    elements = marked.where(F.col("tag").isin(CONDITIONAL)).select(
        "page_id", "node", "owner", "tag", "linked", "headed", "inner", "shown", "shielded_above", "shield", F.array_contains("tags", "figure").alias("in_figure"), F.when(F.lit(True) if weigh is None else weigh, class_weight()).otherwise(0).alias("weight"),
        (_any_name(names, CALLOUTS) & (F.length(names) > 1)).alias("callout"), F.size(F.filter("tags", lambda t: t.isin(CONDITIONAL))).alias("level"),
    )
    elements = elements.join(regions, ["page_id", "node"], "left").join(rich, ["page_id", "node"], "left").withColumn("rich_child", F.coalesce("rich_child", F.lit(False)))
    elements = cut(elements.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in _COUNTS}))
    deepest = elements.agg(F.max("level")).first()[0]
    handed = None
    done = []
    for level in range(deepest, -1, -1):
        here = elements.where(F.col("level") == level)
        if handed is not None:
            sums = handed.groupBy("page_id", F.col("owner").alias("node")).agg(*[F.sum(c).alias(f"more_{c}") for c in _COUNTS], F.flatten(F.collect_list("words")).alias("more_words"))
            here = here.join(sums, ["page_id", "node"], "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0.0)) for c in _COUNTS})
            here = here.withColumn("words", F.concat(F.coalesce("words", F.array().cast("array<struct<node:int,text:string>>")), F.coalesce("more_words", F.array().cast("array<struct<node:int,text:string>>"))))
        said = F.when(F.col("text") < 40, F.array_join(F.transform(F.array_sort("words"), lambda w: w["text"]), ""))
        here = cut(here.withColumn("said", said).withColumn("goes", F.coalesce(_goes(), F.lit(False))).select(*elements.columns, "said", "goes"))
        done.append(here.select("page_id", "node", "tag", *_COUNTS, "goes"))
        up = here.where(~F.col("goes"))
        text, c = F.col("text"), F.col
        boxed = c("tag").isin(TEXT_BOXES) | c("inner")
        handed = up.select(
            "page_id", "owner", "text", F.when(c("linked") > 0, text * c("linked")).otherwise(c("link")).alias("link"), "commas", "p", "img", "li", "input", (c("shielded") + F.when((c("tag") == "table") & c("shield"), 1).otherwise(0)).alias("shielded"), "embeds",
            F.when(c("headed"), text).otherwise(c("heading_text")).alias("heading_text"), F.when(c("tag").isin("ul", "ol"), text).otherwise(c("list_text")).alias("list_text"), F.when(boxed, text).otherwise(c("inner_text")).alias("inner_text"),
            F.when(c("shown"), 0.0).otherwise(c("figures")).alias("figures"), F.when(c("shown"), text).otherwise(c("figure_text")).alias("figure_text"), F.when(c("shown"), c("link")).otherwise(c("figure_link")).alias("figure_link"), "ends",
            F.when(text < 40, c("words")).otherwise(F.array().cast("array<struct<node:int,text:string>>")).alias("words"),
        )
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
