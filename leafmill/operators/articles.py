"""Articles from pages: metadata, content, blocks, text and Markdown as joins and aggregates over page nodes.

``sources.pages.page_nodes`` gives the nodes; each carries the ids and tags of
its ancestors, so subtree sums are an explode and a grouped sum, and pruning is
a test on arrays of one page's ids. Nothing is larger than a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import dates as D
from leafmill.functions import furniture as N
from leafmill.functions import images as I
from leafmill.functions import text as T
from leafmill.functions import urls as U
from leafmill.operators import content as C
from leafmill.session import cut
from leafmill.sources.pages import BLOCK, page_nodes

#: Names in class and id that speak against and for content, tags that hold none, and base scores.
UNLIKELY = (
    r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|combx|comments?|community|cookie\w*|disqus|footer|gdpr|legends|menu|nav\w*|newsletter|pager|pagination|popup|promo|related|"
    r"remark|rss|share\w*|shoutbox|sidebar|skyscraper|social|sponsor\w*|subscribe|supplemental|toolbar|widget)(?:$|[\s_-])"
)
LIKELY = r"(?i)(?:^|[\s_-])(?:article\w*|blog|body|column|content|entry|main|page|post|story|text)(?:$|[\s_-])"
NO_CONTENT_TAGS = "nav footer aside form dialog menu".split()
NO_CONTENT_ROLES = "alert alertdialog banner complementary contentinfo dialog menu menubar navigation search tooltip".split()
TAG_SCORES = {"div": 5, "article": 10, "main": 8, "section": 2, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3, "form": -3, "th": -5}
LEAVES = "p pre td blockquote li h1 h2 h3 h4 h5 h6 dd figcaption".split()
MARKS = {"strong": "bold", "b": "bold", "em": "italic", "i": "italic", "code": "code", "kbd": "code", "samp": "code", "sub": "sub", "sup": "sup", "s": "strike", "del": "strike", "u": "underline", "mark": "highlight", "a": "link"}
MARK_ORDER = "link bold italic underline strike highlight sub sup code".split()
MIN_TEXT = 50

_BLOCKS = sorted(BLOCK)


def _has(tags: Column, names: list[str]) -> Column:
    return F.arrays_overlap(tags, F.array(*[F.lit(n) for n in names]))


def _attr(name: str, attrs: str = "attrs") -> Column:
    return F.coalesce(F.try_element_at(attrs, F.lit(name)), F.lit(""))


def metadata(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per page: title, site, byline, dates, language, description, lead image, canonical address, and ``ld`` titles."""
    value = F.trim(_attr("content"))
    key = F.lower(F.coalesce(F.nullif(_attr("property"), F.lit("")), F.nullif(_attr("name"), F.lit("")), F.nullif(_attr("itemprop"), F.lit(""))))
    first = lambda test, what, name: F.min_by(what, F.when(test, F.col("node"))).alias(name)
    tag = F.col("tag")
    json = F.regexp_replace("text", r"^\s*(?:<!--|//<!\[CDATA\[)|(?:-->|//\]\]>)\s*$", "")
    heads = nodes.where(tag.isin("meta", "html", "link", "time", "script") | ((tag == "#text") & F.array_contains("tags", "title")))
    # a page's head is small; one pass gathers all of it
    heads = heads.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.when((tag == "meta") & key.isNotNull() & (value != ""), F.struct("node", key.alias("key"), value.alias("value"))))).alias("metas"),
        first((tag == "#text") & (F.element_at(F.concat(F.array(F.lit("")), "tags"), -1) == "title"), F.col("text"), "title_text"),
        first(tag == "html", _attr("lang"), "html_lang"),
        first((tag == "link") & (F.lower(_attr("rel")) == "canonical"), _attr("href"), "canonical"),
        first((tag == "link") & F.lower(_attr("rel")).rlike(r"(^|\s)icon(\s|$)"), _attr("href"), "icon"),
        first((tag == "time") & (_attr("datetime") != ""), _attr("datetime"), "clock"),
        first((tag == "script") & F.col("text").isNotNull(), json, "j"),
    )
    pick = lambda p: F.expr(f"coalesce(try_variant_get(v, '$.{p}', 'string'), try_variant_get(v, '$[0].{p}', 'string'), try_variant_get(v, '$[\"@graph\"][0].{p}', 'string'))")
    listed = [f"transform(try_variant_get(v, '{at}.author', 'array<variant>'), a -> coalesce(try_variant_get(a, '$.name', 'string'), try_variant_get(a, '$', 'string')))" for at in ("$", "$[0]", "$[\"@graph\"][0]")]
    ld = F.struct(F.coalesce(*map(F.expr, listed)).alias("authors"), pick("headline").alias("headline"), F.coalesce(pick("author.name"), pick("author[0].name"), pick("author")).alias("author"), pick("datePublished").alias("published"),
        pick("dateModified").alias("modified"), pick("publisher.name").alias("publisher"), pick("articleBody").alias("body"), pick("inLanguage").alias("language"))
    heads = heads.withColumn("v", F.expr("try_parse_json(j)")).withColumn("ld", ld).drop("v", "j")
    df = pages.select("page_id", "url").join(heads, "page_id", "left")
    named = lambda n: F.try_element_at(F.filter("metas", lambda x: x["key"] == n), F.lit(1))["value"]
    m = lambda *names: F.coalesce(*map(named, names))
    # what the tags say, each worked out once, before it is put into form
    said = df.select(
        "page_id", "url", T.collapse(F.coalesce(m("og:title", "twitter:title"), F.col("ld.headline"), "title_text", m("title"), F.lit(""))).alias("full"),
        T.collapse(F.coalesce(m("og:site_name", "application-name"), F.col("ld.publisher"))).alias("site_name"),
        F.coalesce(F.array_compact(F.array(m("author", "article:author", "parsely-author"))), F.array()).alias("tagged"), F.coalesce("ld.authors", F.array("ld.author")).alias("listed"),
        F.coalesce(m("article:published_time", "datepublished", "date", "pubdate"), F.col("ld.published"), "clock").alias("published"),
        F.coalesce(m("article:modified_time", "datemodified"), F.col("ld.modified")).alias("modified"),
        F.lower(F.coalesce(F.nullif("html_lang", F.lit("")), m("og:locale", "language"), F.col("ld.language"))).alias("language"),
        T.collapse(m("og:description", "description", "twitter:description")).alias("description"), m("og:image", "twitter:image").alias("image"),
        F.nullif("icon", F.lit("")).alias("icon"), F.nullif("canonical", F.lit("")).alias("link"), m("og:url").alias("og_url"), F.col("ld.body").alias("ld_body"),
    )
    # names that the tags hold; where they hold none, those of the structured data
    names, other = N.author_names(F.col("tagged")), N.author_names(F.array_compact("listed"))
    byline = F.nullif(F.array_join(F.when(F.size(names) > 0, names).otherwise(other), ", "), F.lit(""))
    return said.select(
        "page_id", "url", clean_title(F.col("full"), F.col("site_name")).alias("title"), "site_name", byline.alias("byline"),
        D.normalize_date("published").alias("published_at"), D.normalize_date("modified").alias("modified_at"), F.nullif(F.regexp_replace("language", "_", "-"), F.lit("")).alias("language"), "description",
        absolute(F.col("image"), F.col("url")).alias("lead_image"), absolute(F.col("icon"), F.col("url")).alias("favicon"),
        U.canonical_url(F.coalesce(absolute(F.col("link"), F.col("url")), "og_url", "url")).alias("canonical"), "ld_body",
    )


def clean_title(title: Column, site: Column) -> Column:
    """The title without the site's name at either end of a separator."""
    pieces = F.split(title, r"\s+[|·»–—:-]\s+")
    is_site = lambda p: T.comparable(p) == T.comparable(site)
    kept = F.regexp_replace(title, r"\s+[|·»–—:-]\s+[^|·»–—]*$", "")
    lead = F.regexp_replace(title, r"^[^|·»–—:]*?\s+[|·»–—:-]\s+", "")
    return F.when((F.size(pieces) > 1) & is_site(F.element_at(pieces, -1)), kept).when((F.size(pieces) > 1) & is_site(pieces[0]), lead).otherwise(title)


def _once(value: Column, make) -> Column:  # noqa: ANN001
    """``make`` of a value that is worked out once and named once in the plan."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def absolute(href: Column, base: Column) -> Column:
    """``href`` resolved against a page's address; null for schemes other than http(s), mailto, tel and data."""

    def joined(x: Column) -> Column:
        out = F.concat(x["origin"], F.when(x["folder"] == "", "/").otherwise(x["folder"]), x["h"])
        for _ in range(4):  # ../ steps
            out = F.regexp_replace(out, r"(://[^/]+(?:/[^/?#]+)*?)/(?!\.\./)[^/?#]+/\.\./", "$1/")
        return F.regexp_replace(out, r"/(?:\./)+", "/")

    def resolved(x: Column) -> Column:
        h, base = x["h"], x["base"]
        return (
            F.when(h == "", None).when(h.rlike("(?i)^(?:https?://|mailto:|tel:|data:)"), h).when(h.rlike("(?i)^[a-z][a-z0-9+.-]*:"), None)
            .when(h.startswith("//"), F.concat(F.regexp_extract(base, "^[^:]+:", 0), h)).when(h.startswith("/"), F.concat(x["origin"], h))
            .when(h.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), h)).when(h.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), h)).otherwise(joined(x))
        )

    h = F.replace(F.regexp_replace(F.trim(href), r"[\t\n\r]", ""), F.lit(" "), F.lit("%20"))
    origin = F.regexp_extract(base, r"(?i)^https?://[^/?#]+", 0)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"(?i)^https?://[^/]+(/.*/|/)", 1)
    return F.when(href.isNotNull(), _once(F.struct(h.alias("h"), base.alias("base"), origin.alias("origin"), folder.alias("folder")), resolved))


def unlikely_nodes(nodes: DataFrame) -> DataFrame:
    """(page_id, node): elements that by tag, role or name hold no content; their subtrees go with them."""
    name = F.concat_ws(" ", _attr("class"), _attr("id"))
    by_name = name.rlike(UNLIKELY) & ~name.rlike(LIKELY) & ~F.col("tag").isin("body", "html", "article", "main", "a")
    role = F.lower(_attr("role")).isin(NO_CONTENT_ROLES)
    tag = F.col("tag").isin(NO_CONTENT_TAGS) | ((F.col("tag") == "header") & ~_has(F.col("tags"), ["article", "main"]))
    return nodes.where(F.col("tag") != "#text").where(tag | role | by_name).select("page_id", "node")


def pruned(nodes: DataFrame, strip: bool = True) -> DataFrame:
    """``nodes`` of the body; with ``strip`` outside of unlikely subtrees."""
    df = nodes.where(~_has(F.col("tags"), ["head"]) & ~F.col("tag").isin("head", "html", "meta", "link", "title", "base"))
    if not strip:
        return df
    bad = unlikely_nodes(nodes).groupBy("page_id").agg(F.collect_list("node").alias("bad"))  # of one page
    gone = F.coalesce(F.arrays_overlap(F.concat("path", F.array("node")), "bad"), F.lit(False))
    return df.join(bad, "page_id", "left").where(~gone).drop("bad")


def subtree_text(nodes: DataFrame) -> DataFrame:
    """(page_id, node, chars, link_chars, commas) of every element: sums over the texts below it."""
    t = nodes.where("tag = '#text'").select("page_id", "path", T.visible_length("text").alias("n"), T.comma_count("text").alias("c"), _has(F.col("tags"), ["a"]).alias("linked"))
    t = t.select("page_id", F.explode("path").alias("node"), "n", "c", "linked")  # a text is counted once, not once for each element above it
    return t.groupBy("page_id", "node").agg(F.sum("n").alias("chars"), F.sum(F.when(F.col("linked"), F.col("n")).otherwise(0)).alias("link_chars"), F.sum("c").alias("commas"))


def scored_elements(nodes: DataFrame, weigh: Column) -> tuple[DataFrame, DataFrame]:
    """(page_id, node, parent, tag, score) of elements with content below them, and the sums of their texts.

    Every leaf block with 25 characters scores by commas and length; its five
    nearest ancestors get 1, 1/2 and 1/(3 * level) of that, less their share of
    link text. ``weigh``: whether class and id count.
    """
    stats = cut(subtree_text(nodes))
    leaf = nodes.where(F.col("tag").isin(LEAVES)).join(stats, ["page_id", "node"]).where("chars >= 25")
    gain = 2 + F.col("commas") + F.least(F.floor(F.col("chars") / 100), F.lit(3))
    up = F.slice(F.reverse("path"), 1, 5)
    spread = leaf.select("page_id", gain.alias("gain"), F.posexplode(up).alias("level", "node"))
    share = F.when(F.col("level") == 0, 1.0).when(F.col("level") == 1, 0.5).otherwise(1 / (3.0 * F.col("level")))
    sums = spread.groupBy("page_id", "node").agg(F.sum(F.col("gain") * share).alias("gain"))
    name = F.concat_ws(" ", _attr("class"), _attr("id"))
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for k, x in TAG_SCORES.items() for v in (k, x)]), "tag"), F.lit(0))
    base = base + F.when(weigh, F.when(name.rlike(LIKELY), 25).otherwise(0) - F.when(name.rlike(UNLIKELY), 25).otherwise(0)).otherwise(0)
    elements = nodes.where("tag <> '#text'").select("page_id", "node", "parent", "tag", base.alias("base"))
    scored = sums.join(elements, ["page_id", "node"]).join(stats, ["page_id", "node"])
    score = (F.col("gain") + F.col("base")) * (1 - F.col("link_chars") / F.greatest("chars", F.lit(1)))
    return scored.select("page_id", "node", "parent", "tag", score.alias("score")), stats


def content_roots(nodes: DataFrame, weigh: Column) -> DataFrame:
    """(page_id, node): the element with the best score, an ancestor that scores more still, and siblings that are content too.

    The body itself wins where its paragraphs stand in it directly: with twice
    the best score. On the way up from the best element the first ancestor that
    scores more than the one before it is taken, unless one below a third of
    the best comes first. A sibling joins by its score (more easily if it has the
    same class), by prose under the same class, or as a paragraph of prose.
    """
    scored, stats = scored_elements(nodes, weigh)
    scored = cut(scored)
    best = lambda df: df.groupBy("page_id").agg(F.max_by(F.struct("node", "parent", "score"), F.struct("score", -F.col("node"))).alias("top"))
    body = best(scored.where("tag = 'body'")).select("page_id", F.col("top").alias("body"))
    top = best(scored.where("tag <> 'body'")).join(body, "page_id", "full")
    top = top.select("page_id", F.when(F.col("top").isNull() | (F.col("body.score") >= 2 * F.col("top.score")), F.col("body")).otherwise(F.col("top")).alias("top"))
    above = top.select("page_id", "top.node").join(nodes.select("page_id", "node", "path"), ["page_id", "node"]).select("page_id", F.posexplode("path").alias("depth", "node"))
    ladder = above.join(scored.where("tag <> 'body'"), ["page_id", "node"]).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("depth", "score", "node", "parent")), asc=False).alias("ladder"))  # of one element
    top = top.join(ladder, "page_id", "left")
    least = F.col("top.score") / 3
    start = F.struct(F.col("top.score").alias("last"), F.lit(False).alias("over"), F.col("top").alias("pick"))

    def climb(s: Column, x: Column) -> Column:
        here = F.struct(x["node"].alias("node"), x["parent"].alias("parent"), x["score"].alias("score"))
        return F.when(s["over"] | (x["score"] < least), F.struct(s["last"].alias("last"), F.lit(True).alias("over"), s["pick"].alias("pick"))).when(
            x["score"] > s["last"], F.struct(x["score"].alias("last"), F.lit(True).alias("over"), here.alias("pick"))
        ).otherwise(F.struct(x["score"].alias("last"), F.lit(False).alias("over"), s["pick"].alias("pick")))

    picked = F.when(F.col("ladder").isNull(), F.col("top")).otherwise(F.aggregate("ladder", start, climb)["pick"])
    top = top.select("page_id", picked.alias("top")).select("page_id", "top.*")
    sibling = nodes.where("tag <> '#text'").select("page_id", F.col("node").alias("kin"), "parent", "tag", _attr("class").alias("class"))
    own = sibling.select("page_id", F.col("kin").alias("node"), F.col("class").alias("own_class"))
    kin = sibling.join(scored.select("page_id", F.col("node").alias("kin"), F.col("score").alias("kin_score")), ["page_id", "kin"], "left").join(stats.withColumnRenamed("node", "kin"), ["page_id", "kin"], "left")
    near = top.where("parent >= 0").join(own, ["page_id", "node"]).join(kin, ["page_id", "parent"])
    bonus = F.when((F.col("class") != "") & (F.col("class") == F.col("own_class")), F.col("score") * 0.2).otherwise(0.0)
    chars, links = F.coalesce("chars", F.lit(0)), F.coalesce(F.col("link_chars") / F.nullif("chars", F.lit(0)), F.lit(0.0))
    more = (F.col("kin_score") + bonus >= F.greatest(F.lit(10.0), F.col("score") * 0.2)) | ((bonus > 0) & (chars > 50) & (links < 0.3)) | ((F.col("tag") == "p") & (chars > 80) & (links < 0.25))
    near = near.where((F.col("kin") == F.col("node")) | F.coalesce(more, F.lit(False)))
    return top.select("page_id", "node").unionByName(near.select("page_id", F.col("kin").alias("node"))).distinct()


#: A text of this many characters ends the attempts.
ENOUGH = 500


def _attempt(nodes: DataFrame, strip: bool, weigh: Column, clean: Column) -> DataFrame:
    """The nodes of each page's content by one set of rules. A page without scored content keeps its body."""
    body = cut(pruned(nodes, strip))  # five branches of the scoring read it
    roots = content_roots(body, weigh).groupBy("page_id").agg(F.collect_list("node").alias("roots"))  # few to a page
    df = body.join(roots, "page_id", "left")
    kept = cut(df.where(F.col("roots").isNull() | F.arrays_overlap("path", "roots") | F.array_contains("roots", F.col("node"))).drop("roots"))
    gone = C.clutter(kept, weigh).where("goes").select("page_id", "node").join(roots, "page_id", "left").where(clean & ~F.coalesce(F.array_contains("roots", F.col("node")), F.lit(False)))
    gone = gone.groupBy("page_id").agg(F.collect_list("node").alias("gone"))  # of one page
    return cut(kept.join(gone, "page_id", "left").where(~F.coalesce(F.arrays_overlap(F.concat("path", F.array("node")), "gone"), F.lit(False))).drop("gone"))


def content_attempts(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of each page's content, and (page_id, attempt, chars): by which set of rules it was found, with how much text.

    0 leaves out unlikely elements, weighs names and removes clutter; 1 keeps
    unlikely elements, 2 doesn't weigh names either, 3 removes no clutter. The
    first that finds 500 characters counts, else the one that finds most, of
    equals the first. Pages that 0 answers are not tried again; for the others 1
    to 3 are one pass, in which an attempt is a page of its own.
    """
    chars = lambda df: df.groupBy("page_id").agg(F.sum(F.when(F.col("tag") == "#text", T.visible_length("text")).otherwise(0)).alias("chars"))
    pages = nodes.select("page_id").distinct()
    first = _attempt(nodes, True, F.lit(True), F.lit(True))
    found = cut(pages.join(chars(first), "page_id", "left").select("page_id", F.lit(0).alias("attempt"), F.coalesce("chars", F.lit(0)).alias("chars")))
    short = found.where(F.col("chars") < ENOUGH).select("page_id")
    if short.isEmpty():
        return first, found
    tries = nodes.join(short, "page_id", "left_semi").withColumn("k_", F.explode(F.array(*map(F.lit, (1, 2, 3))))).withColumn("page_id", F.col("page_id") * 4 + F.col("k_")).drop("k_")
    k = F.pmod("page_id", F.lit(4))
    again = _attempt(cut(tries), False, k == 1, k < 3)
    plain = F.floor((F.col("page_id") - k) / 4)
    more = chars(again).select(plain.alias("page_id"), k.cast("int").alias("attempt"), "chars")
    enough = F.col("chars") >= ENOUGH
    rank = F.struct(enough.cast("int").alias("enough"), F.when(enough, 0).otherwise(F.col("chars")).alias("most"), (-F.col("attempt")).alias("first"))
    chosen = cut(found.unionByName(more).groupBy("page_id").agg(F.max_by(F.struct("attempt", "chars"), rank).alias("c")).select("page_id", "c.*"))
    other = again.withColumn("attempt", k.cast("int")).withColumn("page_id", plain).join(chosen.select("page_id", "attempt"), ["page_id", "attempt"], "left_semi").drop("attempt")
    return first.join(chosen.where("attempt = 0"), "page_id", "left_semi").unionByName(other.select(*first.columns)), chosen


def content_nodes(nodes: DataFrame) -> DataFrame:
    """The nodes of each page's content (``content_attempts``)."""
    return content_attempts(nodes)[0]


def _nearest(names: list[str]) -> Column:
    """struct(node, tag) of the nearest ancestor of one of the names."""
    both = F.arrays_zip(F.col("path").alias("node"), F.col("tags").alias("tag"))
    return F.element_at(F.filter(both, lambda x: x["tag"].isin(names)), -1)


def inlines(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, node, block, block_tag, type, text, marks, href, src, small, alt): texts, breaks and images in order, with their block.

    Placeholders, tracking pixels and decorative images are left out."""
    base = nodes.where((F.col("tag").isin("#text", "br", "img", "hr", "iframe", "math", "video", "audio")) & ~(F.col("tag").eqNullSafe("#text") & F.element_at(F.concat(F.array(F.lit("")), "tags"), -1).isin("ul", "ol", "table", "tr", "tbody", "thead", "dl", "html")))
    near = F.when(F.size("path") > 0, _nearest(_BLOCKS))
    kinds = F.create_map(*[F.lit(v) for k, x in MARKS.items() for v in (k, x)])
    marks = F.array_distinct(F.array_compact(F.transform("tags", lambda t: F.try_element_at(kinds, t))))
    ordered = F.filter(F.array(*[F.lit(m) for m in MARK_ORDER]), lambda m: F.array_contains(marks, m))
    media = F.lower(_attr("media"))
    offered = nodes.where("tag = 'source'").where(~F.lower(_attr("type")).isin("image/avif", "image/jxl") & ~(media.contains("max-width") & ~media.contains("min-width")))
    offered = offered.withColumn("offer", I.source_set(F.col("attrs"))).where("offer is not null").groupBy("page_id", "parent").agg(F.min_by("offer", "node").alias("offer"))
    links = nodes.where("tag = 'a'").select("page_id", F.col("node").alias("a"), _attr("href").alias("raw_href"))
    df = base.select("page_id", "node", near["node"].alias("block"), near["tag"].alias("block_tag"), "tag", "parent", "text", "attrs", "path", "tags", ordered.alias("marks"), F.when(_has(F.col("tags"), ["a"]), _nearest(["a"])["node"]).alias("a"))
    df = df.join(links, ["page_id", "a"], "left").join(offered, ["page_id", "parent"], "left").join(pages.select("page_id", "url"), "page_id")
    attrs = F.col("attrs")
    df = df.withColumn("found", F.when(F.col("tag") == "img", I.candidates(F.coalesce(I.source_set(attrs), "offer"))))
    kind = F.when(F.col("tag") == "#text", "text").when(F.col("tag") == "br", "break").when(F.col("tag") == "img", "image").when(F.col("tag") == "hr", "rule").when(F.col("tag") == "iframe", "embed").otherwise(F.col("tag"))
    # each long expression is a column before another one repeats it: plans grow with repetition
    given = F.coalesce(F.nullif(_attr("data-src"), F.lit("")), F.nullif(_attr("src"), F.lit("")))
    df = df.withColumn("raw_src", F.when(F.col("tag") == "img", I.shown(attrs, F.col("found"))).when(F.col("tag").isin("iframe", "video", "audio"), given))
    df = df.withColumn("width", F.when(F.col("tag") == "img", I.dimension(attrs, "width"))).withColumn("height", F.when(F.col("tag") == "img", I.dimension(attrs, "height")))
    df = df.withColumn("src", absolute(F.col("raw_src"), F.col("url"))).withColumn("href", absolute(F.col("raw_href"), F.col("url")))
    sides = {"width": F.col("width"), "height": F.col("height")}
    chrome = I.is_pixel(attrs, F.col("src"), **sides) | I.is_decorative(attrs, F.col("src"), F.col("href"), F.col("width")) | F.col("src").isNull()
    df = df.where((F.col("tag") != "img") | ~chrome)
    return df.select(
        "page_id", "node", "block", "block_tag", kind.alias("type"), "text", "marks", "href", "src", ((F.col("tag") == "img") & I.is_small(attrs, **sides)).alias("small"), F.nullif(_attr("alt"), F.lit("")).alias("alt"), "path", "tags",
    )


#: Block types by the nearest block's tag; others are paragraphs.
_TYPES = {**{f"h{i}": "heading" for i in range(1, 7)}, "li": "list", "pre": "code", "blockquote": "quote", "td": "table", "th": "table", "dt": "definitions", "dd": "definitions", "figcaption": "figure", "summary": "details", "hr": "rule"}


def _span(x: Column) -> Column:
    """Markdown of one run: escaped text inside its marks; white space stays outside of them."""
    plain = F.regexp_replace(x["text"], r"([\\`*_\[\]<>])", r"\\$1")
    core, lead, trail = F.trim(plain), F.regexp_extract(plain, r"^(\s*)", 1), F.regexp_extract(plain, r"(\s*)$", 1)
    has = lambda m: F.array_contains(x["marks"], m)
    s = F.when(has("code"), F.concat(F.lit("`"), F.trim(x["text"]), F.lit("`"))).otherwise(core)
    s = F.when(has("strike"), F.concat(F.lit("~~"), s, F.lit("~~"))).otherwise(s)
    s = F.when(has("italic"), F.concat(F.lit("*"), s, F.lit("*"))).otherwise(s)
    s = F.when(has("bold"), F.concat(F.lit("**"), s, F.lit("**"))).otherwise(s)
    s = F.when(x["href"].isNotNull(), F.concat(F.lit("["), s, F.lit("]("), x["href"], F.lit(")"))).otherwise(s)
    marked = F.when(core == "", plain).otherwise(F.concat(lead, s, trail))
    image = F.concat(F.lit("!["), F.coalesce(x["alt"], F.lit("")), F.lit("]("), x["src"], F.lit(")"))
    return F.when(x["type"] == "image", F.coalesce(image, F.lit(""))).when(x["type"] == "break", "\n").otherwise(F.coalesce(marked, F.lit("")))


def blocks(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, ordinal, type, level, text, markdown, ordered, language, rows of a table by row and col...): one row per block.

    A block is the runs of its nearest block element; runs of a page's block are
    few, and are put together in order.
    """
    depth = F.size(F.filter("tags", lambda t: t.isin("ul", "ol")))
    lists = F.when(_has(F.col("tags"), ["ul", "ol"]), _nearest(["ul", "ol"])["tag"])
    # phrasing between two child blocks of one element is a block of its own: runs are told apart by the blocks between them
    order = Window.partitionBy("page_id").orderBy("node")
    cut = (~F.lag("block").over(order).eqNullSafe(F.col("block"))).cast("int")
    runs = runs.withColumn("cut", F.coalesce(cut, F.lit(1))).withColumn("part", F.sum("cut").over(order))
    item = F.struct("node", "type", "text", "marks", "href", "src", "alt")
    df = runs.groupBy("page_id", "block", "part").agg(
        F.min("node").alias("ordinal"), F.first("block_tag").alias("tag"), F.array_sort(F.collect_list(item)).alias("runs"), F.first(depth).alias("depth"),
        F.first(lists).alias("list"), F.bool_or(F.col("type") == "rule").alias("rule"), F.bool_or((F.col("type") == "image") & ~F.col("small")).alias("image"),
        F.bool_or(F.col("type") == "embed").alias("embed"), F.bool_or(_has(F.col("tags"), ["pre"])).alias("pre"), F.bool_or(_has(F.col("tags"), ["blockquote"])).alias("quoted"),
        F.first(F.when(_has(F.col("tags"), ["table"]), _nearest(["table"])["node"])).alias("table"), F.first(F.when(_has(F.col("tags"), ["tr"]), _nearest(["tr"])["node"])).alias("row"),
    )
    raw = F.array_join(F.transform("runs", lambda x: F.when(x["type"] == "text", x["text"]).when(x["type"] == "break", "\n").otherwise("")), "")
    flat = F.regexp_replace(F.regexp_replace(raw, r"[\t\f\r ]*\n[\t\f\r ]*", "\n"), r"[\t\f\r ]+", " ")
    text = F.when(F.col("pre"), F.regexp_replace(raw, r"^\n|\s+$", "")).otherwise(T.trim_space(F.regexp_replace(flat, r"\n+", " ")))
    shown_chars = lambda keep: F.aggregate(F.filter("runs", lambda x: (x["type"] == "text") & keep(x)), F.lit(0), lambda n, x: n + F.length(F.trim(x["text"])))
    share = F.coalesce(F.try_divide(shown_chars(lambda x: x["href"].isNotNull()), shown_chars(lambda x: F.lit(True))), F.lit(0.0))
    types = F.create_map(*[F.lit(v) for k, x in _TYPES.items() for v in (k, x)])
    kind = F.when(F.col("rule"), "rule").when(F.col("pre"), "code").when(F.col("embed"), "embed").otherwise(F.coalesce(F.try_element_at(types, "tag"), F.when(F.col("quoted"), "quote"), F.lit("paragraph")))
    kind = F.when((kind == "paragraph") & F.col("image") & (text == ""), "figure").otherwise(kind)
    classes = nodes.where("tag in ('pre', 'code')").select("page_id", F.element_at(F.concat(F.filter("path", lambda p: F.lit(True)), F.array("node")), -1).alias("n"), F.lower(_attr("class")).alias("cls"), "path", "tag")
    label = F.regexp_extract("cls", r"(?:lang(?:uage)?|highlight|brush|code|source)[-:_ ]+([a-z0-9+#-]+)", 1)
    code = classes.select("page_id", F.when(F.col("tag") == "pre", F.col("n")).otherwise(F.element_at("path", -1)).alias("block"), label.alias("label")).where("label <> ''").groupBy("page_id", "block").agg(F.min("label").alias("label"))
    df = df.join(code, ["page_id", "block"], "left")
    language = F.when(kind == "code", T.canonical_language("label"))
    spans = T.trim_space(F.array_join(F.transform("runs", _span), ""))
    inner = F.regexp_replace(F.regexp_replace(spans, r"[\t\f\r ]+", " "), r" ?\n[\n ]*", "\\\\\n")
    level = F.when(kind == "heading", F.substring("tag", 2, 1).cast("int"))
    indent = F.repeat(F.lit("  "), F.greatest(F.lit(0), F.col("depth") - 1))
    fence = F.when(F.contains("body", F.lit("```")), "~~~").otherwise("```")
    df = df.withColumn("body", text).select("page_id", "ordinal", "block", "table", "row", "list", "depth", kind.alias("type"), level.alias("level"), "body", inner.alias("inner"), language.alias("language"), fence.alias("fence"), indent.alias("indent"), share.alias("link_share"), "runs")
    markdown = (
        F.when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "inner"))
        .when(F.col("type") == "list", F.concat("indent", F.when(F.col("list") == "ol", "1. ").otherwise("- "), F.replace("inner", F.lit("\\\n"), F.concat(F.lit("\\\n"), "indent", F.lit("  ")))))
        .when(F.col("type") == "code", F.concat("fence", F.coalesce("language", F.lit("")), F.lit("\n"), "body", F.lit("\n"), "fence"))
        .when(F.col("type") == "quote", F.concat(F.lit("> "), F.replace("inner", F.lit("\n"), F.lit("\n> ")))).when(F.col("type") == "rule", "---")
        .when(F.col("type") == "embed", F.concat(F.lit("<"), F.filter("runs", lambda r: r["type"] == "embed")[0]["src"], F.lit(">"))).otherwise(F.regexp_replace("inner", r"^([#>+-]|\d+[.)])(\s)", r"\\$1$2"))
    )
    out = df.withColumn("markdown", markdown).where((F.col("body") != "") | F.col("type").isin("rule", "figure", "embed"))
    return out.select("page_id", "ordinal", "type", "level", F.col("body").alias("text"), "markdown", (F.col("list") == "ol").alias("ordered"), "depth", "language", "table", "row", "link_share")


def tables(block_rows: DataFrame) -> DataFrame:
    """(page_id, table, row, col, text): cells of tables, numbered; a page's tables are small."""
    cells = block_rows.where("type = 'table'")
    rows = F.dense_rank().over(Window.partitionBy("page_id", "table").orderBy("row")) - 1
    cols = F.row_number().over(Window.partitionBy("page_id", "table", "row").orderBy("ordinal")) - 1
    return cells.select("page_id", "table", rows.alias("row_no"), cols.alias("col_no"), "text")


def tidy(block_rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Blocks without the title repeated as a heading, lines of dates alone, and paragraphs said twice in a row.

    Paragraphs that only lead to other pages go, pitches among the first three
    and last three blocks, and contacts among the last three.
    """
    order = Window.partitionBy("page_id").orderBy("ordinal")
    df = block_rows.join(meta.select("page_id", "title"), "page_id").withColumn("place", F.row_number().over(order)).withColumn("before", F.lag("text").over(order)).withColumn("left", F.count(F.lit(1)).over(Window.partitionBy("page_id")) - F.col("place"))
    title = (F.col("place") <= 3) & F.col("type").isin("heading", "paragraph") & (T.comparable("text") == T.comparable("title"))
    twice = (F.length("text") >= 40) & (F.col("text") == F.col("before"))
    dated = (F.col("place") <= 6) & (F.col("type") == "paragraph") & D.is_date_line("text")
    plain, text = F.col("type") == "paragraph", F.col("text")
    pointer = plain & N.is_pointer(text, F.col("link_share"))
    pitch = ((F.col("place") <= 3) | (F.col("left") < 3)) & F.col("type").isin("paragraph", "list") & N.is_pitch(text)
    contact = (F.col("left") < 3) & plain & N.is_contact(text)
    bad = F.lit(False)
    for b in (twice, title, contact, pointer, dated, pitch):
        bad = bad | F.coalesce(b, F.lit(False))
    return df.where(~bad).drop("title", "before", "place", "left")


def articles(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, blocks) of ``pages`` (page_id, url, html).

    Pages with fewer than 50 characters of text and without figure, code or
    embed are no articles. Where the blocks hold less than 30 % of a JSON-LD
    body of over 500 characters, the body's paragraphs are the blocks.
    """
    nodes = cut(page_nodes(pages))  # many branches read the nodes; pages are parsed once
    meta = cut(metadata(pages, nodes))
    body = cut(content_nodes(nodes))
    rows = cut(tidy(blocks(inlines(body, pages), nodes), meta))
    size = rows.groupBy("page_id").agg(F.sum(F.length("text")).alias("chars"))
    poor = meta.where(F.length("ld_body") > 500).join(size, "page_id", "left").where(F.coalesce("chars", F.lit(0)) < 0.3 * F.length("ld_body")).select("page_id", "ld_body")
    told = poor.select("page_id", F.posexplode(F.filter(F.transform(F.split("ld_body", r"\n+"), T.collapse), lambda p: p != "")).alias("ordinal", "text"))
    told = told.select("page_id", "ordinal", F.lit("paragraph").alias("type"), F.lit(None).cast("int").alias("level"), "text", F.col("text").alias("markdown"), F.lit(None).cast("boolean").alias("ordered"),
        F.lit(0).alias("depth"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("int").alias("table"), F.lit(None).cast("int").alias("row"), F.lit(0.0).alias("link_share"))
    rows = rows.join(poor.select("page_id"), "page_id", "left_anti").unionByName(told)
    join = lambda c, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", c))), lambda x: x[c]), sep)
    paragraphs = F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "paragraph", F.struct("ordinal", "text")))), lambda x: x["text"])
    whole = rows.groupBy("page_id").agg(
        join("text", "\n").alias("text"), join("markdown", "\n\n").alias("markdown"), paragraphs.alias("paragraphs"), F.count(F.lit(1)).alias("block_count"),
        F.bool_or(F.col("type").isin("figure", "code", "embed")).alias("rich"),
    ).where((F.length("text") >= MIN_TEXT) | F.col("rich"))
    out = whole.join(meta, "page_id")
    out = out.select(
        "page_id", F.lit(1).alias("schema"), "canonical", "title", "site_name", "byline", "published_at", "modified_at", "language", T.direction("text").alias("dir"),
        T.excerpt("description", "paragraphs").alias("excerpt"), "lead_image", "favicon", T.count_words("text").alias("word_count"), "block_count", "text", "markdown",
    ).withColumn("reading_minutes", T.reading_minutes("word_count"))
    return out, rows.join(whole.select("page_id"), "page_id", "left_semi")


def links(pages: DataFrame) -> DataFrame:
    """(page_id, href, text, host): the links of the content."""
    runs = inlines(content_nodes(cut(page_nodes(pages))), pages).where("href is not null and type = 'text'")
    return runs.groupBy("page_id", "href").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]), "").alias("text")).withColumn("host", U.host_of("href"))


def store_bodies(article_rows: DataFrame, path: str) -> DataFrame:
    """Writes each distinct article body of at most 4 MB once, by its SHA-256; returns (page_id, body_sha256, body_size, status).

    A larger body isn't stored, by the store's rule; its row says ``too large``.
    """
    body = F.to_json(F.struct("schema", "title", "text", "markdown"))
    rows = article_rows.select("page_id", body.alias("body")).select("page_id", "body", F.sha2("body", 256).alias("body_sha256"), F.octet_length("body").alias("body_size"))
    rows = rows.withColumn("status", F.when(F.col("body_size") <= 4194304, "stored").otherwise("too large"))
    once = rows.where("status = 'stored'").groupBy("body_sha256").agg(F.first("body").alias("body"))
    once.write.option("compression", "gzip").mode("append").parquet(path)
    return rows.select("page_id", "body_sha256", "body_size", "status")
