"""Registered queries of scalar rules, the change log, catalogs and scoring, over whole standard tables.

Where a rule needs values that the tables don't hold (addresses, payloads,
titles), a query spells them from every row's columns. The oracles state the
rules' own outcome in SQL; they don't repeat the expressions of the operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import dates as D
from leafmill.functions import furniture as N
from leafmill.functions import geometry as G
from leafmill.functions import images as I
from leafmill.functions import text as T
from leafmill.functions import urls as U
from leafmill.operators import books as B
from leafmill.operators import catalogs as C
from leafmill.operators import changelog as L
from leafmill.operators import matching as M
from leafmill.operators import scoring as S
from leafmill.plans.catalogue import query
from leafmill.session import numbered, spread, table


def pick(values: list[str], index: Column) -> Column:
    """The value at ``index`` modulo the number of values."""
    return F.get(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int"))


def sql_case(values: list[str | None], index: str) -> str:
    """The same choice in SQL, of results that are written out."""
    spelled = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return f"case {index} % {len(values)} " + " ".join(f"when {i} then {spelled(v)}" for i, v in enumerate(values)) + " end"


# text ---------------------------------------------------------------------------------------------------------------


@query(
    "text_scalars",
    rf"""with c as (select doc_id, text, regexp_replace(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'), '^[{T.SPACE}]+|[{T.SPACE}]+$', '', 'g') as c, trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')) as v from documents)
    select doc_id, md5(c) as collapsed, cast(length(v) as int) as visible, cast(length(text) - length(translate(text, '{T.COMMAS}', '')) as int) as commas from c""",
)
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.collapse("text")).alias("collapsed"), T.visible_length("text").alias("visible"), T.comma_count("text").alias("commas"))


@query("text_comparable", r"""select doc_id, md5(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))) as key from documents""")
def text_comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.comparable("text")).alias("key"))


@query(
    "text_excerpts",
    rf"""with l as (select doc_id, list_filter(string_split(text, chr(10)), lambda p: length(p) >= 40)[1] as p, substr(text, 1, 12) as d from documents)
    select doc_id, coalesce(case when length(p) > 300 then concat(regexp_replace(substr(p, 1, 297), '[{T.SPACE}]+[^{T.SPACE}]*$', ''), '…') else p end, d) as excerpt from l""",
)
def text_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents with a description too short to be one."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.excerpt(F.substring("text", 1, 12), F.split("text", "\n")).alias("excerpt"))


@query(
    "text_fields",
    rf"""select doc_id, substr(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), '[{T.SPACE}]+', ' ', 'g'), '^ | $', '', 'g'), 1, 160) as field from documents""",
)
def text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_field("text", 160).alias("field"))


@query(
    "text_typography",
    rf"""select doc_id, md5(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[‘’‚‛′´`]', '''', 'g'), '[“”„‟″«»]', '"', 'g'), '[\x{{2010}}-\x{{2015}}\x{{2212}}]', '-', 'g'), '…', '...'),
    '[{T.SPACE}{T.ZERO_WIDTH}]+', '', 'g')) as key from (select doc_id, concat('“', text, '” – ‘it’s…’ ') as text from documents)""",
)
def text_typography(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.fold_typography(F.concat(F.lit("“"), "text", F.lit("” – ‘it’s…’ ")))).alias("key"))


@query("text_ligatures", "select doc_id, md5(replace(text, chr(173), '')) as digest from documents")
def text_ligatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts set with ligatures and soft hyphens come back as they were, but for soft hyphens of their own."""
    set_ = F.replace(F.replace(F.replace("text", F.lit("ffi"), F.lit("ﬃ")), F.lit("fi"), F.lit("ﬁ")), F.lit("st"), F.lit("s\u00adt"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.ligatures(set_)).alias("digest"))


@query("entity_texts", r"""select page_id, md5(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', chr(160)), '&amp;', '&')) as digest from pages""")
def entity_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.decode_entities("html")).alias("digest"))


@query("file_titles", "select p_partkey, trim(p_name) as title from part")
def file_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(pick(["/books/new/", "C:\\files\\", ""], F.col("p_partkey")), F.replace("p_name", F.lit(" "), F.lit("__")), pick([".epub", ".tar.gz"], F.col("p_partkey") * 0))
    return table(spark, sf_dir, "part").select("p_partkey", T.title_from_file_name(path).alias("title"))


@query(
    "title_matches",
    """select p_partkey, p_partkey % 4 = 0 as exact, p_partkey % 4 in (0, 1) or (p_partkey % 4 = 2 and length(replace(p_name, ' ', '')) >= 0.4 * (length(replace(p_name, ' ', '')) + length('|awebsite'))) as fuzzy from part""",
)
def title_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in other case and space, in other order, with a site's name after them, and others."""
    words = F.split("p_name", " ")
    k = F.col("p_partkey") % 4
    other = F.when(k == 0, F.concat(F.lit("  "), F.upper("p_name"))).when(k == 1, F.array_join(F.concat(F.reverse(words), F.array(F.element_at(words, -1))), " ")).when(k == 2, F.concat("p_name", F.lit(" | A Website"))).otherwise("zz 99 yy")
    m = T.title_match("p_name", other)
    return table(spark, sf_dir, "part").select("p_partkey", m["exact"].alias("exact"), m["fuzzy"].alias("fuzzy"))


_LABELS = [w for k, vs in sorted(T.LANGUAGE_ALIASES.items()) for v in vs.split() for w in ((f" {v.upper()}\n", k), (v, k))] + [(w, None) for w in T.NO_LANGUAGE.split()] + [("cobol", "cobol"), ("", None)]


@query("code_labels", f"select o_orderkey, {sql_case([v for _, v in _LABELS], 'o_orderkey')} as language from orders")
def code_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.canonical_language(pick([w for w, _ in _LABELS], F.col("o_orderkey"))).alias("language"))


@query(
    "byte_sizes",
    """with n as (select o_orderkey, o_orderkey * o_orderkey * 17 as n from orders)
    select o_orderkey, case when n < 1024 then concat(n, ' B') when n < 1048576 then concat(cast(round(n / 1024) as bigint), ' KB')
        when n < 1073741824 then concat(format('{:.1f}', floor(n / 1048576 * 10 + 0.5) / 10), ' MB') else concat(format('{:.1f}', floor(n / 1073741824 * 10 + 0.5) / 10), ' GB') end as size from n""",
)
def byte_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.format_bytes(F.col("o_orderkey") * F.col("o_orderkey") * 17).alias("size"))


@query("edit_accuracies", "select p_partkey, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 6) as accuracy from part")
def edit_accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(T.edit_accuracy("p_name", "p_type"), 6).alias("accuracy"))


@query(
    "fragment_shares",
    """with f as (select conv_id, turn, text, unnest(range(0, length(text) // 32)) as i from conversations where length(text) >= 32)
    select conv_id, turn, round(avg(contains(substr(text, 1, length(text) // 2), substr(text, 1 + 32 * i, 32))::int), 6) as share from f group by all""",
)
def fragment_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of whole turns that the turn's first half holds."""
    c = table(spark, sf_dir, "conversations").where("length(text) >= 32")
    share = T.fragment_coverage("text", F.expr("substr(text, 1, length(text) div 2)"))
    return c.select("conv_id", "turn", F.round(share, 6).alias("share")).groupBy("conv_id", "turn").agg(F.avg("share").alias("share"))


# addresses and dates ------------------------------------------------------------------------------------------------

_ADDRESSES = [
    ("https://news.example.org/a?b=1", True), ("http://Example.com:80/x", True), ("https://example.com:443", True), ("https://example.com:8080/x", False), ("https://user:pw@example.com/", False),
    ("http://10.0.0.1/x", False), ("http://[::1]/x", False), ("https://localhost/x", False), ("https://box.local/", False), ("https://x.test/", False), ("https://dotless/", False),
    ("ftp://example.com/x", False), ("https://example.com./y", True), ("https://a.b.onion/", False), ("not an address", False), ("https://example.com/" + "p" * 2040, False),
]


@query("public_addresses", f"select o_orderkey, {sql_case([v for _, v in _ADDRESSES], 'o_orderkey')} as public from orders")
def public_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", U.is_public_article(pick([u for u, _ in _ADDRESSES], F.col("o_orderkey"))).alias("public"))


@query(
    "address_parts",
    """select page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) as path, page_id % 3 = 0 as userinfo, page_id % 2 = 0 as same from pages""",
)
def address_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    with_user = F.when(k % 3 == 0, F.regexp_replace("url", "://", "://me@")).otherwise(F.col("url"))
    sibling = F.when(k % 2 == 0, F.concat(F.lit("https://other."), F.array_join(F.slice(F.split(U.host_of("url"), r"\."), -2, 2), "."), F.lit("/z"))).otherwise("https://elsewhere.invalid/z")
    return table(spark, sf_dir, "pages").select("page_id", U.path_of("url").alias("path"), U.has_userinfo(with_user).alias("userinfo"), U.same_site("url", sibling).alias("same"))


@query("found_addresses", "select page_id, case page_id % 3 when 2 then null else url end as found from pages")
def found_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, url = F.col("page_id") % 3, F.col("url")
    text = F.when(k == 0, F.concat(F.lit("Read this ("), url, F.lit(").\nThen more."))).when(k == 1, F.concat(F.lit('  "'), url, F.lit('", they said'))).otherwise("no address, only www and example")
    return table(spark, sf_dir, "pages").select("page_id", U.find_url(text).alias("found"))


_PLAYERS = [
    ("https://www.youtube.com/watch?list=x&v=abcDEF12345", "youtube:abcDEF12345"), ("https://youtu.be/abcDEF12345?t=3", "youtube:abcDEF12345"), ("https://www.youtube-nocookie.com/embed/abcDEF12345", "youtube:abcDEF12345"),
    ("https://player.vimeo.com/video/123456?h=1", "vimeo:123456"), ("https://www.dailymotion.com/embed/video/x7abc", "dailymotion:x7abc"), ("https://www.loom.com/share/0a1b", "loom:0a1b"),
    ("https://embed.ted.com/talks/a_talk-of_it", "ted:a_talk-of_it"), ("https://open.spotify.com/embed/episode/4Zz", "spotify:episode/4Zz"), ("https://example.com/watch?v=abcDEF12345", None),
]


@query("media_players", f"select o_orderkey, {sql_case([v for _, v in _PLAYERS], 'o_orderkey')} as player from orders")
def media_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = U.media_provider(pick([u for u, _ in _PLAYERS], F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(m["provider"].isNotNull(), F.concat_ws(":", m["provider"], m["id"])).alias("player"))


_LINES = [
    ("Updated: {d} at 10:05 a.m. EST", True), ("{d}", True), ("Published on {d}", True), ("3 hours ago", True), ("{d} | 9.30 pm GMT", True), ("{d} by Jane Doe", False),
    ("The first of them came on {d}", False), ("Thursday, {d}", True), ("no digits, only May", False), ("{d} " + "and more " * 12, False),
]


@query("date_lines", f"select o_orderkey, {sql_case([v for _, v in _LINES], 'o_orderkey')} as line from orders")
def date_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.replace(pick([t for t, _ in _LINES], F.col("o_orderkey")), F.lit("{d}"), F.date_format("o_orderdate", "MMMM d, yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.is_date_line(line).alias("line"))


@query(
    "written_dates",
    """select o_orderkey, case o_orderkey % 6 when 3 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') when 4 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:00+01:30') when 5 then null else strftime(o_orderdate, '%Y-%m-%d') end as date from orders""",
)
def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates spelled in five ways, and a line without one."""
    k, form = F.col("o_orderkey") % 6, lambda p: F.date_format("o_orderdate", p)
    text = (
        F.when(k == 0, form("d. MMM yyyy")).when(k == 1, F.concat(F.lit("on "), form("d"), F.lit("th "), form("MMMM"), F.lit(", "), form("yyyy"), F.lit(" (late)"))).when(k == 2, form("yyyyMMdd'T'HHmm"))
        .when(k == 3, form("yyyy-MM-dd HH:mm:ss.SSS'Z'")).when(k == 4, form("yyyy-MM-dd'T'HH:mm'+0130'")).otherwise(F.concat(F.lit("page "), form("d"), F.lit(" of 2020 words")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", D.normalize_date(text).alias("date"))


@query(
    "clock_rules",
    """select event_id, greatest(epoch_us(ts) // 1000, epoch_us(ts) // 1000 - 5 + event_id % 10 + 1) as stamp, cast(least(1000 * pow(2, least(event_id % 40, 16)), 900000) as bigint) as delay from events""",
)
def clock_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.unix_millis(F.col("ts").cast("timestamp"))
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", D.next_stamp(now, now - 5 + k % 10).alias("stamp"), D.retry_delay_ms(F.lit(1000), k % 40).alias("delay"))


# rectangles ---------------------------------------------------------------------------------------------------------


@query(
    "boxes",
    """with b as (select l_orderkey, l_linenumber, l_quantity as x, l_tax * 100 as y, l_discount * 100 + 1 as w, 5.0 as h, 20.0 as x0, 2.0 as y0, 30.0 as x1, 6.0 as y1 from lineitem)
    select l_orderkey, l_linenumber, x < x1 and x0 < x + w and y < y1 and y0 < y + h as meets, round(greatest(0, least(x + w, x1) - greatest(x, x0)) * greatest(0, least(y + h, y1) - greatest(y, y0)), 4) as area,
        x >= x0 - 1 and y >= y0 - 1 and x + w <= x1 + 1 and y + h <= y1 + 1 as inside, round((greatest(x + w, x1) - least(x, x0)) * (greatest(y + h, y1) - least(y, y0)), 4) as hull from b""",
)
def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, w = F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 100 + 1
    a, b = G.rect(x + w, y, x, y + 5.0), G.rect(F.lit(20.0), F.lit(2.0), F.lit(30.0), F.lit(6.0))
    u = G.union(a, b)
    hull = (u["x1"] - u["x0"]) * (u["y1"] - u["y0"])
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", G.intersects(a, b).alias("meets"), F.round(G.overlap(a, b), 4).alias("area"), G.contains(b, a, 1.0).alias("inside"), F.round(hull, 4).alias("hull")
    )


@query(
    "block_positions",
    """with p as (select o_orderkey, o_totalprice, o_totalprice / 1000 as f, 1 + o_custkey % 300 as n from orders), c as (select *, greatest(0, least(f, n)) as place from p), b as (select *, least(floor(place), n - 1) as block from c)
    select o_orderkey, cast(block as bigint) as block, floor((place - block) * 10000 + 0.5) / 10000 as "offset", floor(least(1, place / n) * 10000 + 0.5) / 10000 as percent, floor(-o_totalprice * 10 + 0.5) / 10 as rounded from b""",
)
def block_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = G.position_of(F.col("o_totalprice") / 1000, 1 + F.col("o_custkey") % 300)
    out = table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p"), G.round_half_up(-F.col("o_totalprice"), 1).alias("rounded"))
    return out.select("o_orderkey", F.col("p.block").cast("long").alias("block"), "p.offset", "p.percent", "rounded")


# the change log -----------------------------------------------------------------------------------------------------


def _payload_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a change: ten kinds of payloads by its number, valid or not by its value."""
    k, v = F.col("event_id") % 10, F.col("value")
    sha, zero, id32 = F.sha2(F.col("user_id").cast("string"), 256), F.lit("0" * 64), F.substring(F.md5(F.col("user_id").cast("string")), 1, 32)
    j = lambda template: F.format_string(template, F.floor(v), v / 80, id32, F.col("user_id"), F.floor(v) * 1_000_000)
    day = '"2024-01-01T00:00:00Z"'
    payload = (
        F.when(k == 0, j('{"readingMilliseconds": %5$d}')).when(k == 1, j('{"href": "c%4$d.xhtml", "progression": %2$f}')).when(k == 2, F.when(v > 50, j('{"present": true, "addedAt": ' + day + "}")).otherwise(j('{"present": true, "addedAt": null}')))
        .when(k == 3, j('{"highlightId": "h%4$d", "locator": {"href": "c1"}, "text": "words", "color": "%1$d-red", "createdAt": ' + day + ', "deleted": false}')).when(k == 4, j('{"articleId": "%3$s", "position": {"block": %1$d, "offset": 0.5, "percent": %2$f}}'))
        .when(k == 5, j('{"categoryId": "c-%4$d", "deleted": false, "name": " %1$d ", "color": "blue", "createdAt": ' + day + "}")).when(k == 6, j('{"categoryId": null, "itemType": "article", "itemId": "%3$s"}'))
        .when(k == 7, j('{"articleId": "%3$s", "deleted": true}')).when(k == 8, j("[%1$d]")).otherwise(j('{"x": %1$d}'))
    )
    kind = pick("session progress library highlight articleProgress category categoryItem article session other".split(), F.col("event_id"))
    kept = F.when(k.isin(4, 7), "articles").when(k.isin(5, 6), "categories").otherwise(F.concat(F.lit("book-"), F.col("user_id").cast("string")))
    when = F.when(F.col("event_id") % 97 == 0, "2024-02-30T00:00:00Z").when(F.col("event_id") % 89 == 0, "2030-01-01T00:00:00Z").otherwise("2024-01-01T00:00:00.25Z")
    return table(spark, sf_dir, "events").select(
        "event_id", (F.floor(F.col("event_id") / 60)).alias("batch_id"), F.concat(F.when(F.col("event_id") % 83 == 0, "-").otherwise(""), F.lit("ch"), "event_id").alias("change_id"),
        F.when(k.isin(4, 5, 6, 7) & (v > 120), "elsewhere").otherwise(kept).alias("book_id"), F.when(k.isin(4, 5, 6, 7), zero).otherwise(sha).alias("sha256"), kind.alias("kind"), when.alias("updated_at"), payload.alias("payload"),
    )


_PROBLEMS = """select event_id, event_id // 60 as batch_id, case when event_id % 83 = 0 then 'change id' when event_id % 10 = 9 then 'kind' when event_id % 97 = 0 or event_id % 89 = 0 then 'updated at' when event_id % 10 = 8 then 'payload'
    when event_id % 10 in (4, 5, 6, 7) and value > 120 then 'edition'
    when event_id % 10 = 0 and floor(value) * 1000000 > 604800000 or event_id % 10 = 1 and value / 80 > 1.0000005 or event_id % 10 = 2 and value <= 50 or event_id % 10 = 3 or event_id % 10 = 4 and value / 80 > 1.0000005 then 'payload of kind' end as problem from events"""


@query("change_problems", f"select event_id, problem from ({_PROBLEMS})")
def change_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.validate(_payload_changes(spark, sf_dir), 1_704_067_500_000_000).select("event_id", "problem")


@query(
    "whole_batches",
    f"""with p as ({_PROBLEMS.replace("event_id // 60", "event_id // 4")}) select event_id, batch_id from p where batch_id not in (select batch_id from p where problem is not null)""",
)
def whole_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of four changes; one bad change takes its batch along."""
    changes = _payload_changes(spark, sf_dir).withColumn("batch_id", F.floor(F.col("event_id") / 4))
    return L.whole_batches(L.validate(changes, 1_704_067_500_000_000)).select("event_id", "batch_id")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in the order of their numbers, with clocks that run back and forth."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    clock = us + (F.col("event_id") * 7919 % 86_400) * 1_000_000
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.struct("event_id").alias("turn"), clock.alias("updated_us"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("change_id"), clock.cast("string").alias("updated_at"),
        "event_id", "event_type", F.round("value", 2).cast("string").alias("text"), (F.col("event_id") % 5 == 3).alias("deleted"),
    )


_LOG = "select user_id as id, event_id, epoch_us(ts) + (event_id * 7919 % 86400) * 1000000 as us, event_type, cast(round(value, 2) as varchar) as text, event_id % 5 = 3 as deleted from events"


@query(
    "highlight_merge",
    f"""with l as ({_LOG}), f as (select id, arg_min(event_type, event_id) as sha, min(event_id) as first from l group by id), m as (select l.*, first from l join f on l.id = f.id and l.event_type = f.sha)
    select id, arg_max(text, (us, event_id)) as text, min(first) as created, arg_max(event_id, (us, event_id)) as last, arg_max(deleted, (us, event_id)) as deleted from m group by id""",
)
def highlight_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A highlight is a user's; a write for another event type would move it and is refused."""
    log = _log(spark, sf_dir).select("*", F.lit("book").alias("book_id"), F.col("event_type").alias("sha256"), F.lit("red").alias("color"), F.lit("").alias("note"), F.col("event_id").cast("string").alias("created_at"))
    out = L.merge_highlights(log)
    return out.select("id", "text", F.col("created_at").cast("long").alias("created"), F.col("change_id").cast("long").alias("last"), F.col("deleted_at").isNotNull().alias("deleted"))


@query(
    "article_merge",
    f"""with recursive l as (select *, row_number() over (partition by id order by event_id) as i, event_type = 'view' as move from ({_LOG})),
    s as (select id, 0::bigint as i, null::varchar as url, null::bigint as us, null::bigint as eid, false as dead, null::varchar as pos, null::bigint as pus, null::bigint as peid from (select distinct id from l)
        union all select l.id, l.i, case when ok_save then case when l.deleted then coalesce(s.url, '') else l.text end else s.url end, case when ok_save then l.us else s.us end, case when ok_save then l.event_id else s.eid end,
            case when ok_save then l.deleted else s.dead end, case when ok_move then l.text when ok_save and not l.deleted and s.dead then null else s.pos end, case when ok_move then l.us when ok_save and not l.deleted and s.dead then null else s.pus end,
            case when ok_move then l.event_id when ok_save and not l.deleted and s.dead then null else s.peid end
        from s join l on l.id = s.id and l.i = s.i + 1, lateral (select not l.move and (s.us is null or (l.us, l.event_id) > (s.us, s.eid)) as ok_save) a,
            lateral (select l.move and s.us is not null and not s.dead and (s.pus is null or (l.us, l.event_id) > (s.pus, s.peid)) as ok_move) b)
    select id, url, eid as last, dead as deleted, pos as position from s where us is not null qualify row_number() over (partition by id order by i desc) = 1""",
)
def article_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views move the reading position; all other events save or delete the article."""
    kind = F.when(F.col("event_type") == "view", "articleProgress").otherwise("article")
    log = _log(spark, sf_dir).select("*", kind.alias("kind"), F.col("text").alias("url"), F.lit("t").alias("title"), F.col("text").alias("position"))
    out = L.merge_articles(log)
    return out.select("id", "url", F.col("change_id").cast("long").alias("last"), F.col("deleted_at").isNotNull().alias("deleted"), "position")


@query(
    "shared_revisions",
    f"""with l as (select *, event_type in ('error', 'purchase') as one from ({_LOG})), f as (select id, one, arg_min(event_type, event_id) as sha from l group by all), m as (select l.* from l join f on l.id = f.id and l.one = f.one and l.event_type = f.sha),
    a as (select *, (us, event_id) > max((us, event_id)) over (partition by id, one order by event_id rows between unbounded preceding and 1 preceding) as newer, row_number() over (partition by id, one order by event_id) = 1 as first from m),
    r as (select *, row_number() over (order by event_id) + 1000 as rev from a where first or newer)
    select one as first_state, id, max(rev) as rev from r group by all""",
)
def shared_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of highlights draw their revisions from one sequence, after 1,000."""
    log = _log(spark, sf_dir).select("*", F.lit("book").alias("book_id"), F.col("event_type").alias("sha256"), F.lit("red").alias("color"), F.lit("").alias("note"), F.lit("").alias("created_at"))
    one = F.col("event_type").isin("error", "purchase")
    a, b = L.with_revisions(*[(L.merge_highlights(part), L.accepted_highlights(part)) for part in (log.where(one), log.where(~one))], after=1000)
    return a.select(F.lit(True).alias("first_state"), "id", "rev").unionByName(b.select(F.lit(False).alias("first_state"), "id", "rev"))


@query(
    "union_pull",
    """with c as (select c_custkey * 3 as rev, c_name as name, null::varchar as item from customer where c_custkey * 3 > 50 order by 1 limit 41), i as (select s_suppkey * 3 + 1 as rev, null::varchar as name, s_name as item from supplier where s_suppkey * 3 + 1 > 50 order by 1 limit 41)
    select * from (select * from c union all select * from i) order by rev limit 41""",
)
def union_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("rev"), F.col("c_name").alias("name"))
    i = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3 + 1).alias("rev"), F.col("s_name").alias("item"))
    return L.union_pull(c, i, 50, 40).select("rev", "name", "item")


@query(
    "unsent_totals",
    """with a as (select user_id, cast(sum(floor(value)) as bigint) as t from events where event_type <> 'error' group by all), g as (select user_id, cast(sum(greatest(0, floor(value) - 40)) as bigint) as g from events where event_type <> 'click' group by all)
    select coalesce(a.user_id, g.user_id) as book_id, coalesce(t, 0) + coalesce(g, 0) as total_ms from a full join g using (user_id)""",
)
def unsent_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("book_id", F.col("user_id"))
    acked = e.where("event_type <> 'error'").groupBy("book_id").agg(F.sum(F.floor("value")).alias("total_ms"))
    return L.unsent_total(acked, e.where("event_type <> 'click'").select("book_id", F.floor("value").alias("current_ms"), F.lit(40).alias("acked_ms")))


# catalogs -----------------------------------------------------------------------------------------------------------

_BOOK_FAULTS = [
    "none", "title of 301", "title with a tab", "author missing", "description of 4001", "language", "33 subjects", "empty subject", "cover id", "cover without url", "cover type", "cover size", "download", "size", "sha", "seconds only", "key with ..", "key ending", "format", "id", "none",
]


@query("manifest_books", f"select p_partkey, p_partkey % {len(_BOOK_FAULTS)} in (0, {len(_BOOK_FAULTS) - 1}) as valid from part")
def manifest_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a manifest row: proper ones with and without a cover, and rows with one fault each."""
    fault = pick(_BOOK_FAULTS, F.col("p_partkey"))
    bad = lambda name, then, good: F.when(fault == name, then).otherwise(good)
    sha = F.sha2("p_name", 256)
    id_ = bad("id", F.lit("Part 1"), F.concat(F.lit("part-"), "p_partkey"))
    covered = (F.col("p_partkey") % len(_BOOK_FAULTS) > 0) & (fault != "cover without url")
    comic = F.col("p_partkey") % 2 == 0
    cover = F.struct(
        F.concat(F.lit("covers/"), sha).alias("object_key"), bad("cover type", F.lit("text/html"), F.lit("image/png")).alias("content_type"), bad("cover size", F.lit(10_000_001), F.col("p_size") + 1).cast("long").alias("file_size"), F.lit(None).cast("string").alias("etag")
    )
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", id_.alias("id"), bad("format", F.lit("pdf"), F.when(comic, "comic").otherwise("epub")).alias("format"), F.lit("1.0").alias("version"),
        F.when(fault == "title of 301", F.repeat(F.lit("t"), 301)).when(fault == "title with a tab", F.lit("a\tb")).otherwise(F.col("p_name")).alias("title"), bad("author missing", F.lit(None), F.col("p_brand")).alias("author"),
        bad("description of 4001", F.repeat(F.lit("d"), 4001), F.repeat(F.lit("d"), 4000)).alias("description"), bad("language", F.lit("english"), F.lit("pt-BR")).alias("language"),
        F.when(fault == "33 subjects", F.array_repeat(F.lit("s"), 33)).when(fault == "empty subject", F.array(F.lit(""))).otherwise(F.array_repeat(F.lit("s"), 32)).alias("subjects"),
        bad("cover id", F.lit("cover-x"), F.when(covered & (F.col("p_size") % 2 == 0), F.concat(F.lit("cover-"), sha))).alias("cover_id"), F.when(covered, F.concat(F.lit("/v1/books/"), id_, F.lit("/cover"))).alias("cover_url"),
        bad("download", F.lit("https://example.org/x.epub"), F.concat(F.lit("/v1/books/"), id_, F.lit("/download"))).alias("download_url"), bad("size", F.lit(0), F.col("p_size") + 1).alias("file_size"), bad("sha", F.upper(sha), sha).alias("sha256"),
        bad("seconds only", F.lit("2024-01-01T00:00:00Z"), F.lit("2024-01-01T00:00:00.000Z")).alias("updated_at"),
        F.when(fault == "key with ..", F.lit("a/../b.epub")).when(fault == "key ending", F.lit("a/b.txt")).otherwise(F.concat(F.lit("books/"), sha, F.when(comic, ".cbz").otherwise(".epub"))).alias("object_key"),
        F.when(covered | (fault == "cover without url"), cover).alias("cover"),
    )
    return rows.select("p_partkey", C.valid_book().alias("valid"))


@query(
    "author_union",
    """with s as (select p_brand, p_type, min(p_partkey) as first, arg_min(case p_partkey % 3 when 0 then upper(p_type) when 1 then concat(' ', p_type) else p_type end, p_partkey) as name from part group by all)
    select p_brand, string_agg(trim(name), ';' order by first) as names from s group by all""",
)
def author_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of each brand in one list, in three spellings; each counts once, as first written."""
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.upper("p_type")).when(k == 1, F.concat(F.lit(" "), "p_type")).otherwise(F.col("p_type"))
    names = C.union_names(table(spark, sf_dir, "part").select("p_brand", "p_partkey", name.alias("name")), "p_brand", "name", "p_partkey")
    return names.select("p_brand", F.array_join("names", ";").alias("names"))


@query(
    "highlight_order",
    """select c_custkey as key, o_orderkey as id, cast(row_number() over (partition by c_custkey order by o_totalprice, epoch_us(o_orderdate), o_orderkey) as int) as place from orders join customer on o_custkey = c_custkey where o_orderstatus <> 'F' and c_acctbal > 0""",
)
def highlight_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as highlights of their customer's book, in reading order; finished ones are deleted."""
    h = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("sha256"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("position"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_at"), F.when(F.col("o_orderstatus") == "F", "d").alias("deleted_at")
    )
    library = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_custkey").alias("sha256"))
    return C.highlights_by_edition(h, library).select("key", "id", "place")


@query("library_downloaded", "select p_partkey as key, cast(row_number() over (order by p_retailprice desc, p_partkey) as int) as place from part where p_size > 25")
def library_downloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("added_us"), (F.col("p_size") > 25).alias("downloaded"), F.lit(0.5).alias("progress"), F.lit("book").alias("kind"))
    return numbered(C.library_view(library, "downloaded"), "place", F.col("added_us").desc(), F.col("key")).select("key", F.col("place").cast("int"))


@query("last_opened", "select max(o_orderkey) as key, epoch_us(o_orderdate) as last_opened_us from orders where o_orderdate = (select max(o_orderdate) from orders) group by o_orderdate")
def last_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("last_opened_us"))
    return C.continue_reading(library)


@query("unfiled_items", "select c_custkey as key from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'O')")
def unfiled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("book").alias("kind"))
    filed = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.lit("book").alias("item_type"), F.col("o_custkey").alias("item_id"))
    return C.unfiled(library, filed).select("key")


# scoring ------------------------------------------------------------------------------------------------------------


@query("warning_pages", "select l_returnflag as file, l_shipdate::date::varchar as message, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') as pages from lineitem group by all")
def warning_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("file"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("message"), F.col("l_linenumber").alias("page"))
    return S.warning_groups(w, "file").select("file", "message", F.array_join("pages", ",").alias("pages"))


@query("best_candidates", "select o_custkey as page, o_orderkey as place, cast(row_number() over (partition by o_custkey order by round(o_totalprice, -4) desc, o_orderkey) as int) as rank from orders qualify rank <= 5")
def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five dearest orders of each customer, to ten thousands; of equal ones the first."""
    scores = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("place"), F.round("o_totalprice", -4).alias("score"))
    return S.top_candidates(scores, "page").select("page", "place", "rank")


@query(
    "heading_matches",
    """with a as (select o_custkey, o_orderpriority as h, count(*) as n from orders where o_orderstatus = 'O' group by all), b as (select o_custkey, o_orderpriority as h, count(*) as n from orders where o_orderstatus <> 'O' group by all)
    select coalesce(a.o_custkey, b.o_custkey) as file, cast(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) as bigint) as matched, cast(sum(coalesce(a.n, 0)) as bigint) as first, cast(sum(coalesce(b.n, 0)) as bigint) as second
    from a full join b on a.o_custkey = b.o_custkey and a.h = b.h group by 1""",
)
def heading_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("file", F.col("o_custkey"))
    return S.multiset_matches(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus <> 'O'"), "file", "o_orderpriority")


_CURATED = """with x as (select item_id as id, text, length(text) as n from benchmark),
    c as (select id, 1 + id % 5 as tier, case when id % 2 = 0 then 'a' else 'b' end as category, case when id % 3 = 0 then 0.5 else 1.0 end as inc, case when id % 4 = 0 then null when id % 4 = 1 then 0.5 else 0.0 end as leak, id % 5 <> 0 as title,
        case when id % 6 = 0 then null when id % 6 < 3 then 1.0 else 0.5 end as structure, case when id % 6 = 0 then 0 else 2 end as checks from x),
    s as (select *, (0.5 * inc + 0.1 * title::int + coalesce(0.2 * (1 - leak), 0) + coalesce(0.2 * structure, 0)) / (0.6 + case when leak is null then 0 else 0.2 end + case when structure is null then 0 else 0.2 end) as combined from c)"""


def _curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a page: snippets that it holds or not, by its number."""
    i = F.col("id")
    x = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    inside = F.substring("text", 3, 20)
    outputs = x.select(
        "id", "text", F.when(i % 5 == 0, "something else entirely").otherwise(F.concat(F.lit("Item "), i)).alias("title"), F.when((i % 6).isin(1, 2), 1).otherwise(0).alias("code_blocks"), F.array(F.lit("py")).alias("code_languages"),
        *[F.lit(3).alias(c) for c in ("images", "headings", "tables", "math", "footnotes", "embeds")],
    )
    none = F.lit(None)
    wants = x.select(
        "id", (1 + i % 5).alias("tier"), F.when(i % 2 == 0, "a").otherwise("b").alias("category"), F.concat(F.lit("ITEM "), i).alias("title"), F.when(i % 3 == 0, F.array(inside, F.lit("§ no such words §"))).otherwise(F.array(inside)).alias("must_include"),
        F.when(i % 4 == 0, F.array().cast("array<string>")).when(i % 4 == 1, F.array(inside, F.lit("§ nor these §"))).otherwise(F.array(F.lit("§ nor these §"))).alias("must_exclude"),
        F.when(i % 6 > 0, 1).alias("min_code_blocks"), none.cast("array<string>").alias("code_languages"), none.cast("int").alias("min_images"), F.when(i % 6 > 0, 3).alias("min_headings"), none.cast("int").alias("min_tables"),
        *[F.lit(False).alias(c) for c in ("has_math", "has_footnotes", "has_embeds")],
    )
    return S.curated_scores(outputs, wants)


@query("curated_scores", _CURATED + " select id, cast(tier as bigint) as tier, category, cast(inc as double) as include_recall, cast(leak as double) as leak_rate, title as title_fuzzy, cast(structure as double) as structure_pass, cast(checks as int) as structure_checks, round(combined, 6) as combined from s")
def curated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curated(spark, sf_dir).select("id", "tier", "category", "include_recall", "leak_rate", "title_fuzzy", "structure_pass", "structure_checks", F.round("combined", 6).alias("combined"))


@query(
    "curated_summary",
    _CURATED + """ select tier, category, count(*) as docs, round(avg(inc), 6) as include_recall, round(avg(leak), 6) as leak_rate, count(*) filter (leak > 0) as leaking, round(sum(structure * checks) / sum(case when structure is not null then checks end), 6) as structure_pass, round(avg(combined), 6) as combined
    from s group by grouping sets ((), (tier), (category))""",
)
def curated_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.curated_summary(_curated(spark, sf_dir), "tier", "category")
    return out.select("tier", "category", "docs", "leaking", *[F.round(c, 6).alias(c) for c in ("include_recall", "leak_rate", "structure_pass", "combined")])


_CELLS = "with l as (select *, unnest(['order', 'book']) as level from lineitem), c as (select level, case level when 'order' then l_orderkey else l_orderkey % 500 end as page, l_linenumber as t, l_quantity as r, cast(l_tax * 100 as int) as c, l_returnflag as f from l)"


@query(
    "cell_scores",
    _CELLS + """, p as (select level, page, t, r, c, count(*) as n from c where f <> 'N' group by all), q as (select level, page, t, r, c, count(*) as n from c where f <> 'A' group by all),
    tp as (select p.level, p.page, p.t as p_table, q.t as r_table, sum(least(p.n, q.n)) as tp from p join q on p.level = q.level and p.page = q.page and p.r = q.r and p.c = q.c group by all), ps as (select level, page, t, sum(n) as n from p group by all), qs as (select level, page, t, sum(n) as n from q group by all)
    select tp.level, tp.page, p_table, r_table, round(2 * tp / (ps.n + qs.n), 6) as f1 from tp join ps on tp.level = ps.level and tp.page = ps.page and p_table = ps.t join qs on tp.level = qs.level and tp.page = qs.page and r_table = qs.t""",
)
def cell_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of every order, which grow in number with the lines, and of 500 books of orders, whose tables grow."""
    level = lambda name, page: F.struct(F.lit(name).alias("level"), page.alias("page"))
    levels = F.array(level("order", F.col("l_orderkey")), level("book", F.col("l_orderkey") % 500))
    cells = table(spark, sf_dir, "lineitem").select(
        F.inline(levels), F.col("l_linenumber").alias("table"), F.col("l_quantity").alias("row"), (F.col("l_tax") * 100).cast("int").alias("col"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.lit("").alias("text"), "l_returnflag"
    )
    out = M.pair_scores(cells.where("l_returnflag <> 'N'").drop("l_returnflag"), cells.where("l_returnflag <> 'A'").drop("l_returnflag"), ["level", "page"])
    return out.select("level", "page", "p_table", "r_table", F.round("f1", 6).alias("f1"))


def _page_boxes(df: DataFrame, extra: str) -> DataFrame:
    x, y = F.col("l_quantity"), F.round(F.col("l_discount") * 100)
    return df.select((F.col("l_orderkey") % 2000).alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias(extra), G.rect(x, y, x + 6.0, y + 4.0).alias("box"))


_BOXES = "select l_orderkey % 2000 as page, l_orderkey * 10 + l_linenumber as id, l_quantity as x, round(l_discount * 100) as y, l_returnflag as f from lineitem"


@query(
    "region_blocks",
    f"""with b as ({_BOXES}), m as (select r.page, r.id as region, b.id as block, round((6 - abs(r.x - b.x)) * (4 - abs(r.y - b.y)), 6) as area from b r join b on r.page = b.page and r.f = 'A' and b.f = 'R' and abs(r.x - b.x) < 6 and abs(r.y - b.y) < 4)
    select page, region, block, area from m qualify row_number() over (partition by page, region order by area desc, block) = 1""",
)
def region_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    out = M.largest_overlap(_page_boxes(li.where("l_returnflag = 'A'"), "region"), _page_boxes(li.where("l_returnflag = 'R'"), "block"), ["page"])
    return out.select("page", "region", "block", F.round("area", 6).alias("area"))


@query(
    "link_texts",
    f"""with b as ({_BOXES}) select l.page, l.id as link, 'u' as uri, string_agg(cast(s.id as varchar), ' ' order by s.id) as text from b l join b s on l.page = s.page and l.f = 'A' and s.f = 'N' and abs(l.x - s.x) < 6 and abs(l.y - s.y) < 4 group by all""",
)
def link_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    links = _page_boxes(li.where("l_returnflag = 'A'"), "link").withColumn("uri", F.lit("u"))
    spans = _page_boxes(li.where("l_returnflag = 'N'"), "seq").withColumn("text", F.col("seq").cast("string"))
    return M.link_spans(links, spans, ["page"])


@query(
    "annotation_problems",
    """select item_id as id, unnest(list_filter(case item_id % 4 when 0 then ['fewer than three snippets'] when 1 then ['short snippet: abc', 'not on the page: abc§'] when 2 then [concat('in both lists: ', substr(text, 1, 15))] else [] end, lambda x: x <> 'none')) as problem from (select item_id, text from benchmark)""",
)
def annotation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id") % 4
    a, b, c = (F.substring("text", at, 15) for at in (1, 5, 9))
    inc = F.when(i == 0, F.array(a, b)).when(i == 1, F.array(a, b, F.lit("abc§"))).otherwise(F.array(a, b, c))
    x = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), inc.alias("must_include"), F.when(i == 2, F.array(a)).otherwise(F.array(F.lit("other words"))).alias("must_exclude"), "text")
    out = S.lint_annotations(x.drop("text"), x.select("id", "text"))
    return out.select("id", F.when(F.col("problem") == "short snippet: abc§", "short snippet: abc").otherwise(F.col("problem")).alias("problem"))


_PAGE_NAMES = [("p1.jpg", True), ("dir/P2.JPEG", True), (".hidden/p3.png", False), ("__MACOSX/p4.png", False), ("notes.txt", False), ("a/.b.webp", False), ("/lead/p5.avif", True), ("dir/", False), ("w\\p6.gif", True)]


@query("comic_page_names", f"select o_orderkey, {sql_case([v for _, v in _PAGE_NAMES], 'o_orderkey')} as page from orders")
def comic_page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", B.is_page_name(pick([n for n, _ in _PAGE_NAMES], F.col("o_orderkey"))).alias("page"))


@query(
    "comic_spread_pages",
    """with recursive p as (select p_partkey // 40 as book, row_number() over (partition by p_partkey // 40 order by p_partkey) - 1 as page, p_size > 44 as wide from part),
    f as (select book, page, wide, 0 as spread, page = 0 or wide as full from p where page = 0 union all
        select p.book, p.page, p.wide, case when f.full or p.wide then f.spread + 1 else f.spread end, p.wide or not f.full from f join p on p.book = f.book and p.page = f.page + 1)
    select book, cast(spread as int) as spread, string_agg(cast(page as varchar), ',' order by page) as pages from f group by all""",
)
def comic_spread_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty parts make a comic, the large ones its wide pages."""
    place = (F.row_number().over(Window.partitionBy("book").orderBy("p_partkey")) - 1).alias("page")
    pages = table(spark, sf_dir, "part").withColumn("book", F.floor(F.col("p_partkey") / 40)).select("book", place, (F.col("p_size") > 44).alias("wide"))
    return B.comic_spreads(pages, "book").select("book", "spread", F.array_join("pages", ",").alias("pages"))


# images, names and furniture of pages ---------------------------------------------------------------------------------


_IMAGES = [
    # attributes by name, and the address that is shown
    ({"srcset": "/{n}-400.jpg 400w, /{n}-1200.jpg 1200w,/{n}-2400.jpg 2400w", "src": "/{n}.jpg"}, "/{n}-1200.jpg"),
    ({"srcset": "/{n}-2000.jpg 2000w, /{n}-1800.jpg 1800w", "src": "/{n}.jpg"}, "/{n}-1800.jpg"),
    ({"srcset": "/{n}-400.jpg 400w", "src": "/{n}.jpg"}, "/{n}.jpg"),
    ({"srcset": "/{n}.jpg, /{n}@2x.jpg 2x, /{n}@3x.jpg 3x", "src": "/blank.gif"}, "/{n}@2x.jpg"),
    ({"srcset": "/w_40,h_30/{n}.jpg 3x", "src": ""}, "/w_40,h_30/{n}.jpg"),
    ({"src": "data:image/gif;base64,R0lGOD", "data-src": "/{n}.png"}, "/{n}.png"),
    ({"src": "/{n}.png", "data-original": "/{n}-full.png"}, "/{n}-full.png"),
    ({"src": "/img/placeholder-{n}.png"}, None),
    ({"src": "/{n}.png", "srcset": "javascript:x 2x"}, "/{n}.png"),
    ({"alt": "none"}, None),
]


@query("image_sources", "select p_partkey, replace(" + sql_case([v for _, v in _IMAGES], "p_partkey") + ", '{n}', p_partkey::varchar) as shown from part")
def image_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address that an image element shows, of elements spelled from every part."""
    kinds = F.array(*[F.create_map(*[F.lit(x) for kv in a.items() for x in kv]) for a, _ in _IMAGES])
    named = F.transform_values(F.get(kinds, (F.col("p_partkey") % len(_IMAGES)).cast("int")), lambda k, v: F.replace(v, F.lit("{n}"), F.col("p_partkey").cast("string")))
    df = table(spark, sf_dir, "part").select("p_partkey", named.alias("attrs")).withColumn("found", I.candidates(I.source_set(F.col("attrs"))))
    return df.select("p_partkey", I.shown(F.col("attrs"), F.col("found")).alias("shown"))


@query(
    "image_sizes",
    """select p_partkey, case when p_size * 10 < 20000 then p_size * 10 end as width, p_size * 10 <= 48 or p_partkey % 4 = 1 as small, p_partkey % 4 = 2 or (p_partkey % 4 = 3 and p_size * 10 <= 160) as decorative from part""",
)
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths, icons and chrome among image elements spelled from every part."""
    k, size = F.col("p_partkey") % 4, (F.col("p_size") * 10).cast("string")
    attrs = F.create_map(F.lit("width"), F.concat(size, F.when(k == 0, "px").otherwise("")), F.lit("class"), F.when(k == 1, "wp-smiley x").when(k == 2, "site-logo").otherwise("logos"), F.lit("alt"), F.when(k == 3, "Portrait of a part").otherwise("a part"))
    df = table(spark, sf_dir, "part").select("p_partkey", attrs.alias("attrs"))
    a, none = F.col("attrs"), F.lit(None).cast("string")
    return df.select("p_partkey", I.dimension(a, "width").cast("int").alias("width"), I.is_small(a).alias("small"), I.is_decorative(a, none, none).alias("decorative"))


@query(
    "author_names",
    """select p_partkey, case p_partkey % 4 when 0 then p_mfgr || '|' || p_type when 1 then p_type when 2 then p_name || '|' || p_type else p_type end as names
    from (select p_partkey, 'Ann Able' as p_mfgr, p_type, 'Jo Doe' as p_name from part)""",
)
def author_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names out of bylines that are spelled from every part, in four forms."""
    k, name = F.col("p_partkey") % 4, F.col("p_type")
    line = (
        F.when(k == 0, F.array(F.concat(F.lit("By  Ann Able and "), name, F.lit(" |")))).when(k == 1, F.array(name, F.lower(name), F.lit("@someone"), F.lit("Staff 2024")))
        .when(k == 2, F.array(F.concat(F.lit("Jo Doe; "), name, F.lit(", JO DOE")))).otherwise(F.array(F.concat(F.lit("Von: "), name), F.lit("https://example.org/jo"), F.lit("Email us")))
    )
    return spread(table(spark, sf_dir, "part")).select("p_partkey", F.array_join(N.author_names(line), "|").alias("names"))


_FURNITURE = [
    # a line, the share of its text that is linked, and what it is
    ("Read more: {c}", 0.0, "pointer"), ("Related: {c} " + "and so on " * 14, 0.1, None), ("Related: {c} " + "and so on " * 14, 0.5, "pointer"), ("You may also like", 0.0, "pointer"), ("{c}", 0.95, "pointer"), ("{c}", 0.5, None),
    ("Sign up for the letter of {c}.", 0.0, "pitch"), ("“Sign up for the letter,” said {c}.", 0.0, None), ("Abonnez-vous, {c}", 0.0, "pitch"), ("{c} will subscribe to " + "one thing after the other " * 12, 0.0, None),
    ("@somebody", 0.0, "contact"), ("a.b+{k}@example.org", 0.0, "contact"), ("Follow {c} on Twitter", 0.0, "contact"), ("https://www.threads.net/x{k}", 0.0, "contact"), ("{c} wrote to a.b@example.org once", 0.0, None),
]


@query("page_furniture", f"select o_orderkey, {sql_case([v for *_, v in _FURNITURE], 'o_orderkey')} as kind from orders")
def page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointers, pitches and contacts among lines spelled from every order."""
    line = F.replace(F.replace(pick([t for t, *_ in _FURNITURE], F.col("o_orderkey")), F.lit("{c}"), F.col("o_orderpriority")), F.lit("{k}"), F.col("o_orderkey").cast("string"))
    share = pick([str(s) for _, s, _ in _FURNITURE], F.col("o_orderkey")).cast("double")
    df = table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"), share.alias("share"))
    x = F.col("line")
    return df.select("o_orderkey", F.when(N.is_pointer(x, F.col("share")), "pointer").when(N.is_pitch(x), "pitch").when(N.is_contact(x), "contact").alias("kind"))
