"""URL scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import SPACE, _c, clean_field, trim_space

#: Query parameters that only track. Articles' addresses and their keys drop different ones.
TRACKING = (
    "utm_[a-z_]+ fbclid gclid dclid gbraid wbraid msclkid mc_cid mc_eid ref ref_src ref_url cmpid ocid smid smtyp sr_share igshid _hsenc "
    "_hsmi mkt_tok spm share source via guccounter guce_referrer guce_referrer_sig"
).split()
KEY_TRACKING = "utm_[0-9A-Za-z_]+ fbclid gclid dclid igshid mc_cid mc_eid _hsenc _hsmi mkt_tok".split()
#: Last labels of hosts that are not public.
RESERVED = "localhost local internal test invalid onion arpa home lan".split()


def host_of(url: Column | str) -> Column:
    """Lower-cased host without user, port and www.; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(_c(url), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def _kept(query: Column, tracking: list[str]) -> Column:
    pattern = "(?i)^(?:" + "|".join(tracking) + ")$"
    return F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).rlike(pattern)), "&")


def canonical_url(url: Column | str) -> Column:
    """Without fragment and tracking parameters."""
    whole = F.substring_index(_c(url), "#", 1)
    kept = _kept(F.regexp_extract(whole, r"(?s)\?(.*)$", 1), TRACKING)
    base = F.substring_index(whole, "?", 1)
    return F.when(F.contains(whole, F.lit("?")) & (kept != ""), F.concat(base, F.lit("?"), kept)).otherwise(base)


def article_url_key(url: Column | str) -> Column:
    """What two addresses of one article share: no scheme, user, default port, www., end slash, fragment, tracking."""
    s = trim_space(url)
    pattern = r"(?i)^[a-z][a-z\d+.-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    host = F.lower(F.regexp_extract(F.regexp_extract(s, pattern, 1), r"([^@]*)$", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(s, pattern, 2), r"/+$", "")
    query = _kept(F.regexp_extract(s, pattern, 3), KEY_TRACKING)
    key = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(s.rlike(pattern), key).otherwise(s)


def article_id(url: Column | str) -> Column:
    """The first 128 bits of the key's SHA-256, in hex."""
    return F.substring(F.sha2(article_url_key(url), 256), 1, 32)


def same_site(a: Column | str, b: Column | str) -> Column:
    """The last two labels of both hosts are equal."""
    return (F.substring_index(host_of(a), ".", -2) == F.substring_index(host_of(b), ".", -2)) & (host_of(a) != "")


def has_userinfo(url: Column | str) -> Column:
    return _c(url).rlike(r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*@")


def path_of(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_public_article(url: Column | str) -> Column:
    """http(s) on the default port of a dotted public host name, without credentials; at most 2,048 characters."""
    s = _c(url)
    authority = F.regexp_extract(s, r"(?i)^https?://([^/?#]+)", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(authority, r":(?:80|443)$", "")), r"\.$", "")
    good = (F.length(s) <= 2048) & (host != "") & ~F.contains(host, F.lit("@")) & ~F.contains(host, F.lit(":")) & F.contains(host, F.lit("."))
    return F.coalesce(good & ~host.rlike(r"^\d+(?:\.\d+){3}$") & ~host.rlike(rf"(?:^|\.)(?:{'|'.join(RESERVED)})$"), F.lit(False))


def find_url(text: Column | str) -> Column:
    """The first http(s) address in a text of at most 4,096 characters, without closing marks."""
    s = trim_space(text)
    found = F.regexp_replace(F.regexp_extract(s, r"(?i)https?://[^\s<>\"'`]+", 0), "[.,;:!?'\"]+$", "")
    spare = F.regexp_count(found, F.lit(r"\)")) - F.regexp_count(found, F.lit(r"\("))
    closing = F.length(F.regexp_extract(found, r"\)*$", 0))
    balanced = F.substr(found, F.lit(1), F.length(found) - F.greatest(F.lit(0), F.least(spare, closing)))
    return F.when((F.length(s) <= 4096) & (found != ""), balanced)


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"""(?is)(?:^|[\s"'/]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", 0)
    return F.regexp_replace(F.regexp_replace(value, r"(?s)^[^=]*=\s*", ""), r"""^["']|["']$""", "")


def _meta(head: Column, key: str) -> Column:
    """Content of the first meta tag of a property or name that has some."""
    tags = F.regexp_extract_all(head, F.lit(r"(?i)<meta\b[^>]*>"), 0)
    is_key = lambda t: F.lower(F.coalesce(F.nullif(_attribute(t, "property"), F.lit("")), _attribute(t, "name"))) == key
    return _attribute(F.try_element_at(F.filter(tags, lambda t: is_key(t) & (_attribute(t, "content") != "")), F.lit(1)), "content")


def link_metadata(html: Column | str, url: Column | str) -> Column:
    """struct(title, description, icon) of a page's head."""
    head = F.element_at(F.split(_c(html), r"(?i)</head\s*>", 2), 1)
    title = F.coalesce(_meta(head, "og:title"), F.nullif(F.regexp_extract(head, r"(?is)<title\b[^>]*>(.*?)</title>", 1), F.lit("")), host_of(url))
    description = F.coalesce(_meta(head, "og:description"), _meta(head, "description"), F.lit(""))
    links = F.regexp_extract_all(head, F.lit(r"(?i)<link\b[^>]*>"), 0)
    icon = F.try_element_at(F.filter(links, lambda t: _attribute(t, "rel").rlike(r"(?i)(?:^|\s)(?:icon|shortcut icon)(?:\s|$)") & (_attribute(t, "href") != "")), F.lit(1))
    origin = F.regexp_extract(_c(url), r"(?i)^https?://[^/?#]+", 0)
    href = F.coalesce(_attribute(icon, "href"), F.lit("/favicon.ico"))
    full = F.when(href.rlike("(?i)^https?:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(origin, "^[^:]+:", 0), href)).when(href.startswith("/"), F.concat(origin, href))
    full = F.coalesce(full, F.concat(origin, F.regexp_extract(path_of(url), r"^(.*/)", 1), href))
    return F.struct(
        F.coalesce(F.nullif(clean_field(title, 160), F.lit("")), host_of(url)).alias("title"),
        clean_field(description, 320).alias("description"),
        F.when(full.rlike("(?i)^https:"), full).otherwise("").alias("icon"),
    )


def media_provider(url: Column | str) -> Column:
    """struct(provider, id) of a player's address; null for others."""
    s = _c(url)
    #: Hosts and paths of players.
    rules = [
        ("youtube", r"(?i)^https?://(?:www\.|m\.)?(?:youtube(?:-nocookie)?\.com/(?:embed/|watch\?(?:[^#]*&)?v=|shorts/|live/)|youtu\.be/)([\w-]{6,})"),
        ("vimeo", r"(?i)^https?://(?:www\.|player\.)?vimeo\.com/(?:video/)?(\d+)"),
        ("dailymotion", r"(?i)^https?://(?:www\.)?dailymotion\.com/(?:embed/)?video/(\w+)"),
        ("loom", r"(?i)^https?://(?:www\.)?loom\.com/(?:embed|share)/(\w+)"),
        ("ted", r"(?i)^https?://(?:www\.|embed\.)?ted\.com/talks/([\w-]+)"),
        ("spotify", r"(?i)^https?://open\.spotify\.com/(?:embed/)?((?:track|album|playlist|episode|show)/\w+)"),
        ("codepen", r"(?i)^https?://codepen\.io/[\w-]+/(?:embed|pen)/(?:preview/)?(\w+)"),
        ("streamable", r"(?i)^https?://streamable\.com/(?:[a-z]/)?(\w+)"),
    ]
    out = F.lit(None).cast("struct<provider:string,id:string>")
    for name, pattern in reversed(rules):
        out = F.when(s.rlike(pattern), F.struct(F.lit(name).alias("provider"), F.regexp_extract(s, pattern, 1).alias("id"))).otherwise(out)
    return out


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Column", "F", "SPACE")]
