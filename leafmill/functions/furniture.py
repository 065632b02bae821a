"""Author names, and lines of a page that are no part of its text: pointers to other pages, pitches, contacts.

Lines are read as words: fixed phrases are looked for between them.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions import text as T

# Words before and between names, words that no name holds, and the openings and wordings of furniture.
BYLINE_WORDS = ["by", "written by", "posted by", "words by", "author", "authors", "von", "par", "por", "di", "door", "av", "af", "przez", "автор", "от", "作者", "著者", "筆者", "文", "撰文", "글", "المؤلف", "بقلم", "מאת"]
NAME_JOINERS = ["and", "und", "et", "y"]
NO_NAME = ["affiliation", "email", "e-mail", "profile", "follow", "subscribe", "message"]
OPENINGS = [
    "see more", "read more", "read also", "also read", "related", "more", "don't miss", "dont miss", "watch", "watch now", "recommended", "must read", "trending", "click here", "related article",
    "related articles", "related stories", "related coverage", "more on this", "more from", "listen", "subscribe", "sign up", "follow us", "read next", "up next", "next",
]
POINTER_LINES = [
    "don't miss", "dont miss", "read more", "related", "see also", "recommended", "more stories", "trending", "most popular", "you may also like", "advertisement", "share this", "share this article",
]
PITCHES = [
    "sign up for", "sign up to", "sign up here", "sign up now", "sign up today", "signing up for", "signing up to", "signing up here", "signing up now", "signing up today",
    "subscribe to", "subscribe for", "subscribe now", "subscribe here", "subscribe today", "our newsletter", "our free newsletter", "our daily newsletter", "our weekly newsletter", "email list",
    "mailing list", "register as", "register for", "register now", "register today", "create account", "create a account", "create an account", "create free account", "create a free account",
    "create an free account", "download the", "download our", "follow us", "follow topics", "follow authors", "follow the authors", "support us", "support our", "patreon page", "on patreon",
    "donate to", "donate now", "donate today", "donate here", "become a member", "become a patron", "become a subscriber", "become a supporter", "buy it here", "we may earn commission",
    "we may earn a commission", "we may earn small commission", "we may earn a small commission", "affiliate link", "affiliate links", "affiliate commission", "purchase through links",
]
PITCHES_ELSEWHERE = ["suscribe", "suscríbe", "suscribirte", "suscríbirte", "descarga la", "boletín", "abonnez-vous", "inscrivez-vous", "téléchargez", "abonnieren sie", "jetzt herunterladen", "assine", "inscreva-se"]
NETWORKS = ["twitter", "x", "facebook", "instagram", "linkedin", "threads", "bsky"]
ASKING = ["follow", "contact", "email", "reach"]

_WORD = string.ascii_lowercase + string.digits + "_"


def _list(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _only(x: Column, characters: str) -> Column:
    """Whether a text that isn't empty has no other characters, whatever their case."""
    return (x != "") & (F.translate(F.lower(x), characters, "") == "")


def _one(value: Column, make) -> Column:  # noqa: ANN001
    """``make`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def clean_author(x: Column) -> Column:
    """A name without words before it and marks after it; null for addresses, numbers, labels, over eight words, and lengths outside of 2 to 100."""

    def after(line: Column) -> Column:
        """The line behind the byline word that it begins with: the word needs a space or a colon or dash behind it."""
        rest = F.transform(F.filter(_list(BYLINE_WORDS), lambda w: F.startswith(F.lower(line), w)), lambda w: F.substring(line, F.length(w) + 1, F.length(line)))
        marked = lambda r: F.array_contains(_list([":", "：", "-"]), F.substring(F.ltrim(r), 1, 1))
        rest = F.filter(rest, lambda r: marked(r) | F.startswith(r, F.lit(" ")))
        return F.coalesce(F.get(F.transform(rest, lambda r: F.when(marked(r), F.ltrim(F.substring(F.ltrim(r), 2, F.length(r)))).otherwise(F.ltrim(r))), F.lit(0)), line)

    def name(s: Column) -> Column:
        low, end = F.lower(s), F.rtrim(s)
        unmarked = F.when(F.array_contains(_list(["|", "·", "•", ","]), F.right(end, F.lit(1))), F.left(end, F.length(end) - 1)).otherwise(end)
        no_name = F.exists(_list([*NO_NAME, "@"]), lambda w: F.contains(low, w)) | F.startswith(low, F.lit("http://")) | F.startswith(low, F.lit("https://")) | s.rlike("[0-9]{2}")
        return F.when(~no_name & (F.size(F.split(s, " ")) < 9), F.trim(unmarked))

    found = _one(_one(T.collapse(x), after), name)
    return _one(found, lambda n: F.when(F.length(n).between(2, 100), n))


def author_names(values: Column) -> Column:
    """The distinct names of an array of bylines, ignoring case, as first written."""
    apart = F.flatten(F.transform(values, lambda v: F.split(F.regexp_replace(v, rf"(?i)\b({'|'.join(NAME_JOINERS)})\b", "\n"), "[,;&،\n]")))
    names = F.array_compact(F.transform(apart, clean_author))
    # names and their folded forms are variables, worked out once and not once for each name
    firsts = lambda ns: _one(F.transform(ns, F.lower), lambda folded: F.filter(ns, lambda n, i: F.array_position(folded, F.lower(n)) == i + 1))
    return _one(names, firsts)


def is_pointer(text: Column, link_share: Column, stacked: Column | None = None) -> Column:
    """A line that leads to other pages: by the phrase before its first mark (with links, or short), by its whole wording, or one that is all links and short or ``stacked`` over line breaks."""
    low = F.lower(text)
    opening = F.trim(F.get(F.split(low, "[:|>»–—-]", 2), F.lit(0)))
    opens = F.array_contains(_list(OPENINGS), opening) & (F.size(F.split(low, "[:|>»–—-]", 2)) == 2)
    whole = F.array_contains(_list(POINTER_LINES), low) | (F.startswith(low, F.lit("more great ")) & F.endswith(low, F.lit(" stories")) & (F.length(low) > 18))
    links = (link_share >= 0.9) & ((F.length(text) < 160) | (F.lit(False) if stacked is None else stacked))
    return (text != "") & (opens & ((link_share > 0.4) | (F.length(text) < 120)) | whole | links)


def is_pitch(text: Column) -> Column:
    """A call to sign up, subscribe, download, follow or support, under 300 characters; quoted speech is none."""

    def said(words: Column) -> Column:
        app = F.exists(F.transform(words, lambda w, i: F.struct(w.alias("w"), F.slice(words, i + 2, 3).alias("on"))), lambda x: (x["w"] == "get") & F.get(x["on"], F.lit(0)).isin("the", "our") & F.array_contains(F.slice(x["on"], 2, 2), "app") & ((F.get(x["on"], F.lit(1)) == "app") | _only(F.get(x["on"], F.lit(1)), _WORD)))
        spaced = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        return _one(spaced, lambda line: F.exists(_list([f" {p} " for p in PITCHES]), lambda p: F.contains(line, p))) | F.coalesce(app, F.lit(False))

    # marks are words of their own, so no phrase runs over them; the words are a variable, or each of them would have the line cut again
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+|[^a-z0-9_ ]"), F.lit(0))
    elsewhere = _one(F.lower(text), lambda low: F.exists(_list(PITCHES_ELSEWHERE), lambda p: F.contains(low, p)))
    # only lines that are short enough are cut into words
    return F.when((text != "") & (F.length(text) < 300) & ~F.array_contains(_list(list("\"“„«'‘")), F.left(text, F.lit(1))), _one(words, said) | elsewhere).otherwise(False)


def is_contact(text: Column) -> Column:
    """A line of up to 120 characters that is an address of mail, a profile or a handle, or asks to be followed or written to there."""
    low = F.lower(text)
    sides = F.split(text, "@", -1)
    host = F.split(F.get(sides, F.lit(1)), "[.]", 2)
    mail = (F.size(sides) == 2) & _only(F.get(sides, F.lit(0)), _WORD + ".+-") & _only(F.get(host, F.lit(0)), _WORD + "-") & _only(F.get(host, F.lit(1)), _WORD + ".-")
    bare = F.regexp_replace(F.regexp_replace(low, "^https?://", ""), "^www[.]", "")
    site = F.split(bare, "/", 2)
    profile = F.array_contains(_list([f"{n}.{d}" for n in NETWORKS for d in ("com", "app", "net")]), F.get(site, F.lit(0))) & (F.get(site, F.lit(1)) != "") & ~F.contains(bare, F.lit(" "))
    handle = (F.size(sides) == 2) & (F.get(sides, F.lit(0)) == "") & _only(F.get(sides, F.lit(1)), _WORD) & F.length(text).between(3, 31)
    first = F.regexp_extract(low, "^[a-z0-9_]+", 0)
    rest = F.substring(low, F.length(first) + 1, F.length(low))
    where = F.array(F.instr(rest, "@"), F.instr(rest, "twitter"), F.regexp_instr(rest, F.lit("on x(?![a-z0-9_])")))
    asks = F.array_contains(_list(ASKING), first) & F.exists(where, lambda p: p.between(1, 81))
    return (F.length(text) <= 120) & F.coalesce(mail | profile | handle | asks, F.lit(False))
