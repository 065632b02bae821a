"""Text scalars as Column expressions.

White space classes are written out, because engines disagree on ``\\s``:
``SPACE`` is what counts as white space between words, ``HTML_SPACE`` what HTML
collapses.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

SPACE = r"\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
HTML_SPACE = r"\t\n\f\r "
#: The characters of ``SPACE`` one by one.
_SPACES = "".join(chr(c) for c in (*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}"
ZERO_WIDTH = r"\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}"
#: The ASCII comma and those of other scripts.
COMMAS = ",\u060c\u07f8\u1802\u1808\u2e32\u2e34\u2e41\u2e4c\u2e4e\u3001\ua4fe\ua60d\ua6f5\ufe11\ufe50\ufe51\uff0c\uff64"
WORDS_PER_MINUTE = 230

#: Code labels that name the same language, and labels that name none.
LANGUAGE_ALIASES = {
    "javascript": "js jsx mjs cjs node",
    "typescript": "ts tsx",
    "python": "py python3 py3 pycon ipython",
    "bash": "sh shell zsh console shellscript shell-session shellsession terminal",
    "powershell": "ps ps1 pwsh",
    "rust": "rs",
    "go": "golang",
    "ruby": "rb",
    "kotlin": "kt kts",
    "cpp": "c++ cc cxx hpp",
    "csharp": "c# cs",
    "fsharp": "f# fs",
    "yaml": "yml",
    "markdown": "md mdx",
    "html": "htm xhtml markup vue",
    "xml": "svg",
    "sql": "postgres postgresql mysql plpgsql sqlite psql",
    "docker": "dockerfile",
    "objectivec": "objc objective-c",
    "haskell": "hs",
    "elixir": "ex exs",
    "css": "scss sass less",
    "json": "jsonc json5",
    "ini": "conf",
}
NO_LANGUAGE = "text plain plaintext txt none nohighlight output code raw default auto"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_space(x: Column | str) -> Column:
    """Without white space at both ends."""
    return F.trim(_c(x), F.lit(_SPACES))  # looks at the ends alone, where a pattern tries every character


def collapse(x: Column | str) -> Column:
    """Runs of HTML white space as one space, trimmed."""
    return trim_space(F.regexp_replace(_c(x), f"[{HTML_SPACE}]+", " "))


def visible_length(x: Column | str) -> Column:
    """Length as rendered: runs of HTML white space count once, edges not at all."""
    return F.length(F.trim(F.regexp_replace(_c(x), f"[{HTML_SPACE}]+", " ")))


def utf16_length(x: Column | str) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(_c(x), "UTF-16BE")) / 2).cast("int")


def count_words(x: Column | str) -> Column:
    """White-space-separated words; CJK characters split words and count half, rounded up."""
    words = F.regexp_count(_c(x), F.lit(f"[^{SPACE}{CJK}]+"))
    # most texts have none of these, and finding that out is quicker than counting
    return F.when(_c(x).rlike(f"[{CJK}]"), words + F.ceil(F.regexp_count(_c(x), F.lit(f"[{CJK}]")) / 2)).otherwise(words).cast("int")


def reading_minutes(words: Column | str) -> Column:
    return F.greatest(F.lit(1), F.ceil(_c(words) / WORDS_PER_MINUTE)).cast("int")


def comma_count(x: Column | str) -> Column:
    """Commas of many scripts."""
    return F.regexp_count(_c(x), F.lit(f"[{COMMAS}]"))


def comparable(x: Column | str) -> Column:
    """Lower case, with one space for each run of what is neither letter nor number."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{N}]+", " "))


def tokens(x: Column | str) -> Column:
    """Runs of letters, numbers and underscores, as they stand."""
    return F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), 0)


def ngrams(words: Column | str, n: int) -> Column:
    """Joined n-grams of an array; fewer than n words give one short n-gram, none give none."""

    def grams(w: Column) -> Column:
        last = F.greatest(F.size(w) - n + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(w, i, n), "\u0001"))

    # inside the outer transform the words are a variable, computed once and not once for each n-gram
    once = F.element_at(F.transform(F.array(_c(words)), lambda w: F.when(F.size(w) > 0, grams(w))), 1)
    return F.coalesce(once, F.array().cast("array<string>"))


def ngram_keys(words: Column | str, n: int) -> Column:
    """As ``ngrams``, each as two hashes of 96 bits in all: what texts share is counted by keys of 12 bytes."""

    def keys(w: Column) -> Column:
        last = F.greatest(F.size(w) - n + 1, F.lit(1))
        key = lambda g: F.struct(F.xxhash64(g).alias("a"), F.hash(g).alias("b"))
        return F.transform(F.sequence(F.lit(1), last), lambda i: key(F.slice(w, i, n)))

    once = F.element_at(F.transform(F.array(_c(words)), lambda w: F.when(F.size(w) > 0, keys(w))), 1)
    return F.coalesce(once, F.array().cast("array<struct<a:bigint,b:int>>"))


def normalize_lines(x: Column | str) -> Column:
    """Lines without zero-width characters, collapsed and trimmed, empty ones dropped."""
    clean = F.when(_c(x).rlike(f"[{ZERO_WIDTH}]"), F.regexp_replace(_c(x), f"[{ZERO_WIDTH}]", "")).otherwise(_c(x))
    # white space within lines at once, before the lines are told apart; what isn't a single space already is rare
    inner = rf"{SPACE}&&[^\n\r\x{{2028}}\x{{2029}}]"
    flat = F.regexp_replace(clean, rf"[{inner}&&[^ ]][{inner}]*| [{inner}]+", " ")
    lines = F.transform(F.split(flat, r"\r\n|[\n\r\x{2028}\x{2029}]"), lambda s: F.trim(s))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def fold_typography(x: Column | str) -> Column:
    """Lower case, plain quotes, dashes and dots, no white space: a key for verbatim matches.

    The input is taken as NFKC already; ``nfkc`` makes it so.
    """
    s = F.lower(_c(x))
    s = F.regexp_replace(s, "[‘’‚‛′´`]", "'")
    s = F.regexp_replace(s, "[“”„‟″«»]", '"')
    s = F.regexp_replace(s, "[‐-―−]", "-")
    s = F.regexp_replace(s, "…", "...")
    return F.regexp_replace(s, f"[{SPACE}{ZERO_WIDTH}]+", "")


@F.pandas_udf(StringType())
def nfkc(x):  # noqa: ANN001, ANN201
    """Unicode NFKC, which Spark has no function for."""
    return x.str.normalize("NFKC")


def match_key(x: Column | str) -> Column:
    return fold_typography(nfkc(_c(x)))


def title_words(x: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(x)), F.lit(r"[\p{L}\p{N}]+"), 0))


def title_match(expected: Column | str, actual: Column | str) -> Column:
    """struct(exact, fuzzy) of two titles: equal keys, one inside the other, or mostly equal words."""
    a, b = fold_typography(expected), fold_typography(actual)
    x, y = title_words(expected), title_words(actual)
    both = F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(F.array_union(x, y)))
    inside = (F.contains(b, a) & (F.length(a) >= 0.4 * F.length(b))) | (F.contains(a, b) & (F.length(b) >= 0.6 * F.length(a)))
    exact = (b != "") & (a == b)
    return F.struct(exact.alias("exact"), (exact | ((b != "") & (inside | (both >= 0.8)))).alias("fuzzy"))


def canonical_language(x: Column | str) -> Column:
    """Language id of a code label; null for labels of no language."""
    s = F.lower(trim_space(x))
    names = F.create_map(*[F.lit(v) for k, vs in LANGUAGE_ALIASES.items() for v in [w for a in vs.split() for w in (a, k)]])
    named = F.coalesce(F.try_element_at(names, s), s)
    return F.when(s.isNull() | (s == "") | s.isin(NO_LANGUAGE.split()), None).otherwise(named)


def direction(x: Column | str) -> Column:
    """'rtl' if the first 3,000 characters hold more right-to-left letters than others, else 'ltr'."""
    s = F.substring(_c(x), 1, 3000)
    rtl = F.regexp_count(s, F.lit(r"[\x{590}-\x{8FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]"))
    ltr = F.regexp_count(s, F.lit(r"[A-Za-z\x{C0}-\x{24F}\x{370}-\x{52F}\x{3040}-\x{9FFF}]"))
    return F.when(rtl > ltr, "rtl").otherwise("ltr")


def clip_at_word(x: Column | str, limit: int) -> Column:
    """At most ``limit`` characters, cut before a word, with an ellipsis."""
    s = _c(x)
    cut = F.regexp_replace(F.substring(s, 1, limit - 3), f"[{SPACE}]+[^{SPACE}]*$", "")
    return F.when(F.length(s) > limit, F.concat(cut, F.lit("…"))).otherwise(s)


def excerpt(description: Column | str, paragraphs: Column | str) -> Column:
    """A description of 20 characters or more, else the first paragraph of 40 or more, else the description."""
    d = _c(description)
    first = F.try_element_at(F.filter(_c(paragraphs), lambda p: F.length(p) >= 40), F.lit(1))
    return F.when(F.length(d) >= 20, clip_at_word(d, 400)).otherwise(F.coalesce(clip_at_word(first, 300), d))


def clean_field(x: Column | str, limit: int) -> Column:
    """Control characters as spaces, collapsed, at most ``limit`` characters."""
    s = F.regexp_replace(_c(x), r"[\x00-\x1F\x7F]", " ")
    return F.substring(trim_space(F.regexp_replace(s, f"[{SPACE}]+", " ")), 1, limit)


def title_from_file_name(x: Column | str) -> Column:
    """The base name without its extension, underscores as spaces."""
    base = F.regexp_extract(_c(x), r"([^/\\]*)$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(base, r"\.[^.]+$", ""), "_+", " "))


def decode_numeric(x: Column | str) -> Column:
    """Numeric entities, decimal or hex, as their characters; numbers that are no character stay as they are."""

    def one(part: Column) -> Column:
        """A piece that began with ``&#``."""
        digits = F.regexp_extract(part, "^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", 1)
        number = F.when(F.lower(F.left(digits, F.lit(1))) == "x", F.conv(F.substring(digits, 2, 6), 16, 10)).otherwise(digits).try_cast("int")
        fits = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        # the four bytes of UTF-32 say the character
        char = F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32")
        return F.when((digits != "") & fits, F.concat(char, F.substring(part, F.length(digits) + 2, F.length(part)))).otherwise(F.concat(F.lit("&#"), part))

    pieces = F.split(_c(x), "&#", -1)
    return F.when(F.contains(_c(x), F.lit("&#")), F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), one), ""))).otherwise(_c(x))


def decode_entities(x: Column | str) -> Column:
    """The five XML entities and the no-break space, and numeric entities."""
    s = decode_numeric(x)
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", "\u00a0"), ("amp", "&")):
        s = F.replace(s, F.lit(f"&{name};"), F.lit(char))
    return s


def ligatures(x: Column | str) -> Column:
    """Latin ligatures spelled out, soft hyphens dropped."""
    s = F.translate(_c(x), "\u00ad", "")
    for lig, plain in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        s = F.replace(s, F.lit(lig), F.lit(plain))
    return s


def format_bytes(x: Column | str) -> Column:
    n = _c(x)
    kb, mb, gb = 1024, 1024**2, 1024**3
    return (
        F.when(n < kb, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < mb, F.concat(F.round(n / kb).cast("long").cast("string"), F.lit(" KB")))
        .when(n < gb, F.format_string("%.1f MB", n / mb))
        .otherwise(F.format_string("%.1f GB", n / gb))
    )


def edit_distance(a: str, b: str, near: int = 200) -> int:
    """Levenshtein distance of texts of any length.

    Up to ``near`` edits by furthest reaching diagonals, which take as many steps
    as the square of the edits; beyond that a bit for each character of the
    shorter text in one whole number, a step for each of the longer.
    """
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)

    def alike(i: int, j: int) -> int:
        """How far both texts agree from i and j on: pieces that double while they are equal, then halve."""
        start, step = i, 64
        while step:
            if i + step <= m and j + step <= n and a[i : i + step] == b[j : j + step]:
                i, j, step = i + step, j + step, step * 2
            else:
                step //= 2
        return i - start

    reach = {0: alike(0, 0)}
    for edits in range(near + 1):
        if edits:
            wider = {}
            for d in range(-edits, edits + 1):  # d: how much further along b than along a
                i = max(reach.get(d, -2) + 1, reach.get(d + 1, -2) + 1, reach.get(d - 1, -2))
                if 0 <= i <= m and i + d <= n:
                    wider[d] = i + alike(i, i + d)
                elif i > m and m + d <= n:
                    wider[d] = m
            reach = wider
        if reach.get(n - m, -1) >= m:
            return edits
    if not m:
        return n
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    whole, last = (1 << m) - 1, 1 << m - 1
    more, less, score = whole, 0, m
    for c in b:
        eq = place.get(c, 0)
        down = (((eq & more) + more) ^ more) | eq | less
        up, fall = less | ~(down | more) & whole, more & down
        score += bool(up & last) - bool(fall & last)
        up, fall = (up << 1 | 1) & whole, fall << 1 & whole
        more, less = fall | ~(down | up) & whole, up & down
    return score


@F.pandas_udf(LongType())
def _long_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def edit_accuracy(a: Column | str, b: Column | str, short: int = 2_000) -> Column:
    """1 - Levenshtein / longer length, of texts of any length; beyond ``short`` characters the distance is worked out in Arrow batches, by bits."""
    a, b = _c(a), _c(b)
    longest = F.greatest(F.length(a), F.length(b))
    far = longest > short
    distance = F.when(far, _long_distance(F.when(far, a), F.when(far, b))).otherwise(F.levenshtein(a, b))
    return F.when(longest == 0, 1.0).otherwise(1 - distance / longest)


def fragment_coverage(x: Column | str, text: Column | str, width: int = 32) -> Column:
    """Share of the fixed-width fragments of ``x`` that ``text`` holds."""
    s, t = _c(x), _c(text)
    starts = F.when(F.length(s) >= width, F.sequence(F.lit(1), F.length(s) - width + 1, F.lit(width))).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, lambda i: F.contains(t, F.substr(s, i, F.lit(width))))) / F.size(starts)
