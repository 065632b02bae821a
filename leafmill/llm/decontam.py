"""Benchmark decontamination by a distributed positional inverted index.

Words are lower-cased over A-Z and are runs of ``[0-9a-z]`` and everything
beyond ASCII. A window is ``width`` consecutive words of a benchmark item; an
item of fewer words, but not none, is one window.

1. Count in how many places each benchmark term stands in the corpus.
2. Each window names its two rarest terms. Windows of an item that name the
   same places of the item share them. A word of an item goes to the windows
   that hold it, at most ``width``; an item's words stand in one row only.
3. Store the postings (term, doc_id, pos) of those terms only, shift each by the
   term's place in the item, and intersect the shifted lists of both terms:
   what is in both is an alignment (doc, item, delta).
4. Compare the aligned words of document and item; runs that cover a whole
   window are exact occurrences. ``proximity_matches`` lists the places where
   both rarest terms stand within ``slop`` of their distance in the window.

Only DataFrame functions are used. Benchmark-side tables are broadcast when
they are counted, by rows and bytes, to be small, and are joined by shuffles
beyond that.

Defined results: null and empty texts have no words; null item texts and null
item_ids are ignored; items of equal text each count, and so does each text of
an item_id that has several. Rows that share a doc_id
are judged each on its own text. Rows with a null doc_id are judged as well. An
empty benchmark marks nothing. Extra columns are ignored, or kept by
``remove_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import checkpoint_root, cut, small_enough

WIDTH = 13
#: Rows of a benchmark-side table that may be broadcast, within the bytes that ``small_enough`` allows.
BROADCAST_ROWS = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def pieces(text: Column) -> Column:
    """The words of a text in order; the first and the last piece may be empty, no other."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), _GAP)


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.filter(pieces(text), lambda w: w != "")


def benchmark_items(items: DataFrame) -> DataFrame:
    """(item_id, key, words): the distinct texts with words; ``key`` tells texts of one item_id apart."""
    base = items.where("item_id is not null").select(F.col("item_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    return base.distinct().select("item_id", F.xxhash64("words").alias("key"), "words")


def item_terms(texts: DataFrame) -> DataFrame:
    """(item_id, key, size, place, term): one row for each word of an item, of ``size`` words."""
    return texts.select("item_id", "key", F.size("words").alias("size"), F.posexplode("words").alias("place", "term"))


def corpus_words(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, term): every word of every document, as a stream that is never stored whole; pos counts from an empty first piece, if there is one."""
    return docs.select(F.col("doc_id"), F.posexplode(pieces(F.col("text"))).alias("pos", "term"))


def term_bytes() -> Column:
    return F.octet_length("term")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df): places of each of ``terms`` in the whole corpus, counted map-side first."""
    hits = docs.select(F.explode(pieces(F.col("text"))).alias("term")).join(small_enough(terms, BROADCAST_ROWS, term_bytes()), "term", "left_semi")
    return terms.join(hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def rarest_anchors(terms: DataFrame, counts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(term, item_id, key, pair, place, which): the places of the two rarest terms of each window.

    Windows that hold a term which the corpus lacks occur nowhere and have
    none. A window of one distinct term names the same place twice.
    """
    known = terms.join(small_enough(counts, BROADCAST_ROWS, term_bytes()), "term")
    starts = F.sequence(F.greatest(F.col("place") - width + 1, F.lit(0)), F.least(F.col("place"), F.greatest(F.col("size") - width, F.lit(0))))
    ranked = known.select("item_id", "key", F.explode(starts).alias("start"), F.struct("df", "term", "place").alias("t"))
    ranked = ranked.groupBy("item_id", "key", "start").agg(F.sort_array(F.collect_list("t")).alias("r"))  # at most ``width`` each
    first = F.col("r")[0]
    second = F.coalesce(F.try_element_at(F.filter("r", lambda x: x["term"] != F.col("r")[0]["term"]), F.lit(1)), first)
    pairs = ranked.where(first["df"] > 0).select("item_id", "key", first.alias("a"), second.alias("b")).distinct()
    pair = F.concat_ws(":", F.col("a.place"), F.col("b.place"))
    end = lambda c, n: F.struct(F.col(f"{c}.term").alias("term"), F.col(f"{c}.place").alias("place"), F.lit(n).alias("which"))
    both = pairs.select("item_id", "key", pair.alias("pair"), F.explode(F.array(end("a", 1), end("b", 2))).alias("e"))
    return both.select(F.col("e.term").alias("term"), "item_id", "key", "pair", F.col("e.place").alias("place"), F.col("e.which").alias("which"))


def store_postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The inverted index of ``terms``: (term, doc_id, pos), stored in the shared folder."""
    return cut(corpus_words(docs).join(small_enough(terms, BROADCAST_ROWS, term_bytes()), "term", "left_semi").select("term", "doc_id", "pos"))


def alignments(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, item_id, key, delta): where the shifted lists of both rarest terms of a window intersect."""
    shifted = postings.join(small_enough(anchors, BROADCAST_ROWS, term_bytes() + 32), "term").select("doc_id", "item_id", "key", "pair", (F.col("pos") - F.col("place")).alias("delta"), "which")
    met = shifted.groupBy("doc_id", "item_id", "key", "pair", "delta").agg(F.bit_or("which").alias("which")).where("which = 3")
    return met.select("doc_id", "item_id", "key", "delta").distinct()


def store_index(docs: DataFrame, texts: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(postings, anchors) of the items' windows in ``docs``."""
    terms = item_terms(texts)
    anchors = cut(rarest_anchors(terms, term_counts(docs, terms.select("term").distinct()), width))
    return store_postings(docs, anchors.select("term").distinct()), anchors


def index_and_align(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(item texts, alignments) of ``items`` in ``docs``."""
    checkpoint_root(docs.sparkSession)
    texts = cut(benchmark_items(items))
    return texts, alignments(*store_index(docs, texts, width))


def occurrences(doc: Column, item: Column, delta: Column, width: int) -> Column:
    """Places in ``doc`` (0-based) where a window of ``item``, shifted by ``delta``, stands."""
    n = F.least(F.size(item), F.lit(width))
    low = F.greatest(F.lit(0), -delta)
    high = F.least(F.size(item), F.size(doc) - delta) - n
    starts = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    same = lambda s: F.slice(doc, delta + s + 1, n) == F.slice(item, s + 1, n)
    return F.transform(F.filter(starts, same), lambda s: delta + s)


def phrase_matches(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """All columns of ``docs`` in struct ``row``, n_words, and matches: array of (item_id, n, starts).

    ``starts`` are the exact places of the item's windows of n words in the document.
    """
    texts, aligned = index_and_align(docs, items, width)
    texts = texts.withColumnRenamed("words", "item")
    found = aligned.join(small_enough(texts, BROADCAST_ROWS, F.aggregate("item", F.lit(0), lambda n, w: n + F.octet_length(w) + 8)), ["item_id", "key"])
    found = found.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "item", "delta")).alias("found"))
    found = found.withColumnRenamed("doc_id", "found_doc").hint("shuffle_hash")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["doc_id"].alias("own"))
    joined = rows.join(found, F.col("own").eqNullSafe(F.col("found_doc")), "left").select("row", pieces(F.col("row.text")).alias("doc"), "found")
    one = lambda x: F.struct(
        x["item_id"].alias("item_id"),
        F.least(F.size(x["item"]), F.lit(width)).alias("n"),
        occurrences(F.col("doc"), x["item"], x["delta"], width).alias("starts"),
    )
    matches = F.filter(F.transform("found", one), lambda m: F.size(m["starts"]) > 0)
    empty = F.array().cast(joined.select(matches.alias("m")).schema["m"].dataType)
    gap = lambda at: (F.element_at("doc", at) == "").cast("int")
    n_words = F.size("doc") - gap(1) - F.when(F.size("doc") > 1, gap(-1)).otherwise(0)
    lead = lambda m: F.struct(m["item_id"].alias("item_id"), m["n"].alias("n"), F.transform(m["starts"], lambda s: s - gap(1)).alias("starts"))
    return joined.select("row", n_words.cast("long").alias("n_words"), F.transform(F.coalesce(matches, empty), lead).alias("matches"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = 0.05) -> DataFrame:
    """All columns of ``docs`` in struct ``row``, n_words, n_hit, items (sorted as strings) and contaminated.

    A document is contaminated when windows cover ``share`` of its words or more, and at least one.
    """
    out = phrase_matches(docs, items, width)
    covered = F.flatten(F.transform("matches", lambda m: F.flatten(F.transform(m["starts"], lambda s: F.sequence(s, s + m["n"] - 1)))))
    hit = F.size(F.array_distinct(covered)).cast("long")
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string"))))
    out = out.select("row", "n_words", hit.alias("n_hit"), names.alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= F.round(F.lit(share) * F.col("n_words"), 9)))


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 3, width: int = WIDTH) -> DataFrame:
    """(doc_id, item_id, pair, pos, near): both rarest terms of a window, within ``slop`` of their distance.

    Positions are dealt into blocks of ``2 * slop + 1`` and each list meets its
    own and both next blocks by equality, so that no list is joined whole.
    """
    postings, anchors = store_index(docs, cut(benchmark_items(items)), width)
    shifted = postings.join(small_enough(anchors, BROADCAST_ROWS, term_bytes() + 32), "term").withColumn("delta", F.col("pos") - F.col("place"))
    block = F.floor(F.col("delta") / (2 * slop + 1))
    left = shifted.where("which = 1").select("doc_id", "item_id", "key", "pair", "pos", F.col("delta").alias("d1"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    right = shifted.where("which = 2").select("doc_id", "item_id", "key", "pair", F.col("pos").alias("near"), F.col("delta").alias("d2"), block.alias("block"))
    met = left.join(right, ["doc_id", "item_id", "key", "pair", "block"]).where(F.abs(F.col("d1") - F.col("d2")) <= slop)
    return met.select("doc_id", "item_id", "pair", "pos", "near").distinct()


def remove_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = 0.05) -> DataFrame:
    """``docs`` without its contaminated rows; same columns."""
    return contamination(docs, items, width, share).where("not contaminated").select("row.*")
