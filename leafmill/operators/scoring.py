"""Extraction quality as DataFrame operators: shingle overlap, macro scores, bootstrap, curated checks, ranks.

Texts are compared per id where both of them meet in one row; shingles of texts
that stand in different tables are exploded and counted map-side first. Neither a
text nor a shingle is ever collected.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.session import TASK_BYTES, broadcastable, pieces, text_batches

#: Weights of the combined curated score; missing parts are dropped and the rest renormalised.
COMBINED_WEIGHTS = {"include": 0.5, "exclude": 0.2, "title": 0.1, "structure": 0.2}
#: Upper bounds of the HTML sizes by which latencies are grouped.
SIZE_BUCKETS = [("<50KB", 50_000), ("50-200KB", 200_000), ("200-500KB", 500_000), ("0.5-1MB", 1_000_000), (">1MB", None)]


def shingle_counts(df: DataFrame, key: str, text: str, n: int = 4) -> DataFrame:
    """(key, shingle, n): multiset of the word n-grams of each text, by their keys."""
    grams = df.select(key, F.explode(T.ngram_keys(T.tokens(text), n)).alias("shingle"))
    return grams.groupBy(key, "shingle").agg(F.count(F.lit(1)).alias("n"))


def shared_counts(rows: DataFrame, key: str, first: Column, second: Column, keep: list[str], n: int = 1) -> DataFrame:
    """(row of key and keep, lead, shared, firsts, seconds, exact): the word n-grams that two texts share, as often as both hold them, and how many each has.

    The counts are those of all rows of a key, which stand with each of them in
    their order; ``lead`` marks one row a key. ``exact``: whether a row's texts
    have the same words, null where one is null. Only the texts are shuffled: n-grams
    are counted where a key's rows meet, and partitions grow in number, not in size.
    """
    placed = rows.repartition(pieces(rows, F.octet_length(first) + F.octet_length(second), TASK_BYTES), key).sortWithinPartitions(key)
    words = lambda text: F.when(text.isNotNull(), F.array_join(T.tokens(text), " "))
    carried = F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([key, *keep])]).alias("row")
    kind = rows.select(carried).schema["row"].dataType.simpleString()
    schema = f"row {kind}, lead boolean, shared long, firsts long, seconds long, exact boolean"
    names = ["row", "lead", "shared", "firsts", "seconds", "exact"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, held = Counter(), Counter(), []
        last, types = None, None

        def grams(words: list[str]) -> list | Iterator[tuple]:
            return words if n == 1 else zip(*(words[i:] for i in range(n)), strict=False) if len(words) >= n else [tuple(words)] if words else []

        def counted() -> list[tuple]:
            shared = sum([min(c, two[g]) for g, c in one.items() if g in two])
            sums = shared, one.total(), two.total()
            return [(row, i == 0, *sums, exact) for i, (row, exact) in enumerate(held)]

        def put(out: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for batch in batches:
            types = [batch.schema.field("row").type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            out: list[tuple] = []
            for k, row, x, y in zip(*(batch[c].to_pylist() for c in ("k", "row", "x", "y")), strict=True):
                if held and k != last:
                    out += counted()
                    one, two, held = Counter(), Counter(), []
                last = k
                a, b = (t.split(" ") if t else [] for t in (x, y))
                one.update(grams(a))
                two.update(grams(b))
                held.append((row, None if x is None or y is None else a == b))
            if out:
                yield put(out)
        if held:
            yield put(counted())

    return text_batches(placed.select(F.col(key).alias("k"), carried, words(first).alias("x"), words(second).alias("y"))).mapInArrow(run, schema)


def shingle_shares(rows: DataFrame, key: str, first: Column, second: Column, keep: list[str], n: int = 4) -> DataFrame:
    """(key, keep..., tp, fp, fn, exact) of two texts of every row; the counts are shares that sum to 1, or 0 for two empty texts and without a key."""
    names = list(dict.fromkeys([key, *keep]))
    fp, fn = F.col("firsts") - F.col("shared"), F.col("seconds") - F.col("shared")
    total = F.when(F.col(f"row.{key}").isNotNull(), F.nullif(F.col("shared") + fp + fn, F.lit(0)))
    share = lambda c: F.coalesce(c / total, F.lit(0.0))
    met = shared_counts(rows, key, first, second, keep, n)
    return met.select(*[F.col(f"row.{c}") for c in names], share(F.col("shared")).alias("tp"), share(fp).alias("fp"), share(fn).alias("fn"), "exact")


def shingle_match(outputs: DataFrame, truth: DataFrame, key: str = "id", text: str = "text", n: int = 4) -> DataFrame:
    """(key, tp, fp, fn, exact) for every id of both sides, as ``shingle_shares``; a null text is an empty one."""
    side = lambda df, name: df.select(key, F.coalesce(text, F.lit("")).alias(name))
    pairs = side(outputs, "p_text").join(side(truth, "t_text"), key)
    return shingle_shares(pairs, key, F.col("p_text"), F.col("t_text"), [], n)


def shingle_overlap(docs: DataFrame, key: str, items: DataFrame, item: str, text: str = "text", n: int = 4) -> DataFrame:
    """(key, item, tp, fp, fn): shared and other shingles of every pair of a text and an item that share some.

    A text's shingles are looked up among the items' before anything is counted
    or shuffled; only those that some item has go on.
    """
    b = shingle_counts(items, item, text, n).withColumnRenamed("n", "m")
    known = broadcastable(b.select("shingle").distinct(), F.lit(16))
    grams = docs.select(key, F.explode(T.ngram_keys(T.tokens(text), n)).alias("shingle"))
    hits = grams.join(known, "shingle", "left_semi").groupBy(key, "shingle").agg(F.count(F.lit(1)).alias("n"))
    met = hits.join(broadcastable(b, F.lit(40)), "shingle").groupBy(key, item).agg(F.sum(F.least("n", "m")).alias("tp"))
    count = F.greatest(F.size(T.tokens(text)) - n + 1, F.lit(1)).cast("long")
    sizes = docs.select(key, count.alias("dn"))
    out = met.join(sizes, key).join(b.groupBy(item).agg(F.sum("m").alias("bn")), item)
    return out.select(key, item, "tp", (F.col("dn") - F.col("tp")).alias("fp"), (F.col("bn") - F.col("tp")).alias("fn"))


def precision(tp: Column, fp: Column, fn: Column) -> Column:
    """1 where both sides are empty, 0 where only the prediction is."""
    return F.when(tp + fp + fn == 0, 1.0).when(tp + fp == 0, 0.0).otherwise(tp / F.nullif(tp + fp, F.lit(0.0)))


def recall(tp: Column, fp: Column, fn: Column) -> Column:
    return precision(tp, fn, fp)


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))


def macro_scores(matches: DataFrame, *by: str) -> DataFrame:
    """(by, docs, precision, recall, f1, accuracy): means over the documents where each is defined, F1 of the means."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = matches.groupBy(*by).agg(
        F.count(F.lit(1)).alias("docs"),
        F.coalesce(F.avg(F.when(tp + fp > 0, tp / (tp + fp))), F.lit(0.0)).alias("precision"),
        F.coalesce(F.avg(F.when(tp + fn > 0, tp / (tp + fn))), F.lit(0.0)).alias("recall"),
        F.avg(F.col("exact").cast("double")).alias("accuracy"),
    )
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def mulberry32(seed: int):
    """The generator's next draws from [0, 1), one at a time."""
    state = seed & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ (t >> 7)) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        yield ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296


def bootstrap_scores(matches: DataFrame, by: str, resamples: int = 1000, seed: int = 1) -> DataFrame:
    """(by, low, high, f1_std, precision_std, recall_std, accuracy_std): 95 % percentile interval of the macro F1 and deviations.

    The draws are one seeded sequence, so the resamples of an engine are made in
    order; the interval's ends are the values of ranks 2.5 % and 97.5 % (rounded
    up, less one). One group is an engine's documents of a benchmark: hundreds.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        tp, fp, fn = (frame[c].to_numpy() for c in ("tp", "fp", "fn"))
        exact = frame["exact"].to_numpy(float)
        n, draw = len(frame), mulberry32(seed)
        with np.errstate(invalid="ignore"):
            p, r = np.where(tp + fp > 0, tp / (tp + fp), np.nan), np.where(tp + fn > 0, tp / (tp + fn), np.nan)
        rows = []
        for _ in range(resamples):
            at = np.array([int(next(draw) * n) for _ in range(n)])
            a, b = p[at][~np.isnan(p[at])], r[at][~np.isnan(r[at])]
            a, b = (a.mean() if len(a) else 0.0), (b.mean() if len(b) else 0.0)
            rows.append((2 * a * b / (a + b) if a + b else 0.0, a, b, exact[at].mean()))
        scores = np.array(rows)
        ranked = np.sort(scores[:, 0])
        spread = scores.std(0, ddof=1) if resamples > 1 else np.zeros(4)
        ends = [float(ranked[int(0.025 * resamples)]), float(ranked[math.ceil(0.975 * resamples) - 1])]
        return pd.DataFrame([[frame[by].iloc[0], *ends, *map(float, spread)]], columns=[by, "low", "high", "f1_std", "precision_std", "recall_std", "accuracy_std"])

    rows = matches.select(by, F.col("id").cast("string").alias("id"), "tp", "fp", "fn", F.col("exact").cast("double").alias("exact"))
    return rows.groupBy(by).applyInPandas(run, f"{by} {matches.schema[by].dataType.simpleString()}, low double, high double, f1_std double, precision_std double, recall_std double, accuracy_std double")


def multiset_matches(a: DataFrame, b: DataFrame, key: str, item: str) -> DataFrame:
    """(key, matched, first, second): items that two multisets share, as often as both hold them, and the sizes of both."""
    named = lambda df, x, y: df.groupBy(F.col(key).alias("_key"), F.col(item).alias("_item")).agg(F.count(F.lit(1)).alias("n")).select("_key", "_item", (F.col("n") * x).alias("p"), (F.col("n") * y).alias("t"))
    met = named(a, 1, 0).unionByName(named(b, 0, 1)).groupBy("_key", "_item").agg(F.sum("p").alias("p"), F.sum("t").alias("t"))
    return met.groupBy(F.col("_key").alias(key)).agg(F.sum(F.least("p", "t")).alias("matched"), F.sum("p").alias("first"), F.sum("t").alias("second"))


def warning_groups(warnings: DataFrame, *by: str) -> DataFrame:
    """(by, message, pages): the pages of each message, in order, each once."""
    return warnings.groupBy(*by, "message").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def top_candidates(scores: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The ``n`` best candidates of each ``key``, by falling score and then place in the document; (key, place, score, rank)."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "place"))  # Spark keeps n rows a key before it shuffles
    return scores.select(key, "place", "score", place.alias("rank")).where(F.col("rank") <= n)


def counter_f1(rows: DataFrame, key: str, first: Column, second: Column) -> DataFrame:
    """(key, f1): overlap of the multisets of words of two texts, for every key with a word; rows without a key share nothing."""
    met = shared_counts(rows, key, first, second, []).where(F.col("lead") & (F.col("firsts") + F.col("seconds") > 0))
    shared = F.when(F.col(f"row.{key}").isNotNull(), F.col("shared")).otherwise(0)
    return met.select(F.col(f"row.{key}"), (2 * shared / (F.col("firsts") + F.col("seconds"))).alias("f1"))


def uncovered_lines(df: DataFrame, key: str, text: str, other: str, n: int = 4) -> DataFrame:
    """(key, line_no, line, hit, total): lines of six tokens or more of which fewer than half the n-grams are in the other text.

    Both texts stand in one row, so nothing is shuffled; membership in a set has
    no column function that isn't a scan, hence Arrow batches.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(r"\w+").findall
        for batch in batches:
            out: list[tuple] = []
            for k, mine, theirs in zip(*(batch[i].to_pylist() for i in range(3)), strict=True):
                words = find(theirs or "")
                there = set(zip(*(words[i:] for i in range(n)), strict=False))
                for line_no, line in enumerate((mine or "").split("\n")):
                    words = find(line)
                    if len(words) >= 6:
                        grams = list(zip(*(words[i:] for i in range(n)), strict=False))
                        hit = sum(map(there.__contains__, grams))
                        if hit < len(grams) * 0.5:
                            out.append((k, line_no, line, hit, len(grams)))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (batch.schema.field(0).type, pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["k", "line_no", "line", "hit", "total"])

    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("mine"), F.col(other).cast("string").alias("theirs"))
    return rows.mapInArrow(run, f"k {kind}, line_no int, line string, hit long, total long").withColumnRenamed("k", key)


def latency_buckets(df: DataFrame, size: str, millis: str, *by: str) -> DataFrame:
    """(by, bucket, pages, median, p95, mean) of latencies by HTML size; the 95th percentile is by nearest rank."""
    bucket = F.lit(SIZE_BUCKETS[-1][0])
    for name, top in reversed(SIZE_BUCKETS[:-1]):
        bucket = F.when(F.col(size) < top, name).otherwise(bucket)
    p95 = F.expr(f"percentile_disc(0.95) within group (order by {millis})").cast("double")
    return df.groupBy(*by, bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("pages"), F.median(millis).alias("median"), p95.alias("p95"), F.coalesce(F.avg(millis), F.lit(0.0)).alias("mean")
    )


def curated_scores(outputs: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row per annotated page with snippets: recall, leak rate, title, structure and the combined score.

    ``outputs``: id, title, text and counts code_blocks, code_languages, images,
    headings, tables, math, footnotes, embeds. ``annotations``: id, tier,
    category, title, must_include, must_exclude and minimums min_code_blocks,
    code_languages, min_images, min_headings, min_tables, has_math,
    has_footnotes, has_embeds.
    """
    want = annotations.where(F.size("must_include") > 0).select(*[F.col(c).alias(f"w_{c}") for c in annotations.columns])
    size = F.aggregate(F.concat("w_must_include", F.coalesce("w_must_exclude", F.array().cast("array<string>"))), F.lit(200), lambda n, x: n + F.octet_length(x))
    df = outputs.join(broadcastable(want, size), F.col("id") == F.col("w_id"))
    key = T.match_key("text")
    df = df.withColumn("key", key).withColumn("inc", F.transform("w_must_include", T.fold_typography)).withColumn("exc", F.transform(F.coalesce("w_must_exclude", F.array().cast("array<string>")), T.fold_typography))
    has = lambda c: F.size(F.filter(c, lambda s: F.contains(F.col("key"), s)))
    langs = F.array_distinct(F.filter(F.transform(F.coalesce("w_code_languages", F.array().cast("array<string>")), T.canonical_language), lambda x: x.isNotNull()))
    found = F.transform("code_languages", T.canonical_language)
    lang_recall = F.when(F.size(langs) > 0, F.size(F.array_intersect(langs, found)) / F.size(langs))
    least = lambda w, c: F.when(F.coalesce(F.col(w), F.lit(0)) > 0, F.col(c) >= F.col(w))
    some = lambda w, c: F.when(F.coalesce(F.col(w), F.lit(False)), F.col(c) > 0)
    checks = F.array_compact(F.array(
        least("w_min_code_blocks", "code_blocks"), lang_recall == 1, least("w_min_images", "images"), least("w_min_headings", "headings"), least("w_min_tables", "tables"),
        some("w_has_math", "math"), some("w_has_footnotes", "footnotes"), some("w_has_embeds", "embeds"),
    ))
    title = T.title_match("w_title", "title")
    df = df.select(
        "id", F.col("w_tier").alias("tier"), F.col("w_category").alias("category"),
        (has("inc") / F.size("inc")).alias("include_recall"),
        F.when(F.size("exc") > 0, has("exc") / F.size("exc")).alias("leak_rate"),
        title["exact"].alias("title_exact"), title["fuzzy"].alias("title_fuzzy"),
        F.when(F.size(checks) > 0, F.size(F.filter(checks, lambda c: c)) / F.size(checks)).alias("structure_pass"),
        F.size(checks).alias("structure_checks"), lang_recall.alias("language_recall"), (F.length("key") > 0).alias("has_text"),
    )
    clean = F.when(F.col("has_text"), 1 - F.col("leak_rate")).otherwise(F.when(F.col("leak_rate").isNotNull(), 0.0))
    parts = [("include", F.col("include_recall")), ("title", F.col("title_fuzzy").cast("double")), ("exclude", clean), ("structure", F.col("structure_pass"))]
    weight = sum((F.when(v.isNotNull(), COMBINED_WEIGHTS[k]).otherwise(0.0) for k, v in parts), F.lit(0.0))
    value = sum((F.coalesce(v * COMBINED_WEIGHTS[k], F.lit(0.0)) for k, v in parts), F.lit(0.0))
    return df.withColumn("combined", value / weight).drop("has_text")


def curated_summary(scores: DataFrame, *by: str) -> DataFrame:
    """Means of the curated scores in all, or by tier, category or both in one pass of grouping sets."""
    measures = [
        F.count(F.lit(1)).alias("docs"), F.avg("include_recall").alias("include_recall"), F.avg("leak_rate").alias("leak_rate"),
        F.count_if(F.col("leak_rate") > 0).alias("leaking"), F.avg(F.col("title_exact").cast("double")).alias("title_exact"),
        F.avg(F.col("title_fuzzy").cast("double")).alias("title_fuzzy"),
        (F.sum(F.col("structure_pass") * F.col("structure_checks")) / F.sum(F.when(F.col("structure_pass").isNotNull(), F.col("structure_checks")))).alias("structure_pass"),
        F.avg("language_recall").alias("language_recall"), F.avg("combined").alias("combined"),
    ]
    if not by:
        return scores.agg(*measures)
    return scores.groupingSets([[], *[[c] for c in by]], *by).agg(*measures)


def worst_pages(scores: DataFrame, engine: str, limit: int = 20) -> DataFrame:
    """(id, score, best, best_score): pages where another engine is furthest ahead of ``engine``; a top-k report.

    ``scores``: engine, id, score. Of equal other engines the first by name counts.
    """
    mine = scores.where(F.col("engine") == engine).select("id", F.col("score"))
    others = scores.where(F.col("engine") != engine).groupBy("id").agg(F.max(F.struct("score", F.col("engine"))).alias("top"), F.max("score").alias("best_score"))
    first = scores.where(F.col("engine") != engine).join(others.select("id", "best_score"), "id").where("score = best_score").groupBy("id").agg(F.min("engine").alias("best"))
    out = mine.join(others.select("id", "best_score"), "id").join(first, "id")
    return out.select("id", "score", "best", "best_score").orderBy((F.col("best_score") - F.col("score")).desc(), "score", "id").limit(limit)


def speed_summary(runs: DataFrame) -> DataFrame:
    """(engine, pages, rate, rank): page-weighted milliseconds a page, ranked; ``runs``: engine, file, pages, median_ms."""
    rates = runs.groupBy("engine").agg(F.sum("pages").alias("pages"), (F.sum("median_ms") / F.sum("pages")).alias("rate"))
    return rates.withColumn("rank", F.rank().over(Window.orderBy("rate")))  # a handful of engines


def outcome_changes(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, change): outcomes missing from ``b``, extra in it, or changed."""
    left, right = a.select(*keys, F.col(value).alias("before")), b.select(*keys, F.col(value).alias("after"))
    both = left.withColumn("l", F.lit(1)).join(right.withColumn("r", F.lit(1)), keys, "full")
    change = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.select(*keys, change.alias("change")).where("change is not null")


def category_pass_rate(checks: DataFrame) -> DataFrame:
    """(category, checks, passed, rate), with a row of category null for the mean of the categories' rates."""
    per = checks.groupBy("category").agg(F.count(F.lit(1)).alias("checks"), F.count_if(F.col("passed")).alias("passed"), F.avg(F.col("passed").cast("double")).alias("rate"))
    return per.unionByName(per.agg(F.lit(None).cast("string").alias("category"), F.sum("checks").alias("checks"), F.sum("passed").alias("passed"), F.avg("rate").alias("rate")))


def lint_annotations(annotations: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, problem): duplicate ids, too few or too short snippets, snippets in both lists or not on the page."""
    a = annotations.select("id", "must_include", "must_exclude")
    duplicate = a.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("problem"))
    few = a.where(F.size("must_include") < 3).select("id", F.lit("fewer than three snippets").alias("problem"))
    inc = a.select("id", F.explode("must_include").alias("s"))
    short = inc.where(F.length("s") < 12).select("id", F.concat(F.lit("short snippet: "), "s").alias("problem"))
    both = a.select("id", F.explode(F.array_intersect("must_include", "must_exclude")).alias("s")).select("id", F.concat(F.lit("in both lists: "), "s").alias("problem"))
    keyed = pages.select("id", T.match_key("text").alias("key"))
    absent = inc.join(keyed, "id").where(~F.contains("key", T.match_key("s"))).select("id", F.concat(F.lit("not on the page: "), "s").alias("problem"))
    return duplicate.unionByName(few).unionByName(short).unionByName(both).unionByName(absent)
