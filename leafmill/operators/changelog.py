"""The change log: validation, ordered merges and state.

A change is (device_id, change_id, book_id, sha256, kind, updated_at, payload as
JSON, and ``seq``, its place of arrival). Merges whose result doesn't depend on
arrival are aggregates; in the others, what a change meets is told by running
maxima over the earlier changes of its key (``_earlier_max``), in ranges, so that
no row or task holds a key's history. Orders are on (updated_us, change_id); ids
are ASCII, so byte order is theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.dates import iso_micros
from leafmill.session import cut, numbered

#: Sizes and shapes that a change must keep to.
KINDS = "progress session preferences library highlight article articleProgress category categoryItem".split()
CLIENT_ID = "^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"
BOOK_ID = "^[a-z0-9]+(?:-[a-z0-9]+)*$"
SHA256 = "^[0-9a-f]{64}$"
HEX32 = "^[0-9a-f]{32}$"
COLOR = "^[a-z][a-z0-9-]{0,31}$"
MAX_PAYLOAD, MAX_LOCATOR = 65_536, 16_384
MAX_TEXT, MAX_NOTE, MAX_URL, MAX_NAME = 4_000, 4_000, 2_048, 60
MAX_BODY = 4 * 1024 * 1024
MAX_SESSION_MS = 7 * 24 * 3600 * 1000
FUTURE_US = 5 * 60 * 1_000_000
BATCH_CHANGES, BATCH_BYTES = 100, 240 * 1024


def _get(path: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get(v, '$.{path}', '{kind}')")


def _is(path: str, *kinds: str) -> Column:
    """The value at ``path`` is there and of one of the kinds (STRING, BIGINT, BOOLEAN, OBJECT...)."""
    name = F.expr(f"schema_of_variant(try_variant_get(v, '$.{path}', 'variant'))")
    return F.coalesce(name.rlike("^(" + "|".join(kinds) + ")"), F.lit(False))


def _only(*keys: str) -> Column:
    return F.size(F.array_except(F.expr("json_object_keys(payload)"), F.array(*[F.lit(k) for k in keys]))) == 0


def _text(path: str, limit: int, low: int = 0) -> Column:
    return _is(path, "STRING") & F.length(_get(path)).between(low, limit)


def _maybe_text(path: str, limit: int) -> Column:
    missing = F.expr(f"try_variant_get(v, '$.{path}', 'variant')").isNull() | _is(path, "VOID")
    return missing | _text(path, limit)


def _number(path: str, low: float, high: float) -> Column:
    return _is(path, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT") & _get(path, "double").between(low, high)


def _whole(path: str, low: int, high: int) -> Column:
    return _is(path, "BIGINT") & _get(path, "long").between(low, high)


def _maybe(test: Column, path: str) -> Column:
    return F.expr(f"try_variant_get(v, '$.{path}', 'variant')").isNull() | _is(path, "VOID") | test


def _when(path: str, now_us: Column) -> Column:
    return _is(path, "STRING") & F.coalesce(iso_micros(_get(path)) <= now_us + FUTURE_US, F.lit(False))


def _like(path: str, pattern: str) -> Column:
    return _is(path, "STRING") & _get(path).rlike(pattern)


def payload_rules(now_us: Column) -> dict[str, Column]:
    """For each kind, whether payload ``v`` (variant) is valid."""
    deleted = _is("deleted", "BOOLEAN")
    tomb = deleted & _get("deleted", "boolean") & (F.size(F.expr("json_object_keys(payload)")) == 2)
    url = lambda p, pattern: _text(p, MAX_URL) & _like(p, pattern)
    image = lambda p: _maybe(url(p, r"(?i)^(?:https?://|data:image/)\S+$"), p)
    article = (
        url("url", r"(?i)^https?://\S+$") & _text("title", 1000) & _maybe_text("siteName", 300) & _maybe_text("byline", 500) & _maybe_text("excerpt", 2000)
        & image("leadImage") & image("favicon") & _maybe_text("language", 35) & _maybe_text("publishedAt", 64) & _like("dir", "^(ltr|rtl)$")
        & _whole("wordCount", 0, 10_000_000) & _whole("readingMinutes", 1, 100_000) & _whole("blockCount", 0, 1_000_000)
        & _like("bodySha256", SHA256) & _whole("bodySize", 1, MAX_BODY) & _whole("schema", 1, 1) & _when("savedAt", now_us)
    )
    name = F.trim(_get("name"))
    return {
        "progress": _only("href", "progression", "totalProgression", "title", "engine", "raw") & _text("href", 4096, 1) & _number("progression", 0, 1)
        & _maybe(_number("totalProgression", 0, 1), "totalProgression") & _maybe_text("title", 1000) & _maybe_text("engine", 64) & _maybe(_is("raw", "OBJECT"), "raw"),
        "session": _only("readingMilliseconds") & _whole("readingMilliseconds", 0, MAX_SESSION_MS),
        "library": _only("present", "addedAt") & _is("present", "BOOLEAN") & F.when(_get("present", "boolean"), _when("addedAt", now_us)).otherwise(_is("addedAt", "VOID")),
        "highlight": _only("highlightId", "locator", "text", "color", "note", "createdAt", "deleted") & _like("highlightId", CLIENT_ID) & deleted
        & _is("locator", "OBJECT") & F.length(_get("locator.href")).between(1, 4096) & (F.octet_length(F.to_json(_get("locator", "variant"))) <= MAX_LOCATOR)
        & _text("text", MAX_TEXT) & _like("color", COLOR) & _maybe_text("note", MAX_NOTE) & _when("createdAt", now_us),
        "article": _only(*"articleId deleted url title siteName byline excerpt leadImage favicon language publishedAt dir wordCount readingMinutes blockCount bodySha256 bodySize schema savedAt".split())
        & _like("articleId", HEX32) & deleted & F.when(_get("deleted", "boolean"), tomb).otherwise(article),
        "articleProgress": _only("articleId", "position") & _like("articleId", HEX32) & _is("position", "OBJECT") & _whole("position.block", 0, 1_000_000) & _number("position.offset", 0, 1) & _number("position.percent", 0, 1),
        "category": _only("categoryId", "deleted", "name", "color", "createdAt") & _like("categoryId", CLIENT_ID) & deleted
        & F.when(_get("deleted", "boolean"), tomb).otherwise(_is("name", "STRING") & F.length(name).between(1, MAX_NAME) & ~name.rlike(r"\p{Cc}") & _like("color", COLOR) & _when("createdAt", now_us)),
        "categoryItem": (F.size(F.expr("json_object_keys(payload)")) == 3) & _only("categoryId", "itemType", "itemId") & (_is("categoryId", "VOID") | _like("categoryId", CLIENT_ID))
        & F.when(_get("itemType") == "book", _like("itemId", BOOK_ID) & (F.length(_get("itemId")) <= 128)).otherwise((_get("itemType") == "article") & _like("itemId", HEX32)),
        "preferences": F.lit(True),
    }


def validate(changes: DataFrame, now_us: int | Column, articles_book: str = "articles", categories_book: str = "categories") -> DataFrame:
    """``changes`` with updated_us and ``problem`` (null: valid). Past changes are never late; far-future ones are refused."""
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    df = changes.withColumn("v", F.expr("try_parse_json(payload)")).withColumn("updated_us", iso_micros("updated_at"))
    rule = F.lit(False)
    for kind, test in payload_rules(now).items():
        rule = F.when(F.col("kind") == kind, test).otherwise(rule)
    zero = "0" * 64
    sentinel = F.when(F.col("kind").isin("article", "articleProgress"), (F.col("book_id") == articles_book) & (F.col("sha256") == zero))
    sentinel = sentinel.when(F.col("kind").isin("category", "categoryItem"), (F.col("book_id") == categories_book) & (F.col("sha256") == zero))
    sentinel = sentinel.when(F.col("kind") == "preferences", F.lit(True)).otherwise((F.length("book_id") <= 128) & F.col("book_id").rlike(BOOK_ID) & F.col("sha256").rlike(SHA256))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    problem = (
        F.when(no(F.col("change_id").rlike(CLIENT_ID)), "change id")
        .when(no(F.col("kind").isin(KINDS)), "kind")
        .when(no(F.col("updated_us") <= now + FUTURE_US), "updated at")
        .when(no(F.expr("schema_of_variant(v)").startswith("OBJECT")) | (F.octet_length("payload") > MAX_PAYLOAD), "payload")
        .when(no(sentinel), "edition")
        .when(no(rule), "payload of kind")
    )
    return df.withColumn("problem", problem).drop("v")


def whole_batches(changes: DataFrame, batch: str = "batch_id") -> DataFrame:
    """The changes of batches in which every change is valid and that hold at most 100; the rest of a bad batch goes with it."""
    bad = changes.groupBy(batch).agg(F.count_if(F.col("problem").isNotNull()).alias("bad"), F.count(F.lit(1)).alias("n")).where((F.col("bad") > 0) | (F.col("n") > BATCH_CHANGES))
    return changes.join(bad, batch, "left_anti")


def arrival(changes: DataFrame) -> DataFrame:
    """``changes`` with ``turn``: batches in order, within one saves before positions, else as they came."""
    late = F.when(F.col("kind") == "articleProgress", 1).otherwise(0)
    return changes.withColumn("turn", F.struct("batch_id", late.alias("late"), "seq"))


def last_write(changes: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Last write by (updated_us, change_id) for each key: one partial aggregate, no sort."""
    top = F.max_by(F.struct("change_id", "updated_at", "updated_us", *values), F.struct("updated_us", "change_id")).alias("top")
    return changes.groupBy(*keys).agg(top).select(*keys, "top.*")


def session_totals(changes: DataFrame) -> DataFrame:
    """(book_id, sha256, reading_ms, updated_us, updated_at): the longest report of every session, summed. Safe to replay."""
    each = changes.groupBy("device_id", "change_id", "book_id", "sha256").agg(F.max("reading_ms").alias("reading_ms"), F.max(F.struct("updated_us", "updated_at")).alias("last"))
    return each.groupBy("book_id", "sha256").agg(F.sum("reading_ms").alias("reading_ms"), F.max("last").alias("last")).select("book_id", "sha256", "reading_ms", "last.updated_us", "last.updated_at")


def unsent_total(acknowledged: DataFrame, sessions: DataFrame) -> DataFrame:
    """(book_id, total_ms): acknowledged totals plus what sessions have gained since; never less."""
    gain = sessions.groupBy("book_id").agg(F.sum(F.greatest(F.lit(0), F.col("current_ms") - F.col("acked_ms"))).alias("gain"))
    return acknowledged.join(gain, "book_id", "full").select("book_id", (F.coalesce("total_ms", F.lit(0)) + F.coalesce("gain", F.lit(0))).alias("total_ms"))


def _ranged(changes: DataFrame) -> DataFrame:
    """``changes`` with ``part``, the number of a range of (id, turn); a key with very many changes has several ranges."""
    return cut(changes.repartitionByRange("id", "turn").withColumn("part", F.spark_partition_id()))


def _earlier_max(ranged: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """``name``: the greatest ``value`` that isn't null on earlier turns of the keys.

    Within a range a window finds it; the ranges before count by their maxima, of
    which there is one row for each key and range.
    """
    held = ranged.withColumn("value_", value)
    tops = held.groupBy(*keys, "part").agg(F.max("value_").alias("top_"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "part", F.max("top_").over(before).alias("before_"))
    inside = Window.partitionBy(*keys, "part").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    seen = held.withColumn("inside_", F.max("value_").over(inside)).join(tops, [*keys, "part"])
    return seen.withColumn(name, F.greatest("before_", "inside_")).drop("value_", "inside_", "before_")


_CLOCK = ["updated_us", "change_id"]


def _last(changes: DataFrame, *columns: str) -> DataFrame:
    """(id, top): each key's write with the greatest clock; of equal clocks the first to arrive."""
    same = changes.groupBy("id", *_CLOCK).agg(F.min_by(F.struct("turn", "updated_at", *columns), "turn").alias("row"))
    return same.groupBy("id").agg(F.max_by(F.struct("row.*", "change_id"), F.struct(*_CLOCK)).alias("top"))


def _own_edition(changes: DataFrame) -> DataFrame:
    """Writes for the book and edition of each highlight's first row, with ``made``, the created_at of that row."""
    first = changes.groupBy("id").agg(F.min_by(F.struct("book_id", "sha256", "created_at"), "turn").alias("first"))
    same = changes.join(first, "id").where((F.col("book_id") == F.col("first.book_id")) & (F.col("sha256") == F.col("first.sha256")))
    return same.select("*", F.col("first.created_at").alias("made")).drop("first")


def merge_highlights(changes: DataFrame) -> DataFrame:
    """Highlights by id: last write wins within the book and edition of the first row, whose created_at stays.

    ``changes``: id, turn, updated_us, change_id, updated_at, book_id, sha256,
    text, color, note, created_at, deleted. ``turn``: that of the last accepted
    write; ``accepted_highlights`` has all of them. A first row without book or
    edition (``validate`` lets none pass) leaves no highlight.
    """
    top = _last(_own_edition(changes), "book_id", "sha256", "text", "color", "note", "made", "deleted")
    row = lambda c: F.col(f"top.{c}")
    return top.select("id", row("book_id"), row("sha256"), row("text"), row("color"), row("note"), row("made").alias("created_at"), row("updated_at"), F.when(row("deleted"), row("updated_at")).alias("deleted_at"), row("change_id"), row("turn"))


def accepted_highlights(changes: DataFrame) -> DataFrame:
    """(id, turn) of the accepted writes of ``merge_highlights``, a row each."""
    clock = F.struct(*_CLOCK)
    return _earlier_max(_ranged(_own_edition(changes)), ["id"], clock, "top").where(F.col("top").isNull() | (clock > F.col("top"))).select("id", "turn")


def _accepted_article_rows(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted saves and tombstones, with ``starts`` where a save begins a life of the article; accepted moves, with ``life``, the turn of that save."""
    clock, dead = F.struct(*_CLOCK), F.coalesce("deleted", F.lit(False))
    is_row = F.col("kind") == "article"
    seen = cut(_earlier_max(_ranged(changes), ["id"], F.when(is_row, clock), "top"))
    ok = is_row & (F.col("top").isNull() | (clock > F.col("top")))
    # the state that a change meets is that of the last accepted row before it
    seen = cut(_earlier_max(seen.withColumn("ok", ok), ["id"], F.when(F.col("ok"), F.struct("turn", dead.alias("dead"))), "state"))
    live = F.coalesce(~F.col("state.dead"), F.lit(False))
    seen = seen.withColumn("starts", F.col("ok") & ~dead & ~live)
    rows = seen.where("ok")
    moves = _earlier_max(seen, ["id"], F.when(F.col("starts"), F.col("turn")), "life").where((F.col("kind") == "articleProgress") & live)
    moves = _earlier_max(cut(moves), ["id", "life"], clock, "moved")
    return rows, moves.where(F.col("moved").isNull() | (clock > F.col("moved")))


def merge_articles(changes: DataFrame) -> DataFrame:
    """Articles by id from saves, tombstones and positions, in the order of arrival.

    A newer save wins, keeps the position of a live row and drops a deleted
    row's; a newer tombstone keeps the metadata; positions have their own clock
    and move live rows only. ``changes``: id, turn, updated_us, change_id,
    updated_at, kind (article, articleProgress), deleted, url, title, position.
    ``accepted_articles`` has the turns of accepted writes.
    """
    rows, moves = _accepted_article_rows(changes)
    dead = F.coalesce("deleted", F.lit(False))
    state = rows.groupBy("id").agg(
        F.max_by(F.struct("updated_at", "change_id", dead.alias("dead"), "turn"), "turn").alias("top"),
        F.max_by(F.when(~dead, F.struct("url", "title")), F.when(~dead, F.col("turn"))).alias("saved"),
        F.max(F.when(F.col("starts"), F.col("turn"))).alias("life"),
    )
    # the accepted moves of a life have rising clocks: the last one counts
    places = moves.groupBy("id", "life").agg(F.max_by(F.struct("position", "turn"), "turn").alias("place"))
    out = state.join(places, ["id", "life"], "left")
    known = lambda c: F.when(F.col("saved").isNull(), F.lit("")).otherwise(F.when(F.col("top.dead"), F.coalesce(F.col(f"saved.{c}"), F.lit(""))).otherwise(F.col(f"saved.{c}")))
    return out.select("id", known("url").alias("url"), known("title").alias("title"), "top.updated_at", F.when(F.col("top.dead"), F.col("top.updated_at")).alias("deleted_at"), "place.position", "top.change_id",
        F.greatest("top.turn", "place.turn").alias("turn"))


def accepted_articles(changes: DataFrame) -> DataFrame:
    """(id, turn) of the accepted writes of ``merge_articles``, a row each."""
    rows, moves = _accepted_article_rows(changes)
    return rows.select("id", "turn").unionByName(moves.select("id", "turn"))


def merge_categories(changes: DataFrame) -> DataFrame:
    """Categories by id: a tombstone is final, whatever its clock; live rows are last-write-wins and keep their first created_at.

    Aggregates that Spark combines, so no row holds a key's history: the first
    tombstone of each id, and the last write before it; of equal clocks the
    first to arrive. Clocks and change ids are never null (``validate``).
    ``turn``: that of the last accepted write; ``accepted_categories`` has all.
    """
    dead = F.coalesce("deleted", F.lit(False))
    graves = changes.where(dead).groupBy("id").agg(F.min_by(F.struct("turn", "updated_at", "change_id"), "turn").alias("grave"))
    before = changes.where(~dead).join(graves.select("id", F.col("grave.turn").alias("end")), "id", "left").where("end is null or turn < end")
    made = before.groupBy("id").agg(F.min_by("created_at", "turn").alias("created_at"))
    both = _last(before, "name", "color").join(made, "id").join(graves, "id", "full")
    text = lambda c: F.when(F.col("grave").isNull(), c).otherwise(F.coalesce(c, F.lit("")))
    last = lambda c: F.when(F.col("grave").isNotNull(), F.col(f"grave.{c}")).otherwise(F.col(f"top.{c}")).alias(c)
    return both.select("id", text(F.trim("top.name")).alias("name"), text(F.col("top.color")).alias("color"), F.coalesce("created_at", "grave.updated_at").alias("created_at"),
        last("updated_at"), F.col("grave.updated_at").alias("deleted_at"), last("change_id"), last("turn"))


def accepted_categories(changes: DataFrame) -> DataFrame:
    """(id, turn) of the accepted writes of ``merge_categories``, a row each."""
    dead, clock = F.coalesce("deleted", F.lit(False)), F.struct(*_CLOCK)
    seen = cut(_earlier_max(_ranged(changes), ["id"], clock, "top"))
    seen = _earlier_max(seen, ["id"], dead, "over")
    return seen.where(F.col("top").isNull() | ~F.col("over") & (dead | (clock > F.col("top")))).select("id", "turn")


def with_revisions(*merged: tuple[DataFrame, DataFrame], after: int = 0) -> list[DataFrame]:
    """Each state with ``rev``: the number of its last accepted write among all accepted writes, in order.

    ``merged``: a state with ``turn``, and the accepted writes it was merged
    from.
    """
    all_turns = None
    for _, accepted in merged:
        t = accepted.select("turn")
        all_turns = t if all_turns is None else all_turns.unionByName(t)
    revs = numbered(all_turns, "rev", "turn").select("turn", (F.col("rev") + after).alias("rev"))
    return [state.join(revs, "turn").drop("turn") for state, _ in merged]


def state_snapshot(progress: DataFrame, library: DataFrame, sessions: DataFrame) -> DataFrame:
    """All editions of the three tables, left-joined to each, with last_opened_at: the later of progress and session."""
    key = ["book_id", "sha256"]
    keys = progress.select(*key).union(library.select(*key)).union(sessions.select(*key)).distinct()
    p = progress.select(*key, F.col("updated_at").alias("progress_at"), F.col("updated_us").alias("progress_us"), F.col("payload").alias("progress"))
    lib = library.select(*key, "present", "added_at")
    s = sessions.select(*key, "reading_ms", F.col("updated_at").alias("session_at"), F.col("updated_us").alias("session_us"))
    later = F.when(F.col("session_us").isNull() | (F.col("progress_us") >= F.col("session_us")), F.col("progress_at")).otherwise(F.col("session_at"))
    df = keys.join(lib, key, "left").join(p, key, "left").join(s, key, "left")
    return df.select(*key, "present", "added_at", "progress", F.coalesce("reading_ms", F.lit(0)).alias("reading_ms"), later.alias("last_opened_at"))


def pull_since(state: DataFrame, rev: int, limit: int) -> DataFrame:
    """A page of rows after ``rev`` in its order, each with ``more`` and the page's ``cursor``.

    One row above the page is read, which says whether there is more.
    """
    page = state.where(F.col("rev") > rev).orderBy("rev").limit(limit + 1)
    numbered = page.withColumn("place", F.row_number().over(Window.orderBy("rev")))  # limit + 1 rows
    whole = Window.partitionBy()
    numbered = numbered.withColumn("more", F.max("place").over(whole) > limit).where(F.col("place") <= limit)
    return numbered.withColumn("cursor", F.max("rev").over(whole)).drop("place")


def union_pull(categories: DataFrame, items: DataFrame, rev: int, limit: int) -> DataFrame:
    """Categories and assignments of one sequence: a limit in each branch, then one over both."""
    branch = lambda df: df.where(F.col("rev") > rev).orderBy("rev").limit(limit + 1)
    return branch(categories).unionByName(branch(items), allowMissingColumns=True).orderBy("rev").limit(limit + 1)


def orphan_bodies(dead: DataFrame, articles: DataFrame) -> DataFrame:
    """Bodies of dead articles that no live article holds."""
    live = articles.where("deleted_at is null").select("body_sha256")
    return dead.select("body_sha256").where("body_sha256 is not null").distinct().join(live, "body_sha256", "left_anti")


def outbox(current: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose stamp isn't the one that was last sent: new, changed, or removed (``removed``)."""
    joined = current.withColumn("here", F.lit(True)).join(seen.select(*keys, F.col("stamp").alias("sent")), keys, "full")
    return joined.where(F.col("here").isNull() | ~F.col("stamp").eqNullSafe(F.col("sent"))).withColumn("removed", F.col("here").isNull()).drop("here", "sent")


def _next_starts(total: np.ndarray, empty: np.ndarray, max_rows: int, max_bytes: int) -> np.ndarray:
    """Where the batch after the one that starts at each row starts; ``total``: bytes before each row, ``empty``: rows without a size."""
    at = np.arange(len(empty))
    over = np.maximum(np.searchsorted(total, total[:-1] + max_bytes, side="right") - 1, at + 1)
    unknown = np.minimum.accumulate(np.where(empty, at, len(at))[::-1])[::-1]  # from a row without a size on only rows count
    return np.where(over >= unknown, at + max_rows, np.minimum(over, at + max_rows))


def _first_start(n: int, held: int | None, total: list[int], unknown: int, max_rows: int, max_bytes: int) -> int:
    """Where the first new batch of a stretch starts, after an open batch of ``n`` rows and ``held`` bytes; ``total``: bytes up to each row."""
    if n == 0:
        return 0
    over = max_rows - n if held is None else next((j for j, t in enumerate(total) if held + t > max_bytes), max_rows)
    return max_rows - n if over >= unknown else min(over, max_rows - n)


def pack_batches(changes: DataFrame, key: str, order: str, size: str, max_rows: int = BATCH_CHANGES, max_bytes: int = BATCH_BYTES) -> DataFrame:
    """``changes`` with ``batch``: filled in order until the next row would pass the rows or bytes of a batch.

    Where a batch ends depends on all before it in the key, but a long key is no
    one task's work: rows are dealt by ranges of (key, order). A range that lies
    in one key says where it would end for each of the ``max_rows`` places at
    which its first batch may start; the driver goes through these few numbers
    of each range, and every range is then numbered by itself. Sizes are not negative.
    """
    slim = changes.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(size).cast("long").alias("s"))
    placed = cut(slim.repartitionByRange("k", "o", "s").sortWithinPartitions("k", "o", "s").withColumn("part", F.spark_partition_id()).withColumn("name", F.col("k").cast("string")))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
        """The partition's keys: rows, bytes before each row, rows without a size, next starts."""
        table = pa.Table.from_batches(held) if (held := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        names = table["name"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        ends = [*(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        empty = table["s"].is_null().to_numpy()
        sizes = table["s"].fill_null(0).to_numpy()
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            total = np.r_[0, np.cumsum(sizes[a:b])]
            yield table.slice(a, b - a), total, empty[a:b], _next_starts(total, empty[a:b], max_rows, max_bytes)

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for n_keys, last in enumerate(stretches(batches)):
            first = first or last
        if first is None:
            return
        table, total, empty, following = last
        n = len(empty)
        step, count, end = following.tolist(), [1] * n, list(range(n))
        for i in range(n - 1, -1, -1):
            if step[i] < n:
                count[i], end[i] = count[step[i]] + 1, end[step[i]]
        many = min(n, max_rows) if n_keys == 0 else 1  # the last of several keys begins here
        blank = int(np.flatnonzero(empty)[-1]) if empty.any() else -1
        row = {
            "part": table["part"][0].as_py(), "first": first[0]["name"][0].as_py(), "last": table["name"][0].as_py(), "alone": n_keys == 0, "n": n, "unknown": int(np.flatnonzero(empty)[0]) if blank >= 0 else n,
            "total": total[1 : max_rows + 1].tolist(), "starts": count[:many], "open": [n - e for e in end[:many]], "held": [None if e <= blank else int(total[n] - total[e]) for e in end[:many]],
        }
        yield pa.RecordBatch.from_pylist([row], outlines)

    longs = pa.list_(pa.int64())
    outlines = pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("alone", pa.bool_()), ("n", pa.int64()), ("unknown", pa.int64()), ("total", longs), ("starts", longs), ("open", longs), ("held", longs)])
    carried: dict[int, tuple[int, int | None, int]] = {}  # by partition: rows, bytes and number of the batch that is open before it
    name, fresh = None, (0, 0, -1)
    now = fresh
    kinds = "part int, first string, last string, alone boolean, n long, unknown long, total array<long>, starts array<long>, open array<long>, held array<long>"
    for r in sorted(placed.mapInArrow(outline, kinds).collect(), key=lambda r: r.part):
        now = now if carried and r.first == name else fresh
        carried[r.part] = now
        p = _first_start(now[0], now[1], r.total, r.unknown, max_rows, max_bytes) if r.alone else 0
        if p < r.n:
            now = (r.open[p], r.held[p], (now[2] if r.alone else -1) + r.starts[p])
        else:  # no batch starts here
            now = (now[0] + r.n, None if now[1] is None or r.unknown < r.n else now[1] + r.total[r.n - 1], now[2])
        name = r.last

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, (table, total, empty, following) in enumerate(stretches(batches)):
            n, held, batch = carried[table["part"][0].as_py()] if i == 0 else fresh
            unknown = int(np.flatnonzero(empty)[0]) if empty.any() else len(empty)
            at, step = _first_start(n, held, total[1 : max_rows + 1].tolist(), unknown, max_rows, max_bytes), following.tolist()
            new = np.zeros(len(empty), np.int32)
            while at < len(empty):
                new[at] = 1
                at = step[at]
            out = table.select(["k", "o"]).append_column("batch", pa.array(np.cumsum(new, dtype=np.int32) + np.int32(batch), pa.int32()))
            yield from out.combine_chunks().to_batches()

    kind = lambda c: placed.schema[c].dataType.simpleString()
    place = placed.mapInArrow(number, f"k {kind('k')}, o {kind('o')}, batch int").select(F.col("k").alias(key), F.col("o").alias(order), "batch")
    return changes.join(place.distinct(), [key, order])


def reading_sessions(events: DataFrame, key: str, ts: str, idle: str = "10 minutes") -> DataFrame:
    """(key, start, end, events, active_ms): sessions that end after ``idle`` without activity."""
    # the window's own end lies ``idle`` after the last event
    out = events.groupBy(key, F.session_window(ts, idle).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    return out.select(key, "start", "end", "events", ((F.unix_micros("end") - F.unix_micros("start")) / 1000).cast("long").alias("active_ms"))
