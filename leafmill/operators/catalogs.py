"""Catalog search and paging, unions of catalogs, library views and categories."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.dates import iso_micros

#: Bounds of a list query.
DEFAULT_LIMIT, MAX_LIMIT, MAX_QUERY = 24, 100, 100
#: Fixed value: bytes of a cover.
MAX_COVER = 10_000_000


@dataclass(frozen=True)
class ListQuery:
    """A checked list request: search text, language, page size and offset."""

    q: str = ""
    language: str | None = None
    limit: int = DEFAULT_LIMIT
    offset: int = 0

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= MAX_LIMIT or self.offset < 0 or len(self.q) > MAX_QUERY:
            raise ValueError("limit, offset or q out of bounds")

    def digest(self) -> str:
        return hashlib.sha256(json.dumps([self.q.strip().lower(), self.language, self.limit]).encode()).hexdigest()[:16]

    def cursor(self) -> str:
        """Opaque cursor of this place; bound to the query it was made for."""
        return base64.urlsafe_b64encode(json.dumps({"o": self.offset, "q": self.digest()}).encode()).decode().rstrip("=")

    def at(self, cursor: str) -> ListQuery:
        """This query at the place of ``cursor``; refuses cursors of other queries."""
        try:
            got = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        except ValueError as e:
            raise ValueError("bad cursor") from e
        if got.get("q") != self.digest() or not isinstance(got.get("o"), int):
            raise ValueError("cursor of another query")
        return ListQuery(self.q, self.language, self.limit, got["o"])


def matches(needle: str, scalars: list[str], arrays: list[str] = ()) -> Column:
    """Case-insensitive substring of any of the columns."""
    low = needle.strip().lower()
    tests = [F.contains(F.lower(F.col(c)), F.lit(low)) for c in scalars]
    tests += [F.exists(c, lambda s: F.contains(F.lower(s), F.lit(low))) for c in arrays]
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out if low else F.lit(True)


def search(books: DataFrame, query: ListQuery, scalars: list[str], arrays: list[str] = (), order: list[str] = ("updated_at", "id"), language: str = "language") -> DataFrame:
    """One page of matching rows. Offset paging reads the pages before it; keyset paging is in changelog.pull_since."""
    hits = books.where(matches(query.q, scalars, list(arrays)))
    if query.language is not None:
        hits = hits.where(F.lower(language) == query.language.lower())
    return hits.orderBy(*order).offset(query.offset).limit(query.limit)


def public(books: DataFrame) -> DataFrame:
    return books.drop("object_key", "cover")


def valid_book() -> Column:
    """Whether a manifest row is a proper book; ``cover`` is a struct or null, and agrees with cover_id and cover_url.

    Columns: id, format, version, title, author, description, language,
    subjects, cover_id, cover_url, download_url, file_size, sha256, updated_at,
    object_key, cover (object_key, content_type, file_size, etag).
    """
    c = F.col
    filled = lambda x, most: F.length(x).between(1, most)
    plain = lambda x: ~x.rlike(r"[\x00-\x1F\x7F]")
    key = lambda x: filled(x, 512) & x.rlike(r"^[A-Za-z0-9][A-Za-z0-9._/-]*$") & ~F.contains(x, F.lit("//")) & ~F.array_contains(F.split(x, "/"), "..")
    own = lambda name: F.concat(F.lit("/v1/books/"), c("id"), F.lit("/" + name))
    ending = F.when(F.coalesce("format", F.lit("epub")) == "epub", ".epub").when(c("format") == "comic", ".cbz")
    milliseconds = c("updated_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$") & iso_micros("updated_at").isNotNull()
    subjects = (F.size("subjects") <= 32) & F.forall("subjects", lambda s: filled(s, 100))
    cover = c("cover")
    etag = cover["etag"].isNull() | filled(cover["etag"], 512)
    image = key(cover["object_key"]) & filled(cover["content_type"], 100) & plain(cover["content_type"]) & cover["content_type"].startswith("image/") & cover["file_size"].between(1, MAX_COVER) & etag
    art = F.when(cover.isNull(), c("cover_url").isNull() & c("cover_id").isNull()).otherwise(
        image & (c("cover_url") == own("cover")) & (c("cover_id").isNull() | (c("cover_id") == F.concat(F.lit("cover-"), c("sha256"))))
    )
    return F.coalesce(
        filled(c("id"), 128) & c("id").rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$") & ending.isNotNull() & filled(c("version"), 64) & filled(c("title"), 300) & plain(c("title"))
        & filled(c("author"), 300) & (F.length("description") <= 4000) & filled(c("language"), 35) & c("language").rlike("^[A-Za-z]{2,3}(?:-[A-Za-z0-9]{2,8})*$") & subjects
        & art & (c("download_url") == own("download")) & (c("file_size") > 0) & c("sha256").rlike("^[0-9a-f]{64}$") & milliseconds & key(c("object_key")) & c("object_key").endswith(ending),
        F.lit(False),
    )


def union_keep_first(lists: Column | str) -> Column:
    """Distinct names of an array, ignoring case and outer space, as first written."""
    x = F.col(lists) if isinstance(lists, str) else lists
    x = F.filter(F.transform(x, lambda s: F.trim(s)), lambda s: s != "")
    seen = F.transform(x, lambda s: F.lower(s))
    return F.filter(x, lambda s, i: F.array_position(seen, F.lower(s)) == i + 1)


def union_names(df: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """(key, names): the distinct names of each key, ignoring case and outer space, as first written by ``order``.

    A name is one row before a key's names are put together, however often it stands.
    """
    plain = df.select(key, F.trim(name).alias("n_"), F.col(order).alias("o_")).where("n_ <> ''")
    once = plain.groupBy(key, F.lower("n_").alias("folded_")).agg(F.min(F.struct("o_", "n_")).alias("first_"))
    return once.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("first_")), lambda s: s["n_"]).alias("names"))


def highlights_by_edition(highlights: DataFrame, library: DataFrame) -> DataFrame:
    """Live highlights of the editions at hand (by sha256), in reading order: (key, id, position, created_at, place)."""
    live = highlights.where("deleted_at is null")
    joined = live.join(library.select("key", "sha256"), "sha256")
    place = F.row_number().over(Window.partitionBy("key").orderBy("position", "created_at", "id"))
    return joined.select("key", "id", "position", "created_at", place.alias("place"))


def merge_catalogs(manifest: DataFrame, uploads: DataFrame) -> DataFrame:
    """The manifest, and the uploads that share neither id nor checksum with it."""
    rest = uploads.join(manifest.select("id"), "id", "left_anti").join(manifest.select("sha256"), "sha256", "left_anti")
    return manifest.unionByName(rest, allowMissingColumns=True)


def library_view(library: DataFrame, view: str = "all") -> DataFrame:
    """Rows of a library view, newest first; ``library``: key, kind, added_us, downloaded, progress."""
    tests = {"all": F.lit(True), "downloaded": F.col("downloaded"), "inProgress": (F.col("progress") > 0) & (F.col("progress") < 1), "articles": F.col("kind") == "article"}
    return library.where(tests[view]).orderBy(F.col("added_us").desc(), "key")


def continue_reading(library: DataFrame) -> DataFrame:
    """The row opened last."""
    return library.where("last_opened_us is not null").agg(F.max_by(F.struct(*library.columns), F.struct("last_opened_us", "key")).alias("row")).where("row is not null").select("row.*")


def category_contents(categories: DataFrame, assignments: DataFrame, library: DataFrame) -> DataFrame:
    """(category_id, name, item_type, item_id, title, added_us) of live categories and items at hand; an item is in one category."""
    live = categories.where("deleted_at is null").select(F.col("id").alias("category_id"), "name", "created_at")
    mine = assignments.where("category_id is not null").select("category_id", "item_type", "item_id")
    have = library.select(F.col("kind").alias("item_type"), F.col("key").alias("item_id"), "title", "added_us")
    return mine.join(live, "category_id").join(have, ["item_type", "item_id"]).select("category_id", "name", "created_at", "item_type", "item_id", "title", "added_us")


def category_counts(contents: DataFrame) -> DataFrame:
    return contents.groupBy("category_id", "name").agg(F.count_if(F.col("item_type") == "book").alias("books"), F.count_if(F.col("item_type") == "article").alias("articles"))


def unfiled(library: DataFrame, contents: DataFrame) -> DataFrame:
    filed = contents.select(F.col("item_type").alias("kind"), F.col("item_id").alias("key"))
    return library.join(filed, ["kind", "key"], "left_anti")
