"""Line dedup: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z
lower-cased; keys under ``min_chars`` code points are never touched. A key held
by several documents stays in the smallest doc_id that holds it, with all its
lines there, and goes from the others.

``LineIndex`` keeps three tables in a shared folder: references (one row per key
and document), exact counts (documents that hold a key, and the smallest of
them) and one cuckoo filter per shard over the live keys. New documents ask the
filters first; only the keys that a filter knows reach the exact table.
Documents can be deleted again: their references go, keys without references
leave the filters, and lines that they had displaced come back. A change reads
and writes only the parts of the tables that its keys fall into, and ends with a
version file, so that an index can be opened again by any later job.

Defined results: a null or empty text is one empty line. Rows with a null
doc_id hold no references and keep all their lines. Rows that share a doc_id
are one document. An empty table gives an empty result. Extra columns of any
name are kept by ``dedup_documents`` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import cut, shared_path, text_batches

BLANK = b" \t\n\r\x0b\x0c"
#: Keys of one filter shard about, and postings that one piece of a shard's lookups takes about.
SHARD_KEYS = 200_000
PIECE = 250_000
#: Fewer shards than this can hold a HOT_SHARDS-th of all postings each: the bound of a broadcast.
HOT_SHARDS = 100_000
SLOTS = 4


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints in buckets of four, filled in numpy rounds."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def build(cls, hashes: np.ndarray) -> Cuckoo:
        """A filter of distinct 64-bit hashes; grows until every hash has a slot."""
        buckets = 1
        while buckets * SLOTS * 0.85 < max(1, len(hashes)):
            buckets *= 2
        while True:
            f = cls(np.zeros((buckets, SLOTS), np.uint16))
            if f.insert(hashes):
                return f
            buckets *= 2

    @classmethod
    def load(cls, payload: bytes) -> Cuckoo:
        return cls(np.frombuffer(payload, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        prints = ((hashes >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = (hashes & mask).astype(np.int64)
        return prints, first, self.other(first, prints)

    def other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        step = prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
        return ((bucket.astype(np.uint64) ^ step) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def insert(self, hashes: np.ndarray, rounds: int = 300) -> bool:
        prints, bucket, second = self.places(hashes)
        rng = np.random.default_rng(1)
        for turn in range(rounds):
            if not len(prints):
                return True
            order = np.argsort(bucket, kind="stable")
            prints, bucket, second = prints[order], bucket[order], second[order]
            start = np.r_[True, bucket[1:] != bucket[:-1]]
            rank = np.arange(len(bucket)) - np.maximum.accumulate(np.where(start, np.arange(len(bucket)), 0))
            free = self.table[bucket] == 0
            fits = rank < free.sum(1)
            slot = np.argsort(~free, axis=1, kind="stable")[np.arange(len(bucket)), np.minimum(rank, SLOTS - 1)]
            self.table[bucket[fits], slot[fits]] = prints[fits]
            prints, bucket, second = prints[~fits], second[~fits], bucket[~fits]
            if turn % 2 and len(prints):  # both places are full: one row of each bucket pushes a resident out
                _, one = np.unique(bucket, return_index=True)
                at = rng.integers(0, SLOTS, len(one))
                out = self.table[bucket[one], at]
                self.table[bucket[one], at] = prints[one]
                keep = out != 0
                home = bucket[one]
                rest = np.ones(len(prints), bool)
                rest[one] = False
                away = self.other(home, out)
                prints = np.r_[prints[rest], out[keep]]
                bucket, second = np.r_[bucket[rest], away[keep]], np.r_[second[rest], home[keep]]
        return not len(prints)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        prints, first, second = self.places(hashes)
        return (self.table[first] == prints[:, None]).any(1) | (self.table[second] == prints[:, None]).any(1)

    def delete(self, hashes: np.ndarray) -> None:
        """Takes one fingerprint out for each hash that was inserted before."""
        for p, a, b in zip(*self.places(hashes), strict=True):
            for bucket in (a, b):
                at = np.flatnonzero(self.table[bucket] == p)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """The 128-bit digest of a line's key; None for a key that is too short."""
    line = line.strip(BLANK)
    if len(line) < min_chars or len(line) < 4 * min_chars and len(line.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(line.lower(), digest_size=16).digest()


def lines_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def line_postings(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(hi, lo, doc_id): one row for each key and row of ``docs`` that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = {key_of(line, min_chars) for line in lines_of(text)} - {None}
                ids += [doc_id] * len(found)
                keys += found
            both = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64())], ["hi", "lo", "doc_id"])

    rows = text_batches(docs).select("doc_id", F.col("text").cast("binary").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, "hi long, lo long, doc_id long")


def reference_counts(postings: DataFrame) -> DataFrame:
    """The exact table: documents that hold each key, and the smallest of them.

    Map-side partial aggregation meets a key that a third of all documents hold.
    """
    return postings.distinct().groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"))


def shard_of(shards: int) -> F.Column:
    return F.pmod(F.col("hi"), F.lit(shards)).cast("int")


def build_filters(counts: DataFrame, shards: int) -> DataFrame:
    """(shard, n, payload): a cuckoo filter over each shard's keys."""

    def run(frame):
        import pandas as pd

        payload = Cuckoo.build(frame["lo"].to_numpy(np.int64).view(np.uint64)).dump()
        return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "n": [len(frame)], "payload": [payload]})

    keys = counts.select(shard_of(shards).alias("shard"), "lo")
    return keys.groupBy("shard").applyInPandas(run, "shard int, n long, payload binary")


def shards_for(keys: int) -> int:
    return max(1, -(-keys // SHARD_KEYS))


def probe(postings: DataFrame, filters: DataFrame, shards: int, sizes: DataFrame) -> DataFrame:
    """The postings whose key a filter may know; ``sizes`` (shard, postings) counts them.

    Each shard is looked up in as many pieces as its postings fill: its filter
    row goes first in every piece and the postings stream past it, so a shard of
    a line that a third of all documents hold is spread over as many tasks as it
    needs, and a task holds one filter at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            shard = batch["shard"].to_numpy()
            edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            take = np.zeros(len(shard), bool)
            lo = batch["lo"].to_numpy(zero_copy_only=False).view(np.uint64)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                begin = a
                if shard[a] != at:
                    at, held = shard[a], None
                while begin < b and (payload := batch["payload"][int(begin)].as_py()) is not None:
                    held, begin = Cuckoo.load(payload), begin + 1
                if held is not None and begin < b:
                    take[begin:b] = held.holds(lo[begin:b])
            yield batch.select(["hi", "lo", "doc_id"]).filter(pa.array(take))

    total = sizes.agg(F.sum("postings")).first()[0] or 0
    most = max(PIECE, total // HOT_SHARDS)
    hot = F.broadcast(cut(sizes.where(F.col("postings") > most).select(F.col("shard").alias("hot"), F.ceil(F.col("postings") / PIECE).alias("pieces"))))
    pieces = F.coalesce(F.col("pieces"), F.lit(-(-most // PIECE)))
    none, zero = F.lit(None).cast("binary"), F.lit(0).cast("long")
    rows = postings.withColumn("shard", shard_of(shards)).join(hot, F.col("shard") == F.col("hot"), "left")
    rows = rows.select("shard", F.pmod(F.xxhash64("doc_id"), pieces).cast("long").alias("split"), "hi", "lo", "doc_id", none.alias("payload"))
    heads = filters.join(hot, F.col("shard") == F.col("hot"), "left").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), (pieces - 1).cast("long"))).alias("split"), zero.alias("hi"), zero.alias("lo"), zero.alias("doc_id"), "payload")
    both = heads.unionByName(rows).withColumn("body", F.col("payload").isNull())
    placed = both.repartition("shard", "split").sortWithinPartitions("shard", "split", "body")
    return placed.select("shard", "hi", "lo", "doc_id", "payload").mapInArrow(run, "hi long, lo long, doc_id long")


def repeats(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """(hi, lo, doc_id) that lose their lines: filters first, then the exact table.

    The filters are built over the keys of several documents, so that most
    postings never reach the exact join; the join drops what they get wrong.
    """
    many = counts.where("docs > 1")
    shards = shards_for(many.count())
    sizes = counts.groupBy(shard_of(shards).alias("shard")).agg(F.sum("docs").alias("postings"))
    maybe = probe(postings, build_filters(many, shards), shards, sizes)
    exact = many.select("hi", "lo", "first_doc")
    return maybe.join(exact, ["hi", "lo"]).where("doc_id > first_doc").select("hi", "lo", "doc_id")


def drop_lines(docs: DataFrame, lost: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` (all its columns, in struct ``row``) with new_text, n_lines and n_dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, drops = [], [], []
            for text, keys in zip(batch["text"].to_pylist(), batch["keys"].to_pylist(), strict=True):
                lines = lines_of(text)
                kept = lines
                if keys:
                    gone = set(keys)
                    kept = [x for x in lines if key_of(x, min_chars) not in gone]
                texts.append(b"\n".join(kept))
                totals.append(len(lines))
                drops.append(len(lines) - len(kept))
            out = [batch["row"], pa.array(texts, pa.binary()), pa.array(totals, pa.int64()), pa.array(drops, pa.int64())]
            yield pa.record_batch(out, ["row", "new_text", "n_lines", "n_dropped"])

    digest = F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("hi", "lo")]))
    keys = lost.groupBy("doc_id").agg(F.collect_list(digest).alias("keys"))
    keys = keys.withColumnRenamed("doc_id", "lost_doc").hint("shuffle_hash")
    rows = text_batches(docs).select(F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("row"), F.col("text").cast("binary").alias("text"))
    joined = rows.join(keys, rows["row"]["doc_id"] == keys["lost_doc"], "left").select("row", "text", "keys")
    schema = f"row {rows.schema['row'].dataType.simpleString()}, new_text binary, n_lines long, n_dropped long"
    return joined.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Struct ``row`` (the other columns), new_text (binary), n_lines and n_dropped for each row of ``docs``."""
    postings = cut(line_postings(docs, min_chars))
    counts = cut(reference_counts(postings))
    return drop_lines(docs, repeats(postings, counts), min_chars)


def dedup_documents(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with the same columns; text without its repeated lines, and n_chars, where there is one, set anew.

    A null text becomes an empty one.
    """
    out = dedup_lines(docs, min_chars)
    text = F.col("new_text").cast("string")
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(text.alias("text"))
        elif c == "n_chars":
            cols.append(F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            cols.append(F.col("row").getField(c).alias(c))
    return out.select(*cols)


class LineIndex:
    """Incremental, reversible line dedup: tables of references, counts and filters below ``path``.

    The tables lie in at most PARTS parts by key. A change writes the parts it
    touches under a name of its own and then a version file that says which name
    each part has; a job that fails before that leaves the index as it was. The
    newest version is read when an index is opened. One writer at a time.
    """

    PARTS = 256
    TABLES = {"references": "hi long, lo long, doc_id long", "counts": "hi long, lo long, docs long, first_doc long", "filters": "shard int, n long, payload binary"}

    def __init__(self, spark: SparkSession, path: str | None = None, min_chars: int = 10):
        self.spark, self.path = spark, (path or shared_path(spark, "lines")).rstrip("/")
        self.state = {"version": 0, "shards": 1, "keys": 0, "min_chars": min_chars, "parts": {}}
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            found = [json.loads(r.value) for r in spark.read.text(f"{self.path}/version-*").collect()]  # one row a version
            self.state = max(found, key=lambda v: v["version"])
        else:
            self._point(self.state)

    def _point(self, state: dict) -> None:
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.path}/version-{state['version']}")
        self.state = state

    @property
    def min_chars(self) -> int:
        return self.state["min_chars"]

    @property
    def shards(self) -> int:
        return self.state["shards"]

    def _part(self, shards: int, shard: F.Column | None = None) -> F.Column:
        return F.pmod(shard_of(shards) if shard is None else shard, F.lit(self.PARTS)).alias("part")

    def table(self, name: str, parts: set[int] | None = None) -> DataFrame:
        """One of TABLES, or only some parts of it."""
        paths = [f"{self.path}/{name}/{gen}/part={p}" for p, gen in self.state["parts"].items() if parts is None or int(p) in parts]
        return self.spark.read.schema(self.TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], self.TABLES[name])

    def references(self) -> DataFrame:
        return self.table("references")

    def filters(self) -> DataFrame:
        return self.table("filters")

    def insert(self, docs: DataFrame) -> None:
        """Adds the documents' lines; a document that is there already is replaced."""
        new = cut(line_postings(docs, self.min_chars).distinct())
        self._change(self._held(docs), new)

    def delete(self, ids: DataFrame) -> None:
        """Takes the documents of column doc_id out; keys without references leave the tables."""
        self._change(self._held(ids), self.spark.createDataFrame([], self.TABLES["references"]))

    def _held(self, docs: DataFrame) -> DataFrame:
        """The references of these documents: all parts are read for it, none is written."""
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
        return cut(self.references().join(ids, "doc_id", "left_semi").select("hi", "lo", "doc_id"))

    def _change(self, gone: DataFrame, new: DataFrame) -> None:
        keys = self.state["keys"] + new.select("hi", "lo").distinct().count()
        shards = self.shards if keys <= 4 * self.shards * SHARD_KEYS else shards_for(keys)
        touched = None  # all parts, where the number of shards grows
        if shards == self.shards:
            touched = {r.part for r in gone.unionByName(new).select(self._part(shards)).distinct().collect()}  # at most PARTS
            if not touched:
                return
        gen = uuid.uuid4().hex
        put = lambda df, name, part: df.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(f"{self.path}/{name}/{gen}")
        left = self.table("references", touched).join(gone, ["hi", "lo", "doc_id"], "left_anti").unionByName(new)
        put(left, "references", self._part(shards))

        group = lambda df, n, low: df.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias(n), F.min("doc_id").alias(low))
        step = self.table("counts", touched).join(group(new, "more", "more_first"), ["hi", "lo"], "full").join(group(gone, "less", "less_first"), ["hi", "lo"], "left")
        zero = lambda c: F.coalesce(c, F.lit(0))
        docs = (zero("docs") + zero("more") - zero("less")).alias("now")
        step = cut(step.select("hi", "lo", docs, F.col("docs").isNull().alias("added"), F.least("first_doc", "more_first").alias("first"), F.coalesce(F.col("less_first") <= F.col("first_doc"), F.lit(False)).alias("unsure")))
        stored = self.spark.read.schema(self.TABLES["references"]).parquet(f"{self.path}/references/{gen}")
        again = stored.join(step.where("unsure and now > 0").select("hi", "lo"), ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.min("doc_id").alias("again"))
        live = step.where("now > 0").join(again, ["hi", "lo"], "left")
        put(live.select("hi", "lo", F.col("now").alias("docs"), F.coalesce("again", "first").alias("first_doc")), "counts", self._part(shards))
        counts = self.spark.read.schema(self.TABLES["counts"]).parquet(f"{self.path}/counts/{gen}")

        if shards == self.shards:
            moved = step.where("added or now = 0").select(shard_of(shards).alias("shard"), "lo", (F.col("now") > 0).alias("add"))
            filters = cut(self._refill(self.table("filters", touched), moved))
            full = filters.where("payload is null").select("shard")
            whole = build_filters(counts.join(full, shard_of(shards) == F.col("shard"), "left_semi"), shards)
            filters = filters.where("payload is not null").unionByName(whole)
        else:
            filters = build_filters(counts, shards)
        put(filters.where("n > 0"), "filters", self._part(shards, F.col("shard")))

        state = step.agg(F.sum(F.when(F.col("now") > 0, 1).otherwise(0) - F.when(~F.col("added"), 1).otherwise(0))).first()[0] or 0
        kept = {} if touched is None else {p: g for p, g in self.state["parts"].items() if int(p) not in touched}
        kept |= {str(r.part): gen for r in counts.select(self._part(shards)).distinct().collect()}  # at most PARTS
        self._point(self.state | {"version": self.state["version"] + 1, "shards": shards, "keys": self.state["keys"] + state, "parts": kept})

    @staticmethod
    def _refill(filters: DataFrame, moved: DataFrame) -> DataFrame:
        """Filters less the keys that died, and with the new ones; a filter that is full has a null payload."""

        def run(old, keys):
            import pandas as pd

            if not len(keys):
                return old
            lo, add = keys["lo"].to_numpy(np.int64).view(np.uint64), keys["add"].to_numpy(bool)
            n = (int(old["n"].iloc[0]) if len(old) else 0) + int(add.sum()) - int((~add).sum())
            payload = None
            if len(old):
                f = Cuckoo.load(old["payload"].iloc[0])
                f.delete(lo[~add])
                payload = f.dump() if f.insert(lo[add]) else None
            elif add.all():
                payload = Cuckoo.build(lo).dump()
            return pd.DataFrame({"shard": [keys["shard"].iloc[0]], "n": [n], "payload": [payload]})

        return filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(run, "shard int, n long, payload binary")

    def known(self, docs: DataFrame) -> DataFrame:
        """(hi, lo, doc_id, first_doc) of the lines of ``docs`` that the index holds: filter first, then the exact table."""
        asked = cut(line_postings(docs, self.min_chars).distinct())
        sizes = asked.groupBy(shard_of(self.shards).alias("shard")).agg(F.count(F.lit(1)).alias("postings"))
        return probe(asked, self.filters(), self.shards, sizes).join(self.table("counts").select("hi", "lo", "first_doc"), ["hi", "lo"])

    def dedup(self, docs: DataFrame) -> DataFrame:
        """As ``dedup_lines``, against the index: lines that a smaller doc_id of the index holds go."""
        lost = self.known(docs).where("doc_id > first_doc").select("hi", "lo", "doc_id")
        return drop_lines(docs, lost, self.min_chars)
