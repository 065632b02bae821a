"""Collocations: phrases whose words meet more often than their parts would suggest.

1. *Blocks.* Texts, lower-cased and cut into pieces and words, rest in a table of
   blocks of one language, about ``BLOCK`` bytes each; longer texts are cut between
   pieces, where no phrase is lost.
2. *Sketch.* Every phrase of a block falls into one of 2**40 cells of a count-min
   row by its hash. Blocks send their cells with counts to shards of cells, whose
   number grows with the text; a shard adds up and tells each block which of its
   cells reach ``least``. A cell's count is an upper bound of each of its phrases.
3. *Automata.* The phrases of a block that these bounds admit are compiled into an
   Aho-Corasick automaton, each between delimiters, and the block is scanned once
   for all overlapping matches.
4. Spark adds the blocks' counts; only then the threshold is applied, so cells that
   several phrases share cost time and change no result.
5. Cuts, scores (whole numbers of up to 38 digits), phrases that live inside longer
   ones, and ranks are DataFrame operations.

A phrase that everybody uses is one cell and one count of each block. The memory of
a task is a block with its automaton, or a shard of about ``SHARD`` cells.

Defined results: a null or empty text has no words; a null language is ``und``.
Repeated rows count as often as they stand. Of equal scores and counts the phrase
that is less in UTF-8 order ranks first. Other columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import small_enough, stored, text_batches
from leafmill.llm.shards import single_groups, whole_groups

#: Bytes of text in a block, cells that a shard is meant to hold, bits of a cell.
BLOCK, SHARD, BITS = 16 << 20, 4 << 20, 40

#: No byte of UTF-8; stands between pieces.
END = 0xFF
_FOLD = bytes(END if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BETWEEN = b" \xff "
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


class Numbers(dict):
    """Numbers words in the order in which they first come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def words_of(text: bytes) -> bytes:
    """The words with one space between them, and the mark of an end between pieces."""
    return b" ".join(text.translate(_FOLD).replace(b"\xff", _BETWEEN).split())


def text_blocks(docs: DataFrame, text: str, lang: str, most: int = BLOCK) -> DataFrame:
    """(id, lang, size, z): compressed blocks of words of one language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(1).compress
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def sent(languages: list[str]) -> pa.RecordBatch:
            blobs = [b" " + _BETWEEN.join(held.pop(k)) + b" " for k in languages]
            for k in languages:
                size.pop(k)
            columns = [pa.array([uuid.uuid4().hex for _ in blobs]), pa.array(languages), pa.array([len(b) for b in blobs]), pa.array([squeeze(b) for b in blobs], pa.binary())]
            return pa.record_batch(columns, ["id", "lang", "size", "z"])

        for batch in batches:
            for t, k in zip(batch["text"], batch["lang"].to_pylist(), strict=True):
                words = words_of(t.as_py())
                while words:
                    at = words.find(_BETWEEN, most) if len(words) > 2 * most else -1
                    part, words = (words, b"") if at < 0 else (words[:at], words[at + len(_BETWEEN) :])
                    held.setdefault(k, []).append(part)
                    size[k] = size.get(k, 0) + len(part) + len(_BETWEEN)
                    if size[k] >= most:
                        yield sent([k])
            if sum(size.values()) > 2 * most:  # many languages at once
                yield sent(list(held))
        if held:
            yield sent(list(held))

    rows = docs.select(F.col(text).cast("binary").alias("text"), F.coalesce(lang, F.lit("und")).alias("lang")).where("length(text) > 0")
    return stored(text_batches(rows).mapInArrow(run, "id string, lang string, size long, z binary"), "collocation-blocks")


class Block:
    """The words of a block by number, and its phrases with their cells."""

    def __init__(self, lang: str, z: bytes):
        self.text = zstandard.ZstdDecompressor().decompress(z)
        numbers = Numbers({b"\xff": 0})
        self.ids = np.fromiter(map(numbers.__getitem__, self.text.split()), np.int64)
        self.words = list(numbers)
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words), np.uint64, len(self.words))
        self.seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))

    def starts(self, n: int) -> np.ndarray:
        """Where phrases of ``n`` words begin: no end among them."""
        if len(self.ids) < n:
            return np.zeros(0, np.int64)
        ends = np.r_[0, np.cumsum(self.ids == 0)]
        return np.flatnonzero(ends[n:] == ends[:-n])

    def cells(self, n: int, at: np.ndarray) -> np.ndarray:
        h = np.full(len(at), self.seed ^ np.uint64(n))
        for j in range(n):
            h = (h ^ self.hashes[self.ids[at + j]]) * _ODD[j % len(_ODD)]
            h ^= h >> np.uint64(29)
        return h >> np.uint64(64 - BITS)


def packed_cells(cells: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Ascending cells as compressed differences, with counts below 256."""
    steps = np.diff(cells, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()
    return zstandard.ZstdCompressor(1).compress(planes + (b"" if counts is None else counts.astype(np.uint8).tobytes()))


def unpacked_cells(blob: bytes, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // (9 if counted else 8)
    steps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64)[:, 0]
    return np.cumsum(steps, dtype=np.uint64), raw[8 * n :]


def tallies(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each stands."""
    values = np.sort(values)
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.r_[first, len(values)])


def heavy_cells(blocks: DataFrame, longest: int, least: int, shards: int) -> DataFrame:
    """(id, z): for each block the cells of its phrases whose counts over all blocks reach ``least``."""
    wide = -(-(1 << BITS) // shards)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, lang, z in zip(batch["id"].to_pylist(), batch["lang"].to_pylist(), batch["z"].to_pylist(), strict=True):
                block = Block(lang, z)
                cells, counts = tallies(np.concatenate([block.cells(n, block.starts(n)) for n in range(2, longest + 1)]))
                edges = np.searchsorted(cells, np.arange(shards + 1, dtype=np.uint64) * np.uint64(wide))
                # a count that reaches ``least`` here reaches it everywhere, so more need not be known
                out = [(s, packed_cells(cells[a:b], np.minimum(counts[a:b], min(least, 255)))) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
                if out:
                    yield pa.record_batch([pa.array([s for s, _ in out], pa.int32()), pa.array([i] * len(out)), pa.array([b for _, b in out], pa.binary())], ["shard", "id", "z"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "shard"):
            parts = [unpacked_cells(b, True) for b in group["z"].to_pylist()]
            cells, counts = np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts])
            order = np.argsort(cells, kind="stable")
            first = np.flatnonzero(np.r_[True, cells[order[1:]] != cells[order[:-1]]])
            enough = np.add.reduceat(counts[order].astype(np.int64), first) >= min(least, 255)
            heavy = np.zeros(len(cells), bool)
            heavy[order] = np.repeat(enough, np.diff(np.r_[first, len(cells)]))
            bounds = np.cumsum([0, *(len(c) for c, _ in parts)])
            out = [(i, packed_cells(c[heavy[a:b]])) for i, (c, _), a, b in zip(group["id"].to_pylist(), parts, bounds[:-1], bounds[1:], strict=True) if heavy[a:b].any()]
            if out:
                yield pa.record_batch([pa.array([i for i, _ in out]), pa.array([z for _, z in out], pa.binary())], ["id", "z"])

    sent = blocks.select("id", "lang", "z").mapInArrow(send, "shard int, id string, z binary")
    return sent.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(weigh, "id string, z binary")


def candidates(block: Block, heavy: np.ndarray, longest: int) -> list[bytes]:
    """The distinct phrases of a block whose cells are in ``heavy``."""
    heavy = np.sort(heavy)
    near = np.zeros(1 << 20, bool)
    near[(heavy & np.uint64(len(near) - 1)).astype(np.int64)] = True
    found = []
    for n in range(2, longest + 1):
        at = block.starts(n)
        cells = block.cells(n, at)
        maybe = near[(cells & np.uint64(len(near) - 1)).astype(np.int64)]
        at, cells = at[maybe], cells[maybe]
        if not len(at) or not len(heavy):
            continue
        at = at[heavy[np.minimum(np.searchsorted(heavy, cells), len(heavy) - 1)] == cells]
        code = block.ids[at]
        for j in range(1, n):  # number the phrases word by word, so that codes stay small and exact
            distinct, code = np.unique(code * len(block.words) + block.ids[at + j], return_inverse=True)
        one = np.zeros(len(distinct) if len(at) else 0, np.int64)
        one[code] = at
        found += [b" ".join([block.words[w] for w in phrase]) for phrase in block.ids[one[:, None] + np.arange(n)].tolist()]
    return found


def matches(text: bytes, phrases: list[bytes]) -> np.ndarray:
    """Overlapping occurrences of each phrase between delimiters, by one scan."""
    if not phrases:
        return np.zeros(0, np.int64)
    automaton = ahocorasick.Automaton()
    for k, phrase in enumerate(phrases):
        automaton.add_word(f" {phrase.decode('latin-1')} ", k)  # bytes as characters
    automaton.make_automaton()
    found = np.fromiter((k for _, k in automaton.iter(text.decode("latin-1"))), np.int64)
    return np.bincount(found, minlength=len(phrases))


def counted(blocks: DataFrame, heavy: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, size, f): every word, every candidate of any block, and (size 0) all words, with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in single_groups(batches, "id"):
            lang, blobs = group["lang"][0].as_py(), group["z"].to_pylist()
            block = Block(lang, blobs[0])
            cells = [unpacked_cells(b, False)[0] for b in blobs[1:]]
            phrases = candidates(block, np.concatenate(cells), longest) if cells else []
            single = np.bincount(block.ids, minlength=len(block.words))
            single[0] = 0
            names = pa.array([None, *block.words[1:], *phrases], pa.binary()).cast(pa.string())
            sizes = np.r_[0, np.ones(len(block.words) - 1, np.int32), np.array([p.count(b" ") + 1 for p in phrases], np.int32)].astype(np.int32)
            f = np.r_[single.sum(), single[1:], matches(block.text, phrases)]
            whole = pa.table([pa.array([lang] * len(f)), names, pa.array(sizes), pa.array(f, pa.int64())], ["lang", "phrase", "size", "f"])
            yield from whole.to_batches(max_chunksize=50_000)

    rows = blocks.select("id", F.lit(0).alias("kind"), "lang", "z").unionByName(heavy.select("id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("lang"), "z"))
    rows = rows.repartition("id").sortWithinPartitions("id", "kind").drop("kind")
    return rows.mapInArrow(run, "lang string, phrase string, size int, f long").groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, inside: int = 50, most: int = 2000, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` best phrases of 2 to ``longest`` words of each language.

    A phrase needs ``least`` occurrences, and goes if a longer one that holds it
    has ``inside`` in a hundred of its occurrences.
    """
    blocks = text_blocks(docs, text, lang, block)
    total = blocks.agg(F.sum("size")).first()[0] or 0
    shards = 1 + total * (longest - 1) // (6 * shard)  # words are six bytes long or so
    counts = stored(counted(blocks, heavy_cells(blocks, longest, least, shards), longest).where((F.col("size") == 0) | (F.col("f") >= least)), "collocation-counts")
    totals = small_enough(counts.where("size = 0").select("lang", F.col("f").alias("n")), 10_000)

    words = F.split("phrase", " ")
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    found = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("w"))
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    side = lambda name, f: counts.where("size > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    big = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("over", (F.lit(1_000_000).cast("decimal(7,0)") * big("a")).cast("decimal(38,0)") * big("a")).withColumn("under", big("l") * big("r"))
    score = F.expr("cast(over as decimal(38,0)) div cast(under as decimal(38,0))")
    scored = cuts.groupBy("lang", "phrase", "size").agg(F.min("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    # every phrase of 2 words or more that stands in a longer candidate, with the most that any of these counts
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda s: F.array_join(F.slice("w", s, m), " "))))
    within = found.where("size > 2").select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(within, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
