"""Substring dedup by sliding sentence spans.

A text is cut into sentences after ``.!?`` and closing marks before white
space, after the marks ``。！？`` with or without it, and at line breaks; each
ideograph or kana counts as a word. A sentence of more than ``unit_words`` words counts
as several pieces. With ``content_cuts`` it is cut after the word of least hash
(the last of equal ones) of every ``unit_words`` consecutive words, so pieces
have at most so many words and fall into step inside a copied passage, whatever
stands before it: between the first and the last window that lie in the passage
all cuts agree, and a passage of ``3 * unit_words`` words without any sentence
end is found; up to ``unit_words`` words at either end of it stay. Without it,
pieces of ``unit_words`` words are counted from the sentence's start, and copies
after different lead-in words agree only by chance. Every run of several consecutive sentences with
``min_words`` words is hashed: from each sentence forwards to the first that
completes it, and from each sentence backwards, of two sentences at least. So
every sentence of a repeated passage of ``2 * min_words + unit_words`` words
lies in some run of the passage. With ``few_sentences`` the runs of so many whole
sentences that have fewer words are hashed as well, and so is a text that is
shorter or one sentence, as a whole. What stays then: in texts that differ,
fewer repeated sentences than that with fewer than ``min_words`` words together,
single repeated sentences, and all but whole lines, sentences and texts in
scripts other than Chinese and Japanese that set no spaces. Words are compared lower-cased, with one space
between them.

Runs are joined over the whole corpus by their hashes; the first occurrence, by
doc_id and then place, stays, and the sentences that any other occurrence
covers go, with the white space after them. The runs are judged on the input.

Runs are packed by shard, and within a map batch only the first of equal runs
is sent on, so a passage that a third of all documents hold reaches its shard
once for each batch.

Defined results: null and empty texts have no sentences and an empty rest. Rows
with a null doc_id are neither searched nor changed. Rows that share doc_id and
text are one document. An empty table gives an empty result; extra columns stay
in struct ``row``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, text_batches
from leafmill.llm.shards import by_doc, least, pack, place_base, runs, squeezed, unpack_rows, whole_groups

MIN_WORDS, UNIT_WORDS = 16, 24
#: Runs that one shard holds about, at every size.
SHARD_RUNS = 100_000

_END = re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？｡．][\"'”’»)\]」』）】》〉〕]*\s*|\n\s*")
_WORD = re.compile(r"\S+")
#: Ideographs and kana, which are written without spaces between words; each, with the marks after it, is a word.
_WIDE = "\u3005-\u3007\u3041-\u3096\u30a1-\u30fa\u30fc-\u30fe\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_HAS_WIDE, _WIDE_WORD = re.compile(f"[{_WIDE}]"), re.compile(rf"[{_WIDE}][^\w\s]*|[^\s{_WIDE}]+")


@lru_cache(1 << 16)
def _word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))


def content_starts(words: list[str], width: int) -> list[int]:
    """Where the pieces of more than ``width`` words begin: at 0, and after the last least hash of every ``width`` words."""
    hashes = [*map(_word_hash, words)]
    at = -1
    cuts = [0]
    for i in range(width - 1, len(words)):  # the window that ends with word i; its least hash is mostly the one of the window before
        if at >= 0 and hashes[i] <= hashes[at]:
            at = i
        elif at <= i - width:
            window = hashes[i - width + 1 : i + 1]
            at = i - window[::-1].index(min(window))
        else:
            continue
        cuts.append(at + 1)
    if cuts[-1] == len(words):
        cuts.pop()
    return cuts


def sentences(text: str, unit_words: int = UNIT_WORDS, content_cuts: bool = False) -> tuple[np.ndarray, np.ndarray, str, np.ndarray, np.ndarray]:
    """(ends, words so far, text for comparing, its ends) of a text's sentences, each of which ends where the next begins; and which of them begin a whole one."""
    ends, counts, plain, whole = [], [], [], []
    at = 0
    wide = not text.isascii() and _HAS_WIDE.search(text)
    word, split = (_WIDE_WORD, _WIDE_WORD.findall) if wide else (_WORD, str.split)
    for end in [*[m.end() for m in _END.finditer(text)], len(text)]:
        if end == at:
            continue
        words = split(text[at:end].lower())
        if words or not ends:
            whole.append(len(ends))
        if len(words) > unit_words:
            starts = [m.start() for m in word.finditer(text, at, end)]
            cuts = content_starts(words, unit_words) if content_cuts else list(range(0, len(words), unit_words))
            for a, b in zip(cuts, [*cuts[1:], len(words)], strict=True):
                part = words[a:b]
                ends.append(starts[b] if b < len(starts) else end)
                counts.append(len(part))
                plain.append(" ".join(part))
        elif words or not ends:
            ends.append(end)
            counts.append(len(words))
            plain.append(" ".join(words))
        else:  # white space alone belongs to the sentence before
            ends[-1] = end
        at = end
    plain_ends = np.cumsum([len(p) + 1 for p in plain]) if plain else np.empty(0, np.int64)
    return np.array(ends, np.int64), np.cumsum(counts, dtype=np.int64), " ".join(plain), plain_ends.astype(np.int64), np.array(whole, np.int64)


def spans(words_so_far: np.ndarray, min_words: int = MIN_WORDS, whole: np.ndarray | None = None, few_sentences: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) sentence of every run, in order of first and last; with ``few_sentences`` also the short runs of so many whole ones, and a short text."""
    n = len(words_so_far)
    if n == 1 and few_sentences and words_so_far[0]:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    before = np.r_[0, words_so_far[:-1]]
    i = np.arange(n)
    last = np.maximum(np.searchsorted(words_so_far, before + min_words), i + 1)
    first = np.minimum(np.searchsorted(before, words_so_far - min_words, side="right") - 1, i - 1)
    ahead, behind = last < n, first >= 0
    key = np.r_[i[ahead] * n + last[ahead], first[behind] * n + i[behind]]
    if few_sentences:  # runs of min_words cover all that is longer
        begin, end = whole[: len(whole) - few_sentences + 1], np.r_[whole[1:], n][few_sentences - 1 :] - 1
        short = words_so_far[end] - before[begin] < min_words
        key = np.r_[key, begin[short] * n + end[short], [n - 1] if words_so_far[-1] < min_words else []].astype(np.int64)
    key = np.unique(key)
    return key // n, key % n


def run_hashes(text: str, min_words: int, unit_words: int, content_cuts: bool = False, few_sentences: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every run of a text, in order."""
    _, words, plain, ends, whole = sentences(text, unit_words, content_cuts)
    first, last = spans(words, min_words, whole, few_sentences)
    if not len(first):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    begin = np.r_[0, ends[:-1]][first]
    digest = xxhash.xxh3_128_digest
    got = b"".join([digest(plain[a:b].encode()) for a, b in zip(begin.tolist(), (ends[last] - 1).tolist(), strict=True)])
    both = np.frombuffer(got, "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def shard_runs(rows: DataFrame, shards: int, salted: bool, min_words: int, unit_words: int, content_cuts: bool = False, few_sentences: int = 0) -> DataFrame:
    """(shard, later, blob): runs packed by shard; ``later`` rows are runs that their own batch shows to be no first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, places, one, two = [], [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                text = text or b""
                a, b = run_hashes(text.decode("utf-8", "replace"), min_words, unit_words, content_cuts, few_sentences)
                docs.append(np.full(len(a), doc_id, np.int64))
                places.append(np.arange(len(a)) + place_base(text, salted))
                one.append(a)
                two.append(b)
            if not docs:
                continue
            doc, at, a, b = (np.concatenate(x) for x in (docs, places, one, two))
            order = np.lexsort((at, doc, b, a))
            doc, at, a, b = doc[order], at[order], a[order], b[order]
            group = runs(a, b)
            first = np.r_[True, group[1:] != group[:-1]] if len(group) else np.empty(0, bool)
            top = np.flatnonzero(first)[group] if len(group) else group
            later = (doc != doc[top]) | (at != at[top])
            out: list[tuple[int, bool, bytes]] = []
            for d, p in by_doc(doc[later], at[later]):
                out.append((d % shards, True, pack(np.full(len(p), d), np.sort(p))))
            doc, at, a, b = (x[first] for x in (doc, at, a, b))
            shard = ((a >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)  # 32 bits: shards stay of one size at any input
            order = np.lexsort((at, doc, shard))
            for k, d, p, x, y in by_doc(shard[order], *(v[order] for v in (doc, at, a, b))):
                out.append((k, False, pack(d, p, x, y)))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.binary())], ["shard", "later", "blob"])

    return rows.mapInArrow(run, "shard int, later boolean, blob binary")


def later_runs(packed: DataFrame) -> DataFrame:
    """(doc_id, blob): places of the runs that are not the first of their kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "shard"):
            ids: list[int] = []
            blobs: list[bytes] = []
            for shard in np.unique(table["shard"].to_numpy()):
                rows = table.filter(pa.compute.equal(table["shard"], int(shard)))
                places, parts = [], []
                for later, blob in zip(rows["later"].to_pylist(), rows["blob"].to_pylist(), strict=True):
                    got = unpack_rows(blob, 0 if later else 2)
                    (places if later else parts).append(got)
                if parts:
                    doc, at, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
                    order = np.lexsort((at, doc, b, a))
                    doc, at, group = doc[order], at[order], runs(a[order], b[order])
                    top = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])[group] if len(group) else group
                    more = (doc != doc[top]) | (at != at[top])
                    places.append([doc[more], at[more]])
                if places:
                    for d, p in by_doc(*(np.concatenate(x) for x in zip(*places, strict=True))):
                        ids.append(d)
                        blobs.append(pack(np.full(len(p), d), p))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "blob"])

    placed = packed.repartition("shard").sortWithinPartitions("shard")
    return placed.mapInArrow(run, "doc_id long, blob binary")


def cut_runs(text: str, places: np.ndarray, min_words: int, unit_words: int, content_cuts: bool = False, few_sentences: int = 0) -> tuple[str, int, int]:
    """(rest, sentences, sentences removed)."""
    ends, words, _, _, whole = sentences(text, unit_words, content_cuts)
    if not len(places):
        return text, len(ends), 0
    first, last = spans(words, min_words, whole, few_sentences)
    places = places[(places >= 0) & (places < len(first))]
    step = np.zeros(len(ends) + 1, np.int64)
    np.add.at(step, first[places], 1)
    np.add.at(step, last[places] + 1, -1)
    gone = np.cumsum(step[:-1]) > 0
    begin = np.r_[0, ends[:-1]]
    rest = "".join([text[a:b] for a, b, g in zip(begin.tolist(), ends.tolist(), gone.tolist(), strict=True) if not g])
    return rest, len(ends), int(gone.sum())


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, unit_words: int = UNIT_WORDS, content_cuts: bool = False, few_sentences: int = 0) -> DataFrame:
    """The other columns of ``docs`` in struct ``row``, kept (string), n_sentences and n_removed."""
    rows = text_batches(docs).select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")
    )
    facts = rows.agg(F.sum(F.octet_length("text")), F.count("doc_id"), F.countDistinct("doc_id")).first()
    salted = facts[1] != facts[2]
    shards = max(16, int((facts[0] or 0) / 50 / SHARD_RUNS))
    own = rows.where("doc_id is not null").select("doc_id", "text")
    marks = later_runs(shard_runs(own, shards, salted, min_words, unit_words, content_cuts, few_sentences))
    lists = marks.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("blob").alias("blobs")).hint("shuffle_hash")
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: list[tuple] = []
            for z, blobs in zip(batch["z"].to_pylist(), batch["blobs"].to_pylist(), strict=True):
                data = unpack(z) if z else b""
                places = np.concatenate([unpack_rows(b, 0)[1] for b in blobs]) if blobs else np.empty(0, np.int64)
                out.append(cut_runs(data.decode("utf-8", "replace"), places - place_base(data, salted), min_words, unit_words, content_cuts, few_sentences))
            columns = list(zip(*out, strict=True)) or [()] * 3
            kinds = [pa.string(), pa.int64(), pa.int64()]
            yield pa.record_batch([batch["row"], *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["row", "kept", "n_sentences", "n_removed"])

    small = squeezed(rows, "row", "doc_id")
    joined = small.join(lists, small["doc_id"] == lists["id"], "left").select("row", "z", "blobs")
    return joined.mapInArrow(run, f"row {kind}, kept string, n_sentences long, n_removed long")
