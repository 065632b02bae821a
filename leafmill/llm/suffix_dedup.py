"""Suffix-array dedup of byte substrings through longest-previous-factor arrays.

A byte of a document goes if it is covered by a ``length``-byte string that
also starts in a document of smaller doc_id; texts are UTF-8 bytes and matches
never cross documents.

In suffix order every suffix has a previous and a next suffix of a smaller
document, with a common prefix each; the longer of both is its factor
(``previous_factors``), and a string goes if its factor reaches ``length``.
A corpus has no one suffix array; it is cut so that equal strings meet:

1. Each ``length``-byte string names the smallest hash of its 20-byte grams,
   the leftmost of equal ones. Equal strings name the same gram at the same
   place in them, and neighbouring strings that name the same gram form one
   segment. Segments go to the shard of their gram under a name of 128 bits.
2. In a shard, equal names are blocks that are known to be equal, as in a round
   of prefix doubling: ordered by gram and name, a segment shares its whole
   length with its like. Segments whose factor is their length are covered
   whole; what is left of grams with several names are edges of copies.
3. Only the edges' bytes are sent, to their gram. There the suffixes of all
   edges are sorted by doubling, with their common prefixes, and the factor
   decides for every string. A gram with more than SPLIT edges is dealt out by
   the strings themselves, through the same arrays; a map batch runs them first,
   so that a string that very many documents hold leaves a batch once.
4. Covered strings return to their documents and are cut out.

A text that a smaller document holds whole goes whole (``later_copies``): it is
found by its digest and takes no part in these steps, where its smaller copy
stands for it.

A task remembers the least document of segments and strings that its batches
repeat (``Seen``), so that a passage of a third of all documents reaches its
shard about once for each task.

Defined results: null and empty texts have no bytes and lose none; texts
shorter than ``length`` lose none. Rows with a null doc_id are neither searched
nor changed. Rows that share a doc_id are one document: none covers another.
An empty table gives an empty result. Extra columns stay in struct ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import stored, text_batches
from leafmill.llm.shards import Seen, by_doc, cut_by_doc, least, pack, place_base, runs, shared, squeezed, unpack_rows, whole_groups

GRAM = 20
#: Segments that one shard holds about, at every size; edges of one gram above which they are dealt out by their strings.
SHARD_SEGMENTS = 400_000
SPLIT = 4_096
CHUNK, BLOCK = 1 << 20, 1 << 15
#: Whole copies of a text are left out before it is cut: by a broadcast of so many, or by moving all texts where one in so many is a copy.
FEW_COPIES, MANY_COPIES = 1 << 20, 4
#: A segment's name: 40 bits of its gram and 24 of its own hash in one word, 64 of its hash in the other.
GRAM_BITS = 40

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _rng.integers(0, 1 << 63, 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.arange(CHUNK, dtype=np.uint64)


def suffix_order(data: np.ndarray, left: np.ndarray, chosen: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(``chosen`` suffixes in order, length of the prefix that each shares with the one before it).

    ``data`` holds texts side by side; ``left`` counts the bytes from each place
    to the end of its text, where its suffix ends. Prefix doubling from seven
    bytes a word; the ranks of each round give the common prefixes. With a
    ``depth``, suffixes that share so many bytes are in any order, and a common
    prefix may be given as no more than that.
    """
    n, width = len(data), 7
    key = np.zeros(n, np.uint64)
    for k in range(width):
        symbol = np.zeros(n, np.uint64)
        symbol[: max(0, n - k)] = data[k:] + np.uint64(1)
        symbol[left <= k] = 0
        key = key << np.uint64(9) | symbol
    ranks = []
    while True:
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
        ranks.append((width, rank))
        if not n or width >= (left.max() if depth is None else min(depth, left.max())):
            break
        ahead = np.zeros(n, np.uint64)
        ahead[: max(0, n - width)] = rank[width:]
        ahead[left <= width] = 0
        key, width = rank << np.uint64(32) | ahead, 2 * width
    order = chosen[np.argsort(ranks[-1][1][chosen], kind="stable")]
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    room = np.minimum(left[a], left[b])
    for step, rank in [*ranks[::-1], *[(1, data)] * 6]:
        near = common < room
        x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        common += step * (near & (rank[x] == rank[y]))
    return order, np.r_[0, np.minimum(common, room)] if len(order) else common


def _smaller_before(doc: np.ndarray, common: np.ndarray, floor: int) -> np.ndarray:
    """Prefix shared with the nearest suffix before of a smaller document; 0 where it is under ``floor``.

    Every suffix points to the one before; while that is of no smaller document
    it takes over its pointer, under the lesser of both prefixes.
    """
    to, prefix = np.arange(len(doc)) - 1, common.copy()
    open_ = np.flatnonzero(prefix >= floor)
    prefix[prefix < floor] = 0
    while len(open_):
        open_ = open_[doc[to[open_]] >= doc[open_]]
        via = to[open_]
        to[open_], prefix[open_] = to[via], np.minimum(prefix[open_], prefix[via])
        lost = prefix[open_] < floor
        prefix[open_[lost]] = 0
        open_ = open_[~lost]
    return prefix


def previous_factors(doc: np.ndarray, common: np.ndarray, floor: int = 1) -> np.ndarray:
    """Longest prefix of each suffix, in suffix order, that a suffix of a smaller document shares; 0 where it is under ``floor``.

    ``common[r]`` is shared by suffixes r - 1 and r. The longest match stands
    next to the suffix among those of smaller documents, before or after it.
    """
    after = np.r_[common[1:], 0][::-1] if len(common) else common
    return np.maximum(_smaller_before(doc, common, floor), _smaller_before(doc[::-1], after, floor)[::-1])


def longest_previous_factor(data: bytes) -> np.ndarray:
    """The LPF array of one text: of each place the longest prefix that also starts at a smaller place."""
    n = len(data)
    order, common = suffix_order(np.frombuffer(data, np.uint8), n - np.arange(n), np.arange(n))
    factors = np.zeros(n, np.int64)
    factors[order] = previous_factors(order, common)
    return factors


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= _MUL[8]
    x ^= x >> np.uint64(29)
    x *= _MUL[9]
    x ^= x >> np.uint64(32)
    return x


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte grams: sixteen bytes by doubling, and four more."""
    h, width, tail = _BYTE.take(data), 1, None
    for k in range(4):
        left = h[:-width] * _MUL[k]
        left += h[width:]
        h, width = left, 2 * width
        if width == GRAM - 16:
            tail = h
    h = h[: len(data) - GRAM + 1] * _MUL[6]
    h += tail[16 : 16 + len(h)]
    return _mix(h)


def segments_of(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(number of its text, both words of its name, first string, gram's distance from it, strings) of each segment, text by text.

    Short texts are worked on side by side, a BLOCK at a time; no string crosses from one to the next.
    """
    parts = []
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= BLOCK):
            held += len(texts[end])
            end += 1
        if end - at > 1:
            parts.append(_block_segments(b"".join(texts[at:end]), np.array([len(t) for t in texts[at:end]]), length, at, 0))
        else:
            text = texts[at]
            for begin in range(0, max(1, len(text) - length + 1), CHUNK - length + 1):
                chunk = text[begin : begin + CHUNK]
                parts.append(_block_segments(chunk, np.array([len(chunk)]), length, at, begin))
        at = end
    parts = [p for p in parts if p is not None]
    if not parts:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _block_segments(block: bytes, sizes: np.ndarray, length: int, number: int, begin: int) -> tuple[np.ndarray, ...] | None:
    """The segments of texts of these sizes that stand side by side; ``number``: that of the first, ``begin``: its place."""
    if len(block) < length:
        return None
    h = _grams(np.frombuffer(block, np.uint8))
    low = h & ~np.uint64(CHUNK - 1)
    low |= _PLACE[: len(h)]  # a tie goes to the left
    window = length - GRAM + 1
    w = 1
    while 2 * w <= window:
        low, w = np.minimum(low[:-w], low[w:]), 2 * w
    if w < window:
        low = np.minimum(low[: len(low) - (window - w)], low[window - w :])
    cut = np.empty(len(low), bool)
    cut[0] = True
    np.not_equal(low[1:], low[:-1], out=cut[1:])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    stops = np.maximum(starts, ends - length + 1)  # from here to its end no string of a text begins
    for a, b, c in zip(starts.tolist(), stops.tolist(), ends.tolist(), strict=True):
        if a < c:
            cut[a : a + 1] = True
            cut[b:c] = False
            cut[b : b + 1] = True
    first = np.flatnonzero(cut)
    n = np.diff(np.r_[first, len(low)])
    owner = np.searchsorted(ends, first, "right")
    real = first < stops[owner]
    first, n, owner = first[real], n[real], owner[real]
    gram = (low[first] & np.uint64(CHUNK - 1)).astype(np.int64)
    size = n + length - 1
    seg = n.astype(np.uint64) * _MUL[7] + (gram - first).astype(np.uint64) * _MUL[10]
    more = seg * _MUL[9]
    for k in range(0, 2 * length, GRAM - 5):  # overlapping grams up to the segment's end
        piece = h[first + np.minimum(k, size - GRAM)]
        seg, more = _mix(seg * _MUL[11] + piece), (more + piece) * _MUL[8] ^ (more >> np.uint64(29))
    return owner + number, h[gram] << np.uint64(64 - GRAM_BITS) | _mix(more) >> np.uint64(GRAM_BITS), seg, first - starts[owner] + begin, gram - first, n


def segments(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(both words of its name, first string, gram's distance from it, strings) of each segment of a text."""
    return segments_of([text], length)[1:]


def codes(first: np.ndarray, back: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Place, distance of the gram and number of strings of each segment in one long, in order of place."""
    return (first << 12) | (back << 6) | (n - 1)


def decoded(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code = code & ((1 << 44) - 1)
    return code >> 12, (code >> 6) & 63, (code & 63) + 1


def named_factors(doc: np.ndarray, one: np.ndarray, two: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Factors of whole segments, ordered by name and document: equal names share all their strings, ``n`` of them."""
    same = np.r_[False, (one[1:] == one[:-1]) & (two[1:] == two[:-1])] if len(doc) else np.empty(0, bool)
    return previous_factors(doc, np.where(same, n, 0))


def shard_segments(rows: DataFrame, length: int, shards: int, salted: bool) -> DataFrame:
    """(shard, doc_id, blob): packed segments by shard; of equal ones a batch sends on the smallest doc_id at most.

    Rows with a doc_id name its segments that the task itself has shown to be covered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            rows_ = sorted(zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True), key=lambda r: r[0])
            if not rows_:
                continue
            owner, one, two, first, back, n = segments_of([text or b"" for _, text in rows_], length)
            doc = np.array([d for d, _ in rows_], np.int64)[owner]
            at = codes(first, back, n) + np.array([place_base(text, salted) for _, text in rows_], np.int64)[owner]
            often = np.flatnonzero(shared(two))
            often = often[np.lexsort((doc[often], two[often], one[often]))]
            later = np.zeros(len(doc), bool)
            later[often] = named_factors(doc[often], one[often], two[often], decoded(at[often])[2]) > 0
            later |= seen.later(one, two, doc)
            seen.add(one[often], two[often], doc[often])
            out: list[tuple[int, int | None, bytes]] = [(d % shards, d, a) for d, a in cut_by_doc(doc[later], at[later])]
            doc, at, one, two = (x[~later] for x in (doc, at, one, two))
            # mixed again, because the least hash of a window has small high bits
            shard = ((_mix(one >> np.uint64(64 - GRAM_BITS)) >> np.uint64(24)) % np.uint64(shards)).astype(np.int64)
            keep = np.argsort(shard.astype(np.uint16) if shards < 65536 else shard, kind="stable")  # by document and place already
            for k, d, a, x, y in by_doc(shard[keep], *(v[keep] for v in (doc, at, one, two))):
                out.append((k, None, pack(d, a, x, y, width=8)))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["shard", "doc_id", "blob"])

    return rows.mapInArrow(run, "shard int, doc_id long, blob binary")


def resolve_shards(packed: DataFrame) -> DataFrame:
    """(doc_id, blob, keys): longs of covered segments; with ``keys``, edges and their grams, the lowest bit set where they are to be dealt out by strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "shard"):
            rows: list[tuple[int, bytes, bytes | None]] = []
            shards, owners, blobs = (table[c].to_pylist() for c in ("shard", "doc_id", "blob"))
            parts: dict[int, list] = {}
            for shard, owner, blob in zip(shards, owners, blobs, strict=True):
                if owner is not None:
                    rows.append((owner, blob, None))
                else:
                    parts.setdefault(shard, []).append(unpack_rows(blob, 2, 8))
            for shard, mine in parts.items():
                doc, at, one, two = (np.concatenate(x) for x in zip(*mine, strict=True))
                often = np.flatnonzero(shared(one >> np.uint64(64 - GRAM_BITS)))
                order = often[np.lexsort((doc[often], two[often], one[often]))]
                doc, at, one, two = doc[order], at[order], one[order], two[order]
                later = named_factors(doc, one, two, decoded(at)[2]) > 0
                rows += [(d, a, None) for d, a in cut_by_doc(doc[later], at[later])]
                gram = one >> np.uint64(64 - GRAM_BITS)
                same, forms = runs(gram), runs(one, two)
                low, high = least(same, doc), -least(same, -doc)
                several = -least(same, -forms) > least(same, forms)
                edges = several & (low < high) & ~later
                many = np.bincount(same, edges)[same] > SPLIT if len(same) else edges
                key = (np.uint64(shard) << np.uint64(GRAM_BITS + 1)) | gram << np.uint64(1) | many
                rows += cut_by_doc(doc[edges], at[edges], key[edges])
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["doc_id", "blob", "keys"])

    placed = packed.repartition("shard").sortWithinPartitions("shard")
    return placed.mapInArrow(run, "doc_id long, blob binary, keys binary")


def _binaries(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The slices of ``data`` as a binary column."""
    ends = np.cumsum(size)
    offsets = np.r_[0, ends].astype(np.int32)
    bytes_ = data[np.repeat(start - (ends - size), size) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(bytes_.tobytes())])


def covered_masks(segs: pa.Array, n: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """One long for each segment: bit k is set where string k has a factor of ``length`` or more."""
    mask = np.zeros(len(n), np.int64)
    if not len(n):
        return mask
    data = np.frombuffer(b"".join(segs.to_pylist()), np.uint8)
    size = n + length - 1
    owner = np.repeat(np.arange(len(n)), size)
    left = np.cumsum(size)[owner] - np.arange(len(data))
    # a suffix of fewer than ``length`` bytes can neither go nor cover another
    order, common = suffix_order(data, left, np.flatnonzero(left >= length), length)
    who = owner[order]
    hit = previous_factors(doc[who], common, length) >= length
    who, at = who[hit], order[hit]
    number = size[who] - left[at]
    np.bitwise_or.at(mask, who, np.int64(1) << number)
    return mask


EDGES = "key long, doc_id long, place long, n int, seg binary, mask long"


def edge_segments(rows: DataFrame, edges: DataFrame, length: int, salted: bool) -> DataFrame:
    """EDGES: the bytes of the edges, from the documents that have some; rows with a mask are decided already."""
    names = [c.split()[0] for c in EDGES.split(", ")]

    def dealt(data: np.ndarray, start: np.ndarray, doc: np.ndarray, place: np.ndarray, seen: Seen) -> list[pa.RecordBatch]:
        """Single strings under keys of their own; those whose batch or task has a smaller document are decided."""
        if not len(start):
            return []
        strings = data[start[:, None] + np.arange(length)]
        words = np.zeros((len(start), -(-length // 8) * 8), np.uint8)
        words[:, :length] = strings
        one, two = np.full(len(start), _MUL[0]), np.full(len(start), _MUL[1])
        for word in words.view(np.uint64).T:
            one, two = _mix(one + word), (two ^ word) * _MUL[2] ^ (two >> np.uint64(27))
        two = _mix(two)
        segs = _binaries(data, start, np.full(len(start), length))
        n = np.ones(len(start), np.int64)
        hit = (covered_masks(segs, n, doc, length) > 0) | seen.later(one, two, doc)
        often = np.flatnonzero(shared(one))
        seen.add(one[often], two[often], doc[often])
        sides = []
        for take, done in ((hit, True), (~hit, False)):
            m = int(take.sum())
            body, mask = (pa.nulls(m, pa.binary()), pa.array(np.ones(m, np.int64))) if done else (segs.filter(pa.array(take)), pa.nulls(m, pa.int64()))
            sides.append(pa.record_batch([pa.array(one[take].view(np.int64)), pa.array(doc[take]), pa.array(place[take]), pa.array(n[take].astype(np.int32)), body, mask], names))
        return sides

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        seen = Seen()
        for batch in batches:
            texts, starts, codes_, keys, docs, base_at = [], [], [], [], [], 0
            for doc_id, z, blobs in zip(batch["doc_id"].to_pylist(), batch["z"].to_pylist(), batch["blobs"].to_pylist(), strict=True):
                text = unpack(z) if z else b""
                base = place_base(text, salted)
                at = np.frombuffer(b"".join(x["blob"] for x in blobs), "<i8")
                key = np.frombuffer(b"".join(x["keys"] for x in blobs), "<u8")
                mine = (at - base >= 0) & (at - base < 1 << 44)
                texts.append(text)
                starts.append(decoded(at[mine] - base)[0] + base_at)
                codes_.append(at[mine])
                keys.append(key[mine])
                docs.append(np.full(int(mine.sum()), doc_id, np.int64))
                base_at += len(text)
            if not texts:
                continue
            data = np.frombuffer(b"".join(texts), np.uint8)
            start, place, key, doc = (np.concatenate(x) for x in (starts, codes_, keys, docs))
            _, _, n = decoded(place)
            many = (key & np.uint64(1)).astype(bool)
            few = ~many
            yield pa.record_batch(
                [pa.array(key[few].view(np.int64)), pa.array(doc[few]), pa.array(place[few]), pa.array(n[few].astype(np.int32)), _binaries(data, start[few], n[few] + length - 1), pa.nulls(int(few.sum()), pa.int64())], names
            )
            size = n[many]
            number = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            single = (np.repeat(place[many], size) & ~np.int64(63)) + (number << 12)  # a segment of one string, at its own place
            for at in range(0, len(number), 100_000):
                part = slice(at, at + 100_000)
                yield from dealt(data, (np.repeat(start[many], size) + number)[part], np.repeat(doc[many], size)[part], single[part], seen)

    lists = edges.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("blob", "keys")).alias("blobs")).hint("shuffle_hash")
    found = rows.join(lists, rows["doc_id"] == lists["id"]).select("doc_id", "z", "blobs")
    return found.mapInArrow(run, EDGES)


def covered_strings(segs: DataFrame, length: int) -> DataFrame:
    """(doc_id, place, mask): bit k of mask is set where string k of the segment starts in a smaller doc_id too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            doc, place, n = (table[c].to_numpy() for c in ("doc_id", "place", "n"))
            mask = covered_masks(table["seg"], n.astype(np.int64), doc, length)
            some = mask != 0
            yield pa.record_batch([pa.array(doc[some]), pa.array(place[some]), pa.array(mask[some])], ["doc_id", "place", "mask"])

    open_ = segs.where("mask is null").drop("mask").repartition("key").sortWithinPartitions("key")
    decided = segs.where("mask is not null").select("doc_id", "place", "mask")
    return open_.mapInArrow(run, "doc_id long, place long, mask long").unionByName(decided)


def cut_spans(text: bytes, whole: np.ndarray, part: list[tuple[int, int]], length: int, base: int = 0) -> tuple[bytes, int, int]:
    """(kept bytes, bytes removed, runs removed)."""
    if not len(whole) and not part:
        return text, 0, 0
    step = np.zeros(len(text) + 1, np.int32)
    whole = whole - base
    first, _, n = decoded(whole[(whole >= 0) & (whole < 1 << 44)])
    np.add.at(step, first, 1)
    np.add.at(step, first + n + length - 1, -1)
    for at, mask in part:
        if 0 <= at - base < 1 << 44:
            starts = ((at - base) >> 12) + np.flatnonzero(np.unpackbits(np.array([mask], "<i8").view(np.uint8), bitorder="little"))
            np.add.at(step, starts, 1)
            np.add.at(step, starts + length, -1)
    gone = np.cumsum(step[:-1]) > 0
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return kept, int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum())


def later_copies(named: DataFrame, length: int) -> DataFrame:
    """doc_id of the texts of ``length`` bytes or more that a smaller doc_id holds whole; ``named``: doc_id, size and name (a digest) of every text."""
    named = named.where((F.col("size") >= length) & F.col("doc_id").isNotNull()).select("doc_id", "name")
    first = named.groupBy("name").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    return named.join(first, "name").where("doc_id > first").select("doc_id")


def unsqueezed(rows: DataFrame) -> DataFrame:
    """(doc_id, text) of rows whose texts were compressed to be moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [None if z is None else unpack(z) for z in part["z"].to_pylist()]
                yield pa.record_batch([part["doc_id"], pa.array(texts, pa.binary())], ["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id long, text binary")


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """The other columns of ``docs`` in struct ``row``, kept (binary), n_bytes, n_removed and n_spans.

    ``length``: 36 to 64 bytes; strings are judged on the input, not on what is left.
    """
    if not 36 <= length <= 64:
        raise ValueError("length must be from 36 to 64")
    rows = text_batches(docs).select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")
    )
    named = stored(rows.select("doc_id", F.octet_length("text").alias("size"), F.unhex(F.sha2("text", 256)).alias("name")), "names")
    facts = named.agg(F.sum("size"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    salted = facts[1] != facts[2]
    own = rows.where("doc_id is not null").select("doc_id", "text")
    copies = None if salted else stored(later_copies(named, length), "copies")
    if copies is not None:
        n = copies.count()
        if n <= FEW_COPIES:
            own = own.join(F.broadcast(copies), "doc_id", "left_anti")
        elif n * MANY_COPIES >= facts[1]:
            own = unsqueezed(squeezed(own, "doc_id").join(copies.hint("shuffle_hash"), "doc_id", "left_anti"))
        else:  # they cost less than moving all texts; their segments show the same
            copies = None
    shards = max(16, int((facts[0] or 0) / 14 / SHARD_SEGMENTS))  # a segment for about 14 bytes
    marks = stored(resolve_shards(shard_segments(own, length, shards, salted)), "marks")
    segs = stored(edge_segments(squeezed(rows.where("doc_id is not null"), "doc_id"), marks.where("keys is not null"), length, salted), "segments")
    parts = covered_strings(segs, length).groupBy("doc_id").agg(F.collect_list(F.struct("place", "mask")).alias("parts"))
    whole = marks.where("keys is null").groupBy("doc_id").agg(F.collect_list("blob").alias("blobs"))
    found = whole.join(parts, "doc_id", "full").withColumn("gone", F.lit(False))
    if copies is not None:
        found = found.unionByName(copies.withColumn("gone", F.lit(True)), allowMissingColumns=True)
    found = found.withColumnRenamed("doc_id", "id").hint("shuffle_hash")
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: list[tuple] = []
            for z, blobs, part, gone in zip(*(batch[c].to_pylist() for c in ("z", "blobs", "parts", "gone")), strict=True):
                text = unpack(z) if z else b""
                if gone:
                    out.append((b"", len(text), len(text), 1))
                    continue
                places = np.frombuffer(b"".join(blobs), "<i8") if blobs else np.empty(0, np.int64)
                kept, removed, spans = cut_spans(text, places, [(p["place"], p["mask"]) for p in part or []], length, place_base(text, salted))
                out.append((kept, len(text), removed, spans))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([batch["row"], *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["row", "kept", "n_bytes", "n_removed", "n_spans"])

    small = squeezed(rows, "row", "doc_id")
    joined = small.join(found, small["doc_id"] == found["id"], "left").select("row", "z", "blobs", "parts", "gone")
    return joined.mapInArrow(run, f"row {kind}, kept binary, n_bytes long, n_removed long, n_spans long")
