"""SimHash near-dedup through deletion-variant signatures.

A fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of a text's
3-word shingles. Two fingerprints link at ``distance`` or fewer differing bits.
Cut into (distance + 1) // 2 segments, one segment of two linked fingerprints
differs by at most one bit; so each segment is indexed under every variant with
one bit left out, variants meet by equality, and what meets is verified.

Equal fingerprints are one node before anything is joined. In a bucket of a
variant no pairs are emitted: a search from node to node over what is still
unreached gives a spanning forest, one link for each node at most, which keeps
the components whole. A bucket of more than WIDE fingerprints is first cut by
the bits it differs in, so that its search grows far slower than its square.

Defined results: null and empty texts have no shingles and the zero
fingerprint, linked like any other. Texts of one or two words have one shingle.
Rows with a null doc_id get a fingerprint and the component of their
fingerprint (null if no row of the component has a doc_id). Repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut, text_batches
from leafmill.llm.graph import connected_components, with_least

BITS = 64
#: Distinct fingerprints of a bucket above which it is searched part by part.
WIDE = 2_048


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        begin = np.r_[0, ends[:-shingle]].tolist()
        end = (ends[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(begin, end, strict=True)]
    counts = np.zeros(BITS, np.int64)
    values = np.array(hashes, "<u8")
    for at in range(0, len(values), 65536):
        part = values[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.record_batch([batch["doc_id"], pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def forest(fps: np.ndarray, distance: int, block: int = 64, span: int = 1 << 16) -> list[tuple[int, int]]:
    """Links (i, j) within ``distance`` that span the components of the fingerprints.

    At most ``block * span`` pairs are compared at a time, whatever the bucket's size.
    """
    links: list[tuple[int, int]] = []
    left = np.arange(len(fps))
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            now, front = front[:block], front[block:]
            missed, reached = [], [front]
            for at in range(0, len(left), span):
                part = left[at : at + span]
                near = np.bitwise_count(fps[now][:, None] ^ fps[part][None, :]) <= distance
                hit = near.any(0)
                links += zip(now[near[:, hit].argmax(0)].tolist(), part[hit].tolist(), strict=True)
                reached.append(part[hit])
                missed.append(part[~hit])
            front, left = np.concatenate(reached), np.concatenate(missed)
    return links


def wide_forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """``forest`` of a wide bucket: its varying bits are cut into ``distance + 1`` parts.

    Two linked fingerprints agree on one part at least, so that every link lies
    in a group that is equal on some part, and only those groups are searched.
    """
    varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
    places = [i for i in range(BITS) if varying >> i & 1]
    links: list[tuple[int, int]] = []
    for k in range(distance + 1):
        mask = np.uint64(sum(1 << i for i in places[k :: distance + 1]))
        part = fps & mask
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                mine = order[a:b]
                links += [(int(mine[i]), int(mine[j])) for i, j in forest(fps[mine], distance)]
    return links


def variants(distance: int) -> F.Column:
    """Array of (segment, wildcard, rest) keys of column fp."""
    segments = max(1, (distance + 1) // 2)
    out = []
    for s in range(segments):
        low, high = s * BITS // segments, (s + 1) * BITS // segments
        for w in range(low, high):
            mask = ((1 << high) - (1 << low)) & ~(1 << w)
            mask -= (1 << BITS) if mask >> (BITS - 1) else 0
            out.append(F.struct(F.lit(w).cast("short").alias("wild"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("rest")))
    return F.array(*out)


def fingerprint_links(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b): links among distinct ``nodes`` (fp) that keep their components whole.

    Each bucket of a variant is streamed from sorted rows; a wide bucket holds
    one long for each distinct fingerprint.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest_fps = None, np.empty(0, np.uint64)

        def search(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1), True])
            size = np.diff(edges)
            two = edges[:-1][size == 2]
            two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance]
            a, b = [fps[two]], [fps[two + 1]]
            for at, n in zip(edges[:-1][size > 2], size[size > 2], strict=True):
                group = fps[at : at + n]
                links = forest(group, distance) if n <= WIDE else wide_forest(group, distance)
                if links:
                    pairs = np.array(links)
                    a.append(group[pairs[:, 0]])
                    b.append(group[pairs[:, 1]])
            return pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            keys = np.stack([batch["wild"].to_numpy().astype(np.int64), batch["rest"].to_numpy()], 1)
            fps = batch["fp"].to_numpy().view(np.uint64)
            if rest_key is not None:
                keys = np.r_[np.repeat(rest_key[None], len(rest_fps), 0), keys]
                fps = np.r_[rest_fps, fps]
            if not len(keys):
                continue
            last = np.flatnonzero((keys != keys[-1]).any(1))
            whole = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on in the next batch
            rest_key, rest_fps = keys[-1].copy(), fps[whole:].copy()
            if whole:
                yield search(keys[:whole], fps[:whole])
        if rest_key is not None:
            yield search(np.repeat(rest_key[None], len(rest_fps), 0), rest_fps)

    keyed = nodes.select("fp", F.explode(variants(distance)).alias("key")).select(F.col("key.wild").alias("wild"), F.col("key.rest").alias("rest"), "fp")
    placed = text_batches(keyed).repartition("wild", "rest").sortWithinPartitions("wild", "rest")
    return placed.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row; component_id is the smallest doc_id reachable."""
    marked = cut(fingerprints(docs, shingle))
    groups = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    classes = connected_components(fingerprint_links(groups.select("fp"), distance))
    named = groups.join(classes, groups["fp"] == classes["node"], "left").select(groups["fp"], "least", F.coalesce("component", "fp").alias("component"))
    named = cut(named)
    by_print = with_least(named, "component", "least", named.count()).select("fp", F.col("m").alias("component_id"))
    return marked.join(by_print, "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """``docs`` less every document that is not the smallest doc_id of its group; same columns.

    Documents without words are one group like any other. Rows with a null
    doc_id stay; of rows that share the kept doc_id all stay. Rows go by their
    doc_id: where one of several rows of a doc_id is a lost copy, all go.
    """
    groups = near_duplicates(docs, distance, shingle)
    lost = groups.where("doc_id <> component_id").select("doc_id").distinct().hint("shuffle_hash")
    return docs.join(lost, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
