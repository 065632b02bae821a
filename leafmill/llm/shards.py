"""Rows of (document, place, hashes) packed into shards, and texts packed for moving.

Billions of small rows cost most in their row format. Here a map batch packs
its rows for a shard into one binary value, and shards are read back group by
group from a sorted stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame


def pack(doc: np.ndarray, at: np.ndarray, *hashes: np.ndarray, width: int = 6) -> bytes:
    """Rows as bytes: ``width`` low bytes of each hash, then doc ids and places as compressed differences."""
    thin = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes() for x in hashes]
    steps = np.r_[np.diff(doc, prepend=0), np.diff(at, prepend=0)].astype(np.int64)
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(doc).to_bytes(4, "little") + b"".join(thin) + zstandard.ZstdCompressor(1).compress(planes)


def unpack_rows(blob: bytes, hashes: int, width: int = 6) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:4], "little"), 4, []
    for _ in range(hashes):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(blob, np.uint8, width * n, at).reshape(-1, width)
        out.append(wide.view(np.uint64)[:, 0])
        at += width * n
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[at:]), np.uint8).reshape(8, -1)
    steps = np.ascontiguousarray(planes.T).view(np.int64)[:, 0]
    return [np.cumsum(steps[:n]), np.cumsum(steps[n:]), *out]


def shared(hashes: np.ndarray) -> np.ndarray:
    """Whether each hash stands more than once; one unstable sort, so that only such rows need a full order."""
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    out = np.zeros(len(hashes), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def runs(*keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys for each of the sorted rows."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def least(run: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Least value of each row's run."""
    begin = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    return np.minimum.reduceat(value, begin)[run] if len(run) else value


def by_doc(doc: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(doc, *columns) of each document."""
    order = np.argsort(doc, kind="stable")
    doc, columns = doc[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]) if len(doc) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield (int(doc[a]), *[c[a:b] for c in columns])


class Seen:
    """The least document of 128-bit keys that the batches of a task repeat, the newest ``size`` of them.

    What it forgets is only sent on again, so its bound changes no result.
    """

    def __init__(self, size: int = 1 << 16):
        self.size = size
        self.one, self.two, self.doc = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)

    def later(self, one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a smaller document than ``doc`` is known for each key."""
        if not len(self.one):
            return np.zeros(len(one), bool)
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        return (self.one[at] == one) & (self.two[at] == two) & (self.doc[at] < doc)

    def add(self, one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> None:
        if not len(one):
            return
        held = slice(-self.size // 2, None) if len(self.one) > self.size // 2 else slice(None)
        one, two, doc = one[-self.size :], two[-self.size :], doc[-self.size :]
        one, two, doc = np.r_[self.one[held], one], np.r_[self.two[held], two], np.r_[self.doc[held], doc]
        order = np.lexsort((doc, one))
        one, two, doc = one[order], two[order], doc[order]
        first = np.r_[True, one[1:] != one[:-1]]
        self.one, self.two, self.doc = one[first], two[first], doc[first]


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of a sorted stream, as tables of one or more groups."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch[key].to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        if last is not None and keys[0] != last:
            yield pa.Table.from_batches(held)
            held = []
        last = keys[-1]
        tail = int(np.flatnonzero(keys != last)[-1]) + 1 if (keys != last).any() else 0
        if tail:
            yield pa.Table.from_batches([*held, batch.slice(0, tail)])
            held = []
        held.append(batch.slice(tail))
    if held:
        yield pa.Table.from_batches(held)


def single_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The groups of a sorted stream, each as a table."""
    for table in whole_groups(batches, key):
        keys = table[key].to_numpy()
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield table.slice(a, b - a)


def cut_by_doc(doc: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(doc, *bytes) of each document: its longs as they are; for many small groups, which compression would only slow."""
    order = np.argsort(doc, kind="stable")
    doc, data = doc[order], [c[order].tobytes() for c in columns]
    cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]).tolist() if len(doc) else []
    for d, a, b in zip(doc[cuts[:-1]].tolist(), cuts[:-1], cuts[1:], strict=True):
        yield (d, *[x[8 * a : 8 * b] for x in data])


def place_base(text: bytes | None, salted: bool) -> int:
    """Tells the segments of rows that share a doc_id apart; 0 where no doc_id repeats."""
    return int.from_bytes(hashlib.blake2b(text or b"", digest_size=2).digest(), "little") << 45 if salted else 0


def squeezed(docs: DataFrame, *columns: str) -> DataFrame:
    """The rows with their text compressed, so that moving them costs about what storing them costs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            z = [None if t is None else squeeze(t) for t in batch["text"].to_pylist()]
            yield pa.record_batch([*[batch[c] for c in columns], pa.array(z, pa.binary())], [*columns, "z"])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, "text").mapInArrow(run, f"{schema}, z binary")
