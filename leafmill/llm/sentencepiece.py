"""SentencePiece unigram encoding and decoding over a double-array trie.

Pieces and their kinds come from a vocabulary file whose path is a parameter;
nothing is trained. The file's own scores are merge ranks, so a piece's log
score is Zipf's law over its rank: ``-ln(1 + rank) - ln(sum of 1 / (1 + r))``,
or the file's scores if ``scores="file"`` is asked for.

A text is read as UTF-8 after one leading space; the whitespace marker stands
for a space, both in the trie and when decoding. Viterbi takes the segmentation
of greatest total score; of equal ones it keeps the one found first, going from
left to right with short pieces before long ones. A character that is no piece
costs the smallest score less 10 and is written as byte pieces; a marker
character in the text itself is such a character, so every text comes back as
it was.

Pieces never cross from a word into a space or a line break; the text is cut
there, new chunks of a batch are segmented together in numpy, and a chunk seen
before in a task is taken from a bounded memory.

Defined results: a null text has null ids and a null decoding; an empty text
has the pieces of the leading space and decodes to an empty text. Unknown ids
decode to nothing, bytes that are no UTF-8 to U+FFFD. Ids and extra columns
may be null; repeated rows are encoded alike.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import text_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
#: Chunks that a task remembers at most; longer chunks than LONG bytes are segmented one by one.
REMEMBER, LONG = 400_000, 96
UNKNOWN_COST = 10.0

_CHUNK = re.compile(rb"\n| *[^ \n]+| +")


class DoubleArray:
    """A trie in two integer arrays: child = base[node] + byte + 1, valid where check[child] == node."""

    def __init__(self, keys: dict[bytes, int]):
        tree: dict = {}
        for key, value in keys.items():
            node = tree
            for byte in key:
                node = node.setdefault(byte, {})
            node[-1] = value
        size = 1 << 12
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        stack = [(tree, 0)]
        start = 1  # slots before it are nearly all taken
        while stack:
            node, at = stack.pop()
            value[at] = node.get(-1, -1)
            kids = sorted(k for k in node if k >= 0)
            if not kids:
                continue
            slot, taken = max(start, kids[0] + 1), 0
            first = slot
            while True:
                if slot + 300 >= len(check):
                    base, check, value = base + [0] * len(base), check + [-1] * len(check), value + [-1] * len(value)
                if check[slot] >= 0:
                    taken += 1
                elif all(check[slot - kids[0] + k] < 0 for k in kids):
                    break
                slot += 1
            if taken > 0.9 * (slot - first + 1) or slot - first > 2000:
                start = max(start, slot)
            b = slot - kids[0] - 1
            base[at] = b
            for k in kids:
                check[b + k + 1] = at
            stack += [(node[k], b + k + 1) for k in kids]
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, value))
        self.longest = max(map(len, keys), default=0)

    def step(self, nodes: np.ndarray, bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(children, valid) of nodes and next bytes."""
        child = self.base[nodes] + bytes_ + 1
        return child, self.check[child] == nodes


@dataclass
class Pieces:
    """A vocabulary: surface bytes (marker as a space), log scores, and which ids are byte pieces."""

    surface: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    normal: np.ndarray

    @classmethod
    def load(cls, path: str = MODEL, scores: str = "zipf") -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        surface, normal, bytes_ = [], np.zeros(n, bool), np.zeros(256, np.int32)
        for i in range(n):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                value = int(piece[3:5], 16)
                bytes_[value] = i
                surface.append(bytes([value]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                surface.append(b"")
            else:
                surface.append(piece.replace(MARKER, " ").encode())
                normal[i] = True
        return cls.of(surface, normal, bytes_, np.array([m.get_score(i) for i in range(n)]) if scores == "file" else None)

    @classmethod
    def of(cls, surface: list[bytes], normal: np.ndarray, byte_ids: np.ndarray, scores: np.ndarray | None = None) -> Pieces:
        if scores is None:
            rank = np.cumsum(normal) - 1.0
            scores = np.where(normal, -np.log(1 + rank.clip(0)), 0) - np.log((1 / (1 + np.arange(max(1, normal.sum())))).sum())
        return cls(surface, scores, byte_ids, normal)


class Unigram:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        keys: dict[bytes, int] = {}
        for i in np.flatnonzero(pieces.normal):
            keys.setdefault(pieces.surface[i], int(i))
        self.trie = DoubleArray(keys)
        self.unknown = float(pieces.scores[pieces.normal].min()) - UNKNOWN_COST if pieces.normal.any() else -UNKNOWN_COST
        self.cuts = not any(b"\n" in k or b" " in k.lstrip(b" ") for k in keys)
        self.memory: dict[bytes, bytes] = {}

    def edges(self, data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, id, score) of every piece and every unknown character; ``left``: bytes to the chunk's end."""
        lead = (data & 0xC0) != 0x80
        width = np.where(data >= 0xF0, 4, np.where(data >= 0xE0, 3, np.where(data >= 0xC0, 2, 1)))
        at = np.flatnonzero(lead)
        node = np.zeros(len(at), np.int32)
        known = np.zeros(len(data), bool)
        found = []
        for length in range(1, self.trie.longest + 1):
            alive = left[at] >= length
            at, node = at[alive], node[alive]
            child, ok = self.trie.step(node, data[at + length - 1].astype(np.int32))
            at, node = at[ok], child[ok]
            if not len(at):
                break
            ids = self.trie.value[node]
            hit = ids >= 0
            found.append((at[hit], np.full(hit.sum(), length), ids[hit], self.p.scores[ids[hit]]))
            known[at[hit & (width[at] == length)]] = True
        lost = np.flatnonzero(lead & ~known)
        found.append((lost, np.minimum(width[lost], left[lost]), np.full(len(lost), -1), np.full(len(lost), self.unknown)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def segment(self, chunks: list[bytes]) -> list[bytes]:
        """Packed little-endian int32 ids of each chunk, all chunks in step."""
        size = np.array([len(c) for c in chunks])
        data = np.frombuffer(b"".join(chunks), np.uint8)
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(chunks)), size)
        place, length, ids, score = self.edges(data, (begin + size)[owner] - np.arange(len(data)))
        row = owner[place]
        offset = place - begin[row]
        wide = int(size.max()) + 1
        best = np.full((len(chunks), wide), -np.inf)
        best[:, 0] = 0
        back = np.zeros((len(chunks), wide), np.int32)
        piece = np.zeros((len(chunks), wide), np.int32)
        order = np.lexsort((length, offset))
        row, offset, length, ids, score = row[order], offset[order], length[order], ids[order], score[order]
        key = offset * (self.trie.longest + 5) + length
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            r, o, n = row[a:b], int(offset[a]), int(length[a])
            value = best[r, o] + score[a:b]
            better = value > best[r, o + n]
            r = r[better]
            best[r, o + n] = value[better]
            back[r, o + n] = n
            piece[r, o + n] = ids[a:b][better]
        out = []
        byte_ids = self.p.byte_ids.tolist()
        for chunk, steps, chosen in zip(chunks, back.tolist(), piece.tolist(), strict=True):
            end, got = len(chunk), []
            while end > 0:
                n = steps[end]
                if chosen[end] < 0:
                    got += [byte_ids[x] for x in reversed(chunk[end - n : end])]
                else:
                    got.append(chosen[end])
                end -= n
            out.append(np.array(got[::-1], "<i4").tobytes())
        return out

    def encode_batch(self, texts: list[bytes | None]) -> list[bytes | None]:
        """Packed ids of each UTF-8 text; None for None."""
        cut = [None if t is None else (_CHUNK.findall(b" " + t) if self.cuts else [b" " + t]) for t in texts]
        if len(self.memory) > REMEMBER:
            self.memory.clear()
        memory = self.memory
        new = list({c for chunks in cut if chunks for c in chunks} - memory.keys())
        short = sorted((c for c in new if len(c) <= LONG), key=len)
        for i in range(0, len(short), 20_000):
            part = short[i : i + 20_000]
            memory.update(zip(part, self.segment(part), strict=True))
        for c in new:
            if len(c) > LONG:
                memory[c] = self.segment([c])[0]
        out = [None if chunks is None else b"".join(map(memory.__getitem__, chunks)) for chunks in cut]
        for c in new:
            if len(c) > LONG:
                del memory[c]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of ids, without the leading space; unknown ids give nothing."""
        ids = ids[(ids >= 0) & (ids < len(self.p.surface))]
        return b"".join(map(self.p.surface.__getitem__, ids.tolist())).removeprefix(b" ")


def encode(docs: DataFrame, path: str = MODEL, keep_ids: bool = True) -> DataFrame:
    """All columns of ``docs`` in struct ``row``, then ids (if ``keep_ids``), n_tokens, n_fallback, ids_sha256, decoded_sha256, round_trip.

    Every text is encoded, decoded again from its ids, and compared; the hashes
    are of the little-endian int32 ids and of the decoded bytes.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Pieces.load(path))  # bounded by the vocabulary
    held: dict[int, Unigram] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.get(0) or held.setdefault(0, Unigram(shared.value))
        fallback = np.isin(np.arange(len(model.p.surface)), model.p.byte_ids)
        for batch in batches:
            texts = batch["utf8"].to_pylist()
            packed = model.encode_batch(texts)
            rows: list[list] = [[], [], [], [], [], []]
            for text, blob in zip(texts, packed, strict=True):
                if blob is None:
                    got = (None,) * 6
                else:
                    ids = np.frombuffer(blob, "<i4")
                    back = model.decode(ids)
                    got = (ids if keep_ids else None, len(ids), int(fallback[ids].sum()), hashlib.sha256(blob).hexdigest(), hashlib.sha256(back).hexdigest(), back == text)
                for column, value in zip(rows, got, strict=True):
                    column.append(value)
            kinds = [pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            columns = [pa.array(v, k) for v, k in zip(rows, kinds, strict=True)]
            names = ["row", "ids", "n_tokens", "n_fallback", "ids_sha256", "decoded_sha256", "round_trip"]
            yield pa.record_batch([batch["row"], *columns], names)

    rows = text_batches(docs).select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["text"].cast("binary").alias("utf8"))
    kept = rows.select(F.struct(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != "text"]).alias("row"), "utf8")
    kind = kept.schema["row"].dataType.simpleString()
    out = kept.mapInArrow(run, f"row {kind}, ids array<int>, n_tokens long, n_fallback long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
    return out if keep_ids else out.drop("ids")


def decode(tokens: DataFrame, path: str = MODEL, ids: str = "ids") -> DataFrame:
    """All columns of ``tokens`` in struct ``row``, and text: what column ``ids`` (array of int) says."""
    shared = tokens.sparkSession.sparkContext.broadcast(Pieces.load(path))
    held: dict[int, Unigram] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.get(0) or held.setdefault(0, Unigram(shared.value))
        for batch in batches:
            got = [None if x is None else model.decode(np.array([i for i in x if i is not None], np.int64)).decode("utf-8", "replace") for x in batch["ids"].to_pylist()]
            yield pa.record_batch([batch["row"], pa.array(got, pa.string())], ["row", "text"])

    rows = text_batches(tokens).select(F.struct("*").alias("row"), F.col(f"`{ids}`").cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string")
