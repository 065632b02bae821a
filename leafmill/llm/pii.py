"""Personal data: fixed patterns plus a linear-chain conditional random field.

The patterns find e-mail addresses, IPv4 addresses, card numbers (Luhn) and
international phone numbers; their spans always stay. The field reads the
tokens of every line through word-shape features, is trained from a small
labelled table, and is decoded by Viterbi for all lines of a batch at once. It
adds what patterns miss: spelled-out addresses, national phone numbers, and
secrets such as access tokens. A span of the field that touches a span of a
pattern is left out.

Offsets are code points, the end exclusive. Defined results: null and empty
texts have no spans; white space alone has no tokens. Null ids, repeated rows
and extra columns (kept in struct ``row``) need no care: a row is on its own.
Lines of any length are decoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import text_batches

KINDS = ("email", "ip", "card", "phone", "secret")
TAGS = ("O", "B-email", "I-email", "B-phone", "I-phone", "B-secret", "I-secret")
REMEMBER = 300_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
#: Words near personal data that the field knows by themselves.
KEYWORDS = """
at dot mail email e-mail contact write phone tel telephone call fax mobile token key apikey api_key secret password
passwd bearer auth = : is
""".split()


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping; from each @ outwards, so that long words cost no backtracking."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end), by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


_RUNS = re.compile(r"[0-9]+|[a-z]+|[A-Z]+|[^\W\d_a-zA-Z]+|.", re.S)


def shapes(token: str) -> tuple[str, str, str]:
    """(fine shape, coarse shape, keyword or nothing) of a token."""
    word = token.strip("\"'.,;()[]").lower()
    key = word if word in _KEYS else (token if token in _KEYS else "")
    if token.isalpha():
        return ("x" if token.islower() else "Xx" if token[1:].islower() else "X" if token.isupper() else "xX"), "x", key
    core = token.strip("\"'.,;()[]")
    hexes = len(core) >= 16 and all(c in "0123456789abcdefABCDEF" for c in core) and not core.isdigit()
    if hexes:
        return "hex", "hex", key
    fine = []
    for r in _RUNS.findall(token):
        c = r[0]
        if c.isdigit():
            fine.append(f"d{min(len(r), 12)}")
        elif c.isalpha():
            fine.append("x" if c.islower() or not c.isupper() else "X")
        else:
            fine.append(c)
    mixed = len(core) >= 16 and any(c.isdigit() for c in core) and any(c.isalpha() for c in core) and core.replace("-", "").replace("_", "").isalnum()
    digits = sum(c.isdigit() for c in core)
    coarse = "mixed" if mixed else f"n{min(digits, 12)}" if digits and not any(c.isalpha() for c in core) else "@" if "@" in core else "xd" if digits else "x" if any(c.isalpha() for c in core) else "p"
    shape = "".join(fine)  # a long shape is known by its digest, all of it
    return shape if len(shape) <= 24 else hashlib.blake2b(shape.encode("utf-8", "replace"), digest_size=8).hexdigest(), coarse, key


_KEYS = frozenset(KEYWORDS)


def labelled_table(n: int = 420, seed: int = 8) -> list[list[tuple[str, str]]]:
    """The small labelled table: lines of (token, tag), made by rule from a fixed seed."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    number = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    word = lambda: "".join(pick("th he in er an re on ti en or ed is at ou é ü ción sch".split()) for _ in range(rng.integers(1, 5)))

    def plain() -> list[tuple[str, str]]:
        out = []
        for _ in range(rng.integers(1, 9)):
            w = word()
            kind = rng.integers(0, 40)
            w = w.capitalize() if kind < 4 else w.upper() if kind == 4 else w + pick(".,;:!?") if kind < 9 else w
            w = pick(["|", "-", "=", "***", "###", number(2), number(4), "1,250", "3.14", "$" + number(3), "(" + w + ")", "x=" + number(1), word() + "-" + word(), number(1) + "."]) if kind > 35 else w
            out.append((w, "O"))
        return out

    def tagged(kind: str, *tokens: str) -> list[tuple[str, str]]:
        return [(t, f"{'I' if k else 'B'}-{kind}") for k, t in enumerate(tokens)]

    def secret() -> list[tuple[str, str]]:
        body = number(int(rng.integers(2, 8))) + "".join(pick("abcdef0123456789") for _ in range(rng.integers(18, 40)))
        if rng.integers(0, 3) == 0:
            body = pick(["sk-", "ghp_", "AKIA", ""]) + "".join(pick("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(24)) + number(2)
        quoted = pick(['"%s"', "'%s'", "%s", "%s."]) % body
        lead = pick([["token", "="], ["api_key", "="], ["secret", ":"], ["key", "="], ["password", "is"], ["Bearer"], []])
        return [(t, "O") for t in lead] + tagged("secret", quoted)

    def phone() -> list[tuple[str, str]]:
        form = rng.integers(0, 4)
        lead = pick([["tel"], ["phone"], ["call"], ["Tel:"], []])
        body = [f"({number(3)})", f"{number(3)}-{number(4)}"] if form == 0 else [f"{number(3)}-{number(3)}-{number(4)}"] if form == 1 else [f"{number(3)}.{number(3)}.{number(4)}"] if form == 2 else [f"+{number(1)}", f"({number(3)})", f"{number(3)}-{number(4)}"]
        return [(t, "O") for t in lead] + tagged("phone", *body)

    def mail() -> list[tuple[str, str]]:
        host = pick(["example", "mail", "test", "site"])
        form = rng.integers(0, 4)
        if form == 0:
            return tagged("email", word(), pick(["at", "(at)", "[at]"]), host, pick(["dot", "(dot)", "[dot]"]), pick(["com", "org", "net"]))
        if form == 1:
            return tagged("email", word(), pick(["(at)", "[at]"]), host + "." + pick(["com", "org"]))
        if form == 2:
            w = pick([word(), "at", "At", "dot", "is"])
            return [("at", "O"), (w, "O"), (pick(["dot", w, w]), "O"), (w, "O")]
        return tagged("email", word() + number(2) + "@" + host + number(1) + ".example.com")

    def other() -> list[tuple[str, str]]:
        return [(pick([number(16), number(13), ".".join(str(x) for x in rng.integers(0, 256, 4)), number(5), number(10), "https://" + word() + ".org/" + word()]), "O")]

    table = []
    for _ in range(n):
        line = plain()
        for _ in range(rng.integers(0, 3)):
            line += pick([secret, phone, mail, other, plain])() + plain()
        table.append(line)
    return table


@dataclass
class Field:
    """Weights of the field: one row of tag scores for each feature value, and the tag transitions.

    A task numbers the shapes it meets; a shape's scores for its own token, for
    the token after and for the token before stand in three tables.
    """

    index: list[dict[str, int]]
    weights: list[np.ndarray]
    steps: np.ndarray
    begin: np.ndarray
    numbers: dict[tuple[str, str, str], int] = field(default_factory=dict)
    memory: dict[str, int] = field(default_factory=dict)
    tables: list[list[np.ndarray]] = field(default_factory=lambda: [[], [], []])

    def number(self, token: str) -> int:
        """The number of the token's shape."""
        shape = shapes(token)
        got = self.numbers.get(shape)
        if got is None:
            got = self.numbers[shape] = len(self.numbers)
            fine, coarse, key = (ix.get(v, 0) for ix, v in zip(self.index, shape, strict=True))
            w = self.weights
            for table, row in zip(self.tables, (w[0][fine] + w[1][coarse] + w[2][key], w[3][coarse] + w[5][key], w[4][coarse] + w[6][key]), strict=True):
                table.append(row)
        if len(self.memory) > REMEMBER:
            self.memory.clear()
        if len(token) < 64:
            self.memory[token] = got
        return got

    def scores(self, shape: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Tag scores of every token from its own features and its neighbours'."""
        own, before, after = (np.array(t, np.float32) for t in self.tables)
        edge_before, edge_after = self.weights[3][1] + self.weights[5][1], self.weights[4][1] + self.weights[6][1]
        out = own[shape]
        left, right = np.empty_like(out), np.empty_like(out)
        left[1:], right[:-1] = before[shape[:-1]], after[shape[1:]]
        left[first], right[last] = edge_before, edge_after
        return out + left + right

    def plain(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Lines whose best path is certainly all O: no step of the chain can repay what any token would lose."""
        gain = 2 * (max(self.steps.max(), self.begin.max()) - min(self.steps[0, 0], self.begin[0]))
        return np.minimum.reduceat(scores[:, 0] - scores[:, 1:].max(1), first) > gain


def _grid(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines by falling length, lines alive at each step, start of each line)."""
    order = np.argsort(-lengths, kind="stable")
    alive = np.cumsum(np.bincount(lengths, minlength=int(lengths.max()) + 1)[::-1])[::-1][1:]
    return order, alive, np.cumsum(lengths) - lengths


def viterbi(scores: np.ndarray, lengths: np.ndarray, steps: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Best tags of all lines, advancing every line by one token at a time."""
    order, alive, start = _grid(lengths)
    start = start[order]
    best = scores[start] + begin
    back = np.zeros(scores.shape, np.int8)
    tags = np.zeros(len(scores), np.int8)
    final = np.zeros(len(order), np.int8)
    for t in range(1, len(alive) + 1):
        n = alive[t] if t < len(alive) else 0
        if n < len(best):
            final[n : len(best)] = best[n:].argmax(1)
            best = best[:n]
        if not n:
            break
        route = best[:, :, None] + steps[None]
        at = start[:n] + t
        back[at] = route.argmax(1)
        best = route.max(1) + scores[at]
    size = lengths[order]
    tags[start + size - 1] = final
    for t in range(len(alive) - 1, 0, -1):
        at = start[: alive[t]] + t
        tags[at - 1] = back[at, tags[at]]
    return tags


def train(table: list[list[tuple[str, str]]], rounds: int = 150, l2: float = 1e-3) -> Field:
    """Maximum likelihood by Adam; gradients from forward and backward sums over all lines in step."""
    lines = [[shapes(t) for t, _ in line] for line in table if line]
    tags = np.array([TAGS.index(g) for line in table for _, g in line])
    index = []
    for k in range(3):
        names = sorted({s[k] for line in lines for s in line})
        index.append({v: i + 2 for i, v in enumerate(names)})  # 0: unknown, 1: beyond the line
    ids = np.array([[ix[v] for ix, v in zip(index, s, strict=True)] for line in lines for s in line])
    lengths = np.array([len(line) for line in lines])
    start = np.cumsum(lengths) - lengths
    first, last = start, start + lengths - 1
    rng = np.random.default_rng(3)
    k = len(TAGS)
    sizes = [len(index[i]) + 2 for i in (0, 1, 2, 1, 1, 2, 2)]
    params = [np.zeros((s, k)) for s in sizes] + [np.zeros((k, k)), np.zeros(k)]
    before, after = np.zeros_like(ids), np.zeros_like(ids)
    before[1:], after[:-1] = ids[:-1], ids[1:]
    before[first], after[last] = 1, 1
    gold = np.eye(k)[tags]
    inner = np.setdiff1d(np.arange(len(tags)), first)
    gold_steps = np.zeros((k, k))
    np.add.at(gold_steps, (tags[inner - 1], tags[inner]), 1)
    order, alive, _ = _grid(lengths)
    begin_at = start[order]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    lse = lambda x, axis: (mx := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - mx).sum(axis))
    for r in range(1, rounds + 1):
        seen = ids.copy()
        seen[rng.random(len(ids)) < 0.1, 0] = 0  # so that unknown shapes lean on the rest
        columns = (seen[:, 0], seen[:, 1], seen[:, 2], before[:, 1], after[:, 1], before[:, 2], after[:, 2])
        scores = sum(p[c] for p, c in zip(params, columns, strict=False))
        steps, begin = params[-2], params[-1]
        alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
        alpha[begin_at] = scores[begin_at] + begin
        for t in range(1, len(alive)):
            at = begin_at[: alive[t]] + t
            alpha[at] = lse(alpha[at - 1][:, :, None] + steps[None], 1) + scores[at]
        for t in range(len(alive) - 1, 0, -1):
            at = begin_at[: alive[t]] + t
            beta[at - 1] = lse(steps[None] + (scores[at] + beta[at])[:, None, :], 2)
        z = np.repeat(lse(alpha[last], 1), lengths)
        err = np.exp(alpha + beta - z[:, None]) - gold
        pair = np.exp(alpha[inner - 1][:, :, None] + steps[None] + (scores[inner] + beta[inner])[:, None, :] - z[inner][:, None, None])
        grads = []
        for p, c in zip(params[:7], columns, strict=True):
            g = np.zeros_like(p)
            np.add.at(g, c, err)
            grads.append(g)
        grads += [pair.sum(0) - gold_steps, err[first].sum(0)]
        for i, g in enumerate(grads):
            g = g / len(lines) + l2 * params[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - 0.1 * (m[i] / (1 - 0.9**r)) / (np.sqrt(v[i] / (1 - 0.999**r)) + 1e-9)
    return Field(index, [p.astype(np.float32) for p in params[:7]], params[7].astype(np.float32), params[8].astype(np.float32))


def decode(model: Field, texts: list[str | None], at_once: int = 250_000) -> list[list[tuple[int, int, int]]]:
    """The field's spans of each text, decoded in blocks of about ``at_once`` tokens of whole lines."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    lines: list[tuple[int, int, str]] = []
    shape: list[int] = []
    lengths: list[int] = []

    def flush() -> None:
        if not lengths:
            return
        size = np.array(lengths)
        first = np.cumsum(size) - size
        scores = model.scores(np.array(shape), first, first + size - 1)
        for i in np.flatnonzero(~model.plain(scores, first)).tolist():
            todo.append((lines[i], scores[first[i] : first[i] + size[i]]))
        lines.clear(), shape.clear(), lengths.clear()

    todo: list[tuple[tuple[int, int, str], np.ndarray]] = []
    get = model.memory.get
    for k, text in enumerate(texts):
        at = 0
        for line in (text or "").split("\n"):
            tokens = line.split()
            if tokens:
                lines.append((k, at, line))
                lengths.append(len(tokens))
                shape += [model.number(t) if (n := get(t)) is None else n for t in tokens]
            at += len(line) + 1
        if len(shape) > at_once:
            flush()
    flush()
    if todo:
        size = np.array([len(s) for _, s in todo])
        tags = viterbi(np.concatenate([s for _, s in todo]), size, model.steps, model.begin)
        for ((k, at, line), _), mine in zip(todo, np.split(tags, np.cumsum(size)[:-1]), strict=True):
            group = None
            if mine.any():
                for m, tag in zip(_TOKEN.finditer(line), mine.tolist(), strict=True):
                    kind = {0: None, 1: 0, 2: 0, 3: 3, 4: 3, 5: 4, 6: 4}[tag]
                    if group is not None and tag and tag % 2 == 0 and group[0] == kind:
                        group[2] = at + m.end()
                    elif kind is not None:
                        group = [kind, at + m.start(), at + m.end()]
                        out[k].append(group)
                    else:
                        group = None
    return out


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while b > a and text[b - 1] in "\"'.,;:!?()[]":
        b -= 1
    while b > a and text[a] in "\"'.,;:([":
        a += 1
    return a, b


def find_in(model: Field, texts: list[str | None]) -> list[tuple[list, list]]:
    """(pattern spans, all spans) of each text, both by kind and start."""
    out = []
    for text, more in zip(texts, decode(model, texts), strict=True):
        base = patterns(text) if text else []
        taken = sorted((a, b) for _, a, b in base)
        starts = np.array([a for a, _ in taken])
        ends = np.maximum.accumulate(np.array([b for _, b in taken])) if taken else starts
        extra = []
        for kind, a, b in more:
            a, b = trimmed(text, a, b)
            k = int(np.searchsorted(starts, b)) if taken else 0
            if a < b and not (k and ends[k - 1] > a):
                extra.append((kind, a, b))
        out.append((base, sorted(base + extra)))
    return out


def find_personal_data(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """The other columns of ``docs`` in struct ``row``, base and spans: arrays of (kind, start, end)."""
    model = model or train(labelled_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        named = lambda xs: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in xs]
        for batch in batches:
            got = find_in(model, batch["text"].to_pylist())
            yield pa.record_batch([batch["row"], pa.array([named(b) for b, _ in got], kind), pa.array([named(s) for _, s in got], kind)], ["row", "base", "spans"])

    rows = text_batches(docs).select(F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]).alias("row"), F.col("text"))
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, base {spans}, spans {spans}")
