"""Collocations against a plain loop over random and odd texts, in blocks and shards of any size."""

import random
import re
from collections import Counter

import pytest

from leafmill.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, phrase string, w string, k string, z string, id string, size string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, k, "p", "w", "k", "z", "i", "s") for i, (t, k) in enumerate(rows)], SCHEMA)


def plain(rows, longest=3, least=10, inside=50, most=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    cands = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    gone = set()
    for k, longer in cands.items():
        for m in range(2, len(k) - 1):
            for i in range(1, len(k) - m + 1):
                part = (k[0], *k[i : i + m])
                if 100 * longer >= inside * f[part]:
                    gone.add(part)
    out = []
    for k, a in cands.items():
        if k not in gone:
            cuts = [(1000000 * a * a // (f[k[: i + 1]] * f[(k[0], *k[i + 1 :])]), i, f[k[: i + 1]], f[(k[0], *k[i + 1 :])]) for i in range(1, len(k) - 1)]
            score, _, left, right = min(cuts)
            out.append((k[0], -score, -a, " ".join(k[1:]).encode(), left, right))
    ranked, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= most:
            ranked.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return ranked


def texts(seed):
    r = random.Random(seed)
    words = ["a", "b", "New", "york", "der", "é", "日本", "ÿ", "x\x00y", "\x1c", " ", "'s", "c"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " a "]
    rows = [("".join(r.choice(words) + r.choice(ends) for _ in range(r.randrange(60))), r.choice(["en", "de", None, "", "und"])) for _ in range(150)]
    return rows + [(None, "en"), ("", None), (" \t\n", "en"), ("a", "fr"), ("hot pair " * 3000, "en"), ("hot pair. " * 3000, "de")] + [("same text of many copies", "en")] * 12


@pytest.mark.parametrize("options", [{}, {"block": 200, "shard": 8}, {"longest": 5, "least": 12, "inside": 70, "most": 40, "block": 3000}])
def test_against_a_plain_loop(spark, options):
    rows = texts(len(options))
    got = C.collocations(frame(spark, rows), **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(rows, **{k: v for k, v in options.items() if k not in ("block", "shard")})
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 30


def test_least_beyond_a_byte(spark):
    rows = [("common pair here", "en")] * 300 + [("rare pair here", "en")] * 299
    got = C.collocations(frame(spark, rows).repartition(4), least=300)
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, least=300))


def test_empty_table(spark):
    assert C.collocations(frame(spark, []).limit(0)).count() == 0
    assert C.collocations(frame(spark, [(None, None)])).count() == 0


def test_cells_only_ever_add_candidates(spark):
    """A cell that several phrases share admits them all; counts stay those of each."""
    block = C.Block("en", __import__("zstandard").ZstdCompressor().compress(b" a b c \xff a b d "))
    cells = block.cells(2, block.starts(2))
    assert set(C.candidates(block, cells, 3)) == {b"a b", b"b c", b"b d"}
    assert C.matches(block.text, [b"a b", b"b c", b"c a", b"b"]).tolist() == [2, 1, 0, 2]
