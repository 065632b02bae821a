"""Each method against brute force, its oracle, an exact round trip or held-out rows."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leafmill.llm import decontam, graph, line_dedup, media, pii, sentence_dedup, sentencepiece, shards, simhash, suffix_dedup, toxicity
from leafmill.llm.queries import ORACLES, QUERIES
from tests.conftest import SF

RNG = random.Random(4)


def words(n):
    return " ".join(RNG.choice("ta be ko li mo nu pe ra si to".split()) + RNG.choice("ka lo mi".split()) for _ in range(n))


@pytest.fixture(scope="module")
def copies():
    """Small documents with exact and near copies and shared passages."""
    passage, line = words(60), words(9)
    rows = []
    for i in range(60):
        t = ". ".join(words(RNG.randint(3, 12)) for _ in range(RNG.randint(1, 8)))
        if i % 3 == 0:
            t = t[: len(t) // 2] + " " + passage[RNG.randint(0, 40) :] + ". " + t[len(t) // 2 :]
        if i % 5 == 0:
            t += "\n" + line + "\n" + words(4)
        if i % 7 == 0 and rows:
            t = rows[-1][1].replace("ka", "lo", 1)
        rows.append((i, t))
    return rows + [(60, rows[3][1]), (61, rows[3][1])]


@pytest.fixture(scope="module")
def frame(spark, copies):
    return spark.createDataFrame(copies, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(name, same_as_oracle):
    same_as_oracle(QUERIES[name], ORACLES[name])


def test_cuckoo_holds_what_it_was_given_until_deleted():
    h = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    f = line_dedup.Cuckoo.load(line_dedup.Cuckoo.build(h[:15_000]).dump())
    assert f.holds(h[:15_000]).all() and f.holds(h[15_000:]).mean() < 0.01
    f.delete(h[:5_000])
    assert f.holds(h[5_000:15_000]).all() and f.holds(h[:5_000]).mean() < 0.01


def test_line_index_is_reversible(spark):
    a = spark.createDataFrame([(1, "a shared line here\nonly in one"), (2, "a shared line here\nother text here")], "doc_id long, text string")
    b = spark.createDataFrame([(3, "a shared line here\nother text here\nnew words here")], "doc_id long, text string")
    index = line_dedup.LineIndex(spark)
    index.insert(a)
    kept = lambda: bytes(index.dedup(b).first().new_text).decode()
    assert kept() == "new words here"
    index.delete(spark.createDataFrame([(2,)], "doc_id long"))
    assert kept() == "other text here\nnew words here"
    index.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert kept() == "a shared line here\nother text here\nnew words here"
    index.insert(a)
    assert kept() == "new words here"


def test_line_index_opens_again_and_equals_a_rebuild(spark, tmp_path, monkeypatch):
    """Closed and opened between changes; counts and known lines are those of an index built at once; other parts stay as they are."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 6)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    line = lambda k: f"line number {k} of the texts"
    first = [(i, "\n".join(line(k) for k in range(i, i + 6))) for i in range(30)]
    path = str(tmp_path / "index")
    line_dedup.LineIndex(spark, path).insert(frame(first))
    index = line_dedup.LineIndex(spark, path)
    assert index.shards == 6 and index.state["version"] == 1
    index.insert(frame([(50, line(3) + "\n" + line(100)), (4, line(4))]))  # document 4 is replaced
    before = dict(line_dedup.LineIndex(spark, path).state["parts"])
    index = line_dedup.LineIndex(spark, path)
    index.delete(frame([(0, ""), (50, "")]))
    after = line_dedup.LineIndex(spark, path)
    assert {p for p in before if after.state["parts"].get(p) == before[p]}
    rows = [r for r in first if r[0] not in (0, 4)] + [(4, line(4))]
    rebuilt = line_dedup.LineIndex(spark)
    rebuilt.insert(frame(rows))
    asked = frame([(90, "\n".join(line(k) for k in range(0, 120, 3)))])
    content = lambda t: sorted(map(tuple, t.collect()))
    for one in (after, index):
        assert content(one.table("counts")) == content(rebuilt.table("counts")) and content(one.references()) == content(rebuilt.references())
        assert content(one.known(asked)) == content(rebuilt.known(asked)) and one.state["keys"] == rebuilt.state["keys"]
        assert bytes(one.dedup(asked).first().new_text) == bytes(rebuilt.dedup(asked).first().new_text)
    after.insert(frame([(i, "\n".join(line(k) for k in range(200 + 40 * i, 240 + 40 * i))) for i in range(200, 206)]))  # filters and shards grow
    assert after.shards > 6 and after.known(frame([(999, line(8210))])).count() == 1
    after.delete(after.references().select("doc_id"))
    assert after.state["keys"] == 0 and after.table("counts").count() == 0 and after.known(asked).count() == 0


def test_hot_line_spreads_by_its_count(spark, monkeypatch):
    """A line in every document fills as many pieces as its postings need, and the result is the same."""
    rows = [(i, f"the line that all of them hold\n{i} has a line of its own") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "PIECE", 10)
    got = {r.row.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {i: int(i > 0) for i in range(300)}


def test_suffix_dedup_equals_brute_force(frame, copies):
    first = {}
    for d, t in copies:
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], d)
    for r in suffix_dedup.remove_repeats(frame).collect():
        t = dict(copies)[r.row.doc_id]
        gone = {k for i in range(len(t) - 49) if first[t[i : i + 50]] < r.row.doc_id for k in range(i, i + 50)}
        assert bytes(r.kept).decode() == "".join(c for k, c in enumerate(t) if k not in gone)
        assert (r.n_removed, r.n_spans) == (len(gone), sum(k - 1 not in gone for k in gone))


def test_suffix_dedup_deals_hot_grams_out_alike(frame, monkeypatch):
    want = sorted((r.row.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(frame).collect())
    monkeypatch.setattr(suffix_dedup, "SPLIT", 1)
    assert sorted((r.row.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(frame).collect()) == want


@pytest.mark.parametrize("split", [1, 4096])
def test_suffix_dedup_of_repetitive_and_hot_texts(spark, monkeypatch, split):
    """Texts of few symbols, of one repeated word, and a passage in two thirds of all documents after different words."""
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    hot = words(25)
    rows = [(i, "".join(RNG.choice("ab") for _ in range(RNG.randint(0, 400)))) for i in range(12)]
    rows += [(20 + i, "ha " * RNG.randint(5, 90)) for i in range(8)]
    rows += [(40 + i, words(3)[: RNG.randint(1, 20)] + hot[RNG.randint(0, 9) :] + words(2)) for i in range(60)]
    rows += [(200, "\0" * 90), (201, "\0" * 70 + "x"), (202, "日本" * 40), (199, "本日" * 40)]
    first = {}
    for d, t in sorted(rows):
        b = t.encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        b = dict(rows)[r.row.doc_id].encode()
        gone = {k for i in range(len(b) - 49) if first[b[i : i + 50]] < r.row.doc_id for k in range(i, i + 50)}
        assert bytes(r.kept) == bytes(c for k, c in enumerate(b) if k not in gone), r.row.doc_id
        assert (r.n_removed, r.n_spans) == (len(gone), sum(k - 1 not in gone for k in gone))


def test_longest_previous_factor():
    for _ in range(200):
        d = bytes(RNG.choice(b"ab\0") for _ in range(RNG.randint(0, 60)))
        lpf = suffix_dedup.longest_previous_factor(d)
        for i in range(len(d)):
            assert lpf[i] == max([next((k for k in range(len(d) - i) if d[i + k] != d[j + k]), len(d) - i) for j in range(i)], default=0)


def test_factors_over_documents():
    """Several texts side by side: suffixes in order, common prefixes, and the factor against every suffix of a smaller document."""
    for _ in range(60):
        texts = [bytes(RNG.choice(b"ab\0") for _ in range(RNG.randint(0, 12))) for _ in range(RNG.randint(1, 8))]
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        ends = np.cumsum([len(t) for t in texts])
        left = ends[owner] - np.arange(len(owner)) if len(owner) else np.empty(0, np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        order, common = suffix_dedup.suffix_order(data, left, np.arange(len(data)))
        suffix = [bytes(data[i : i + left[i]]) for i in range(len(data))]
        assert [suffix[i] for i in order] == sorted(suffix)
        shared = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert common.tolist()[1:] == [shared(suffix[a], suffix[b]) for a, b in zip(order, order[1:])]
        ids = np.array([RNG.randint(0, 4) for _ in texts])
        for floor in (1, 3):
            got = suffix_dedup.previous_factors(ids[owner[order]], common, floor)
            for i, f in zip(order, got):
                want = max([shared(suffix[i], suffix[j]) for j in range(len(data)) if ids[owner[j]] < ids[owner[i]]], default=0)
                assert f == (want if want >= floor else 0)


def test_seen_keys_tell_later_documents():
    seen = shards.Seen(4)
    key = lambda *x: np.array(x, np.uint64)
    assert not seen.later(key(1), key(1), np.array([5])).any()
    seen.add(key(1, 1, 2), key(1, 1, 2), np.array([7, 5, 9]))
    assert seen.later(key(1, 1, 1, 2, 3), key(1, 2, 1, 2, 3), np.array([6, 6, 5, 10, 99])).tolist() == [True, False, False, True, False]
    seen.add(key(*range(10, 20)), key(*range(10, 20)), np.arange(10))
    assert len(seen.one) <= 6


def test_packing_round_trip():
    doc, at, h = np.array([3, 3, 9]), np.array([1, 70_000, 2]), np.array([1, 2**47, 5], np.uint64)
    got = shards.unpack_rows(shards.pack(doc, at, h), 1)
    assert all((a == b).all() for a, b in zip(got, (doc, at, h), strict=True))
    assert shards.shared(np.array([4, 1, 4, 2], np.uint64)).tolist() == [True, False, True, False]


def test_shards_grow_in_number_not_in_size(frame):
    """Far more shards than 16 or 20 bits of a hash could name are in use."""
    rows = frame.select("doc_id", F.col("text").cast("binary").alias("text"))
    runs = sentence_dedup.shard_runs(rows, 20_000_000, False, 16, 24).where("not later").agg(F.max("shard")).first()[0]
    segments = suffix_dedup.shard_segments(rows, 50, 16_000_000, False).where("doc_id is null").agg(F.max("shard")).first()[0]
    assert runs > 10_000_000 and segments > 8_000_000
    assert line_dedup.shards_for(10**12) == 10**12 // line_dedup.SHARD_KEYS


def units(text):
    out, at = [], 0
    for m in [*sentence_dedup._END.finditer(text), None]:
        end = m.end() if m else len(text)
        w = text[at:end].lower().split()
        if end > at and len(w) > 24:
            st = [at + x.start() for x in re.finditer(r"\S+", text[at:end])]
            out += [(at if k == 0 else st[k], st[k + 24] if k + 24 < len(st) else end, w[k : k + 24]) for k in range(0, len(w), 24)]
        elif end > at and (w or not out):
            out.append((at, end, w))
        elif end > at:
            out[-1] = (out[-1][0], end, out[-1][2])
        at = max(at, end)
    return out


def test_sentence_spans_equal_brute_force(frame, copies):
    def spans(u):
        n, size = len(u), lambda i, j: sum(len(x[2]) for x in u[i : j + 1])
        ahead = {(i, next((j for j in range(i + 1, n) if size(i, j) >= 16), None)) for i in range(n)}
        behind = {(next((j for j in range(i - 1, -1, -1) if size(j, i) >= 16), None), i) for i in range(n)}
        return sorted(x for x in ahead | behind if None not in x)

    key = lambda u, i, j: " ".join(w for x in u[i : j + 1] for w in x[2])
    first = {}
    for d, t in copies:
        u = units(t)
        for i, j in spans(u):
            first.setdefault(key(u, i, j), (d, i, j))
    for r in sentence_dedup.remove_repeats(frame).collect():
        t = dict(copies)[r.row.doc_id]
        u = units(t)
        gone = {k for i, j in spans(u) if first[key(u, i, j)] != (r.row.doc_id, i, j) for k in range(i, j + 1)}
        assert r.kept == "".join(t[a:b] for k, (a, b, _) in enumerate(u) if k not in gone)


def test_sentence_passage_after_different_lead_in_words(spark):
    """No sentence ends in the passage; the query's cuts fall into step in it."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(200))
    rows = [(n, " ".join([*[word() for _ in range(n)], passage])) for n in (3, 1, 24, 50, 0)]
    for text in [rows[0][1], "to be or not to be " * 40, "a " * 90]:
        starts = sentence_dedup.content_starts(text.split(), 24)
        assert max(np.diff([*starts, len(text.split())])) <= 24 and starts[0] == 0 and min(np.diff(starts)) > 0
    out = {r.row.doc_id: r for r in sentence_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), content_cuts=True).collect()}
    assert out[0].kept == rows[4][1]
    for n, text in rows[:4]:
        assert len(out[n].kept.split()) <= n + 24 and out[n].kept.split()[:n] == text.split()[:n]


def test_sentence_copies_without_spaces_or_of_few_words(spark):
    zh = "天气很好。我们去公园散步！你想一起来吗？他说：“好的。”然后大家出发了。"
    five = "One two three four five. Six seven eight nine ten. Red green blue grey pink. "
    texts = [zh, zh, "前面还有别的话。" + zh + "后面也有。", five + "An end of its own.", "Some other words here first. " + five, "Not long.", "Not long.", "", " "]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.row.doc_id: (r.kept, r.n_sentences) for r in sentence_dedup.remove_repeats(frame, content_cuts=True, few_sentences=3).collect()}
    assert [out[i][0] for i in range(9)] == [zh, "", "前面还有别的话。后面也有。", texts[3], "Some other words here first. ", "Not long.", "", "", " "]
    assert out[0][1] == 5 and sentence_dedup.sentences(zh)[1][-1] == 28
    assert sentence_dedup.spans(np.array([5, 10, 15, 20]), 16, np.arange(4), 3)[0].tolist() == [0, 0, 1]


def test_simhash_equals_brute_force(frame, copies):
    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    prints = {d: fp(t) for d, t in copies}
    parent = {d: d for d in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3 and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    for r in simhash.near_duplicates(frame).collect():
        assert r.fp % (1 << 64) == prints[r.doc_id] and r.component_id == root(r.doc_id)


def test_simhash_links_every_pair_within_distance(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, d, replace=False)) for b, d in zip(base, [1, 2, 3, 4] * 10, strict=True)]
    values = [int(b) for b in base] + near
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    got = {frozenset((r.a, r.b)) for r in links}
    assert got == {frozenset((signed[i], signed[40 + i])) for i in range(40) if i % 4 < 3}


def test_wide_forest_keeps_components():
    rng = np.random.default_rng(5)
    near = rng.integers(0, 1 << 24, 400).astype(np.uint64)
    flips = np.uint64(1) << rng.integers(0, 33, (400, 3)).astype(np.uint64)
    fps = np.unique(np.r_[near, near ^ flips[:, 0], near ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2]])

    def components(links):
        root = list(range(len(fps)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in links:
            assert int(fps[i] ^ fps[j]).bit_count() <= 3
            root[max(find(i), find(j))] = min(find(i), find(j))
        return [find(i) for i in range(len(fps))]

    every = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 3]
    assert components(simhash.wide_forest(fps, 3)) == components(simhash.forest(fps, 3)) == components(every)


def test_forest_spans_components():
    fps = np.array([0, 1, 3, 7, 3 << 40, 255], np.uint64)
    assert {frozenset(x) for x in simhash.forest(fps, 1)} == {frozenset((0, 1)), frozenset((1, 2)), frozenset((2, 3))}
    assert sorted(simhash.forest(fps, 1)) == sorted(simhash.forest(fps, 1, block=1, span=2))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 240)] + [(7, 3), (5, 5), (None, 1)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[k] == 3 for k in [3, 7, *range(200, 240)]) and len(got) == 41 + 42


def test_components_of_hubs_are_the_same(spark, monkeypatch):
    """Nodes with many links take their minimum from a broadcast; here most nodes are hubs."""
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 90, (70, 2))] + [(5, 100 + k) for k in range(60)] + [(900, 901 + k) for k in range(30)]
    frame = spark.createDataFrame(edges, "a long, b long")
    want = sorted(map(tuple, graph.connected_components(frame).collect()))
    parent = list(range(1000))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert want == sorted((x, root(x)) for x in linked)
    monkeypatch.setattr(graph, "HUB_ROWS", 1)
    assert sorted(map(tuple, graph.connected_components(frame).collect())) == want


def test_texts_of_one_item_id_each_count(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(15)) for c in "pq")
    items = spark.createDataFrame([("i", one), ("i", two), ("i", "short text"), ("i", one)], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"lead {one} end"), (2, f"{two} and {one}"), (3, "no such words"), (4, "a short text here")], "doc_id long, text string")
    got = {r.row.doc_id: (r.n_hit, list(r["items"])) for r in decontam.contamination(docs, items).collect()}
    assert got == {1: (15, ["i"]), 2: (30, ["i"]), 3: (0, []), 4: (2, ["i"])}
    assert {r.doc_id for r in decontam.proximity_matches(docs, items).collect()} == {1, 2, 4}


def test_long_items_stay_linear(spark):
    """An item of 20,000 words has so many rows of terms, and one row of words; every window of it is found."""
    rng = random.Random(3)
    text = [rng.choice("abcdefghij") + str(rng.randint(0, 4000)) for _ in range(20_000)]
    items = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(text[100:113]))], "item_id long, text string")
    texts = decontam.benchmark_items(items)
    assert decontam.item_terms(texts).count() == 20_013
    docs = spark.createDataFrame([(1, ", ".join(["lead", *text[5000:5600], "end."])), (2, " ".join(text[40:52])), (3, "\u2014" + " ".join(text[100:113])), (4, "(" + " ".join(text[100:113]) + ")")], "doc_id long, text string")
    got = {r.row.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontam.contamination(docs, items).collect()}
    assert got == {1: (602, 600, ["1"]), 2: (12, 0, []), 3: (13, 0, []), 4: (13, 13, ["1", "2"])}  # the dash is a letter of its word
    starts = {r.row.doc_id: [(m.item_id, m.starts) for m in r.matches] for r in decontam.phrase_matches(docs, items).collect()}
    assert sorted(starts[4]) == [(1, [0]), (2, [0])] and sum(len(s) for _, s in starts[1]) == 588 and min(s[0] for _, s in starts[1]) == 1


def test_items_too_large_to_broadcast_are_shuffled(spark):
    from leafmill.llm import common

    big = spark.range(3).select(F.repeat(F.lit("x"), 1000).alias("term"))
    assert common.small_enough(big, 2) is big and common.small_enough(big, 3, F.octet_length("term"), 2999) is big
    assert common.small_enough(big, 3, F.octet_length("term"), 3000) is not big


def test_proximity_and_phrases(spark):
    docs = spark.createDataFrame([(1, "zz alpha beta xx gamma yy"), (2, "alpha beta gamma"), (3, "gamma alpha q q q q q q beta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    phrases = {r.row.doc_id: r.matches for r in decontam.phrase_matches(docs, items).collect()}
    assert phrases[1] == [] and [m.starts for m in phrases[2]] == [[0]]
    near = {r.doc_id for r in decontam.proximity_matches(docs, items, slop=2).collect()}
    assert 2 in near and 1 in near


def test_unigram_equals_plain_viterbi_and_comes_back():
    vocabulary = [b" a", b"a", b"b", b"ab", b"ba", b" ab", b" ", b"aba", "é".encode(), b"  "]
    surface = [bytes([i]) for i in range(256)] + vocabulary
    normal = np.arange(len(surface)) >= 256
    p = sentencepiece.Pieces.of(surface, normal, np.arange(256, dtype=np.int32))
    u = sentencepiece.Unigram(p)
    keys = {surface[i]: i for i in range(256, len(surface))}

    def best(b):
        b = b" " + b
        score, back = {0: 0.0}, {}
        for i in range(len(b)):
            if i not in score or b[i] & 0xC0 == 0x80:
                continue
            width = next(n for n in (1, 2, 3, 4) if i + n == len(b) or b[i + n] & 0xC0 != 0x80)
            for n in range(1, 5):
                s = p.scores[keys[b[i : i + n]]] if b[i : i + n] in keys and i + n <= len(b) else u.unknown if n == width and b[i : i + n] not in keys else None
                if s is not None and score[i] + s > score.get(i + n, -np.inf):
                    score[i + n] = score[i] + s
        return score[len(b)]

    for _ in range(300):
        t = "".join(RNG.choice(["a", "b", " ", "é", "x", "▁", "\n", "😀"]) for _ in range(RNG.randint(0, 30))).encode()
        ids = np.frombuffer(u.encode_batch([t])[0], "<i4")
        assert u.decode(ids) == t
        text = u.p.surface
        got, k = 0.0, 0
        flat = b"".join(text[i] for i in ids)
        assert flat == b" " + t
        run = 0
        for i in ids.tolist():
            if normal[i]:
                got += p.scores[i]
            else:
                run += 1
        lost = sum(1 for c in (" " + t.decode()) if c in "x▁\n😀")
        assert abs(got + lost * u.unknown - best(t)) < 1e-6 and k == 0 and run >= lost


def test_long_words_are_whole():
    p = sentencepiece.Pieces.load()
    u = sentencepiece.Unigram(p)
    t = ("supercalifragilistic" * 500).encode()
    assert u.decode(np.frombuffer(u.encode_batch([t])[0], "<i4")) == t


def test_decode_frame(spark):
    d = spark.createDataFrame([(1, "Hello  wörld\n▁x"), (2, None)], "doc_id long, text string")
    back = sentencepiece.decode(sentencepiece.encode(d).select("row.doc_id", "ids"))
    assert {r.row.doc_id: r.text for r in back.collect()} == {1: "Hello  wörld\n▁x", 2: None}


def test_wav_round_trip_and_fingerprint_of_a_tone():
    payload = media.payload_of("é".encode() * 500)
    data, channels, width, rate = media.from_wav(media.to_wav(payload))
    assert (data, channels, width, rate) == (payload, 1, 1, media.RATE) and len(payload) % media.BLOCK == 0
    t = np.arange(8000) / media.RATE
    tone = np.sin(2 * np.pi * 1000 * t)
    _, bins = media.peaks(tone)
    assert round(1000 * media.FRAME / media.RATE) in bins.tolist()
    assert (media.fingerprint(tone) == media.fingerprint(tone.copy())).all()


def test_unreadable_media(spark):
    out = media.read_media(spark.createDataFrame([(1, b"nothing"), (2, None)], "id long, media binary")).collect()
    assert {r.row.id: r.status.split(":")[0] for r in out} == {1: "unreadable", 2: "null"}


def test_field_learns_and_patterns_equal_regexes():
    model = pii.train(pii.labelled_table())
    table = pii.labelled_table(150, seed=77)
    got = pii.decode(model, [" ".join(t for t, _ in line) for line in table])
    good = total = found = 0
    for line, spans in zip(table, got, strict=True):
        at, want = 0, []
        for token, tag in line:
            if tag[0] == "B":
                want.append([pii.KINDS.index(tag[2:]), at, at + len(token)])
            elif tag[0] == "I":
                want[-1][2] = at + len(token)
            at += len(token) + 1
        a, b = {tuple(x) for x in want}, {tuple(x) for x in spans}
        good, total, found = good + len(a & b), total + len(a), found + len(b)
    assert good >= 0.9 * total and good >= 0.9 * found
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for _ in range(500):
        t = "".join(RNG.choice("a.@-1+ b") for _ in range(40))
        assert pii.emails(t) == [m.span() for m in email.finditer(t)]
    long = "a" * 200_000 + "1" * 200_000
    assert pii.patterns(long) == []


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(2)
    k = 3
    steps, begin = rng.normal(size=(k, k)), rng.normal(size=k)
    lengths = np.array([4, 1, 3])
    scores = rng.normal(size=(8, k))
    got = pii.viterbi(scores, lengths, steps, begin)
    at = 0
    for n in lengths:
        s = scores[at : at + n]
        best = max(np.ndindex(*[k] * n), key=lambda p: begin[p[0]] + sum(s[i, p[i]] for i in range(n)) + sum(steps[p[i], p[i + 1]] for i in range(n - 1)))
        assert tuple(got[at : at + n]) == best
        at += n


def test_label_model_finds_the_good_voters():
    rng = np.random.default_rng(3)
    y = rng.random(2000) < 0.2
    vote = lambda right: np.where(rng.random(2000) < right, np.where(y, 1, -1), np.where(y, -1, 1))
    votes = np.stack([vote(0.9), vote(0.85), vote(0.8), vote(0.5)], 1)
    post, weight, odds = toxicity.label_model(votes.astype(float), 0.2)
    assert ((post > 0.5) == y).mean() > 0.93 and odds[0, 2] > odds[3, 2] + 1


def test_toxicity_on_held_out_rows(spark):
    """Well above the majority class (88 in 100 rows are clean) and in order; the label model knows no label but the prior."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    held = toxicity.score(docs.join(labels, "doc_id").where(F.expr(toxicity.HELD_OUT)), model).select("row.toxic", "score").toPandas()
    right = ((held.score >= 0.5) == held.toxic.astype(bool)).mean()
    majority = max(held.toxic.mean(), 1 - held.toxic.mean())
    assert majority < 0.9 and right >= 0.95 and right > majority + 0.05
    rank, n = held.score.rank(), held.toxic.sum()
    assert (rank[held.toxic == 1].sum() - n * (n + 1) / 2) / n / (len(held) - n) >= 0.95
    assert model.agreement > 0.95 and [v for v, _ in model.accuracies if "label" in v] == []
    assert 0 <= model.score("") <= 1 and 0 <= model.score(None) <= 1


def test_toxicity_query_is_its_model_row_by_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    import zlib

    for r in QUERIES["op10_toxicity"](spark, SF).collect():
        assert abs(r.score - model.score(texts[r.doc_id])) < 1e-9 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_pipeline_stages_agree_with_their_operators(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = pipeline.run(spark, SF).collect()
    ids = {r.doc_id for r in out}
    assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) == len(out) and all(r.round_trip for r in out)
    columns = set(docs.columns)
    for name, stage in pipeline.STAGES[:-1]:
        assert set(stage(spark, docs, SF).columns) == columns, name


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_hits(text, items):
    """(words, hit words) of a text by the contract's windows."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit = split(text), set()
    at = {}
    for i in items:
        v = split(i)
        n = min(13, len(v))
        for s in range(len(v) - n + 1 if n else 0):
            at.setdefault(n, set()).add(tuple(v[s : s + n]))
    for n, windows in at.items():
        for s in range(len(w) - n + 1):
            if tuple(w[s : s + n]) in windows:
                hit |= set(range(s, s + n))
    return len(w), len(hit)


def test_pipeline_equals_brute_force(spark):
    """The chained stages over all rows against plain loops, each on what the one before kept."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id: r.text or "" for r in docs.collect() if model.score(r.text) < 0.5}

    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\r\x0b\x0c"))
    holders = {}
    for d, t in kept.items():
        for line in t.split("\n"):
            holders.setdefault(key(line), set()).add(d)
    kept = {d: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or min(holders[key(x)]) == d) for d, t in kept.items()}

    prints = {d: plain_fingerprint(t) for d, t in kept.items()}
    group = {d: d for d in kept}
    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    kept = {d: t for d, t in kept.items() if group[d] == d}

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    counts = {d: plain_hits(t, items) for d, t in kept.items()}
    kept = {d: t for d, t in kept.items() if not (counts[d][1] and 20 * counts[d][1] >= counts[d][0])}
    out = {r.doc_id: r for r in pipeline.run(spark, SF).collect()}
    assert set(out) == set(kept) and any(h for _, h in counts.values())
    assert all(r.round_trip and r.decoded_sha256 == hashlib.sha256(kept[d].encode()).hexdigest() for d, r in out.items())


def test_media_columns_of_every_row(spark):
    import zlib

    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op6_media"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        b = texts[r.doc_id]
        payload = b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(b), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        wav = media.to_wav(payload)
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
    same = {}
    for r in rows:
        assert same.setdefault(texts[r.doc_id], r.feature) == r.feature


def plain_patterns(t):
    """The contract's base spans by its own regexes."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_personal_data_equals_the_regexes_on_every_row(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op8_pii"](spark, sf).collect()
    assert len(rows) == len(texts)
    total = 0
    for r in rows:
        base = plain_patterns(texts[r.doc_id])
        total += len(base)
        joined = [f"{k}:{a}:{b}" for k, a, b in base]
        assert [sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone")] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
        assert hashlib.sha256(",".join(joined).encode()).hexdigest() == r.base_sha256
        spans = r.spans.split(",") if r.spans else []
        assert set(joined) <= set(spans) and len(spans) == r.n_spans
    assert total > 50
    for _ in range(3000):
        t = "".join(RNG.choice("a.@-1+ 25(4") for _ in range(60))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.patterns(t)] == plain_patterns(t)


def test_recall_of_each_kind_on_sentences_of_another_make():
    """Written by hand, apart from the generator of the training table; found means that a span of the kind overlaps."""
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n - 2)) + digits(2)

    def card():
        d = "4" + digits(14)
        last = next(c for c in "0123456789" if pii.luhn(d + c))
        d += last
        return rng.choice([d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))])

    name = lambda: rng.choice(["maria.lopez", "j_smith", "anna", "tom.k", "info"])
    site = lambda: rng.choice(["example.org", "mail.example.com", "shop-online.net", "uni.edu"])
    make = {
        "email": lambda: rng.choice([f"{name()}@{site()}", f"{name()}+news@{site()}", f"{name()} (at) example (dot) org", f"{name()} [at] mail.net"]),
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: rng.choice([f"+44 20 {digits(4)} {digits(4)}", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"]),
        "secret": lambda: rng.choice([hexes(40), hexes(32), "ghp_" + mixed(36), "sk-" + mixed(40)]),
    }
    before = ["Please write to", "The old record says", "In case of trouble use", "He left this note:", "Our log shows", "Yesterday we saw", "My new one is", "value ="]
    after = ["and wait for an answer.", "until Monday.", "", "which was never changed", "- thanks!", ", as agreed."]
    model = pii.train(pii.labelled_table())
    for kind, one in make.items():
        texts, wanted = [], []
        for _ in range(120):
            lead, value = rng.choice(before) + " ", one()
            texts.append(lead + value + " " + rng.choice(after))
            wanted.append((len(lead), len(lead) + len(value)))
        found = sum(any(pii.KINDS[k] == kind and a < end and b > start for k, a, b in spans) for (_, spans), (start, end) in zip(pii.find_in(model, texts), wanted))
        assert found >= 0.9 * len(texts), (kind, found)
    clean = ["The meeting on 2024-05-01 has 12 items, at 10:30.", "Version 1.2.3 costs $19.99 at most.", "See chapter 4.2 at the end of it.", "A well-known, state-of-the-art thing.", "He was born in 1984 and lives there.", "https://example.org/path/to/page?id=12"]
    assert [s for _, spans in pii.find_in(model, clean) for s in spans] == []


def test_shapes_read_whole_tokens():
    a, b = ("ab1-" * 60 + x for x in ("c", "7"))
    assert pii.shapes(a) != pii.shapes(b) and len(pii.shapes(a)[0]) <= 24


def test_content_cuts_are_the_least_hashes_of_all_windows():
    """Against every window by itself, with equal words; a repeated word is hashed once."""
    import random

    from leafmill.llm import sentence_dedup as D

    rng = random.Random(11)
    D._word_hash.cache_clear()
    for _ in range(200):
        width, words = rng.randint(1, 24), [rng.choice("abcdefghij") for _ in range(rng.randint(25, 80))]
        hashes = [D.xxhash.xxh3_64_intdigest(w.encode()) for w in words]
        ends = {max(range(i, i + width), key=lambda k: (-hashes[k], k)) + 1 for i in range(len(words) - width + 1)}
        assert D.content_starts(words, width) == [0, *sorted(ends - {len(words)})]
    assert D._word_hash.cache_info().misses == 10


@pytest.mark.parametrize("few,many", [(1 << 20, 4), (-1, 4), (-1, 0)])
def test_suffix_dedup_cuts_no_whole_copies(spark, monkeypatch, few, many):
    """Twelve copies of each text, of nothing and of 49, 50 and 51 bytes: copies are left out by a broadcast or by moving texts, or are cut like others."""
    texts = [words(60), words(90), "", None, "y" * 49, "x" * 50, "".join(RNG.choices("abcdef", k=51)), "日本" * 30]
    rows = [(100 * k + i, t) for k in range(12) for i, t in enumerate(texts)] + [(5, words(40)), (3000, "lead " + texts[0])]
    rows = [(d, t) for d, t in rows if d != 5 or t != "x" * 50]  # no doc_id stands twice
    marks = []

    def stored(df, name, store=suffix_dedup.stored):
        out = store(df, name)
        if name == "marks":
            marks.append(out.agg(F.count_distinct("doc_id")).first()[0])
        return out

    for name, value in (("stored", stored), ("FEW_COPIES", few), ("MANY_COPIES", many)):
        monkeypatch.setattr(suffix_dedup, name, value)
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows)
    for r in got:
        b = (dict(rows)[r.row.doc_id] or "").encode()
        gone = {k for i in range(len(b) - 49) if first[b[i : i + 50]] < r.row.doc_id for k in range(i, i + 50)}
        assert bytes(r.kept) == bytes(c for k, c in enumerate(b) if k not in gone), r.row.doc_id
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), len(gone), sum(k - 1 not in gone for k in gone))
    # without the copies only the text that begins otherwise and its like have something to be cut or compared
    assert marks[0] <= 2 if many or few > 0 else marks[0] > 40


def test_segments_of_texts_side_by_side_are_those_of_each():
    texts = [RNG.randbytes(n) if n % 2 else b"ab " * n for n in (0, 1, 49, 50, 51, 400, 7, 2000, 40_000, 0, 300, 63)]
    for length in (36, 50, 64):
        together = suffix_dedup.segments_of(texts, length)
        for i, text in enumerate(texts):
            one = suffix_dedup.segments(text, length)
            assert all((x[together[0] == i] == y).all() for x, y in zip(together[1:], one, strict=True))
            assert one[4].sum() == max(0, len(text) - length + 1) and (np.diff(one[2]) == one[4][:-1]).all()
